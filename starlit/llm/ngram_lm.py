"""Language-model scoring with a log-frequency Bloom filter.

Training tokens (words and one end per text) are counted, single tokens and pairs. A token or pair with count
c enters a Bloom filter once per level 1 .. 1 + floor(log_b c), with b = 2 for pairs and 2**(1/4) for single
tokens; probing it level by level until the first miss gives its quantised count. The probability of a token
is UNIGRAM_SHARE of its smoothed quantised frequency (normalised over the quantised vocabulary) plus the rest
of the quantised count of the pair (rounded down) over that of the token before it (rounded up), so that the
mixture stays a probability but for the filter's few false positives.

Counts are summed inside tasks before the shuffle, where a pair is one 64-bit value. The filter is built in
parts, one per ``PART_TOKENS`` training tokens, each by one task over the hashes that fall to it and sized by its
insertions; every token and pair enters, at every input size. The parts are a written table. Up to ``MAX_BITS`` of
them are broadcast whole. Beyond that the texts are written in chunks of some ``CHUNK_TEXT`` bytes, and the parts are
dealt into buckets of some ``ROUTE_BYTES``. The distinct hashes of a chunk go to the tasks that hold their buckets, sorted
and as gaps; many chunks are probed at once there, and the levels found come back to the chunk. What is asked and
answered follows the n-grams; a chunk makes a row for each bucket, not for each part.
Both ways score by the same levels.

``base_score`` uses exact counts: those of the most frequent words (at most ``MAX_WORDS``) are broadcast, the
rest of each document's words is joined with the table of all counts.

Tokens: ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end; tokens are compared by 64-bit hash.
Training documents: crc32(doc_id as text) mod 5 is not 1.

Defined results: a null text is empty and scores its end alone; a null id trains; without training documents
all counts are 0; repeated rows count and score each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlit.llm.common import add_missing, arrow_batches, session_conf, stash, table
from starlit.llm.near_dedup import BATCH_BYTES, _chunks, _mix, _texts, word_hashes

BITS = 8          # per insertion
PROBES = 4        # nine bits each of one hash
BLOCK_BYTES = 64
MAX_BITS = 1 << 31
PART_TOKENS = 1_000_000
FLUSH_TOKENS = 3_000_000
MAX_WORDS = 2_000_000
UNIGRAM_SHARE = 0.6
BATCH_ROWS = 200
PROBE_BLOCK = 1 << 16  # hashes probed together: what they need stays in the cache
CHUNK_TEXT = 8 << 20
ROUTE_BYTES = 4 << 20  # of the filter, held at a time where it is probed in buckets
# files of a shuffle are dropped when the table made from it is written: each is read once
SHUFFLE_ONCE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

_U = np.uint64
END = _U(0x0123456789ABCDEF)
START = _U(0xFEDCBA9876543210)
_LEFT, _RIGHT = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)


SINGLE, PAIR = 4, 1  # levels per doubling of the count


def levels(counts: np.ndarray, per_doubling: int) -> np.ndarray:
    """Number of filter levels of exact counts: 1 + floor(per_doubling * log2 c)."""
    return 1 + np.floor(per_doubling * np.log2(counts) + 1e-9).astype(np.int64)


def singles(tokens: np.ndarray) -> np.ndarray:
    """56-bit hashes of tokens, the lowest bit 0."""
    return (_mix(tokens * _LEFT) >> _U(8)) & ~_U(1)


def pairs_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """56-bit hashes of token pairs, the lowest bit 1."""
    return (_mix(left * _LEFT + _mix(right * _RIGHT)) >> _U(8)) | _U(1)


def token_runs(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts of bounded size: first text's number, tokens with ends, owner of each, token before each."""
    for first, run in _chunks(texts):
        words, owner = word_hashes(run)
        counts = np.bincount(owner, minlength=len(run)).astype(np.int64)
        ends = np.cumsum(counts + 1) - 1
        tokens = np.empty(len(words) + len(run), dtype=np.uint64)
        is_word = np.ones(len(tokens), dtype=bool)
        is_word[ends] = False
        tokens[is_word], tokens[ends] = words, END
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[np.concatenate([[0], ends[:-1] + 1])] = START
        yield first, tokens, np.repeat(np.arange(len(run)), counts + 1), before


def _counted(batches: Iterator[pa.RecordBatch], of: Callable, pack: Callable) -> Iterator[pa.RecordBatch]:
    """Counts of the hashes that ``of`` makes of token runs, summed over up to FLUSH_TOKENS tokens."""
    held, size = [], 0

    def flush():
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        for k in range(0, len(values), 100_000):
            yield pack(values[k:k + 100_000], counts[k:k + 100_000])

    for batch in batches:
        for _, tokens, _, before in token_runs(_texts(batch.column("text"))):
            held.append(of(tokens, before))
            size += len(tokens)
            if size >= FLUSH_TOKENS:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _counted(batches, lambda tokens, before: tokens, lambda v, c: pa.RecordBatch.from_arrays(
        [pa.array(v.view(np.int64)), pa.array(c.astype(np.int64))], names=["word", "c"]))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pack(values, counts):  # hash in the upper 56 bits, count in the lower 8; larger counts take several rows
        rows = [(values[counts > 255 * k] << _U(8)) | np.clip(counts[counts > 255 * k] - 255 * k, 1, 255).astype(np.uint64)
                for k in range(-(-int(counts.max()) // 255))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows).view(np.int64))], names=["packed"])
    yield from _counted(batches, lambda tokens, before: np.concatenate([singles(tokens), pairs_of(before, tokens)]), pack)


class FrequencyFilter:
    """Log-frequency Bloom filter in parts; a hash belongs to part ``hash % parts``. The probes of a hash at one level
    lie in one block of 64 bytes, so a level costs one look into memory and one hash."""

    def __init__(self, parts: int, filled: dict[int, bytes]):
        self.parts = parts
        sizes = np.array([len(filled.get(k, b"")) // BLOCK_BYTES for k in range(parts)], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.uint64)
        self.sizes = sizes.astype(np.uint64)
        self.words = np.frombuffer(b"".join(filled.get(k, b"") for k in range(parts)), dtype="<u8")

    @staticmethod
    def places(hashes: np.ndarray, level: int, blocks: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Block of each hash at a level, and four bit numbers of nine bits each inside it."""
        x = _mix(hashes + _U(level * int(_LEFT) & 0xFFFF_FFFF_FFFF_FFFF))
        return ((x >> _U(32)) * blocks) >> _U(32), (x * _RIGHT) >> _U(64 - 9 * PROBES)

    @classmethod
    def build_part(cls, hashes: np.ndarray, counts: np.ndarray) -> bytes:
        deep = np.where(hashes & _U(1) == 1, levels(counts, PAIR), levels(counts, SINGLE))
        blocks = max(1, -(-int(deep.sum()) * BITS // (8 * BLOCK_BYTES)))
        flags = np.zeros(blocks * 8 * BLOCK_BYTES, dtype=np.uint8)
        for level in range(1, int(deep.max(initial=0)) + 1):
            block, bits = cls.places(hashes[deep >= level], level, _U(blocks))
            for probe in range(PROBES):
                flags[(block << _U(9)) | ((bits >> _U(9 * probe)) & _U(511))] = 1
        return np.packbits(flags, bitorder="little").tobytes()

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Levels found by probing one after the other until a miss; 0 if the first is missing."""
        out = np.zeros(len(hashes), dtype=np.int64)
        for at in range(0, len(hashes), PROBE_BLOCK):
            self._probe(hashes[at:at + PROBE_BLOCK], out[at:at + PROBE_BLOCK])
        return out

    def _probe(self, hashes: np.ndarray, out: np.ndarray) -> None:
        part = (hashes % _U(self.parts)).astype(np.int64) if self.parts > 1 else np.zeros(len(hashes), dtype=np.int64)
        starts, sizes = self.starts[part], self.sizes[part]
        alive, level = np.flatnonzero(sizes > 0), 1
        hashes, starts, sizes = hashes[alive], starts[alive], sizes[alive]
        while len(alive):
            block, bits = self.places(hashes, level, sizes)
            word, hit = (starts + block) << _U(3), _U(1)
            for probe in range(PROBES):
                at = (bits >> _U(9 * probe)) & _U(511)
                hit = hit & (self.words[(word | (at >> _U(6))).view(np.int64)] >> (at & _U(63)))
            kept = np.flatnonzero(hit)
            alive, hashes, starts, sizes = alive[kept], hashes[kept], starts[kept], sizes[kept]
            out[alive] = level
            level += 1


class NearWords:
    """Exact counts of the frequent words by binary search (``words`` sorted), and their levels in the filter as far as
    they were probed: a frequent word is probed once per worker. Both are as long as the broadcast list of words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.words, self.counts = words, counts
        self.known = np.full(len(words), -1, dtype=np.int16)

    def _places(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.words):
            return np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=bool)
        at = np.minimum(np.searchsorted(self.words, asked), len(self.words) - 1)
        return at, self.words[at] == asked

    def look_up(self, asked: np.ndarray, grams: FrequencyFilter | FoundLevels) -> tuple[np.ndarray, np.ndarray]:
        """(count, level) of distinct words; count 0 for those not held."""
        at, held = self._places(asked)
        if not len(self.words):
            return np.zeros(len(asked), dtype=np.int64), grams.levels(singles(asked))
        level = np.where(held, self.known[at], -1).astype(np.int64)
        new = np.flatnonzero(level < 0)
        level[new] = grams.levels(singles(asked[new]))
        kept = new[held[new]]
        self.known[at[kept]] = level[kept]
        return np.where(held, self.counts[at], 0), level


class FoundLevels:
    """Levels of a chunk's distinct hashes, already probed; ``hashes`` sorted. Only those are asked for again: a hash is
    looked for from the first one of its upper bits on."""

    def __init__(self, hashes: np.ndarray, found: np.ndarray):
        self.hashes, self.found = hashes, found
        upper = len(hashes).bit_length()
        self.shift = _U(56 - upper)
        self.starts = np.searchsorted(hashes, np.arange(1 << upper, dtype=np.uint64) << self.shift)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        at = self.starts[hashes >> self.shift]
        left = np.flatnonzero(self.hashes[at] != hashes)
        while len(left):
            at[left] += 1
            left = left[self.hashes[at[left]] != hashes[left]]
        return self.found[at].astype(np.int64)


def _fill(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column("packed").to_numpy() for b in batches if b.num_rows]
        if not held:
            return
        packed = np.concatenate(held).view(np.uint64)
        packed.sort()
        hashes, counts = packed >> _U(8), (packed & _U(255)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        hashes, counts = hashes[first], np.add.reduceat(counts, first)
        part = (hashes % _U(parts)).astype(np.int64)
        for k in np.unique(part):
            mine = part == k
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(k)], pa.int32()), pa.array([FrequencyFilter.build_part(hashes[mine], counts[mine])], pa.binary())],
                names=["part", "bits"])
    return run


class Scorer:
    """Scores texts given the counts of frequent words. Holds what a worker needs beside them.
    n, v: training tokens, all and distinct; n_soft: sum of the quantised counts in the filter."""

    def __init__(self, n: int, v: int, n_soft: float, n_docs: int, grams: FrequencyFilter | FoundLevels | None):
        self.n, self.v, self.n_soft, self.n_docs, self.grams = n, v, n_soft, n_docs, grams

    def score(self, texts: list[bytes], near: NearWords, complete: bool, runs: list | None = None):
        """(n_tokens, n_known, base_score, score) of each text and its words whose count isn't at hand, as
        arrays of (text number, word, times); with ``complete`` counts there are none: unknown is 0.
        ``runs``: the texts' token runs, if at hand."""
        n_tokens, n_known = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        base, score = np.zeros(len(texts)), np.zeros(len(texts))
        rare: list[np.ndarray] = [np.zeros((0, 3), dtype=np.int64)]
        room, soft_room = self.n + 0.5 * (self.v + 1), self.n_soft + 0.5 * (self.v + 1)
        for first, tokens, owner, before in token_runs(texts) if runs is None else runs:
            m = int(owner[-1]) + 1
            distinct, back = np.unique(tokens, return_inverse=True)
            c, level = near.look_up(distinct, self.grams)
            low = np.where(level > 0, 2.0 ** ((level - 1) / SINGLE), 0.0)
            p1 = ((low * 2 ** (0.5 / SINGLE) + 0.5) / soft_room)[back]
            high = np.where(level > 0, 2.0 ** (level / SINGLE), 0.0)[back]
            history = np.empty(len(tokens))
            history[1:] = high[:-1]
            history[before == START] = self.n_docs
            level2 = self.grams.levels(pairs_of(before, tokens))
            c2 = np.minimum(np.where(level2 > 0, 2.0 ** (level2 - 1), 0.0), history)
            p = np.where(history > 0, UNIGRAM_SHARE * p1 + (1 - UNIGRAM_SHARE) * c2 / np.maximum(history, 1), p1)
            at = slice(first, first + m)
            known, exact = (c > 0)[back], np.log10((np.maximum(c, 0) + 0.5) / room)[back]
            if not complete and (c == 0).any():
                open_ = ~known
                exact = np.where(open_, 0.0, exact)
                found, times = np.unique(np.stack([first + owner[open_], tokens[open_].view(np.int64)], 1), axis=0, return_counts=True)
                rare.append(np.concatenate([found, times[:, None]], 1))
            n_tokens[at] = np.bincount(owner, minlength=m)
            n_known[at] = np.bincount(owner, weights=known, minlength=m).astype(np.int64)
            base[at] = np.bincount(owner, weights=exact, minlength=m)
            score[at] = np.bincount(owner, weights=np.log10(p), minlength=m)
        return (n_tokens, n_known, base, score), np.concatenate(rare)


_SCORED = ("doc_id bigint, held_out boolean, row bigint, n_tokens bigint, n_known bigint, base_score double, score double, "
           "rare array<bigint>, times array<bigint>")


def _scored_batch(scorer: Scorer, near: NearWords, complete: bool, texts: list[bytes], doc_id, held_out, rows, runs=None) -> pa.RecordBatch:
    columns, rare = scorer.score(texts, near, complete, runs)
    rare = rare[np.argsort(rare[:, 0], kind="stable")]
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rare[:, 0], minlength=len(texts)))]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(rare[:, k].copy())) for k in (1, 2)]
    return pa.RecordBatch.from_arrays([doc_id, held_out, rows, *map(pa.array, columns), *lists],
                                      names=[x.split()[0] for x in _SCORED.split(", ")])


def _score_all(shared, complete: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (scorer, near), row = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            if batch.num_rows:
                rows = pa.array(np.arange(row, row + batch.num_rows))
                yield _scored_batch(scorer, near, complete, _texts(batch.column("text")), batch.column("doc_id"), batch.column("held_out"), rows)
                row += batch.num_rows
    return run


def _chunk_rows(size: int):
    """Documents of a task in chunks of some ``size`` bytes of text, a row each, with their row numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = row = TaskContext.get().partitionId() << 40
        held, held_bytes = [], 0

        def flush() -> pa.RecordBatch:
            docs, sink = pa.Table.from_batches(held).combine_chunks(), pa.BufferOutputStream()
            docs = docs.append_column("row", pa.array(np.arange(row, row + docs.num_rows)))
            with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(docs)
            return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "data"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                held_bytes += batch.column("text").nbytes
            if held_bytes >= size:
                yield flush()
                chunk, row, held, held_bytes = chunk + 1, row + sum(b.num_rows for b in held), [], 0
        if held:
            yield flush()
    return run


def _documents(data: bytes) -> pa.RecordBatch:
    """The documents of a chunk's row."""
    return pa.ipc.open_stream(data).read_all().combine_chunks().to_batches()[0]


def _distinct(runs: list) -> np.ndarray:
    """Sorted distinct hashes of the tokens and pairs of token runs."""
    hashes = np.concatenate([x for _, tokens, _, before in runs for x in (singles(tokens), pairs_of(before, tokens))])
    hashes.sort()
    return hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])]


def _by_bucket(hashes: np.ndarray, parts: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted hashes by the bucket of their part (and hash), and the number of those in each bucket."""
    bucket = (hashes % _U(parts) % _U(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    return np.argsort(bucket, kind="stable"), np.bincount(bucket, minlength=buckets)


def _gaps(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Hashes of buckets of these sizes (over 0), sorted in each: gaps of as many bytes as the largest needs, after that number."""
    ends = np.cumsum(sizes)
    gaps = np.diff(hashes, prepend=_U(0))
    gaps[ends - sizes] = hashes[ends - sizes]
    width = max(1, -(-int(gaps.max()).bit_length() // 8))
    data = gaps.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    return [bytes([width]) + data[(b - n) * width:b * width] for b, n in zip(ends.tolist(), sizes.tolist())]


def _from_gaps(data: bytes) -> np.ndarray:
    width = data[0]
    gaps = np.zeros(((len(data) - 1) // width, 8), dtype=np.uint8)
    gaps[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def _ask(parts: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("data")):
                hashes = _distinct(list(token_runs(_texts(_documents(data.as_buffer()).column("text")))))
                order, sizes = _by_bucket(hashes, parts, buckets)
                asked = np.flatnonzero(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(asked), pa.int64()), pa.array(asked, pa.int32()), pa.nulls(len(asked), pa.int32()),
                     pa.array(_gaps(hashes[order], sizes[asked]), pa.binary())], names=["chunk", "bucket", "part", "data"])
    return run


def _answer(parts: int):
    """Of each bucket its parts' bits (chunk -1) first, then what the chunks ask of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, filled, grams = None, {}, None
        for batch in batches:
            out: list[tuple[int, int, bytes]] = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("chunk", "bucket", "part", "data")))
            for (bucket, bits), group in groupby(rows, lambda r: (r[1], r[0] < 0)):
                if bucket != held:
                    held, filled, grams = bucket, {}, None
                if bits:
                    filled.update((part, data) for _, _, part, data in group)
                    continue
                if grams is None:
                    grams = FrequencyFilter(parts, filled)
                chunks, asked = zip(*((chunk, _from_gaps(data)) for chunk, _, _, data in group))
                found = np.minimum(grams.levels(np.concatenate(asked)), 255).astype(np.uint8)
                ends = np.cumsum([len(a) for a in asked]).tolist()
                out += [(chunk, bucket, found[end - len(a):end].tobytes()) for chunk, a, end in zip(chunks, asked, ends)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))],
                                             names=["chunk", "bucket", "data"])
    return run


def _score_chunk(shared, parts: int, buckets: int, complete: bool):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        scorer, near = shared.value
        docs = _documents(chunk.column("data")[0].as_buffer())
        texts = _texts(docs.column("text"))
        runs = list(token_runs(texts))
        hashes = _distinct(runs)
        levels_ = np.frombuffer(b"".join(answers.sort_by("bucket").column("data").to_pylist()), dtype=np.uint8)
        if len(levels_) != len(hashes):
            raise ValueError(f"{len(levels_)} levels for {len(hashes)} hashes")
        found = np.empty_like(levels_)
        found[_by_bucket(hashes, parts, buckets)[0]] = levels_
        own = Scorer(scorer.n, scorer.v, scorer.n_soft, scorer.n_docs, FoundLevels(hashes, found))
        # levels here come from this chunk's own answers: nothing is remembered across chunks
        near = NearWords(near.words, near.counts)
        return pa.Table.from_batches([_scored_batch(own, near, complete, texts, *(docs.column(c) for c in ("doc_id", "held_out", "row")), runs)])
    return run


def _score_routed(docs: DataFrame, built: DataFrame, bits: int, parts: int, shared, complete: bool) -> DataFrame:
    """Scores by parts of the filter that are not broadcast, written."""
    buckets = min(parts, max(1, -(-bits // (8 * ROUTE_BYTES))))
    with arrow_batches(docs.sparkSession, BATCH_ROWS, BATCH_BYTES):
        chunks = stash(docs.mapInArrow(_chunk_rows(CHUNK_TEXT), "chunk bigint, data binary"), "lm-chunks")
        asked = chunks.mapInArrow(_ask(parts, buckets), "chunk bigint, bucket int, part int, data binary")
        filled = built.select(F.lit(-1).cast("bigint").alias("chunk"), (F.col("part") % buckets).alias("bucket"), "part", F.col("bits").alias("data"))
        answers = filled.union(asked).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "chunk").mapInArrow(
            _answer(parts), "chunk bigint, bucket int, data binary")
        return stash(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
            _score_chunk(shared, parts, buckets, complete), _SCORED), "lm-scored")


def _packed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([
            pa.array([batch.column(c).to_numpy().tobytes()], pa.binary()) for c in ("word", "c")], names=["words", "counts"])


def score_documents(docs: DataFrame, max_words: int = MAX_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    docs = add_missing(docs, doc_id="bigint", text="string")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    train = docs.filter(~F.col("held_out")).select("text")

    with session_conf(spark, SHUFFLE_ONCE):
        words = stash(train.mapInArrow(_count_words, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "lm-words")
    end = F.lit(int(END.view(np.int64)))
    facts = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"),
                      F.coalesce(F.sum(F.when(F.col("word") == end, F.col("c"))), F.lit(0)).alias("docs")).first()
    n, v = facts["n"], facts["v"]
    quantised = F.pow(F.lit(2.0), (F.floor(F.log2("c") * SINGLE + 1e-9) + 0.5) / SINGLE)
    n_soft = words.agg(F.coalesce(F.sum(quantised), F.lit(0.0))).first()[0]

    parts = max(1, -(-n // PART_TOKENS))
    # the part's number as numpy computes it: 56-bit hashes are never negative
    with session_conf(spark, SHUFFLE_ONCE):
        built = stash(train.mapInArrow(_count_grams, "packed bigint")
                      .repartition(parts, F.expr(f"shiftrightunsigned(packed, 8) % {parts}"))
                      .mapInArrow(_fill(parts), "part int, bits binary"), "lm-filter")
    bits = 8 * built.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0))).first()[0]
    grams = FrequencyFilter(parts, {r["part"]: bytes(r["bits"]) for r in built.toLocalIterator()}) if bits <= max_bits else None
    scorer = Scorer(n, v, n_soft, facts["docs"], grams)
    del grams

    # most frequent words, whole powers of two of the count at a time, 16 bytes each
    by_power = sorted(words.groupBy(F.floor(F.log2("c")).alias("power")).agg(F.count("*").alias("words")).collect(), reverse=True)
    from_count, held_words = None, 0
    for r in by_power:
        if held_words + r["words"] > max_words:
            break
        from_count, held_words = 1 << int(r["power"]), held_words + r["words"]
    frequent = words.filter(F.col("c") >= F.lit(from_count if from_count is not None else 1 << 62))
    blobs = frequent.mapInArrow(_packed_words, "words binary, counts binary").collect()
    near_words = np.frombuffer(b"".join(r["words"] for r in blobs), dtype=np.int64).view(np.uint64)
    near_counts = np.frombuffer(b"".join(r["counts"] for r in blobs), dtype=np.int64)
    order = np.argsort(near_words)
    complete = held_words == v
    shared = spark.sparkContext.broadcast((scorer, NearWords(near_words[order], near_counts[order])))
    if bits <= max_bits:
        scored = docs.mapInArrow(_score_all(shared, complete), _SCORED)
    else:
        with session_conf(spark, SHUFFLE_ONCE):
            scored = _score_routed(docs, built, bits, parts, shared, complete)
    columns = ("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
    if complete:
        return scored.select(*columns)
    if bits <= max_bits:
        scored = stash(scored, "lm-scored")
    open_words = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select(
        "row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    # exploded rows have no size estimate that could be trusted: never broadcast
    rest = (open_words.hint("merge").join(words, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(n + 0.5 * (v + 1)))).alias("more_base")))
    return (scored.drop("rare", "times").join(rest.hint("merge"), "row", "left")
            .withColumn("n_known", F.col("n_known") + F.coalesce("more_known", F.lit(0)))
            .withColumn("base_score", F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).select(*columns))


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
