"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, exact confirmation, components.

A document's set is its distinct 5-word shingles (64-bit hashes). Documents with equal sets are one class, and
classes are what is compared. A class has a signature of ``CHUNKS * CHUNK_SLOTS`` MinHash slots of 16 bits;
the Hamming distance of two signatures counts slots that differ. Signatures are split into chunks; by the
pigeonhole principle two signatures at distance ``CHUNKS * (CHUNK_ERRORS + 1) - 1`` or less agree in at least
one chunk but for ``CHUNK_ERRORS`` slots, so every chunk is indexed once for each choice of slots left out, and
all pairs within that distance share an index key. (Farther pairs mostly do as well: two documents at
similarity 0.75 share none with probability 6e-6.)

A key may hold very many documents. Its members are first compared with two centres only, the smallest id and
the member that meets most others; confirmed links are joined into components. Pairs that could still connect
different components inside a key are then compared block by block: only members outside the key's largest
component are set against the rest, in blocks of bounded size. A block notes its pairs whose signatures are near
enough (each pair in the first key it shares), nearest first, as one row; the whole sets of the members in those pairs
are brought to the block, which confirms them itself. Pairs never become rows, so rows grow with the members of a
block, not with their square; a pair whose components have met meanwhile needs no confirmation, and only links that
join two components leave the task. No pair of a key is dropped, and components come out as if all pairs had been
compared. Only documents in candidate pairs are read again.

Words: ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; fewer than five words are one shingle.

Defined results: null, empty and blank texts have no shingles, no links and stay, repeated ids or not; rows that
repeat an id and have words count as one document inside one component (``keep_one`` keeps one of them, but decides
by row, so a text of that id in another component is not lost); a null id never is the smallest, and a row of null id
goes only if its own text is a near copy of a document with an id; a group of null ids only has a null component and
stays; an empty table gives no rows; other columns are ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlit.llm.common import add_missing, arrow_batches, stash, table

SHINGLE_WORDS = 5
SIMILARITY = 75  # percent
CHUNKS, CHUNK_SLOTS, CHUNK_ERRORS = 12, 5, 1
SLOTS = CHUNKS * CHUNK_SLOTS
# Further slots of 8 bits only sharpen the estimate of a pair's similarity. At similarity 0.75 a quarter of all
# slots differ; FAR is 6 standard deviations more (FAR_INDEX, over the index slots alone, 5), and pairs beyond it
# are ruled out without reading texts (3e-9 of the pairs at 0.75, beyond FAR_INDEX 7e-7).
MORE_SLOTS = 452
FAR, FAR_INDEX = 187, 32
BLOCK = 512
BROADCAST_IDS = 1_000_000
BATCH_ROWS = 200
CHUNK_BYTES = 1 << 19  # bytes hashed at a time; a longer text is cut between words
BATCH_BYTES = 4 << 20
NO_ID = 1 << 62  # class numbers from here on stand for classes of null ids only

_U = np.uint64
_rng = np.random.default_rng(20_240_607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_STEP = _rng.integers(1, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) * _U(2) + _U(1)
_XOR = _rng.integers(0, 1 << 63, SLOTS + MORE_SLOTS, dtype=np.uint64)
_MUL = _rng.integers(1, 1 << 63, SLOTS + MORE_SLOTS, dtype=np.uint64) * _U(2) + _U(1)
_KEY = _rng.integers(1, 1 << 63, CHUNKS * CHUNK_SLOTS, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each; those of a window's size are kept."""
    size = max(n, 2 * CHUNK_BYTES)
    if n > 2 * CHUNK_BYTES or not _powers:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        if n > 2 * CHUNK_BYTES:
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def _window_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of the words in lower-cased bytes that start and end with a space."""
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = _power_tables(len(data))
    sums = np.concatenate([[_U(0)], np.cumsum(_BYTE[data] * up[:len(data)], dtype=np.uint64)])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of its text), over all texts in order, A-Z lower-cased. Bytes are worked on in
    windows cut at a space, so memory beyond them follows the words, 16 bytes each (a window holds one word at least)."""
    joined = b" " + b" ".join(t.lower() for t in texts) + b" "
    data, hashes, starts, at = np.frombuffer(joined, dtype=np.uint8), [], [], 0
    while at < len(data) - 1:
        end = min(at + 2 * CHUNK_BYTES, len(data))
        if end < len(data):
            spaces = np.flatnonzero(_SPACE[data[at + 1:end]])
            step = 4 * CHUNK_BYTES
            while not len(spaces):  # a word longer than the window
                end = min(end + step, len(data))
                spaces = np.flatnonzero(_SPACE[data[at + 1:end]])
            end = at + 1 + int(spaces[-1]) + 1
        found, first = _window_hashes(data[at:end])
        hashes.append(found)
        starts.append(first + at)
        at = end - 1  # the space that ends this window starts the next one
    bounds = np.cumsum([len(t) + 1 for t in texts]) + 1
    return np.concatenate(hashes), np.searchsorted(bounds, np.concatenate(starts), side="right")


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of bounded bytes, with the first one's number."""
    first, run, size = 0, [], 0
    for k, t in enumerate(texts):
        if run and size + len(t) > CHUNK_BYTES:
            yield first, run
            first, run, size = k, [], 0
        run.append(t)
        size += len(t)
    if run:
        yield first, run


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for _, run in _chunks(texts):
        words, owner = word_hashes(run)
        counts = np.bincount(owner, minlength=len(run))
        first = np.concatenate([[0], np.cumsum(counts)])
        n = SHINGLE_WORDS
        grams = np.zeros(max(len(words) - n + 1, 0), dtype=np.uint64)
        for k in range(n):
            grams += words[k:len(words) - n + 1 + k] * _STEP[k] if len(grams) else _U(0)
        grams = _mix(grams)
        for d in range(len(run)):
            m = counts[d]
            if m >= n:
                out.append(np.unique(grams[first[d]:first[d] + m - n + 1]))
            elif m:
                own = words[first[d]:first[d] + m]
                out.append(_mix((own * _STEP[:m]).sum(keepdims=True, dtype=np.uint64) + _U(m)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, SLOTS + MORE_SLOTS) MinHash slots, the first SLOTS of 16 bits, the others of 8; of no meaning
    for empty sets."""
    sig = np.zeros((len(sets), SLOTS + MORE_SLOTS), dtype=np.uint16)
    full = [k for k, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):  # bounded runs of hashes
        run, size = [], 0
        while at < len(full) and (not run or size + len(sets[full[at]]) <= 1 << 17):
            run.append(full[at])
            size += len(sets[full[at]])
            at += 1
        flat = np.concatenate([sets[k] for k in run])
        starts = np.concatenate([[0], np.cumsum([len(sets[k]) for k in run])[:-1]])
        for j in range(SLOTS + MORE_SLOTS):
            low = np.minimum.reduceat((flat ^ _XOR[j]) * _MUL[j], starts)
            sig[run, j] = (_mix(low) & _U(0xFFFF if j < SLOTS else 0xFF)).astype(np.uint16)
    return sig


def _stored(sig: np.ndarray) -> list[bytes]:
    return [row[:SLOTS].tobytes() + row[SLOTS:].astype(np.uint8).tobytes() for row in sig]


def _loaded(column) -> np.ndarray:
    raw = np.frombuffer(b"".join(x.as_py() for x in column), dtype=np.uint8).reshape(-1, 2 * SLOTS + MORE_SLOTS)
    sig = np.empty((len(raw), SLOTS + MORE_SLOTS), dtype=np.uint16)
    sig[:, :SLOTS] = np.ascontiguousarray(raw[:, :2 * SLOTS]).view(np.uint16)
    sig[:, SLOTS:] = raw[:, 2 * SLOTS:]
    return sig


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of the first index key that each row of ``a`` shares with that of ``b`` (-1: none)."""
    same = (a[:, :SLOTS] == b[:, :SLOTS]).reshape(-1, CHUNKS, CHUNK_SLOTS)
    close = same.sum(2) >= CHUNK_SLOTS - CHUNK_ERRORS
    chunk = close.argmax(1)
    rows = np.arange(len(a))
    out = (~same[rows, chunk]).argmax(1)  # the slot that differs, or the first one
    return np.where(close.any(1), chunk * CHUNK_SLOTS + out, -1)


def index_keys(sig: np.ndarray) -> np.ndarray:
    """(signatures, CHUNKS * CHUNK_SLOTS) keys: every chunk with each of its slots left out in turn."""
    wide = sig[:, :SLOTS].astype(np.uint64).reshape(len(sig), CHUNKS, CHUNK_SLOTS)
    keys = np.empty((len(sig), CHUNKS * CHUNK_SLOTS), dtype=np.uint64)
    for c in range(CHUNKS):
        for out in range(CHUNK_SLOTS):
            key = np.zeros(len(sig), dtype=np.uint64)
            for s in range(CHUNK_SLOTS):
                if s != out:
                    key = (key << _U(16)) | wide[:, c, s]
            j = c * CHUNK_SLOTS + out
            keys[:, j] = _mix(key * _KEY[j] + _U(j))
    return keys


def _texts(column) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column.cast(pa.binary())]


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(_texts(batch.column("text")))
        sig = signatures(sets)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
            pa.array(_stored(sig), pa.binary())], names=["doc_id", "text_key", "n", "class", "sig"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 2000):
            part = batch.slice(k, 2000)
            keys = index_keys(_loaded(part.column("sig")))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(part.column("node").to_numpy(), keys.shape[1])),
                pa.array(keys.reshape(-1).view(np.int64)),
                pa.array(np.tile(np.arange(keys.shape[1], dtype=np.int16), len(keys)))], names=["node", "key", "j"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingle_sets(_texts(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())],
                                         names=["node", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("sa"), batch.column("sb")):
            keep.append(_similar(*(np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (a, b))))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])


def _distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            mask = pa.array((_loaded(batch.column("ga")) != _loaded(batch.column("gb"))).sum(1) <= FAR)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])


_BLOCK = "key bigint, r int, c int"


def _across(group: pa.Table) -> pa.Table:
    """What a block has to confirm, at most one row: the near pairs of a minor member and any other member, of
    different components, nearest first, as places in the list of the members in them. A pair that shares several
    keys is noted in the first one alone."""
    minor = np.array(group.column("minor").to_pylist(), dtype=bool)
    node, comp, n = (group.column(c).to_numpy() for c in ("node", "comp", "n"))
    sig, key = _loaded(group.column("sig")), group.column("j")[0].as_py()
    rest = np.flatnonzero(~minor)
    found = [np.zeros((0, 3), dtype=np.int64)]
    for i in np.flatnonzero(minor):
        size = (np.minimum(n[rest], n[i]) * 100 >= SIMILARITY * np.maximum(n[rest], n[i]))
        hit = rest[size & (comp[rest] != comp[i])]
        hit = hit[(sig[hit, :SLOTS] != sig[i, :SLOTS]).sum(1) <= FAR_INDEX]
        far = (sig[hit] != sig[i]).sum(1)
        hit, far = hit[far <= FAR], far[far <= FAR]
        if len(hit):
            first = first_shared(sig[hit], np.broadcast_to(sig[i], (len(hit), sig.shape[1]))) == key
            found.append(np.stack([far[first], hit[first], np.full(first.sum(), i)], 1))
    pairs = np.concatenate(found)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable"), 1:]
    members, places = np.unique(pairs, return_inverse=True)
    block = {c: group.column(c).slice(0, len(pairs) and 1) for c in ("key", "r", "c")}
    lists = {"nodes": [node[members].tolist()], "comps": [comp[members].tolist()], "pairs": [places.astype("<i4").tobytes()]}
    return pa.table({**block, **{k: pa.array(v if len(pairs) else [], pa.binary() if k == "pairs" else pa.list_(pa.int64())) for k, v in lists.items()}})


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= SIMILARITY * (len(both) - shared)


def _confirm_block(members: pa.Table, noted: pa.Table) -> pa.Table:
    """Links of a block that join two components, confirmed on whole sets."""
    sets = {node: np.frombuffer(s.as_buffer(), dtype=np.uint64) for node, s in zip(members.column("node").to_pylist(), members.column("shingles"))}
    nodes, comps = noted.column("nodes")[0].as_py(), noted.column("comps")[0].as_py()
    top = {c: c for c in comps}

    def find(c: int) -> int:
        while top[c] != c:
            top[c] = c = top[top[c]]
        return c
    links = []
    for x, y in np.frombuffer(noted.column("pairs")[0].as_buffer(), dtype="<i4").reshape(-1, 2).tolist():
        a, b = find(comps[x]), find(comps[y])
        if a != b and _similar(sets[nodes[x]], sets[nodes[y]]):
            top[max(a, b)] = min(a, b)
            links.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y])))
    return pa.table({c: pa.array([link[k] for link in links], pa.int64()) for k, c in enumerate(("a", "b"))})


def shingle_sets_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """(node, shingles) of the wanted nodes, one row each, from the text of one document of their class."""
    wanted = wanted.join(classes.select("node", "some_id", "some_text"), "node")
    if wanted.count() <= BROADCAST_IDS:  # else texts and ids meet in a shuffle
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, (F.col("text_key") == F.col("some_text")) & F.col("doc_id").eqNullSafe(F.col("some_id")))
    # rows that repeat an id and its text give the same set: one of them is kept
    return stash(texts.select("node", "text").mapInArrow(_sets, "node bigint, shingles binary").dropDuplicates(["node"]), name)


def confirmed_across(open_: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between different components inside the open keys, enough of them to join what is joined by any."""
    noted = stash(_blocks(open_, classes).groupBy("key", "r", "c").applyInArrow(
        _across, f"{_BLOCK}, nodes array<bigint>, comps array<bigint>, pairs binary"), "near-noted")
    need = noted.select(*[F.col(k).alias(f"own_{k}") for k in ("key", "r", "c")], F.explode("nodes").alias("node"))
    sets = shingle_sets_of(need.select("node").distinct(), classes, docs, "near-open-sets")
    # what explode and mapInArrow make has no size estimate that could be trusted: never broadcast
    held = need.hint("merge").join(sets, "node")
    return stash(held.groupBy("own_key", "own_r", "own_c").cogroup(noted.groupBy("key", "r", "c")).applyInArrow(_confirm_block, "a bigint, b bigint").distinct(), "near-across")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of class numbers whose whole shingle sets reach the similarity. ``pairs`` may repeat."""
    size = classes.select("node", "n", "sig")
    near = (pairs.distinct()
            .join(size.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("ga")), "a")
            .join(size.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("gb")), "b")
            .filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * SIMILARITY)
            .select("a", "b", "ga", "gb").mapInArrow(_distance, "a bigint, b bigint"))
    near = stash(near, "near-pairs")
    sets = shingle_sets_of(near.select(F.col("a").alias("node")).union(near.select("b")).distinct(), classes, docs, "near-sets")
    both = (near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b"))
    return stash(both.select("a", "b", "sa", "sb").mapInArrow(_confirm, "a bigint, b bigint").distinct(), "near-links")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): smallest node reachable, for nodes with links. Alternating large and small stars; every
    round is a written table, so no lineage grows and a lost executor repeats one round."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    edges, seen = stash(edges, "near-edges"), None
    while True:
        facts = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum("v")).first())
        if facts == seen or not facts[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        seen = facts
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = stash(small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
                      .union(low.select("u", "m")).distinct(), "near-edges")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and kept."""
    return _placed(docs).drop("text_key")


def _placed(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with the hash of each row's text."""
    with arrow_batches(docs.sparkSession, BATCH_ROWS, BATCH_BYTES):  # every step that runs Python is written in here
        return _placed_in_batches(docs)


def _placed_in_batches(docs: DataFrame) -> DataFrame:
    docs = add_missing(docs, doc_id="bigint", text="string").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    prints = stash(docs.mapInArrow(
        _fingerprint, "doc_id bigint, text_key bigint, n bigint, class binary, sig binary"), "near-prints")
    classes = stash(prints.filter("n > 0").groupBy("class").agg(
        F.min("doc_id").alias("some_id"), F.any_value("sig").alias("sig"), F.any_value("n").alias("n"),
        F.coalesce(F.min_by("text_key", "doc_id"), F.min("text_key")).alias("some_text"))
        .withColumn("node", F.coalesce("some_id", F.lit(NO_ID) + F.pmod(F.xxhash64("class"), F.lit(1 << 60)))), "near-classes")

    keyed = classes.select("node", "sig").mapInArrow(_keys, "node bigint, key bigint, j smallint")
    shared = keyed.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("least")).filter("members > 1")
    # what mapInArrow makes has no size estimate that could be trusted: never broadcast
    members = stash(keyed.join(shared.hint("merge"), "key"), "near-members")
    met = members.groupBy("node").agg(F.sum("members").alias("met"))
    hubs = members.join(met, "node").groupBy("key").agg(
        F.max_by("node", F.struct("met", -F.col("node"))).alias("hub"))
    spokes = members.select("node", F.col("least").alias("centre")).union(
        members.join(hubs, "key").select("node", F.col("hub").alias("centre")))
    first = spokes.filter("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    links = confirmed(first, classes, docs)
    comps = components(links)

    # what may still connect different components inside a key
    open_ = _open_members(members, comps)
    if not open_.isEmpty():
        links = links.union(confirmed_across(open_, classes, docs))
        comps = components(links)

    named = classes.select("class", "node").join(comps, "node", "left").select(
        "class", F.coalesce("comp", "node").alias("comp"))
    out = prints.join(named, "class", "left")
    component = F.when(F.col("comp").isNull(), F.col("doc_id")).when(F.col("comp") < NO_ID, F.col("comp"))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _open_members(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, j, node, comp) of the keys whose members are in different components."""
    placed = members.select("key", "j", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    return stash(placed.join(split, "key"), "near-open")


def _blocks(open_: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of the open keys dealt into blocks (key, r, c) in which every minor member meets every other one."""
    sizes = open_.groupBy("key", "comp").agg(F.count("*").alias("c"))
    per_key = sizes.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("major"), F.sum("c").alias("total"),
                                       F.max("c").alias("most"))
    shape = per_key.select("key", "major", F.ceil(F.col("total") / BLOCK).cast("int").alias("rows"),
                           F.ceil((F.col("total") - F.col("most")) / BLOCK).cast("int").alias("columns"))
    row = F.pmod(F.xxhash64("node"), F.col("rows").cast("long")).cast("int")
    column = F.pmod(F.xxhash64("node", F.lit(1)), F.col("columns").cast("long")).cast("int")
    m = (open_.join(shape, "key").join(classes.select("node", "n", "sig"), "node")
         .withColumn("r", row).withColumn("c", column))
    rest = m.select("key", "j", "node", "comp", "n", "sig", F.lit(False).alias("minor"), F.col("r"),
                    F.explode(F.expr("sequence(0, columns - 1)")).alias("c"))
    minor = m.filter("comp <> major").select("key", "j", "node", "comp", "n", "sig", F.lit(True).alias("minor"),
                                             F.explode(F.expr("sequence(0, rows - 1)")).alias("r"), F.col("c"))
    return rest.unionByName(minor)


def _named(rows: DataFrame, own_id: str, own_text: str) -> DataFrame:
    """Distinct (id, text) of rows, broadcast up to BROADCAST_IDS of them; beyond that they meet documents in a shuffle."""
    rows = rows.select(F.col("doc_id").alias(f"{own_id}_found"), F.col("text_key").alias(f"{own_text}_found")).distinct()
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near duplicates: of each component the smallest id stays; the input's columns."""
    found = stash(_placed(docs), "near-result")
    have = add_missing(docs, doc_id="bigint", text="string")
    free = max((len(c) for c in docs.columns), default=0) * "_"  # longer than any name of the caller's
    own_id, own_text = f"{free}_own_id", f"{free}_own_text"
    own = have.withColumns({own_id: F.col("doc_id").cast("bigint"), own_text: F.xxhash64("text")})
    same = F.col(own_id).eqNullSafe(F.col(f"{own_id}_found")) & (F.col(own_text) == F.col(f"{own_text}_found"))
    kept = own.join(_named(found.filter(~F.col("kept")), own_id, own_text), same, "left_anti")
    # rows with words that repeat the id of their component: one of them stays
    worded = found.filter("kept and n_shingles > 0 and doc_id is not null")
    facts = worded.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    if facts[0] != facts[1]:
        twice = worded.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
        again = _named(worded.join(twice, "doc_id"), own_id, own_text)
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([own_id]))
    return kept.select(*docs.columns)


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
