"""Token ids of whole documents in ORC files.

Documents are range-partitioned and sorted by id (rows that repeat an id by text hash, so a hot id splits too),
encoded in the same task and written as ORC: ids are integer lists under ORC's run-length encoding, stripes
carry row indexes and a Bloom filter on ``doc_id``, so a reader can take stripes in parallel and skip those
whose statistics or Bloom filter rule an id out (``lookup_documents``). Every row carries its file part, its
position there and the number of ids before it in the part; a document's global start is that plus the
lengths of earlier parts, one number per part.

Encoding is the tokenizers library's, for groups of texts at a time. The pre-tokenizer never joins across ASCII
white space. Words of plain Latin letters, digits and ASCII signs are cut into the tokenizer's pieces, all others
stay whole; each different piece or word of a group is looked up once in a bounded per-worker cache, and goes to
the tokenizer's BPE model (pieces) or the whole tokenizer (words) if it is not there. Both give the ids of
``encode(text, add_special_tokens=False)``; special-token strings inside a text are handled by the latter. The
caches have two generations, so that frequent entries outlive a full one.

Defined results: a null text is empty and gives the end id alone; null ids come first; repeated rows are
written once each, ordered by text hash; very long texts are one row; an empty table gives an empty file set;
other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starlit.llm.common import add_missing, scratch_dir, stash, table

END_ID = 1
TOKENIZER = "word_bpe_49k.json"
CACHE_PIECES = 400_000  # of each of two generations
CACHE_WORDS = 150_000
BATCH_ROWS = 200
GROUP_BYTES = 4 << 20  # of text cut and looked up at a time
GROUP_ROWS = 10_000
STRIPE_BYTES = 64 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BLANK, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)


def _kind(b: int) -> int:
    """Kind of a UTF-8 byte; of letters beyond ASCII, U+00C0 to U+00FF without the two signs are plain (\\xC3 and one byte)."""
    if b == 0x20 or 0x09 <= b <= 0x0D:
        return _BLANK
    if 0x21 <= b <= 0x7E:
        return _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SIGN
    return _LETTER if b == 0xC3 or 0x80 <= b <= 0xBF and b not in (0x97, 0xB7) else _OTHER


_KINDS = bytes(map(_kind, range(256)))
# Lower case of plain letters: A-Z, and the byte after \xC3.
_LOWER = bytes(b + 0x20 if 0x41 <= b <= 0x5A or 0x80 <= b <= 0x9E and b != 0x97 else b for b in range(256))
# The tokenizer's pattern cuts 's 't 'm 'd 're 've 'll before all else.
_ONE = np.isin(np.arange(256), list(b"stmd"))
_TWO = [(ord("r"), ord("e")), (ord("v"), ord("e")), (ord("l"), ord("l"))]


def _cut(data: bytes) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """Pieces of plain words, lower-cased, and whole other words of texts that end in white space: where each starts,
    the pieces and words themselves, and whether they are whole words."""
    raw = np.frombuffer(data, np.uint8)
    kinds = np.frombuffer(bytearray(data.translate(_KINDS)), np.uint8)
    low = np.frombuffer(data.translate(_LOWER), np.uint8)
    if not data.isascii():
        first, second = raw == 0xC3, (kinds == _LETTER) & (raw >= 0x80) & (raw <= 0xBF)
        kinds[:-1][first[:-1] & ~second[1:]] = _OTHER
        kinds[1:][second[1:] & ~first[:-1]] = _OTHER
        if second[0]:
            kinds[0] = _OTHER
    if b"<|" in data:
        kinds[:-1][(raw[:-1] == ord("<")) & (raw[1:] == ord("|"))] = _OTHER
    text = kinds != _BLANK
    if (others := np.flatnonzero(kinds == _OTHER)).size:
        word = np.cumsum(np.diff(text, prepend=False) & text, dtype=np.int32)
        whole = np.zeros(int(word[-1]) + 1, dtype=bool)
        whole[word[others]] = True
        whole = whole[word] & text
        kinds[whole] = _OTHER
        low = np.where(whole, raw, low)
    starts = text & ((np.diff(kinds, prepend=np.uint8(_BLANK)) != 0) | (kinds == _DIGIT))
    # a lone apostrophe before letters; the white space at the end keeps the next two bytes inside
    at = np.flatnonzero(starts & (low == ord("'")) & (kinds == _SIGN))
    at = at[kinds[at + 1] == _LETTER]
    one, two = low[at + 1], low[at + 2]
    for tail, many in ((at[_ONE[one]], 1), (at[np.any([(one == x) & (two == y) for x, y in _TWO], axis=0)], 2)):
        starts[tail + 1] = False
        rest = tail + 1 + many
        starts[rest[kinds[rest] == _LETTER]] = True
    offsets = np.append(np.flatnonzero(starts[text]), np.count_nonzero(text)).astype(np.int32)
    where = np.flatnonzero(starts)
    pieces = pa.StringArray.from_buffers(len(where), pa.py_buffer(offsets), pa.py_buffer(low[text]))
    return where, pieces, kinds[where] == _OTHER


def _packed(ids: list[int]) -> bytes:
    """Little-endian 32-bit integers."""
    packed = array("i", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def _byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Cache(dict):
    """Ids by piece or word, from the generation before or made on first use."""

    def __init__(self, make, before: dict[str, bytes]):
        super().__init__()
        self.make, self.before = make, before

    def __missing__(self, key: str) -> bytes:
        ids = self.before.get(key)
        if ids is None:
            ids = self.make(key)
        self[key] = ids
        return ids

    def bounded(self, most: int) -> _Cache:
        """Itself, or a new generation once it has more entries than that."""
        if len(self) <= most:
            return self
        self.before = {}
        return _Cache(self.make, self)


class WordEncoder:
    """Ids of texts by pieces and words; one per Python worker and tokenizer file."""

    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.cache_pieces, self.cache_words = cache_pieces, cache_words
        self.pieces, self.words = _Cache(self._piece, {}), _Cache(self._word, {})

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():  # printable ASCII stands for itself in the byte-level alphabet
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return _packed([t.id for t in self.tokenize(piece)])

    def _word(self, word: str) -> bytes:
        return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _part(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that end in white space: their ids, where each piece starts, and the number of ids before it."""
        self.pieces, self.words = self.pieces.bounded(self.cache_pieces), self.words.bounded(self.cache_words)
        where, found, whole = _cut(data)
        coded = found.dictionary_encode()
        is_word = np.zeros(len(coded.dictionary), dtype=bool)
        is_word[coded.indices.to_numpy()[whole]] = True
        pieces, words = self.pieces, self.words
        keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        packed = [(words if w else pieces)[key] for key, w in zip(keys, is_word.tolist())]
        every = pa.array(packed, pa.large_binary()).take(coded.indices)
        _, ends, data = every.buffers()
        ends = np.frombuffer(ends, np.int64, len(every) + 1) // 4
        return np.frombuffer(data or b"", "<i4", int(ends[-1])), where, ends

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of UTF-8 texts, one after the other, and the number of ids up to the end of each."""
        data = b"\n".join([*texts, b""])
        stops = np.cumsum([len(t) + 1 for t in texts])
        parts, ends, at, done, before = [], np.zeros(len(texts), dtype=np.int64), 0, 0, 0
        while at < len(data):  # long texts are cut at white space
            blank = _SPACE.search(data, at + GROUP_BYTES)
            stop = blank.end() if blank else len(data)
            ids, where, ahead = self._part(data[at:stop])
            here = np.searchsorted(stops, stop, side="right")
            ends[done:here] = before + ahead[np.searchsorted(where, stops[done:here] - at)]
            parts.append(ids)
            at, done, before = stop, here, before + len(ids)
        return np.concatenate([np.zeros(0, "<i4"), *parts]), ends

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        return self.encode_all([text.encode()])[0].tobytes()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Ids and texts of rows that together hold a bounded number of bytes, or of one longer text."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
            text = text.as_py()
            if ids and (size + len(text) >= GROUP_BYTES or len(ids) >= GROUP_ROWS):
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(text)
            size += len(text) + 1
    if ids:
        yield ids, texts


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, pos, offset = WordEncoder.of(path), TaskContext.get().partitionId(), 0, 0
        for doc_ids, texts in _groups(batches):
            ids, upto = encoder.encode_all(texts)
            ids, n = np.insert(ids, upto, end_id), len(texts)
            ends = np.concatenate([[0], upto + np.arange(1, n + 1)])
            yield pa.RecordBatch.from_arrays([
                pa.array(doc_ids, pa.int64()), pa.array(np.full(n, part, dtype=np.int32)),
                pa.array(np.arange(pos, pos + n)), pa.array(offset + ends[:-1]),
                pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))],
                names=["doc_id", "part", "pos", "offset", "ids"])
            pos, offset = pos + n, offset + int(ends[-1])
    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode every text and write (doc_id, part, pos, offset, ids) as ORC in ascending doc_id order.
    ``tokenizer``: a tokenizers file that every executor can open."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    rows = add_missing(docs, doc_id="bigint", text="string").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    out = rows.select("doc_id", "text").mapInArrow(
        _encoded(tokenizer, end_id), "doc_id bigint, part int, pos bigint, offset bigint, ids array<int>")
    (out.write.option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true")
     .option("orc.row.index.stride", "1000").option("orc.stripe.size", str(STRIPE_BYTES)).option("compression", "zstd").orc(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files: doc_id, part, pos, offset (ids before the row in its part) and ids."""
    return spark.read.schema("doc_id bigint, part int, pos bigint, offset bigint, ids array<int>").orc(path)


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all documents before a row's own, to rows with part, offset and n_tokens."""
    lengths = rows.groupBy("part").agg(F.max(F.col("offset") + F.col("n_tokens")).alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = lengths.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    # one number for each task of the write: a bound that holds at any size
    return rows.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("offset")).drop("base")


def lookup_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Rows of a few documents; ORC statistics and Bloom filters skip the stripes that can't hold them."""
    return spark.read.orc(path).filter(F.col("doc_id").isin(ids))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        ends = lists.offsets.to_numpy()
        data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
        crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), batch.column("offset"), pa.array(np.diff(ends).astype(np.int64)),
             pa.array(crc, pa.int64())], names=["doc_id", "part", "offset", "n_tokens", "ids_crc32"])


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens and ids_crc32 (of little-endian unsigned ids)."""
    sums = stash(read_token_files(spark, path).select("doc_id", "part", "offset", "ids").mapInArrow(
        _checksums, "doc_id bigint, part int, offset bigint, n_tokens bigint, ids_crc32 bigint"), "token-sums")
    return with_starts(sums).select("doc_id", "start", "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the documents' token files to a scratch folder on shared storage and digest them from there."""
    if tokenizer is None:
        import public_tokenizers
        tokenizer = public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    path = scratch_dir(spark, "tokens")
    write_token_files(docs, path, tokenizer)
    return token_digest(spark, path)


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
