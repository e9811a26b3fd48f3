"""Importance resampling of documents towards the feature distribution of a target text collection.

Features are runs of one to ``MAX_RUN`` consecutive words, hashed by CRC-32 into ``BUCKETS``. What a bucket gains is the
logarithm of its smoothed share in the target over that in the corpus; a document weighs the mean gain of its features,
plus seeded Gumbel noise, so that the highest scores are a draw without replacement in proportion to the weights.

Length-bucketed CRC matrices: inside a task the distinct features of a run of texts are grouped by byte length, each
group laid out as a two-dimensional uint8 array, and all checksums of a group advance together, one column (byte
position) at a time, by a table look-up; the results are scattered back to the features' places.

Both passes over the texts emit little: a vector of bucket counts per task, then three numbers per document. Gains are
``BUCKETS`` integers however large the corpus. The draw needs no sort of everything: scores are integers of a range
that the logarithms bound, so a histogram of them gives the lowest score drawn, and only rows from there on are range
partitioned and numbered (``operators.positions``). All written tables are small beside the texts.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.

Defined results: a null or wordless text has no features and weight 0; very long texts are cut into bounded runs of
words, so memory doesn't follow their length; a null id hashes like the empty text and loses ties against any other;
rows that repeat an id are scored each, ties among them go to fewer features, then the lower weight; without eligible
documents nothing is drawn; an empty target gives T = 0, so gains only flatten the corpus; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlit.llm.common import add_missing, arrow_batches, stash, table
from starlit.operators.positions import place

MAX_RUN = 1          # words in a feature, at most
BUCKETS = 10_000
LEAST_WORDS = 20     # of a document that may be drawn
DRAWN_PERCENT = 10
SEED = 2024
MATRIX_BYTES = 128   # longer features, which hardly repeat, take the plain checksum
RUN_FEATURES = 200_000
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased bytes: all bytes of characters from U+0080 on are in words


def _crc_table() -> np.ndarray:
    rest = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rest = np.where(rest & 1, (rest >> 1) ^ np.uint32(0xEDB88320), rest >> 1).astype(np.uint32)
    return rest


_TABLE = _crc_table()


def checksums(features: list[bytes]) -> np.ndarray:
    """CRC-32 of each feature, by one matrix per byte length."""
    lengths = np.fromiter(map(len, features), dtype=np.int64, count=len(features))
    order = np.argsort(lengths, kind="stable")
    out = np.empty(len(features), dtype=np.uint32)
    for same in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
        size = int(lengths[same[0]])
        if size > MATRIX_BYTES:
            out[same] = [zlib.crc32(features[k]) for k in same]
            continue
        columns = np.frombuffer(b"".join([features[k] for k in same]), dtype=np.uint8).reshape(len(same), size).T.copy()
        state = np.full(len(same), 0xFFFFFFFF, dtype=np.uint32)
        for column in columns:
            state = _TABLE[(state ^ column) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
        out[same] = ~state
    return out


def _feature_runs(texts: list[bytes | None], max_run: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(number of the text, number of words) of every piece and its features, in runs of some RUN_FEATURES features."""
    owner, words_of, features = [], [], []
    sizes: list[int] = []
    for k, text in enumerate(texts):
        found, before = (m.group() for m in _WORD.finditer((text or b"").lower())), []
        while piece := list(islice(found, RUN_FEATURES)):
            words = before + piece
            first = len(before)
            own = piece if max_run == 1 else piece + [
                b" ".join(words[e - n + 1:e + 1]) for e in range(first, len(words)) for n in range(2, min(max_run, e + 1) + 1)]
            before = words[len(words) - (max_run - 1):] if max_run > 1 else []
            owner.append(k)
            words_of.append(len(piece))
            sizes.append(len(own))
            features += own
            if len(features) >= RUN_FEATURES:
                yield np.array(owner), np.array([words_of, sizes]), features
                owner, words_of, sizes, features = [], [], [], []
    if features:
        yield np.array(owner), np.array([words_of, sizes]), features


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return [t.as_buffer().to_pybytes() if t.is_valid else None for t in batch.column("text").cast(pa.binary())]


def _count(max_run: int, buckets: int):
    """Bucket counts of a task's texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, features in _feature_runs(_texts(batch), max_run):
                times = Counter(features)
                place_ = checksums(list(times)) % np.uint32(buckets)
                counts += np.bincount(place_, weights=np.fromiter(times.values(), np.float64, len(times)), minlength=buckets).astype(np.int64)
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(counts[hit])], names=["bucket", "c"])
    return run


def _weigh(max_run: int, gains: np.ndarray):
    """Words, features and the floored mean gain of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n, total = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for owner, (n_words, sizes), features in _feature_runs(_texts(batch), max_run):
                number: dict[bytes, int] = {}
                at = np.fromiter((number.setdefault(f, len(number)) for f in features), dtype=np.int64, count=len(features))
                gain = gains[checksums(list(number)) % np.uint32(len(gains))][at]
                np.add.at(total, owner, np.add.reduceat(gain, np.concatenate([[0], np.cumsum(sizes)[:-1]])))
                np.add.at(words, owner, n_words)
                np.add.at(n, owner, sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))],
                names=["doc_id", "n_words", "n_features", "weight"])
    return run


def bucket_counts(texts: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; the driver reads at most ``buckets`` sums."""
    summed = texts.select("text").mapInArrow(_count(max_run, buckets), "bucket int, c bigint").groupBy("bucket").agg(F.sum("c").alias("c"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in summed.collect():
        out[r["bucket"]] = r["c"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(smoothed share in the target / smoothed share in the corpus)) of each bucket."""
    s_all, t_all, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n))))
                     for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def resample(docs: DataFrame, target: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS, seed: int = SEED,
             percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score and its rank in the draw (null if not drawn)."""
    spark = docs.sparkSession
    docs = add_missing(docs, doc_id="bigint", text="string").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    target = add_missing(target, text="string").select(F.col("text").cast("string").alias("text"))
    with arrow_batches(spark, BATCH_ROWS, BATCH_BYTES):
        gains = bucket_gains(bucket_counts(docs, max_run, buckets), bucket_counts(target, max_run, buckets))
        weighed = docs.mapInArrow(_weigh(max_run, gains), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
        digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
        h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
        noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
        scored = stash(weighed.withColumn("score", F.col("weight") + noise), "resample-scores")

    may = F.col("n_words") >= least_words
    # scores are whole thousandths of logarithms: some 100,000 values at most, however many documents
    hist = scored.filter(may).groupBy("score").agg(F.count("*").alias("c"))
    above = F.sum("c").over(Window.orderBy(F.desc("score")))
    n = scored.filter(may).count()
    k = percent * n // 100
    lowest = hist.select("score", (above - F.col("c")).alias("higher")).filter(F.col("higher") < k).agg(F.min("score")).first()[0]
    columns = ("doc_id", "n_features", "weight", "score")
    if lowest is None:
        return scored.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    in_reach = may & (F.col("score") >= lowest)
    placed = place(scored.filter(in_reach).select(*columns), [],
                   [F.desc("score"), F.col("doc_id").asc_nulls_last(), "n_features", "weight"]).positions("rank")
    drawn = placed.select(*columns, F.when(F.col("rank") < k, F.col("rank") + 1).alias("rank"))
    return drawn.unionByName(scored.filter(~in_reach).select(*columns, F.lit(None).cast("bigint").alias("rank")))


def op12_importance_resample(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# DuckDB statement of the same draw; CRC-32 of the distinct words by the bitwise rule.
OP12_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
               lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT r, unnest(w) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
b AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT)),
        lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
      FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc),
s AS (SELECT bucket, count(*) AS c FROM dw JOIN b USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS c FROM bw JOIN b USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.c, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)
        / ((coalesce(s.c, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
m AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN b USING (w) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
      FROM d LEFT JOIN m USING (r)),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS pos,
        count(*) OVER (PARTITION BY n_features >= 20) AS n FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND pos <= 10 * n // 100 THEN pos END AS rank FROM k
"""
