"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a linear score of text statistics (character classes, word shapes, repetition, the
worst chunk of each). Weights come from preference pairs, a document labelled 1 preferred over one labelled 0,
by the logistic loss on their feature differences, in numpy, from at most ``SAMPLE_PER_LABEL`` labelled rows
of each label (those with the smallest hash of their id) and at most ``PAIRS`` pairs of them. The strength is cut at
the quantile, over all labelled training rows, that their share of label 0 names, and squashed to (0, 1) so that the
cut is 0.5. Every whole text is
scored in Arrow batches; only the weight vector travels.

Training rows are those whose crc32(doc_id as text) mod 3 is not 1; nothing but the text enters a score.

Defined results: a null text scores as the empty text; very long texts are scored whole; rows are kept with
repetitions and tie freely; a labelled id that repeats, or has both labels, counts once for each of its rows and labels; without both labels to
learn from, every score is 0.5 and every document is kept; an empty table gives no rows; other columns are
ignored by ``score_quality`` and kept by ``keep_quality`` (internal names start with ``_quality``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from starlit.llm.common import add_missing, stash, table
from starlit.operators.quantile import exact_quantile_value

SAMPLE_PER_LABEL = 6_000    # labelled rows the weights are fitted on, of each label
PAIRS = 120_000             # preference pairs drawn among them, at most
BROADCAST_LABELS = 1_000_000
STEPS = 400
BATCH_ROWS = 500
CHUNK = 400  # bytes

# Character classes by byte: lower, upper, digit, space, line break, non-ASCII, bar, exclamation, full marks,
# quotes and brackets, other signs.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\x0b\x0c", "\n\r", "", "|",
            "!", ".,;:?", "\"'()[]-"]
_LUT = np.full(256, len(_CLASSES), dtype=np.intp)
for _k, _chars in enumerate(_CLASSES):
    for _c in _chars:
        _LUT[ord(_c)] = _k
_LUT[128:] = 5
N_CLASSES = len(_CLASSES) + 1
LOWER, UPPER, BAR, BANG, SIGN = 0, 1, 6, 7, N_CLASSES - 1


def features(text: bytes) -> np.ndarray:
    """Statistics of one UTF-8 text."""
    data = _LUT[np.frombuffer(text, dtype=np.uint8)]
    n = max(len(data), 1)
    share = np.bincount(data, minlength=N_CLASSES) / n
    chunks = max(1, -(-len(data) // CHUNK))
    grid = np.bincount(data + N_CLASSES * (np.arange(len(data)) // CHUNK), minlength=chunks * N_CLASSES).reshape(chunks, N_CLASSES)
    sizes = np.maximum(grid.sum(1, keepdims=True), CHUNK // 4)
    worst = (grid / sizes).max(0)[[UPPER, BAR, BANG, SIGN]]

    words = text.split()
    n_words = len(words)
    m = max(n_words, 1)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n_words) if n_words else np.zeros(1)
    again = np.fromiter(map(eq, words[1:], words), dtype=np.float64, count=n_words - 1) if n_words > 1 else np.zeros(1)
    # worst run of 20 word pairs: whole runs from the start, and the last 20 pairs, so that none is left out
    run = max(again[:len(again) // 20 * 20].reshape(-1, 20).mean(1).max(), again[-20:].mean()) if len(again) >= 20 else again.mean()
    lines = [x for x in text.split(b"\n") if x]
    letters = share[LOWER] + share[UPPER] + share[5]
    return np.concatenate([share, np.sqrt(share), worst, np.sqrt(worst), [
        share[UPPER] / max(letters, 1e-9), letters,
        np.log1p(n_words), lengths.mean(), lengths.std(), (lengths <= 3).mean(), (lengths >= 12).mean(), (lengths <= 1).mean(),
        again.mean(), np.sqrt(again.mean()), run, len(set(words)) / m, len(set(words)) / m ** 0.8,
        len(set(lines)) / max(len(lines), 1), n_words / max(len(lines), 1) / 100]])


def _batch_features(texts: pa.Array) -> np.ndarray:
    return np.stack([features(t.as_buffer().to_pybytes()) for t in texts.cast(pa.binary())])


@dataclass
class PairwiseModel:
    """Bradley-Terry strengths ``w . (x - mean) / scale`` and the cut that parts the labels."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.strength(x) - self.cut)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights


def fit_pairwise(good: np.ndarray, bad: np.ndarray, share_bad: float, pairs: int = PAIRS, steps: int = STEPS,
                 ridge: float = 1e-3, seed: int = 7) -> PairwiseModel:
    """Weights from preference pairs of the rows of ``good`` over those of ``bad``; the cut is the ``share_bad``
    quantile of all strengths, each label weighted by its share."""
    n_features = good.shape[1] if len(good) else bad.shape[1] if len(bad) else len(features(b""))
    if not len(good) or not len(bad):
        return PairwiseModel(np.zeros(n_features), np.ones(n_features), np.zeros(n_features), 0.0, 1.0)
    both = np.concatenate([good, bad])
    mean, scale = both.mean(0), both.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    g, b = (np.clip((x - mean) / scale, -6, 6) for x in (good, bad))
    rng = np.random.default_rng(seed)
    k = min(pairs, 20 * max(len(g), len(b)))
    left, right = rng.permutation(np.arange(k) % len(g)), rng.permutation(np.arange(k) % len(b))
    w, m1, m2 = np.zeros(n_features), np.zeros(n_features), np.zeros(n_features)
    for t in range(1, steps + 1):  # Adam over the whole set, in slices of pairs
        part = slice((t % 8) * k // 8, (t % 8 + 1) * k // 8)
        diff = g[left[part]] - b[right[part]]
        loss_slope = -1.0 / (1.0 + np.exp(np.clip(diff @ w, -500, 500)))
        grad = diff.T @ loss_slope / max(len(diff), 1) + ridge * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad * grad
        w = w - 0.05 * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.99 ** t)) + 1e-8)
    strengths = np.concatenate([g @ w, b @ w])
    weight = np.concatenate([np.full(len(g), (1 - share_bad) / len(g)), np.full(len(b), share_bad / len(b))])
    order = np.argsort(strengths, kind="stable")
    at = int(np.searchsorted(np.cumsum(weight[order]), share_bad - 1e-12))
    ranked = strengths[order]
    cut = (ranked[min(at, len(ranked) - 1)] + ranked[min(at + 1, len(ranked) - 1)]) / 2
    return PairwiseModel(mean, scale, w, float(cut), 1.0)


def in_training(doc_id: Column, modulus: int = 3, held: int = 1) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)) != held


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = _batch_features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x))], names=["label", "x"])


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_LABEL) -> PairwiseModel:
    """Weights from at most ``sample`` labelled training rows of each label, of which the driver receives statistics
    only and draws at most PAIRS preference pairs; the cut from all labelled training rows, a quantile that tasks find."""
    docs, labels = add_missing(docs, doc_id="bigint", text="string"), add_missing(labels, doc_id="bigint", quality="int")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & in_training(F.col("doc_id"))).distinct()
    share_bad = known.agg(F.avg(1.0 - F.col("label"))).first()[0]
    chosen = None
    for label in (0, 1):
        part = known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # at most 2 * sample rows: a fixed bound
    rows = texts.join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(_featured, "label int, x array<double>").collect()
    x = {label: np.array([r["x"] for r in rows if r["label"] == label]) for label in (0, 1)}
    model = fit_pairwise(x[1], x[0], float(share_bad or 0.0))

    # the cut comes from all labelled training rows: as many lie below it as are labelled 0
    labelled = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    strengths = stash(texts.join(labelled, "doc_id").select("label", "text").mapInArrow(
        _strengths(model), "label int, strength double"), "quality-strengths")
    facts = strengths.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("bad")).first()
    if not 0 < facts["bad"] < facts["n"]:
        return model
    middle = (facts["bad"] - 0.5) / (facts["n"] - 1)  # between the last row below and the first one above
    return replace(model, cut=exact_quantile_value(strengths, "strength", middle))


def _strengths(model: PairwiseModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(model.strength(_batch_features(batch.column("text"))))],
                                                 names=["label", "strength"])
    return run


def _scored(model: PairwiseModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_batch_features(batch.column("text"))) if batch.num_rows else np.zeros(0)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], names=[*batch.schema.names[:-1], "score"])
    return run


def score_quality(docs: DataFrame, model: PairwiseModel) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    docs = add_missing(docs, doc_id="bigint", text="string")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    held = F.coalesce(~in_training(F.col("doc_id")), F.lit(False))
    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"),
                      F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _scored(model), "doc_id bigint, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_quality(docs: DataFrame, model: PairwiseModel) -> DataFrame:
    """The documents that the classifier accepts (score >= 0.5), in the input's columns."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
                x = np.stack([features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts])
                yield batch.filter(pa.array(model.score(x) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
