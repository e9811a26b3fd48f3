"""Toxicity by subword-bag embeddings.

A passage is the bag of character 3- to 5-grams of its words (word ends included); their hashed embeddings are
averaged and fed to a linear softmax. Embeddings and softmax are trained jointly in numpy by Adagrad. Because
unseen misspellings of a word share most of its n-grams, they share its vectors.

A document is toxic if a passage is, so documents are cut into passages of ``PASSAGE_WORDS`` words and scored
by their worst one: a few words in a very long text count as much as in a short one. Training starts from the
document labels on at most ``FIRST_PASSAGES`` random passages of each label in the sample, and then goes over to the
passages that the model itself finds worst (those of clean documents as hard negatives). The final score is the worst
passage's logit, shifted so that the cut that parts all labelled training documents best, not those of the sample
only, is 0.5.

Scoring is linear after training: n-gram hash -> one number, averaged, so only a table of ``BUCKETS`` floats
travels. At most ``SAMPLE_PER_LABEL`` labelled rows of each label are used for fitting (those with the
smallest hash of their id), and all texts are scored whole. Training rows are those whose crc32(doc_id as
text) mod 5 is not 0; nothing but the text enters a score.

Defined results: null, empty and wordless texts get the score of a passage without evidence; very long texts are
scored a window of passages at a time; rows are kept with repetitions and tie freely; a labelled id that repeats, or
has both labels, counts once for each of its rows and labels; without both labels to learn from every score is as good as 0; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from starlit.llm.common import add_missing, stash, table

BUCKETS = 1 << 18
DIM = 8
GRAMS = (3, 4, 5)
PASSAGE_WORDS = 8
SAMPLE_PER_LABEL = 1_000
FIRST_PASSAGES = 60_000      # of each label, in the first round of the fit, at most
BROADCAST_LABELS = 1_000_000
CUTS = 4096                  # candidate cuts compared at a time
BATCH_ROWS = 200
WINDOW = 1 << 18             # bytes whose n-grams are held at a time

# Bytes that are part of words (A-Z lower-cased, all of non-ASCII); the others become a space.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
_SPACE = 32


def grams(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bucket ids of all n-grams in the text, passage number of each). A gram may begin or end with the space
    beside a word but holds none inside."""
    data = np.frombuffer(b" " + text.translate(_WORD_BYTES) + b" ", dtype=np.uint8)
    space = data == _SPACE
    begins = np.zeros(len(data), dtype=np.int64)
    begins[:-1] = space[:-1] & ~space[1:]  # the space before a word
    passage = np.maximum(np.cumsum(begins) - 1, 0) // PASSAGE_WORDS
    gaps = np.concatenate([[0], np.cumsum(space)])
    ids, owner = [], []
    wide = data.astype(np.uint64)
    hashed = wide[:len(data)] + np.uint64(1)
    for n in range(2, max(GRAMS) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        hashed = (hashed[:m] * np.uint64(0x9E3779B97F4A7C15)) ^ (wide[n - 1:] + np.uint64(n))
        if n in GRAMS:
            inner = gaps[n - 1:n - 1 + m] == gaps[1:1 + m]
            at = np.flatnonzero(inner)
            mixed = hashed[at]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            ids.append(((mixed >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int32))
            owner.append(passage[at])
    if not ids:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    return np.concatenate(ids), np.concatenate(owner)


def windows(text: bytes) -> Iterator[bytes]:
    """A text in parts of some WINDOW bytes that start with a passage, so that n-grams are made of a part at a time."""
    if len(text) <= WINDOW:
        yield text
        return
    space = np.frombuffer(text.translate(_WORD_BYTES), dtype=np.uint8) == _SPACE
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))[::PASSAGE_WORDS]
    at = 0
    while at < len(text):
        k = int(np.searchsorted(first, at + WINDOW))
        end = int(first[k]) if k < len(first) else len(text)
        yield text[at:end]
        at = end


@dataclass
class SubwordModel:
    """``table``: each bucket's embedding times the softmax's direction; ``bias``, and the documents' ``cut``."""

    table: np.ndarray
    bias: float
    cut: float

    def worst(self, text: bytes) -> float:
        """Logit of the worst passage."""
        found = []
        for window in windows(text):
            ids, owner = grams(window)
            if len(ids):
                total = np.bincount(owner, weights=self.table[ids])
                found.append(float((total / np.maximum(np.bincount(owner), 1)).max()))
        return max(found) + self.bias if found else self.bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        z = np.array([self.worst(t) for t in texts]) - self.cut
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


class _Passages:
    """All passages of some texts as one ragged array."""

    def __init__(self, texts: list[bytes]):
        ids, sizes, docs = [], [], []
        for k, text in enumerate(texts):
            i, owner = grams(text)
            if len(i):
                order = np.argsort(owner, kind="stable")
                ids.append(i[order])
                size = np.bincount(owner)
                sizes.append(size.astype(np.int32))
                docs.append(np.full(len(size), k, dtype=np.int32))
        self.ids = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
        self.docs = np.concatenate(docs) if docs else np.zeros(0, dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[which]
        first = np.repeat(self.starts[which] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        return self.ids[first + np.arange(sizes.sum())], sizes

    def logits(self, table: np.ndarray, bias: float) -> np.ndarray:
        out = np.empty(len(self.sizes))
        for k in range(0, len(out), 10_000):  # some passages at a time: the driver's memory stays small
            part = slice(k, min(k + 10_000, len(out)))
            held = table[self.ids[self.starts[part.start]:self.starts[part.stop]]]
            sums = np.add.reduceat(held, self.starts[part] - self.starts[part.start], dtype=np.float64)
            out[part] = sums / self.sizes[part]
        return out + bias

    def worst_of(self, logits: np.ndarray, n_docs: int, floor: float) -> np.ndarray:
        out = np.full(n_docs, floor)
        np.maximum.at(out, self.docs, logits)
        return out


def fit_subwords(toxic: list[bytes], clean: list[bytes], rounds: int = 5, seed: int = 11,
                 first_passages: int = FIRST_PASSAGES) -> SubwordModel:
    """Joint training of embeddings and softmax; see the module's text. ``first_passages``: how many passages of each
    label, drawn at random, the first round fits at most."""
    if not toxic or not clean:
        return SubwordModel(np.zeros(BUCKETS, dtype=np.float32), -500.0, 0.0)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    g_emb, g_soft, g_bias = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    hot, cold = _Passages(toxic), _Passages(clean)
    if not len(hot.sizes) or not len(cold.sizes):
        return SubwordModel(np.zeros(BUCKETS, dtype=np.float32), -500.0, 0.0)

    def step(ids, sizes, labels):
        nonlocal emb, soft, bias
        owner = np.repeat(np.arange(len(sizes)), sizes)
        mean = np.stack([np.bincount(owner, weights=emb[ids, d], minlength=len(sizes)) for d in range(DIM)], 1)
        mean = (mean / np.maximum(sizes, 1)[:, None]).astype(np.float32)
        z = mean @ soft + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(labels)), labels] -= 1  # slope of the loss by logit
        back = p @ soft.T  # by mean embedding
        touched, inverse = np.unique(ids, return_inverse=True)
        per = back / np.maximum(sizes, 1)[:, None]
        grad = np.stack([np.bincount(inverse, weights=per[owner, d], minlength=len(touched)) for d in range(DIM)], 1)
        g_emb[touched] += (grad ** 2).mean(1)
        emb[touched] -= (0.5 * grad / np.sqrt(g_emb[touched])[:, None]).astype(np.float32)
        d_soft, d_bias = mean.T @ p, p.sum(0)
        g_soft[...] += d_soft ** 2
        g_bias[...] += d_bias ** 2
        soft -= 0.1 * d_soft / np.sqrt(g_soft)
        bias -= 0.1 * d_bias / np.sqrt(g_bias)

    def direction():
        return (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0])

    for r in range(rounds):
        if r == 0:  # every passage takes its document's label
            pos = np.arange(len(hot.sizes))
            neg = np.arange(len(cold.sizes))
            pos, neg = (rng.permutation(x)[:first_passages] for x in (pos, neg))
        else:       # the worst passages; of toxic documents also the harmless ones
            t, b = direction()
            zh, zc = hot.logits(t, b), cold.logits(t, b)
            best = hot.worst_of(zh, len(toxic), -np.inf)[hot.docs]
            pos = np.flatnonzero((zh >= best) | (zh >= np.quantile(zc, 0.999)))
            hard = np.argsort(-zc, kind="stable")[:max(len(pos), 1000)]
            easy = rng.permutation(len(zc))[:4 * len(pos) + 2000]
            neg = np.concatenate([hard, easy])
        for _ in range(2 if r == 0 else 4):
            where = np.concatenate([pos, neg + len(hot.sizes)])
            for batch in np.array_split(rng.permutation(where), max(1, len(where) // 1000)):
                from_hot = batch[batch < len(hot.sizes)]
                from_cold = batch[batch >= len(hot.sizes)] - len(hot.sizes)
                (a, sa), (c, sc) = hot.take(from_hot), cold.take(from_cold)
                step(np.concatenate([a, c]), np.concatenate([sa, sc]),
                     np.concatenate([np.ones(len(sa), dtype=np.int64), np.zeros(len(sc), dtype=np.int64)]))
    t, b = direction()
    zh = hot.worst_of(hot.logits(t, b), len(toxic), b)
    zc = cold.worst_of(cold.logits(t, b), len(clean), b)
    # the cut with the fewest errors per label, in the middle of its gap
    values = np.unique(np.concatenate([zh, zc]))
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2])
    errors = (np.searchsorted(np.sort(zh), cuts) / len(zh)
              + 1 - np.searchsorted(np.sort(zc), cuts) / len(zc))
    least = np.flatnonzero(errors <= errors.min() + 1e-12)
    gap = np.diff(np.concatenate([[values[0] - 1], values]))[least]
    return SubwordModel(t, b, float(cuts[least[np.argmax(gap)]]))


def in_training(doc_id: Column, modulus: int = 5, held: int = 0) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)) != held


def train_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_LABEL) -> SubwordModel:
    """Fit on at most ``sample`` labelled training rows of each label, whose texts come to the driver."""
    docs, labels = add_missing(docs, doc_id="bigint", text="string"), add_missing(labels, doc_id="bigint", toxic="int")
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & in_training(F.col("doc_id"))).distinct()
    chosen = None
    for label in (0, 1):
        part = known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # at most 2 * sample rows: a fixed bound
    rows = texts.join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "text").select("label", "text").collect()
    of = {label: [r["text"].encode() for r in rows if r["label"] == label] for label in (0, 1)}
    model = fit_subwords(of[1], of[0])

    # the cut comes from all labelled training rows, scored by tasks
    labelled = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    worst = stash(texts.join(labelled, "doc_id").select("label", "text").mapInArrow(
        _worst(docs.sparkSession.sparkContext.broadcast(model)), "label int, z double"), "toxicity-worst")
    cut = least_errors(worst)
    return model if cut is None else replace(model, cut=cut)


def _worst(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [broadcast.value.worst(t.as_buffer().to_pybytes()) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(z, pa.float64())], names=["label", "z"])
    return run


def least_errors(rows: DataFrame, rounds: int = 3) -> float | None:
    """The cut of ``z`` with the fewest errors per label over all rows, in the middle of the widest range of equally
    good ones; None without rows of both labels. Each round counts the rows between CUTS candidate cuts, an aggregate of
    at most 2 * CUTS rows, and looks closer around the best."""
    facts = rows.agg(F.count_if(F.col("label") == 1).alias("hot"), F.count_if(F.col("label") == 0).alias("cold"),
                     F.min("z").alias("lo"), F.max("z").alias("hi")).first()
    if not facts["hot"] or not facts["cold"]:
        return None
    lo, hi = facts["lo"] - 1.0, facts["hi"] + 1.0
    for _ in range(rounds):
        cuts = np.linspace(lo, hi, CUTS)
        # number of candidate cuts at or below a row's score, found as it is for any row
        place = F.least(F.lit(CUTS), F.greatest(F.lit(0), F.floor((F.col("z") - F.lit(lo)) / F.lit((hi - lo) / (CUTS - 1))) + 1)).cast("int")
        counts = np.zeros((2, CUTS + 1))
        for r in rows.groupBy("label", place.alias("p")).agg(F.count("*").alias("c")).collect():
            counts[r["label"], r["p"]] += r["c"]
        below = np.cumsum(counts, axis=1)[:, :CUTS]  # rows under each cut
        errors = below[1] / facts["hot"] + 1 - below[0] / facts["cold"]
        good = errors <= errors.min() + 1e-12
        ends = np.flatnonzero(np.diff(np.concatenate([[0], good.astype(int), [0]])))
        first, last = max(zip(ends[::2], ends[1::2] - 1), key=lambda e: cuts[e[1]] - cuts[e[0]])
        best = float(cuts[first] + cuts[last]) / 2
        if last > first:
            return best
        lo, hi = float(cuts[max(first - 1, 0)]), float(cuts[min(last + 1, CUTS - 1)])
    return best


def _scored(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in batches:
            score = model.score([t.as_buffer().to_pybytes() for t in batch.column("text").cast(pa.binary())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64())],
                                             names=["doc_id", "held_out", "score"])
    return run


def score_toxicity(docs: DataFrame, model: SubwordModel) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    docs = add_missing(docs, doc_id="bigint", text="string")
    held = F.coalesce(~in_training(F.col("doc_id")), F.lit(False))
    shared = spark.sparkContext.broadcast(model)  # one float per bucket: a fixed size
    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held.alias("held_out"),
                      F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _scored(shared), "doc_id bigint, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))
