"""Classifiers: cuts from all labelled rows, whole-text scores recomputed by hand, odd labels."""

import zlib

import numpy as np
from llm_cases import docs_frame
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def by_hand_windows(text, words):
    from starlit.llm.toxicity import _WORD_BYTES
    all_ = text.translate(_WORD_BYTES).split()
    return [b" ".join(all_[k:k + words]) for k in range(0, len(all_), words)]


def test_long_texts_are_scored_by_passage_windows():
    from starlit.llm import toxicity as tx
    rng = np.random.default_rng(4)
    model = tx.SubwordModel(rng.normal(size=tx.BUCKETS).astype(np.float32), 0.25, 0.0)
    for text in (b"one two", b"", b"  ,, ", b", ".join(b"w%d" % v for v in rng.integers(0, 9999, 150_000)), b"x" * 600_000 + b" y z"):
        parts = by_hand_windows(text, tx.PASSAGE_WORDS)
        each = [tx.SubwordModel(model.table, 0.0, 0.0).worst(p) for p in parts]
        assert model.worst(text) == (max(each) if each else 0.0) + 0.25
        assert b"".join(tx.windows(text)) == text


def test_cut_with_the_fewest_errors(spark):
    from starlit.llm.toxicity import least_errors
    rng = np.random.default_rng(6)
    rows = [(1, float(z)) for z in rng.normal(2, 1, 400)] + [(0, float(z)) for z in rng.normal(-1, 1, 900)]
    cut = least_errors(spark.createDataFrame(rows, "label int, z double"))
    errors = lambda c: sum(z < c for l, z in rows if l) / 400 + sum(z >= c for l, z in rows if not l) / 900
    z = sorted(v for _, v in rows)
    assert abs(errors(cut) - min(errors(c) for c in [z[0] - 1, *((a + b) / 2 for a, b in zip(z, z[1:])), z[-1] + 1])) < 1e-9
    apart = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 8.0)], "label int, z double")
    assert 4.9 < least_errors(apart) < 5.1
    assert least_errors(apart.filter("label = 1")) is None


def training(ids, modulus, held):
    return [i for i in ids if zlib.crc32(str(i).encode()) % modulus != held]


def test_quality_cut_parts_all_labelled_rows(spark):
    """The cut doesn't follow the fitting sample: as many labelled rows lie below it as are labelled 0."""
    from starlit.llm.quality import features, train_quality
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = train_quality(docs, labels, sample=5)
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    own = training(known, 3, 1)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    strengths = [float(model.strength(features(texts[i])[None])[0]) for i in own if i in texts]
    bad = sum(known[i] == 0 for i in own if i in texts)
    assert sum(s < model.cut for s in strengths) == bad


def test_repeated_and_conflicting_labels(spark):
    from starlit.llm.quality import score_quality, train_quality
    from starlit.llm.toxicity import score_toxicity, train_toxicity
    good, bad = "the quiet river ran past the old mill and on to the sea", "BUY!!! ||| NOW $$$ BUY BUY BUY !!!"
    rows = [(k, good if k % 2 else bad, "en", "a") for k in range(40)] + [(1, good, "en", "a")] * 3 + [(5, None, "en", "a"), (None, good, None, None)]
    labels = [(k, k % 2, 1 - k % 2) for k in range(40)] + [(1, 1, 0), (3, 0, 1), (None, 1, 1), (7, None, None), (999, 1, 0)]
    docs, known = docs_frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for score in (score_quality(docs, train_quality(docs, known)), score_toxicity(docs, train_toxicity(docs, known))):
        got = score.collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
        by = {r["doc_id"]: r["predicted"] for r in got if r["doc_id"] not in (5, None)}
        assert len({by[k] for k in range(1, 40, 2) if k != 5}) == 1 and len({by[k] for k in range(0, 40, 2)}) == 1 and by[1] != by[2]


def test_scores_do_not_follow_other_columns(spark):
    from starlit.llm.quality import score_quality, train_quality
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = train_quality(docs, labels)
    one = {r["doc_id"]: r["score"] for r in score_quality(docs, model).collect()}
    other = {r["doc_id"]: r["score"] for r in score_quality(docs.withColumns({"source": F.lit("x"), "lang": F.lit(None).cast("string")}), model).collect()}
    assert one == other
