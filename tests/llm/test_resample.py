"""Importance resampling against a brute-force version."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import DOCS, docs_frame, lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, max_run):
    w = WORD.findall(lower(text))
    return [" ".join(w[k:k + n]) for n in range(1, max_run + 1) for k in range(len(w) - n + 1)], len(w)


def expected(docs, target, max_run=1, buckets=10_000, percent=10, least=20):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(place(f) for _, t in docs for f in features(t, max_run)[0])
    t = Counter(place(f) for x in target for f in features(x, max_run)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in docs:
        own, words = features(text, max_run)
        gains = [math.floor(1000 * math.log((t[place(f)] + 1) * (s_all + buckets) / ((s[place(f)] + 1) * (t_all + buckets)))) for f in own]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = able[:percent * len(able) // 100]
    out = Counter((*r[:4], k + 1) for k, r in enumerate(drawn))
    return out + Counter((*r[:4], None) for r in able[len(drawn):]) + Counter((*r[:4], None) for r in rows if not r[4])


@pytest.mark.parametrize("max_run,buckets", [(1, 10_000), (3, 97)])
def test_resample(spark, odd_rows, max_run, buckets):
    from starlit.llm.resample import resample
    more = [(300 + k, " ".join(f"W{(k * j) % 31}-é{j % 7}" for j in range(k % 45)), "en", "a") for k in range(80)] + [(300, "x " * 30, "en", "a")] * 3
    rows, target = odd_rows + more, ["w1 w2 w3 é5", None, "", "W4 " * 50, "一二三 x"]
    got = resample(docs_frame(spark, rows), spark.createDataFrame([(t, 1) for t in target], "text string, weight int"),
                   max_run, buckets, percent=30)
    assert Counter(map(tuple, got.collect())) == expected([r[:2] for r in rows], target, max_run, buckets, 30)


def test_empty_tables_and_no_one_eligible(spark, odd_rows):
    from starlit.llm.resample import resample
    empty, docs = spark.createDataFrame([], DOCS), docs_frame(spark, odd_rows)
    assert resample(empty, docs).collect() == []
    assert Counter(map(tuple, resample(docs, empty).collect())) == expected([r[:2] for r in odd_rows], [])
    few = docs_frame(spark, [(1, "too few words", "en", "a")])
    assert few.count() == 1 and resample(few, docs).first()["rank"] is None


def test_checksums_of_every_length():
    from starlit.llm.resample import checksums
    features_ = [os.urandom(k % 300) for k in range(2000)] + [b"", b"a"]
    assert (checksums(features_) == np.array([zlib.crc32(f) for f in features_], dtype=np.uint32)).all()


def test_long_texts_in_bounded_runs(spark):
    from starlit.llm import resample as m
    long = " ".join(f"w{k % 1000}" for k in range(500_000))
    texts = [(1, long), (2, "y" * 3_000_000), (3, "a b " * 10)]
    got = m.resample(docs_frame(spark, [(i, t, "en", "a") for i, t in texts]), spark.createDataFrame([("w1 w2 yy",)], "text string"), percent=50)
    assert Counter(map(tuple, got.collect())) == expected(texts, ["w1 w2 yy"], percent=50)
    runs = list(m._feature_runs([long.encode(), None, b""], 2))
    assert sum(len(f) for _, _, f in runs) == 2 * 500_000 - 1 and max(len(f) for _, _, f in runs) <= 2 * m.RUN_FEATURES + 1


def test_settings_come_back(spark):
    from starlit.llm.common import arrow_batches
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), arrow_batches(spark, 17, 1 << 20):
        assert spark.conf.get(key) == "17"
        1 / 0
    assert spark.conf.get(key) == before
