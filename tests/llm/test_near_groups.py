"""Near duplicates in large groups around the threshold: whole results, and rows that grow with the group only."""

import random
import re

import numpy as np
import pytest
from llm_cases import components, docs_frame, lower

SPACE_WORD = r"[^\x20\x09-\x0D]+"


def shingles(text):
    w = re.findall(SPACE_WORD, lower(text))
    return {" ".join(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def around_threshold(n, changed, words=120, seed=5):
    """Copies of one text with so many words changed that pairs lie on both sides of the threshold."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for k in range(n):
        own = list(base)
        for at in rng.sample(range(words), rng.choice(changed)):
            own[at] = f"c{rng.randrange(10 ** 6)}"
        out.append((k + 1, " ".join(own), "en", "a"))
    return out


def linked(sets):
    ids = sorted(sets)
    return [(a, b) for x, a in enumerate(ids) for b in ids[x + 1:]
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]


def near_rows(spark, rows, monkeypatch):
    """(result, rows of every table written on the way)."""
    from starlit.llm import near_dedup as nd
    written = {}
    stash = nd.stash

    def counted(df, name, *more):
        out = stash(df, name, *more)
        written[name] = max(written.get(name, 0), out.count())
        return out
    monkeypatch.setattr(nd, "stash", counted)
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(docs_frame(spark, rows)).collect()}
    monkeypatch.setattr(nd, "stash", stash)
    return got, written


def test_groups_around_the_threshold(spark, monkeypatch):
    from starlit.llm import near_dedup as nd
    monkeypatch.setattr(nd, "BLOCK", 100)  # a key's members fill several blocks
    sizes = {}
    for n in (150, 300):
        rows = around_threshold(n, [1, 2, 3, 4, 5, 6]) + [(1000 + k, t, "en", "a") for k, (_, t, *_) in enumerate(around_threshold(40, [5, 6], seed=9))]
        sets = {r[0]: shingles(r[1]) for r in rows}
        got, written = near_rows(spark, rows, monkeypatch)
        assert got == components(sets, linked(sets))
        sizes[n] = written
    # pairs don't become rows: links join components, sets are one for each document
    assert sizes[300].get("near-across", 0) <= 300 and sizes[300].get("near-open-sets", 0) <= 340
    assert sizes[300]["near-pairs"] <= 2.5 * max(sizes[150]["near-pairs"], 100)


def test_repeated_rows_do_not_multiply(spark, monkeypatch):
    a, b = (r[1] for r in around_threshold(2, [1]))
    rows = [(1, a, "en", "a")] * 60 + [(2, b, "en", "a")] * 60
    got, written = near_rows(spark, rows, monkeypatch)
    assert got == {1: 1, 2: 1} and written["near-sets"] == 2 and written["near-links"] == 1


def test_long_texts_are_hashed_in_windows():
    from starlit.llm import near_dedup as nd
    rng = np.random.default_rng(3)
    words = [b"%x" % v for v in rng.integers(0, 1 << 40, 300_000)]
    long, huge = b" ".join(words), b"z" * 5_000_000
    texts = [b"A b  C", b"", long, b"a " + huge + b" b", b"\n\t", b"tail"]
    hashes, owner = nd.word_hashes(texts)
    assert np.bincount(owner, minlength=6).tolist() == [3, 0, 300_000, 3, 0, 1]
    alone = {w: h for w, h in zip([b"a", b"b", b"c", words[7], words[-1], huge], nd.word_hashes([b"a b c " + words[7] + b" " + words[-1] + b" " + huge])[0])}
    assert hashes[:3].tolist() == [alone[b"a"], alone[b"b"], alone[b"c"]]
    assert hashes[3 + 7] == alone[words[7]] and hashes[3 + 299_999] == alone[words[-1]] and hashes[300_004] == alone[huge]
    assert len(nd._powers[0]) == 2 * nd.CHUNK_BYTES
    assert nd.word_hashes([])[0].tolist() == nd.word_hashes([b"", b" "])[0].tolist() == []
