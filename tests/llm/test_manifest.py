"""Merkle manifest against a plain recursive version."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from llm_cases import DOCS, docs_frame
from pyspark.sql import functions as F


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return digest("".join(map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))


def climb(nodes):
    """(top, [siblings left and right of each node, level by level])."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(where):
            start = at - at % 3
            paths[k].append(("".join(nodes[start:at]), "".join(nodes[at + 1:start + 3])))
        nodes = [digest("".join(nodes[k:k + 3])) for k in range(0, len(nodes), 3)]
        where = [at // 3 for at in where]
    return nodes[0], paths


def expected(rows):
    sources = defaultdict(list)
    for r in rows:
        now = r["text"]
        if now is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
            now = now.replace("\n", "")
        sources[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), leaf(r, now), r["doc_id"]))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [(sorted(sources[s]), *climb([x[2] for x in sorted(sources[s])])) for s in order]
    root, up = climb([t[1] for t in trees])
    out = Counter()
    for (leaves, top, paths), above in zip(trees, up):
        for (_, _, own, found, doc_id), path in zip(leaves, paths):
            steps = path + above
            for left, right in steps:
                found = digest(left + found + right)
            out[(doc_id, own, top, root, digest("".join(a + b for a, b in steps)), found, found == root)] += 1
    return out


@pytest.mark.parametrize("block_levels", [1, 2, 6])
def test_manifest(spark, odd_rows, block_levels):
    from starlit.llm.merkle import build_manifest, prove, without_newlines
    more = [(100 + k, f"line {k}\nand\n\nmore" if k % 3 else f"no break {k}", "en", f"s{k % 4}" if k % 2 else "hot") for k in range(70)]
    rows = docs_frame(spark, odd_rows + more + [(200 + k, "x\ny", None, f"lone{k:02d}") for k in range(15)])
    got = prove(build_manifest(rows, without_newlines(), block_levels)).collect()
    assert Counter(map(tuple, got)) == expected(rows.collect())


def test_empty_and_single(spark):
    from starlit.llm.merkle import build_manifest, prove
    assert prove(build_manifest(spark.createDataFrame([], DOCS))).collect() == []
    one = prove(build_manifest(docs_frame(spark, [(7, "a\nb", None, None)]))).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof_sha256"] == digest("") and one["verified"]
    bare = prove(build_manifest(spark.createDataFrame([(1,)], "other long"))).first()
    assert bare["leaf"] == digest("-----") and bare["doc_id"] is None


def test_any_change_is_found(spark, odd_rows):
    from starlit.llm.merkle import build_manifest, prove
    docs = docs_frame(spark, odd_rows)
    same = prove(build_manifest(docs, F.col("text"))).collect()
    assert all(r["verified"] for r in same)
    changed = prove(build_manifest(docs, F.when(F.col("doc_id") == 8, F.lit("one two!")).otherwise(F.col("text")))).collect()
    assert {r["doc_id"] for r in changed if not r["verified"]} == {8}
