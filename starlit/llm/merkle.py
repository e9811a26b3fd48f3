"""Merkle manifest of a document table: leaves, a tree per source, a root over the sources, proofs and their check.

A leaf is the digest of a row's fields. A source's leaves in id order are reduced ``ARITY`` at a time, level by level,
to its subroot; the subroots in source order are reduced likewise to the root. A leaf's proof is its siblings on the
way up: folding it with them gives the root if, and only if, the row is what it was when the manifest was made.

Cogrouped subtree exchange: leaves are placed in their source's order (``operators.positions``: no task holds a whole
source) and cut into superblocks of ``ARITY ** BLOCK_LEVELS``. Each superblock is reduced by itself in one pandas
group, and only its top goes on to the next layer, which is cut and reduced the same way, until a source has one node;
the subroots are one more tree of this kind. Back down, a layer's nodes are cogrouped by superblock with the outer
nodes that superblock needs (the siblings above its top, a few digests): the group finishes its local reduction,
joins proofs and, at the leaves, folds. Every group is bounded by a superblock (small sources share groups of about
its size), every layer is a written table, and texts never leave the scan: the exchange moves digests alone.

H is sha256 in lower-case hex; its inputs are concatenated, digests as hex text. A field goes in as its UTF-8 byte count,
``:`` and its value (integers decimal), null as ``-``.

Defined results: nulls in any column are fields like others; a null id comes first in its source, rows that repeat an id
are ordered by leaf and proved each; a null source is a source of its own and comes first, then sources by
their UTF-8 bytes; a lone node that is a run of its own is hashed all the same, a source of one row is its own subroot
and a single subroot is the root; a proof without siblings is the digest of nothing; empty and very long texts are
hashed whole; an empty table has no rows and the root is null; other columns are ignored, whatever their names, and
absent ones are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from starlit.llm.common import add_missing, stash, table
from starlit.operators.positions import place

ARITY = 3
BLOCK_LEVELS = 6
FIELDS = {"doc_id": "bigint", "source": "string", "lang": "string", "n_chars": "bigint", "text": "string"}

_NODES = "tree string, position bigint, total bigint, digest string"
_OUTER = "tree string, position bigint, lefts array<string>, rights array<string>, subroot string"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**replaced: Column) -> Column:
    """Digest of a row's fields, some of them replaced."""
    return F.sha2(F.concat(*[field(replaced.get(c, F.col(c))) for c in FIELDS]), 256)


# inside a superblock

def climb(nodes: list[str], whole: bool, block_levels: int) -> list[list[str]]:
    """Levels of a superblock from its nodes up: ``block_levels`` of them, or until one node remains if the block is
    a whole tree."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= block_levels:
        last = levels[-1]
        levels.append([_hash("".join(last[k:k + ARITY])) for k in range(0, len(last), ARITY)])
    return levels


def siblings(levels: list[list[str]], place_: int) -> tuple[list[str], list[str]]:
    """Of each level below the top: what stands left and right of the node's ancestor in its run, concatenated."""
    lefts, rights = [], []
    for level in levels[:-1]:
        start = place_ - place_ % ARITY
        lefts.append("".join(level[start:place_]))
        rights.append("".join(level[place_ + 1:start + ARITY]))
        place_ //= ARITY
    return lefts, rights


def fold(digest: str, lefts: list[str], rights: list[str]) -> str:
    for left, right in zip(lefts, rights):
        digest = _hash(left + digest + right)
    return digest


def _blocks(nodes: pd.DataFrame, block_levels: int) -> Iterator[tuple[tuple[str, int], pd.DataFrame, list[list[str]]]]:
    """((tree, block), its rows in order, its levels) of the superblocks in one group."""
    nodes, size = nodes.sort_values(["tree", "position"], kind="stable"), ARITY ** block_levels
    for key, rows in nodes.groupby(["tree", nodes["position"] // size], sort=False):
        yield key, rows, climb(rows["digest"].tolist(), int(rows["total"].iloc[0]) <= size, block_levels)


def _reduce(block_levels: int):
    def run(nodes: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(tree, block, -(-int(rows["total"].iloc[0]) // ARITY ** block_levels), levels[-1][0])
                             for (tree, block), rows, levels in _blocks(nodes, block_levels)], columns=["tree", "position", "total", "digest"])
    return run


def _outer_of(outer: pd.DataFrame) -> dict:
    return {(r.tree, r.position): (list(r.lefts), list(r.rights), r.subroot) for r in outer.itertuples(index=False)}


def _descend(block_levels: int):
    """Proofs of a layer's nodes, given those of its superblocks' tops."""
    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        above, out = _outer_of(outer), []
        for (tree, block), rows, levels in _blocks(nodes, block_levels):
            up_left, up_right, subroot = above[tree, block]
            for k, position in enumerate(rows["position"]):
                lefts, rights = siblings(levels, k)
                out.append((tree, position, lefts + up_left, rights + up_right, subroot))
        return pd.DataFrame(out, columns=["tree", "position", "lefts", "rights", "subroot"])
    return run


def _prove(root: str, block_levels: int):
    def run(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        above, out = _outer_of(outer), []
        for (tree, block), rows, levels in _blocks(leaves, block_levels):
            up_left, up_right, subroot = above[tree, block]
            up = "".join(a + b for a, b in zip(up_left, up_right))
            tops: dict[str, str] = {}  # folded roots by what the fold makes of this block's top
            for k, (doc_id, digest, found) in enumerate(zip(rows["doc_id"], rows["digest"], rows["found"])):
                lefts, rights = siblings(levels, k)
                top = fold(found, lefts, rights)
                folded = tops.get(top) or tops.setdefault(top, fold(top, up_left, up_right))
                proof = _hash("".join(a + b for a, b in zip(lefts, rights)) + up)
                out.append((None if pd.isna(doc_id) else int(doc_id), digest, subroot, root, proof, folded, folded == root))
        return pd.DataFrame(out, columns=_PROVED_NAMES).astype({"doc_id": "Int64"})
    return run


_PROVED = ("doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
_PROVED_NAMES = [x.split()[0] for x in _PROVED.split(", ")]


# between superblocks

def _units(nodes: DataFrame, groups: int, size: int) -> DataFrame:
    """Group of each node: a superblock, or for trees of one superblock a share of all of those."""
    own = F.concat(F.lit("b"), F.expr(f"position div {size}").cast("string"), F.lit("/"), F.col("tree"))
    return nodes.withColumn("unit", F.when(F.col("total") > size, own).otherwise(_share(groups)))


def _share(groups: int) -> Column:
    return F.concat(F.lit("s"), F.pmod(F.xxhash64("tree"), F.lit(groups)).cast("string"))


@dataclass
class Forest:
    """Layers of nodes from the leaves up; the last holds trees of one superblock only. tops: one row per tree."""

    layers: list[DataFrame]
    groups: list[int]
    tops: DataFrame
    block_levels: int


def grow(leaves: DataFrame, block_levels: int = BLOCK_LEVELS) -> Forest:
    """Reduce every tree of (tree, position, total, digest, ...) to its top, a superblock at a time."""
    layers, groups, tops, size = [], [], None, ARITY ** block_levels
    while True:
        facts = leaves.agg(F.coalesce(F.max("total"), F.lit(0)).alias("most"), F.count("*").alias("n")).first()
        n_groups = -(-facts["n"] // size) or 1
        layers.append(_units(leaves, n_groups, size))
        groups.append(n_groups)
        reduced = stash(layers[-1].select("tree", "position", "total", "digest", "unit").groupBy("unit").applyInPandas(_reduce(block_levels), _NODES), "merkle-layer")
        done = reduced.filter("total = 1").select("tree", "digest")
        tops = done if tops is None else tops.union(done)
        if facts["most"] <= size:
            return Forest(layers, groups, tops, block_levels)
        leaves = reduced.filter("total > 1")


def outer_nodes(forest: Forest, above_tops: DataFrame) -> DataFrame:
    """Proofs of the leaf layer's superblock tops, with their group. ``above_tops``: of every tree's top, its siblings
    further up (lefts, rights) and its subroot."""
    small = above_tops.select("tree", F.lit(0).cast("bigint").alias("position"), "lefts", "rights", "subroot")
    upper, size = None, ARITY ** forest.block_levels
    for k in reversed(range(len(forest.layers))):
        layer = forest.layers[k]
        ends_here = layer.filter(F.col("total") <= size).select("tree").distinct()
        outer = small.join(ends_here, "tree").withColumn("unit", _share(forest.groups[k]))
        if upper is not None:
            outer = outer.unionByName(upper.withColumn("unit", F.concat(F.lit("b"), F.col("position").cast("string"), F.lit("/"), F.col("tree"))))
        outer = stash(outer, "merkle-outer")
        if k == 0:
            return outer
        nodes = layer.select("tree", "position", "total", "digest", "unit")
        upper = stash(nodes.groupBy("unit").cogroup(outer.groupBy("unit")).applyInPandas(_descend(forest.block_levels), _OUTER), "merkle-proofs")


@dataclass
class Manifest:
    """leaves: doc_id, source, position, digest, found. subroots: source, tree, position, digest. root: null when empty."""

    leaves: DataFrame
    subroots: DataFrame
    root: str | None
    sources: Forest
    forest: Forest


def build_manifest(docs: DataFrame, found_text: Column | None = None, block_levels: int = BLOCK_LEVELS) -> Manifest:
    """The manifest of ``docs``; ``found_text``: a row's text as a later check finds it (as it is, by default)."""
    docs = add_missing(docs, **FIELDS).select(*[F.col(c).cast(t).alias(c) for c, t in FIELDS.items()])
    found = leaf() if found_text is None else F.when(found_text.eqNullSafe(F.col("text")), leaf()).otherwise(leaf(text=found_text))
    # written first: the range bounds are sampled from digests, and texts are read and hashed once
    leaves = stash(docs.select("doc_id", "source", leaf().alias("digest"), found.alias("found")), "merkle-leaves")
    placed = place(leaves, ["source"], [F.col("doc_id").asc_nulls_first(), "digest", "found"])
    leaves = placed.positions().withColumn("tree", field(F.col("source")))
    forest = grow(leaves, block_levels)

    named = leaves.select("tree", "source").distinct()
    tops = place(forest.tops.join(named, "tree"), [], [F.col("source").asc_nulls_first()]).positions()
    subroots = stash(tops.select("source", F.col("tree").alias("own"), F.lit("").alias("tree"), "position", "total", "digest"), "merkle-subroots")
    sources = grow(subroots, block_levels)
    root = sources.tops.select("digest").first()
    return Manifest(leaves, subroots, root["digest"] if root else None, sources, forest)


def prove(manifest: Manifest) -> DataFrame:
    """One row per document: its leaf, subroot and root, the digest of its proof, and what folding the text found
    now with that proof gives."""
    if manifest.root is None:
        return manifest.leaves.sparkSession.createDataFrame([], _PROVED)
    none = F.array().cast("array<string>")
    # proofs of the subroots in the tree of sources, whose own top has nothing above it
    top = manifest.sources.tops.select("tree", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"))
    layer = manifest.sources.layers[0].select("tree", "position", "total", "digest", "unit")
    paths = stash(layer.groupBy("unit").cogroup(outer_nodes(manifest.sources, top).groupBy("unit")).applyInPandas(_descend(manifest.sources.block_levels), _OUTER), "merkle-paths")
    above = paths.drop("tree", "subroot").join(manifest.subroots.select("position", F.col("own").alias("tree"), F.col("digest").alias("subroot")), "position")
    outer = outer_nodes(manifest.forest, above)
    leaves = manifest.forest.layers[0].select("tree", "position", "total", "digest", "found", "doc_id", "unit")
    return leaves.groupBy("unit").cogroup(outer.groupBy("unit")).applyInPandas(_prove(manifest.root, manifest.forest.block_levels), _PROVED)


def without_newlines() -> Column:
    """The tampering of the registered query: where 2 divides the CRC of the decimal id, line feeds are deleted."""
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return F.when(picked, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return prove(build_manifest(table(spark, sf_dir, "documents"), without_newlines()))


# DuckDB statement of the same trees; CRC parity by the bitwise rule over the id's decimal digits.
OP13_SQL = """
WITH RECURSIVE
f AS (SELECT doc_id, source, text,
        CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
        || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
        || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
        || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head,
        (SELECT list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1)))),
                lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS crc
      FROM documents),
l AS (SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
        CASE WHEN coalesce(crc & 1 = 1, false) THEN replace(text, chr(10), '') ELSE text END AS now, head FROM f),
o AS (SELECT doc_id, source, leaf, sha256(head || CASE WHEN now IS NULL THEN '-' ELSE strlen(now) || ':' || now END) AS found,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
up AS (SELECT source, 0 AS lv, pos, n, leaf AS h FROM o
       UNION ALL
       SELECT source, lv + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY source, lv, pos // 3),
sub AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS lv, pos, n, h FROM sub
        UNION ALL
        SELECT lv + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lv, pos // 3),
nodes AS (SELECT source, false AS outer_, lv, pos, h FROM up WHERE n > 1 UNION ALL SELECT NULL, true, lv, pos, h FROM top WHERE n > 1),
path AS (SELECT doc_id, leaf, found, source, pos AS own, false AS outer_, lv, pos // power(3, lv)::BIGINT AS p
         FROM (SELECT o.*, unnest(range(0, (SELECT max(lv) + 1 FROM up))) AS lv FROM o)
         UNION ALL
         SELECT doc_id, leaf, found, source, own, true, lv, s // power(3, lv)::BIGINT
         FROM (SELECT o.doc_id, o.leaf, o.found, o.source, o.pos AS own, sub.pos AS s, unnest(range(0, (SELECT max(lv) + 1 FROM top))) AS lv
               FROM o JOIN sub ON o.source IS NOT DISTINCT FROM sub.source)),
sib AS (SELECT path.doc_id, path.leaf, path.found, path.source, path.own, path.outer_, path.lv,
          coalesce(string_agg(nodes.h, '' ORDER BY nodes.pos) FILTER (WHERE nodes.pos < path.p), '') AS lefts,
          coalesce(string_agg(nodes.h, '' ORDER BY nodes.pos) FILTER (WHERE nodes.pos > path.p), '') AS rights
        FROM path JOIN nodes ON nodes.outer_ = path.outer_ AND nodes.lv = path.lv AND nodes.pos // 3 = path.p // 3
          AND (path.outer_ OR nodes.source IS NOT DISTINCT FROM path.source)
        GROUP BY ALL),
steps AS (SELECT doc_id, leaf, found, source, own, string_agg(lefts || rights, '' ORDER BY outer_, lv) AS proof,
            list(lefts ORDER BY outer_, lv) AS ls, list(rights ORDER BY outer_, lv) AS rs FROM sib GROUP BY ALL),
whole AS (SELECT o.doc_id, o.leaf, o.found, o.source, coalesce(proof, '') AS proof, coalesce(ls, []) AS ls, coalesce(rs, []) AS rs
          FROM o LEFT JOIN steps ON o.source IS NOT DISTINCT FROM steps.source AND o.pos = steps.own)
SELECT w.doc_id, w.leaf, sub.h AS subroot, r.h AS root, sha256(w.proof) AS proof_sha256,
       list_reduce(list_prepend(w.found, list_transform(range(1, len(ls) + 1), lambda k: ls[k] || '|' || rs[k])),
                   lambda d, s: sha256(split_part(s, '|', 1) || d || split_part(s, '|', 2))) AS folded_root,
       folded_root = r.h AS verified
FROM whole w JOIN sub ON w.source IS NOT DISTINCT FROM sub.source, (SELECT h FROM top WHERE n = 1) r
"""
