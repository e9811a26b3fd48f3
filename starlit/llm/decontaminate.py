"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``WINDOW`` consecutive words (a shorter item is one window), and a
window is the set of its word shingles (``SHINGLE`` words, fewer in a shorter window) with their offsets.
Shingles are ordered by how rare they are in the documents. A window lies in a document only if all its
shingles do, so the prefix that containment makes necessary is its rarest shingle: documents are joined on
that one, candidates whose window would begin before the document or end behind it fall to the positional and
length bounds, and the others are verified exactly: every shingle of the window at its own place.

One pass over the texts finds the occurrences of item shingles (words themselves, not hashes); from there on
only (document key, position, shingle number) rows are shuffled, never texts. A passage that many documents
share costs rows in proportion to its occurrences; its hot shingle key is split by AQE or, while the item side
is below ``BROADCAST_ROWS`` rows (counted first), not shuffled at all.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.

Defined results: null and wordless texts have no words and are never contaminated; wordless items have no
window; an item with a null id counts under the empty id; rows that repeat (id, text) get the same result,
and rows that repeat an id with another text their own; an empty benchmark or document table works; other
columns are ignored by ``find_contamination`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from starlit.llm.common import add_missing, ascii_lower, stash, table

WINDOW = 10
SHINGLE = 3
BROADCAST_ROWS = 500_000
# Fixed classes of the contract; the second also takes A-Z, for counting words in texts as they are.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
ANY_CASE_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _shingles(size: int) -> str:
    """SQL text: the shingles of ``size`` words of the array ``w``, in order."""
    one = "w[i]" if size == 1 else "concat_ws(' ', " + ", ".join(f"w[i + {k}]" if k else "w[i]" for k in range(size)) + ")"
    return (f"if(size(w) < {size}, cast(array() as array<string>), "
            f"transform(sequence(0, size(w) - {size}), i -> {one}))")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side whose counted rows are under the bound; beyond it the join shuffles (AQE splits hot keys)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(windows: wid, len, shingles array; items: wid, item_id as string), windows being distinct word sequences."""
    items = add_missing(benchmark, item_id="bigint", text="string").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).filter("size(w) > 0")
    cut = items.select("item_id", F.explode(F.expr(
        f"if(size(w) <= {window}, array(w), transform(sequence(1, size(w) - {window - 1}), i -> slice(w, i, {window})))")).alias("w"))
    by_size = "case " + " ".join(f"when size(w) = {k} then {_shingles(k)}" for k in range(1, shingle)) + f" else {_shingles(shingle)} end"
    distinct = stash(cut.select("w").distinct().select("w", F.monotonically_increasing_id().alias("wid")), "decon-windows")
    windows = distinct.select("wid", F.size("w").alias("len"), F.expr(by_size if shingle > 1 else _shingles(1)).alias("shingles"))
    return windows, cut.join(distinct, "w").select("wid", "item_id").distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    docs = add_missing(docs, doc_id="bigint", text="string")
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"),
                       F.xxhash64("text").alias("text_key"))


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(verified window occurrences: key, text_key, wid, start, len; items of the windows)."""
    windows, items = item_windows(benchmark, window, shingle)
    parts = stash(windows.select("wid", "len", F.posexplode("shingles").alias("offset", "shingle")), "decon-shingles")
    numbered = stash(parts.select("shingle").distinct().select("shingle", F.monotonically_increasing_id().alias("sid")), "decon-sids")
    n_shingles = numbered.count()
    sizes = sorted((r["n"] for r in windows.select(F.least("len", F.lit(shingle)).alias("n")).distinct().collect()), reverse=True)

    # places of item shingles in documents; arrays of several shingle sizes follow one another
    tokens = _keyed(docs).select("key", "text_key", words(F.col("text")).alias("w"))
    arrays = [_shingles(k) for k in sizes] or ["cast(array() as array<string>)"]
    placed = tokens.select("key", "text_key", F.expr("size(w)").alias("n"), F.posexplode(F.expr(
        arrays[0] if len(arrays) == 1 else f"concat({', '.join(arrays)})")).alias("at", "shingle"))
    shift = "0" if len(sizes) < 2 else "case " + " ".join(
        f"when length(shingle) - length(replace(shingle, ' ', '')) = {k - 1} then "
        + " + ".join(["0"] + [f"greatest(n - {j - 1}, 0)" for j in sizes if j > k]) for k in sizes) + " end"
    found = stash(placed.join(_small(numbered, n_shingles), "shingle")
                  .select("key", "text_key", "n", F.expr(f"at - ({shift})").alias("pos"), "sid").distinct(), "decon-found")

    # the necessary prefix: each window's rarest shingle; a window with a shingle that no document has is out
    rarity = found.groupBy("sid").agg(F.count("*").alias("seen"))
    known = stash(parts.join(numbered, "shingle").join(rarity, "sid", "left").select(
        "wid", "len", "offset", "sid", F.coalesce("seen", F.lit(0)).alias("seen")), "decon-known")
    rarest = known.groupBy("wid", "len").agg(
        F.min_by(F.struct("sid", "offset", "seen"), F.struct("seen", "offset")).alias("r"), F.count("*").alias("m")
    ).filter("r.seen > 0").select("wid", "len", "m", F.col("r.sid").alias("sid"), F.col("r.offset").alias("offset"))
    candidates = (found.join(_small(rarest, n_shingles), "sid")
                  .withColumn("start", F.col("pos") - F.col("offset"))
                  .filter("start >= 0 and start + len <= n")
                  .select("key", "text_key", "wid", "start", "len", "m"))
    shape = known.select(F.col("wid"), F.col("offset").alias("step"), F.col("sid"))
    asked = (candidates.join(_small(shape, n_shingles), "wid")
             .select("key", "text_key", "wid", "start", "len", "m", (F.col("start") + F.col("step")).alias("pos"), "sid"))
    verified = (asked.join(found.select("key", "text_key", "pos", "sid"), ["key", "text_key", "pos", "sid"])
                .groupBy("key", "text_key", "wid", "start", "len", "m").agg(F.count("*").alias("met"))
                .filter("met = m").select("key", "text_key", "wid", "start", "len"))
    return stash(verified, "decon-verified"), items


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    verified, items = occurrences(docs, benchmark, window, shingle)
    base = stash(_keyed(docs).select("doc_id", "key", "text_key", F.coalesce(
        F.regexp_count("text", F.lit(ANY_CASE_WORD)), F.lit(0)).cast("long").alias("n_words")), "decon-docs")
    doc = Window.partitionBy("key", "text_key").orderBy("start", "len", "wid")
    before = F.coalesce(F.max(F.col("start") + F.col("len")).over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = (verified.withColumn("fresh", F.col("start") + F.col("len") - F.greatest("start", before))
               .groupBy("key", "text_key").agg(F.sum(F.greatest("fresh", F.lit(0))).alias("n_hit")))
    named = (verified.select("key", "text_key", "wid").distinct().join(items, "wid")
             .groupBy("key", "text_key").agg(F.array_sort(F.collect_set("item_id")).alias("ids")))
    return (base.join(covered.join(named, ["key", "text_key"]), ["key", "text_key"], "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
                    (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The documents without those in which a benchmark window occurs; the input's columns."""
    verified, _ = occurrences(docs, benchmark, window, shingle)
    hit = verified.select(F.col("key").alias("_decon_key"), F.col("text_key").alias("_decon_text")).distinct()
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.join(hit, (key == F.col("_decon_key")) & (F.xxhash64("text") == F.col("_decon_text")), "left_anti")


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# DuckDB statement of the same windows, for the registered query.
OP2_SQL = r"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     iw AS (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0),
     win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s + 1:s + 10], ' ') AS k FROM iw),
     d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     dw AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
     h AS (SELECT DISTINCT doc_id, item_id, s, dw.n FROM (SELECT doc_id, n, s, array_to_string(w[s + 1:s + n], ' ') AS k FROM dw) dw
           JOIN win USING (n, k)),
     c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
     t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(item_id))), ',') AS ids
           FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
