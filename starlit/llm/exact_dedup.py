"""Exact deduplication with streaming keyed state.

Fingerprints of new documents (digest of the normalised text, code points, id, content locator) are appended
to an inbox folder; a Structured Streaming query reads what is new there and keeps, per digest, the number of
rows and the row that stays, in a RocksDB state store without expiry. State lives on executor disks with its
changes in the stream's checkpoint on shared storage, so a lost executor restores it and a later run with the
same ``state_dir`` goes on from it: texts seen in any earlier run are found again.

A digest that is hit more than once is checked on full bytes: the contents are fetched by locator and grouped
by (digest, normalised text), aggregated before the shuffle, so a group of copies with a third of all rows
costs one row per task. If a digest turns out to stand for several texts, its rows are regrouped by text.

Normalisation deletes ``[\\x20\\x09-\\x0D]``. Of equal texts the row with the most code points in the original
text stays, then the smallest id, then the smallest locator.

Defined results: null counts as the empty text (all of those are one group); a null id loses ties against any
other; rows that repeat an id are separate rows, of which one stays (without a locator of their own, rows that repeat
id and text are told apart by nothing and share their decision); an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from starlit.llm.common import SPACES, add_missing, scratch_dir, stash, table

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # no space reserved ahead: each partition's store would hold 4 MB of disk, however small its state
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
FINGERPRINT = "locator string, doc_id bigint, n_points bigint, digest string"


def normalised(text: Column) -> Column:
    """The text without its six white-space characters; null becomes the empty text."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256_digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def advance_state(spark: SparkSession, state_dir: str, files_per_batch: int = 10_000) -> DataFrame:
    """Feed the inbox's new fingerprints through the keyed state and return the state: digest, group_size,
    and the row that stays (keep_id, keep_locator)."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        stream = (spark.readStream.schema(FINGERPRINT).option("maxFilesPerTrigger", files_per_batch)
                  .parquet(f"{state_dir}/inbox"))
        kept = F.max(F.struct("n_points", (-F.col("doc_id")).alias("neg_id"), "locator")).alias("kept")
        query = (stream.groupBy("digest").agg(F.count("*").alias("group_size"), kept)
                 .writeStream.outputMode("update").format("noop").trigger(availableNow=True)
                 .option("checkpointLocation", f"{state_dir}/stream").start())
        query.awaitTermination()
        state = spark.read.format("statestore").load(f"{state_dir}/stream")
        return stash(state.select(
            F.col("key.digest").alias("digest"), F.expr("value.count").alias("group_size"),
            (-F.expr("value.max.neg_id")).alias("keep_id"), F.expr("value.max.locator").alias("keep_locator")),
            "dedup-state")
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def deduplicate(docs: DataFrame, locator: Column | None = None, state_dir: str | None = None,
                corpus: DataFrame | None = None, digest: Callable[[Column], Column] = sha256_digest,
                files_per_batch: int = 10_000) -> DataFrame:
    """One row per document of ``docs``: doc_id, keep_id, group_size, kept and text_sha256
    (the digest; another ``digest`` function is for tests of collisions).

    ``locator`` names a row's place in storage (default: id and text hash). ``state_dir`` keeps the state
    between runs; ``corpus`` is then the table (with the same locators) in which earlier contents are found."""
    spark = docs.sparkSession
    state_dir = state_dir or scratch_dir(spark, "dedup")

    def located(df: DataFrame) -> DataFrame:
        df = add_missing(df, doc_id="bigint", text="string")
        where = locator if locator is not None else F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64("text"))
        return df.select(where.alias("locator"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    new = located(docs)
    prints = stash(new.select("locator", "doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("n_points"),
                              digest(F.col("text")).alias("digest")), "dedup-prints")
    prints.write.mode("append").parquet(f"{state_dir}/inbox")
    state = advance_state(spark, state_dir, files_per_batch)

    hits = prints.join(state.filter("group_size > 1"), "digest")
    suspects = hits.select("digest", "locator").union(hits.select("digest", F.col("keep_locator").alias("locator"))).distinct()
    contents = located(corpus if corpus is not None else docs).select("locator", "text")
    texts = contents.join(suspects, "locator").select("digest", "locator", normalised(F.col("text")).alias("norm"))
    mixed = stash(texts.groupBy("digest", "norm").agg(F.lit(1).alias("one")).groupBy("digest")
                  .agg(F.count("*").alias("texts")).filter("texts > 1").select("digest"), "dedup-mixed")
    out = prints.join(state, "digest")
    if not mixed.isEmpty():
        out = _regrouped(out, prints, located(docs), mixed)
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                      F.col("locator").eqNullSafe(F.col("keep_locator")).alias("kept"),
                      F.col("digest").alias("text_sha256"))


def _regrouped(out: DataFrame, prints: DataFrame, new: DataFrame, mixed: DataFrame) -> DataFrame:
    """Rows whose digest stands for several texts, grouped by the texts themselves."""
    texts = new.select("locator", normalised(F.col("text")).alias("norm")).distinct()
    own = prints.join(mixed, "digest").join(texts, "locator")
    groups = own.groupBy("digest", "norm").agg(
        F.count("*").alias("group_size"),
        F.max(F.struct("n_points", (-F.col("doc_id")).alias("neg_id"), "locator")).alias("best"))
    again = own.join(groups, ["digest", "norm"]).select(
        "digest", "locator", "doc_id", "n_points", "group_size", (-F.col("best.neg_id")).alias("keep_id"),
        F.col("best.locator").alias("keep_locator"))
    return out.join(mixed, "digest", "left_anti").select(*again.columns).unionByName(again)


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    return deduplicate(docs.select("doc_id", "text", place.alias("place")), F.col("place"))


# DuckDB statement of the same groups, for the registered query.
OP1_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
     k AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
                  first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_points DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
