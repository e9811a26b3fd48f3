"""Mixing sources to target weights.

Every source's words are packed end to end into blocks of ``block_words`` (the last one may be short). A
source's target is its weighted share of all words, capped at ``MAX_REPEAT`` times what it has; the excess is
shared again by weight among the others (a water level, found in closed form over the sources). The mix is a
sequence of block slots cut into output shards of ``shard_slots``: every source owns as many slots as its
target needs, and a pseudorandom permutation of all slots deals them out, so the source counts of each shard
are a multinomial draw, conditioned on the totals so that no source misses its target by chance. A source's
k-th slot maps through that source's own pseudorandom permutation of block numbers (a new one for every pass
over the source), and blocks are joined by (source, block number). No pass takes a block twice, hence no
document is taken more than ``MAX_REPEAT`` times; the last slot of a source is trimmed to the target's word.

Permutations are swap-or-not shuffles: exact bijections of [0, n) for any n, computed per row from hashes, so
reruns and retried tasks agree and nothing is sorted. Positions inside a source come from prefix sums over
hash lanes of a few ``sqrt(rows)`` documents each, so a source with a third of all rows is no larger a task
than any other. Only ids and counts are shuffled, except in ``mixed_documents``, which returns texts.

Defined results: null or blank texts have size 0 and are never taken; the null source is a source of its own,
last in order; repeated rows are separate documents; an empty table gives no rows; further columns are kept
by ``mixed_documents`` (internal names start with ``_mix``) and ignored by ``mix_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlit.llm.common import WORD_CLASS, add_missing, stash, table, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BLOCK_WORDS = 256
SHARD_SLOTS = 4096
ROUNDS = 20
SEED = 20_240_607
PAGE = 1024  # slots generated per row of the slot pages
PAGES_PER_TASK = 32


def permuted(x: str, n: str, seed: str) -> str:
    """SQL text of a swap-or-not permutation of [0, n) applied to ``x``, keyed by ``seed``."""
    size = f"greatest({n}, 1L)"
    partner = f"pmod(pmod(xxhash64({seed}, r), {size}) - v, {size})"
    return (f"aggregate(sequence(1, {ROUNDS}), cast({x} as bigint), (v, r) -> "
            f"if((xxhash64({seed}, -r, greatest(v, {partner})) & 1L) = 1L, {partner}, v))")


def source_targets(sized: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source: source, sid (rank by code point, null last), source_rows, source_size, target."""
    total = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sized.groupBy("source").agg(F.count("*").alias("source_rows"), F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(by_name) - 1)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("sid"), F.lit(len(weights))))
    s = (s.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(max_repeat))
         .withColumn("ratio", F.col("limit") / F.col("weight")))
    # sources in the order in which a rising level meets their limits
    earlier = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.sum("source_size").over(total) - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0)))
                     / (F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))))
    free = F.col("level") <= F.col("ratio")
    water = F.min_by("level", F.when(free, F.struct("ratio", "sid"))).over(total)
    return s.select("source", "sid", "source_rows", "source_size",
                    F.least(F.col("limit"), water * F.col("weight")).alias("target"))


def slot_plan(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per source: full blocks, words of the short block, complete passes, and what the last pass takes."""
    L = block_words
    size = "greatest(source_size, 1L)"
    return (sources
            .withColumn("want", F.expr("cast(round(target) as bigint)"))
            .withColumn("n_full", F.expr(f"source_size div {L}")).withColumn("short", F.expr(f"source_size % {L}"))
            .withColumn("n_blocks", F.expr("n_full + if(short > 0, 1, 0)"))
            .withColumn("passes", F.expr(f"if(source_size = 0, 0L, want div {size})"))
            .withColumn("rest", F.expr("if(source_size = 0, 0L, want - passes * source_size)"))
            .withColumn("q", F.expr(f"least(rest div {L}, n_full)"))
            .withColumn("tail", F.expr(f"rest - q * {L}"))
            .withColumn("slots", F.expr("passes * n_blocks + q + if(tail > 0, 1, 0)"))
            .withColumn("slot_base", F.coalesce(F.sum("slots").over(
                Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("all_slots", F.sum("slots").over(Window.partitionBy())))


def draw_slots(plan: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS,
               seed: int = SEED) -> DataFrame:
    """Every slot of the mix: shard, slot (place in the shard), sid, pass, block and words (taken from the
    front of the block). Slots are generated by pages, so a hot source spreads over all tasks."""
    L = block_words
    pages = plan.filter("slots > 0").select("*", F.explode(F.expr(f"sequence(0L, (slots - 1) div {PAGE})")).alias("page"))
    total = plan.agg(F.sum("slots")).first()[0] or 0
    slots = (pages.repartition(max(1, -(-total // (PAGES_PER_TASK * PAGE))), "sid", "page")
             .select("*", F.explode(F.expr(f"sequence(page * {PAGE}, least(page * {PAGE} + {PAGE - 1}, slots - 1))")).alias("k"))
             .withColumn("pass", F.expr("least(k div greatest(n_blocks, 1L), passes)"))
             .withColumn("i", F.expr("k - pass * n_blocks"))
             .withColumn("domain", F.expr("if(pass < passes, n_blocks, n_full)"))
             .withColumn("last", F.expr("pass = passes and i = q")))
    key = f"{seed}L, sid, pass"
    block = F.expr(f"if(pass = passes and i >= n_full, n_full, {permuted('i', 'domain', key)})")
    place = F.expr(permuted("slot_base + k", "all_slots", f"{seed}L"))
    return (slots.withColumn("block", block).withColumn("place", place)
            .withColumn("words", F.expr(f"if(last, tail, if(block = n_full, short, {L}L))"))
            .select(F.expr(f"place div {shard_slots}").alias("shard"), F.expr(f"place % {shard_slots}").alias("slot"),
                    "sid", "pass", "passes", "block", "words"))


def shard_draws(slots: DataFrame) -> DataFrame:
    """Slots that each source got in each output shard."""
    return slots.groupBy("shard", "sid").agg(F.count("*").alias("slots"))


def pack(sized: DataFrame, plan: DataFrame, order: list[str]) -> DataFrame:
    """Place of every document inside its source's word sequence: adds sid, source_size, target, start."""
    # sources are few beside documents; AQE picks the join, and splits it if one source is hot
    s = sized.join(plan.select(F.col("source").alias("_src"), "sid", "source_rows", "source_size", "target", "passes"),
                   F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    total = sized.count()
    room = max(1024, 8 * math.isqrt(total))
    s = s.withColumn("lane", F.expr(f"pmod(xxhash64({', '.join(order)}), ceil(source_rows / {room}))"))
    lanes = s.groupBy("sid", "lane").agg(F.sum("size").alias("lane_size"))
    ahead = Window.partitionBy("sid").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.select("sid", "lane", F.coalesce(F.sum("lane_size").over(ahead), F.lit(0)).alias("lane_start"))
    inside = Window.partitionBy("sid", "lane").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return s.join(lanes, ["sid", "lane"]).withColumn(
        "start", F.col("lane_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))).drop("lane", "lane_start")


def doc_blocks(packed: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents joined to the taken blocks that they overlap: lo and hi (words of the document inside the
    block), at (the block's first word, relative to the document), takes (whole takes) and part (words taken
    from the block's front by the trimmed slot), each also for the last, partial pass alone."""
    L = block_words
    taken = slots.groupBy("sid", "block").agg(
        F.sum(F.expr("if(pass < passes, 1, 0)")).alias("takes"),
        F.max(F.expr("if(pass = passes, words, 0)")).alias("part"))
    pieces = packed.filter("size > 0").select(
        "*", F.explode(F.expr(f"sequence(start div {L}, (start + size - 1) div {L})")).alias("block"))
    # generated rows have no size estimate that could be trusted: never broadcast
    return (pieces.join(taken.hint("merge"), ["sid", "block"])
            .withColumn("at", F.expr(f"block * {L} - start"))
            .withColumn("lo", F.expr("greatest(at, 0L)")).withColumn("hi", F.expr(f"least(at + {L}, size)"))
            .withColumn("part_hi", F.expr("least(at + part, size)")))


def _sized(docs: DataFrame, extra: list[str]) -> DataFrame:
    docs = add_missing(docs, doc_id="bigint", text="string", source="string")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
                       F.xxhash64("text").alias("text_hash"), *extra)


def mix_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS,
                  seed: int = SEED, weights=WEIGHTS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and taken (words that the mix takes)."""
    sized = stash(_sized(docs, []), "mix-sizes")
    plan = stash(slot_plan(source_targets(sized, weights), block_words), "mix-plan")
    packed = stash(pack(sized, plan, ["doc_id", "text_hash", "size"]), "mix-packed")
    pieces = doc_blocks(packed, draw_slots(plan, block_words, shard_slots, seed), block_words)
    words = F.expr("takes * (hi - lo) + greatest(part_hi - lo, 0L)")
    # (sid, start) names a document with words: ranges in a source don't overlap
    got = pieces.groupBy("sid", "start").agg(F.sum(words).alias("taken")).select(
        F.col("sid").alias("_sid"), F.col("start").alias("_start"), "taken")
    return packed.join(got, (F.col("sid") == F.col("_sid")) & (F.col("start") == F.col("_start"))
                       & (F.col("size") > 0), "left").select(
        "doc_id", "source", "size", "source_size", "target",
        F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS,
                    seed: int = SEED, weights=WEIGHTS) -> DataFrame:
    """The mix as documents, in the input's columns: a row per document and pass over its source. Complete
    passes carry the text as it is, the last pass the words of the blocks it takes (joined by a space, with
    ``n_chars`` to match); documents that the mix doesn't take are gone."""
    columns = docs.columns
    rows = stash(add_missing(docs, doc_id="bigint", text="string", source="string", n_chars="bigint")
                 .withColumn("_mix_row", F.monotonically_increasing_id()), "mix-rows")
    sized = stash(_sized(rows, ["_mix_row"]), "mix-sizes")
    plan = stash(slot_plan(source_targets(sized, weights), block_words), "mix-plan")
    packed = stash(pack(sized, plan, ["doc_id", "text_hash", "size", "_mix_row"]), "mix-packed")
    pieces = doc_blocks(packed, draw_slots(plan, block_words, shard_slots, seed), block_words)
    last = pieces.filter("part_hi > lo").groupBy("_mix_row").agg(
        F.array_sort(F.collect_list(F.struct("lo", "part_hi"))).alias("_mix_parts"))
    takes = (packed.filter("size > 0").select("_mix_row", F.col("passes").alias("_mix_passes"), F.col("size").alias("_mix_size"))
             .join(last, "_mix_row", "left").filter("_mix_passes > 0 or _mix_parts is not null"))
    whole = "aggregate(_mix_parts, 0L, (a, p) -> a + p.part_hi - p.lo) = _mix_size"
    words = f"regexp_extract_all(text, r'{WORD_CLASS}', 0)"
    cut = (f"if({whole}, text, array_join(flatten(transform(_mix_parts, p -> "
           f"slice({words}, cast(p.lo + 1 as int), cast(p.part_hi - p.lo as int)))), ' '))")
    copies = ("if(_mix_passes > 0, transform(sequence(1L, _mix_passes), x -> x), array())")
    out = (rows.join(takes, "_mix_row")
           .withColumn("_mix_pass", F.explode(F.expr(
               f"concat(cast({copies} as array<bigint>), if(_mix_parts is null, cast(array() as array<bigint>), array(0L)))")))
           .withColumn("_mix_text", F.expr(f"if(_mix_pass = 0, {cut}, text)"))
           .withColumn("n_chars", F.expr("if(_mix_pass = 0, cast(char_length(_mix_text) as bigint), n_chars)"))
           .withColumn("text", F.col("_mix_text")))
    return out.select(*columns)


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))
