"""Personal data in whole texts: patterns propose spans, checksums confirm them, nearby words move their score.

Of every kind a regular expression proposes the leftmost non-overlapping spans; a validator decides on each (octets of
an address, Luhn for cards, mod-97 for account numbers, digit counts, reserved ranges), without retries inside a span
that fails. What stays has its kind's score, raised by words that go with the kind within ``BEFORE`` code points before
or ``AFTER`` after, lowered by words that speak against it. The four base kinds are always reported; the further ones
only from ``LEAST_SCORE`` on, and not where they overlap a base span.

Everything is DataFrame expressions. Positions: a text split at a pattern gives the gaps between its matches, so a
running sum of gap and match lengths over a document's matches gives their code point positions. Matches are exploded,
dealt out by row and summed by a window that spills, so a text with millions of matches costs no quadratic array work;
texts themselves stay where they were read. Patterns of the base kinds are written so that they never scan a run of
characters twice and need no stack, which keeps long runs linear.

Defined results: a null text is empty; texts without matches have counts 0 and the digest of nothing; very long texts
are scanned whole; a null id is reported like others; repeated rows are reported each; of spans that start together the
kind listed first comes first; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlit.llm.common import add_missing, table

BEFORE, AFTER = 40, 20
LEAST_SCORE = 0.5
CONTEXT = 0.3  # what a word for the kind adds to the score, and one against it takes


@dataclass(frozen=True)
class Kind:
    """stated: the pattern as plainly as it can be said; scanned: one that matches the same spans in linear time and
    without recursion. valid: SQL over ``value`` and its neighbours ``before`` and ``after``. hint: a substring
    without which a text has no match."""

    name: str
    stated: str
    valid: str
    score: float
    words_for: str
    words_against: str = "example|sample|dummy"
    base: bool = False
    hint: str = ""
    scanned: str = ""


_DIGITS = "regexp_replace(value, '[^0-9]', '')"
# from the right, every second digit doubled, its digits summed
_LUHN = (f"aggregate(transform(split(reverse({_DIGITS}), ''), (c, i) -> int(c) * (1 + i % 2) - if(i % 2 = 1 and int(c) > 4, 9, 0)), "
         "0, (a, x) -> a + x) % 10 = 0")
_COMPACT = "regexp_replace(value, ' ', '')"
# letters count 10 to 35, the first four characters go last
_MOD_97 = (f"aggregate(split(concat(substring({_COMPACT}, 5), substring({_COMPACT}, 1, 4)), ''), 0L, "
           "(a, c) -> if(c between '0' and '9', (a * 10 + int(c)) % 97, (a * 100 + ascii(c) - 55) % 97)) = 1")
_OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
_ALONE = "not before rlike '[A-Za-z0-9]$' and not after rlike '^[A-Za-z0-9]'"
_NO_DIGIT = "not before rlike '[0-9+-]$' and not after rlike '^-?[0-9]'"

# Base kinds in the order in which they are listed, then the further ones. Patterns of the base kinds are fixed.
KINDS = [
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 0.9, "mail|contact|write", base=True, hint="@",
         scanned=r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    Kind("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", f"value rlike '^{_OCTET}([.]{_OCTET}){{3}}$'", 0.6,
         "ip|host|server|address|login", "version|release|section|chapter", base=True, hint=".",
         scanned=r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"),
    # whole chains of digits with single separators, of 12 to 19 digits: longer and shorter ones never pass
    Kind("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) between 12 and 19 and {_LUHN}", 0.7,
         "card|visa|master|amex|payment|credit|debit", "isbn|order|serial|tracking", base=True,
         scanned=r"[0-9](?<![0-9]{2})(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 9 and 15", 0.7, "phone|call|tel|mobile|fax", base=True, hint="+"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]{4}){2,7}( ?[A-Z0-9]{1,3})?",
         f"{_ALONE} and length({_COMPACT}) between 15 and 34 and {_MOD_97}", 0.8, "iban|account|bank|transfer"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
         f"{_NO_DIGIT} and not value rlike '^(000|666|9)|-00-|0000$'", 0.3, "ssn|social security|taxpayer", "order|part|serial", hint="-"),
    Kind("local_phone", r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
         _NO_DIGIT, 0.3, "phone|call|tel|mobile|fax", "order|isbn|serial"),
]
_BASE = sum(k.base for k in KINDS)


def _of_kind(expression: str) -> str:
    """SQL: the expression of the row's kind; ``expression`` names a field of Kind."""
    return "case kind " + " ".join(f"when {n} then ({getattr(k, expression)})" for n, k in enumerate(KINDS)) + " end"


def _hits(docs: DataFrame) -> DataFrame:
    """(row, doc_id, kind, n, gap, before, after, value): a row per match in text order, one of nulls for a text
    without any."""
    docs = add_missing(docs, doc_id="bigint", text="string").select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pieces, found = {}, {}
    for n, k in enumerate(KINDS):
        cut = F.split("text", k.scanned or k.stated, -1)
        pieces[f"p{n}"] = F.when(F.contains("text", F.lit(k.hint)), cut) if k.hint else cut
        found[f"m{n}"] = F.when(F.size(f"p{n}") > 1, F.regexp_extract_all("text", F.lit(k.scanned or k.stated), F.lit(0)))
    docs = docs.withColumns(pieces).withColumns(found)
    each = [F.expr(
        f"transform(arrays_zip(slice(p{n}, 1, size(m{n})), slice(p{n}, 2, size(m{n})), m{n}), (x, i) -> "
        f"struct({n} as kind, i as n, char_length(x.`0`) as gap, right(x.`0`, {BEFORE}) as before, left(x.`1`, {AFTER}) as after, x.m{n} as value))")
        for n in range(len(KINDS))]
    every = F.filter(F.array(*each), lambda a: a.isNotNull())
    return docs.select("row", "doc_id", F.explode_outer(F.flatten(every)).alias("h")).select("row", "doc_id", "h.*")


def _spans(docs: DataFrame) -> DataFrame:
    """(row, doc_id, kind, start, end, value, score), kept spans; a row of nulls for texts that had no match, and
    spans that fail have a null start."""
    hits = _hits(docs).repartition("row")  # all of the windows and the aggregate after them share this exchange
    own = Window.partitionBy("row", "kind").orderBy("n")
    end = F.sum(F.col("gap") + F.char_length("value")).over(own)
    spans = hits.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("value"))
    near = F.lower(F.concat_ws(" ", "before", "after"))
    move = F.expr(f"if(near rlike {_of_kind_text('words_for')}, {CONTEXT}D, 0D) - if(near rlike {_of_kind_text('words_against')}, {CONTEXT}D, 0D)")
    spans = spans.withColumn("near", near).withColumn("valid", F.expr(_of_kind("valid")))
    score = F.round(F.expr(_of_kind("score")).cast("double") + move, 3)
    spans = spans.withColumn("score", F.least(F.lit(1.0), score))
    # running frames in both directions: a frame that shrinks would be summed anew for every row
    along = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("valid") & (F.col("kind") < _BASE)
    before = F.max(F.when(fixed, F.col("end"))).over(along)
    after = F.min(F.when(fixed, F.col("start"))).over(back)
    apart = F.coalesce(before <= F.col("start"), F.lit(True)) & F.coalesce(after >= F.col("end"), F.lit(True))
    kept = F.col("valid") & ((F.col("kind") < _BASE) | ((F.col("score") >= LEAST_SCORE) & apart))
    return spans.withColumn("kept", kept).select("row", "doc_id", *[
        F.when(F.col("kept"), F.col(c)).alias(c) for c in ("kind", "start", "end", "value", "score")])


def _of_kind_text(name: str) -> str:
    return "case kind " + " ".join(f"when {n} then '{getattr(k, name)}'" for n, k in enumerate(KINDS)) + " end"


def find_private(docs: DataFrame) -> DataFrame:
    """One row per span: doc_id, kind, start, end (code points, end exclusive), value and score."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return _spans(docs).filter("kind is not null").select("doc_id", F.get(names, F.col("kind")).alias("kind"), "start", "end", "value", "score")


def private_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, number of spans of every base kind, digest of the base spans, all spans."""
    listed = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))))
    per = _spans(docs).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), listed.alias("s"),
        *[F.count_if(F.col("kind") == n).alias(f"n_{k.name}") for n, k in enumerate(KINDS)])
    names = "array(" + ", ".join(f"'{k.name}'" for k in KINDS) + ")"
    text = f"array_join(transform({{}}, x -> concat(get({names}, x.kind), ':', x.start, ':', x.end)), ',')"
    return per.select("doc_id", *[f"n_{k.name}" for k in KINDS if k.base],
                      F.sha2(F.expr(text.format(f"filter(s, x -> x.kind < {_BASE})")), 256).alias("base_sha256"),
                      F.expr(text.format("s")).alias("spans"), *[f"n_{k.name}" for k in KINDS if not k.base])


def op11_private_data(spark, sf_dir: str) -> DataFrame:
    return private_report(table(spark, sf_dir, "documents"))
