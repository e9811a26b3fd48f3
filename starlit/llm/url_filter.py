"""URL filter: all glob rules simulated at once over every canonical URL.

A rule is a glob over the canonical form ``.host/path`` (host lower-cased, preceded by a dot so that a domain
and its subdomains end alike): ``?`` is any one byte, ``*`` any run of bytes inside the host, ``**`` any run,
everything else itself. All rules are packed into one Shift-And bit set of as many 64-bit words as they need:
bit k says that the first k pattern bytes match the input so far. Reading a byte shifts the whole set by one
(carrying from word to word), keeps the bits whose pattern byte accepts it, and keeps bits that stand at a
star that accepts it. The work a byte costs is the number of words, whatever the rules look like, and the
bit sets of a whole Arrow batch of URLs advance together in numpy.

Of the rules that match, the one with the longest (host, path) decides; where only the general globs match,
the first of them does, and where nothing matches the URL is allowed.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule and verdict allow;
the order and number of rows, repeated ones included, are kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlit.llm.common import UPPER, add_missing, table

# Fixed rules of the contract: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# The method's own globs for URLs that no rule fits.
GLOBS = (
    ("block", ".*spam*/**"),
    ("block", ".*casino*/**"),
    ("block", "**/wp-login.php**"),
)


class GlobAutomaton:
    """Multiword Shift-And automaton of many globs. ``match`` returns a (strings, globs) boolean array."""

    def __init__(self, globs: list[str]):
        accept = np.zeros((256, 0), dtype=bool)  # per input byte: pattern positions that accept it
        stay = np.zeros((256, 0), dtype=bool)    # per input byte: states (bytes matched so far) that may wait
        host = np.ones(256, dtype=bool)
        host[ord("/")] = False
        first, final = [], []
        columns_accept, columns_stay, at = [], [], 0
        for glob in globs:
            data, i = glob.encode(), 0
            first.append(at)  # the state "nothing matched yet"
            columns_accept.append(np.zeros(256, dtype=bool))
            columns_stay.append(np.zeros(256, dtype=bool))
            while i < len(data):
                if data[i:i + 2] == b"**":
                    columns_stay[-1] = np.ones(256, dtype=bool)
                    i += 2
                    continue
                if data[i:i + 1] == b"*":
                    columns_stay[-1] = columns_stay[-1] | host
                    i += 1
                    continue
                byte = np.ones(256, dtype=bool) if data[i:i + 1] == b"?" else np.arange(256) == data[i]
                columns_accept.append(byte)
                columns_stay.append(np.zeros(256, dtype=bool))
                i += 1
            at = len(columns_accept)
            final.append(at - 1)
        self.words = max(1, -(-at // 64))
        accept = np.stack(columns_accept, 1) if columns_accept else accept
        stay = np.stack(columns_stay, 1) if columns_stay else stay
        self.accept, self.stay = self._packed(accept), self._packed(stay)
        start = np.zeros((1, at), dtype=bool)
        start[0, first] = True
        self.start = self._packed(start)[0]
        self.final = final

    def _packed(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros((bits.shape[0], self.words * 64), dtype=np.uint8)
        out[:, :bits.shape[1]] = bits
        return np.packbits(out, axis=1, bitorder="little").view("<u8").astype(np.uint64)

    def match(self, strings: list[bytes]) -> np.ndarray:
        n = len(strings)
        if not n:
            return np.zeros((0, len(self.final)), dtype=bool)
        lengths = np.fromiter((len(s) for s in strings), dtype=np.int64, count=n)
        order = np.argsort(-lengths, kind="stable")  # strings that have ended stand at the back
        lengths = lengths[order]
        data = np.frombuffer(b"".join(strings[k] for k in order), dtype=np.uint8)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        state = np.tile(self.start, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        live = n
        for step in range(int(lengths[0])):
            live = int(np.searchsorted(-lengths, -step, side="left")) if lengths[live - 1] <= step else live
            byte = data[starts[:live] + step]
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.accept[byte]) | (now & self.stay[byte])
        hit = np.empty((n, len(self.final)), dtype=bool)
        for k, bit in enumerate(self.final):
            hit[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one != 0
        return hit


def rule_glob(host: str, path: str) -> str:
    """The glob of a (host, path) rule over ``.host/path``: the host, subdomains, and what follows the path."""
    return f"*.{host}{path}**"


def judge_urls(pages: DataFrame, rules=RULES, globs=GLOBS) -> DataFrame:
    """One row per page: page_id, host, path, rule (the fitting rule's host and path, else null), verdict."""
    pages = add_missing(pages, page_id="bigint", url="string")
    rest = F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)
    url = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^([^/?#]*)", 1), UPPER, UPPER.lower())
    path = F.regexp_extract(url, r"(?s)^[^/?#]*([^?#]*)", 1)
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))

    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    names = np.array([h + p for _, h, p in ranked] + [None] * (len(globs) + 1), dtype=object)
    verdicts = np.array([v for v, _, _ in ranked] + [v for v, _ in globs] + ["allow"], dtype=object)
    automaton = GlobAutomaton([rule_glob(h, p) for _, h, p in ranked] + [g for _, g in globs])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            urls = [f".{h}{p}".encode() for h, p in zip(batch["host"], batch["path"])]
            hit = automaton.match(urls)
            hit = np.concatenate([hit, np.ones((len(urls), 1), dtype=bool)], axis=1)
            best = hit.argmax(axis=1)
            yield batch.assign(rule=names[best], verdict=verdicts[best])

    return parts.mapInPandas(judge, "page_id bigint, host string, path string, rule string, verdict string")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


# DuckDB statement of the same rules, for the registered query.
OP5_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN ''
                                ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
     p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
     r AS (SELECT *, CASE
             WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
             WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
             WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
             WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
             WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN path LIKE '/%' AND (contains(host, 'spam') OR contains(host, 'casino')) THEN 'block'
            WHEN contains(path, '/wp-login.php') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
