"""Personal data spans against a brute-force version by plain pattern matching."""

import hashlib
import re
from collections import Counter

import pytest
from llm_cases import DOCS, docs_frame

SF = "/root/testdata/sf0.001"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def base_spans(text):
    text = text or ""
    found = [(m.start(), n, m.end(), kind) for n, (kind, pattern) in enumerate(BASE.items())
             for m in re.finditer(pattern, text) if passes(kind, m.group())]
    return sorted(found)


def expected(doc_id, text):
    spans = base_spans(text)
    listed = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in spans)
    per = Counter(kind for *_, kind in spans)
    return (doc_id, *[per[k] for k in BASE], hashlib.sha256(listed.encode()).hexdigest()), listed


CASES = [
    "write a.b@c.de now", "a@b.c_d@e.f", "a@b", "a@b.", "x@y.z.", "@a.b", "é.a@b.c漢x@y.z😀q@w.e",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.2.3.4", "01.002.0003.255", "1.2.3.256", "0.0.0.0.0", "99999999999999999999.1.1.1", "x1.2.3.4y",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "4111  1111 1111 1111", "411111111111", "1" * 40, "0" * 12, "0" * 19, "0" * 20,
    "5 0 0 0 0 0 0 0 0 0 0 0 0", "12 4111111111111111", "+1 (017) 555-7713", "+1 2", "+123456789", "+1 234 567 89 and +49-(0)30.1234567", "+" * 30, "+1" + "-" * 50,
    "+12345678901234567890", "tel +1 (017) 555-7713 mail a@b.co from 10.0.0.1 card 4111 1111 1111 1111", "+1+2 345 678 90", "\n+1\n234567890",
    None, "", " \n\t",
]


def test_base_spans(spark, odd_rows):
    from starlit.llm.private_data import private_report
    rows = [(k, t, "en", "a") for k, t in enumerate(CASES)] + odd_rows
    got = private_report(docs_frame(spark, rows)).collect()
    want = Counter(expected(r[0], r[1])[0] for r in rows)
    assert Counter(tuple(r[:6]) for r in got) == want
    assert private_report(spark.createDataFrame([], DOCS)).count() == 0
    assert private_report(spark.createDataFrame([(1,)], "other long")).first()["n_email"] == 0


def test_long_runs_are_scanned_once(spark):
    """Runs without a match, and texts with very many matches, of a million characters and more."""
    from starlit.llm.private_data import private_report
    texts = ["a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "1 " * 1_000_000, "+1" + " " * 1_000_000, "a@" * 500_000, "a.b" * 500_000 + "@",
             "a@b.c " * 100_000, "x@" + "y." * 500_000 + "z", "10.0.0.1," * 100_000, "A1" * 1_000_000, "AB12" + " ABCD" * 200_000]
    got = {r["doc_id"]: r for r in private_report(docs_frame(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])).collect()}
    for k in (3, 4, 5, 7, 9, 11):  # elsewhere the plain pattern itself takes quadratic time
        assert tuple(got[k][:6]) == expected(k, texts[k])[0], k
    assert all(got[k]["spans"] == "" for k in (0, 1, 6, 10)) and got[2]["n_ip"] == 250_000 and got[8]["n_email"] == 1


def test_whole_table(spark):
    from starlit.llm.queries import QUERIES
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_private_data"](spark, SF).collect()
    assert Counter(tuple(r[:6]) for r in got) == Counter(expected(*r)[0] for r in docs)
    listed = {r["doc_id"]: set(r["spans"].split(",")) for r in got}
    assert all(set(filter(None, expected(*r)[1].split(","))) <= listed[r[0]] for r in docs)


IBAN = "DE89 3704 0044 0532 0130 00"


@pytest.mark.parametrize("text,kinds", [
    (f"transfer to account {IBAN} today", ["iban"]), (f"code {IBAN.replace('89', '88')} today", []), ("GB82WEST12345698765432", ["iban"]),
    (f"example {IBAN}", ["iban"]), (f"X{IBAN}", []), (f"sample: {IBAN} for an order", ["iban"]),
    ("my ssn is 123-45-6789", ["ssn"]), ("part 123-45-6789 of it", []), ("ssn 000-45-6789", []), ("ssn 123-45-67890", []), ("SSN order 123-45-6789", []),
    ("call (555) 123-4567 now", ["local_phone"]), ("see 555 123 4567 there", []), ("call +1 (017) 555-7713", ["phone"]),
    ("iban " + IBAN + " tel +49 30 1234567", ["iban", "phone"]), (f"bank {IBAN} and again {IBAN}", ["iban", "iban"]),
])
def test_checked_kinds_and_nearby_words(spark, text, kinds):
    from starlit.llm.private_data import find_private
    got = find_private(docs_frame(spark, [(1, text, "en", "a")])).orderBy("start").collect()
    assert [r["kind"] for r in got] == kinds
    assert all(text[r["start"]:r["end"]] == r["value"] and 0 < r["score"] <= 1 for r in got)


def test_scores_move_with_context(spark):
    from starlit.llm.private_data import find_private
    texts = ["host 10.0.0.1", "it was 10.0.0.1", "version 10.0.0.1"]
    got = {r["doc_id"]: r["score"] for r in find_private(docs_frame(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])).collect()}
    assert got[0] > got[1] > got[2] > 0  # base spans stay, whatever the words say
