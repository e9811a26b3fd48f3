"""Each operator against a brute-force version, on odd rows and on the small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_cases import DOCS, components, docs_frame, lower

SF = "/root/testdata/sf0.001"
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1 exact dedup

def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def dedup_expected(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0))
    return Counter((i, min(groups[norm(t)])[2], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest())
                   for i, t, *_ in rows)


def test_exact_dedup(spark, odd_rows):
    from starlit.llm.exact_dedup import deduplicate
    got = deduplicate(docs_frame(spark, odd_rows)).select("doc_id", "keep_id", "group_size", "text_sha256", "kept").collect()
    expected = dedup_expected(odd_rows)
    fixed = Counter((r[0], r[1] or 0, r[2], r[3]) for r in got)
    assert fixed == Counter({(i, k, n, h): c for (i, k, n, h), c in expected.items()})
    assert deduplicate(empty(spark)).count() == 0


def test_exact_dedup_checks_bytes_when_digests_collide(spark, odd_rows):
    from starlit.llm.exact_dedup import deduplicate, normalised
    weak = lambda text: F.substring(F.sha2(normalised(text), 256), 1, 1)
    rows = [r for r in odd_rows if r[0] is not None]
    got = Counter((r[0], r[1], r[2]) for r in deduplicate(docs_frame(spark, rows), digest=weak).select("doc_id", "keep_id", "group_size").collect())
    assert got == Counter(key[:3] for key in dedup_expected(rows).elements())


def test_exact_dedup_state_lives_on(spark, tmp_path):
    from starlit.llm.exact_dedup import deduplicate
    first = docs_frame(spark, [(1, "a b", "en", "s"), (2, "c", "en", "s")])
    second = docs_frame(spark, [(3, "ab", "en", "s"), (4, "d", "en", "s"), (5, "c  ", "en", "s")])
    deduplicate(first, state_dir=str(tmp_path)).count()
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in
           deduplicate(second, state_dir=str(tmp_path), corpus=first.union(second), files_per_batch=1).collect()}
    assert got == {3: (1, 2, False), 4: (4, 1, True), 5: (5, 2, True)}


# 2 decontamination

def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def contamination(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = bench_words(t)
        if w:
            for k in range(max(1, len(w) - 9)):
                windows[tuple(w[k:k + 10])].add("" if i is None else str(i))
    out = Counter()
    for i, t, *_ in rows:
        w, hit, ids = bench_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids |= windows[tuple(w[k:k + n])]
        out[(i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))] += 1
    return out


def test_decontamination(spark, odd_rows):
    from starlit.llm.decontaminate import drop_contaminated, find_contamination
    item = " ".join(f"q{k}" for k in range(14))
    rows = odd_rows + [(20, f"before {item} after {item}", "en", "a"), (21, item.upper().replace(" ", "--"), "en", "b"),
                       (22, " ".join(item.split()[:9]), "en", "a"), (23, "x Short-Item y short item", "en", "a"), (24, "q1 " * 40, "en", "a")]
    items = [(1, item), (2, item + " more"), (3, "short item"), (4, "漢字"), (5, None), (6, "..."), (None, "texts here"), (7, item)]
    frame, bench = docs_frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    assert Counter(rows_of(find_contamination(frame, bench))) == contamination(rows, items)
    clean = [r for r in rows if not next(iter(contamination([r], items)))[5]]
    left = drop_contaminated(frame, bench)
    assert left.columns == frame.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(r[0] for r in clean)
    assert find_contamination(empty(spark), bench).count() == 0
    assert drop_contaminated(frame, bench.limit(0)).count() == len(rows)


# 3 mixing

def targets(sizes, weights=(5, 2, 1)):
    """Sizes in source order; the contract's rounds of capping and resharing."""
    weight = {k: weights[k % len(weights)] for k in range(len(sizes))}
    out, left, open_ = {}, float(sum(sizes)), set(weight)
    while open_:
        unit = left / sum(weight[k] for k in open_)
        over = {k for k in open_ if unit * weight[k] > 3 * sizes[k]}
        if not over:
            return [out.get(k, unit * weight[k]) for k in range(len(sizes))]
        for k in over:
            out[k] = 3.0 * sizes[k]
            left -= out[k]
        open_ -= over
    return [out[k] for k in range(len(sizes))]


@pytest.mark.parametrize("block", [4, 256])
def test_mixing(spark, odd_rows, block):
    from starlit.llm.mixing import mix_documents, mixed_documents
    rows = odd_rows + [(100 + k, f"tok{k} " * (k % 50), "en", "small" if k % 9 else "zz") for k in range(200)]
    frame = docs_frame(spark, rows)
    got = mix_documents(frame, block_words=block).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(SPACE_WORD, t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, targets([sizes[s] for s in order])))
    taken = defaultdict(int)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(re.findall(SPACE_WORD, t or ""))) for i, t, *_ in rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], abs_tol=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in order:
        assert abs(taken[s] - want[s]) <= 0.51
    assert Counter(map(tuple, got)) == Counter(rows_of(mix_documents(frame, block_words=block)))
    mixed = mixed_documents(frame, block_words=block)
    assert mixed.columns == frame.columns
    by_doc = Counter()
    for r in mixed.collect():
        by_doc[r["doc_id"]] += len(re.findall(SPACE_WORD, r["text"]))
    expected = Counter()
    for r in got:
        expected[r["doc_id"]] += r["taken"]
    assert sum(by_doc.values()) == sum(expected.values())
    assert {k: v for k, v in by_doc.items() if k not in (12, 13)} == {k: v for k, v in expected.items() if v and k not in (12, 13)}


def test_permutation_is_one(spark):
    from starlit.llm.mixing import permuted
    for n in (1, 2, 7, 64, 1000):
        got = [r[0] for r in spark.range(n).select(F.expr(permuted("id", f"{n}L", "5L"))).collect()]
        assert sorted(got) == list(range(n)) and (n < 64 or got != list(range(n)))


def test_shard_draws_follow_targets(spark):
    from starlit.llm.mixing import _sized, draw_slots, shard_draws, slot_plan, source_targets, word_count
    plan = slot_plan(source_targets(_sized(small(spark), [])), 16)
    draws = shard_draws(draw_slots(plan, 16, shard_slots=500)).groupBy("shard").agg(F.sum("slots").alias("n")).orderBy("shard").collect()
    assert all(r["n"] == 500 for r in draws[:-1]) and 0 < draws[-1]["n"] <= 500


def test_mixing_empty(spark):
    from starlit.llm.mixing import mix_documents, mixed_documents
    assert mix_documents(empty(spark)).count() == 0 and mixed_documents(empty(spark)).count() == 0


# 4 token files

def test_token_files(spark, odd_rows, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer
    from starlit.llm.token_files import lookup_documents, read_token_files, token_digest, write_token_files
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = odd_rows + [(200, "a<|endoftext|>b <|EndOfText|> don't!'s İSTANBUL ΣΑΣ é x²ª½ ３ a\x1cb\xa0c ﬁ", "en", "a")]
    write_token_files(docs_frame(spark, rows), str(tmp_path / "t"), path)
    ids = lambda t: tok.encode(t or "", add_special_tokens=False).ids + [1]
    stored = read_token_files(spark, str(tmp_path / "t")).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in stored) == Counter((i, tuple(ids(t))) for i, t, *_ in rows)
    digest = sorted(rows_of(token_digest(spark, str(tmp_path / "t"))), key=lambda r: r[1])
    assert [r[0] for r in digest] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    at, of = 0, {(i, zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t, *_ in rows}
    for i, start, n, crc in digest:
        assert start == at and (i, crc) in of
        at += n
    assert {r["doc_id"] for r in lookup_documents(spark, str(tmp_path / "t"), [10, 200]).collect()} == {10, 200}
    write_token_files(empty(spark), str(tmp_path / "e"), path)
    assert token_digest(spark, str(tmp_path / "e")).count() == 0


# 5 URL filter

def test_url_filter(spark):
    from starlit.llm.url_filter import RULES, GlobAutomaton, judge_urls
    urls = [None, "", "no scheme", "http://", "http://org/", "http://org", "https://A.Example.ORG/es/x?y", "http://example.org/en/1#z",
            "http://xexample.org/es/", "http://example.org/es", "http://u@host.com:80/fr/", "ftp://x.com/de/?q=://", "http://a.com/x.org/",
            "http://spam-farm.net/a", "http://x.net/wp-login.php", "http://x.net/a?wp-login.php", "http://é.com/fr/é", "http://h.net/" + "a" * 5000,
            "http://org.net/", "x://y://z.org/", "http:///org/"]
    rows = [(k, u, "html") for k, u in enumerate(urls)] * 2
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    for r in got:
        u = urls[r["page_id"]]
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        fit = [(len(h + p), h + p, v) for v, h, p in RULES
               if (lower(host) == h or lower(host).endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"]) == (lower(host), path)
        assert r["rule"] == (max(fit)[1] if fit else None)
        if fit:
            assert r["verdict"] == max(fit)[2]
        else:
            assert r["verdict"] == ("block" if "spam" in host or path.startswith("/wp-login") else "allow")
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    # many globs: more than one machine word, against a plain matcher
    globs = [f"*.d{k}?.com/**x{k}*" for k in range(40)]
    texts = [f".{a}.d{k}{b}.com/{c}x{j}{d}" for k in range(0, 40, 3) for j in (k, 1) for a in ("", "s.t") for b in ("", "q", "/") for c in ("", "u/") for d in ("", "/", "z")]

    def plain(glob):
        return re.compile("".join(".*" if p == "**" else "[^/]*" if p == "*" else "." if p == "?" else re.escape(p)
                                  for p in re.split(r"(\*\*|\*|\?)", glob)) + r"\Z", re.S)
    hit = GlobAutomaton(globs).match([t.encode() for t in texts])
    assert hit.tolist() == [[bool(plain(g).match(t)) for g in globs] for t in texts] and hit.any()


# 6 quality, 8 toxicity: held-out accuracy

def held_out_accuracy(spark, scored, column):
    labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    both = scored.join(labels, "doc_id").filter("held_out")
    return both.agg(F.avg((F.col("predicted") == F.col(column)).cast("int"))).first()[0], both.count()


def test_quality(spark, odd_rows):
    from starlit.llm.quality import fit_pairwise, keep_quality, score_quality, train_quality
    big = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = train_quality(docs, labels)
    accuracy, n = held_out_accuracy(spark, score_quality(docs, model), "quality")
    assert accuracy >= 0.95 and n > 80
    odd = score_quality(docs_frame(spark, odd_rows), model).collect()
    assert Counter(r["doc_id"] for r in odd) == Counter(r[0] for r in odd_rows) and all(0 <= r["score"] <= 1 for r in odd)
    kept = keep_quality(docs_frame(spark, odd_rows), model)
    assert kept.columns == docs_frame(spark, odd_rows).columns and kept.count() == sum(r["predicted"] for r in odd)
    none = train_quality(docs, labels.limit(0))
    assert {r["score"] for r in score_quality(docs_frame(spark, odd_rows), none).collect()} == {0.5}
    assert score_quality(empty(spark), model).count() == 0
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    good = x[:, 1] - x[:, 3] > 0.5
    m = fit_pairwise(x[good], x[~good], float((~good).mean()))
    assert ((m.score(x) >= 0.5) == good).mean() > 0.97


def test_toxicity(spark, odd_rows):
    from starlit.llm.toxicity import score_toxicity, train_toxicity
    big = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    model = train_toxicity(docs, labels)
    accuracy, n = held_out_accuracy(spark, score_toxicity(docs, model), "toxic")
    assert accuracy >= 0.9 and n > 40
    odd = score_toxicity(docs_frame(spark, odd_rows), model).collect()
    assert Counter(r["doc_id"] for r in odd) == Counter(r[0] for r in odd_rows) and all(0 <= r["score"] <= 1 for r in odd)
    none = train_toxicity(docs, labels.limit(0))
    assert all(r["score"] < 1e-100 for r in score_toxicity(docs_frame(spark, odd_rows), none).collect())
    assert score_toxicity(empty(spark), model).count() == 0
    words = model.worst(b"plain words only here and there"), model.worst(b"you utter idiot and moron"), model.worst(b"you utter idiiot and moronn")
    assert words[1] > words[0] and words[2] > words[0]


# 7 sharding

def test_hilbert_neighbours():
    from starlit.llm.hilbert import curve_tables
    for n, bits in ((2, 4), (3, 3)):
        digit, nxt = curve_tables(n)
        points = {}
        for p in np.ndindex(*[1 << bits] * n):
            h = s = 0
            for b in range(bits - 1, -1, -1):
                at = (s << n) + sum(((c >> b) & 1) << (n - 1 - k) for k, c in enumerate(p))
                h, s = (h << n) + digit[at], nxt[at]
            points[h] = p
        assert sorted(points) == list(range((1 << bits) ** n))
        assert all(sum(abs(a - b) for a, b in zip(points[k], points[k + 1])) == 1 for k in range(len(points) - 1))


def test_shards(spark, odd_rows, tmp_path):
    from starlit.llm.hilbert import assign_shards, write_shards
    for frame, n in ((docs_frame(spark, odd_rows), len(odd_rows)), (small(spark), 200)):
        got = assign_shards(frame).collect()
        assert sorted(r["position"] for r in got) == list(range(n))
        counts = Counter(r["shard"] for r in got)
        assert max(counts.values()) - min(counts.get(k, 0) for k in range(8)) <= 1
        for k in counts:
            assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(counts[k]))
        by_place = sorted(got, key=lambda r: r["position"])
        assert [r["cell"] for r in by_place] == sorted(r["cell"] for r in got) and [r["shard"] for r in by_place] == sorted(r["shard"] for r in got)
    of = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows)
    got = assign_shards(docs_frame(spark, odd_rows)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == of
    write_shards(docs_frame(spark, odd_rows), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(odd_rows)
    assert assign_shards(empty(spark)).count() == 0


# 9 near duplicates

def shingles(t):
    w = re.findall(SPACE_WORD, lower(t))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def similar(sets):
    where, links = defaultdict(list), []
    for i, s in sets.items():
        met = Counter(j for g in s for j in where[g])
        links += [(i, j) for j, k in met.items() if 100 * k >= 75 * (len(s) + len(sets[j]) - k)]
        for g in s:
            where[g].append(i)
    return links


def test_near_duplicates_small_table(spark):
    from starlit.llm.near_dedup import keep_one, near_duplicates
    docs = small(spark)
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    comp = components(sets, similar(sets))
    got = near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}
    assert {r["doc_id"] for r in keep_one(docs).collect()} == {i for i in sets if comp[i] == i}


def test_near_duplicates_chains_and_odd_rows(spark, odd_rows):
    from starlit.llm.near_dedup import keep_one, near_duplicates
    rng = np.random.default_rng(3)
    rows = [r for r in odd_rows if r[0] is not None and r[0] not in (12, 13)]
    base = [f"t{k}" for k in range(120)]
    for k in range(90):  # a drifting chain: neighbours are similar, the ends are not
        base[int(rng.integers(120))] = f"n{k}"
        rows.append((1000 + int(rng.permutation(5000)[0]) * 100 + k, " ".join(base), "en", "a"))
    frame = docs_frame(spark, rows)
    sets = {i: shingles(t) for i, t, *_ in rows}
    comp = components(sets, similar(sets))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(frame).collect()}
    assert got == comp
    whole = docs_frame(spark, odd_rows)
    result = near_duplicates(whole).collect()
    assert Counter(r["doc_id"] for r in result) == Counter(r[0] for r in odd_rows)
    kept = keep_one(whole)
    assert kept.columns == whole.columns and Counter(r["doc_id"] for r in kept.collect())[12] == 1
    assert near_duplicates(empty(spark)).count() == 0 and keep_one(empty(spark)).count() == 0


def test_keep_one_decides_by_row(spark):
    """Null and repeated ids: a row goes for its own text only."""
    from starlit.llm.near_dedup import keep_one
    base = " ".join(f"w{k}" for k in range(60))
    near, own = base.replace("w30", "other"), " ".join(f"v{k}" for k in range(60))
    rows = [(1, base), (None, near), (None, "one of its own"), (None, "another of its own"), (None, "another of its own"), (None, None),
            (2, base), (2, own), (3, "twice the same"), (3, "twice the same"), (3, " "), (3, None), (4, None), (4, "")]
    want = Counter(rows) - Counter([(None, near), (2, base), (3, "twice the same")])
    got = keep_one(docs_frame(spark, [(i, t, "en", "a") for i, t in rows]))
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want
    once = [r for k, r in enumerate(rows) if k != 8]  # no kept id repeats
    got = keep_one(docs_frame(spark, [(i, t, "en", "a") for i, t in once]))
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want


def test_open_pairs_cover_all_components(spark):
    """Members of one key in many components: every pair across components must come out of the blocks."""
    from starlit.llm import near_dedup as nd
    n = 1300
    sig = bytes(2 * nd.SLOTS + nd.MORE_SLOTS)
    nodes = spark.createDataFrame([(k, 10, bytearray(sig)) for k in range(n)], "node long, n long, sig binary")
    open_ = nodes.select(F.lit(1).cast("long").alias("key"), F.lit(0).cast("short").alias("j"), "node", F.when(F.col("node") % 13 == 0, 0).otherwise(F.col("node") % 5 + 1).cast("long").alias("comp"))
    noted = nd._blocks(open_, nodes).groupBy("key", "r", "c").applyInArrow(nd._across, f"{nd._BLOCK}, nodes array<bigint>, comps array<bigint>, pairs binary")
    got = set()
    for r in noted.collect():
        for x, y in np.frombuffer(r["pairs"], dtype="<i4").reshape(-1, 2):
            got.add(tuple(sorted((r["nodes"][x], r["nodes"][y]))))
    comp = {r["node"]: r["comp"] for r in open_.collect()}
    assert got == {(a, b) for a in range(n) for b in range(a + 1, n) if comp[a] != comp[b]}


def test_first_shared_key():
    from starlit.llm import near_dedup as nd
    rng = np.random.default_rng(2)
    a = rng.integers(0, 3, (300, nd.SLOTS + nd.MORE_SLOTS)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < 0.25, 9, a).astype(np.uint16)
    shared = nd.index_keys(a) == nd.index_keys(b)
    assert (nd.first_shared(a, b) == np.where(shared.any(1), shared.argmax(1), -1)).all()
    assert (nd._loaded([type("V", (), {"as_py": lambda self, x=x: x})() for x in nd._stored(a & 255)]) == (a & 255)).all()


def test_sift_loses_less_than_the_index():
    """Pairs at the similarity itself: what the sift rules out is far below the 6e-6 that share no key."""
    from starlit.llm import near_dedup as nd
    slots = nd.SLOTS + nd.MORE_SLOTS
    tail = lambda n, most: sum(math.comb(n, k) * 0.25 ** k * 0.75 ** (n - k) for k in range(most + 1, n + 1))
    assert tail(slots, nd.FAR) < 1e-8 and tail(nd.SLOTS, nd.FAR_INDEX) < 1e-6


def test_components(spark):
    from starlit.llm.near_dedup import components as spark_components
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2)) if a != b] + [(k, k + 1) for k in range(500, 560)]
    got = {r["node"]: r["comp"] for r in spark_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components({x for e in links for x in e}, links)
    assert got == {k: v for k, v in want.items() if k != v}


# 10 language model

def test_lm_scores(spark, odd_rows):
    from starlit.llm.ngram_lm import score_documents
    rows = [tuple(r) for r in small(spark).select("doc_id", "text", "lang", "source").collect()] + [(1000 + (i or 0), t, la, s) for i, t, la, s in odd_rows]
    frame = docs_frame(spark, rows)
    tokens = lambda t: re.findall(SPACE_WORD, lower(t)) + ["\0"]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    n, room = sum(count.values()), sum(count.values()) + 0.5 * (len(count) + 1)
    want = Counter((i, held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n,
                    round(sum(math.log10((count[w] + 0.5) / room) for w in tokens(t)), 5)) for i, t, *_ in rows)
    for max_words in (10_000_000, 50, 0):  # all counts broadcast, some, none
        got = score_documents(frame, max_words=max_words).collect()
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
        test = [r for r in got if r["held_out"] and r["doc_id"] < 1000]
        assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)
        assert all(r["score"] <= 0 for r in got)
    assert score_documents(empty(spark)).count() == 0


def test_filter_counts():
    from starlit.llm.ngram_lm import FrequencyFilter, levels
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 55, 20_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    counts = rng.zipf(1.7, 20_000).clip(1, 10 ** 6)
    f = FrequencyFilter(1, {0: FrequencyFilter.build_part(hashes, counts)})
    got = f.levels(hashes)
    assert (got >= levels(counts, 1)).all() and (got == levels(counts, 1)).mean() > 0.95
    assert (f.levels(rng.integers(0, 1 << 55, 20_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) > 0).mean() < 0.05


def test_scores_with_exact_counts_in_place_of_the_filter(spark):
    """The model's probability by a plain recount: quantised counts of words and pairs, mixed."""
    from starlit.llm import ngram_lm as lm
    texts = [r["text"] or "" for r in small(spark).select("text").collect()][:60] + ["", "one", "one one one"]
    tokens = [re.findall(SPACE_WORD, lower(t)) + ["\0"] for t in texts]
    train, ones, twos = tokens[::2], Counter(), Counter()
    for w in train:
        ones.update(w)
        twos.update(zip([None, *w[:-1]], w))
    quantised = lambda c: 2.0 ** (math.floor(4 * math.log2(c) + 1e-9) / 4)
    n_soft = sum(quantised(c) * 2 ** 0.125 for c in ones.values())
    room = n_soft + 0.5 * (len(ones) + 1)
    hashed: dict[int, int] = {}
    for t in texts[::2]:
        for _, tok, _, before in lm.token_runs([t.encode()]):
            for h in np.concatenate([lm.singles(tok), lm.pairs_of(before, tok)]).tolist():
                hashed[h] = hashed.get(h, 0) + 1

    class Exact:
        def levels(self, hashes):
            return np.array([0 if h not in hashed else int(lm.levels(np.array([hashed[h]]), lm.PAIR if h & 1 else lm.SINGLE)[0])
                             for h in hashes.tolist()], dtype=np.int64)
    scorer = lm.Scorer(sum(ones.values()), len(ones), n_soft, len(train), Exact())
    near = lm.NearWords(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    (n_tokens, _, _, score), _ = scorer.score([t.encode() for t in texts], near, True)
    for k, w in enumerate(tokens):
        want = 0.0
        for a, b in zip([None, *w[:-1]], w):
            p1 = ((quantised(ones[b]) * 2 ** 0.125 if ones[b] else 0) + 0.5) / room
            history = len(train) if a is None else quantised(ones[a]) * 2 ** 0.25 if ones[a] else 0
            pair = min(2.0 ** math.floor(math.log2(twos[a, b]) + 1e-9) if twos[a, b] else 0.0, history)
            want += math.log10(0.6 * p1 + 0.4 * pair / max(history, 1) if history else p1)
        assert n_tokens[k] == len(w) and score[k] == pytest.approx(want, rel=1e-9)


def test_words_held_near_are_probed_once():
    from starlit.llm.ngram_lm import NearWords, singles
    asked: list = []

    class Filter:
        def levels(self, hashes):
            asked.append(len(hashes))
            return (hashes % np.uint64(7)).astype(np.int64)
    words = np.arange(10, 30, dtype=np.uint64)
    near, seen = NearWords(words[:10], np.arange(1, 11)), np.arange(12, 25, dtype=np.uint64)
    first, again = near.look_up(seen, Filter()), near.look_up(seen, Filter())
    assert asked == [13, 5] and all((a == b).all() for a, b in zip(first, again))
    assert (first[1] == singles(seen) % np.uint64(7)).all() and first[0].tolist() == [*range(3, 11)] + [0] * 5


def test_filter_holds_every_gram_at_any_size(spark, odd_rows):
    """A filter too large to broadcast is probed part by part, with the same scores; rare n-grams stay in it."""
    from starlit.llm import ngram_lm as lm
    rows = [tuple(r) for r in small(spark).select("doc_id", "text", "lang", "source").collect()] + odd_rows
    frame = docs_frame(spark, rows)
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5), round(r["score"], 5))
    whole, chunk = Counter(map(key, lm.score_documents(frame).collect())), lm.CHUNK_TEXT
    try:
        lm.CHUNK_TEXT = 100_000  # several chunks
        for max_words in (lm.MAX_WORDS, 50):
            assert Counter(map(key, lm.score_documents(frame, max_words=max_words, max_bits=1 << 12).collect())) == whole
    finally:
        lm.CHUNK_TEXT = chunk
    assert lm.score_documents(empty(spark), max_bits=-1).count() == 0


# registered queries

@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_decontaminate", "op5_url_filter"])
def test_query_matches_sql(spark, name):
    from starlit.llm.queries import QUERIES, SQL
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF).toPandas()
    want = con.execute(SQL[name]).df()[list(got.columns)]
    key = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(want)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p
    docs = small(spark)
    for k, (name, stage) in enumerate(p.STAGES):
        before, columns = {r["doc_id"]: r["text"] for r in docs.collect()}, docs.columns
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        assert {r["doc_id"] for r in after} <= set(before)
        if name != "tokens":
            assert docs.columns == columns
        if name == "near_dedup":
            sets = {i: shingles(t) for i, t in before.items()}
            comp = components(sets, similar(sets))
            assert {r["doc_id"] for r in after} == {i for i in sets if comp[i] == i}
        if name == "decontaminate":
            items = rows_of(spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text"))
            assert {r["doc_id"] for r in after} == {i for i, t in before.items() if not next(iter(contamination([(i, t)], items)))[5]}
        if name in ("quality", "near_dedup", "decontaminate"):
            assert all(before[r["doc_id"]] == r["text"] for r in after)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    first = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "0")).collect()}
    assert all(i in first for i, q in labels.items() if q == 1)
    assert len(after) > 0 and "ids_crc32" in docs.columns
