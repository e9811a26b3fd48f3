"""A filter probed in buckets: rows and look-ups follow chunks and buckets, not parts, and levels are those of the whole filter."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import docs_frame

from starlit.llm import ngram_lm as lm

U = np.uint64


def texts_of(seed, n, words=400):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{k}" for k in rng.zipf(1.3, rng.integers(0, 60)) % words) for _ in range(n)]


def grams(texts):
    return lm._distinct(list(lm.token_runs([t.encode() for t in texts])))


def chunk_row(texts):
    sink = pa.BufferOutputStream()
    docs = pa.table({"text": pa.array(texts)})
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(docs)
    return sink.getvalue().to_pybytes()


def test_many_parts_are_asked_in_few_rows_and_look_ups(monkeypatch):
    parts, buckets, chunks = 600, 3, [texts_of(k, 200) for k in range(4)]
    known = grams(chunks[0] + chunks[1])
    counts = np.random.default_rng(9).zipf(1.7, len(known)).clip(1, 10 ** 6)
    bits = {k: lm.FrequencyFilter.build_part(known[known % U(parts) == k], counts[known % U(parts) == k]) for k in range(parts)}
    whole = lm.FrequencyFilter(parts, bits)
    want = [whole.levels(grams(c)) for c in chunks]

    batch = pa.RecordBatch.from_pydict({"chunk": pa.array(range(4), pa.int64()), "data": pa.array(map(chunk_row, chunks), pa.binary())})
    asked = list(lm._ask(parts, buckets)(iter([batch])))
    assert sum(b.num_rows for b in asked) <= len(chunks) * buckets
    assert sum(len(x) for b in asked for x in b.column("data").to_pylist()) < 8 * sum(map(len, want))

    rows = [r for b in asked for r in b.to_pylist()] + [
        {"chunk": -1, "bucket": k % buckets, "part": k, "data": d} for k, d in bits.items()]
    rows.sort(key=lambda r: (r["bucket"], r["chunk"]))
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])
    calls, probe = [], lm.FrequencyFilter.levels
    monkeypatch.setattr(lm.FrequencyFilter, "levels", lambda self, hashes: calls.append(len(hashes)) or probe(self, hashes))
    batches = pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=150)
    found = [r for b in lm._answer(parts)(iter(batches)) for r in b.to_pylist()]
    assert len(calls) <= buckets + len(batches) and sum(calls) == sum(map(len, want))
    for k, c in enumerate(chunks):
        got = np.empty(len(want[k]), dtype=np.uint8)
        mine = sorted((r["bucket"], r["data"]) for r in found if r["chunk"] == k)
        got[lm._by_bucket(grams(c), parts, buckets)[0]] = np.frombuffer(b"".join(d for _, d in mine), dtype=np.uint8)
        assert (got == want[k]).all() and (lm.FoundLevels(grams(c), got).levels(grams(c)[::-1]) == want[k][::-1]).all()


@pytest.mark.parametrize("n, buckets", [(1, 1), (2, 5), (5000, 1), (5000, 7), (40, 70_000)])
def test_gaps_give_the_hashes_back(n, buckets):
    rng = np.random.default_rng(n)
    hashes = np.unique(np.concatenate([rng.integers(0, 1 << 56, n, dtype=np.uint64), [U(0), U((1 << 56) - 1)]]))
    order, sizes = lm._by_bucket(hashes, 100_003, buckets)
    asked = sizes[sizes > 0]
    got = [lm._from_gaps(d) for d in lm._gaps(hashes[order], asked)]
    assert [len(g) for g in got] == asked.tolist() and (np.concatenate(got) == hashes[order]).all()
    assert len(sizes) == buckets and sizes.sum() == len(hashes)


def test_scores_of_many_chunks_parts_and_buckets(spark, odd_rows, monkeypatch):
    """Routed scores are those of the broadcast filter, and other settings of the session come back."""
    rows = [(k, t, "en", "a") for k, t in enumerate(texts_of(5, 400))] + odd_rows
    frame = docs_frame(spark, rows).repartition(3, "doc_id")
    monkeypatch.setattr(lm, "PART_TOKENS", 100)
    key = lambda r: (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6))
    want = Counter(map(key, lm.score_documents(frame).collect()))
    assert sum(want.values()) == len(rows)
    monkeypatch.setattr(lm, "CHUNK_TEXT", 10_000)
    monkeypatch.setattr(lm, "ROUTE_BYTES", 1_000)
    names = [*lm.SHUFFLE_ONCE, "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(n) for n in names]
    for max_words in (lm.MAX_WORDS, 50):
        assert Counter(map(key, lm.score_documents(frame, max_words=max_words, max_bits=0).collect())) == want
    assert [spark.conf.get(n) for n in names] == before
