"""Texts encoded in groups: ids of the whole tokenizer wherever a group or a long text is cut, one look-up for each
different piece of a group."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from starlit.llm import token_files as tf

PARTS = ["'", "'s", "'S", "'re", "'VE", "'ll", "'m", "'t", "'d", "a", "e", "s", "ll", "É", "ß", "À", "Þ", "ÿ", "÷", "×", "12", "!", "-", "<|",
         "<", "|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "\n", "\t", "\x0b", "\x1c", "\x00", "\x7f", "\x85", "\xa0", "中", "’", "é", "́",
         "İ", "ﬁ", "Σ", "🙂", "ª", "the", "The"]


@pytest.fixture(scope="module")
def encoder():
    return tf.WordEncoder(public_tokenizers.path(tf.TOKENIZER))


@pytest.mark.parametrize("group_bytes", [1, 40, tf.GROUP_BYTES])
def test_ids_of_groups_however_cut(encoder, monkeypatch, group_bytes):
    monkeypatch.setattr(tf, "GROUP_BYTES", group_bytes)
    rng = random.Random(3)
    texts = ["", " ", "\n", *("".join(rng.choices(PARTS, k=rng.randint(0, 12))) for _ in range(1500)), "", "don't 'tis"]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    ids, ends = encoder.encode_all([t.encode() for t in texts])
    assert ids.tolist() == [i for w in want for i in w]
    assert ends.tolist() == np.cumsum([len(w) for w in want]).tolist()


def test_no_texts(encoder):
    ids, ends = encoder.encode_all([])
    assert len(ids) == len(ends) == 0


def test_bytes_that_are_not_utf8_fail(encoder):
    for data in (b"\x80", b"a \x80 b", b"a\xc3 b", b"\xc3", b"x\xa9"):
        with pytest.raises((ValueError, pa.ArrowException)):
            encoder.encode_all([data])


def test_one_look_up_for_each_piece_of_a_group():
    class Counted(tf._Cache):
        seen = []

        def __getitem__(self, key):
            self.seen.append(key)
            return super().__getitem__(key)

    enc = tf.WordEncoder(public_tokenizers.path(tf.TOKENIZER))
    enc.pieces, enc.words = Counted(enc._piece, {}), Counted(enc._word, {})
    enc.encode_all([b"The cat, the dog, the cat.", "the 中文 中文 dog".encode()] * 50)
    assert sorted(Counted.seen) == sorted({"the", "cat", ",", "dog", ".", "中文"})


def test_groups_go_over_batches_and_stay_bounded(monkeypatch):
    monkeypatch.setattr(tf, "GROUP_BYTES", 30)
    monkeypatch.setattr(tf, "GROUP_ROWS", 4)
    rows = [(None, "x" * 100), *((k, "ab cd"[:k]) for k in range(6)), *((k, "") for k in range(6, 16)), (16, "é" * 20)]
    batches = (pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0]], pa.int64()), "text": pa.array([r[1]], pa.string())}) for r in rows)
    groups = list(tf._groups(batches))
    assert [(i, t.decode()) for ids, texts in groups for i, t in zip(ids, texts)] == rows
    assert all(len(ids) == 1 or len(ids) <= 4 and sum(len(t) + 1 for t in texts) <= 30 for ids, texts in groups)
    assert len(groups) < len(rows) / 2
