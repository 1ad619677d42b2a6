"""op5: words and grams of a block are handled by distinct value, not one by one."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import ppm

TEXTS = [b"", b" ", b"a", b"\x0b a\tb  a\n", b"one two\x0c\rtwo ", b"\x00x \x1f\x85 \xc2\xa0y", "é 字 é".encode(), b"ends", b" starts"]


def test_tokens_are_split_words_and_an_end():
    words, first = ppm.tokens(TEXTS)
    expected = [[*t.split(), b""] for t in TEXTS]
    assert words.to_pylist() == [w for ws in expected for w in ws]
    assert first.tolist() == np.cumsum([0, *map(len, expected)])[:-1].tolist()
    for t in TEXTS:
        assert ppm.tokens([t])[0].to_pylist() == [*t.split(), b""]
    assert ppm.distinct(np.zeros(0, np.int64)).tolist() == [] and ppm.distinct(np.asarray([3, 1, 3, 2, 1])).tolist() == [1, 2, 3]


@pytest.mark.parametrize("flush", [1, 4, 1000])
@pytest.mark.parametrize("order", [2, 4])
def test_counting_gives_every_word_and_trigram(monkeypatch, flush, order):
    monkeypatch.setattr(ppm, "FLUSH_WORDS", flush)
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 8)
    batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.binary())], ["t"]) for t in (TEXTS, [], [b"A", b"two tWo"], TEXTS)]
    words, grams = Counter(), Counter()
    for b in ppm._count_corpus(order)(iter(batches)):
        for gram, word, n in zip(*(b.column(i).to_pylist() for i in range(3))):
            (words if gram is None else grams)[word if gram is None else gram] += n
    texts = [t.lower() for t in [*TEXTS, b"A", b"two tWo", *TEXTS]]
    assert words == Counter(w for t in texts for w in [*t.split(), b""])
    trigrams = Counter(int(k) for k in ppm.byte_keys(texts)[0] if k >= 0)
    # longer orders get them as sums of their grams
    long = Counter(int(k) & (ppm.N_KEYS - 1) for k in ppm.long_keys(texts, 4)[0])
    assert long == trigrams and grams == (trigrams if order == 2 else Counter())
    assert list(ppm._count_corpus(order)(iter([]))) == []


def test_a_gram_is_costed_once_in_a_chunk(monkeypatch):
    class Held:
        def __init__(self, value):
            self.value = value

    texts = [[b"some text", b""], [b"some more text"], [b"some text", b"text"]]
    table = ppm.Table(np.linspace(-3, -1, ppm.N_KEYS, dtype=np.float32).reshape(256, 256, 256), np.ones(256, bool))
    base = (np.zeros(1 << 16), np.zeros(1 << 16), np.zeros(1 << 21, np.uint8))
    packed = [ppm._packed([(i, 10 * j + i, t) for i, t in enumerate(ts)]) for j, ts in enumerate(texts)]
    docs = pa.table({"chunk": [0] * 3, "uids": [p[1] for p in packed], "lengths": [p[2] for p in packed], "t": [p[3] for p in packed]})
    found = pa.schema([("asker", pa.int64()), ("k", pa.int32()), ("ctx", pa.int64()), ("total", pa.int64()), ("below", pa.int64()),
                       ("symbols", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]).empty_table()
    asked, costs = [], ppm._Long.costs
    monkeypatch.setattr(ppm._Long, "costs", lambda self, u, *more: asked.extend(u.tolist()) or costs(self, u, *more))
    out = ppm._long_scores(4, Held(table), Held(base))(docs, found)
    keys = [ppm.long_keys([t], 4)[0] for ts in texts for t in ts]
    assert len(asked) == len(set(asked)) and set(asked) == set(np.concatenate(keys).tolist())
    assert out.column("uid").to_pylist() == [0, 1, 10, 20, 21]
    assert np.allclose(out.column("score").to_numpy(), [table[k & (ppm.N_KEYS - 1)].sum() for k in keys])
