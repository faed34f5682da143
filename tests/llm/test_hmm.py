"""The hidden Markov language model against plain recursions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlane.llm import hmm, queries
from eventlane.llm.common import table

SCHEMA = "doc_id long, text string"


def plain_words(text):
    return [w.encode() for w in re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))]


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def plain_counts(rows):
    counts = Counter()
    for i, text in rows:
        if not held_out(i):
            counts.update(plain_words(text))
            counts[b""] += 1
    return counts


def random_model(states, symbols, seed=0):
    draw = np.random.default_rng(seed)
    move, emit = draw.random((states, states)) ** 3, draw.random((symbols, states)) ** 4 + 1e-9
    start = draw.random(states)
    return hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def plain_log10(model, ids):
    own, total = model.start, 0.0
    for t, i in enumerate(ids):
        own = (own if t == 0 else own @ model.move) * model.emit[i]
        total += math.log10(own.sum())
        own = own / own.sum()
    return total


@pytest.mark.parametrize("limits", [(4096, 1024), (5, 3)])
def test_forward_whole_and_in_pieces(monkeypatch, limits):
    monkeypatch.setattr(hmm, "_LONG", limits[0])
    monkeypatch.setattr(hmm, "_PIECE", limits[1])
    model, draw = random_model(5, 40), np.random.default_rng(1)
    texts = [draw.integers(0, 40, n).astype("<u2") for n in (1, 2, 5, 6, 7, 17, 300, 5000, 1)]
    assert np.allclose(hmm.log10_of(model, texts), [plain_log10(model, t) for t in texts], rtol=1e-12, atol=1e-9)


def test_forward_is_the_sum_over_all_paths():
    model, ids = random_model(3, 6), [4, 0, 5, 5]
    total = 0.0
    for path in np.ndindex(3, 3, 3, 3):
        p = model.start[path[0]] * model.emit[ids[0], path[0]]
        for t in range(1, 4):
            p *= model.move[path[t - 1], path[t]] * model.emit[ids[t], path[t]]
        total += p
    assert math.isclose(hmm.log10_of(model, [np.array(ids, "<u2")])[0], math.log10(total))


def test_expected_counts():
    """One stretch: counts by enumeration of all paths."""
    model, ids = random_model(2, 4, 3), [1, 3, 3, 0, 2]
    emitted, moved, started, total = np.zeros((4, 2)), np.zeros((2, 2)), np.zeros(2), 0.0
    for path in np.ndindex(*[2] * 5):
        p = model.start[path[0]] * model.emit[ids[0], path[0]]
        for t in range(1, 5):
            p *= model.move[path[t - 1], path[t]] * model.emit[ids[t], path[t]]
        total += p
        started[path[0]] += p
        for t, s in enumerate(path):
            emitted[ids[t], s] += p
            if t:
                moved[path[t - 1], s] += p
    sums = hmm._Expected(model)
    sums.add([np.array(ids, "<u2")], np.array([True]))
    assert np.allclose(sums.emitted, emitted / total, rtol=1e-4) and np.allclose(sums.moved * model.move, moved / total, rtol=1e-4)
    assert np.allclose(sums.started, started / total, rtol=1e-4) and math.isclose(sums.log10, math.log10(total), rel_tol=1e-5)


def test_stretches_keep_every_token():
    texts = [np.arange(n, dtype="<u2").tobytes() for n in (1, 64, 65, 200, 70_000 % 65_536)]
    parts = [p for some, _ in hmm._stretches(iter(texts)) for p in some]
    begins = sum(int(b.sum()) for _, b in hmm._stretches(iter(texts)))
    assert sum(map(len, parts)) == sum(len(t) // 2 for t in texts) and begins == len(texts) and max(map(len, parts)) == hmm.STRETCH


def scored(df, frequent=60_000):
    teaches = queries.lm_teaches()
    vocab = hmm.vocabulary(df.where(teaches), frequent)
    encoded = hmm.encode(df, vocab, teaches)
    model = hmm.train(encoded, vocab, rounds=2)
    return vocab, model, hmm.score(encoded, vocab, model).collect()


@pytest.mark.parametrize("frequent", [0, 3, 60_000])
def test_scores_by_plain_counts(spark, frequent):
    odd = ["", None, " \t\n", "The the THE", "É é É", "a b c d", "x" * 5000, "a a a a z", "unseen words here", "\x1c odd  space", "long " * 20_000]
    rows = [(i, odd[i % len(odd)] if i % 2 else f"word{i % 7} the common End{i}") for i in range(60)] + [(None, "the last"), (3, "the same id")]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], SCHEMA + ", row long, score double")
    vocab, model, found = scored(df, frequent)
    counts = plain_counts(rows)
    n, v = sum(counts.values()), len(counts)
    assert (vocab.tokens, vocab.distinct) == (n, v)
    symbol = hmm._Symbols(vocab.frequent)
    short = sorted((-c, w) for w, c in counts.items() if 0 < len(w) <= 64)
    beyond = -short[frequent][0] if frequent < len(short) else 0
    assert vocab.frequent == [w for c, w in short if -c > beyond]
    class_n, class_v = Counter(), Counter()
    for w, c in counts.items():
        if w and w not in symbol:
            class_n[hmm.class_of(w)] += c
            class_v[hmm.class_of(w)] += 1
    want = []
    for i, text in rows:
        words = plain_words(text)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words, b""])
        ids = [symbol[w] for w in words] + [vocab.symbols - 1]
        score = plain_log10(model, ids)
        score += sum(math.log10((counts[w] + 0.5) / (class_n[k] + 0.5 * (class_v[k] + 1))) for w in words if w not in symbol.keys() for k in [hmm.class_of(w)])
        want.append((i, len(words) + 1, sum(counts[w] > 0 for w in [*words, b""]), n, base, score))
    key = lambda r: (r[0] is None, r[0] or 0, round(r[4], 6))
    for got, exact in zip(sorted(found, key=key), sorted(want, key=key), strict=True):
        assert tuple(got)[:4] == exact[:4]
        assert got.base_score == pytest.approx(exact[4], rel=1e-9) and got.score == pytest.approx(exact[5], rel=1e-9)


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(i, f"a b c{i} d{i % 3}") for i in range(50)], SCHEMA)
    vocab, model, _ = scored(df, 4)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1) and np.isclose(model.start.sum(), 1)
    assert (model.emit > 0).all()


def test_nothing_to_learn_from(spark):
    assert scored(spark.createDataFrame([], SCHEMA))[2] == []
    alone = next(i for i in range(100) if held_out(i))
    row = scored(spark.createDataFrame([(alone, "only held out")], SCHEMA))[2][0]
    assert tuple(row)[:4] == (alone, 4, 0, 0) and row.base_score == 0.0 and row.score < 0


def test_rounds_raise_the_likelihood_and_beat_the_base(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    vocab = hmm.vocabulary(docs.where(queries.lm_teaches()))
    encoded = hmm.encode(docs, vocab, queries.lm_teaches())
    texts = [np.frombuffer(r.symbols, "<u2") for r in encoded.where("teaches").collect()]
    likely = [hmm.log10_of(hmm.train(encoded, vocab, rounds=n), texts).sum() for n in (0, 2, 5)]
    assert likely == sorted(likely)
    rows = [r for r in queries.op13_lm_scores(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 0.2 * sum(r.n_tokens for r in rows)


def test_least_count(spark):
    draw = np.random.default_rng(2)
    numbers = [int(n) for n in np.exp(draw.uniform(0, 30, 400))]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long")
    for most in (0, 1, 7, 100, 399, 400, 1000):
        least = hmm.least_count(rows, most)
        # Large counts are told apart by their first ten bits; the next of these would be too many.
        kept, rest = sum(n >= least for n in numbers), [n for n in numbers if n < least]
        level = lambda n: n if n < 1024 else n >> (n.bit_length() - 10) << (n.bit_length() - 10)
        assert kept <= most and (not rest or kept + sum(level(n) == level(max(rest)) for n in rest) > most)


def test_class_column(spark):
    words = [b"a", b"ab", b"abc", b"abcd", "éü".encode(), "xé".encode(), b"long-word"]
    rows = spark.createDataFrame([(w,) for w in words], "word binary").withColumn("cls", hmm.class_column(F.col("word"))).collect()
    assert [r.cls for r in rows] == [hmm.class_of(w) for w in words]
