"""op11: counts and base by hand, probabilities that add up, gradients by differences, states that reach over windows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarrylens.llm import gru, op11_lm

SCHEMA = "doc_id long, text string, part int, codes string, train int"
R = random.Random(3)
WORDS = ["the", "The", "of", "naïve", "É", "x", "tion", "a-b", "wörld", "12"]


def by_hand(rows):
    def words(t):
        return [bytes(c + 32 if 65 <= c <= 90 else c for c in w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]

    crc = lambda i: zlib.crc32(str(i).encode()) % 10
    c = Counter()
    for i, t in rows:
        if i is not None and crc(i):
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = [*words(t), None]
        out.append((i, i is not None and crc(i) == 0, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    return out


def same(spark, rows, monkeypatch, head=None):
    if head:
        monkeypatch.setattr(op11_lm, "COUNT_HEAD", head)
    df = spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in rows], SCHEMA).repartition(3)
    got = op11_lm.score(df).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    mine, want = sorted([tuple(r)[:6] for r in got], key=key), sorted(by_hand(rows), key=key)
    assert [r[:5] for r in mine] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in mine], [r[5] for r in want])
    assert all(math.isfinite(r.score) and r.score <= 1e-9 for r in got)
    return got


def test_counts_and_base(spark, monkeypatch):
    rows = [(i, " ".join(R.choice(WORDS) for _ in range(R.randrange(30))) + R.choice(["", "\n", f" own{i}"])) for i in range(60)]
    rows += [(None, "the of"), (7, "the the"), (7, "the the"), (100, None), (101, ""), (102, " \t\n "), (103, "The " * 400_000)]
    same(spark, rows, monkeypatch)
    same(spark, rows, monkeypatch, head=4)  # most words are counted by the shuffled look-up


def test_no_training_rows_and_no_rows(spark, monkeypatch):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = same(spark, [(held, "a b c"), (None, "x")], monkeypatch)
    assert all(r.base_score == 0 and r.n_known == 0 for r in got)
    same(spark, [], monkeypatch)


def test_held_out_documents_are_likelier_than_under_the_base(spark):
    rows = op11_lm.op11_gated_recurrent_lm(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > 0.92 * sum(r.base_score for r in rows) > sum(r.base_score for r in rows)


@pytest.fixture(scope="module")
def net():
    p = gru.initial(np.arange(gru.HEAD_WORDS, 0, -1.0), np.arange(gru.SHAPES) + 5.0)
    rng = np.random.default_rng(1)
    return {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in p.items()}


def documents(n, rng):
    sizes = rng.integers(1, 90, n)
    return rng.integers(0, gru.HEAD_WORDS + gru.SHAPES, int(sizes.sum())), sizes


def test_probabilities_of_all_codes_add_up(net):
    rng = np.random.default_rng(2)
    states = rng.normal(0, 0.5, (3, gru.HIDDEN)).astype(np.float32)
    every = np.arange(gru.HEAD_WORDS + gru.SHAPES)
    for s in states:
        logp, _ = gru.Pass(net).output(np.repeat(s[None], len(every), 0), every, None)
        assert abs(np.exp(logp).sum() - 1) < 1e-4


def test_shapes_share_out_all_their_mass(spark):
    words = [("w%d" % k, 0, n) for k, n in enumerate([1, 1, 1, 2, 2, 3, 9])]
    counts = spark.createDataFrame([(hash(w), s, n) for w, s, n in words] + [(op11_lm.END, -1, 4)], "word long, shape byte, n long")
    stats = op11_lm.Statistics(counts)
    assert (stats.tokens, stats.types) == (23, 8)
    stats.shape_tokens[0], stats.discount[0] = 19, 0.5
    stats.unknown[0] = (0.5 * 7 + 1) / 20
    part = 10 ** stats.terms(np.ones(7, bool), np.array([1, 1, 1, 2, 2, 3, 9]), np.zeros(7, int))[:, 2]
    assert abs(part.sum() + stats.unknown[0] - 1) < 1e-9


def test_a_document_scores_alike_alone_and_among_others(net):
    codes, sizes = documents(40, np.random.default_rng(4))
    sizes[0] = len(codes) - sizes[1:].sum()
    whole = gru.log_probabilities(net, codes, sizes)
    at = 0
    for n in sizes.tolist():
        assert np.allclose(gru.log_probabilities(net, codes[at : at + n], np.array([n])), whole[at : at + n], atol=1e-4)
        at += n


def test_gradients(net, monkeypatch):
    monkeypatch.setattr(gru, "F4", np.float64)
    p = {k: v.astype(float) for k, v in net.items()}
    rng = np.random.default_rng(5)
    codes, target = rng.integers(0, 40, (6, 4)), rng.integers(0, 40, (6, 4))
    first = rng.random((6, 4)) < 0.3
    h = rng.normal(0, 0.3, (4, gru.HIDDEN))

    def loss():
        run = gru.Pass(p)
        states, kept = run.forward(h, codes, first)
        return run, states, kept

    run, states, kept = loss()
    grads = {}
    logp, back = run.output(states.reshape(-1, gru.HIDDEN), target.ravel(), grads)
    run.backward(back.reshape(states.shape), kept, codes, grads)
    rows, values = grads["x"]
    full = np.zeros_like(p["x"])
    full[rows] = values
    grads["x"] = full
    for name in p:
        for _ in range(6):
            nz = np.argwhere(np.abs(grads[name]) > 1e-4)
            at = tuple(nz[rng.integers(len(nz))])
            old, step = p[name][at], 1e-5
            ends = []
            for sign in (1, -1):
                p[name][at] = old + sign * step
                run, states, _ = loss()
                ends.append(-run.output(states.reshape(-1, gru.HIDDEN), target.ravel(), None)[0].sum())
            p[name][at] = old
            assert abs((ends[0] - ends[1]) / (2 * step) - grads[name][at]) < 1e-3 * max(1, abs(grads[name][at]))


def test_a_window_takes_few_softmaxes(net, monkeypatch):
    """Classes with few targets share array operations: a window of few lanes costs a few exp, not one for each class."""
    calls = []

    class Counted:
        def __getattr__(self, name):
            calls.append(name)
            return getattr(np, name)

    monkeypatch.setattr(gru, "np", Counted())
    rng = np.random.default_rng(6)
    target = (gru.HEAD_WORDS * rng.random(1000) ** 3).astype(int)
    gru.Pass(net).output(rng.normal(0, 0.5, (1000, gru.HIDDEN)).astype(np.float32), target, {})
    assert len(np.unique(target // gru.CLASS_WORDS)) == gru.HEAD_CLASSES
    assert calls.count("exp") <= gru.HEAD_CLASSES // 2


@pytest.mark.parametrize("n", [1, 7, 3000])
def test_stacks_of_classes_equal_one_softmax_each(net, n):
    rng = np.random.default_rng(n)
    target = (gru.START * rng.random(n) ** 3).astype(int)
    states = rng.normal(0, 2, (n, gru.HIDDEN)).astype(np.float32)
    grads = {}
    logp, back = gru.Pass(net).output(states, target, grads)
    p, want, dww = {k: v.astype(float) for k, v in net.items()}, [], np.zeros(net["ww"].shape)
    for s, t, b in zip(states.astype(float), target.tolist(), back, strict=True):
        head = t < gru.HEAD_WORDS
        kind = t // gru.CLASS_WORDS if head else t - gru.HEAD_WORDS + gru.HEAD_CLASSES
        e = np.exp(s @ p["wc"] + p["bc"])
        e /= e.sum()
        want.append(math.log(e[kind]))
        e[kind] -= 1
        own = p["wc"] @ e
        if head:
            w = np.exp(s @ p["ww"][kind] + p["bw"][kind])
            w /= w.sum()
            want[-1] += math.log(w[t % gru.CLASS_WORDS])
            w[t % gru.CLASS_WORDS] -= 1
            own += p["ww"][kind] @ w
            dww[kind] += np.outer(s, w)
        assert np.allclose(b, own, atol=1e-4)
    assert np.allclose(logp, want, atol=1e-4)
    assert np.allclose(grads["ww"], dww, atol=2e-3)


def test_states_are_the_same_when_steps_are_not_kept(net):
    rng = np.random.default_rng(7)
    codes, first = rng.integers(0, gru.START, (9, 5)), rng.random((9, 5)) < 0.3
    h = rng.normal(0, 0.3, (5, gru.HIDDEN)).astype(np.float32)
    kept, passed = (gru.Pass(net).forward(h, codes, first, keep=k)[0] for k in (True, False))
    assert (kept == passed).all()


def test_averages_by_tokens(spark):
    nets = [(k, k + 1, np.full(3, float(k), "<f4").tobytes()) for k in range(40)]
    df = spark.createDataFrame(nets, "bucket long, tokens long, net binary")
    want = sum(k * (k + 1) for k in range(40)) / sum(k + 1 for k in range(40))
    assert np.allclose(op11_lm.averaged(df, 40), want, rtol=1e-5)
    assert op11_lm.averaged(df.limit(0), 1) is None
