"""Whole scores of both classifiers against versions that go word by word."""

import math

import numpy as np

from plumbline.llm import quality, toxicity
from plumbline.llm.words import word_hashes

H = toxicity.HIDDEN


def squashed(x):
    return 1 / (1 + math.exp(-x))


def slow_states(net, d, inputs):
    h, out = np.zeros(H), []
    for x in inputs:
        gates, hu = x @ net.wx[d] + net.b[d], h @ net.u[d]
        z = [squashed(gates[i] + hu[i]) for i in range(H)]
        r = [squashed(gates[H + i] + hu[H + i]) for i in range(H)]
        new = [math.tanh(gates[2 * H + i] + r[i] * hu[2 * H + i]) for i in range(H)]
        h = np.array([z[i] * h[i] + (1 - z[i]) * new[i] for i in range(H)])
        out.append(h)
    return out


def slow_score(net, text):
    """Every window's words one after another, both ways, attention, the largest logit, the curve."""
    words = text.split()
    if not words:
        return net.prior
    logits = []
    for start in range(0, max(1, len(words) - toxicity.SPAN + toxicity.STRIDE), toxicity.STRIDE):
        own = [net.inputs(toxicity.word_codes([w]))[0].astype(float) for w in words[start : start + toxicity.SPAN]]
        states = [np.concatenate(s) for s in zip(slow_states(net, 0, own), slow_states(net, 1, own[::-1])[::-1], strict=True)]
        weight = [math.exp(float(np.tanh(s @ net.wa) @ net.va)) for s in states]
        pooled = sum(w * s for w, s in zip(weight, states, strict=True)) / sum(weight)
        logits.append(float(pooled @ net.wo + net.bo[0]))
    a, b = net.curve
    return squashed(a * max(logits) + b)


def test_toxicity_score_by_definition():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["Rude!", "(awful)", "é漢", "x" * 300]
    texts = [" ".join(rng.choice(vocabulary, n)).encode() for n in (1, 2, 31, 32, 33, 48, 49, 130) for _ in range(6)]
    y = np.array([float(b"Rude!" in t or b"(awful)" in t) for t in texts])
    model = toxicity.Toxicity(toxicity.fit_network(texts, y, steps=20))
    for t in [*texts[::3], b"", b" \n "]:
        assert abs(float(model.scores([t])[0]) - slow_score(model.net, t)) < 1e-4


def test_quality_score_by_definition():
    rng = np.random.default_rng(4)
    vectors = rng.integers(-60, 60, (quality.ROWS, quality.SIZE)).astype(np.int8)
    good, bad = [f"good{i}" for i in range(30)], [f"bad{i}" for i in range(30)]
    texts = [" ".join(rng.choice(good if i % 2 else bad, 40)).encode() for i in range(200)]
    model = quality.Quality(vectors, quality.fit_network(quality.pooled(texts, vectors), np.arange(200) % 2))
    net = model.network
    for t in [*texts[:20], b"one", b"", b"good1 bad2 " * 400]:
        rows = [[int(x) / quality.PARTS for x in vectors[r]] for r in quality.rows_of(word_hashes(t)).tolist()]
        n = max(len(rows), 1)
        mean = [sum(r[i] for r in rows) / n for i in range(quality.SIZE)]
        spread = [math.sqrt(max(sum(r[i] ** 2 for r in rows) / n - mean[i] ** 2, 0)) for i in range(quality.SIZE)]
        x = [*mean, *spread, math.sqrt(sum(m * m for m in mean))]
        hidden = [math.tanh(sum((x[i] - net.shift[i]) / net.scale[i] * net.w1[i, j] for i in range(len(x))) + net.b1[j]) for j in range(quality.HIDDEN)]
        logit = sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2
        assert abs(float(model.scores([t])[0]) - squashed(logit / net.temperature)) < 1e-3
    assert np.mean((model.scores(texts) > 0.5) == (np.arange(200) % 2)) > 0.95
