"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Each word has word inputs (two hashed embeddings, so that two words hardly ever share
both) and character inputs (the mean embedding of its hashed five-byte grams, edges
included, and their largest association with the label), of the word in lower case
without punctuation around it. A document is read in overlapping
windows of SPAN words, one every STRIDE; in each, a forward and a backward gated
recurrent layer run over the words, attention pools their states, and a logit
follows. A document's logit is the largest of all its windows, whatever its length.

Everything is trained in numpy on a bounded sample of labelled rows: embeddings
start from the association of document frequencies with the label and are trained on
with the rest by back-propagation through time; rare words' stay zero, so that they
can't be learnt by heart. A toxic document teaches by its currently
most suspicious window, a clean one by its most suspicious and a random one. A
logistic curve fitted on a part of the sample kept out of training turns logits into
probabilities.

Null texts are empty; a text without words has the sample's share of toxic documents
as score. Without labels of both kinds every score is that share (0.5 without any).
Rows with equal doc_id each get a row. An empty table gives no rows. Very long texts are
scored whole; their ties of windows make no difference. Other columns have no effect on
scores, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import LOWER_AZ
from plumbline.llm.labels import training_rows

SPAN, STRIDE = 32, 16
WORD_ROWS, WORD_SIZE = 1 << 16, 4
GRAM_ROWS, GRAM_SIZE, GRAM = 1 << 16, 8, 5
INPUT = 2 * WORD_SIZE + GRAM_SIZE + 1
HIDDEN, ATTENTION = 8, 12
#: Labelled rows that the network is fitted on, at most.
SAMPLE = 4_000
#: Bytes of a training text at most, so the driver gets at most SAMPLE times as many.
TEXT = 1 << 16
#: Distinct words that a task keeps at a time, and windows that it runs at a time.
MEMO, BATCH = 120_000, 1024
#: Documents that an embedding's row must be in to be trained.
RARE = 4
AROUND = b".,;:!?\"'()[]{}*_-#$%&|<>"


def plain(word: bytes) -> bytes:
    return word.translate(LOWER_AZ).strip(AROUND) or word


def word_codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first row, second row, gram rows of all words, grams of each word)."""
    own = [plain(w) for w in words]
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in own), np.uint64, len(own))
    first = (h & np.uint64(WORD_ROWS - 1)).astype(np.int64)
    second = (h >> np.uint64(32) & np.uint64(WORD_ROWS - 1)).astype(np.int64)
    counts = np.fromiter(map(len, own), np.int64, len(own))
    line = np.frombuffer(b"\x02\x02" + b"\x03\x03\x02\x02".join(own) + b"\x03\x03", np.uint8).astype(np.uint64)
    key = line[: 1 - GRAM].copy()
    for i in range(1, GRAM):
        key = key << np.uint64(8) | line[i : len(line) + 1 + i - GRAM]
    starts = np.cumsum(counts + GRAM - 1) - (counts + GRAM - 1)
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    mixed = key[at] * np.uint64(0x9E3779B97F4A7C15)
    return first, second, (mixed >> np.uint64(48)).astype(np.int32), counts


def parts(codes, size: int = 1 << 14):
    """The codes of so many words after another, of no words once if there are none."""
    first, second, grams, counts = codes
    ends = np.concatenate(([0], np.cumsum(counts)))
    for i in range(0, max(1, len(first)), size):
        j = min(len(first), i + size)
        yield first[i:j], second[i:j], grams[ends[i] : ends[j]], counts[i:j]


def windows(n: int) -> np.ndarray:
    """Starts of the overlapping windows of n words, n > 0."""
    return np.arange(0, max(1, n - SPAN + STRIDE), STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights; the two directions are the first axis of wx, u and b."""

    word: np.ndarray  # two tables
    gram: np.ndarray
    wx: np.ndarray
    u: np.ndarray
    b: np.ndarray
    wa: np.ndarray
    va: np.ndarray
    wo: np.ndarray
    bo: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)
    prior: float = 0.5
    constant: bool = False

    def inputs(self, codes) -> np.ndarray:
        first, second, grams, counts = codes
        x = np.zeros((len(first), INPUT), np.float32)
        x[:, :WORD_SIZE], x[:, WORD_SIZE : 2 * WORD_SIZE] = self.word[0][first], self.word[1][second]
        if len(grams):
            own, at = self.gram[grams], np.cumsum(counts) - counts
            x[:, 2 * WORD_SIZE : -1] = np.add.reduceat(own, at, axis=0) / counts[:, None]
            x[:, -1] = np.maximum.reduceat(own[:, 0], at)
        return x

    def projected(self, x: np.ndarray) -> np.ndarray:
        """The words' share of the gates, for both directions: (words, 2, 3 * HIDDEN)."""
        return np.stack([(x @ self.wx[d] + self.b[d]).astype(np.float32) for d in range(2)], axis=1)

    def words(self, codes) -> np.ndarray:
        """projected() of many words, a part at a time."""
        out, at = np.empty((len(codes[0]), 2, 3 * HIDDEN), np.float32), 0
        for part in parts(codes):
            out[at : at + len(part[0])] = self.projected(self.inputs(part))
            at += len(part[0])
        return out

    def run(self, xp: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; xp (2, windows, SPAN, 3 * HIDDEN) with the second direction's time turned round, mask alike (2, windows, SPAN)."""
        n, k = xp.shape[1], HIDDEN
        h = np.zeros((2, n, k), np.float32)
        states = np.zeros((2, n, SPAN, k), np.float32)
        saved = []
        u = self.u.astype(np.float32)
        for t in range(SPAN):
            m = mask[:, :, t, None]
            hu = h @ u
            zr = sigmoid(xp[:, :, t, : 2 * k] + hu[:, :, : 2 * k])
            z, r = zr[..., :k], zr[..., k:]
            new = np.tanh(xp[:, :, t, 2 * k :] + r * hu[:, :, 2 * k :])
            if keep:
                saved.append((h, z, r, new, hu[:, :, 2 * k :]))
            h = h + m * (1 - z) * (new - h)
            states[:, :, t] = h
        whole = np.concatenate((states[0], states[1][:, ::-1]), axis=2)
        a = np.tanh(whole @ self.wa.astype(np.float32))
        e = np.where(mask[0] > 0, a @ self.va.astype(np.float32), -1e9)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        alpha = e / e.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,ntk->nk", alpha, whole)
        logit = pooled @ self.wo + self.bo[0]
        return (logit, saved, whole, a, alpha, pooled) if keep else logit


def gathered(proj: np.ndarray, ids: np.ndarray, first: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """xp and mask for Network.run of windows that start at `first` in ids with `left` words left in their document."""
    at = first[:, None] + np.arange(SPAN)
    mask = (np.arange(SPAN) < left[:, None]).astype(np.float32)
    rows = ids[np.minimum(at, len(ids) - 1)]
    xp = np.stack((proj[rows, 0], proj[rows[:, ::-1], 1]))
    return xp, np.stack((mask, mask[:, ::-1]))


def logits(net: Network, proj: np.ndarray, ids: np.ndarray, first: np.ndarray, left: np.ndarray) -> np.ndarray:
    out = [net.run(*gathered(proj, ids, first[i : i + BATCH], left[i : i + BATCH])) for i in range(0, len(first), BATCH)]
    return np.concatenate(out) if out else np.zeros(0)


def laid_out(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words left, document) of every window of documents of these lengths, one after another."""
    offset = np.cumsum(lengths) - lengths
    parts = [windows(int(n)) for n in lengths if n]
    some = np.flatnonzero(lengths)
    doc = np.repeat(some, [len(p) for p in parts])
    start = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return offset[doc] + start, lengths[doc] - start, doc


class Memo(dict):
    """Numbers of words, with their projected inputs."""

    def __init__(self, net: Network):
        super().__init__()
        self.net, self.fresh = net, []
        self.proj = np.zeros((0, 2, 3 * HIDDEN), np.float32)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def settle(self) -> None:
        if self.fresh:
            made = self.net.words(word_codes(self.fresh))
            self.proj = np.concatenate((self.proj, made))
            self.fresh = []

    def forget(self) -> None:
        self.clear()
        self.proj = self.proj[:0]


@dataclass
class Toxicity:
    """A fitted model of fixed size."""

    net: Network
    memo: Memo | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"net": self.net, "memo": None}

    def doc_logits(self, texts: list[bytes]) -> np.ndarray:
        """The largest window logit of each text, -inf without words."""
        if self.memo is None:
            self.memo = Memo(self.net)
        if len(self.memo) > MEMO:
            self.memo.forget()
        rows = [np.fromiter(map(self.memo.__getitem__, w), np.int64, len(w)) for w in (t.split() for t in texts)]
        self.memo.settle()
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        out = np.full(len(rows), -np.inf)
        if lengths.any():
            first, left, doc = laid_out(lengths)
            np.maximum.at(out, doc, logits(self.net, self.memo.proj, np.concatenate(rows), first, left))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.net.constant:
            return np.full(len(texts), self.net.prior)
        found = self.doc_logits(texts)
        a, b = self.net.curve
        some = np.isfinite(found)
        return np.where(some, sigmoid(np.clip(a * np.where(some, found, 0) + b, -60, 60)), self.net.prior)


def association(present: np.ndarray, clean: np.ndarray, n_present: int, n_clean: int) -> np.ndarray:
    """How far a row's toxic documents exceed what its documents would have by chance.

    In standard errors, less 1.5 so that chance and single documents give zero, at
    most 4, halved.
    """
    share = n_present / max(1, n_present + n_clean)
    expected = (present + clean) * share
    z = (present - expected) / np.sqrt(expected * (1 - share) + 1)
    return np.sign(z) * np.clip(np.abs(z) - 1.5, 0, 4) / 2


def fresh_network(docs: list[np.ndarray], y: np.ndarray, codes, rng) -> Network:
    """Random weights; the embeddings' first numbers are associations, and rows of fewer than RARE documents are zero."""
    first, second, grams, counts = codes
    by_gram = np.cumsum(counts) - counts
    seen = [np.zeros((2, WORD_ROWS)), np.zeros((2, WORD_ROWS)), np.zeros((2, GRAM_ROWS))]
    for d, label in zip(docs, y.astype(int), strict=True):
        u = np.unique(d)
        seen[0][label][np.unique(first[u])] += 1
        seen[1][label][np.unique(second[u])] += 1
        if len(u):
            at = np.repeat(by_gram[u] - (np.cumsum(counts[u]) - counts[u]), counts[u]) + np.arange(int(counts[u].sum()))
            seen[2][label][np.unique(grams[at])] += 1
    n = int(y.sum()), int(len(y) - y.sum())
    word = rng.normal(0, 0.02, (2, WORD_ROWS, WORD_SIZE)).astype(np.float32)
    gram = rng.normal(0, 0.02, (GRAM_ROWS, GRAM_SIZE)).astype(np.float32)
    for table, s in ((word[0], seen[0]), (word[1], seen[1]), (gram, seen[2])):
        table[s.sum(axis=0) < RARE] = 0
        table[:, 0] = association(s[1], s[0], *n)
    k = HIDDEN
    return Network(
        word, gram, rng.normal(0, INPUT**-0.5, (2, INPUT, 3 * k)), rng.normal(0, 0.5 * k**-0.5, (2, k, 3 * k)), np.zeros((2, 3 * k)),
        rng.normal(0, (2 * k) ** -0.5, (2 * k, ATTENTION)), rng.normal(0, ATTENTION**-0.5, ATTENTION), rng.normal(0, (2 * k) ** -0.5, 2 * k), np.zeros(1), prior=float(y.mean()) if len(y) else 0.5,
    )


class Adam:
    def __init__(self, rate: float):
        self.rate, self.step, self.m, self.v = rate, 0, {}, {}

    def move(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.step += 1
        for name, g in grads.items():
            m = self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * g
            v = self.v[name] = 0.99 * self.v.get(name, 0) + 0.01 * g * g
            params[name] -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-8)


def gradients(net: Network, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradients of the mean cross-entropy of windows x (windows, SPAN, INPUT): of the weights, of x, and the loss."""
    k, n = HIDDEN, len(y)
    flipped = np.stack((x, x[:, ::-1]))
    xp = np.stack([flipped[d] @ net.wx[d] + net.b[d] for d in range(2)])
    masks = np.stack((mask, mask[:, ::-1]))
    logit, saved, whole, a, alpha, pooled = net.run(xp, masks, keep=True)
    loss = float(np.mean(np.logaddexp(0, np.where(y > 0, -logit, logit))))
    d = (sigmoid(logit) - y) / n
    g = {"wo": pooled.T @ d, "bo": np.array([d.sum()])}
    dpool = np.outer(d, net.wo)
    dwhole = alpha[:, :, None] * dpool[:, None, :]
    dalpha = np.einsum("ntk,nk->nt", whole, dpool)
    de = alpha * (dalpha - (alpha * dalpha).sum(axis=1, keepdims=True))
    g["va"] = np.einsum("nta,nt->a", a, de)
    da = de[:, :, None] * net.va * (1 - a * a)
    g["wa"] = np.einsum("ntk,nta->ka", whole, da)
    dwhole = dwhole + da @ net.wa.T
    dstates = np.stack((dwhole[:, :, :k], dwhole[:, ::-1, k:]))
    g["u"] = np.zeros_like(net.u)
    dxp = np.zeros(xp.shape)
    dh = np.zeros((2, n, k))
    ut = net.u.transpose(0, 2, 1)
    for t in range(SPAN - 1, -1, -1):
        h, z, r, new, hn = saved[t]
        m = masks[:, :, t, None]
        dh = dh + dstates[:, :, t]
        dnew = dh * m * (1 - z) * (1 - new * new)
        dz = dh * m * (h - new) * z * (1 - z)
        dr = dnew * hn * r * (1 - r)
        dhu = np.concatenate((dz, dr, dnew * r), axis=2)
        dxp[:, :, t] = np.concatenate((dz, dr, dnew), axis=2)
        g["u"] += h.transpose(0, 2, 1) @ dhu
        dh = dh * (1 - m * (1 - z)) + dhu @ ut
    g["b"] = dxp.sum(axis=(1, 2))
    g["wx"] = np.stack([np.einsum("nti,ntj->ij", flipped[i], dxp[i]) for i in range(2)])
    dx = dxp[0] @ net.wx[0].T + (dxp[1] @ net.wx[1].T)[:, ::-1]
    return g, dx * mask[:, :, None], loss


def _step_tables(net: Network, codes, rows: np.ndarray, dx: np.ndarray, rate: float) -> None:
    """One step on the embeddings of the words of a batch; a row moves by at most its rate in each number."""
    first, second, grams, counts = codes
    flat, grad = rows.ravel(), dx.reshape(-1, INPUT)
    starts = np.cumsum(counts) - counts
    parts = [(net.word[0], first[flat], grad[:, :WORD_SIZE]), (net.word[1], second[flat], grad[:, WORD_SIZE : 2 * WORD_SIZE])]
    c = counts[flat]
    at = np.repeat(starts[flat] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
    parts.append((net.gram, grams[at], np.repeat(grad[:, 2 * WORD_SIZE : -1] / np.maximum(c, 1)[:, None], c, axis=0)))
    for table, at, g in parts:
        known = table.any(axis=1)
        for j in range(table.shape[1]):
            table[:, j] -= np.clip(rate * np.bincount(at, weights=g[:, j], minlength=len(table)) * known, -0.05, 0.05).astype(np.float32)


def fit_network(texts: list[bytes], y: np.ndarray, steps: int = 600, seed: int = 5) -> Network:
    """Train for at least so many batches of 64 windows, and four passes over the sample."""
    rng = np.random.default_rng(seed)
    numbers: dict[bytes, int] = {}
    docs = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in t.split()), np.int32) for t in texts]
    known = list(numbers)
    coded = [word_codes(known[i : i + (1 << 14)]) for i in range(0, len(known), 1 << 14)]
    codes = tuple(np.concatenate(c) for c in zip(*coded, strict=True)) if coded else (np.zeros(0, np.int64),) * 4
    del known, coded, numbers
    y = y.astype(np.float64)
    some = np.array([len(d) > 0 for d in docs], bool)
    if len(y) < 10 or not some.any() or y[some].min() == y[some].max():
        net = fresh_network([], np.zeros(0), ((np.zeros(0, np.int64),) * 4), rng) if not len(y) else fresh_network([], y[:0], codes, rng)
        net.prior, net.constant = float(y.mean()) if len(y) else 0.5, True
        return net
    order = rng.permutation(np.flatnonzero(some))
    cal, fit = order[: len(order) // 5], order[len(order) // 5 :]
    net = fresh_network([docs[i] for i in fit], y[fit], codes, rng)
    net.prior = float(y.mean())
    lengths = np.array([len(docs[i]) for i in range(len(docs))], np.int64)
    ids = np.concatenate(docs)
    first, left, doc = laid_out(lengths)
    by_doc = np.searchsorted(doc, np.arange(len(docs) + 1))
    params = {name: getattr(net, name) for name in ("wx", "u", "b", "wa", "va", "wo", "bo")}
    adam = Adam(0.01)
    # before the first epoch the most suspicious window is that with the largest sum of its words' associations above one
    own = np.concatenate([np.maximum(net.inputs(part)[:, [0, WORD_SIZE, -1]].sum(axis=1) - 1, 0) for part in parts(codes)])
    total = np.concatenate(([0], np.cumsum(own[ids])))
    value = total[np.minimum(first + SPAN, first + left)] - total[first]
    fit_windows = np.flatnonzero(np.isin(doc, fit))
    epochs = max(4, -(-steps // (-(-int(2 * len(fit) - y[fit].sum()) // 64))))
    for epoch in range(epochs):
        if epoch:
            proj = net.words(codes)
            value[fit_windows] = logits(net, proj, ids, first[fit_windows], left[fit_windows])
        picked, target = [], []
        for i in fit:
            lo, hi = by_doc[i], by_doc[i + 1]
            picked.append(lo + int(np.argmax(value[lo:hi])))
            target.append(y[i])
            if not y[i]:
                picked.append(int(rng.integers(lo, hi)))
                target.append(0.0)
        picked, target = np.array(picked), np.array(target)
        adam.rate = 0.01 * (1 - epoch / epochs) + 5e-4
        order = rng.permutation(len(picked))
        for at in range(0, len(order), 64):
            i = order[at : at + 64]
            f, rest = first[picked[i]], left[picked[i]]
            rows = ids[np.minimum(f[:, None] + np.arange(SPAN), len(ids) - 1)]
            mask = (np.arange(SPAN) < rest[:, None]).astype(np.float64)
            x = net.inputs(tuple_of(codes, rows.ravel())).reshape(len(i), SPAN, INPUT).astype(np.float64)
            g, dx, _ = gradients(net, x, mask, target[i])
            adam.move(params, g)
            _step_tables(net, codes, rows, dx, 0.3)
    model = Toxicity(net)
    found = [model.doc_logits([texts[i] for i in cal[at : at + 64]]) for at in range(0, len(cal), 64)]
    net.curve = fitted_curve(np.concatenate(found), y[cal])
    return net


def tuple_of(codes, rows: np.ndarray):
    """The codes of some words."""
    first, second, grams, counts = codes
    c = counts[rows]
    starts = np.cumsum(counts) - counts
    at = np.repeat(starts[rows] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
    return first[rows], second[rows], grams[at], c


def fitted_curve(logit: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(slope, shift) of a logistic curve by Newton's method, with targets drawn in from 0 and 1 (Platt)."""
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return 1.0, 0.0
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack((logit, np.ones_like(logit)), axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(np.clip(x @ w, -60, 60))
        grad = x.T @ (p - t) + 1e-3 * (w - [1, 0])
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        w = w - move * min(1.0, 2.0 / max(1e-9, float(np.abs(move).max())))
    return float(max(w[0], 0.05)), float(w[1])


def stretches(text: Column, most: int = TEXT, parts: int = 64) -> Column:
    """A text of more bytes than `most` as so many evenly spaced stretches of it, `most` bytes in all."""
    n = F.octet_length(text).cast("bigint")
    each = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.substr(text, (1 + i * (n - most // parts) / (parts - 1)).cast("int"), F.lit(most // parts)))
    return F.when(n <= most, text).otherwise(F.aggregate(each, F.lit(b""), lambda a, x: F.concat(a, F.lit(b" "), x)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, fold: int = 2, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Toxicity:
    """Fit on at most `most` labelled documents, of each at most TEXT bytes (see stretches()), which come to the driver."""
    rows = training_rows(docs, labels, label, folds, fold, most, id_col, text_col)
    got = rows.withColumn("text", stretches(F.col("text"))).toArrow().sort_by("doc_id")
    return Toxicity(fit_network(got["text"].to_pylist(), got["label"].to_numpy()))
