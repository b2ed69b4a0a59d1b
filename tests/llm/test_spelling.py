import math
from collections import Counter, defaultdict

import numpy as np

from plumbline.llm.spelling import CLASSES, EDGE, ORDER, discounts, estimate, grams
from plumbline.llm.words import spans


def grams_of(words):
    data = np.frombuffer(b"  ".join(words) + b" ", np.uint8)
    return grams(data, *spans(data))[0]


def test_places_of_words():
    data = np.frombuffer(b" ab\n c  def", np.uint8)
    key, lo, hi = grams(data, *spans(data))
    assert lo.tolist() == [0, 3, 5] and hi.tolist() == [3, 5, 9] and len(key) == 9
    assert key[3:5].tolist() == grams_of([b"c"]).tolist()
    assert grams(data[:0], *spans(data[:0]))[0].tolist() == []


class SlowModel:
    """Modified Kneser-Ney by definition, on symbol tuples."""

    def __init__(self, words):
        self.c = [None] * (ORDER + 1)
        top = Counter()
        for w in words:
            s = [EDGE] * (ORDER - 1) + [int(CLASSES[b]) for b in w] + [EDGE]
            for i in range(ORDER - 1, len(s)):
                top[tuple(s[i - ORDER + 1 : i + 1])] += 1
        raw = top
        self.c[ORDER] = top
        for n in range(ORDER - 1, 0, -1):
            lefts, sums = defaultdict(set), Counter()
            for g, k in raw.items():
                lefts[g[1:]].add(g[0])
                sums[g[1:]] += k
            raw = Counter({g: sums[g] if n > 1 and g[0] == EDGE else len(x) for g, x in lefts.items()})
            self.c[n] = raw
        self.d = [None] + [discounts(np.array(list(self.c[n].values()))) for n in range(1, ORDER + 1)]

    def p(self, g):
        if not g:
            return 1 / 64
        n = len(g)
        after = {x: k for x, k in self.c[n].items() if x[:-1] == g[:-1]}
        total = sum(after.values())
        if not total:
            return self.p(g[1:])
        cut = lambda k: self.d[n][min(k, 3) - 1]
        k = after.get(g, 0)
        return (k - cut(k) if k else 0) / total + sum(cut(x) for x in after.values()) / total * self.p(g[1:])


def test_model_equals_the_definition():
    words = [b"the", b"then", b"the", b"a", "é".encode(), b"abba", b"in###", b"the", b"in", b"thin", b"nth", b"hen"] * 2 + [b"inn", b"ten", b"net"]
    key = grams_of(words)
    k, n = np.unique(key, return_counts=True)
    model, slow = estimate(k, n), SlowModel(words)
    for w in [b"the", b"thin", b"zzz", b"tent", "éa".encode(), b"#", b"q1"]:
        keys = grams_of([w])
        want = [math.log(slow.p(tuple(int(x) >> 6 * (ORDER - 1 - i) & 63 for i in range(ORDER)))) for x in keys]
        assert np.allclose(model.score(keys), want, atol=1e-9)
    for context in [(EDGE,) * 3, (19, 7, 4), (1, 2, 3)]:
        assert abs(sum(slow.p((*context, s)) for s in range(64)) - 1) < 1e-9
