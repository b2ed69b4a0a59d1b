"""Few-shot examples, drawn on the driver from a small pool."""

from __future__ import annotations

import random
from itertools import groupby


def balanced_examples(pool: list[tuple[str, list[str], int]], n: int, seed: int) -> list[tuple[str, list[str], int]]:
    """n questions (question, options, answer) that take turns over the answers' texts.

    Answers with more questions come first, equally common ones in a seeded order; a
    question of the answer whose turn it is is drawn without putting it back.
    """
    rng = random.Random(seed)
    left: dict[str, list] = {}
    for q in pool:
        left.setdefault(q[1][q[2]], []).append(q)
    turns: list[str] = []
    for _, same in groupby(sorted(left, key=lambda a: (-len(left[a]), a)), key=lambda a: len(left[a])):
        tied = list(same)
        rng.shuffle(tied)
        turns += tied
    out: list = []
    while len(out) < min(n, len(pool)):
        for answer in turns:
            if left[answer] and len(out) < n:
                out.append(left[answer].pop(rng.randrange(len(left[answer]))))
    return out
