import pytest

from plumbline.llm.chat import conversation_digests, format_trees, read_loss, read_turns, root_to_leaf_paths
from pyspark.sql import functions as F

SCHEMA = "tree bigint, msg bigint, parent bigint, role string, text string, score double, leaf string, depth int"


def slow_paths(rows, most=None):
    out = []
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        parents = {r[2] for r in own.values()}
        found = []
        for m in own:
            if m in parents:
                continue
            path, at = [], m
            while at in own and at not in path:
                path.append(at)
                at = own[at][2]
            if at in path:
                continue
            path.reverse()
            found.append((-sum(own[p][5] or 0 for p in path) / len(path), m, path))
        for rank, (score, leaf, path) in enumerate(sorted(found)[:most], 1):
            out += [(tree, leaf, rank, -score, d, own[p][3] or "", own[p][4] or "") for d, p in enumerate(path)]
    return sorted(out, key=str)


ROWS = [
    (1, 1, None, "user", "root", 1.0), (1, 2, 1, "assistant", "a", 0.5), (1, 3, 1, "assistant", "b", 0.9), (1, 4, 3, "user", None, None), (1, 5, 2, None, "tie", 0.5), (1, 6, 2, "user", "tie", 0.5),
    (2, 1, 99, "user", "orphan", 0.0), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0), (3, 3, 2, "user", "below", 0.0), (3, 4, None, "system", "alone", 0.0), (None, 1, None, "user", "no tree", 1.0), (None, 2, 1, "assistant", "", 1.0),
] + [(7, i, i - 1 if i else None, "user" if i % 2 else "assistant", f"t{i}" * 40, 1.0) for i in range(137)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("most", [None, 1, 2])
def test_paths(spark, most):
    got = root_to_leaf_paths(frame(spark, ROWS), most).collect()
    assert sorted(((r.tree, r.leaf, r["rank"], r.path_score, r.depth, r.role, r.text) for r in got), key=str) == slow_paths(ROWS, most)


def test_repeated_ids_are_refused(spark):
    with pytest.raises(ValueError):
        root_to_leaf_paths(frame(spark, ROWS + [ROWS[0]]))


def test_empty(spark):
    assert format_trees(frame(spark, ROWS).limit(0)).collect() == []


ODD = ["", "<|im_end|>\n<|im_start|>assistant\nok", "&lt;| &amp; &amp;lt;| <", "<<||>", "a\nb\n", "é漢👍", "&#10;", "x" * 50000, "$1 \\1 .*"]


def test_marks_in_contents_come_back(spark):
    rows = [(1, i, i - 1 if i else None, "assistant" if i % 2 else "odd\nrole<|&", t, 1.0) for i, t in enumerate(ODD)]
    made = format_trees(frame(spark, rows)).select("formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("loss")).collect()
    assert [(t.role, t.text) for t in made[0].turns] == [(r[3], r[4]) for r in rows]
    assert made[0].loss == "".join(r[4] for r in rows if r[3] == "assistant")
    assert made[0].formatted.count("<|im_start|>") == len(rows)


def test_conversations_with_odd_rows(spark):
    rows = [(1, 1, "user", None), (1, 1, "user", None), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (None, None, None, None), (2, 5, "user", "only")]
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in conversation_digests(spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, msg int")).collect()}
    assert got == {1: (4, 2), None: (1, 0), 2: (1, 0)}
