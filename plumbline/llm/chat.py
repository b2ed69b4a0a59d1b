"""Reply trees to chat transcripts, by DataFrame operations only.

A message has a tree, an id, a parent's id (null at a root), a role, a text and a
score. Self-joins double the distance that each message sees upwards, so a tree of
depth d takes about log2(d) joins; leaves are ranked by their path's mean score; the
same tables then list the chosen paths' messages, doubling the number listed each
time; each path becomes one transcript:

    <|im_start|>role
    text<|im_end|>

Inside roles and texts "&" becomes "&amp;" and "<|" becomes "&lt;|"; in roles a line
feed becomes "&#10;". So no content can look like a mark, and unescape() gives back
exactly what went in.

Null roles and texts are empty, null scores 0. A parent that isn't in its tree makes
its children roots. Messages on a cycle, or below one, are on no root's path and are
left out. Repeated ids of a tree are a caller's error and raise. Null tree ids form
one tree. An empty table gives no rows. Very long texts are rows like others and are
joined to the paths last; ties of score go to the least leaf. Columns other than the
six have no effect, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, stored

START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("&#10;"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("&#10;"), F.lit("\n")))


def _on(a: str, x: str, b: str, y: str) -> Column:
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree")) & (F.col(f"{a}.{x}") == F.col(f"{b}.{y}"))


def _lookups(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Look-ups upwards, and (tree, msg, up, total, hops) of whole paths to a root.

    Look-up j has (tree, msg, up, ..) of the messages that have a 2**j-th ancestor,
    which is up; total and hops sum up what was passed. A message whose path is whole
    is not joined again, so a few long branches don't make short ones work.
    """
    level = nodes.select("tree", "msg", F.col("parent").alias("up"), F.col("score").alias("total"), F.lit(1).cast("bigint").alias("hops"))
    live, whole = level.where("up is not null"), level.where("up is null")
    levels = [live]
    deepest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while 1 << len(levels) <= 2 * deepest and not live.isEmpty():
        a, b = live.alias("a"), live.unionByName(whole).alias("b")
        level = cut(a.join(b, _on("a", "up", "b", "msg")).select("a.tree", "a.msg", "b.up", (F.col("a.total") + F.col("b.total")).alias("total"), (F.col("a.hops") + F.col("b.hops")).alias("hops")))
        live, whole = level.where("up is not null"), whole.unionByName(level.where("up is null"))
        levels.append(live)
    return levels, whole


def root_to_leaf_paths(messages: DataFrame, paths: int | None = None) -> DataFrame:
    """(tree, leaf, rank, path_score, depth, role, text): messages of the best `paths` paths of each tree (None: all).

    messages: tree, msg, parent, role, text, score. rank from 1 by falling mean
    score, ties by leaf id; depth from 0 at the root.
    """
    own = stored(messages.select("tree", "msg", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")))
    if not own.groupBy("tree", "msg").count().where("count > 1").isEmpty():
        raise ValueError("a tree holds the same message id more than once")
    a, b = own.select("tree", "msg", "parent", "score").alias("a"), own.select("tree", "msg").alias("b")
    nodes = cut(a.join(b, _on("a", "parent", "b", "msg"), "left").select("a.tree", "a.msg", F.col("b.msg").alias("parent"), "a.score"))  # texts join the paths at the end
    levels, whole = _lookups(nodes)
    parents = nodes.where("parent is not null").select("tree", "parent").distinct()
    leaves = whole.alias("a").join(parents.alias("b"), _on("a", "msg", "b", "parent"), "left_anti").select("tree", F.col("msg").alias("leaf"), (F.col("total") / F.col("hops")).alias("path_score"), "hops")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")))
    listed = (ranked if paths is None else ranked.where(F.col("rank") <= paths)).withColumn("msg", F.col("leaf")).withColumn("depth", F.col("hops") - 1)
    for j in range(len(levels) - 1, -1, -1):
        step = levels[j].select("tree", "msg", "up")
        above = listed.alias("a").join(step.alias("b"), _on("a", "msg", "b", "msg")).select("a.tree", "a.leaf", "a.path_score", "a.hops", "a.rank", F.col("b.up").alias("msg"), (F.col("a.depth") - (1 << j)).alias("depth"))
        listed = cut(listed.unionByName(above))
    return listed.alias("a").join(own.alias("b"), _on("a", "msg", "b", "msg")).select("a.tree", "a.leaf", "a.rank", "a.path_score", "a.depth", "b.role", "b.text")


def format_paths(listed: DataFrame, trained: str = ASSISTANT) -> DataFrame:
    """(tree, leaf, rank, path_score, formatted, loss): a transcript for each path.

    loss: the spans (start from 1, length, in code points) of `formatted` that are
    trained on: the texts of the role `trained`, without their marks.
    """
    key = ["tree", "leaf", "rank", "path_score"]
    turn = listed.select(*key, "depth", "role", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    turn = turn.withColumn("size", F.length("head") + F.length("body") + len(END))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turn = turn.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head") + 1)
    turn = turn.select(*key, F.struct("depth", F.concat("head", "body", F.lit(END)).alias("piece"), "role", F.col("at").cast("int").alias("start"), F.length("body").alias("length")).alias("t"))
    whole = turn.groupBy(*key).agg(F.sort_array(F.collect_list("t")).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x.role == trained), lambda x: F.struct(x.start.alias("start"), x.length.alias("length")))
    return whole.select(*key, F.array_join(F.transform("t", lambda x: x.piece), "").alias("formatted"), spans.alias("loss"))


def format_trees(messages: DataFrame, paths: int | None = None, trained: str = ASSISTANT) -> DataFrame:
    return format_paths(root_to_leaf_paths(messages, paths), trained)


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a transcript was made of."""
    parts = F.slice(F.split(formatted, r"<\|im_end\|>\n"), F.lit(1), F.size(F.split(formatted, r"<\|im_end\|>\n")) - 1)

    def turn(x: Column) -> Column:
        inner = F.substr(x, F.lit(len(START) + 1))
        role = F.substring_index(inner, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(inner, F.length(role) + 2)).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s.start, s.length))), "")


def linear_trees(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Conversations as trees of one branch: rows of a conversation by turn, then role and text, each replying to the one before."""
    at = F.row_number().over(Window.partitionBy(id_col).orderBy("turn", "role", "text")).cast("bigint")
    rows = turns.select(F.col(id_col).alias("tree"), at.alias("msg"), "role", "text")
    return rows.select("tree", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """The digest columns of every conversation's transcript, read back from it."""
    made = format_trees(linear_trees(conversations)).select(F.col("tree").alias("conv_id"), "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("trained"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return made.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(text.cast("binary"), 256).alias("turns_sha256"), F.length("trained").cast("bigint").alias("loss_chars"), F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))
