from pyspark.sql import functions as F

from plumbline.functions import text, tokens

TEXTS = ["", "one", "  two words ", "a\nb  c\t", "é 漢 字", None]


class Letters:
    def encode(self, t):
        return list(t)

    def decode(self, ids):
        return "".join(ids)


def test_counts_and_cuts(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for make in (tokens.Whitespace, Letters):
        own = make()
        for r in df.select("t", tokens.token_count(F.col("t"), make).alias("n"), tokens.first_tokens(F.col("t"), 2, make).alias("cut")).collect():
            assert r.n == (None if r.t is None else len(own.encode(r.t)))
            assert r.cut == (None if r.t is None else own.decode(own.encode(r.t)[:2]))


def test_reasoning_is_cut_by_tokens(spark):
    df = spark.range(1)
    assert df.select(text.answer_after_reasoning(F.lit("<think>x</think> abcdef"), 3, Letters)).first()[0] == "abc"
    assert df.select(text.answer_after_reasoning(F.lit("<think>x</think> abcdef"), 0, Letters)).first()[0] == ""
