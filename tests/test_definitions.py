import io
import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import responses as R
from plumbline.plans import models
from plumbline.plans.definitions import GENERAL_SETS, ModelOptions, Progress, TestDefinition, check_prompt_set, initialization, kind_of, not_ready, observed, question_test, run_test, security_test

CHAT = {"choices": [{"message": {"content": "hi"}, "logprobs": {"content": [{"top_logprobs": [{"token": "h", "logprob": -0.5}]}]}}]}
TEXT = {"choices": [{"text": "yo", "logprobs": {"tokens": ["y", "o"], "token_logprobs": [-1.0, -2.0]}}]}
CASES = [
    (lambda c: R.chat_completion(c, True), CHAT, ("hi", [[("h", -0.5)]], None)),
    (R.chat_completion, {"choices": []}, (None, None, "expected one choice, got 0")),
    (lambda c: R.chat_completion(c, True), {"choices": [{"message": {"content": "hi"}}]}, (None, None, "no logprobs")),
    (lambda c: R.text_completion(c, True), TEXT, ("yo", [[("y", -1.0)], [("o", -2.0)]], None)),
    (R.candidates, {}, ("", None, None)),
    (R.candidates, {"candidates": [{"finish_reason": "SAFETY"}]}, ("", None, None)),
    (R.candidates, {"candidates": [{"finish_reason": "STOP", "content": {"parts": [{"text": "x"}]}}]}, ("x", None, None)),
    (R.candidates, {"candidates": [{"finish_reason": "STOP"}]}, (None, None, "a candidate without content")),
    (R.moderated, {"moderation_response": {"results": [{"flagged": True}]}}, ("", None, None)),
    (R.moderated, {"moderation_response": {"results": []}, "sut_response": {"completion_message": {"content": {"text": "t"}}}}, ("t", None, None)),
    (R.content_blocks, {"content": [{"type": "text", "text": "t"}]}, ("t", None, None)),
    (R.content_blocks, {"content": []}, (None, None, "expected one block")),
]


@pytest.mark.parametrize(("f", "raw", "want"), CASES)
def test_provider_answers(spark, f, raw, want):
    r = spark.createDataFrame([(json.dumps(raw),)], "r string").select(f(F.col("r")).alias("a")).first().a
    probs = None if r.top_logprobs is None else [[(t.token, t.logprob) for t in ts] for ts in r.top_logprobs]
    assert (r.text, probs, r.error) == want


def test_envelopes(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string").select(R.envelope("Thing", F.struct("a", "b")).alias("e"))
    assert df.select(R.opened(F.col("e"), "Thing", "a: int, b: string").alias("d")).first().d.b == "x"
    with pytest.raises(Exception, match="expected Other"):
        df.select(R.opened(F.col("e"), "Other", "a: int")).collect()


def test_tests(spark):
    questions = spark.createDataFrame([("1", "one two", "Yes"), ("2", "one", "Yes")], "id string, question string, safe_answer string")
    record = run_test(question_test("qa", questions), models.YesNoModel("m"))
    assert json.loads(record.to_json())["result"][0]["frac_safe"] == 0.5
    empty = run_test(question_test("qa", questions.limit(0)), models.YesNoModel("m"))
    assert json.loads(empty.to_json())["result"] == {"Unknown test result": "no valid items."}
    items = spark.createDataFrame([(str(i), "why", "h", ["normal", "skilled"][i % 2]) for i in range(3)], "prompt_id string, prompt_text string, hazard string, persona string")
    t = TestDefinition("t", lambda: items, [models.YGoodAnnotator("a")], keys=("hazard",))
    assert {r.persona: (r.frac_safe, r.num_items) for r in run_test(t, models.ConstantModel("m", "ok")).result.collect()} == {"normal": (0.0, 2), "skilled": (0.0, 1)}
    with pytest.raises(ValueError):
        security_test("naive", "fr_fr", "official", lambda: items, [])
    assert security_test("naive", "en_us", "official", lambda: items, []).uid == "security-naive-en_us-official-1.0.1"
    with pytest.raises(models.MissingCapability):
        run_test(TestDefinition("t", lambda: items, requires=("chat",)), models.YesNoModel("m"))


def test_small_parts(spark):
    check_prompt_set(GENERAL_SETS, "demo", "fr_fr")
    with pytest.raises(ValueError):
        check_prompt_set(GENERAL_SETS, "demo", "zh_cn")
    with pytest.raises(ValueError):
        ModelOptions(max_tokens=10, max_total_output_tokens=5)
    assert ModelOptions(temperature=0.0).given() == {"max_tokens": 100, "temperature": 0.0}
    assert [kind_of(u, ["demo"]) for u in ("demo", "a/b:driver", "odd")] == ["known", "dynamic", "unknown"]
    m = models.YesNoModel("m")
    assert json.loads(initialization(m, uid="m", key=("secret", "k")))["kwargs"] == {"uid": "m", "key": {"secret": "k"}}
    assert not_ready([m], lambda x: True) == {} and not_ready([m], lambda x: 1 / 0)["m"].startswith("ZeroDivisionError")
    out = io.StringIO()
    p = Progress(4, 60, out)
    for i in range(4):
        p.update(i)
    p.update(4, final=True)
    assert [json.loads(x)["progress"] for x in out.getvalue().splitlines()] == [0.0, 1.0]
    df, seen = observed(spark.createDataFrame([(1, "e"), (2, None)], "a int, error string"))
    df.collect()
    assert seen.get == {"items": 2, "failed": 1}
