"""Tests as definitions: their items, annotators and measures; options; readiness; progress."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.uids import parse_system_uid, security_test_uid
from plumbline.operators import hazards, measure
from plumbline.plans.models import annotate, require_capabilities, responses

#: Prompt sets and locales that go together.
GENERAL_SETS = {"practice": ["en_us", "fr_fr", "zh_cn"], "official": ["en_us", "fr_fr", "zh_cn"], "demo": ["en_us", "fr_fr"]}
SECURITY_SETS = {"official": ["en_us"]}


def check_prompt_set(sets: dict[str, list[str]], prompt_set: str, locale: str) -> None:
    if locale not in sets.get(prompt_set, []):
        known = ", ".join(f"{s} + {x}" for s, xs in sets.items() for x in xs)
        raise ValueError(f"no prompt set {prompt_set} in {locale}; there are {known}")


@dataclass(frozen=True)
class ModelOptions:
    """What a model is asked with; null where not given."""

    max_tokens: int | None = 100
    max_total_output_tokens: int | None = None
    temperature: float | None = None
    top_p: float | None = None
    top_k: int | None = None
    top_logprobs: int | None = None
    stop_sequences: tuple[str, ...] = ()

    def __post_init__(self):
        if None not in (self.max_tokens, self.max_total_output_tokens) and self.max_total_output_tokens < self.max_tokens:
            raise ValueError("max_total_output_tokens is less than max_tokens")

    def given(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v not in (None, ())}


@dataclass
class TestDefinition:
    """Items, what is needed of a model, the annotators, and how an item's annotations become its measurement."""

    __test__ = False

    uid: str
    items: Callable[[], DataFrame]
    annotators: list = field(default_factory=list)
    requires: tuple[str, ...] = ("text",)
    measure: Callable[[DataFrame], DataFrame] | None = None
    keys: tuple[str, ...] = ()


@dataclass
class TestRecord:
    __test__ = False

    uid: str
    sut: str
    items: DataFrame
    result: DataFrame

    def to_json(self) -> str:
        """The result, a row a group of items."""
        rows = [r.asDict(recursive=True) for r in self.result.collect()]
        return json.dumps({"test_uid": self.uid, "sut_uid": self.sut, "result": rows or {"Unknown test result": "no valid items."}})


def security_test(persona: str, locale: str, prompt_set: str, items: Callable[[], DataFrame], annotators: list, evaluator: str = "default") -> TestDefinition:
    check_prompt_set(SECURITY_SETS, prompt_set, locale)
    return TestDefinition(security_test_uid(persona, locale, prompt_set, evaluator), items, annotators)


def run_test(test: TestDefinition, model) -> TestRecord:
    """One test on one model: items, responses, annotations, measurements, and their mean by the test's keys."""
    require_capabilities(model, test.requires)
    own = test.items()
    for c in ("evaluated_prompt_text",):
        own = own if c in own.columns else own.withColumn(c, F.col("prompt_text"))
    answered = responses(own, model)
    if test.measure is not None:
        done = test.measure(answered)
    else:
        votes = annotate(answered, test.annotators).groupBy("prompt_id").agg(F.bool_and("is_safe").alias("is_safe"), F.bool_or("is_valid").alias("is_valid"))
        done = measure.measured(answered, votes)
    result = hazards.persona_stats(done.withColumn("_all", F.lit("all")), list(test.keys) or ["_all"], "persona" if "persona" in done.columns else "_all").drop("_all") if test.keys else done.groupBy().agg(F.count("value").alias("num_items"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("num_safe"), F.count_if(F.col("value").isNull()).alias("exceptions")).where("num_items > 0").withColumn("frac_safe", F.col("num_safe") / F.col("num_items"))
    return TestRecord(test.uid, model.uid, done, result)


def question_test(uid: str, questions: DataFrame) -> TestDefinition:
    """Whether a model gives the safe answer, word for word."""
    return TestDefinition(uid, lambda: questions.select(F.col("id").alias("prompt_id"), F.col("question").alias("prompt_text"), "safe_answer"), measure=lambda df: df.withColumn("value", (F.col("response_text") == F.col("safe_answer")).cast("double")))


def initialization(thing, **kwargs) -> str:
    """How something was made, so that it can be made again; secrets are named, not told."""
    shown = {k: {"secret": v[1]} if isinstance(v, tuple) and len(v) == 2 and v[0] == "secret" else v for k, v in kwargs.items()}
    return json.dumps({"module": type(thing).__module__, "class_name": type(thing).__qualname__, "kwargs": shown}, sort_keys=True, default=str)


def kind_of(uid: str, known: list[str]) -> str:
    """known, dynamic or unknown."""
    if uid in known:
        return "known"
    try:
        parse_system_uid(uid)
    except ValueError:
        return "unknown"
    return "dynamic"


def not_ready(things: list, probe: Callable[[object], bool], threads: int = 8) -> dict[str, str]:
    """What isn't ready to be asked, and why; run before a plan is made, some at a time."""

    def why(thing) -> str | None:
        try:
            return None if probe(thing) else "not ready"
        except Exception as e:  # a probe that fails says why
            return f"{type(e).__name__}: {e}"

    with ThreadPoolExecutor(threads) as pool:
        return {t.uid: w for t, w in zip(things, pool.map(why, things), strict=True) if w is not None}


@dataclass
class Progress:
    """Lines of JSON about how far a run is, at most one every `seconds`."""

    total: int
    seconds: float = 1.0
    out: object = None
    last: float = -1e9

    def update(self, done: int, final: bool = False) -> None:
        now = time.monotonic()
        if final or now - self.last >= self.seconds:
            self.last = now
            print(json.dumps({"progress": done / max(1, self.total)}), file=self.out or sys.stderr)


def observed(df: DataFrame, name: str = "run"):
    """df and an observation of its rows and failed rows, which fills as df is computed: metrics without another pass."""
    from pyspark.sql import Observation

    seen = Observation(name)
    failed = F.count_if(F.col("error").isNotNull()) if "error" in df.columns else F.lit(0)
    return df.observe(seen, F.count(F.lit(1)).alias("items"), F.max(F.lit(0)).alias("_") if "error" not in df.columns else failed.alias("failed")), seen
