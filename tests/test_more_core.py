import json

import pytest
from pyspark.sql import functions as F

from plumbline.cli import main
from plumbline.functions import text, uids
from plumbline.operators.dag import Arbiter, Composer, Router, metadata_of
from plumbline.plans import models
from plumbline.sources import datasets, sinks


def test_definitions_of_systems(tmp_path):
    parts = {"model": "m", "driver": "d", "maker": "k", "moderated": "y"}
    (tmp_path / "s.json").write_text(json.dumps(parts))
    want = uids.SystemUid("m", "d", "k", options=(("moderated", "y"),))
    for given in (json.dumps(parts), str(tmp_path / "s.json"), "k/m:d;mod=y"):
        assert uids.system_from(given) == want
    for bad in ("{", "[1]", "{}", "no driver", str(tmp_path / "absent.json"), "m:hf"):
        found = uids.system_from(bad)
        assert found is None or bad == "{}"


def test_drivers():
    drivers = models.Drivers()
    drivers.register("echo", lambda system, secrets: models.ConstantModel(str(system), secrets.get("k", system.model)))
    assert drivers.make("maker/said:echo").answer == "said" and drivers.make("demo_yes_no", models.MODELS).uid == "demo_yes_no"
    assert drivers.make('{"model": "x", "driver": "echo"}', secrets={"k": "s"}).answer == "s"
    with pytest.raises(ValueError):
        drivers.register("echo", None)
    for bad in ("nothing", "m:absent"):
        with pytest.raises(KeyError):
            drivers.make(bad)


def test_graphs_as_annotators(spark):
    graph = Composer("g", [models.judge_node("first", models.YBadAnnotator("y"), {"safe": ["SAFE"], "unsafe": ["long"]}), Arbiter("long", lambda c: F.when(F.length(c["response"]) > 5, "SAFE").otherwise("UNSAFE"), error=lambda c: F.when(c["response"] == "y!", "odd"))], ["SAFE", "UNSAFE"])
    rows = spark.createDataFrame([("a", "no"), ("b", "yes"), ("c", "yes it is"), ("d", "y!"), ("e", None)], "evaluated_prompt_text string, response_text string")
    informed = models.InformedAnnotator("i", lambda p, r, c: c["key"] == "a", "context")
    got = models.annotate(rows.withColumn("context", F.create_map(F.lit("key"), F.col("evaluated_prompt_text"))), [informed, models.GraphAnnotator("graph", graph)]).collect()
    assert {(r.evaluated_prompt_text, r.is_safe, r.is_valid, r.annotation_error is None) for r in got if r.annotator == "graph"} == {("a", True, True, True), ("b", False, True, True), ("c", True, True, True), ("d", None, False, False)}
    assert {(r.evaluated_prompt_text, r.is_safe) for r in got if r.annotator == "i"} == {("a", True), ("b", False), ("c", False), ("d", False)}


def test_metadata_from_json_and_columns(spark):
    rows = spark.createDataFrame([("p", "r", '{"k": "1", "n": 2}', "x"), ("p", "r", "{bad", "y"), ("p", "r", None, None)], "prompt string, response string, meta string, other string")
    got = [r[0] for r in rows.select(metadata_of(rows, "meta")).collect()]
    assert got[0] == {"k": "1", "n": "2"} and not got[2] and not {k: v for k, v in got[1].items() if v}
    assert [r[0] for r in rows.select(metadata_of(rows, columns=["other"])).collect()] == [{"other": "x"}, {"other": "y"}, {"other": None}]
    assert set(rows.select(metadata_of(rows)).first()[0]) == {"meta", "other"}
    graph = Composer("g", [Router("r", lambda c: F.coalesce(F.try_element_at(c["metadata"], F.lit("k")), F.lit("none")), routes={"1": ["YES"]}, default=["NO"])], ["YES", "NO"])
    assert [r.g_output for r in graph.run(rows.withColumn("m", metadata_of(rows, "meta")), metadata="m").collect()] == ["YES", "NO", "NO"]


def test_guard_prompts(spark):
    known = {"O1": ("Violence", "Be kind."), "O2": ("Fraud", "Be true.")}
    got = [spark.range(1).select(text.guard_prompt(F.lit("  what $5 says \n"), known, v)).first()[0] for v in (1, 2)]
    assert got[0].startswith("<s>[INST] Task: Check if there is unsafe content in 'assistant' messages") and got[1].startswith("<|begin_of_text|>[INST] ")
    assert "<BEGIN UNSAFE CONTENT CATEGORIES>\nO1: Violence\nBe kind.\nO2: Fraud\nBe true.\n<END" in got[0]
    assert "<BEGIN CONVERSATION>\n\nAgent: what $5 says\n\n<END CONVERSATION>" in got[1] and got[1].endswith("violated categories. [/INST]")


def test_standards_by_benchmark(spark, tmp_path):
    (tmp_path / "b-1.json").write_text(json.dumps({"standards": {"reference_standards": {"safe_hazard-1_1-cse": 0.5}}}))
    assert [tuple(r) for r in datasets.standards_of(spark, str(tmp_path), "b-1").collect()] == [("safe_hazard-1_1-cse", 0.5)]
    with pytest.raises(FileNotFoundError):
        datasets.standards_of(spark, str(tmp_path), "b-2")
    assert datasets.no_standards(spark).collect() == []


def test_appended_rows_and_provenance(spark, tmp_path):
    one = spark.createDataFrame([("1", "a")], "prompt_uid string, prompt_text string")
    path = str(tmp_path / "p.csv")
    sinks.write_csv(one, path, one.columns)
    sinks.write_csv(one, path, one.columns, append=True)
    assert len(datasets.read_prompts(spark, path).collect()) == 2
    with pytest.raises(Exception, match="already exists"):
        sinks.write_csv(one, path, one.columns)
    assert {"packages", "source", "spark"} <= set(sinks.provenance(spark)) and "pyspark" in sinks.provenance(spark)["packages"]


def test_endpoints(spark):
    offered = spark.createDataFrame([("Org/Model-A-8b",), ("other",)], "name string")
    assert [r.name for r in models.endpoint_of("model-a", offered).collect()] == ["Org/Model-A-8b"]


def test_more_commands(spark, tmp_path, capsys):
    (tmp_path / "q.jsonl").write_text('{"id": "1", "question": "a", "safe_answer": "I hate you"}\n\n{"id": "2", "question": "b", "safe_answer": "no"}\n')
    assert main(["run-test", str(tmp_path / "q.jsonl"), "--sut", "demo_always_angry"], spark) == 0
    assert json.loads(capsys.readouterr().out)["sut_uid"] == "demo_always_angry"
    (tmp_path / "n.csv").write_text("prompt_uid,prompt_text,locale\n1,go,en_us\n2,do,fr_fr\n")
    (tmp_path / "j.csv").write_text("prompt_uid,prompt_text,seed_prompt_text,bijection_mapping,locale\n1,xx,go,,en_us\n")
    assert main(["benchmark-security", "--naive", str(tmp_path / "n.csv"), "--jailbreak", str(tmp_path / "j.csv"), "--sut", "demo_always_angry", "--annotator", "demo_y_bad", "-o", str(tmp_path)], spark) == 0
    scores = json.loads((tmp_path / "benchmark_record-security.json").read_text())["scores"]
    assert {(r["persona"], r["num_scored_items"], r["score"]) for r in scores} == {("naive", 1, 0.0), ("jailbreak", 1, 0.0)}
    (tmp_path / "config").mkdir()
    (tmp_path / "config" / "secrets.toml").write_text('[hosted]\napi_key = "hidden"\n')
    capsys.readouterr()
    assert main(["list", "secrets", "--secrets", str(tmp_path)]) == 0
    assert capsys.readouterr().out == "secret: hosted.api_key\n"
    assert main(["list", "tests"]) == 0 and "test: safe-cse-en_us-practice-1.1" in capsys.readouterr().out
