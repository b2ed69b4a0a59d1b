import json

from plumbline.cli import main
from plumbline.plans import models
from plumbline.plans.load import load_namespace, load_plugins


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "own.py").write_text("from plumbline.plans import models\nmodels.MODELS.register(models.ConstantModel, 'plugged', 'hello')\n")
    prompts = tmp_path / "p.csv"
    prompts.write_text("prompt_uid,prompt_text,hazard,locale,persona\n" + "".join(f"{i},w w,{h},en_us,normal\n" for i, h in enumerate(["cse", "vcr"] * 4)))
    assert main(["--plugins", str(tmp_path), "list"]) == 0
    assert "model: plugged" in capsys.readouterr().out
    assert main(["run-sut", "plugged", "x"], spark) == 0 and capsys.readouterr().out == "hello\n"
    assert main(["run-annotator", "demo_y_bad", "x", "why"], spark) == 0 and json.loads(capsys.readouterr().out)["is_safe"] is False
    assert main(["run-job", str(prompts), str(tmp_path / "out"), "--sut", "plugged"], spark) == 0
    common = [str(prompts), "--hazard", "cse", "--hazard", "vcr", "--sut", "plugged", "--annotator", "demo_y_bad", "-o", str(tmp_path)]
    assert main(["calibrate", *common, "--standards", str(tmp_path / "s.json")], spark) == 0
    (tmp_path / "t.json").write_text((tmp_path / "s.json").read_text().replace("1.0", "0.9", 2).replace("\"2.0.0\"", "\"2.0.0\"").replace(": 1.0", ": 0.9"))
    assert main(["benchmark", *common, "--standards", str(tmp_path / "t.json"), "--journals", str(tmp_path / "j")], spark) == 0
    assert main(["consistency-check", str(tmp_path / "j")], spark) == 0
    record = json.loads(next(tmp_path.glob("benchmark_record-*.json")).read_text())
    assert {s["hazard"]: s["numeric_grade"] for s in record["scores"]} == {"cse": 5, "vcr": 5}
    j = tmp_path / "journal-run-1.jsonl"
    j.write_text('{"message": "starting run", "suts": [], "tests": [], "benchmarks": ["a", "b"]}\n')
    assert main(["consistency-check", str(j), "-v"], spark) == 2


def test_namespaces():
    assert "plumbline.plans.models" in load_namespace("plumbline.plans") and load_plugins("/nowhere") == []
    assert models.ANNOTATORS.list() == sorted(models.ANNOTATORS.list(), key=str.lower)
