"""Command line: python -m plumbline.cli COMMAND."""

from __future__ import annotations

import argparse
import contextlib
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from plumbline.functions.uids import safe_test_uid
from plumbline.operators import audit
from plumbline.plans import models
from plumbline.plans.definitions import question_test, run_test
from plumbline.plans.load import load_plugins
from plumbline.plans.runner import Benchmark, calibrate, leave_journal, run_benchmark, run_job, run_security
from plumbline.plans.views import HAZARDS
from plumbline.sources import datasets, journal, sinks
from plumbline.sources.store import stored


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline")
    p.add_argument("--plugins", help="a folder whose modules register models and annotators")
    sub = p.add_subparsers(dest="command", required=True)
    some = sub.add_parser("list", help="registered models, annotators, drivers, tests, and the names of secrets")
    some.add_argument("what", nargs="?", choices=["all", "models", "annotators", "drivers", "tests", "secrets"], default="all")
    some.add_argument("--secrets", default=".", help="the folder from which a secrets file is looked for upwards")
    test = sub.add_parser("run-test", help="a file of questions on one model")
    test.add_argument("questions")
    test.add_argument("--sut", required=True)
    test.add_argument("--uid", default="questions")
    safe = sub.add_parser("benchmark-security", help="run security prompt sets")
    safe.add_argument("--jailbreak", help="a CSV of jailbreaks")
    safe.add_argument("--naive", help="a CSV of naive prompts")
    safe.add_argument("--locale", default="en_us")
    safe.add_argument("-m", "--max-instances", type=int)
    safe.add_argument("-o", "--output-dir", default=".")
    for o in ("--sut", "--annotator"):
        safe.add_argument(o, action="append", default=[])
    one = sub.add_parser("run-sut", help="ask one model one prompt")
    one.add_argument("sut")
    one.add_argument("prompt")
    one = sub.add_parser("run-annotator", help="judge one response")
    one.add_argument("annotator")
    one.add_argument("prompt")
    one.add_argument("response")
    job = sub.add_parser("run-job", help="a CSV of prompts, or of responses, to responses or annotations")
    job.add_argument("input")
    job.add_argument("output")
    for c in ("benchmark", "calibrate"):
        b = sub.add_parser(c, help="run a benchmark over a hazard prompt set" if c == "benchmark" else "write standards from reference models")
        b.add_argument("prompts")
        b.add_argument("--locale", default="en_us")
        b.add_argument("--prompt-set", default="demo")
        b.add_argument("--evaluator", default="default")
        b.add_argument("--hazard", action="append")
        b.add_argument("--standards", help="a standards file to grade against, or to write")
        b.add_argument("-m", "--max-instances", type=int)
        b.add_argument("-o", "--output-dir", default=".")
        b.add_argument("--journals", help="a folder to leave the run's journal in")
        b.add_argument("--run-uid")
        b.add_argument("--user")
        for o in ("--sut", "--annotator"):
            b.add_argument(o, action="append", default=[])
    for o in ("--sut", "--annotator"):
        job.add_argument(o, action="append", default=[])
    job.add_argument("--jailbreak", action="store_true")
    check = sub.add_parser("consistency-check", help="audit a journal, or all below a folder")
    check.add_argument("path")
    check.add_argument("--tolerance", type=float, default=0.0)
    check.add_argument("-v", "--verbose", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.plugins:
        load_plugins(a.plugins)
    if a.command == "list":
        found = {"models": models.MODELS.list(), "annotators": models.ANNOTATORS.list(), "drivers": sorted(models.DRIVERS.makers), "tests": [safe_test_uid(h, "en_us", "practice") for h in HAZARDS]}
        if a.what in ("all", "secrets"):
            with contextlib.suppress(FileNotFoundError):
                found["secrets"] = [f"{scope}.{key}" for scope, keys in datasets.load_secrets(a.secrets).items() for key in keys]  # names only
        for what, names in found.items():
            if a.what in ("all", what):
                for uid in names:
                    print(f"{what[:-1]}: {uid}")
        return 0
    spark = spark or SparkSession.builder.appName("plumbline").getOrCreate()
    suts = [models.DRIVERS.make(u, models.MODELS) for u in ([a.sut] if a.command in ("run-sut", "run-test") else getattr(a, "sut", []))]
    judges = [models.ANNOTATORS.make(u) for u in ([a.annotator] if a.command == "run-annotator" else getattr(a, "annotator", []))]
    if a.command == "run-sut":
        row = models.responses(spark.createDataFrame([(a.prompt,)], "prompt_text string"), suts[0]).first()
        print(row.response_text if row.sut_error is None else row.sut_error)
        return int(row.sut_error is not None)
    if a.command == "run-annotator":
        row = models.annotate(spark.createDataFrame([(a.prompt, a.response)], "evaluated_prompt_text string, response_text string"), judges).first()
        print(json.dumps({"is_safe": row.is_safe, "is_valid": row.is_valid}))
        return 0
    if a.command == "run-test":
        print(run_test(question_test(a.uid, datasets.read_questions(spark, a.questions)), suts[0]).to_json())
        return 0
    if a.command == "benchmark-security":
        rows = {k: datasets.read_csv(spark, getattr(a, k)) for k in ("jailbreak", "naive") if getattr(a, k)}
        run = run_security(rows, a.locale, suts, judges, a.max_instances)
        scores = stored(run.hazard_scores)
        scores.orderBy("sut", "persona").show(1000, truncate=False)
        run.benchmark_scores.orderBy("sut").show(1000, truncate=False)
        sinks.write_record(Path(a.output_dir) / "benchmark_record-security.json", spark, "security", scores)
        return 0
    if a.command == "run-job":
        print(json.dumps(run_job(spark, a.input, a.output, suts, judges, jailbreak=a.jailbreak)))
        return 0
    if a.command == "consistency-check":
        found = stored(audit.check_journals(journal.read_journals(spark, a.path), a.tolerance))
        audit.summary(found).orderBy("journal").show(truncate=False)
        if a.verbose:
            audit.in_order(found.where("not passed")).show(1000, truncate=False)
        return 0 if found.where("not passed").isEmpty() else 2
    b = Benchmark(locale=a.locale, prompt_set=a.prompt_set, evaluator=a.evaluator, annotators=judges, **({"hazards": a.hazard} if a.hazard else {}))
    rows = datasets.read_csv(spark, a.prompts)
    if a.command == "calibrate":
        calibrate(rows, b, suts, Path(a.standards or f"{b.uid}.json"), a.journals).show(100, truncate=False)
        return 0
    run = run_benchmark(rows, b, suts, datasets.read_standards(spark, a.standards) if a.standards else None, a.max_instances)
    shown = run.hazard_scores.cache()
    shown.orderBy("sut", "hazard").show(1000, truncate=False)
    if run.benchmark_scores is not None:
        run.benchmark_scores.show(100, truncate=False)
    if a.journals:
        print(leave_journal(run, a.journals, a.run_uid or b.uid))
    sinks.write_record(Path(a.output_dir) / f"benchmark_record-{b.uid}.json", spark, b.uid, shown, a.run_uid, user=a.user)
    return 0


if __name__ == "__main__":
    sys.exit(main())
