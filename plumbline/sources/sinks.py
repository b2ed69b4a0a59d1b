"""What runs leave behind: CSV, records, exports, standards."""

from __future__ import annotations

import importlib.metadata
import json
import platform
import subprocess
import sys
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.datasets import ANNOTATIONS, RESPONSES, with_seed


def write_csv(df: DataFrame, path: str, header: list[str], single: bool = True, append: bool = False) -> None:
    """All fields quoted, columns in the header's order; an existing path or a missing column is an error.

    single=False writes a file a partition, for tables that no one task should write.
    append adds files, each with its header, to what is there.
    """
    own = df.select(*header)
    (own.coalesce(1) if single else own).write.mode("append" if append else "errorifexists").csv(path, header=True, quoteAll=True, escape='"', emptyValue="")


def response_rows(df: DataFrame, jailbreak: bool = False, logprobs: bool = False) -> DataFrame:
    """Rows for a responses file; a missing prompt or id is an error."""
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a row has no {c}")).cast("string")).otherwise(F.col(c)).alias(c)
    cols = with_seed(RESPONSES) if jailbreak else RESPONSES
    return df.select(*[need(c) if c in ("prompt_uid", "prompt_text") else F.col(c) for c in cols], *([logprob_text(df).alias("sut_logprobs")] if logprobs else []))


@F.pandas_udf(T.StringType())
def _python_lists(given: pd.Series) -> pd.Series:
    return given.map(lambda text: repr([[(t.get("token"), t.get("logprob")) for t in tokens] for tokens in json.loads(text or "[]")]))


def logprob_text(df: DataFrame):
    """Token probabilities in Python's notation: a list of lists of (token, logprob); empty without any."""
    return _python_lists(F.to_json("top_logprobs"))


def annotation_rows(df: DataFrame, jailbreak: bool = False) -> DataFrame:
    """Rows for an annotations file, the annotation struct as JSON without nulls."""
    cols = with_seed(ANNOTATIONS) if jailbreak else ANNOTATIONS
    return df.withColumn("annotation_json", F.to_json("annotation", {"ignoreNullFields": "true"})).select(*cols)


def shareable(items: DataFrame) -> DataFrame:
    """Items that may be exported: marked shareable, and not of an official prompt set; hazard and prompt_set come from the test's identifier."""
    parts = F.split("test_uid", "-")
    five = F.size(parts) == 5
    own = items.withColumn("prompt_set", F.when(five, F.try_element_at(parts, F.lit(4))).otherwise("unknown")).withColumn("hazard", F.when(five, F.try_element_at(parts, F.lit(2))).otherwise(F.col("test_uid")))
    return own.where(F.col("shareable") & (F.col("prompt_set") != "official"))


def export_annotations(items: DataFrame, path: str, job_id: str) -> None:
    """JSON lines of {job_id, hazard, prompt, response, is_safe, is_valid}, a file a partition."""
    own = shareable(items).select(F.lit(job_id).alias("job_id"), "hazard", F.col("prompt_text").alias("prompt"), F.col("response_text").alias("response"), "is_safe", "is_valid")
    own.write.mode("errorifexists").json(path)


def _said(*command: str) -> str | None:
    """What a command prints, if it is there and ends well."""
    try:
        return subprocess.run(command, capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def provenance(spark) -> dict:
    """Versions, packages, and the state of the sources that a run was made with."""
    packages = {d.metadata["Name"]: d.version for d in importlib.metadata.distributions()}
    git = {"commit": _said("git", "rev-parse", "HEAD"), "origin": _said("git", "remote", "get-url", "origin"), "changes": _said("git", "status", "--porcelain")}
    return {"spark": spark.version, "python": platform.python_version(), "platform": platform.platform(), "node": platform.node(), "command": " ".join(sys.argv), "packages": dict(sorted(packages.items())), "source": git}


def write_record(path: Path, spark, benchmark: str, scores: DataFrame, run_uid: str | None = None, start: str = "", user: str | None = None) -> None:
    """A run's record: metadata and a small table of scores."""
    rows = [r.asDict(recursive=True) for r in scores.collect()]  # a row a hazard and system
    meta = provenance(spark) | {"user": user, "start_time": start}
    path.write_text(json.dumps({"_metadata": meta, "benchmark": benchmark, "run_uid": run_uid or f"run-{benchmark}-{start}", "scores": rows}, indent=2, default=str))


def write_standards(path: Path, references: DataFrame, benchmark: str, suts: list[str], sut_scores: dict, journals: list[str]) -> None:
    """A standards file, keys in order; an existing one is never replaced."""
    if path.exists():
        raise FileExistsError(path)
    given = {r["reference_key"]: r["reference"] for r in references.collect()}  # a row a hazard
    body = {"_metadata": {"file_format_version": "2.0.0", "run_info": {"sut_scores": sut_scores, "journals": journals}}, "standards": {"reference_suts": suts, "reference_benchmark": benchmark, "reference_standards": dict(sorted(given.items()))}}
    path.write_text(json.dumps(body, indent=4))


def run_metadata(rows: DataFrame, by: list[str], seconds: float) -> dict:
    """Counts by system and annotator, and how long the run took."""
    counts = {c: {r[c]: r["count"] for r in rows.groupBy(c).count().orderBy(c).collect()} for c in by}
    hours, rest = divmod(int(seconds), 3600)
    return {"counts": counts, "duration": f"{hours}:{rest // 60:02}:{rest % 60:02}"}
