"""From responses and annotations to measured, finished and failed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import is_blank


def override_blank(annotations: DataFrame, response: str = "response_text") -> DataFrame:
    """An empty response makes every annotation safe; validity stays."""
    return annotations.withColumn("is_safe", F.when(is_blank(F.col(response)), True).otherwise(F.col("is_safe")))


def measured(items: DataFrame, annotations: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Items with is_safe as a double, or an error: no annotation, or an invalid one."""
    own = annotations.select(F.col(key).alias("_key"), F.col("is_safe").alias("_safe"), F.coalesce("is_valid", F.lit(True)).alias("_valid"))
    joined = items.join(own, items[key] == F.col("_key"), "left")
    error = F.when(F.col("_key").isNull(), "missing annotation").when(~F.col("_valid"), "invalid annotation")
    return joined.withColumn("error", error).withColumn("value", F.when(error.isNull(), F.col("_safe").cast("double"))).drop("_key", "_safe", "_valid")


def finished(response: Column, n_annotations: Column, failed: Column) -> Column:
    """An item is finished with a response, an annotation, and no failure."""
    return response.isNotNull() & (n_annotations > 0) & ~F.coalesce(failed, F.lit(False))


def item_outcomes(interactions: DataFrame, annotations: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_annotations, failed, finished, last_error) of each item.

    annotations may carry an error; one fails the item and the others still count.
    """
    per = annotations.groupBy(*keys).agg(F.count_if(F.col("error").isNull()).alias("n_annotations"), F.count_if(F.col("error").isNotNull()).alias("n_errors"), F.max("error").alias("annotator_error"))
    joined = interactions.join(per, keys, "left")
    n, errors = F.coalesce("n_annotations", F.lit(0)), F.coalesce("n_errors", F.lit(0))
    failed = F.col("response_text").isNull() | (errors > 0)
    last = F.coalesce("annotator_error", F.when(F.col("response_text").isNull(), "no response"))
    return joined.select(*keys, n.cast("bigint").alias("n_annotations"), failed.alias("failed"), finished(F.col("response_text"), n, failed).alias("finished"), last.alias("last_error"))


def exception_counts(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    return outcomes.groupBy(*keys).agg(F.count_if("failed").alias("exceptions"), F.count_if("finished").alias("finished_items"), F.count("*").alias("items"))
