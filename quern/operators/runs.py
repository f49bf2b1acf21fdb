"""Run artefacts, batches, unions and accepted / rejected splits."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def run_id(name: Column) -> Column:
    """The 14 digits that a run's files begin with; null for other names."""
    found = F.regexp_extract(name, r"^(\d{14})", 1)
    return F.when(found != "", found)


def checkpoint_fields(name: Column) -> Column:
    """struct(run, epoch, loss) of a checkpoint's name; the run's digits are not taken for the epoch."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    parts = F.filter(F.split(F.regexp_replace(stem, r"^\d{14}_?", ""), "_"), lambda p: p != "")
    epoch = F.try_element_at(F.filter(parts, lambda p: p.rlike(r"^\d+$")), F.lit(1)).try_cast("int")
    loss = F.regexp_extract(name, r"loss_?([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.struct(run_id(name).alias("run"), epoch.alias("epoch"), loss.alias("loss"))


def latest_run(files: DataFrame, name: str) -> DataFrame:
    return files.agg(F.max(run_id(F.col(name))).alias("run"))


def batches(rows: DataFrame, group: str, order: str, size: int, skip: int = 0) -> DataFrame:
    """Add batch: numbers of ``size`` rows in order within each group, the first ``skip`` rows left out."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("_n", n).filter(F.col("_n") > skip).withColumn("batch", F.floor((F.col("_n") - 1 - skip) / size)).drop("_n")


def union(sources: list[DataFrame]) -> DataFrame:
    """Rows of all sources; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def split(rows: DataFrame, rule: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows; both read the same input and nothing is lost between them."""
    return rows.filter(F.col(rule).isNull()), rows.filter(F.col(rule).isNotNull())


def pending(files: DataFrame, done: DataFrame, name: str) -> DataFrame:
    """Files that a ledger of finished work doesn't name."""
    return files.join(done.select(name), name, "left_anti")


def composed(rows: DataFrame, stages: dict[str, Callable[[DataFrame], DataFrame]], toggles: dict[str, bool] | None = None) -> DataFrame:
    """The stages that are not switched off, one after another; an unknown name in ``toggles`` is an error."""
    if unknown := set(toggles or {}) - set(stages):
        raise ValueError(f"no such stages: {sorted(unknown)}")
    for name, stage in stages.items():
        if (toggles or {}).get(name, True):
            rows = rows.transform(stage)
    return rows


def lineage(spark: SparkSession, run: str, model: str, checkpoint: str | None, parent: str | None, dataset: str | None, settings: dict, results: dict) -> DataFrame:
    """One row that tells where a model's checkpoint comes from; appended to an audit table by the caller."""
    row = (run, model, checkpoint, parent, dataset, json.dumps(settings, sort_keys=True), {k: float(v) for k, v in results.items()})
    out = spark.createDataFrame([row], "run_id string, model_id string, checkpoint_path string, parent_checkpoint string, dataset_hash string, config_snapshot string, metrics map<string,double>")
    return out.withColumn("timestamp", F.current_timestamp())


def status_counts(records: DataFrame, status: str = "status") -> DataFrame:
    """One row: stages done, failed, running and pending."""
    return records.agg(*[F.count_if(F.col(status) == s).alias(s) for s in ("completed", "failed", "running", "pending")])
