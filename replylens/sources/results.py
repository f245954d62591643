"""The result store: one folder per (config, run), and bases that hold the outcome of many runs.

A run only adds its own attempts. ``compact_results`` folds what is stored into a base, the newest good
attempt per (config, id), and then adds one row to the manifest that names the base and the
files of the runs it covers. A reader takes the newest base whose runs still consist of just those files, and
the runs that came later. So a base that was never listed does not count, and a run stored again makes
the bases that cover it void.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replylens.operators.joins import usable

MANIFEST = "base string, seq long, runs array<struct<config: string, run_ts: long, files: string>>"
NO_CONFIG = "__HIVE_DEFAULT_PARTITION__"       # the folder of rows whose config is null or empty
Runs = dict[tuple[str | None, int], str]


def append_results(results: DataFrame, path: str, run_ts: int) -> None:
    """IO6: add one attempt per (config, id); earlier attempts stay readable.

    A run that is stored again replaces itself: each (config, run) is a folder of its own.
    """
    (results.withColumn("run_ts", F.lit(run_ts).cast("long"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("config", "run_ts").parquet(path))


def attempts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """IO6: every stored attempt; none before the first run."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], schema)


def latest_results(results: DataFrame) -> DataFrame:
    """IO6: the newest attempt without an error per (config, id).

    A maximum, not a window, so an id retried very often combines on the map side.
    """
    rest = [c for c in results.columns if c not in ("config", "id")]
    newest = F.max_by(F.struct(*rest), F.col("run_ts"))
    return usable(results).groupBy("config", "id").agg(newest.alias("r")).select(
        "config", "id", "r.*")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """All attempts; the config is text also where every one looks like a number."""
    fields = [f for f in spark.read.parquet(path).schema.fields if f.name not in ("config", "run_ts")]
    return spark.read.schema(T.StructType([*fields, T.StructField("config", T.StringType()),
                                           T.StructField("run_ts", T.LongType())])).parquet(path)


def stored_runs(spark: SparkSession, path: str) -> Runs:
    """(config, run) with a digest of the names of its files; folders are listed, no file is opened."""
    files = defaultdict(list)
    for name in spark.read.schema("id string").parquet(path).inputFiles():
        *_, config, run, file = unquote(name).split("/")
        config = unquote(config.removeprefix("config="))
        files[None if config == NO_CONFIG else config, int(run.removeprefix("run_ts="))].append(file)
    return {run: hashlib.sha256("\n".join(sorted(own)).encode()).hexdigest() for run, own in files.items()}


def bases(spark: SparkSession, path: str) -> list[tuple[int, str, Runs]]:
    """(sequence, folder, covered runs) of the listed bases, newest first."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{path}/_bases/manifest").collect()    # one row a compaction
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    found = [(r["seq"], r["base"], {(x["config"], x["run_ts"]): x["files"] for x in r["runs"]}) for r in rows]
    return sorted(found, key=lambda b: b[:2], reverse=True)


def valid_base(runs: Runs, listed: list[tuple[int, str, Runs]]) -> tuple[int, str, Runs] | None:
    """The newest base whose runs are stored as they were when it was made."""
    return next((b for b in listed if all(runs.get(run) == files for run, files in b[2].items())), None)


def later_runs(stored: DataFrame, covered: Runs) -> DataFrame:
    """Attempts of runs that no base covers; the others' folders are pruned."""
    by_config = defaultdict(list)
    for config, run in covered:
        by_config[config].append(run)
    for config, own in by_config.items():
        stored = stored.filter(~(F.col("config").eqNullSafe(F.lit(config)) & F.col("run_ts").isin(own)))
    return stored


def _outcome(spark: SparkSession, path: str, base: tuple[int, str, Runs] | None) -> DataFrame:
    stored = _stored(spark, path)
    if base is None:
        return latest_results(stored)
    kind = T.StructType([*[f for f in stored.schema.fields if f.name != "config"],
                         T.StructField("config", T.StringType())])
    folded = spark.read.schema(kind).parquet(f"{path}/_bases/{base[1]}")
    return latest_results(later_runs(stored, base[2]).unionByName(folded))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """IO6: the newest good attempt per (config, id), from the newest valid base and the runs after it.

    A filter on ``config`` reaches the folders of both.
    """
    return _outcome(spark, path, valid_base(stored_runs(spark, path), bases(spark, path)))


def compact_results(spark: SparkSession, path: str) -> str | None:
    """IO6: fold the newest valid base and the runs after it into a new base; its folder, None if there is nothing new.

    One compaction and no run may write at a time. If this dies before the manifest is written, readers go
    on with the former base. Runs and former bases stay, so attempts remain readable.
    """
    runs, listed = stored_runs(spark, path), bases(spark, path)
    base = valid_base(runs, listed)
    if base and base[2].keys() == runs.keys():
        return None
    name = f"base-{uuid.uuid4().hex}"
    _outcome(spark, path, base).write.partitionBy("config").parquet(f"{path}/_bases/{name}")
    row = (name, listed[0][0] + 1 if listed else 1, [(*run, files) for run, files in runs.items()])
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/_bases/manifest")
    return name
