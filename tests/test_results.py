"""The result store: bases, the runs after them, and what makes a base void."""

import pytest
from pyspark.sql import functions as F

from replylens.sources import results as rs

KIND = "config string, id string, pred string, error string"


def outcome(df):
    return {(r["config"], r["id"]): (r["pred"], r["run_ts"]) for r in df.collect()}


def run_of(spark, n):
    """Run ``n`` of two configs: every third id fails, and few are scored at all."""
    return spark.createDataFrame([(c, str(i), f"{c}{n}", "limit" if (i + n) % 3 == 0 else None)
                                  for c in ("a:b c", "007") for i in range(n % 4, 40, 1 + n % 5)], KIND)


@pytest.fixture
def store(spark, tmp_path):
    """A store of six runs."""
    path = str(tmp_path / "r s")
    for n in range(1, 7):
        rs.append_results(run_of(spark, n).coalesce(2), path, n)
    return path


def by_definition(spark, path):
    return outcome(rs.latest_results(rs._stored(spark, path)))


def test_a_read_opens_one_base_and_the_runs_after_it(spark, store):
    before = rs.read_results(spark, store)
    want = outcome(before)
    assert want == by_definition(spark, store) and {c for c, _ in want} == {"a:b c", "007"}
    base = rs.compact_results(spark, store)
    assert rs.compact_results(spark, store) is None
    got = rs.read_results(spark, store)
    assert outcome(got) == want and got.columns == before.columns
    read = rs.later_runs(rs._stored(spark, store), rs.bases(spark, store)[0][2])
    assert read.count() == 0
    for n in range(7, 21):
        rs.append_results(run_of(spark, n).coalesce(1), store, n)
        if n == 18:
            base = rs.compact_results(spark, store)
    got = rs.read_results(spark, store)
    assert outcome(got) == by_definition(spark, store)
    _, name, covered = rs.bases(spark, store)[0]
    assert name == base and {r for _, r in covered} == set(range(1, 19))
    opened = [r["f"] for r in rs.later_runs(rs._stored(spark, store), covered)
              .select(F.col("_metadata.file_path").alias("f")).distinct().collect()]
    assert len(opened) == 4 and all("run_ts=19" in f or "run_ts=20" in f for f in opened)
    plan = got.filter("config = '007'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(config") == 2 and "run_ts" in plan


def test_a_base_that_was_not_listed_does_not_count(spark, store, monkeypatch):
    want = by_definition(spark, store)
    rs.compact_results(spark, store)
    rs.append_results(run_of(spark, 7), store, 7)
    kept = rs.bases(spark, store)

    def dies(*_, **__):
        raise RuntimeError("lost")

    monkeypatch.setattr(spark, "createDataFrame", dies)
    with pytest.raises(RuntimeError):
        rs.compact_results(spark, store)
    monkeypatch.undo()
    assert rs.bases(spark, store) == kept
    got = outcome(rs.read_results(spark, store))
    assert got == by_definition(spark, store) != want


def test_a_run_stored_again_makes_its_bases_void(spark, store):
    rs.compact_results(spark, store)
    rs.append_results(run_of(spark, 7), store, 7)
    rs.compact_results(spark, store)
    again = run_of(spark, 7).withColumn("pred", F.lit("again"))
    rs.append_results(again, store, 7)
    runs, listed = rs.stored_runs(spark, store), rs.bases(spark, store)
    assert rs.valid_base(runs, listed)[0] == 1      # the first base does not cover run 7
    got = outcome(rs.read_results(spark, store))
    assert got == by_definition(spark, store) and ("again", 7) in got.values()
    rs.append_results(again, store, 3)
    assert rs.valid_base(rs.stored_runs(spark, store), listed) is None
    assert outcome(rs.read_results(spark, store)) == by_definition(spark, store)
    rs.compact_results(spark, store)
    assert rs.bases(spark, store)[0][0] == 3
    assert outcome(rs.read_results(spark, store)) == by_definition(spark, store)


def test_rows_without_a_config_and_runs_that_only_failed(spark, tmp_path):
    path = str(tmp_path / "n")
    rs.append_results(spark.createDataFrame([(None, "1", "x", "limit"), ("c", "2", "y", "limit")], KIND), path, 1)
    assert rs.compact_results(spark, path) and rs.read_results(spark, path).count() == 0
    rs.append_results(spark.createDataFrame([(None, "1", "x", None), ("c", None, "y", None)], KIND), path, 2)
    want = {(None, "1"): ("x", 2), ("c", None): ("y", 2)}
    assert outcome(rs.read_results(spark, path)) == want
    assert rs.compact_results(spark, path)
    assert outcome(rs.read_results(spark, path)) == want
