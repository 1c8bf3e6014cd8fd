"""Sliced windows give what whole-key windows give, whatever the slice size, also for one hot key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scanlake.operators import ordered

ORDER = ["t", "id"]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = []
    for n in range(900):
        key = 0 if n % 3 == 0 else rnd.randint(1, 40)  # one key holds a third of the rows
        value = None if rnd.random() < 0.3 else float(rnd.randint(-9, 9))
        data.append((key, rnd.randint(0, 200), n, value))
    return spark.createDataFrame(data, "k long, t long, id long, v double").cache()


def as_set(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_running(rows, size):
    sliced = rows.withColumn(ordered.SLICE, ordered.index_slice(F.col("t"), size))
    got = ordered.running(
        sliced, ["k"], ORDER, s=("sum", F.col("v")), n=("count", F.col("v")), hi=("max", F.col("v")), lo=("min", F.col("v")), last=("last", F.col("v"))
    ).drop(ordered.SLICE)
    w = Window.partitionBy("k").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select(
        "*", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("n"), F.max("v").over(w).alias("hi"), F.min("v").over(w).alias("lo"),
        F.last("v", ignorenulls=True).over(w).alias("last"),
    )
    assert as_set(got) == as_set(want)


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_previous(rows, size):
    sliced = rows.withColumn(ordered.SLICE, ordered.index_slice(F.col("t"), size))
    got = ordered.previous(sliced, ["k"], ORDER, before=F.col("v"), before_id=F.col("id")).drop(ordered.SLICE)
    w = Window.partitionBy("k").orderBy(*ORDER)
    assert as_set(got) == as_set(rows.select("*", F.lag("v").over(w).alias("before"), F.lag("id").over(w).alias("before_id")))


@pytest.mark.parametrize("size", [3, 8, 500])
def test_dense_index_and_halo(rows, size):
    got = ordered.dense_index(rows, ["k"], ORDER, ordered.index_slice(F.col("t"), 11))
    w = Window.partitionBy("k").orderBy(*ORDER)
    want = rows.withColumn("i", (F.row_number().over(w) - 1).cast("long"))
    assert as_set(got) == as_set(want)
    haloed = ordered.with_halo(got, "i", 3, size)
    moving = haloed.withColumn("m", F.sum("id").over(ordered.halo_window(["k"], "i").rowsBetween(-3, 0)))
    moving = ordered.drop_halo(moving)
    assert as_set(moving) == as_set(want.withColumn("m", F.sum("id").over(w.rowsBetween(-3, 0))))


def test_halo_longer_than_slice(rows):
    with pytest.raises(ValueError):
        ordered.with_halo(rows, "t", 5, 4)


def test_time_slices_agree(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 01:59:59' AS a, TIMESTAMP'2024-01-01 01:59:59' AS b")
    row = df.select(ordered.time_slice(df, "a", 3600).alias("a"), ordered.time_slice(df, "b", 3600).alias("b")).first()
    assert row["a"] == row["b"] == 1704074399 // 3600


def test_time_slices_of_fractions_of_a_second(spark):
    df = spark.sql("SELECT explode(array(0.0, 0.2, 0.3, 0.9, 1.0)) AS s").selectExpr("timestamp_micros(CAST(s * 1000000 AS BIGINT)) AS b").withColumn("a", F.col("b").cast("timestamp_ntz"))
    rows = ordered.time_sliced(df, "a", 0.25).select("*", ordered.time_slice(df, "b", 0.25).alias("other")).collect()
    assert sorted(r[ordered.SLICE] for r in rows) == [0, 0, 1, 3, 4] and all(r[ordered.SLICE] == r["other"] for r in rows)


def test_slicing_runs_no_job(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id", "timestamp_seconds(id * 1000) AS ts")
    group = "no-job"
    spark.sparkContext.setJobGroup(group, group)
    numbered = ordered.dense_index(ordered.time_sliced(df, "ts", 3600), ["k"], ["ts", "id"])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted((r["k"], r["i"]) for r in numbered.collect()) == sorted((n % 3, n // 3) for n in range(100))
