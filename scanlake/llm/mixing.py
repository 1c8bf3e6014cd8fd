"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm import text

#: Leading hex digits of a document's draw that name its bucket: 4096 buckets a source.
BUCKET_DIGITS = 3
#: Most sources whose table is sent to every executor (about 100 bytes each); more are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def draw(seed: int) -> Column:
    """Seeded draw of a document as 32 hex digits, from its id and text: equal on every run and machine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))))


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """``target`` of each source (source, source_size, weight).

    All targets together are ``share`` of all sizes. A source above ``epochs`` times its size is clamped there and the rest is
    reshared by weight, until none is above. Each round is one aggregation over the sources; one row comes to the driver.
    """
    cap = F.col("source_size") * F.lit(float(epochs))
    total = sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level = None
    while True:
        # a source is clamped from the round on in which its part at the current level passes its cap
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        now = sources.agg(
            F.sum(F.when(full, cap)).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count(F.when(full, 1)).alias("clamped")
        ).first()
        free = float(total) * share - (now["used"] or 0.0)
        if not now["weight"]:
            return sources.withColumn("target", cap)
        new = free / now["weight"]
        if level is not None and new <= level:
            return sources.withColumn("target", F.when(full, cap).otherwise(F.col("weight") * F.lit(level)))
        level = new


def plan(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """One row per source: source_size, target, whole, last.

    ``docs`` has source, size, draw. A document of a source is taken ``whole`` times, and once more if its draw is at most
    ``last``: those draws, in order, add up to the target to within about half a document. Sources in code point order, null
    last, have the weights in turn. Bounded work per task: sizes are added per (source, bucket of draws) before any shuffle,
    the bucket in which a source's fraction ends is found on those sums, and only that bucket's documents are sorted.
    """
    bucket = F.substring("draw", 1, BUCKET_DIGITS)
    sums = text.stored(docs.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n")), "mix-sums")
    sizes = sums.groupBy("source").agg(F.sum("n").alias("source_size"))
    # one row per source, in one task: sources are names that people give
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights) + 1)
    filled = water_fill(text.stored(sizes.withColumn("weight", weight), "mix-sources"), share, epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    filled = filled.withColumn("whole", F.floor(rate).cast("long"))
    filled = filled.withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))

    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    small = filled.select(F.col("source").alias("_s"), "rest")
    ends = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(small, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    ends = ends.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest")))
    ends = ends.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "before", "rest")
    fine = docs.join(F.broadcast(ends) if _few(ends) else ends, F.col("source").eqNullSafe(F.col("_s")) & (bucket == F.col("_b")))
    to_here = F.sum("size").over(Window.partitionBy("source").orderBy("draw"))
    fine = fine.withColumn("middle", F.col("before") + to_here - F.col("size") / 2)
    # the documents of earlier buckets are all in; the empty draw stands for none of this bucket
    last = fine.groupBy(F.col("source").alias("_s")).agg(
        F.coalesce(F.max(F.when(F.col("middle") <= F.col("rest"), F.col("draw"))), F.min(bucket)).alias("last")
    )
    return text.stored(
        filled.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "whole", F.coalesce("last", F.lit("")).alias("last")),
        "mix-plan",
    )


def _few(table: DataFrame) -> bool:
    return table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES


def take(docs: DataFrame, planned: DataFrame) -> DataFrame:
    """``docs`` (source, draw, ...) with source_size, target and ``times``, how often each document is taken."""
    planned = planned.withColumnRenamed("source", "_s")
    joined = docs.join(F.broadcast(planned) if _few(planned) else planned, F.col("source").eqNullSafe(F.col("_s")))
    return joined.withColumn("times", F.col("whole") + (F.col("draw") <= F.col("last")).cast("long")).drop("_s", "whole", "last")


def mix_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Every document with its size in words, its source's size and target, and the words the mix takes of it.

    Null or empty texts have size 0 and take nothing. A null source is a source, after all others. A null doc_id draws as an
    empty one. Rows equal in doc_id and text draw alike, so they are taken equally often. Other columns are not read; an empty
    table gives no rows. Texts are read once, into one narrow stored row per document.
    """
    narrow = docs.select("doc_id", "source", F.size(text.words(F.col("text"))).cast("long").alias("size"), draw(seed).alias("draw"))
    narrow = text.stored(narrow, "mix-rows")
    taken = take(narrow, plan(narrow, seed=seed))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mix_stage(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the columns of ``docs``."""
    drawn = docs.select(text.row_of(docs), "source", draw(seed).alias("draw"), F.size(text.words(F.col("text"))).cast("long").alias("size"))
    taken = take(drawn.drop("size"), plan(text.stored(drawn.drop("_row"), "mix-rows"), seed=seed)).where("times > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("_row.*")


def op6_water_filling(spark, sf_dir: str) -> DataFrame:
    return mix_documents(text.load(spark, sf_dir, "documents"))


OP6_SQL = r"""WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight FROM d GROUP BY source),
fill AS (SELECT 0 AS k, (SELECT sum(source_size) FROM s) * 15e-1 / (SELECT sum(weight) FROM s) AS level
  UNION ALL
  SELECT k + 1, ((SELECT sum(source_size) FROM s) * 15e-1
      - (SELECT coalesce(sum(source_size * 2e0), 0) FROM s WHERE weight * level > source_size * 2e0)) /
      nullif((SELECT sum(weight) FROM s WHERE NOT weight * level > source_size * 2e0), 0)
  FROM fill WHERE level IS NOT NULL AND k < 100),
top AS (SELECT max(level) AS level, bool_or(level IS NULL) AS every FROM fill),
t AS (SELECT source, source_size, CASE WHEN every OR weight * level > source_size * 2e0 THEN source_size * 2e0 ELSE weight * level END AS target FROM s, top),
r AS (SELECT *, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT) AS whole FROM t),
o AS (SELECT d.doc_id, d.size, d.source, d.draw, r.source_size, r.target, r.whole, greatest(r.target - r.whole * r.source_size, 0e0) AS rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY draw) AS upto FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, size * (whole + CASE WHEN rest > 0 AND upto - size / 2e0 <= rest THEN 1 ELSE 0 END) AS taken FROM o"""
