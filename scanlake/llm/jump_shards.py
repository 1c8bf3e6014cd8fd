"""Sharding by jump consistent hashing: stable keys to shards without a ring table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm import text

#: Multiplier of the generator in the published algorithm.
MULTIPLIER = 2862933555777941757
_LOW, _HIGH = MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32
#: Parts of a shard whose rows are numbered apart, so that no task sorts a whole shard.
BUCKETS = 1024


def _step(a: Column, x: Column) -> Column:
    """One jump. The 64-bit key is held as two halves, since SQL arithmetic does not wrap around."""
    lo, hi = a["lo"], a["hi"]
    full, half = F.lit(0xFFFFFFFF).cast("long"), F.lit(0xFFFF).cast("long")

    def product(v: Column) -> tuple[Column, Column]:
        """v * _LOW as (part below 2**49, rest in units of 2**32), v below 2**32."""
        upper = F.shiftright(v, 16) * F.lit(_LOW)
        return v.bitwiseAND(half) * F.lit(_LOW) + F.shiftleft(upper.bitwiseAND(half), 16), F.shiftright(upper, 16)

    below, above = product(lo)
    below = below + F.lit(1)
    new_hi = (F.shiftright(below, 32) + above + product(hi)[0] + lo * F.lit(_HIGH)).bitwiseAND(full)

    def jump(h: Column) -> Column:
        far = (a["j"] + 1) * (F.lit(2147483648.0) / (F.shiftright(h, 1) + 1))
        return F.struct(h.alias("hi"), below.bitwiseAND(full).alias("lo"), a["j"].alias("b"), F.floor(far).cast("long").alias("j"))

    return text.let(new_hi, jump)


def jump_hash(key: Column, shards: int) -> Column:
    """Struct (b, j): the shard of a 64-bit key, and the next place it would jump to (at least ``shards``).

    With n + 1 shards a key moves only if its j is n, and then to shard n. A null key counts as 0.
    """
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    full = F.lit(0xFFFFFFFF).cast("long")
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(full).alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j")
    )
    # each jump goes at least one ahead, so as many steps as shards always suffice
    done = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, lambda a, x: F.when(a["j"] < shards, _step(a, x)).otherwise(a))
    return text.let(done, lambda d: F.struct(d["b"].cast("int").alias("b"), d["j"].alias("j")))


def assign(docs: DataFrame, shards: int, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``shard`` and ``grown_shard`` (the shard when one more is appended).

    Key and shard count alone decide. Null keys go where key 0 goes. Row-wise: no shuffle, all other columns stay.
    """
    at = docs.withColumn("_at", jump_hash(F.col(key), shards))
    return at.withColumns({
        "shard": F.col("_at.b"), "grown_shard": F.when(F.col("_at.j") == shards, F.lit(shards)).otherwise(F.col("_at.b")),
    }).drop("_at")


def number(rows: DataFrame, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Gapless ``slot`` from 0 within each shard.

    Rows of a shard are dealt into hash buckets of ``order``, numbered there, and moved up by the row counts of the buckets
    before: one task never sorts a whole shard. Rows equal in all of ``order`` are told apart arbitrarily.
    """
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy(*order))
    numbered = rows.withColumn("_inside", inside).join(sizes, ["shard", "_bucket"])
    return numbered.withColumn("slot", F.col("_before") + F.col("_inside") - 1).drop("_bucket", "_inside", "_before")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Every document's shard, slot and shard after growth, with its size in bytes and the checksum of its text.

    Null or empty texts: size 8, checksum 0. Null doc_id: the place of key 0. Repeated rows: one slot each. Other columns are
    not read; an empty table gives no rows. Texts are read once; what is stored and sorted is one narrow row per document.
    """
    narrow = docs.select(
        "doc_id", (text.byte_size(F.col("text")) + 8).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    )
    rows = number(text.stored(assign(narrow, shards), "shards"), ["doc_id", "text_crc32"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_jump_shards(spark, sf_dir: str) -> DataFrame:
    return shard_documents(text.load(spark, sf_dir, "documents"))
