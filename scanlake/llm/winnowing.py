"""Document fingerprints by winnowing: hashed word grams, the minimum of each window, rightmost on ties, with places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.llm import text

#: Words of a gram, and grams of a window: any common run of GRAM + WINDOW - 1 words is seen in both texts.
GRAM, WINDOW = 4, 8
#: Bits that hold a gram's place; texts have fewer than 2**30 words (a string has less than 2**31 bytes).
PLACE_BITS = 30
_PLACES = (1 << PLACE_BITS) - 1
#: doc_id values of one slice of the order by doc_id.
SLICE = 1024
#: Most slices whose first documents are sent to every executor (40 bytes each); more are joined by a shuffle.
BROADCAST_SLICES = 200_000


def select_grams(words: Column) -> Column:
    """Array of (pos, hash): the grams that winnowing selects, by place; pos counts words from 0.

    Grams are compared by the high bits of their hash, then by place, later ones first: the low bits of the compared value
    hold the place counted down. A text of fewer words than a gram has one gram of them all; fewer grams than a window
    are one window. No words, no grams.
    """

    def from_words(w: Column) -> Column:
        starts = F.slice(w, 1, F.when(F.size(w) > 0, F.greatest(F.size(w) - (GRAM - 1), F.lit(1))).otherwise(0))
        return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, GRAM)]))

    def from_hashes(h: Column) -> Column:
        high, low = F.lit(~_PLACES).cast("long"), F.lit(_PLACES)
        packed = F.transform(h, lambda x, i: x.bitwiseAND(high).bitwiseOR((low - i).cast("long")))

        def minima(v: Column) -> Column:
            windows = F.slice(v, 1, F.when(F.size(v) > 0, F.greatest(F.size(v) - (WINDOW - 1), F.lit(1))).otherwise(0))
            return F.array_distinct(F.transform(windows, lambda x, i: F.array_min(F.slice(v, i + 1, WINDOW))))

        def place(v: Column) -> Column:
            return (low - v.bitwiseAND(low.cast("long"))).cast("int")

        return F.transform(text.let(packed, minima), lambda v: F.struct(place(v).alias("pos"), F.get(h, place(v)).alias("hash")))

    return text.let(text.let(words, from_words), from_hashes)


def as_text(grams: Column) -> Column:
    """``pos:hash`` of each selected gram, hash in hex, joined by spaces."""
    return F.array_join(F.transform(grams, lambda g: F.concat(g["pos"].cast("string"), F.lit(":"), F.lower(F.hex(g["hash"])))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of distinct hashes that both have (0 to 1); two texts without words are alike, one without is unlike the other."""
    both, every = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(both / every)


def in_slices(docs: DataFrame) -> tuple[DataFrame, object]:
    """``docs`` (doc_id, text) such that, in the window returned, each row is followed by the next document in ascending doc_id.

    The last document's next is the first. Rows with ``copy`` only serve as next ones. The order is cut into slices of ``SLICE`` ids. The first document of each slice is also sent to the slice before it, so one
    shuffle of the texts gives each slice all it needs; which slice that is comes from the ids alone. Null ids come first, in slices
    of their own by the hash of their text; rows with one id are ordered by that hash, and equal rows are told apart arbitrarily.
    """
    key = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63)).cast("long")).alias("id"), F.xxhash64("text").alias("h")).alias("key")
    keyed = docs.select(key, "doc_id", "text")
    by_hash = F.lit(-(2**62)).cast("long") + F.shiftright(F.col("key.h"), 54)
    slice_of = F.when(F.col("doc_id").isNull(), by_hash).otherwise(F.floor(F.col("doc_id") / SLICE).cast("long"))
    keyed = keyed.withColumn("slice", slice_of)
    firsts = text.stored(keyed.groupBy("slice").agg(F.min("key").alias("key")), "slice-firsts")
    # the slices in order, each with the one before it; range partitions with the last row of the one before
    parts = firsts.repartitionByRange(32, "slice").withColumn("part", F.spark_partition_id())
    parts = text.stored(parts, "slice-order")
    edges = parts.groupBy("part").agg(F.max("slice").alias("top"))
    edges = edges.select("part", F.lag("top").over(Window.orderBy("part")).alias("carried"))  # at most 32 rows
    inside = F.lag("slice").over(Window.partitionBy("part").orderBy("slice"))
    before = parts.withColumn("to", inside).join(F.broadcast(edges), "part").select("slice", "key", F.coalesce("to", "carried").alias("to"))
    last = parts.agg(F.max("slice")).first()[0]
    before = before.select("key", F.coalesce("to", F.lit(last).cast("long")).alias("to"), F.col("to").isNull().alias("around"))
    few = before.limit(BROADCAST_SLICES + 1).count() <= BROADCAST_SLICES
    sent = keyed.join(F.broadcast(before) if few else before, "key").dropDuplicates(["key"]).select("key", "doc_id", "text", F.col("to").alias("slice"), "around", F.lit(True).alias("copy"))
    every = keyed.select("key", "doc_id", "text", "slice", F.lit(False).alias("around"), F.lit(False).alias("copy")).unionByName(sent)
    order = Window.partitionBy("slice").orderBy("around", "key", "copy")
    return every, order


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, in which the start of the next document replaces the last half.

    Null texts count as empty: no grams, fingerprint ``''``. A table of one row is its own next. An empty table gives no rows.
    Only doc_id and text are read.
    """
    every, order = in_slices(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    every = every.repartition("slice").withColumn("grams", select_grams(text.words(F.col("text"))))
    every = every.withColumn("next", F.lead(F.struct("text", F.col("grams.hash").alias("hashes"))).over(order)).where("NOT copy")
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 2).cast("int")), F.substring(F.col("next.text"), F.lit(1), F.floor(n / 2).cast("int")))
    rows = every.select("doc_id", n.cast("long").alias("n_chars"), "grams", edited.alias("edited"), F.col("next.hashes").alias("next_hashes"))
    rows = rows.withColumn("edited_grams", select_grams(text.words(F.col("edited"))))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("grams")).alias("fingerprint"), as_text(F.col("edited_grams")).alias("edited_fingerprint"),
        likeness(F.col("grams.hash"), F.col("edited_grams.hash")).alias("near_edited"), likeness(F.col("grams.hash"), F.col("next_hashes")).alias("near_next"),
    )


def op9_winnowing(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(text.load(spark, sf_dir, "documents"))
