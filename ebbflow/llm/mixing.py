"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations only.

1. Targets. Each source asks for its weight's share of all words and gets at most ``cap`` times its own words; what is
   left over is shared again by weight. With sources in order of words/weight the common level has a closed form: the
   level offered to source i is (all words - caps before i) / (weights from i on), and the final level is the largest.
2. Blocks. A source's documents are shuffled by a hash and laid end to end; the stream is cut into blocks of
   ``block_words`` words (the last is shorter). Running sums are taken within hash buckets and carried over buckets, so
   a source with most of the rows is spread over many tasks.
3. Schedule. Slot n lies at the golden-ratio point frac(n * 0.618...). The points fall into the sources' cumulative
   shares, so every prefix of the schedule holds the shares but for a few slots. Slots are ranked per source; slot r
   takes block r mod (number of blocks), the last slot only what the target still needs. A source that the points
   left short of a few slots gets them at the schedule's end.

A source takes its rounded target exactly, and a document is taken at most ceil(cap) times.

Defined results: a null source is a source of its own, last in order; a null text has no words and takes none; equal
rows stay separate rows; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbflow.llm import support

#: 2**32 divided by the golden ratio, and the range of the points.
GOLDEN, POINTS = 2654435769, 1 << 32
CELLS = 4096


def point(n: Column) -> Column:
    """The golden-ratio point of slot ``n``, n * GOLDEN mod 2**32, in products that a long holds."""
    n = n % POINTS
    high, low = F.floor(n / (1 << 16)), n % (1 << 16)
    return (high * GOLDEN % POINTS * (1 << 16) % POINTS + low * GOLDEN % POINTS) % POINTS


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, size) to one row a source: sid (rank by code point, null last), source_size, target."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    )
    ceiling = F.col("source_size") * cap
    order = Window.orderBy(ceiling / F.col("weight"), "sid")
    every = Window.partitionBy()
    offered = (F.sum("source_size").over(every) - (F.sum(ceiling).over(order.rowsBetween(Window.unboundedPreceding, 0)) - ceiling)) / (
        F.sum("weight").over(every) - (F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("weight"))
    )
    return (
        ranked.withColumn("offered", offered.cast("double"))
        .withColumn("target", F.least(ceiling.cast("double"), F.max("offered").over(every) * F.col("weight")))
        .select("source", "sid", "source_size", "target")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block_words: int = 1024, seed: int = 17) -> DataFrame:
    """One row a document: its id, size, source_size, target and the words taken from it (repeats counted)."""
    spark = docs.sparkSession
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(support.WORD_PATTERN)), F.lit(0)).cast("bigint").alias("size"),
        # Rows without id, or with one id, are spread by their text.
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"),
    )
    sized = support.checkpoint(sized)
    buckets = support.power_of_two(math.sqrt(sized.count()))
    sized = sized.withColumn("bucket", F.pmod("h", F.lit(buckets)))

    per_source = targets(sized, weights, cap)
    block = F.lit(block_words)
    wanted = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * cap)
    per_source = (
        per_source.withColumn("wanted", F.when(F.col("source_size") > 0, wanted).otherwise(0).cast("bigint"))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block)).cast("bigint"))
        .withColumn("rounds", F.when(F.col("source_size") > 0, F.expr("wanted div source_size")).otherwise(0).cast("bigint"))
        .withColumn("slots", (F.col("rounds") * F.col("blocks") + F.ceil((F.col("wanted") - F.col("rounds") * F.col("source_size")) / block)).cast("bigint"))
        .withColumn("to", F.sum("slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("since", F.col("to") - F.col("slots"))
    )
    per_source = support.checkpoint(per_source)
    total = per_source.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]

    taken_blocks = _schedule(spark, per_source, total, block_words)
    pieces = _pieces(sized, per_source, block_words)
    part = (
        F.coalesce(F.col("full"), F.lit(0)) * (F.col("hi") - F.col("lo"))
        + F.greatest(F.lit(0), F.least(F.col("hi"), F.coalesce(F.col("cut"), F.lit(0))) - F.col("lo"))
    )
    return (
        pieces.join(taken_blocks, ["sid", "block"], "left")
        .groupBy("sid", "part", "nth", "doc_id", "size", "source_size", "target")
        .agg(F.coalesce(F.sum(part), F.lit(0)).cast("bigint").alias("taken"))
        .select(F.col("doc_id").alias(id_col), "size", "source_size", "target", "taken")
    )


def _pieces(sized: DataFrame, per_source: DataFrame, block_words: int) -> DataFrame:
    """Every document's parts by block: positions lo to hi within the block; wordless documents have no block."""
    in_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    offsets = in_bucket.join(per_source.select("source", "sid", "source_size", "target"), in_bucket["source"].eqNullSafe(per_source["source"])).select(
        in_bucket["source"].alias("of"),
        F.col("bucket").alias("part"),
        "sid",
        "source_size",
        "target",
        (F.sum("words").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).alias("before"),
    )
    order = Window.partitionBy("sid", "part").orderBy("h", "doc_id", "size")
    at = sized.join(offsets, sized["source"].eqNullSafe(offsets["of"]) & (sized["bucket"] == offsets["part"])).select(
        "sid",
        "part",
        "doc_id",
        "size",
        "source_size",
        "target",
        F.row_number().over(order).alias("nth"),
        (F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
    )
    spans = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")))
    return (
        at.withColumn("block", F.explode_outer(spans))
        .withColumn("lo", F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0)))
        .withColumn("hi", F.least(F.col("start") + F.col("size") - F.col("block") * block_words, F.lit(block_words)))
    )


def _schedule(spark: SparkSession, per_source: DataFrame, total: int, block_words: int) -> DataFrame:
    """How often the schedule takes each block: full takes, and words of the one that is cut short."""
    width = max(1, math.ceil(total / CELLS))
    share = ("sid", "slots", "source_size", "wanted", "blocks")
    shares = per_source.filter("slots > 0").select(*share, "since", "to")
    cells = shares.select("*", F.explode(F.sequence(F.expr(f"since div {width}"), F.expr(f"(to - 1) div {width}"))).alias("cell"))
    place = F.floor(point(F.col("n")) / float(POINTS) * total).cast("bigint")
    points = spark.range(total).withColumnRenamed("id", "n").withColumn("place", place).withColumn("cell", F.expr(f"place div {width}"))
    drawn = points.join(cells, (points["cell"] == cells["cell"]) & (F.col("place") >= F.col("since")) & (F.col("place") < F.col("to"))).select("n", *share)
    drawn = drawn.withColumn("chunk", F.expr(f"n div {support.power_of_two(math.sqrt(total))}"))

    ranked = drawn.withColumn("r", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("n")))
    counts = drawn.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("drawn"))
    before = counts.withColumn("before", F.sum("drawn").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("drawn"))
    ranked = ranked.join(before.select("sid", "chunk", "before"), ["sid", "chunk"]).select(*share, (F.col("before") + F.col("r") - 1).alias("rank"))
    short = (
        shares.join(counts.groupBy("sid").agg(F.sum("drawn").alias("drawn")), "sid", "left")
        .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        .filter("drawn < slots")
        .select(*share, F.explode(F.sequence("drawn", F.col("slots") - 1)).alias("rank"))
    )
    slots = ranked.union(short).filter("rank < slots")
    slots = slots.withColumn("block", F.col("rank") % F.col("blocks"))
    length = F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words)
    left = F.col("wanted") - (F.expr("rank div blocks") * F.col("source_size") + F.col("block") * block_words)
    return (
        slots.groupBy("sid", "block")
        .agg(F.sum((left >= length).cast("bigint")).alias("full"), F.coalesce(F.sum(F.when(left < length, left)), F.lit(0)).alias("cut"))
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1, repeating."""
    return mix(support.table(spark, sf_dir, "documents"))
