"""Order: filters by checkpoint, late changes, operators' commands, dead letters, global order and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.functions.model import ReplicaSpec, Strategy, position

COMMANDS = ("skip", "apply")


def not_stale(rows: DataFrame, checkpoint: Column) -> DataFrame:
    """Changes or heartbeats at or beyond the checkpoint; those before it were applied already."""
    return rows.filter(position() >= checkpoint)


def below(changes: DataFrame, at: Column) -> DataFrame:
    return changes.filter(position() < at)


def pending(changes: DataFrame, at: Column) -> DataFrame:
    return changes.filter(position() >= at)


SAMPLE = 8192


def _ranges(rows: DataFrame, names: tuple[str, ...]) -> Column:
    """The number of a row's range, where ranges follow the order of ``names`` and hold about equally many rows.

    Bounds are literals taken once from a sample of ``SAMPLE`` rows, so every plan that uses the column cuts the rows alike.
    Only the sample reaches the driver.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = rows.select(*names).orderBy(F.xxhash64(*names)).limit(SAMPLE).collect()
    drawn = sorted({tuple(r) for r in some})
    step = max(1, -(-len(drawn) // parts))
    kinds = [rows.schema[n].dataType.simpleString() for n in names]
    at = F.struct(*(F.col(n) for n in names))

    def bound(values: tuple) -> Column:
        return F.struct(*(F.lit(str(v)).cast(k).alias(n) for n, k, v in zip(names, kinds, values)))

    def cut(bounds: list[tuple], first: int) -> Column:
        if not bounds:
            return F.lit(first)
        half = len(bounds) // 2
        return F.when(at < bound(bounds[half]), cut(bounds[:half], first)).otherwise(cut(bounds[half + 1 :], first + half + 1))

    return cut(drawn[step::step], 0)


def out_of_order(log: DataFrame, seen: dict[tuple[int, int], tuple[int, int]] | None = None) -> DataFrame:
    """Changes that lie before the last heartbeat which their partition had sent earlier; adds ``last_hb``.

    The last heartbeat counts here, not the greatest. ``seen`` holds the last heartbeat of each (stream, partition) from before
    the log. A partition's messages are cut into ranges of offsets, and a range's last heartbeat is carried to the ranges after it, so
    a partition is not one task.
    """
    part = ("stream_id", "partition")
    cut = log.filter(F.col("stream_id").isNotNull()).withColumn("range", _ranges(log.filter(F.col("stream_id").isNotNull()), (*part, "offset")))
    beats = cut.filter("kind = 'resolved'").groupBy(*part, "range").agg(F.max_by(position(), "offset").alias("hb"))
    start = log.sparkSession.createDataFrame([(s, p, -1, str(x), str(y)) for (s, p), (x, y) in (seen or {}).items()], "stream_id int, partition bigint, range int, step string, tx string")
    known = beats.unionByName(start.select(*part, "range", position("step", "tx").alias("hb")))
    # A row a range in which a partition has messages: what the partition had sent before it.
    met = cut.select(*part, "range").distinct().join(known, [*part, "range"], "full_outer")
    before = Window.partitionBy(*part).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = met.select(*(F.col(c).alias(f"of_{c}") for c in (*part, "range")), F.last("hb", ignorenulls=True).over(before).alias("carried"))
    earlier = Window.partitionBy(*part, "range").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    here = cut.withColumn("own_hb", F.last(F.when(F.col("kind") == "resolved", position()), ignorenulls=True).over(earlier))
    joined = here.join(F.broadcast(carried), (F.col("stream_id") == F.col("of_stream_id")) & (F.col("partition") == F.col("of_partition")) & (F.col("range") == F.col("of_range")), "left")
    found = joined.withColumn("last_hb", F.coalesce("own_hb", "carried")).drop("range", "own_hb", "carried", *(f"of_{c}" for c in (*part, "range")))
    return found.filter(F.col("kind").isin("update", "erase") & (position() < F.col("last_hb")))


def decisions(commands: DataFrame, instance: str) -> DataFrame:
    """(topic, key_json, step, tx_id, action): an instance's last valid command about each change."""
    own = commands.filter((F.col("instance") == instance) & F.col("action").isin(*COMMANDS))
    return own.groupBy("topic", "key_json", "step", "tx_id").agg(F.max_by("action", "offset").alias("action"))


def strategy(replica: ReplicaSpec) -> Column:
    """What a row's stream does with problems: dead_letter or stop."""
    found = F.lit("stop")
    for s in replica.streams:
        if s.strategy is Strategy.CONTINUE:
            found = F.when(F.col("stream_id") == s.stream_id, "dead_letter").otherwise(found)
    return found


def resolve(late: DataFrame, commands: DataFrame, replica: ReplicaSpec) -> DataFrame:
    """Adds ``decision`` to late changes: apply, skip, or what the stream's strategy says (dead_letter or stop)."""
    known = decisions(commands, replica.instance).select(*(F.col(c).alias(f"of_{c}") for c in ("topic", "key_json", "step", "tx_id")), "action")
    same = [late[c] == known[f"of_{c}"] for c in ("topic", "key_json", "step", "tx_id")]
    joined = late.join(known, same[0] & same[1] & same[2] & same[3], "left")
    return joined.withColumn("decision", F.coalesce("action", strategy(replica))).drop("action", *(f"of_{c}" for c in ("topic", "key_json", "step", "tx_id")))


def late_text() -> Column:
    """A late change for people to read."""
    return F.format_string("late %s on %s/%d: key %s, position [%s, %s], last heartbeat [%s, %s]", "kind", "topic", "partition", "key_json", F.col("step").cast("string"), F.col("tx_id").cast("string"), F.col("last_hb.step").cast("string"), F.col("last_hb.tx_id").cast("string"))


def dead_letters(late: DataFrame, replica: ReplicaSpec) -> DataFrame:
    """Late changes as diagnostic rows with a rendered text."""
    return late.select(F.lit(replica.instance).alias("instance"), "topic", "stream_id", "partition", "offset", "key_json", "step", "tx_id", F.col("last_hb.step").alias("hb_step"), F.col("last_hb.tx_id").alias("hb_tx_id"), late_text().alias("text"))


def passing(log: DataFrame, stream_id: Column, since: Column, line: Column) -> DataFrame:
    """(stream_id, partition, passed): where each partition of a stream first sends a heartbeat beyond ``line``."""
    beyond = (F.col("kind") == "resolved") & (F.col("stream_id") == stream_id) & (F.col("offset") >= since) & (position() > line)
    return log.filter(beyond).groupBy("stream_id", "partition").agg(F.min("offset").alias("passed"))


def stop_diagnostics(log: DataFrame, trigger: DataFrame) -> DataFrame:
    """After a stop: late changes of the trigger's stream that each partition sends before it passes the trigger.

    ``trigger`` is one row with stream_id, offset and last_hb of the change that stopped the replica. A partition is
    read until its first heartbeat beyond the trigger's.
    """
    one = F.broadcast(trigger.select(F.col("stream_id").alias("of"), F.col("offset").alias("since"), F.col("last_hb").alias("line")))
    here = log.join(one, log["stream_id"] == one["of"]).filter("offset >= since")
    ends = passing(here, F.col("of"), F.col("since"), F.col("line")).select(F.col("stream_id").alias("end_of"), F.col("partition").alias("end_part"), "passed")
    open_ = here.filter("kind in ('update', 'erase')").filter(position() < F.col("line"))
    open_ = open_.join(F.broadcast(ends), (F.col("stream_id") == F.col("end_of")) & (F.col("partition") == F.col("end_part")), "left").filter("passed is null or offset <= passed")
    return open_.drop("of", "since", "line", "end_of", "end_part", "passed")


ORDER = ("step", "tx_id", "offset")


def global_order(changes: DataFrame, name: str = "place", ties: tuple[str, ...] = ("stream_id", "partition")) -> DataFrame:
    """Numbers the changes from 1 by step, tx_id and arrival; ``ties`` decide between equal ones.

    Ranks are taken within ranges of positions and carried over the ranges, so no task holds all rows. The changes are
    read three times (sample, counts, ranks): pass a written table.
    """
    order = (*ORDER, *(c for c in ties if c in changes.columns))
    ranged = changes.withColumn("range", _ranges(changes, order))
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("there"))
    before = counts.select(F.col("range").alias("of"), (F.sum("there").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("there")).alias("before"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.withColumn("nth", within).join(F.broadcast(before), F.col("range") == F.col("of")).withColumn(name, F.col("before") + F.col("nth")).drop("range", "of", "nth", "before")


def pop(changes: DataFrame, n: int, at: Column | None = None) -> DataFrame:
    """The first ``n`` changes in order, of those before ``at`` if given."""
    rows = changes if at is None else below(changes, at)
    return rows.orderBy("step", "tx_id", "offset").limit(n)


def chunks(changes: DataFrame, size: int = 1000) -> DataFrame:
    """Adds ``chunk`` (from 0): successive runs of ``size`` changes in order."""
    return global_order(changes).withColumn("chunk", F.floor((F.col("place") - 1) / size).cast("bigint"))


def without_blocked(changes: DataFrame, blocked: DataFrame) -> DataFrame:
    """Changes whose ``filter_key`` isn't in the set; the optimiser broadcasts the set if it is small."""
    return changes.join(blocked.select(F.col("filter_key").alias("blocked_key")), F.col("filter_key") == F.col("blocked_key"), "left_anti")


def with_blocked(blocked: DataFrame, new: DataFrame) -> DataFrame:
    """The set with more keys."""
    return blocked.unionByName(new.select(*blocked.columns)).dropDuplicates()


def lag_ms(step: Column, now_ms: Column) -> Column:
    """How far a position lies behind; never negative, null for the zero position."""
    return F.when(step > 0, F.greatest(F.lit(0).cast("bigint"), now_ms - step.cast("bigint")))
