"""Every operator as a query over the deterministic feeds; ``oracles`` holds the same in SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.functions import convert, parse
from ebbflow.functions.model import ColumnSpec, ReplicationHalted, Strategy, TableSpec, position
from ebbflow.operators import apply, fold, order, quorum, state
from ebbflow.plans import replay
from ebbflow.plans.store import Store
from ebbflow.shared import checkpoint, shared_folder
from ebbflow.sources import feeds
from ebbflow.streaming.runner import Replicator

E, OL = feeds.EVENTS_FEED, feeds.SALES_FEED
NARROW = TableSpec("narrow", ("user_id",), (ColumnSpec("user_id", "Int64", False), ColumnSpec("last_type", "Utf8"), ColumnSpec("last_value", "Int16")))
#: 2024-02-01 in milliseconds.
NOW_MS = 1_706_745_600_000
CHUNK, POP, MIDDLE = 1000, 100, 10

BAD = ('{"foo":1}', "not json", '{"update":{"a":1},"erase":{},"key":[1],"ts":[1,2]}', '{"resolved":[1]}', '{"update":{"a":1},"key":[1],"ts":[1]}')


def _e(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse(feeds.events(spark, d), E)


def _ol(spark: SparkSession, d: str) -> DataFrame:
    return parse.parse(feeds.sales(spark, d), OL)


def _last(log: DataFrame) -> int:
    return log.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]


def _plan(spark: SparkSession, d: str) -> DataFrame:
    log = _e(spark, d)
    return quorum.schedule(parse.heartbeats(log), E, _last(log))


def _at(name: str, step: str = "step", tx: str = "tx_id") -> list:
    return [F.col(f"{name}.step").cast("bigint").alias(step), F.col(f"{name}.tx_id").cast("bigint").alias(tx)]


def _pos() -> list:
    return [F.col("step").cast("bigint").alias("step"), F.col("tx_id").cast("bigint").alias("tx_id")]


def changelog_scan(spark, d):
    return _e(spark, d).select("topic", "partition", "offset", "kind")


def topic_layout(spark, d):
    return quorum.observed_layout(feeds.events(spark, d).union(feeds.sales(spark, d)))


def classify_messages(spark, d):
    side = spark.range(len(BAD)).select(F.lit("events_cdc").alias("topic"), F.lit(0).cast("bigint").alias("partition"), (-F.col("id")).alias("offset"), F.lit(0).cast("bigint").alias("batch"), F.get(F.array(*map(F.lit, BAD)), F.col("id").cast("int")).alias("value"))
    return parse.parse(feeds.events(spark, d).union(side), E).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def parse_changes(spark, d):
    return parse.changes(_e(spark, d)).select("offset", *_pos(), "kind", F.get("key", F.lit(0)).cast("bigint").alias("user_id"))


def image_select(spark, d):
    return parse.changes(_e(spark, d)).filter("kind = 'update'").select("offset", parse.column_set().alias("column_set"))


def parse_heartbeats(spark, d):
    return parse.heartbeats(_e(spark, d)).select("batch", "partition", *_pos())


def _tagged(spark, d):
    log = parse.changes(_ol(spark, d))
    return log.withColumn("table", F.when(F.col("stream_id") == 1, "orders").otherwise("lines"))


def route_tables(spark, d):
    parts = parse.route(_ol(spark, d), OL)
    both = [rows.select(F.lit(name).alias("table"), "kind") for name, rows in parts.items()]
    return both[0].union(both[1]).groupBy("table", "kind").agg(F.count(F.lit(1)).alias("n"))


def key_text(spark, d):
    return _tagged(spark, d).groupBy("table", "key_json").agg(F.count(F.lit(1)).alias("n"))


def filter_key(spark, d):
    return _tagged(spark, d).select("table", F.hex(parse.filter_key(F.col("table"))).alias("filter_key")).groupBy("table", "filter_key").agg(F.count(F.lit(1)).alias("n"))


def typed_conversion(spark, d):
    return parse.changes(_e(spark, d)).filter("kind = 'update'").select(*convert.row(feeds.USERS, ("offset",)))


def row_build(spark, d):
    return parse.route(_ol(spark, d), OL)["lines"].filter("kind = 'update'").select(*convert.row(feeds.LINES, ("offset",)))


def schema_violations(spark, d):
    return convert.violations(parse.changes(_e(spark, d)), NARROW).select("offset", "violation")


def column_sets(spark, d):
    return fold.column_sets(parse.changes(_e(spark, d)))


def _with_checkpoint(spark, d, rows):
    plan = _plan(spark, d).select(F.col("batch").alias("of"), "checkpoint")
    return order.not_stale(rows.join(plan, F.col("batch") == F.col("of")), F.col("checkpoint"))


def drop_stale(spark, d):
    return _with_checkpoint(spark, d, parse.changes(_e(spark, d))).select("offset")


def drop_stale_heartbeats(spark, d):
    return _with_checkpoint(spark, d, parse.heartbeats(_e(spark, d))).select("batch", "partition")


def _blocked(spark, d, step, instance="main"):
    keys = spark.read.parquet(f"{d}/orders.parquet").filter(F.col("o_orderkey") % step == 0)
    return keys.select(F.lit(instance).alias("instance"), F.array(F.col("o_orderkey").cast("string")).alias("key")).select("instance", parse.filter_key("orders").alias("filter_key"))


def blocked_keys_scan(spark, d):
    stored = _blocked(spark, d, 7).union(_blocked(spark, d, 5, "other"))
    return stored.filter("instance = 'main'").select(F.hex("filter_key").alias("filter_key"))


def blocked_keys_upsert(spark, d):
    return order.with_blocked(_blocked(spark, d, 7), _blocked(spark, d, 11)).select("instance", F.hex("filter_key").alias("filter_key"))


def key_filter(spark, d):
    rows = _tagged(spark, d).filter("stream_id = 1").withColumn("filter_key", parse.filter_key("orders"))
    return order.without_blocked(rows, _blocked(spark, d, 7)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get("key", F.lit(0)).cast("bigint")).alias("keys"))


def _late(spark, d):
    return order.out_of_order(checkpoint(_e(spark, d).drop("value")))


def out_of_order(spark, d):
    return _late(spark, d).select("offset", *_pos(), *_at("last_hb", "hb_step", "hb_tx_id"))


def _commands(spark, d):
    late = parse.changes(_e(spark, d)).filter("tx_id % 97 = 0")
    turn = (F.floor(F.col("tx_id") / 97) % 3).cast("int")
    first = late.select(F.lit("main").alias("instance"), "topic", "key_json", "step", "tx_id", F.element_at(F.array(F.lit("skip"), F.lit("apply"), F.lit("wait")), turn + 1).alias("action"), F.col("tx_id").cast("bigint").alias("offset"))
    again = late.filter("tx_id % 2 = 0").select(F.lit("main").alias("instance"), "topic", "key_json", "step", "tx_id", F.lit("apply").alias("action"), (F.col("tx_id") + 1_000_000).cast("bigint").alias("offset"))
    return first.union(again)


def command_scan(spark, d):
    return _commands(spark, d).select("topic", "key_json", *_pos(), "action", "offset")


def command_decisions(spark, d):
    return order.decisions(_commands(spark, d), "main").select("topic", "key_json", *_pos(), "action")


def problem_resolution(spark, d):
    return order.resolve(_late(spark, d), _commands(spark, d), E).select("offset", "decision")


def dead_letters(spark, d):
    late = order.resolve(_late(spark, d), _commands(spark, d), E).filter("decision = 'dead_letter'")
    return order.dead_letters(late, E).select("offset", "key_json", *_pos(), F.col("hb_step").cast("bigint").alias("hb_step"), "text")


def stop_diagnostics(spark, d):
    log = checkpoint(_e(spark, d).drop("value"))
    late = order.out_of_order(log)
    return order.stop_diagnostics(log, late.orderBy("offset").limit(1)).select("offset", *_pos())


def last_heartbeat(spark, d):
    return quorum.last_heartbeat(parse.heartbeats(_e(spark, d))).select("stream_id", "partition", *_at("hb"))


def _found(spark, d):
    return quorum.quorum(quorum.last_heartbeat(parse.heartbeats(_e(spark, d))), E.partitions)


def max_heartbeat(spark, d):
    return _found(spark, d).select(*_at("furthest"))


def quorum_ready(spark, d):
    return _found(spark, d).select("heartbeats", "ready")


def quorum_now(spark, d):
    return _found(spark, d).select(*_at("quorum"))


def _sync(spark, d):
    """One row: the furthest heartbeat when all partitions have sent one, and the first quorum beyond it."""
    beats, plan = parse.heartbeats(_e(spark, d)), _plan(spark, d)
    ready = plan.filter("quorum is not null").agg(F.min("batch").alias("ready_batch"))
    furthest = beats.join(F.broadcast(ready), F.col("batch") <= F.col("ready_batch")).agg(F.max(position()).alias("scan_max"))
    return plan.join(F.broadcast(furthest), F.col("quorum") > F.col("scan_max")).agg(F.min_by("scan_max", "batch").alias("scan_max"), F.min_by("quorum", "batch").alias("sync"), F.min("batch").alias("batch"))


def sync_quorum(spark, d):
    return _sync(spark, d).select("batch", *_at("scan_max", "scan_step", "scan_tx"), *_at("sync", "sync_step", "sync_tx"))


def quorum_schedule(spark, d):
    return quorum.advancing(_plan(spark, d)).select("batch", *_at("quorum"))


def missing_heartbeats(spark, d):
    log = _e(spark, d)
    expected = quorum.layout(spark, E).withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(_last(log))).cast("array<bigint>")))
    seen = parse.heartbeats(log).select("stream_id", "partition", "batch")
    return expected.join(seen, ["stream_id", "partition", "batch"], "left_anti").select("batch", "stream_id", "partition")


def ready_changes(spark, d):
    return order.below(parse.changes(_e(spark, d)).join(F.broadcast(_found(spark, d))), F.col("quorum")).select("offset")


def pending_changes(spark, d):
    return order.pending(parse.changes(_e(spark, d)).join(F.broadcast(_found(spark, d))), F.col("quorum")).select("offset")


def _written(spark, d):
    """The changes of the events feed, parsed and written once."""
    return checkpoint(parse.changes(_e(spark, d)).select("stream_id", "partition", "offset", "step", "tx_id", "kind", "key", "cols"))


def global_order(spark, d):
    return order.global_order(_written(spark, d)).select("offset", "place")


def global_order_rows(spark, d):
    """Whole rows next to their place."""
    return order.global_order(_written(spark, d)).select("offset", "place", *_pos(), "kind", F.get("key", F.lit(0)).cast("bigint").alias("user_id"), F.col("cols")["last_type"].alias("last_type"))


def pop_top_n(spark, d):
    return order.pop(parse.changes(_e(spark, d)), POP).select("offset")


def pop_top_n_below(spark, d):
    middle = _plan(spark, d).filter(F.col("batch") == MIDDLE).select("quorum")
    return order.pop(parse.changes(_e(spark, d)).join(F.broadcast(middle)), POP, F.col("quorum")).select("offset")


def initial_scan_chunk(spark, d):
    return order.chunks(_written(spark, d), CHUNK).filter("chunk = 1").select("offset")


def initial_scan_chunks(spark, d):
    return order.chunks(_written(spark, d), CHUNK).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("offset").alias("first_offset"))


def _ready(spark, d):
    rows, _ = replay.placed(_e(spark, d), E)
    return replay.keyed(rows.filter("apply_batch is not null and violation is null"), feeds.USERS)


def net_changes(spark, d):
    return fold.net_changes(_ready(spark, d), ["user_id"])


def net_deletes(spark, d):
    gone = fold.net_changes(_ready(spark, d), ["user_id", "key_json"]).filter("op = 'erase'")
    return gone.select("key_json")


def column_overlay(spark, d):
    return fold.cells(_ready(spark, d), feeds.USERS)


def modification_counts(spark, d):
    rows = _tagged(spark, d).withColumn("filter_key", parse.filter_key(F.col("table")))
    return fold.modification_counts(order.without_blocked(rows, _blocked(spark, d, 7)))


def _base(spark, d):
    return spark.read.parquet(f"{d}/customer.parquet").filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("bigint").alias("user_id"), F.lit("base").alias("last_type"), F.col("c_custkey").cast("bigint").alias("last_value"), F.lit("{}").alias("props"))


def apply_upsert(spark, d):
    updates = parse.changes(_e(spark, d)).filter("kind = 'update'").withColumn("apply_batch", F.lit(0).cast("bigint"))
    return apply.apply_net(_base(spark, d), fold.folded(replay.typed(updates, feeds.USERS), feeds.USERS), feeds.USERS)


def apply_delete(spark, d):
    gone = fold.net_changes(_ready(spark, d), ["user_id"]).filter("op = 'erase'")
    return apply.apply_deletes(_base(spark, d), gone, feeds.USERS)


def multi_table_commit(spark, d):
    done = replay.replay(_ol(spark, d), OL)
    text = lambda *cs: [F.col(c).cast("string").alias(n) for c, n in zip(cs, ("k1", "k2", "c1", "c2", "c3"))]
    orders = done.tables["orders"].withColumn("none", F.lit("")).select(F.lit("orders").alias("table"), *text("o_orderkey", "none", "status", "total", "priority"))
    lines = done.tables["lines"].select(F.lit("lines").alias("table"), *text("l_orderkey", "l_linenumber", "qty", "price", "flag"))
    none = F.lit(None).cast("string")
    mark = done.checkpoint().select(F.lit("checkpoint").alias("table"), F.col("step").cast("string").alias("k1"), F.col("tx_id").cast("string").alias("k2"), none.alias("c1"), none.alias("c2"), none.alias("c3"))
    return orders.union(lines).union(mark)


def replay_run(spark, d):
    return replay.replay(_e(spark, d), E).tables["users"]


def replay_run_exact(spark, d):
    return replay.replay(_e(spark, d), E, {"users": _base(spark, d)}, fold.EXACT).tables["users"]


def replay_on_base(spark, d):
    return replay.replay(_e(spark, d), E, {"users": _base(spark, d)}).tables["users"]


def stage_transition(spark, d):
    """The initial scan applies what lies below the sync position in chunks; then the stage is RUN with that checkpoint."""
    rows = parse.changes(_e(spark, d)).join(F.broadcast(_sync(spark, d).withColumnRenamed("batch", "sync_batch")), F.col("batch") <= F.col("sync_batch"))
    return order.below(rows, F.col("sync")).groupBy("sync").agg(F.count(F.lit(1)).alias("changes")).select(F.lit("RUN").alias("stage"), *_at("sync"), "changes", (F.floor(F.col("changes") / CHUNK) + 1).cast("bigint").alias("chunks"))


def recovery_replay(spark, d):
    """Replays half of the log, then the rest on what the first half left: tables, waiting changes, heartbeats."""
    log = checkpoint(_e(spark, d).drop("value", "error"))
    half = _last(log) // 2
    first = replay.replay(log.filter(F.col("batch") <= half), E, last_batch=half)
    rest = log.filter((F.col("batch") > half) | (F.col("kind") == "resolved"))
    return replay.replay(rest.unionByName(first.pending.select(*log.columns)), E, first.tables).tables["users"]


def _states(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").filter("n_nationkey % 2 = 0")
    bad = F.col("n_nationkey") % 6 == 0
    return n.select(
        F.col("n_name").alias("id"),
        (F.col("n_nationkey") * 10).cast("decimal(20,0)").alias("step_id"),
        F.lit(0).cast("decimal(20,0)").alias("tx_id"),
        F.when(bad, "FATAL_ERROR").otherwise("OK").alias("state"),
        F.lit("RUN").alias("stage"),
        F.when(bad, "late change").alias("last_msg"),
        F.lit("").alias("lock_owner"),
        F.lit(None).cast("timestamp").alias("lock_deadline"),
    )


def _state_columns(rows):
    return rows.select("id", F.col("step_id").cast("bigint").alias("step_id"), F.col("tx_id").cast("bigint").alias("tx_id"), "state", "stage")


def state_init(spark, d):
    return _state_columns(state.init(_states(spark, d), spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("id"))))


def state_lookup(spark, d):
    return _states(spark, d).select("id", state.problem().alias("problem"))


def state_checkpoint(spark, d):
    done = spark.read.parquet(f"{d}/nation.parquet").filter("n_nationkey % 4 = 0").select(F.col("n_name").alias("id"), F.lit(999).cast("decimal(20,0)").alias("step_id"), F.col("n_nationkey").cast("decimal(20,0)").alias("tx_id"), F.lit("RUN").alias("stage"))
    return _state_columns(state.checkpoint(_states(spark, d), done))


def lease_transition(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    asked = n.select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, "me").when(F.col("n_nationkey") % 3 == 1, "you").otherwise("").alias("owner"), F.when(F.col("n_nationkey") % 3 < 2, F.col("n_nationkey").cast("bigint") * 100).alias("deadline"))
    owner, deadline = state.lease(F.col("owner"), F.col("deadline"), F.lit("me"), F.lit(1000).cast("bigint"), F.lit(20).cast("bigint"))
    return asked.select("n_nationkey", owner.alias("owner"), deadline.alias("deadline"))


def replication_lag(spark, d):
    return quorum.advancing(_plan(spark, d)).select("batch", order.lag_ms(F.col("quorum.step"), F.lit(NOW_MS).cast("bigint")).alias("lag_ms"))


def throughput(spark, d):
    """Changes that each batch applies, by second of the feed's time between its checkpoint and its quorum."""
    rows, plan = replay.placed(_e(spark, d), E)
    done = rows.filter("apply_batch is not null").groupBy("apply_batch").agg(F.count(F.lit(1)).alias("changes"))
    seconds = (F.col("quorum.step") - F.col("checkpoint.step")).cast("double") / 1000
    return done.join(quorum.advancing(plan), F.col("batch") == F.col("apply_batch")).select("batch", "changes", (F.col("changes") / seconds).alias("per_second"))


#: Texts that a column of each type accepts and rejects.
SAMPLES = (
    ("Bool", "true", "yes"), ("Int8", "-128", "128"), ("Int16", "300", "40000"), ("Int32", "5", "1.5"), ("Int64", "9", "1e2"), ("Uint8", "255", "256"),
    ("Uint16", "65535", "-1"), ("Uint32", "4294967295", "4294967296"), ("Uint64", "18446744073709551615", "18446744073709551616"), ("Float", "1.5", "x"),
    ("Double", "1000", "NaN"), ("Date", "19000", "d"), ("Timestamp", "2024-01-02T03:04:05.000006Z", "2024-01-02T03:04:05Z"), ("Interval", "7000000", "x"),
    ("String", "aGk=", "%"), ("Uuid", "123E4567-e89b-12d3-a456-426614174000", "123"), ("Utf8", "x", None), ("Yson", "<a>b", None), ("Json", "{}", None),
    ("TzDate", "2024-01-02,UTC", None), ("TzDatetime", "2024-01-02T03:04:05,UTC", None), ("TzTimestamp", "2024-01-02T03:04:05.1,UTC", None),
)


def type_conversions(spark, d):
    """Every type with a text that it accepts and one that it rejects; values as text, intervals in seconds."""
    given = spark.createDataFrame(SAMPLES, "type string, good string, bad string")
    good = bad = F.lit(None).cast("string")
    for name, *_ in SAMPLES:
        shown = lambda v: F.base64(v) if name == "String" else F.unix_micros(v).cast("string") if name == "Timestamp" else (F.unix_micros(F.timestamp_seconds(F.lit(0)) + convert.interval(v)) / 1000000).cast("bigint").cast("string") if name == "Interval" else v.cast("string")  # noqa: B023, E731
        good = F.when(F.col("type") == name, shown(convert.convert(F.col("good"), name))).otherwise(good)
        bad = F.when(F.col("type") == name, convert.convert(F.col("bad"), name).cast("string")).otherwise(bad)
    return given.select("type", good.alias("good"), bad.alias("bad"))


SLICES = 4


def _streamed(spark, d, table, strategy):
    """The feed run through the streaming replica in a few micro-batches: (store, folder of dead letters, why it stopped)."""
    s = replace(E.streams[0], table=table, strategy=strategy)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = checkpoint(feeds.events(spark, d))
    last = _last(rows)
    run = Replicator(store := Store(spark, f"{folder}/store", "main"), replace(E, streams=(s,)), dead_letters=f"{folder}/letters")
    for k in range(SLICES):
        try:
            run(rows.filter(F.expr(f"batch * {SLICES} div {last + 1}") == k), k)
        except ReplicationHalted as why:
            return store, f"{folder}/letters", str(why)
    return store, f"{folder}/letters", run.halted


def _letters(spark, path):
    return spark.read.option("recursiveFileLookup", True).parquet(path).select("offset", "reason", "text")


def stream_late(spark, d):
    """Dead letters of the streaming replica: late changes, also those whose heartbeat came with an earlier micro-batch."""
    return _letters(spark, _streamed(spark, d, feeds.USERS, Strategy.CONTINUE)[1])


def stream_violations(spark, d):
    """Dead letters of a replica whose table fits only some changes."""
    return _letters(spark, _streamed(spark, d, NARROW, Strategy.CONTINUE)[1])


def stream_stop(spark, d):
    """What a replica that stops at problems has stored: its state and the late changes read on the way out."""
    store, letters, _ = _streamed(spark, d, feeds.USERS, Strategy.STOP)
    found = store.manifest()
    return _letters(spark, letters).select("offset", F.lit(found.state).alias("state"), F.lit(found.last_msg).alias("last_msg"), F.lit(found.step).cast("bigint").alias("step"))


def stream_table(spark, d):
    """The table that the streaming replica leaves, and its checkpoint as key -1."""
    store, _, _ = _streamed(spark, d, feeds.USERS, Strategy.CONTINUE)
    found = store.manifest()
    mark = spark.range(1).select(F.lit(-1).cast("bigint").alias("user_id"), F.lit(found.stage).alias("last_type"), F.lit(found.step).cast("bigint").alias("last_value"), F.lit(found.state).alias("props"))
    return store.read("users", found).select("user_id", "last_type", "last_value", "props").union(mark)


def request_size(spark, d):
    return fold.request_bytes(parse.changes(_ol(spark, d)))


QUERIES = {
    f.__name__: f
    for f in (
        changelog_scan, topic_layout, classify_messages, parse_changes, image_select, parse_heartbeats, route_tables, key_text, filter_key, typed_conversion,
        row_build, schema_violations, column_sets, drop_stale, drop_stale_heartbeats, blocked_keys_scan, blocked_keys_upsert, key_filter, out_of_order,
        command_scan, command_decisions, problem_resolution, dead_letters, stop_diagnostics, last_heartbeat, max_heartbeat, quorum_ready, sync_quorum,
        quorum_schedule, missing_heartbeats, ready_changes, pending_changes, global_order, global_order_rows, pop_top_n, pop_top_n_below, initial_scan_chunk,
        initial_scan_chunks, net_changes, net_deletes, column_overlay, modification_counts, apply_upsert, apply_delete, multi_table_commit, replay_run,
        replay_run_exact, replay_on_base, stage_transition, recovery_replay, state_init, state_lookup, state_checkpoint, lease_transition,
        replication_lag, request_size, throughput, type_conversions, stream_late, stream_violations, stream_stop, stream_table,
    )
} | {"quorum": quorum_now}
