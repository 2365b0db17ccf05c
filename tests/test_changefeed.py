"""Hand-made logs: parsing, conversion, order, quorum, fold, store and stream."""

import itertools
import json
import random
import urllib.error
import urllib.request
from dataclasses import replace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ebbflow import config

from ebbflow.functions import convert, parse
from ebbflow.functions.model import ColumnSpec, ReplicaSpec, ReplicationHalted, StreamSpec, Strategy, TableSpec, position
from ebbflow.operators import fold, order, quorum
from ebbflow.plans import replay
from ebbflow.plans.lease import Lease, LeaseUnavailable, under_lease
from ebbflow.plans.store import Change, LeaseLost, Manifest, Store
from ebbflow.sources import feeds
from ebbflow.streaming.metrics import HeartbeatGuard, Listener, Metrics, Registry, serve
from ebbflow.streaming.runner import Replicator, start

T = TableSpec("t", ("k",), (ColumnSpec("k", "Int64", False), ColumnSpec("a", "Utf8"), ColumnSpec("b", "Int64")))
ONE = ReplicaSpec("i", (StreamSpec("t_cdc", 0, 2, T, Strategy.CONTINUE),))
MESSAGE = "topic string, partition bigint, offset bigint, batch bigint, value string"


def messages(spark, rows, topic="t_cdc"):
    return spark.createDataFrame([(topic, p, o, b, v if isinstance(v, str) else json.dumps(v)) for p, o, b, v in rows], MESSAGE)


def update(k, ts, **cols):
    return {"update": cols, "key": [k], "ts": ts}


def erase(k, ts):
    return {"erase": {}, "key": [k], "ts": ts}


@pytest.mark.parametrize(
    ("value", "kind", "error"),
    [
        ("not json", "malformed", "unknown format"),
        ({"x": 1}, "malformed", "unknown format"),
        ({"update": None, "key": [1], "ts": [1, 2]}, "malformed", "unknown format"),
        ({"update": {"a": "x"}, "erase": {}, "key": [1], "ts": [1, 2]}, "malformed", "both update and erase"),
        ({"update": {"a": "x"}, "key": [1], "ts": [1]}, "malformed", "ts needs two numbers"),
        ({"update": {"a": "x"}, "key": [1], "ts": [1, 2, 3]}, "malformed", "ts needs two numbers"),
        ({"update": {"a": "x"}, "key": [1], "ts": [-1, 2]}, "malformed", "ts out of range"),
        ({"resolved": [1, 2, 3]}, "malformed", "resolved needs two numbers"),
        ({"resolved": [18446744073709551615, 0]}, "resolved", None),
        ({"update": {"a": None}, "key": [1], "ts": [18446744073709551615, 1]}, "update", None),
        ({"erase": {}, "key": [1], "ts": [1, 2]}, "erase", None),
        ({"update": {"a": "x"}, "newImage": {"b": 1}, "key": [1], "ts": [1, 2]}, "update", None),
        ({"newImage": {"b": 1}, "key": [1], "ts": [1, 2]}, "malformed", "unknown format"),
        ({"update": {"a": "x"}, "key": 1, "ts": [1, 2]}, "malformed", "no key"),
    ],
)
def test_parse(spark, value, kind, error):
    row = parse.parse(messages(spark, [(0, 0, 0, value)]), ONE).first()
    assert (row["kind"], row["error"]) == (kind, error)
    if kind == "update":
        assert row["key"] == ["1"] and row["key_json"] == "[1]"
    if kind == "update" and "newImage" in value:
        assert row["cols"] == {"b": "1"}
    if isinstance(value, dict) and value.get("update") == {"a": None}:
        assert row["cols"] == {"a": None} and int(row["step"]) == 18446744073709551615


@pytest.mark.parametrize(
    ("kind", "good", "bad"),
    [
        ("Bool", "true", "yes"), ("Int8", "-128", "128"), ("Int16", "300", "40000"), ("Int32", "5", "1.5"), ("Int64", "9", "1e2"), ("Uint8", "255", "256"),
        ("Uint16", "65535", "-1"), ("Uint32", "4294967295", "4294967296"), ("Uint64", "18446744073709551615", "18446744073709551616"), ("Float", "1.5", "x"),
        ("Double", "1e3", "NaN"), ("Date", "19000", "d"), ("Timestamp", "2024-01-02T03:04:05.000006Z", "2024-01-02T03:04:05Z"), ("Interval", "7", "x"),
        ("String", "aGk=", "%"), ("Uuid", "123E4567-e89b-12d3-a456-426614174000", "123"), ("Utf8", "x", None), ("TzDate", "x", None), ("Json", "{}", None), ("Yson", "x", None),
        ("TzDatetime", "x", None), ("TzTimestamp", "x", None),
    ],
)
def test_conversion(spark, kind, good, bad):
    row = spark.range(1).select(convert.convert(F.lit(good), kind).alias("g"), convert.convert(F.lit(bad).cast("string"), kind).alias("b")).first()
    assert row["g"] is not None and row["b"] is None
    if kind == "Uuid":
        assert row["g"] == good.lower()


def test_unsupported_type():
    with pytest.raises(ValueError, match="unsupported"):
        convert.spark_type("Decimal")


def test_violations(spark):
    rows = [(0, 0, 0, update(1, [1, 1], zzz=1)), (0, 1, 0, {"update": {"a": "x"}, "key": [1, 2], "ts": [1, 2]}), (0, 2, 0, update(1, [1, 3], b="x")), (0, 3, 0, update("q", [1, 4], b=1)), (0, 4, 0, update(1, [1, 5], b=2))]
    found = {r["offset"]: r["violation"] for r in convert.violations(parse.changes(parse.parse(messages(spark, rows), ONE)), T).collect()}
    assert found == {0: "unknown column zzz", 1: "key has 2 values, the table needs 1", 2: "bad value for column b", 3: "bad value for key column k"}


def test_filter_key_bytes(spark):
    row = spark.range(1).select(F.array(F.lit("k1"), F.lit("k2")).alias("key")).select(parse.filter_key("t1").alias("a"), parse.filter_key("t1", separated=True).alias("b")).first()
    assert bytes(row["a"]) == b"\x01t1k1k2" and bytes(row["b"]) == b"\x01t1\x00k1\x00k2"


def test_strategy_names():
    assert Strategy.named("continue") is Strategy.CONTINUE and Strategy.named("") is Strategy.STOP
    with pytest.raises(ValueError, match="unknown"):
        Strategy.named("later")


def test_quorum_needs_every_partition(spark):
    rows = [(0, 0, 0, {"resolved": [3, 0]}), (0, 1, 0, {"resolved": [6, 0]}), (0, 2, 0, {"resolved": [5, 0]})]
    latest = quorum.last_heartbeat(parse.heartbeats(parse.parse(messages(spark, rows), ONE)))
    row = quorum.quorum(latest, 2).first()
    assert not row["ready"] and row["quorum"] is None and int(row["furthest"]["step"]) == 6
    rows.append((1, 0, 0, {"resolved": [4, 0]}))
    row = quorum.quorum(quorum.last_heartbeat(parse.heartbeats(parse.parse(messages(spark, rows), ONE))), 2).first()
    assert row["ready"] and int(row["quorum"]["step"]) == 4


def test_order_is_stable_and_bounds_are_strict(spark):
    steps = [(3, 1), (2, 1), (2, 1), (1, 9), (3, 1), (4, 0)]
    log = parse.parse(messages(spark, [(0, i, 0, update(i, list(p), b=i)) for i, p in enumerate(steps)]), ONE)
    ranked = {r["offset"]: r["place"] for r in order.global_order(parse.changes(log)).collect()}
    assert sorted(ranked, key=ranked.get) == [3, 1, 2, 0, 4, 5] and sorted(ranked.values()) == [1, 2, 3, 4, 5, 6]
    assert [r["offset"] for r in order.pop(log, 2, position(F.lit(3), F.lit(1))).collect()] == [3, 1]


def test_late_changes_and_commands(spark):
    rows = [(0, 0, 0, {"resolved": [10, 0]}), (0, 1, 0, update(1, [9, 9], b=1)), (0, 2, 0, update(2, [10, 0], b=1)), (0, 3, 0, update(3, [1, 1], b=1)), (0, 4, 0, {"resolved": [5, 0]}), (0, 5, 0, update(4, [6, 0], b=1))]
    late = order.out_of_order(parse.parse(messages(spark, rows), ONE))
    assert sorted(r["offset"] for r in late.collect()) == [1, 3]
    commands = spark.createDataFrame([("i", "t_cdc", "[1]", 9, 9, "skip", 0), ("i", "t_cdc", "[1]", 9, 9, "apply", 1), ("i", "t_cdc", "[1]", 9, 9, "wait", 2), ("other", "t_cdc", "[3]", 1, 1, "skip", 3)], "instance string, topic string, key_json string, step int, tx_id int, action string, offset int")
    assert {r["offset"]: r["decision"] for r in order.resolve(late, commands, ONE).collect()} == {1: "apply", 3: "dead_letter"}


def simulate(log, partitions, mode, base):
    """A plain model: batches one after another."""
    table, seen, waiting, checkpoint = {k: dict(v) for k, v in base.items()}, {}, [], (0, 0)
    for _, rows in itertools.groupby(sorted(log, key=lambda r: (r["batch"], r["offset"])), key=lambda r: r["batch"]):
        for r in rows:
            at = (r["step"], r["tx"])
            if r["kind"] == "resolved":
                seen[r["part"]] = max(seen.get(r["part"], (0, 0)), at)
            elif at >= checkpoint:
                waiting.append(r)
        if len(seen) < partitions or min(seen.values()) <= checkpoint:
            continue
        q = min(seen.values())
        ready = sorted((r for r in waiting if (r["step"], r["tx"]) < q), key=lambda r: (r["step"], r["tx"], r["offset"]))
        waiting, checkpoint = [r for r in waiting if (r["step"], r["tx"]) >= q], q
        net = {}
        for r in ready:
            if r["kind"] == "erase":
                net[r["key"]] = ("erase", {}, True)
            else:
                op, cols, gone = net.get(r["key"], ("update", {}, False))
                net[r["key"]] = ("update", (cols if op == "update" else {}) | r["cols"], gone)
        for key, (op, cols, gone) in net.items():
            if op == "erase":
                table.pop(key, None)
            else:
                old = {} if mode == fold.EXACT and gone else table.get(key, {})
                table[key] = {"a": None, "b": None} | old | cols
    return table


def random_log(seed):
    rng, rows, offset = random.Random(seed), [], 0
    for batch in range(6):
        for _ in range(rng.randint(0, 10)):
            kind = rng.choice(["update", "update", "erase"])
            cols = {c: rng.choice([None, rng.randint(0, 9)]) for c in rng.sample(["a", "b"], rng.randint(1, 2))}
            if cols.get("a") is not None:
                cols["a"] = str(cols["a"])
            rows.append({"batch": batch, "offset": offset, "part": rng.randint(0, 1), "kind": kind, "step": max(1, batch * 10 + rng.randint(-12, 15)), "tx": rng.randint(0, 3), "key": rng.randint(0, 3), "cols": cols})
            offset += 1
        for part in range(2):
            if rng.random() < 0.7:
                rows.append({"batch": batch, "offset": offset, "part": part, "kind": "resolved", "step": batch * 10 + rng.randint(0, 9), "tx": 0, "key": None, "cols": None})
                offset += 1
    return rows


def as_message(r):
    if r["kind"] == "resolved":
        return {"resolved": [r["step"], r["tx"]]}
    return update(r["key"], [r["step"], r["tx"]], **r["cols"]) if r["kind"] == "update" else erase(r["key"], [r["step"], r["tx"]])


@pytest.mark.parametrize("mode", [fold.REFERENCE, fold.EXACT])
@pytest.mark.parametrize("seed", range(3))
def test_replay_equals_step_by_step(spark, seed, mode):
    rows = random_log(seed)
    base = {0: {"a": "base", "b": 1}, 2: {"a": None, "b": 2}, 7: {"a": "x", "b": None}}
    start = spark.createDataFrame([(k, v["a"], v["b"]) for k, v in base.items()], "k bigint, a string, b bigint")
    log = parse.parse(messages(spark, [(r["part"], r["offset"], r["batch"], as_message(r)) for r in rows]), ONE)
    got = {r["k"]: {"a": r["a"], "b": r["b"]} for r in replay.replay(log, ONE, {"t": start}, mode).tables["t"].collect()}
    assert got == simulate(rows, 2, mode, base)


def simulate_stream(batches, partitions, chunk):
    """A plain model of the streaming replica: (table, late offsets, checkpoint, stage). It holds its own idea of what is late."""
    table, last, most, waiting, checkpoint, scan_max, stage, late = {}, {}, {}, [], (0, 0), None, "INITIAL_SCAN", []

    def fold_in(rows):
        net = {}
        for r in rows:
            if r["kind"] == "erase":
                net[r["key"]] = ("erase", {})
            else:
                op, cols = net.get(r["key"], ("update", {}))
                net[r["key"]] = ("update", (cols if op == "update" else {}) | r["cols"])
        for key, (op, cols) in net.items():
            if op == "erase":
                table.pop(key, None)
            else:
                table[key] = {"a": None, "b": None} | table.get(key, {}) | cols

    for rows in batches:
        for r in sorted(rows, key=lambda r: r["offset"]):
            at = (r["step"], r["tx"])
            if r["kind"] == "resolved":
                last[r["part"]] = at
                most[r["part"]] = max(most.get(r["part"], at), at)
            elif r["part"] in last and at < last[r["part"]]:
                late.append(r["offset"])
            elif at >= checkpoint:
                waiting.append(r)
        waiting.sort(key=lambda r: (r["step"], r["tx"], r["offset"]))
        full = len(most) == partitions
        if stage == "INITIAL_SCAN":
            if full and scan_max is None:
                scan_max = max(most.values())
            if scan_max is None:
                ready, waiting = waiting, []
            elif min(most.values()) > scan_max:
                checkpoint, stage = min(most.values()), "RUN"
                ready = [r for r in waiting if (r["step"], r["tx"]) < checkpoint]
                waiting = [r for r in waiting if (r["step"], r["tx"]) >= checkpoint]
            else:
                ready = []
            for k in range(0, len(ready), chunk):
                fold_in(ready[k : k + chunk])
        elif min(most.values()) > checkpoint:
            checkpoint = min(most.values())
            fold_in([r for r in waiting if (r["step"], r["tx"]) < checkpoint])
            waiting = [r for r in waiting if (r["step"], r["tx"]) >= checkpoint]
    return table, late, checkpoint, stage


@pytest.mark.parametrize("seed", [11, 12])
def test_stream_equals_step_by_step_and_recovers(spark, tmp_path, seed):
    rows = random_log(seed)
    replica = ReplicaSpec("i", ONE.streams, chunk=3)
    batches = [[r for r in rows if r["batch"] == b] for b in range(6)]
    store = Store(spark, str(tmp_path), "i", buckets=3)
    assert store.acquire(600_000)
    for batch, own in enumerate(batches):
        df = messages(spark, [(r["part"], r["offset"], 0, as_message(r)) for r in own])
        run = Replicator(Store(spark, str(tmp_path), "i", buckets=3) if batch == 3 else store, replica, dead_letters=str(tmp_path / "dead"))
        if batch == 3:
            with pytest.raises(LeaseLost):
                run.store.commit(Manifest(version=99, epoch=99), {})
        Replicator(store, replica, dead_letters=str(tmp_path / "dead"))(df, batch)
        if batch < 2:
            run(df, batch)  # redelivered
    table, late, checkpoint, stage = simulate_stream(batches, 2, 3)
    found, at = store.read("t"), store.manifest()
    got = {} if found is None else {r["k"]: {"a": r["a"], "b": r["b"]} for r in found.collect()}
    assert got == table and (at.step, at.tx_id) == checkpoint and at.stage == stage
    letters = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "dead")).collect() if late else []
    assert sorted(r["offset"] for r in letters) == sorted(late)
    before = {r["k"]: r["a"] for r in found.collect()}
    assert store.vacuum(keep=1) > 0 and {r["k"]: r["a"] for r in store.read("t").collect()} == before and store.vacuum(keep=1) == 0


def test_a_late_change_is_known_by_an_earlier_batch(spark, tmp_path):
    strict = ReplicaSpec("i", (StreamSpec("t_cdc", 0, 1, T, Strategy.STOP),))
    run = Replicator(Store(spark, str(tmp_path / "s"), "i"), strict, drain=False)
    run(messages(spark, [(0, 0, 0, {"resolved": [10, 0]})]), 0)
    with pytest.raises(ReplicationHalted, match="late"):
        run(messages(spark, [(0, 1, 0, update(1, [6, 0], b=1))]), 1)


def test_misfits_halt_or_become_dead_letters(spark, tmp_path):
    """Each stream's own strategy counts, whatever the order of rows; nothing vanishes and the checkpoint stays."""
    other = TableSpec("u", ("k",), T.columns)
    both = ReplicaSpec("i", (StreamSpec("t_cdc", 0, 1, T, Strategy.CONTINUE), StreamSpec("u_cdc", 1, 1, other, Strategy.STOP)))
    bad = [(0, 0, 0, update(1, [1, 1], zzz=1)), (0, 1, 0, update(1, [2, 1], b="x")), (0, 2, 0, "broken"), (0, 3, 0, update(2, [3, 1], b=4)), (0, 4, 0, {"resolved": [10, 0]})]
    store = Store(spark, str(tmp_path / "a"), "i")
    Replicator(store, both, dead_letters=str(tmp_path / "letters"))(messages(spark, bad).union(messages(spark, [(0, 0, 0, {"resolved": [10, 0]})], "u_cdc")), 0)
    letters = spark.read.parquet(str(tmp_path / "letters" / "batch=0" / "letters")).collect()
    assert sorted((r["offset"], r["reason"], r["text"]) for r in letters) == [(0, "violation", "unknown column zzz"), (1, "violation", "bad value for column b"), (2, "malformed", "unknown format")]
    for k, wrong in enumerate([update(1, [1, 1], zzz=1), "broken"]):
        store = Store(spark, str(tmp_path / f"b{k}"), "i")
        with pytest.raises(ReplicationHalted, match="u_cdc"):
            Replicator(store, both)(messages(spark, bad).union(messages(spark, [(0, 9, 0, wrong)], "u_cdc")), 0)
        found = store.manifest()
        assert found.state == "FATAL_ERROR" and found.step == 0 and not found.tables and found.batch_id == -1


def test_drain_reads_until_all_partitions_pass(spark, tmp_path):
    strict = ReplicaSpec("i", (StreamSpec("t_cdc", 0, 2, T, Strategy.STOP),))
    run = Replicator(Store(spark, str(tmp_path / "s"), "i"), strict, dead_letters=str(tmp_path / "d"))
    run(messages(spark, [(0, 0, 0, {"resolved": [10, 0]}), (0, 1, 0, update(1, [1, 1], b=1)), (1, 0, 0, {"resolved": [9, 0]})]), 0)
    assert "late" in run.halted and run.store.manifest().state == "FATAL_ERROR"
    run(messages(spark, [(0, 2, 0, update(2, [3, 1], b=1)), (0, 3, 0, update(2, [12, 1], b=1)), (0, 4, 0, {"resolved": [11, 0]}), (1, 1, 0, update(3, [8, 0], b=1))]), 1)
    with pytest.raises(ReplicationHalted, match="late"):
        run(messages(spark, [(1, 2, 0, update(4, [2, 0], b=1)), (1, 3, 0, {"resolved": [11, 0]})]), 2)
    letters = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path / "d")).collect()
    assert sorted((r["partition"], r["offset"]) for r in letters) == [(0, 1), (0, 2), (1, 1), (1, 2)]


def test_topic_rows_feed_the_replica(spark, tmp_path):
    """Rows as a topic source gives them: binary values, integer partitions, no batch."""
    rows = spark.createDataFrame([("t_cdc", 0, 0, json.dumps(update(1, [1, 0], b=1)).encode())], "topic string, partition int, offset bigint, value binary")
    given = feeds.as_messages(rows.withColumns({"timestamp": F.current_timestamp(), "key": F.lit(b"k")}))
    assert given.columns == ["topic", "partition", "offset", "batch", "value"]
    store = Store(spark, str(tmp_path), "i")
    Replicator(store, ONE)(given, 0)
    assert [(r["k"], r["b"]) for r in store.read("t").collect()] == [(1, 1)] and replay.replay(parse.parse(given, ONE), ONE).pending.count() == 1


def test_stream_runs_from_files(spark, tmp_path):
    for k in range(2):
        messages(spark, [(p, 10 * k + p, 0, {"resolved": [5 + 10 * k, 0]}) for p in range(2)] + [(0, 10 * k + 5, 0, update(k, [6 + 10 * k, 1], b=k))]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store, registry = Store(spark, str(tmp_path / "s"), "i"), Registry()
    run = Replicator(store, ONE, registry=registry, guard=HeartbeatGuard(ONE, registry))
    start(feeds.from_files(spark, str(tmp_path / "in"), 1, bounded=False), run, str(tmp_path / "c")).awaitTermination()
    assert [r["k"] for r in store.read("t").collect()] == [0] and store.manifest().stage == "RUN" and store.manifest().step == 15
    assert registry.counters["modifications_count", ""] == 1 and "replication_lag_estimation" in registry.text()


def test_crash_before_the_manifest_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path), "i")
    old = store.manifest()

    def crash():
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        store.commit(old, {"t": Change(spark.range(3).toDF("k"), ("k",))}, before_manifest=crash, step=5)
    assert store.manifest() == old and store.read("t") is None
    new = store.commit(old, {"t": Change(spark.range(3).toDF("k"), ("k",))}, step=5)
    assert store.manifest() == new and store.read("t").count() == 3
    with pytest.raises(LeaseLost):
        store.commit(old, {}, step=6)


def test_lease_is_renewed_refused_and_taken_over(spark, tmp_path):
    now = [1000]
    a, b = (Store(spark, str(tmp_path), "i", clock=lambda: now[0]) for _ in range(2))
    assert a.acquire(100) and a.acquire(100) and not b.acquire(100)
    held = a.manifest()
    now[0] = 2000
    assert b.acquire(100)
    with pytest.raises(LeaseLost):
        a.commit(held, {}, step=1)
    b.release()
    assert a.acquire(100)
    held = a.manifest()
    assert a.acquire(100) and a.commit(held, {}, step=7).step == 7  # a renewal in between does no harm
    with pytest.raises(LeaseLost):
        a.commit(held, {}, step=8)


def test_writers_never_share_a_version(spark, tmp_path):
    store = Store(spark, str(tmp_path), "i")
    old = store.manifest()
    assert store._create(replace(old, version=1)) and not store._create(replace(old, version=1, owner="late")) and store.manifest().owner == ""
    create, tries = store._create, []

    def slow(manifest):
        tries.append(manifest.version)
        if len(tries) == 1:
            create(replace(manifest, state="OK", last_msg="", owner="other"))
        return create(manifest)

    store._create = slow
    store.fail("broken")
    assert tries == [2, 3] and store.manifest().state == "FATAL_ERROR" and store.manifest().owner == "other"


class Held:
    """A store that gives its lease as told."""

    instance = "i"

    def __init__(self, *answers):
        self.answers, self.released = list(answers), False

    def acquire(self, ttl_ms):
        answer = self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]
        if isinstance(answer, Exception):
            raise answer
        return answer

    def release(self):
        self.released = True


def test_lease_ends_at_its_deadline_and_when_taken():
    now, lost = [0.0], []
    lease = Lease(Held(True, OSError(), True, False), 10, lambda: lost.append(now[0]), lambda: now[0], lambda: 0.5)
    assert lease.pause() == 1.5 and not lease.held and lease.renew() and lease.held
    now[0] = 9.0
    assert not lease.renew() and lease.held and not lost  # the store was out of reach, the lease still lasts
    now[0] = 10.0
    with pytest.raises(LeaseLost):
        lease.check()
    assert lease.renew() and lease.held
    assert not lease.renew() and not lease.held and lost == [10.0]


def test_standby_waits_and_a_single_replica_gives_up():
    done = []
    store = Held(False, False, True)
    under_lease(store, ReplicaSpec("i", ONE.streams, heartbeat_interval=0.05), lambda lease: done.append(lease.held), check_s=0.05)
    assert done == [True] and store.released
    with pytest.raises(LeaseUnavailable):
        under_lease(Held(False), ReplicaSpec("i", ONE.streams, single=True), done.append, check_s=0.01, checks=3)
    assert len(done) == 1


def test_guard_and_quorum_over_four_partitions():
    streams = (StreamSpec("a", 0, 2, T, mon_tag="first"), StreamSpec("b", 1, 2, T))
    now, registry = [0.0], Registry()
    guard = HeartbeatGuard(ReplicaSpec("i", streams, heartbeat_interval=5), registry, lambda: now[0])
    for key, steps in {(0, 0): (3, 5, 6), (0, 1): (2, 7), (1, 0): (5,)}.items():
        for step in steps:
            guard.saw(*key, (step, 0))
    assert guard.quorum() is None and guard.tick() == {"first": 0, "b": 0}
    now[0] = 6.0
    assert guard.tick() == {"first": 0, "b": 1} and registry.gauges["topic_without_hb", "b"] == 1
    guard.saw(1, 1, (4, 0))
    assert guard.quorum() == (4, 0) and guard.tick() == {"first": 0, "b": 0}
    guard.commit((4, 0))
    assert guard.quorum() is None and guard.silent() == {"first": 0, "b": 1}
    guard.saw(1, 1, (5, 0))
    assert guard.quorum() == (5, 0)


def test_metrics_are_served():
    registry = Registry()
    registry.took(Metrics(123, {"tag_1": 120, "tag_2": 3}, 0.2, 0.01, 50, 1.5), 7)
    registry.took(Metrics(333, {"tag_1": 333}, 0.1, 0.0, 50))
    registry.set("topic_without_hb", 0, "tag_1")
    registry.set("topic_without_hb", 1, "tag_2")
    server = serve(registry)
    at = f"http://127.0.0.1:{server.server_port}"
    text = urllib.request.urlopen(f"{at}/metrics").read().decode().splitlines()
    assert {"modifications_count 456", 'modifications_count_per_table{stream_tag="tag_1"} 453', 'topic_without_hb{stream_tag="tag_2"} 1', "commit_latency_count 2", 'commit_latency_bucket{le="0.1"} 1', "modifications_per_second 3330"} <= set(text)
    with pytest.raises(urllib.error.HTTPError):
        urllib.request.urlopen(f"{at}/ready")
    Listener(registry).onQueryStarted(None)
    assert urllib.request.urlopen(f"{at}/ready").read() == b"ready\n"
    server.shutdown()


def test_configuration(spark, tmp_path):
    schema = spark.createDataFrame([], "k bigint, a string, t timestamp, n decimal(20,0)").schema
    good = {"instance": 0, "root": "/r", "source_token": "x", "streams": [{"topic": "a", "table": "t", "partitions": 2, "key": ["k"], "problem_strategy": "Continue"}, {"topic": "b", "table": "u", "partitions": 1}]}
    (tmp_path / "c.json").write_text(json.dumps(good))
    found = config.load(spark, str(tmp_path / "c.json"), {"t": schema, "u": T})
    s = found.replica.streams[0]
    assert s.strategy is Strategy.CONTINUE and s.table.column("n").type == "Uint64" and not s.table.column("k").nullable and found.replica.single and found.source.token == "x"
    for wrong in ({"instance": ""}, {"streams": []}, {"source_key_file": "f"}, {"log_level": "loud"}, {"max_expected_heartbeat_interval": 0}, {"streams": [{"topic": "a", "table": "none", "partitions": 1}]}, {"streams": [{"topic": "a", "table": "u", "partitions": 1, "problem_strategy": "later"}]}, {"streams": [{"topic": "a", "partitions": 1}]}):
        with pytest.raises(config.ConfigError):
            config.verify(good | wrong, {"t": schema, "u": T})
    for text in ("", "- a", "a: [", "{"):
        (tmp_path / "bad").write_text(text)
        with pytest.raises(config.ConfigError):
            config.load(spark, str(tmp_path / "bad"), {})


def test_global_order_of_wide_rows(spark):
    """More rows than the sample of bounds holds, with many equal positions and wide rows."""
    rows = spark.range(500_000).select(F.pmod(F.xxhash64("id"), F.lit(5000)).cast("decimal(20,0)").alias("step"), (F.col("id") % 2).cast("decimal(20,0)").alias("tx_id"), F.col("id").alias("offset"), F.repeat(F.lit("x"), 200).alias("wide"))
    ranked = order.global_order(rows.repartition(7))
    after = Window.partitionBy(F.floor(F.col("place") / 1000)).orderBy("place")
    steps = ranked.withColumn("before", F.lag(F.struct("step", "tx_id", "offset")).over(after))
    row = steps.agg(F.count_distinct("place").alias("n"), F.min("place").alias("low"), F.max("place").alias("high"), F.count_if(F.col("before") > F.struct("step", "tx_id", "offset")).alias("wrong")).first()
    assert tuple(row) == (500_000, 1, 500_000, 0)


def test_late_changes_across_ranges_equal_a_plain_loop(spark):
    rng, rows = random.Random(3), []
    for i in range(4000):
        rows.append((i % 2, i, 0, {"resolved": [max(0, i // 8 + rng.randint(-20, 5)), 0]} if rng.random() < 0.05 else update(i, [max(1, i // 8 + rng.randint(-6, 9)), i], b=1)))
    last, want = {0: (40, 0)}, []
    for p, o, _, v in rows:
        if "resolved" in v:
            last[p] = tuple(v["resolved"])
        elif p in last and tuple(v["ts"]) < last[p]:
            want.append(o)
    got = order.out_of_order(parse.parse(messages(spark, rows), ONE), {(0, 0): (40, 0)})
    assert sorted(r["offset"] for r in got.collect()) == want


def test_stop_is_stored_before_it_is_raised(spark, tmp_path):
    strict = ReplicaSpec("i", (StreamSpec("t_cdc", 0, 2, T, Strategy.STOP),))
    store = Store(spark, str(tmp_path), "i")
    bad = messages(spark, [(0, 0, 0, {"resolved": [10, 0]}), (0, 1, 0, update(1, [1, 1], b=1))])
    with pytest.raises(ReplicationHalted, match="late"):
        Replicator(store, strict, drain=False)(bad, 0)
    with pytest.raises(ReplicationHalted, match="FATAL_ERROR"):
        Replicator(store, strict)(bad, 1)
