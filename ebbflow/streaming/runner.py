"""The replica as a stream: each micro-batch is parsed, checked, folded and committed with its checkpoint.

A batch's rows take this way: late changes (judged by the last heartbeats of this batch and, through the manifest, of all before), then
the key filter, then malformed messages and changes that don't fit their table. What an operator's command, or a stream's
strategy, doesn't let pass becomes a dead letter or stops the replica; nothing is dropped silently. A stop is stored
before anything else of its batch; afterwards batches are only read for further late changes of that stream, until
all its partitions have passed the heartbeat that was violated, and then the stop is raised.

Stages. INITIAL_SCAN: until every partition has sent a heartbeat, batches are applied without moving the checkpoint, in
chunks of ``ReplicaSpec.chunk`` changes in order. Then changes wait until the quorum passes the furthest heartbeat there was;
what lies below that quorum is applied in chunks, the quorum becomes the checkpoint, and the stage is RUN. RUN: every
quorum beyond the checkpoint is applied with the changes below it.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.functions import convert, parse
from ebbflow.functions.model import ReplicaSpec, ReplicationHalted, Stage, position
from ebbflow.operators import apply, fold, order
from ebbflow.plans import replay
from ebbflow.plans.lease import Lease
from ebbflow.plans.store import Change, Manifest
from ebbflow.protocols import COMMANDS, Commands, KeyFilter, Sink
from ebbflow.streaming.metrics import HeartbeatGuard, Metrics, Registry

PENDING = ("topic", "partition", "offset", "batch", "value", "stream_id", "kind", "step", "tx_id", "key", "key_json", "cols", "error")
LETTERS = ("stream_id", "topic", "partition", "offset", "key_json", "step", "tx_id", "last_hb", "reason", "text", "decision")
AT = ("topic", "partition", "offset")


class Replicator:
    """``foreachBatch`` target. A batch whose id was committed before is skipped, so redelivery is harmless.

    ``blocked`` is a set of filter keys or a KeyFilter, ``commands`` a table of commands or Commands. Dead letters go to one folder a
    batch under ``dead_letters``, written anew if a batch is redelivered.
    """

    def __init__(self, store: Sink, replica: ReplicaSpec, mode: str = fold.REFERENCE, blocked: DataFrame | KeyFilter | None = None, commands: DataFrame | Commands | None = None, dead_letters: str | None = None, drain: bool = True, lease: Lease | None = None, registry: Registry | None = None, guard: HeartbeatGuard | None = None):
        self.store, self.replica, self.mode, self.blocked, self.commands, self.dead_letters, self.drain = store, replica, mode, blocked, commands, dead_letters, drain
        self.lease, self.registry, self.guard = lease, registry or Registry(), guard
        self.metrics: list[Metrics] = []
        self._stopped: dict | None = None
        self._waiting_since = time.time()

    @property
    def halted(self) -> str | None:
        """Why the replica stopped, while it reads on for diagnostics."""
        return self._stopped["why"] if self._stopped else None

    def __call__(self, messages: DataFrame, batch_id: int) -> None:
        if self.lease is not None:
            self.lease.check()
        if self._stopped is None:
            old = self.store.load()
            if batch_id <= old.batch_id:
                return
        began = time.time()
        log = parse.parse(messages.withColumn("batch", F.lit(batch_id).cast("bigint")), self.replica).filter("stream_id is not null").persist()
        try:
            if self._stopped is not None:
                self._drain(log, batch_id)
            else:
                self._apply(log, batch_id, old, began)
        finally:
            log.unpersist()

    # --- Problems ---------------------------------------------------------------------------------------------------

    def _commands(self, log: DataFrame) -> DataFrame:
        if self.commands is None:
            return log.sparkSession.createDataFrame([], COMMANDS)
        return self.commands if isinstance(self.commands, DataFrame) else self.commands.read(log.sparkSession)

    def _unblocked(self, changes: DataFrame) -> DataFrame:
        if self.blocked is None:
            return changes
        keyed = changes.withColumn("filter_key", parse.filter_key(parse.table_name(self.replica)))
        return (order.without_blocked(keyed, self.blocked) if isinstance(self.blocked, DataFrame) else self.blocked.apply(keyed)).drop("filter_key")

    def _violation(self) -> Column:
        """Why a change doesn't fit its stream's table, or null."""
        return F.coalesce(*(F.when(F.col("stream_id") == s.stream_id, convert.violation(s.table)) for s in self.replica.streams))

    def _problems(self, log: DataFrame, seen: dict) -> DataFrame:
        """Rows that can't simply pass, with reason, text and decision."""
        late = order.resolve(order.out_of_order(log, seen), self._commands(log), self.replica)
        late = late.withColumns({"reason": F.lit("late"), "text": order.late_text()}).select(*LETTERS)
        none = F.lit(None).cast("struct<step:decimal(20,0),tx_id:decimal(20,0)>")
        broken = log.filter("kind = 'malformed'").withColumns({"reason": F.lit("malformed"), "text": F.col("error")})
        # A change that a command skips, or that becomes a late dead letter, is judged no further.
        unfit = self._unblocked(parse.changes(log)).withColumns({"reason": F.lit("violation"), "text": self._violation()}).filter("text is not null")
        out = late.filter("decision <> 'apply'").select(*(F.col(c).alias(f"of_{c}") for c in AT))
        unfit = unfit.join(out, reduce(Column.__and__, (F.col(c) == F.col(f"of_{c}") for c in AT)), "left_anti")
        rest = broken.unionByName(unfit).withColumns({"last_hb": none, "decision": order.strategy(self.replica)}).select(*LETTERS)
        return late.unionByName(rest)

    def _letters(self, rows: DataFrame, batch_id: int, part: str = "letters") -> None:
        if self.dead_letters:
            found = rows.select(F.lit(self.replica.instance).alias("instance"), *LETTERS[:-4], "reason", "text")
            found.write.mode("overwrite").parquet(f"{self.dead_letters}/batch={batch_id}/{part}")

    def _checked(self, log: DataFrame, batch_id: int, old: Manifest) -> DataFrame:
        """The log's changes that pass; raises, or begins to drain, if the replica must stop."""
        seen = {tuple(map(int, k.split("/"))): tuple(v) for k, v in old.last_heartbeats.items()}
        found = self._problems(log, seen).persist()
        try:
            counts = {r["decision"]: r["n"] for r in found.groupBy("decision").agg(F.count(F.lit(1)).alias("n")).collect()}
            if counts.get("stop") or counts.get("dead_letter"):
                if counts.get("stop"):
                    first = found.filter("decision = 'stop'").orderBy(*AT).first()
                    why = f"{first['reason']} on {first['topic']}/{first['partition']} at {first['offset']}: {first['text']}"
                    self.store.fail(why)
                self._letters(found.filter("decision in ('dead_letter', 'stop')"), batch_id)
                if counts.get("stop"):
                    self._stop(log, first, why, seen)
            changes = parse.changes(log)
            if not counts:
                return changes
            gone = replay.checkpoint(found.filter("decision <> 'apply'").select(*AT))
            return changes.join(gone, list(AT), "left_anti")
        finally:
            found.unpersist()

    def _stop(self, log: DataFrame, first, why: str, seen: dict) -> None:
        """The stop is stored; what is left is to read on, if there is a heartbeat to pass."""
        if first["last_hb"] is None or not self.drain:
            raise ReplicationHalted(why)
        s = next(s for s in self.replica.streams if s.stream_id == first["stream_id"])
        line = (int(first["last_hb"]["step"]), int(first["last_hb"]["tx_id"]))
        self._stopped = {"why": why, "stream": s, "line": line, "seen": seen, "passed": {p for (i, p), at in seen.items() if i == s.stream_id and at > line}}
        self._pass(log)

    def _pass(self, log: DataFrame) -> None:
        """Takes note of heartbeats while draining; raises the stop when all partitions have passed the line."""
        stopped = self._stopped
        s, line = stopped["stream"], position(*(F.lit(str(x)) for x in stopped["line"]))
        ends = order.passing(log, F.lit(s.stream_id), F.lit(-1), line).collect()
        stopped["passed"] |= {r["partition"] for r in ends}
        for key, (_, last) in self._beats(log).items():
            stopped["seen"][tuple(map(int, key.split("/")))] = tuple(last)
        if len(stopped["passed"]) >= s.partitions:
            raise ReplicationHalted(stopped["why"])

    def _drain(self, log: DataFrame, batch_id: int) -> None:
        """After a stop: further late changes of its stream become dead letters; nothing is applied."""
        own = log.filter(F.col("stream_id") == self._stopped["stream"].stream_id)
        late = order.out_of_order(own, self._stopped["seen"])
        self._letters(late.withColumns({"reason": F.lit("late"), "text": order.late_text(), "decision": F.lit("stop")}).select(*LETTERS), batch_id, "drained")
        self._pass(log)

    # --- Batches ----------------------------------------------------------------------------------------------------

    @staticmethod
    def _beats(log: DataFrame) -> dict[str, tuple[list[int], list[int]]]:
        """(greatest, last) heartbeat by "stream/partition": a row a partition at most reaches the driver."""
        found = parse.heartbeats(log).groupBy("stream_id", "partition").agg(F.max(position()).alias("most"), F.max_by(position(), "offset").alias("last")).collect()
        return {f"{r['stream_id']}/{r['partition']}": tuple([int(r[n]["step"]), int(r[n]["tx_id"])] for n in ("most", "last")) for r in found}

    def _apply(self, log: DataFrame, batch_id: int, old: Manifest, began: float) -> None:
        changes = self._checked(log, batch_id, old)
        if self._stopped is not None:
            return
        found = self._beats(log)
        beats = old.heartbeats | {k: max(old.heartbeats.get(k, [0, 0]), most) for k, (most, _) in found.items()}
        known = {"heartbeats": beats, "last_heartbeats": old.last_heartbeats | {k: last for k, (_, last) in found.items()}, "batch_id": batch_id}
        if self.guard is not None:
            for k, (most, _) in found.items():
                self.guard.saw(*map(int, k.split("/")), tuple(most))
        silent = {s.tag: sum(f"{s.stream_id}/{p}" not in beats for p in range(s.partitions)) for s in self.replica.streams}
        checkpoint = [old.step, old.tx_id]
        fresh = order.not_stale(self._unblocked(changes), position(F.lit(str(old.step)), F.lit(str(old.tx_id)))).select(*PENDING)
        waiting = self.store.pending(old)
        rows = fresh if waiting is None else fresh.unionByName(waiting.select(*PENDING))
        target = None if any(silent.values()) else min(beats.values())

        if old.stage == Stage.INITIAL_SCAN.value:
            if target is not None and not old.scan_max:
                known["scan_max"] = max(beats.values())
            line = known.get("scan_max", old.scan_max)
            if line and target <= line:
                self._commit(old, rows.limit(0), rows, known, silent, began, None)
            elif line:
                self._commit(old, *self._cut(rows, target, True), known | self._run(target), silent, began, target)
            else:
                self._commit(old, order.chunks(rows, self.replica.chunk).withColumnRenamed("chunk", "apply_batch"), rows.limit(0), known, silent, began, None)
        elif target is None or target <= checkpoint:
            self._commit(old, rows.limit(0), rows, known, silent, began, None)
        else:
            self._commit(old, *self._cut(rows, target, False), known | self._run(target), silent, began, target)

    @staticmethod
    def _run(target: list[int]) -> dict:
        return {"step": target[0], "tx_id": target[1], "stage": Stage.RUN.value}

    def _cut(self, rows: DataFrame, target: list[int], chunked: bool) -> tuple[DataFrame, DataFrame]:
        """(what lies below the target, with its place among the steps of the fold; the rest)."""
        at = position(*(F.lit(str(x)) for x in target))
        ready = order.below(rows, at)
        if chunked:
            ready = order.chunks(ready, self.replica.chunk).withColumnRenamed("chunk", "apply_batch")
        return ready, order.pending(rows, at)

    def _commit(self, old: Manifest, ready: DataFrame, rest: DataFrame, fields: dict, silent: dict, began: float, target: list[int] | None) -> None:
        if "apply_batch" not in ready.columns:
            ready = ready.withColumn("apply_batch", F.lit(0).cast("bigint"))
        ready = ready.persist()
        counts = {r["stream_id"]: (r["n"], r["bytes"] or 0) for r in ready.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value").cast("bigint")).alias("bytes")).collect()}
        tables = {}
        for s in self.replica.streams:
            if s.stream_id not in counts:
                continue
            own = replay.keyed(ready.filter(F.col("stream_id") == s.stream_id), s.table)
            net = replay.checkpoint(fold.folded(own, s.table, self.mode).withColumn("bucket", self.store.bucket(s.table.key)))
            touched = sorted(r["bucket"] for r in net.select("bucket").distinct().collect())
            base = self.store.read(s.table.name, old, touched)
            base = apply.empty(ready.sparkSession, s.table) if base is None else base
            tables[s.table.name] = Change(apply.apply_net(base, net.drop("bucket"), s.table), s.table.key, touched)
        if self.lease is not None:
            self.lease.check()
        wrote = time.time()
        self.store.commit(old, tables, rest, **fields)
        ready.unpersist()
        now = time.time()
        done = Metrics(
            sum(n for n, _ in counts.values()),
            {s.tag: counts.get(s.stream_id, (0, 0))[0] for s in self.replica.streams},
            now - began if counts or target else 0.0,
            max(0.0, wrote - self._waiting_since),
            sum(b for _, b in counts.values()),
            max(0.0, now * 1000 - target[0]) / 1000 if target else None,
            silent,
        )
        if target:
            self._waiting_since = now
            if self.guard is not None:
                self.guard.commit(tuple(target))
        self.metrics.append(done)
        runtime = ready.sparkSession._jvm.java.lang.Runtime.getRuntime()
        self.registry.took(done, runtime.totalMemory() - runtime.freeMemory())


def start(messages: DataFrame, replicator: Replicator, checkpoint: str):
    """Runs a streaming DataFrame of messages through the replica until what is there is done."""
    return messages.writeStream.foreachBatch(replicator).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
