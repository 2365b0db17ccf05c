"""What a replica tells its operators: counters, gauges and histograms in the usual text format, and readiness."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql.streaming.listener import StreamingQueryListener

from ebbflow.functions.model import ReplicaSpec

#: Upper bounds in seconds of the usual latency histogram.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


@dataclass
class Metrics:
    """What a batch did."""

    modifications_count: int = 0
    modifications_count_per_table: dict[str, int] = field(default_factory=dict)
    commit_latency: float = 0.0
    quorum_waiting_latency: float = 0.0
    request_size_bytes: int = 0
    replication_lag_estimation: float | None = None
    topic_without_hb: dict[str, int] = field(default_factory=dict)

    @property
    def ready(self) -> bool:
        return not any(self.topic_without_hb.values())

    @property
    def modifications_per_second(self) -> float:
        return self.modifications_count / self.commit_latency if self.commit_latency > 0 else 0.0


class Registry:
    """Sums over batches, by metric name and stream tag."""

    def __init__(self):
        self._lock = threading.Lock()
        self.counters: dict[tuple[str, str], float] = {}
        self.gauges: dict[tuple[str, str], float] = {}
        self.histograms: dict[str, list[float]] = {}
        self.ready = False

    def add(self, name: str, by: float, tag: str = "") -> None:
        if by < 0:
            raise ValueError("counters don't fall")
        with self._lock:
            self.counters[name, tag] = self.counters.get((name, tag), 0.0) + by

    def set(self, name: str, value: float, tag: str = "") -> None:
        with self._lock:
            self.gauges[name, tag] = value

    def observe(self, name: str, seconds: float) -> None:
        with self._lock:
            held = self.histograms.setdefault(name, [0.0] * (len(BOUNDS) + 2))
            for k, bound in enumerate(BOUNDS):
                held[k] += seconds <= bound
            held[-2] += 1
            held[-1] += seconds

    def took(self, batch: Metrics, heap_bytes: float | None = None) -> None:
        """Takes in one batch."""
        self.add("modifications_count", batch.modifications_count)
        self.add("request_size_bytes", batch.request_size_bytes)
        for tag, n in batch.modifications_count_per_table.items():
            self.add("modifications_count_per_table", n, tag)
        if batch.commit_latency:
            self.observe("commit_latency", batch.commit_latency)
            self.observe("quorum_waiting_latency", batch.quorum_waiting_latency)
            self.set("modifications_per_second", batch.modifications_per_second)
        if batch.replication_lag_estimation is not None:
            self.set("replication_lag_estimation", batch.replication_lag_estimation)
        if heap_bytes is not None:
            self.set("heap_allocated", heap_bytes)

    def text(self) -> str:
        """All metrics, one a line."""
        with self._lock:
            label = lambda tag: f'{{stream_tag="{tag}"}}' if tag else ""
            lines = [f"{n}{label(t)} {v:g}" for held in (self.counters, self.gauges) for (n, t), v in sorted(held.items())]
            for name, held in sorted(self.histograms.items()):
                lines += [f'{name}_bucket{{le="{b:g}"}} {v:g}' for b, v in zip(BOUNDS, held)]
                lines += [f'{name}_bucket{{le="+Inf"}} {held[-2]:g}', f"{name}_sum {held[-1]:g}", f"{name}_count {held[-2]:g}"]
        return "\n".join(lines) + "\n"


def serve(registry: Registry, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Serves /metrics and /ready (200 or 503) from a thread; ``shutdown`` of the result ends it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            code, body = {"/metrics": (200, registry.text()), "/ready": (200, "ready\n") if registry.ready else (503, "not ready\n")}.get(self.path, (404, "\n"))
            self.send_response(code)
            self.send_header("Content-Type", "text/plain; charset=utf-8")
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


class Listener(StreamingQueryListener):
    """Progress of the streaming query as gauges; ready while the query runs."""

    def __init__(self, registry: Registry):
        self.registry = registry

    def onQueryStarted(self, event) -> None:
        self.registry.ready = True

    def onQueryProgress(self, event) -> None:
        self.registry.add("input_rows", event.progress.numInputRows)
        self.registry.set("batch_duration_ms", event.progress.batchDuration)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.registry.ready = False


class HeartbeatGuard:
    """Heartbeats by partition since the last quorum, and a gauge by stream if some stay away too long.

    ``limit_s`` seconds without a full set of heartbeats set a stream's ``topic_without_hb`` to 1 if one of its partitions
    is silent; a full set within that time sets all to 0. ``tick`` is called every ``limit_s`` seconds, by ``start``'s thread or by hand.
    """

    def __init__(self, replica: ReplicaSpec, registry: Registry, clock: Callable[[], float] = time.monotonic):
        self.replica, self.registry, self.clock, self.limit_s = replica, registry, clock, replica.heartbeat_interval
        self._beats: dict[tuple[int, int], tuple[int, int]] = {}
        self._full_at = clock()
        self._lock, self._end = threading.Lock(), threading.Event()

    def saw(self, stream_id: int, partition: int, at: tuple[int, int]) -> None:
        with self._lock:
            key = (stream_id, partition)
            self._beats[key] = max(self._beats.get(key, at), at)
            if len(self._beats) == self.replica.partitions:
                self._full_at = self.clock()

    def quorum(self) -> tuple[int, int] | None:
        with self._lock:
            return min(self._beats.values()) if len(self._beats) == self.replica.partitions else None

    def commit(self, at: tuple[int, int]) -> None:
        """Forgets heartbeats up to a quorum that was applied."""
        with self._lock:
            self._beats = {k: v for k, v in self._beats.items() if v > at}

    def silent(self) -> dict[str, int]:
        """Partitions without heartbeat, by stream tag."""
        with self._lock:
            return {s.tag: sum((s.stream_id, p) not in self._beats for p in range(s.partitions)) for s in self.replica.streams}

    def tick(self) -> dict[str, int]:
        late = self.clock() - self._full_at > self.limit_s
        shown = {tag: int(late and n > 0) for tag, n in self.silent().items()}
        for tag, value in shown.items():
            self.registry.set("topic_without_hb", value, tag)
        return shown

    def start(self) -> threading.Event:
        """Ticks from a thread until the returned event is set."""

        def run() -> None:
            while not self._end.wait(self.limit_s):
                self.tick()

        threading.Thread(target=run, name="heartbeat-guard", daemon=True).start()
        return self._end
