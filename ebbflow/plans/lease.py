"""The lease held by a thread: renewal, what runs under it, and waiting in standby."""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable

from ebbflow.functions.model import ReplicaSpec
from ebbflow.plans.store import LeaseLost, Store

CHECK_S, CHECKS = 5.0, 10


class LeaseUnavailable(RuntimeError):
    """A replica that mustn't wait in standby couldn't get the lease."""


class Lease:
    """Renews the store's lease from a thread, every tenth to fifth of its time to live, and gives it back at the end.

    ``held`` turns false when the deadline passes without renewal, whatever the thread does; ``lost`` callbacks are
    called once a loss, as for cancelling what runs.
    """

    def __init__(self, store: Store, ttl_s: float, lost: Callable[[], None] = lambda: None, clock: Callable[[], float] = time.monotonic, draw: Callable[[], float] = random.random):
        if ttl_s <= 0:
            raise ValueError("the lease needs a positive time to live")
        self.store, self.ttl_s, self.lost, self.clock, self.draw = store, ttl_s, lost, clock, draw
        self._deadline = float("-inf")
        self._had = False
        self._taken, self._end = threading.Event(), threading.Event()
        self._thread = threading.Thread(target=self._run, name="lease", daemon=True)

    @property
    def held(self) -> bool:
        return self.clock() < self._deadline

    def pause(self) -> float:
        """Seconds until the next renewal."""
        return self.ttl_s / 10 * (1 + self.draw())

    def renew(self) -> bool:
        """One attempt. The deadline counts from before the attempt, so it never lies beyond the stored one."""
        asked = self.clock()
        try:
            got = self.store.acquire(int(self.ttl_s * 1000))
        except Exception:  # the store can't be reached: the lease lasts until its deadline
            got = None
        if got:
            self._deadline, self._had = asked + self.ttl_s, True
            self._taken.set()
        elif got is False:
            self._deadline = float("-inf")
        if self._had and not self.held:
            self._had = False
            self._taken.clear()
            self.lost()
        return bool(got)

    def _run(self) -> None:
        while not self._end.is_set():
            self.renew()
            self._end.wait(self.pause())

    def wait(self, seconds: float) -> bool:
        return self._taken.wait(seconds) and self.held

    def check(self) -> None:
        if not self.held:
            raise LeaseLost(f"the lease of {self.store.instance} ran out")

    def __enter__(self) -> Lease:
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._end.set()
        self._thread.join(self.ttl_s)
        self._deadline = float("-inf")
        self.store.release()


def under_lease(store: Store, replica: ReplicaSpec, work: Callable[[Lease], None], lost: Callable[[], None] = lambda: None, check_s: float = CHECK_S, checks: int = CHECKS) -> None:
    """Runs ``work`` once the lease is held; its time to live is twice the heartbeat interval.

    Replicas that may run several instances wait in standby as long as it takes; a single one gives up after ``checks``
    checks of ``check_s`` seconds.
    """
    with Lease(store, 2 * replica.heartbeat_interval, lost) as lease:
        tries = 0
        while not lease.wait(check_s):
            tries += 1
            if replica.single and tries >= checks:
                raise LeaseUnavailable(f"another instance of {replica.instance} holds the lease")
        work(lease)
