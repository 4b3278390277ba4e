"""Existence checks over a stream of cited targets: each is asked once in a time to live, over all micro-batches.

State is kept by host: the answers of its targets, and when the host may be asked next. So the host's rate holds across
micro-batches, and a restart from the checkpoint asks nothing twice. A target whose host was too busy gets a timer and is
asked again when it fires, at most `Limits.retries` times."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from proseloom.functions import text as T
from proseloom.sources.probe import Asking, Limits, Probe, host_of, seconds_of

CHECKED = "target string, code int, retry_after string, failure string, asked_ms long"
KNOWN = "code int, tries int, asked_ms long"


class TargetProcessor(StatefulProcessor):
    def __init__(self, probe: Probe, ttl_ms: int, limits: Limits, head_first: bool = True):
        self.probe, self.ttl_ms, self.limits, self.head_first = probe, ttl_ms, limits, head_first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "target string", KNOWN, self.ttl_ms)
        self.busy = handle.getMapState("busy", "target string", "due_ms long, tries int")
        self.next = handle.getValueState("next", "free_s double")

    def _asked(self, host: str, targets: list[tuple[str, int]]) -> pd.DataFrame:
        """The answers of targets, each with how often it was asked before; the state and the timers follow them."""
        asking = Asking(self.probe, replace(self.limits, retries=0), self.head_first)
        free = self.next.get()
        # The loop's clock is monotonic, the state's is the wall's.
        asking.next[host] = time.monotonic() + max(0.0, (free[0] if free else 0.0) - time.time())
        out = []
        for (target, code, after, failure), (_, tries) in zip(asking.answers([(host, t) for t, _ in targets]), targets, strict=True):
            now = int(time.time() * 1000)
            out.append((target, code, after, failure, now))
            self.known.updateValue((target,), (code, tries, now))
            if code in (429, 503) and tries < self.limits.retries:
                wait = seconds_of(after)
                due = now + int(1000 * min(self.limits.patience, self.limits.pause * 2**tries if wait is None else wait))
                self.busy.updateValue((target,), (due, tries + 1))
                self.handle.registerTimer(due)
        self.next.update((time.time() + max(0.0, asking.next[host] - time.monotonic()),))
        return pd.DataFrame(out, columns=[c.split()[0] for c in CHECKED.split(", ")]).astype({"code": "Int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, None] = {}
        for b in rows:
            for target in b["target"]:
                if target not in new and not self.known.containsKey((target,)):
                    new[target] = None
            if len(new) >= 1000:
                yield self._asked(key[0], [(t, 0) for t in new])
                new = {}
        if new:
            yield self._asked(key[0], [(t, 0) for t in new])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        due = [(k[0], v[1]) for k, v in self.busy.iterator() if v[0] <= at]
        for target, _ in due:
            self.busy.removeKey((target,))
        if due:
            yield self._asked(key[0], due)

    def close(self) -> None:
        pass


def checked(targets: DataFrame, probe: Probe, ttl_ms: int, limits: Limits | None = None, head_first: bool = True) -> DataFrame:
    """CHECKED of a stream of targets that the URL policy allows: an answer for each that isn't known, and again after its
    time to live. Repeats within a micro-batch reach the host's state once for each row."""
    asked = targets.where(T.url_refusal(F.col("target")).isNull()).select("target", host_of(F.col("target")).alias("host"))
    processor = TargetProcessor(probe, ttl_ms, limits or Limits(), head_first)
    return asked.groupBy("host").transformWithStateInPandas(processor, CHECKED, "append", "processingTime")
