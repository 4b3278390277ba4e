"""Existence checks of cited URLs and DOIs through an injected probe, once per distinct target.

A probe is a picklable callable (method, url) -> (status, retry_after) that raises OSError when there is no answer;
`http_probe` makes one for real servers. Targets the URL policy refuses never reach it. Duplicates are removed before,
results joined back after; citations are written once in between, so documents aren't parsed again for the join.

Targets are dealt out by host, so a host's limits hold in one place: an event loop a task keeps `Limits.together` requests
under way at once, each host gets at most `Limits.rate` starts a second, and a host that answers 429 or 503 with
Retry-After is left alone for that long before it is asked again."""

from __future__ import annotations

import asyncio
import email.utils
import http.client
import ipaddress
import socket
import time
import urllib.parse
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseloom.functions import text as T
from proseloom.sources.staging import staged

WORKS = "https://api.crossref.org/works/"
Probe = Callable[[str, str], tuple[int, str | None]]
ANSWER = "target string, code int, retry_after string, failure string"


@dataclass(frozen=True)
class Limits:
    """rate: starts a second and host. timeout: seconds until a request has no answer. retries: how often a busy host is
    asked again, after what it asked for or after ``pause``, doubled each time; ``patience``: seconds it may ask for."""

    rate: float = 5.0
    together: int = 32
    timeout: float = 10.0
    retries: int = 2
    pause: float = 1.0
    patience: float = 60.0


def seconds_of(retry_after: str | None, now: float | None = None) -> float | None:
    """What a Retry-After header asks for, a number of seconds or a date; of several values the first. Null if neither."""
    value = (retry_after or "").strip()
    if value.split(",")[0].strip().isdigit():
        return float(value.split(",")[0])
    try:
        return max(0.0, email.utils.parsedate_to_datetime(value).timestamp() - (time.time() if now is None else now))
    except (TypeError, ValueError):
        return None


class Asking:
    """The requests of one task: when each host may be asked next, and how many are under way."""

    def __init__(self, probe: Probe, limits: Limits, head_first: bool = True):
        self.probe, self.limits, self.head_first = probe, limits, head_first
        self.next: dict[str, float] = {}

    async def _turn(self, host: str) -> None:
        """Waits for the host's next start, which is 1/rate seconds after the one before."""
        while True:
            now, at = time.monotonic(), self.next.get(host, 0.0)
            if at <= now:
                self.next[host] = now + 1 / self.limits.rate
                return
            await asyncio.sleep(at - now)

    async def _once(self, pool: ThreadPoolExecutor, method: str, host: str, target: str) -> tuple[int, str | None]:
        await self._turn(host)
        return await asyncio.wait_for(asyncio.get_running_loop().run_in_executor(pool, self.probe, method, target), self.limits.timeout)

    async def _answer(self, pool: ThreadPoolExecutor, gate: asyncio.Semaphore, host: str, target: str) -> tuple:
        limits, method, tries = self.limits, "HEAD" if self.head_first else "GET", 0
        while True:
            try:
                async with gate:
                    code, after = await self._once(pool, method, host, target)
            except TimeoutError:
                return target, None, None, f"no answer within {limits.timeout:g} seconds"
            except OSError as fault:
                return target, None, None, str(fault)
            if method == "HEAD" and code in (403, 405, 501):
                method = "GET"
                continue
            wait = seconds_of(after)
            wait = limits.pause * 2**tries if wait is None else wait
            if code not in (429, 503) or tries == limits.retries or wait > limits.patience:
                return target, code, after, None
            tries += 1
            self.next[host] = max(self.next.get(host, 0.0), time.monotonic() + wait)

    def answers(self, targets: list[tuple[str, str]]) -> list[tuple]:
        """ANSWER of (host, target) pairs, in their order."""

        async def every() -> list[tuple]:
            gate = asyncio.Semaphore(self.limits.together)
            return list(await asyncio.gather(*[self._answer(pool, gate, h, t) for h, t in targets]))

        pool = ThreadPoolExecutor(self.limits.together)
        try:
            return asyncio.run(every())
        finally:
            pool.shutdown(wait=False, cancel_futures=True)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def answers(targets: DataFrame, probe: Probe, head_first: bool = True, limits: Limits | None = None) -> DataFrame:
    """ANSWER of distinct targets. A refused HEAD (403, 405, 501) is asked again by GET."""
    bounds = limits or Limits()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asking = Asking(probe, bounds, head_first)
        for b in batches:
            for at in range(0, len(b), 1000):
                some = b.iloc[at : at + 1000]
                found = asking.answers(list(zip(some["host"], some["target"], strict=True)))
                yield pd.DataFrame(found, columns=["target", "code", "retry_after", "failure"]).astype({"code": "Int32"})

    each = targets.select("target").distinct().withColumn("host", host_of(F.col("target")))
    # Hosts in turn, so that a slow one doesn't hold up a batch of its own.
    dealt = each.repartition("host").withColumn("turn", F.xxhash64("target")).sortWithinPartitions("turn").select("host", "target")
    return dealt.mapInPandas(run, ANSWER)


def http_probe(timeout: float = 10.0, hops: int = 5, agent: str = "proseloom/0.3 (+citation-check)") -> Probe:
    """A probe that asks servers over HTTP(S) for headers only: at most so many redirects, and no connection to addresses
    that aren't public, whatever name leads there."""

    def ask(method: str, url: str) -> tuple[int, str | None]:
        for _ in range(hops + 1):
            at = urllib.parse.urlsplit(url)
            if at.scheme not in ("http", "https") or not at.hostname:
                raise OSError(f"redirected to {at.scheme or 'nowhere'}")
            port = at.port or (443 if at.scheme == "https" else 80)
            found = socket.getaddrinfo(at.hostname, port, type=socket.SOCK_STREAM)
            if not all(ipaddress.ip_address(a[4][0]).is_global for a in found):
                raise OSError("not a public address")
            kind = http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection
            connection = kind(at.hostname, port, timeout=timeout)
            try:
                connection.request(method, urllib.parse.urlunsplit(("", "", at.path or "/", at.query, "")), headers={"User-Agent": agent, "Host": at.netloc.rpartition("@")[2]})
                reply = connection.getresponse()
                onward = reply.getheader("Location")
                if reply.status in (301, 302, 303, 307, 308) and onward:
                    url = urllib.parse.urljoin(url, onward)
                    continue
                return reply.status, (reply.headers.get_all("Retry-After") or [None])[0]
            except http.client.HTTPException as fault:
                raise OSError(str(fault) or type(fault).__name__) from fault
            finally:
                connection.close()
        raise OSError(f"more than {hops} redirects")

    return ask


def _told(code, failure, registry: bool, after=None):
    status = F.when(code.isNull(), "Unreachable").otherwise(T.status_class(code))
    return status, F.when(code.isNull(), F.concat(F.lit("no response: "), failure)).otherwise(T.status_text(code, registry, after))


def check_citations(citations: DataFrame, probe: Probe, limits: Limits | None = None) -> DataFrame:
    """Citation rows (with url) plus status and reason."""
    judged = staged(citations.withColumn("refusal", T.url_refusal(F.col("url"))), "citations")
    found = answers(judged.where("refusal is null").select(F.col("url").alias("target")), probe, limits=limits)
    status, reason = _told(F.col("code"), F.col("failure"), False)
    both = judged.join(found, F.col("url") == F.col("target"), "left")
    refused = F.col("refusal").isNotNull()
    return both.select(*citations.columns, F.when(refused, "Skipped").otherwise(status).alias("status"), F.when(refused, F.concat(F.lit("not fetched: "), F.col("refusal"))).otherwise(reason).alias("reason"))


def check_dois(rows: DataFrame, probe: Probe, column: str = "url", limits: Limits | None = None) -> DataFrame:
    """Rows plus status and reason; only values that are one bare DOI are asked of the registry."""
    value = F.lower(F.regexp_extract(F.trim(column), r"^(10\.\d{4,}(?:\.\d+)*/[^\s\"<>]*[^\s\"<>.,;:!?')\]}])$", 1))
    keyed = staged(rows.withColumn("target", F.when(value != "", F.concat(F.lit(WORKS), value))), "dois")
    found = answers(keyed.where("target is not null"), probe, head_first=False, limits=limits)
    status, reason = _told(F.col("code"), F.col("failure"), True, F.col("retry_after"))
    both = keyed.join(found, "target", "left")
    other = F.col("target").isNull()
    return both.select(*rows.columns, F.when(other, "Skipped").otherwise(status).alias("status"), F.when(other, "not fetched: not a doi").otherwise(reason).alias("reason"))
