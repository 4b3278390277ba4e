"""Operator 3: exact top-k by a Voronoi join on integer inner products.

Data and queries belong to the cell of their nearest pivot; pivots are rows, sqrt(N) of them (16 to MOST_PIVOTS). A
cell's summary is its row count, largest norm, smallest and largest distance to the pivot, and the k + 1 smallest
distances. From summaries alone a query q has

* a floor: k rows besides q's own surely score at least q.p - |q| d, d being the (k + 1)-th distance of some cell;
* for each cell a ceiling, the least of q.p + |q| r, |q| times the largest norm, and (|q|^2 + norm^2 - d^2) / 2, where d
  is the least distance that the ring around the pivot and the bisector towards q's own pivot allow.

Cells are solved in groups of near pivots, of some BLOCK rows. Each query first meets its home group, which raises its
floor; it is then copied only to groups with a cell whose ceiling reaches the floor. Queries are the small side (one row
in a hundred), so they are what is copied; data moves once, and groups are cut into blocks of at most BLOCK rows or so.
The blocks are solved locally and the local tops merged. Where vectors are spread evenly over many dimensions no bound
can tell cells apart, and every block is met; `cells_reached` tells how many are.

Components become floor(1024 x), whole numbers in doubles of any size a double has. Products are exact: pairs whose
norms allow sums of 2^53 or more are computed in whole numbers of any size, and ranked by them; only the score returned
is held within the range of a long. Vectors with a component beyond FAR get no bounds: their cells are always met, and
they meet every cell.

Every row divisible by ``every`` asks, and every row but the one that asks answers (``by_row``, as op3's contract has it):
rows that repeat an id ask each for itself and answer each other. Without ``by_row`` an id asks once, by the smallest
(compared component by component) of its vectors, and none of its rows answers. For tables whose ids are there and unique
the two, and the SQL, are the same.

Nulls: vectors that are null, or hold a null or non-finite component, take no part. Rows with a null vec_id don't ask,
but answer, after all others in ties. Shorter vectors count as padded with zeros. Repeated rows all take part. An empty
table, or one without queries, gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, staged, table

MOST_PIVOTS, BLOCK = 16_384, 8192
EXACT, LONG, FAR = 2.0**53, 2**63, 2.0**100


def integers(vectors: DataFrame) -> DataFrame:
    """has_id, vec_id (0 for null), v: arrays of floor(1024 x); rows that take no part are left out."""
    e, most = F.col("embedding"), F.lit(sys.float_info.max)
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))

    def whole(x):
        y = F.greatest(F.least(x.cast("double") * 1024, most), -most)
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # from 2^53 on doubles are whole

    return vectors.where(e.isNotNull() & ~F.coalesce(odd, F.lit(False))).select(
        F.col("vec_id").isNotNull().alias("has_id"), F.coalesce(F.col("vec_id").cast("long"), F.lit(0)).alias("vec_id"), F.transform(e, whole).alias("v"))


def _matrix(vectors, width: int) -> np.ndarray:
    if all(len(v) == width for v in vectors):
        return np.array([np.asarray(v, np.float64) for v in vectors], np.float64).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _best(scores: np.ndarray, exact: dict[int, dict[int, int]], ids: np.ndarray, has_id: np.ndarray, own: np.ndarray, k: int, floor: float) -> np.ndarray:
    """The places of a query's best k of a block that reach its floor, ties to smaller ids, null last."""
    bar = min(floor, float(LONG))  # scores are held there
    at = np.nonzero(~own & (scores >= bar - 1e-9 * abs(bar)) if np.isfinite(bar) else ~own)[0]
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
        if exact:
            at = np.array(sorted(at.tolist(), key=lambda j: (-exact.get(j, int(scores[j])), not has_id[j], ids[j])), np.int64)[:k]
        else:
            at = at[np.lexsort((ids[at], ~has_id[at], ~scores[at]))][:k]
    return at


def products(q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, dict[int, dict[int, int]]]:
    """Inner products of rows of whole numbers, exact, held within longs; and by row and column those that were computed
    in whole numbers of any size, as they are."""
    with np.errstate(over="ignore", invalid="ignore"):
        scores = q @ d.T
        large = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((d * d).sum(1)) >= 0.99 * EXACT
    exact: dict[int, dict[int, int]] = {}
    if not large.any():
        return scores.astype(np.int64), exact
    out = np.where(large, 0, scores).astype(np.int64)
    whole = {}
    for i, j in np.argwhere(large).tolist():
        for side, m, n in (("q", q, i), ("d", d, j)):
            if (side, n) not in whole:
                whole[side, n] = [int(x) for x in m[n]]
        true = exact.setdefault(i, {})[j] = sum(a * b for a, b in zip(whole["q", i], whole["d", j], strict=True))
        out[i, j] = min(LONG - 1, max(-LONG, true))
    return out, exact


def beyond(score: int) -> bytes | None:
    """Bytes that sort like the scores at and beyond the ends of a long; none within."""
    if -LONG < score < LONG - 1:
        return None
    raw = abs(score).to_bytes((abs(score).bit_length() + 7) // 8)
    raw = len(raw).to_bytes(4) + raw
    return b"\x01" + raw if score > 0 else b"\x00" + bytes(255 - x for x in raw)


class Summary:
    """Pivots and what is known of their cells, a fixed number of numbers each."""

    def __init__(self, centre: np.ndarray, rows: list, k: int):
        self.centre, self.k = centre, k
        n = len(centre)
        self.count, self.norm, self.low, self.high = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.full(n, -np.inf)
        self.near = np.full((n, k + 1), np.inf)
        for r in rows:
            c = r["cell"]
            self.count[c], self.norm[c], self.low[c], self.high[c] = r["n"], r["norm"], r["low"], r["high"]
            self.near[c, : len(r["near"] or [])] = sorted(r["near"] or [])
        self.between = None

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query its floor, and the ceiling of each cell (minus infinity: empty)."""
        far_out = (np.abs(q) > FAR).any(1)
        q = q.clip(-FAR, FAR)
        size = np.sqrt((q * q).sum(1))[:, None]
        dot = q @ self.centre.T
        own = (self.centre * self.centre).sum(1)
        away = np.sqrt(np.maximum(0, size**2 - 2 * dot + own))
        home = away.argmin(1)
        slack = 1e-9 * (size * (self.norm + np.sqrt(own)) + size**2 + self.norm**2) + 1e-3
        with np.errstate(invalid="ignore", divide="ignore"):
            gap = own[home][:, None] - 2 * self.centre[home] @ self.centre.T + own
            bisector = (away**2 - away[np.arange(len(q)), home][:, None] ** 2) / (2 * np.sqrt(np.maximum(0, gap)))
            bisector = np.where(gap > 1e-6 * (own[home][:, None] + own), bisector, 0)  # of near pivots the gap is not sure
            far = np.maximum(np.maximum(away - self.high, self.low - away), np.nan_to_num(bisector, nan=0.0, posinf=0.0, neginf=0.0))
            far = np.maximum(0, far - 1e-6 * (size + np.sqrt(own)))
            ceiling = np.minimum(np.minimum(dot + size * self.high, size * self.norm), (size**2 + self.norm**2 - far**2) / 2) + slack
            sure = dot - size * self.near[:, -1] - slack
            one = dot - size * self.near[:, 0] - slack
        ceiling = np.where(np.isinf(self.norm) | far_out[:, None], np.inf, ceiling)
        floor = np.where(np.isnan(sure), -np.inf, sure).max(1)
        if one.shape[1] > self.k:  # one row each of k + 1 cells
            floor = np.maximum(floor, np.partition(np.where(np.isnan(one), -np.inf, one), -self.k - 1, axis=1)[:, -self.k - 1])
        return np.where(far_out, -np.inf, floor), np.where(self.count > 0, ceiling, -np.inf)


class Join:
    """The staged vectors in their cells, the summary, and the groups that cells are solved in."""

    def __init__(self, vectors: DataFrame, k: int, every: int, pivots: int | None, block: int, by_row: bool):
        # The key tells the row that asks from the others.
        data = staged(integers(vectors).withColumn("key", F.monotonically_increasing_id() if by_row else F.col("vec_id")), "vectors")
        size = data.agg(F.max(F.size("v")), F.count("*")).first()
        self.any = size[1] > 0
        if not self.any:
            return
        width = self.width = max(1, size[0])
        count = pivots or min(MOST_PIVOTS, max(16, math.isqrt(size[1])))
        chosen = data.select("vec_id", "v").distinct().orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(count).collect()  # a bounded number
        centre = np.unique(_matrix([r["v"] for r in chosen], width).clip(-FAR, FAR), axis=0)
        centre = centre[np.random.default_rng(3).permutation(len(centre))]

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = (centre * centre).sum(1)
            for b in batches:
                for at in range(0, len(b), 1024):
                    some = b.iloc[at : at + 1024]
                    m = _matrix(some["v"].tolist(), width)
                    out = (np.abs(m) > FAR).any(1)
                    m = m.clip(-FAR, FAR)
                    norm = (m * m).sum(1)
                    d = norm[:, None] - 2 * m @ centre.T + own
                    cell = d.argmin(1)
                    yield some.assign(cell=cell.astype(np.int32), far=np.where(out, np.inf, np.sqrt(((m - centre[cell]) ** 2).sum(1))), norm=np.where(out, np.inf, np.sqrt(norm)))

        self.celled = staged(data.mapInPandas(assign, "has_id boolean, vec_id long, v array<double>, key long, cell int, far double, norm double"), "celled")
        # At most one of these rows is a query's own: without by_row, the nearest of each id.
        sole = self.celled if by_row else self.celled.groupBy("has_id", "vec_id").agg(F.min(F.struct("far", "cell")).alias("s")).select("s.*")
        nearest = sole.select("cell", "far", F.row_number().over(Window.partitionBy("cell").orderBy("far")).alias("r")).where(F.col("r") <= k + 1)
        nearest = nearest.groupBy("cell").agg(F.collect_list("far").alias("near"))  # k + 1 a cell
        cells = self.celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.min("far").alias("low"), F.max("far").alias("high"))
        self.summary = Summary(centre, cells.join(nearest, "cell", "left").collect(), k)  # one row a pivot
        # Groups: pivots by the nearest of the first few.
        few = centre[: max(1, -(-size[1] // block))]
        self.group = ((few * few).sum(1) - 2 * centre @ few.T).argmin(1).astype(np.int32)
        rows = np.bincount(self.group, self.summary.count, len(few)).astype(np.int64)
        self.parts = np.maximum(1, -(-rows // block))
        # Of the types that the queries' keys have: a cogroup hashes an int and a long of one value to different partitions.
        maps = self.celled.sparkSession.createDataFrame(list(zip(range(len(centre)), self.group.tolist(), self.parts[self.group].tolist(), strict=True)), "cell int, group int, cuts int")
        grouped = self.celled.join(F.broadcast(maps), "cell")  # one row a pivot
        self.dealt = grouped.select("key", "has_id", "vec_id", "v", "group", F.pmod(F.xxhash64("key", "v", F.lit(3)), F.col("cuts")).cast("int").alias("part"))
        asking = self.celled.where(F.col("has_id") & (F.col("vec_id") % every == 0))
        asking = asking if by_row else asking.groupBy("key", "vec_id").agg(F.min("v").alias("v"))  # the smallest vector asks
        self.queries = staged(asking.select("key", F.col("vec_id").alias("query_id"), "v"), "queries")


ASKED = "key long, query_id long, v array<double>, group int, cuts int, floor double"
SOLVED = "key long, query_id long, has_id boolean, vec_id long, score long, beyond binary"
_NAMES = [c.split()[0] for c in ASKED.split(", ")]


def at_home(join: Join) -> DataFrame:
    """ASKED: the queries with their home groups."""
    summary, group, parts, width = join.summary, join.group, join.parts, join.width

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                some = b.iloc[at : at + 256]
                m = _matrix(some["v"].tolist(), width)
                floor, _ = summary.bounds(m)
                m = m.clip(-FAR, FAR)
                own = group[((m * m).sum(1)[:, None] - 2 * m @ summary.centre.T + (summary.centre**2).sum(1)).argmin(1)]
                yield some.assign(group=own, cuts=parts[own].astype(np.int32), floor=floor)[_NAMES]

    return join.queries.mapInPandas(run, ASKED)


def reached(join: Join, known: DataFrame) -> DataFrame:
    """ASKED: the queries, which come with their home group and the floor known, with all other groups that have a cell
    whose ceiling reaches the floor."""
    summary, group, parts, width = join.summary, join.group, join.parts, join.width

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                some = b.iloc[at : at + 256].reset_index(drop=True)
                floor = some["floor"].to_numpy()
                need = np.zeros((len(some), len(parts)), bool)
                i, c = np.nonzero(summary.bounds(_matrix(some["v"].tolist(), width))[1] >= floor[:, None])
                need[i, group[c]] = True
                need[np.arange(len(some)), some["group"]] = False
                i, g = np.nonzero(need)
                yield some.iloc[i].assign(group=g.astype(np.int32), cuts=parts[g].astype(np.int32))[_NAMES]

    return known.select(*_NAMES).mapInPandas(run, ASKED)


def cells_reached(vectors: DataFrame, k: int = 10, every: int = 100, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, cells, cells_reached by the summaries alone: what the bounds spare before any vector is compared."""
    join = Join(vectors, k, every, pivots, block, False)
    schema = "query_id long, cells int, cells_reached int"
    if not join.any:
        return vectors.sparkSession.createDataFrame([], schema)
    summary, width = join.summary, join.width

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            floor, ceiling = summary.bounds(_matrix(b["v"].tolist(), width))
            yield pd.DataFrame({"query_id": b["query_id"], "cells": np.int32((summary.count > 0).sum()), "cells_reached": (ceiling >= floor[:, None]).sum(1).astype(np.int32)})

    return join.queries.mapInPandas(run, schema)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, pivots: int | None = None, block: int = BLOCK, by_row: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score for the ids that are divisible by ``every``, or for each row that has such an id."""
    with scratch(vectors.sparkSession):
        return _top_k(vectors, k, every, pivots, block, by_row)


def _top_k(vectors: DataFrame, k: int, every: int, pivots: int | None, block: int, by_row: bool) -> DataFrame:
    join = Join(vectors, k, every, pivots, block, by_row)
    if not join.any:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = join.width
    names = [c.split()[0] for c in SOLVED.split(", ")]

    def solve(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=names)]
        if len(q) and len(d):
            ids, has_id, keys, m = d["vec_id"].to_numpy(), d["has_id"].to_numpy(bool), d["key"].to_numpy(), _matrix(d["v"].tolist(), width)
            for at in range(0, len(q), 256):
                some = q.iloc[at : at + 256]
                scores, exact = products(_matrix(some["v"].tolist(), width), m)
                for i, r in enumerate(some[["key", "query_id", "floor"]].itertuples(index=False)):
                    true = exact.get(i, {})
                    best = _best(scores[i], true, ids, has_id, (keys == r.key) & (by_row | has_id), k, r.floor)
                    out.append(pd.DataFrame({"key": r.key, "query_id": r.query_id, "has_id": has_id[best], "vec_id": ids[best], "score": scores[i, best], "beyond": [beyond(true[j]) if j in true else None for j in best.tolist()]}))
        return pd.concat([x for x in out if len(x)] or out)

    def local(asked: DataFrame) -> DataFrame:
        """The asked queries meet every block of their group."""
        each = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        solved = each.groupBy("group", "part").cogroup(join.dealt.groupBy("group", "part")).applyInPandas(solve, SOLVED)
        return solved.withColumn("vec_id", F.when(F.col("has_id"), F.col("vec_id"))).drop("has_id")

    order = Window.partitionBy("key").orderBy(F.desc("score"), F.desc("beyond"), F.asc_nulls_last("vec_id"))
    first = staged(at_home(join), "at-home")
    home = staged(local(first), "home")
    score = F.when(F.col("score") > -LONG, F.col("score").cast("double"))  # a score held at the low end says nothing
    kth = home.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("key", score.alias("kth"))
    known = first.join(kth, "key", "left").withColumn("floor", F.greatest("floor", "kth"))
    every_ = home.unionByName(local(reached(join, known))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return staged(every_.select("query_id", "rank", "vec_id", "score"), "top-k", keep=True)


def op3_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), by_row=True)


SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
  FROM (SELECT * FROM ok WHERE vec_id % 100 = 0) q, ok d WHERE q.vec_id <> d.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
