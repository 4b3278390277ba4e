"""Operator 11: mixing sources to target weights by the cube method, balanced on tokens and documents.

A source's target is its weighted share of all words, at most MOST_REPEATS times its own; what is over goes to the others
by weight. Each document of a source is wanted target / size times: it is taken the whole part of that, and once more with
the fractional part as its inclusion probability. The cube method decides the latter. Its flight takes three undecided
documents at a time and moves their probabilities along the one direction that changes neither the expected number of
documents nor of words, as far as one of them gets to 0 or 1; which of the two ends is drawn so that each expected
probability stays what it was. Cells of some CELL documents of one source fly on their own and leave two undecided
documents each at most; these fly again, cells of a source together, until two a source are left. Landing decides them by
a linear program in one unknown (how likely both are taken) that keeps both probabilities and has the least expected
squared error in documents and words. Large documents fly first, so what is left is small.

Cells are made by a hash of id, size and number of the copy, and each has its own seed, so reruns agree however the
input is split. A document that is repeated is numbered by counts of its input partitions, so copies go to different
cells. Only ids, sources and sizes are shuffled. Weights follow the sources' order over all distinct sources, whose
table may be large: it is joined with its hot keys sent to the rows, and levels are found by sums over it.

Nulls: a null text has size 0; a null source is a source, the last; a null id hashes as a null. Documents of size 0 are
never worth a word but are counted in their source's documents. A source without words has target 0. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, numbered, scratch, spread_join, staged, table

WEIGHTS, MOST_REPEATS, SEED = (1, 2, 3), 3, 11
CELL, CELLS_TOGETHER = 1_000, 500
NEAR = 1e-9


def fly(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> None:
    """Moves the probabilities p to 0 or 1 in place, but for two at most; sums of p and of p * size stay."""
    todo = [int(i) for i in np.flatnonzero((p > NEAR) & (p < 1 - NEAR))][::-1]
    sizes, probs, draws, used = size.tolist(), p.tolist(), rng.random(len(todo)).tolist(), 0
    active: list[int] = []
    while True:
        while len(active) < 3 and todo:
            active.append(todo.pop())
        if len(active) < 2:
            break
        if len(active) == 2:
            # Two documents of one size can still move against each other.
            a, b = active
            if sizes[a] != sizes[b]:
                break
            way = [1.0, -1.0]
        else:
            a, b, c = (float(sizes[i]) for i in active)
            way = [b - c, c - a, a - b]
            if not any(way):
                way = [1.0, -1.0, 0.0]
        up = down = math.inf
        for i, w in zip(active, way, strict=True):
            if w > 0:
                up, down = min(up, (1 - probs[i]) / w), min(down, probs[i] / w)
            elif w < 0:
                up, down = min(up, -probs[i] / w), min(down, (probs[i] - 1) / w)
        step = up if draws[used] * (up + down) < down else -down
        used += 1
        still = []
        for i, w in zip(active, way, strict=True):
            x = probs[i] + step * w
            probs[i] = 0.0 if x < NEAR else 1.0 if x > 1 - NEAR else x
            if 0.0 < probs[i] < 1.0:
                still.append(i)
        active = still
    p[:] = probs


def land(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> None:
    """Decides the one or two probabilities that are left, in place."""
    left = np.flatnonzero((p > 0) & (p < 1))
    if len(left) == 1:
        p[left] = float(rng.random() < p[left[0]])
    elif len(left) == 2:
        (x, y), (a, b) = p[left], size[left].astype(float)
        scale = max(1.0, a, b)
        # Squared error of an outcome; the expected error is linear in the probability of taking both.
        error = lambda i, j: (i + j - x - y) ** 2 + ((i * a + j * b - x * a - y * b) / scale) ** 2
        slope = error(1, 1) - error(1, 0) - error(0, 1) + error(0, 0)
        both = max(0.0, x + y - 1) if slope > 0 else min(x, y)
        at = np.searchsorted(np.cumsum([both, x - both, y - both]), rng.random(), "right")
        p[left] = [(1, 1), (1, 0), (0, 1), (0, 0)][at]


def flight(rows: DataFrame, keys: list[str], landing: bool, seed: int) -> DataFrame:
    """rows (source_no, p, size, h, ...) with the probabilities of each group of keys decided but for two (``landing``:
    all of them)."""

    def one(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["size", "h", "copy"], ascending=[False, True, True], kind="stable")
        p, rng = cell["p"].to_numpy().copy(), np.random.default_rng([seed, *(int(k) for k in key)])
        fly(p, cell["size"].to_numpy(), rng)
        if landing:
            land(p, cell["size"].to_numpy(), rng)
        return cell.assign(p=p)

    return rows.groupBy(*keys).applyInPandas(one, rows.schema)


def sized_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, size of every document."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))


def targets(sources: DataFrame, rows: int, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """sources (source, source_size, n: distinct sources) with source_no from 1 and target."""
    keyed = sources.select("*", F.col("source").isNull().cast("int").alias("last"), F.coalesce("source", F.lit("")).alias("name"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights)).cast("int") + 1)
    placed = staged(numbered(keyed, ["last", "name"], "source_no", rows).drop("last", "name").withColumn("source_no", F.col("source_no") - 1).withColumn("weight", w.cast("double")), "sources")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    # The level a unit of weight gets rises with each round, as more sources are full; it ends when none is added.
    level, full = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * level > most * F.col("source_size")
        held, free, n = placed.agg(F.sum(F.when(over, most * F.col("source_size"))), F.sum(F.when(~over, F.col("weight"))), F.sum(over.cast("long"))).first()
        if n == full or n is None or not free:
            break
        level, full = (total - (held or 0)) / free, n
    target = F.lit(0.0) if level is None else F.least(F.col("weight") * level, (most * F.col("source_size")).cast("double"))
    return placed.withColumn("target", target.cast("double"))


def copies(rows: DataFrame) -> DataFrame:
    """rows (doc_id, source, size) with the number of each among those equal to it; no row of a document that is repeated
    very often is sent to where the others are."""
    same = ["doc_id", "source", "size"]
    counted = rows.withColumn("part", F.spark_partition_id()).groupBy(*same, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    based = counted.withColumn("base", F.coalesce(before, F.lit(0)))
    single = based.where("n = 1").select(*same, F.col("base").alias("copy"))
    # Those that an input partition holds several times are dealt out before they are multiplied.
    many = based.where("n > 1").repartition("doc_id", "part").select(*same, F.explode(F.sequence(F.col("base"), F.col("base") + F.col("n") - 1)).alias("copy"))
    return single.unionByName(many)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST_REPEATS, seed: int = SEED, cell: int = CELL) -> DataFrame:
    """doc_id, size, source_size, target (of the document's source), taken (words, repeats counted) of every document."""
    with scratch(docs.sparkSession):
        rows = staged(copies(staged(sized_rows(docs), "sizes")), "copies")
        sources = staged(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "source-sizes")
        n_sources, n_rows, largest = sources.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        aims = targets(sources, n_sources, weights, most)
        key = lambda c: F.concat(F.when(F.col(c).isNull(), "0").otherwise("1"), F.coalesce(F.col(c), F.lit("")))
        both = spread_join(rows.withColumn("key", key("source")).drop("source"), aims.withColumn("key", key("source")).drop("source"), "key", n_rows, largest)
        rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        whole = F.floor(rate + NEAR)
        h = F.xxhash64("doc_id", "size", "copy")
        cells = F.ceil(F.col("n") / cell)
        wanted = both.select(
            "doc_id", "size", "source_size", "target", "source_no", "copy", h.alias("h"), F.pmod(h, cells).cast("long").alias("cell"), whole.cast("long").alias("whole"), F.greatest(F.lit(0.0), rate - whole).alias("p"),
        )
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        decided, left = [], flight(wanted, ["source_no", "cell"], False, seed)
        while True:
            left = staged(left, "flight")
            decided.append(left.where(~undecided))
            left = left.where(undecided)
            if left.groupBy("source_no", "cell").count().where("cell > 0").isEmpty():
                break
            left = flight(left.withColumn("cell", F.floor(F.col("cell") / CELLS_TOGETHER)), ["source_no", "cell"], False, seed + len(decided))
        decided.append(flight(left, ["source_no"], True, seed - 1))
        out = decided[0]
        for more in decided[1:]:
            out = out.unionByName(more)
        taken = F.col("size") * (F.col("whole") + F.col("p").cast("long"))
        return staged(out.select("doc_id", "size", "source_size", "target", taken.alias("taken")), "mix", keep=True)


def op11_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
