"""Operator 13: importance resampling towards the benchmark's words, weights by bit-sliced aggregation.

Words are hashed into BUCKETS buckets. A document's bucket counts become bit planes: bit b of plane k is bit k of its
count in bucket b. The gains of the buckets are planes too, those of gains above zero apart from those below. The sum of
count * gain is then the sum over pairs of planes of 2^(k + j) times the bits both have set, exact in integers, and costs
as much for a document of ten words as for one that fills all buckets.

One pass reads the texts: it stores each document's planes, and of each partition the counts of all buckets, which are
summed (BUCKETS rows from each partition, combined there). The gains are BUCKETS numbers whatever the size of the corpus.
Scores are integers and lie within some 100,000 of each other, since gains and noise are logarithms: the number of
documents by score is a table of bounded size, from which the lowest drawn score follows. Only drawn rows are numbered,
by ranges of (score, id).

Nulls: a null text has no words and weight 0; the noise of a null id is that of an empty one, and it is ordered as the
largest long. Repeated rows count and are drawn as often as they occur. Empty tables give an empty result; an empty
benchmark leaves every gain to the corpus. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_bytes, numbered, scratch, staged, table, terms_of, with_nulls, worker_cache

BUCKETS = 10_000
SEED, LEAST_WORDS, PERCENT = 2024, 20, 10
DOCS_A_BATCH = 512
PLANES = "has_id boolean, doc_id long, n_features long, planes array<binary>, counts array<long>"


class _Buckets(dict):
    """Buckets of words, looked up once each."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = crc32(word) % BUCKETS
        return found


def planes_of(counts: np.ndarray) -> list[bytes]:
    """Bit planes of non-negative numbers, the lowest first; bit b of a plane, little-endian, is that of counts[b]."""
    width = int(counts.max(initial=0)).bit_length()
    return [np.packbits((counts >> k & 1).astype(np.uint8), bitorder="little").tobytes() for k in range(width)]


def _whole(plane: bytes) -> int:
    return int.from_bytes(plane, "little")


def weighed(planes: list[bytes], plus: list[int], minus: list[int]) -> int:
    """The sum of count * gain over all buckets."""
    total = 0
    for k, plane in enumerate(planes):
        bits = _whole(plane)
        for j, gain in enumerate(plus):
            total += (bits & gain).bit_count() << k + j
        for j, gain in enumerate(minus):
            total -= (bits & gain).bit_count() << k + j
    return total


def sliced(docs: DataFrame) -> DataFrame:
    """PLANES: one row a document (counts null), and one a partition with the counts of its buckets (planes null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = worker_cache("resampling")
        seen, every = cache.setdefault("buckets", _Buckets()), np.zeros(BUCKETS, np.int64)
        names = [c.split()[0] for c in PLANES.split(", ")]
        for b in batches:
            for at in range(0, len(b), DOCS_A_BATCH):
                rows = []
                for known, doc_id, raw in b.iloc[at : at + DOCS_A_BATCH].itertuples(index=False):
                    if len(seen) > 500_000:
                        seen.clear()
                    words = terms_of(raw)
                    counts = np.bincount(np.fromiter(map(seen.__getitem__, words), np.int64, len(words)), minlength=BUCKETS)
                    every += counts
                    rows.append((known, doc_id, len(words), planes_of(counts), None))
                yield pd.DataFrame(rows, columns=names)
        yield pd.DataFrame([(False, 0, 0, None, every)], columns=names)

    return keyed_bytes(docs).mapInPandas(run, PLANES)


def totals(rows: DataFrame) -> np.ndarray:
    """Features by bucket of rows from `sliced`: BUCKETS numbers."""
    each = rows.where("counts is not null").select(F.posexplode("counts").alias("bucket", "n")).where("n > 0")
    out = np.zeros(BUCKETS, np.int64)
    for r in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln(smoothed share in the target / smoothed share in the corpus)) by bucket."""
    s_all, t_all = int(corpus.sum()), int(target.sum())
    return [math.floor(1000 * math.log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]


def noise(doc_id: Column, seed: int) -> Column:
    """A document's Gumbel noise in thousandths, from the first 32 bits of a hash of its id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def scores(rows: DataFrame, gains: list[int], seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score of the documents in rows from `sliced`."""
    g = np.array(gains, np.int64)
    plus, minus = planes_of(np.maximum(g, 0)), planes_of(np.maximum(-g, 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up, down = [_whole(p) for p in plus], [_whole(p) for p in minus]
        for b in batches:
            b["weight"] = [weighed(p, up, down) // n if n else 0 for p, n in zip(b.pop("planes"), b["n_features"].tolist(), strict=True)]
            yield b

    docs = rows.where("planes is not null").select("has_id", "doc_id", "n_features", "planes")
    found = with_nulls(docs.mapInPandas(run, "has_id boolean, doc_id long, n_features long, weight long"))
    return found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def lowest_drawn(scored: DataFrame, least: int, percent: int) -> tuple[int, int | None]:
    """How many documents are drawn of those with ``least`` words, and the lowest score among them (None: none are)."""
    # One row a score: gains and noise are logarithms of bounded ratios, in thousandths, so there are some 100,000 at most.
    by_score = sorted(((r[0], r[1]) for r in scored.where(F.col("n_features") >= least).groupBy("score").count().collect()), reverse=True)
    wanted = sum(n for _, n in by_score) * percent // 100
    above = 0
    for score, n in by_score:
        above += n
        if wanted and above >= wanted:
            return wanted, score
    return 0, None


def resample(docs: DataFrame, target: DataFrame, least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) of every document, for the words of the target's texts."""
    with scratch(docs.sparkSession):
        rows = staged(sliced(docs), "planes")
        aims = sliced(target.select(F.lit(0).alias("doc_id"), "text"))
        gains = gains_of(totals(rows), totals(aims))
        scored = staged(scores(rows, gains, seed), "scores")
        wanted, lowest = lowest_drawn(scored, least, percent)
        none = F.lit(None).cast("long").alias("rank")
        if lowest is None:
            return staged(scored.select("*", none), "resampled", keep=True)
        # Rows of the lowest score that are not drawn are numbered too, beyond the number drawn.
        close = (F.col("n_features") >= least) & (F.col("score") >= lowest)
        order = [(-F.col("score")).alias("down"), F.coalesce("doc_id", F.lit(np.iinfo(np.int64).max)).alias("id")]
        ranked = numbered(scored.where(close).select("*", *order), ["down", "id", "n_features", "weight"], "rank", wanted)
        drawn = ranked.select(*scored.columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
        return staged(drawn.unionByName(scored.where(~close).select("*", none)), "resampled", keep=True)


def op13_bit_sliced_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
