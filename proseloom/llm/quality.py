"""Operator 4: quality classifier, a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]): linear time in the number of
features by the sum-of-squares identity. x holds a document's hashed lower-cased words (square root of the share of the
text), SHAPE structure statistics and the text's length as metadata. labels, lang, source and doc_id are no inputs.

Training is a documented bounded sample: of the labelled rows whose crc32(doc_id as text) mod 3 is not 1, the
``sample`` (8,000) with the smallest hash of doc_id, fitted in one task on features of fixed size. The fitted model has
a fixed size (2^14 + SHAPE rows of 9 numbers) and is what travels to the tasks. Everything else covers all documents.

Nulls: a null text is empty; empty texts get the score of the structure part alone. Labels that are null or neither 0
nor 1 are left out, equal ones count once; of several texts with a labelled id the smallest is learned from. No labels
at all: score 0.5. Repeated rows get equal scores, an empty table an empty result. Extra columns are carried by
`reject`, whatever their names, and ignored else.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_bucket, table, text_or_empty, worker_cache

HASHED, FACTORS, SHAPE = 1 << 14, 8, 16
SAMPLE, EPOCHS, BATCH, RATE = 8000, 6, 128, 0.05


def shape(text: str, words: list[str]) -> list[float]:
    """Structure statistics, each between 0 and about 1."""
    n, count = max(1, len(text)), max(1, len(words))
    lines = text.split("\n")
    letters = sum(map(len, words))
    some = text[:0] if not text else text
    alpha = sum(map(some.count, ".,;:!?'\"()-"))
    symbols = sum(map(some.count, "|#$%&*@<>{}[]_=+~^\\/"))
    digits = sum(map(some.count, "0123456789"))
    distinct = len(set(words))
    ends = some.count(". ") + some.count(".\n") + text.endswith(".")
    upper = sum(w[:1].isupper() for w in words)
    return [
        1.0, min(1.0, np.log1p(count) / 10), min(1.0, letters / count / 12), distinct / count, min(1.0, alpha / count), min(1.0, 4 * symbols / n), min(1.0, 4 * digits / n),
        len({*lines}) / len(lines), min(1.0, np.log1p(n / len(lines)) / 8), min(1.0, 8 * ends / count), upper / count, float(not words), min(1.0, some.count("|") * 2 / count),
        min(1.0, max((len(w) for w in words), default=0) / 40), float(count < 20), min(1.0, np.log1p(n) / 12),
    ]


def rows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, feature numbers and values of the sparse feature matrix, ordered by row."""
    seen = worker_cache("quality")
    if len(seen) > 500_000:
        seen.clear()
    ids, lens, extra = [], [], []
    for text in texts:
        words = text.lower().split()
        for w in words:
            if w not in seen:
                seen[w] = crc32(w.encode("utf-8", "replace")) % HASHED
        ids += [seen[w] for w in words]
        lens.append(len(words))
        extra.append(shape(text, text.split()))
    lens = np.array(lens, np.int64)
    keys, counts = np.unique(np.repeat(np.arange(len(texts)), lens) * HASHED + np.array(ids, np.int64), return_counts=True)
    row = keys // HASHED
    x = np.sqrt(counts / np.maximum(1, lens[row]))
    extra = np.array(extra, np.float64).reshape(len(texts), SHAPE)
    row = np.concatenate([row, np.repeat(np.arange(len(texts)), SHAPE)])
    col = np.concatenate([keys % HASHED, np.tile(np.arange(HASHED, HASHED + SHAPE), len(texts))])
    val = np.concatenate([x, extra.reshape(-1)])
    order = np.argsort(row, kind="stable")
    return row[order], col[order], val[order].astype(np.float32)


def margins(model: np.ndarray, row: np.ndarray, col: np.ndarray, val: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The machine's value of each row, and its factor sums. model: [features, 1 + FACTORS], linear weight first."""
    first = np.searchsorted(row, np.arange(rows))
    part = model[col] * val[:, None]
    sums = np.add.reduceat(part, first, axis=0)
    squares = np.add.reduceat(np.square(part[:, 1:]).sum(1), first)
    return sums[:, 0] + 0.5 * (np.square(sums[:, 1:]).sum(1) - squares), sums[:, 1:]


def fit(row: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, seed: int = 5) -> np.ndarray:
    """Logistic loss, class-balanced to the odds of the sample, Adagrad over mini-batches, fixed seed."""
    rng = np.random.default_rng(seed)
    model = np.zeros((HASHED + SHAPE, 1 + FACTORS), np.float32)
    model[:, 1:] = rng.normal(0, 0.02, (HASHED + SHAPE, FACTORS))
    past = np.full_like(model, 1e-6)
    start = np.searchsorted(row, np.arange(len(y) + 1))
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            n = start[pick + 1] - start[pick]
            index = np.repeat(start[pick] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            r, c, v = np.repeat(np.arange(len(pick)), n), col[index], val[index]
            z, s = margins(model, r, c, v, len(pick))
            slope = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)).astype(np.float32)
            g = np.empty((len(c), 1 + FACTORS), np.float32)
            g[:, 0] = slope[r] * v
            g[:, 1:] = g[:, :1] * (s[r] - model[c, 1:] * v[:, None])
            used, inverse = np.unique(c, return_inverse=True)
            total = np.stack([np.bincount(inverse, g[:, k], len(used)) for k in range(1 + FACTORS)], 1).astype(np.float32)
            total += 1e-6 * model[used]
            past[used] += total**2
            model[used] -= RATE * total / np.sqrt(past[used])
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """The model, from a bounded sample; None if there is nothing to learn from (no rows of either class)."""
    good = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y"))
    good = good.where(crc_bucket("id", 3) != 1).distinct()
    few = good.withColumn("o", F.xxhash64("id", "y")).orderBy("o", "id").limit(sample).drop("o")
    texts = text_or_empty(docs)
    found = texts.join(F.broadcast(few), texts["doc_id"] == few["id"]).groupBy("id", "y").agg(F.min("text").alias("text"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            row, col, val = rows_of(b["text"].tolist())
            cut = np.searchsorted(row, np.arange(len(b) + 1))
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "col": [col[i:j].astype(np.int32).tobytes() for i, j in zip(cut, cut[1:], strict=False)], "val": [val[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)]})

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "y", "col"])
        cols = [np.frombuffer(c, np.int32) for c in rows["col"]]
        row = np.repeat(np.arange(len(rows)), [len(c) for c in cols])
        model = fit(row, np.concatenate(cols), np.frombuffer(b"".join(rows["val"]), np.float32), rows["y"].to_numpy(np.float32))
        return pd.DataFrame({"model": [model.tobytes()]})

    learned = found.mapInPandas(features, "id long, y int, col binary, val binary").withColumn("all", F.col("y") * 0).groupBy("all").applyInPandas(learn, "model binary").collect()
    return np.frombuffer(learned[0]["model"], np.float32).reshape(HASHED + SHAPE, -1) if learned else None


def scorer(model: np.ndarray | None):
    """A Column function of texts: the score in [0, 1]. Only texts reach Python, so other columns stay as they are."""
    packed = None if model is None else model.tobytes()

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = None if packed is None else np.frombuffer(packed, np.float32).reshape(HASHED + SHAPE, -1)
        for b in batches:
            z = [np.zeros(0)]
            for at in range(0, len(b), 256):
                texts = b.iloc[at : at + 256].tolist()
                z.append(np.zeros(len(texts)) if weights is None else margins(weights, *rows_of(texts), len(texts))[0].astype(np.float64))
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.concatenate(z), -30, 30))))

    return lambda text: of(F.coalesce(text, F.lit("")))


def score(docs: DataFrame, model: np.ndarray | None) -> DataFrame:
    """doc_id, score of every document."""
    return docs.select("doc_id", scorer(model)(F.col("text")).alias("score"))


def op4_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents kept (score at least threshold), with the columns they came with."""
    return docs.where(scorer(train(docs, labels))(docs["text"]) >= threshold)
