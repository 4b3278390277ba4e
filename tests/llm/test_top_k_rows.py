"""Operator 3 against brute force on rows that repeat ids, have none, or score beyond a long."""

import math

import numpy as np
import pytest

from proseloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>"
LAST = 2**63
rng = np.random.default_rng(7)


def vectors(n, scale=0.3):
    return [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(rng.normal(0, 1, (n, 8)) * scale)]


def best(asks, rows):
    """asks: id, vector, the places of its own rows. Ranked by the whole product; the score is held within a long."""
    out = []
    for q, u, own in asks:
        scored = sorted((-sum(a * b for a, b in zip(u, v, strict=False)), LAST if i is None else i) for at, (i, v) in enumerate(rows) if at not in own)[:10]
        out += [(q, r, None if i == LAST else i, max(-LAST, min(LAST - 1, -s))) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect()), key=repr)


SAME = [0.9] * 8
CASES = {
    "each row twice": vectors(250) * 2,
    "one row twelve times": vectors(250) + [(100, SAME)] * 12 + [(7, SAME)] * 3,
    "other vectors under one id": vectors(250) + [(i // 3 * 100, v) for i, v in vectors(9)],
    "no id": (some := vectors(250)) + [(None, some[100][1]), (None, [-x for x in some[0][1]]), (None, some[0][1])],
    "beyond a long": vectors(250, 10.0 ** rng.integers(0, 37, (250, 1))),
    "below a long": [(i, [abs(x) * (1 if i % 100 == 0 else -1) for x in v]) for i, v in vectors(250, 1e10)],
}


@pytest.mark.parametrize("name", CASES)
def test_every_row_asks_and_answers(spark, tmp_path, name):
    table = spark.createDataFrame(CASES[name], SCHEMA)
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v in CASES[name]]
    want = best([(i, v, {at}) for at, (i, v) in enumerate(rows) if i is not None and i % 100 == 0], rows)
    assert got(topk.op3_voronoi_top_k(spark, str(tmp_path))) == want


def test_an_id_asks_once(spark):
    """Many rows of the id that asks say nothing about how well others score."""
    table = spark.createDataFrame(vectors(250) + [(300, SAME)] * 12, SCHEMA)
    rows = [(r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for r in table.collect()]
    asks = [(q, min(v for i, v in rows if i == q), {at for at, (i, _) in enumerate(rows) if i == q}) for q in (0, 100, 200, 300)]
    assert got(topk.top_k(table, pivots=300, block=64)) == best(asks, rows)


def test_queries_meet_their_groups_in_any_partition(spark):
    """With as many shuffle partitions as are asked for, not merged into one."""
    table = spark.createDataFrame(vectors(700), SCHEMA)
    rows = [(r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for r in table.collect()]
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = got(topk.top_k(table, block=100))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == best([(i, v, {at}) for at, (i, v) in enumerate(rows) if i % 100 == 0], rows)
