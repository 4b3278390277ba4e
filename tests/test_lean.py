"""Scores and findings look at what decides them only; they agree with the relations that tell all."""

import random

import pytest
from pyspark.sql import functions as F
from test_linear import PIECES

from proseloom.plans.analyze import Analysis, fired
from proseloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
SAID = ["It was 5% more.", "See https://a.b/c now.", "At 14:08 we left.", "Needless to say, in today's world it goes without saying.", "Per the log it held.", "Maria Lopez came.", "because of it\n", "\n\n", "# Head line\n", "- item ", "\n"]


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["doc_scores", "band_histogram", "bench_metrics", "bench_outcomes", "bench_totals"])
def test_scores_place_and_word_no_finding(spark, name):
    told = plan(spark, name)
    assert "source signal near" not in told and "preceding sentence" not in told and "filler phrasing" not in told


def test_findings_word_no_reason(spark):
    assert "preceding sentence" not in plan(spark, "findings") and "preceding sentence" in plan(spark, "grounding_adjacent")


@pytest.mark.parametrize("name", ["findings", "sql_scores"])
def test_values_used_twice_are_not_copied(spark, name):
    """A transform copies what it gives, a fold over nothing doesn't."""
    assert "transform(array(" not in plan(spark, name)


def test_findings_are_those_of_claims_and_densities(spark):
    r = random.Random(4)
    texts = ["".join(r.choice(SAID if r.random() < 0.7 else PIECES) for _ in range(r.randint(1, 40))) for _ in range(300)]
    texts.append("It was 5 more.\n\n- item 7\n\n" * 200)  # more blocks than are looked at one by one
    texts.append("It was 5% more. Maria came. " * 200)  # and more sentences
    d = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id long, text string")
    a = Analysis(d)
    claims = a.claims.where("not grounded").select("doc_id", F.lit("GROUND001").alias("rule_id"), "block_index", "start_char", "end_char")
    flagged = a.density.where("flagged").select("doc_id", F.expr("CASE WHEN size(filler_hits) > 0 THEN 'FILLER001' ELSE 'DENSITY001' END").alias("rule_id"), "block_index", "start_char", "end_char")
    want = sorted(map(tuple, claims.unionByName(flagged).collect()))
    found = a.findings().collect()
    assert sorted((f.doc_id, f.rule_id, f.block_index, f.start_char, f.end_char) for f in found) == want and len(want) > 500
    assert all(f.start_line == 1 + texts[f.doc_id][: f.start_char].count("\n") and f.end_line == 1 + texts[f.doc_id][: f.end_char].count("\n") for f in found if not texts[f.doc_id].startswith("﻿"))
    assert {f.rule_id for f in found} == {"GROUND001", "DENSITY001", "FILLER001"}
    s = a.summary()
    key = lambda f: (f.file, f.band, f.score, sorted(f.fired))
    assert sorted(map(key, a.fired().collect())) == sorted(map(key, fired(s).collect()))
    shares = {x.doc_id: (x.gap, x.rate) for x in a.scores().collect()}
    total = {x.doc_id: x for x in a.claims.groupBy("doc_id").agg(F.avg(F.expr("CASE WHEN grounded THEN 0.0D ELSE 1.0D END")).alias("gap")).collect()}
    blocks = {x.doc_id: x for x in a.density.groupBy("doc_id").agg(F.avg(F.expr("CASE WHEN flagged THEN 1.0D ELSE 0.0D END")).alias("rate")).collect()}
    assert shares.keys() == {-1, *range(len(texts))}
    for k, (gap, rate) in shares.items():
        assert gap == pytest.approx(total[k].gap if k in total else 0.0) and rate == pytest.approx(blocks[k].rate if k in blocks else 0.0)
