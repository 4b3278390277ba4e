"""Every operator and stage on rows that are odd: ids of 63 bits beside nulls, repeated ids with other texts, clashing
column names, empty tables; and the queries that SQL can state against that SQL."""

import math
import struct
import zlib
from collections import Counter

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from proseloom.llm import katz, media, nearjoin, packing, pieces, quality, registry, repeats, sharding
from proseloom.llm.components import components

BIG = 2**60 + 1
LONG = 2**63 - 1
PASSAGE = " ".join(f"w{i}" for i in range(70))
ROWS = [
    (BIG, f"{PASSAGE} one"), (BIG + 1, f"two {PASSAGE}"), (None, "three words here now then"), (None, f"{PASSAGE} one"), (LONG, "the last id of all is here"), (-5, ""), (-LONG - 1, None), (BIG, "another text under one id"),
    (None, None), (7, "the last id of all is here"),
]
#: Names that the operators use themselves.
CLASH = "doc_id long, text string, score double, block string, has_id string, words int, node long, spans array<int>, __id string, first string"
NONE = (None,) * 8


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *NONE) for i, t in ROWS], CLASH).repartition(2)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


OPERATORS = {
    "media": lambda d: media.features(media.media_column(d)), "katz": lambda d: katz.score(d, 3), "quality": lambda d: quality.score(d, None), "sparse suffixes": lambda d: repeats.repeats(d, repeats.suffix_solver, repeats.spans, repeats.SPANS),
    "sharding": sharding.shard, "near": nearjoin.near_duplicates, "encode": pieces.encode, "digests": pieces.digests, "decode": lambda d: pieces.decode(pieces.encode(d)),
    "fm-index": lambda d: repeats.repeats(d, repeats.fm_solver, repeats.kept, repeats.REMOVED),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_come_back_as_they_are(docs, none, name):
    got = Counter(r.doc_id for r in OPERATORS[name](docs).collect())
    assert got == Counter(i for i, _ in ROWS)
    assert OPERATORS[name](none).count() == 0


def test_packing_ids(docs, none):
    whole = [r for r in packing.pack_documents(docs, windows=2).collect() if r.start == 0]
    assert Counter(r.doc_id for r in whole) == Counter(i for i, _ in ROWS) and packing.pack_documents(none).count() == 0


def test_held_out_by_the_exact_id(docs):
    want = Counter((i, zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0) for i, _ in ROWS)
    assert Counter((r.doc_id, r.held_out) for r in katz.score(docs).collect()) == want


def test_one_row_of_each_class(spark, docs, none):
    kept = nearjoin.one_of_each(docs)
    assert kept.columns == docs.columns
    # Copies and near copies: the smallest id stays, also beside a repeated id; of rows without text the smallest.
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(BIG, f"{PASSAGE} one"), (None, "three words here now then"), (7, "the last id of all is here"), (-LONG - 1, None), (BIG, "another text under one id")])
    a, b = "alpha beta gamma delta epsilon zeta eta", "one two three four five six seven"
    rows = spark.createDataFrame([(2, a), (4, a), (4, b), (4, b), (None, b), (None, "x y"), (None, "x  y")], "doc_id long, text string")
    got = Counter((r.doc_id, " ".join(r.text.split())) for r in nearjoin.one_of_each(rows).collect())
    assert got == Counter([(2, a), (4, b), (None, "x y")])
    assert nearjoin.one_of_each(none).count() == 0


def test_cleaned_rows(docs, none):
    kept = repeats.cleaned(docs)
    assert kept.columns == docs.columns
    # The passage stays under the smallest id; a row without an id loses it.
    want = [(BIG, f"{PASSAGE} one"), (BIG + 1, "two"), (None, "three words here now then"), (LONG, "the last id of all is here"), (-5, ""), (-LONG - 1, None), (BIG, "another text under one id"), (None, None), (7, "the last id of all is here")]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want) and repeats.cleaned(none).count() == 0


def test_rejected_rows(spark, docs, none):
    labels = spark.createDataFrame([(BIG, 1), (7, 0), (7, 0), (None, 1), (3, 2), (-5, None)], "doc_id long, quality int")
    kept = quality.reject(docs, labels, 0.0)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in ROWS)
    assert quality.reject(none, labels).count() == 0 and quality.reject(docs, labels.limit(0)).count() == len(ROWS)


@pytest.mark.parametrize("rows", [ROWS, []])
def test_pipeline_on_odd_rows(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = Counter([BIG, BIG, None, 7, -LONG - 1]) if rows else Counter()
    assert Counter(r.doc_id for r in packed if r.start == 0) == want


def test_the_permutation_against_a_second_version(spark):
    def spark_hash(b, key, seed):
        h = xxhash.xxh64_intdigest(struct.pack("<q", b), 42)
        for x in (key, seed):
            h = xxhash.xxh64_intdigest(struct.pack("<i", x), h)
        return h - 2**64 if h >> 63 else h

    def once(x, left, right, seed):
        a, b, m, n = x // right, x % right, left, right
        for key in range(1, sharding.ROUNDS + 1):
            a, b, m, n = b, (a + spark_hash(b, key, seed) % m) % m, n, m
        return a * right + b

    for rows in (1, 7, 100, 997):
        left = math.isqrt(rows - 1) + 1
        right = -(-rows // left)
        want = []
        for x in range(rows):
            p = once(x, left, right, 11)
            while p >= rows:
                p = once(p, left, right, 11)
            want.append(p)
        assert [r.p for r in spark.range(rows).select(sharding.permuted(F.col("id"), rows, 11).alias("p")).orderBy("id").collect()] == want
        assert sorted(want) == list(range(rows))


def test_shards_do_not_depend_on_the_split(docs):
    shown = lambda d: Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.shard(d, shards=3).collect())
    assert shown(docs) == shown(docs.repartition(7)) == shown(docs.coalesce(1))


def test_a_hot_key_does_not_meet_in_one_task(spark):
    """A star of many edges is joined without a task that holds them all."""
    star = spark.range(1, 4001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    roots = components(star.repartition(8))
    assert roots.where("root = 0").count() == 4001


@pytest.mark.parametrize("name", sorted(set(registry.SQL) - {"op3_voronoi_top_k"}))
def test_queries_against_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for view in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {view} AS FROM '{sf}/{view}.parquet'")
    ours = registry.QUERIES[name](spark, sf)
    columns = sorted(ours.columns)
    theirs = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in ours.select(*columns).collect()))) == sorted(map(repr, theirs))


def test_recall_of_the_chosen_paths(spark):
    """Of all exact links of the documents whose id is divisible by 20, on the large table."""
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    links = f"SELECT doc_id, n_links FROM ({registry.SQL['op7_chosen_path']}) WHERE doc_id % 20 = 0"
    want = dict(con.sql(links).fetchall())
    got = {r.doc_id: r.n_links for r in nearjoin.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).where("doc_id % 20 = 0").collect()}
    assert sum(want.values()) > 20 and sum(min(got[i], n) for i, n in want.items()) >= 0.99 * sum(want.values()) and all(got[i] <= n for i, n in want.items())
