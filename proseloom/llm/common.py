"""Shared pieces: tables, stage files in the shared folder, packed integer blobs."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words everywhere in this package: runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, a local folder of our own, in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="spark-")
    return f"file://{own}"


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Staged tables written inside are deleted at the end, but for those that ask to be kept."""
    _scratch.append([])
    try:
        yield
    finally:
        for name in _scratch.pop():
            if name.startswith("table "):
                spark.sql(f"DROP TABLE IF EXISTS `{name[6:]}`")
                continue
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def one_exchange(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query are dropped when it ends, and not when the driver gets to it. For queries that
    are each written once and read back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def staged(df: DataFrame, tag: str, keep: bool = False, by: tuple[str, ...] = (), up: int = 0) -> DataFrame:
    """Write df once as Parquet in the shared folder, in folders by the columns ``by``, and read it back: lineage ends
    there, and a lost executor costs a reread, not a recomputation. ``keep``: the table outlives a `scratch` around it;
    ``up``: it outlives so many of those around it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    if len(_scratch) > up and not keep:
        _scratch[-1 - up].append(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """df of at most so many narrow rows, in partitions of about ``each``, so that a small table isn't many files."""
    return df.coalesce(1 + rows // each)


def bucketed(df: DataFrame, tag: str, column: str) -> DataFrame:
    """As `staged`, in buckets of a column: what is grouped or joined by it later need not move this table again."""
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    buckets = min(most, max(16, 2 * df.rdd.getNumPartitions()))
    df.write.bucketBy(buckets, column).format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
    if _scratch:
        _scratch[-1] += [f"table {name}", path]
    return spark.table(name)


#: Keys that `with_pairs` sends to every executor at most: some 100 MB there.
MOST_IDS = 2_000_000


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_hash(text):
    """Hash of a text's words joined by one space."""
    return F.xxhash64(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")))


def with_pairs(docs: DataFrame, pairs: DataFrame, how: str) -> DataFrame:
    """The documents whose id and hash of words are ("left_semi"), or are not ("left_anti"), among the distinct pairs
    (doc_id, words). Up to MOST_IDS pairs go to the documents, so that texts need not move, and words are only hashed
    where the id is met; beyond, both sides are shuffled."""
    names = {c: fresh(docs, f"{c}_of_pair") for c in ("doc_id", "words")}
    pairs = pairs.select(*[F.col(c).alias(n) for c, n in names.items()])
    few = pairs.limit(MOST_IDS + 1).count() <= MOST_IDS
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(names["doc_id"]))
    own, other = words_hash(docs["text"]), F.col(names["words"])
    return docs.join(F.broadcast(pairs), same & (own.bitwiseXOR(other) == 0), how) if few else docs.join(pairs, same & (own == other), how)


#: Bytes as they count in `terms_of`: letters of ASCII in lower case, digits and bytes of other characters; else a space.
_TERM_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The runs of letters, digits and characters beyond ASCII of a text in UTF-8, A-Z (and nothing else) lower-cased."""
    return text.translate(_TERM_BYTES).split()


def keyed_bytes(df: DataFrame) -> DataFrame:
    """As `keyed_texts`, with the text's UTF-8 bytes as ``raw``."""
    return keyed_texts(df).select("has_id", "doc_id", F.col("text").cast("binary").alias("raw"))


#: Narrow rows in one partition of `numbered`.
ROWS_TO_NUMBER = 500_000


def numbered(df: DataFrame, order: list[str], name: str, rows: int) -> DataFrame:
    """df of about so many rows with the column ``name``: 1, 2, 3, ... over all rows in ascending order of columns. Rows
    are dealt by ranges of the order, equal rows by their place in the input, and each range starts where the ranges
    before it end: no range and no window grows with the table or with one key."""
    part, place = fresh(df, "part"), fresh(df, "place")
    dealt = df.withColumn(place, F.monotonically_increasing_id()).repartitionByRange(1 + rows // ROWS_TO_NUMBER, *order, place)
    dealt = staged(dealt.withColumn(part, F.spark_partition_id()), "numbered")
    # A row a range: one for each ROWS_TO_NUMBER rows.
    counts = sorted((r[0], r[1]) for r in dealt.groupBy(part).count().collect())
    bases, base = [], 0
    for p, n in counts:
        bases.append((p, base))
        base += n
    first = df.sparkSession.createDataFrame(bases, f"{part} int, {name} long")
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order, place))
    return dealt.withColumn(place, own).join(F.broadcast(first), part).select(*df.columns, (F.col(name) + F.col(place)).alias(name))


def crowd(rows: int) -> int:
    """Over so many of the rows a key is hot; there are at most 100,000 such keys."""
    return max(1000, rows // 100_000)


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: int, most: int, count: str = "n") -> DataFrame:
    """Inner join with a table of one row a key that counts the left rows of it, ``most`` at most. Hot keys are sent to
    the rows; the others are shuffled as usual."""
    bar = crowd(rows)
    if most <= bar:
        return left.join(right, key)
    hot, cold = right.where(F.col(count) > bar), right.where(F.col(count) <= bar)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(df: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc_id and the whole text (null: empty); other columns, whatever their names, are left behind."""
    return df.select(*columns, F.coalesce("text", F.lit("")).alias("text"))


def keyed_texts(df: DataFrame) -> DataFrame:
    """has_id, doc_id (0 for null), text: nothing is null, so that pandas keeps every 64-bit id as it is."""
    return df.select(F.col("doc_id").isNotNull().alias("has_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def with_nulls(df: DataFrame) -> DataFrame:
    """Without has_id, with doc_id null where has_id is false."""
    return df.select(*[F.when(F.col("has_id"), F.col(c)).alias(c) if c == "doc_id" else F.col(c) for c in df.columns if c != "has_id"])


def crc_bucket(column: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def crc_of_id(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


_caches: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What an operator's tasks keep in their Python worker. Spark uses workers again for other stages, so a call by
    one operator drops what the others left there."""
    for other in _caches.keys() - {owner}:
        del _caches[other]
    return _caches.setdefault(owner, {})


_PRESS = zstandard.ZstdCompressor(level=1)
_OPEN = zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    """An integer or float array as bytes: planes of bytes, compressed. Sorted keys shrink most."""
    a = np.ascontiguousarray(values)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T if len(a) else np.zeros((1, 0), np.uint8)
    return _PRESS.compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    raw = np.frombuffer(_OPEN.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, -1).T).view(dtype).reshape(-1)


def squeeze(raw: bytes) -> bytes:
    return _PRESS.compress(raw)


def unsqueeze(blob: bytes) -> bytes:
    return _OPEN.decompress(blob)
