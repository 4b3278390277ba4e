"""What operator 2 leaves on the disk while it runs."""

import os
import random

import numpy as np
import pandas as pd
import pytest

from proseloom.llm import common, katz
from proseloom.llm.common import pack


def exchanged(spark):
    """Bytes of all shuffle files."""
    roots = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    return sum(os.path.getsize(os.path.join(at, f)) for root in roots for at, _, files in os.walk(root) for f in files if f.startswith("shuffle_"))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    return spark.createDataFrame([(i, " ".join(f"w{r.randrange(500)}" for _ in range(200))) for i in range(300)], "doc_id long, text string").repartition(3)


def test_an_exchange_is_dropped_when_its_table_is_written(spark, docs, monkeypatch, tmp_path):
    seen, kept, write, folder = [], [], katz.staged, tmp_path.as_uri()
    monkeypatch.setattr(common, "shared_dir", lambda spark: folder)

    def watched(df, tag, **how):
        before = exchanged(spark)
        if tag == "ngram-backoff":
            kept.append(sorted(p.name.split("-")[0] for p in tmp_path.iterdir()))
        out = write(df, tag, **how)
        seen.append((tag, before, exchanged(spark)))
        return out

    monkeypatch.setattr(katz, "staged", watched)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    assert katz.score(docs).count() == 300
    assert [t for t, *_ in seen] == ["ngram-counts", "ngram-counts", "scored", "ngram-backoff", "katz"]
    assert kept == [["scored"]]  # blocks and counts are gone while weights are summed
    assert all(after <= before for _, before, after in seen)
    assert spark.conf.get(name, None) == before


def test_only_a_stored_model_keeps_keys(docs):
    keys = np.array([3, 5, 9], np.uint64)
    rows = pd.DataFrame([{"kind": 2, "block": b, "bucket": 0, "keys": pack(keys), "counts": pack(np.array([2, 4, 1], np.uint32))} for b in (0, 1)])
    lean, full = katz.counted(rows), katz.counted(rows, True)
    assert lean.iloc[-1]["keys"] is None and full.iloc[-1]["keys"] is not None
    assert lean["answer"].tolist()[:-1] == full["answer"].tolist()[:-1] and lean[katz.COUNTS].equals(full[katz.COUNTS])
    assert katz.train(docs).counts.where("keys IS NULL").count() == 0
