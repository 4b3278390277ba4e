"""The pipeline's stages one after another: each works on what the one before kept, and the last packs it whole."""

import corpus_pipeline
from proseloom.llm.packing import default_tokenizer

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        kept = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and kept and kept <= ids
        if name == "quality":
            right = [(quality[i] == 1) == (i in kept) for i in quality]
            assert sum(right) >= 0.95 * len(right)
        ids = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    coder = Tokenizer.from_file(default_tokenizer())
    want = {r.doc_id: len(coder.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
