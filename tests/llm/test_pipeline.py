"""The pipeline, stage by stage, against what each stage's operator says."""

from collections import Counter

import corpus_pipeline
from latticeweave.llm import decontam, quality, queries, secrets
from latticeweave.llm._common import table, written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = dict(corpus_pipeline.STAGES)
    assert list(names) == ["quality", "near_dedup", "decontam", "secrets", "mixing"]
    kept = written(names["quality"](spark, docs, SF))
    says = {r.doc_id for r in queries.op9_quality(spark, SF).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == says and kept.columns == docs.columns
    single = written(names["near_dedup"](spark, kept, SF))
    from latticeweave.llm import simhash

    found = simhash.near_duplicates(kept, shingle=5, similarity=0.8).collect()
    assert {r.doc_id for r in single.collect()} == {r.component_id for r in found}
    clean = written(names["decontam"](spark, single, SF))
    bench = table(spark, SF, "benchmark").collect()
    windows = decontam.item_windows([(r.item_id, r.text) for r in bench])
    dirty = lambda t: any(p in b" ".join([b"", *decontam.words_of(t), b""]).decode() for p in windows)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect() if not dirty(r.text)}
    redacted = written(names["secrets"](spark, clean, SF))
    left = redacted.select(secrets.find_spans(redacted.text).alias("s")).where("size(s) > 0").count()
    assert left == 0 and redacted.count() == clean.count() and redacted.columns == docs.columns
    mixed = names["mixing"](spark, redacted, SF).collect()
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in redacted.collect()} and max(Counter(r.doc_id for r in mixed).values()) <= 3


def test_empty_and_odd_documents(spark):
    docs = table(spark, SF, "documents")
    schema = docs.schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (1, "a b " * 50, "en", None, 3), (2, "one two three four five six seven eight nine ten password=abcdefghij", "en", "s", 5)], schema)
    for frame in (odd, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = written(stage(spark, frame, SF))
        assert frame.columns == docs.columns


def test_one_row_stays_of_each_component(spark):
    same, other = "one two three four five six seven eight nine ten", "a wholly different text of some other twelve words for this test"
    rows = [(None, same), (7, same), (7, same), (3, same), (3, same), (None, other), (None, other)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], table(spark, SF, "documents").schema)
    got = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, other), (3, same)]
