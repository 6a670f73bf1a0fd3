import corpus_pipeline
from blockweave.llm.common import table


def test_stages_in_turn(spark):
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["remove_toxic", "near_duplicates", "redact_secrets", "mix", "pack"]
    docs = table(spark, sf, "documents")
    toxic = {r.doc_id for r in table(spark, sf, "labels").where("toxic = 1").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        rows = out.collect()
        seen[name], docs = rows, spark.createDataFrame(rows, docs.schema)
    kept = {r.doc_id for r in seen["remove_toxic"]}
    assert len(kept & toxic) <= 0.5 * len(toxic)
    one = [r.doc_id for r in seen["near_duplicates"]]
    assert len(one) == len(set(one)) <= len(kept) and set(one) <= kept
    assert [r.doc_id for r in seen["redact_secrets"]] == one
    assert {r.doc_id for r in seen["mix"]} <= set(one)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in seen["mix"]}
    fill = {}
    for r in packed:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048


def test_run_gives_the_last_stages_rows(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
