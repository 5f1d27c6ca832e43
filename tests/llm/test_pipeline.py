"""Each stage's decisions against its operator's, and the packed rows against the last stage's texts."""

import corpus_pipeline
from test_packing import check

from valuemesh.llm import decontam, jaccard_join, langid, line_dedup


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, kept = docs.columns, [docs]
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_copies", "decontamination", "packing"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], sf)
        assert i == 4 or out.columns == names
        out.write.parquet(f"{tmp_path}/{i}")
        kept.append(spark.read.parquet(f"{tmp_path}/{i}"))
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    bad = {r.doc_id for r in langid.op3_langid(kept[0]).collect() if r.lang_pred == "und" or r.score < 0.5}
    assert ids[1] == ids[0] - bad
    lines = {r.doc_id: r for r in line_dedup.op4_line_dedup(kept[1]).collect()}
    assert ids[2] == {d for d, r in lines.items() if r.n_removed < r.n_lines or not r.n_lines}
    assert ids[3] == ids[2] - {r.doc_id for r in jaccard_join.op9_ngram_jaccard(kept[2]).collect() if r.doc_id != r.component_id}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert ids[4] == ids[3] - {r.doc_id for r in decontam.op7_decontam(kept[3], bench).collect() if r.contaminated}
    texts = {r.doc_id: r.text for r in kept[4].collect()}
    assert check(kept[5].collect(), texts) == 0
    again = corpus_pipeline.run(spark, sf).collect()
    assert sum(r.length for r in again) == sum(r.length for r in kept[5].collect())
