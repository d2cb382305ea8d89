"""Each stage of the corpus pipeline on its predecessor's rows."""

import corpus_pipeline
from fixtures import texts

from docquarry.llm import lines, pii, quality, simhash


def test_stages(spark, sf_dir, odd, labels, tmp_path):
    docs, rows = odd, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows.append((name, before, docs))
        if name != "packing":
            assert docs.columns == odd.columns
    for name, before, after in rows:
        a, b = texts(before), texts(after) if name != "packing" else []
        if name == "quality":
            kept = {r.doc_id for r in quality.judge(before, labels).where("kept").collect()}
            assert sorted(b) == sorted(x for x in a if x[0] in kept)
        elif name == "line_dedup":
            gone = {(r.doc_id, r.line_no) for r in lines.line_dedup(before).where("not kept").collect()}
            want = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in a]
            assert sorted(b) == sorted(want)
        elif name == "simhash":
            assert {i for i, _ in b} == {r.component_id for r in simhash.near_duplicates(before).collect()}
            assert len(b) == len({i for i, _ in b}) and set(b) <= set(a)
        elif name == "pii":
            assert sorted(b) == sorted((i, pii.masked(t, pii.all_spans([t])[0][1])) for i, t in a)
        else:
            assert {r.doc_id for r in after.collect()} == {i for i, _ in a}


def test_whole_run(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.count() > 0
    assert found.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
