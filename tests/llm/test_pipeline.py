"""Every stage on its own input, against plain versions."""

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import odd_documents, texts_of


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        rows, before = texts_of(out), dict(texts_of(docs))
        assert out.columns == columns
        if name == "language_id":
            assert len(rows) == len(before)
        elif name == "near_dedup":
            assert sorted(d for d, _ in rows) == sorted(d for d, x in brute.near_duplicates(before.items(), 5, 80).items() if x[2])
        elif name == "decontamination":
            clean = {d for (d, _), x in zip(before.items(), brute.contamination(list(before.items()), bench)) if not x[1]}
            assert all(t == before[d] for d, t in rows if d in clean) and clean <= {d for d, _ in rows}
            assert not any(x[1] for x in brute.contamination(rows, bench))
        elif name == "secret_redaction":
            assert len(rows) == len(before) and not any(brute.secrets(t) for _, t in rows)
        else:
            assert {d for d, _ in rows} <= set(before)
        docs = out
        assert number < 5


def test_run_and_odd_rows(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    docs = odd_documents(spark).unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() > 0
        assert stage(spark, docs.filter("false"), sf_dir).count() == 0
