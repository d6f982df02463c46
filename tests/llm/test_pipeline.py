from pyspark.sql import functions as F

import corpus_pipeline
from chanspark.llm.secrets import redacted

from .helpers import docs, windows_hit
from .test_similar import kept_by_hand

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    """Each stage against a plain version of itself, on what the stage before it kept."""
    from chanspark.llm.quality import quality

    table = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    current = {r.doc_id: r for r in table.collect()}
    df = table
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == set(current)
            break
        assert out.columns == table.columns
        got = {r.doc_id: r for r in out.collect()}
        if name == "quality":
            want = {r.doc_id for r in quality(df).where("kept").collect()}
        elif name == "near_duplicates":
            want = {d for _, d in kept_by_hand([(d, r.text) for d, r in current.items()])}
        elif name == "decontamination":
            want = {d for d, r in current.items() if not windows_hit(r.text, items)[1]}
        else:
            want = set(current)
            assert all(got[d].text == redacted(r.text) and got[d].n_chars == len(got[d].text) for d, r in current.items())
        assert set(got) == want
        assert name == "secrets" or all(got[d] == current[d] for d in got)
        current, df = got, out
    assert corpus_pipeline.run(spark, SF).count() == out.count()


def test_awkward_rows(spark, tmp_path):
    for rows in (docs(spark), docs(spark, [])):
        df = rows
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, SF)
            assert df.columns == rows.columns, name
        assert df.where(F.col("doc_id") == 3).count() == 0
        corpus_pipeline.packing(spark, df, SF).collect()
