"""The pipeline's stages on a small table: order, nulls, empties, repeats, extra columns."""

import corpus_pipeline
from pyspark.sql import functions as F

from lodestone.llm import common

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_clean_rows(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "exact_dedup", "near_dedup", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.limit(1).withColumn("doc_id", F.lit(10**9).cast("long"))
    odd = some.withColumn("text", F.lit(None).cast("string")).unionByName(some.withColumn("text", F.lit(""))).unionByName(docs.limit(1)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    rows = docs.unionByName(odd).withColumn("kept", F.lit("x"))
    seen = rows.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.written(stage(spark, rows, SF), name)
        assert out.columns == rows.columns and 0 < out.count() <= seen
        assert out.exceptAll(rows).isEmpty()
        rows, seen = out, out.count()
    texts = [r.text for r in rows.select("text").collect()]
    assert len({"".join(t.split()) for t in texts}) == len(texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
    assert packed.select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()


def test_without_as_anti_join(spark):
    rows = spark.createDataFrame([(i if i % 10 else None, str(i)) for i in range(500)], "id long, x string")
    gone = spark.createDataFrame([(i,) for i in range(0, 500, 3)], "id long")
    for bits in (common.SIEVE_BITS, 1 << 15, 64):
        got = {r.x for r in common.without(rows, F.col("id"), gone, bits).collect()}
        assert got == {str(i) for i in range(500) if i % 10 == 0 or i % 3}
