"""No part of the manifest that grows with the rows is gathered in the driver."""

from pyspark.sql import functions as F

from tallyray.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("BroadcastHashJoin"), plan.count("SortMergeJoin")


def test_proofs_broadcast_only_the_rows_of_sources(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "ab"[i % 2], 6) for i in range(700)], DOCS)
    m = merkle.manifest(docs)
    heights = len(m.rows.records)  # one join a height, one with the runs; the subroots are few
    assert heights == 2 and joins(merkle.proofs(m)) == (1, heights + 1)
    asked = docs.select("doc_id").where(F.col("doc_id") % 3 == 0)
    # besides: what is asked for, at each height and among the leaves
    assert joins(merkle.proofs(m, asked)) == (1, 2 * heights + 2)
