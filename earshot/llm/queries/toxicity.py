"""op1: severity of every row of ``documents``."""

from pyspark.sql import functions as F

from earshot.llm.registry import query
from earshot.llm.store import table
from earshot.llm.toxicity import fit, score


@query("op1_ordinal_toxicity")
def op1_ordinal_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select(
        "doc_id", F.round("severity", 6).alias("severity"), F.round("p_toxic", 6).alias("p_toxic"), "toxic", (~F.col("toxic")).alias("kept")
    )
