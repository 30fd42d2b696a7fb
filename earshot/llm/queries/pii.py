"""op9: personal data in all ``documents``."""

from pyspark.sql import functions as F

from earshot.llm.pii import joined, personal_spans
from earshot.llm.registry import query
from earshot.llm.store import table


@query("op9_personal_spans")
def op9_personal_spans(spark, sf_dir):
    docs = personal_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = docs.withColumn("base", F.expr("filter(spans, s -> s.base)"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return docs.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
