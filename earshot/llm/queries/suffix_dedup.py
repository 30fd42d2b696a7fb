"""op10: bytes of passages repeated anywhere in ``documents``."""

from pyspark.sql import functions as F

from earshot.llm.registry import query
from earshot.llm.store import table
from earshot.llm.suffix_dedup import remove_repeats


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, window=400).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
