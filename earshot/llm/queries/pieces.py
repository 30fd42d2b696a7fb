"""op6: three sampled segmentations of all ``documents``, with their decoded texts' digests."""

import public_tokenizers
from pyspark.sql import functions as F

from earshot.llm.pieces import segmentations
from earshot.llm.registry import query
from earshot.llm.store import table

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@query("op6_gumbel_pieces")
def op6_gumbel_pieces(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = segmentations(docs, MODEL, k=3, with_text=True)
    return rows.select(
        "doc_id", "rank", F.size("ids").cast("long").alias("n_pieces"), F.round("log_prob", 9).alias("log_prob"),
        F.round("perturbed", 9).alias("perturbed"), F.round("inclusion", 9).alias("inclusion"),
        F.xxhash64("ids").alias("ids_hash"), F.sha2("text", 256).alias("text_sha256"),
    )
