"""op4: all ``documents`` packed along the curve."""

import public_tokenizers

from earshot.llm.packing import ids_crc32, pack
from earshot.llm.registry import query
from earshot.llm.store import table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op4_hilbert_packing")
def op4_hilbert_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ids_crc32(pack(docs, RANKS, PATTERN, length=1024))
