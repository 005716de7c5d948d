"""The queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, decontam, html, langid, neardup, packing, pii, quality, sharding
from .common import table

#: Folder-independent name of the vocabulary that op4 packs by and op9 counts by.
PACK_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pii_key(spark: SparkSession) -> str:
    """The key of surrogates: the session's ``memlake.pii.key``, or for the test tables a word that is no secret."""
    return spark.conf.get("memlake.pii.key", None) or "not a secret"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": lambda s, d: quality.op1_quality(table(s, d, "documents"), table(s, d, "labels")),
        "op2_language": lambda s, d: langid.op2_language(table(s, d, "documents")),
        "op3_main_text": lambda s, d: html.op3_main_text(table(s, d, "pages")),
        "op4_packing": lambda s, d: packing.op4_packing(table(s, d, "documents"), tokenizer_path(PACK_TOKENIZER)),
        "op5_decontamination": lambda s, d: decontam.op5_decontamination(table(s, d, "documents"), table(s, d, "benchmark")),
        "op6_sharding": lambda s, d: sharding.op6_sharding(table(s, d, "documents")),
        "op7_neighbours": lambda s, d: ann.op7_neighbours(table(s, d, "embeddings")),
        "op8_pii": lambda s, d: pii.op8_pii(table(s, d, "documents"), pii_key(s)),
        "op9_chat": lambda s, d: chat.op9_chat(table(s, d, "conversations"), tokenizer_path(PACK_TOKENIZER)),
        "op10_near_duplicates": lambda s, d: neardup.op10_near_duplicates(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": decontam.ORACLE}
