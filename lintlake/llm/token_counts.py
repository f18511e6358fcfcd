"""Token counts of whole texts by a compiled transducer.

Narrow work: every batch is counted where it is read, no shuffle. Each Python worker compiles
the part of the transducer that its texts use (``token_transducer``). Null texts count as
empty; repeated rows and ids give one row each; other columns stay, one with the name of the
output is replaced; empty tables give empty tables.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import with_batch_columns
from .token_transducer import count_tokens, transducer


def count_document_tokens(docs: DataFrame, model_path: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each text, without begin and end."""

    def compute(texts):
        return {name: pa.array(count_tokens(transducer(model_path), [t or "" for t in texts]))}

    return with_batch_columns(docs, [text], {name: LongType()}, compute)


def token_report(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, bytes, tokens, and whether the tokens exceed the limit."""
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return count_document_tokens(sized, model_path).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
