"""Encoding and decoding of whole texts with a BPE ``.model`` file.

Work is narrow: every batch of rows is encoded where it is read (``bpe_rounds``), nothing is
shuffled, and a hot source or a large group of copies is spread as the table is. Within a
batch texts are taken in groups of a bounded number of characters, a very long text in parts
cut before blanks, so memory does not follow the longest text.

Null texts encode as empty ones. Repeated rows and ids give one row each. Other columns stay;
one with the name of an output is replaced. Empty tables give empty tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from .bpe_rounds import decode_ids, encode_texts
from .common import with_batch_columns
from .piece_model import piece_model


def encode_documents(
    docs: DataFrame, model_path: str, text: str = "text", ids: str = "token_ids", begin: bool = True, end: bool = True
) -> DataFrame:
    """docs with ``ids``: the text's piece ids as little-endian unsigned 32-bit integers.

    ``model_path`` must be readable on every executor.
    """

    def compute(texts):
        model = piece_model(model_path)
        head = [model.begin] if begin else []
        tail = [model.end] if end else []
        found = encode_texts(model, [t or "" for t in texts])
        return {ids: pa.array([np.concatenate([head, x, tail]).astype("<u4").tobytes() for x in found], pa.binary())}

    return with_batch_columns(docs, [text], {ids: BinaryType()}, compute)


def decode_documents(docs: DataFrame, model_path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """docs with ``text``: the ids decoded; null ids decode to the empty text."""

    def compute(values):
        model = piece_model(model_path)
        return {text: pa.array([decode_ids(model, np.frombuffer(v or b"", "<u4")) for v in values], pa.string())}

    return with_batch_columns(docs, [ids], {text: StringType()}, compute)


def encode_and_decode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """docs with ``token_ids`` and ``decoded`` in one pass over the batches."""

    def compute(texts):
        model = piece_model(model_path)
        found = [np.r_[model.begin, x, model.end].astype("<u4") for x in encode_texts(model, [t or "" for t in texts])]
        return {
            "token_ids": pa.array([x.tobytes() for x in found], pa.binary()),
            "decoded": pa.array([decode_ids(model, x) for x in found], pa.string()),
        }

    return with_batch_columns(docs, [text], {"token_ids": BinaryType(), "decoded": StringType()}, compute)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, number of ids and digests of ids and decoded text."""
    return encoded.select(
        "doc_id",
        F.expr("octet_length(token_ids) div 4").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
