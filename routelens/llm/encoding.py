"""BPE encoding and decoding of whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from routelens.llm.bpe import WordEncoder, encoder_of, shared, spell


def encode_texts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` with ``ids`` (array of int) for ``text``, by the vocabulary file at that path.

    NULL and empty texts have no ids. Special tokens in a text are taken as such, none are
    added. Rows stay where they are: there is no shuffle.
    """
    content = shared(docs.sparkSession.sparkContext, vocabulary)

    @arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encoder = encoder_of(WordEncoder, content.value)
        rows = [encoder.ids(text) for text in texts.to_pylist()]
        return _lists(rows)

    return docs.withColumn("ids", ids("text"))


def decode_ids(df: DataFrame, vocabulary: str) -> DataFrame:
    """``df`` with ``decoded``, the token strings of ``ids`` joined by blanks. NULL ids: NULL."""
    content = shared(df.sparkSession.sparkContext, vocabulary)

    @arrow_udf("string")
    def decoded(ids: pa.Array) -> pa.Array:
        encoder = encoder_of(WordEncoder, content.value)
        return pa.array([None if row is None else encoder.decode(np.array(row, np.int64)).decode()
                         for row in ids.to_pylist()], pa.string())

    return df.withColumn("decoded", decoded("ids"))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    values = np.concatenate(rows or [np.empty(0, np.int32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def token_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes each text in one pass.

    The ids and the decoded text exist for one document at a time. NULL texts count as empty;
    a NULL doc_id stays NULL; repeated rows each give a row.
    """
    content = shared(docs.sparkSession.sparkContext, vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(WordEncoder, content.value)
        for batch in batches:
            counts, id_digests, text_digests = [], [], []
            for text in batch.column("text"):
                ids = encoder.ids(text.as_py())
                counts.append(len(ids))
                digits = spell(ids, encoder.vocabulary.decimals) if len(ids) else b""
                id_digests.append(hashlib.sha256(digits).hexdigest())
                text_digests.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()),
                 pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())],
                schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
