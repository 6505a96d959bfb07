"""Line dedup: ranges of sorted line hashes, streamed into keep bitmaps."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from routelens.llm.common import byte_texts, slices, written

_CONTINUATION = re.compile(rb"[\x80-\xbf]")
_LINES = "key binary, doc_id long, sig long, pos int"
_FOUND = "kind int, key binary, doc_id long, sig long, pos int, docs long"
_DROP, _OPEN, _TOTAL = 0, 1, 2


def line_key(line: bytes) -> bytes:
    """ASCII white space off both ends, A-Z in lower case."""
    return line.strip().lower()


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key) - len(_CONTINUATION.findall(key))


def _line_hashes(min_chars: int):
    schema = pa.schema([("key", pa.binary()), ("doc_id", pa.int64()), ("sig", pa.int64()),
                        ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keys, owners, places = [], [], []
            for row, text in enumerate(byte_texts(batch.column("text"))):
                for pos, line in enumerate(text.split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_chars and _code_points(key) >= min_chars:
                        keys.append(xxhash.xxh3_128_digest(key))
                        owners.append(row)
                        places.append(pos)
            rows = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), batch.column("doc_id").take(rows),
                 batch.column("sig").take(rows), pa.array(places, pa.int32())], schema=schema)

    return run


def _decide(min_docs: int):
    """Streams one range of lines, sorted by key and then by document from the largest down.

    A run of one key that begins in this range has its largest document here, so it is
    decided as soon as it shows enough documents. The first run may go on from the range
    before, and the last one into the next: what they leave open is given out with the
    number of documents and the largest one seen, at most two such totals a range.
    """
    schema = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("doc_id", pa.int64()),
                        ("sig", pa.int64()), ("pos", pa.int32()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = top = last = None
        lead, docs = True, 0
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for line in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if line[0] != key:
                    if lead and key is not None:
                        out.append((_TOTAL, key, top, None, None, docs))
                        lead = False
                    key, top, last, docs, held = line[0], line[1], None, 0, []
                if line[1] != last:
                    last = line[1]
                    docs += 1
                if lead:
                    out.append((_OPEN, *line, None))
                elif 1 < docs < min_docs:
                    held.append(line)
                elif docs >= min_docs:
                    out.extend((_DROP, *row, None) for row in held)
                    held = []
                    if docs > 1:
                        out.append((_DROP, *line, None))
            yield _records(out, schema)
        if key is not None:
            yield _records([*((_OPEN, *row, None) for row in held),
                            (_TOTAL, key, top, None, None, docs)], schema)

    return run


def _records(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(values, field.type) for values, field in zip(columns, schema, strict=True)],
        schema=schema)


@arrow_udf(BinaryType())
def _bitmap(dropped: pa.Array) -> pa.Array:
    out = []
    for places in dropped.to_pylist():
        keep = np.ones(max(places) // 8 * 8 + 8, bool)  # whole bytes
        keep[places] = False
        out.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
    return pa.array(out, pa.binary())


_CUT = StructType([StructField("text", StringType()), StructField("n_lines", LongType()),
                   StructField("n_dropped", LongType())])


@arrow_udf(_CUT)
def _apply(texts: pa.Array, bitmaps: pa.Array) -> pa.Array:
    kept, n_lines, n_dropped = [], [], []
    for text, bitmap in zip(byte_texts(texts), bitmaps.to_pylist(), strict=True):
        lines = text.split(b"\n")
        n_lines.append(len(lines))
        if bitmap is not None:
            bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8),
                                 bitorder="little")[:len(lines)]
            lines = [line for place, line in enumerate(lines)
                     if place >= len(bits) or bits[place]]
        n_dropped.append(n_lines[-1] - len(lines))
        kept.append(b"\n".join(lines))
    return pa.StructArray.from_arrays(
        [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()),
         pa.array(n_dropped, pa.int64())], names=["text", "n_lines", "n_dropped"])


def line_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, sig, bitmap) for each document that loses lines.

    Lines whose key (``line_key``) has at least ``min_chars`` code points and stands in at
    least ``min_docs`` documents go, except in the largest doc_id that holds it, which keeps
    all of them. ``sig`` is xxhash64 of the text. A bitmap is a compressed row of bits, bit
    i being 1 if line i stays; lines beyond its end stay.

    NULL or empty text: one empty line, which stays. Rows that share a doc_id count as one
    document. Rows without a doc_id keep their lines and are not counted. An empty table
    gives no rows.

    128-bit hashes are dealt by ranges of (hash, document), so a line that a third of all
    documents hold is spread over many tasks.
    """
    lines = written(
        docs.where("doc_id IS NOT NULL")
        .select("doc_id", "text", F.xxhash64("text").alias("sig"))
        .mapInArrow(_line_hashes(min_chars), _LINES))
    found = written(
        lines.repartitionByRange("key", F.desc("doc_id"))
        .sortWithinPartitions("key", F.desc("doc_id"), "sig", "pos")
        .mapInArrow(_decide(min_docs), _FOUND))
    # At most two totals for each range, so this side is small whatever the data are.
    totals = (found.where(F.col("kind") == _TOTAL).groupBy("key")
              .agg(F.sum("docs").alias("all_docs"), F.max("doc_id").alias("top"))
              .where(F.col("all_docs") >= min_docs))
    settled = (found.where(F.col("kind") == _OPEN).join(F.broadcast(totals), "key")
               .where(F.col("doc_id") < F.col("top")))
    place = ["doc_id", "sig", "pos"]
    drops = found.where(F.col("kind") == _DROP).select(place).unionByName(settled.select(place))
    return drops.groupBy("doc_id", "sig").agg(_bitmap(F.collect_set("pos")).alias("bitmap"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the remaining lines as ``text``, plus n_lines and n_dropped (see above)."""
    bitmaps = line_bitmaps(docs, min_chars, min_docs).select(
        F.col("doc_id").alias("__doc"), F.col("sig").alias("__sig"), F.col("bitmap").alias("__bitmap"))
    names = [name for name in docs.columns if name not in ("n_lines", "n_dropped")]
    joined = docs.join(bitmaps, (F.col("doc_id") == F.col("__doc"))
                       & (F.xxhash64("text") == F.col("__sig")), "left")
    cut = joined.withColumn("__cut", _apply(F.col("text"), F.col("__bitmap")))
    return cut.select(
        *[F.col("__cut.text").alias("text") if name == "text" else F.col(f"`{name}`")
          for name in names],
        F.col("__cut.n_lines").alias("n_lines"), F.col("__cut.n_dropped").alias("n_dropped"))
