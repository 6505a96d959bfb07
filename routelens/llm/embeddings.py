"""Near-duplicate vectors: hyperplane sign hashes in several tables, exact cosines, components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from routelens.llm.common import written
from routelens.llm.components import connected_components

BLOCK = 512
_BLOCKS = "cid long, links long, root long"


def tables_for(threshold: float, bits: int, miss: float) -> int:
    """Tables needed so that a pair at the threshold is in no common bucket with this chance."""
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log(1 - same))


def _planes(seed: int, tables: int, bits: int, size: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, tables * bits))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a digest to the vectors that have a direction; the others get NULL."""
    for batch in batches:
        digests = []
        for vector in batch.column("vector").to_pylist():
            x = np.array([] if not vector or None in vector else vector, np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                usable = len(x) and np.isfinite(x).all() and 0 < x @ x < np.inf
            # -0.0 and 0.0 are one value but differ in their bits.
            digests.append(hashlib.md5((x + 0.0).tobytes()).digest() if usable else None)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(digests, pa.binary())],
            names=[*batch.schema.names, "digest"])


def _signs(tables: int, bits: int, seed: int):
    """One number for each table: on which sides of its hyperplanes the vector lies."""
    powers = 1 << np.arange(bits)

    @arrow_udf("array<int>")
    def signs(vectors: pa.Array) -> pa.Array:
        out = []
        for vector in vectors.to_pylist():
            x = np.array(vector, np.float64)
            sides = (x @ _plane_cache(seed, tables, bits, len(x))).reshape(tables, bits) > 0
            out.append((sides @ powers).astype(np.int32))
        return pa.array(out, pa.list_(pa.int32()))

    return signs


_PLANES: dict = {}


def _plane_cache(seed: int, tables: int, bits: int, size: int) -> np.ndarray:
    key = (seed, tables, bits, size)
    if key not in _PLANES:
        _PLANES[key] = _planes(*key)
    return _PLANES[key]


def _compare(threshold: float):
    """Compares the members of each bucket, or of two of its blocks, by matrix products.

    Rows come sorted by bucket and block pair; a group holds two blocks at most. A pair that
    shares several buckets counts in the first of them only. Out go the number of linked
    vectors for each member, and for the components a spanning forest of the links.
    """
    schema = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    group = ["label", "size", "table", "sign", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            keys = [held.column(name).to_numpy() for name in group]
            change = np.zeros(len(held) - 1, bool)
            for key in keys:
                change |= key[1:] != key[:-1]
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            yield _out(held.slice(0, starts[-1]), starts, threshold, schema)
            held = held.slice(starts[-1])
        if held is not None and len(held):
            yield _out(held, np.array([0, len(held)]), threshold, schema)

    return run


def _out(rows: pa.Table, starts: np.ndarray, threshold: float, schema: pa.Schema) -> pa.RecordBatch:
    """Counts and forests of complete groups, given where each begins and the last one ends."""
    found: list[tuple] = [(np.empty(0, np.int64),) * 3]
    if len(rows):
        rows = rows.combine_chunks()
        numbers = {n: rows.column(n).to_numpy() for n in ("cid", "copies", "block", "low", "high", "table")}
        vectors, signs = (rows.column(n).chunk(0) for n in ("vector", "signs"))
        for start, end in zip(starts[:-1], starts[1:], strict=True):
            x, sign = (v.slice(start, end - start).flatten().to_numpy(zero_copy_only=False)
                       .reshape(end - start, -1) for v in (vectors, signs))
            own = {name: values[start:end] for name, values in numbers.items()}
            found.extend(_block_links(x, sign, own, threshold))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(column)) for column in zip(*found, strict=True)], schema=schema)


def _block_links(x: np.ndarray, signs: np.ndarray, own: dict, threshold: float) -> Iterator[tuple]:
    left, right = (np.flatnonzero(own["block"] == own[side]) for side in ("low", "high"))
    scale = np.sqrt((x * x).sum(axis=1))
    close = (x[left] @ x[right].T) / np.outer(scale[left], scale[right]) >= threshold
    table = int(own["table"][0])
    if own["low"][0] == own["high"][0]:
        close = np.triu(close, 1)
    i, j = np.nonzero(close)
    fresh = ~(signs[left[i], :table] == signs[right[j], :table]).any(axis=1)
    i, j = left[i[fresh]], right[j[fresh]]
    if not len(i):
        return
    ids, copies = own["cid"], own["copies"]
    count = (np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))).astype(np.int64)
    seen = np.flatnonzero(count)
    yield ids[seen], count[seen], _roots(ids, i, j)[seen]


def _roots(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest id that each member reaches within its group."""
    root = ids.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        if (root == before).all():
            return root


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, bits: int = 10,
                           miss: float = 1e-3, seed: int = 1) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``.

    Vectors (vec_id, embedding, label) are linked if their labels are equal and their cosine,
    in double precision, is at least ``threshold``. Candidates share the signs of ``bits``
    random hyperplanes in one of several tables, as many as let a pair at the threshold be
    missed with a chance of ``miss``; closer pairs are missed less. ``bits`` should grow by
    one for each doubling of the vectors of a label beyond some ten thousand.

    Copies are merged first and counted with their number. Large buckets are cut into blocks
    of ``BLOCK``, and every two blocks are compared in a task of their own, so nothing grows
    with a bucket but the number of tasks; pairs are counted there and never written out.

    A vector that is NULL, empty, zero, or holds NULL or a value that is not finite, and one
    with a NULL label or vec_id, is linked with nothing: n_links 0, its own component, kept.
    Vectors of different lengths are never linked. Rows that share a vec_id count as vectors
    of their own for n_links, and as one node for components. An empty table gives no rows.
    """
    tables = tables_for(threshold, bits, miss)
    rows = written(
        vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long").alias("label"),
                       F.col("embedding").cast("array<double>").alias("vector"))
        .mapInArrow(_clean, "vec_id long, label long, vector array<double>, digest binary"))
    usable = rows.where("digest IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL")
    classes = written(
        usable.groupBy("label", "digest")
        .agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
        .withColumn("signs", _signs(tables, bits, seed)("vector"))
        .withColumn("cid", F.monotonically_increasing_id()))
    bucket = ["label", "size", "table", "sign"]
    places = classes.select("cid", "label", F.size("vector").alias("size"),
                            F.posexplode("signs").alias("table", "sign"))
    crowded = (places.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
               .select(*bucket, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    dealt = places.join(crowded, bucket).select(
        "cid", *bucket, F.pmod(F.xxhash64("cid"), "blocks").cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    group = [*bucket, "low", "high"]
    dealt = dealt.select("cid", *bucket, "block", F.least("block", "other").alias("low"),
                         F.greatest("block", "other").alias("high"))
    compared = written(
        dealt.join(classes.select("cid", "copies", "vector", "signs"), "cid")
        .repartition(*group).sortWithinPartitions(*group).mapInArrow(_compare(threshold), _BLOCKS))
    links = compared.groupBy("cid").agg(F.sum("links").alias("links"))
    of_class = classes.select("label", "digest", "cid", "id", "copies")
    edges = compared.select(F.col("cid").alias("src"), F.col("root").alias("dst"))
    found = connected_components(edges.unionByName(_same_id(usable, of_class)))
    reached = (of_class.join(found, F.col("cid") == F.col("node"), "left")
               .withColumn("component", F.coalesce("component", "cid")))
    smallest = reached.groupBy("component").agg(F.min("id").alias("component_id"))
    counted = (reached.join(links, "cid", "left").join(smallest, "component").select(
        "label", "digest", "component_id",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n")))
    component_id = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return rows.join(counted, ["label", "digest"], "left").select(
        "vec_id", F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("n")), F.lit(0)).cast("long")
        .alias("n_links"), component_id.alias("component_id"),
        F.coalesce(F.col("vec_id") == component_id, F.lit(True)).alias("kept"))


def _same_id(usable: DataFrame, of_class: DataFrame) -> DataFrame:
    """Links that make the vectors of one vec_id one node."""
    several = (usable.groupBy("vec_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"),
                                            F.min("label").alias("from"), F.max("label").alias("to"))
               .where("low < high OR from < to").select("vec_id"))
    nodes = (usable.select("vec_id", "label", "digest").join(several, "vec_id", "left_semi")
             .join(of_class.select("label", "digest", "cid"), ["label", "digest"]))
    least = nodes.groupBy("vec_id").agg(F.min("cid").alias("dst"))
    return nodes.join(least, "vec_id").select(F.col("cid").alias("src"), "dst")
