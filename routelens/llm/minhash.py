"""Near-duplicate documents: SuperMinHash signatures, bands, full verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, LongType

from routelens.llm.common import byte_texts, slices, written
from routelens.llm.components import connected_components

#: 45 bands of 5 miss a pair at 0.75 as rarely as 32 bands of 4; a slot's number fits a byte.
SLOTS, BAND = 225, 5
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_UNSET = np.uint64(2**64 - 1)
_LOW, _32 = np.uint64(0xFFFFFFFF), np.uint64(32)
#: Least estimated similarity of a pair that is compared in full; over five standard errors of
#: the estimate below 0.75.
ESTIMATE = 0.55


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed shingles; remembers the hashes of words, of at most ``most`` at a time."""

    def __init__(self, width: int, most: int = 150_000):
        self.width, self.most = width, most
        self.words: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        value = self.words.get(word)
        if value is None:
            if len(self.words) >= self.most:
                self.words.clear()
            value = xxhash.xxh3_64_intdigest(word)
            if len(word) <= 64:
                self.words[word] = value
        return value

    def shingles(self, text: bytes) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the windows of ``width`` words; of fewer words, one."""
        words = text.lower().split()  # on bytes: ASCII letters and ASCII white space only
        if not words:
            return np.empty(0, np.uint64)
        hashes = np.fromiter(map(self._hash, words), np.uint64, len(words))
        width = min(self.width, len(hashes))
        mixed = np.full(len(hashes) - width + 1, width, np.uint64)
        for i in range(width):
            mixed = mix((mixed + _STEP) ^ hashes[i:len(hashes) - width + 1 + i])
        return np.unique(mixed)


def super_min_hash(hashes: np.ndarray, owner: np.ndarray, n_sets: int,
                   slots: int = SLOTS) -> np.ndarray:
    """Signatures of sets given as concatenated hashes and the set each belongs to.

    Each element draws a random permutation of the slots step by step, and offers the j-th
    slot of it a value whose whole part is j. Once every slot of a set holds a value below j
    later steps cannot change it, and its elements stop.
    """
    signature = np.full(n_sets * slots, _UNSET)
    order = None
    for j in range(slots):
        drawn = mix(hashes + np.array(j + 1, np.uint64).reshape(1) * _STEP)
        pick = ((drawn & _LOW) * np.uint64(slots - j) >> _32).astype(np.int64) + j
        rows = np.arange(len(hashes))
        if order is None:
            slot = pick
        else:
            slot = order[rows, pick].astype(np.int64)
        np.minimum.at(signature, owner * slots + slot, np.uint64(j) << _32 | drawn >> _32)
        full = (signature.reshape(n_sets, slots) != _UNSET).all(axis=1)
        active = ~full[owner]
        if not active.any():
            break
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint8), (int(active.sum()), 1))
            pick = pick[active]
        else:
            order, pick = (order, pick) if active.all() else (order[active], pick[active])
        hashes, owner = hashes[active], owner[active]
        order[np.arange(len(pick)), pick] = order[:, j]
    return signature.reshape(n_sets, slots)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature; the number of the band is part of it."""
    bands = signatures.reshape(len(signatures), -1, BAND)
    keys = np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=np.uint64) * _STEP,
                           bands.shape[:2]).copy()
    for i in range(BAND):
        keys = mix((keys + _STEP) ^ bands[:, :, i])
    return keys


def _fixed_binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(width), len(rows),
                                 [None, pa.py_buffer(rows)]).cast(pa.binary())


_PROFILE = ("doc_id long, n_shingles long, digest binary, sketch binary, bands array<long>")


def _profiles(width: int, chunk: int = 100_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in slices(batches, "text", 4 << 20):
            sets = [shingler.shingles(text) for text in byte_texts(batch.column("text"))]
            start = 0
            while start < len(sets):
                end, held = start, 0
                while end < len(sets) and (end == start or held + len(sets[end]) <= chunk):
                    held += len(sets[end])
                    end += 1
                yield _profile(batch.column("doc_id").slice(start, end - start), sets[start:end])
                start = end

    return run


def _profile(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    sizes = np.array([len(s) for s in sets], np.int64)
    signatures = super_min_hash(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes),
                                len(sets))
    keys = band_keys(signatures).view(np.int64)
    offsets = np.arange(len(sets) + 1, dtype=np.int32) * keys.shape[1]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(sizes), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                                        pa.binary()),
         _fixed_binary((mix(signatures) & np.uint64(0xFFFF)).astype(np.uint16)),
         pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))],
        names=["doc_id", "n_shingles", "digest", "sketch", "bands"])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in slices(batches, "text", 4 << 20):
            rows = [shingler.shingles(text).tobytes() for text in byte_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(rows, pa.binary())], names=["id", "shingles"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shingle of each set, with a hash of the whole set."""
    for batch in batches:
        for row in batch.column("shingles"):
            hashes = np.frombuffer(row.as_buffer(), np.int64)
            of_set = xxhash.xxh3_64_intdigest(hashes) - (1 << 63)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(hashes), of_set)), pa.array(hashes)], names=["of_set", "shingle"])


@arrow_udf(LongType())
def _set_hash(shingles: pa.Array) -> pa.Array:
    return pa.array([xxhash.xxh3_64_intdigest(row.as_buffer()) - (1 << 63) for row in shingles], pa.int64())


_DIFFERENCES = ("leader long, base long, id long, label long, of_set long, n long, n_base long, d long, "
                "element long")


def _differences(most: int = 200_000):
    """One row for each shingle that stands in a set or in its leader's, but not in both.

    An element is NULL in the one row of a set that differs in nothing.
    """
    keep = ["leader", "base", "id", "label", "of_set"]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        own, sizes, elements = zip(*rows, strict=True)
        repeat = np.array([len(e) for e in elements])
        columns = [pa.array(np.repeat(np.array(column, np.int64), repeat))
                   for column in (*zip(*own, strict=True), *zip(*sizes, strict=True))]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.concat_arrays(elements)], names=[*keep, "n", "n_base", "d", "element"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            owns = zip(*(batch.column(name).to_pylist() for name in keep), strict=True)
            for own, x, y in zip(owns, batch.column("shingles"), batch.column("base_shingles"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.int64) for v in (x, y))
                d = np.setxor1d(x, y, assume_unique=True)
                rows.append((own, (len(x), len(y), len(d)),
                             pa.array(d) if len(d) else pa.nulls(1, pa.int64())))
                held += len(d)
                if held >= most:
                    yield out(rows)
                    rows, held = [], 0
        if rows:
            yield out(rows)

    return run


@arrow_udf(DoubleType())
def _estimate(a: pa.Array, b: pa.Array) -> pa.Array:
    """Share of equal slots of two sketches."""
    left, right = (np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(len(x), -1)
                   for x in (a, b))
    return pa.array((left == right).mean(axis=1) if len(left) else np.empty(0))


def _linked(percent: int):
    @arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = np.concatenate([x, y])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            out.append(100 * common >= percent * (len(x) + len(y) - common))
        return pa.array(out, pa.bool_())

    return linked


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75,
                    rounds: int = 1) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Documents are linked if their sets of ``width``-word shingles share at least ``percent``
    of their union; component_id is the smallest doc_id that links reach. Candidates share a
    band of a 225-slot SuperMinHash signature: a pair at exactly 0.75 is missed five times in a
    million, one at 0.8 twice in a hundred million. Links are confirmed on the full sets.

    Copies are merged by the digest of their set before anything is compared, so a group of
    copies costs one row in each task. Within a bucket all members are first compared to one
    of them, the one that meets most others in its buckets, and what is linked then counts as
    one (not with ``rounds=0``). Members that are still in different components are compared by
    what sets them apart from such a leader (``_last_links``), so that neither a group of near
    copies nor a passage that many documents share makes pairs. No link between components is lost.

    NULL, empty or blank text: no shingles, linked with nothing. NULL doc_id: linked with
    nothing, component_id NULL, kept. Rows that share a doc_id are one node with the links of
    all of them. An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    profiles = written(texts.mapInArrow(_profiles(width), _PROFILE))
    usable = profiles.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("id"))
    first = (usable.join(classes.withColumnRenamed("digest", "__digest"),
                         (F.col("doc_id") == F.col("id")) & (F.col("digest") == F.col("__digest")))
             .select("id", "digest", "n_shingles", "sketch", "bands"))
    first = written(first.dropDuplicates(["id", "digest"]))
    entries = first.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    crowded = (entries.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"),
                                          F.count("*").alias("size"))
               .where("low < high").select("key", "size"))
    entries = written(entries.join(crowded, "key").distinct())
    met = entries.groupBy("id").agg(F.sum("size").alias("met"))
    entries = entries.drop("size").join(met, "id")
    sketches = first.select("id", "sketch")
    shingles = written(
        texts.join(entries.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi")
        .withColumnRenamed("doc_id", "id").mapInArrow(_sets(width), "id long, shingles binary"))
    links = written(_same_id(usable, classes))
    found = connected_components(links)
    attempt = 0
    while True:
        labelled = entries.join(found, F.col("id") == F.col("node"), "left").select(
            "key", "id", "n", "met", F.coalesce("component", "id").alias("label"))
        open_keys = (labelled.groupBy("key").agg(F.min("label").alias("low"),
                                                 F.max("label").alias("high"))
                     .where("low < high").select("key"))
        labelled = written(labelled.join(open_keys, "key"))
        entries = labelled.drop("label")  # settled buckets stay settled
        if labelled.isEmpty():
            break
        done = attempt == rounds
        fresh = (_last_links(labelled, shingles, sketches, percent) if done else
                 _confirmed(_close_pairs(_star_pairs(labelled, percent), sketches), shingles, percent))
        links = written(links.unionByName(fresh))
        found = connected_components(links)
        if done:
            break
        attempt += 1
    return _members(profiles, classes, found)


def _same_id(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """Links that make the texts of one doc_id one node."""
    several = (usable.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
               .where("low < high").select("doc_id"))
    return (usable.select("doc_id", "digest").join(several, "doc_id", "left_semi")
            .join(classes, "digest").select(F.col("doc_id").alias("src"), F.col("id").alias("dst")))


def _confirmed(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    left = shingles.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = shingles.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return (pairs.join(left, "a").join(right, "b").where(_linked(percent)("x", "y"))
            .select(F.col("a").alias("src"), F.col("b").alias("dst")))


def _members(profiles: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    component = classes.join(found, F.col("id") == F.col("node"), "left").select(
        F.col("digest").alias("__digest"), F.coalesce("component", "id").alias("component"))
    joined = (profiles.select("doc_id", "n_shingles", "digest").join(
        component, (F.col("digest") == F.col("__digest")) & (F.col("n_shingles") > 0), "left"))
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component_id.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"))


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be linked."""
    return (100 * a >= percent * b) & (100 * b >= percent * a)


def _leaders(labelled: DataFrame) -> DataFrame:
    """Each bucket's leader: the member that meets most sets in its buckets, so mostly their centre."""
    order = F.struct(F.negative("met").alias("met"), F.xxhash64("id").alias("h"), "id", "label", "n")
    return labelled.groupBy("key").agg(F.min(order).alias("leader"))


def _star_pairs(labelled: DataFrame, percent: int) -> DataFrame:
    """Each member with its bucket's leader."""
    return (labelled.join(_leaders(labelled), "key").where(F.col("label") != F.col("leader.label"))
            .where(_sizes_allow(F.col("n"), F.col("leader.n"), percent))
            .select(F.least("id", "leader.id").alias("a"), F.greatest("id", "leader.id").alias("b"))
            .distinct())


def _shared_sizes(labelled: DataFrame, shingles: DataFrame) -> DataFrame:
    """(id, n, shared): how many of a set's n shingles stand in another set of unsettled buckets.

    Two sets have no more in common than either shares with all others. Only minima, maxima
    and counts are aggregated, so a shingle of many sets is combined in each task.
    """
    sets = shingles.join(labelled.select("id").distinct(), "id", "left_semi")
    alone = (sets.select("id", "shingles").mapInArrow(_spread, "of_set long, shingle long").groupBy("shingle")
             .agg(F.min("of_set").alias("of_set"), F.max("of_set").alias("high"))
             .where("of_set = high").groupBy("of_set").agg(F.count("*").alias("alone")))
    sizes = sets.select("id", (F.octet_length("shingles") / 8).cast("long").alias("n"),
                        _set_hash("shingles").alias("of_set"))
    return (sizes.join(alone, "of_set", "left").groupBy("id", "n")
            .agg(F.max(F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared")))


def _last_links(labelled: DataFrame, shingles: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The links between members of a bucket whose components differ.

    Members whose shingles stand in too few other open sets are left out. The others are seen
    by their differences from the bucket's leader: what a whole group has in common is in none.
    Those linked with the leader are so by their number of differences; for all other pairs
    see ``_pairs_by_differences``.
    """
    shared = _shared_sizes(labelled, shingles).where(100 * F.col("shared") >= percent * F.col("n"))
    able = labelled.join(shared.select("id").distinct(), "id", "left_semi")
    leaders = _leaders(able).select("key", F.col("leader.id").alias("leader"))
    members = written(able.join(leaders, "key").select("leader", "id", "label").distinct())
    sets = (shingles.join(members.select("id").distinct(), "id", "left_semi").distinct()
            .withColumn("of_set", _set_hash("shingles")))
    # A leader of many is dealt to several tasks.
    parts = members.groupBy("leader").agg(F.ceil(F.count("*") / 1000).cast("int").alias("parts"))
    bases = parts.join(sets.select(F.col("id").alias("leader"), F.col("of_set").alias("base"),
                                   F.col("shingles").alias("base_shingles")), "leader")
    bases = bases.select("leader", "base", "base_shingles", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
                         .alias("part"))
    dealt = members.join(parts, "leader").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    differences = written(
        dealt.join(sets, "id").join(bases, ["leader", "part"])
        .select("leader", "base", "id", "label", "of_set", "shingles", "base_shingles")
        .mapInArrow(_differences(), _DIFFERENCES))
    to_leader = (differences.where((100 + percent) * F.col("d") <= (100 - percent) * (F.col("n") + F.col("n_base")))
                 .where("id <> leader").select(F.col("id").alias("src"), F.col("leader").alias("dst")).distinct())
    pairs = _close_pairs(_pairs_by_differences(differences, percent), sketches)
    return to_leader.unionByName(_confirmed(pairs, shingles, percent))


def _pairs_by_differences(differences: DataFrame, percent: int, classes: int = 16, salts: int = 16) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, though not both to their leader.

    Sets of n and m shingles, with d and e differences from one leader of which o are the same,
    differ from each other in d + e - 2 o. They are linked if that is at most the part
    (100 - percent) / (100 + percent) of n + m. So with the excess g = (100 + percent) d -
    (100 - percent) n of each set, o must reach (g + g') / (2 (100 + percent)), which is more
    than 0 unless both are linked with the leader. Then, with the differences in one order,
    rarest first, the first d - o + 1 of one set hold one of the first e - o + 1 of the other.
    As o depends on both, sets are put in classes of g, and a set's first differences are
    given for each class that its leader's members have.
    """
    whole = 100 + percent
    limit = (100 - percent) * F.col("n_base")
    width = F.greatest(F.lit(4), F.floor(F.col("n_base") / classes)) * whole
    rows = differences.where("element IS NOT NULL").withColumn(
        "g", whole * F.col("d") - (100 - percent) * F.col("n")).withColumn(
        "class", F.least(F.lit(4 * classes), F.floor((F.col("g") - limit - 1) / width)).cast("long"))
    # Classes below 0 hold those linked with the leader.
    present = rows.groupBy("leader", "base").agg(F.collect_set("class").alias("others"))
    often = (rows.groupBy("leader", "base", "element")
             .agg(F.count("*").alias("often"), F.min("label").alias("low"), F.max("label").alias("high"))
             .where("often > 1")
             .select("leader", "base", "element", "often", (F.col("low") < F.col("high")).alias("across"),
                     F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")))
    ranked = rows.withColumn("salt", F.pmod(F.xxhash64("of_set"), F.lit(salts)).cast("int")).join(
        often, ["leader", "base", "element", "salt"], "left").withColumn(
        "rank", F.row_number().over(Window.partitionBy("leader", "base", "id", "of_set")
                                    .orderBy(F.coalesce("often", F.lit(1)), "element")))
    least = F.greatest(F.lit(1), F.ceil((F.col("g") + F.col("other") * width + limit + 1) / (2 * whole)))
    first = written(
        ranked.where("across").join(present, ["leader", "base"])
        .withColumn("other", F.explode("others")).where("class >= 0 OR other >= 0")
        .where(F.col("rank") <= F.col("d") - least + 1)
        .select("leader", "base", "element", "class", "other", "id", "label", "n"))
    left = first.where("class <= other")
    right = first.where("class >= other").select(
        "leader", "base", "element", F.col("class").alias("other"), F.col("other").alias("class"),
        F.col("id").alias("id2"), F.col("label").alias("label2"), F.col("n").alias("n2"))
    return (left.join(right, ["leader", "base", "element", "class", "other"])
            .where("label <> label2 AND (class < other OR id < id2)")
            .where(_sizes_allow(F.col("n"), F.col("n2"), percent))
            .select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct())


def _close_pairs(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs whose sketches look alike."""
    for side in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("id").alias(side),
                                           F.col("sketch").alias(f"sketch_{side}")), side)
    return (pairs.where(_estimate("sketch_a", "sketch_b") >= ESTIMATE)
            .select("a", "b").distinct())
