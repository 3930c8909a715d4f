"""Near-duplicate vectors by projection passes.

Each pass draws ``BITS`` random hyperplanes; a vector's signs, concatenated, are its key. Vectors of one (label,
dimension) that share the first ``depth`` signs stand in one bucket, and all pairs of a bucket are compared, however
crowded it is: large buckets in pairs of blocks that are dealt out. Pairs of cosine >= ``threshold`` are links; of each
pair of blocks only a tree for each group of linked vectors is kept. Passes are independent; their links are united.

A pair right at the threshold shares a bucket in one pass with probability ``(1 - angle / pi) ** depth``. The planes do not
depend on the vectors, so this holds wherever the pair stands, also inside a dense cluster; the number of passes follows
from it for a miss of at most ``MISS``. The depth only sets the cost: Spark counts how many rows share each prefix, and the
depth with the least work over all passes is taken (at depth 0 one pass compares all pairs of a label).

Inside a component found this way every vector is compared with every other, block by block, and only
counts and direct links to the component's blocks are kept, never the pairs: so the link counts of a dense group
are whole although its pairs are many more than a window holds.

Equal vectors of one label are one row with its copies counted, from the start.

Defined results: a null, empty or zero vector, one with a null or non-finite component, and one with a null label
link with nothing (0 links, own component); vectors of different lengths never link; rows with equal vec_id
are one node if their vectors agree, else they are linked as separate vectors and share the smallest id reached; a
null vec_id is not linked, and its component is null; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import column, stored
from .graph import components

THRESHOLD = 0.98
BITS, MISS = 62, 0.005
#: Depths to choose from, and the number of comparisons that handling a row once costs as much as.
DEPTHS, ROW = range(0, BITS, 3), 1000
#: Vectors of one component, and of one bucket, that are compared at once; rows of a product of bucket blocks held at once.
BLOCK = 1024
BUCKET, STRIP = 2048, 256
SALTS = 16


def passes_needed(depth: int, threshold: float, miss: float) -> int:
    chance = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** depth
    if chance >= 1 - miss:
        return 1
    return math.ceil(math.log(miss) / math.log1p(-chance)) if chance > 1e-12 else 1 << 40


def planes(number: int, dim: int) -> np.ndarray:
    return np.random.default_rng([20240917, number, dim]).standard_normal((dim, BITS))


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    x = vectors.values.to_numpy(zero_copy_only=False) if hasattr(vectors, "values") else np.zeros(0)
    at = vectors.offsets.to_numpy()
    return np.asarray(x[at[0] : at[-1]], float).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


def _keyed(classes: DataFrame, number: int) -> DataFrame:
    """(kin, cid, dim, vector, order): the signs of each vector in one pass; kin stands for label and dimension."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            for dim, rows in _by_dim(batch):
                signs = _unit(_matrix(rows.column("vector"), dim)) @ planes(number, dim) > 0
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("kin", "cid", "dim", "vector")), pa.array(signs @ weights)],
                    ["kin", "cid", "dim", "vector", "order"],
                )

    rows = classes.select(F.xxhash64("label", "dim").alias("kin"), "cid", "dim", "vector")
    return rows.mapInArrow(keyed, "kin long, cid long, dim int, vector array<double>, order long")


def best_depth(classes: DataFrame, threshold: float, miss: float) -> int:
    """The depth of least work: passes times rows and pairs of rows that share a prefix, as counted in one pass."""
    shift = F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), F.shiftright("order", BITS - d).alias("prefix")) for d in DEPTHS)))
    prefixes = _keyed(classes, 0).select("kin", shift.alias("at")).groupBy("kin", "at").count()
    pairs = prefixes.groupBy("at.depth").agg(F.sum(F.col("count").cast("double") ** 2).alias("pairs"), F.sum("count").alias("n"))
    work = {r.depth: passes_needed(r.depth, threshold, miss) * (r.pairs / 2 + ROW * r.n) for r in pairs.collect()}
    return min(work, key=lambda d: (work[d], d), default=0)


def _joined(top: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``top``, each node's smallest linked one, with the links (i, j) added."""
    while len(i):
        low = np.minimum(top[i], top[j])
        np.minimum.at(top, top[i], low)
        np.minimum.at(top, top[j], low)
        while (top[top] != top).any():
            top = top[top]
        open_ = top[i] != top[j]
        i, j = i[open_], j[open_]
    return top


def _bucket_links(classes: DataFrame, number: int, depth: int, threshold: float) -> DataFrame:
    """Links (a, b) of one pass, a tree for each linked group of a pair of blocks."""
    rows = _keyed(classes, number).select(
        "kin", "cid", "dim", "vector", F.xxhash64(F.lit(number), "kin", F.shiftright("order", BITS - depth)).alias("bucket")
    )
    # Crowded buckets are few: one in ``BUCKET`` rows at most.
    crowded = rows.groupBy("kin", "bucket").count().where(F.col("count") > BUCKET).select(
        "kin", "bucket", F.ceil(F.col("count") / BUCKET).cast("int").alias("parts")
    )
    cut = rows.join(crowded, ["kin", "bucket"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    each = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = each.select(
        "kin", "bucket", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"),
        (F.col("part") > F.col("other")).alias("second"), "cid", "dim", "vector",
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("kin", "bucket", "p", "q")])
            new = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
            for low, high in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows], strict=True):
                group = tuple(key[:, low].tolist())
                if held and group != last:
                    yield from _trees(held, last)
                    held = []
                held.append(batch.slice(low, high - low))
                last = group
        if held:
            yield from _trees(held, last)

    def _trees(parts: list[pa.RecordBatch], group: tuple) -> Iterator[pa.RecordBatch]:
        if sum(p.num_rows for p in parts) < 2:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        cid, second = table.column("cid").to_numpy(), table.column("second").to_numpy()
        x = _unit(_matrix(table.column("vector").chunk(0), table.column("dim")[0].as_py()))
        same = group[2] == group[3]
        mine, other = (np.arange(len(cid)),) * 2 if same else (np.flatnonzero(~second), np.flatnonzero(second))
        top = np.arange(len(cid))
        for low in range(0, len(mine), STRIP):
            at = mine[low : low + STRIP]
            against = other[low:] if same else other
            i, j = np.nonzero(x[at] @ x[against].T >= threshold)
            i, j = at[i], against[j]
            top = _joined(top, i[i != j], j[i != j])
        ends = np.flatnonzero(top != np.arange(len(cid)))
        if len(ends):
            yield pa.RecordBatch.from_arrays([pa.array(cid[ends]), pa.array(cid[top[ends]])], ["a", "b"])

    keys = ["kin", "bucket", "p", "q"]
    paired = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return paired.mapInArrow(compared, "a long, b long").where("a <> b").distinct()


def _counts(members: DataFrame, threshold: float) -> DataFrame:
    """(cid, linked): other vectors linked with each, over all pairs of blocks of its component."""
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    cut = members.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    mine = cut.select("component", F.col("part").alias("p"), each.alias("q"), "cid", "dim", "vector", "copies", F.lit(0).alias("side"))
    other = cut.select("component", each.alias("p"), F.col("part").alias("q"), "cid", "dim", "vector", "copies", F.lit(1).alias("side"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("component", "p", "q")])
            new = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
            for low, high in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows], strict=True):
                group = tuple(key[:, low].tolist())
                if held and group != last:
                    yield _block(held)
                    held = []
                held.append(batch.slice(low, high - low))
                last = group
        if held:
            yield _block(held)

    def _block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        side = table.column("side").to_numpy()
        dim = table.column("dim")[0].as_py()
        x = _unit(_matrix(table.column("vector").chunk(0), dim))
        cid, copies = table.column("cid").to_numpy(), table.column("copies").to_numpy()
        mine, other = side == 0, side == 1
        linked = (x[mine] @ x[other].T >= threshold) | (cid[mine][:, None] == cid[other][None, :])
        return pa.RecordBatch.from_arrays([pa.array(cid[mine]), pa.array(linked @ copies[other])], ["cid", "linked"])

    paired = mine.union(other).repartition("component", "p", "q").sortWithinPartitions("component", "p", "q")
    return paired.mapInArrow(counted, "cid long, linked long").groupBy("cid").agg((F.sum("linked")).alias("linked"))


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``."""
    vector = F.transform(column(vectors, "embedding"), lambda v: v.cast("double"))
    flat = vectors.select(
        column(vectors, "vec_id").alias("vec_id"), column(vectors, "label").alias("label"), vector.alias("vector")
    )
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("vector") > 0, F.lit(False))
        & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("vector", lambda v: v != 0), F.lit(False))
    )
    # Adding zero makes -0.0 and 0.0 one value.
    clean = F.transform("vector", lambda v: v + F.lit(0.0))
    marked = flat.withColumn("usable", usable).withColumn("vector", F.when(F.col("usable"), clean))
    named = stored(
        marked.withColumn("print", F.when(F.col("usable"), F.sha2(F.to_json(F.struct("label", "vector")).cast("binary"), 256))),
        "vectors",
    )
    classes = stored(
        named.where("usable")
        .groupBy("print")
        .agg(
            F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies"),
            F.first("label").alias("label"), F.first("vector").alias("vector"),
        )
        .withColumn("cid", F.xxhash64("print"))
        .withColumn("dim", F.size("vector")),
        "vector-classes",
    )
    depth = best_depth(classes, threshold, miss)
    links = None
    for number in range(passes_needed(depth, threshold, miss)):
        found = _bucket_links(classes, number, depth, threshold)
        links = found if links is None else links.union(found)
    groups = components(stored(links.distinct(), "vector-links"))
    members = classes.join(groups.withColumnRenamed("node", "cid"), "cid")
    counts = _counts(members.select("component", "cid", "dim", "vector", "copies"), threshold)
    heads = members.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = members.select("cid", "component").join(heads, "component").join(counts, "cid")
    answers = (
        classes.select("print", "cid", "rep", "copies").join(linked.select("cid", "component_id", "linked"), "cid", "left")
        .where("copies > 1 OR component_id IS NOT NULL")
        .select(
            "print", F.coalesce("component_id", "rep").alias("component_id"),
            (F.coalesce("linked", "copies") - 1).alias("n_links"),
            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
        )
    )
    salted = named.select("vec_id", "print", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
    return salted.join(answers, ["print", "salt"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
    )
