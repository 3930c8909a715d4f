"""Set-similarity join on word n-grams with set-relation skipping.

A document's set is cut into blocks of consecutive positions in hash order. Sets with a Jaccard
similarity of at least ``num / den`` differ in at most h elements, so among h + 1 blocks one is equal in
both: an index list holds the sets that share a block at its place, and all other positions are skipped
at once. Sizes are split into classes such that partners lie in the same or the next one; a set is indexed
with the block numbers of both.

Answers are derived along set relations:

1. Equal sets are one class; its representative answers for all.
2. In each list every set is compared with one member of it, and in lists that this does not unite all pairs are, by
   parities of their elements: about as many bits as a set has elements. Parities that differ in d bits prove that the
   sets differ in d elements at least, so no similar pair is lost. What is left unites sets to families, and only
   sets of families are read with their elements.
3. The links of the lists' heads are verified and give first components: sets in one need no more comparing, its
   answers are taken over. Sets of one family but of different components are compared in blocks; a block gives only
   what it links, so a dense family, such as thousands of near copies, is compared in full without a row for each of its pairs.

Lists are folded inside each part of a scan before they are shuffled, so a list that a third of all documents
share arrives as one row a part. Components are found without gathering them.

Defined results: a null or wordless text has an empty set (size 0) and is linked with nothing; fewer than
``size`` words are one shingle; rows with equal doc_id are one document if their texts agree, else
each is judged by its own text; a null doc_id has a null component and links nothing; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as B
from .frames import SWEPT, column, session_settings, stored
from .graph import components, united

SIZE, NUM, DEN = 3, 90, 100
SALTS = 16
#: Bytes of text whose lists are folded before they are dealt out.
ENTERED = 2 << 20
#: Sets and elements in one block of a family, and elements that are counted at once.
BLOCK, BLOCK_ITEMS, COLUMNS = 1024, 500_000, 4096
#: Most bits of a set's parities; sets of one list that meet in a task; their pairs that are looked at at once.
PARITIES, MEETING, PAIRS = 1 << 16, 2048, 1 << 17
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def size_classes(num: int, den: int, limit: int = 1 << 31) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper ends of the size classes, blocks for pairs of a class and the next, and spare blocks among them.

    With ``spare`` blocks beyond h + 1, two similar sets share spare + 1 blocks at least; so a set with
    no more than ``spare`` empty blocks need not be listed under those.
    """
    upper = []
    low = 1
    while low < limit:
        upper.append(low * den // num)
        low = upper[-1] + 1
    ends = np.array(upper, np.int64)
    least = (ends[:-1] + ends[1:]) * (den - num) // (den + num) + 1
    low = np.concatenate([[1], ends[:-2] + 1])
    spare = np.ceil(1.5 * least * np.exp(-low / least)).astype(np.int64) + 1
    spare[least == 1] = 0
    return ends[:-1], least + spare, spare


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    words, first = B.word_hashes(raw, offsets, B.VISIBLE)
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        rolled = rolled + words[k : len(words) - size + 1 + k] * _MULT[k % 5] * np.uint64(2 * (k // 5) + 1)
    rolled = B.mixed(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            few = words[a:b] * _MULT[: b - a] if b - a <= 5 else words[a:b] * np.arange(3, 2 * (b - a) + 3, 2, dtype=np.uint64)
            out.append(B.mixed(np.array([few.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(words[:0])
    return out


def blocks(elements: np.ndarray, level: int, counts: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Keys of the blocks of one sorted set, under the block numbers of its class and the one below."""
    sums = np.zeros(len(elements) + 1, np.uint64)
    np.cumsum(B.mixed(elements ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    high = elements >> np.uint64(32)
    keys = []
    for group in (level, level - 1) if level else (level,):
        m = int(counts[group])
        edges = (np.arange(m + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(m)
        at = np.searchsorted(high, edges)
        at[-1] = len(elements)
        size = np.diff(at)
        key = B.mixed(sums[at[1:]] - sums[at[:-1]] + size.astype(np.uint64))
        key = B.mixed(key + np.arange(m, dtype=np.uint64) + np.uint64((group + 1) << 40))
        full = size > 0
        keys.append(key[full] if m - full.sum() <= spare[group] else key)
    return np.concatenate(keys)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").cast("string").alias("text"))


def _prints(sets: list[np.ndarray], turn: int) -> np.ndarray:
    """One 64-bit fingerprint of each set."""
    with np.errstate(over="ignore"):
        found = [int(B.mixed(s * _MULT[turn]).sum(dtype=np.uint64)) for s in sets]
    return np.array(found, np.uint64).view(np.int64)


def parities(elements: np.ndarray) -> bytes:
    """Whether an odd number of elements falls on each of 2 ** k bits, 64 at least, one an element or more up to ``PARITIES``."""
    bits = min(PARITIES, max(64, 1 << max(0, len(elements) - 1).bit_length()))
    counts = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


class Parities:
    """The parities of many sets, compared at the width of the shorter ones."""

    def __init__(self, column: pa.Array) -> None:
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)
        self.words = np.diff(at) // 8
        self.width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        place = np.zeros(len(column), np.int64)
        wider = np.zeros((0, 0), np.uint64)
        rows = np.zeros(0, np.int64)
        for words in np.unique(self.words)[::-1].tolist():
            while wider.shape[0] and wider.shape[1] > words:  # halves fall on one another
                half = wider.shape[1] // 2
                wider = wider[:, :half] ^ wider[:, half:]
            own = np.flatnonzero(self.words == words)
            mine = raw[at[own][:, None] + np.arange(8 * words)].view("<u8")
            wider = np.concatenate([wider.reshape(-1, words), mine])
            rows = np.concatenate([rows, own])
            place = place.copy()
            place[rows] = np.arange(len(rows))
            self.width[words] = place, wider

    def differing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which the parities of rows ``i`` and ``j`` differ."""
        common = np.minimum(self.words[i], self.words[j])
        out = np.zeros(len(i), np.int64)
        for words in np.unique(common).tolist():
            place, bits = self.width[words]
            at = np.flatnonzero(common == words)
            strip = max(1, (1 << 20) // words)
            for low in range(0, len(at), strip):
                part = at[low : low + strip]
                differ = bits[place[i[part]]] ^ bits[place[j[part]]]
                out[part] = np.bitwise_count(differ).sum(1, dtype=np.int64)
        return out


def _may_link(differing: np.ndarray, n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of ``n`` elements together may be similar if they differ in so many elements or more."""
    return differing * (num + den) <= n * (den - num)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, cid, check, bits): set size, two fingerprints and the parities of the set; stored."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in B.slices(batches, "text"):
            sets = shingle_sets(raw, offsets, size)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), pa.array(np.array([len(s) for s in sets], np.int64)),
                    pa.array(_prints(sets, 0)), pa.array(_prints(sets, 1)), pa.array([parities(s) for s in sets], pa.binary()),
                ],
                ["doc_id", "n", "cid", "check", "bits"],
            )

    texts = _texts(docs)
    id_type = dict(texts.dtypes)["doc_id"]
    return stored(texts.mapInArrow(signed, f"doc_id {id_type}, n long, cid long, check long, bits binary"), "set-signatures")


def _heads(key: np.ndarray, cid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order of (key, cid); the first entry of each one's run; the length of its run."""
    order = np.lexsort((cid, key))
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    length = np.diff(np.append(start, len(k)))
    return order, start[run] if len(k) else run, length[run] if len(k) else run


def _entries(key, cid, other, deal) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(deal), pa.array(key), pa.array(cid), other], ["deal", "key", "cid", "other"]
    )


def index_lists(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Lists of two sets or more, (key, cid, other): ``other`` is a member to verify against; stored."""

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, counts, spare = size_classes(num, den)
        for _, raw, offsets in B.slices(batches, "text", ENTERED):
            sets = [s for s in shingle_sets(raw, offsets, size) if len(s)]
            if not sets:
                continue
            cids, at = np.unique(_prints(sets, 0), return_index=True)  # equal sets enter once
            keys = [blocks(sets[i], int(np.searchsorted(ends, len(sets[i]))), counts, spare) for i in at.tolist()]
            key = np.concatenate(keys).view(np.int64)
            cid = np.repeat(cids, [len(k) for k in keys])
            order, head, length = _heads(key, cid)
            key, cid = key[order], cid[order]
            folded = head != np.arange(len(head))
            # A folded entry only passes through, dealt out by its own set; so does a note of its run's head.
            yield _entries(key, cid, pa.array(cid[head], mask=~folded), np.where(folded, cid, key))
            noted = ~folded & (length > 1)
            yield _entries(key[noted], cid[noted], pa.array(cid[noted]), cid[noted])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            lone = batch.column("other").is_null()
            through = batch.filter(lone.invert() if hasattr(lone, "invert") else pa.compute.invert(lone))
            if through.num_rows:
                yield through
            rows = batch.filter(lone)
            key, cid = rows.column("key").to_numpy(), rows.column("cid").to_numpy()
            if held is not None:  # the last key of a batch may go on in the next; its head is kept
                key, cid = np.append(held[0], key), np.append(held[1], cid)
            if not len(key):
                continue
            _, head, length = _heads(key, np.arange(len(key)))
            first = head == np.arange(len(head))
            again = ~first
            opened = first & (length > 1)
            if held is not None and held[2]:
                opened[0] = False  # already given
            last = head[-1]
            given = bool(length[-1] > 1) or bool(held is not None and held[2] and last == 0)
            pick = again | opened
            if pick.any():
                yield _entries(key[pick], cid[pick], pa.array(cid[head][pick], mask=first[pick]), key[pick])
            held = (key[last : last + 1], cid[last : last + 1], given)

    raw = _texts(docs).where("doc_id IS NOT NULL").select("text").mapInArrow(entered, "deal long, key long, cid long, other long")
    dealt = raw.repartition("deal").sortWithinPartitions("key", "cid")
    return stored(dealt.mapInArrow(met, "deal long, key long, cid long, other long").drop("deal"), "index-lists")


def elements_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cid, n, items) of the representatives ``wanted`` (cid, doc_id); stored."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in B.slices(batches, "text"):
            sets = shingle_sets(raw, offsets, size)
            cid = _prints(sets, 0)
            ends = np.cumsum([0, *map(len, sets)])
            items = B.list_array(np.concatenate(sets).view(np.int64), ends, pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(cid), pa.array(np.diff(ends)), items], ["cid", "n", "items"])
            yield batch.filter(pa.array(cid == rows.column("cid").to_numpy()))

    found = _texts(docs).join(wanted, "doc_id").mapInArrow(listed, "cid long, n long, items array<bigint>")
    return stored(found.dropDuplicates(["cid"]), "set-elements")


def possible(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that parities (cid, n, bits) leave open."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            both = Parities(pa.concat_arrays([batch.column("ba"), batch.column("bb")]))
            rows = np.arange(batch.num_rows)
            differ = both.differing(rows, rows + batch.num_rows)
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(_may_link(differ, n, num, den)))

    left = sketches.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    right = sketches.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(compared, "a long, b long")


def list_links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that parities leave open between members (key, leader, cid, n, bits) of one list and different leaders.

    Long lists are cut into blocks. A block gives the trees of what it unites, never the pairs.
    """
    sizes = rows.groupBy("key").count().where(F.col("count") > MEETING).select(
        "key", F.ceil(F.col("count") / MEETING).cast("int").alias("parts")
    )
    cut = rows.join(sizes, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    each = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = each.select(
        "key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"),
        (F.col("part") > F.col("other")).cast("int").alias("side"), "leader", "cid", "n", "bits",
    )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("key", "p", "q")])
            new = np.flatnonzero(np.concatenate([[last != tuple(key[:, 0].tolist())], (key[:, 1:] != key[:, :-1]).any(0)]))
            if len(new):  # all groups but the last have ended
                held.append(batch.slice(0, new[-1]))
                yield _possible_trees(held, num, den)
                held = []
                batch = batch.slice(new[-1])
            held.append(batch)
            last = tuple(key[:, -1].tolist())
        if held:
            yield _possible_trees(held, num, den)

    keys = ["key", "p", "q"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(compared, "a long, b long").distinct()


def _possible_trees(parts: list[pa.RecordBatch], num: int, den: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(parts).combine_chunks()
    names = ("key", "p", "q", "side", "leader", "cid", "n")
    key, p, q, side, leader, cid, n = (table.column(c).to_numpy() for c in names)
    label = np.arange(len(cid))
    if len(cid) > 1:
        bits = Parities(table.column("bits").chunk(0))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
        ends = np.append(np.flatnonzero(new)[1:], len(cid))[np.cumsum(new) - 1]
        after = ends - np.arange(len(cid)) - 1  # rows of its group behind each row
        before = np.cumsum(after) - after
        low = 0
        while low < len(cid):
            high = max(low + 1, int(np.searchsorted(before, before[low] + PAIRS)))
            i = np.repeat(np.arange(low, high), after[low:high])
            j = i + 1 + np.arange(len(i)) - (before[i] - before[low])
            open_ = (leader[i] != leader[j]) & ((p[i] == q[i]) | (side[i] != side[j])) & (label[i] != label[j])
            open_ &= np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num
            i, j = i[open_], j[open_]
            near = _may_link(bits.differing(i, j), n[i] + n[j], num, den)
            label = united(label, i[near], j[near])
            low = high
    ends = np.flatnonzero(label != np.arange(len(cid)))
    return pa.RecordBatch.from_arrays([pa.array(cid[ends]), pa.array(cid[label[ends]])], ["a", "b"])


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with na, nb and the number of common elements."""
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    return (
        pairs.join(left, "a").join(right, "b")
        .withColumn("common", F.size(F.array_intersect("ia", "ib")).cast("long"))
        .drop("ia", "ib")
    )


def family_links(members: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between components of one family (family, leader, cid, n, items), block by block.

    A task holds two blocks of a family and counts the common elements of all their sets as a product of
    matrices. It gives the trees of what is linked, never the pairs.
    """
    sizes = members.groupBy("family").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_ITEMS)).cast("int").alias("parts")
    )
    cut = members.join(sizes, "family").withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    rest = ["leader", "cid", "n", "items"]
    one = cut.select("family", F.col("part").alias("p"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("q"), F.lit(0).alias("side"), *rest)
    two = cut.where("part > 0").select("family", F.explode(F.sequence(F.lit(0), F.col("part") - 1)).alias("p"), F.col("part").alias("q"), F.lit(1).alias("side"), *rest)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("family", "p", "q")])
            new = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
            for low, high in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows], strict=True):
                group = tuple(key[:, low].tolist())
                if held and group != last:
                    yield _trees(held, num, den)
                    held = []
                held.append(batch.slice(low, high - low))
                last = group
        if held:
            yield _trees(held, num, den)

    dealt = one.union(two).repartition("family", "p", "q").sortWithinPartitions("family", "p", "q")
    return dealt.mapInArrow(compared, "a long, b long").where("a <> b")


def _trees(parts: list[pa.RecordBatch], num: int, den: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(parts).combine_chunks()
    cid, n, leader, side = (table.column(c).to_numpy() for c in ("cid", "n", "leader", "side"))
    items = table.column("items").chunk(0).flatten().to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    _, code, count = np.unique(items, return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1  # an element of one set alone is common to none
    shared = count[code] > 1
    row, code = row[shared], rank[code[shared]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    width = int(rank[-1]) + 1 if len(rank) else 0
    # Sets of one side only are compared where the block meets itself.
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    common = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, width, COLUMNS):
        a, b = np.searchsorted(code, (low, low + COLUMNS))
        matrix = np.zeros((len(n), min(COLUMNS, width - low)), np.float32)
        matrix[row[a:b], code[a:b] - low] = 1
        common += matrix[left] @ matrix[right].T
    near = common.astype(np.int64) * (num + den) >= num * (n[left][:, None] + n[right][None, :])
    near &= leader[left][:, None] != leader[right][None, :]
    label = np.arange(len(n))
    while True:  # the smallest row that links reach
        down = np.where(near, label[right][None, :], len(n)).min(1, initial=len(n))
        up = np.where(near, label[left][:, None], len(n)).min(0, initial=len(n))
        new = label.copy()
        np.minimum.at(new, left, down)
        np.minimum.at(new, right, up)
        if (new == label).all():
            break
        label = new
    return pa.RecordBatch.from_arrays([pa.array(cid), pa.array(cid[label])], ["a", "b"])


def similar_sets(docs: DataFrame, size: int = SIZE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``."""
    with session_settings(docs.sparkSession, SWEPT):
        signs = signatures(docs, size)
        joined = _components(docs, signs, size, num, den)
    classes = _classes(signs)
    named_groups = (
        classes.join(joined.withColumnRenamed("node", "cid"), "cid", "left")
        .where("members > 1 OR component IS NOT NULL")
        .select("cid", "rep", F.coalesce("component", "cid").alias("component"))
    )
    heads = named_groups.groupBy("component").agg(F.min("rep").alias("component_id"))
    answers = named_groups.join(heads, "component").select(
        "cid", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    ).dropDuplicates(["cid", "salt"])
    salted = signs.select(
        "doc_id", "n", F.when(F.col("n") > 0, F.col("cid")).alias("cid"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    return salted.join(answers, ["cid", "salt"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def _classes(signs: DataFrame) -> DataFrame:
    """Equal sets: (cid, check, n, rep, members)."""
    named = signs.where("n > 0 AND doc_id IS NOT NULL")
    return named.groupBy("cid", "check", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"))


def _components(docs: DataFrame, signs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(node, component) of all sets that are linked with another."""

    def linked(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("common") * (num + den) >= F.lit(num) * (F.col("na") + F.col("nb"))).select("a", "b")

    def ordered(rows: DataFrame) -> DataFrame:
        return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()

    def led(rows: DataFrame, groups: DataFrame) -> DataFrame:
        named = groups.select(F.col("node").alias("cid"), F.col("component").alias("leader"))
        return rows.join(named, "cid", "left").withColumn("leader", F.coalesce("leader", "cid"))

    lists = index_lists(docs, size, num, den)
    representatives = signs.join(_classes(signs).select("cid", F.col("rep").alias("doc_id")), ["cid", "doc_id"])
    listed = representatives.join(lists.select("cid").distinct(), "cid", "left_semi")
    sketches = stored(listed.select("cid", "doc_id", "n", "bits").dropDuplicates(["cid"]), "set-parities")

    # The same block keys come from either class group, so the pairs are few beside the entries.
    first = ordered(lists.where("other IS NOT NULL").select(F.col("other").alias("a"), F.col("cid").alias("b")))
    first = stored(possible(first, sketches, num, den), "first-pairs")

    # Lists whose members are not all united yet.
    placed = led(lists.select("key", "cid").distinct(), components(first))
    mixed = (
        placed.groupBy("key")
        .agg(F.min("leader").alias("low"), F.max("leader").alias("high"), F.count(F.lit(1)).alias("held"))
        .where("low < high AND held > 2")  # the two of a list of two were compared
        .select("key")
    )
    open_ = placed.join(mixed, "key").join(sketches.select("cid", "n", "bits"), "cid")
    second = stored(list_links(open_, num, den), "second-pairs")
    families = components(first.union(second)).select(F.col("node").alias("cid"), F.col("component").alias("family"))

    sets = elements_of(docs, sketches.join(families, "cid").select("cid", "doc_id"), size)
    links = stored(linked(overlaps(first, sets)), "first-links")
    members = stored(led(families, components(links)), "family-members")
    mixed = members.groupBy("family").agg(F.min("leader").alias("low"), F.max("leader").alias("high")).where("low < high")
    more = family_links(members.join(mixed.select("family"), "family").join(sets, "cid"), num, den)
    return components(links.union(stored(more, "family-links")))
