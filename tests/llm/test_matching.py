"""Decontamination, set join and vector join against brute force."""

import collections
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from chapterloom.llm import decontam, jaccard, neardup
from chapterloom.llm.graph import components
from chapterloom.llm.trees import fit, log_odds

from .helpers import DOCS, alnum_words, no_docs, odd_docs, odd_rows, prose, visible_words

ITEMS = "item_id long, text string, doc_id string"


def _smallest(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_contamination_is_that_of_all_windows(spark):
    rows = odd_rows()
    item = " ".join(prose("en", 40, 1).split())
    hidden = prose("fr", 9, 5) + " " + item + " " + item.upper() + "!"
    rows += [(200, hidden, "en", "s", "c", "7", "c", None), (200, "other " + item, "en", "s", "c", "7", "c", None)]
    rows += [(201, item[: len(item) // 4], "en", "s", "c", "7", "c", None), (202, "tiny, ITEM", None, "s", "c", "7", "c", None)]
    items = [(1, item, "x"), (2, item, "x"), (3, "Tiny item", "x"), (4, None, "x"), (5, "-- .", "x"), (None, rows[0][1], "x"), (6, rows[2][1], "x")]
    docs = spark.createDataFrame(rows, DOCS)
    found, matches = decontam.contamination(docs, spark.createDataFrame(items, ITEMS))
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r.item_ids))) for r in found.collect())
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        words, hit, names = alnum_words(text), set(), set()
        for item_id, test, _ in items:
            test = alnum_words(test)
            for low in range(max(1, len(test) - 9) if test else 0):
                window = test[low : low + 10]
                for i in range(len(words) - len(window) + 1):
                    if words[i : i + len(window)] == window:
                        hit.update(range(i, i + len(window)))
                        names |= {item_id} - {None}
        want[doc_id, len(words), len(hit), tuple(sorted(names))] += 1
    assert got == want
    assert {r.kind for r in matches.collect()} == {"phrase"}


def test_proximity_takes_what_the_slop_allows(spark):
    test = "alpha bravo carol delta early fancy giant happy indie jolly"
    near = test.replace("delta early", "delta so early").replace("giant", "giant oh")
    far = test.replace("early", "early one two three four five six seven")
    docs = spark.createDataFrame([(1, test), (2, near), (3, far), (4, "jolly giant")], "doc_id long, text string")
    _, found = decontam.contamination(docs, spark.createDataFrame([(1, test)], "item_id long, text string"), slop=2)
    assert sorted((r.doc_id, r.kind) for r in found.collect()) == [(1, "phrase"), (2, "proximity")]


def test_empty_tables_match_nothing(spark):
    none = spark.createDataFrame([], ITEMS)
    found, _ = decontam.contamination(odd_docs(spark), none)
    assert found.count() == len(odd_rows()) and found.where("n_hit > 0").count() == 0
    assert decontam.contamination(no_docs(spark), none)[0].count() == 0
    assert jaccard.similar_sets(no_docs(spark)).count() == 0


def _family(seed, copies, words, edits):
    rng = random.Random(seed)
    base = prose("en", words, seed).split()
    for _ in range(copies):
        text = base[:]
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
        yield " ".join(text)


def _sets(rows, size):
    out = []
    for doc_id, text, *_ in rows:
        words = visible_words(text)
        grams = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())
        out.append((doc_id, frozenset(grams)))
    return out


def _expected(rows, size, num):
    sets = [(i, s) for i, s in _sets(rows, size) if s and i is not None]
    links = [
        (a, b)
        for k, (a, s) in enumerate(sets)
        for b, t in sets[:k]
        if 100 * len(s & t) >= num * len(s | t)
    ]
    return _smallest({i for i, *_ in rows if i is not None}, links)


def test_components_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rows = odd_rows()
    at = 1000
    for seed, copies, words, edits in ((1, 60, 90, 3), (2, 40, 300, 9), (3, 25, 14, 1), (4, 20, 5, 1), (5, 30, 60, 2)):
        for text in _family(seed, copies, words, edits):
            rows.append((at, text, "en", "s", "c", "7", "c", None))
            at += 1
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    for size, num in ((3, 90), (5, 80)):
        want = _expected(rows, size, num)
        sizes = collections.Counter((i, len(s)) for i, s in _sets(rows, size))
        got = jaccard.similar_sets(docs, size, num, 100).collect()
        assert collections.Counter((r.doc_id, r.n_shingles) for r in got) == sizes
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        assert all(r.component_id is None for r in got if r.doc_id is None)


def test_blocks_of_a_family_find_what_stars_leave_open(spark):
    """Members linked only to one another, with a head that links to none."""
    rows, links = [], []
    for i in range(40):
        items = sorted({j for j in range(100)} - {(i * 5 + k) % 100 for k in range(3)} | {1000 + i})
        rows.append((0, i, i, len(items), items))
    for a in range(40):
        for b in range(a):
            s, t = set(rows[a][4]), set(rows[b][4])
            if 100 * len(s & t) >= 95 * len(s | t):
                links.append((a, b))
    members = spark.createDataFrame(rows, "family long, leader long, cid long, n long, items array<long>")
    got = jaccard.family_links(members, 95, 100).collect()
    assert _smallest(range(40), [(r.a, r.b) for r in got]) == _smallest(range(40), links) and links


def test_parities_never_part_similar_sets():
    rng = np.random.default_rng(5)
    sets = []
    for n in (0, 1, 5, 63, 64, 65, 300, 900, 1100, 70_000, 140_000):
        base = rng.integers(1 << 63, size=n, dtype=np.uint64)
        sets += [np.unique(base), np.unique(base[n // 12 :]), np.unique(np.append(base[n // 20 :], rng.integers(1 << 63, size=n // 20, dtype=np.uint64)))]
    bits = jaccard.Parities(pa.array([jaccard.parities(s) for s in sets], pa.binary()))
    i, j = (x.ravel() for x in np.mgrid[: len(sets), : len(sets)])
    found = bits.differing(i, j)
    apart = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    assert (found <= apart).all() and (found[i == j] == 0).all()
    n = np.array([len(s) for s in sets])
    kept = jaccard._may_link(found, n[i] + n[j], 80, 100)
    unlike = (n[i] > 50) & (n[j] < 60_000) & (n[j] <= n[i]) & (n[j] * 100 >= n[i] * 80) & (i // 3 != j // 3)
    assert unlike.any() and not kept[unlike].any()


def test_sets_that_only_share_lists_are_not_read(spark, monkeypatch):
    """A passage in all documents puts them on common lists; before, that made one family, compared by pairs of blocks."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=9))
    passage = " ".join(word() for _ in range(300))
    rows = [(i, f"{passage} {' '.join(word() for _ in range(200))}") for i in range(60)]
    rows.append((99, rows[7][1] + " end"))
    read = []
    whole = jaccard.elements_of
    monkeypatch.setattr(jaccard, "elements_of", lambda docs, wanted, size: read.append(wanted.count()) or whole(docs, wanted, size))
    monkeypatch.setattr(jaccard, "MEETING", 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard.similar_sets(docs, 5, 80, 100).collect()}
    assert got == {i: 7 if i == 99 else i for i, _ in rows} and read == [2]


def test_shuffle_files_of_a_set_join_go_with_its_steps(spark, monkeypatch):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen = spark.conf.get(name, None), []
    whole = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, at: seen.append(spark.conf.get(name)) or whole(df, at))
    jaccard.similar_sets(odd_docs(spark)).collect()
    assert set(seen) == {"true"} and spark.conf.get(name, None) == before


def test_long_lists_meet_in_blocks(spark, monkeypatch):
    """Links between members of one list, also where its blocks are small."""
    monkeypatch.setattr(jaccard, "MEETING", 4)
    monkeypatch.setattr(jaccard, "PAIRS", 5)
    rng = np.random.default_rng(6)
    rows, groups = [], {}
    for g in range(9):
        base = rng.integers(1 << 62, size=100, dtype=np.uint64)
        for k in range(5):
            cid = 10 * g + k
            s = np.unique(np.append(base[k:], rng.integers(1 << 62, size=k, dtype=np.uint64)))
            rows.append((1, cid, cid, len(s), bytearray(jaccard.parities(s))))
            groups[cid] = g
    lists = spark.createDataFrame(rows, "key long, leader long, cid long, n long, bits binary")
    got = [(r.a, r.b) for r in jaccard.list_links(lists, 85, 100).collect()]
    assert all(groups[a] == groups[b] for a, b in got)
    assert _smallest(set(groups), got) == {c: 10 * g for c, g in groups.items()}


def test_star_contraction(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + k) for k in range(1, 80)]
    links += [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)] + [(7, 7)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == _smallest(nodes, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_need_few_jobs(spark):
    """The driver holds plans, jobs and stages, so a small graph must not take many."""
    links = [(100 * i, 100 * i + k) for i in range(50) for k in range(1, 9)] + [(i, i + 1) for i in range(5000, 5040)]
    frame = spark.createDataFrame(links, "a long, b long").repartition(4)
    spark.sparkContext.setJobGroup("few-jobs", "components")
    try:
        got = components(frame)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) <= 10
    assert {r.node: r.component for r in got.collect()} == _smallest({n for x in links for n in x}, links)


def test_components_of_links_that_no_task_holds_together(spark, monkeypatch):
    from chapterloom.llm import graph

    rounds = []
    nodes = graph._nodes
    monkeypatch.setattr(graph, "_nodes", lambda edges: rounds.append(1) or nodes(edges))
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        monkeypatch.setattr(graph, "UNITED", 1)
        rng = random.Random(3)
        links = [(i + 1, i) for i in range(60)] + [(200, 200 + k) for k in range(1, 70)]
        links += [(rng.randint(500, 560), rng.randint(500, 560)) for _ in range(70)] + [(None, 3), (3, None), (9, 9)]
        rng.shuffle(links)
        got = components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()
    finally:
        spark.conf.unset(name)
    real = [x for x in links if None not in x and x[0] != x[1]]
    assert len(got) == len({r.node for r in got}) and len(rounds) > 2
    assert {r.node: r.component for r in got} == _smallest({n for x in real for n in x}, real)


def test_components_of_few_links_need_few_jobs_however_many_tasks_shuffles_have(spark):
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = spark.conf.get(names[1])
    rng = random.Random(5)
    links = [(i + 1, i) for i in range(200)] + [(500, 500 + k) for k in range(1, 200)]
    links += [(rng.randint(900, 1100), rng.randint(900, 1100)) for _ in range(200)]
    rng.shuffle(links)
    frame = spark.createDataFrame(links, "a long, b long").repartition(5)
    spark.conf.set(names[0], "false")
    spark.conf.set(names[1], "40")
    spark.sparkContext.setJobGroup("many-tasks", "components")
    try:
        got = components(frame).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset(names[0])
        spark.conf.set(names[1], before)
    real = [x for x in links if x[0] != x[1]]
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == _smallest({n for x in real for n in x}, real)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("many-tasks")) <= 8


def test_trees_that_share_a_leaf_meet(spark, monkeypatch):
    from chapterloom.llm import graph

    monkeypatch.setattr(graph, "UNITED", 4)
    trees = spark.createDataFrame([(100 + k, k) for k in range(6)] + [(100 + k, 10 + k) for k in range(6)], "a long, b long")
    got = graph._contracted(trees.repartition(6, "b"), 3).collect()
    assert {(10 + k, k) for k in range(6)} <= {(r.a, r.b) for r in got}


VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()), T.StructField("cid", T.StringType()), T.StructField("print", T.StringType()),
    ]
)


def test_vector_links_reach_the_recall_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 32)
    rng = np.random.default_rng(1)
    rows, at = [], 10
    for label in (0, 1):
        for center in rng.standard_normal((12, 16)):
            spread = rng.choice([0.02, 0.06, 0.12])
            for _ in range(int(rng.choice([1, 2, 5, 70]))):
                rows.append((at, [float(v) for v in (center + spread * rng.standard_normal(16)).astype("f4")], label))
                at += 1
    rows += [(at + 1, rows[0][1], rows[0][2]), (at + 2, rows[0][1], None), (at + 3, [v * 2 for v in rows[0][1]], rows[0][2])]
    odd = [(1, None, 0), (2, [], 0), (3, [0.0] * 16, 0), (4, [float("nan")] * 16, 0), (5, [float("inf")] + [1.0] * 15, 0), (6, [None] + [1.0] * 15, 0), (7, rows[0][1][:8], rows[0][2])]
    every = rows + odd
    got = {r.vec_id: r for r in neardup.near_duplicates(spark.createDataFrame([(*r, "c", "p") for r in every], VECTORS)).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    same = np.array([[a[2] is not None and a[2] == b[2] for b in rows] for a in rows])
    near = (x @ x.T >= 0.98) & same & ~np.eye(len(rows), dtype=bool)
    counts = near.sum(1)
    assert sum(got[r[0]].n_links for r in rows) >= 0.9 * counts.sum()
    assert all(got[r[0]].n_links <= n for r, n in zip(rows, counts))
    want = _smallest([r[0] for r in rows], [(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(near))])
    assert sum(got[k].component_id != v for k, v in want.items()) <= 0.1 * len(rows)
    assert all(got[r[0]].n_links == 0 and got[r[0]].component_id == r[0] and got[r[0]].kept for r in odd)
    assert neardup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_vector_links_inside_a_dense_cluster_are_found(spark):
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    n, pairs, dim = 16_000, 300, 64
    center = unit(rng.standard_normal(dim))
    dense = unit(np.sqrt(0.9) * center + np.sqrt(0.1) * unit(rng.standard_normal((n, dim))))
    first = dense[:pairs]
    aside = rng.standard_normal((pairs, dim))
    aside = unit(aside - (aside * first).sum(1, keepdims=True) * first)
    second = 0.982 * first + np.sqrt(1 - 0.982**2) * aside
    x = np.vstack([dense, second, unit(rng.standard_normal((n // 4, dim)))])
    rows = [(i, v, 0, "c", "p") for i, v in enumerate(x.tolist())]
    got = {r.vec_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert len(got) == len(rows)
    assert sum(got[n + i] == got[i] for i in range(pairs)) >= 0.98 * pairs


def test_boosted_trees_learn_a_rule():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = fit(x[:2000], y[:2000])
    assert ((log_odds(model, x[2000:]) > 0) == y[2000:]).mean() > 0.97
