"""Near-duplicates and repeated passages against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from cases import clashing, empty, hard, prose, rows

from tallyframe.llm import debruijn, lsh_forest
from tallyframe.llm.components import components

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in BLANK.findall(text or "")]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def classes(docs):
    """{doc_id: (size, class)} of (doc_id, text) pairs; rows of one id are one document."""
    sets = [(i, shingle_set(t)) for i, t in docs if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a < b and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(shingle_set(t)), None if i is None else find(i), i is None or find(i) == i) for i, t in docs), key=str)


def copies(spark, n=60):
    rng = random.Random(5)
    out = []
    for base in range(6):
        words = prose(base + 50, 150).split(" ")
        for _ in range(n // 6):
            w = list(words)
            for _ in range(rng.randrange(9)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(999)}"
            out.append((len(out), " ".join(w)))
    return spark.createDataFrame(out, "doc_id long, text string")


@pytest.mark.parametrize("block", [2_000_000, 300])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(lsh_forest, "BLOCK", block)  # small: a cluster in many blocks
    for docs in (copies(spark), hard(spark)):
        want = classes([(r["doc_id"], r["text"]) for r in docs.collect()])
        assert rows(lsh_forest.classes(docs)) == want
    assert sum(not w[3] for w in classes([(r["doc_id"], r["text"]) for r in copies(spark).collect()])) > 10


def test_members_by_shuffle_give_the_same(spark, monkeypatch):
    want = rows(lsh_forest.classes(copies(spark)))
    monkeypatch.setattr(lsh_forest, "BROADCAST_IDS", 0)
    assert rows(lsh_forest.classes(copies(spark))) == want


def test_one_of_each_class_stays(spark):
    docs = clashing(hard(spark))
    kept = lsh_forest.deduplicated(docs)
    assert kept.columns == docs.columns
    want = [w for w in classes([(r["doc_id"], r["text"]) for r in docs.collect()]) if w[3]]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(w[0]) for w in want)
    assert lsh_forest.classes(empty(spark)).count() == lsh_forest.deduplicated(empty(spark)).count() == 0


def test_forest_edges_across_blocks_only():
    import numpy as np

    sets = [np.arange(20, dtype=np.uint64), np.arange(20, dtype=np.uint64), np.arange(1, 21, dtype=np.uint64)]
    assert lsh_forest.forest_edges(sets) == [(0, 1), (0, 2)]
    assert {b for _, b in lsh_forest.forest_edges(sets, 2)} == {2}


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("compared", [1, 64])
def test_forest_edges_join_what_links_join(monkeypatch, seed, compared):
    """Groups of near copies, families with much in common, and tiny sets, against all pairs."""
    import numpy as np

    monkeypatch.setattr(lsh_forest, "COMPARED", compared)
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(60):
        base = np.arange(rng.integers(1, 60)) + 100 * rng.integers(0, 3)
        own = rng.integers(1000, 1100, rng.integers(0, max(len(base) // 2, 1)))
        sets.append(np.unique(np.concatenate([base, own])).astype(np.uint64))
    left = seed * 5
    linked = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))

    def parts(edges):
        root = list(range(len(sets)))
        for a, b in edges:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    for cut in (None, left):
        pairs = [(a, b) for b in range(len(sets)) for a in range(b) if (cut is None or a < cut <= b) and linked(sets[a], sets[b])]
        got = lsh_forest.forest_edges(sets, cut)
        assert set(got) <= set(pairs) and parts(got) == parts(pairs)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(120)], [(0, i) for i in range(1, 80)] + [(90, 91)]])
def test_components(spark, edges):
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == root


def without(docs, width=20):
    """(doc_id, words, removed, digest); ids sort as given, null last, one row per id and text."""
    order = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0))
    words = [BLANK.findall(t or "") for _, t in order]
    seen, gone = set(), [set() for _ in order]
    for d, w in enumerate(words):
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            if g in seen:
                gone[d] |= set(range(i, i + width))
            seen.add(g)
    result = {}
    for d, w in enumerate(words):
        kept = " ".join(x for i, x in enumerate(w) if i not in gone[d])
        result[order[d]] = (order[d][0], len(w), len(gone[d]), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return [result[d] for d in docs]


def passages(spark):
    rng = random.Random(8)
    shared = [prose(900 + i, 70) for i in range(4)]
    out = []
    for i in range(120):
        parts = [prose(i, rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(shared).split(" ")
            a = rng.randrange(40)
            parts += [" ".join(p[a : a + rng.randrange(10, 70)]), prose(i * 7 + len(parts), rng.randrange(30))]
        out.append((rng.randrange(10**6), " ".join(parts)))
    out.append((5 * 10**6, "a b " * 200))
    out.append((6 * 10**6, "a b " * 15 + "c"))
    return spark.createDataFrame(out, "doc_id long, text string")


@pytest.mark.parametrize("fan", [64, 1])
def test_repeats_are_those_of_a_plain_search(spark, monkeypatch, fan):
    monkeypatch.setattr(debruijn, "FAN", fan)
    for docs in (passages(spark).repartition(7), hard(spark), clashing(hard(spark))):
        want = without([(r["doc_id"], r["text"]) for r in docs.collect()])
        assert rows(debruijn.report(docs)) == sorted((w[:4] for w in want), key=str)
    cut = debruijn.without_repeats(hard(spark))
    assert rows(cut) == sorted(((w[0], w[4]) for w in without([(r["doc_id"], r["text"]) for r in hard(spark).collect()])), key=str)
    assert debruijn.report(empty(spark)).count() == 0


def test_many_texts_of_one_id(spark):
    """Each text loses its own words only, whether the id is null or shared."""
    common = " ".join(f"c{i}" for i in range(25))
    docs = spark.range(20_000).selectExpr("case when id % 2 = 0 then 7L end as doc_id", f"concat('{common} own', id, ' words') as text")
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in debruijn.report(docs).collect())
    assert got == {(7, 27, 25): 9_999, (7, 27, 0): 1, (None, 27, 25): 10_000}


def test_long_groups_are_streamed():
    """Rows of one node that arrive in many batches are judged as if in one."""
    import numpy as np
    import pyarrow as pa

    n = 3000
    edge = np.sort(np.random.default_rng(3).integers(0, 40, n))
    ids = np.arange(n)
    batch = debruijn._batch(np.zeros(n, np.int64), edge, ids, ids * 0, ids * 256, np.zeros(n, np.int32))
    whole = pa.Table.from_batches(debruijn._branches(iter([batch])))
    parts = pa.Table.from_batches(debruijn._branches(iter([batch.slice(i, 100) for i in range(0, n, 100)])))
    assert whole.equals(parts)
    assert (np.asarray(whole.column("kind")) == 2).sum() == len(set(edge.tolist()))


@pytest.mark.parametrize("blanks", [[None, ""], ["", " \n", None, None]])
def test_blank_rows_that_share_the_id_of_a_cluster(spark, blanks):
    base = " ".join(f"word{i}" for i in range(80))
    texts = [(1, base), (2, base + " more")] + [(i, b) for b in blanks for i in (1, 2)]
    got = lsh_forest.classes(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(1, 1, True), (2, 1, False)}


def test_neighbours_meet_over_partition_bounds(spark):
    key, low = b"\1" * 16, b"\2" * lsh_forest._HASHES
    rows = [(0, key, i, low) for i in range(12)] + [(1, key, i, low) for i in range(20, 22)]
    ordered = spark.createDataFrame(rows, "tree int, key binary, id long, low binary").repartitionByRange(6, "tree", "id")
    got = {tuple(r) for r in lsh_forest._near(ordered.sortWithinPartitions("tree", "key", "id")).collect()}
    want = {(a, b) for a in range(12) for b in range(a + 1, min(a + lsh_forest.NEIGHBOURS, 11) + 1)} | {(20, 21)}
    assert want <= got
