"""Manifests: against a plain tree, with many levels, pages and groups."""

import hashlib
import zlib

import pytest
from cases import clashing, empty, hard
from pyspark.sql import functions as F

from tallyframe.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, n_chars):
    values = [n_chars if c == "n_chars" else row[c] for c in FIELDS]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        yield (level[i ^ 1] if i ^ 1 < len(level) else None), i & 1
        i >>= 1


def plain(rows):
    groups = {}
    for r in rows:
        place = (r["doc_id"] is not None, r["doc_id"] or 0)
        groups.setdefault(r["lang"], []).append((place, leaf(r, r["n_chars"]), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:2])
        trees[g] = tree([x[1] for x in groups[g]])
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for place, g in enumerate(names):
        for i, (_, own, r) in enumerate(groups[g]):
            changed = r["n_chars"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            path = [*siblings(trees[g], i), *siblings(top, place)]
            h = leaf(r, r["n_chars"] + 1) if changed else own
            for other, left in path:
                h = digest(other, h) if left and other else digest(h, other or "")
            root = top[-1][0]
            out.append((r["doc_id"], own, trees[g][-1][0], root, digest(*(s for s, _ in path if s)), h, h == root))
    return sorted(out, key=str)


def found(docs):
    out = merkle.document_proofs(docs).withColumn("proof", F.sha2(F.lower(F.hex("proof")), 256))
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_hard_rows(spark):
    docs = hard(spark)
    assert found(clashing(docs)) == plain(docs.collect())
    assert found(empty(spark)) == []


@pytest.mark.parametrize("case", ["one row", "one group", "null group only", "a row each"])
def test_small_tables(spark, case):
    docs = hard(spark)
    docs = {
        "one row": docs.filter("doc_id = 1"), "one group": docs.filter("lang = 'en'"), "null group only": docs.filter("lang is null"),
        "a row each": docs.filter("doc_id < 10").withColumn("lang", F.concat(F.lit("l"), "doc_id")),
    }[case]
    assert found(docs) == plain(docs.collect())


def test_many_levels(spark, folder, monkeypatch):
    """Tiles of four: several steps, rows stored for many pages, and three steps over the groups."""
    monkeypatch.setattr(merkle, "STRIDE", 2)
    monkeypatch.setattr(merkle, "_TILE", 4)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert found(docs) == plain(docs.collect())
    groups = docs.withColumn("lang", F.when(F.col("doc_id") > 20, F.concat("lang", (F.col("doc_id") % 30).cast("string"))))
    assert found(groups) == plain(groups.collect())


def test_one_large_group_of_copies(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "'same' as text", "'en' as lang", "'s' as source", "4L as n_chars")
    assert found(docs) == plain(docs.collect())
    same = docs.withColumn("doc_id", F.lit(3).cast("long"))
    assert found(same) == plain(same.collect())


def test_session_setting_stays(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "12345")
    try:
        found(hard(spark))
        assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "12345"
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
