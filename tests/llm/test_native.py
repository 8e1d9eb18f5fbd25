"""Mixing, sharding and decontamination: plain versions, SQL and hard cases."""

import re
from collections import Counter

import duckdb
import pytest
from cases import clashing, empty, hard, prose, rows
from pyspark.sql import functions as F

from tallyframe.llm import decontaminate, mixing, queries, sharding

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def count(text):
    return len(BLANK.findall(text or ""))


def duck(documents, sql, benchmark=None):
    con = duckdb.connect()
    con.register("documents_", documents.toArrow())
    con.execute("create view documents as select * from documents_")
    if benchmark is not None:
        con.register("benchmark_", benchmark.toArrow())
        con.execute("create view benchmark as select * from benchmark_")
    return sorted((tuple(r) for r in con.execute(sql).fetchall()), key=str)


@pytest.mark.parametrize("block", [7, 100, 8192])
def test_mix_meets_its_targets(spark, block):
    docs = hard(spark)
    got = mixing.words_taken(docs, block).collect()
    assert len(got) == docs.count()
    by_source = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_source.setdefault(r["source"], []).append(r)
    for mine in by_source.values():
        target = mine[0]["target"]
        assert mine[0]["source_size"] == sum(r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target) <= 0.5
    assert rows(mixing.words_taken(docs, block)) == rows(mixing.words_taken(docs.repartition(5), block))


def test_mix_is_the_sql_on_hard_rows(spark):
    docs = hard(spark)
    assert rows(mixing.words_taken(docs)) == duck(docs, queries.SQL["op1_mixing"])
    many = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', int(id % 300)) as text", "concat('s', id % 5) as source")
    assert rows(mixing.words_taken(many)) == duck(many, queries.SQL["op1_mixing"])


def test_mixed_documents_come_in_slot_order(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "repeat('w ', 50) as text", "concat('s', id % 3) as source")
    first = {r["doc_id"]: r["first_slot"] for r in mixing.words_taken(docs, 100).collect()}
    seen = {}
    for at, r in enumerate(mixing.mixed_documents(docs, 100).collect()):
        seen.setdefault(r["doc_id"], at)
    assert len(seen) > 1000 and set(seen) == {d for d, s in first.items() if s is not None}
    order = [first[d] for d in sorted(seen, key=seen.get)]
    assert order == sorted(order)


def test_mix_spreads_sources_over_the_slots(spark):
    docs = spark.range(3000).selectExpr(
        "id as doc_id", "repeat('w ', 10) as text", "if(id < 1000, 'big', concat('s', id % 7)) as source"
    )
    slots = mixing.mix(docs, 100).filter("source = 'big' and taken > 0").select("slot").distinct()
    total = mixing.mix(docs, 100).select("slot").filter("slot is not null").distinct().count()
    at = sorted(r[0] for r in slots.collect())
    share = len(at) / total
    for part in range(1, 10):
        inside = sum(x < total * part / 10 for x in at)
        assert abs(inside - share * total * part / 10) < 4


def test_mixed_documents_hold_the_words_taken(spark):
    docs = hard(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    taken = {r["source"]: r["n"] for r in mixing.words_taken(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    got = Counter()
    for r in out.collect():
        got[r["source"]] += count(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert {k: v for k, v in taken.items() if v} == dict(got)
    more = mixing.mixed_documents(clashing(docs))
    assert more.columns == clashing(docs).columns and more.count() == out.count()
    assert mixing.words_taken(empty(spark)).count() == mixing.mixed_documents(empty(spark)).count() == 0


def test_many_equal_rows_are_mixed(spark):
    docs = spark.range(5000).selectExpr("1L as doc_id", "'a b c' as text", "'s' as source")
    r = mixing.words_taken(docs, 64).agg(F.count("*"), F.sum("taken")).first()
    assert tuple(r) == (5000, 22500)
    assert mixing.mixed_documents(docs, 64).count() in (7500, 7501)


@pytest.mark.parametrize("limit", [3000, 20000, 1 << 30])
def test_shards_are_the_sql(spark, limit):
    docs = spark.createDataFrame([(i, prose(i, i % 97)) for i in range(400)], "doc_id long, text string")
    got = sharding.shard_table(docs, limit)
    assert rows(got.select("doc_id", "bytes", "shard", "depth", "shard_bytes")) == duck(docs, queries.shard_sql(limit))


def test_shards_of_hard_rows_keep_all_and_fit(spark):
    for docs in (hard(spark), clashing(hard(spark))):
        out = sharding.sharded(docs, 1500)
        kept = [c for c in docs.columns if c != "shard"]
        assert rows(out.select(*kept)) == rows(docs.select(*kept))
        sizes = Counter()
        members = Counter()
        told = {}
        for r in out.collect():
            sizes[r["shard"]] += len((r["text"] or "").encode())
            members[r["shard"]] += 1
            told[r["shard"]] = r["shard_bytes"]
        assert told == dict(sizes)
        assert all(size <= 1500 or members[s] == 1 for s, size in sizes.items())
    assert sharding.sharded(empty(spark)).count() == sharding.shard_table(empty(spark)).count() == 0


def test_shards_keep_rows_that_differ_by_the_place_of_a_null(spark):
    docs = spark.createDataFrame([(1, "abc", None, {"a": 1}), (1, None, "abc", {"a": 1}), (1, None, "abc", {"a": 2})],
                                 "doc_id long, text string, note string, kinds map<string, int>")
    for limit in (2, 1000):
        assert sharding.shard_table(docs, limit).count() == 3
        out = sharding.sharded(docs, limit).select("text", "note", F.to_json("kinds"))
        assert rows(out) == rows(docs.select("text", "note", F.to_json("kinds")))


def test_equal_rows_are_paged(spark):
    docs = spark.range(1000).selectExpr("7L as doc_id", "repeat('x', 10) as text")
    got = sharding.sharded(docs, 95).groupBy("shard").agg(F.count("*").alias("n"), F.first("shard_bytes").alias("b"))
    assert Counter((r["n"], r["b"]) for r in got.collect()) == {(9, 90): 111, (1, 10): 1}


def bench(spark):
    items = [
        (1, " ".join(prose(1, 120).split(" ")[20:45])), (2, "one two three"), (3, None), (4, ""), (5, "ONE two, three"),
        (6, prose(99, 40)), (2, "naïve é"), (None, "É naïve"), (8, "word word word word word word word word word word word"),
    ]
    return spark.createDataFrame(items, "item_id long, text string")


def leaks(docs, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - n + 1, 1) if w else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i : i + k])) in grams:
                    hit |= set(range(i, i + k))
                    found |= grams[g]
        out.append((doc_id, len(w), len(hit), found - {None}))
    return out


def test_leaks_are_those_of_a_plain_search(spark):
    import hashlib

    docs, items = hard(spark), bench(spark)
    plain = leaks([(r[0], r[1]) for r in docs.collect()], [tuple(r) for r in items.collect()])
    want = [
        (i, n, hit, len(f), hashlib.sha256(",".join(sorted(map(str, f))).encode()).hexdigest(), hit > 0)
        for i, n, hit, f in plain
    ]
    assert rows(decontaminate.report(docs, items)) == sorted(want, key=str)
    assert rows(decontaminate.report(clashing(docs), items)) == sorted(want, key=str)
    assert sum(w[5] for w in want) > 5


def test_decontaminated(spark):
    docs, items = clashing(hard(spark)), bench(spark)
    plain = leaks([(r[0], r[1]) for r in docs.collect()], [tuple(r) for r in items.collect()])
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(p[0]) for p in plain if not p[2])
    cut = decontaminate.decontaminated(docs, items, remove="spans")
    assert cut.columns == docs.columns and cut.count() == docs.count()
    left = {str(p[0]): p[1] - p[2] for p in plain}
    for r in cut.collect():
        assert leaks([(1, r["text"])], [])[0][1] == left[str(r["doc_id"])]
    same = {r["doc_id"]: r["text"] for r in cut.collect() if left[str(r["doc_id"])] == dict((str(p[0]), p[1]) for p in plain)[str(r["doc_id"])]}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(before[k] == v for k, v in same.items())


def test_no_items_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["contaminated"] for r in decontaminate.report(hard(spark), none).collect()} == {False}
    assert decontaminate.report(empty(spark), bench(spark)).count() == 0
    assert decontaminate.decontaminated(hard(spark), none).count() == hard(spark).count()


def test_shuffled_windows_give_the_same(spark, monkeypatch):
    want = rows(decontaminate.report(hard(spark), bench(spark)))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert rows(decontaminate.report(hard(spark), bench(spark))) == want


def test_native_plans_have_no_python(spark, folder):
    for name in ("op1_mixing", "op3_sharding", "op7_decontamination"):
        plan = queries.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan), name


def test_mixed_copies_keep_their_own_columns(spark):
    rows = [(1, "a b c d", "en", "s", None, "x", {"k": 1}), (1, "a b c d", "de", "s", None, "x", {"k": 1}),
            (1, "a b c d", None, "s", None, "x", {"k": 1}), (1, "a b c d", "x", "s", None, None, {"k": 1}),
            (1, "a b c d", "x", "s", None, None, {"k": 2}), (1, "a b c d", "x", "s", None, None, {"k": 2})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string, m map<string,int>")
    got = mixing.mixed_documents(docs, share=2.0, most=2).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in docs.collect() for _ in range(2))
