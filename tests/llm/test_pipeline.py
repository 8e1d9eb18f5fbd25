"""Each stage of the pipeline against a plain version on its own input."""

import re

import corpus_pipeline
import pytest
from test_dedup import classes
from test_native import leaks
from pyspark.sql import functions as F

from tallyframe.llm import mixing, nbsvm, sharding
from tallyframe.session import scratch_path

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark, folder):
    docs = [spark.read.parquet(f"{folder}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "steps")
        stage(spark, docs[-1], folder).write.parquet(path)
        docs.append(spark.read.parquet(path))
    return docs


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns(steps):
    for df in steps[:-1]:
        assert df.columns == DOCUMENTS
    assert steps[-1].columns == [*DOCUMENTS, "shard", "shard_depth", "shard_bytes"]


def test_quality(spark, steps, folder):
    model = nbsvm.fit(steps[0], spark.read.parquet(f"{folder}/labels.parquet"), "quality", F.lit(True))
    table = steps[0].toArrow()
    scores = nbsvm.sigmoid(model.slope * model.margins(table.column("text")) + model.shift)
    want = {i for i, s in zip(table.column("doc_id").to_pylist(), scores) if s >= 0.7}
    assert {i for i, _ in texts(steps[1])} == want and len(texts(steps[1])) == len(want)


def test_near_duplicates(steps):
    want = {w[0] for w in classes(texts(steps[1])) if w[3]}
    assert sorted(i for i, _ in texts(steps[2])) == sorted(want)


def test_leaks(spark, steps, folder):
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    want = [p[0] for p in leaks(texts(steps[2]), items) if not p[2]]
    assert sorted(i for i, _ in texts(steps[3])) == sorted(want)


def test_mix(steps):
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.words_taken(steps[3]).collect()}
    got = {}
    for i, t in texts(steps[4]):
        got[i] = got.get(i, 0) + len(BLANK.findall(t))
    assert got == {i: n for i, (_, n) in taken.items() if n}
    total = sum(size for size, _ in taken.values())
    assert abs(sum(got.values()) - 1.5 * total) <= 20


def test_shards(steps):
    assert sorted(map(str, steps[5].select(*DOCUMENTS).collect())) == sorted(map(str, steps[4].collect()))
    got = steps[5].groupBy("shard").agg(F.sum(F.octet_length("text")).alias("n"), F.max("shard_bytes").alias("told")).collect()
    assert all(r["n"] == r["told"] <= sharding.LIMIT for r in got)


def test_run(spark, folder, steps):
    assert corpus_pipeline.run(spark, folder).count() == steps[-1].count()
