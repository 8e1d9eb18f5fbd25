"""URL rules in a sorted digest array.

A rule is a host, a path and a verdict.  It fits a url of its host or of a
subdomain whose path starts with the rule's.  Of the rules that fit, the longest
(host and path) wins, then the one of the longer host.  Rules that are given more
than once are one rule; block wins over allow.

Method.  The index is two arrays of 64-bit xxhash keys, sorted: the hosts that have
rules, and the rules (host and path).  Beside the keys lie the full strings, and
for each host the path lengths of its rules.  Tasks memory-map the files, so that a
look-up touches only the pages that its binary search meets, and tasks of a machine
share them.  A batch of urls is probed as a whole: the suffixes of its distinct
hosts in the first array, then, for hosts that are found, the path prefixes of the
lengths that this host has, in the second.  Every hit is compared with the stored
string, and all entries of equal keys are, so collisions change nothing.

The index is built by Spark: keys are range-partitioned and sorted, each task
writes one segment, and a segment is found by its first key.  Only the first keys
(one of each segment) pass the driver.  Files lie in the shared folder; tasks of
another attempt write files of their own, and only those of finished tasks are
named in the index.  A folder that machines can't map (no mounted path) is fetched
by each executor through Spark's own file distribution.

Urls: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
end, A-Z lower-cased, the path what follows up to ``?``, ``#`` or the end.  A null
url, or one without ``://``, has neither and fits no rule; it is allowed, as are
all urls that no rule fits.  Very long hosts and paths cost no more than the
lengths that rules have.  An empty rule host fits nothing; rules with a null host or
verdict are left out, a null path is an empty one.  Repeated rows are judged each;
other columns are kept.  An empty table gives no rows, no rules allow everything.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.native import free_name, staged
from tallyframe.session import scratch_path

SEED = 42  # that of Spark's xxhash64, which keys the rules when the index is built
SEGMENT_ROWS = 4_000_000
_COLUMNS = ("key", "end", "verdict", "host_size", "text", "sizes_end", "sizes")


def host(url: Column) -> Column:
    """Host of a url; empty if there is none."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """Path of a url; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Index:
    """Where the segments are: folder, and for hosts and rules (first key, name) in order."""

    folder: str
    mounted: bool
    hosts: tuple[tuple[int, str], ...]
    rules: tuple[tuple[int, str], ...]


def _keyed(texts: Iterable[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(t, SEED) for t in texts], np.uint64).view(np.int64)


def _write_segments(folder: str, label: str):
    """Writer of sorted rows (key, text, verdict, host_size, sizes): one segment for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"{label}-{uuid.uuid4().hex}"
        out, end, sizes_end, first = {}, 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            if first is None:
                first = col["key"][0].as_py()
                out = {c: fs.open_output_stream(f"{root}/{name}.{c}", compression=None) for c in _COLUMNS}
            texts = col["text"].to_pylist()
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64) + end
            lists = col["sizes"].to_pylist()
            sizes_ends = np.cumsum([len(s) for s in lists], dtype=np.int64) + sizes_end
            end, sizes_end = int(ends[-1]), int(sizes_ends[-1])
            written = {
                "key": col["key"].to_numpy().astype(np.int64), "end": ends, "text": np.frombuffer(b"".join(texts), np.uint8),
                "verdict": np.array(col["verdict"].to_pylist(), np.uint8), "host_size": col["host_size"].to_numpy().astype(np.int64),
                "sizes_end": sizes_ends, "sizes": np.array([x for s in lists for x in s], np.int64),
            }
            for c in _COLUMNS:
                out[c].write(written[c].tobytes())
        for stream in out.values():
            stream.close()
        if first is not None:
            yield pa.RecordBatch.from_pydict({"first": pa.array([first]), "name": pa.array([name])})

    return run


def _segments(spark: SparkSession, rows: DataFrame, folder: str, label: str) -> tuple[tuple[int, str], ...]:
    parts = max(1, -(-rows.count() // SEGMENT_ROWS))
    sorted_rows = rows.repartitionByRange(parts, "key").sortWithinPartitions("key", "text")
    named = sorted_rows.mapInArrow(_write_segments(folder, label), "first long, name string")
    return tuple(sorted((r["first"], r["name"]) for r in named.collect()))


def build(rules: DataFrame, mask: int = -1) -> Index:
    """Index of rules (host, path, verdict: allow or block).

    ``mask`` keeps only some bits of the keys, to make collisions for tests.
    """
    spark = rules.sparkSession
    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = staged(
        rules.filter(F.col("host").isNotNull() & (F.col("host") != "") & F.col("verdict").isNotNull())
        .select(lower.alias("host"), F.coalesce("path", F.lit("")).alias("path"), (F.col("verdict") == "block").alias("block"))
        .groupBy("host", "path").agg(F.max("block").alias("verdict"))
    )
    key = lambda c: F.xxhash64(c).bitwiseAND(F.lit(mask))
    # a rule's key is of host and path apart, so that no host runs on into a path
    rule = F.concat("host", F.lit("\0"), "path")
    none = F.array().cast("array<int>")
    rule_rows = own.select(key(rule).alias("key"), rule.cast("binary").alias("text"), "verdict",
                           F.octet_length("host").alias("host_size"), none.alias("sizes"))
    host_rows = own.groupBy("host").agg(F.sort_array(F.collect_set(F.octet_length("path")), asc=False).alias("sizes")).select(
        key(F.col("host")).alias("key"), F.col("host").cast("binary").alias("text"), F.lit(False).alias("verdict"),
        F.octet_length("host").alias("host_size"), "sizes")
    folder = scratch_path(spark, "url_rules")
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    fs, root = pafs.FileSystem.from_uri(uri)
    fs.create_dir(root)
    index = Index(uri, isinstance(fs, pafs.LocalFileSystem),
                  _segments(spark, host_rows, uri, "hosts"), _segments(spark, rule_rows, uri, "rules"))
    if not index.mounted:
        for _, name in index.hosts + index.rules:
            for c in _COLUMNS:
                spark.sparkContext.addFile(f"{uri}/{name}.{c}")
    return index


class _Array:
    """Mapped segments of sorted keys."""

    _TYPES = dict.fromkeys(("key", "end", "host_size", "sizes_end", "sizes"), np.int64) | dict.fromkeys(("verdict", "text"), np.uint8)

    def __init__(self, index: Index, segments: tuple[tuple[int, str], ...]):
        self.first = np.array([f for f, _ in segments], np.int64)
        self.parts = []
        for _, name in segments:
            columns = {}
            for c in _COLUMNS:
                file = f"{pafs.FileSystem.from_uri(index.folder)[1]}/{name}.{c}" if index.mounted else SparkFiles.get(f"{name}.{c}")
                empty = not os.path.getsize(file)
                columns[c] = np.zeros(0, self._TYPES[c]) if empty else np.memmap(file, self._TYPES[c], "r")
            self.parts.append(columns)

    def find(self, keys: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Segment and row of each text's entry; -1 if it has none."""
        # equal keys lie in one segment, as range partitions keep them together
        segment = np.searchsorted(self.first, keys, side="right") - 1
        row = np.full(len(keys), -1, np.int64)
        for s in np.unique(segment[segment >= 0]).tolist():
            part = self.parts[s]
            ask = np.flatnonzero(segment == s)
            at = np.searchsorted(part["key"], keys[ask])
            while len(ask):
                equal = at < len(part["key"])
                equal[equal] = part["key"][at[equal]] == keys[ask[equal]]
                ask, at = ask[equal], at[equal]
                end = part["end"][at]
                start = np.where(at > 0, part["end"][at - 1], 0)
                same = np.array([part["text"][a:b].tobytes() == texts[i] for a, b, i in zip(start, end, ask.tolist())], bool)
                row[ask[same]] = at[same]
                ask, at = ask[~same], at[~same] + 1
        return segment, row


class Lookup:
    """Both arrays of an index, as a task maps them."""

    def __init__(self, index: Index, mask: int):
        self.hosts, self.rules, self.mask = _Array(index, index.hosts), _Array(index, index.rules), mask
        sizes = [np.unique(p["host_size"]) for p in self.hosts.parts]
        self.host_sizes = set(np.concatenate(sizes).tolist()) if sizes else set()

    def suffixes(self, name: bytes) -> Iterator[bytes]:
        """The host and its parent domains, as far as rules have hosts of their lengths."""
        for size in self.host_sizes:
            if size == len(name) or (size < len(name) and name[-size - 1] == 46):
                yield name[len(name) - size :]

    def judge(self, hosts: list[bytes], paths: list[bytes]) -> tuple[list[str | None], list[bool]]:
        """For each url the winning rule (host and path), and whether it blocks."""
        number = {h: i for i, h in enumerate(dict.fromkeys(hosts))}
        asked = [(i, s) for h, i in number.items() for s in self.suffixes(h)]
        texts = [s for _, s in asked]
        segment, row = self.hosts.find(_keyed(texts) & np.int64(self.mask), texts)
        known: dict[int, list[tuple[bytes, list[int]]]] = {}
        for (i, s), seg, r in zip(asked, segment.tolist(), row.tolist()):
            if r >= 0:
                part = self.hosts.parts[seg]
                start = part["sizes_end"][r - 1] if r else 0
                known.setdefault(i, []).append((s, part["sizes"][start : part["sizes_end"][r]].tolist()))
        url, texts = [], []
        for u, (h, p) in enumerate(zip(hosts, paths)):
            for s, sizes in known.get(number[h], ()):
                for size in sizes:
                    if size <= len(p):
                        url.append(u)
                        texts.append(s + b"\0" + p[:size])
        segment, row = self.rules.find(_keyed(texts) & np.int64(self.mask), texts)
        best: dict[int, tuple[int, int, bytes, bool]] = {}
        for u, text, seg, r in zip(url, texts, segment.tolist(), row.tolist()):
            if r >= 0:
                part = self.rules.parts[seg]
                hit = (len(text), int(part["host_size"][r]), text, bool(part["verdict"][r]))
                best[u] = max(best.get(u, hit), hit)
        rule = [best[u][2].replace(b"\0", b"", 1).decode() if u in best else None for u in range(len(hosts))]
        return rule, [u in best and best[u][3] for u in range(len(hosts))]


@lru_cache(maxsize=4)
def _lookup(index: Index, mask: int) -> Lookup:
    return Lookup(index, mask)


def judged(pages: DataFrame, index: Index, url: str = "url", mask: int = -1) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict (allow or block).

    Columns of these names are replaced.
    """

    @F.arrow_udf("struct<rule: string, block: boolean>")
    def probe(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        found = _lookup(index, mask)
        rule, block = found.judge(hosts.cast(pa.binary()).to_pylist(), paths.cast(pa.binary()).to_pylist())
        return pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array(block, pa.bool_())], ["rule", "block"])

    (hit,) = free_name(pages, "hit")
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*(F.col(f"`{c}`") for c in kept), host(F.col(f"`{url}`")).alias("host"), path(F.col(f"`{url}`")).alias("path"))
    return parsed.withColumn(hit, probe("host", "path")).select(
        *(F.col(f"`{c}`") for c in kept), "host", "path", F.col(f"{hit}.rule").alias("rule"),
        F.when(F.col(f"{hit}.block"), "block").otherwise("allow").alias("verdict"),
    )
