"""Benchmark decontamination: a hash set of test n-grams against training windows.

Benchmark items and documents are normalised alike: A-Z in lower case, words are
runs of letters, digits and non-ASCII characters.  An item gives its windows of
``n`` consecutive words; a shorter one, with a word at least, is one window.
Every window of every whole document is hashed and looked up in the set of item
windows; hits are verified word by word, and the words that any hit covers, or
the documents, are removed.

Only DataFrame functions are used.  The set is broadcast after its rows have been
counted (``BROADCAST_WINDOWS`` of 16 bytes at most); a larger benchmark is joined
by shuffle.  Rows equal in id and text share their hits.

Defined cases: null and empty texts have no words and no hits, items without
words give no window, an empty benchmark hits nothing, repeated items and
documents are all reported.  Item ids that repeat count once.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.native import computed_once, free_name, staged

N = 10
BROADCAST_WINDOWS = 2_000_000
_WORD = r"[0-9a-z\x80-\x{10FFFF}]+"
_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words(text: Column) -> Column:
    """The normalised words; none for null.  Pure ASCII takes the quick way."""
    ascii_only = F.octet_length(text) == F.length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.coalesce(F.regexp_extract_all(low, F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def _pairs(a: Column, b: Column, shift: int, width: int) -> Column:
    """Hashes of windows of ``width`` words: ``a`` at a word, ``b`` at ``shift`` words on."""
    rest = F.greatest(F.size("words") - (width - 1), F.lit(0))
    return F.zip_with(F.slice(a, 1, rest), F.slice(b, shift + 1, rest), lambda x, y: F.xxhash64(x, y))


def _with_windows(df: DataFrame, widths: list[int]) -> DataFrame:
    """Adds w1, w2, w4, ... and the given widths, from ``words``; doubling keeps it cheap."""
    df = df.withColumn("w1", F.transform("words", lambda w: F.xxhash64(w)))
    have = 1
    while have * 2 <= max(widths):
        df = df.withColumn(f"w{have * 2}", _pairs(F.col(f"w{have}"), F.col(f"w{have}"), have, have * 2))
        have *= 2
    for width in widths:
        if f"w{width}" in df.columns:
            continue
        done = 1 << (width.bit_length() - 1)
        part = F.col(f"w{done}")
        name = f"w{done}"
        while done < width:
            step = 1 << ((width - done).bit_length() - 1)
            name = f"w{done + step}" if done + step == width else f"u{width}_{done + step}"
            df = df.withColumn(name, _pairs(part, F.col(f"w{step}"), done, done + step))
            part, done = F.col(name), done + step
    return df


def item_windows(benchmark: DataFrame, n: int = N) -> tuple[DataFrame, list[int]]:
    """gram, width, gram_words, item_id of each item window; and the widths that occur (n at most)."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("width", F.least(F.size("words"), F.lit(n)))
    widths = sorted((r[0] for r in items.select("width").distinct().collect()), reverse=True)
    if not widths:
        return items.select(F.lit(0).cast("long").alias("gram"), "width", F.col("words").alias("gram_words"), "item_id"), []
    hashed = _with_windows(items, widths)
    mine = F.coalesce(*(F.when(F.col("width") == w, F.col(f"w{w}")) for w in widths))
    grams = hashed.select("item_id", "width", "words", F.posexplode(mine).alias("at", "gram"))
    gram_words = F.slice("words", F.col("at") + 1, F.col("width"))
    return grams.select("gram", "width", gram_words.alias("gram_words"), "item_id").distinct(), widths


def hits(docs: DataFrame, grams: DataFrame, widths: list[int], key: str) -> DataFrame:
    """key, at, gram, width, gram_words: windows of ``docs`` (key, words) with an item window's hash."""
    if not widths:
        return docs.join(grams, F.lit(False)).select(key, F.lit(0).alias("at"), "gram", "width", "gram_words")
    known = grams.select("gram", "width", "gram_words").distinct()
    few = known.select("gram").distinct()
    if few.count() <= BROADCAST_WINDOWS:
        few = F.broadcast(few)
    hashed = _with_windows(docs, widths)
    # outer: else the optimizer adds a size filter, which repeats all the hashing
    all_windows = hashed.select(key, F.size("words").alias("n"), F.concat(*(F.col(f"w{w}") for w in widths)).alias("w"))
    seen = all_windows.select(key, "n", F.posexplode_outer("w").alias("place", "gram")).join(few, "gram", "left_semi")
    seen = seen.distinct().join(known, "gram")
    before = F.lit(0)
    at = F.lit(None).cast("int")
    for w in widths:
        at = F.when(F.col("width") == w, F.col("place") - before).otherwise(at)
        before = before + F.greatest(F.col("n") - (w - 1), F.lit(0))
    # a hash of another width's window gives a place outside this width
    return seen.withColumn("at", at).filter((F.col("at") >= 0) & (F.col("at") + F.col("width") <= F.col("n"))).select(
        key, "at", "gram", "width", "gram_words"
    )


def _covered(spans: Column) -> Column:
    """Words that sorted (at, width) spans cover."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def add(acc: Column, s: Column) -> Column:
        end = s["at"] + s["width"]
        fresh = F.greatest(end - F.greatest(acc["end"], s["at"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(spans, start, add, lambda acc: acc["n"]).cast("long")


def find(docs: DataFrame, benchmark: DataFrame, n: int = N) -> tuple[DataFrame, DataFrame]:
    """Rows (d, words, spans, grams, key) of all documents, and the item windows.

    ``spans`` are the verified hits in order, ``grams`` their distinct windows.
    """
    grams, widths = item_windows(benchmark, n)
    key = F.xxhash64("doc_id", "text")
    split = computed_once(docs.select(key.alias("key"), "text"), "words", words(F.col("text"))).drop("text")
    found = hits(split, grams, widths, "key")
    per_doc = found.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("at", "width", "gram", "gram_words"))).alias("hits")
    )
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("d"), key.alias("key"))
    met = computed_once(rows.join(per_doc, "key", "left"), "words", words(F.col("d.text")))

    def same(h: Column) -> Column:
        return F.forall(
            F.sequence(F.lit(0), h["width"] - 1),
            lambda i: F.get(F.col("words"), h["at"] + i).eqNullSafe(F.get(h["gram_words"], i)),
        )

    none = F.array().cast(per_doc.schema["hits"].dataType)
    met = computed_once(met, "spans", F.filter(F.coalesce("hits", none), same))
    return met.select("d", "key", "words", "spans"), grams


def report(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    met, grams = find(docs, benchmark, n)
    lines = met.select(
        F.col("d.doc_id").alias("doc_id"), "key", F.size("words").cast("long").alias("n_words"),
        _covered(F.col("spans")).alias("n_hit"),
        F.array_distinct(F.transform("spans", lambda s: F.struct(s["gram"], s["gram_words"]))).alias("grams"),
    )
    lines = staged(lines)
    hit = lines.filter("n_hit > 0").select("key", F.explode("grams").alias("g"))
    owners = grams.select(F.struct("gram", "gram_words").alias("g"), "item_id").distinct()
    of_doc = hit.distinct().join(owners, "g").groupBy("key").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    out = lines.drop("grams").join(of_doc, "key", "left")
    ids = F.array_sort(F.coalesce("ids", F.array().cast("array<string>")))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, remove: str = "documents") -> DataFrame:
    """``docs`` without the documents that have a hit, or (``remove="spans"``) without the hit words.

    A removed word goes with the other characters before it; the rest of the text
    stays as it is.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    met, _ = find(docs, benchmark, n)
    if remove == "documents":
        return met.filter(F.size("spans") == 0).select("d.*")
    # the words between spans, as (from, to)
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<a:int,b:int>>").alias("gaps"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.struct(acc["end"].alias("a"), s["at"].alias("b"))
        gaps = F.when(s["at"] > acc["end"], F.concat(acc["gaps"], F.array(gap))).otherwise(acc["gaps"])
        return F.struct(F.greatest(acc["end"], s["at"] + s["width"]).alias("end"), gaps.alias("gaps"))

    last = lambda acc: F.concat(acc["gaps"], F.array(F.struct(acc["end"].alias("a"), F.size("words").alias("b"))))
    gaps = F.aggregate("spans", start, add, last)
    parts, tail = free_name(docs, "parts", "tail")
    met = met.withColumn(parts, F.regexp_extract_all("d.text", F.lit(f"{_OTHER}*{_ANY_CASE}+"), F.lit(0)))
    met = met.withColumn(tail, F.regexp_extract("d.text", f"{_OTHER}*$", 0))
    kept = F.transform(gaps, lambda g: F.array_join(F.slice(F.col(parts), g["a"] + 1, g["b"] - g["a"]), ""))
    text = F.when(F.size("spans") == 0, F.col("d.text")).otherwise(F.concat(F.array_join(kept, ""), F.col(tail)))
    met = met.withColumn("cut", text)
    new = {"text": F.col("cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") == 0, F.col("d.n_chars")).otherwise(F.length("cut"))
    types = dict(docs.dtypes)
    return met.select(*(new.get(c, F.col(f"d.`{c}`")).cast(types[c]).alias(c) for c in docs.columns))
