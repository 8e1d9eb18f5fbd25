"""Registered queries of this package, each beside its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import align, cross_entropy, debruijn, decontaminate, isolation, kneser_ney, lsh_forest, merkle, mixing, nbsvm, sharding, url_rules, warc
from tallyframe.llm.labelled import held_out
from tallyframe.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _scores(module, label: str, folds: int, fold: int, threshold: float) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
        kept_out: Column = held_out(F.col("doc_id"), folds, fold)
        model = module.fit(docs, labels, label, ~kept_out)
        scored = module.classify(docs.select("doc_id", "text"), model, threshold)
        return scored.select("doc_id", kept_out.alias("held_out"), "score", "predicted")

    return run


query("op5_toxicity")(_scores(kneser_ney, "toxic", 5, 0, 0.5))
query("op9_quality_classifier")(_scores(nbsvm, "quality", 4, 2, 0.7))


_MIX = rf"""
with d as (
  select doc_id, source, coalesce(text, '') as body,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size
  from documents
), s as (
  select source, sum(size)::bigint as source_size,
         row_number() over (order by source nulls last) - 1 as place
  from d group by source
), w as (
  select *, [5.0::double, 2.0, 1.0][(place % 3) + 1] as w, 2 * source_size as cap,
         sum(source_size) over ()::bigint * 1.5::double as goal
  from s
), f as (
  select *, cap * sum(w) over (order by cap / w, place rows between current row and unbounded following)
         <= (goal - coalesce(sum(cap) over (order by cap / w, place rows between unbounded preceding and 1 preceding), 0)::bigint) * w
         as filled
  from w
), t as (
  select source, source_size, place,
         case when filled then cap::double
              else (goal - coalesce(sum(case when filled then cap end) over (), 0)::bigint)
                   / (sum(case when not filled then w end) over ()) * w end as target
  from f
), p as (
  select d.*, t.source_size, t.target, round(t.target)::bigint as wanted,
         coalesce(sum(size) over (partition by d.source
           order by md5(coalesce(doc_id::varchar, '')), doc_id, size
           rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from d join t on d.source is not distinct from t.source
), b as (  -- blocks of a source: the first ``larger`` ones have a word more
  select source, source_size, place, round(target)::bigint as wanted, ceil(source_size / {mixing.BLOCK})::bigint as blocks
  from t
), c as (
  select *, source_size // greatest(blocks, 1) as length, source_size % greatest(blocks, 1) as larger,
         wanted // greatest(source_size, 1) as rounds, wanted % greatest(source_size, 1) as rest
  from b
), e as (
  select *, case when source_size = 0 then 0 else rounds * blocks + case when rest = 0 then 0
              when rest - 1 < larger * (length + 1) then (rest - 1) // (length + 1) + 1
              else larger + (rest - 1 - larger * (length + 1)) // length + 1 end end::bigint as slots
  from c
), q as (
  select *, coalesce(sum(slots) over (order by place rows between unbounded preceding and 1 preceding), 0)::bigint as point
  from e
), n as (select sum(slots)::bigint as n from e),
g as (
  select n, coalesce((
    select x from (select d, unnest([near + d, near - d]) as x
                   from (select unnest(range(0, 1000)) as d, round(n * (sqrt(5) - 1) / 2)::bigint as near))
    where x > 0 and x <= n and gcd(x, n) = 1 order by d, x desc limit 1), 1) as g from n
), lattice as (
  select slot, ((slot::hugeint * g) % n)::bigint as cell from (select unnest(range(n)) as slot, g, n from g)
), turns as (
  select source, blocks, slots, rest, source_size, length, larger, slot,
         row_number() over (partition by place order by slot) - 1 as turn
  from lattice join q on cell >= point and cell < point + slots
), firsts as (  -- the first slot of each block, and the words of the source that it holds
  select source, slot, turn * length + least(turn, larger) as low,
         least((turn + 1) * length + least(turn + 1, larger),
               case when turn = slots - 1 and rest > 0 then rest else source_size end) as high
  from turns where turn < blocks
), met as (
  select p.source, start, min(slot) as first_slot
  from p join firsts on p.source is not distinct from firsts.source and size > 0 and start < high and start + size > low
  group by p.source, start
)
select p.doc_id, size::bigint as size, source_size, target,
       case when size = 0 then 0 else
         (wanted // source_size) * size
         + greatest(0, least(p.start + size, wanted % source_size) - p.start) end::bigint as taken,
       p.source, first_slot
from p left join met on size > 0 and p.start = met.start and p.source is not distinct from met.source
"""


@query("op1_mixing", _MIX)
def op1_mixing(spark, folder):
    return mixing.words_taken(read(spark, folder, "documents"))


def shard_sql(limit: int) -> str:
    """The shards of ``documents`` with distinct ids; a larger document is a page by itself."""
    return f"""
with d as (
  select doc_id, strlen(coalesce(text, ''))::bigint as bytes,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
  from documents
), b as (select *, lpad(bin(h), 60, '0') as bits from d where bytes <= {limit}),
l as (select doc_id, bytes, bits, unnest(range(0, 61)) as depth from b),
s as (select *, sum(bytes) over (partition by depth, substr(bits, 1, depth))::bigint as shard_bytes from l)
select doc_id, bytes, substr(bits, 1, depth) as shard, depth::int as depth, shard_bytes
from s where shard_bytes <= {limit}
qualify row_number() over (partition by doc_id order by depth) = 1
"""


@query("op3_sharding", shard_sql(sharding.LIMIT))
def op3_sharding(spark, folder):
    return sharding.shard_table(read(spark, folder, "documents"))


def leak_sql(n: int) -> str:
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pick = rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
with b as (select distinct item_id, {pick} as w from benchmark where text is not null),
g as (
  select distinct item_id, w[i + 1 : i + least(len(w), {n})] as gram
  from (select item_id, w, unnest(range(0, greatest(len(w) - {n} + 1, 1))) as i from b where len(w) > 0)
),
d as (select row_number() over () as r, doc_id, coalesce({pick}, []) as w from documents),
v as (
  select r, i, k, w[i + 1 : i + k] as gram
  from (select r, w, k, unnest(range(0, greatest(len(w) - k + 1, 0))) as i
        from d, (select distinct len(gram) as k from g))
),
h as (select v.r, v.i, v.k, g.item_id from v join g using (gram)),
c as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from h) group by r),
m as (select r, count(*) as n_items, string_agg(id, ',' order by id) as ids
      from (select distinct r, item_id::varchar as id from h) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
       coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
       n_hit is not null as contaminated
from d left join c using (r) left join m using (r)
"""


@query("op7_decontamination", leak_sql(decontaminate.N))
def op7_decontamination(spark, folder):
    return decontaminate.report(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query("op2_quality_rules")
def op2_quality_rules(spark, folder):
    return isolation.verdicts(read(spark, folder, "documents"), read(spark, folder, "labels"))


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(
    f"substr('{_ALPHABET}', (('0x' || substr(h, {1 + 5 * part}, 5))::int // {32 ** (3 - digit)}) % 32 + 1, 1)"
    for part in range(8)
    for digit in range(4)
)


@query("op6_warc", f"""
with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h from pages),
f as (select *, min(page_id) over (partition by h) as first from p)
select page_id, strlen(body)::bigint as payload_bytes, {_BASE32} as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from f
""")
def op6_warc(spark, folder):
    path = scratch_path(spark, "warc")
    warc.write_pages(read(spark, folder, "pages"), path)
    return warc.page_digests(warc.read_archive(spark, path))


@query("op8_lm_scoring")
def op8_lm_scoring(spark, folder):
    """The target are the documents labelled as of high quality."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    good = read(spark, folder, "labels").filter("quality = 1").select("doc_id")
    return cross_entropy.corpus_scored(docs, good).drop("text")


def near_sql(width: int, percent: int) -> str:
    return rf"""
with recursive w as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w
  from documents
), s as (
  select doc_id, list_distinct(list_transform(range(0, greatest(len(w) - {width} + 1, least(len(w), 1))),
         lambda i : array_to_string(w[i + 1 : i + {width}], ' '))) as s from w
), r as (select s, min(doc_id) as id, len(s) as n from (select doc_id, list_sort(s) as s from s) where len(s) > 0 group by s),
e as (select id, n, unnest(s) as g from r),
c as (
  select x.id as a, y.id as b, count(*) as common, any_value(x.n) as na, any_value(y.n) as nb
  from e x join e y on x.g = y.g and x.id < y.id
   and 100 * x.n >= {percent} * y.n and 100 * y.n >= {percent} * x.n
  group by 1, 2
), l as (select a, b from c where 100 * common >= {percent} * (na + nb - common)),
reach as (
  select id as node, id as root from r
  union
  select case when l.a = reach.node then l.b else l.a end, reach.root
  from reach join l on l.a = reach.node or l.b = reach.node
), k as (select node, min(root) as root from reach group by node)
select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(k.root, s.doc_id) as component_id,
       s.doc_id = coalesce(k.root, s.doc_id) as kept
from s left join r on r.s = list_sort(s.s) left join k on k.node = r.id
"""


@query("op4_near_dedup", near_sql(lsh_forest.WIDTH, lsh_forest.SIMILAR))
def op4_near_dedup(spark, folder):
    return lsh_forest.classes(read(spark, folder, "documents"))


def repeat_sql(window: int) -> str:
    return rf"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), v as (
  select doc_id, i, w[i + 1 : i + {window}] as g
  from (select doc_id, w, unnest(range(0, greatest(len(w) - {window} + 1, 0))) as i from w)
), r as (
  select doc_id, i from v
  qualify row_number() over (partition by g order by doc_id nulls last, i) > 1
), c as (select doc_id, list(distinct p) as gone from (select doc_id, unnest(range(i, i + {window})) as p from r) group by doc_id),
k as (
  select w.doc_id, w.w as w, coalesce(gone, []) as gone from w left join c on c.doc_id is not distinct from w.doc_id
), p as (select doc_id, w, gone, unnest(range(0, greatest(len(w), 1))) as i from k),
t as (
  select doc_id, string_agg(w[i + 1], ' ' order by i) filter (where i < len(w) and x is null) as kept
  from (select p.doc_id, p.w, p.i, x.i as x from p left join
        (select doc_id, unnest(gone) as i from c) x on x.doc_id is not distinct from p.doc_id and x.i = p.i)
  group by doc_id
)
select k.doc_id, len(w)::bigint as n_words, len(gone)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from k join t on t.doc_id is not distinct from k.doc_id
"""


@query("op10_substring_dedup", repeat_sql(debruijn.WINDOW))
def op10_substring_dedup(spark, folder):
    return debruijn.report(read(spark, folder, "documents"))


# CRC-32 of a decimal id, bit by bit
_CRC = """xor(4294967295, list_reduce([4294967295::bigint] || list_transform(string_split({0}::varchar, ''), lambda c : ascii(c)::bigint),
  lambda crc, b : list_reduce([xor(crc, b)] || list_transform(range(8), lambda z : 0::bigint),
    lambda x, z : xor(x >> 1, 3988292384::bigint * (x & 1)))))"""
_LEAF = "sha256(" + " || ".join(
    f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "{0}", "text")
) + ")"


@query("op12_merkle_manifest", f"""
with recursive d as (
  select doc_id, lang, {_LEAF.format("n_chars")} as leaf,
         case when {_CRC.format("doc_id")} % 7 = 0 then {_LEAF.format("(n_chars + 1)")} end as claim
  from documents
), o as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i from d
), sub as (
  select lang, 0 as k, list(leaf order by i) as nodes from o group by lang
  union all
  select lang, k + 1, list_transform(range(0, (len(nodes) + 1) // 2),
                                     lambda j : sha256(nodes[2 * j + 1] || coalesce(nodes[2 * j + 2], '')))
  from sub where len(nodes) > 1
), tops as (
  select lang, nodes[1] as subroot, row_number() over (order by lang nulls first) - 1 as place from sub where len(nodes) = 1
), up as (
  select 0 as k, list(subroot order by place) as nodes from tops
  union all
  select k + 1, list_transform(range(0, (len(nodes) + 1) // 2),
                               lambda j : sha256(nodes[2 * j + 1] || coalesce(nodes[2 * j + 2], '')))
  from up where len(nodes) > 1
), low as (
  select doc_id, lang, leaf, 0 as k, i, coalesce(claim, leaf) as h, '' as proof from o
  union all
  select doc_id, low.lang, leaf, low.k + 1, i // 2,
         case when i % 2 = 1 then sha256(nodes[i] || h) else sha256(h || coalesce(nodes[i + 2], '')) end,
         proof || case when i % 2 = 1 then nodes[i] else coalesce(nodes[i + 2], '') end
  from low join sub on low.lang is not distinct from sub.lang and low.k = sub.k and len(nodes) > 1
), high as (
  select doc_id, leaf, subroot, 0 as k, place as i, h, proof
  from low join sub on low.lang is not distinct from sub.lang and low.k = sub.k and len(nodes) = 1
  join tops on tops.lang is not distinct from low.lang
  union all
  select doc_id, leaf, subroot, high.k + 1, i // 2,
         case when i % 2 = 1 then sha256(nodes[i] || h) else sha256(h || coalesce(nodes[i + 2], '')) end,
         proof || case when i % 2 = 1 then nodes[i] else coalesce(nodes[i + 2], '') end
  from high join up on high.k = up.k and len(nodes) > 1
)
select doc_id, leaf, subroot, nodes[1] as root, sha256(proof) as proof_sha256, h as folded_root, h = nodes[1] as verified
from high join up on high.k = up.k and len(nodes) = 1
""")
def op12_merkle_manifest(spark, folder):
    found = merkle.document_proofs(read(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root",
        F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), "folded_root", "verified",
    )


@query("op13_tokenizer_alignment")
def op13_tokenizer_alignment(spark, folder):
    return align.alignment(read(spark, folder, "documents"))


URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]
_RULES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)


@query("op11_url_filters", rf"""
with p as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path
  from pages
), r as (select * from (values {_RULES}) as r(rule_host, rule_path, verdict)),
m as (
  select row_number() over () as n, * from p
)
select page_id, host, path, rule_host || rule_path as rule, coalesce(verdict, 'allow') as verdict
from m left join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
qualify row_number() over (partition by n order by len(rule_host || rule_path) desc, len(rule_host) desc) = 1
""")
def op11_url_filters(spark, folder):
    index = url_rules.build(spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))
    pages = read(spark, folder, "pages").select("page_id", "url")
    return url_rules.judged(pages, index).select("page_id", "host", "path", "rule", "verdict")
