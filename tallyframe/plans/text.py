"""Queries over question logs and column names.

Questions are the turns of the conversations table behind a leading phrase that
depends on conversation and turn; the whole text of every turn is kept.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.vocabulary import (
    ABSENT_CONCEPTS,
    FOLLOW_UP_WORDS,
    KPI_PHRASES,
    KPI_WORDS,
    PER_GROUP_PHRASES,
    QUESTION_OPERATIONS,
    SYNONYMS,
)
from tallyframe.operators import matching, questions
from tallyframe.plans.base import query, rounded
from tallyframe.plans.profiling import HEADERS_SQL, headers
from tallyframe.sources.tables import table

_PHRASES = [
    "What is the total revenue by region ?",
    "Show the average price",
    "Top 3 products in each region",
    "bottom 7 brands by units",
    "Give the 95th percentile of sales",
    "orders after 2024-03-01",
    "Which KPI is behind target",
    "what about its margin",
    "Compare sales between North and South",
    "median wait per clinic",
    "how many customers churn",
    "monthly trend of profit",
    "does that include tax",
    "dividend and depreciation per each branch",
    "Distribution of score",
    "count of missing values",
]
_N = len(_PHRASES)
_LIST = "[" + ", ".join(f"'{p}'" for p in _PHRASES) + "]"
QUESTIONS_SQL = f"""q as (
  select conv_id, turn, role, list_extract({_LIST}, cast((conv_id * 7 + turn * 3) % {_N} + 1 as integer))
         || ' ' || text as text from conversations)"""


def log(spark, folder):
    phrase = F.element_at(
        F.array(*[F.lit(p) for p in _PHRASES]),
        ((F.col("conv_id") * 7 + F.col("turn") * 3) % _N + 1).cast("int"),
    )
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", F.concat(phrase, F.lit(" "), "text").alias("text")
    )


def _any(words) -> str:
    return "(" + " or ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@query("question_intent", f"""
with {QUESTIONS_SQL}
select conv_id, turn,
  case {' '.join(f"when {_any(w)} then '{n}'" for n, w in QUESTION_OPERATIONS.items())} else 'sum' end as operation,
  case {' '.join('when ' + ' and '.join(_any(g) for g in gs) + f" then '{n}'" for n, gs in questions.INTENTS)}
    else 'sum' end as intent
from q""")
def question_intent(spark, folder):
    return log(spark, folder).select(
        "conv_id", "turn", questions.operation("text").alias("operation"),
        questions.intent("text").alias("intent"),
    )


@query("question_is_kpi", f"""
with {QUESTIONS_SQL} select conv_id, turn, {_any(KPI_PHRASES)} and {_any(KPI_WORDS)} as is_kpi from q""")
def question_is_kpi(spark, folder):
    return log(spark, folder).select("conv_id", "turn", questions.asks_for_kpis("text").alias("is_kpi"))


def _slot(pattern: str) -> str:
    return f"nullif(trim(regexp_extract(lower(text), '{pattern}', 1)), '')"


@query("question_slots", f"""
with {QUESTIONS_SQL}
select conv_id, turn, try_cast({_slot(questions.TOP_PATTERN)} as bigint) as top,
       try_cast({_slot(questions.PERCENTILE_PATTERN)} as bigint) as percentile,
       {_slot(questions.AFTER_PATTERN)} as after, md5({_slot(questions.GROUP_PATTERN)}) as group_term,
       md5({_slot(questions.CONTAINER_PATTERN)}) as container, {_any(PER_GROUP_PHRASES)} as per_group
from q""")
def question_slots(spark, folder):
    out = questions.slots(log(spark, folder))
    return out.select("conv_id", "turn", "top", "percentile", "after", F.md5("group_term").alias("group_term"),
                      F.md5("container").alias("container"), "per_group")


_WORDS_SQL = r"string_split_regex(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+')"


@query("question_ngrams", f"""
with {QUESTIONS_SQL},
w as (select {_WORDS_SQL} as w from q),
g as (select n, array_to_string(list_slice(w, i, i + n - 1), ' ') as phrase
      from (select w, n, unnest(generate_series(1, len(w) - n + 1)) as i from w, (values (1), (2), (3)) v(n)))
select n, phrase, count(*) as uses from g group by all""")
def question_ngrams(spark, folder):
    runs = questions.ngrams(log(spark, folder).select("text"))
    return runs.groupBy("n", "phrase").agg(F.count("*").alias("uses"))


@query("session_context_last5", f"""
with {QUESTIONS_SQL},
r as (select *, row_number() over (partition by conv_id order by turn desc) as n from q)
select conv_id, count(*) as n_turns, md5(string_agg(text, chr(10) || '---' || chr(10) order by turn)) as context
from r where n <= 5 group by 1""")
def session_context_last5(spark, folder):
    out = questions.last_turns(log(spark, folder), "conv_id")
    return out.withColumn("context", F.md5("context"))


_ENTITY = "case when (conv_id + turn) % 3 = 0 then 'entity ' || cast(conv_id * 10 + turn as string) end"


@query("followup_flag", f"""
with {QUESTIONS_SQL},
e as (select *, {_ENTITY} as entity,
        len(list_intersect({_WORDS_SQL}, {list(FOLLOW_UP_WORDS)!r})) > 0 as follow_up from q)
select conv_id, turn, follow_up, case when follow_up then last_value(entity ignore nulls) over
       (partition by conv_id order by turn rows between 5 preceding and 1 preceding) end as carried_entity
from e""")
def followup_flag(spark, folder):
    df = log(spark, folder).withColumn("entity", F.expr(_ENTITY))
    out = questions.carry_entity(df, "conv_id")
    return out.select("conv_id", "turn", "follow_up", "carried_entity")


_TERMS = ["Sales", "revenue", "customer id", "orderdate", "prodcut", "qunatity", "profit", "units",
          "stock", "wage", "colour", "Unit Price", "score", "tax", "medium campaign"]


def _requests(spark, folder):
    words = F.array(*[F.lit(t) for t in _TERMS])
    return table(spark, folder, "part").select(
        F.col("p_brand").alias("table_id"),
        F.element_at(words, (F.col("p_partkey") % len(_TERMS) + 1).cast("int")).alias("term"),
    )


def _bare(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"


def _synonym_rows() -> str:
    rows = []
    for c, (concept, words) in enumerate(SYNONYMS.items()):
        for term in dict.fromkeys([concept, *words]):
            rows += [f"('{term}', {c * 100 + i}, '{w}')" for i, w in enumerate(words)]
    return ", ".join(rows)


# Every term against every header of its table, ranked by tier.
_MATCH_SQL = f"""
syn as (select distinct {_bare('t')} as norm, prio, {_bare('w')} as syn from (values {_synonym_rows()}) v(t, prio, w)),
h as (select *, lower(trim(header)) as low, {_bare('header')} as hn from ({HEADERS_SQL})),
r as (select distinct table_id, term, lower(trim(term)) as tl, {_bare('term')} as tn from req),
c as (
  select r.table_id, term, header, 1 as tier, 0 as prio, 0 as part, position as place from r join h using (table_id) where low = tl
  union all
  select r.table_id, term, header, 2, 0, 0, -position from r join h using (table_id) where hn = tn and tn <> ''
  union all
  select r.table_id, term, header, 3, prio, 0, -position from r join syn on norm = tn join h using (table_id) where hn = syn
  union all
  select r.table_id, term, header, 3, prio, 1, position from r join syn on norm = tn join h using (table_id)
  where length(syn) >= 4 and hn <> '' and (contains(hn, syn) or contains(syn, hn))
  union all
  select r.table_id, term, header, 4, 0, 1, position from r join h using (table_id)
  where length(tn) >= 3 and hn <> '' and (contains(hn, tn) or contains(tn, hn))),
m as (select *, row_number() over (partition by table_id, term order by tier, prio, part, place, header) as n from c)"""
_REQ_SQL = f"""req as (select p_brand as table_id,
  list_extract({_TERMS!r}, cast(p_partkey % {len(_TERMS)} + 1 as integer)) as term from part)"""


@query("column_match", f"""
with {_REQ_SQL},
{_MATCH_SQL}
select table_id, term, header, tier from m where n = 1""")
def column_match(spark, folder):
    return matching.match_columns(_requests(spark, folder), headers(spark, folder), similar=False)


# Every open term against every header of its table by edit distance.
_TIERS_SQL = f"""{_MATCH_SQL},
alike as (
  select r.table_id, term, header, position, 1 - levenshtein(tn, hn)::double / greatest(length(tn), length(hn)) as likeness
  from r join (select table_id, hn, min(position) as position, arg_min(header, position) as header
               from h where hn <> '' group by 1, 2) h using (table_id)
  where length(tn) >= 3 and not exists (select 1 from m where m.table_id = r.table_id and m.term = r.term)),
best as (
  select table_id, term, header, tier from m where n = 1
  union all
  select table_id, term, header, 5 from (
    select *, row_number() over (partition by table_id, term order by likeness desc, position) as place
    from alike where likeness >= 0.6) where place = 1)"""


@query("column_match_similar", f"""
with {_REQ_SQL},
{_TIERS_SQL}
select table_id, term, header, tier from best""")
def column_match_similar(spark, folder):
    """All five tiers."""
    return matching.match_columns(_requests(spark, folder), headers(spark, folder))


@query("column_match_fuzzy", f"""
with {_REQ_SQL},
r as (select distinct table_id, term, {_bare('term')} as tn from req),
h as (select table_id, {_bare('header')} as hn, min(position) as position, arg_min(header, position) as header
      from ({HEADERS_SQL}) group by 1, 2),
c as (select r.table_id, term, header, position,
             1 - levenshtein(tn, hn)::double / greatest(length(tn), length(hn)) as likeness
      from r join h using (table_id) where tn <> '' and hn <> ''),
m as (select *, row_number() over (partition by table_id, term order by likeness desc, position) as n
      from c where likeness >= 0.6)
select table_id, term, header, round(likeness, 6) as likeness from m where n = 1""")
def column_match_fuzzy(spark, folder):
    return rounded(matching.match_by_edits(_requests(spark, folder), headers(spark, folder)), 6)


@query("concept_map", f"""
with req as (select t.table_id, c.term from (select distinct p_brand as table_id from part) t,
  (values {', '.join(f"('{c}')" for c in SYNONYMS)}) c(term)),
{_TIERS_SQL}
select table_id, term as concept, header, tier from best""")
def concept_map(spark, folder):
    return matching.concept_map(headers(spark, folder))


@query("question_missing_concept", f"""
with {QUESTIONS_SQL},
asked as (select conv_id, turn, 'Brand#' || cast(conv_id % 25 + 1 as varchar) as table_id, t.term
          from q, (values {', '.join(f"('{t}')" for t in ABSENT_CONCEPTS)}) t(term)
          where contains(lower(text), t.term)),
req as (select table_id, term from asked),
{_MATCH_SQL}
select conv_id, turn, a.table_id, a.term from asked a
where not exists (select 1 from m where n = 1 and m.table_id = a.table_id and m.term = a.term)""")
def question_missing_concept(spark, folder):
    df = log(spark, folder).withColumn(
        "table_id", F.concat(F.lit("Brand#"), (F.col("conv_id") % 25 + 1).cast("string"))
    )
    return questions.missing_concepts(df, headers(spark, folder), ["conv_id", "turn"])
