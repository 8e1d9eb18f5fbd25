"""Queries for column statistics, roles, audit and domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import profile
from tallyframe.plans.base import query, rounded
from tallyframe.sources.tables import table

_WORDS = ["sales", "qty", "unit_price", "order_date", "customer", "stock_level", "prodcut",
          "gross margin", "campaign", "score", "region", "patient"]

# Headers of a catalog of tables, derived from the part table: the brand is the
# table, the part key the position of the header in it.
HEADERS_SQL = f"""
select p_brand as table_id, p_partkey as position,
       case when p_partkey % 3 = 0 then '' else lower(p_type) || '_' end
       || list_extract({_WORDS!r}, cast(p_partkey % {len(_WORDS)} + 1 as integer))
       || case when p_partkey % 5 = 0 then ' ' || p_name else '' end as header
from part"""


def headers(spark, folder):
    word = F.element_at(
        F.array(*[F.lit(w) for w in _WORDS]), (F.col("p_partkey") % len(_WORDS) + 1).cast("int")
    )
    front = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(
        F.concat(F.lower("p_type"), F.lit("_"))
    )
    back = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(" "), "p_name")).otherwise("")
    return table(spark, folder, "part").select(
        F.col("p_brand").alias("table_id"),
        F.col("p_partkey").alias("position"),
        F.concat(front, word, back).alias("header"),
    )


# A table with every kind of column, derived from orders.
_MIXED = {
    "Order_ID": ("cast(o_orderkey as string)", "varchar"),
    "status": ("case when o_orderstatus = 'P' then null else o_orderstatus end", "varchar"),
    "is_settled": ("case when o_orderstatus = 'F' then 'Yes' else 'No' end", "varchar"),
    "order_day": ("cast(cast(o_orderdate as date) as string)", "varchar"),
    "Target_Value": ("o_totalprice * 1.1e0", "double"),
    "discount_rate": ("cast(o_orderkey % 11 as double) / 100e0", "double"),
    "amount": ("o_totalprice", "double"),
    "price_change": ("o_totalprice - 250000", "double"),
    "note": ("o_orderpriority || ' ' || cast(o_orderkey as string)", "varchar"),
    "currency": ("'EUR'", "varchar"),
}
_MIXED_SQL = "select " + ", ".join(f'{e} as "{n}"' for n, (e, _) in _MIXED.items()) + " from orders"


def mixed(spark, folder):
    return table(spark, folder, "orders").select(
        *[F.expr(e).alias(n) for n, (e, _) in _MIXED.items()]
    )


def _each(template: str, names) -> str:
    return "\nunion all\n".join(template.replace("{c}", n) for n in names)


@query("profile_columns", f"""
with t as ({_MIXED_SQL})
{_each('''select '{c}' as "column", count(*) as n_rows, count(*) - count("{c}") as n_null,
  count(distinct "{c}") as n_distinct, min("{c}") = max("{c}") as constant from t''', _MIXED)}""")
def profile_columns(spark, folder):
    out = profile.column_stats(mixed(spark, folder), distinct="exact")
    return out.select("column", "n_rows", "n_null", "n_distinct", "constant")


def _role_sql() -> str:
    parts = []
    for i, (name, (_, kind)) in enumerate(_MIXED.items()):
        value = f'"{name}"'
        dated = f"avg(case when try_strptime({value}, '%Y-%m-%d') is not null then 1 else 0 end)"
        low = name.lower()
        if kind == "varchar":
            body = f"""case when count(*) filter (where {value} not in ('Yes', 'No', 'yes', 'no')) = 0
                 and count(distinct {value}) <= 2 then 'boolean'
                 when {'true' if 'day' in low else 'false'} and {dated} > 0.8 then 'date'
                 when count(distinct {value}) < 0.5 * count(*) or count(distinct {value}) <= 50
                 then 'categorical' else 'text' end"""
        else:
            body = f"""case when {'true' if 'target' in low else 'false'} then 'target'
                 when {'true' if 'rate' in low else 'false'} then 'kpi' else 'numeric' end"""
        if low.endswith("id"):
            body = "max('identifier')"
        if not body.startswith(("max", "case when count")):
            body = f"max({body})"
        parts.append(f"select {i} as position, '{name}' as \"column\", {body} as role from t")
    return "with t as (" + _MIXED_SQL + ")\n" + "\nunion all\n".join(parts)


@query("profile_roles", _role_sql())
def profile_roles(spark, folder):
    return profile.roles(mixed(spark, folder)).select(
        F.col("position").cast("int").alias("position"), "column", "role"
    )


_WIDE = 500
_WIDE_EXPR = "case when (c_custkey + {i}) % {m} = 0 then null else c_acctbal * {i} end"


def _wide(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    cores = spark.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:  # rows get 250 times as wide
        rows = rows.repartition(cores)
    return rows.select(
        F.col("c_custkey").alias("Record_ID"),
        *[F.expr(_WIDE_EXPR.format(i=i, m=i % 13 + 2)).alias(f"Col_{i}") for i in range(1, _WIDE + 1)],
    )


@query("profile_wide", "with t as (select c_custkey as \"Record_ID\", "
       + ", ".join(f'{_WIDE_EXPR.format(i=i, m=i % 13 + 2)} as "Col_{i}"' for i in range(1, _WIDE + 1))
       + " from customer)\n"
       + "select 'Record_ID' as \"column\", count(*) as n_rows, 0::bigint as n_null, false as constant, count(distinct \"Record_ID\") as n_distinct from t\nunion all\n"
       + _each('''select 'Col_{c}' as "column", count(*) as n_rows, count(*) - count("Col_{c}") as n_null,
         min("Col_{c}") = max("Col_{c}") as constant, count(distinct "Col_{c}") as n_distinct from t''',
               [str(i) for i in range(1, _WIDE + 1)]))
def profile_wide(spark, folder):
    out = profile.column_stats(_wide(spark, folder), distinct="exact")
    return out.select("column", "n_rows", "n_null", "constant", "n_distinct")


# texts of few and of many values, flags, targets and amounts, by turns
_KINDS = {
    "Text_{i}": ("case when (c_custkey + {i}) % 7 = 0 then null else 'v' || cast(c_custkey % ({i} + 40) as {s}) end",
                 "case when count(distinct \"{c}\") < 0.5 * count(*) or count(distinct \"{c}\") <= 50 then 'categorical' else 'text' end"),
    "Note_{i}": ("cast(c_custkey * {i} as {s}) || 'n'",
                 "case when count(distinct \"{c}\") < 0.5 * count(*) or count(distinct \"{c}\") <= 50 then 'categorical' else 'text' end"),
    "Flag_{i}": ("case when (c_custkey + {i}) % 5 = 0 then 'Yes' when (c_custkey + {i}) % 5 = 1 then null else 'No' end", "'boolean'"),
    "Target_{i}": ("c_acctbal * {i}", "'target'"),
    "Amount_{i}": ("case when c_custkey % ({i} + 1) = 0 then null else c_custkey * {i} end", "'numeric'"),
}


def _wide_kinds(text: str) -> dict[str, tuple[str, str]]:
    """Name: (expression, role in SQL) of 500 columns."""
    out = {}
    for i in range(1, _WIDE // len(_KINDS) + 1):
        for name, (value, role) in _KINDS.items():
            c = name.format(i=i)
            out[c] = (value.format(i=i, s=text), role.format(c=c))
    return out


@query("profile_wide_roles", "with t as (select c_custkey as \"Record_ID\", "
       + ", ".join(f'{e} as "{c}"' for c, (e, _) in _wide_kinds("varchar").items())
       + " from customer)\nselect 'Record_ID' as \"column\", 'identifier' as role\nunion all\n"
       + "\nunion all\n".join(f"select '{c}', {role} from t" if "(" in role else f"select '{c}', {role}"
                              for c, (_, role) in _wide_kinds("varchar").items()))
def profile_wide_roles(spark, folder):
    """Roles of 501 columns."""
    df = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("Record_ID"), *[F.expr(e).alias(c) for c, (e, _) in _wide_kinds("string").items()]
    )
    return profile.roles(df).select("column", "role")


@query("audit_report", f"""
with t as ({_MIXED_SQL}),
s as (select sum(m) as missing, sum(case when m > 0 then 1 else 0 end) as cols,
             sum(case when d = 1 then 1 else 0 end) as constants,
             sum(case when cat and d > 30 then 1 else 0 end) as wide
      from ({_each('''select count(*) - count("{c}") as m, count(distinct "{c}") as d,
        typeof(any_value("{c}")) = 'VARCHAR' and '{c}' not in ('Order_ID', 'is_settled', 'order_day')
          and (count(distinct "{c}") < 0.5 * count(*) or count(distinct "{c}") <= 50) as cat from t''', _MIXED)})),
d as (select (select count(*) from t) - (select count(*) from (select distinct * from t)) as dup)
select unnest(['missing_values', 'missing_columns', 'duplicate_rows', 'constant_columns',
               'high_cardinality_columns', 'quality_score']) as metric,
       unnest([missing, cols, dup, constants, wide, greatest(0, 100 - 5 * cols - 2 * dup)])::double as value
from s, d""")
def audit_report(spark, folder):
    return profile.audit(mixed(spark, folder))


@query("audit_duplicate_rows", """
select count(*) - (select count(*) from (select distinct text, lang, n_chars from documents))
  as duplicate_rows from documents""")
def audit_duplicate_rows(spark, folder):
    return profile.duplicate_rows(table(spark, folder, "documents").select("text", "lang", "n_chars"))


@query("audit_duplicate_ids", """
select 'l_orderkey' as "column", count(*) - count(distinct l_orderkey) as duplicates from lineitem
union all select 'l_partkey', count(*) - count(distinct l_partkey) from lineitem
union all select 'l_suppkey', count(*) - count(distinct l_suppkey) from lineitem""")
def audit_duplicate_ids(spark, folder):
    return profile.duplicate_ids(
        table(spark, folder, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"]
    )


@query("audit_negatives", f"""
with t as ({_MIXED_SQL})
select 'price_change' as "column", count(*) filter (where price_change < 0) as n_negative from t""")
def audit_negatives(spark, folder):
    return profile.negatives(mixed(spark, folder))


def _values(spark, folder):
    """All values of a text column per table: the part names of each brand."""
    return table(spark, folder, "part").select(
        F.col("p_brand").alias("table_id"), F.lit("p_name").alias("column"),
        F.concat("p_name", F.lit(" "), F.element_at(
            F.array(F.lit("store"), F.lit("lead"), F.lit("none")),
            (F.col("p_partkey") % 3 + 1).cast("int"))).alias("value"),
    )


def _domain_sql() -> str:
    from tallyframe.functions.vocabulary import DOMAIN_WORDS

    words = ", ".join(
        f"('{d}', {i}, '{w}')" for i, (d, ws) in enumerate(DOMAIN_WORDS.items()) for w in ws
    )
    return f"""
w(domain, place, word) as (values {words}),
h as ({HEADERS_SQL}),
smp as (select p_brand as table_id, p_name || ' ' || list_extract(['store', 'lead', 'none'],
           cast(p_partkey % 3 + 1 as integer)) as v from part),
p as (select table_id, domain, place, sum(pts) as score from (
        select distinct table_id, domain, place, word, 2 as pts, 'h' as src from h, w
        where contains(lower(header), word)
        union all
        select distinct table_id, domain, place, word, 1, 's' from smp, w where contains(lower(v), word))
      group by 1, 2, 3)"""


@query("domain_score", f"""
with {_domain_sql()}
select table_id, domain, score::bigint as score from p""")
def domain_score(spark, folder):
    return profile.domain_scores(headers(spark, folder), _values(spark, folder))


@query("domain_detect", f"""
with {_domain_sql()},
r as (select *, row_number() over (partition by table_id order by score desc, place) as n from p)
select table_id, max(case when n = 1 then domain end) as primary_domain,
       concat_ws(', ', max(case when n = 2 and score >= 2 then domain end),
                 max(case when n = 3 and score >= 2 then domain end)) as secondary_domains,
       case when round(max(score) / 10.0, 2) < 0.4 then 0.55
            else least(round(max(score) / 10.0, 2), 0.99) end::double as confidence
from r group by 1""")
def domain_detect(spark, folder):
    return rounded(profile.detect_domains(headers(spark, folder), _values(spark, folder)))
