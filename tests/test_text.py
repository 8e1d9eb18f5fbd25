import random
import re

import pytest

from tallyframe.operators import matching, questions

HEADERS = ["Customer_ID", "Order_Date", "Product", "Quantity", "Sales"]


def headers(spark, names, table="t"):
    return spark.createDataFrame([(table, i, n) for i, n in enumerate(names)], "table_id string, position long, header string")


def match(spark, terms, names):
    req = spark.createDataFrame([("t", t) for t in terms], "table_id string, term string")
    return {r["term"]: r["header"] for r in matching.match_columns(req, headers(spark, names)).collect()}


def sent_to_all(df):
    """What stands below the broadcasts of a plan, line by line."""
    found, below = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-*"))
        if below is not None and depth > below:
            found.append(line)
            continue
        below = depth if "BroadcastExchange" in line else None
    return found


def on_disk(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_names_never_pass_the_driver(spark, tmp_path):
    names = on_disk(headers(spark, HEADERS), tmp_path / "h")
    req = on_disk(spark.createDataFrame([("t", "revenue"), ("t", "units")], "table_id string, term string"), tmp_path / "r")
    df = matching.match_columns(req, names, similar=False)
    assert not [x for x in sent_to_all(df) if "table_id" in x]
    assert {r["term"]: (r["header"], r["tier"]) for r in df.collect()} == {"revenue": ("Sales", 3), "units": ("Quantity", 3)}


def test_similar_names_never_pass_the_driver(spark, tmp_path):
    names = on_disk(headers(spark, HEADERS), tmp_path / "h")
    req = on_disk(spark.createDataFrame([("t", "prodcut"), ("t", "units"), ("t", "zzz")], "table_id string, term string"), tmp_path / "r")
    both = matching.match_columns(req, names), matching.match_by_edits(req, names)
    assert not [x for df in both for x in sent_to_all(df) if "table_id" in x]
    assert {r["term"]: (r["header"], r["tier"]) for r in both[0].collect()} == {"prodcut": ("Product", 5), "units": ("Quantity", 3)}
    assert [(r["term"], r["header"]) for r in both[1].collect()] == [("prodcut", "Product")]


def test_concepts_never_pass_the_driver(spark, tmp_path):
    names = on_disk(headers(spark, HEADERS), tmp_path / "h")
    assert not [x for similar in (False, True) for x in sent_to_all(matching.concept_map(names, similar)) if "table_id" in x]
    got = {(r["table_id"], r["concept"]): (r["header"], r["tier"]) for r in matching.concept_map(names).collect()}
    assert got[("t", "sales")] == ("Sales", 1) and got[("t", "customer")] == ("Customer_ID", 3) and ("t", "salary") not in got


def test_places_of_equal_names(spark):
    rows = [("t", None, "Net Sales"), ("t", 1, "sales"), ("t", 1, "Sales"), ("t", 2, "s-a-les"), ("t", 7, "sa_les"), ("t", 7, "sal_es"),
            ("t", 9, "total_cost_a"), ("t", 4, "Total Cost A"), ("u", 1, None), (None, 1, "sales"), ("u", 2, "")]
    names = spark.createDataFrame(rows, "table_id string, position long, header string")
    terms = [("t", "SALES"), ("t", "sale.s"), ("t", "total cost"), ("u", "sales"), (None, "sales"), ("u", None), ("u", "")]
    req = spark.createDataFrame(terms, "table_id string, term string")
    got = {(r["table_id"], r["term"]): (r["header"], r["tier"]) for r in matching.match_columns(req, names, similar=False).collect()}
    # same text: the first place; same letters: the last place, then by name; pieces: the first place
    assert got == {("t", "SALES"): ("Sales", 1), ("t", "sale.s"): ("sa_les", 2), ("t", "total cost"): ("Total Cost A", 3), ("u", ""): ("", 1)}


def test_cascade(spark):
    want = {"Sales": "Sales", "sales": "Sales", "revenue": "Sales", "turnover": "Sales", "customer id": "Customer_ID",
            "customer_id": "Customer_ID", "units": "Quantity", "items": "Quantity", "orderdate": "Order_Date",
            "prodcut": "Product", "qunatity": "Quantity"}
    assert match(spark, [*want, "profit", "salary", "wage"], HEADERS) == want


def test_similar_tier_equals_all_pairs(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    terms = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 9))) for _ in range(40)]
    names = sorted(set(names))
    got = match(spark, terms, names)
    def likeness(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, old = [i], row
            for j, d in enumerate(y, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
        return 1 - row[-1] / max(len(x), len(y))

    for t in terms:
        if any(n in t or t in n for n in names):
            assert t in got
        else:
            near = max(names, key=lambda n: (likeness(t, n), -names.index(n)))
            assert got.get(t) == (near if likeness(t, near) >= 0.6 - 1e-9 else None), t


@pytest.mark.parametrize("term,name", [("tax", "tux"), ("prodcut", "Product"), ("qunatity", "Quantity"), ("slaes", "Sales")])
def test_spellings_without_a_common_pair_of_letters(spark, term, name):
    req = spark.createDataFrame([("t", term)], "table_id string, term string")
    assert [r["header"] for r in matching.match_by_edits(req, headers(spark, ["zzz", name])).collect()] == [name]
    assert match(spark, [term], ["zzz", name]) == {term: name}


def test_edit_distance(spark):
    req = spark.createDataFrame([("t", "slaes"), ("t", "zzz")], "table_id string, term string")
    got = matching.match_by_edits(req, headers(spark, HEADERS)).collect()
    assert [(r["term"], r["header"], round(r["likeness"], 2)) for r in got] == [("slaes", "Sales", 0.6)]


def test_concepts(spark):
    got = {r["concept"]: r["header"] for r in matching.concept_map(headers(spark, HEADERS)).collect()}
    assert got["sales"] == "Sales" and got["customer"] == "Customer_ID" and "salary" not in got


@pytest.mark.parametrize("text,op,intent", [
    ("What is the total sales?", "sum", "sum"),
    ("average order value please", "mean", "average_order_value"),
    ("lowest price", "min", "bottom_n"),
    ("highest margin", "max", "profit_margin"),
    ("how many rows", "count", "count"),
    ("the median age", "median", "median"),
    ("95th percentile of cost", "sum", "percentile"),
    ("monthly trend of cost", "sum", "monthly_trend"),
    ("percentage difference of cost", "sum", "percentage_difference"),
    ("Compare the difference", "sum", "difference_between_groups"),
])
def test_intent(spark, text, op, intent):
    df = spark.createDataFrame([(text,)], "text string")
    row = df.select(questions.operation("text").alias("o"), questions.intent("text").alias("i")).first()
    assert (row["o"], row["i"]) == (op, intent)


def test_slots(spark):
    df = spark.createDataFrame([("Top 3 products inside each region after 2024-01-01",), ("the 90th percentile by city",), ("nothing",)], "text string")
    rows = questions.slots(df).collect()
    assert (rows[0]["top"], rows[0]["after"], rows[0]["per_group"]) == (3, "2024-01-01", True)
    assert rows[0]["container"].startswith("region")
    assert (rows[1]["percentile"], rows[1]["group_term"]) == (90, "city")
    assert rows[2]["top"] is None and rows[2]["per_group"] is False


def test_kpi_and_follow_up(spark):
    df = spark.createDataFrame([("Which KPI is behind target?",), ("sum it up",), ("kpi",), ("its\tmargin",)], "text string")
    got = [tuple(r) for r in df.select(questions.asks_for_kpis("text"), questions.is_follow_up("text")).collect()]
    assert got == [(True, False), (False, True), (False, False), (False, True)]


def test_ngrams(spark):
    df = spark.createDataFrame([(1, " Total  net\nsales "), (2, ""), (3, "one two three four")], "q long, text string")
    got = {(r["q"], r["n"], r["position"]): r["phrase"] for r in questions.ngrams(df).collect()}
    assert got[(1, 3, 1)] == "total net sales" and got[(3, 2, 3)] == "three four"
    assert len([k for k in got if k[0] == 3]) == 2 + 3 + 4 and not [k for k in got if k[0] == 2]


def test_session_context_and_carry(spark):
    rows = [("s", i, f"turn {i} its" if i in (2, 9) else f"turn {i}", "E1" if i == 1 else ("E3" if i == 3 else None)) for i in range(1, 10)]
    df = spark.createDataFrame(rows, "session_id string, turn long, text string, entity string")
    row = questions.last_turns(df).first()
    assert row["n_turns"] == 5 and row["context"].startswith("turn 5\n---\n")
    got = {r["turn"]: r["carried_entity"] for r in questions.carry_entity(df).collect()}
    assert got[2] == "E1" and got[9] is None and got[4] is None


def test_missing_concepts(spark):
    log = spark.createDataFrame([(1, "t", "tax and churn?"), (2, "t", "sales")], "q long, table_id string, text string")
    got = questions.missing_concepts(log, headers(spark, ["Tax_Amount", "Sales"]), ["q"]).collect()
    assert [(r["q"], r["term"]) for r in got] == [(1, "churn")]
    assert re.match("churn", got[0]["term"])


def test_missing_concepts_keep_names_from_the_driver(spark, tmp_path):
    rows = [(1, "t", "tax and churn?"), (1, "t", "tax and churn?"), (2, None, "nps"), (3, "u", "NPS"), (4, "t", None)]
    log = on_disk(spark.createDataFrame(rows, "q long, table_id string, text string"), tmp_path / "q")
    got = questions.missing_concepts(log, on_disk(headers(spark, ["Tax_Amount", "Sales"]), tmp_path / "h"), ["q"])
    assert not [x for x in sent_to_all(got) if "header" in x]
    assert sorted((r["q"], r["table_id"] or "", r["term"]) for r in got.collect()) == [
        (1, "t", "churn"), (1, "t", "churn"), (2, "", "nps"), (3, "u", "nps")]
