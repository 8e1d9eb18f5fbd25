"""Small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import random

WORDS = [f"w{i}" for i in range(400)] + ["the", "The", "É", "naïve", "ß", "x1", "😀"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def hard_rows():
    """(doc_id, text, lang, source, n_chars)"""
    base = prose(1, 120)
    edited = base.split(" ")
    edited[60] = "changed"
    texts = [
        (1, base, "a"), (2, " ".join(edited), "a"), (3, base, "b"), (4, base.upper(), None), (5, "", "b"),
        (6, None, "c"), (7, " \t\n\r ", "c"), (8, "one", "b"), (9, "one", "a"), (10, "One two three four", "b"),
        (11, prose(2, 4000) + " " + base, "a"), (12, "word " * 300, "a"), (13, "a\nb\na\n\na \nb", "é"),
        (14, prose(3, 30) + "  " + base[:300], "Z"), (15, " x y É naïve", ""), (16, base, "a"), (16, base, "a"),
        (None, base, None), (17, prose(4, 60), "b"), (18, prose(4, 60) + " " + prose(4, 60), "b"), (19, "$$$ ### &&&", "b"),
    ]
    return [(i, t, "en" if i != 3 else None, s, None if t is None else len(t)) for i, t, s in texts]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """With columns named like those that operators add or use."""
    out = df
    for name in ("score", "kept", "size", "words", "key", "d", "s", "features", "shard", "bucket", "place", "label",
                 "id", "at", "component_id", "spans", "n_words", "taken", "gone", "node", "h1", "r_id", "tie", "cut"):
        out = out.selectExpr("*", f"'x' as {name}")
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
