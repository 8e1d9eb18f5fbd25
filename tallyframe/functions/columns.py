"""Column helpers: null, zero and tie rules, parsing, labels.

Every helper returns a native ``Column`` expression, so it stays inside
whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
NULL_TOKENS = ("", "nan", "null", "none", "n/a", "#n/a", "na", "?")
TRUTHY = ("true", "1", "yes")
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "dd-MM-yyyy",
    "MM/dd/yyyy",
    "yyyy-MM-dd HH:mm:ss",
)
CURRENCY_CHARS = "₹$€£, \t\n\r\f\x0b"
# The short form cannot overflow a double, so its value needs no second look.
SHORT_NUMBER = r"^[+-]?[0-9]{1,100}(\.[0-9]*)?$"
PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# ----------------------------------------------------------------------------


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sum0(c: str | Column) -> Column:
    """Sum that is 0 over no or only null values."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def ratio0(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def pct0(a: Column, b: Column) -> Column:
    return ratio0(a, b) * 100.0


def growth_pct(now: Column, before: Column) -> Column:
    """Percent change; NULL (not infinity) where the earlier value is 0 or absent."""
    return F.try_divide(now - before, before) * 100.0


def as_text(c: str | Column) -> Column:
    return F.lower(F.trim(col(c).cast("string")))


def truthy(c: str | Column) -> Column:
    return F.coalesce(as_text(c).isin(*TRUTHY), F.lit(False))


def text_is(c: str | Column, value: str) -> Column:
    return F.coalesce(as_text(c) == value.strip().lower(), F.lit(False))


def null_if_token(c: str | Column) -> Column:
    """Trim, and turn the usual spellings of "no value" into NULL."""
    trimmed = F.trim(col(c).cast("string"))
    return F.when(F.lower(trimmed).isin(*NULL_TOKENS), F.lit(None)).otherwise(trimmed)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    Written out, an expression that is used several times is also generated
    several times; a long rule then grows beyond what the JVM compiles and runs
    many times slower.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def finite(c: Column) -> Column:
    """NULL in place of NaN and infinities (NaN compares as the greatest value)."""
    return let(c, lambda x: F.when(F.abs(x) < float("inf"), x))


def _is_plain(text: Column) -> Column:
    # checked by pattern: a cast would also take a trailing d or f, inf and nan
    return text.rlike(PLAIN_NUMBER)


def _undecorated(bare: Column) -> Column:
    last = F.lower(F.right(bare, F.lit(1)))
    shorter = F.substring(bare, F.lit(1), F.length(bare) - 1)
    factor = F.when(last == "k", 1e3).when(last == "m", 1e6).when(last == "b", 1e9).otherwise(1.0)
    percent = F.endswith(bare, F.lit("%")) | F.endswith(bare, F.lit("pct"))
    digits = (
        F.when(percent, F.regexp_replace(bare, "[%pct]+$", ""))
        .when(last.isin("k", "m", "b"), shorter)
        .otherwise(bare)
    )
    return let(digits, lambda d: F.when(_is_plain(d), d.try_cast("double"))) * factor


def _decorated_number(text: Column) -> Column:
    return let(F.translate(text, CURRENCY_CHARS, ""), _undecorated)


def parse_number(c: str | Column) -> Column:
    """Number out of plain, currency, percent or K/M/B text; NULL where there is none.

    A percent sign is dropped without dividing by 100.
    """
    text = F.trim(col(c).cast("string"))
    # decorated text also covers plain numbers in any other form
    return F.when(text.rlike(SHORT_NUMBER), text.try_cast("double")).otherwise(
        finite(_decorated_number(text))
    )


def needs_sanitizing(c: str | Column) -> Column:
    """True where the text is a number only after removing signs or suffixes."""
    text = F.trim(col(c).cast("string"))
    return F.coalesce(~_is_plain(text) & _decorated_number(text).isNotNull(), F.lit(False))


def _shape(fmt: str) -> str:
    """Pattern of the texts that a fixed-width date format describes."""
    out = fmt.replace("yyyy", "[0-9]{4}").replace("MM", "[0-9]{2}").replace("dd", "[0-9]{2}")
    return "^" + out.replace("HH", "([01][0-9]|2[0-3])").replace("mm", "[0-5][0-9]").replace(
        "ss", "[0-5][0-9]"
    ) + "$"


def _by_format(text: Column, fmt: str) -> Column:
    """Date by position.  A failed format parse throws inside Spark for every
    value, which is slow on dirty columns; a cast of an ISO text does not."""
    y, m, d = (fmt.index(p) + 1 for p in ("yyyy", "MM", "dd"))
    iso = F.concat_ws("-", F.substring(text, y, 4), F.substring(text, m, 2), F.substring(text, d, 2))
    return F.when(text.rlike(_shape(fmt)), iso.try_cast("date"))


def parse_date(c: str | Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First format that fits wins; text that fits none gives NULL."""
    text = F.trim(col(c).cast("string"))
    return let(text, lambda t: F.coalesce(*[_by_format(t, f) for f in formats]))


def iso_day(c: str | Column) -> Column:
    """Date from the first ten characters of an ISO text."""
    text = F.substring(col(c).cast("string"), 1, 10)
    return let(text, lambda t: _by_format(t, "yyyy-MM-dd"))


def squash(c: str | Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(col(c).cast("string")), "[^a-z0-9]", "")


def quality_badge(score: str | Column) -> Column:
    s = col(score)
    return (
        F.when(s >= 90, "Excellent").when(s >= 75, "Moderate").otherwise("Needs Attention")
    )


def recipient_list(c: str | Column) -> Column:
    """Comma list to an array of trimmed entries that hold an @."""
    return F.filter(
        F.transform(F.split(col(c), ","), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit("@"))
    )


def adjusted_skew(c: str | Column) -> Column:
    """Bias-adjusted sample skewness; NULL under 3 values, 0 for a constant."""
    n = F.count(col(c)).cast("double")
    adjust = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    spread = F.stddev_pop(col(c))
    return F.when(n < 3, F.lit(None)).when(spread == 0, F.lit(0.0)).otherwise(
        adjust * F.skewness(col(c))
    )


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Pairwise-complete correlation; NULL where one side is constant."""
    x = F.when(col(b).isNotNull(), col(a))
    y = F.when(col(a).isNotNull(), col(b))
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
