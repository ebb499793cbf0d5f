"""Column expressions shared by the operators: months, cleaning, curves, robust statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PHASES = ("oil", "gas", "water")
TINY = 1e-12


def month_number(d: Column) -> Column:
    """Months since year 0: differences of these are calendar months."""
    return F.year(d) * 12 + F.month(d) - 1


def parse_month(text: Column) -> Column:
    """First of month from YYYY-MM[-DD], MM/YYYY, YYYY/MM or YYYYMM; null for anything else
    (MM/DD/YYYY is refused rather than misread)."""
    v = F.trim(text)
    iso = F.regexp_extract(v, r"^(\d{4})[-/](\d{1,2})(?:[-T ].*)?$", 0) != ""
    y = F.when(iso | v.rlike(r"^\d{6}$"), F.substring(v, 1, 4)).when(v.rlike(r"^\d{1,2}/\d{4}$"), F.regexp_extract(v, r"/(\d{4})$", 1))
    m = F.when(iso, F.regexp_extract(v, r"^\d{4}[-/](\d{1,2})", 1)).when(v.rlike(r"^\d{6}$"), F.substring(v, 5, 2)).when(v.rlike(r"^\d{1,2}/\d{4}$"), F.regexp_extract(v, r"^(\d{1,2})/", 1))
    return F.when(m.cast("int").between(1, 12), F.make_date(y.cast("int"), m.cast("int"), F.lit(1)))


def parse_volume(text: Column) -> Column:
    """Number without thousands commas; blank, unreadable, NaN and infinite are null."""
    x = F.regexp_replace(F.trim(text), ",", "").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def unreadable_volume(text: Column) -> Column:
    """Whether there is a text that is no number (nan and inf are numbers, and missing)."""
    x = F.trim(text)
    return F.coalesce((x != "") & F.regexp_replace(x, ",", "").try_cast("double").isNull(), F.lit(False))


def pad_or_self(pad: Column, well: Column) -> Column:
    """A blank pad is the well itself."""
    return F.coalesce(F.when(F.trim(pad) != "", F.trim(pad)), well.cast("string"))


def group_label(raw: Column) -> Column:
    """Play or basin label: lower case, separators as single underscores, aliases resolved,
    blank as the global group."""
    label = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(raw, F.lit("")))), r"[- /]", "_"), r"_+", "_")
    known = F.create_map(*[F.lit(x) for pair in GROUP_ALIASES.items() for x in pair])
    return F.when(label == "", "__global__").otherwise(F.coalesce(F.try_element_at(known, label), label))


# Alternative names of groups.
GROUP_ALIASES = {
    "eagleford": "eagle_ford",
    "lower_eagle_ford": "eagle_ford",
    "upper_eagle_ford": "eagle_ford",
    "dj_basin": "dj",
    "denver_julesburg": "dj",
    "denver_julesburg_basin": "dj",
    "niobrara_a": "dj",
    "niobrara_b": "dj",
    "niobrara_c": "dj",
    "codell": "dj",
    "delaware_basin": "delaware",
    "permian_delaware": "delaware",
}


def hyperbolic(t: Column, qi: Column, di: Column, b: Column) -> Column:
    return F.when(b < 1e-6, qi * F.exp(-di * t)).otherwise(qi / F.pow(1 + b * di * t, 1 / b))


def span_bucket(months: Column) -> Column:
    return F.when(months.between(7, 12), "b1").when(months.between(13, 24), "b2").when(months.between(25, 36), "b3").otherwise("b4")


def method_label(raw: Column) -> Column:
    label = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(label == "", "UNKNOWN").otherwise(label)


def pool_score(e: Column) -> Column:
    """2/3 |median| + 1/3 population deviation of log errors; null under two."""
    return F.when(F.count(e) >= 2, F.lit(2 / 3) * F.abs(F.median(e)) + F.lit(1 / 3) * F.stddev_pop(e))
