"""Dates in texts as Column expressions; invalid dates are null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: month names, without and with diacritics ----
MONTHS = {"ledna": 1, "unora": 2, "brezna": 3, "dubna": 4, "kvetna": 5, "cervna": 6, "cervence": 7, "srpna": 8, "zari": 9, "rijna": 10, "listopadu": 11, "prosince": 12}
NUMERIC_DATE = r"(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})"
YEAR_CONTEXT = r"(?i)(?:v\s+roce|roku|za\s+rok)\s+(\d{4})"
# ---- end of fixed values ----


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def numeric_iso(text: str | Column) -> Column:
    """yyyy-mm-dd of the first d. m. yyyy, not checked for validity; null without one."""
    parts = [_part(_col(text), NUMERIC_DATE, k) for k in (3, 2, 1)]
    return F.concat(parts[0], F.lit("-"), F.lpad(parts[1], 2, "0"), F.lit("-"), F.lpad(parts[2], 2, "0"))


def numeric_date(text: str | Column) -> Column:
    return F.try_to_date(numeric_iso(text), "yyyy-MM-dd")


def asked_date(question: str | Column, citation_pattern: str, given: str | Column | None = None) -> Column:
    """The day that a question is about: given explicitly, else a date in it, else the end of a year it names, else null.

    The first citation is masked, so that its year isn't taken for one.
    """
    cited = F.regexp_extract(_col(question), citation_pattern, 0)
    masked = F.when(cited == "", _col(question)).otherwise(F.regexp_replace(_col(question), F.concat(F.lit("^(.*?)\\Q"), cited, F.lit("\\E")), F.lit("$1")))
    year = F.concat(_part(masked, YEAR_CONTEXT, 1), F.lit("-12-31"))
    found = F.coalesce(numeric_iso(masked), year)
    return found if given is None else F.coalesce(_col(given), found)


def named_date(text: str | Column) -> Column:
    """Date of `d. month yyyy` with the month's name, with or without diacritics."""
    plain = F.translate(F.lower(_col(text)), "áčďéěíňóřšťúůýž", "acdeeinorstuuyz")
    pattern = r"(\d{1,2})\.\s*([a-z]+)\s+(\d{4})"
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    month = F.try_element_at(table, F.regexp_extract(plain, pattern, 2))
    return F.try_to_date(F.concat_ws("-", _part(plain, pattern, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(_part(plain, pattern, 1), 2, "0")), "yyyy-MM-dd")


def split_iso(text: str | Column) -> Column:
    """dd.mm.yyyy of digits only to yyyy-mm-dd, no range check; else null."""
    parts = F.split(F.trim(_col(text)), r"\.")
    return F.when(F.rlike(F.trim(_col(text)), F.lit(r"^\d{1,2}\.\d{1,2}\.\d{4}$")), F.concat_ws("-", F.get(parts, F.lit(2)), F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.get(parts, F.lit(0)), 2, "0")))


def case_year(case_number: str | Column) -> Column:
    """Year after a slash: four digits as they are; two digits up to 79 are 20xx, others 19xx."""
    four, two = _part(_col(case_number), r"/(\d{4})(?!\w)", 1).cast("int"), _part(_col(case_number), r"/(\d{2})(?!\w)", 1).cast("int")
    return F.coalesce(four, F.when(two <= 79, 2000 + two).otherwise(1900 + two))


def shown(day: str | Column) -> Column:
    """d. m. yyyy without leading zeros."""
    return F.date_format(_col(day), "d. M. yyyy")


def year_range(text: str, current: int) -> list[int]:
    """`2024,2025` or `od:2018` (from that year on) as years."""
    if text.startswith("od:"):
        return list(range(int(text[3:]), current + 1))
    return [int(x) for x in text.split(",") if x.strip()]


def month_range(year_from: int | None, month_from: int | None, year_to: int | None, month_to: int | None) -> tuple[str | None, str | None]:
    """First and last day asked for; months count only if one year is asked for."""
    one = year_from is not None and (year_to is None or year_to == year_from)
    first = None if year_from is None else f"{year_from:04d}-{(month_from if one and month_from else 1):02d}-01"
    last_year = year_to if year_to is not None else year_from
    if last_year is None:
        return first, None
    month = (month_to or month_from) if one and (month_to or month_from) else 12
    days = (31, 29 if last_year % 4 == 0 and (last_year % 100 or last_year % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    return first, f"{last_year:04d}-{month:02d}-{days[month - 1]:02d}"


def days_back(spark, reference: str, n: int):
    """The reference day and the n - 1 days before it."""
    day = F.to_date(F.lit(reference))
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(day, n - 1), day)).alias("day"))


def cutoff(now: str, *, years: int = 0, days: int = 0, hours: int = 0) -> Column:
    """The time so long before `now`, which is given, so that reruns agree."""
    return F.to_timestamp(F.lit(now)) - F.make_interval(years=F.lit(years), days=F.lit(days), hours=F.lit(hours))
