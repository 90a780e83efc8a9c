"""Calendar buckets, windows and strict time texts. Instants are timestamps without a zone, in UTC."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the date under which the rolling window's bucket is kept.
LIVE_DATE = "1970-01-01"
_RFC3339 = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt]([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$"


def midnight(date: Column, zone: Column) -> Column:
    """The instant of a date's first moment in a zone."""
    return F.to_utc_timestamp(date.cast("timestamp_ntz").cast("string"), zone).cast("timestamp_ntz")


def shifted(date: Column, period: Column, by: int) -> Column:
    """A bucket's date moved by whole days, weeks or months; a month's end is cut to the target month's."""
    return F.when(period == "DAILY", F.date_add(date, by)).when(period == "WEEKLY", F.date_add(date, 7 * by)).when(period == "MONTHLY", F.add_months(date, by))


def windows(period: Column, bucket: Column, zone: Column, now: str) -> Column:
    """previous, start and end of a bucket's window: calendar units before the zone applies; LIVE is the 24 hours before now."""
    live, t = period == "LIVE", F.lit(now).cast("timestamp_ntz")
    at = lambda by, hours: F.when(live, t - F.expr(f"INTERVAL {hours} HOURS")).otherwise(midnight(shifted(bucket, period, by), zone))
    return F.struct(at(-1, 48).alias("previous"), at(0, 24).alias("start"), F.when(live, t).otherwise(midnight(shifted(bucket, period, 1), zone)).alias("end"))


def bucket_of(date: Column, period: Column) -> Column:
    """The date of the bucket that a date falls in: the day, the week's Monday, the month's first; LIVE has one fixed date."""
    cut = lambda u: F.to_date(F.date_trunc(u, date))
    return F.when(period == "DAILY", date.cast("date")).when(period == "WEEKLY", cut("week")).when(period == "MONTHLY", cut("month")).when(period == "LIVE", F.lit(LIVE_DATE).cast("date"))


def valid_date(text: Column) -> Column:
    """Whether a text is a date that exists, as YYYY-MM-DD."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def valid_instant(text: Column) -> Column:
    """Whether a text is a strict RFC 3339 instant of a day that exists, offset included."""
    return F.coalesce(text.rlike(_RFC3339) & F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").isNotNull(), F.lit(False))


def day_in_zone(instant: Column, zone: Column) -> Column:
    """The day of an instant in a zone, as text; an unknown or null zone counts as UTC."""
    known = sorted(z for z in available_timezones() if "/" in z or z == "UTC")
    return F.date_format(F.from_utc_timestamp(instant.cast("string"), F.when(zone.isin(known), zone).otherwise("UTC")), "yyyy-MM-dd")


def epoch_micros(instant: Column) -> Column:
    return F.unix_micros(instant.cast("string").cast("timestamp"))


def year_buckets(spark: SparkSession, year: int) -> DataFrame:
    """(kind, bucket) of a year: its days, its months' firsts, and the Mondays that lie in it."""
    first, last = F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date")
    days = spark.range(1).select(F.explode(F.sequence(first, last)).alias("bucket"))
    kinds = F.array(F.lit("day"), F.when(F.dayofweek("bucket") == 2, "week"), F.when(F.dayofmonth("bucket") == 1, "month"))
    return days.select(F.explode(F.array_compact(kinds)).alias("kind"), "bucket")


def buckets_of_years(years: DataFrame) -> DataFrame:
    """``year_buckets`` of each row's year (columns year, kind, bucket)."""
    days = years.select("year", F.explode(F.sequence(F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31)))).alias("bucket"))
    kinds = F.array(F.lit("day"), F.when(F.dayofweek("bucket") == 2, "week"), F.when(F.dayofmonth("bucket") == 1, "month"))
    return days.select("year", F.explode(F.array_compact(kinds)).alias("kind"), "bucket")


def days_of_views(rows: DataFrame, view: str, today: str) -> DataFrame:
    """The days that each row's viewport shows (a month, a year, or today's month for anything else)."""
    text = F.col(view)
    year = F.coalesce(text.rlike(r"^[0-9]{4}$"), F.lit(False))
    month = F.when(F.coalesce(text.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$"), F.lit(False)), text).otherwise(today[:7])
    first = F.when(year, F.concat(text, F.lit("-01-01"))).otherwise(F.concat(month, F.lit("-01"))).cast("date")
    last = F.when(year, F.concat(text, F.lit("-12-31")).cast("date")).otherwise(F.last_day(first))
    return rows.withColumn("bucket", F.explode(F.sequence(first, last)))


def viewport(text: str | None, today: str) -> tuple[str, str]:
    """The month or year that a calendar shows: ("month", "2024-02") or ("year", "2024"); today's month for anything else."""
    if text and len(text) == 7 and text[:4].isdigit() and text[4] == "-" and text[5:].isdigit() and 1 <= int(text[5:]) <= 12:
        return "month", text
    if text and len(text) == 4 and text.isdigit():
        return "year", text
    return "month", today[:7]


def moved(view: tuple[str, str], by: int) -> tuple[str, str]:
    """The viewport ``by`` months or years on."""
    kind, text = view
    if kind == "year":
        return kind, f"{int(text) + by:04}"
    months = int(text[:4]) * 12 + int(text[5:]) - 1 + by
    return kind, f"{months // 12:04}-{months % 12 + 1:02}"


def viewport_days(spark: SparkSession, view: tuple[str, str]) -> DataFrame:
    """The days that a viewport shows."""
    kind, text = view
    first = F.lit(f"{text}-01" if kind == "month" else f"{text}-01-01").cast("date")
    last = F.last_day(first) if kind == "month" else F.lit(f"{text}-12-31").cast("date")
    return spark.range(1).select(F.explode(F.sequence(first, last)).alias("bucket"))
