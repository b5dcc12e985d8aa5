"""Instants, local calendar fields and calendar labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearlog.vocabulary import DAY_PARTS, MONTH_LABELS, NIGHT, NIGHT_FROM, WEEKDAY_NAMES

EXPORT_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def export_instant(ts: Column) -> Column:
    """Instant of an export's UTC time text; null when it does not parse."""
    return F.try_to_timestamp(ts, F.lit(EXPORT_TIME_FORMAT))


def calendar_fields(instant: Column, zone: str) -> dict[str, Column]:
    local = F.from_utc_timestamp(instant, zone)
    return {
        "year": F.year(local),
        "month": F.month(local),
        "day": F.dayofmonth(local),
        "hour": F.hour(local),
        "weekday": F.dayofweek(local),
    }


def literal_map(names: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def weekday_name(weekday: Column) -> Column:
    return F.try_element_at(literal_map(WEEKDAY_NAMES), weekday)


def month_label(month: Column) -> Column:
    return F.try_element_at(literal_map(MONTH_LABELS), month)


def day_part(hour: Column) -> Column:
    part = F.when(hour >= NIGHT_FROM, NIGHT)
    for first_hour, name in reversed(DAY_PARTS):
        part = part.when(hour >= first_hour, name)
    return part.otherwise(NIGHT)


def week_label(year: Column, month: Column, day: Column, iso_year: bool = False) -> Column:
    """``yyyy-Www``: ISO week number under the calendar year, or under the ISO year."""
    date = F.make_date(year, month, day)
    shown_year = F.extract(F.lit("YEAROFWEEK"), date) if iso_year else year
    return F.concat(shown_year.cast("string"), F.lit("-W"),
                    F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def month_key(year: Column, month: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def ten_minute_bucket(ms: Column) -> Column:
    return (F.floor(ms / 600_000) * 10).cast("int")
