"""Date and time column helpers. Timestamps are UTC without a zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from parasol.constants import AQI_SEASON_MONTHS, MONSOON_MONTHS
from parasol.functions.numeric import as_col


def micros(ts) -> Column:
    """Microseconds since the epoch as a long, the order key of all time frames."""
    return F.unix_micros(as_col(ts).cast("timestamp"))


def at_literal(moment) -> Column:
    """A Python datetime as a zone-less literal, whatever the driver's own zone."""
    return F.lit(f"{moment:%Y-%m-%d %H:%M:%S.%f}").cast("timestamp_ntz")


def seconds_between(later, earlier) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def date_key(ts) -> Column:
    c = as_col(ts)
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int")


def day_text(ts) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM-dd")


def is_monsoon(month) -> Column:
    return as_col(month).isin(MONSOON_MONTHS)


def is_aqi_season(month) -> Column:
    return as_col(month).isin(AQI_SEASON_MONTHS)


def ist_hour(ts) -> Column:
    """Indian hour as the domain defines it: five whole hours ahead of UTC."""
    return (F.hour(as_col(ts)) + 5) % 24


def is_odd_hour(ts) -> Column:
    return ist_hour(ts).between(2, 5)


def part_of_day(hour) -> Column:
    h = as_col(hour)
    return (
        F.when(h < 5, "Night").when(h < 12, "Morning").when(h < 17, "Afternoon")
        .when(h < 21, "Evening").otherwise("Night")
    )


def parse_iso(text, fallback=None) -> Column:
    """ISO text with an optional trailing Z; unparsable text gives the fallback."""
    parsed = F.try_to_timestamp(F.regexp_replace(as_col(text), "Z$", "")).cast("timestamp_ntz")
    return parsed if fallback is None else F.coalesce(parsed, as_col(fallback))


def iso_text(ts) -> Column:
    return F.concat(F.date_format(as_col(ts), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def date_attributes(ts) -> list[Column]:
    """Attributes of the date dimension, in table order."""
    c = as_col(ts)
    return [
        date_key(c).alias("date_key"),
        day_text(c).alias("date"),
        F.date_format(c, "E").alias("day_of_week"),
        (F.weekday(c) + 1).cast("int").alias("day_num"),
        F.month(c).alias("month"),
        F.date_format(c, "MMM").alias("month_name"),
        F.quarter(c).alias("quarter"),
        F.year(c).alias("year"),
        (F.weekday(c) >= 5).alias("is_weekend"),
        is_monsoon(F.month(c)).alias("is_monsoon"),
    ]
