from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def to_number(value: Column) -> Column:
    """The value as a double, NULL where it is no number."""
    return value.try_cast("double")


def utc_day(moment: Column | str) -> Column:
    """The UTC date of a timestamp, whatever the zone of the session."""
    micros = F.unix_micros(moment)
    return F.date_from_unix_date(((micros - F.pmod(micros, F.lit(DAY_MICROS))) / DAY_MICROS).cast("int"))


def utc_midnight(day: date) -> Column:
    """The timestamp at which a UTC date begins, as a literal."""
    return F.lit(datetime(day.year, day.month, day.day, tzinfo=timezone.utc))


def to_second(moment: Column) -> Column:
    """A timestamp without its fraction of a second."""
    return F.date_trunc("second", moment)
