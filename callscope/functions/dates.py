"""Dates of calls as they are printed, read and split."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("d-MMM-yy h:mma z", "d-MMM-yy h:mma", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "d-MMM-yy", "MM-dd-yyyy", "M/d/yyyy")


def call_time(text: Column) -> Column:
    """A timestamp in any of FORMATS; null where none fits."""
    loud = F.regexp_replace(text, r"(?i)(am|pm)", "$1")
    return F.coalesce(*[F.try_to_timestamp(F.regexp_replace(F.regexp_replace(loud, r"(?i)am\b", "AM"), r"(?i)pm\b", "PM"), F.lit(f)) for f in FORMATS])


def gmt(text: Column) -> Column:
    """Written as 21-Dec-16 01:00PM GMT; as it was where it can't be read."""
    return F.coalesce(F.date_format(call_time(text), "dd-MMM-yy hh:mma 'GMT'"), text)


def day_and_time(text: Column) -> tuple[Column, Column]:
    """ISO day and time of day; where the date can't be read, what is before and after the first space."""
    t, cut = call_time(text), F.split(text, " ", 2)
    return F.coalesce(F.date_format(t, "yyyy-MM-dd"), F.get(cut, 0)), F.coalesce(F.date_format(t, "HH:mm:ss"), F.get(cut, 1), F.lit(""))


def cut_day_and_time(text: Column) -> tuple[Column, Column]:
    cut = F.split(text, " ", 2)
    return F.get(cut, 0), F.coalesce(F.get(cut, 1), F.lit(""))


def quarter_and_year(title: Column) -> tuple[Column, Column]:
    at = r"(Q[1-4])\s+(\d{4})"
    return F.nullif(F.regexp_extract(title, at, 1), F.lit("")), F.nullif(F.regexp_extract(title, at, 2), F.lit(""))


def upload_date(text: Column) -> Column:
    """ISO time in UTC of what a remote table takes, whatever zone is named; null where none of its three formats fits.

    Two digits of a year from 69 on are of the last century.
    """
    bare = F.trim(F.regexp_replace(text, r" (GMT|[ECP][SD]T)", ""))
    loud = F.upper(F.regexp_replace(bare, r"(?i)\s*([ap]m)$", "$1"))
    t = F.coalesce(*[F.try_to_timestamp(_titled(loud), F.lit(f)) for f in ("d-MMM-yy h:mma", "d-MMM-yy H:mm")])
    t = F.when(F.year(t) > 2068, F.add_months(F.to_date(t), -1200).cast("timestamp") + (t - F.date_trunc("day", t))).otherwise(t)
    return F.when(F.length(bare) > 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))


def _titled(loud: Column) -> Column:
    """25-JUL-02 01:15PM as 25-Jul-02 01:15PM."""
    return F.concat(F.regexp_extract(loud, r"^(\d+-[A-Z]?)", 1), F.lower(F.regexp_extract(loud, r"^\d+-[A-Z]([A-Z]*)", 1)), F.regexp_replace(loud, r"^\d+-[A-Z]*", ""))


def run_stamp() -> str:
    """The driver's time, as names of runs have it."""
    from datetime import datetime

    return datetime.now().strftime("%Y%m%d_%H%M%S")
