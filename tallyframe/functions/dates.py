"""Date intervals and their labels, whose text order is the order in time.

All is done on zone-less values, so that a label does not depend on the session's time zone.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, functions as F

from tallyframe.functions.numeric import as_column

# How many characters of ``yyyy-MM-dd HH:mm:ss`` name an interval.
LABEL_LENGTHS = {"minute": 16, "hour": 13, "day": 10, "week": 10, "month": 7, "year": 4}


def interval(c: Column | str, granularity: str) -> Column | None:
    """The interval a cell falls in, as a compact grouping key; None for an unknown granularity.

    Days and longer are the first date of the interval (Monday for a week), so that no text
    is built per row; hours and minutes are the start of the moment's text.
    """
    if granularity not in LABEL_LENGTHS:
        warnings.warn(f"unknown date granularity ignored: {granularity!r}", stacklevel=2)
        return None
    moment = as_column(c).try_cast("timestamp_ntz")
    if granularity in ("minute", "hour"):
        return F.left(moment.cast("string"), F.lit(LABEL_LENGTHS[granularity]))
    day = moment.cast("date")
    return day if granularity == "day" else F.trunc(day, granularity)


def interval_label(key: Column, granularity: str) -> Column:
    """Label of an interval key."""
    if granularity == "hour":
        return F.concat(key, F.lit(":00"))
    return F.left(key.cast("string"), F.lit(LABEL_LENGTHS[granularity]))


def date_label(c: Column | str, granularity: str) -> Column | None:
    """Label of the interval a cell falls in."""
    key = interval(c, granularity)
    return None if key is None else interval_label(key, granularity)
