"""Text expressions over option handles and cohort labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text patterns the handles and labels follow.
HANDLE_SLOT = r"(\d{4}-\d{4})"
COHORT_LETTER = r"(?U)Cohort (\w)"


def time_slot(handle: Column) -> Column:
    """The ``dddd-dddd`` slot inside an option handle, ``''`` when it has none."""
    return F.regexp_extract(handle, HANDLE_SLOT, 1)


def slot_text(start_time: Column, end_time: Column) -> Column:
    """``HH:MM-HH:MM`` from an option's opening and closing time; NULL if either is missing."""
    return F.concat(F.left(start_time, F.lit(5)), F.lit("-"), F.left(end_time, F.lit(5)))


def cohort_letter(label: Column) -> Column:
    """``Cohort B (-1)`` -> ``B``; NULL for labels of another form."""
    return F.nullif(F.regexp_extract(label, COHORT_LETTER, 1), F.lit(""))
