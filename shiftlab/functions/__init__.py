"""Column expressions shared by the operators; all stay inside whole-stage code generation."""

from shiftlab.functions.dates import (
    compact_date,
    cutoff_day,
    day_number,
    holiday_week_status,
)
from shiftlab.functions.handles import cohort_letter, slot_text, time_slot
from shiftlab.functions.postcodes import zone_extended, zone_simple

__all__ = [
    "cohort_letter",
    "compact_date",
    "cutoff_day",
    "day_number",
    "holiday_week_status",
    "slot_text",
    "time_slot",
    "zone_extended",
    "zone_simple",
]
