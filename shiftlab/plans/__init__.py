"""The five analyses, composed from operators."""

from shiftlab.plans.comparison import comparison_input, control_report
from shiftlab.plans.impact_table import shift_impact_table
from shiftlab.plans.order_study import OrderStudy, holiday_order_rates
from shiftlab.plans.status_study import (
    HolidayStudy,
    holiday_status_rates,
    holiday_status_rates_by_option,
)

__all__ = [
    "HolidayStudy",
    "OrderStudy",
    "comparison_input",
    "control_report",
    "holiday_order_rates",
    "holiday_status_rates",
    "holiday_status_rates_by_option",
    "shift_impact_table",
]
