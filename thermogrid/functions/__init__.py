from .calendar import (
    cyclic_calendar, day_of_common_year, future_hours, hour_of_year, label_of_hour_of_year, parse_timestamp,
)
from .measures import (
    above_other, clamp_to, diurnal_profile, in_range, is_plain_number, null_if_nan, out_of_range, parse_celsius,
    parse_encoded, wind_components,
)

__all__ = [
    "above_other", "clamp_to", "cyclic_calendar", "day_of_common_year", "diurnal_profile", "future_hours",
    "hour_of_year", "in_range", "is_plain_number", "label_of_hour_of_year", "null_if_nan", "out_of_range",
    "parse_celsius", "parse_encoded", "parse_timestamp", "wind_components",
]
