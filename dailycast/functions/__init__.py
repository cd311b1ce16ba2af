"""Scalar column functions (calendar, money, arrays)."""

from dailycast.functions.columns import (  # noqa: F401
    add_days,
    epoch_micros,
    from_epoch_micros,
    ntz_literal,
    calendar_struct,
    day_spine,
    day_start,
    is_weekend,
    iso_string,
    last_n,
    mean_of,
    money,
    month_string,
    safe_ratio,
)
