"""Column-expression builders (all JVM-side, no Python UDFs)."""
from spreadforge.functions.scalar import (  # noqa: F401
    clip, col, normalise_missing, row_mean, row_range, row_std, safe_div, sign_int,
)
from spreadforge.functions.calendar import (  # noqa: F401
    add_calendar, add_clock_parts, add_cyclical, parse_market_time,
)
from spreadforge.functions.selection import build_xcols  # noqa: F401
