"""Column-expression helpers (all JVM-side, codegen friendly; no Python UDFs)."""

from sparkjourney.functions.time import (  # noqa: F401
    seconds_between, minutes_between, whole_days_between, weekday_mon0,
    timestamp_from_parts, parse_timestamp, epoch_seconds,
)
from sparkjourney.functions.scalar import (  # noqa: F401
    threshold_flag, regex_flag, pct, null_safe, relabel, lookup,
)
