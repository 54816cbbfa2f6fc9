"""Sources, sinks and inspection (read/bind tables, write stages, profile)."""

from sparkjourney.sources.readers import (  # noqa: F401
    read_table, read_clickstream_csv, bind_events, bind_orders, bind_order_lines,
    clickstream_to_events, quarantine_counts, read_clickstream_checked, with_defaults, with_event_ids, require_columns,
)
from sparkjourney.sources.writers import (  # noqa: F401
    write_stage, write_by_cluster, export_cluster, save_model, load_model,
)
from sparkjourney.sources.profile import profile, null_profile, table_profile  # noqa: F401
