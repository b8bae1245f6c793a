"""Readers, writers and the derived input tables."""
from spreadforge.sources.market import (  # noqa: F401
    csv_roundtrip, drop_index_column, load_market_data, table_profile, write_table,
)
from spreadforge.sources.fixtures import (  # noqa: F401
    dirty_panel, event_bins, market_panel, scored_rows, supplier_daily,
)
