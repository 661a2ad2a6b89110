from ledgerline.sources.calendars import fiscal_calendar, small_calendar
from ledgerline.sources.catalog import ignoring_case, read_tables, tables_from_catalog
from ledgerline.sources.sinks import save_summary, update_summary, write_summary
from ledgerline.sources.snapshots import (
    previous_week,
    read_snapshots,
    save_bucketed_week,
    scan_weeks,
    snapshots_from_catalog,
    weekly_snapshots,
    write_week,
)
from ledgerline.sources.tpch import tables_from_tpch

__all__ = [
    "fiscal_calendar",
    "ignoring_case",
    "previous_week",
    "read_snapshots",
    "read_tables",
    "save_bucketed_week",
    "save_summary",
    "scan_weeks",
    "small_calendar",
    "snapshots_from_catalog",
    "tables_from_catalog",
    "tables_from_tpch",
    "update_summary",
    "weekly_snapshots",
    "write_summary",
    "write_week",
]
