"""DataFrame-to-DataFrame operators. Amounts are decimals throughout, so totals are exact in any order."""

from ledgerline.operators.fiscal import anchor_month, future_months
from ledgerline.operators.forecast import baseline, baseline_average, spread_runrate
from ledgerline.operators.lookups import add_lookups
from ledgerline.operators.merge import expand_copies, merge_facts, one_row_per_key
from ledgerline.operators.opportunities import (
    accepted_amounts,
    clean_opportunities,
    extrapolate,
    future_opportunities,
    live_opportunities,
    opportunity_detail,
    opportunity_monthly,
    rejected_amounts,
)
from ledgerline.operators.profile import (
    distinct_values,
    merge_profiles,
    peek,
    profile_sketches,
    read_profile,
    sample_rows,
)
from ledgerline.operators.revenue import (
    align_revenue,
    bucket_category,
    rename_revenue,
    revenue_lines,
    revenue_monthly,
    split_measures,
)
from ledgerline.operators.rules import categorize_by_rules
from ledgerline.operators.targets import align_targets, rename_targets

__all__ = [
    "accepted_amounts", "add_lookups", "align_revenue", "align_targets", "anchor_month", "baseline", "baseline_average",
    "bucket_category", "categorize_by_rules", "clean_opportunities", "distinct_values", "expand_copies", "extrapolate",
    "future_months", "future_opportunities", "live_opportunities", "merge_facts", "one_row_per_key",
    "merge_profiles", "opportunity_detail", "opportunity_monthly", "peek", "profile_sketches", "read_profile", "rejected_amounts", "rename_revenue", "rename_targets", "revenue_lines", "sample_rows",
    "revenue_monthly", "split_measures", "spread_runrate",
]
