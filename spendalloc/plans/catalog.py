"""All registered queries with their SQL equivalents."""

from . import landing, names, reports, settlement, streams

# module -> query names; a query has an SQL twin when the upper-case name exists.
_MODULES = [
    (settlement, ["asof_site", "latest_site", "center_resolve", "missing_sites", "share_allocate",
                  "remainder_settle", "pool_split", "pool_bridge", "control_close", "control_totals", "detail_check",
                  "dedup_exact", "dedup_suspects", "dedup_overlap"]),
    (names, ["name_keys", "clean_text", "surname_forms", "token_stats", "roster_profile", "secondary_profile",
             "exact_match", "subset_join", "unjoined_names", "known_identities", "secondary_match", "family",
             "translit", "prefix", "fuzzy", "cascade_methods", "person_search", "unmatched_causes", "ledger_feed",
             "ledger_report", "bridge_derive", "alias_derive", "ledger_merge", "bridge_summary"]),
    (reports, ["center_rollup", "top_centers", "company_rollup", "allocation_totals", "allocation_table", "line_table",
               "run_summary", "label_summary", "cover_counts", "center_table", "review_queue", "suggest_map", "coverage",
               "compare_runs", "align", "accuracy", "route_rule", "company_mismatch", "release_gate"]),
    (landing, ["header_resolve", "cells_to_lines", "repeat_sheets", "quoted_cells", "content_dedup", "same_name", "registers",
               "parse_values", "parse_ids", "parse_labels", "travel_ledger", "assessment", "invoice_fields",
               "message_items", "attendance"]),
    (streams, ["stream_once", "stream_control", "stream_resolve"]),
]

QUERIES = {name: getattr(module, name) for module, names in _MODULES for name in names}
ORACLES = {name: getattr(module, name.upper()) for module, names in _MODULES for name in names
           if hasattr(module, name.upper())}
