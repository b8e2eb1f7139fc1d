"""Every registered query by name."""

from __future__ import annotations

from harrow.sources import registry

from . import feed_queries, grouping, oracle, oracle_feeds, oracle_helpers, oracle_state, read_models, scalars, state_queries

_NAMED = {
    read_models: (
        "inbox_list inbox_count inbox_filtered_recent inbox_by_source_kind score_masked rejected_recent reject_reason_histogram "
        "reject_first_reason near_misses rule_results score_levels dry_run companies_overview sources_overview source_runs_latest "
        "window_totals usage nav_counts pipeline_by_status due_followups status_transitions triage_next"
    ),
    grouping: (
        "dedupe_first_seen hash_duplicates exact_key_latest fuzzy_pairs part_pairs canonical_pick cluster_rollup republished_lineage "
        "company_priority_lookup triage_merge cdc_classes run_counters upserted cursor_overlap_union set_differences due_sources "
        "backoff_next_run retention_split check_violations json_props scheduled_windows"
    ),
    scalars: (
        "classified contract_labels salaries folded_documents normalized_titles normalized_companies html_texts page_links page_domains "
        "canonical_urls page_keys document_emails generic_contacts board_sources text_helpers time_helpers contact_pages mail_links robots"
    ),
    state_queries: state_queries.NAMES,
    feed_queries: "board_configs page_boards seed_sources captured window_halves quarantined",
}

QUERIES = {name: getattr(module, name) for module, names in _NAMED.items() for name in names.split()} | {
    "content_hash": grouping.content_hashes,
    "closures_full": grouping.closures(complete=True),
    "closures_deferred": grouping.closures(complete=False),
}
QUERIES |= {f"feed_{kind}": getattr(feed_queries, kind) for kind in registry.ADAPTERS}

#: DuckDB SQL for the same rows.
SQL = oracle.SQL | oracle_feeds.SQL | oracle_state.SQL | oracle_helpers.SQL
