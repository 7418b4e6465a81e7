"""Rules and fixes as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Rule, severity, status on a hit, operator that finds the hits.
_RULES = """
LH-001 HIGH FAIL status_health
LH-002 LOW WARN naming_audit
LH-003 HIGH FAIL inventory_counts
LH-004 MEDIUM WARN maintenance_history
LH-005 MEDIUM WARN row_count_classes
LH-006 MEDIUM WARN oversized_strings
LH-007 HIGH FAIL key_candidates
LH-008 MEDIUM WARN float_exactness
LH-009 LOW WARN naming_audit
LH-010 MEDIUM FAIL date_as_text
LH-011 MEDIUM FAIL number_as_text
LH-012 LOW WARN wide_tables
LH-013 MEDIUM WARN null_share
LH-014 LOW WARN audit_columns
LH-015 LOW WARN mixed_types
LH-016 MEDIUM WARN large_unpartitioned
LH-017 MEDIUM WARN maintenance_history
LH-018 MEDIUM WARN maintenance_history
LH-019 HIGH FAIL small_files
LH-020 MEDIUM WARN property_audit
LH-021 LOW WARN property_audit
LH-022 LOW WARN version_count
LH-023 MEDIUM WARN write_amplification
LH-024 LOW WARN property_audit
LH-025 MEDIUM WARN maintenance_history
LH-026 MEDIUM WARN property_audit
LH-027 LOW WARN change_feed_gap
LH-028 LOW WARN property_audit
LH-029 LOW WARN property_audit
LH-030 LOW WARN property_audit
LH-031 LOW WARN legacy_or_nested_types
LH-S01 HIGH WARN sensitive_content
LH-S02 INFO PASS row_count_classes
LH-S03 HIGH FAIL legacy_or_nested_types
LH-S04 MEDIUM WARN key_candidates
WH-001 HIGH FAIL key_candidates
WH-002 HIGH FAIL legacy_or_nested_types
WH-003 MEDIUM WARN float_exactness
WH-004 MEDIUM WARN oversized_strings
WH-005 LOW WARN naming_audit
WH-006 LOW WARN naming_audit
WH-007 LOW WARN pattern_audit
WH-008 MEDIUM FAIL stale_statistics
WH-009 MEDIUM WARN orphan_rows
WH-010 HIGH FAIL key_candidates
WH-011 MEDIUM WARN row_count_classes
WH-012 MEDIUM WARN wide_tables
WH-013 LOW WARN mixed_types
WH-014 MEDIUM WARN fk_discovery
WH-015 MEDIUM WARN blob_columns
WH-016 LOW WARN audit_columns
WH-017 HIGH FAIL reciprocal_edges
WH-018 HIGH FAIL unmasked_sensitive
WH-019 MEDIUM WARN property_audit
WH-020 MEDIUM WARN excess_members
WH-021 LOW WARN node_degree
WH-022 LOW WARN cross_group_edges
WH-023 HIGH FAIL slow_queries
WH-024 HIGH FAIL frequent_queries
WH-025 MEDIUM WARN failed_queries
WH-026 HIGH FAIL property_audit
WH-027 MEDIUM WARN property_audit
WH-028 MEDIUM WARN property_audit
WH-029 MEDIUM WARN property_audit
WH-030 LOW WARN property_audit
WH-031 HIGH FAIL status_health
WH-032 MEDIUM WARN stale_statistics
WH-033 MEDIUM WARN oversized_strings
WH-034 LOW WARN row_count_classes
WH-035 LOW WARN missing_metadata
WH-036 MEDIUM WARN not_null_defaults
WH-037 LOW WARN mixed_types
WH-038 LOW WARN missing_metadata
WH-039 MEDIUM WARN recent_health
WH-040 HIGH FAIL property_audit
WH-041 MEDIUM WARN property_audit
WH-042 LOW WARN computed_share
WH-043 LOW WARN pattern_audit
WH-044 LOW WARN fk_skew
EH-001 HIGH FAIL status_health
EH-002 HIGH FAIL extent_fragmentation
EH-003 MEDIUM WARN compression_ratio
EH-004 MEDIUM WARN property_audit
EH-005 MEDIUM WARN property_audit
EH-006 HIGH FAIL view_freshness
EH-007 MEDIUM WARN data_freshness
EH-008 HIGH FAIL command_profile
EH-009 MEDIUM WARN failed_queries
EH-010 HIGH FAIL ingestion_failures
EH-011 INFO PASS stream_candidates
EH-012 MEDIUM WARN view_freshness
EH-013 MEDIUM WARN hot_cold
EH-014 LOW WARN property_audit
EH-015 INFO PASS property_audit
EH-016 MEDIUM WARN large_unpartitioned
EH-017 LOW PASS property_audit
EH-018 MEDIUM WARN compression_ratio
EH-019 LOW PASS property_audit
EH-020 INFO PASS inventory_counts
EH-021 MEDIUM WARN property_audit
EH-022 LOW WARN property_audit
EH-023 INFO PASS property_audit
EH-024 LOW WARN stream_candidates
EH-025 MEDIUM WARN view_freshness
EH-026 INFO PASS command_profile
EH-027 MEDIUM WARN ingestion_latency
SM-001 MEDIUM WARN pattern_audit
SM-002 MEDIUM WARN pattern_audit
SM-003 HIGH FAIL pattern_audit
SM-004 MEDIUM WARN pattern_audit
SM-005 LOW WARN normalized_duplicates
SM-006 MEDIUM WARN pattern_audit
SM-007 LOW WARN pattern_audit
SM-008 LOW PASS missing_metadata
SM-009 HIGH WARN inventory_counts
SM-010 MEDIUM WARN naming_audit
SM-011 MEDIUM WARN pattern_audit
SM-012 LOW WARN alias_records
SM-013 MEDIUM WARN occurrence_audit
SM-014 LOW WARN pattern_audit
SM-015 LOW WARN missing_metadata
SM-016 MEDIUM WARN pattern_audit
SM-017 LOW WARN naming_audit
SM-018 LOW WARN inventory_counts
SM-021 MEDIUM WARN edge_flags
SM-022 MEDIUM WARN edge_flags
SM-023 MEDIUM WARN disconnected_nodes
SM-024 LOW WARN pattern_audit
SM-025 LOW WARN occurrence_audit
SM-026 LOW WARN node_degree
SM-027 LOW WARN edge_flags
SM-028 LOW WARN missing_metadata
SM-029 INFO PASS pseudo_hierarchies
SM-B01 HIGH FAIL high_card_text
SM-B02 HIGH FAIL free_text_columns
SM-B03 HIGH FAIL guid_columns
SM-B04 MEDIUM WARN constant_columns
SM-B05 MEDIUM WARN bool_as_text
SM-B06 MEDIUM WARN date_as_text
SM-B07 MEDIUM WARN number_as_text
SM-B08 MEDIUM WARN string_keys
SM-B09 MEDIUM WARN wide_tables
SM-B10 HIGH FAIL wide_tables
SM-B11 HIGH FAIL many_high_card
SM-B12 LOW WARN wide_tables
SM-B13 MEDIUM WARN high_precision_ts
SM-B14 LOW WARN low_card_in_fact
GW-001 HIGH FAIL status_health
GW-002 MEDIUM WARN version_check
GW-003 MEDIUM WARN unused_parents
GW-004 LOW WARN unused_parents
GW-005 HIGH FAIL status_health
GW-006 MEDIUM WARN excess_members
GW-007 MEDIUM WARN missing_metadata
GW-008 LOW WARN orphan_rows
GW-009 HIGH FAIL missing_metadata
GW-010 LOW WARN duplicate_records
GW-011 LOW WARN missing_metadata
GW-012 LOW WARN missing_metadata
"""

RULES = [tuple(line.split()) for line in _RULES.strip().splitlines()]

# What to do about the findings of an operator.
ADVICE = {
    "alias_records": "Drop records that only repeat another record's name.",
    "audit_columns": "Add created_at and updated_at.",
    "blob_columns": "Move very long values to a table of their own.",
    "bool_as_text": "Store the flag as a boolean.",
    "change_feed_gap": "Turn the change feed on for large tables.",
    "command_profile": "Look at the command types with a high average.",
    "compression_ratio": "Set an encoding for poorly compressed columns.",
    "computed_share": "Materialise computed columns where they are read often.",
    "constant_columns": "Drop the column or keep the value as a parameter.",
    "cross_group_edges": "Keep dependencies inside one group.",
    "data_freshness": "Check the load of the stale entities.",
    "date_as_text": "Store dates as dates.",
    "disconnected_nodes": "Link the node or remove it.",
    "duplicate_records": "Keep one record per key.",
    "edge_flags": "Prefer single-direction, active, explicit relationships.",
    "excess_members": "Reduce the number of privileged members.",
    "extent_fragmentation": "Merge small extents.",
    "failed_queries": "Fix the most frequent failure classes.",
    "fk_discovery": "Declare the references that the data already satisfies.",
    "fk_skew": "Cluster by the reference column and expect skewed joins.",
    "float_exactness": "Store exact amounts as decimals.",
    "free_text_columns": "Keep free text out of analytical tables.",
    "frequent_queries": "Tune or cache the frequent slow queries.",
    "guid_columns": "Use integer surrogate keys.",
    "high_card_text": "Drop the column or move it to a lookup table.",
    "high_precision_ts": "Truncate or split timestamps.",
    "hot_cold": "Lengthen the hot period or accept slower reads.",
    "ingestion_failures": "Fix the failing ingests.",
    "ingestion_latency": "Ingest the entity more often.",
    "inventory_counts": "Convert items to the standard format.",
    "key_candidates": "Declare a key and make it not null.",
    "large_unpartitioned": "Partition the table by a commonly filtered column.",
    "legacy_or_nested_types": "Replace deprecated types and flatten nested ones where needed.",
    "low_card_in_fact": "Move the attribute to a dimension.",
    "maintenance_history": "Compact and vacuum regularly.",
    "many_high_card": "Review columns with very many values.",
    "missing_metadata": "Fill in the missing descriptions, formats or names.",
    "mixed_types": "Use one type per purpose.",
    "naming_audit": "Use letters, digits and underscores in names.",
    "node_degree": "Split entities with too many relationships.",
    "normalized_duplicates": "Keep one of the identical definitions.",
    "not_null_defaults": "Give NOT NULL columns a default.",
    "null_share": "Declare columns NOT NULL where the data allows.",
    "number_as_text": "Store numbers as numbers.",
    "occurrence_audit": "Flatten repeated calls.",
    "orphan_rows": "Remove or repair rows without a parent.",
    "oversized_strings": "Declare realistic text lengths.",
    "pattern_audit": "Rewrite the expression.",
    "property_audit": "Set the property to the expected value.",
    "pseudo_hierarchies": "Review hierarchies with very few levels.",
    "recent_health": "Look into the recent slowdown.",
    "reciprocal_edges": "Break the circular reference.",
    "row_count_classes": "Review empty and nearly empty tables.",
    "sensitive_content": "Protect personal data.",
    "slow_queries": "Tune the slowest queries.",
    "small_files": "Compact small files.",
    "stale_statistics": "Refresh statistics.",
    "status_health": "Bring the entity back to a healthy state.",
    "stream_candidates": "Ingest high-volume entities as a stream.",
    "string_keys": "Use integer keys.",
    "unmasked_sensitive": "Mask sensitive columns.",
    "unused_parents": "Remove entries nothing refers to.",
    "version_check": "Update to a supported version.",
    "version_count": "Write checkpoints and clean the log.",
    "view_freshness": "Refresh or repair the view.",
    "wide_tables": "Split or trim the table.",
    "write_amplification": "Prefer appends or clustering.",
}

# Setting rules, as (rule, entity kind, key, test, expected value, value when unset).
SETTING_RULES = [
    ("LH-020", "table", "delta.autoOptimize.optimizeWrite", "=", "true", "false"),
    ("LH-021", "table", "delta.logRetentionDuration|delta.deletedFileRetentionDuration", "set", None, None),
    ("LH-024", "table", "delta.dataSkippingNumIndexedCols", "!=", "0", "0"),
    ("LH-026", "table", "delta.parquet.vorder.enabled", "=", "true", "false"),
    ("LH-027", "table", "delta.enableChangeDataFeed", "=", "true", "false"),
    ("LH-028", "table", "delta.columnMapping.mode", "!=", "none", "none"),
    ("LH-029", "table", "delta.enableDeletionVectors", "=", "true", "false"),
    ("LH-030", "table", "delta.checkpointInterval", "<=", "50", "10"),
    ("WH-019", "database", "security_policy", "set", None, None),
    ("WH-026", "database", "is_auto_update_stats_on", "=", "true", "false"),
    ("WH-027", "database", "is_result_set_caching_on", "=", "true", "false"),
    ("WH-028", "database", "snapshot_isolation_state", "=", "true", "false"),
    ("WH-029", "database", "page_verify_option_desc", "=", "checksum", "none"),
    ("WH-030", "database", "is_ansi_nulls_on", "=", "true", "false"),
    ("WH-030", "database", "is_ansi_padding_on", "=", "true", "false"),
    ("WH-030", "database", "is_ansi_warnings_on", "=", "true", "false"),
    ("WH-030", "database", "is_arithabort_on", "=", "true", "false"),
    ("WH-030", "database", "is_quoted_identifier_on", "=", "true", "false"),
    ("WH-040", "database", "is_auto_create_stats_on", "=", "true", "false"),
    ("WH-041", "database", "is_query_store_on", "=", "true", "false"),
    ("EH-004", "database", "caching_policy", "set", None, None),
    ("EH-005", "database", "retention_policy", "set", None, None),
    ("EH-014", "store", "ingestion_batching_policy", "set", None, None),
    ("EH-015", "store", "update_policy", "set", None, None),
    ("EH-017", "store", "merge_policy", "set", None, None),
    ("EH-019", "store", "row_order_policy", "set", None, None),
    ("EH-021", "database", "autocompaction_policy", "set", None, None),
    ("EH-022", "database", "extent_tags_retention_policy", "set", None, None),
    ("EH-023", "store", "sharding_policy", "set", None, None),
]

_SET = "ALTER TABLE {target} SET TBLPROPERTIES ("
# Fixed values: (fix, rule, in the default subset, command). A command that starts with
# "transform:" names the operator that writes the repaired copy.
FIXES = [
    ("auto-optimize", "LH-020", True, _SET + "'delta.autoOptimize.optimizeWrite' = 'true', 'delta.autoOptimize.autoCompact' = 'true')"),
    ("retention", "LH-021", True, _SET + "'delta.logRetentionDuration' = 'interval 30 days', 'delta.deletedFileRetentionDuration' = 'interval 7 days')"),
    ("data-skipping", "LH-024", True, _SET + "'delta.dataSkippingNumIndexedCols' = '32')"),
    ("audit-columns", "LH-014", False, "transform:add_audit_columns {target}"),
    ("v-order", "LH-026", False, _SET + "'delta.parquet.vorder.enabled' = 'true')"),
    ("change-data-feed", "LH-027", False, _SET + "'delta.enableChangeDataFeed' = 'true')"),
    ("column-mapping", "LH-028", False, _SET + "'delta.columnMapping.mode' = 'name', 'delta.minReaderVersion' = '2', 'delta.minWriterVersion' = '5')"),
    ("checkpoint-interval", "LH-030", False, _SET + "'delta.checkpointInterval' = '10')"),
    ("deletion-vectors", "LH-029", False, _SET + "'delta.enableDeletionVectors' = 'true')"),
    ("compute-stats", "LH-004", False, "transform:compute_stats {target}"),
    ("WH-001", "WH-001", True, "transform:propose_primary_key {target}"),
    ("WH-008", "WH-008", True, "transform:compute_stats {target}"),
    ("WH-009", "WH-009", True, "transform:drop_orphans {target}"),
    ("WH-016", "WH-016", True, "transform:add_audit_columns {target}"),
    ("WH-018", "WH-018", True, "transform:mask_columns {target}"),
    ("WH-026", "WH-026", True, "ALTER DATABASE {target} SET AUTO_UPDATE_STATISTICS ON"),
    ("WH-027", "WH-027", True, "ALTER DATABASE {target} SET RESULT_SET_CACHING ON"),
    ("WH-028", "WH-028", True, "ALTER DATABASE {target} SET ALLOW_SNAPSHOT_ISOLATION ON"),
    ("WH-029", "WH-029", True, "ALTER DATABASE {target} SET PAGE_VERIFY CHECKSUM"),
    ("WH-030", "WH-030", True, "ALTER DATABASE {target} SET ANSI_NULLS, ANSI_PADDING, ANSI_WARNINGS, ARITHABORT, QUOTED_IDENTIFIER ON"),
    ("WH-032", "WH-032", True, "transform:compute_stats {target}"),
    ("WH-036", "WH-036", True, "transform:fill_defaults {target}"),
    ("WH-040", "WH-040", True, "ALTER DATABASE {target} SET AUTO_CREATE_STATISTICS ON"),
    ("WH-041", "WH-041", True, "ALTER DATABASE {target} SET QUERY_STORE = ON"),
    ("WH-044", "WH-044", True, "CREATE NONCLUSTERED INDEX ON {target}"),
    ("EH-002", "EH-002", True, "transform:compact_files {target}"),
    ("EH-004", "EH-004", True, ".alter {target} policy caching hot = 30d"),
    ("EH-005", "EH-005", True, "transform:retention_filter {target} 365d"),
    ("EH-006", "EH-006", True, "transform:repair_view_source {target}"),
    ("EH-014", "EH-014", True, ".alter {target} policy ingestionbatching 500 items, 00:05:00, 1024 MB"),
    ("EH-016", "EH-016", True, "transform:partition_rewrite {target}"),
    ("EH-017", "EH-017", True, "transform:compact_files {target} 24h 16000000 rows"),
    ("EH-021", "EH-021", True, ".alter {target} policy autocompaction enabled"),
    ("EH-022", "EH-022", True, ".alter {target} policy extent_tags_retention drop-by: 7d"),
    ("EH-024", "EH-024", True, ".alter {target} policy streamingingestion enable"),
    ("EH-025", "EH-025", True, "transform:refresh_view {target}"),
    ("SM-FIX-IFERROR", "SM-001", True, "transform:rewrite_expressions {target}"),
    ("SM-FIX-EVALLOG", "SM-003", True, "transform:rewrite_expressions {target}"),
    ("SM-FIX-ADDZERO", "SM-007", True, "transform:rewrite_expressions {target}"),
    ("SM-FIX-SUMX", "SM-014", True, "transform:rewrite_expressions {target}"),
    ("SM-FIX-REMOVEFILTERS", "SM-024", True, "transform:rewrite_expressions {target}"),
    ("SM-FIX-FORMAT", "SM-015", True, "transform:fill_formats {target}"),
    ("SM-FIX-DESC", "SM-008", True, "transform:fill_descriptions {target}"),
    ("SM-FIX-MEASUREDESC", "SM-008", True, "transform:fill_descriptions {target}"),
    ("SM-FIX-MEASURENAME", "SM-017", True, "transform:clean_names {target}"),
    ("SM-FIX-HIDDEN", "SM-B02", True, "transform:hide_columns {target}"),
    ("SM-FIX-HIDEDESC", "SM-B02", True, "transform:hide_columns {target}"),
    ("SM-FIX-HIDEGUID", "SM-B03", True, "transform:hide_columns {target}"),
    ("SM-FIX-CONSTCOL", "SM-B04", True, "transform:drop_constant_columns {target}"),
    ("SM-FIX-DIRECTREF", "SM-012", True, "transform:drop_alias_records {target}"),
    ("SM-FIX-AUTODATE", "SM-023", True, "transform:drop_orphans {target}"),
    ("SM-FIX-DATE", "SM-010", True, "transform:mark_date_table {target}"),
    ("SM-FIX-KEY", "SM-B08", True, "transform:mark_keys {target}"),
    ("SM-FIX-BIDI", "SM-021", True, "transform:single_direction {target}"),
    ("SM-FIX-SUMMARIZE", "SM-022", True, "transform:no_implicit_summary {target}"),
    ("GW-004", "GW-004", True, "transform:drop_orphans {target}"),
    ("GW-006", "GW-006", True, "transform:trim_members {target}"),
    ("GW-008", "GW-008", True, "transform:drop_orphans {target}"),
    ("GW-010", "GW-010", True, "transform:dedup_records {target}"),
]


def rules_frame(spark: SparkSession, ids: list[str] | None = None) -> DataFrame:
    """(rule_id, severity, on_hit, operator, recommendation); at most one row per catalog entry."""
    rows = [(r, s, h, o, ADVICE[o]) for r, s, h, o in RULES if ids is None or r in ids]
    return spark.createDataFrame(
        rows, "rule_id string, severity string, on_hit string, operator string, recommendation string")


def fixes_frame(spark: SparkSession, ids: list[str] | None = None) -> DataFrame:
    rows = [(f, r, d, c) for f, r, d, c in FIXES if ids is None or f in ids]
    return spark.createDataFrame(rows, "fix_id string, rule_id string, is_default boolean, command string")


def setting_rules_frame(spark: SparkSession, rules: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(
        rules if rules is not None else SETTING_RULES,
        "rule_id string, entity_kind string, key string, test string, expected string, unset_value string")
