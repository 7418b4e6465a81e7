"""The whole audit as one plan: profile once, evaluate every rule, report.

``run_audit`` takes plain tables. Rules that need other inputs (logs, settings, graph
edges, expressions) join in when those inputs are given and are N/A otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from plumbline.functions import fixed_values as V
from plumbline.functions import predicates as P
from plumbline.operators import columns as C
from plumbline.operators import graph as G
from plumbline.operators import integrity as I
from plumbline.operators import logs as L
from plumbline.operators import profile as PR
from plumbline.operators import report as R
from plumbline.operators import storage as S
from plumbline.operators import text as X
from plumbline.plans.catalog import RULES, rules_frame, setting_rules_frame
from plumbline.session import cut_lineage
from plumbline.sources.facts import column_facts, falsy, truthy

Reference = tuple[str, str, str, str]


@dataclass
class Inputs:
    """What an audit may look at; everything is optional."""

    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    references: Iterable[Reference] = ()
    commits: DataFrame | None = None        # table_name, version, operation, committed, zorder_by
    files: DataFrame | None = None          # table_name, path, size (live files)
    actions: DataFrame | None = None        # table_name, version
    partitioned: DataFrame | None = None    # table_name
    with_feed: DataFrame | None = None      # table_name
    settings: DataFrame | None = None       # entity_kind, entity, properties
    extents: DataFrame | None = None        # table_name, n_rows, original_bytes, compressed_bytes
    query_log: DataFrame | None = None
    ingest: DataFrame | None = None         # entity, ts
    views: DataFrame | None = None          # name, is_healthy, is_enabled, last_run
    edges: DataFrame | None = None          # src, dst, cross_filter, is_active, summarize_by
    nodes: DataFrame | None = None          # node
    expressions: DataFrame | None = None    # id, name, text, format, is_visible
    members: DataFrame | None = None        # group_name, member, role
    entities: DataFrame | None = None       # kind, name, status, version
    connections: DataFrame | None = None    # id, gateway_id, display_name, privacy_level, credential_type
    gateways: DataFrame | None = None       # id, type, display_name, vnet fields
    datasources: DataFrame | None = None    # id, gateway_id, type, details
    masked: DataFrame | None = None         # table_name, column_name
    failures: DataFrame | None = None       # entity, ts: failed ingests
    catalog: DataFrame | None = None        # table_name, format
    statistics: DataFrame | None = None     # table_name, updated
    dependencies: DataFrame | None = None   # src, dst, src_schema, dst_schema: a view and what it reads
    documented: DataFrame | None = None     # kind (procedure, schema, measure), name, description
    defaults: DataFrame | None = None       # table_name, column_name, is_nullable, default_value
    computed: DataFrame | None = None       # table_name, column_name
    indexed: DataFrame | None = None        # table_name, column_name
    streamed: DataFrame | None = None       # table_name
    volumes: DataFrame | None = None        # table_name, n_rows, n_hot
    exports: DataFrame | None = None        # name, is_running, is_disabled
    encoded: DataFrame | None = None        # table_name
    functions: DataFrame | None = None      # name
    levels: DataFrame | None = None         # hierarchy: one row a level
    store_name: str | None = None
    as_of: str | None = None


def _label(*parts: str):
    return F.concat_ws(" ", *[F.col(p).cast("string") for p in parts])


def _hits(frame: DataFrame, conditions: Mapping[str, Column], keep: list[str]) -> DataFrame:
    """(rule_id, keep...) for every condition that holds: all rules in one pass over the frame."""
    fired = F.array_compact(F.array(*[F.when(cond, F.lit(rule)) for rule, cond in conditions.items()]))
    return frame.select(*keep, F.explode(fired).alias("rule_id"))


def column_conditions() -> dict[str, Column]:
    """Rules about one column; the frame is the profile joined with the declared columns."""
    name, sql = F.col("column_name"), F.expr
    key_with_nulls = P.key_like(name) & sql("n_nulls > 0")
    long_text = sql("kind = 'string' and max_len > 500")
    inexact = sql("data_type in ('float', 'double')")
    deprecated = F.col("data_type").isin(*V.DEPRECATED_TYPES)
    bad_name = P.bad_identifier(name)
    return {
        "LH-006": long_text, "WH-004": long_text, "WH-033": long_text,
        "LH-007": key_with_nulls, "WH-010": key_with_nulls,
        "LH-008": inexact, "WH-003": inexact,
        "LH-009": bad_name, "WH-005": bad_name,
        "LH-010": sql("kind = 'string'") & P.date_like(name),
        "LH-011": sql("kind = 'string' and max_len <= 20") & P.number_like(name),
        "LH-031": sql("data_type rlike '^(array|map|struct)<'"),
        "LH-S01": P.sensitive_name(name),
        "LH-S03": deprecated, "WH-002": deprecated,
        "WH-015": sql("kind = 'string' and max_len > 8000"),
        "SM-B01": C.is_high_card_text(), "SM-B02": C.is_free_text(), "SM-B03": C.is_guid(), "SM-B04": C.is_constant(),
        "SM-B05": C.is_bool_as_text(), "SM-B06": C.is_date_as_text(), "SM-B07": C.is_number_as_text(),
        "SM-B13": C.is_precise_time(), "SM-B14": C.is_low_card_in_fact(),
    }


def table_frame(columns: DataFrame) -> DataFrame:
    """One row per table with the counts its rules need."""
    name, sql = F.col("column_name"), F.expr
    model_key = P.model_key_like(name)
    dates = sql("case when data_type in ('date', 'timestamp', 'timestamp_ntz') then data_type end")
    texts = sql("case when data_type rlike '^(string|varchar|char)' then regexp_extract(data_type, '^([a-z]+)', 1) end")
    return columns.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_columns"), F.max("n_rows").alias("n_rows"), F.max("n_distinct").alias("max_distinct"),
        F.count_if(sql("n_nulls > 0")).alias("n_with_nulls"),
        F.count_if(P.key_like(name)).alias("n_keys"),
        F.count_if(P.key_like(name) & sql("n_nulls = 0 and n_distinct = n_rows")).alias("n_unique_keys"),
        F.count_if(P.audit_column(name)).alias("n_audit"),
        F.count_if(model_key & sql("kind = 'number'")).alias("n_number_keys"),
        F.count_if(model_key & sql("kind = 'string' and max_len > 0")).alias("n_text_keys"),
        F.count_if(sql("n_distinct > 50000 and max_len > 0")).alias("n_high_card"),
        F.count_distinct(dates).alias("n_date_types"), F.count_distinct(texts).alias("n_text_types"))


def table_conditions() -> dict[str, Column]:
    sql = F.expr
    return {
        "LH-005": sql("n_rows = 0"), "WH-011": sql("n_rows = 0"), "WH-034": sql("n_rows between 1 and 10"),
        "LH-S02": sql("n_rows > 1000000"),
        "LH-012": sql("n_columns > 30"), "SM-B09": sql("n_columns > 30"), "WH-012": sql("n_columns > 50"),
        "SM-B10": sql("n_columns > 100"), "SM-B12": sql("n_columns = 1"),
        "LH-013": sql("n_columns > 5 and n_with_nulls > 0.9 * n_columns"),
        "LH-014": sql("n_audit = 0"), "WH-016": sql("n_audit = 0"),
        "LH-015": sql("n_date_types > 1"), "WH-013": sql("n_date_types > 1"), "WH-037": sql("n_text_types > 1"),
        "LH-S04": sql("n_keys = 0"), "WH-001": sql("n_unique_keys = 0"),
        "WH-006": P.bad_identifier(F.col("table_name")),
        "SM-B08": sql("n_number_keys = 0 and n_text_keys > 0 and max_distinct > 1000"),
        "SM-B11": sql("n_high_card > 5"),
    }


def profile_findings(profile: DataFrame, facts: DataFrame) -> tuple[DataFrame, set[str]]:
    """Findings of every rule that needs only the profile and the declared columns."""
    columns = C.with_table_max(facts.drop("kind").join(
        profile.withColumnRenamed("kind", "_kind"), ["table_name", "column_name"], "left")
        .withColumn("kind", F.coalesce("_kind", F.lit("other"))))
    by_column, by_table = column_conditions(), table_conditions()
    found = [
        R.findings(_hits(columns, by_column, ["table_name", "column_name"]), F.col("rule_id")),
        R.findings(_hits(table_frame(columns), by_table, ["table_name"]), F.col("rule_id")),
    ]
    tables = facts.select("table_name").distinct().agg(
        F.count(F.lit(1)).alias("n"), F.count_if(P.date_table_name(F.col("table_name"))).alias("n_date"))
    crowd = _hits(tables.withColumn("table_name", F.lit("all tables")), {
        "SM-009": F.expr("n = 0"), "SM-010": F.expr("n_date = 0"), "SM-018": F.expr("n > 20")}, ["table_name"])
    found.append(R.findings(crowd, F.col("rule_id")))
    return R.union_findings(found), set(by_column) | set(by_table) | {"SM-009", "SM-010", "SM-018"}


def input_rules(inp: Inputs) -> dict[str | tuple[str, ...], Callable[[], DataFrame]]:
    """Rules over logs, settings, graphs and inventories, for the inputs at hand. Several rules of one frame have its rule_id."""
    out: dict[str | tuple[str, ...], Callable[[], DataFrame]] = {}

    def table(df: DataFrame, column: str) -> DataFrame:
        return df.select(F.col(column).cast("string").alias("table_name"))

    refs = list(inp.references)
    if refs:
        def broken() -> DataFrame:
            # one row a reference, with its missing keys and their rows
            return R.union_findings([
                I.orphan_summary(inp.tables[c], inp.tables[p], (ck, pk)).agg(
                    F.count(F.lit(1)).alias("n_keys"), F.sum("n_rows").alias("n_rows")).filter("n_keys > 0").select(
                    F.lit(c).alias("table_name"), F.lit(ck).alias("column_name"),
                    F.format_string("%d rows of %d keys without a parent", "n_rows", "n_keys").alias("note"))
                for c, ck, p, pk in refs])
        out["WH-009"] = broken
        if len(inp.tables) > 3:  # too few tables tell nothing
            out["WH-014"] = lambda: column_facts(inp.tables).select("table_name").distinct().filter(
            ~F.col("table_name").isin([c for c, *_ in refs] + [p for *_, p, _ in refs]))
    if inp.commits is not None and inp.as_of:
        history = S.maintenance_history(inp.commits, inp.as_of)
        out["LH-004"] = lambda: history
        out["LH-017"] = lambda: history.filter("vacuum <> 'recent'")
        out["LH-018"] = lambda: history.filter("optimize = 'never'")
        out["LH-023"] = lambda: S.write_amplification(inp.commits)
    if inp.actions is not None:
        out["LH-022"] = lambda: S.version_count(inp.actions)
    if inp.files is not None:
        stats = S.file_size_stats(inp.files)
        out["LH-019"] = lambda: S.small_files(stats)
        if inp.partitioned is not None:
            out["LH-016"] = lambda: S.large_unpartitioned(stats, inp.partitioned)
            out["EH-016"] = lambda: S.large_unpartitioned(stats, inp.partitioned, V.GB)
        if inp.with_feed is not None:
            out["LH-027"] = lambda: S.change_feed_gap(stats, inp.with_feed)
        if inp.commits is not None and inp.as_of:
            out["LH-025"] = lambda: stats.filter(F.col("total_bytes") > V.LARGE_TABLE).join(
                S.maintenance_history(inp.commits, inp.as_of).filter("not has_zorder"), "table_name", "left_semi")
    if inp.settings is not None:
        spark = inp.settings.sparkSession
        from plumbline.plans.catalog import SETTING_RULES
        # all setting rules in one scan of the settings
        rules = [r for r in SETTING_RULES if r[0] != "LH-027"]
        out[tuple(sorted({r[0] for r in rules}))] = lambda: S.property_audit(inp.settings, setting_rules_frame(spark, rules)).select(
            "rule_id", F.col("entity").cast("string").alias("table_name"))
    if inp.extents is not None:
        out["EH-002"] = lambda: S.extent_fragmentation(inp.extents)
        out["EH-003"] = lambda: S.compression_ratio(inp.extents)
    if inp.query_log is not None:
        log = inp.query_log
        out["WH-023"] = lambda: table(L.succeeded(log).filter("elapsed_ms > 60000"), "query_id")
        out["WH-024"] = lambda: table(L.frequent_queries(log, k=None).filter("is_hot"), "query_text")
        out["WH-025"] = lambda: table(log.filter("status = 'Failed'"), "query_id")
        out["EH-009"] = out["WH-025"]
        if inp.as_of:
            out["WH-039"] = lambda: L.recent_health(log, inp.as_of).filter("status in ('WARN', 'FAIL')").select(
                F.col("status").alias("table_name"), F.when(F.col("status") == "FAIL", "FAIL").alias("level"))
            out["EH-008"] = lambda: table(L.command_profile(log, inp.as_of, exact=False).filter("is_slow"), "command_type")
            out["EH-026"] = lambda: table(L.command_profile(log, inp.as_of, exact=False), "command_type")
    if inp.ingest is not None and inp.as_of:
        out["EH-007"] = lambda: table(L.data_freshness(inp.ingest, "entity", "ts", inp.as_of), "entity")
        out["EH-027"] = lambda: table(L.ingestion_latency(inp.ingest, "entity", "ts", inp.as_of), "entity")
    if inp.views is not None and inp.as_of:
        out["EH-006"] = lambda: table(inp.views.filter(falsy(F.col("is_healthy"))), "name")
        out["EH-025"] = lambda: table(L.stale_views(inp.views, inp.as_of), "name")
    if inp.edges is not None:
        flags = G.edge_flags(inp.edges)
        bidirectional = inp.edges.filter(F.lower(F.col("cross_filter")).isin("2", "both", "bothdirections"))
        level = G.edge_flags(inp.edges).filter("check = 'bidirectional'").select(F.col("status").alias("level"))
        # every such edge is an issue; one row says whether they are too many
        out["SM-021"] = lambda: bidirectional.select(_label("src", "dst").alias("table_name"), F.lit(None).cast("string").alias("level")).unionByName(
            level.filter("level = 'FAIL'").select(F.lit(None).cast("string").alias("table_name"), "level"))
        out["SM-022"] = lambda: table(flags.filter("check = 'implicit_summary' and n_hits > 0"), "check")
        out["SM-027"] = lambda: table(flags.filter("check = 'inactive' and n_hits > 0"), "check")
        out["SM-026"] = lambda: table(G.node_degree(inp.edges, 5), "node")
        out["WH-017"] = lambda: I.reciprocal_edges(inp.edges.select("src", "dst", F.lit(1).alias("n"))).select(
            _label("node_a", "node_b").alias("table_name"))
        if inp.nodes is not None:
            out["SM-023"] = lambda: table(G.disconnected_nodes(inp.nodes, "node", inp.edges, exempt="date|calendar"), "node")
    if inp.expressions is not None:
        ex = inp.expressions
        # all patterns of a kind in one scan of the expressions
        named = ex.select("name", "text")
        out[tuple(r[0] for r in V.EXPRESSION_PATTERNS)] = lambda: X.pattern_audit(named, "text", V.EXPRESSION_PATTERNS).select(
            "rule_id", F.col("name").cast("string").alias("table_name"))
        out[tuple(r[0] for r in V.OCCURRENCE_PATTERNS)] = lambda: X.occurrence_audit(named, "text", V.OCCURRENCE_PATTERNS).select(
            "rule_id", F.col("name").cast("string").alias("table_name"))
        out["SM-005"] = lambda: table(X.normalized_duplicates(ex, "name", "text"), "first_record")
        out["SM-012"] = lambda: table(X.alias_records(ex.select("id", "name", "text"), "id", "name", X.bracket_reference(F.col("text"))), "name")
        out["SM-015"] = lambda: table(X.missing_metadata(ex, "name", ["format"], F.col("is_visible")), "name")
        out["SM-017"] = lambda: table(ex.filter(F.col("name").rlike(r"[\t\r\n]|^ | $")), "name")
        out["SM-028"] = lambda: table(X.missing_metadata(ex, "name", ["format"]), "name")
    if inp.members is not None:
        privileged = F.lower("role").isin("admin", "readoverrideeffectiveidentity")
        out["GW-006"] = lambda: table(G.excess_members(inp.members, ["group_name"], 5, privileged), "group_name")
        out["WH-020"] = lambda: table(G.excess_members(inp.members, ["group_name"], 3, F.lower("role") == "db_owner"), "group_name")
    if inp.entities is not None:
        healthy = {"GW-001": ("gateway", ("live", "online")), "GW-005": ("datasource", ("ok",)),
                   "LH-001": ("endpoint", ("success",)), "WH-031": ("database", ("online",)), "EH-001": ("store", ("running", "active"))}
        for rule, (kind, ok) in healthy.items():
            out[rule] = lambda kind=kind, ok=ok: table(G.status_health(
                inp.entities.filter(F.col("kind") == kind), "name", "status", ok).filter("status = 'FAIL'"), "name")
        out["GW-002"] = lambda: table(G.version_check(inp.entities.filter("kind = 'gateway'"), "version", (3000,)), "name")
    if inp.gateways is not None:
        shared = inp.gateways.filter("type <> 'Personal'")
        out["GW-012"] = lambda: table(X.missing_metadata(shared, "id", ["display_name"]), "id")
        if "subnet" in inp.gateways.columns:
            vnet = ["subscription", "resource_group", "network", "subnet"]
            out["GW-009"] = lambda: table(X.missing_metadata(inp.gateways.filter("type = 'VirtualNetwork'"), "id", vnet), "id")
        if inp.connections is not None:
            out["GW-003"] = lambda: table(I.unused_parents(shared, inp.connections, [("id", "gateway_id")]), "id")
            out["GW-008"] = lambda: table(I.orphan_rows(inp.connections, inp.gateways, [("gateway_id", "id")]), "id")
            if inp.datasources is not None:
                out["GW-004"] = lambda: table(I.unused_parents(inp.datasources, inp.connections, [("gateway_id", "gateway_id")]), "id")
    if inp.connections is not None:
        out["GW-007"] = lambda: table(X.missing_metadata(inp.connections, "id", ["credential_type"]), "id")
        out["GW-011"] = lambda: table(X.missing_metadata(inp.connections, "id", ["privacy_level"]), "id")
    out.update(catalog_rules(inp))
    if inp.datasources is not None:
        out["GW-010"] = lambda: table(G.duplicate_records(inp.datasources, ["gateway_id", "type", "details"], "id"), "keep_id")
    return out


def catalog_rules(inp: Inputs) -> dict[str, Callable[[], DataFrame]]:
    """Rules over what a store's catalog lists: masks, statistics, dependencies, documentation, policies."""
    out: dict[str, Callable[[], DataFrame]] = {}
    pair = ["table_name", "column_name"]
    facts = column_facts(inp.tables) if inp.tables else None

    def named(df: DataFrame, column: str) -> DataFrame:
        return df.select(F.col(column).cast("string").alias("table_name"))

    if inp.masked is not None and facts is not None:
        out["WH-018"] = lambda: C.unmasked(C.sensitive_names(facts), inp.masked, pair)
    if inp.failures is not None and inp.as_of:
        out["EH-010"] = lambda: named(L.ingestion_failures(inp.failures, ["entity"], "ts", inp.as_of), "entity")
    if inp.catalog is not None:
        out["LH-003"] = lambda: inp.catalog.filter(F.coalesce(F.lower("format") != "delta", F.lit(True))).select("table_name")
    if inp.store_name is not None:
        spark = next(iter(inp.tables.values())).sparkSession
        store = spark.createDataFrame([(inp.store_name,)], "table_name string")
        out["LH-002"] = lambda: store.filter(P.layer(F.col("table_name")).isNull())
    if inp.statistics is not None and inp.as_of and facts is not None:
        state = L.stale_statistics(facts.select("table_name"), inp.statistics, "table_name", "updated", inp.as_of)
        out["WH-008"] = lambda: state.filter("reason = 'stale'").select("table_name")
        out["WH-032"] = lambda: state.filter("reason = 'missing'").select("table_name")
    if inp.dependencies is not None:
        deps = inp.dependencies
        out["WH-021"] = lambda: named(deps.groupBy("src").agg(F.count_distinct("dst").alias("n")).filter("n > 10"), "src")
        out["WH-022"] = lambda: G.cross_group_edges(deps, "src_schema", "dst_schema", ["src", "dst"]).select(_label("src", "dst").alias("table_name"))
    if inp.documented is not None:
        for rule, kind in (("WH-035", "procedure"), ("WH-038", "schema"), ("SM-008", "measure")):
            out[rule] = lambda kind=kind: named(X.missing_metadata(
                inp.documented.filter(F.col("kind") == kind), "name", ["description"]), "name")
    if inp.defaults is not None:
        out["WH-036"] = lambda: inp.defaults.filter(falsy(F.col("is_nullable")) & P.blank(F.col("default_value"))).select(*pair)
    if inp.computed is not None and facts is not None:
        out["WH-042"] = lambda: G.computed_share(facts, inp.computed).select("table_name")
    if inp.indexed is not None and inp.references:
        spark = inp.indexed.sparkSession
        keys = spark.createDataFrame([(c, ck) for c, ck, *_ in inp.references], "table_name string, column_name string")
        out["WH-044"] = lambda: keys.join(inp.indexed.select(*pair), pair, "left_anti")
    if inp.streamed is not None:
        out["EH-011"] = lambda: inp.streamed.select("table_name")
        if inp.volumes is not None:
            out["EH-024"] = lambda: inp.volumes.filter("n_rows >= 1000000").join(inp.streamed.select("table_name"), "table_name", "left_anti").select("table_name")
    if inp.volumes is not None:
        out["EH-013"] = lambda: inp.volumes.filter("n_rows > 0 and n_hot < n_rows * 0.5").select("table_name")
    if inp.exports is not None:
        out["EH-012"] = lambda: named(inp.exports.filter(falsy(F.col("is_running")) | truthy(F.col("is_disabled"))), "name")
    if inp.encoded is not None and inp.extents is not None:
        out["EH-018"] = lambda: S.compression_ratio(inp.extents).join(inp.encoded.select("table_name"), "table_name", "left_anti").select("table_name")
    if inp.functions is not None:
        out["EH-020"] = lambda: named(inp.functions, "name")
    if inp.levels is not None:
        out["SM-029"] = lambda: named(G.pseudo_hierarchies(inp.levels, "hierarchy"), "hierarchy")
    return out


def collect_findings(inp: Inputs, mode: str = "exact") -> tuple[DataFrame, tuple[str, ...], dict[str, str]]:
    """(findings, rules without input, rules whose input failed). A rule that cannot be
    planned becomes an ERROR and does not stop the others."""
    frames, errors, known = [], {}, set()
    if inp.tables:
        # One row per column, read by every rule below: written to the shared folder, so
        # neither the rules nor a lost executor scan the tables again.
        profile = cut_lineage(PR.column_profile(inp.tables, mode), "profile")
        found, known = profile_findings(profile, column_facts(inp.tables))
        frames.append(found)
    for rule, build in input_rules(inp).items():
        several = isinstance(rule, tuple)
        known = known | (set(rule) if several else {rule})
        try:
            frames.append(R.findings(build(), F.col("rule_id") if several else rule))
        except AnalysisException as problem:
            errors.update(dict.fromkeys(rule if several else [rule], str(problem)))
    absent = tuple(r for r, *_ in RULES if r not in known)
    # counted and sampled from what is written, so every input is read once
    return cut_lineage(R.union_findings(frames), "findings"), absent, errors


def run_audit(
    tables: Mapping[str, DataFrame], references: Iterable[Reference] = (), mode: str = "exact", inputs: Inputs | None = None,
) -> DataFrame:
    """One row per rule of the catalog, worst first."""
    inp = inputs or Inputs()
    inp.tables, inp.references = tables, list(references)
    found, absent, errors = collect_findings(inp, mode)
    spark = next(iter(tables.values())).sparkSession
    results = R.findings_to_rules(found, rules_frame(spark), absent, errors)
    return results.orderBy(R._rank("status", V.STATUS_ORDER), R._rank("severity", V.SEVERITY_ORDER), "rule_id")
