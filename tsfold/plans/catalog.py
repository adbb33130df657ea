"""Query catalog: one callable ``(spark, sf_dir) -> DataFrame`` per operator
key of the survey inventory. Every entry reads the given tables (through the
corpus builders) so its work grows with them. Integer outputs are BIGINT so
schemas match the DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import graph as G
from ..operators import imports as I
from ..operators import merge as M
from ..operators import reexports as R
from ..operators import tree as T
from ..sources import corpora as C
from ..sources import files as S
from ..sources.tables import table
from ..session import scratch_path
from ..streaming import affected as AF
from ..streaming import events as EV
from ..streaming import remerge as RM
from ..streaming import throttle as TH

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def _big(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("bigint"))
    return df


# statement facts read by resolve/merge style queries (text columns left out)
FACT_COLS = [
    "project_id", "path", "file_ord", "stmt_ord", "kind", "raw_type", "name", "is_export",
    "value", "export_names", "nested_exports", "import_names", "source_path",
]

# those of queries on names alone
NAME_COLS = [c for c in FACT_COLS if c != "value"]

# ------------------------------------------------------------ A sources

@query("merge_concat")
def q_merge_concat(spark, sf):
    return S.merge_concat(C.documents_files(spark, sf))


@query("merge_concat_rows")
def q_merge_concat_rows(spark, sf):
    return S.merge_concat_rows(C.documents_files(spark, sf))


@query("quarantine")
def q_quarantine(spark, sf):
    # limit parameter chosen so both sides exist: documents over 20,000 bytes
    ok, rej = S.quarantine(C.documents_files(spark, sf), max_bytes=20000)
    acc = ok.select("project_id", "path", F.lit("accepted").alias("reason"))
    return acc.unionByName(rej)


@query("filter_suffix")
def q_filter_suffix(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    files = p.select(F.col("page_id").alias("project_id"), F.col("url").alias("path"))
    ok, rej = S.filter_suffix(files, ".html")
    return _big(ok.select("project_id", "path", F.lit("accepted").alias("reason")).unionByName(rej), "project_id")


@query("exclude_paths")
def q_exclude_paths(spark, sf):
    d = C.documents_files(spark, sf).select(
        "project_id", F.concat(F.col("project_id"), F.lit("/"), "path").alias("path"), "file_ord"
    )
    return S.exclude_paths(d, "src1,src2*,docs_x").select("project_id", "path", "file_ord")


@query("output_stats")
def q_output_stats(spark, sf):
    return S.output_stats(M.merge_rows(C.ts_corpus(spark, sf)))


# --------------------------------------------------------- B extraction

def _ts_stmts(spark, sf):
    return X.statements(C.ts_corpus(spark, sf))


@query("statements")
def q_statements(spark, sf):
    return _big(_ts_stmts(spark, sf), "stmt_ord")


@query("classify_kind")
def q_classify_kind(spark, sf):
    s = _ts_stmts(spark, sf)
    return s.groupBy("raw_type", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("kind_histogram")
def q_kind_histogram(spark, sf):
    return X.kind_histogram(_ts_stmts(spark, sf))


@query("imports")
def q_imports(spark, sf):
    return _big(X.imports(C.ts_corpus(spark, sf)), "stmt_ord", "name_ord")


@query("exports")
def q_exports(spark, sf):
    return _big(X.exports(C.ts_corpus(spark, sf)).drop("line", "row"), "stmt_ord")


@query("declarations")
def q_declarations(spark, sf):
    return _big(X.declarations_from(X.extract_facts(C.ts_corpus(spark, sf))), "stmt_ord")


@query("rejects")
def q_rejects(spark, sf):
    return X.rejects(C.ts_broken_parts(spark, sf))


@query("export_conflicts")
def q_export_conflicts(spark, sf):
    return M.export_conflicts(X.exports(C.ts_brands(spark, sf)))


@query("resolve_imports")
def q_resolve_imports(spark, sf):
    st = X.extract_facts(C.ts_corpus(spark, sf), materialize=True, columns=FACT_COLS)
    r = M.resolve_imports(X.imports_from(st), X.exports_from(st))
    return _big(r.select(
        "project_id", "path", "stmt_ord", "imported_name", "source_path", "resolved",
        "export_path", "export_stmt_ord",
    ), "stmt_ord", "export_stmt_ord")


@query("unresolved_imports")
def q_unresolved_imports(spark, sf):
    st = X.extract_facts(C.ts_corpus(spark, sf), materialize=True, columns=NAME_COLS)
    r = M.unresolved_imports(X.imports_from(st), X.exports_from(st))
    return _big(r.select("project_id", "path", "stmt_ord", "imported_name", "source_path"), "stmt_ord")


@query("merge_full")
def q_merge_full(spark, sf):
    r = M.merge_rows(C.ts_corpus(spark, sf))
    return _big(r.select("project_id", "out_ord", "section", "path", "stmt_ord", "kind", "value"),
                "section", "stmt_ord")


@query("flatten_program")
def q_flatten_program(spark, sf):
    st = X.statements(C.ts_corpus(spark, sf))
    return _big(M.flatten_program(st).select("project_id", "path", "stmt_ord", "out_ord"), "stmt_ord")


# ---------------------------------------------------------- B edges

def _ts_edges(spark, sf, corpus):
    st = X.extract_facts(corpus(spark, sf), materialize=True, columns=[
        "project_id", "path", "file_ord", "stmt_ord", "name", "kind", "raw_type", "is_export",
        "decl_keyword", "decl_names", "mcode", "members",
    ])
    return st


@query("ref_edges")
def q_ref_edges(spark, sf):
    st = _ts_edges(spark, sf, C.ts_corpus)
    return X.ref_edges_from(st, X.declarations_from(st))


@query("contains_edges")
def q_contains_edges(spark, sf):
    st = _ts_edges(spark, sf, C.ts_customers)
    return X.contains_edges_from(st).select("project_id", "path", "src", "dst", "edge_kind")


@query("method_edges")
def q_method_edges(spark, sf):
    st = _ts_edges(spark, sf, C.ts_customers)
    return X.method_edges_from(st).select("project_id", "path", "src", "dst", "edge_kind")


def customer_graph(spark, sf):
    st = _ts_edges(spark, sf, C.ts_customers)
    ref = X.ref_edges_from(st, X.declarations_from(st))
    cont = X.contains_edges_from(st).select("project_id", "src", "dst", "edge_kind")
    return ref.unionByName(cont)


@query("flow_of")
def q_flow_of(spark, sf):
    return G.flow_of(customer_graph(spark, sf))


@query("find_by_name")
def q_find_by_name(spark, sf):
    st = X.extract_facts(C.ts_brands(spark, sf))
    return _big(G.find_by_name(X.declarations_from(st)), "stmt_ord")


# ---------------------------------------------------------- D graph

@query("dependency_edges")
def q_dependency_edges(spark, sf):
    return G.dependency_edges(C.edges_order(spark, sf))


@query("degrees")
def q_degrees(spark, sf):
    return G.degrees(C.edges_order(spark, sf))


def _last_parts(spark, sf):
    """Seed per order: the part of its last line (l_linenumber, l_partkey)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    last = li.groupBy("l_orderkey").agg(F.max(F.struct("l_linenumber", "l_partkey")).alias("x"))
    return last.select(F.col("l_orderkey").alias("project_id"),
                       F.concat(F.lit("p"), F.col("x.l_partkey").cast("string")).alias("seed"))


@query("closure")
def q_closure(spark, sf):
    r = G.closure(C.edges_order(spark, sf), _last_parts(spark, sf))
    return r.select("project_id", "seed", "node")


@query("has_cycle")
def q_has_cycle(spark, sf):
    return G.has_cycle(C.edges_order(spark, sf))


@query("cycle_members")
def q_cycle_members(spark, sf):
    return G.cycle_members(C.edges_order(spark, sf))


@query("topo_order")
def q_topo_order(spark, sf):
    return _big(G.topo_order(C.edges_order(spark, sf)), "level")


@query("components")
def q_components(spark, sf):
    return G.components(C.edges_order(spark, sf))


@query("affected_files")
def q_affected_files(spark, sf):
    """Files affected by a change of the parts with p_size >= 45:
    the changed part files and every file whose declarations depend on
    them, transitively (reverse reference edges)."""
    st = _ts_edges(spark, sf, C.ts_corpus)
    decls = X.declarations_from(st)
    edges = X.ref_edges_from(st, decls)
    big = table(spark, sf, "part").where(F.col("p_size") >= 45).select(
        F.concat(F.lit("src/part/"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"))
    changed = decls.join(big, "path", "left_semi").select("project_id", F.col("name").alias("node"))
    hit = G.affected(edges, changed)
    return decls.join(hit.withColumnRenamed("node", "name"), ["project_id", "name"], "left_semi") \
        .select("project_id", "path").distinct()


# ---------------------------------------------------------- E tree

def _nodes(spark, sf):
    return C.nodes_geo(spark, sf).withColumn("depth", F.col("depth").cast("bigint"))


@query("preorder")
def q_preorder(spark, sf):
    return T.preorder(_nodes(spark, sf)).select("node_id", "sort_path", "pre_ord")


@query("postorder")
def q_postorder(spark, sf):
    return T.postorder(_nodes(spark, sf)).select("node_id", "post_ord")


@query("prune")
def q_prune(spark, sf):
    n = _nodes(spark, sf)
    skip = (F.col("kind") == "Method") & (F.col("label") == "BUILDING")
    return T.prune(n, skip).select("node_id", "parent_id", "depth")


@query("leaf_nodes")
def q_leaf_nodes(spark, sf):
    return T.leaf_nodes(_nodes(spark, sf)).select("node_id", "kind")


# ---------------------------------------------------------- more B/C

@query("node_text")
def q_node_text(spark, sf):
    files = C.ts_corpus(spark, sf)
    rng = X.statements(files).select("project_id", "path", "stmt_ord", "start_byte", "end_byte")
    return _big(X.node_text(files, rng).select("project_id", "path", "stmt_ord", "value", "valid"), "stmt_ord")


@query("comments")
def q_comments(spark, sf):
    return _big(X.comments(C.ts_corpus(spark, sf)), "comment_ord")


@query("comments_html")
def q_comments_html(spark, sf):
    return _big(X.comments(C.pages_files(spark, sf), "html"), "comment_ord")


@query("strip_comments")
def q_strip_comments(spark, sf):
    return X.strip_comments(C.ts_corpus(spark, sf)).select("project_id", "path", "content")


def _merge_q(spark, sf, **kw):
    r = M.merge_rows(C.ts_corpus(spark, sf), M.MergeOptions(**kw))
    return _big(r.select("project_id", "out_ord", "section", "path", "stmt_ord", "kind", "value"),
                "section", "stmt_ord")


@query("sort_imports")
def q_sort_imports(spark, sf):
    return _merge_q(spark, sf, sort_imports=True, exports_first=False).drop("value")


@query("exports_first")
def q_exports_first(spark, sf):
    return _merge_q(spark, sf, sort_imports=False, exports_first=True).drop("value")


@query("dedupe_written")
def q_dedupe_written(spark, sf):
    return _merge_q(spark, sf, dedupe=False)


@query("drop_unknown")
def q_drop_unknown(spark, sf):
    st = X.statements(C.ts_customers(spark, sf))
    return _big(M.drop_unknown(st).select("project_id", "path", "stmt_ord", "kind"), "stmt_ord")


@query("spacing")
def q_spacing(spark, sf):
    st = X.statements(C.ts_corpus(spark, sf))
    return _big(st.select("project_id", "path", "stmt_ord", "kind",
                          M.spacing(F.col("kind"), F.col("value")).alias("value")), "stmt_ord")


@query("comment_carry")
def q_comment_carry(spark, sf):
    facts = M.numbered(M.merge_facts(C.ts_corpus(spark, sf), M.MergeOptions()))  # lexed once for the merge and the comments
    rows = M.merge_rows_from_facts(facts)
    return M.comment_carry(facts, rows).select("project_id", "out_ord", "comment")


@query("merge_text")
def q_merge_text(spark, sf):
    t = M.merge_text(M.merge_rows(C.ts_corpus(spark, sf)))
    return t.select("project_id", "n_rows", "n_bytes", "md5", "too_large")


@query("merge_chunks")
def q_merge_chunks(spark, sf):
    """C12 in chunks of 64 KiB."""
    c = S.text_chunks(M.merge_rows(C.ts_corpus(spark, sf)), ["out_ord"])
    return c.select("project_id", "chunk", "n_bytes", F.md5("content").alias("md5"))


@query("concat_chunks")
def q_concat_chunks(spark, sf):
    """A5 in chunks of 64 KiB."""
    c = S.text_chunks(S.merge_concat_rows(C.documents_files(spark, sf)), ["file_ord", "path"])
    return c.select("project_id", "chunk", "n_bytes", F.md5("content").alias("md5"))


@query("index_export_order")
def q_index_export_order(spark, sf):
    st = X.extract_facts(C.ts_index(spark, sf), materialize=True, columns=NAME_COLS)
    return _big(I.index_export_order(st).select("project_id", "export_name", "index_ord", "out_ord"), "index_ord")


@query("scan_corpus")
def q_scan_corpus(spark, sf):
    folder = scratch_path(spark, "corpus")
    S.write_corpus(C.ts_parts(spark, sf), folder)
    f = S.scan_corpus(spark, folder, suffix=".txt", project_from_path=r"project_id=(\d+)")
    return f.groupBy(F.col("project_id").cast("bigint").alias("project_id")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_bytes").cast("bigint").alias("n_bytes"))


@query("write_merged")
def q_write_merged(spark, sf):
    out = scratch_path(spark, "merged")
    S.write_merged_text(M.merge_rows(C.ts_corpus(spark, sf)), out)
    t = S.stream_digest(S.read_merged_text(spark, out), ["path"])
    return t.select("project_id", "md5", "n_bytes")


@query("position_order")
def q_position_order(spark, sf):
    """2H: positions (row, col) ordered as tuples; lineitem (orderkey, linenumber)."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row"),
                                            F.col("l_linenumber").cast("bigint").alias("col")).distinct()
    p = li.withColumn("g", F.lit(0)).withColumn("position", F.struct("row", "col"))
    from ..operators.order import dense_rank_within
    return dense_rank_within(p, ["g"], ["position"], "pos").select("row", "col", "pos")


# ---------------------------------------------------------- G roadmap

def _facts(spark, sf, corpus):
    return X.extract_facts(corpus(spark, sf), materialize=True, columns=[
        "project_id", "path", "file_ord", "stmt_ord", "name", "kind", "raw_type", "is_export",
        "decl_keyword", "mcode", "members", "import_names", "source_path", "value", "start_row",
        "export_names", "nested_exports", "decl_names", "export_links",
    ])


def _both(spark, sf):
    return C.ts_corpus(spark, sf).unionByName(C.ts_customers(spark, sf))


@query("import_scope")
def q_import_scope(spark, sf):
    im = X.imports(_both(spark, sf))
    return I.import_scope(im).groupBy("project_id", "scope").agg(F.count(F.lit(1)).alias("n"))


@query("normalize_import_path")
def q_normalize_import_path(spark, sf):
    im = X.imports(C.ts_corpus(spark, sf))
    return _big(I.normalize_import_paths(im).select("project_id", "path", "stmt_ord", "source_path", "resolved_path"),
                "stmt_ord")


@query("redundant_imports")
def q_redundant_imports(spark, sf):
    return I.redundant_imports(X.imports(C.ts_corpus(spark, sf)))


@query("unused_imports")
def q_unused_imports(spark, sf):
    u = I.unused_imports(X.extract_facts(_both(spark, sf), materialize=True, columns=[
        "project_id", "path", "file_ord", "stmt_ord", "raw_type", "import_names", "source_path", "mcode"]))
    return u.select("project_id", "path", "imported_name", "local_name", "source_path")


@query("dead_decls")
def q_dead_decls(spark, sf):
    st = X.extract_facts(_both(spark, sf), materialize=True, columns=[*LOCATING, "kind", "decl_keyword"])
    decls = X.declarations_from(st)
    return _big(I.dead_decls(decls, I.located_refs(st, distinct=False)).select("project_id", "path", "stmt_ord", "name"), "stmt_ord")


# statement facts that located references read
LOCATING = ["project_id", "path", "file_ord", "stmt_ord", "name", "is_export", "raw_type", "decl_names", "mcode", "import_names",
            "source_path", "export_links"]
LOCATED = ["project_id", "src_path", "src_stmt_ord", "src", "dst_path", "dst_stmt_ord", "dst"]


@query("located_refs")
def q_located_refs(spark, sf):
    """B9 with identity on files whose namespaces and members share names."""
    refs = I.located_refs(_facts(spark, sf, C.ts_customers))
    return _big(refs.select(*LOCATED), "src_stmt_ord", "dst_stmt_ord")


@query("usage_position_shared")
def q_usage_position_shared(spark, sf):
    """G3 where projects declare one name in many files."""
    u = I.usage_position(I.located_refs(_facts(spark, sf, C.ts_customers)))
    return _big(u, "first_use_stmt_ord")


@query("cross_module_refs")
def q_cross_module_refs(spark, sf):
    return I.cross_module_refs(I.located_refs(X.extract_facts(C.ts_corpus(spark, sf), materialize=True, columns=LOCATING), distinct=False))


@query("usage_position")
def q_usage_position(spark, sf):
    u = I.usage_position(I.located_refs(X.extract_facts(C.ts_corpus(spark, sf), materialize=True, columns=LOCATING), distinct=False))
    return _big(u.drop("path"), "first_use_stmt_ord")


@query("namespace_merge")
def q_namespace_merge(spark, sf):
    return I.namespace_merge(X.extract_facts(C.ts_customers(spark, sf)))


@query("line_provenance")
def q_line_provenance(spark, sf):
    facts = M.numbered(X.extract_facts(C.ts_corpus(spark, sf), columns=[*(c for c in M.FACT_COLUMNS if c != "ccode"), "start_row"]))
    return I.line_provenance(M.merge_rows_from_facts(facts), facts)  # lexed once for both


# ------------------------------------------------- dependants of changes

@query("affected_stream")
def q_affected_stream(spark, sf):
    """F8 with G11: batches that really change, delete and add files, and the files that depend on them."""
    folder, index, out, ck = (scratch_path(spark, f"changes-{x}") for x in ("in", "index", "out", "ck"))
    for batch in C.ts_changes(spark, sf):
        batch.write.mode("append").parquet(folder)
    q = AF.start_affected(AF.change_source(spark, folder), C.ts_corpus(spark, sf), index, out, ck)
    q.awaitTermination()
    return AF.read_affected(spark, out).groupBy("version", "project_id", "path").agg(F.min("hop").alias("hop"))


# ---------------------------------------------- dense code, re-exports

@query("statements_dense")
def q_statements_dense(spark, sf):
    """B1 on several statements a line and nested templates."""
    return _big(X.statements(C.ts_shapes(spark, sf)), "stmt_ord")


@query("declarations_dense")
def q_declarations_dense(spark, sf):
    """B6 on several declarators and binding patterns."""
    d = X.declarations_from(X.extract_facts(C.ts_shapes(spark, sf)))
    return _big(d.select("project_id", "path", "stmt_ord", "name", "is_export", "decl_keyword"), "stmt_ord")


@query("exports_dense")
def q_exports_dense(spark, sf):
    """B4 on several declarators and members that share a line."""
    return _big(X.exports(C.ts_shapes(spark, sf)).drop("line", "row"), "stmt_ord")


@query("ref_edges_dense")
def q_ref_edges_dense(spark, sf):
    st = _ts_edges(spark, sf, C.ts_shapes)
    return X.ref_edges_from(st, X.declarations_from(st))


@query("trailing_comments")
def q_trailing_comments(spark, sf):
    """C11 on comments behind code."""
    facts = M.numbered(M.merge_facts(C.ts_shapes(spark, sf), M.MergeOptions()))
    rows = M.merge_rows_from_facts(facts)
    return _big(M.comment_carry(facts, rows).select("project_id", "path", "stmt_ord", "comment_ord", "comment"), "stmt_ord", "comment_ord")


@query("reexports")
def q_reexports(spark, sf):
    """What the names stand for that barrels pass on."""
    r = R.resolve(_facts(spark, sf, C.ts_barrels))
    return _big(r, "dst_stmt_ord")


@query("located_refs_barrels")
def q_located_refs_barrels(spark, sf):
    """B9 with identity through barrels three deep."""
    return _big(I.located_refs(_facts(spark, sf, C.ts_barrels)).select(*LOCATED), "src_stmt_ord", "dst_stmt_ord")


# ---------------------------------------------------------- F events

THROTTLE_GAP_MS = 24 * 3600 * 1000  # query parameter: one day between re-scans


def _norm(spark, sf, strict=False):
    return EV.normalize_events(C.raw_events_tbl(spark, sf), strict)


def _routed(spark, sf):
    return EV.route_events(_norm(spark, sf), C.watched_dirs(spark, sf))


@query("normalize_events")
def q_normalize_events(spark, sf):
    return _norm(spark, sf).select("event_id", "wd", "name", "kind")


@query("route_events")
def q_route_events(spark, sf):
    return _routed(spark, sf).select("event_id", "path", "kind")


@query("ignore_deletes")
def q_ignore_deletes(spark, sf):
    return EV.ignore_deletes(_routed(spark, sf), "ignore").select("event_id", "path", "kind")


@query("scan_throttle")
def q_scan_throttle(spark, sf):
    ev = _norm(spark, sf).select("event_id", "wd", "ts")
    return EV.scan_throttle(ev, "wd", "ts", THROTTLE_GAP_MS).select("wd", "event_id")


@query("active_paths")
def q_active_paths(spark, sf):
    return EV.active_paths(_routed(spark, sf)).select("path", "last_kind")


@query("watch_dedup")
def q_watch_dedup(spark, sf):
    return EV.watch_dedup(_routed(spark, sf))


@query("register_path")
def q_register_path(spark, sf):
    r = _routed(spark, sf)
    files = r.select("path").distinct()
    return EV.register_path(r, files)


@query("event_counts")
def q_event_counts(spark, sf):
    return EV.event_counts(_norm(spark, sf))


def _landed_events(spark, sf):
    folder = scratch_path(spark, "events-in")
    RM.write_event_files(C.raw_events_tbl(spark, sf), folder, n_files=4)
    return folder


@query("event_source")
def q_event_source(spark, sf):
    folder = _landed_events(spark, sf)
    out, ck = scratch_path(spark, "events-out"), scratch_path(spark, "events-ck")
    stream = RM.normalized_stream(spark, folder).select("event_id", "wd", "name", "kind")
    RM.run_available_now(stream, out, ck)
    return spark.read.parquet(out)


@query("scan_throttle_stream")
def q_scan_throttle_stream(spark, sf):
    folder = _landed_events(spark, sf)
    out, ck = scratch_path(spark, "throttle-out"), scratch_path(spark, "throttle-ck")
    ev = RM.normalized_stream(spark, folder).select("event_id", "wd", "ts")
    RM.run_available_now(TH.scan_throttle_stream(ev, "wd", "ts", "event_id", THROTTLE_GAP_MS), out, ck)
    return spark.read.parquet(out).select("wd", "event_id")


@query("event_counts_stream")
def q_event_counts_stream(spark, sf):
    folder = _landed_events(spark, sf)
    out, ck = scratch_path(spark, "counts-out"), scratch_path(spark, "counts-ck")
    ev = RM.normalized_stream(spark, folder)
    RM.run_updates(EV.event_counts_stream(ev), out, ck)
    return RM.read_updates(spark, out, ["window_start", "kind"])


@query("stream_progress")
def q_stream_progress(spark, sf):
    """Per-batch progress of the event stream, summed."""
    folder = _landed_events(spark, sf)
    out, progress, ck = (scratch_path(spark, "progress-out"), scratch_path(spark, "progress"),
                         scratch_path(spark, "progress-ck"))
    RM.run_with_progress(RM.event_source(spark, folder), out, progress, ck,
                         lambda b: EV.normalize_events(b).select("event_id", "wd", "kind"))
    p = RM.read_progress(spark, progress).where("num_input_rows > 0")
    return p.agg(F.count(F.lit(1)).alias("n_batches"), F.sum("num_input_rows").alias("n_input_rows"))


@query("remerge_incremental")
def q_remerge_incremental(spark, sf):
    """F8 incremental: the corpus is lexed once; each event batch re-lexes
    only the files its events name (a user's events touch that user's part
    file) and re-merges their projects from the facts table."""
    folder = _landed_events(spark, sf)
    facts, out, ck = (scratch_path(spark, "facts"), scratch_path(spark, "remerge-inc-out"),
                      scratch_path(spark, "remerge-inc-ck"))
    ev = RM.normalized_stream(spark, folder, max_files_per_trigger=2)
    files = C.ts_corpus(spark, sf)
    path_of = lambda b: b.select(F.concat(F.lit("src/part/"), F.col("wd").cast("string"), F.lit(".ts")).alias("path"))
    q = RM.start_remerge_incremental(ev, files, facts, out, ck, path_of)
    q.awaitTermination()
    return _big(RM.read_merged(spark, out), "section", "stmt_ord")


@query("remerge_stream")
def q_remerge_stream(spark, sf):
    folder = _landed_events(spark, sf)
    out, ck = scratch_path(spark, "remerge-out"), scratch_path(spark, "remerge-ck")
    ev = RM.normalized_stream(spark, folder, max_files_per_trigger=2)
    files = C.ts_corpus(spark, sf)
    q = RM.start_remerge(ev, files, out, ck, lambda b: b.select((F.col("wd") % C.N_PROJECTS).alias("project_id")),
                         initial=True)  # projects that no event names are merged at start-up
    q.awaitTermination()
    return _big(RM.read_merged(spark, out), "section", "stmt_ord")


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
