"""G roadmap operators on imports, declarations and merged output:
import scope (G5), import path normalisation (G6), redundant (G7) and
unused (G8) imports, dead declarations (G9), cross-module references (G10),
usage position (G3), namespace merging (G4), line provenance (G12) and the
index-file export order (C13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extract as X
from . import reexports as R
from .order import dense_rank_within

# --- fixed values: built-in module names (Node.js core modules) -------------
BUILTIN_MODULES = [
    "assert", "buffer", "child_process", "cluster", "crypto", "dgram", "dns", "events",
    "fs", "http", "http2", "https", "net", "os", "path", "perf_hooks", "process",
    "querystring", "readline", "stream", "string_decoder", "timers", "tls", "tty", "url",
    "util", "v8", "vm", "worker_threads", "zlib",
]
# --- end fixed values -------------------------------------------------------


def import_scope(imports: DataFrame) -> DataFrame:
    """Internal (relative or absolute path), built-in (core module or
    ``node:`` prefix), else external package."""
    sp = F.col("source_path")
    base = F.regexp_extract(sp, r"^(?:node:)?([^/]+)", 1)
    scope = (
        F.when(sp.startswith(".") | sp.startswith("/"), "internal")
        .when(sp.startswith("node:") | base.isin(*BUILTIN_MODULES), "builtin")
        .when(sp.isNotNull(), "external")
    )
    return imports.withColumn("scope", scope)


def normalize_path(importer: Column, source: Column) -> Column:
    """Resolve ``source`` relative to the importing file's folder with a
    stack fold over path segments ('.' skipped, '..' pops)."""
    folder = F.regexp_extract(importer, r"^(.*)/[^/]*$", 1)
    joined = F.when(source.startswith("/"), source).otherwise(F.concat_ws("/", folder, source))
    segs = F.split(joined, "/")
    empty = F.array().cast("array<string>")
    stack = F.aggregate(
        segs, empty,
        lambda acc, s: F.when((s == "") | (s == "."), acc)
        .when((s == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.size(acc) - 1))
        .otherwise(F.concat(acc, F.array(s))),
    )
    rel = F.array_join(stack, "/")
    return (F.when(source.startswith("."), rel)
            .when(source.startswith("/"), F.concat(F.lit("/"), rel)).otherwise(source))


def normalize_import_paths(imports: DataFrame) -> DataFrame:
    return imports.withColumn("resolved_path", normalize_path(F.col("path"), F.col("source_path")))


def redundant_imports(imports: DataFrame) -> DataFrame:
    """The same (file, name, source) imported more than once."""
    return imports.where(F.col("imported_name").isNotNull()).groupBy(
        "project_id", "path", "imported_name", "source_path"
    ).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unused_imports(stmts: DataFrame) -> DataFrame:
    """Imported local names that no non-import statement of the same
    file mentions (identifiers of masked code; anti join)."""
    imp = X.imports_from(stmts).where(F.col("local_name").isNotNull())
    used = stmts.where(F.col("raw_type") != "import_statement").select(
        "project_id", "path", F.explode(X.L.identifiers(F.col("mcode"))).alias("local_name")
    ).distinct()
    return imp.join(used, ["project_id", "path", "local_name"], "left_anti")


def located_refs(stmts: DataFrame, distinct: bool = True) -> DataFrame:
    """B9 with identity: one row per referencing statement and declaration it
    names, both given by (path, stmt_ord).

    A name means the file's own declaration, else what the file imports under
    it (from the module that the import's path names, or what that module
    re-exports under the name), else an export of the
    project. A name imported from outside the project or as a whole module
    has no declaration here and gives no row.

    Two joins, both with one row per key on the declaration side: the names
    a file knows, then the declarations by place (file, module, or project).
    AQE's skew join splits a popular name. Without ``distinct`` a reference may come several times, for readers that
    group or distinguish its columns themselves."""
    own = stmts.select(
        "project_id", "path", "file_ord", "stmt_ord", "is_export", F.explode(X.declared_names(stmts)).alias("name")
    )
    declared = own.groupBy("project_id", "path", F.col("name").alias("word")).agg(F.min("stmt_ord").alias("own_ord"))
    imported = stmts.where(F.col("raw_type") == "import_statement").select(
        "project_id", "path", "stmt_ord", "source_path", F.posexplode("import_names").alias("name_ord", "n")
    ).where(F.col("n.local_name").isNotNull()).groupBy("project_id", "path", F.col("n.local_name").alias("word")).agg(
        F.min_by(F.struct(F.col("n.imported_name").alias("name"), F.col("source_path").alias("source")),
                 F.struct("stmt_ord", "name_ord")).alias("imp")
    )
    known = declared.join(imported, ["project_id", "path", "word"], "full_outer")

    names = X.declared_names(stmts)
    refs = stmts.where(F.size(names) > 0).select(
        "project_id", "path", "file_ord", "stmt_ord", F.coalesce("name", names[0]).alias("src"),
        F.explode(X.L.identifiers(F.col("mcode"))).alias("word"),
    ).where(F.col("src") != F.col("word"))
    source = F.col("imp.source")
    place = (
        F.when(F.col("own_ord").isNotNull(), F.col("path"))
        .when(F.col("imp").isNull(), F.lit(""))
        .when(source.startswith(".") | source.startswith("/"),
              F.concat(F.lit("module:"), R.module_of(normalize_path(F.col("path"), source))))
    )
    name = F.when(F.col("own_ord").isNull(), F.col("imp.name"))
    refs = refs.join(known, ["project_id", "path", "word"], "left").select(
        "project_id", F.col("path").alias("src_path"), "file_ord", F.col("stmt_ord").alias("src_stmt_ord"), "src",
        place.alias("place"), F.coalesce(name, "word").alias("dst"),
    ).where(F.col("place").isNotNull())

    places = F.array(F.col("path"), F.concat(F.lit("module:"), R.module_of(F.col("path"))),
                     F.when(F.col("is_export"), F.lit("")))
    targets = own.select("*", F.explode(places).alias("place")).where(F.col("place").isNotNull()).select(
        "project_id", "place", F.col("name").alias("dst"), F.struct("path", "stmt_ord", "name").alias("to"),
        F.struct((~F.col("is_export")).cast("int").alias("rank"), "file_ord", "path", "stmt_ord").alias("key"))
    passed = R.resolve(stmts) if "export_links" in stmts.columns else None
    if passed is not None:  # names that a module passes on come after those it declares and exports
        passed = passed.where("dst IS NOT NULL").select(
            "project_id", F.concat(F.lit("module:"), R.module_of(F.col("path"))).alias("place"), F.col("name").alias("dst"),
            F.struct(F.col("dst_path").alias("path"), F.col("dst_stmt_ord").alias("stmt_ord"), F.col("dst").alias("name")).alias("to"),
            F.struct(F.lit(0).alias("rank"), F.lit(2 ** 62).alias("file_ord"), "path", F.col("dst_stmt_ord").alias("stmt_ord")).alias("key"))
        targets = targets.unionByName(passed)
    targets = targets.groupBy("project_id", "place", "dst").agg(F.min_by("to", "key").alias("to"))
    found = refs.join(targets, ["project_id", "place", "dst"]).select(
        "project_id", "src_path", "file_ord", "src_stmt_ord", "src",
        F.col("to.path").alias("dst_path"), F.col("to.stmt_ord").alias("dst_stmt_ord"), F.col("to.name").alias("dst"),
    ).where((F.col("src_path") != F.col("dst_path")) | (F.col("src_stmt_ord") != F.col("dst_stmt_ord")))
    return found.distinct() if distinct else found


def dead_decls(decls: DataFrame, refs: DataFrame) -> DataFrame:
    """Declarations that are not exported and that no located reference
    points to."""
    targets = refs.select("project_id", F.col("dst_path").alias("path"), F.col("dst").alias("name")).distinct()
    return decls.where(~F.col("is_export")).join(targets, ["project_id", "path", "name"], "left_anti")


def cross_module_refs(refs: DataFrame) -> DataFrame:
    """Located references whose two declarations live in different files."""
    return refs.where(F.col("src_path") != F.col("dst_path")).select(
        "project_id", "src_path", "src", "dst_path", "dst").distinct()


def usage_position(refs: DataFrame) -> DataFrame:
    """For each referenced declaration, the first statement (by file
    order) that references it -- where usage-based placement would put it."""
    first = F.min_by(F.struct(F.col("src_path").alias("path"), F.col("src_stmt_ord").alias("stmt_ord")),
                     F.struct("file_ord", "src_path", "src_stmt_ord"))
    return refs.groupBy("project_id", F.col("dst_path").alias("path"), F.col("dst").alias("name")).agg(
        first.alias("x")).select("project_id", "path", "name", F.col("x.path").alias("first_use_path"),
                                 F.col("x.stmt_ord").alias("first_use_stmt_ord"))


def namespace_merge(stmts: DataFrame) -> DataFrame:
    """Same-named namespaces of a project merged: members with the number
    of files declaring them; a member declared by more than one file is a
    conflict. Counts are partial aggregates (no member lists)."""
    m = X.contains_edges_from(stmts)
    return m.groupBy("project_id", F.col("src").alias("namespace"), F.col("dst").alias("member")).agg(
        F.countDistinct("path").alias("n_files")
    ).withColumn("conflict", F.col("n_files") > 1)


def line_provenance(rows: DataFrame, stmts: DataFrame) -> DataFrame:
    """Each line of a merged statement -> (source path, source row).
    Merged rows carry their origin statement; its start row plus the line's
    offset inside the statement text gives the source row. The lines of an
    inlined namespace member start at its own line."""
    src = stmts.select(
        "project_id", F.col("path").alias("origin_path"), F.col("stmt_ord").alias("origin_stmt_ord"),
        "start_row", F.col("value").alias("_v"),
    )
    member = F.col("origin_line") >= 0
    own = F.when(member, F.split(F.btrim("value", F.lit("\n")), "\n", -1))
    j = rows.select("project_id", "out_ord", "origin_path", "origin_stmt_ord", "origin_line", "origin_row", own.alias("_own")).join(
        src, ["project_id", "origin_path", "origin_stmt_ord"]
    ).withColumn("start_row", F.when(member, F.col("origin_row")).otherwise(F.col("start_row")))
    return j.select(
        "project_id", "out_ord", "origin_path", "start_row",
        F.posexplode(F.coalesce("_own", F.split("_v", "\n"))).alias("k", "_line"),
    ).select(
        "project_id", "out_ord", F.col("k").cast("bigint").alias("line_in_stmt"),
        F.col("origin_path").alias("src_path"), (F.col("start_row") + F.col("k")).alias("src_row"),
    )


def index_export_order(stmts: DataFrame, index_name: str = "index.ts") -> DataFrame:
    """Exports follow the order in which the project's index file names
    them (``export { a } from './x'``); names the index lacks come after, in
    file order. Dense position per project without a per-project task."""
    is_index = F.col("path").endswith("/" + index_name) | (F.col("path") == index_name)
    idx = X.exports_from(stmts.where(is_index), nested=False).groupBy(
        "project_id", "export_name"
    ).agg(F.min("stmt_ord").alias("index_ord"))
    ex = X.exports_from(stmts.where(~is_index), nested=False).where(F.col("export_name").isNotNull())
    j = ex.join(idx, ["project_id", "export_name"], "left")
    j = j.withColumn("_io", F.coalesce(F.col("index_ord"), F.lit(2 ** 31 - 1)))
    return dense_rank_within(j, ["project_id"], ["_io", "file_ord", "path", "stmt_ord"], "out_ord").drop("_io")
