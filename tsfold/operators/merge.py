"""C: resolve, order and merge statements into one ordered stream per project.

Output grain is one row per merged statement ``(project_id, out_ord, value)``
plus the order key; no project's text is ever one string. Dense positions come from ``order.dense_rank_within`` (range
partitioning + per-partition offsets), so no task ever holds a whole project.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored
from ..sources import files as S
from . import extract as X
from .order import dense_rank_within

# --- fixed values: node kinds that get a blank line before / a newline after
SPACE_BEFORE = ["Program", "ExportDecl", "Interface", "Class", "Method"]
SPACE_AFTER = ["Program", "ExportDecl", "Interface", "Class"]
# --- end fixed values -------------------------------------------------------


@dataclass(frozen=True)
class MergeOptions:
    preserve_comments: bool = True
    sort_imports: bool = True
    exports_first: bool = True
    dedupe: bool = True
    strict_kinds: bool = False  # C8: drop Unknown-kind statements
    on_conflict: str = "first"  # 'first' keeps lowest (file_ord, stmt_ord); 'error' raises


# ------------------------------------------------------------------ C1

def export_conflicts(exports: DataFrame) -> DataFrame:
    """A name exported more than once in one project. Aggregates are
    bounded per group (count, first/last location), never a list of paths."""
    e = exports.where(F.col("export_name").isNotNull())
    first = F.min_by("path", F.struct("file_ord", "path", "stmt_ord"))
    return e.groupBy("project_id", "export_name").agg(
        F.count(F.lit(1)).alias("n_exports"),
        F.countDistinct("path").alias("n_files"),
        first.alias("first_path"),
        F.max_by("path", F.struct("file_ord", "path", "stmt_ord")).alias("last_path"),
    ).where(F.col("n_exports") > 1)


def export_map(exports: DataFrame) -> DataFrame:
    """One export per (project, name): the first by (file_ord, path, stmt_ord, line).
    Partial aggregation before the shuffle; this side of C2 is many-to-one. Columns that ``exports`` lacks are left out."""
    e = exports.where(F.col("export_name").isNotNull())
    kept = [c for c in ("path", "file_ord", "stmt_ord", "line", "row", "kind", "value", *PLACE) if c in exports.columns]
    best = F.min_by(F.struct(*kept), F.struct("file_ord", "path", "stmt_ord", "line"))
    return e.groupBy("project_id", "export_name").agg(best.alias("x")).select(
        "project_id", "export_name", *[F.col(f"x.{c}").alias(f"export_{c.lstrip('_')}") for c in kept])


# ------------------------------------------------------------------ C2/C3

def resolve_imports(imports: DataFrame, exports: DataFrame, with_value: bool = False) -> DataFrame:
    """Left equi-join of imports with the project's export map on
    (project_id, name). AQE picks broadcast from runtime size when the map
    is small and splits a hot name with the skew join otherwise."""
    m = export_map(exports if with_value else exports.drop("value")).withColumnRenamed("export_name", "imported_name")
    j = imports.join(m.withColumn("_hit", F.lit(True)), ["project_id", "imported_name"], "left")
    return j.withColumn("resolved", F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit")


def unresolved_imports(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """Imports whose name no export of the project provides (anti join)."""
    m = exports.where(F.col("export_name").isNotNull()).select(
        "project_id", F.col("export_name").alias("imported_name")
    )
    return imports.join(m, ["project_id", "imported_name"], "left_anti")


# ------------------------------------------------------------ dense order

def flatten_program(stmts: DataFrame) -> DataFrame:
    """C4: all top-level statements of a project in file order, dense position."""
    s = stmts.select("project_id", "path", "file_ord", "stmt_ord", "kind", "value")
    return dense_rank_within(s, ["project_id"], ["file_ord", "path", "stmt_ord"], "out_ord")


# ------------------------------------------------------------- C5/C6 keys

def order_key(kind: Column, raw_type: Column, source_path: Column, opts: MergeOptions) -> tuple[Column, Column]:
    """Section and sort path of a statement: 0 hoisted imports (by source
    path, nulls last), 1 exports, 2 the rest."""
    is_imp = raw_type == "import_statement"
    section = F.lit(2)
    if opts.exports_first:
        section = F.when(kind == "ExportDecl", 1).otherwise(2)
    if opts.sort_imports:
        section = F.when(is_imp, 0).otherwise(section)
    sp = F.when(is_imp & F.lit(opts.sort_imports), source_path)
    return section.cast("int"), sp


def spacing(kind: Column, value: Column) -> Column:
    """Blank line before program/export/interface/class/method, newline
    after program/export/interface/class, newline after every node."""
    return F.concat(
        F.when(kind.isin(*SPACE_BEFORE), F.lit("\n")).otherwise(F.lit("")),
        value,
        F.when(kind.isin(*SPACE_AFTER), F.lit("\n")).otherwise(F.lit("")),
        F.lit("\n"),
    )


def strip_comment_value(ccode: Column) -> Column:
    """Statement text without comments: the comment-blanked code from the
    head line on, with trailing blanks of each line removed."""
    return F.regexp_replace(ccode, r"(?m)[ \t]+$", "")


# ---------------------------------------------------------------- C10

# statement facts the merge needs; a facts table with these columns can be
# kept between runs so only changed files are lexed again (F8)
FACT_COLUMNS = [
    "project_id", "path", "file_ord", "stmt_ord", "kind", "raw_type", "is_export", "value", "ccode",
    "export_names", "nested_exports", "import_names", "source_path",
]
# number of a stored statement, and where in its text an export lies: what stands for a text while rows are ordered
PLACE = ["_sid", "at", "n_bytes"]


def merge_facts(files: DataFrame, opts: MergeOptions | None = None) -> DataFrame:
    """Facts for merges of any options, or those that merges with ``opts`` read: comments that stay need no second text."""
    without = ["ccode"] if opts and opts.preserve_comments else []
    return X.extract_facts(files).select(*[c for c in FACT_COLUMNS if c not in without])


def numbered(facts: DataFrame) -> DataFrame:
    """``facts`` stored once, with a number for each row that does not change between the scans of it."""
    return stored(facts.withColumn("_sid", F.monotonically_increasing_id()), "facts")


def merge_rows(files: DataFrame, opts: MergeOptions = MergeOptions()) -> DataFrame:
    """C10 flagship: exports -> resolve imports -> flatten -> comments ->
    sort imports -> exports first -> dedupe -> spacing.

    Returns one row per merged statement with its order key and dense
    ``out_ord`` within the project.
    """
    return merge_rows_from_facts(merge_facts(files, opts), opts)


def merge_rows_from_facts(facts: DataFrame, opts: MergeOptions = MergeOptions()) -> DataFrame:
    """C10 from statement facts (``FACT_COLUMNS``). The facts are read by
    several branches (exports, imports, own statements), so they are
    stored once unless they come numbered from storage (``numbered``).

    Names, places and order keys go through the joins, the dedupe and the ordering alone. A row says by ``_sid``, ``at``
    and ``n_bytes`` where its text lies; the texts join the rows that are left, once and at the end."""
    st = facts if "_sid" in facts.columns else numbered(facts)
    if opts.strict_kinds:
        st = st.where(F.col("kind") != "Unknown")
    names = st.drop("value", "ccode")
    ex = X.exports_from(names, text="value" if opts.preserve_comments else "ccode", places=True)
    if opts.on_conflict == "error":
        bad = export_conflicts(ex).limit(1).count()
        if bad:
            raise ValueError("conflicting exports found; see export_conflicts()")
    im = X.imports_from(names)
    # statement-level resolution: an import statement is inlined iff all its
    # names resolve; then each name becomes the exported declaration.
    r = stored(resolve_imports(im, ex), "resolved")
    per_stmt = r.groupBy("project_id", "path", "stmt_ord").agg(
        F.min(F.col("resolved").cast("int")).alias("all_resolved")
    )
    inlined = r.join(per_stmt, ["project_id", "path", "stmt_ord"]).where("all_resolved = 1").select(
        "project_id", "path", "file_ord", "stmt_ord", "name_ord",
        F.col("export_kind").alias("kind"), F.lit("export_statement").alias("raw_type"),
        F.lit(None).cast("string").alias("source_path"),
        F.col("export_sid").alias("_sid"), F.col("export_at").alias("at"), F.col("export_n_bytes").alias("n_bytes"),
        F.col("export_path").alias("origin_path"), F.col("export_stmt_ord").alias("origin_stmt_ord"),
        F.col("export_line").alias("origin_line"), F.col("export_row").alias("origin_row"),
    )
    own = names.join(per_stmt.where("all_resolved = 1"), ["project_id", "path", "stmt_ord"], "left_anti")
    own = own.select(
        "project_id", "path", "file_ord", "stmt_ord", F.lit(0).alias("name_ord"),
        "kind", "raw_type", "source_path", "_sid", F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("n_bytes"),
        F.col("path").alias("origin_path"), F.col("stmt_ord").alias("origin_stmt_ord"),
        F.lit(-1).alias("origin_line"), F.lit(-1).cast("bigint").alias("origin_row"),
    )
    rows = own.unionByName(inlined)
    section, sp = order_key(F.col("kind"), F.col("raw_type"), F.col("source_path"), opts)
    rows = rows.withColumn("section", section).withColumn("sort_path", sp).drop("raw_type", "source_path")
    if opts.dedupe:
        # keep the first occurrence per origin: min order key per origin
        # (partial aggregation copes with a hot origin), semi join back. The
        # origin of an inlined member is its own line, not its namespace.
        key = F.struct(
            "section", F.coalesce("sort_path", F.lit("￿")).alias("sp"), "file_ord", "path", "stmt_ord", "name_ord"
        )
        rows = stored(rows.withColumn("_k", key), "rows")  # read twice
        origin = ["project_id", "origin_path", "origin_stmt_ord", "origin_line"]
        firsts = rows.groupBy(*origin).agg(F.min("_k").alias("_k"))
        rows = rows.join(firsts, [*origin, "_k"], "left_semi").drop("_k")
    rows = rows.withColumn("sort_path_nl", F.coalesce("sort_path", F.lit("￿")))
    out = dense_rank_within(
        rows, ["project_id"], ["section", "sort_path_nl", "file_ord", "path", "stmt_ord", "name_ord"], "out_ord", whole=True
    )
    texts = st.select("_sid", F.col("value" if opts.preserve_comments else "ccode").alias("_text"))
    text = F.when(F.col("origin_line") >= 0, X.member_text(F.col("_text"), F.col("at"), F.col("n_bytes"))).otherwise(F.col("_text"))
    return out.join(texts, "_sid").select(
        "project_id", "out_ord", "section", "sort_path", "path", "file_ord", "stmt_ord", "name_ord",
        "kind", "origin_path", "origin_stmt_ord", "origin_line", "origin_row",
        spacing(F.col("kind"), text if opts.preserve_comments else strip_comment_value(text)).alias("value"),
    )


def merge_text(rows: DataFrame) -> DataFrame:
    """Rows, bytes and md5 of the text of each project. The text is never one
    string: ``rows`` is it at row grain (what A6 writes), ``text_chunks`` in pieces of bounded size.
    ``too_large`` is always false; it stays for readers of the column."""
    return S.stream_digest(rows, ["out_ord"]).withColumn("too_large", F.lit(False))


def comment_carry(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """C11: comments of merged statements, at the place where the statement
    itself first went, be it in its own file's turn or inlined before it: one
    row per comment, before, inside or behind the statement's code, numbered in order.

    A statement's text begins outside any literal, so its comments are the
    comment tokens of that text; no file is read again for them."""
    c = facts.where((F.instr("value", "//") > 0) | (F.instr("value", "/*") > 0)).select(
        "project_id", "path", "stmt_ord", F.posexplode(X.L.comment_tokens(X.L.tokens(F.col("value")))).alias("comment_ord", "comment"))
    kept = rows.where(F.col("origin_line") < 0).groupBy(
        "project_id", F.col("origin_path").alias("path"), F.col("origin_stmt_ord").alias("stmt_ord")
    ).agg(F.min("out_ord").alias("out_ord"))
    return c.join(kept, ["project_id", "path", "stmt_ord"])


def drop_unknown(stmts: DataFrame) -> DataFrame:
    """Skip Unknown-kind statements."""
    return stmts.where(F.col("kind") != "Unknown")
