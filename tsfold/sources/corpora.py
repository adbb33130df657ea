"""Source corpora derived by Spark from the given tables.

Each builder turns rows of a base table into rows of the ``files`` table
(``project_id, path, file_ord, content, n_bytes``) or another logical table
(edges, nodes, raw watcher events). Their size grows with the base tables, so
every query built on them does work proportional to the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

N_PROJECTS = 16  # projects of the TypeScript corpora: key % 16
ORDER_FILE_BASE = 1_000_000_000  # file_ord offset of order files (after parts)


def _s(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def files_frame(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("project_id").cast("bigint").alias("project_id"),
        "path",
        F.col("file_ord").cast("bigint").alias("file_ord"),
        "content",
        F.octet_length("content").cast("bigint").alias("n_bytes"),
    )


def ts_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exported class per part (FIXTURES 3.1)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    k = _s("p_partkey")
    content = F.concat(
        F.lit("// part "), k, F.lit("\nexport class Part"), k, F.lit(" {\n"),
        F.lit("    brand: string = '"), F.col("p_brand"), F.lit("';\n"),
        F.lit("    size: number = "), _s("p_size"), F.lit(";\n}\n"),
    )
    return files_frame(p.select(
        (F.col("p_partkey") % N_PROJECTS).alias("project_id"),
        F.concat(F.lit("src/part/"), k, F.lit(".ts")).alias("path"),
        F.col("p_partkey").alias("file_ord"),
        content.alias("content"),
    ))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order, its parts in line order (l_linenumber, l_partkey).

    The group is one order (a handful of lines), i.e. one source file; files
    are bounded by the 10 MiB quarantine limit downstream.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return li.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("ln")
    )


def ts_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports + exported const + private helper per order (FIXTURES 3.2)."""
    o = order_lines(spark, sf_dir)
    k = _s("l_orderkey")
    imports = F.array_join(
        F.transform("ln", lambda x: F.concat(
            F.lit("import { Part"), _s(x["l_partkey"]), F.lit(" } from '../part/"),
            _s(x["l_partkey"]), F.lit("';"))),
        "\n",
    )
    news = F.array_join(
        F.transform("ln", lambda x: F.concat(F.lit("new Part"), _s(x["l_partkey"]), F.lit("()"))),
        ", ",
    )
    content = F.concat(
        imports, F.lit("\n/* order "), k, F.lit(" */\nexport const order"), k,
        F.lit(" = ["), news, F.lit("];\nfunction helper"), k, F.lit("() {\n    return order"),
        k, F.lit(";\n}\n"),
    )
    return files_frame(o.select(
        (F.col("l_orderkey") % N_PROJECTS).alias("project_id"),
        F.concat(F.lit("src/order/"), k, F.lit(".ts")).alias("path"),
        (F.col("l_orderkey") + ORDER_FILE_BASE).alias("file_ord"),
        content.alias("content"),
    ))


def ts_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts_parts(spark, sf_dir).unionByName(ts_orders(spark, sf_dir))


def ts_broken_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts_parts with defects chosen by p_size: size <= 2 -> empty file,
    size 3..4 -> '.js' path (wrong suffix), size >= 45 -> closing brace
    missing (unbalanced). Feeds the rejects table."""
    f = ts_parts(spark, sf_dir)
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_ord"), "p_size")
    j = f.join(p, "file_ord")
    content = (
        F.when(F.col("p_size") <= 2, F.lit(""))
        .when(F.col("p_size") >= 45, F.regexp_replace("content", r"\}\n$", ""))
        .otherwise(F.col("content"))
    )
    path = F.when(F.col("p_size").between(3, 4), F.regexp_replace("path", r"\.ts$", ".js")).otherwise(F.col("path"))
    return files_frame(j.select("project_id", path.alias("path"), "file_ord", content.alias("content")))


def ts_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exported const named after the brand per part: conflicting exports
    inside a project (FIXTURES 3.3)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    k = _s("p_partkey")
    content = F.concat(
        F.lit("export const "), F.regexp_replace("p_brand", "#", "_"), F.lit(" = "), k, F.lit(";\n")
    )
    return files_frame(p.select(
        (F.col("p_partkey") % N_PROJECTS).alias("project_id"),
        F.concat(F.lit("src/brand/"), k, F.lit(".ts")).alias("path"),
        F.col("p_partkey").alias("file_ord"),
        content.alias("content"),
    ))


def ts_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with methods and namespaces with members, one file per
    customer with orders (FIXTURES 3.7, ours): a top-level interface, a class
    with one method per order, and a namespace ``Group<custkey % 7>`` (so
    same-named namespaces meet in a project) holding a shared ``Config``
    interface and one class per order, two unused imports (a built-in and an
    external module) and a type alias (a kind the kind map lacks). Feeds
    contains/method/ref edges, namespace merging, import scope/unused
    imports and dropping of Unknown kinds."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    per = o.groupBy("o_custkey").agg(
        F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("os")
    )
    c = _s("o_custkey")
    g = _s(F.col("o_custkey") % 7)
    methods = F.array_join(
        F.transform("os", lambda x: F.concat(
            F.lit("    order"), _s(x["o_orderkey"]), F.lit("(): string {\n        return '"),
            x["o_orderstatus"], F.lit("';\n    }\n"))),
        "",
    )
    members = F.array_join(
        F.transform("os", lambda x: F.concat(
            F.lit("    export class Order"), _s(x["o_orderkey"]), F.lit(" extends Base"), c,
            F.lit(" {\n        status(): string {\n            return '"), x["o_orderstatus"],
            F.lit("';\n        }\n    }\n"))),
        "",
    )
    content = F.concat(
        F.lit("import { readFile } from 'fs';\nimport * as lodash from 'lodash';\n"),
        F.lit("interface Base"), c, F.lit(" {\n    status(): string;\n}\n"),
        F.lit("export class Account"), c, F.lit(" implements Base"), c, F.lit(" {\n"),
        F.lit("    status(): string {\n        return 'open';\n    }\n"), methods, F.lit("}\n"),
        F.lit("export namespace Group"), g, F.lit(" {\n    export interface Config {\n        id: number;\n    }\n"),
        members, F.lit("}\n"),
        F.lit("type Status"), c, F.lit(" = 'open' | 'closed';\n"),
    )
    return files_frame(per.select(
        (F.col("o_custkey") % N_PROJECTS).alias("project_id"),
        F.concat(F.lit("src/customer/"), c, F.lit(".ts")).alias("path"),
        F.col("o_custkey").alias("file_ord"),
        content.alias("content"),
    ))


def ts_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order (one project per order): one file per distinct part with an
    exported class, plus ``index.ts`` re-exporting the parts in line order.
    The index names parts in an order unrelated to file order (C13)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = li.select("l_orderkey", "l_partkey").distinct()
    pk = _s("l_partkey")
    pf = files_frame(parts.select(
        F.col("l_orderkey").alias("project_id"),
        F.concat(F.lit("src/part/"), pk, F.lit(".ts")).alias("path"),
        F.col("l_partkey").alias("file_ord"),
        F.concat(F.lit("export class Part"), pk, F.lit(" {}\n")).alias("content"),
    ))
    o = order_lines(spark, sf_dir)
    idx = F.array_join(
        F.transform("ln", lambda x: F.concat(
            F.lit("export { Part"), _s(x["l_partkey"]), F.lit(" } from './part/"), _s(x["l_partkey"]),
            F.lit("';"))),
        "\n",
    )
    ix = files_frame(o.select(
        F.col("l_orderkey").alias("project_id"), F.lit("src/index.ts").alias("path"),
        F.lit(0).alias("file_ord"), F.concat(idx, F.lit("\n")).alias("content"),
    ))
    return pf.unionByName(ix)


def ts_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense code, one file per part: several statements on a line, several declarators, binding patterns, a namespace
    and its members on one line, a trailing comment, and template literals nested up to seven deep (by ``p_size``)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    deep = (F.col("p_size") % 7 + 1).cast("int")
    nest = F.concat(F.expr("repeat('`${', cast(p_size % 7 + 1 as int))"), F.lit("1"), F.repeat(F.lit("}`"), deep))
    lines = [
        "class C# {} class E# extends C# {}",
        "export const a# = 1, b# = new C#(); let { p#, q: r# = { z: 2 }, ...s# } = a#;",
        "const t# = `x${ b# ? `}{ ${ p# } {` : '`' }y` + @; export function f#() {} f#();",
        "export namespace N# { export const m# = 1, n# = 2; export class K# { go() {} } }",
        "const z# = 2; // tail #", "",
    ]
    content = F.replace(F.replace(F.lit("\n".join(lines)), F.lit("#"), _s("p_partkey")), F.lit("@"), nest)
    return files_frame(p.select(
        (F.col("p_partkey") % N_PROJECTS).alias("project_id"),
        F.concat(F.lit("src/shape/"), _s("p_partkey"), F.lit(".ts")).alias("path"),
        F.col("p_partkey").alias("file_ord"), content.alias("content"),
    ))


def ts_barrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that travel through barrels: a part's class is listed (every other one under an alias) in a barrel of eight
    parts, barrels are gathered by ``index.ts`` files with ``export *``, these by ``src/entry.ts``, and users import
    from the entry. The index files also pass on the entry (a circle of stars), and two files of each
    barrel pass a name to each other that nobody declares (a circle of lists)."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    p = p.select("k", (F.col("k") % N_PROJECTS).alias("project_id"), F.floor(F.col("k") / (8 * N_PROJECTS)).cast("bigint").alias("g"))
    p = p.withColumn("h", F.floor(F.col("g") / 8).cast("bigint"))
    k, g, h = _s("k"), _s("g"), _s("h")
    odd = F.col("k") / N_PROJECTS % 2 >= 1

    def file(rows: DataFrame, path: Column, order: Column, content: Column) -> DataFrame:
        return files_frame(rows.select("project_id", path.alias("path"), order.alias("file_ord"), content.alias("content")))

    def gathered(rows: DataFrame, keys: list[str], order: str, line: Column) -> DataFrame:
        lines = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
        return rows.groupBy("project_id", *keys).agg(F.concat(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit("\n")).alias("content"))

    groups = p.select("project_id", "g", "h").distinct()
    parts = file(p, F.concat(F.lit("src/part/"), k, F.lit(".ts")), F.col("k"), F.concat(F.lit("export class Part"), k, F.lit(" {}\n")))
    listed = gathered(p, ["g"], "k", F.concat(
        F.lit("export { Part"), k, F.when(odd, F.concat(F.lit(" as Alias"), k)).otherwise(""), F.lit(" } from '../part/"), k, F.lit("';")))
    barrels = file(listed, F.concat(F.lit("src/b1/"), g, F.lit(".ts")), F.col("g") + 10 ** 9, F.col("content"))
    stars = gathered(groups, ["h"], "g", F.concat(F.lit("export * from '../../b1/"), g, F.lit("';")))
    index = file(stars, F.concat(F.lit("src/b2/"), h, F.lit("/index.ts")), F.col("h") + 2 * 10 ** 9,
                 F.concat("content", F.lit("export * from '../../entry';\n")))
    entries = gathered(groups.select("project_id", "h").distinct(), [], "h", F.concat(F.lit("export * from './b2/"), h, F.lit("';")))
    entry = file(entries, F.lit("src/entry.ts"), F.lit(3 * 10 ** 9), F.col("content"))
    name = F.when(odd, F.concat(F.lit("Alias"), k, F.lit(" as It"))).otherwise(F.concat(F.lit("Part"), k))
    word = F.when(odd, F.lit("It")).otherwise(F.concat(F.lit("Part"), k))
    users = file(p, F.concat(F.lit("src/use/"), k, F.lit(".ts")), F.col("k") + 4 * 10 ** 9, F.concat(
        F.lit("import { "), name, F.lit(" } from '../entry';\nexport const use"), k, F.lit(" = new "), word, F.lit("();\n")))
    out = parts.unionByName(barrels).unionByName(index).unionByName(entry).unionByName(users)
    for i, (mine, other) in enumerate((("x", "y"), ("y", "x"))):
        out = out.unionByName(file(groups, F.concat(F.lit("src/loop/"), g, F.lit(f"{mine}.ts")), F.col("g") + (5 + i) * 10 ** 9, F.concat(
            F.lit("export { Loop"), g, F.lit(" } from './"), g, F.lit(f"{other}';\n"))))
    return out.unionByName(file(groups, F.concat(F.lit("src/loop/"), g, F.lit("z.ts")), F.col("g") + 7 * 10 ** 9, F.concat(
        F.lit("import { Loop"), g, F.lit(" } from './"), g, F.lit("x';\nconst end"), g, F.lit(" = Loop"), g, F.lit(";\n"))))


def ts_changes(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Five batches of changes to ``ts_corpus``, as change events (version, project_id, path, file_ord, kind, content):
    1 a field added to the classes of large parts, 2 only the comment of others, 3 small parts deleted, 4 new files
    that use a part in a body alone, 5 a field added to those parts."""
    parts = ts_parts(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_ord"), "p_size"), "file_ord")
    field = F.regexp_replace("content", r"\}\n$", "    added: boolean = true;\n}\n")
    k = _s("file_ord")
    extra = F.concat(F.lit("import { Part"), k, F.lit(" } from '../part/"), k, F.lit("';\nexport const extra"), k,
                     F.lit(" = 1;\nfunction local() {\n    return new Part"), k, F.lit("();\n}\n"))

    def batch(version: int, some: DataFrame, kind: str, content: Column, path: Column = F.col("path")) -> DataFrame:
        return some.select(F.lit(version).cast("bigint").alias("version"), "project_id", path.alias("path"), "file_ord",
                           F.lit(kind).alias("kind"), content.cast("string").alias("content"))

    two = parts.where("p_size = 2")
    return [
        batch(1, parts.where("p_size >= 45"), "modify", field),
        batch(2, parts.where("p_size BETWEEN 40 AND 44"), "modify", F.regexp_replace("content", "^// part", "// revised part")),
        batch(3, parts.where("p_size = 1"), "delete", F.lit(None)),
        batch(4, two, "create", extra, F.concat(F.lit("src/extra/"), k, F.lit(".ts"))),
        batch(5, two, "modify", field),
    ]


def pages_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as HTML files (second language plug-in for comments)."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return p.select(
        F.col("page_id").alias("project_id"), F.col("url").alias("path"), F.col("page_id").alias("file_ord"),
        F.col("html").alias("content"), F.octet_length("html").cast("bigint").alias("n_bytes"),
    )


def documents_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as plain files: project = source, file order = doc_id.
    project_id is a string here (source names)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return d.select(
        F.col("source").alias("project_id"),
        F.concat(F.lit("docs/"), _s("doc_id"), F.lit(".txt")).alias("path"),
        F.col("doc_id").alias("file_ord"),
        F.col("text").alias("content"),
        F.octet_length("text").cast("bigint").alias("n_bytes"),
    )


def edges_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path graph per order: previous part -> part in line order (FIXTURES 3.4).
    Cycle (self-loops included) iff a part repeats in the order."""
    from pyspark.sql.window import Window

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    e = li.select(
        F.col("l_orderkey").alias("project_id"),
        F.lag("l_partkey").over(w).alias("a"),
        F.col("l_partkey").alias("b"),
    ).where(F.col("a").isNotNull())
    return e.select(
        "project_id",
        F.concat(F.lit("p"), _s("a")).alias("src"),
        F.concat(F.lit("p"), _s("b")).alias("dst"),
        F.lit("uses").alias("edge_kind"),
    )


def nodes_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forest region -> nation -> customer -> order (FIXTURES 3.5) as a flat
    node table with parent pointers and a zero-padded sort path."""

    def pad(c, n=12):
        return F.lpad(_s(c), n, "0")

    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    # Paths of parents come from small dimension tables (region 5 rows, nation
    # 25 rows: fixed size by the schema); customer paths join orders by key.
    nat = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", "n_regionkey", "n_name",
        F.concat(pad("n_regionkey"), F.lit("/"), pad("n_nationkey")).alias("np"),
    )
    cus = c.join(F.broadcast(nat), c.c_nationkey == nat.n_nationkey).select(
        "c_custkey", "c_nationkey", "c_mktsegment", F.concat("np", F.lit("/"), pad("c_custkey")).alias("cp")
    )
    rows = [
        r.select(
            F.lit(0).cast("bigint").alias("project_id"),
            F.concat(F.lit("r"), _s("r_regionkey")).alias("node_id"),
            F.lit(None).cast("string").alias("parent_id"),
            pad("r_regionkey").alias("sort_path"),
            F.lit(0).alias("depth"), F.lit("Program").alias("kind"), F.col("r_name").alias("label"),
        ),
        nat.select(
            F.lit(0).cast("bigint"), F.concat(F.lit("n"), _s("n_nationkey")),
            F.concat(F.lit("r"), _s("n_regionkey")), F.col("np"), F.lit(1), F.lit("Class"), F.col("n_name"),
        ),
        cus.select(
            F.lit(0).cast("bigint"), F.concat(F.lit("c"), _s("c_custkey")),
            F.concat(F.lit("n"), _s("c_nationkey")), F.col("cp"), F.lit(2), F.lit("Method"), F.col("c_mktsegment"),
        ),
        o.join(cus, o.o_custkey == cus.c_custkey).select(
            F.lit(0).cast("bigint"), F.concat(F.lit("o"), _s("o_orderkey")),
            F.concat(F.lit("c"), _s("o_custkey")),
            F.concat("cp", F.lit("/"), pad("o_orderkey")), F.lit(3), F.lit("Statement"), F.col("o_orderstatus"),
        ),
    ]
    out = rows[0]
    for x in rows[1:]:
        out = out.union(x)
    return out


# --- fixed values: Linux inotify mask bits (kernel ABI) --------------------
IN_MODIFY = 0x2
IN_CLOSE_WRITE = 0x8
IN_MOVED_FROM = 0x40
IN_MOVED_TO = 0x80
IN_CREATE = 0x100
IN_DELETE = 0x200
IN_DELETE_SELF = 0x400
IN_MOVE_SELF = 0x800
# --- end fixed values --------------------------------------------------------


def raw_events_tbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watcher events from the events table (FIXTURES 3.6): wd = user_id,
    name = user_id.ts, mask from event_type, DELETE added when value > 100."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    base = (
        F.when(F.col("event_type") == "view", IN_MODIFY)
        .when(F.col("event_type") == "purchase", IN_CLOSE_WRITE)
        .when(F.col("event_type") == "error", IN_DELETE)
        .when(F.col("event_type") == "click", IN_MOVED_TO)
        .when(F.col("event_type") == "signup", IN_CREATE)
        .otherwise(0)
    )
    mask = F.when(F.col("value") > 100, base.bitwiseOR(F.lit(IN_DELETE))).otherwise(base)
    return e.select(
        "event_id",
        F.lit("linux").alias("backend"),
        F.col("user_id").alias("wd"),
        F.concat(_s("user_id"), F.lit(".ts")).alias("name"),
        mask.cast("bigint").alias("mask"),
        F.lit(False).alias("is_dir"),
        "ts",
    )


def watched_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watched entries: one directory handle per user (wd = user_id)."""
    e = table(spark, sf_dir, "events").select("user_id").distinct()
    return e.select(
        F.col("user_id").alias("wd"),
        F.concat(F.lit("/w/u"), _s("user_id")).alias("path"),
        F.lit(True).alias("is_dir"),
    )
