"""B: extraction of statements, imports, exports, declarations, comments and
reference edges from a ``files`` DataFrame.

Plan shape (one shuffle): files are hash-partitioned by (project_id, path)
once; each row is tokenised and split into lines *inside the task*; the
per-file running windows and the per-statement aggregation both reuse that
partitioning (HashPartitioning(project_id, path) satisfies clustering on
(project_id, path, stmt_ord)), so no further exchange is planned. A project
is never a unit of work here, only a file (bounded by the quarantine size
limit), so a project holding a third of all files spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexer as L
from ..functions.kinds import classify_kind
from ..session import stored

# A file is identified by (project_id, path); file_ord only orders files and
# may tie between files of different origins in one project.
FILE_KEY = ["project_id", "path"]


DECL_HEAD_WORDS = [
    "export", "default", "declare", "abstract", "async", "class", "interface", "function",
    "namespace", "module", "enum", "type", "const", "let", "var",
]


def _nested_export() -> Column:
    """Whether a row of the line table begins an export inside brackets."""
    return (F.col("depth_before") > 0) & F.col("is_code") & (F.col("fw") == "export")


def lines(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """Internal line table: one row per source line with depth, statement
    number and classification flags. A line that holds several statements is
    cut into as many rows (``cut_lines``), so ``line`` numbers the rows, and
    ``row`` and ``col`` (bytes) say where a row begins in the source.

    All per-line facts that need the masked text are computed right after
    the explode; the masked copy is then dropped, so the window sorts carry
    only the raw line and a few scalars. Window frames are all running
    frames (O(n) per file): three passes in line order share one sort, one
    pass in reverse line order finds the next code line and file totals.
    """
    f = files.select("project_id", "path", "file_ord", "content")
    # Hash-partition whole files (compact rows) by file key once; a fixed
    # partition count keeps the CPU-heavy lexing spread over all cores even
    # when the input is small (AQE would coalesce a keyed repartition).
    n = partitions or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    f = f.repartition(n, *FILE_KEY)
    # Outer explodes here and below: for the plain form Spark puts a filter on the array's size before it, which
    # evaluates the whole array a second time.
    f = f.withColumn("masked", L.masked_text(L.tokens(F.col("content"))))
    f = f.select("project_id", "path", "file_ord", L.cut_lines(F.col("content"), F.col("masked")).alias("c"))
    z = f.select(
        "project_id", "path", "file_ord",
        F.posexplode_outer(F.arrays_zip("c.raw_l", "c.mask_l", "c.place_l")).alias("line", "z"),
    ).where(F.col("line").isNotNull()).select("project_id", "path", "file_ord", "line", F.col("z.raw_l").alias("raw"), F.col("z.mask_l").alias("m"),
             F.coalesce("z.place_l", F.lit(0)).alias("place"))
    m = F.col("m")
    fw = L.first_word(m)
    is_code = ~L.is_blank(m)
    z = z.select(
        "project_id", "path", "file_ord", "line", "raw",
        L.brace_delta(m).alias("delta"),
        (~L.is_blank(F.col("raw"))).alias("nonblank"),
        is_code.alias("is_code"),
        fw.alias("fw"),
        L.last_char(m).alias("lc"),
        (F.col("place").bitwiseAND(1) != 0).alias("mid"),
        (F.col("place").bitwiseAND(2) == 0).alias("eol"),
        F.octet_length("raw").alias("rlen"),
        F.when(F.col("place").bitwiseAND(1) != 0, F.octet_length("raw") - F.octet_length(L.ltrim(F.col("raw"))))
        .otherwise(0).alias("lead"),  # blanks before a statement that does not begin its line
        # these by an expression of their own (``once``): written out in the generated method of this projection they
        # make it longer than the JVM compiles, so that every line of a corpus would be interpreted
        F.when(is_code & fw.isin(*DECL_HEAD_WORDS, "@"), L.once(F.struct(m.alias("m"), fw.alias("fw")), lambda x: L.decl_name(x["m"], x["fw"] == "@"))).alias("m_decl"),
        F.when(is_code & fw.isin(*DECL_HEAD_WORDS, "@"), L.once(F.struct(m.alias("m"), fw.alias("fw")), lambda x: L.decl_keyword(x["m"], x["fw"] == "@"))).alias("m_kw"),
        # syntax type of a possible statement head line (NULL for a line that
        # is only decorators); the statement takes its first head line's type
        F.when(is_code & fw.isin(*L.STATEMENT_KEYWORDS, "@"), L.once(
            F.struct(m.alias("m"), fw.alias("fw")), lambda x: L.raw_type_of_line(x["m"], x["fw"]))).alias("l_type"),
        F.when(is_code & (F.instr(m, "(") > 0), F.regexp_extract(m, L.METHOD_RE, 1)).alias("m_method"),
    )
    w = Window.partitionBy(*FILE_KEY).orderBy("line")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    wr = Window.partitionBy(*FILE_KEY).orderBy(F.col("line").desc())
    rev_upto = wr.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    # Pass 1. Non-code lines change no depth, so the previous code line ends
    # at this line's depth_before: whether it "ended" (';' or '}') or was a
    # decorator needs no depth of its own and is read in the same pass.
    z = z.select(
        "*",
        F.sum("delta").over(upto).alias("depth_after"),
        F.coalesce(F.sum(F.col("rlen") + F.col("eol").cast("int")).over(before), F.lit(0)).cast("bigint").alias("line_byte"),
        (F.col("line") - F.sum(F.col("mid").cast("int")).over(upto)).alias("row"),
        F.coalesce(F.last(F.when(F.col("is_code"), F.col("lc").isin(";", "}")), True).over(before),
                   F.lit(True)).alias("prev_closed"),
        F.coalesce(F.last(F.when(F.col("is_code"), F.col("fw") == "@"), True).over(before),
                   F.lit(False)).alias("prev_deco"),
    ).withColumn("depth_before", F.col("depth_after") - F.col("delta"))
    kw = F.col("fw").isin(*L.STATEMENT_KEYWORDS) | (F.col("fw") == "@")
    start = (
        F.col("is_code") & (F.col("depth_before") == 0)
        & ((kw & ~F.col("prev_deco")) | (~kw & F.col("prev_closed")))
    )
    z = z.withColumn("start", start)
    # Pass 2: statement number and running minimum depth.
    z = z.select(
        "*",
        F.sum(F.col("start").cast("int")).over(upto).alias("grp"),
        F.min("depth_after").over(upto).alias("run_min"),
        F.max(F.when(~F.col("mid"), F.col("line_byte"))).over(upto).alias("row_byte"),
        F.max(_nested_export()).over(upto).alias("nested_before"),
    )
    # reverse pass: next code line at or after this one, and file totals
    # (the first row in reverse order is the file's last line)
    z = z.select(
        "*",
        F.last(F.when(F.col("is_code"), F.col("start")), True).over(rev_upto).alias("next_start"),
        F.first("run_min").over(rev_upto).alias("min_depth"),
        F.first("depth_after").over(rev_upto).alias("final_depth"),
        (F.col("nested_before") | F.max(_nested_export()).over(rev_upto)).alias("nests"),
    )
    stmt = (
        F.when(F.col("is_code"), F.col("grp"))
        .when(F.coalesce(F.col("next_start"), F.lit(False)), F.col("grp") + 1)
        .otherwise(F.col("grp"))
    )
    # a file whose brackets do not balance has no reliable statement borders:
    # it stays one statement (and is reported by ``rejects_unbalanced``)
    balanced = (F.col("min_depth") >= 0) & (F.col("final_depth") == 0)
    return z.withColumns({
        "balanced": balanced, "stmt_ord": F.when(balanced, F.greatest(stmt, F.lit(1))).otherwise(1).cast("int")})


MEMBER = "struct<line:int,row:bigint,byte:bigint,depth:bigint,name:string,stop:bigint>"


def _members_with_ends(ls: Column) -> Column:
    """Nested exports of a statement (its rows of code in order) with the byte at which each ends: behind its first row
    that ends in ';' or '}' back at its depth, or before the next member or the end of the enclosing block. One fold over
    the rows; its state holds the members that are still open."""
    none = F.array().cast(f"array<{MEMBER}>")
    state = f"struct<open:array<{MEMBER}>,done:array<{MEMBER}>,stop:bigint>"
    zero = F.struct(none.alias("open"), none.alias("done"), F.lit(0).cast("bigint").alias("stop")).cast(state)

    def with_end(stop: Column):
        return lambda x: F.struct(x["line"], x["row"], x["byte"], x["depth"], x["name"], stop.alias("stop")).cast(MEMBER)

    def step(acc: Column, y: Column) -> Column:
        stop = y["byte"] + y["rlen"]

        def beyond(x: Column) -> Column:
            return (y["after"] < x["depth"]) | (y["opens"] & (y["before"] <= x["depth"]))

        def closed(x: Column) -> Column:
            return y["closes"] & (y["after"] == x["depth"])

        left = F.filter(acc["open"], lambda x: ~beyond(x))
        done = F.concat(acc["done"], F.transform(F.filter(acc["open"], beyond), with_end(acc["stop"])))
        here = F.when(y["nested"], F.array(F.struct(
            y["line"], y["row"], y["byte"], y["before"].alias("depth"), y["name"], stop.alias("stop")).cast(MEMBER))).otherwise(none)
        now = F.concat(left, here)
        busy = F.struct(
            F.filter(now, lambda x: ~closed(x)).alias("open"),
            F.concat(done, F.transform(F.filter(now, closed), with_end(stop))).alias("done"), stop.alias("stop")).cast(state)
        idle = F.struct(acc["open"], acc["done"], stop.alias("stop")).cast(state)
        return F.when((F.size(acc["open"]) > 0) | y["nested"], busy).otherwise(idle)

    # what is still open at the end keeps the end of its first row
    return F.aggregate(ls, zero, step, lambda acc: F.concat(acc["done"], acc["open"]))


def _join_rows(arr: Column, lo: Column, hi: Column) -> Column:
    """Raw text of the rows lo to hi."""
    some = F.filter(arr, lambda x: (x["line"] >= lo) & (x["line"] <= hi))
    return F.array_join(F.transform(some, lambda x: F.concat(x["raw"], F.when(x["eol"] & (x["line"] < hi), "\n").otherwise(""))), "")


IMPORTED = "struct<names:array<struct<imported_name:string,local_name:string>>,source:string>"


def _imported(code: Column) -> Column:
    """(names, source) of an import statement's comment-free code.
    { a, b as c } gives two names; a default import its local name; a
    namespace import '*'; a side-effect import one NULL name."""
    t = "array<struct<imported_name:string,local_name:string>>"
    empty = F.array().cast(t)
    none = F.array(F.struct(F.lit(None).cast("string").alias("imported_name"), F.lit(None).cast("string").alias("local_name")))

    def pair(imported: Column, local: Column) -> Column:
        return F.struct(imported.alias("imported_name"), local.alias("local_name"))

    def named(x: Column) -> Column:
        alias = F.when(x.contains(" as "), F.regexp_extract(x, r"\sas\s+([\w$]+)", 1))
        return L.once(F.regexp_extract(x, r"^(?:type\s+)?([\w$]+)", 1), lambda first: pair(first, F.coalesce(alias, first)))

    def read(group: Column) -> Column:  # groups of IMPORT_RE: default name, namespace alias, clause, source
        parts = F.filter(F.transform(F.split(group[2], ","), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
        names = F.concat(F.when(group[0] != "", F.array(pair(group[0], group[0]))).otherwise(empty),
                         F.when(group[1] != "", F.array(pair(F.lit("*"), group[1]))).otherwise(empty), F.transform(parts, named))
        names = L.once(names, lambda found: F.when(F.size(found) > 0, found).otherwise(none))
        return F.struct(names.alias("names"), F.when(group[3] != "", group[3]).alias("source")).cast(IMPORTED)

    return L.once(F.array(*(F.regexp_extract(code, L.IMPORT_RE, k) for k in (1, 2, 3, 4))), read)


def _export_names(code: Column, names: Column) -> Column:
    """Exported names of a top-level export statement: the list of
    ``export { a, b as c }``, the name of ``export * as ns``, or the declared names (NULL when there is none)."""
    lst = F.regexp_extract(code, L.EXPORT_LIST_RE, 1)
    is_list = code.rlike(r"^\s*export\s+(?:type\s+)?\{")
    list_names = F.filter(
        F.transform(
            F.split(lst, ","),
            lambda x: F.coalesce(
                F.when(x.rlike(r"\sas\s"), F.regexp_extract(x, r"\sas\s+([\w$]+)", 1)),
                F.regexp_extract(x, r"^\s*(?:type\s+)?([\w$]+)", 1),
            ),
        ),
        lambda x: x != "",
    )
    star = F.regexp_extract(code, L.EXPORT_STAR_RE, 1)
    return (F.when(is_list & (F.size(list_names) > 0), list_names).when(star != "", F.array(star))
            .when(F.size(names) > 0, names).otherwise(F.array(F.lit(None).cast("string"))))


LINK = "struct<name:string,target:string,source:string>"


def _export_links(code: Column) -> Column:
    """What an export statement passes on: (exported name, its name there, source path or NULL for the file itself) of
    ``export { a, b as c } [from '..']``; ``export * from`` has the name '*', and '*' as a target is the whole module."""
    src = F.regexp_extract(code, L.EXPORT_LIST_RE, 2)
    source = F.when(src != "", src)
    parts = F.filter(F.transform(F.split(F.regexp_extract(code, L.EXPORT_LIST_RE, 1), ","),
                                 lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    first = lambda x: F.regexp_extract(x, r"^(?:type )?([\w$]+)", 1)
    named = F.transform(parts, lambda x: F.struct(
        F.coalesce(F.when(x.contains(" as "), F.regexp_extract(x, r" as ([\w$]+)", 1)), first(x)).alias("name"),
        first(x).alias("target"), source.alias("source")).cast(LINK))
    star_name, star_src = (F.regexp_extract(code, L.EXPORT_STAR_RE, k) for k in (1, 2))
    star = F.array(F.struct(F.when(star_name != "", star_name).otherwise("*").alias("name"), F.lit("*").alias("target"),
                            star_src.alias("source")).cast(LINK))
    return F.when(code.rlike(r"^\s*export\s+(?:type\s+)?\{"), named).when(star_src != "", star).otherwise(F.array().cast(f"array<{LINK}>"))


def binding_names(code: Column, keyword: Column, name: Column) -> Column:
    """All names that the masked code of a declaration declares, in order: several declarators and binding patterns of
    const, let and var, else ``name``. Only statements that need it pay for the fold over tokens."""
    body = F.regexp_replace(code, L.VARIABLE_HEAD_RE, "")
    flat = body
    for brackets in (r"\([^()]*\)", r"\[[^\[\]]*\]", r"\{[^{}]*\}"):
        flat = F.regexp_replace(flat, brackets, "")
    start = L.ltrim(body)
    several = (F.instr(code, ",") > 0) & (F.instr(flat, ",") > 0) | F.substring(start, 1, 1).isin("{", "[")
    plain = F.when(name.isNotNull(), F.array(name)).otherwise(F.array().cast("array<string>"))
    return F.when(keyword.isin("const", "let", "var") & several, _declared(body)).otherwise(plain)


# Where the fold over the tokens of a declaration is: in a name or pattern, a type, an initialiser, or behind the end.
_NAME, _TYPE, _VALUE, _END = range(4)


def _declared(body: Column) -> Column:
    """Names bound by ``a = 1, { b, c: d = 2, ...e } = f, [g, , h]: T = i``. The state of the fold: the open brackets of
    the pattern, depth inside a type, value, default or computed key (``skip``), the last word, and the names."""
    state = "struct<at:int,kinds:array<string>,skip:boolean,depth:int,word:string,before:string,names:array<string>>"
    zero = F.from_json(F.lit('{"at":0,"kinds":[],"skip":false,"depth":0,"word":"","before":",","names":[]}'), state)
    toks = F.regexp_extract_all(F.regexp_replace(body, L.TYPE_ARGUMENTS_RE, "$1"), F.lit(L.BINDING_TOKEN_RE), 0)

    def step(acc: Column, t: Column) -> Column:
        at, kinds, depth, word = acc["at"], acc["kinds"], acc["depth"], acc["word"]
        opens, closes = t.isin("(", "[", "{"), t.isin(")", "]", "}")
        inner = F.size(kinds) > 0
        pattern = (at == _NAME) & ~acc["skip"]
        leaves = acc["skip"] & (depth == 0) & (closes | (t == ","))  # the default ends: this token belongs to the pattern
        acts = pattern | leaves
        key = pattern & (t == "[") & inner & (F.element_at(F.concat(F.array(F.lit("")), kinds), -1) == "{") & acc["before"].isin("{", ",")
        flush = acts & t.isin(",", ":", "=", "}", "]", ";") & (word != "")
        named = flush & ~((t == ":") & inner)  # before a colon stands a key
        typed = at == _TYPE
        angle = F.when(typed & (t == "<"), 1).when(typed & (t == ">"), -1).otherwise(0)
        bracket = F.when(opens, 1).when(closes, -1).otherwise(0)
        outside = (at.isin(_TYPE, _VALUE)) & (depth == 0)
        new_at = (
            F.when(at == _END, _END)
            .when(pattern & ~inner & (t == ";"), _END).when(outside & (t == ";"), _END)
            .when(pattern & ~inner & (t == ":"), _TYPE).when(pattern & ~inner & (t == "="), _VALUE)
            .when(outside & (t == ","), _NAME).when(typed & (depth == 0) & (t == "="), _VALUE)
            .otherwise(at)
        )
        skip = F.when(key | (pattern & inner & (t == "=")), True).when(leaves, False).when(
            acc["skip"] & (depth == 1) & (t == "]") & (acc["before"] != "=") & acc["word"].startswith("["), False).otherwise(acc["skip"])
        new_depth = F.when(key, 1).when(new_at != at, 0).when(acc["skip"] & ~leaves, depth + bracket).when(
            at.isin(_TYPE, _VALUE), depth + bracket + angle).otherwise(0)
        new_kinds = (
            F.when(acts & closes & inner, F.slice(kinds, 1, F.greatest(F.size(kinds) - 1, F.lit(0))))
            .when(pattern & ~key & t.isin("{", "["), F.concat(kinds, F.array(t))).otherwise(kinds)
        )
        is_word = t.rlike(r"^[A-Za-z_$]")
        new_word = F.when(key, "[").when(acc["skip"] & ~leaves, F.when(skip, word).otherwise("")).when(
            pattern & is_word, t).when(acts & t.isin(",", ":", "=", "}", "]", ";", "{", "["), "").otherwise(word)
        return F.struct(
            new_at.cast("int").alias("at"), new_kinds.alias("kinds"), skip.alias("skip"), new_depth.cast("int").alias("depth"),
            new_word.alias("word"), t.alias("before"),
            F.when(named, F.concat(acc["names"], F.array(word))).otherwise(acc["names"]).alias("names"),
        ).cast(state)

    def end(acc: Column) -> Column:
        rest = (acc["at"] == _NAME) & ~acc["skip"] & (acc["word"] != "")
        return F.when(rest, F.concat(acc["names"], F.array(acc["word"]))).otherwise(acc["names"])

    return F.aggregate(toks, zero, step, end)


def statement_rows(ln: DataFrame) -> DataFrame:
    """Internal statement table from the line table: one aggregate per
    statement collects its text, location, and the facts of its inner lines
    (nested exports, members one level deep), so every later operator reads
    statements only. Rows of one statement are in one partition already
    (files are hash-partitioned by file key), so this adds no exchange."""
    nested_cond = _nested_export()
    # the statement's head: first depth-0 code line that is not only decorators
    head_cond = F.col("is_code") & (F.col("depth_before") == 0) & (
        F.col("l_type").isNotNull() | ~F.col("fw").isin(*L.STATEMENT_KEYWORDS, "@")
    )
    member_cond = F.col("is_code") & (F.col("depth_before") == 1) & (
        F.col("m_decl").isNotNull() | (F.coalesce(F.col("m_method"), F.lit("")) != "")
    )
    member = F.struct("line", F.col("m_decl").alias("decl"), F.coalesce(F.col("m_method"), F.lit("")).alias("method"))
    g = ln.groupBy("project_id", "path", "file_ord", "stmt_ord").agg(
        F.sort_array(F.collect_list(F.struct("line", "raw", "eol"))).alias("ls"),
        # only read for nested exports: collected only by queries that want them, from files that have any
        F.sort_array(F.collect_list(F.when(F.col("nests") & F.col("is_code"), F.struct(
            "line", F.col("depth_before").alias("before"), F.col("depth_after").alias("after"),
            F.col("lc").isin(";", "}").alias("closes"), F.col("fw").isin(*L.STATEMENT_KEYWORDS, "@").alias("opens"),
            F.col("row").cast("bigint").alias("row"), F.col("line_byte").alias("byte"), "rlen", nested_cond.alias("nested"),
            F.when(nested_cond, F.col("m_decl")).alias("name"),
        )))).alias("code_rows"),
        # all of these grow from line to line, so the first or last line's is the least or largest
        F.min(F.when(F.col("nonblank"), F.col("line"))).alias("lo"),
        F.max(F.when(F.col("nonblank"), F.col("line"))).alias("hi"),
        F.min(F.when(F.col("nonblank"), F.col("line_byte"))).alias("lo_byte"),
        F.min(F.when(F.col("nonblank"), F.col("line_byte") + F.col("lead"))).alias("start_byte"),
        F.max(F.when(F.col("nonblank"), F.col("line_byte") + F.col("rlen"))).alias("end_byte"),
        F.min(F.when(F.col("nonblank"), F.col("row"))).alias("lo_row"),
        F.max(F.when(F.col("nonblank"), F.col("row"))).alias("hi_row"),
        F.min(F.when(F.col("nonblank"), F.col("row_byte"))).alias("lo_row_byte"),
        F.max(F.when(F.col("nonblank"), F.col("row_byte"))).alias("hi_row_byte"),
        F.min(F.when(F.col("is_code"), F.col("line"))).alias("head_line"),
        F.min(F.when(F.col("is_code"), F.col("line_byte"))).alias("head_byte"),
        F.first("balanced").alias("balanced"),
        F.min_by("l_type", F.when(head_cond, F.col("line"))).alias("head_type"),
        F.min_by("m_decl", F.when(head_cond, F.col("line"))).alias("head_name"),
        F.min_by("m_kw", F.when(head_cond, F.col("line"))).alias("head_kw"),
        F.max(nested_cond).alias("has_nested"),
        F.collect_list(F.when(member_cond, member)).alias("members"),
    ).where(F.col("lo").isNotNull())
    comment_only = F.col("head_line").isNull()
    head_line = F.coalesce("head_line", "lo")
    head_byte = F.coalesce("head_byte", "lo_byte")
    blanks = (F.col("start_byte") - F.col("lo_byte")).cast("int")
    g = g.withColumn("text", _join_rows(F.col("ls"), F.col("lo"), F.col("hi")))
    text = F.col("text")
    members = L.built_once("members", F.col("code_rows"), build=_members_with_ends)
    s = g.select(
        "project_id", "path", "file_ord", "stmt_ord", "balanced", F.col("start_byte").cast("bigint").alias("start_byte"),
        # place of each nested export: number and line of its first row, and bytes: where it begins in ``value`` and in
        # the code without comments (which starts at the head line), and how many it has
        F.when(F.col("balanced") & F.col("has_nested"), F.transform(F.sort_array(members), lambda x: F.struct(
            x["name"].alias("name"), x["line"].alias("line"), x["row"].alias("row"), (x["byte"] - F.col("start_byte")).alias("at"),
            (x["byte"] - head_byte).alias("code_at"), (x["stop"] - x["byte"]).alias("n_bytes")))).otherwise(
            F.array().cast("array<struct<name:string,line:int,row:bigint,at:bigint,code_at:bigint,n_bytes:bigint>>")).alias("nested_exports"),
        F.filter("members", lambda x: F.col("balanced")).alias("members"),
        F.when(F.col("balanced"), F.col("head_type")).otherwise("ERROR").alias("head_type"),
        F.when(F.col("balanced"), F.col("head_name")).alias("head_name"),
        F.when(F.col("balanced"), F.col("head_kw")).alias("head_kw"),
        F.when(blanks > 0, F.substring(text, blanks + 1, (F.col("end_byte") - F.col("lo_byte")).cast("int"))).otherwise(text).alias("value"),
        F.when(head_line == F.col("lo"), text).otherwise(_join_rows(F.col("ls"), head_line, F.col("hi"))).alias("code"),
        comment_only.alias("comment_only"),
        F.col("end_byte").cast("bigint").alias("end_byte"),
        F.col("lo_row").cast("bigint").alias("start_row"),
        (F.col("start_byte") - F.col("lo_row_byte")).cast("bigint").alias("start_col"),
        F.col("hi_row").cast("bigint").alias("end_row"),
        (F.col("end_byte") - F.col("hi_row_byte")).cast("bigint").alias("end_col"),
    )
    # Statement code starts on a code line at depth 0 outside any literal, so
    # re-tokenising it alone gives the same masks as the file-level pass.
    # classification comes from the head line (computed per line before the
    # windows); the re-tokenised statement code is only evaluated for the
    # columns that need it (clauses of imports/exports, identifiers, all declared names)
    raw_type = F.when(F.col("comment_only"), F.lit("comment")).otherwise(
        F.coalesce(F.col("head_type"), F.lit("expression_statement"))
    )
    s = s.withColumns({"raw_type": raw_type, "decl_keyword": F.coalesce("head_kw", F.lit(""))})
    literals = F.col("code").rlike("[/'\"`]")  # else the code is one token, its own mask
    comments = (F.instr("code", "//") > 0) | (F.instr("code", "/*") > 0)  # else the clean text is the code
    is_imp, is_export = F.col("raw_type") == "import_statement", F.col("raw_type") == "export_statement"
    # The tokens are written out in both masks: as a column of their own they would be read for statements that need
    # neither. Names are looked for in other statements than imports, so these have no masked code.
    tokens = L.tokens(F.col("code"))
    s = s.withColumns({
        "mcode": F.when(~is_imp | (F.size("nested_exports") > 0), F.when(literals, L.masked_text(tokens)).otherwise(F.col("code"))),
        "ccode": F.when(comments, L.clean_text(tokens)).otherwise(F.col("code")), "kind": classify_kind(F.col("raw_type")),
        "name": F.when(~is_imp, F.col("head_name")), "is_export": is_export,
    }).drop("code", "head_type", "head_name", "head_kw")
    # all declared names; ``name`` is the one behind the keyword (none before a binding pattern)
    variables = F.col("raw_type").isin("export_statement", "lexical_declaration", "variable_declaration", "ambient_declaration")
    keyword = F.when(variables & (F.col("decl_keyword") == ""), F.regexp_extract("mcode", L.VARIABLE_HEAD_RE, 1))
    s = s.withColumns({
        "decl_keyword": F.coalesce(keyword, "decl_keyword"),
        "nested_exports": F.when(F.size("nested_exports") > 0, L.built_once(
            "named", F.col("nested_exports"), F.col("mcode"), build=_named_members)).otherwise(F.array().cast(NAMED)),
        "_imported": F.when(is_imp, L.built_once("imported", F.col("ccode"), build=_imported)),
        "export_links": F.when(is_export, L.built_once("export_links", F.col("ccode"), build=_export_links)),
    })
    s = s.withColumns({"import_names": F.col("_imported.names"), "source_path": F.col("_imported.source")}).drop("_imported")
    plain = F.when(F.col("name").isNotNull(), F.array("name")).otherwise(F.array().cast("array<string>"))
    s = s.withColumn("decl_names", F.when(variables, L.built_once(
        "binding_names", F.col("mcode"), F.col("decl_keyword"), F.col("name"), build=binding_names)).otherwise(plain))
    return s.withColumn("export_names", F.when(is_export, L.built_once(
        "export_names", F.col("ccode"), F.col("decl_names"), build=_export_names)))


NAMED = "array<struct<names:array<string>,line:int,row:bigint,at:bigint,code_at:bigint,n_bytes:bigint>>"


def _named_members(members: Column, mcode: Column) -> Column:
    """Nested exports with all their names, from their part of the statement's masked code."""
    code = mcode.cast("binary")
    return F.transform(members, lambda x: F.struct(
        _nested_names(F.decode(F.substring(code, x["code_at"].cast("int") + 1, x["n_bytes"].cast("int")), "UTF-8"), x["name"]).alias("names"),
        x["line"].alias("line"), x["row"].alias("row"), x["at"].alias("at"), x["code_at"].alias("code_at"), x["n_bytes"].alias("n_bytes"))).cast(NAMED)


def _nested_names(code: Column, name: Column) -> Column:
    """Names of a nested export from its masked code; one NULL where it has none."""
    names = binding_names(code, F.regexp_extract(code, L.VARIABLE_HEAD_RE, 1), name)
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(None).cast("string")))


def declared_names(stmts: DataFrame) -> Column:
    """All names a statement declares (of a statements table with or without ``decl_names``)."""
    first = F.when(F.col("name").isNotNull(), F.array("name"))
    return F.col("decl_names") if "decl_names" in stmts.columns else F.coalesce(first, F.array().cast("array<string>"))


def extract_facts(files: DataFrame, keep_unbalanced: bool = True, materialize: bool = False,
                  columns: list[str] | None = None) -> DataFrame:
    """Statement facts of a corpus, optionally materialised once in the shared
    checkpoint folder (``session.stored``) when several operators read
    them. A file whose brackets do not balance is one statement of raw type
    ERROR, or left out with ``keep_unbalanced=False``: lexing is the costly part and must not run once per plan branch.
    The stored copy cuts lineage, so a lost executor does not re-run it."""
    s = statement_rows(lines(files))
    if not keep_unbalanced:
        s = s.where("balanced")
    if columns:
        s = s.select(*columns)
    if materialize:
        s = stored(s, "facts")
    return s


STATEMENT_COLUMNS = [
    "project_id", "path", "file_ord", "stmt_ord", "kind", "raw_type", "name",
    "is_export", "value", "start_byte", "end_byte", "start_row", "start_col",
    "end_row", "end_col",
]


def statements(files: DataFrame, keep_unbalanced: bool = True) -> DataFrame:
    """B1: top-level statements, with kind (B2), name and flat location."""
    return extract_facts(files, keep_unbalanced).select(*STATEMENT_COLUMNS)


def with_location(stmts: DataFrame) -> DataFrame:
    """Nested Location struct (file_path, start{row,col}, end{row,col})."""
    return stmts.withColumn(
        "location",
        F.struct(
            F.col("path").alias("file_path"),
            F.struct(F.col("start_row").alias("row"), F.col("start_col").alias("col")).alias("start"),
            F.struct(F.col("end_row").alias("row"), F.col("end_col").alias("col")).alias("end"),
        ),
    )


def node_text(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """value = content bytes [start_byte, end_byte) when the range is valid
    (0 <= start < end <= n_bytes), else NULL. ``ranges`` carries
    (project_id, path, start_byte, end_byte, ...) and is joined to its file.
    The file is UTF-8 encoded once on the file side; the join and the byte
    slice are fused by codegen, so a range costs its own length only."""
    f = files.select("project_id", "path", F.encode("content", "UTF-8").alias("_bin"), "n_bytes")
    j = ranges.join(f, ["project_id", "path"])
    ok = (F.col("start_byte") >= 0) & (F.col("start_byte") < F.col("end_byte")) & (F.col("end_byte") <= F.col("n_bytes"))
    txt = F.expr(
        "decode(substring(_bin, cast(start_byte + 1 as int), cast(end_byte - start_byte as int)), 'UTF-8')"
    )
    return j.withColumn("value", F.when(ok, txt)).withColumn("valid", ok).drop("_bin")


def rejects(files: DataFrame, suffix: str = ".ts", max_bytes: int | None = None) -> DataFrame:
    """All rejected files with their reason, first reason wins:
    missing/empty/too_large (A4), bad_suffix (A2), unbalanced (Q13)."""
    from ..sources import files as S

    ok, q = S.quarantine(files) if max_bytes is None else S.quarantine(files, max_bytes)
    ok, bad = S.filter_suffix(ok, suffix)
    return q.unionByName(bad).unionByName(rejects_unbalanced(ok))


def rejects_unbalanced(files: DataFrame) -> DataFrame:
    ln = lines(files)
    return (
        ln.where(~F.col("balanced"))
        .select("project_id", "path")
        .distinct()
        .withColumn("reason", F.lit("unbalanced"))
    )


# ----------------------------------------------------------------- imports

def imports_from(stmts: DataFrame) -> DataFrame:
    """One row per imported name of each import statement, with its text if ``stmts`` has the texts."""
    text = [c for c in ("value",) if c in stmts.columns]
    imp = stmts.where(F.col("raw_type") == "import_statement")
    out = imp.select(
        "project_id", "path", "file_ord", "stmt_ord", *text, "source_path",
        F.posexplode_outer("import_names").alias("name_ord", "n"),
    ).where(F.col("name_ord").isNotNull())
    return out.select(
        "project_id", "path", "file_ord", "stmt_ord", "name_ord",
        F.col("n.imported_name").alias("imported_name"),
        F.col("n.local_name").alias("local_name"),
        "source_path", *text,
    )


def imports(files: DataFrame) -> DataFrame:
    return imports_from(extract_facts(files))


# ----------------------------------------------------------------- exports

def member_text(text: Column, at: Column, n_bytes: Column) -> Column:
    """The text of a nested export: ``n_bytes`` bytes of its statement's text from ``at`` on."""
    return F.trim(F.decode(F.substring(text.cast("binary"), at.cast("int") + 1, n_bytes.cast("int")), "UTF-8"))


def exports_from(stmts: DataFrame, nested: bool = True, text: str = "value", places: bool = False) -> DataFrame:
    """One row per exported name: top-level exports, plus exports nested
    at depth > 0 (e.g. inside a namespace) with their own full text. ``line``
    numbers a nested export within its file, ``row`` is its line there; both are -1 for a top-level one. NULL name =
    no identifier (the reference raises InvalidNode; the row is kept for
    reporting). Nested texts are cut out of the column ``text`` (``value``, or ``ccode``: without comments).
    One array per statement, exploded once. Statements without texts give exports without them; ``places`` gives the
    number of the statement (``_sid``) and the place of a nested export in that text."""
    texts = text in stmts.columns
    kind = "array<struct<name:string,line:int,row:bigint,at:bigint,n_bytes:bigint>>"
    found = F.when(F.col("is_export"), F.transform("export_names", lambda n: F.struct(
        n.alias("name"), F.lit(-1).alias("line"), F.lit(-1).alias("row"), F.lit(0).alias("at"), F.lit(0).alias("n_bytes"))).cast(kind))
    found = F.coalesce(found, F.array().cast(kind))
    if nested:
        at = "at" if text == "value" else "code_at"
        found = F.concat(found, F.flatten(F.transform("nested_exports", lambda x: F.transform(x["names"], lambda n: F.struct(
            n.alias("name"), x["line"].alias("line"), x["row"].alias("row"), x[at].alias("at"), x["n_bytes"].alias("n_bytes"))))).cast(kind))
    cut = [F.col(text).alias("_text")] if texts and text != "value" else []
    e = stmts.select("project_id", "path", "file_ord", "stmt_ord", "kind", *(["value"] if texts else []), *cut, *(["_sid"] if places else []), F.explode_outer(found).alias("x")).where(F.col("x").isNotNull())
    inner = F.col("x.line") >= 0
    member = member_text(F.col("_text" if cut else "value"), F.col("x.at"), F.col("x.n_bytes")) if texts else None
    return e.select(
        "project_id", "path", "file_ord", "stmt_ord", F.col("x.name").alias("export_name"),
        F.when(inner, F.lit("ExportDecl")).otherwise(F.col("kind")).alias("kind"),
        *([F.when(inner, member).otherwise(F.col("value")).alias("value")] if texts else []),
        inner.alias("nested"), F.col("x.line").alias("line"), F.col("x.row").alias("row"),
        *(["_sid", "x.at", "x.n_bytes"] if places else []),
    )


def exports(files: DataFrame, nested: bool = True) -> DataFrame:
    return exports_from(extract_facts(files), nested)


# ------------------------------------------------------------ declarations

def declarations_from(stmts: DataFrame) -> DataFrame:
    """Named top-level declarations (imports excluded; they are in B5), one row for each declared name."""
    return stmts.select(
        "project_id", "path", "file_ord", "stmt_ord", F.posexplode_outer(declared_names(stmts)).alias("_i", "name"), "kind", "raw_type",
        "is_export", "decl_keyword",
    ).where(F.col("_i").isNotNull()).drop("_i")


def _members(stmts: DataFrame) -> DataFrame:
    return stmts.where(F.size("members") > 0).select(
        "project_id", "path", "stmt_ord", F.col("name").alias("owner"),
        F.col("decl_keyword").alias("owner_keyword"), F.explode("members").alias("m"),
    ).select("project_id", "path", "stmt_ord", "owner", "owner_keyword",
             F.col("m.line").alias("line"), F.col("m.decl").alias("decl"), F.col("m.method").alias("method"))


def contains_edges_from(stmts: DataFrame) -> DataFrame:
    """namespace/module -> declarations one level inside it."""
    m = _members(stmts)
    return m.where(
        F.col("owner_keyword").isin("namespace", "module") & F.col("decl").isNotNull() & F.col("owner").isNotNull()
    ).select(
        "project_id", F.col("owner").alias("src"), F.col("decl").alias("dst"),
        F.lit("contains").alias("edge_kind"), "path", "stmt_ord", "line",
    )


def method_edges_from(stmts: DataFrame) -> DataFrame:
    """Class -> its methods (Function children in the reference's list)."""
    m = _members(stmts)
    return m.where(
        (F.col("owner_keyword") == "class") & (F.col("method") != "")
        & ~F.col("method").isin(*L.NOT_METHOD_NAMES) & F.col("owner").isNotNull()
    ).select(
        "project_id", F.col("owner").alias("src"), F.col("method").alias("dst"),
        F.lit("method").alias("edge_kind"), "path", "stmt_ord", "line",
    )


def ref_edges_from(stmts: DataFrame, decls: DataFrame) -> DataFrame:
    """Declaration -> declarations of the same project it names.

    Identifiers of each masked body are made distinct per statement, then
    equi-joined with the project's declared names. The declared-name side is
    deduplicated per (project_id, name) first so the join is many-to-one and
    a popular name cannot multiply rows; AQE's skew join splits a hot key.
    """
    names = declared_names(stmts)
    src = stmts.where(F.size(names) > 0).select(
        "project_id", names.alias("srcs"), F.explode(F.array_except(L.identifiers(F.col("mcode")), names)).alias("dst")
    ).select("project_id", F.explode("srcs").alias("src"), "dst")
    targets = decls.select("project_id", F.col("name").alias("dst")).distinct()
    return src.join(targets, ["project_id", "dst"], "left_semi").select(
        "project_id", "src", "dst", F.lit("uses").alias("edge_kind")
    ).distinct()


# ---------------------------------------------------------------- comments

def comments(files: DataFrame, language: str = "typescript") -> DataFrame:
    """Comment tokens as rows, ordered within the file. Map-only: no
    shuffle, each file's tokens come from its own row."""
    if language == "html":
        toks = F.regexp_extract_all(F.col("content"), F.lit(r"(?s)<!--.*?-->"), 0)
    else:
        toks = L.comment_tokens(L.tokens(F.col("content")))
    return files.select(
        "project_id", "path", F.posexplode_outer(toks).alias("comment_ord", "value")
    ).where(F.col("comment_ord").isNotNull()).select("project_id", "path", (F.col("comment_ord") + 1).alias("comment_ord"), "value")


def strip_comments(files: DataFrame) -> DataFrame:
    """File text without comment tokens."""
    return files.select(
        "project_id", "path", "file_ord", L.strip_comments_text(L.tokens(F.col("content"))).alias("content")
    )


def kind_histogram(stmts: DataFrame) -> DataFrame:
    """Number of statements per (project, kind). Partial aggregation
    happens map-side before the shuffle."""
    return stmts.groupBy("project_id", "kind").agg(F.count(F.lit(1)).alias("n"))
