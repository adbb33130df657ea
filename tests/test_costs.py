"""Work that is done once: array expressions that are not evaluated again by a filter, cheap forms of line facts."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from tsfold.functions import lexer as L
from tsfold.operators import extract as X
from tsfold.operators import graph as G
from tsfold.operators.order import dense_rank_within


def _files(spark, *texts):
    rows = [(1, f"src/{i}.ts", i, t, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "project_id bigint, path string, file_ord bigint, content string, n_bytes bigint")


def _filters(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in plan.splitlines() if "Filter" in x]


def test_texts_are_read_once_not_in_a_filter_too(spark):
    files = _files(spark, "import { a as b } from './b';\nexport const c = 1, d = `${'}'}`; // e\n", None, "")
    st = X.extract_facts(files)
    for df in (X.lines(files), X.imports_from(st), X.exports_from(st), X.declarations_from(st), X.comments(files)):
        assert not [x for x in _filters(df) if "regexp_extract" in x or "arrays_zip" in x or "size(" in x]
    assert [r["imported_name"] for r in X.imports_from(st).collect()] == ["a"]
    assert [r["export_name"] for r in X.exports_from(st).collect()] == ["c", "d"]
    assert [r["name"] for r in X.declarations_from(st).collect()] == ["c", "d"]
    assert [r["value"] for r in X.comments(files).collect()] == ["// e"]


def test_line_types_by_their_first_word(spark):
    words = [*L.STATEMENT_KEYWORDS, "@a import", "@b({}) export class", "@c"]
    ends = ["", " x", "{", "* as y", "~~", " class A", " enum B", " function* f()", " function f()", "* g()", " 1", ".z", "(q)", "\tA"]
    rows = [(b + w + e,) for w in words for e in ends for b in ("", " ", "\t")]
    m = F.col("m")
    df = spark.createDataFrame(rows, "m string").withColumn("w", L.first_word(m)).where(F.col("w").isin(*L.STATEMENT_KEYWORDS, "@"))
    at = F.col("w") == "@"
    bad = df.where(~(L.raw_type_of_line(m, F.col("w")).eqNullSafe(L.raw_type_of(m, F.lit(False)))
                     & L.decl_name(m, at).eqNullSafe(L.decl_name(m)) & L.decl_keyword(m, at).eqNullSafe(L.decl_keyword(m))))
    assert df.count() > 400 and not bad.collect()


def test_template_spans_by_runs(spark):
    texts = {"a `b${`c${`d${`e${`f${1}`}`}`}`}` é😀 `g`": ["`b${`c${`d${`e${`f${1}`}`}`}`}`", "`g`"],
             "'`' \"`\" // `\n/* ` */ `\\`$x`": ["`\\`$x`"], "\\`h`": ["`h`"], "": []}
    for text, found in texts.items():
        spans = spark.createDataFrame([(text,)], "t string").select(L.template_spans(F.col("t"))).first()[0]
        assert [text[s["start"]:s["stop"]] for s in spans] == found
    plan = spark.createDataFrame([("",)], "t string").select(L.template_spans(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan  # not character by character


def test_stored_rows_are_packed_and_read_by_columns(spark):
    st = X.extract_facts(_files(spark, "export class A {}\n", None), materialize=True)
    plan = st.select("name")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet [name" in plan and "ReadSchema: struct<name:string>" in plan
    assert [r["name"] for r in st.select("name").collect()] == ["A"]
    ranked = dense_rank_within(st.select("project_id", "path", "value"), ["project_id"], ["path"], "n")
    assert [tuple(r) for r in ranked.select("value", "n").collect()] == [("export class A {}", 1)]


def test_components_offer_changed_labels_only(spark):
    ring = [(1, f"n{i * 7 % 41:02d}", f"n{(i + 1) * 7 % 41:02d}") for i in range(30)]
    pairs = [(2, "b", "a"), (2, "c", "b"), (2, "d", "d"), (2, "x", "y"), (2, "c", "b"), (2, None, "a")]
    edges = spark.createDataFrame(ring + pairs, "project_id bigint, src string, dst string")
    found = {(r["project_id"], r["node"]): r["component"] for r in G.components(edges).collect() if r["node"]}
    want = {(1, n): min(x for _, a, b in ring for x in (a, b)) for _, a, b in ring for n in (a, b)}
    want |= {(2, "a"): "a", (2, "b"): "a", (2, "c"): "a", (2, "d"): "d", (2, "x"): "x", (2, "y"): "x"}
    assert found == want
    assert not list(_checkpoints(spark, G.components, edges))  # rounds are stored packed


def _checkpoints(spark, run, *args):
    base = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())

    def rdds():
        return {str(x.getPath().getName()) for x in fs.listStatus(base) if x.getPath().getName().startswith("rdd-")}
    before = rdds()
    run(*args).collect()
    return rdds() - before


def _generated_sizes(spark, df):
    """Byte code of the longest method of each stage that Spark generates for ``df``."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with contextlib.redirect_stdout(io.StringIO()) as out:
            df.explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]


def test_no_generated_method_is_too_long_to_be_compiled(spark):
    sizes = _generated_sizes(spark, X.extract_facts(_files(spark, "class A {}\n")))
    assert sizes and max(sizes) < 8000  # HotSpot interprets longer ones


def test_blanks_and_brackets_of_lines(spark):
    texts = ["", " \t\r\f\v", "\t{ (a[é])\v", "@b \r", "\u00a0{{", None, "\f  x = [(;\t"]
    df = spark.createDataFrame([(t,) for t in texts], "m string")
    m = F.col("m")
    rows = df.select(L.is_blank(m), L.brace_delta(m), L.first_word(m), L.last_char(m)).collect()
    assert [tuple(r) for r in rows] == [(True, 0, "", ""), (True, 0, "", ""), (False, 1, "", ")"), (False, 0, "@", "b"),
                                        (False, 2, "", "{"), (None, None, None, None), (False, 2, "x", ";")]


def test_import_clauses(spark):
    codes = {"import a, { b, type c as d , e  as\tf } from './x';": [("a", "a"), ("b", "b"), ("c", "d"), ("e", "f")],
             "import * as g from \"h\"": [("*", "g")], "import 'i';": [(None, None)], "import {} from 'j'": [(None, None)]}
    for code, names in codes.items():
        x = spark.createDataFrame([(code,)], "c string").select(X._imported(F.col("c")).alias("x")).first()["x"]
        assert [tuple(n) for n in x["names"]] == names and x["source"] in ("./x", "h", "i", "j")


def test_small_projects_are_peeled_without_rounds(spark, monkeypatch):
    chain = [(1, f"n{i:02d}", f"n{i + 1:02d}") for i in range(12)]
    more = [(2, "a", "b"), (2, "b", "c"), (2, "c", "b"), (2, "c", "d"), (3, "x", "x"), (4, "a", "b"), (4, "a", "b"), (4, "a", "c"), (4, "c", "b")]
    odd = [(None, "a", "b"), (5, None, "b"), (5, "b", "c"), (6, "a", None)]
    large = [(8, f"n{i}", f"n{(i + 1) % 70}") for i in range(70)]

    def found(rows):
        e = spark.createDataFrame(rows, "project_id bigint, src string, dst string")
        return [sorted(map(repr, df.collect())) for df in (*G.peel_levels(e), G.has_cycle(e), G.topo_order(e))]

    names = []
    real = G._ckpt
    monkeypatch.setattr(G, "_ckpt", lambda df: names.append(1) or real(df))
    alone = found(chain + more)
    assert len(names) == 12  # each call: edges, large projects, and the empty rounds; none for a level of the chain
    every = found(more + odd + large)
    monkeypatch.setattr(G, "SMALL_GRAPH", 0)
    assert alone == found(chain + more)
    assert every == found(more + odd + large)


def test_names_are_read_without_texts(spark):
    st = X.extract_facts(_files(spark, "import { a } from './a';\nexport const b = 1;\nexport namespace C { export type D = 1; }\n")).drop("value")
    assert [r["imported_name"] for r in X.imports_from(st).collect()] == ["a"]
    assert sorted(r["export_name"] for r in X.exports_from(st).collect()) == ["C", "D", "b"]
    assert "value" not in X.imports_from(st).columns + X.exports_from(st).columns
