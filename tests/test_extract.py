from pyspark.sql import functions as F

from ts_sources import REPORT_TS, files_df
from tsfold.functions.kinds import RAW_TYPE_TO_KIND, classify_kind
from tsfold.operators import extract as X


def _stmts(files):
    return {(r.path, r.stmt_ord): r for r in X.statements(files).collect()}


def test_simple_declarations_and_imports(fixture_files):
    st = X.extract_facts(fixture_files).where("path = 'src/report.ts'")
    decls = {(r.decl_keyword, r.name) for r in X.declarations_from(st).collect()}
    assert decls == {("interface", "Cell"), ("class", "Sheet"), ("function", "summarise"), ("const", "monthly")}
    imps = [(r.imported_name, r.source_path) for r in X.imports_from(st).collect()]
    assert imps == [("RainGauge", "./gauge")]


def test_statements_are_lossless(fixture_files):
    """Every statement value is exactly the bytes of its range, ranges are
    ordered and disjoint, and only whitespace lies outside them."""
    files = {r.path: r.content for r in fixture_files.collect()}
    by_file = {}
    for r in X.statements(fixture_files).collect():
        raw = files[r.path].encode()
        assert raw[r.start_byte:r.end_byte].decode() == r.value
        by_file.setdefault(r.path, []).append(r)
    for path, rows in by_file.items():
        rows.sort(key=lambda r: r.stmt_ord)
        raw = files[path].encode()
        pos = 0
        for r in rows:
            assert r.start_byte >= pos
            assert raw[pos:r.start_byte].strip() == b""
            pos = r.end_byte
        assert raw[pos:].strip() == b""


def test_complex_kinds_and_names(fixture_files):
    st = X.statements(fixture_files).where("path = 'src/station.ts'").orderBy("stmt_ord").collect()
    got = [(r.raw_type, r.name) for r in st]
    assert got == [
        ("type_alias_declaration", "Unit"),
        ("export_statement", "Limits"),
        ("type_alias_declaration", "Scales"),
        ("interface_declaration", "Labelled"),
        ("export_statement", "Ring"),
        ("export_statement", "Probe"),
        ("interface_declaration", "Dated"),
        ("export_statement", "Entry"),
    ]
    # leading comments attach to the statement below them
    assert st[2].value.startswith("/* a lookup by unit } */\ntype Scales")
    assert st[4].value.startswith("// keeps the latest values\nexport class Ring")
    # the decorator belongs to its class, braces in strings/templates ignored
    assert st[5].value.startswith("@Registered('probe')\nexport abstract class Probe")
    assert st[5].value.rstrip().endswith("}")


def test_nested_exports(fixture_files):
    ex = X.exports(fixture_files).where("path = 'src/station.ts'")
    nested = {r.export_name for r in ex.where("nested").collect()}
    assert nested == {"Alarm", "Window"}
    top = {r.export_name for r in ex.where("not nested").collect()}
    assert top == {"Limits", "Ring", "Probe", "Entry"}


def test_classify_kind_map(spark):
    df = spark.createDataFrame([(k,) for k, _ in RAW_TYPE_TO_KIND] + [("import_declaration",), ("nope",), (None,)], "t string")
    got = dict((r.t, r.k) for r in df.select("t", classify_kind(F.col("t")).alias("k")).collect())
    for raw, kind in RAW_TYPE_TO_KIND:
        assert got[raw] == kind
    assert got["}"] == "BlockEnd"
    assert got["import_declaration"] == "ImportDecl"
    assert got["nope"] == "Unknown" and got[None] == "Unknown"


def test_edge_cases(spark):
    rows = [
        (2, "empty.ts", 1, ""),
        (2, "comments.ts", 2, "// only a comment\n/* and\n another */\n"),
        (2, "ws.ts", 3, "   \n\n"),
        (2, "crlf.ts", 4, "export const a = 1;\r\nexport const b = '}';\r\n"),
        (2, "noeol.ts", 5, "export function f() {\n  return `${1}}`;\n}"),
        (2, "bad.ts", 6, "class { invalid"),
        (2, "default.ts", 7, "export default function () {}\n"),
        (2, "list.ts", 8, "export { a, b as c } from './x';\nimport d, { e as f } from './y';\nimport './side';\n"),
    ]
    files = files_df(spark, rows)
    st = X.statement_rows(X.lines(files))
    by = {}
    for r in st.collect():
        by.setdefault(r.path, []).append(r)
    assert "empty.ts" not in by and "ws.ts" not in by
    assert [r.raw_type for r in by["comments.ts"]] == ["comment"]
    assert [r.name for r in sorted(by["crlf.ts"], key=lambda r: r.stmt_ord)] == ["a", "b"]
    assert len(by["noeol.ts"]) == 1 and by["noeol.ts"][0].balanced
    assert not by["bad.ts"][0].balanced  # unbalanced -> rejected
    # its text is not lost: the file is one statement of no known kind
    assert [(r.raw_type, r.kind, r.value) for r in X.statements(files).where("path = 'bad.ts'").collect()] == [
        ("ERROR", "Unknown", "class { invalid")]
    assert X.statements(files, keep_unbalanced=False).where("path = 'bad.ts'").count() == 0
    rej = X.rejects_unbalanced(files).collect()
    assert [(r.path, r.reason) for r in rej] == [("bad.ts", "unbalanced")]
    ex = {(r.path, r.export_name) for r in X.exports(files).collect()}
    assert ("default.ts", None) in ex  # no identifier: kept, name NULL
    assert {("list.ts", "a"), ("list.ts", "c")} <= ex
    imps = {(r.imported_name, r.local_name, r.source_path) for r in X.imports(files).collect()}
    assert imps == {("d", "d", "./y"), ("e", "f", "./y"), (None, None, "./side")}


def test_comments_and_strip(spark):
    files = files_df(spark, [(3, "c.ts", 1, "// a\nconst s = '// no';\n/* b */ let x = 1;\n")])
    cs = [r.value for r in X.comments(files).orderBy("comment_ord").collect()]
    assert cs == ["// a", "/* b */"]
    stripped = X.strip_comments(files).first().content
    assert stripped == "\nconst s = '// no';\n let x = 1;\n"


def test_node_text_invalid_range(spark, fixture_files):
    rng = spark.createDataFrame([(1, "src/report.ts", 0, 6), (1, "src/report.ts", 5, 2), (1, "src/report.ts", 0, 10 ** 6)],
                                "project_id bigint, path string, start_byte bigint, end_byte bigint")
    got = [(r.value, r.valid) for r in X.node_text(fixture_files, rng).orderBy("start_byte", "end_byte").collect()]
    assert got == [("export", True), (None, False), (None, False)]
    assert REPORT_TS.startswith("export")


def test_location_struct_and_position_order(spark, fixture_files):
    st = X.with_location(X.statements(fixture_files)).where("path = 'src/gauge.ts'").orderBy("stmt_ord")
    locs = [r.location for r in st.collect()]
    assert locs[0].file_path == "src/gauge.ts"
    assert (locs[0].start.row, locs[0].start.col) == (0, 0)
    assert locs[0].end.row < locs[1].start.row  # statements in position order
    df = spark.createDataFrame([(10, 5, 10, 6)], "r1 long, c1 long, r2 long, c2 long")
    p1, p2 = F.struct("r1", "c1"), F.struct("r2", "c2")
    row = df.select((p1 < p2).alias("lt"), (p1 == p1).alias("eq"), (p1 == p2).alias("ne")).first()
    assert row.lt and row.eq and not row.ne
    same = X.with_location(X.statements(fixture_files)).where("path = 'src/gauge.ts' and stmt_ord = 1")
    a, b = same.first().location, same.first().location
    assert a == b  # equal file, start and end


def test_several_statements_on_a_line(spark):
    text = ("class C {} class E {}\nconst é = 'ü'; /* ñ */ const a = `ß`; let k = 'é'; if (a) { b(); } else { c(); }\n"
            "import { q } from './q'; export { q };\nconst w = {} as any; type A = { x: 1 } & { y: 2 };\n"
            "for (let i = 0; i < 3; i++) { go(i); }\nfunction f() {} f();\n@D() class Q { x = 1; y() {} } @E class R {}\n")
    files = files_df(spark, [(1, "a.ts", 1, text)])
    rows = X.statements(files).orderBy("stmt_ord").collect()
    assert [r.value for r in rows] == [
        "class C {}", "class E {}", "const é = 'ü';", "/* ñ */ const a = `ß`;", "let k = 'é';", "if (a) { b(); } else { c(); }",
        "import { q } from './q';", "export { q };", "const w = {} as any;", "type A = { x: 1 } & { y: 2 };",
        "for (let i = 0; i < 3; i++) { go(i); }", "function f() {}", "f();", "@D() class Q { x = 1; y() {} }", "@E class R {}"]
    raw, lines = text.encode(), text.split("\n")
    for r in rows:
        assert raw[r.start_byte:r.end_byte].decode() == r.value
        assert lines[r.start_row].encode()[r.start_col:r.end_col].decode() == r.value


def test_one_long_line_of_many_statements(spark):
    text = "".join(f"const a{i} = '{i % 7 * 'ü'}';" for i in range(3000))
    rows = X.statements(files_df(spark, [(1, "min.ts", 1, text)])).orderBy("stmt_ord").collect()
    assert [r.name for r in rows] == [f"a{i}" for i in range(3000)]
    assert all(text.encode()[r.start_byte:r.end_byte].decode() == r.value for r in rows)


def test_nested_templates_of_any_depth(spark):
    def nest(d):
        return "`}{ ${ '`' + {a: 1}.a + " + (nest(d - 1) if d else "`it's \\` ${1}`") + " } // {`"

    text = "".join(f"export const t{d} = {nest(d)}; class C{d} {{}}\n" for d in range(12))
    files = files_df(spark, [(1, "t.ts", 1, text)])
    rows = X.statements(files).orderBy("stmt_ord").collect()
    assert [r.name for r in rows] == [x for d in range(12) for x in (f"t{d}", f"C{d}")]
    assert X.rejects_unbalanced(files).count() == 0
    toks = files.select(F.array_join(X.L.tokens(F.col("content")), "")).first()[0]
    assert toks == text


def test_all_names_of_a_declaration(spark):
    cases = {
        "a = 1, b = 2;": "a b", "{ p, q: r } = o;": "p r", "x": "x", "[[a, b], { c }] = d, e": "a b c e",
        "{ p, q: { s, t = f(1, 2), ...u }, [k + 1]: v, 'w': x = [1, 2] } = o, [g, , h = 3, ...z]: T<A, B> = i, last": "p s t u v x g h z last",
        "m: Map<string, number> = new Map<string, number>(), n = x < y, o = (a, b) => a": "m n o",
        "f: (a: number, b: { c: d }) => void, e = { a: 1, b: [2, 3] }; zz = 1": "f e",
        "{ a = { x: 1, y: 2 }, b = [1, 2], c } = o": "a b c", "a = { b: 1, c: [2, 3] }": "a", "a,\n  b,\n  c;": "a b c",
    }
    files = files_df(spark, [(1, f"{i}.ts", i, f"export const {c}\n") for i, c in enumerate(cases)])
    facts = X.extract_facts(files)
    got = {}
    for r in X.declarations_from(facts).where("stmt_ord = 1").collect():
        got.setdefault(r.file_ord, []).append(r.name)
    assert got == {i: want.split() for i, want in enumerate(cases.values())}
    exported = {(r.file_ord, r.export_name) for r in X.exports_from(facts).where("stmt_ord = 1").collect()}
    assert exported == {(i, n) for i, names in got.items() for n in names}


def test_nested_exports_that_share_a_line(spark):
    text = ("namespace N { export const a = 1, b = 2; export class K { m() { return 1; } } export namespace O { export let z = 0; } }\n"
            "export namespace M {\n  export const { d, e } = f(); export function g() {\n  }\n}\n")
    got = [(r.export_name, r.value) for r in X.exports(files_df(spark, [(1, "n.ts", 1, text)])).where("nested").orderBy("stmt_ord", "line", "export_name").collect()]
    assert got == [
        ("a", "export const a = 1, b = 2;"), ("b", "export const a = 1, b = 2;"), ("K", "export class K { m() { return 1; } }"),
        ("O", "export namespace O { export let z = 0; }"), ("z", "export let z = 0;"), ("d", "export const { d, e } = f();"),
        ("e", "export const { d, e } = f();"), ("g", "export function g() {\n  }")]
