import datetime as dt
import hashlib

from pyspark.sql import functions as F

from ts_sources import files_df
from tsfold.operators import extract as X
from tsfold.operators import imports as I
from tsfold.operators import merge as M
from tsfold.sources import files as S
from tsfold.streaming import events as EV
from tsfold.streaming import remerge as RM


def _merged(spark, rows, **kw):
    return M.merge_rows(files_df(spark, rows), M.MergeOptions(**kw)).orderBy("out_ord").collect()


def test_merge_order_and_dedupe(spark):
    rows = [
        (1, "a.ts", 1, "import { B } from './b';\nimport { Z } from './zed';\nimport { Y } from './why';\nexport const a = new B();\nfunction h() {}\n"),
        (1, "b.ts", 2, "export class B {}\n"),
    ]
    out = _merged(spark, rows)
    kinds = [(r.section, r.kind, r.path) for r in out]
    # unresolved imports hoisted and sorted by source path; exports next.
    # The resolved import is replaced by B's declaration at its own place
    # (a.ts comes first), so b.ts's copy is the duplicate that is dropped.
    assert kinds == [(0, "ImportDecl", "a.ts"), (0, "ImportDecl", "a.ts"),
                     (1, "ExportDecl", "a.ts"), (1, "ExportDecl", "a.ts"), (2, "Function", "a.ts")]
    assert out[0].value.startswith("import { Y } from './why'")
    assert out[2].value == "\nexport class B {}\n\n" and out[2].origin_path == "b.ts"
    assert out[3].value == "\nexport const a = new B();\n\n"  # spacing
    out2 = _merged(spark, rows, dedupe=False)
    assert sum(1 for r in out2 if r.value.strip() == "export class B {}") == 2


def test_merge_text_and_write(spark, tmp_path):
    rows = [(7, "x.ts", 1, "export const x = 1;\n"), (7, "y.ts", 2, "const y = 2;\n")]
    merged = M.merge_rows(files_df(spark, rows))
    text = "\nexport const x = 1;\n\nconst y = 2;\n"
    t = M.merge_text(merged).first()
    assert (t.n_rows, t.n_bytes, t.md5) == (2, len(text), hashlib.md5(text.encode()).hexdigest())
    assert bytes(S.text_chunks(merged, ["out_ord"]).first().content).decode() == text
    out = str(tmp_path / "out")
    S.write_merged_text(merged, out)
    assert "".join(r.value for r in S.read_merged_text(spark, out).orderBy("path").collect()) == text


def test_chunks_do_not_depend_on_the_partitioning(spark):
    rows = [(p, f"{i:03}.ts", i, ("é" * (i * 7 % 50) if i % 5 else None if i % 2 else "")) for p in (1, 2) for i in range(120)]
    rows += [(3, "big.ts", 1, "xyz" * 1000), (4, "none.ts", 1, None)]
    files = files_df(spark, rows)
    want = {}
    for p, _, _, t in rows:
        want[p] = want.get(p, b"") + (t.encode() + b"\n" if t is not None else b"")
    for n in (1, 7):
        concat = S.merge_concat_rows(files.repartition(n, "path"))
        chunks = S.text_chunks(concat, ["file_ord", "path"], chunk_bytes=97).orderBy("project_id", "chunk").collect()
        got = {}
        for r in chunks:
            assert r.n_bytes == len(r.content) <= 97 and r.chunk == len(got.get(r.project_id, b"")) // 97
            got[r.project_id] = got.get(r.project_id, b"") + bytes(r.content)
        assert got == {p: t for p, t in want.items() if t}
        digests = {r.project_id: (r.n_files, r.n_bytes, r.md5) for r in S.merge_concat(files.repartition(n, "path")).collect()}
        assert digests == {p: (sum(r[0] == p for r in rows), len(t), hashlib.md5(t).hexdigest()) for p, t in want.items()}


def test_quarantine_and_filters(spark):
    files = files_df(spark, [(1, "a.ts", 1, ""), (1, "b.js", 2, "x"), (1, "tests/c.ts", 3, "y"), (1, "d.ts", 4, "z" * 50)])
    ok, rej = S.quarantine(files, max_bytes=10)
    assert {(r.path, r.reason) for r in rej.collect()} == {("a.ts", "empty"), ("d.ts", "too_large")}
    keep, bad = S.filter_suffix(ok)
    assert [r.path for r in bad.collect()] == ["b.js"]
    assert [r.path for r in S.exclude_paths(keep, "tests,docs").collect()] == []
    assert S.merge_concat(files_df(spark, [(1, "a", 2, "B"), (1, "b", 1, "A")])).first().md5 == hashlib.md5(b"A\nB\n").hexdigest()


def test_event_normalisation(spark):
    rows = [
        ("linux", 0x2 | 0x200, False), ("linux", 0x80, False), ("linux", 0x100, False), ("linux", 0x1, False),
        ("macos", 0x2, True), ("macos", 0x2 | 0x20, False), ("macos", 0x20, False),
        ("windows", 2, False), ("windows", 5, False), ("windows", 1, False),
    ]
    df = spark.createDataFrame(rows, "backend string, mask bigint, is_dir boolean")
    got = [r.k for r in df.select(EV.normalize_kind(F.col("backend"), F.col("mask"), F.col("is_dir")).alias("k")).collect()]
    assert got == ["delete", "rename", "create", None, None, "modify", "rename", "delete", "rename", "create"]
    strict = [r.k for r in df.select(EV.normalize_kind(F.col("backend"), F.col("mask"), F.col("is_dir"), True).alias("k")).collect()]
    assert strict[2] is None and strict[9] is None


def test_scan_throttle_greedy(spark):
    t0 = dt.datetime(2024, 1, 1)
    ms = [0, 400, 999, 1000, 1500, 2100, 2200]
    rows = [(i, 1, t0 + dt.timedelta(milliseconds=m)) for i, m in enumerate(ms)] + [(99, 2, t0)]
    ev = spark.createDataFrame(rows, "event_id bigint, wd bigint, ts timestamp_ntz")
    kept = sorted((r.wd, r.event_id) for r in EV.scan_throttle(ev, gap_ms=1000).collect())
    assert kept == [(1, 0), (1, 3), (1, 5), (2, 99)]


def test_merge_options(spark):
    rows = [
        (4, "a.ts", 1, "// lead\nexport const a = 1; // trailing\ntype T = string;\n"),
        (4, "b.ts", 2, "export const a = 2;\n"),
    ]
    files = files_df(spark, rows)
    # comments dropped from the merged text
    out = M.merge_rows(files, M.MergeOptions(preserve_comments=False)).orderBy("out_ord").collect()
    assert out[0].value == "\nexport const a = 1;\n\n"
    # Unknown kinds (type alias) dropped only with strict_kinds
    kinds = [r.kind for r in M.merge_rows(files, M.MergeOptions(strict_kinds=True)).collect()]
    assert "Unknown" not in kinds
    assert "Unknown" in [r.kind for r in M.merge_rows(files).collect()]
    # conflicting exports: a report by default, an error on request
    import pytest
    with pytest.raises(ValueError):
        M.merge_rows(files, M.MergeOptions(on_conflict="error"))


def test_tied_file_order_is_decided_by_path(spark):
    files = files_df(spark, [(1, "z.ts", 5, "export const X = 1;\n"), (1, "a.ts", 5, "export const X = 2;\n")])
    row = M.export_conflicts(X.exports(files)).first()
    assert (row.first_path, row.last_path) == ("a.ts", "z.ts")


def test_absolute_import_paths_are_simplified(spark):
    df = spark.createDataFrame([("src/a.ts", "/lib/./x/../y"), ("src/a.ts", "../b/./c"), ("src/a.ts", "pkg/../x")], "path string, source_path string")
    got = [r.resolved_path for r in I.normalize_import_paths(df).collect()]
    assert got == ["/lib/y", "b/c", "pkg/../x"]


NAMESPACE = """// lead
export namespace Depot {
  // the options
  export interface Options {
    track: string; // trailing
  }
  export class Yard {
    open() { return 1; }
  }
}
"""


def test_inlined_namespace_member_is_whole_and_leaves_its_owner(spark):
    rows = [(1, "a.ts", 1, "import { Options } from './depot';\nexport const a = 1;\n"), (1, "depot.ts", 2, NAMESPACE)]
    out = _merged(spark, rows)
    assert [(r.path, r.origin_path, r.origin_line) for r in out] == [
        ("a.ts", "depot.ts", 3), ("a.ts", "a.ts", -1), ("depot.ts", "depot.ts", -1)]
    assert out[0].value == "\nexport interface Options {\n    track: string; // trailing\n  }\n\n"
    assert "export class Yard" in out[2].value and "export interface Options" in out[2].value
    plain = "".join(r.value for r in _merged(spark, rows, preserve_comments=False))
    assert "//" not in plain and plain.count("track: string;") == 2 and "export class Yard" in plain
    files = files_df(spark, rows)
    merged = M.merge_rows(files)
    lines = {(r.out_ord, r.line_in_stmt): (r.src_path, r.src_row)
             for r in I.line_provenance(merged, X.extract_facts(files)).collect()}
    first = min(k[0] for k in lines)
    assert [lines[first, i] for i in range(3)] == [("depot.ts", 3), ("depot.ts", 4), ("depot.ts", 5)]
    assert (first, 3) not in lines


def test_comment_follows_the_inlined_statement(spark):
    rows = [(1, "a.ts", 1, "import { B } from './b';\nconst a = 1;\n"), (1, "b.ts", 2, "// about B\nexport class B {}\n")]
    files = files_df(spark, rows)
    merged = M.merge_rows(files)
    place = {r.origin_path: r.out_ord for r in merged.collect()}
    assert [(r.comment, r.out_ord) for r in M.comment_carry(M.merge_facts(files), merged).collect()] == [("// about B", place["b.ts"])]


def test_comments_behind_code_and_in_unbalanced_files(spark):
    rows = [(1, "a.ts", 1, "const z = 1; // tail\nlet y = '// no'; /* own */ let x = 2; // x\n"), (1, "bad.ts", 2, "// lead\nclass Half {\n")]
    facts = M.merge_facts(files_df(spark, rows))
    got = M.comment_carry(facts, M.merge_rows_from_facts(facts)).orderBy("out_ord", "comment_ord").collect()
    assert [(r.path, r.stmt_ord, r.comment) for r in got] == [
        ("a.ts", 1, "// tail"), ("a.ts", 3, "/* own */"), ("a.ts", 3, "// x"), ("bad.ts", 1, "// lead")]


def test_members_of_one_line_are_inlined_without_comments(spark):
    rows = [(1, "a.ts", 1, "import { K } from './n';\n"),
            (1, "n.ts", 2, "/* ö */ export namespace N { export const q = 1; /* ü */ export class K { m() {} } }\n")]
    plain = _merged(spark, rows, preserve_comments=False)
    assert plain[0].value.strip() == "export class K { m() {} }"
    assert _merged(spark, rows)[0].value.strip() == "/* ü */ export class K { m() {} }"


def test_regex_literals_and_unbalanced_files_stay_in_the_merge(spark):
    rows = [(1, "re.ts", 1, "export const open = /[{]/;\nexport const q = [/'/g, /\\/\\{/];\nexport class A {}\nconst h = 6 / 2 / 1;\n"),
            (1, "bad.ts", 2, "export class Half {\nlet rest = 1;\n")]
    out = _merged(spark, rows)
    assert [r.value.strip() for r in out] == ["export const open = /[{]/;", "export const q = [/'/g, /\\/\\{/];",
                                              "export class A {}", "const h = 6 / 2 / 1;", "export class Half {\nlet rest = 1;"]
    assert [r.path for r in X.rejects_unbalanced(files_df(spark, rows)).collect()] == ["bad.ts"]


def test_remerge_follows_new_changed_and_deleted_files(spark, tmp_path):
    now = {}
    corpus = lambda s: files_df(s, [(p, path, o, text) for (p, path), (o, text) in now.items()])
    facts, whole, inc = str(tmp_path / "facts"), str(tmp_path / "whole"), str(tmp_path / "inc")
    now.update({(1, "a.ts"): (1, "const a = 1;\n"), (1, "b.ts"): (2, "const b = 1;\n"), (2, "c.ts"): (1, "const c = 1;\n")})
    M.merge_facts(corpus(spark)).write.partitionBy("project_id").parquet(facts)
    for out in (whole, inc):
        RM._write_projects(M.merge_rows(corpus(spark)), None, out)
    del now[1, "b.ts"], now[2, "c.ts"]
    now.update({(1, "a.ts"): (1, "const a = 2;\n"), (3, "d.ts"): (1, "const d = 1;\n")})
    batch = spark.createDataFrame([("a.ts", 1), ("b.ts", 1), ("c.ts", 2), ("d.ts", 3)], "path string, project_id bigint")
    for again in range(2):
        RM.remerge_batch(corpus, whole, lambda b: b)(batch, again)
        RM.remerge_incremental_batch(corpus, facts, inc, lambda b: b)(batch, again)
        for out in (whole, inc):
            got = [(r.project_id, r.path, r.value) for r in RM.read_merged(spark, out).orderBy("project_id").collect()]
            assert got == [(1, "a.ts", "const a = 2;\n"), (3, "d.ts", "const d = 1;\n")]


def test_progress_of_many_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(0, 240, 1, 120).write.parquet(src)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(src)
    RM.run_with_progress(stream, str(tmp_path / "out"), str(tmp_path / "progress"), str(tmp_path / "ck"),
                         lambda b: b.where("id % 2 = 0"))
    p = RM.read_progress(spark, str(tmp_path / "progress")).collect()
    assert len(p) == 120 and sum(r.num_input_rows for r in p) == 240
    assert spark.read.parquet(str(tmp_path / "out")).count() == 120
