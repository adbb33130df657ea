"""What intermediate results take up: texts stored once, scratch folders of batches and rounds removed."""

import os

import pytest
from ts_sources import files_df

from tsfold import session
from tsfold.operators import extract as X
from tsfold.operators import graph as G
from tsfold.operators import imports as I
from tsfold.operators import merge as M
from tsfold.session import scratch_released, stored
from tsfold.streaming import affected as AF
from tsfold.streaming import remerge as RM

ROWS = [(1, "a.ts", 1, "import { K, Q } from './n';\nimport x from 'x';\nconst a = new K(); // a\n"),
        (1, "b.ts", 2, "import { K } from './n';\nexport const b = K;\n"),
        (1, "n.ts", 3, "/* ö */ export namespace N { export const q = 1; /* ü */ export class K { m() {} } }\nexport class Q {}\n"),
        (2, "n.ts", 1, "export class Q {}\n")]


def _local(path):
    return path[len("file:"):] if path.startswith("file:") else path


@pytest.mark.parametrize("opts", [M.MergeOptions(), M.MergeOptions(dedupe=False), M.MergeOptions(preserve_comments=False)])
def test_a_merge_stores_texts_once(spark, monkeypatch, opts):
    schemas = []
    real = session.stored

    def seen(df, name="stored", made=None):
        schemas.append(set(df.columns))
        return real(df, name, made)

    monkeypatch.setattr(M, "stored", seen)
    monkeypatch.setattr("tsfold.operators.order._stored", seen)
    out = [(r.project_id, r.out_ord, r.value.strip()) for r in M.merge_rows(files_df(spark, ROWS), opts).orderBy("project_id", "out_ord").collect()]
    assert sum(bool(s & {"value", "out_value", "_text", "export_value"}) for s in schemas) == 1
    K = "/* ü */ export class K { m() {} }" if opts.preserve_comments else "export class K { m() {} }"
    tail = "const a = new K(); // a" if opts.preserve_comments else "const a = new K();"
    N = ROWS[2][3].split("\n")[0] if opts.preserve_comments else "export namespace N { export const q = 1;          export class K { m() {} } }"
    found = [v for p, _, v in out if p == 1]
    if opts.dedupe:
        assert found == ["import x from 'x';", K, "export class Q {}", "export const b = K;", N, tail]
    else:
        assert sorted(found) == sorted(["import x from 'x';", K, "export class Q {}", K, "export const b = K;", N, "export class Q {}", tail])
    assert [v for p, _, v in out if p == 2] == ["export class Q {}"]


def test_scratch_of_a_block_is_removed(spark):
    made = []
    with scratch_released(spark):
        assert stored(spark.range(3), "kept", made).count() == 3 and os.path.isdir(_local(made[0]))
    assert not os.path.exists(_local(made[0]))
    with pytest.raises(ZeroDivisionError), scratch_released(spark):
        stored(spark.range(3), "kept", made)
        1 / 0
    assert not os.path.exists(_local(made[1]))
    assert stored(spark.range(3), "kept", made).count() == 3 and os.path.isdir(_local(made[2]))
    assert spark.conf.get(session.SHUFFLE_CLEANUP) == "false"


def test_remerge_leaves_no_scratch(spark, tmp_path):
    base = _local(session.ensure_checkpoint_dir(spark))
    files, facts, whole, inc = files_df(spark, ROWS), str(tmp_path / "facts"), str(tmp_path / "whole"), str(tmp_path / "inc")
    M.merge_facts(files, M.MergeOptions()).write.partitionBy("project_id").parquet(facts)
    batch = spark.createDataFrame([("a.ts", 1), ("n.ts", 2)], "path string, project_id bigint")
    before = set(os.listdir(base))
    RM.remerge_batch(files, whole, lambda b: b)(batch, 0)
    RM.remerge_incremental_batch(files, facts, inc, lambda b: b)(batch, 0)
    assert set(os.listdir(base)) == before
    rows = [sorted(map(repr, RM.read_merged(spark, out).collect())) for out in (whole, inc)]
    assert rows[0] == rows[1] and len(rows[0]) == 7


def test_components_of_small_projects_need_no_rounds(spark, monkeypatch):
    chain = [(1, f"n{i * 7 % 31:02d}", f"n{(i + 1) * 7 % 31:02d}") for i in range(30)]
    more = [(2, "b", "a"), (2, "c", "b"), (2, "d", "d"), (2, "x", "y"), (2, "c", "b"), (2, "y", "w"), (3, "q", "p")]
    odd = [(None, "a", "b"), (5, None, "b"), (5, "b", "c")]
    large = [(8, f"n{i}", f"n{i + 1}") for i in range(70)]

    def found(rows):
        e = spark.createDataFrame(rows, "project_id bigint, src string, dst string")
        return sorted(map(repr, G.components(e).collect()))

    base = _local(session.ensure_checkpoint_dir(spark))
    before = set(os.listdir(base))
    every = found(chain + more + odd + large)
    # edges, large projects, edges both ways, and the last labels
    assert len([x for x in set(os.listdir(base)) - before if x.startswith("round-")]) == 4
    joins = []
    real = G._empty
    monkeypatch.setattr(G, "_empty", lambda df: joins.append(1) or real(df))
    alone = found(chain + more)
    assert len(joins) == 1
    monkeypatch.setattr(G, "SMALL_GRAPH", 0)
    assert alone == found(chain + more) and every == found(chain + more + odd + large)


def test_references_without_a_distinct_of_their_own(spark):
    st = X.extract_facts(files_df(spark, ROWS), materialize=True)
    once, many = I.located_refs(st), I.located_refs(st, distinct=False)
    assert "HashAggregate" not in many._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    for use in (I.cross_module_refs, I.usage_position, lambda refs: I.dead_decls(X.declarations_from(st), refs)):
        assert sorted(map(repr, use(once).collect())) == sorted(map(repr, use(many).collect()))


def test_changes_leave_no_scratch(spark, tmp_path):
    base, index, out = _local(session.ensure_checkpoint_dir(spark)), str(tmp_path / "index"), str(tmp_path / "out")
    rows = [(1, "q.ts", 1, "export class Q {}\n"), (1, "u.ts", 2, "import { Q } from './q';\nconst u = new Q();\n"),
            (2, "q.ts", 1, "export class Q {}\n")]
    before = set(os.listdir(base))
    AF.write_index(files_df(spark, rows), index)
    change = spark.createDataFrame([(1, 1, "q.ts", 1, "modify", "export class Q { x = 1; }\n")], AF.CHANGE_SCHEMA)
    AF.affected_batch(index, out)(change, 0)
    assert set(os.listdir(base)) == before
    assert {(r.project_id, r.path, r.hop) for r in AF.read_affected(spark, out).collect()} == {(1, "q.ts", 0), (1, "u.ts", 1)}
