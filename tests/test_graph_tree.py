from pyspark.sql import functions as F

from tsfold.operators import extract as X
from tsfold.operators import graph as G
from tsfold.operators import tree as T


def _graph(fixture_files):
    st = X.extract_facts(fixture_files)
    decls = X.declarations_from(st)
    ref = X.ref_edges_from(st, decls)
    cont = X.contains_edges_from(st).select("project_id", "src", "dst", "edge_kind")
    return ref.unionByName(cont)


def _flow(edges, node):
    return {r.related: r.relation for r in G.flow_of(edges).where(F.col("node") == node).collect()}


def test_flow_golden_facts(fixture_files):
    e = _graph(fixture_files)
    # reverse edges: things that use Unit
    f = _flow(e, "Unit")
    assert {"Scales", "Probe"} <= set(f) and f["Probe"] == "dependant"
    # forward edges: several base interfaces
    assert {"Dated", "Labelled"} <= set(_flow(e, "Entry"))
    deg = {r.node: r.n_dependencies for r in G.degrees(e).collect()}
    assert deg["Entry"] >= 2
    # containment: namespace members
    f = _flow(e, "Limits")
    assert f.get("Window") == "member" and f.get("Alarm") == "member"


def test_method_edges(fixture_files):
    st = X.extract_facts(fixture_files)
    m = {(r.src, r.dst) for r in X.method_edges_from(st).collect()}
    assert {("Ring", "constructor"), ("Ring", "push"), ("Probe", "unit")} <= m


def test_cycle(spark):
    e = spark.createDataFrame(
        [(1, "Node1", "Node2", "uses"), (1, "Node2", "Node3", "uses"), (1, "Node3", "Node1", "uses"),
         (2, "a", "b", "uses"), (2, "b", "c", "uses"),
         (3, "x", "y", "uses"), (3, "y", "y", "uses"), (3, "y", "z", "uses")],
        "project_id bigint, src string, dst string, edge_kind string")
    hc = {r.project_id: r.has_cycle for r in G.has_cycle(e).collect()}
    assert hc == {1: True, 2: False, 3: True}
    mem = {(r.project_id, r.node) for r in G.cycle_members(e).collect()}
    assert mem == {(1, "Node1"), (1, "Node2"), (1, "Node3"), (3, "y")}
    lv = {(r.node, r.level) for r in G.topo_order(e).collect()}
    assert lv == {("a", 0), ("b", 1), ("c", 2)}
    seeds = spark.createDataFrame([(2, "a"), (1, "Node1")], "project_id bigint, seed string")
    cl = {(r.seed, r.node, r.hops) for r in G.closure(e, seeds).collect()}
    assert cl == {("a", "b", 1), ("a", "c", 2), ("Node1", "Node2", 1), ("Node1", "Node3", 2), ("Node1", "Node1", 3)}


def test_peeling_equals_scc_property(spark):
    """Property: a node survives two-sided peeling and lies in a non-trivial
    SCC iff it reaches itself (brute force on a small random graph)."""
    import random

    rnd = random.Random(7)
    edges = [(1, f"n{rnd.randrange(12)}", f"n{rnd.randrange(12)}", "uses") for _ in range(20)]
    e = spark.createDataFrame(edges, "project_id bigint, src string, dst string, edge_kind string")
    adj = {}
    for _, a, b, _k in edges:
        adj.setdefault(a, set()).add(b)

    def reaches_self(n):
        seen, todo = set(), list(adj.get(n, ()))
        while todo:
            x = todo.pop()
            if x == n:
                return True
            if x not in seen:
                seen.add(x)
                todo.extend(adj.get(x, ()))
        return False

    truth = {n for n in adj if reaches_self(n)}
    got = {r.node for r in G.cycle_members(e).collect()}
    assert got == truth


def test_tree_orders(spark):
    nodes = spark.createDataFrame(
        [(0, "r", None, "01", 0, "Program", "x"), (0, "a", "r", "01/01", 1, "Class", "skip"),
         (0, "a1", "a", "01/01/01", 2, "Method", "x"), (0, "b", "r", "01/02", 1, "Class", "x"),
         (0, "b1", "b", "01/02/01", 2, "Method", "x")],
        "project_id bigint, node_id string, parent_id string, sort_path string, depth int, kind string, label string")
    pre = [r.node_id for r in T.preorder(nodes).orderBy("pre_ord").collect()]
    post = [r.node_id for r in T.postorder(nodes).orderBy("post_ord").collect()]
    assert pre == ["r", "a", "a1", "b", "b1"]
    assert post == ["a1", "a", "b1", "b", "r"]
    kept = {r.node_id for r in T.prune(nodes, F.col("label") == "skip").collect()}
    assert kept == {"r", "a", "b", "b1"}  # a visited, its subtree skipped
    leaves = {r.node_id for r in T.leaf_nodes(nodes).collect()}
    assert leaves == {"a1", "b1"}


def test_position_order(spark):
    df = spark.createDataFrame([(10, 6), (10, 5), (9, 99)], "row bigint, col bigint")
    from tsfold.operators.order import dense_rank_within
    r = dense_rank_within(df.withColumn("g", F.lit(0)), ["g"], [F.struct("row", "col")], "pos")
    got = [(x.row, x.col) for x in r.orderBy("pos").collect()]
    assert got == [(9, 99), (10, 5), (10, 6)]


def test_located_refs_own_file_then_imports_then_exports(spark):
    from tsfold.operators import imports as I

    src = {
        "a.ts": "export class Base {}\nclass Helper {}\nexport class A { b: Base; h: Helper; }\n",
        "b.ts": "class Base {}\nclass Helper {}\nexport class B { b: Base; }\n",
        "lib/index.ts": "export class Base {}\n",
        "c.ts": "import { Base as Root } from './lib';\nimport { B } from 'elsewhere';\nexport class C { r: Root; b: B; }\n",
        "d.ts": "export class D { a: A; h: Helper; }\n",
    }
    files = spark.createDataFrame([(1, p, k, t, len(t)) for k, (p, t) in enumerate(src.items())],
                                  "project_id bigint, path string, file_ord bigint, content string, n_bytes bigint")
    st = X.extract_facts(files)
    refs = I.located_refs(st)
    found = {(r.src_path, r.src, r.dst_path, r.dst) for r in refs.collect()}
    assert found == {("a.ts", "A", "a.ts", "Base"), ("a.ts", "A", "a.ts", "Helper"), ("b.ts", "B", "b.ts", "Base"),
                     ("c.ts", "C", "lib/index.ts", "Base"), ("d.ts", "D", "a.ts", "A")}
    # the helper of b.ts is unused, however often other files use that name
    dead = {(r.path, r.name) for r in I.dead_decls(X.declarations_from(st), refs).collect()}
    assert dead == {("b.ts", "Helper")}
    assert {(r.path, r.name, r.first_use_path) for r in I.usage_position(refs).collect()} == {
        ("a.ts", "Base", "a.ts"), ("a.ts", "Helper", "a.ts"), ("b.ts", "Base", "b.ts"),
        ("lib/index.ts", "Base", "c.ts"), ("a.ts", "A", "d.ts")}


def test_affected_nodes_share_one_frontier(spark):
    n = 6
    e = spark.createDataFrame([(1, f"n{k}", f"n{k + 1}", "uses") for k in range(n)] + [(1, "n2", "n2", "uses"), (1, "x", "y", "uses")],
                              "project_id bigint, src string, dst string, edge_kind string")
    changed = spark.createDataFrame([(1, "n3"), (1, "n1")], "project_id bigint, node string")
    assert sorted(r.node for r in G.affected(e, changed).collect()) == ["n0", "n1", "n2", "n3"]
