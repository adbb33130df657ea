"""DuckDB oracle SQL per query key. Oracles read the base tables directly and
rebuild expected facts from keys (imports = lineitem, exports = part +
orders, conflicts = repeated brands, cycles = repeated parts); they never
re-run the Spark logic on text."""

from __future__ import annotations

NL = "chr(10)"


def v(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


# ts_parts statement values (one exported class per part)
TP = f"""
tp AS (
  SELECT p_partkey % 16 AS project_id, 'src/part/' || {v('p_partkey')} || '.ts' AS path,
         p_partkey AS file_ord, p_partkey AS pk, p_brand, p_size,
         '// part ' || {v('p_partkey')} || {NL} || 'export class Part' || {v('p_partkey')} || ' {{' || {NL}
         || '    brand: string = ''' || p_brand || ''';' || {NL}
         || '    size: number = ' || {v('p_size')} || ';' || {NL} || '}}' AS value
  FROM part)"""

# lineitem in file order per order, import lines and their byte offsets
LI = f"""
li AS (
  SELECT l_orderkey AS k, l_partkey AS pk,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn,
         count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem),
lim AS (
  SELECT *, l.k % 16 AS project_id, 'src/order/' || {v('k')} || '.ts' AS path, 1000000000 + k AS file_ord,
         'import {{ Part' || {v('pk')} || ' }} from ''../part/' || {v('pk')} || ''';' AS line
  FROM li l),
lio AS (
  SELECT *, COALESCE(SUM(strlen(line) + 1) OVER (PARTITION BY k ORDER BY rn
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM lim),
ord AS (
  SELECT k, n, k % 16 AS project_id, 'src/order/' || {v('k')} || '.ts' AS path, 1000000000 + k AS file_ord,
         sum(strlen(line) + 1) AS imp_bytes, string_agg(line, chr(10) ORDER BY rn) AS imp_text,
         'export const order' || {v('k')} || ' = ['
           || string_agg('new Part' || {v('pk')} || '()', ', ' ORDER BY rn) || '];' AS exp_line,
         'function helper' || {v('k')} || '() {{' || {NL} || '    return order' || {v('k')} || ';' || {NL} || '}}' AS fn_value
  FROM lim GROUP BY k, n),
ordv AS (
  SELECT *, '/* order ' || {v('k')} || ' */' || {NL} || exp_line AS exp_value FROM ord)"""

STMTS = f"""
WITH {TP}, {LI},
stmts AS (
  SELECT project_id, path, file_ord, CAST(1 AS BIGINT) AS stmt_ord, 'ExportDecl' AS kind,
         'export_statement' AS raw_type, 'Part' || {v('pk')} AS name, true AS is_export, value,
         CAST(0 AS BIGINT) AS start_byte, CAST(strlen(value) AS BIGINT) AS end_byte,
         CAST(0 AS BIGINT) AS start_row, CAST(0 AS BIGINT) AS start_col,
         CAST(4 AS BIGINT) AS end_row, CAST(1 AS BIGINT) AS end_col
  FROM tp
  UNION ALL
  SELECT project_id, path, file_ord, rn, 'ImportDecl', 'import_statement', NULL, false, line,
         CAST(off AS BIGINT), CAST(off + strlen(line) AS BIGINT), rn - 1, 0, rn - 1, strlen(line)
  FROM lio
  UNION ALL
  SELECT project_id, path, file_ord, n + 1, 'ExportDecl', 'export_statement', 'order' || {v('k')}, true,
         exp_value, CAST(imp_bytes AS BIGINT), CAST(imp_bytes + strlen(exp_value) AS BIGINT), n, 0, n + 1,
         strlen(exp_line)
  FROM ordv
  UNION ALL
  SELECT project_id, path, file_ord, n + 2, 'Function', 'function_declaration', 'helper' || {v('k')}, false,
         fn_value, CAST(imp_bytes + strlen(exp_value) + 1 AS BIGINT),
         CAST(imp_bytes + strlen(exp_value) + 1 + strlen(fn_value) AS BIGINT), n + 2, 0, n + 4, 1
  FROM ordv)"""

ORACLES: dict[str, str] = {}

ORACLES["merge_concat"] = f"""
SELECT source AS project_id, count(*) AS n_files, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes,
       md5(string_agg(text, {NL} ORDER BY doc_id) || {NL}) AS md5
FROM documents GROUP BY source"""

ORACLES["merge_concat_rows"] = f"""
SELECT source AS project_id, doc_id AS file_ord, 'docs/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text || {NL} AS value
FROM documents"""

ORACLES["quarantine"] = """
SELECT source AS project_id, 'docs/' || CAST(doc_id AS VARCHAR) || '.txt' AS path,
       CASE WHEN text IS NULL THEN 'missing' WHEN strlen(text) = 0 THEN 'empty'
            WHEN strlen(text) > 20000 THEN 'too_large' ELSE 'accepted' END AS reason
FROM documents"""

ORACLES["filter_suffix"] = """
SELECT page_id AS project_id, url AS path,
       CASE WHEN url LIKE '%.html' THEN 'accepted' ELSE 'bad_suffix' END AS reason
FROM pages"""

ORACLES["exclude_paths"] = """
SELECT source AS project_id, source || '/docs/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, doc_id AS file_ord
FROM documents
WHERE NOT (source = 'src1' OR source LIKE 'src2%' OR source = 'docs_x')"""

ORACLES["statements"] = STMTS + """
SELECT * FROM stmts"""

ORACLES["classify_kind"] = STMTS + """
SELECT raw_type, kind, count(*) AS n FROM stmts GROUP BY raw_type, kind"""

ORACLES["kind_histogram"] = STMTS + """
SELECT project_id, kind, count(*) AS n FROM stmts GROUP BY project_id, kind"""

ORACLES["imports"] = f"""
WITH {LI}
SELECT project_id, path, file_ord, rn AS stmt_ord, CAST(0 AS BIGINT) AS name_ord,
       'Part' || {v('pk')} AS imported_name, 'Part' || {v('pk')} AS local_name,
       '../part/' || {v('pk')} AS source_path, line AS value
FROM lim"""

ORACLES["exports"] = STMTS + """
SELECT project_id, path, file_ord, stmt_ord, name AS export_name, kind, value, false AS nested
FROM stmts WHERE is_export"""

ORACLES["declarations"] = STMTS + """
SELECT project_id, path, file_ord, stmt_ord, name, kind, raw_type, is_export,
       CASE WHEN name LIKE 'Part%' THEN 'class' WHEN name LIKE 'order%' THEN 'const' ELSE 'function' END
         AS decl_keyword
FROM stmts WHERE name IS NOT NULL"""

ORACLES["rejects"] = """
SELECT p_partkey % 16 AS project_id,
       'src/part/' || CAST(p_partkey AS VARCHAR) || CASE WHEN p_size BETWEEN 3 AND 4 THEN '.js' ELSE '.ts' END AS path,
       CASE WHEN p_size <= 2 THEN 'empty' WHEN p_size <= 4 THEN 'bad_suffix' ELSE 'unbalanced' END AS reason
FROM part WHERE p_size <= 4 OR p_size >= 45"""

ORACLES["export_conflicts"] = """
SELECT p_partkey % 16 AS project_id, replace(p_brand, '#', '_') AS export_name, count(*) AS n_exports,
       count(*) AS n_files, 'src/brand/' || CAST(min(p_partkey) AS VARCHAR) || '.ts' AS first_path,
       'src/brand/' || CAST(max(p_partkey) AS VARCHAR) || '.ts' AS last_path
FROM part GROUP BY p_partkey % 16, p_brand HAVING count(*) > 1"""

ORACLES["resolve_imports"] = f"""
WITH {LI}
SELECT project_id, path, rn AS stmt_ord, 'Part' || {v('pk')} AS imported_name,
       '../part/' || {v('pk')} AS source_path, (pk % 16 = k % 16) AS resolved,
       CASE WHEN pk % 16 = k % 16 THEN 'src/part/' || {v('pk')} || '.ts' END AS export_path,
       CASE WHEN pk % 16 = k % 16 THEN CAST(1 AS BIGINT) END AS export_stmt_ord
FROM lim"""

ORACLES["unresolved_imports"] = f"""
WITH {LI}
SELECT project_id, path, rn AS stmt_ord, 'Part' || {v('pk')} AS imported_name,
       '../part/' || {v('pk')} AS source_path
FROM lim WHERE pk % 16 <> k % 16"""

# merged rows of ts_corpus: unresolved imports hoisted and sorted by source
# path, then exports (own; inlined copies of resolved imports are dropped as
# duplicates of the part file's own export), then the rest; spacing applied.
MERGED = STMTS + f""",
merged AS (
  SELECT s.project_id, s.path, s.file_ord, s.stmt_ord, s.kind,
         CASE WHEN s.kind = 'ImportDecl' THEN 0 WHEN s.kind = 'ExportDecl' THEN 1 ELSE 2 END AS section,
         CASE WHEN s.kind = 'ImportDecl' THEN regexp_extract(s.value, 'from ''([^'']*)''', 1) END AS sort_path,
         CASE WHEN s.kind IN ('ExportDecl') THEN {NL} ELSE '' END || s.value
           || CASE WHEN s.kind IN ('ExportDecl') THEN {NL} ELSE '' END || {NL} AS value
  FROM stmts s
  WHERE NOT (s.kind = 'ImportDecl'
             AND TRY_CAST(regexp_extract(s.value, 'Part([0-9]+)', 1) AS BIGINT) % 16 = s.project_id)),
mo AS (
  SELECT *, row_number() OVER (PARTITION BY project_id
            ORDER BY section, sort_path NULLS LAST, file_ord, stmt_ord) AS out_ord
  FROM merged)"""

ORACLES["merge_full"] = MERGED + """
SELECT project_id, out_ord, CAST(section AS BIGINT) AS section, path, stmt_ord, kind, value FROM mo"""

ORACLES["output_stats"] = MERGED + """
SELECT project_id, CAST(sum(strlen(value)) AS BIGINT) AS n_bytes, count(*) AS n_rows,
       sum(strlen(value)) = 0 AS empty
FROM mo GROUP BY project_id"""


ORACLES["flatten_program"] = STMTS + """
SELECT project_id, path, stmt_ord,
       row_number() OVER (PARTITION BY project_id ORDER BY file_ord, stmt_ord) AS out_ord
FROM stmts"""

ORACLES["ref_edges"] = f"""
WITH {LI}
SELECT DISTINCT project_id, 'order' || {v('k')} AS src, 'Part' || {v('pk')} AS dst, 'uses' AS edge_kind
FROM lim WHERE pk % 16 = k % 16
UNION ALL
SELECT DISTINCT project_id, 'helper' || {v('k')}, 'order' || {v('k')}, 'uses' FROM lim"""

CUST = """
cu AS (SELECT DISTINCT o_custkey AS c, o_custkey % 16 AS project_id,
              'src/customer/' || CAST(o_custkey AS VARCHAR) || '.ts' AS path,
              'Group' || CAST(o_custkey % 7 AS VARCHAR) AS grp FROM orders),
co AS (SELECT o_orderkey AS o, o_custkey AS c FROM orders)"""

ORACLES["contains_edges"] = f"""
WITH {CUST}
SELECT project_id, path, grp AS src, 'Config' AS dst, 'contains' AS edge_kind FROM cu
UNION ALL
SELECT cu.project_id, cu.path, cu.grp, 'Order' || {v('co.o')}, 'contains' FROM co JOIN cu ON co.c = cu.c"""

ORACLES["method_edges"] = f"""
WITH {CUST}
SELECT project_id, path, 'Account' || {v('c')} AS src, 'status' AS dst, 'method' AS edge_kind FROM cu
UNION ALL
SELECT cu.project_id, cu.path, 'Account' || {v('cu.c')}, 'order' || {v('co.o')}, 'method'
FROM co JOIN cu ON co.c = cu.c"""

ORACLES["flow_of"] = f"""
WITH {CUST},
e AS (
  SELECT DISTINCT project_id, 'Account' || {v('c')} AS src, 'Base' || {v('c')} AS dst, 'uses' AS k FROM cu
  UNION
  SELECT DISTINCT project_id, grp, 'Base' || {v('c')}, 'uses' FROM cu
  UNION
  SELECT DISTINCT project_id, grp, 'Config', 'contains' FROM cu
  UNION
  SELECT DISTINCT cu.project_id, cu.grp, 'Order' || {v('co.o')}, 'contains' FROM co JOIN cu ON co.c = cu.c)
SELECT DISTINCT project_id, src AS node, dst AS related,
       CASE WHEN k = 'contains' THEN 'member' ELSE 'dependency' END AS relation FROM e
UNION
SELECT DISTINCT project_id, dst, src, CASE WHEN k = 'contains' THEN 'owner' ELSE 'dependant' END FROM e"""

ORACLES["find_by_name"] = """
SELECT p_partkey % 16 AS project_id, replace(p_brand, '#', '_') AS name,
       'src/brand/' || CAST(min(p_partkey) AS VARCHAR) || '.ts' AS path, CAST(1 AS BIGINT) AS stmt_ord,
       'ExportDecl' AS kind
FROM part GROUP BY p_partkey % 16, p_brand"""

EO = """
eo AS (
  SELECT l_orderkey AS project_id, l_partkey AS pk,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn,
         count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem),
eg AS (
  SELECT a.project_id, 'p' || CAST(a.pk AS VARCHAR) AS src, 'p' || CAST(b.pk AS VARCHAR) AS dst,
         'uses' AS edge_kind
  FROM eo a JOIN eo b ON a.project_id = b.project_id AND b.rn = a.rn + 1)"""

ORACLES["dependency_edges"] = f"""
WITH {EO}
SELECT project_id, src AS node, dst AS other, 'dependency' AS relation, edge_kind FROM eg
UNION ALL
SELECT project_id, dst, src, 'reference', edge_kind FROM eg"""

ORACLES["degrees"] = f"""
WITH {EO},
o AS (SELECT project_id, src AS node, count(*) AS n FROM eg GROUP BY 1, 2),
i AS (SELECT project_id, dst AS node, count(*) AS n FROM eg GROUP BY 1, 2)
SELECT COALESCE(o.project_id, i.project_id) AS project_id, COALESCE(o.node, i.node) AS node,
       COALESCE(o.n, 0) AS n_dependencies, COALESCE(i.n, 0) AS n_references
FROM o FULL OUTER JOIN i ON o.project_id = i.project_id AND o.node = i.node"""

ORACLES["closure"] = f"""
WITH RECURSIVE {EO},
seeds AS (SELECT project_id, 'p' || CAST(pk AS VARCHAR) AS seed FROM eo WHERE rn = n),
r(project_id, seed, node) AS (
  SELECT s.project_id, s.seed, e.dst FROM seeds s JOIN eg e ON e.project_id = s.project_id AND e.src = s.seed
  UNION
  SELECT r.project_id, r.seed, e.dst FROM r JOIN eg e ON e.project_id = r.project_id AND e.src = r.node)
SELECT project_id, seed, node FROM r"""

ORACLES["has_cycle"] = f"""
WITH {EO}
SELECT project_id, count(*) > count(DISTINCT pk) AS has_cycle
FROM eo GROUP BY project_id HAVING count(*) >= 2"""

ORACLES["cycle_members"] = f"""
WITH {EO},
rep AS (SELECT a.project_id, a.rn AS i, b.rn AS j FROM eo a JOIN eo b
        ON a.project_id = b.project_id AND a.pk = b.pk AND a.rn < b.rn)
SELECT DISTINCT e.project_id, 'p' || CAST(e.pk AS VARCHAR) AS node
FROM eo e JOIN rep r ON e.project_id = r.project_id AND e.rn BETWEEN r.i AND r.j"""

ORACLES["topo_order"] = f"""
WITH {EO},
acyc AS (SELECT project_id FROM eo GROUP BY project_id
         HAVING count(*) >= 2 AND count(*) = count(DISTINCT pk))
SELECT e.project_id, 'p' || CAST(e.pk AS VARCHAR) AS node, e.rn - 1 AS level
FROM eo e JOIN acyc USING (project_id)"""

ORACLES["components"] = f"""
WITH {EO},
multi AS (SELECT project_id, min('p' || CAST(pk AS VARCHAR)) AS component FROM eo
          GROUP BY project_id HAVING count(*) >= 2)
SELECT DISTINCT e.project_id, 'p' || CAST(e.pk AS VARCHAR) AS node, m.component
FROM eo e JOIN multi m USING (project_id)"""

ORACLES["affected_files"] = f"""
WITH {LI},
chg AS (SELECT p_partkey FROM part WHERE p_size >= 45)
SELECT DISTINCT p_partkey % 16 AS project_id, 'src/part/' || CAST(p_partkey AS VARCHAR) || '.ts' AS path FROM chg
UNION
SELECT DISTINCT l.project_id, l.path FROM lim l JOIN chg c ON l.pk = c.p_partkey WHERE l.pk % 16 = l.k % 16"""


def _pad(x: str) -> str:
    return f"lpad(CAST({x} AS VARCHAR), 12, '0')"


NG = f"""
ng AS (
  SELECT CAST(0 AS BIGINT) AS project_id, 'r' || {v('r_regionkey')} AS node_id, CAST(NULL AS VARCHAR) AS parent_id,
         {_pad('r_regionkey')} AS sort_path, CAST(0 AS BIGINT) AS depth, 'Program' AS kind, r_name AS label
  FROM region
  UNION ALL
  SELECT 0, 'n' || {v('n_nationkey')}, 'r' || {v('n_regionkey')},
         {_pad('n_regionkey')} || '/' || {_pad('n_nationkey')}, 1, 'Class', n_name
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 0, 'c' || {v('c_custkey')}, 'n' || {v('c_nationkey')},
         {_pad('n_regionkey')} || '/' || {_pad('n_nationkey')} || '/' || {_pad('c_custkey')}, 2, 'Method',
         c_mktsegment
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 0, 'o' || {v('o_orderkey')}, 'c' || {v('o_custkey')},
         {_pad('n_regionkey')} || '/' || {_pad('n_nationkey')} || '/' || {_pad('c_custkey')} || '/'
           || {_pad('o_orderkey')}, 3, 'Statement', o_orderstatus
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey)"""

ORACLES["preorder"] = f"""
WITH {NG}
SELECT node_id, sort_path, row_number() OVER (ORDER BY sort_path) AS pre_ord FROM ng"""

ORACLES["postorder"] = f"""
WITH {NG}
SELECT node_id, row_number() OVER (ORDER BY sort_path || '/~') AS post_ord FROM ng"""

ORACLES["prune"] = f"""
WITH {NG}
SELECT n.node_id, n.parent_id, n.depth FROM ng n
WHERE NOT EXISTS (SELECT 1 FROM ng p WHERE p.kind = 'Method' AND p.label = 'BUILDING'
                  AND n.sort_path LIKE p.sort_path || '/%')"""

ORACLES["leaf_nodes"] = f"""
WITH {NG}
SELECT n.node_id, n.kind FROM ng n
WHERE NOT EXISTS (SELECT 1 FROM ng c WHERE c.parent_id = n.node_id)"""


EV = """
ev AS (
  SELECT event_id, user_id AS wd, CAST(user_id AS VARCHAR) || '.ts' AS name, ts, event_type, value,
         CASE WHEN event_type = 'error' OR value > 100 THEN 'delete'
              WHEN event_type IN ('view', 'purchase') THEN 'modify'
              WHEN event_type = 'click' THEN 'rename'
              WHEN event_type = 'signup' THEN 'create' END AS kind,
         '/w/u' || CAST(user_id AS VARCHAR) || '/' || CAST(user_id AS VARCHAR) || '.ts' AS path
  FROM events)"""

ORACLES["normalize_events"] = f"""
WITH {EV}
SELECT event_id, wd, name, kind FROM ev WHERE kind IS NOT NULL"""

ORACLES["event_source"] = ORACLES["normalize_events"]

ORACLES["route_events"] = f"""
WITH {EV}
SELECT event_id, path, kind FROM ev WHERE kind IS NOT NULL"""

ORACLES["ignore_deletes"] = f"""
WITH {EV}
SELECT event_id, path, kind FROM ev WHERE kind IS NOT NULL AND kind <> 'delete'"""

ORACLES["scan_throttle"] = f"""
WITH RECURSIVE {EV},
acc(wd, event_id, ts) AS (
  SELECT wd, arg_min(event_id, ts), min(ts) FROM ev GROUP BY wd
  UNION ALL
  SELECT e.wd, arg_min(e.event_id, e.ts), min(e.ts)
  FROM acc a JOIN ev e ON e.wd = a.wd AND e.ts >= a.ts + INTERVAL 1 DAY
  GROUP BY e.wd)
SELECT wd, event_id FROM acc"""

ORACLES["scan_throttle_stream"] = ORACLES["scan_throttle"]

ORACLES["active_paths"] = f"""
WITH {EV}
SELECT path, arg_max(kind, ts) AS last_kind FROM ev GROUP BY path
HAVING arg_max(kind, ts) NOT IN ('delete', 'rename')"""

ORACLES["watch_dedup"] = f"""
WITH {EV}
SELECT path, min(ts) AS first_ts, count(*) AS n_events FROM ev GROUP BY path"""

ORACLES["register_path"] = f"""
WITH {EV}
SELECT DISTINCT '/w/u' || CAST(wd AS VARCHAR) AS dir, path FROM ev WHERE kind = 'create'"""

ORACLES["event_counts"] = f"""
WITH {EV}
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, kind, count(*) AS n
FROM ev GROUP BY 1, 2"""

ORACLES["event_counts_stream"] = f"""
WITH {EV}
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, kind, count(*) AS n
FROM ev
GROUP BY 1, 2"""

ORACLES["remerge_stream"] = ORACLES["merge_full"]
ORACLES["remerge_incremental"] = ORACLES["merge_full"]

# four landed event files, one per micro-batch (maxFilesPerTrigger = 1)
ORACLES["stream_progress"] = """
SELECT CAST(4 AS BIGINT) AS n_batches, count(*) AS n_input_rows FROM events"""


ORACLES["node_text"] = STMTS + """
SELECT project_id, path, stmt_ord, value, true AS valid FROM stmts"""

ORACLES["comments"] = f"""
WITH {TP}, {LI}
SELECT project_id, path, CAST(1 AS BIGINT) AS comment_ord, '// part ' || {v('pk')} AS value FROM tp
UNION ALL
SELECT project_id, path, 1, '/* order ' || {v('k')} || ' */' FROM ord"""

ORACLES["comments_html"] = """
WITH c AS (SELECT page_id, url, regexp_extract_all(html, '(?s)<!--.*?-->') AS arr FROM pages)
SELECT page_id AS project_id, url AS path, CAST(i AS BIGINT) AS comment_ord, arr[i] AS value
FROM c, range(1, len(arr) + 1) t(i)"""

ORACLES["strip_comments"] = f"""
WITH {TP}, {LI}
SELECT project_id, path, regexp_replace(value, '^// part [0-9]+', '') || {NL} AS content FROM tp
UNION ALL
SELECT project_id, path, imp_text || {NL} || {NL} || exp_line || {NL} || fn_value || {NL} FROM ordv"""


def _merged_variant(sections: str, sort_path: str, extra: str = "") -> str:
    return STMTS + f""",
base AS (
  SELECT s.project_id, s.path, s.file_ord, s.stmt_ord, s.kind, s.value AS v,
         {sections} AS section, {sort_path} AS sort_path
  FROM stmts s
  WHERE NOT (s.kind = 'ImportDecl'
             AND TRY_CAST(regexp_extract(s.value, 'Part([0-9]+)', 1) AS BIGINT) % 16 = s.project_id)
  {extra}),
mo AS (
  SELECT *, row_number() OVER (PARTITION BY project_id
            ORDER BY section, sort_path NULLS LAST, file_ord, stmt_ord) AS out_ord,
         CASE WHEN kind = 'ExportDecl' THEN {NL} ELSE '' END || v
           || CASE WHEN kind = 'ExportDecl' THEN {NL} ELSE '' END || {NL} AS value
  FROM base)"""


_IMP_SP = "CASE WHEN s.kind = 'ImportDecl' THEN regexp_extract(s.value, 'from ''([^'']*)''', 1) END"

ORACLES["sort_imports"] = _merged_variant(
    "CASE WHEN s.kind = 'ImportDecl' THEN 0 ELSE 2 END", _IMP_SP) + """
SELECT project_id, out_ord, CAST(section AS BIGINT) AS section, path, stmt_ord, kind FROM mo"""

ORACLES["exports_first"] = _merged_variant(
    "CASE WHEN s.kind = 'ExportDecl' THEN 1 ELSE 2 END", "CAST(NULL AS VARCHAR)") + """
SELECT project_id, out_ord, CAST(section AS BIGINT) AS section, path, stmt_ord, kind FROM mo"""

# without dedupe the inlined copies of resolved imports stay (at the import's place)
ORACLES["dedupe_written"] = _merged_variant(
    "CASE WHEN s.kind = 'ImportDecl' THEN 0 WHEN s.kind = 'ExportDecl' THEN 1 ELSE 2 END", _IMP_SP,
    """UNION ALL
  SELECT l.project_id, l.path, l.file_ord, l.rn, 'ExportDecl', t.value, 1, NULL
  FROM lim l JOIN tp t ON t.pk = l.pk WHERE l.pk % 16 = l.k % 16""") + """
SELECT project_id, out_ord, CAST(section AS BIGINT) AS section, path, stmt_ord, kind, value FROM mo"""

CUSTS = """
cs AS (SELECT DISTINCT o_custkey AS c, o_custkey % 16 AS project_id,
              'src/customer/' || CAST(o_custkey AS VARCHAR) || '.ts' AS path FROM orders)"""

ORACLES["drop_unknown"] = f"""
WITH {CUSTS}
SELECT project_id, path, CAST(i AS BIGINT) AS stmt_ord,
       CASE WHEN i <= 2 THEN 'ImportDecl' WHEN i = 3 THEN 'Interface' ELSE 'ExportDecl' END AS kind
FROM cs, range(1, 6) t(i)"""

ORACLES["spacing"] = STMTS + f"""
SELECT project_id, path, stmt_ord, kind,
       CASE WHEN kind = 'ExportDecl' THEN {NL} ELSE '' END || value
         || CASE WHEN kind = 'ExportDecl' THEN {NL} ELSE '' END || {NL} AS value
FROM stmts"""

ORACLES["comment_carry"] = MERGED + """
SELECT project_id, out_ord,
       CASE WHEN path LIKE 'src/part/%' THEN '// part ' || regexp_extract(path, '([0-9]+)', 1)
            ELSE '/* order ' || regexp_extract(path, '([0-9]+)', 1) || ' */' END AS comment
FROM mo WHERE kind = 'ExportDecl'"""

ORACLES["merge_text"] = MERGED + """
SELECT project_id, count(*) AS n_rows, CAST(sum(strlen(value)) AS BIGINT) AS n_bytes,
       md5(string_agg(value, '' ORDER BY out_ord)) AS md5, false AS too_large
FROM mo GROUP BY project_id"""

_CHUNKS = """
SELECT project_id, c AS chunk, octet_length(p)::BIGINT AS n_bytes, md5(p) AS md5
FROM (SELECT project_id, c, array_slice(t, c * 65536 + 1, (c + 1) * 65536) AS p
      FROM (SELECT project_id, t, unnest(range(0, (octet_length(t) + 65535) // 65536)) AS c FROM texts))"""

ORACLES["merge_chunks"] = MERGED + """,
texts AS (SELECT project_id, encode(string_agg(value, '' ORDER BY out_ord)) AS t FROM mo GROUP BY project_id)""" + _CHUNKS

ORACLES["concat_chunks"] = """
WITH texts AS (SELECT source AS project_id, encode(string_agg(text || chr(10), '' ORDER BY doc_id)) AS t FROM documents GROUP BY source)""" + _CHUNKS

ORACLES["write_merged"] = MERGED + """
SELECT project_id, md5(string_agg(value, '' ORDER BY out_ord)) AS md5,
       CAST(sum(strlen(value)) AS BIGINT) AS n_bytes
FROM mo GROUP BY project_id"""

ORACLES["index_export_order"] = f"""
WITH {EO},
fi AS (SELECT project_id, pk, min(rn) AS index_ord FROM eo GROUP BY project_id, pk)
SELECT project_id, 'Part' || {v('pk')} AS export_name, index_ord,
       row_number() OVER (PARTITION BY project_id ORDER BY index_ord, pk) AS out_ord
FROM fi"""

ORACLES["scan_corpus"] = f"""
WITH {TP}
SELECT project_id, count(*) AS n_files, CAST(sum(strlen(value) + 2) AS BIGINT) AS n_bytes
FROM tp GROUP BY project_id"""

ORACLES["position_order"] = """
WITH p AS (SELECT DISTINCT l_orderkey AS "row", CAST(l_linenumber AS BIGINT) AS col FROM lineitem)
SELECT "row", col, row_number() OVER (ORDER BY "row", col) AS pos FROM p"""

ORACLES["import_scope"] = f"""
WITH {CUSTS}
SELECT l_orderkey % 16 AS project_id, 'internal' AS scope, count(*) AS n FROM lineitem GROUP BY 1
UNION ALL
SELECT project_id, 'builtin', count(*) FROM cs GROUP BY 1
UNION ALL
SELECT project_id, 'external', count(*) FROM cs GROUP BY 1"""

ORACLES["normalize_import_path"] = f"""
WITH {LI}
SELECT project_id, path, rn AS stmt_ord, '../part/' || {v('pk')} AS source_path,
       'src/part/' || {v('pk')} AS resolved_path
FROM lim"""

ORACLES["redundant_imports"] = f"""
WITH {LI}
SELECT project_id, path, 'Part' || {v('pk')} AS imported_name, '../part/' || {v('pk')} AS source_path,
       count(*) AS n
FROM lim GROUP BY project_id, path, pk HAVING count(*) > 1"""

ORACLES["unused_imports"] = f"""
WITH {CUSTS}
SELECT project_id, path, 'readFile' AS imported_name, 'readFile' AS local_name, 'fs' AS source_path FROM cs
UNION ALL
SELECT project_id, path, '*', 'lodash', 'lodash' FROM cs"""

ORACLES["dead_decls"] = f"""
WITH {LI}, {CUSTS}
SELECT project_id, path, n + 2 AS stmt_ord, 'helper' || {v('k')} AS name FROM ord
UNION ALL
SELECT project_id, path, CAST(6 AS BIGINT), 'Status' || {v('c')} FROM cs"""

ORACLES["cross_module_refs"] = f"""
WITH {LI}
SELECT DISTINCT project_id, path AS src_path, 'order' || {v('k')} AS src,
       'src/part/' || {v('pk')} || '.ts' AS dst_path, 'Part' || {v('pk')} AS dst
FROM lim WHERE pk % 16 = k % 16"""

ORACLES["located_refs"] = f"""
WITH {CUST}
SELECT project_id, path AS src_path, CAST(4 AS BIGINT) AS src_stmt_ord, 'Account' || {v('c')} AS src,
       path AS dst_path, CAST(3 AS BIGINT) AS dst_stmt_ord, 'Base' || {v('c')} AS dst FROM cu
UNION ALL
SELECT project_id, path, 5, grp, path, 3, 'Base' || {v('c')} FROM cu"""

ORACLES["usage_position_shared"] = f"""
WITH {CUST}
SELECT project_id, path, 'Base' || {v('c')} AS name, path AS first_use_path, CAST(4 AS BIGINT) AS first_use_stmt_ord
FROM cu"""

ORACLES["usage_position"] = f"""
WITH {LI}
SELECT project_id, 'Part' || {v('pk')} AS name, 'src/order/' || {v('min(k)')} || '.ts' AS first_use_path,
       arg_min(n, k) + 1 AS first_use_stmt_ord
FROM lim WHERE pk % 16 = k % 16 GROUP BY project_id, pk
UNION ALL
SELECT project_id, 'order' || {v('k')}, path, n + 2 FROM ord"""

ORACLES["namespace_merge"] = f"""
WITH {CUST}
SELECT project_id, grp AS namespace, 'Config' AS member, count(*) AS n_files, count(*) > 1 AS conflict
FROM cu GROUP BY project_id, grp
UNION ALL
SELECT cu.project_id, cu.grp, 'Order' || {v('co.o')}, 1, false FROM co JOIN cu ON co.c = cu.c"""

ORACLES["line_provenance"] = MERGED + """
SELECT m.project_id, m.out_ord, CAST(i AS BIGINT) AS line_in_stmt, m.path AS src_path, s.start_row + i AS src_row
FROM mo m JOIN stmts s ON s.path = m.path AND s.stmt_ord = m.stmt_ord AND s.project_id = m.project_id,
     range(0, len(string_split(s.value, chr(10)))) t(i)"""


# ------------------------------------------------- dense code, re-exports

SHAPES = f"""
WITH p AS (SELECT p_partkey AS k, p_size % 7 + 1 AS d FROM part),
v AS (SELECT k, unnest([
    {{'s': 1, 'row': 0, 'v': 'class C# {{}}', 't': 'class_declaration', 'kind': 'Class', 'name': 'C#', 'after': NULL}},
    {{'s': 2, 'row': 0, 'v': 'class E# extends C# {{}}', 't': 'class_declaration', 'kind': 'Class', 'name': 'E#', 'after': 1}},
    {{'s': 3, 'row': 1, 'v': 'export const a# = 1, b# = new C#();', 't': 'export_statement', 'kind': 'ExportDecl', 'name': 'a#', 'after': NULL}},
    {{'s': 4, 'row': 1, 'v': 'let {{ p#, q: r# = {{ z: 2 }}, ...s# }} = a#;', 't': 'lexical_declaration', 'kind': 'Unknown', 'name': NULL, 'after': 3}},
    {{'s': 5, 'row': 2, 'v': 'const t# = `x${{ b# ? `}}{{ ${{ p# }} {{` : ''`'' }}y` + ' || repeat('`${{', d) || '1' || repeat('}}`', d) || ';', 't': 'lexical_declaration', 'kind': 'Unknown', 'name': 't#', 'after': NULL}},
    {{'s': 6, 'row': 2, 'v': 'export function f#() {{}}', 't': 'export_statement', 'kind': 'ExportDecl', 'name': 'f#', 'after': 5}},
    {{'s': 7, 'row': 2, 'v': 'f#();', 't': 'expression_statement', 'kind': 'Unknown', 'name': NULL, 'after': 6}},
    {{'s': 8, 'row': 3, 'v': 'export namespace N# {{ export const m# = 1, n# = 2; export class K# {{ go() {{}} }} }}', 't': 'export_statement', 'kind': 'ExportDecl', 'name': 'N#', 'after': NULL}},
    {{'s': 9, 'row': 4, 'v': 'const z# = 2; // tail #', 't': 'lexical_declaration', 'kind': 'Unknown', 'name': 'z#', 'after': NULL}}]) AS x FROM p),
st AS (SELECT k % 16 AS project_id, 'src/shape/' || k || '.ts' AS path, k AS file_ord, k, x.s AS stmt_ord, x.kind AS kind, x.t AS raw_type,
    replace(x.name, '#', k::VARCHAR) AS name, x.t = 'export_statement' AS is_export, replace(x.v, '#', k::VARCHAR) AS value,
    x.row::BIGINT AS r FROM v),
pos AS (SELECT *, coalesce(sum(length(value) + 1) OVER (PARTITION BY k ORDER BY stmt_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM st)
"""

ORACLES["statements_dense"] = SHAPES + """
SELECT project_id, path, file_ord, stmt_ord::BIGINT AS stmt_ord, kind, raw_type, name, is_export, value, b AS start_byte, b + length(value) AS end_byte,
    r AS start_row, b - min(b) OVER (PARTITION BY k, r) AS start_col, r AS end_row, b - min(b) OVER (PARTITION BY k, r) + length(value) AS end_col FROM pos"""

_SHAPE_NAMES = """names AS (SELECT k, unnest([
    {'s': 1, 'n': 'C', 'e': false, 'w': 'class'}, {'s': 2, 'n': 'E', 'e': false, 'w': 'class'}, {'s': 3, 'n': 'a', 'e': true, 'w': 'const'},
    {'s': 3, 'n': 'b', 'e': true, 'w': 'const'}, {'s': 4, 'n': 'p', 'e': false, 'w': 'let'}, {'s': 4, 'n': 'r', 'e': false, 'w': 'let'},
    {'s': 4, 'n': 's', 'e': false, 'w': 'let'}, {'s': 5, 'n': 't', 'e': false, 'w': 'const'}, {'s': 6, 'n': 'f', 'e': true, 'w': 'function'},
    {'s': 8, 'n': 'N', 'e': true, 'w': 'namespace'}, {'s': 9, 'n': 'z', 'e': false, 'w': 'const'}]) AS x FROM p)"""

ORACLES["declarations_dense"] = SHAPES + "," + _SHAPE_NAMES + """
SELECT k % 16 AS project_id, 'src/shape/' || k || '.ts' AS path, x.s::BIGINT AS stmt_ord, x.n || k AS name, x.e AS is_export, x.w AS decl_keyword FROM names"""

ORACLES["exports_dense"] = SHAPES + "," + _SHAPE_NAMES + """
SELECT project_id, path, file_ord, stmt_ord::BIGINT AS stmt_ord, x.n || names.k AS export_name, kind, value, false AS nested
FROM names JOIN st ON st.k = names.k AND x.s = stmt_ord WHERE x.e
UNION ALL SELECT project_id, path, file_ord, 8, n || k, 'ExportDecl', replace(m, '#', k::VARCHAR), true
FROM st, (VALUES ('m', 'export const m# = 1, n# = 2;'), ('n', 'export const m# = 1, n# = 2;'), ('K', 'export class K# { go() {} }')) AS t(n, m) WHERE stmt_ord = 8"""

ORACLES["ref_edges_dense"] = """
SELECT p_partkey % 16 AS project_id, a || p_partkey AS src, b || p_partkey AS dst, 'uses' AS edge_kind
FROM part, (VALUES ('E', 'C'), ('a', 'C'), ('b', 'C'), ('p', 'a'), ('r', 'a'), ('s', 'a')) AS t(a, b)"""

ORACLES["trailing_comments"] = """
SELECT p_partkey % 16 AS project_id, 'src/shape/' || p_partkey || '.ts' AS path, 9::BIGINT AS stmt_ord, 0::BIGINT AS comment_ord, '// tail ' || p_partkey AS comment FROM part"""

BARRELS = """
WITH p AS (SELECT p_partkey AS k, p_partkey % 16 AS project_id, p_partkey // 128 AS g, 'src/part/' || p_partkey || '.ts' AS dst_path,
    CASE WHEN p_partkey // 16 % 2 = 1 THEN 'Alias' ELSE 'Part' END || p_partkey AS name FROM part)
"""

ORACLES["reexports"] = BARRELS + """
SELECT project_id, 'src/b1/' || g || '.ts' AS path, name, dst_path, 1::BIGINT AS dst_stmt_ord, 'Part' || k AS dst FROM p
UNION ALL SELECT project_id, 'src/entry.ts', name, dst_path, 1, 'Part' || k FROM p
UNION ALL SELECT DISTINCT project_id, 'src/loop/' || g || x || '.ts', 'Loop' || g, NULL, NULL, NULL FROM p, (VALUES ('x'), ('y')) AS t(x)"""

ORACLES["located_refs_barrels"] = BARRELS + """
SELECT project_id, 'src/use/' || k || '.ts' AS src_path, 2::BIGINT AS src_stmt_ord, 'use' || k AS src, dst_path, 1::BIGINT AS dst_stmt_ord, 'Part' || k AS dst FROM p"""

ORACLES["affected_stream"] = """
WITH p AS (SELECT p_partkey AS k, p_partkey % 16 AS project_id, p_size AS z FROM part),
f AS (SELECT CASE WHEN z >= 45 THEN 1 WHEN z >= 40 THEN 2 WHEN z = 1 THEN 3 ELSE 5 END AS version, k, project_id FROM p WHERE z >= 40 OR z IN (1, 2)),
o AS (SELECT DISTINCT version, project_id, 'src/order/' || l_orderkey || '.ts' AS path FROM f JOIN lineitem ON l_partkey = k AND l_orderkey % 16 = project_id WHERE version <> 2)
SELECT version::BIGINT AS version, project_id, 'src/part/' || k || '.ts' AS path, 0::BIGINT AS hop FROM f
UNION ALL SELECT 4, project_id, 'src/extra/' || k || '.ts', 0 FROM p WHERE z = 2
UNION ALL SELECT 5, project_id, 'src/extra/' || k || '.ts', 1 FROM p WHERE z = 2
UNION ALL SELECT version, project_id, path, 1 FROM o"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
