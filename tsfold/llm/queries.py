"""Registered queries of this subpackage and their DuckDB oracles.

Each query applies its operator to the whole table. Vocabulary files are
parameters of the operators; the queries name them through ``public_tokenizers``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsfold.llm import ann, chat, dac, decontaminate, near_dup, phrases, pii, repeats, spm, structure, token_count, toxicity, warc
from tsfold.llm.common import table
from tsfold.session import scratch_path

END_ID = 2
TOKEN_LIMIT = 2048
TOXIC = 0.7


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.round_trip(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_count.count_tokens(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    dac.write_token_ids(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), path, END_ID)
    return dac.read_documents(spark, path)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_records(warc.derive(warc.responses(table(spark, sf_dir, "pages"))), path)
    return warc.read_records(spark, path)


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op12_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return structure.report(structure.damage(rows), rows)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii, op2_decontamination, op3_toxicity, op4_sentencepiece, op5_token_count,
                            op6_nearest, op7_token_ids, op8_near_duplicates, op9_chat, op10_warc, op11_repeats,
                            op12_structure, op13_phrases)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOWER.format("coalesce(text, '')"))
_PLAIN_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')".format(_LOWER.format("coalesce(text, '')"))



def _add(cost: str | int, letters: str, state: str) -> str:
    """A state's value (cost in 8 digits, then letters) with cost and letters added; null stays null."""
    return f"(lpad(CAST(CAST(left({state}, 8) AS BIGINT) + {cost} AS VARCHAR), 8, '0') || substr({state}, 9) || '{letters}')"


def _kept(state: str) -> str:
    return f"CASE WHEN fault IN ('', 't') THEN {_add("CASE fault WHEN 't' THEN 5 ELSE 0 END", 'K', state)} END"


def _rerole(state: str) -> str:
    return f"CASE WHEN fault IN ('', 't') THEN {_add("CASE fault WHEN 't' THEN 6 ELSE 1 END", 'R', state)} END"


ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
occ AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM occ JOIN win USING (n, g)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_near_duplicates": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN_WORDS} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM inter JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT a, a AS b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id, coalesce(comp.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.a = d.doc_id""",
    "op11_repeats": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT row_id, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT row_id, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
first AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
hit AS (SELECT row_id, i FROM win JOIN first USING (g) WHERE doc_id > m),
gone AS (SELECT DISTINCT row_id, unnest(range(i, i + 50)) AS p FROM hit),
kept AS (SELECT row_id, p, x FROM (SELECT row_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN gone USING (row_id, p)),
joined AS (SELECT row_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM kept GROUP BY row_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN joined USING (row_id)""",
    "op13_phrases": f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
inner_part AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
               FROM (SELECT lang, k, w, a, unnest(range(1, k + 1)) AS i FROM cand), (SELECT unnest(range(2, 5)) AS m)
               WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN inner_part i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
cut AS (SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:k], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS c FROM kept)),
scored AS (SELECT cut.lang, cut.phrase, a, c, u.f AS l, v.f AS r, n, ((1000::HUGEINT * a * n) // (u.f::HUGEINT * v.f))::BIGINT AS score
           FROM cut JOIN n USING (lang) JOIN f u ON u.lang = cut.lang AND u.phrase = x JOIN f v ON v.lang = cut.lang AND v.phrase = y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000""",
    "op12_structure": rf"""
WITH RECURSIVE
tab AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v FROM range(256) r(i))),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crc AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1]))) % 20 AS what FROM src, tab),
hurt AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN what = 1 THEN '' WHEN what = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN what = 3 THEN [1, 2] ELSE [1] END) AS copy FROM crc WHERE what <> 0),
nth AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(role || ':' || text), copy) AS k FROM hurt),
bare AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
  left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM nth),
flt AS (SELECT *, CASE WHEN b = '' THEN 'b' WHEN again THEN 'd' WHEN right(b, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM bare),
facts AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM flt GROUP BY conv_id),
-- cost (8 digits) and letters of the best way to each state: nothing yet, after system, user, assistant
best(conv_id, n, k, s0, s1, s2, s3) AS (
  SELECT conv_id, n, 0::BIGINT, '00000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM facts
  UNION ALL
  SELECT conv_id, n, k,
    {_add(2, 'D', 's0')},
    least({_add(2, 'D', 's1')}, CASE WHEN i = 's' THEN {_kept('s0')} END),
    least({_add(2, 'D', 's2')}, CASE WHEN i = 'u' THEN least({_kept('s0')}, {_kept('s1')}, {_kept('s3')}) END, {_rerole('s0')}, {_rerole('s1')}, {_rerole('s3')}),
    least({_add(2, 'D', 's3')}, CASE WHEN i = 'a' THEN {_kept('s2')} END, {_rerole('s2')})
  FROM (SELECT best.conv_id, best.n, f.k, f.i, f.fault, s0, s1, least(s2, {_add(5, 'I', 's0')}, {_add(5, 'I', 's1')}, {_add(5, 'I', 's3')}) AS s2,
          least(s3, {_add(10, 'II', 's0')}, {_add(10, 'II', 's1')}, {_add(5, 'I', 's2')}) AS s3
        FROM best JOIN flt f ON f.conv_id IS NOT DISTINCT FROM best.conv_id AND f.k = best.k + 1)),
done AS (SELECT conv_id, least(s0, {_add(5, 'I', 's2')}, s3, {_add(10, 'II', 's1')}) AS v FROM best WHERE k = n),
letters AS (SELECT conv_id, CAST(left(v, 8) AS BIGINT) AS cost, substr(v, 9) AS audit FROM done),
walk AS (SELECT conv_id, p, e, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS k, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS j
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS e, unnest(range(1, length(audit) + 1)) AS p FROM letters WHERE audit <> '')),
made AS (SELECT w.conv_id, p, j, CASE WHEN e = 'K' THEN f.role END AS own, CASE WHEN e = 'I' THEN '' ELSE f.text END AS text
  FROM walk w LEFT JOIN flt f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.k = w.k WHERE e <> 'D'),
lead AS (SELECT conv_id, bool_or(j = 1 AND left(own, 1) = 's') AS sys FROM made GROUP BY conv_id),
said AS (SELECT m.conv_id, string_agg(coalesce(own, CASE WHEN (j - sys::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY p) AS t
  FROM made m JOIN lead l ON l.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY m.conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN letters l ON l.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM a.conv_id""",
}
