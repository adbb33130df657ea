"""The training-data operators against brute force, round trips and held-out labels, on small tables that hold
nulls, empty and long texts, repeated rows, ties and columns whose names clash with the operators' own."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tsfold.llm import ann, chat, dac, decontaminate, near_dup, pii, queries, spm, token_count, toxicity, units, warc
from tsfold.llm.common import table

SF = "/root/testdata/sf0.001"
LONG = "the quick brown fox jumps over the lazy dog again, " * 4000
TEXTS = [None, "", "   ", "mail a.b+c@x-y.example.org or +1 (244) 555-4688.", "card 4111 1111 1111 1111 ip 10.0.0.256 1.2.3.4.5",
         "password=abcdef12345 https://u.example.com/p?q=1).", "naïve ▁ text\n\twith odd　space <|endoftext|> x.", LONG, LONG, "one two three"]


def tool(name):
    return queries._vocabulary(name)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "n", -1) for i, t in enumerate(TEXTS)] + [(None, "no id here at all", "n", 0), (3, TEXTS[3], "n", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, id int")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for df in (pii.find_pii(none), token_count.count_tokens(none, tool("word_bpe_49k.json")), spm.encode(none, tool("piece_bpe_32k.model")),
               near_dup.near_duplicates(none), decontaminate.find_contamination(none, none, item_col="doc_id"),
               toxicity.score(none, toxicity.Model(np.zeros(0, int), np.zeros(0), 0.0))):
        assert df.count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(vectors).count() == 0
    assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def _brute_pii(x):
    found = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                           r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, x):
            n = [int(c) for c in m.group() if c in "0123456789"][::-1]
            luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(n)) % 10 == 0
            if (k == 0 or k == 1 and all(int(q) <= 255 for q in m.group().split(".")) or k == 2 and 13 <= len(n) <= 19 and luhn
                    or k == 3 and 9 <= len(n) <= 15):
                found.append(f"{pii.BASE[k]}:{m.start()}:{m.end()}")
    return found


def test_pii_base_spans_equal_regular_expressions(spark, docs):
    big = table(spark, SF, "documents").select("doc_id", "text")
    for source in (docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), big):
        text = {r.doc_id: r.text or "" for r in source.collect()}
        for i, r in by_id(pii.find_pii(source)).items():
            base = _brute_pii(text[i])
            assert [s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE] == base
            assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k + ":") for s in base) for k in pii.BASE)
    spans = by_id(pii.find_pii(docs))[5].spans
    assert spans == "url:21:48,secret:9:20"
    masked = by_id(pii.mask(docs))
    assert masked[0].text is None and masked[4].text == "card <card> ip 10.0.0.256 <ip>.5" and masked[4].id == -1


def test_tokens_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tool("word_bpe_49k.json"))
    got = token_count.count_tokens(docs, tool("word_bpe_49k.json"), slice_bytes=3000).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = "no id here at all" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(tok.encode(text, add_special_tokens=False).ids))


def test_long_texts_are_cut_at_safe_boundaries():
    parts = units.split_long(LONG.encode(), 500, units.cuts_before_space)
    assert b"".join(parts) == LONG.encode() and max(map(len, parts)) < 520
    assert units.split_long(b"x" * 5000, 500, units.cuts_before_space) == [b"x" * 5000]


def test_sentencepiece_equals_the_library_and_decodes(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tool("piece_bpe_32k.model"))
    encoded = spm.encode(docs, tool("piece_bpe_32k.model"))
    for r in encoded.collect():
        assert r.ids == sp.encode("no id here at all" if r.doc_id is None else TEXTS[r.doc_id] or "")
    back = spm.decode(encoded, tool("piece_bpe_32k.model")).collect()
    assert all(r.text == (TEXTS[r.doc_id] or "").replace("▁", " ") for r in back if r.doc_id is not None)


def test_codes_are_directly_addressable():
    ids = np.random.default_rng(1).integers(0, 1 << 20, 5000).astype(np.uint32)
    ids[::7] %= 200
    reader = dac.Reader(dac.encode(ids))
    places = np.random.default_rng(2).permutation(5000)
    assert (reader.at(places) == ids[places]).all()
    assert all((reader.range(a, b) == ids[a:b]).all() for a, b in ((0, 5000), (3, 3), (511, 513), (1023, 4097)))


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tool("byte_bpe_50k.json"))
    source = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    dac.write_token_ids(source, tool("byte_bpe_50k.json"), str(tmp_path / "ids"), 2, segment_ids=100)
    start = 0
    for r in dac.read_documents(spark, str(tmp_path / "ids")).orderBy("doc_id").collect():
        ids = [*tok.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def _oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_oracles(spark, name):
    _oracle(spark, name)


def test_contamination_edge_cases(spark, docs):
    items = spark.createDataFrame([("b", "THE quick brown fox jumps over the lazy dog again the"), ("a", "One, two"), ("c", None), (None, "lazy dog"), ("a", "One, two")],
                                  "item_id string, text string")
    got = by_id(decontaminate.find_contamination(docs, items, block_bytes=8))
    assert (got[9].n_words, got[9].n_hit, got[9].n_items) == (3, 2, 1) and got[9].items_sha256 == hashlib.sha256(b"a").hexdigest()
    assert got[7].n_hit == got[7].n_words == 40000 and not got[0].contaminated
    assert {r.doc_id for r in decontaminate.remove_contaminated(docs, items).collect()} == {None, 0, 1, 2, 3, 4, 5, 6}
    best = {r.item_id: r for r in decontaminate.longest_matches(docs, items).collect()}
    assert (best["b"].n_words, best["b"].doc_id, best["b"].doc_start) == (11, 7, 0) and best["a"].n_words == 2


def test_near_duplicates_by_brute_force_with_branching(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):  # one large group of near copies of every similarity, and strangers that share a passage
        words = base.copy()
        for k in rng.choice(120, rng.integers(0, 14), replace=False):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:40] + [f"y{i}_{k}" for k in range(60)])) for i in range(60)]
    rows += [(2000, None), (2001, " \t "), (2002, "a b"), (2003, "A  b"), (None, "A b"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: set(s.tolist()) for i, s in zip([r[0] for r in rows], near_dup.shingle_sets([(r[1] or "").encode() for r in rows])) if i is not None}
    label = {i: i for i in sets}
    for _ in range(len(sets)):
        old = dict(label)
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = min(label[a], label[b])
        if old == label:
            break
    got = near_dup.near_duplicates(docs, small=20).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == label
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(2002, False)]


def test_toxicity_learns_and_keeps_clean_rows(spark):
    rng = np.random.default_rng(4)
    words = ["the", "of", "and", "river", "stone", "light", "paper", "green"]
    rows, labels = [], []
    for i in range(600):
        text = list(rng.choice(words, 30))
        if bad := i % 6 == 0:
            text[rng.integers(30)] = "vile" if i % 12 else "vilest"
        rows.append((i, " ".join(text)))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    rows += [(None, "river"), (9000, None), (9001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame([*labels, (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marked)
    got = by_id(toxicity.score(docs, model))
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert all((got[i].score >= 0.7) == (i % 6 == 0) for i in range(600))
    assert toxicity.keep_clean(docs, model).count() == len(rows) - 100
    assert toxicity.train(docs, marked.limit(0)).scorer()(["x"])[0] < 1e-6


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 12)).astype(np.float32)
    x[300:500] = x[299]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (800, [0.0] * 12), (900, [float("nan")] + [1.0] * 11), (1000, [1.0]), (None, [1.0] * 12)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), part=64).toPandas()
    x = x.astype(np.float64)
    hits = 0
    for q in range(0, 700, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 10 and (mine.score.to_numpy() == d[mine.vec_id.to_numpy()]).all()
        hits += len(set(np.lexsort((np.arange(700), d))[:10]) & set(mine.vec_id))
    assert set(got.query_id) == set(range(0, 700, 100)) and hits >= 63
    assert got[got.query_id == 300].sort_values("rank").vec_id.tolist() == [299, *range(301, 310)]


def _least(roles):
    """Cheapest repair by trying all actions."""
    def go(k, s):
        if k == len(roles):
            return chat.END[s][0]
        return min(cost + go(k + 1, x) for a, x, cost, _, _ in chat.MOVES[roles[k]] if a == s)
    return go(0, chat.START)


def test_role_repair_is_cheapest_and_legal(spark):
    rng = np.random.default_rng(6)
    names = [*chat.ROLES, "tool", None]
    rows, want = [], {}
    for c in range(40):
        roles = [names[k] for k in rng.integers(0, 5, rng.integers(1, 6))]
        rows += [(c, t, r, None if t == 1 else f"t{t}", 7) for t, r in enumerate(roles)]
        want[c] = _least([chat.ROLES.index(r) if r in chat.ROLES else -1 for r in roles])
    docs = spark.createDataFrame([*rows, rows[0], (None, None, None, None, 0)], "conv_id long, turn long, role string, text string, cost int")
    for chunk in (2, 1000):  # cut into chunks or not: the same costs
        out = chat.repair(docs, chunk=chunk)
        assert out.count() == len(rows) + 1
        for r in chat.conversations(out).filter("conv_id IS NOT NULL").collect():
            assert r.cost == want[r.conv_id]
            assert re.fullmatch(r"(S)?(UA)+", "".join({"system": "S", "user": "U", "assistant": "A"}[x] for x in re.findall(r"<\|im_start\|>(\w+)\n", r.text)))
            assert r.text.count("<|im_end|>") == r.text.count("<|im_start|>")


def test_warc_derivatives(spark, tmp_path):
    page = '<html lang="EN"><head><title>A &amp; B</title></head><body><script>x()</script><p>One<br>two &lt;3</p><a href="/l">l</a>\r\nend</body></html>'
    pages = spark.createDataFrame([(1, "http://a.example/\n", page, 0), (2, None, None, 0), (1, "http://a.example/\n", page, 0)], "page_id long, url string, html string, record int")
    sources = {r.page_id: warc.parse(r.record) for r in warc.responses(pages).collect()}
    warc.write_records(warc.derive(warc.responses(pages)), str(tmp_path / "w"))
    got = warc.read_records(spark, str(tmp_path / "w")).collect()
    assert len(got) == 6 and all(r.digest_ok and r.content_length == len(r.block.encode()) for r in got)
    assert {r.refers_to for r in got} == {h["WARC-Record-ID"] for h, _ in sources.values()}
    text = next(r for r in got if r.warc_type == "conversion" and r.target_uri)
    assert text.block == "One\ntwo <3\nl end"
    meta = next(r for r in got if r.warc_type == "metadata" and r.target_uri)
    assert "title: A & B\nlanguage: en\nhttp-status: HTTP/1.1 200 OK\n" in meta.block and "outlink: /l\n" in meta.block
    assert f"source-payload-digest: {sources[1][0]['WARC-Payload-Digest']}\n" in meta.block and "source-digest-ok: true" in meta.block


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.count()
        assert 0 < rows <= n
        if name != "sentencepiece":
            assert out.schema == docs.schema
            docs, n = out, rows
    assert out.filter(F.size("ids") != F.col("n_tokens")).count() == 0
