"""Cases in which an operator once did less than its whole job."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from tsfold.llm import near_dup, pii, toxicity, warc


def test_near_duplicates_adds_trees_for_deep_nodes(spark):
    assert [near_dup.trees_for(d) for d in (0, 2, 5, 10, 15)] == [12, 12, 18, 28, 38]
    assert all(near_dup.apart(d) ** near_dup.trees_for(d) <= near_dup.MISS for d in range(60))
    rng = np.random.default_rng(8)
    rows = []
    for i in range(40):  # 40 pairs of similarity 0.77 from one template, 0.53 or less between pairs
        places = rng.permutation(np.arange(0, 200, 5) + 2)
        words = [f"w{k}" for k in range(200)]
        for k in places[:6]:
            words[k] = f"x{i}_{k}"
        rows.append((2 * i, " ".join(words)))
        for k in places[6:11]:
            words[k] = f"y{i}_{k}"
        rows.append((2 * i + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(docs, trees=1, small=40).collect()  # one tree loses a quarter of the pairs
    assert {r.doc_id: r.component_id for r in got} == {i: i // 2 * 2 for i in range(80)}


def test_pii_finds_whole_account_numbers_and_secrets():
    anchors = pii.automaton()

    def found(text):
        return [text[a:b] for k, a, b in pii.find_spans(text, anchors) if pii.KINDS[k] in ("iban", "secret")]

    de, gb = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    assert found(f"IBAN {de} BIC COBADEFF") == [de]
    assert found("IBAN DE89370400440532013000 2024 paid") == ["DE89370400440532013000"]
    assert found(f"IBAN {gb}, {de}; {'x ' * 60}{gb} end IBAN{gb}") == [gb, de, gb, gb]
    assert found("DE89370400440532013001 XDE89370400440532013000 DE893704004405320130001") == []
    assert found("password=abcdef1!secondhalf on") == ["abcdef1!secondhalf"]
    assert found("password=p@ssw0rd!x") == ["p@ssw0rd!x"]
    assert found('{"password": "two words", \'token\'   :   \'it\\\'s me\'}') == ["two words", "it\\'s me"]
    assert found('{\\"secret\\":\\"abcdef12\\",x') == ["abcdef12"]
    assert found('password="abc", user="bob", "token": ""') == []
    assert found('password="neverclosed on') == ["neverclosed"]
    assert found("password=token=" * 20000) == [("password=token=" * 20000)[9:]]


def test_warc_keeps_the_text_of_pages_with_an_open_head():
    assert warc.plain_text("<html><head><title>x</title><body><p>all of the text</p>") == "all of the text"
    assert warc.plain_text("<head><meta a=1><script>'<body>'</script><title>x</title><h1>One</h1>two") == "One\ntwo"
    assert warc.plain_text("<head><title>x</title>bare text") == "bare text"
    assert warc.plain_text("<head><script>'</head>'</script><title>x</title></head><body>a<noscript>b</noscript>c") == "a c"
    assert warc.plain_text("<body>a<noscript>b<p>c</p><template>d<div>e</div></template>f") == "a\nc\nf"
    assert warc.plain_text("<body>a<!-- b <p>c") == "a" == warc.plain_text("<body>a<script>b <p>c")


def test_each_text_of_a_repeated_id_is_judged_alone(spark):
    a, b = "one two three four five six", "nothing like it at all here"
    schema = "doc_id long, text string, extra int"

    def kept(rows):
        got = near_dup.keep_one(spark.createDataFrame([(i, t, 1) for i, t in rows], schema))
        assert got.schema.simpleString() == "struct<doc_id:bigint,text:string,extra:int>"
        return sorted((r.doc_id or -1, r.text or "") for r in got.collect())

    assert kept([(3, a), (5, a), (5, b), (9, b)]) == [(3, a), (5, b)]
    assert kept([(5, a), (5, b), (7, a), (5, b)]) == [(5, b), (5, a)]
    assert kept([(None, a), (5, a), (None, b), (1, None), (2, "")]) == [(-1, b), (1, ""), (2, ""), (5, a)]
    assert kept([]) == []
    near = a + " seven eight nine ten " + b
    rows = [(2, near + " x"), (5, near), (5, "quite another text of some words"), (6, near)]
    got = near_dup.near_duplicates(spark.createDataFrame([(i, t, 1) for i, t in rows], schema)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(2, 2, True), (5, 2, False), (5, 5, True), (6, 2, False)]


def test_near_duplicates_at_other_thresholds(spark):
    assert near_dup.least_matches(0.75) == 352
    base = [f"w{i}" for i in range(104)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:52] + ["x"] + base[53:])), (3, " ".join(base[:20] + ["y"] + base[21:70] + ["z", "z"] + base[72:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    def groups(num):
        return [r.component_id for r in near_dup.near_duplicates(docs, num=num).orderBy("doc_id").collect()]
    assert groups(75) == [1, 1, 1] and groups(85) == [1, 1, 3] and groups(95) == [1, 2, 3]


def test_toxicity_without_rows_to_learn_from(spark):
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int")
    ids = [r[0] for r in spark.range(400).filter(toxicity.held_out(F.col("id"))).limit(4).collect()]
    for some in (ids, [None, None], []):
        docs = spark.createDataFrame([(i, "any text") for i in some], "doc_id long, text string")
        model = toxicity.train(docs, labels)
        scores = [r.score for r in toxicity.score(docs, model).collect()]
        assert len(scores) == len(some) and all(0 < s < 0.5 for s in scores)
        assert toxicity.keep_clean(docs, model).count() == len(some)


def test_toxicity_learns_from_one_text_of_a_repeated_id(spark):
    rows = [(i, f"calm words number {i}") for i in range(200)] + [(4, f"vile {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in (4, 8, 12))) for i in range(0, 40, 4)], "doc_id long, toxic int")
    scores = [r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()]
    assert len(scores) == 500 and all(0 <= s <= 1 for s in scores)


def test_toxicity_held_out_rows(spark):
    got = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "i long").select("i", toxicity.held_out(F.col("i")).alias("h")).collect()
    assert all(r.h == (r.i is not None and zlib.crc32(str(r.i).encode()) % 3 == 1) for r in got)


def test_pii_finds_numbers_inside_rejected_candidates():
    anchors = pii.automaton()

    def found(text):
        return [(pii.KINDS[k], text[a:b]) for k, a, b in pii.find_spans(text, anchors)]

    text = "+1 (826) 555-4081 190.137.223.204"
    assert found(text) == [("ip", "190.137.223.204"), ("phone_within", "+1 (826) 555-4081")]
    assert pii.masked(text, pii.find_spans(text, anchors)) == "<phone> <ip>"
    assert found("id 12 4111 1111 1111 1111 7") == [("card_within", "4111 1111 1111 1111")]
    assert found("+12345678901234567890") == [] == found("4111 1111 1111 1112 77")


def test_warc_keeps_text_that_only_looks_like_a_tag():
    assert warc.plain_text("x<y then z> w") == "x<y then z> w"
    assert warc.plain_text('<p title="x>y">hello <b class=\'a>b\'>you</b>') == "hello you"
    assert warc.plain_text('a <my-tag x="1">b</my-tag> <svg:g>c <!DOCTYPE x>d <a href="u>e') == "a b c d e"
    assert warc.plain_text("1 <2 and 3> 2, <unknown> </gone>!") == "1 <2 and 3> 2, <unknown> !"


def test_token_look_up_from_the_files(spark, tmp_path):
    from tokenizers import Tokenizer

    from tsfold.llm import dac, queries

    path = queries._vocabulary("byte_bpe_50k.json")
    texts = {i: f"text number {i} " * (i % 5) for i in range(40)}
    docs = spark.createDataFrame([*texts.items(), (None, "no id"), (None, "none either")], "doc_id long, text string")
    dac.write_token_ids(docs, path, str(tmp_path / "ids"), 2, segment_ids=50)
    tok = Tokenizer.from_file(path)
    want = {(i, p): x for i, t in texts.items() for p, x in enumerate([*tok.encode(t, add_special_tokens=False).ids, 2])}
    asked = spark.createDataFrame([*want, (3, 999), (3, -1), (77, 0)], "doc_id long, place long")
    assert {(r.doc_id, r.place): r.token for r in dac.lookup(spark, str(tmp_path / "ids"), asked).collect()} == want
