import hashlib
import random
import json
import math
import re
import statistics as st

import pytest
from pyspark.sql import functions as F

from linkweave import fixed
from linkweave.functions import text, web
from linkweave.operators import extract, observations, search, style, textindex
from linkweave.sources import statistics

LONG = ("The quick brown fox jumps over the lazy dog. It was not what we had in mind, but then "
        "there are many of them and they do as they will! Why not? " * 3)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def words(t):
    return re.findall(r"\b\w+\b", t.lower())


def test_tokens_follow_unicode_words(spark):
    samples = ["Straße und Äpfel, naïve café_1!", "don't stop", "", "x-ray 42 ½"]
    got = docs(spark, *samples).select("doc_id", text.tokens("text").alias("t")).orderBy("doc_id")
    assert [r.t for r in got.collect()] == [words(s) for s in samples]


def test_ascii_tokens_need_unicode_boundaries(spark):
    row = docs(spark, "café abc äbc d_1").select(text.ascii_tokens("text").alias("t")).first()
    assert row.t == re.findall(r"\b[a-zA-Z0-9_]+\b", "café abc äbc d_1")


def test_char_ngrams_equal_a_loop(spark):
    sample = "Abé  c\U0001F600d\n\ne fgh"
    clean = re.sub(r"\s+", " ", sample.lower())
    want = {}
    for n in (3, 4, 5):
        for i in range(len(clean) - n + 1):
            g = clean[i:i + n]
            want[g] = want.get(g, 0) + 1
    out = style.char_ngram_shares(docs(spark, sample, "ab")).collect()
    assert {r.gram: r.n for r in out} == want
    assert sum(r.share for r in out) == pytest.approx(1.0)


def test_sentences_and_punctuation(spark):
    row = style.features(docs(spark, LONG)).first()
    lens = [len(words(s)) for s in re.split(r"[.!?]+", LONG) if s.strip()]
    assert row.avg_sentence_len == pytest.approx(st.mean(lens))
    assert row.std_sentence_len == pytest.approx(st.pstdev(lens))
    assert row.punctuation["."] == pytest.approx(LONG.count(".") / len(LONG) * 100)
    empty = style.features(docs(spark, "")).first()
    assert empty.word_count == 0 and empty.avg_sentence_len == 0.0


def test_style_vector_and_episode(spark):
    rows = [("a", 1, "the cat and the dog"), ("a", 1, "of the house"), ("b", 1, LONG)]
    df = spark.createDataFrame(rows, "author string, episode int, text string")
    out = {r.author: r for r in style.style_vectors(df, ["author", "episode"]).collect()}
    assert out["a"].word_count == 8 and out["a"].n_texts == 2 and out["a"].abstain
    assert not out["b"].abstain and len(out["b"].vector) == 174
    the = fixed.FUNCTION_WORDS.index("the")
    assert out["a"].vector[the] == pytest.approx(3 / 8)


def test_corpus_statistics(spark, folder):
    texts = [LONG, "the the a", "", "nothing here"]
    out = {r.word: r for r in style.corpus_statistics(docs(spark, *texts)).collect()}
    assert len(out) == 174
    shares = [words(t).count("the") / max(len(words(t)), 1) for t in texts]
    assert out["the"].mean == pytest.approx(st.mean(shares))
    assert out["the"].std_dev == pytest.approx(st.pstdev(shares))
    assert out["can't"].std_dev == 1e-5
    path = f"{folder}/short.json"
    with open(path, "w") as f:
        json.dump({"num_documents": 3, "means": [0.5, 0.0], "std_devs": [0.1, 0.0]}, f, indent=1)
    back = {r.pos: r for r in statistics.load(spark, path).collect()}
    assert len(back) == 174
    assert (back[0].mean, back[0].std_dev) == (0.5, 0.1)
    assert (back[1].mean, back[173].std_dev) == (0.002, 0.005)


def test_long_pairs(spark):
    d = docs(spark, LONG, LONG + " and more of the same", "too short")
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "left_id long, right_id long")
    out = {r.right_id: r for r in style.verify_pairs(
        pairs, style.style_vectors(d, ["doc_id"]), style.corpus_statistics(d)).collect()}
    assert (out[1].m_i, out[1].u_i, out[1].abstain) == (0.85, 0.02, False)
    assert out[2].abstain and out[2].llr == 0.0 and out[2].cosine is None


def test_delta_without_deviations(spark):
    row = spark.sql(
        "SELECT array(0.1D, 0.3D) a, array(0.2D, 0.1D) b, CAST(NULL AS ARRAY<DOUBLE>) s, array(1D) c"
    ).selectExpr(style.delta_sql("a", "b", "s") + " AS d", style.delta_sql("a", "c", "s") + " AS m")
    assert row.first().d == pytest.approx(0.15)
    assert row.first().m == 2.0


def _vector(t):
    toks = re.findall(r"\b[a-zA-Z0-9_]+\b", t.lower())
    v = {}
    for w in toks:
        v["w_" + w] = v.get("w_" + w, 0) + 1.0
    for x, y in zip(toks, toks[1:]):
        v[f"bg_{x}_{y}"] = v.get(f"bg_{x}_{y}", 0) + 1.0
    j = " ".join(toks)
    for i in range(len(j) - 2):
        v["c3_" + j[i:i + 3]] = v.get("c3_" + j[i:i + 3], 0) + 0.5
    return toks, v


def test_short_pairs_equal_a_loop(spark):
    a = "shipping is fast and the vendor replies within one hour every single day"
    b = "shipping was fast and the vendor replied within an hour every single day"
    c = "completely different words are used in this other message about cooking food"
    rows = [("ab", a, b), ("aa", a, a), ("ac", a, c), ("few", "too few tokens", a)]
    out = {r.pair_id: r for r in style.verify_short_pairs(
        spark.createDataFrame(rows, "pair_id string, text_a string, text_b string")).collect()}
    for pair, x, y in rows:
        (tx, vx), (ty, vy) = _vector(x), _vector(y)
        dot = sum(vx[k] * vy[k] for k in vx.keys() & vy.keys())
        sim = dot / math.sqrt(sum(v * v for v in vx.values()) * sum(v * v for v in vy.values()))
        r = out[pair]
        if len(tx) < 10 or len(ty) < 10:
            assert (r.verdict, r.llr_score) == ("ABSTAIN", 0.0)
            continue
        assert r.similarity == pytest.approx(sim, abs=1e-4)
        assert r.verdict == ("ABSTAIN" if sim < .45 else "MATCH" if sim >= .65 else "NO_MATCH")
    assert out["aa"].llr_score == 10.0


def test_top_word_distance(spark):
    df = spark.createDataFrame([("p", "a a b", "a c"), ("q", "", "x")],
                               "pair_id string, text_a string, text_b string")
    out = {r.pair_id: r for r in style.top_word_distance(df).collect()}
    assert out["p"].distance == round((abs(2 / 3 - .5) + 1 / 3 + .5) / 3, 4)
    assert out["q"].distance == 2.0


def test_every_identifier_kind(spark):
    onion = "abcdefgh234567" * 4
    body = (f"Key: A1B2 C3D4 E5F6 0718 293A 4B5C 6D7E 8F90 1234 5678\n"
            f"pay bc1q{'x' * 38} or 1{'B' * 30} or 0x{'aB' * 20}, private 4A{'b' * 93}\n"
            f"see {onion}.onion, mail someone.else@example.org and @some_handle twice @some_handle")
    df = spark.createDataFrame([("t", body), ("n", "nothing")], "text_id string, body string")
    out = {}
    for r in extract.extract_identifiers(df).collect():
        assert r.text_id == "t"
        out.setdefault(r.kind, set()).add(r.value)
    assert out["PGP_FINGERPRINT"] == {"A1B2C3D4E5F60718293A4B5C6D7E8F9012345678"}
    assert len(out["BTC_ADDRESS"]) == 2 and len(out["ETH_ADDRESS"]) == 1
    assert out["ONION_SERVICE"] == {f"{onion}.onion"}
    assert out["HANDLE"] == {"some_handle"} and out["EMAIL"] == {"someone.else@example.org"}
    flags = {r.text_id: r.xmr_abstain for r in extract.extraction_summary(df).collect()}
    assert flags == {"t": True, "n": False}


def test_footprint(spark):
    pem = "Subject: CN=hidden.example/O=x\nmore"
    rows = [("u1", "<title>Apache Status</title>", 77, {"SERVER": "nginx"}, pem),
            ("u2", "plain", 0, {}, None)]
    df = spark.createDataFrame(rows, "url string, html string, favicon_hash int, "
                                     "headers map<string,string>, tls_pem string")
    out = {r.url: r for r in extract.page_footprints(df).collect()}
    digest = hashlib.sha256(pem.strip().encode()).hexdigest()
    assert out["u1"].leaks == ["FAVICON_MMH3_77", "SERVER_STATUS_PAGE_EXPOSED",
                               f"TLS_CERT_{digest[:16]}", "SERVER_BANNER_nginx"]
    assert out["u1"].tls_common_name == "hidden.example"
    assert out["u2"].leaks == [] and out["u2"].x_powered_by == "Unknown"


def test_time_stamps(spark):
    df = spark.createDataFrame([("2026-01-01T00:00:00Z",), ("2026-01-01T02:00:00+02:00",),
                                ("2026-01-01",), ("bad",), ("",)], "t string")
    out = [r[0] for r in df.select(F.unix_micros(web.iso_timestamp("t"))).collect()]
    assert out[0] == out[1] == out[2] and out[3] is None and out[4] is None


def _raw(spark, *rows):
    return spark.createDataFrame(
        rows, "observation_id string, raw_content string, source_name string, source_type string, "
              "lawful_basis string, source_uri string")


def test_gate_and_duplicates(spark):
    ok = ("forum", "FORUM_CRAWL", "passive_osint", None)
    raw = _raw(spark, ("o1", "mail a@b.org", *ok), ("o2", "mail a@b.org", *ok), ("o3", "other", *ok),
               ("o4", "x", "forum", "FORUM_CRAWL", "stolen", None),
               ("o5", "", *ok), ("o6", "y", "forum", "SATELLITE", "honeypot", None))
    none = spark.createDataFrame([], "sha256 string")
    registry = spark.createDataFrame([], "name string, lawful_basis string")
    out = observations.ingest(raw, none, registry)
    assert {r.observation_id for r in out["held"].collect()} == {"o4", "o5", "o6"}
    assert {r.observation_id for r in out["observations"].collect()} == {"o1", "o3"}
    assert out["sources"].count() == 1
    ev = out["evidence"].collect()
    assert [(e.value, e.observation_id) for e in ev] == [("a@b.org", "o1")]
    art = {r.artifact_id: r for r in out["artifacts"].collect()}
    assert art[ev[0].artifact_id].sha256 == hashlib.sha256(b"mail a@b.org").hexdigest()
    again = observations.ingest(raw, out["artifacts"], out["sources"])
    assert again["observations"].count() == again["evidence"].count() == 0
    assert again["sources"].count() == 0
    rows = observations.with_digest(observations.gate(raw)[0])
    dup = observations.duplicates(rows, rows.limit(0)).collect()
    assert [(r.observation_id, r.prior_observation_id) for r in dup] == [("o2", "o1")]


def test_search_ranks_and_finds_digests(spark):
    d = spark.createDataFrame([(1, "wallet wallet cluster", "alpha"), (2, "walet only", "wallet"),
                               (3, "unrelated", "beta")], "doc_id long, text string, source string")
    out = [r.doc_id for r in search.scored_search(d, ["wallet"], 10).orderBy(F.desc("score")).collect()]
    assert set(out) == {1, 2}
    sha = hashlib.sha256(b"unrelated").hexdigest()
    assert [r.doc_id for r in search.scored_search(d, [sha], 10).collect()] == [3]


def test_index_ranks_as_the_search_over_texts(spark, tmp_path):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcé_") for _ in range(rng.randint(1, 8))) for _ in range(60)]
    vocabulary += ["x" * 31, "x" * 33, "x" * 34 + "y", "wallet", "walet", "wallets", "ballet"]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))), rng.choice(["wallet forum", "b", None]))
            for k in range(120)]
    rows += [(500, None, "wallet"), (501, "", "x"), (502, "wallet " * 400, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    textindex.build(docs, f"{tmp_path}/index")
    sha = hashlib.sha256(rows[7][1].encode()).hexdigest()
    for words in (["wallet"], ["x" * 33], ["x" * 32, "Wallet"], ["ab", sha], ["abca", "bcéa"], ["zzzzzzzzzz"], []):
        if not words:
            assert textindex.search(docs, f"{tmp_path}/index", words).count() == 0
            continue
        want = {r.doc_id: r.score for r in search.scored_search(docs, words, 200).collect()}
        got = {r.doc_id: r.score for r in textindex.search(docs, f"{tmp_path}/index", words, 200).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-8 for k in want)
    plan = textindex.search(docs, f"{tmp_path}/index", ["wallet"])._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "sha2" not in plan


def test_ngrams_are_counted_inside_the_row(spark):
    texts = ["", "ab", "abc", "a  b\tA B a b", "aaaaaa", "é😀é😀é😀é", "x" * 40 + "y" * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    figures = ["distinct_ngrams", "total_ngrams", "top_ngram_count"]
    out = style.bundle(docs)
    assert "Generate explode(concat(regexp_extract_all" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: tuple(r[f] for f in figures) for r in out.collect()}
    want = {r.doc_id: tuple(r[f] for f in figures) for r in style._ngrams_by_id(docs, "doc_id", "text").collect()}
    assert len(got) == len(texts) and got == {i: want.get(i, (0, 0, 0)) for i in range(len(texts))}
    # texts that share an id are one
    twice = docs.unionByName(spark.createDataFrame([(2, "bcd")], docs.schema))
    assert {r.distinct_ngrams for r in style.bundle(twice).where("doc_id = 2").collect()} == {2}


def test_short_pairs_are_compared_inside_the_row(spark):
    base = "one two two three a_b c a b_c four five six seven"
    rows = [("p", base, base + " eight nine"), ("q", base, "zz " * 12), ("r", "few", base), ("s", None, base)]
    pairs = spark.createDataFrame(rows, "pair_id string, text_a string, text_b string")
    out = style.verify_short_pairs(pairs)
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.pair_id: r for r in out.collect()}
    # a repeated id takes the other way for all pairs
    twice = pairs.unionByName(spark.createDataFrame([("t", base, base)] * 2, pairs.schema))
    want = {r.pair_id: r for r in style.verify_short_pairs(twice).where("pair_id <> 't'").collect()}
    assert got == want and got["p"].verdict == "MATCH"


def test_postings_are_counted_in_the_row_and_lie_by_term(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * k) % 7}" for k in range(30)), "s") for i in range(40)] + [(3, "w1 w1", "s"), (99, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    textindex.build(docs, f"{tmp_path}/index")
    got = spark.read.parquet(f"{tmp_path}/index/postings").where("field = 'content'")
    want = sum(len(set(t.split())) for _, t, _ in rows if t)
    assert got.count() == want and got.agg(F.sum("tf")).first()[0] == 30 * 40 + 2
    for part in got.groupBy(F.input_file_name()).agg(F.collect_list("term").alias("t")).collect():
        assert part.t == sorted(part.t)
