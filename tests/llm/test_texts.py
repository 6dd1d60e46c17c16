"""Token counts, byte-pair coding, language, quality scores and rules against plain versions."""

import hashlib
import math
import re
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardframe.llm import bpe, html_text, language, quadratic, queries, risk_rules, token_counts
from wardframe.llm.texts import id_bucket, table

SF = "/root/testdata/sf0.001"
tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

ODD = [
    None, "", " \n\t", "word", "word word", "x" * 70_000, " " * 9000 + "a", "ab1" * 9000, "é漢😀 " * 4000,
    "a<|endoftext|>b 1<|startoftext|>" * 300, "ΑΣ Σ İstanbul ﬁ don'T  ", "word", "1" * 4000 + " b" * 3000, "\x1c\x85 ",
]


def odd_rows(spark, extra="score double, n_tokens string, ids string"):
    rows = [(i, t, "en", "s", 0.5, "kept", "kept") for i, t in enumerate(ODD)] + [(3, "word", None, None, None, None, None)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {extra}")


def texts_of(spark):
    return [r.text for r in table(spark, SF, "documents").select("text").collect()] + [t for t in ODD if t]


def test_spliced_windows_equal_one_call(spark):
    tokenizer = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    for window, overlap in ((96, 20), (1000, 64), (32_768, 256)):
        encoder = token_counts.SplicingEncoder(tokenizer, window, overlap)
        for text in texts_of(spark):
            text = text[:6000] if window < 1000 else text
            want = tokenizer.encode(text, add_special_tokens=False)
            assert encoder.encode(text) == (want.ids, want.offsets)
    with pytest.raises(ValueError):
        token_counts.SplicingEncoder(tokenizer, 100, 5)


def test_token_counts_on_odd_rows(spark):
    tokenizer = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    docs = odd_rows(spark)
    got = token_counts.count_tokens(docs, public.path("byte_bpe_50k.json"), window=2000).collect()
    assert len(got) == len(ODD) + 1
    assert set(docs.columns) <= set(got[0].asDict())
    for r in got:
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 1024)
    assert token_counts.count_tokens(docs.limit(0), public.path("byte_bpe_50k.json")).count() == 0


def test_segment_tree_takes_leftmost_lowest_rank():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2, ("a", "a"): 3}
    assert bpe.merge_symbols(list("abcab"), ranks) == ["abc", "ab"]
    assert bpe.merge_symbols(list("aaaaa"), ranks) == ["aa", "aa", "a"]
    assert bpe.merge_symbols([], ranks) == [] and bpe.merge_symbols(["a"], ranks) == ["a"]


def test_codec_equals_the_library(spark):
    path = public.path("word_bpe_49k.json")
    tokenizer, codec = tokenizers.Tokenizer.from_file(path), bpe.WordBpe(path)
    signs = ["a" + chr(i) * 2 + "b1" + chr(i) + " '" + chr(i).upper() for i in range(0x300)]
    for text in texts_of(spark) + signs:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        packed, decoded = codec.pack(text)
        assert codec.encode(text) == ids
        assert decoded == tokenizer.decode(ids, skip_special_tokens=False) == codec.decode(ids)
    docs = odd_rows(spark)
    rows = bpe.bpe_digests(docs, path).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    full = bpe.encode_texts(docs, path).where("doc_id = 4").first()
    assert full.decoded == codec.decode(full.ids)
    assert bpe.bpe_digests(docs.limit(0), path).count() == 0


def test_language_held_out_accuracy_and_odd_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in queries.op4_language(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in held)
    model = language.fit(docs.limit(300))
    odd = odd_rows(spark)
    got = odd.select("doc_id", "text", language.predict(model, F.col("text")).alias("p")).collect()
    for r in got:
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert (r.p.lang_pred, r.p.score) == ("und", 0.0)
    nothing = language.fit(docs.limit(0))
    assert odd.select(language.predict(nothing, F.col("text")).alias("p")).where("p.lang_pred <> 'und'").count() == 0


def test_unseen_words_back_off_to_shorter_grams():
    logs = {n: {} for n in language.LENGTHS}
    logs[2] = {"qx": np.array([0.0, -5.0])}
    logs[1] = {"z": np.array([-4.0, 0.0])}
    model = language.LanguageModel(["aa", "bb"], {"known": np.array([-1.0, -2.0])}, logs)
    assert list(model.word_scores("known")) == [-1.0, -2.0]
    assert list(model.word_scores("qxz")) == [0.0, -5.0]  # the longer gram decides
    assert list(model.word_scores("z")) == [-4.0, 0.0]
    assert list(model.word_scores("w")) == [0.0, 0.0]


def test_quadratic_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op10_quadratic(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    good = [r.predicted for r in rows if r.quality == 1]
    bad = [r.predicted for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1
    docs = odd_rows(spark)
    model = quadratic.fit(docs.limit(0).select(F.lit(1).alias("label"), quadratic.statistics_column("text").alias("x")))
    assert docs.select(quadratic.score_texts(model, "text").alias("p")).where("p <> 0.5").count() == 0
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (2, 0), (3, None), (4, 1)], "doc_id long, quality int")
    assert sorted(map(tuple, quadratic.clean_labels(labels, "doc_id", "quality").collect())) == [(1, 0), (4, 1)]


def test_density_difference_is_that_of_two_gaussians():
    rng = np.random.default_rng(1)
    mean = [rng.normal(size=3), rng.normal(size=3)]
    cov = [np.diag([1.0, 2.0, 3.0]), np.eye(3) + 0.3]
    model = quadratic.QuadraticModel(mean, [np.linalg.cholesky(c) for c in cov], 0.7, np.zeros(3), np.ones(3))
    x = rng.normal(size=(5, 3))
    odds = [0.7 + sum(
        s * (-0.5 * (v - m) @ np.linalg.inv(c) @ (v - m) - 0.5 * np.log(np.linalg.det(c))) for s, m, c in zip((-1, 1), mean, cov)
    ) for v in x]
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-np.array(odds))))


def plain_statistics(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_rule_statistics_equal_a_plain_count(spark):
    repeats = ["a b c d e f g h " * 3, "\n".join(["x y", " ", "x y", "x y "] * 5), "1 2 3 4 5 6 7 8 9 " + "1 2 3 4 5 6 7 8"]
    docs = table(spark, SF, "documents").select("doc_id", "text").union(odd_rows(spark).select("doc_id", "text")).union(
        spark.createDataFrame([(i, t) for i, t in enumerate(repeats)], "doc_id long, text string"))
    for r in risk_rules.base_statistics(docs, "text", ["doc_id", "text"]).collect():
        want = plain_statistics(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_binomial_tail_is_exact(spark):
    cases = [(0, 500, 0.01), (3, 1000, 0.01), (900, 100_000, 0.0101), (7, 7, 0.3)]
    for k, n, p in cases:
        got = spark.range(1).select(risk_rules.binomial_tail(F.lit(k), F.lit(n), p).alias("t")).first().t
        if k >= n * p:
            assert got == 1.0
        else:
            logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
            assert got == pytest.approx(sum(map(math.exp, logs)), rel=1e-7)


def test_cutoffs_keep_the_promise_and_need_evidence(spark):
    rng = np.random.default_rng(3)

    def good(n, stratum):
        return [(i, stratum, 100, int(500 + rng.integers(0, 50)), int(rng.random() < 0.001) * 90, 0, 0, 0, False) for i in range(n)]

    names = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_exclaims long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    rows = spark.createDataFrame(good(6000, "a") + good(50, "b"), names)
    cuts = risk_rules.certified_cutoffs(rows)
    assert {r.stratum for r in cuts.collect()} == {"a"}
    judged = risk_rules.judge(rows, cuts)
    assert judged.where("stratum = 'a' and not kept").count() <= 0.05 * 6000
    assert judged.where("stratum = 'b' and not kept").count() == 0
    junk = spark.createDataFrame([(9, "a", 100, 500, 95, 0, 0, 0, False)], names)
    assert not risk_rules.judge(junk, cuts).first().kept


def test_rules_on_empty_and_odd_tables(spark):
    docs = odd_rows(spark).select("doc_id", "text", "lang")
    labels = spark.createDataFrame([(1, None), (2, 1)], "doc_id long, quality int")
    assert risk_rules.apply_rules(docs, labels).count() == len(ODD) + 1
    assert risk_rules.apply_rules(docs.limit(0), labels.limit(0)).count() == 0


PAGE = """<html><body><div class="cookie-notice">We use cookies on this page and that is what you have to know about it</div>
<header><h1>Site</h1></header><nav><a href=x>home</a></nav>%s<div class=sidebar><p>Related: <a href=1>foo</a></div>
<div id=comments><p>I think that this is the best article that I have read in all of my life and it is great to be here.</div>
<form><p>Sign up to the list<input></form><footer>&copy; 2020 by us</footer><script>if(a<b){document.write("<p>x</p>")}</script>"""
PROSE = "This is a paragraph of the article and it has a lot of the usual words in it, so that the rules can be sure &amp; keep it."


def test_main_text_rules():
    body = f"<h1>Big news</h1><p>{PROSE}<p>Short one.<p>{PROSE}\n  <b>bold</b><br>end<ul><li>item &quot;one&quot;</ul>"
    prose = PROSE.replace("&amp;", "&")
    want = "\n\n".join(["Big news", prose, "Short one.", prose + " bold end", 'item "one"'])
    assert html_text.main_text(PAGE % f"<div id=content>{body}</div>") == want
    assert html_text.main_text(PAGE % f"<main><aside>note</aside><article>{body}</article></main>") == want
    assert html_text.main_text((PAGE % f"<article>{body}</article>").replace("</article>", "")[:-40]).startswith("Big news")


def test_main_text_defined_cases(spark):
    cases = {None: "", "": "", "<": "<", "<p": "", "<p>a &am": "a &am", "plain": "plain", "<article><p>x<br>y</article>": "x y"}
    pages = spark.createDataFrame([(i, None, h, "t") for i, h in enumerate(cases)] * 2, "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == sorted((i, t, len(t)) for i, t in enumerate(cases.values()) for _ in "ab")
    assert html_text.extract(pages.limit(0)).count() == 0
    assert html_text.main_text("<div>" * 30_000 + "x") == "x"


def test_main_text_behind_many_open_elements():
    prose = PROSE.replace("&amp;", "&")
    shapes = "<path d='M0 0'/>" * 500
    for before in (f"<svg>{shapes}</svg>", f"<svg/><math/><svg><title/>{shapes}</svg>", "<nav>" + "<b>" * 500 + "</nav>", "<form>" + "<i>x" * 300 + "</form>"):
        assert html_text.main_text(f"<body>{before}<p>{PROSE}</p><p>{PROSE}</p>") == f"{prose}\n\n{prose}"
    flat = "<ul><li>" + "<b>" * 60 + "one<li>two</ul>"
    assert [b.text for b in html_text.blocks(flat)] == ["one", "two"]
    assert html_text._attributes("<a href=x/>", 2)[2] is False and html_text._attributes("<a b='x' />", 2)[2] is True


def test_main_text_article_is_a_prior_only():
    prose = PROSE.replace("&amp;", "&")
    long = f"{PROSE} {PROSE}"
    body = f"<p>{long}</p>" * 3
    want = "\n\n".join([f"{prose} {prose}"] * 3)
    card = "<article class=card><p><a href=x>Buy a teaser of something else, now cheaper in all colours and sizes</a></p></article>"
    plain = "<article class=card><p>Teaser: something else, cheaper now, all colours, all sizes, free delivery</p></article>"
    for teaser in (card, plain):
        for page in (f"<main>{body}{teaser}</main>", f"<div>{body}</div>{teaser}", f"{teaser}<div>{body}</div>"):
            assert html_text.main_text(PAGE % page).replace(f"\n\n{html_text.blocks(teaser)[0].text}", "").endswith(want)
    # Stop words count inside as well; a language without listed stop words is kept by length.
    links = "<p><a href=x>more of this and that, all of it here</a></p>"
    tags = "<p>Tags: alpha beta gamma delta epsilon zeta eta theta iota kappa lambda</p>"
    assert html_text.main_text(f"<article>{body}{links}{tags}{links}</article>") == want
    russian = "Это первый абзац статьи, в котором довольно много слов и нет ни одной ссылки на другие страницы."
    assert html_text.main_text(f"<article>{links}<p>{russian}</p>{links}</article>") == russian


def test_second_pass_inherits_from_the_nearest_decided():
    labels = ["short", "good", "short", "bad", "near", "good", "short", "short", "bad"]
    assert html_text.second_pass(labels, False) == ["good", "good", "good", "bad", "good", "good", "good", "bad", "bad"]
    assert html_text.second_pass(["short", "near"], False) == ["good", "good"]


def test_id_bucket_is_crc32_of_the_text(spark):
    import zlib

    rows = spark.range(50).select("id", id_bucket("id", 5).alias("b")).collect()
    assert all(r.b == zlib.crc32(str(r.id).encode()) % 5 for r in rows)
