"""Recursive byte-pair coding, conversation repair and spelling variants against plain versions and SQL."""

import base64
import hashlib
import itertools
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, connect
from wardframe.llm import dialogue, html_text, queries, recursive_bpe, spelling, warc
from wardframe.llm.texts import table

SF = "/root/testdata/sf0.001"
tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")
RANKS = "byte_bpe_multi_50k.tiktoken"

ODD = [
    None, "", " \n\t", "word", "word word", "x" * 20_000, " " * 3000 + "a", "ab1" * 900, "é漢😀 " * 400, "a<|endoftext|>b",
    "ΑΣ Σ İstanbul ﬁ don'T  ", "word", "\x1c\x85 \x00", "".join(chr(97 + i * i % 26) for i in range(1500)),
]


def library():
    with open(public.path(RANKS), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain_merge(word, ranks):
    parts = [bytes([b]) for b in word]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_recursive_coding_equals_the_library(spark):
    path, encoding = public.path(RANKS), library()
    coder = recursive_bpe.RecursiveBpe(path, public.PATTERN)
    signs = ["a" + chr(i) * 2 + " b1" + chr(i) + " '" + chr(i) + "  " + chr(i) + "\n" for i in range(0x500)]
    texts = [r.text or "" for r in table(spark, SF, "documents").collect()] + [t or "" for t in ODD] + signs
    ids, counts = coder.encode(texts)
    decoded = coder.decode(ids, counts)
    for text, part, back in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), decoded, strict=True):
        assert part.tolist() == encoding.encode_ordinary(text) and back == text.encode()


def test_recursive_contraction_where_a_merge_makes_a_lower_rank(tmp_path):
    tokens = [bytes([b]) for b in range(256)] + [b"cd", b"bc", b"abc", b"abcd", b"ab", b"aa", b"aaaa", b"aab"]
    path = tmp_path / "ranks.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens)))
    ranks = {t: i for i, t in enumerate(tokens)}
    coder = recursive_bpe.RecursiveBpe(str(path), r".+")
    words = [bytes(w) for n in range(2, 8) for w in itertools.product(b"abcd", repeat=n)]
    rng = random.Random(0)
    words += [bytes(rng.choice(b"abcd") for _ in range(40)) for _ in range(200)]
    word, token = coder.contract(words)
    got = np.split(token, np.cumsum(np.bincount(word, minlength=len(words)))[:-1])
    assert all(g.tolist() == plain_merge(w, ranks) for w, g in zip(words, got, strict=True))


def test_recursive_coding_goes_on_over_queries_and_forgets(monkeypatch):
    monkeypatch.setattr(recursive_bpe, "QUERY_ROWS", 50)
    monkeypatch.setattr(recursive_bpe, "QUERY_BYTES", 40)
    monkeypatch.setattr(recursive_bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(recursive_bpe, "DECODE_IDS", 5)
    coder, encoding = recursive_bpe.RecursiveBpe(public.path(RANKS), public.PATTERN), library()
    for texts in (["an unbreakablylongishword of letters", "", "xxxxxxxxxxxxxxxxxxxxx"], ["again", "and again and again"], []):
        ids, counts = coder.encode(texts)
        assert ids.tolist() == [i for t in texts for i in encoding.encode_ordinary(t)]
        assert coder.decode(ids, counts) == [t.encode() for t in texts]


def test_recursive_digests_on_odd_rows(spark):
    path, encoding = public.path(RANKS), library()
    rows = [(i, t, "kept", 1) for i, t in enumerate(ODD)] + [(3, "word", None, None), (None, "a b", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, __encoded int")
    got = recursive_bpe.bpe_digests(docs, path, public.PATTERN).collect()
    assert len(got) == len(rows) and all("__encoded" in r.asDict() for r in got)
    for r in got:
        ids = encoding.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    coded = recursive_bpe.encode_texts(docs.limit(6), path, public.PATTERN)
    back = recursive_bpe.decode_ids(coded, path, public.PATTERN).collect()
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in back)
    nothing = recursive_bpe.decode_ids(docs.limit(1).select(F.lit(None).cast("array<long>").alias("ids")), path, public.PATTERN).first()
    assert bytes(nothing.decoded) == b""
    assert recursive_bpe.bpe_digests(docs.limit(0), path, public.PATTERN).count() == 0


def cheapest(letters):
    """Least (cost, audit) by trying every string of edits with up to three insertions at each place."""
    best = None
    queue = [(0, "", 0, 0)]
    seen = {}
    while queue:
        cost, audit, i, state = queue.pop()
        if seen.get((i, state), (10**9, "")) < (cost, audit):
            continue
        seen[i, state] = (cost, audit)
        if i == len(letters) and state in dialogue.ENDS and (best is None or (cost, audit) < best):
            best = (cost, audit)
        for x in "ua":
            if (state, x) in dialogue.MOVES and cost < 5 * (len(letters) + 3):
                queue.append((cost + 5, audit + "I", i, dialogue.MOVES[state, x]))
        if i < len(letters):
            queue.append((cost + 2, audit + "D", i + 1, state))
            if letters[i] != dialogue.GONE:
                extra = 5 * letters[i].isupper()
                for x in "sua":
                    after = dialogue.MOVES.get((state, x))
                    if after is not None and x == letters[i].lower():
                        queue.append((cost + extra, audit + "K", i + 1, after))
                    if after is not None and x != "s":
                        queue.append((cost + 1 + extra, audit + "R", i + 1, after))
    return best


def test_interval_parsing_finds_the_least_cost_and_audit():
    parser = dialogue.Parser()
    rng = random.Random(3)
    cases = ["".join(x) for n in range(4) for x in itertools.product("suaodSUAO", repeat=n)]
    cases += ["".join(rng.choice("uuaasodUA") for _ in range(rng.randint(4, 11))) for _ in range(150)]
    for letters in cases:
        assert dialogue.best(parser.cell(letters)) == cheapest(letters), letters
    long = "".join(rng.choice("uuaasodUA") for _ in range(200))
    parts = [parser.cell(long[i:i + 7]) for i in range(0, 200, 7)]
    joined = parts[0]
    for part in parts[1:]:
        joined = dialogue._join(joined, part)
    assert joined == parser.cell(long)


def conversation_rows():
    rng = random.Random(5)
    rows = []
    for conv in [*range(25), None, 10**17 + 1]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None])
            text = rng.choice(["Fine.", "Fine.", "Yes!", "no end", " \t\n", "", None, "a:b\nc? \u000b", "é" * 50 + "."])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, text, "extra", 1))
    return rows + [(99, 10**17 + 1, "user", "Hi.", None, None), (99, 10**17 + 3, "user", "Hi.", None, None)]


def test_repair_on_odd_rows_equals_sql_and_the_long_way(spark, tmp_path):
    odd = spark.createDataFrame(conversation_rows(), "conv_id long, turn long, role string, text string, gaps string, place long")
    for frame in (odd, odd.limit(0)):
        path = str(tmp_path / f"{frame.count()}")
        frame.coalesce(1).write.parquet(f"{path}/conversations.parquet")
        con = connect(SF)
        con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
        assert compare(spark, con, queries.op12_dialogue_repair, queries.ORACLES["op12_dialogue_repair"], path) == ""
    rows = dialogue.damage(odd)
    key = lambda r: tuple(str(x) for x in r)
    short, long = (sorted(map(tuple, dialogue.repair_digests(rows, n).collect()), key=key) for n in (1000, 2))
    assert short == long
    told, made = dialogue.repair(rows, 2)
    reports, lines = dialogue.repair(rows)
    assert sorted(map(tuple, told.collect()), key=key) == sorted(map(tuple, reports.collect()), key=key)
    assert sorted(map(tuple, made.collect()), key=key) == sorted(map(tuple, lines.collect()), key=key)
    for r in reports.collect():
        roles = "".join(x.role[0] for x in sorted(lines.where(F.col("conv_id").eqNullSafe(F.lit(r.conv_id))).collect(), key=lambda x: x.line)) \
            if r.conv_id in (3, None) else "ua"
        assert roles in ("", "s") or roles.lstrip("s").replace("ua", "") == ""


def test_repair_of_one_long_conversation_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "SPAN_ROWS", 3)
    monkeypatch.setattr(dialogue, "FAN_IN", 2)
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["a.", "b", f"{t}!"])) for t in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    long, short = dialogue.repair_digests(df, 10).collect(), dialogue.repair_digests(df).collect()
    assert long == short and len(long) == 1


def plain_words(rows):
    """Counter of the words of (doc_id, text) rows, typos included."""
    import re

    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    out = Counter()
    for doc, text in rows:
        for run in re.findall(spelling.RUN, (text or "").translate(lower)):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            out[run[:h % len(run)] + run[h % len(run) + 1:] if h % spelling.TYPO == 0 else run] += 1
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts):
    words = {w: n for w, n in counts.items() if len(w) >= spelling.MIN_LENGTH and n >= spelling.MIN_COUNT}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= spelling.FORM_RATIO * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def test_variants_equal_all_pairs(spark):
    rng = random.Random(2)
    base = ["aaabbb", "straße", "lettres", "letters", "aabbcc", "colour×", "abcabcabc", "çaétait"]
    rows = []
    for i in range(120):
        words = []
        for w in base:
            for _ in range(rng.choice([1, 1, 2, 6])):
                at, kind = rng.randrange(len(w)), rng.random()
                sign = rng.choice("abé")
                words.append(w if kind < 0.6 else w[:at] + w[at + 1:] if kind < 0.75 else w[:at] + sign + w[at + (kind < 0.9):])
        rows.append((i % 50 if i % 7 else None, " ".join(words).upper() if i % 3 == 0 else "-".join(words), "x", 1))
    rows += [(1, None, None, None), (2, "", None, None), (3, "a", None, None), (4, "wordword " * 3000, None, None), (5, "wordwords1wordwords\n" * 6, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    got = spelling.group_variants(spelling.vocabulary(spelling.runs_with_typos(docs)))
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == plain_variants(plain_words([r[:2] for r in rows]))
    empty = spelling.group_variants(spelling.vocabulary(spelling.runs_with_typos(docs.limit(0))))
    assert empty.count() == 0 and set(empty.columns) == {"word", "form", "root", "n", "n_near", "form_n"}


def test_neighbours_meet_once_and_chains_end(spark):
    words = spark.createDataFrame([("aab", 5), ("ab", 25), ("aaab", 125), ("abb", 5), ("cb", 1), ("", 3)], "word string, n long")
    pairs = [(r.word, r.near) for r in spelling.neighbours(words).collect()]
    assert len(pairs) == len(set(pairs))
    names = [w for w in ("aab", "ab", "aaab", "abb", "cb")]
    assert set(pairs) == {(a, b) for a in names for b in names if a != b and one_edit(a, b)}
    chain = spark.createDataFrame([(str(i), str(i + 1)) for i in range(37)], "word string, form string")
    assert {r.root for r in spelling.roots(chain).collect()} == {"37"}


@pytest.mark.parametrize("name", ["op12_dialogue_repair", "op13_spelling"])
def test_round3_queries_equal_sql(spark, name):
    assert compare(spark, connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF) == ""


PROSE = "The council has said that the old bridge over the river will be closed for most of the year, and that this is not the last of it. " * 2


@pytest.mark.parametrize("wrapped", [
    '<div class="content-with-sidebar">%s</div>', '<div id="page" class="has-sidebar">%s</div>', '<div class="site no-header">%s</div>',
    '<div class="post single-notice">%s</div>', '<main class="with-menu">%s</main>', '<div class="search-results">%s</div>',
    '<div class="legal-text">%s</div>', '<article class="post comments-open">%s</article>', '<div class="related-work">%s</div>',
    '<form id="aspnetForm">%s</form>', '<form><div class="related-work"><div class="legal-text">%s</div></div></form>',
])
def test_no_text_is_lost_by_a_layout_name(wrapped):
    body = f"<p>{PROSE}</p>" * 4
    want = "\n\n".join([PROSE.strip()] * 4)
    around = '<header>Home</header><nav><a href=x>menu</a></nav>%s<footer>All rights are ours and this is the end of it</footer>'
    assert html_text.main_text(around % (wrapped % body)) == want
    # Boxes inside the wrapper are still judged, and so are comments, however long.
    noise = f'<div class="sidebar"><p>{PROSE}</p></div><form class="newsletter"><p>{PROSE}</p></form>'
    talk = f'<section class="comments-area" id="comments">{"<p>I do not think that this is the way to do it, and it was the same with the last one.</p>" * 40}</section>'
    assert html_text.main_text(around % (wrapped % (noise + body + talk))) == want
    assert html_text.main_text(around % (noise + wrapped % body + talk)) == want


def test_archive_with_urls_of_a_megabyte(spark):
    urls = ["u" * 1_000_000, "é " * 300_000, "\r\n\r\n" * 1000, None, ""]
    rows = [(i, u, f"<p>{i % 2}</p>" * 50) for i, u in enumerate(urls)] + [(9, "x", None)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r.page_id for r in got] == [0, 1, 2, 3, 4, 9]
    assert [r.refers_to for r in got] == [None, None, 0, 1, 0, None]
    for r, (_, _, page) in zip(got, rows):
        assert (r.payload_bytes, r.payload_digest) == (len(page or ""), hashlib.sha256((page or "").encode()).hexdigest())
