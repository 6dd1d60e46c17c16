"""Search, near duplicates, packing, archives and the pipeline against brute force."""

import gzip
import hashlib
import io
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.oracle import compare, connect
from wardframe.llm import components, forest, near_copies, packing, queries, simhash, warc
from wardframe.llm.texts import table

SF = "/root/testdata/sf0.001"
xxhash = pytest.importorskip("xxhash")


def brute_neighbours(rows, asked, k):
    """rows: {id: vector}; the k nearest by inner product, ties to the smaller id."""
    ids = sorted(rows)
    matrix = np.array([rows[i] for i in ids], dtype=float)
    out = {}
    for q in asked:
        scores = matrix @ np.array(rows[q], dtype=float)
        best = sorted((-s, i) for s, i in zip(scores, ids) if i != q)[:k]
        out[q] = [(i, -s) for s, i in best]
    return out


def test_forest_recall_and_order(spark):
    vectors = table(spark, SF, "embeddings")
    rows = {r.vec_id: r.embedding for r in vectors.collect()}
    want = brute_neighbours(rows, [i for i in rows if i % 20 == 0], 20)
    got = {}
    for r in sorted(queries.op1_forest_search(spark, SF).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    for q, answer in got.items():
        assert len(answer) == 20 and answer == sorted(answer, key=lambda x: (-x[1], x[0]))
        assert all(s == pytest.approx(float(np.dot(np.array(rows[q], float), np.array(rows[i], float))), abs=1e-12) for i, s in answer)


def test_forest_small_tree_search_still_finds(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 12))
    rows = {i: (centres[i % 30] + 0.1 * rng.normal(size=12)).tolist() for i in range(1500)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got = forest.search(df, F.col("vec_id") % 20 == 0, k=5, trees=4, leaf=32, fit_rows=600).collect()
    want = brute_neighbours(rows, [i for i in rows if i % 20 == 0], 5)
    found = {(r.query_id, r.vec_id) for r in got}
    assert np.mean([(q, i) in found for q, answer in want.items() for i, _ in answer]) >= 0.9


def test_forest_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (40, [0.0, 0.0]),
        (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (None, [1.0, 1.0]),
    ] + [(100 + i, [1.0, 0.0]) for i in range(60)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = forest.search(df, F.col("vec_id") % 20 == 0).collect()
    answers = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in {r.query_id for r in got}}
    equal = sorted([0, 1, 20, *range(100, 160)])
    assert set(answers) == {0, 20, 100, 120, 140}
    for q, found in answers.items():
        assert found == [i for i in equal if i != q][:20]
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in forest.search(two, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 4.0)]
    assert forest.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def plain_fingerprint(text, size=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, reach=2):
    """{key: smallest key reachable} for {key: fingerprint}."""
    keys = sorted(prints)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= reach:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_simhash_equals_brute_force(spark):
    texts = ["the cat sat on the mat " * 3, "THE cat sat on the mat " * 3, "the cat sat on the hat " * 3, None, "", " \n", "one", "One two"]
    docs = table(spark, SF, "documents").select("doc_id", "text").union(
        spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    prints = {k: plain_fingerprint(t) for k, t in rows.items()}
    want = plain_components(prints)
    got = simhash.near_duplicates(docs.withColumn("component_id", F.lit("x")))
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got.collect()} == {k: (prints[k], want[k]) for k in rows}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cost", [1e9, 260.0, 0.0])
def test_all_links_are_found_whatever_the_cost_estimate(spark, monkeypatch, cost):
    monkeypatch.setattr(simhash, "PROBE_COST", cost)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    crowd = [int(base[0]) ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 24, (150, 2))]
    near = [int(f) ^ (1 << int(b)) for f in base for b in rng.integers(0, 64, 2)]
    prints = sorted({int(f) for f in base} | set(crowd) | set(near))
    signed = [(int(np.array([f], np.uint64).view(np.int64)[0]),) for f in prints]
    edges = simhash.links(spark.createDataFrame(signed, "f long"), sample_size=64)
    got = {r.node: r.component for r in components.components(edges, "x", "y").collect()}
    want = plain_components({s[0]: f for s, f in zip(signed, prints)})
    assert {k: got.get(k, k) for k in want} == want


def test_thresholds_satisfy_the_pigeonhole_sum():
    rng = np.random.default_rng(1)
    sample = rng.integers(-(2**63), 2**63, 300, dtype=np.int64)
    groups = simhash.correlated_partitions(sample)
    assert sorted(b for g in groups for b in g) == list(range(64))
    picked, cost = simhash.Prober(groups, sample, 10_000, 2).thresholds(sample.view(np.uint64))
    assert (picked.sum(axis=1) == 2 - 3 + 1).all() and (picked >= -1).all() and (cost > 0).all()


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (7, 6), (200, 201), (201, 200), (None, 1)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def varied(words, changes, rng):
    out = list(words)
    for at in rng.choice(len(words), changes, replace=False):
        out[at] = f"new{rng.integers(1e9)}"
    return " ".join(out)


def test_near_copies_link_at_the_bound_only(spark):
    """Pairs of Jaccard 0.81 and of 0.75: the first are linked, the second are not."""
    rng = np.random.default_rng(8)
    docs = []
    for i in range(100):
        words = [f"w{rng.integers(1e9)}" for _ in range(400)]
        for change in (0, 42 if i % 2 else 57):  # of 396 shingles; the end of the text is replaced
            docs.append((len(docs), " ".join(words[:400 - change] + [f"n{rng.integers(1e9)}" for _ in range(change)])))
    shingles = [set(near_copies.shingle_hashes(t).tolist()) for _, t in docs]
    alike = {i: len(shingles[i] & shingles[i + 1]) / len(shingles[i] | shingles[i + 1]) for i in range(0, len(docs), 2)}
    assert {a >= 0.8 for a in alike.values()} == {True, False} and min(alike.values()) > 0.74
    got = {r.doc_id: r.group_id for r in near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: got[i + 1] == i for i in alike} == {i: a >= 0.8 for i, a in alike.items()}


def test_near_copies_within_a_template_crowd(spark):
    """Pages of one template (pairwise 0.67) with 150 pairs just above the bound: all these, nothing else."""
    rng = np.random.default_rng(12)
    template = [f"t{i}" for i in range(240)]
    docs = []
    for pair in range(150):
        shared = [f"s{pair}x{i}" for i in range(28)]
        docs += [(2 * pair + i, " ".join(template + shared + [f"p{rng.integers(1e12)}" for _ in range(32)])) for i in range(2)]
    shingles = [set(near_copies.shingle_hashes(t).tolist()) for _, t in docs]
    brute = {(i, j) for i in range(300) for j in range(i) if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])}
    assert brute == {(2 * i + 1, 2 * i) for i in range(150)}
    got = {r.doc_id: r.group_id for r in near_copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    split = sum(got[i] != j for i, j in brute)
    assert split == 0 and all(got[j] == j for _, j in brute)


def test_near_copies_go_through_the_simhash_search(spark, monkeypatch):
    """Without the buckets, near texts within two bits are still grouped; the search's groups equal brute force."""
    rng = np.random.default_rng(21)
    docs = []
    for _ in range(30):
        words = [f"w{rng.integers(1e9)}" for _ in range(1200)]
        docs += [(len(docs) + i, varied(words, (0, 1, 2)[i], rng)) for i in range(3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    sketches = [near_copies.sketch(t) for _, t in docs]
    prints = [s[2][0] % 2**64 for s in sketches]
    linked = [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert 30 < len(linked) < 90 and all(i // 3 == j // 3 for i, j in linked)
    folded = near_copies._fold(near_copies._read(frame, "doc_id", "text"))
    pairs = {(r.node, r.leader) for r in near_copies._print_pairs(folded).collect()}
    at = {s[0]: i for i, s in enumerate(sketches)}

    def groups(links):
        first = list(range(len(docs)))
        for _ in docs:
            for i, j in links:
                first[i] = first[j] = min(first[i], first[j])
        return first

    assert {(max(at[a], at[b]), min(at[a], at[b])) for a, b in pairs} <= set(linked)
    assert groups([(at[a], at[b]) for a, b in pairs]) == groups(linked)
    buckets = near_copies._sample_buckets
    monkeypatch.setattr(near_copies, "_sample_buckets", lambda nodes: buckets(nodes).limit(0))
    assert {r.doc_id for r in corpus_pipeline.dedup_stage(spark, frame, SF).collect()} == set(groups(linked))


def test_near_copies_of_four_fifths_are_grouped(spark):
    rng = np.random.default_rng(4)
    docs, family = [], {}
    for f in range(40):
        words = [f"w{rng.integers(20_000)}" for _ in range(250)]
        for copy in range(3):
            family[len(docs)] = f
            docs.append((len(docs), varied(words, [0, 2, 4][copy], rng)))
    far = [(1000 + i, varied(docs[0][1].split(), 60, rng)) for i in range(5)]
    extra = [(2000, None), (2001, ""), (2002, docs[0][1].upper()), (None, "x")]
    df = spark.createDataFrame(docs + far + extra, "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in near_copies.near_copies(df).collect()}
    assert all(got[i] == min(j for j in family if family[j] == f) for i, f in family.items())
    assert all(got[i] == i for i, _ in far)
    assert got[2002] == 0 and got[2001] == got[2000] == 2000 and None not in got
    assert near_copies.near_copies(df.limit(0)).count() == 0


def plain_pack(lengths, sources, clusters, capacity):
    """Best fit by scanning every bin, for comparison."""
    bins, where = [], {}
    rests = []
    for d, n in enumerate(lengths):
        full, rest = divmod(n, capacity)
        for p in range(full):
            bins.append([0, {sources[d]}, {clusters[d]}])
            where[d, p] = len(bins) - 1
        if rest or not full:
            rests.append((-rest, d, full))
    for negative, d, p in sorted(rests):
        fits = [
            (room, b) for b, (room, s, c) in enumerate(bins)
            if room >= -negative and room > 0 and (sources[d] is None or sources[d] not in s) and (clusters[d] is None or clusters[d] not in c)
        ]
        if fits:
            b = min(fits)[1]
        else:
            bins.append([capacity, set(), set()])
            b = len(bins) - 1
        bins[b][0] += negative
        bins[b][1].add(sources[d])
        bins[b][2].add(clusters[d])
        where[d, p] = b
    return where


def test_packing_is_best_fit_under_conflicts():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = int(rng.integers(0, 80))
        lengths = [int(x) for x in rng.integers(0, 250, n)]
        sources = [None if x == 0 else f"s{x}" for x in rng.integers(0, 8, n)]
        clusters = [None if x == 0 else f"c{x}" for x in rng.integers(0, 12, n)]
        got = packing.pack(lengths, sources, clusters, 100)
        assert {(d, p): b for d, pieces in enumerate(got) for p, _, _, b in pieces} == plain_pack(lengths, sources, clusters, 100)


def test_packing_places_every_byte_once(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "source").union(spark.createDataFrame(
        [(9001, None, None), (9002, "", "a"), (9003, "x" * 30_000, "a"), (9003, "x" * 30_000, "a"), (9004, "y", None)],
        "doc_id long, text string, source string"))
    size = {}
    for r in docs.collect():
        size[r.doc_id] = size.get(r.doc_id, 0) + len((r.text or "").encode())
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = packing.pack_documents(docs, group_documents=64).collect()
    placed, load, held = {}, {}, {}
    for r in rows:
        placed[r.doc_id] = placed.get(r.doc_id, 0) + r.length
        load[r.bin_id] = load.get(r.bin_id, 0) + r.length
        held.setdefault(r.bin_id, []).append(source[r.doc_id])
    assert placed == size and max(load.values()) <= packing.CAPACITY
    assert all(r.room == packing.CAPACITY - load[r.bin_id] for r in rows)
    for names in held.values():
        named = [s for s in names if s is not None]
        assert len(named) == len(set(named))
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_archives_equal_sql_and_files_are_plain_warc(spark, tmp_path):
    duck = connect(SF)
    assert compare(spark, duck, queries.QUERIES["op7_warc"], queries.ORACLES["op7_warc"], SF) == ""
    big = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 40_000
    rows = [(1, "http://a b/é", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (None, "u", big), (1, "x", big)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload_bytes int")
    got = sorted(((r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    digest = {h: hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in rows}
    size = len(big.encode())
    b = digest[big]
    assert got == sorted([
        (1, size, b, "response", None), (1, size, b, "response", None), (2, size, b, "revisit", 1), (0, size, b, "response", None),
        (3, 0, digest[None], "response", None), (4, 0, digest[""], "response", None),
        (5, 5, digest["small"], "response", None), (6, 5, digest["small"], "response", None),
    ], key=lambda x: (x[0], x[1], x[2], x[3]))
    assert warc.round_trip(pages.limit(0)).count() == 0
    folder = str(tmp_path / "w")
    archives = [r.archive for r in warc.write_archives(warc.with_references(pages), folder).collect()]
    assert all(os.path.exists(a) for a in archives)
    text = b"".join(gzip.open(a).read() for a in archives)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.count(b"WARC-Record-ID") == len(rows)


def test_reader_streams_in_bounded_chunks():
    payload = "ab\r\n\r\n" * 5000
    digest = hashlib.sha256(payload.encode()).hexdigest()
    data = b"".join(d for _, _, d in warc.record_chunks("7", "http://x", len(payload), digest, None, payload))
    data += b"".join(d for _, _, d in warc.record_chunks("8", "http://x", len(payload), digest, "7", ""))
    seen = list(warc.Reader(io.BytesIO(data), chunk=1000).chunks())
    assert max(len(part) for _, _, part, _ in seen) <= 1000
    assert [n for r, n, _, _ in seen if r.headers["warc-record-id"] == "<urn:page:7>"] == list(range(len(seen) - 1))
    assert b"".join(p for _, _, p, _ in seen).decode() == payload and seen[0][0].digest.hexdigest() == digest
    with pytest.raises(ValueError):
        list(warc.Reader(io.BytesIO(data[:-10])).chunks())


def test_rules_equal_sql(spark):
    assert compare(spark, connect(SF), queries.QUERIES["op9_risk_rules"], queries.ORACLES["op9_risk_rules"], SF) == ""


def test_pipeline_stages_keep_what_they_should(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").withColumn("score", F.lit("x"))
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "language_id", "simhash_near_dedup", "best_fit_packing"]
    kept = corpus_pipeline.quality_stage(spark, docs, sf)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert np.mean([i in ids for i in good]) > 0.97
    assert np.mean([i in ids for i, q in labels.items() if q == 0]) < 0.1
    told = corpus_pipeline.language_stage(spark, kept, sf)
    assert told.columns == docs.columns and told.count() >= 0.99 * len(ids)
    copies = told.limit(200).unionByName(told.limit(50).withColumn("doc_id", F.col("doc_id") + 1_000_000))
    single = corpus_pipeline.dedup_stage(spark, copies, sf)
    left = {r.doc_id for r in single.select("doc_id").collect()}
    assert single.columns == docs.columns and max(left) < 1_000_000 and single.count() == len(left)
    packed = corpus_pipeline.packing_stage(spark, single, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == left


def test_pipeline_on_empty_and_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "123 !!", None, "s", 6), (None, "some words here", "en", "s", 15), (4, "x", "en", None, 1), (4, "x", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, given, SF).count() >= 0
    once = corpus_pipeline.dedup_stage(spark, docs, SF)
    assert sorted(r.doc_id for r in once.collect()) == [1, 3, 4]


def test_dedup_keeps_different_texts_under_one_id(spark):
    rows = [(1, "a text of its own that nobody else has"), (5, "the text of a copy that is here twice"), (5, "a unique text under a shared id, also kept"), (5, "a unique text under a shared id, also kept"), (2, "The text of a copy that is here twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted((r.doc_id, r.text) for r in corpus_pipeline.dedup_stage(spark, docs, SF).collect())
    assert left == [(1, rows[0][1]), (2, rows[4][1]), (5, rows[2][1])]
