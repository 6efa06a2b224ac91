"""Operators with exact results against brute force, and their edge cases."""

import re

import pytest
from pyspark.sql import functions as F

from admitflow.llm import blocks, components, decontamination, fingerprints, jaccard_join, line_dedup, substring_dedup
from tests.llm import corpus as C


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed):
    rows = C.random_corpus(seed)
    got = substring_dedup.dedup_substrings(C.docs(spark, rows)).collect()
    want = C.brute_substrings(rows)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == want
    assert sum(w[1] for w in want.values()) > 0


def test_substrings_edges(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(2, text), (2, text), (1, text), (None, text), (9, None), (None, None)]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring_dedup.dedup_substrings(C.docs(spark, rows)).collect())
    assert got == [("1", 30, 0), ("2", 30, 30), ("2", 30, 30), ("9", 0, 0), ("None", 0, 0), ("None", 30, 0)]
    assert substring_dedup.dedup_substrings(C.docs(spark, [])).count() == 0


def test_cover_aligns_all_shifts():
    for i in range(7):
        for j in range(7):
            assert any((i + d) % 7 in substring_dedup.COVER and (j + d) % 7 in substring_dedup.COVER for d in range(7))


def test_blocks_answer_in_order():
    import numpy as np
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    sent = blocks.send(3, 64, keys)
    flags = np.arange(1000) % 3 == 0
    assert (blocks.received(keys, 64, blocks.answer(sent, 1, flags), 1) == flags).all()


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard(spark, seed):
    rows = C.random_corpus(seed, n=70, words=60)
    got, links = jaccard_join.link_documents(C.docs(spark, rows))
    want, n = C.brute_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want
    assert n > 0


def test_jaccard_group_of_near_copies(spark):
    """Copies that differ by some words each: similar to few others, one chain."""
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in range(0, i // 6):
            w[(i * 7 + k * 31) % 150] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    got, links = jaccard_join.link_documents(C.docs(spark, rows))
    want, n = C.brute_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want
    assert links.count() < n


def test_jaccard_edges(spark):
    rows = [(5, "a b c d e f"), (4, "A b c d e f"), (5, "p q r s t u"), (8, "P q r s t u"), (None, "a b c d e f"), (7, None), (6, "")]
    got = jaccard_join.link_documents(C.docs(spark, rows))[0].collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == [
        ("4", 2, 4), ("5", 2, 4), ("5", 2, 4), ("6", 0, 6), ("7", 0, 7), ("8", 2, 4)]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert jaccard_join.link_documents(C.docs(spark, []))[0].count() == 0


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links, "a", "b").collect()}
    assert got == {**{k: 0 for k in range(201)}, 500: 500, 501: 500}
    assert components.components(links.limit(0), "a", "b").count() == 0


@pytest.mark.parametrize("seed", [5])
def test_lines(spark, seed):
    rows = C.random_corpus(seed)
    rows += [(1000 + k, f"Shared Line of text {k % 3}  \nown {k}\nshared line OF text 1\nshort\n") for k in range(20)]
    got = line_dedup.dedup_lines(C.docs(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got} == C.brute_lines(rows)


def test_lines_edges(spark):
    line = "a line that repeats"
    rows = [(None, line), (3, line), (3, line), (3, f"{line}\nother"), (4, f"{line}\n{line}"), (5, None)]
    got = line_dedup.dedup_lines(C.docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["n_dropped"], r["kept_text"]) for r in got) == [
        ("3", 0, line), ("3", 0, line), ("3", 0, f"{line}\nother"), ("4", 2, ""), ("5", 0, ""), ("None", 0, line)]
    maps = line_dedup.keep_bitmaps(C.docs(spark, [(1, f"{line}\n{line}x"), (2, f"q\n{line}\n{line}x\nz\n{line}")])).collect()
    assert [(r["doc"], r["n_dropped"], r["runs"]) for r in maps] == [(2, 3, [1, 2, 1, 1])]
    assert line_dedup.dedup_lines(C.docs(spark, [])).count() == 0


@pytest.mark.parametrize("slice_words", [1_000_000, 8])
def test_contamination(spark, monkeypatch, slice_words):
    rows = C.random_corpus(6)
    texts = [t for _, t in rows if t]
    items = [(k, " ".join(C.spaced(t)[3:20])) for k, t in enumerate(texts[:12])] + [(50, "one two"), (51, None), (52, "..."), (50, "日本x"), (None, texts[0])]
    rows += rows[:2]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "SLICE_WORDS", slice_words)
    got = decontamination.find_contamination(C.docs(spark, rows), bench).collect()
    want = C.brute_contamination(rows, [x for x in items if x[0] is not None])
    assert len(got) == len(rows)
    assert all((r["n_words"], sorted(r["hit_words"]), sorted(r["items"])) == want[r["doc_id"]] for r in got)
    assert any(r["items"] for r in got)


def test_contamination_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.find_contamination(C.docs(spark, [(1, "a b"), (None, None)]), none).collect()
    assert sorted((r["n_words"], r["hit_words"], r["items"]) for r in got) == [(0, [], []), (2, [], [])]
    assert decontamination.find_contamination(C.docs(spark, []), none).count() == 0


def brute_winnow(text, k=fingerprints.K, window=fingerprints.WINDOW):
    """Positions that winnowing must choose, over any total order of gram hashes."""
    tokens = re.findall(r"[^ \t\n\x0b\f\r]{1,12}", text or "")
    return [tuple(tokens[i:i + k]) for i in range(max(1, len(tokens) - k + 1))] if tokens else []


def test_winnowing(spark):
    rows = [(i, t) for i, t in C.random_corpus(7) if i is not None]
    df = fingerprints.winnow(C.docs(spark, rows), "text", "fp")
    got = df.select("text", F.transform("fp", lambda e: F.struct(fingerprints.entry_hash(e).alias("h"), fingerprints.entry_position(e).alias("p"))).alias("fp")).collect()
    seen = {}
    for r in got:
        grams = brute_winnow(r["text"])
        entries = [(e["h"], e["p"]) for e in r["fp"]]
        assert len(set(entries)) == len(entries) and all(p < len(grams) for _, p in entries)
        for h, p in entries:
            assert seen.setdefault(grams[p], h) == h
        at = [p for _, p in entries]
        assert at == sorted(at) and bool(at) == bool(grams)
        if len(grams) >= fingerprints.WINDOW:  # every window holds a chosen gram
            assert all(any(s <= p < s + fingerprints.WINDOW for p in at) for s in range(len(grams) - fingerprints.WINDOW + 1))
    # the minimum of each window, rightmost on ties, on texts whose gram hashes are known
    for r in got:
        grams = brute_winnow(r["text"])
        known = [seen.get(g) for g in grams]
        if grams and all(h is not None for h in known):
            w = min(fingerprints.WINDOW, len(known))
            want = {max(p for p in range(s, s + w) if known[p] == min(known[s:s + w])) for s in range(len(known) - w + 1)}
            assert {e["p"] for e in r["fp"]} == want


def test_fingerprint_documents(spark):
    rows = C.random_corpus(8) + [(None, "no id at all"), (3, "twice"), (3, "twice")]
    got = fingerprints.fingerprint_documents(C.docs(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, follow = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        want.append((i, t, t[:len(t) - q] + follow[:q]))
    assert sorted(((r["doc_id"], r["text"], r["edited"]) for r in got), key=str) == sorted(want, key=str)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r["text"], r["fp"]) == r["fp"]
    assert fingerprints.fingerprint_documents(C.docs(spark, [])).count() == 0
    one = fingerprints.fingerprint_documents(C.docs(spark, [(1, "abcd efgh")])).collect()
    assert [r["edited"] for r in one] == ["abcd efab"]


def test_likeness(spark):
    row = spark.sql("SELECT array(1L, 2L, 3L) AS a, array(2L, 3L, 4L) AS b, array() AS n").select(
        fingerprints.likeness(F.col("a"), F.col("b")).alias("x"), fingerprints.likeness(F.col("n"), F.col("n")).alias("y"),
        fingerprints.likeness(F.col("a"), F.col("n")).alias("z")).first()
    assert (row["x"], row["y"], row["z"]) == (0.5, 1.0, 0.0)


@pytest.mark.parametrize("signs", ["日本語文章東京大学研究者発表新資料", "กขคงจฉชซฌญฎฏฐฑฒณดตถท", "abcdefghijklmnopqrstuvwxyzABCDEFG0123456789+/", "0123456789abcdef"])
def test_long_runs_do_not_depend_on_where_they_start(spark, signs):
    import random
    rng = random.Random(9)
    run = lambda n: "".join(rng.choice(signs) for _ in range(n))
    base, shared = run(400), run(60)
    pairs = [(base, "x" + base), (base, signs[0] + base), (run(41) + shared + run(30), run(52) + shared + run(7))]
    df = fingerprints.winnow(fingerprints.winnow(spark.createDataFrame(pairs, "a string, b string"), "a", "fa"), "b", "fb")
    fa, fb = fingerprints.hashes(F.col("fa")), fingerprints.hashes(F.col("fb"))
    near = df.select(fingerprints.likeness(fa, fb).alias("near"), F.size(F.array_intersect(fa, fb)).alias("n")).collect()
    assert near[0]["near"] > 0.9 and near[1]["near"] > 0.9 and near[2]["n"] >= 3


@pytest.mark.parametrize("block", [3, 8])
def test_jaccard_in_blocks(spark, monkeypatch, block):
    """Tokens with many entries are dealt out; the result stays exact."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "LEAST_COUNT", 2)
    groups = []
    whole = jaccard_join._pairs_of_groups
    monkeypatch.setattr(jaccard_join, "_pairs_of_groups", lambda placed, *a: groups.append(placed) or whole(placed, *a))
    base = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(50):
        w = list(base) + [f"t{i % 3}_{k}" for k in range(i % 5 * 6)]
        for k in range(i % 9):
            w[(i * 7 + k * 31) % 90] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    rows += [(100 + k, " ".join(base[:40] + [f"y{k}_{j}" for j in range(50)])) for k in range(4)]
    got, _ = jaccard_join.link_documents(C.docs(spark, rows))
    want, _ = C.brute_components(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == want
    most = [df.groupBy("bucket", "token").count().agg(F.max("count").alias("m")).first()["m"] for df in groups[1::2]]
    assert len(groups) == 4 and max(m or 0 for m in most) <= 8 * block


def test_walk_steps_over_one_component():
    import numpy as np
    m = 30_000
    comp = np.zeros(m, np.int64)
    comp[m // 2] = 1
    n, zero = np.full(m, 100), np.zeros(m, np.int64)
    pairs = jaccard_join._walk(zero, np.arange(m), n, zero, comp, np.zeros((m, jaccard_join.SIGNATURE), np.uint64), 80, True)
    assert len(pairs) == m - 1 and (pairs == m // 2).any(axis=1).all()
