"""Operators on whole documents against brute force: quality, substring, decontamination, scoring, near-duplicates, licences."""

import collections
import hashlib
import math
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gneiss.llm import decontaminate, extract, hashing, licenses, neardup, ppm, quality, substring

from .conftest import records

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


# quality rules


def base(text):
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    three = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in range(3)}
    n, repeat = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, n < 50 or 100 * repeat > 50 * n


def test_quality_counts(awkward, empty):
    got = quality.quality_rules(awkward, keep=["doc_id", "text"])
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text or "")
        assert not (r.base_failed and r.kept)
    assert got.count() == awkward.count()
    assert quality.quality_rules(empty, keep=["doc_id"]).count() == 0


def least_determinant(x, floors, cover, tries=150):
    """An independent search: C-steps on sorted distances from random elemental starts and a median start; (log determinant, d2)."""
    rng, ridge, h, best = np.random.default_rng(0), np.diag(np.square(floors)), int(np.ceil(cover * len(x))), None
    factor = quality.consistency(cover, x.shape[1])
    for t in range(tries):
        pick = x[rng.choice(len(x), size=min(len(x), 6), replace=False)] if t else x[np.argsort(np.abs(x - np.median(x, 0)).sum(1))[: len(x) // 2]]
        centre, cov = pick.mean(0), np.cov(pick.T, bias=True) + ridge
        for _ in range(30):
            d2 = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            core = x[np.argsort(d2, kind="stable")[:h]]
            centre, cov = core.mean(0), np.cov(core.T, bias=True) * factor + ridge
        log_det = np.log(np.linalg.det(cov)) / 2
        if best is None or log_det < best[0]:
            best = log_det, np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
    return best


def test_consistency_factor():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200_000, 4))
    near = x[np.argsort((x**2).sum(1))[:120_000]]
    assert quality.consistency(0.6, 4) == pytest.approx(1 / near.var(0).mean(), rel=0.02)


@pytest.mark.parametrize("share", [0.05, 0.2, 0.33])
def test_quality_estimates_have_the_least_determinant(spark, share):
    """Groups with a share of outliers that form a cluster of their own, half of them copies of one text, against an independent search."""
    rng, rows = np.random.default_rng(int(100 * share)), []
    floors = list(quality.FLOORS.values())
    for group in range(6):
        n = 300
        x = rng.normal(size=(n, 4)) @ np.diag([0.2, 0.5, 0.2, 0.2]) @ (np.eye(4) + 0.3 * rng.random((4, 4)))
        bad = int(share * n)
        x[:bad] = rng.normal(size=(bad, 4)) * 0.05 + [5.0, 10.0, 4.0, 4.0]
        x[: bad // 2] = x[0]
        rows += [("v" + str(group), "vs", False, i < bad, *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, f"g_lang string, g_source string, base_failed boolean, bad boolean, {', '.join(f'{c} double' for c in quality.FLOORS)}")
    est = quality.fit(df)
    found = {r.g_lang: r.log_det for r in est.collect()}
    judged = quality.judge(df, est).toPandas()
    for lang, own in judged.groupby("g_lang"):
        log_det, d2 = least_determinant(own[list(quality.FLOORS)].to_numpy(), floors, quality.COVER)
        assert found[lang] <= log_det + 0.1
        assert not own.kept[own.bad].any()
        assert own.kept[~own.bad].mean() > 0.98 and (own.kept == (d2 <= quality.CUTOFF)).mean() > 0.97


def test_overlapping_outliers_flip_no_verdict(spark):
    """Groups of hundreds and thousands with a quarter to 38 % of outliers close by, against an independent search from many starts."""
    rng, rows, floors = np.random.default_rng(7), [], list(quality.FLOORS.values())
    for group in range(10):
        n = (300, 2000)[group % 2]
        x = rng.normal(size=(n, 4)) @ np.diag([0.2, 0.5, 0.2, 0.2]) @ (np.eye(4) + 0.3 * rng.random((4, 4)))
        bad, way = int(rng.uniform(0.25, 0.38) * n), rng.normal(size=4)
        x[:bad] = x[:bad] * rng.uniform(0.1, 1) + rng.uniform(0.8, 2) * way / np.linalg.norm(way)
        rows += [("v" + str(group), "vs", False, i < bad, *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, f"g_lang string, g_source string, base_failed boolean, bad boolean, {', '.join(f'{c} double' for c in quality.FLOORS)}")
    est = quality.fit(df)
    found = {r.g_lang: r.log_det for r in est.collect()}
    for lang, own in quality.judge(df, est).toPandas().groupby("g_lang"):
        log_det, d2 = least_determinant(own[list(quality.FLOORS)].to_numpy(), floors, quality.COVER, tries=60)
        assert found[lang] <= log_det + 0.05
        assert (own.kept == (d2 <= quality.CUTOFF)).mean() > 0.95
        assert abs(own.kept[own.bad].mean() - (d2 <= quality.CUTOFF)[own.bad.to_numpy()].mean()) < 0.2


def test_elemental_starts_take_different_vectors(spark):
    df = spark.range(3000).selectExpr("'v' AS g_lang", "'s' AS g_source", "IF(id < 1500, 0D, id / 10D) AS x_len", "IF(id < 1500, 0D, id % 7 + 0D) AS x_sym", "0D AS x_dup", "0D AS x_rep")
    every = df.groupBy("g_lang", "g_source").agg(F.count(F.lit(1)).alias("n"))
    got = quality._elements(df, every, list(quality.FLOORS)).toPandas()
    assert got.start.nunique() >= quality.ELEMENTAL - 2 and got.groupby("start").size().max() == quality.ELEMENT
    assert not got.duplicated().any() and (got.x_len == 0).mean() < 0.1


def test_quality_rejects_junk_texts(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(600):
        good = i % 7 != 0
        body = " ".join("".join(rng.choice(list("abcdefghij"), size=rng.integers(3, 8))) for _ in range(rng.integers(60, 200)))
        rows.append((i, body if good else body.replace(" ", "*** "), ("en", "de")[i % 2], "s"))
    junk = " ".join(f"x{i} ###" for i in range(80))
    rows += [(600 + i, junk, "en", "s") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = quality.quality_rules(df, keep=["doc_id", "lang"]).toPandas()
    assert (got.kept.to_numpy() == ((got.doc_id.to_numpy() % 7 != 0) & (got.doc_id.to_numpy() < 600))).all()


# hashes and substring dedup


def test_hashes_do_not_depend_on_chunks():
    import pyarrow as pa

    column = pa.array(["one two  three", None, "", "three one", " \n", "two" * 900_000 + " one", "one"])
    found = {}
    for lo, _, data, offsets in hashing.chunks(column):
        starts, ends, row = hashing.spans(data, offsets)
        for h, r, a, b in zip(hashing.word_hashes(data, starts, ends), row, starts, ends, strict=True):
            found.setdefault(data[a:b].tobytes()[:20], set()).add((int(h), lo + r < 0))
    assert all(len(x) == 1 for x in found.values()) and len({h for x in found.values() for h, _ in x}) == len(found)


def removed(docs, size):
    first, gone = {}, {}
    for doc, text in sorted((d for d in docs if d[0] is not None), key=lambda x: x[0]):
        w = words(text)
        for i in range(len(w) - size + 1):
            at = first.setdefault(tuple(w[i : i + size]), (doc, i))
            if at < (doc, i):
                gone.setdefault(doc, set()).update(range(i, i + size))
    return gone


@pytest.mark.parametrize("size", [3, 20])
def test_substring_dedup(awkward, empty, size):
    docs = texts(awkward)
    gone = removed(docs, size)
    want = []
    for doc, text in docs:
        w = words(text)
        cut = gone.get(doc, set()) if doc is not None else set()
        kept = " ".join(x for i, x in enumerate(w) if i not in cut)
        want.append((doc, len(w), len(cut), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in substring.remove_repeats(awkward, size).drop("kept_text").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert substring.remove_repeats(empty, size).count() == 0


def test_small_blocks_and_batches_lose_nothing(awkward, monkeypatch):
    want = sorted(map(tuple, substring.remove_repeats(awkward, 4).collect()), key=repr)
    monkeypatch.setattr(substring, "CELLS_IN_BLOCK", 1 << 10)
    monkeypatch.setattr(substring, "HELD", 500)
    assert sorted(map(tuple, substring.remove_repeats(awkward, 4).collect()), key=repr) == want


def test_share_of_windows_that_pass_does_not_grow_with_the_text(spark, monkeypatch):
    """Texts without a repeat, ten times as many: the share of anchors estimated repeated stays (the blocks are small, so that there are many)."""
    monkeypatch.setattr(substring, "CELLS_IN_BLOCK", 1 << 12)
    shares = []
    for n in (200, 2000):
        rng = np.random.default_rng(n)
        rows = [(i, " ".join(f"w{x}" for x in rng.integers(1 << 40, size=400))) for i in range(n)]
        texts_ = substring.bucketed(spark.createDataFrame(rows, "doc_id bigint, text string"), [])
        found = substring.repeated_anchors(texts_, 20).selectExpr("sum(aggregate(residues, 0, (n, x) -> n + octet_length(x)))").first()[0] or 0
        shares.append(found / 4 / (n * 400 / 7))
    assert shares[1] < 1.5 * shares[0] and shares[1] < 0.15


def alternating(n):
    """A word that a power sum modulo 2**64 can't tell from its complement, and that complement."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096, 65536])
def test_structured_words_are_told_apart(spark, n):
    x, y = alternating(n)
    plain = [f"p{i}" for i in range(19)]
    rows = [(1, " ".join([x, *plain])), (2, " ".join([y, *plain])), (6, f"{x} {y}")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(df).collect()} == {1: 0, 2: 0, 6: 0}
    many = spark.createDataFrame([(i, " ".join([w] * 3)) for i, w in enumerate((x, y))], "doc_id bigint, text string")
    assert all(r.kept for r in neardup.near_duplicates(many).collect())
    scored = {r.doc_id: r for r in ppm.score(df).collect()}
    held = [i for i in (1, 2, 6) if ppm.is_held_out(i)]
    known = set().union(*({*t.split()} for i, t in rows if i not in held))
    assert all(scored[i].n_known == 1 + sum(w in known for w in t.split()) for i, t in rows)


def test_texts_that_share_a_doc_id_are_told_apart(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a, "x"), (5, a, "y"), (5, b, "y"), (7, b + " z", "z"), (7, b + " z", "z"), (None, b, "n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, first string")
    left = sorted((r.doc_id, r.text) for r in neardup.without_near_duplicates(df).where("doc_id IS NOT NULL").collect())
    assert left == [(1, a), (5, b)] and neardup.without_near_duplicates(df).where("doc_id IS NULL").count() == 1
    again = neardup.without_near_duplicates(spark.createDataFrame([(3, a, "q")] * 3, df.schema)).collect()
    assert [tuple(r) for r in again] == [(3, a, "q")]
    got = sorted(tuple(r) for r in substring.remove_repeats(df.where("doc_id = 5 OR doc_id = 7"), 20).select("doc_id", "n_words", "n_removed").collect())
    assert got == [(5, 30, 0), (5, 30, 0), (7, 31, 30), (7, 31, 30)]


# near-duplicates


def components(docs, size=5, percent=75):
    sets = {}
    for doc, text in docs:
        w = text.encode().translate(LOWER).split()
        sets[doc] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def check_components(df):
    want = components([d for d in texts(df) if d[0] is not None])
    for r in neardup.near_duplicates(df).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_near_duplicates(awkward, empty):
    check_components(awkward)
    assert neardup.near_duplicates(empty).count() == 0


def test_chains_of_near_copies(spark, monkeypatch):
    """Copies of copies, dealt over several blocks, so that most links cross blocks and no hub is near to all."""
    rng = np.random.default_rng(4)
    rows = [(0, [f"w{i}" for i in range(90)])]
    for i in range(1, 150):
        w = list(rows[int(rng.integers(len(rows)))][1])
        for _ in range(int(rng.integers(1, 4))):
            w[int(rng.integers(len(w)))] = f"x{rng.integers(1 << 30)}"
        rows.append((i, w))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string").repartition(7)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 20)
    check_components(df)


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(0)
    x = rng.integers(1 << 63, size=400, dtype=np.uint64)
    y = np.concatenate((x[:300], rng.integers(1 << 63, size=100, dtype=np.uint64)))
    signs = neardup.signatures(np.repeat([0, 1], 400), np.concatenate((x, y)), 2, 1)
    assert abs((signs[0] == signs[1]).mean() - 0.6) < 0.15
    once = np.random.default_rng(1).permutation(neardup.UNIVERSE)
    place = (hashing.mix(x, 1) & np.uint64(neardup.UNIVERSE - 1)).astype(np.int64)
    assert [int(once[(place + k) % neardup.UNIVERSE].min()) for k in range(5)] == signs[0][:5].tolist()


# decontamination


def test_decontamination_finds_edited_items_and_leaves_others(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"v{i}" for i in range(400)]
    text = lambda n: list(rng.choice(vocabulary, size=n))
    items = [(i, text(int(rng.integers(12, 60)))) for i in range(30)] + [(90, ["too", "few"]), (91, [])]
    docs, planted = [], {}
    for i in range(240):
        body = text(80)
        if i % 2:
            item_id, item = items[i % 30]
            item, k = list(item), int(rng.integers(0, decontaminate.allowed(len(item)) // 2 + 1))
            for _ in range(k):
                p = int(rng.integers(len(item)))
                item[p : p + int(rng.integers(0, 2))] = ["new"] * int(rng.integers(0, 2))
            body[40:40] = [w.upper() + "," for w in item]
            planted[i] = item_id
        docs.append((i, " ".join(body), "c"))
    docs += [(500, None, "c"), (501, "", "c"), (None, " ".join(items[3][1]), "c"), (502, " ".join(items[3][1][:-1]), "c")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    b = spark.createDataFrame([(i, " ".join(w), "c") for i, w in items] + [(None, None, "c")], "item_id bigint, text string, doc_id string")
    got = decontaminate.leaks(d, b).toPandas()
    pairs = {(r.doc_id, r.item_id) for r in got.itertuples()}
    assert {(i, x) for i, x in planted.items()} <= pairs | set()
    assert all(r.doc_id in planted or r.doc_id in (502,) or r.doc_id != r.doc_id for r in got.itertuples())
    assert 502 in set(got.doc_id) and got.doc_id.isna().sum() == 1
    assert decontaminate.leaks(d.limit(0), b).count() == 0 and decontaminate.leaks(d, b.limit(0)).count() == 0


@pytest.mark.parametrize("n", [5, 7, 9, 10, 16, 19, 20, 29, 46, 59, 80, 150, 400])
def test_walks_reach_their_recall(n):
    """At all allowed edits, by length and kind of edit; the walks alone, without the verification."""
    rng, tries, k = np.random.default_rng(n), 40, decontaminate.allowed(n)
    for kind in (0, 1, 2, None):
        hits = 0
        for _ in range(tries):
            item = rng.integers(1 << 60, size=n).astype(np.uint64)
            copy = item.tolist()
            for _ in range(k):
                p, now = int(rng.integers(len(copy))), int(rng.integers(3)) if kind is None else kind
                copy[p : p + (now != 2)] = [] if now == 1 else [int(rng.integers(1 << 60))]
            doc = np.concatenate((rng.integers(1 << 60, size=6), np.array(copy), rng.integers(1 << 60, size=n))).astype(np.uint64)
            found = False
            for at, m in decontaminate.pieces(n):
                starts = np.arange(max(0, 6 + at - k), min(len(doc), 6 + at + k + 1))
                own = decontaminate.walk_keys(item[at : at + m], np.zeros(1, np.int64), np.full(1, m), m)
                found |= bool((own == decontaminate.walk_keys(doc, starts, np.minimum(starts + m, len(doc)), m)).any())
            hits += found
        assert hits >= 0.9 * tries


def test_walks_of_other_texts_seldom_meet():
    rng, hits = np.random.default_rng(1), 0
    for n in (10, 15, 19) * 20:
        x, y = (rng.integers(1 << 60, size=n).astype(np.uint64) for _ in range(2))
        hits += (decontaminate.walk_keys(x, np.zeros(1, np.int64), np.full(1, n), n) == decontaminate.walk_keys(y, np.zeros(1, np.int64), np.full(1, n), n)).any()
    assert hits == 0


def test_a_common_pair_takes_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    items = [" ".join(f"w{x}" for x in rng.integers(5000, size=8)) + " of the " + " ".join(f"w{x}" for x in rng.integers(5000, size=8)) for _ in range(2000)]
    text = ("of the end " * 11_000 + items[700] + " of the").strip()
    made = decontaminate.Items(items)
    tracemalloc.start()
    found = [x for _, _, words, row in decontaminate.word_arrays(pa.array(["", text])) for x in made.leaked(words, row)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(1, 700)] and peak < 200 << 20


@pytest.mark.parametrize("shape", ["prefix", "middle", "alike"])
def test_items_that_share_most_of_their_words(shape):
    """Thousands of items made by one template, and a document that holds hundreds of them."""
    import time
    import tracemalloc

    rng, many = np.random.default_rng(5), 20_000 if shape != "alike" else 400
    shared = "which of the following statements about this topic is true"
    own = lambda n: " ".join(f"w{x}" for x in rng.integers(50_000, size=n))
    items = [f"{shared} {own(10)}" if shape == "prefix" else f"{own(5)} {shared} {own(5)}" if shape == "middle" else f"{shared} {shared[::-1]} {own(1)}" for _ in range(many)]
    made = decontaminate.Items(items)
    planted = rng.choice(many, size=2000 if shape != "alike" else 40, replace=False).tolist()
    text = " ".join(f"{own(3)} {items[i]}" for i in planted)
    tracemalloc.start()
    began = time.perf_counter()
    found = {i: d for _, _, words, row in decontaminate.word_arrays(pa.array(["", text])) for (_, i), d in made.leaked(words, row).items()}
    took, peak = time.perf_counter() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {i for i, d in found.items() if d == 0} >= set(planted) and peak < 300 << 20 and took < 60
    assert len(found) == (many if shape == "alike" else len(planted))


def test_rare_pairs_lose_no_leak():
    """Runs found from the rarest pairs alone hold every stretch within the allowed edits, repeated words included."""
    rng = np.random.default_rng(12)
    for _ in range(60):
        texts = [" ".join(map(str, rng.integers(rng.choice([3, 8, 40]), size=int(rng.integers(5, 40))))) for _ in range(6)]
        made = decontaminate.Items(texts)
        doc = []
        for t in texts:
            copy = t.split()
            for _ in range(decontaminate.allowed(len(copy))):
                q = int(rng.integers(len(copy)))
                copy[q : q + int(rng.integers(0, 2))] = [str(rng.integers(60))] * int(rng.integers(0, 2))
            doc += [str(x) for x in rng.integers(60, size=5)] + copy
        for _, _, words, row in decontaminate.word_arrays(pa.array([" ".join(doc)])):
            runs = {i for _, i, _, _ in made.runs(words, row).tolist()}
            for i, w in enumerate(made.words):
                if decontaminate.edits(w, words) <= decontaminate.allowed(len(w)):
                    assert i in runs


@pytest.mark.parametrize("n", [5, 50, 100, 200, 400])
def test_every_allowed_leak_is_found(n):
    rng, k = np.random.default_rng(n), decontaminate.allowed(n)
    words = lambda m: rng.choice(5000, size=m).tolist()
    for kind in ("insert", "delete", "replace", "mixed"):
        for t in range(20):
            item = words(n)
            copy, now = list(item), kind
            for _ in range(k):
                now = ("insert", "delete", "replace")[int(rng.integers(3))] if kind == "mixed" else kind
                p = int(rng.integers(len(copy)))
                copy[p : p + (now != "insert")] = [] if now == "delete" else words(1)
            items = decontaminate.Items([" ".join(map(str, x)) for x in (words(n), item)])
            shared = type("Shared", (), {"value": ([1, 2], items)})
            doc = " ".join(map(str, words(t) + copy + words(n) + (copy if t % 2 else [])))
            rows = [x for out in decontaminate._finder(shared)([pa.record_batch([pa.array([7]), pa.array([doc])], ["doc_id", "text"])]) for x in out.to_pylist()]
            assert [(r["doc_id"], r["item_id"], r["item_words"]) for r in rows] == [(7, 2, n)] and rows[0]["edit_distance"] <= k


def test_edits_match_the_plain_table():
    rng = np.random.default_rng(3)
    for _ in range(300):
        item, words = (rng.integers(5, size=int(rng.integers(0, 80))).astype(np.uint64) for _ in range(2))
        best = [0] * (len(words) + 1)
        for i, a in enumerate(item):
            now = [i + 1]
            for j, b in enumerate(words):
                now.append(min(best[j] + int(a != b), best[j + 1] + 1, now[j] + 1))
            best = now
        assert decontaminate.edits(item, words) == min(best)


def test_edits():
    a = lambda s: np.array([ord(c) for c in s], dtype=np.uint64)
    assert decontaminate.edits(a("abcdef"), a("xxabcdefyy")) == 0
    assert decontaminate.edits(a("abcdef"), a("xxabXdefyy")) == 1
    assert decontaminate.edits(a("abcdef"), a("xxabdeyy")) == 2
    assert decontaminate.edits(a("abc"), a("")) == 3


# language model


def test_scoring_matches_brute_force(awkward, empty):
    rows = [(d, t.encode().translate(LOWER)) for d, t in texts(awkward)]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    count, grams, order = collections.Counter(), collections.defaultdict(collections.Counter), ppm.ORDER
    for d, t in rows:
        if not held(d):
            count.update([*t.split(), None])
            b = b"\xff" * order + t + b"\xff"
            for p in range(order, len(b)):
                for k in range(order + 1):
                    grams[b[p - k : p]][b[p]] += 1
    total = sum(count.values())

    def score(t):
        b, out = b"\xff" * order + t + b"\xff", 0.0
        for p in range(order, len(b)):
            gone = set()
            for k in range(order, -1, -1):
                left = {s: n for s, n in grams.get(b[p - k : p], {}).items() if s not in gone}
                every, fresh = sum(left.values()), len(left)
                if b[p] in left:
                    out += math.log10(left[b[p]] / (every + fresh))
                    break
                out += math.log10(fresh / (every + fresh)) if fresh else 0
                gone |= set(left)
            else:
                out -= math.log10(256 - len(gone))
        return out

    want = []
    for d, t in rows:
        w = [*t.split(), None]
        want.append((d, held(d), len(w), sum(count[x] > 0 for x in w), total, sum(math.log10((count[x] + 0.5) / (total + 0.5 * (len(count) + 1))) for x in w), score(t)))
    got = [tuple(r) for r in ppm.score(awkward).collect()]
    order_by = lambda r: (repr(r[0]), r[2], round(r[6], 6))
    for x, y in zip(sorted(got, key=order_by), sorted(want, key=order_by), strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], rel=1e-9)
    assert ppm.score(empty).count() == 0


def test_rare_words_and_grams_by_join(awkward, monkeypatch):
    whole = ppm.score(awkward).orderBy("doc_id", "score").toPandas()
    monkeypatch.setattr(ppm, "MAX_HEAD", 20)
    rare = ppm.score(awkward).orderBy("doc_id", "score").toPandas()
    assert np.allclose(whole.base_score, rare.base_score) and (whole.n_known == rare.n_known).all()
    for most in (300, 0):
        monkeypatch.setattr(ppm, "MAX_GRAMS", most)
        small = ppm.score(awkward).orderBy("doc_id", "score").toPandas()
        assert np.allclose(whole.score, small.score, rtol=1e-9)


def test_trie_probabilities_sum_to_one():
    texts_ = [b"abracadabra", b"abcab", b"cab"]
    keys = np.concatenate([ppm.gram_keys(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 3)[0] for t in texts_])
    levels = []
    for d in range(4):
        levels.append(np.unique(keys & np.uint64((1 << 8 * (d + 1)) - 1), return_counts=True))
    trie = ppm.Trie([(k, n.astype(float)) for k, n in levels])
    for context in (b"abr", b"zzz", b"\xff\xff\xff", b"cab"):
        base_key = int.from_bytes(context, "big") << 8
        assert (10 ** trie.log10(np.arange(256, dtype=np.uint64) + np.uint64(base_key))).sum() == pytest.approx(1)


# licences


def test_licences(awkward, empty, spark):
    mit = licenses.TEMPLATES[0][2]
    rows = [(20, "Foo 1.0\n\n" + mit + "\n\nThe end of it."), (21, "text\nReleased under the MIT License.\nmore text"), (22, mit.replace("free of charge", "at no cost").upper()), (23, "nothing of the kind"), (24, None), (25, "x")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.license_id) for r in got} == {(20, "MIT"), (21, "MIT"), (22, "MIT")}
    assert {r.doc_id: r.dice_permille for r in got}[20] == 1000
    assert licenses.scan(empty).count() == 0 and licenses.scan(awkward).count() == 0


@pytest.mark.parametrize("piece", ["of the\n\n", "of the\n\nin the\n\nand the\n\nto the\n\nany of\n\n"])
def test_texts_of_short_paragraphs_take_time_in_proportion(spark, piece):
    import time

    mit = paragraphs_of(licenses.TEMPLATES[0][2])
    took = []
    for n in (4_000, 16_000):
        body = piece * (n // len(piece))
        df = spark.createDataFrame([(1, f"{mit}\n\n{body}"), (2, f"{body}\n\n{mit}\n\n{body}"), (3, body)], "doc_id bigint, text string").repartition(3)
        began = time.perf_counter()
        got = {(r.doc_id, r.license_id): r.dice_permille for r in licenses.scan(df).collect()}
        took.append(time.perf_counter() - began)
        assert got == {(1, "MIT"): 1000, (2, "MIT"): 1000}
    assert took[1] < 60


def test_runs_of_repeated_paragraphs(spark, sql):
    """Copies in a row, long repeats between the parts of a licence, and runs at the bound, against the SQL."""
    from gneiss.llm import queries

    parts = paragraphs_of(licenses.TEMPLATES[0][2]).split("\n\n")
    filler = "\n\n".join(["of the software"] * 30)
    texts = ["\n\n".join(x) for x in ([*parts, *parts], [parts[0]] * 5 + parts[1:], [parts[0], filler, *parts[1:]], [parts[0], "a b " * 300, *parts[1:]], [filler, *parts, filler], ["in the"] * 40 + parts)]
    docs = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = sql(queries.ORACLE_SQL["op2_license_scan"], documents=pd.DataFrame(docs, columns=["doc_id", "text"]))
    assert records(licenses.scan(df)) == records(want) and len(want) >= 5


def test_size_bounds_admit_every_match():
    for _, _, text in licenses.TEMPLATES:
        n = len(licenses.bigrams_of(text))
        fits = [m for m in range(1, 4 * n) if 2000 * min(m, n) // (m + n) >= 10 * licenses.LEAST]
        low, high, shared = licenses.bounds(n)
        assert (low, high) == (fits[0], fits[-1])
        assert all(2000 * (shared - 1) // (m + n) < 10 * licenses.LEAST for m in fits)


def test_units_without_the_needed_words_match_nothing():
    every = set(licenses.needed())
    for _, _, text in licenses.TEMPLATES:
        pairs = licenses.bigrams_of(text)
        left = [p for p in pairs if every.isdisjoint(p.split())]
        assert len(left) < licenses.bounds(len(pairs))[2]


def paragraphs_of(text):
    """The published layout: a paragraph for each numbered clause, and for what is written in capitals."""
    return re.sub(r" (?=\d\. [A-Z]|THE SOFTWARE IS|THIS SOFTWARE IS|The above copyright notice and)", "\n\n", text)


def test_licences_of_several_paragraphs_inside_long_texts(spark):
    rng = np.random.default_rng(6)
    filler = lambda: "\n\n".join(" ".join(f"w{x}" for x in rng.integers(100_000, size=40)) for _ in range(10))
    wanted = {i: (name, text) for i, (name, kind, text) in enumerate(licenses.TEMPLATES) if kind == "text"}
    rows = [(i, filler() + "\n\n" + paragraphs_of(text) + "\n\n" + filler()) for i, (_, text) in wanted.items()]
    assert sum("\n\n" in paragraphs_of(text) for _, text in wanted.values()) >= 5
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    best = {}
    for r in got:
        best.setdefault(r.doc_id, []).append((r.dice_permille, r.license_id))
    assert {i: max(x) for i, x in best.items()} == {i: (1000, name) for i, (name, _) in wanted.items()}


def test_versions_and_variants_are_told_apart(spark):
    rows = [(i, f"some text here\n{text}\nand more of it") for i, (_, kind, text) in enumerate(licenses.TEMPLATES) if kind == "notice"]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.license_id) for r in got) == [(i, licenses.TEMPLATES[i][0]) for i, _ in rows]


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p>"; if (1 < 2) x();</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><header><h1>Head&amp;line</h1></header><p>First <b>para</b>graph of the text.<br>Next&nbsp;line &lt;here&gt;.</p><aside>Side</aside><form><label>Mail</label><input></form>
<p>short</p><div class="related"><p>See also</p></div><blockquote>Quoted &#233;</blockquote><section class="comments"><p>I disagree.</p></section></article><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert extract.main_text(PAGE)[0] == "Head&line First paragraph of the text. Next line <here>. short Quoted é"
    assert all(extract.main_text(x)[0] == "" for x in (None, "", "<nav>only a menu"))


def test_pages_without_an_article():
    good = "<p>" + "It is one of the things that they say is in the book and it was for the best of us all. " * 4 + "</p>"
    page = f"<div id='menu'><a href='a'>One</a> <a href='b'>Two</a></div><h2>The heading</h2>{good}<p>And so on.</p>{good}<p><a href='x'>More</a> links</p><p>xyz</p>"
    text, _ = extract.main_text(page)
    assert text.startswith("The heading It is one") and "And so on." in text and "More" not in text and "One" not in text and "xyz" not in text


RUSSIAN = "Старый мост соединял два берега широкой реки, и каждое утро рыбаки выходили на него задолго до рассвета, чтобы занять лучшие места у перил. "
JAPANESE = "川沿いの古い町では毎朝早くから市場が開き、近くの村から来た人々が野菜や魚を並べて客を待っていた。"


@pytest.mark.parametrize("text", [RUSSIAN * 3, JAPANESE * 2, "Just a short note.", "Gwlad yr iaith Gymraeg ydyw hon, gydag afonydd llydain, mynyddoedd uchel, pentrefi bychain, ffermydd hynafol. " * 2, "the cat is on the mat " * 20, "日本"])
def test_pages_without_an_article_keep_their_text(text):
    want = " ".join(text.split())
    assert extract.main_text(f"<body><div>{text}</div></body>")[0] == want
    page = f"<nav><a href='/'>Menu</a></nav><ul><li><a href='/a'>One link</a></li><li><a href='/b'>Two links</a></li></ul><div>{text}</div><div>{text}</div><footer>{text}</footer><form>{text}</form>"
    assert extract.main_text(page)[0] == f"{want} {want}"


def test_marks_are_outvoted_where_nothing_else_is_text():
    long = "It was one of the best of the books that they had in the house, and he read it to her on the first day of the year. " * 3
    assert extract.main_text(f"<div class='widget'><p>{long}</p><p>Short.</p></div>")[0] == long.strip()
    assert extract.main_text(f"<div class='widget'><p>{long}</p></div><p>{long}</p>")[0] == long.strip()
    assert extract.main_text(f"<div class='cookie'>Cookies?</div><nav>{long}</nav>")[0] == ""


class PlainReader(HTMLParser):
    """Blocks of a well-formed page by the parser of the standard library: (text, characters in links, names and marks of what holds it, is it a heading)."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.path, self.found, self.text, self.linked, self.hidden, self.heading = [], [], "", "", 0, False
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        if self.text.split():
            self.found.append((" ".join(self.text.split()), len(self.linked), list(self.path), self.heading))
        self.text = self.linked = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title", "textarea"):
            self.hidden += 1
        elif tag in extract.BLOCK:
            self.cut()
            self.heading = tag in extract.HEADING
        if tag in extract.NESTED:
            self.path.append((tag, {w for _, v in attrs if _ in ("class", "id", "role") for x in (v or "").lower().split() for w in (x, *x.split("-"))}))
        if tag == "a":
            self.path.append(("a", set()))

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title", "textarea"):
            self.hidden -= 1
        elif tag in extract.BLOCK:
            self.cut()
            self.heading = False
        if tag in extract.NESTED or tag == "a":
            self.path.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.text += data
            self.linked += data if any(t == "a" for t, _ in self.path) else ""


def plain_text(page):
    """The rules as the docstring of the module tells them, block by block over all others."""
    rows = []
    for text, linked, path, heading in PlainReader(page).found:
        inside, named, marked = False, False, False
        for tag, marks in path:
            named |= tag in extract.OUTSIDE and not (tag == "header" and inside)
            if tag not in ("a", "body", "html", "article", "main") or tag == "article" and inside:  # an article in an article may be a comment
                marked |= bool((marks - {"header"} if inside else marks) & extract.MARKED)
            inside |= tag in ("article", "main") and not named and not marked
        rows.append((text, linked / len(text), heading, inside and not named and not marked, named, marked))
    main = any(r[3] for r in rows)
    stops = lambda t: [w.strip(".,;:!?\"'()") in extract.STOP for w in t.lower().split()]
    own = [x for r in rows if not r[4] for x in stops(r[0])]
    known = main or sum(own) >= 0.08 * len(own)

    def verdict(r, marks=True):
        text, linked, heading, inside, named, marked = r
        if named or marked and marks or main and not inside:
            return "cue"
        if linked > (0.5 if main else 0.25) and not (main and heading):
            return "bad"
        size = len(text) + (0 if known else 2 * sum(c >= "\u3040" for c in text))
        if size < 70:
            return "short" if main or linked == 0 else "bad"
        share = sum(stops(text)) / len(text.split())
        if not known or share >= 0.25 and size > 200:
            return "good"
        return "near" if main or share >= 0.15 else "bad"

    got = [verdict(r) for r in rows]
    if not main and not {"good", "near", "short"} & set(got):
        return " ".join(r[0] for r in rows if verdict(r, marks=False) == "good")
    decided = [g if g in ("good", "bad") else "bad" if g == "cue" and not main else None for g in got]
    kept = []
    for i, (r, g) in enumerate(zip(rows, got, strict=True)):
        left = next((d for d in reversed(decided[:i]) if d), "good" if main else "bad")
        right = next((d for d in decided[i + 1 :] if d), "good" if main else "bad")
        if g == "good" or g in ("near", "short") and (
            not main and "good" not in got or (main or g == "near") and "good" in (left, right) or g == "short" and (left == right == "good" or r[2] and right == "good")
        ):
            kept.append(r[0])
    return " ".join(kept)


@pytest.mark.parametrize("seed", range(300))
def test_rules_match_a_plain_version(seed):
    rng = np.random.default_rng(seed)
    languages = ["the of and to in is that it for was house river stone".split(), "lorem ipsum dolor sit amet of".split(), RUSSIAN.split(), [JAPANESE[:9], JAPANESE[9:16]]]
    own = languages[int(rng.integers(4))]
    say = lambda n: " ".join(rng.choice(own if rng.random() < 0.8 else languages[int(rng.integers(4))]) for _ in range(n))
    marks = ["", "", "", ' class="widget"', ' id="comments"', ' class="story-body"', ' role="banner"', ' class="cookie-notice top"']

    def part(depth):
        kind = rng.random()
        if depth and kind < 0.35:
            tag = str(rng.choice(["div", "section", "article", "aside", "nav", "footer", "header", "ul", "main", "form"]))
            return f"<{tag}{rng.choice(marks)}>{''.join(part(depth - 1) for _ in range(int(rng.integers(1, 5))))}</{tag}>"
        tag, text = str(rng.choice(["p", "h2", "li", "blockquote", "td", "p"])), say(int(rng.choice([1, 4, 20, 60])))
        if rng.random() < 0.3:
            text = f"<a href='x'>{text}</a> {say(int(rng.integers(0, 30)))}"
        return f"<{tag}>{text} &amp; <b>more</b></{tag}>" + ("<script>var a = '<p>';</script>" if rng.random() < 0.1 else "")

    page = f"<html><head><title>t</title></head><body>{''.join(part(3) for _ in range(int(rng.integers(1, 7))))}</body></html>"
    assert extract.main_text(page)[0] == plain_text(page)


@pytest.mark.parametrize("broken", ["<p>a <b", "<p title=\"x>y'>z", "<!-- open", "<script>never closed", "<div" * 2000, "<p>&am", "a < b > c", "<article><p>x</article></div></div>y"])
def test_broken_pages(broken):
    assert isinstance(extract.main_text(broken)[0], str)


@pytest.mark.parametrize("seed", range(30))
def test_pages_made_of_known_parts(seed):
    """Pages put together from article blocks, whose text is noted, and from other parts; nothing is shared with the rules under test."""
    rng = np.random.default_rng(seed)
    few, many = "lorem ipsum dolor sit amet consetetur".split(), "the of and to in is that it for was".split()
    pick = lambda n: " ".join(str(rng.choice(many if rng.random() < 0.4 else few)) for _ in range(n))
    other = [
        lambda: f"<nav><ul><li><a href='/'>{pick(2)}</a></li></ul></nav>", lambda: f'<div class="ad">{pick(30)}</div>', lambda: f"<aside><p>{pick(60)}</p></aside>",
        lambda: f"<form><label>{pick(3)}</label><textarea>{pick(50)}</textarea></form>", lambda: f"<!-- {pick(5)} <p>{pick(5)}</p> -->", lambda: f"<script>if (a < b) '<p>{pick(9)}</p>'</script>",
        lambda: f"<section id=comments><p>{pick(50)}</p></section>", lambda: f"<div class='cookie-notice'><p>{pick(40)}</p></div>",
    ]
    want, body = [], []
    for _ in range(int(rng.integers(1, 12))):
        if rng.random() < 0.3:
            body.append(other[int(rng.integers(len(other)))]())
        text = pick(int(rng.integers(1, 120)))
        tag = str(rng.choice(["p", "blockquote", "h2", "li", "div", "pre"]))
        shown = text.replace(" the ", " <em>the</em> ", 1).replace(" of ", "\n &#111;f\t", 1).replace(" is ", " <a href='x>y'>is</a> ", 1)
        body.append(f"<{tag} title=\"a > b\">{shown}</{tag}>")
        want.append(text)
    head = pick(4)
    page = f"<html><head><title>{pick(3)}</title></head><body><header><p>{pick(60)}</p></header>{other[0]()}<article><header class='entry-header'><h1>{head}</h1></header>{''.join(body)}</article><p>{pick(80)}</p><footer>{pick(60)}</footer></body></html>"
    assert extract.main_text(page)[0] == " ".join([head, *want])


@pytest.mark.parametrize("piece", ["<p class='", "<a ", "<a \"'>", "<!", "<ul></li>", "<!-- ", "<script>", "</div>", "<p class=\"x"])
def test_reading_takes_time_in_proportion(piece):
    import time

    began = time.perf_counter()
    extract.main_text(piece * (2_000_000 // len(piece)))
    assert time.perf_counter() - began < 20


def test_both_passes_decide_blocks(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    row = extract.extract(pages).agg(F.sum("by_density").alias("d"), F.sum("by_neighbours").alias("n"), F.min("by_neighbours").alias("least")).first()
    assert row.d > 0 and row.n > pages.count() and row.least > 0


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "", "t")], "page_id bigint, url string, html string, text string")
    rows = extract.extract(df).collect()
    assert [r.n_chars for r in rows] == [len(r.text) for r in rows] and sum(r.text == "" for r in rows) == 2
    assert extract.extract(df.limit(0)).count() == 0
