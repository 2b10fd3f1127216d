"""Language identification: features and codes against plain versions, and held-out accuracy."""

import collections
import pathlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gneiss.llm import hashing, language

SMALL = "/root/testdata/sf0.001"
SYLLABLES = {"aa": "ka ro mi tu ne", "bb": "sch ung ein ver ter", "cc": "ción ll que ñó ra", "dd": "ск ов на пре ние", "ee": "eau oi tre ê men", "ff": "yy zz ww xq jk", "gg": "日 本 語 学 生", "hh": "ab ba bab aab bba"}


def made(languages, per=60, seed=0, words=(1, 40)):
    rng = np.random.default_rng(seed)
    rows = []
    for lang in languages:
        parts = SYLLABLES[lang].split()
        for _ in range(per):
            text = " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(rng.integers(*words)))
            rows.append((len(rows), text.title() if len(rows) % 3 else text.upper() + "!! 12", lang))
    return [rows[i] for i in rng.permutation(len(rows))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def plain_grams(text):
    """Buckets of all n-grams of one to three letters, by loops over characters."""
    text = (text or "") + " "
    c = [0]
    for x in text:
        k = ord(x.lower()[0]) if x.isalpha() else 0
        if k or c[-1]:
            c.append(k)
    keys = [(k, 0) for k in c if k]
    keys += [(a | b << 21 | 1 << 63, 0) for a, b in zip(c, c[1:], strict=False)]
    keys += [(a | b << 21 | d << 42, 1) for a, b, d in zip(c, c[1:], c[2:], strict=False) if b]
    return collections.Counter(int(hashing.mix(np.array([k], dtype=np.uint64), w)[0] >> np.uint64(64 - language.BITS)) for k, w in keys if len(c) > 2)


def test_grams_match_plain_version():
    texts = ["Ab cÉ-d", "", None, "1 2 3", "x", "ÀÉ 日本語!!", "a" * 50, " lead", "trail \n"]
    got = collections.defaultdict(collections.Counter)
    for row, bucket in language.grams(pa.array(texts)):
        for r, b in zip(row.tolist(), bucket.tolist(), strict=True):
            got[r][b] += 1
    for i, t in enumerate(texts):
        assert got[i] == (plain_grams(t) if any(x.isalpha() for x in t or "") else {})


def test_grams_of_many_runs(monkeypatch):
    texts = ["ab cd ef"] * 20
    whole = [(r, b) for row, bucket in language.grams(pa.array(texts)) for r, b in zip(row.tolist(), bucket.tolist(), strict=True)]
    monkeypatch.setattr(language, "CHUNK", 16)
    parts = [(r, b) for row, bucket in language.grams(pa.array(texts)) for r, b in zip(row.tolist(), bucket.tolist(), strict=True)]
    assert collections.Counter(whole) == collections.Counter(parts)


@pytest.mark.parametrize("n", range(2, 33))
def test_codewords_are_far_apart(n):
    code = language.codewords(n)
    assert set(np.unique(code)) == {-1.0, 1.0}
    assert (np.abs(code.sum(0)) < n).all()  # every bit splits the languages
    apart = (code[:, None] != code[None]).sum(2) + 99 * np.eye(n)
    assert apart.min() >= (2 ** (n - 2) if n <= 6 else 7)


def accuracy(spark, rows, **more):
    out = {r.doc_id: r for r in language.identify(frame(spark, rows), **more).collect()}
    held = [(out[i].lang_pred == lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= out[i].score <= 1 for i, _, _ in rows)
    return np.mean(held)


def test_held_out_accuracy_of_many_languages(spark):
    assert accuracy(spark, made(SYLLABLES, words=(3, 40))) > 0.97
    assert accuracy(spark, made(["aa", "bb", "cc", "dd"], words=(2, 9))) > 0.95
    assert accuracy(spark, made(["aa", "hh"], words=(2, 9))) > 0.95


def test_one_language_may_hold_most_rows(spark):
    rows = made(["aa"], per=900, words=(3, 20)) + [(i + 10_000, t, g) for i, t, g in made(["bb", "cc", "ee"], per=30, words=(3, 20))]
    out = {r.doc_id: r.lang_pred for r in language.identify(frame(spark, rows)).collect()}
    for lang in ("aa", "bb", "cc", "ee"):
        held = [out[i] == lang for i, _, g in rows if g == lang and zlib.crc32(str(i).encode()) % 3 == 1]
        assert np.mean(held) > 0.95


@pytest.mark.skipif(not pathlib.Path(SMALL).exists(), reason="no test tables")
def test_held_out_accuracy_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97


def test_held_out_labels_sources_and_ids_are_not_used(spark):
    rows = made(["aa", "bb", "cc"])
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    spoilt = [(i, t, "zz" if held(i) else lang) for i, t, lang in rows]
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(language.identify(frame(spark, rows))) == key(language.identify(frame(spark, spoilt)))


def test_awkward_tables(awkward, empty, spark):
    out = language.identify(awkward)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score", "ambiguous"]
    rows = out.collect()
    assert len(rows) == awkward.count()
    for r, text in zip(sorted(rows, key=repr), sorted(awkward.collect(), key=repr), strict=False):
        assert r.lang_pred in ("en", "de", "fr", "und")
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (3, 4, 5))
    assert language.identify(empty).count() == 0


def test_nothing_or_one_language_learned(spark):
    none = language.identify(frame(spark, [(1, "some text", None), (2, None, None)])).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    one = language.identify(frame(spark, [*[(i, "some text", "xx") for i in range(9)], (10, "123", None)])).collect()
    assert {r.doc_id: (r.lang_pred, r.score) for r in one} == {**dict.fromkeys(range(9), ("xx", 1.0)), 10: ("und", 0.0)}


def test_mixed_and_short_texts_are_flagged(spark):
    rows = made(["aa", "bb", "cc", "dd"], per=150, words=(5, 40))
    half = "karomitu nekaro mituka romine " * 5 + "schung einver terein verschung " * 5
    out = {r.doc_id: r for r in language.identify(frame(spark, [*rows, (10**6, half, None), (10**6 + 1, "e", None)])).collect()}
    assert out[10**6].ambiguous and out[10**6].lang_pred in ("aa", "bb")
    assert out[10**6].score < 0.9
    assert np.mean([out[i].ambiguous for i, _, _ in rows]) < 0.05


def test_rare_languages_beyond_the_bound_are_not_learned(spark):
    rows = made(["aa", "bb", "cc"], per=60) + [(9_000 + i, t, "dd") for i, (_, t, _) in enumerate(made(["dd"], per=6))]
    coder = language.learn(frame(spark, rows).select("lang", "text"), most=3)
    assert coder.languages == ["aa", "bb", "cc"]


def test_more_languages_than_a_task_holds(spark, monkeypatch):
    rows = made(["aa", "bb", "cc", "dd"], per=20)
    key = lambda: sorted(tuple(r) for r in language.gram_counts(frame(spark, rows).select("lang", "text")).collect())
    whole = key()
    monkeypatch.setattr(language, "HELD", 2)
    assert key() == whole


def test_weighted_decoding_prefers_trusted_bits():
    code = language.codewords(4)
    coder = language.Coder(list("abcd"), code, np.zeros((1, 7)), np.zeros(7), np.ones(7), np.array([1, 1, 1, 1, 0, 0, 0.0]), 16)
    for k, word in enumerate(code):
        noisy = 3 * word
        noisy[4:] *= -1  # bits without trust may all be wrong
        assert coder.losses(noisy[None])[0].argmin() == k


def many(languages, per=40, seed=3):
    """Texts of many languages, each with syllables of its own."""
    rng = np.random.default_rng(seed)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    rows = []
    for k in range(languages):
        parts = ["".join(rng.choice(letters, 2)) for _ in range(6)]
        rows += [(" ".join("".join(rng.choice(parts, 2)) for _ in range(30)), f"l{k:03}") for _ in range(per)]
    return [(i, *rows[j]) for i, j in enumerate(rng.permutation(len(rows)))]


def test_every_language_is_learned(spark):
    rows = many(40) + [(10_000 + i, t, "zz") for i, (_, t, _) in enumerate(made(["dd"], per=6, words=(20, 30)))]
    out = {r.doc_id: r.lang_pred for r in language.identify(frame(spark, rows)).collect()}
    assert {g for _, _, g in rows} == set(out.values())
    assert all(out[i] == "zz" for i, _, g in rows if g == "zz")
    assert np.mean([out[i] == g for i, _, g in rows if zlib.crc32(str(i).encode()) % 3 == 1]) > 0.97


def test_blocks_and_large_codes(spark, monkeypatch):
    coder = language.learn(frame(spark, made(["aa", "bb", "cc"], per=20)).select("lang", "text"))
    texts = pa.array([t for _, t, _ in made(["aa", "cc"], per=9)] + [None])
    whole = coder.predict(texts)
    monkeypatch.setattr(language, "CELLS", 7)
    assert [list(x) for x in coder.predict(texts)] == [list(x) for x in whole]
    monkeypatch.setattr(language, "COMPARED", 20)
    code = language.codewords(50)
    assert len(np.unique(code, axis=0)) == 50 and (np.abs(code.sum(0)) < 50).all()
