import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gneiss.operators import search


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(rng, word):
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(word) + 1)
        word = rng.choice([word[:i] + "x" + word[i:], word[:i] + word[i + 1 :], word[:i] + "y" + word[i + 1 :]])
    return word


@pytest.fixture(scope="module")
def words():
    rng = random.Random(4)
    base = ["steel", "brass", "polished", "anodized", "economical", "standardisation", "internationalisation", "a", "tin", "日本語テキスト"]
    return sorted({near(rng, w) for w in base for _ in range(40)} - {""} | set(base))


def test_near_tokens_are_those_of_the_scan(spark, words):
    tokens = spark.createDataFrame([(w,) for w in words], "token string")
    needles = ["steel", "stel", "polishd", "economicaly", "standardisaton", "internationalizatio", "a", "tim", "日本語テキス", "nothing"]
    want = {(q, w) for q in needles for w in words if edits(q, w) <= len(q) // 5}
    got = search.near_tokens(tokens, needles)
    assert {(r.q, r.token) for r in got.collect()} == want and got.count() == len(want)
    assert any(len(q) // 5 > search.DEPTH for q, _ in want)
    assert {(r.q, r.token) for r in search.near_tokens(tokens, needles, search.token_variants(tokens).cache()).collect()} == want


def test_near_tokens_meet_by_equality(spark, words, tmp_path):
    tokens = spark.createDataFrame([(w,) for w in words], "token string")
    search.token_variants(tokens).write.parquet(str(tmp_path / "v"))
    plan = search.near_tokens(tokens, ["polishd"], spark.read.parquet(str(tmp_path / "v")))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner.*variant#\d+ = variant#\d+", plan)


def test_indexed_search_is_that_of_the_scan(spark, words):
    rng = random.Random(1)
    rows = [(w, i, rng.randrange(1, 4), bool(i % 2)) for w in words for i in rng.sample(range(30), 2)]
    index = spark.createDataFrame(rows, "token string, id int, tf bigint, is_name boolean")
    for needle in ("steel polishd", "Economical economical brass", "stan tin a", "internationalizatio", ""):
        want = {}
        for q in needle.lower().split():
            for token, i, tf, is_name in rows:
                worth = 1 if token == q else 0.5 if token.startswith(q) else 0.25 if edits(token, q) <= len(q) // 5 else 0
                if worth:
                    want[i] = want.get(i, 0) + worth * tf * (2 if is_name else 1)
        best = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:20]
        assert [(r.id, r.score) for r in search.indexed_search(index, needle).collect()] == best


def test_refresh_writes_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "index")
    texts = [(i, f"word{i % 5} common t{i}") for i in range(200)]
    frame = lambda rows: spark.createDataFrame(rows, "id int, text string")
    search.write_index(frame(texts), path, buckets=16)
    rows = lambda df: sorted(tuple(r) for r in df.select("token", "id", "tf").collect())
    files = lambda: {p.parent.name: sorted(x.name for x in p.parent.glob("*.parquet")) for p in pathlib.Path(path).rglob("*.parquet")}
    assert rows(search.read_index(spark, path)) == rows(search.inverted_index(frame(texts)))
    before = files()
    changed = [(3, "new words"), (77, None), (500, "a new text")]
    search.refresh_index(spark, path, frame(changed))
    now = dict(texts) | dict(changed)
    assert rows(search.read_index(spark, path)) == rows(search.inverted_index(frame([(k, v) for k, v in now.items() if v is not None])))
    after = files()
    touched = {f"bucket={r[0]}" for r in frame(changed).select(F.pmod(F.xxhash64("id"), F.lit(16))).collect()}
    assert set(before) == set(after) and {b for b in before if before[b] != after[b]} == touched
    only = {r.id for r in search.read_index(spark, path).select("id").distinct().collect() if f"bucket={spark.range(1).select(F.pmod(F.xxhash64(F.lit(r.id)), F.lit(16))).first()[0]}" in touched}
    search.refresh_index(spark, path, frame([(i, None) for i in only]))  # whole buckets are emptied
    assert set(files()) == set(before) and not only & {r.id for r in search.read_index(spark, path).collect()}


def test_two_tiers(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id string, name string")
    models, columns = frame([(f"m{i}", f"amount_{i}") for i in range(4)] + [("z", "other")]), frame([("c1", "amounts"), ("c2", "nothing")])
    assert [(r.tier, r.id) for r in search.two_tier(models, columns, "amount").collect()] == [(1, "m0"), (1, "m1"), (1, "m2"), (1, "m3"), (2, "c1")]
    assert [(r.tier, r.id) for r in search.two_tier(models, columns, "amount", few=4).collect()] == [(1, f"m{i}") for i in range(4)]
    assert search.two_tier(models, columns, "zzzzz").count() == 0
