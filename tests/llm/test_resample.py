"""Importance resampling against a plain version."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from gneiss.llm import resample

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def plain(docs, target):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text), by sorting all."""
    cut = [plain_features(t) for _, t in docs]
    s, t = collections.Counter(b for _, f in cut for b in f), collections.Counter(b for x in target for b in plain_features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (all_s + 10000)) / ((s[b] + 1) * (all_t + 10000)))) for b in s}
    rows = []
    for (doc_id, _), (n, f) in zip(docs, cut, strict=True):
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for place, r in enumerate(may[: 25 * len(may) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def some(n, seed):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(80)] + ["Ünï", "日本", "It's", "a_b", "x@y"])
    return [(int(i), " ".join(words[np.minimum(rng.zipf(1.3, rng.integers(0, 60)) - 1, 84)])) for i in rng.permutation(n)]


@pytest.mark.parametrize("seed", [0, 1])
def test_draw_matches_plain_version(spark, seed):
    docs = some(400, seed)
    docs += [(i + 1000, docs[0][1]) for i in range(50)] + [(None, docs[1][1]), (None, None), (2000, None), (2001, ""), (2002, " \x00 ")]
    target = ["w1 w2 w3 w4", "w7 w7 日本 w2 w3", None, ""]
    out = resample.resample(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string"))
    assert got(out) == plain(docs, target)


def test_repeated_rows_take_a_rank_each(spark, monkeypatch):
    monkeypatch.setattr(resample, "COPIES", 7)
    hot = (5, " ".join(f"w{i}" for i in range(30)))
    docs = some(60, 3) + [hot] * 300
    target = [hot[1]]
    rows = got(resample.resample(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame([(t,) for t in target], "text string")))
    assert rows == plain(docs, target)
    ranks = sorted(r[4] for r in rows if r[4])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 75


def test_awkward_tables(awkward, empty, spark):
    target = spark.createDataFrame([("the river turns to silver",)], "text string")
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    assert got(resample.resample(awkward, target)) == plain(docs, ["the river turns to silver"])
    assert resample.resample(empty, target).count() == 0
    assert got(resample.resample(awkward, target.limit(0))) == plain(docs, [])


def test_features_do_not_depend_on_runs(monkeypatch):
    text = " ".join(f"Wörd{i % 50} 日{i % 7}" for i in range(500)).encode()
    whole = np.concatenate(list(resample.features(text)))
    monkeypatch.setattr(resample, "RUN", 9)
    parts = list(resample.features(text))
    assert len(parts) > 50 and max(map(len, parts)) <= 10
    assert sorted(np.concatenate(parts)) == sorted(whole) == sorted(plain_features(text.decode())[1])


def test_the_draw_leans_to_the_target(spark):
    wanted, other = "alpha beta gamma delta", "one two three four"
    docs = [(i, " ".join([wanted if i % 4 == 0 else other] * 6)) for i in range(800)]
    out = resample.resample(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(wanted,)] * 50, "text string"))
    drawn = [r.doc_id for r in out.where("rank IS NOT NULL").collect()]
    assert len(drawn) == 200 and np.mean([d % 4 == 0 for d in drawn]) > 0.6


def test_an_equal_target_draws_by_noise_alone(spark):
    docs = some(500, 9)
    out = resample.resample(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(t,) for _, t in docs], "text string"))
    assert abs(out.agg({"weight": "avg"}).first()[0]) <= 1
