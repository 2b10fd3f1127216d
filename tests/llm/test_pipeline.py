"""Each stage of the pipeline against brute force on what the stage before it kept."""

import pathlib
import re

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gneiss.llm import decontaminate, quality

from .test_documents import LOWER, base, components, least_determinant, removed, words

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SMALL).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(input, output) of every stage as pandas."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append((before, docs.toPandas()))
    return out


def ids(pdf):
    return sorted(pdf.doc_id)


def test_quality(stages):
    """What goes fails the base rules or lies beyond the cutoff of an independent search, but for documents near it."""
    before, after = stages[0]
    rows = []
    for r in before.itertuples():
        n, chars, symbols, dup, repeat, failed = base(r.text or "")
        lines = len([x for x in (r.text or "").split("\n") if words(x)])
        m = max(n, 1)
        rows.append((r.doc_id, r.lang, r.source, failed, np.log1p(chars / m), np.log1p(20 * symbols / m), dup / max(lines, 1), repeat / m))
    made = pd.DataFrame(rows, columns=["doc_id", "lang", "source", "failed", *quality.FLOORS])
    kept = set(ids(after))
    assert kept.isdisjoint(made.doc_id[made.failed]) and len(kept) < len(before)
    same = total = 0
    for _, g in made[~made.failed].groupby(["lang", "source"], dropna=False):
        if len(g) >= 15:
            _, d2 = least_determinant(g[list(quality.FLOORS)].to_numpy(), list(quality.FLOORS.values()), quality.COVER)
            same += (g.doc_id.isin(kept).to_numpy() == (d2 <= quality.CUTOFF)).sum()
            total += len(g)
    assert same >= 0.9 * total


AWKWARD = ["_w", "g_lang", "m_0", "x_len", "n_words", "d2", "kept", "base_failed", "kept_text", "row", "key", "first", "d", "k", "_id", "_text", "_key", "_nth", "one", "many", "c", "stays", "start"]


def test_stages_keep_columns_with_clashing_names(spark):
    long = " ".join(f"word{i}" for i in range(80))
    docs = [(i, long.replace("word7 ", f"x{i} "), "en", "s", 5, *[f"{c}{i}" for c in AWKWARD]) for i in range(3)] + [(None,) * (5 + len(AWKWARD))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in AWKWARD))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SMALL)
        assert out.columns == df.columns
        rows = out.collect()
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in AWKWARD if r.doc_id is not None), name
        assert stage(spark, df.limit(0), SMALL).count() == 0
        assert len(rows) == {"quality_rules": 3, "minhash_near_dedup": 2, "substring_dedup": 3, "benchmark_decontamination": 4}[name], (name, rows)
    assert stage_rows(spark, df) == 4


def stage_rows(spark, df):
    return corpus_pipeline.STAGES[-1][1](spark, df, SMALL).where("start = 0").count()


def test_near_duplicates(stages):
    before, after = stages[1]
    found = components(list(zip(before.doc_id, before.text, strict=True)))
    assert ids(after) == sorted(d for d, (_, root) in found.items() if root == d)


def test_substrings(stages):
    before, after = stages[2]
    docs = list(zip(before.doc_id, before.text, strict=True))
    gone = removed(docs, 20)
    want = {}
    for doc, text in docs:
        w = words(text)
        kept = [x for i, x in enumerate(w) if i not in gone.get(doc, ())]
        if kept:
            want[doc] = kept
    assert {r.doc_id: words(r.text) for r in after.itertuples()} == want
    assert all(r.n_chars == len(r.text) for r in after.itertuples())


def test_decontamination(stages):
    before, after = stages[3]
    items = [x for x in pd.read_parquet(f"{SMALL}/benchmark.parquet").text if x]
    split = lambda t: re.sub(r"[!-/:-@\[-`{-~]", " ", t.lower()).encode().split()
    number = {}
    as_ids = lambda w: np.array([number.setdefault(x, len(number)) for x in w], dtype=np.uint64)
    items = [as_ids(split(x)) for x in items]
    clean = []
    for r in before.itertuples():
        w = as_ids(split(r.text))
        if not any(len(i) >= decontaminate.LEAST_WORDS and decontaminate.edits(i, w) <= decontaminate.allowed(len(i)) for i in items):
            clean.append(r.doc_id)
    assert ids(after) == sorted(clean)


def test_packing(stages):
    before, after = stages[4]
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = {r.doc_id: [*other.encode(r.text, add_special_tokens=False).ids, 0] for r in before.itertuples()}
    got = {d: [x for p in g.sort_values("start").ids for x in p] for d, g in after.groupby("doc_id")}
    assert got == whole


def test_run_is_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SMALL).toPandas()
    assert got.length.sum() == stages[4][1].length.sum() and LOWER
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "packing"]
