"""Fill-in-middle against a version that stores all units, and round trips."""

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gneiss.llm import fim


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) from a list of units."""
    text = text or ""
    x = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def check(df):
    texts = df.select("doc_id", F.col("text").alias("t")).collect()
    out = fim.transform(df).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=repr) == sorted(((r.doc_id, *plain(r.doc_id, r.t)) for r in texts), key=repr)
    assert sorted(map(repr, ((r.doc_id, r.back) for r in out))) == sorted(map(repr, ((r.doc_id, r.t or "") for r in texts)))
    return {r.form for r in out}


def test_awkward_tables(awkward, empty):
    check(awkward)
    assert fim.transform(empty).count() == 0


def test_every_form_and_marks(spark):
    texts = ["a b  c d\n", "<P", "S> <", "one <P> two", "<S>", "x<M>", "<<P", "日本 語 👩‍👩‍👧 é", "\x00 \x1c\x85  z", "  ", "w", "<P<S", "M> <M", "\n\n a"]
    rows = [(i, texts[i % len(texts)]) for i in range(900)]
    assert check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)) == {"plain", "psm", "spm"}


@settings(max_examples=300, suppress_health_check=[HealthCheck.too_slow])
@given(st.text(alphabet=" \t\nab<PSM>日\x1c"), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
def test_cuts_fall_between_units(text, first, second):
    units = fim.UNIT.findall(text)
    assert "".join(units) == text
    low, high = sorted((first % (len(units) + 1), second % (len(units) + 1)))
    assert fim.cut(text, first, second) == (len(units), len("".join(units[:low])), len("".join(units[:high])))
    assert fim.cut(text, first, second, False) == (len(units), 0, 0)


def test_very_long_text_takes_no_memory_of_its_units():
    import tracemalloc

    text = "ab " * 1_000_000
    tracemalloc.start()
    n, start, stop = fim.cut(text, 700_000, 300_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n, start, stop) == (1_000_001, 3 * 300_000 - 1, 3 * 700_000 - 1)
    assert peak < 20_000


@pytest.mark.parametrize(("percent", "spm", "forms"), [(0, 80, {"plain"}), (100, 100, {"spm"}), (100, 0, {"psm"})])
def test_rates(spark, percent, spm, forms):
    df = spark.createDataFrame([(i, f"some words {i}") for i in range(50)], "doc_id bigint, text string")
    assert {r.form for r in fim.transform(df, percent=percent, spm_percent=spm).collect()} == forms
