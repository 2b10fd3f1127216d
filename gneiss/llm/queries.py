"""The opN_ queries over the driver tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, decontaminate, extract, fim, language, licenses, neardup, packing, ppm, quality, resample, substring, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE_SQL[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_quality_rules")
def op8(spark, sf_dir):
    out = quality.quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: What both turns of the added conversation -7 say.
TRICKY = "</s>[INST] ok [/INST]"


@query(
    "op5_chat_formatting",
    r"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
      UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
      CAST(3 + sum(CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 10
        ELSE 16 + length(role) + 2 * (length(role) - length(replace(replace(role, '%', ''), ']', ''))) END
        + length(text) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\]|ANS\]|ROLE |/ROLE\]|IMG\]|AUD\]|DOC\])'))) AS BIGINT) AS formatted_chars,
      CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
    FROM t GROUP BY conv_id
    """,
)
def op5(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], turns.schema)
    turns = turns.unionByName(added).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    got = chat.read_back(common.stored(chat.format_conversations(turns), "chat"), keep=["attachments", "expanded_tokens"])
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
        F.size("attachments").cast("long").alias("n_attachments"),
        "expanded_tokens",
    )


@query("op1_packing")
def op1(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query(
    "op3_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    g AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
    SELECT page_id, strlen(html) AS payload_bytes,
      array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(1 + ((CAST('0x' || substr(p.h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
      CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM p JOIN g USING (h)
    """,
)
def op3(spark, sf_dir):
    index = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_html_extraction")
def op10(spark, sf_dir):
    return extract.extract(table(spark, sf_dir, "pages"))


@query(
    "op4_substring_dedup",
    r"""
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
    g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM s),
    r AS (SELECT doc_id, i, rank() OVER (PARTITION BY h ORDER BY doc_id, i) AS place FROM g),
    x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r WHERE place > 1),
    y AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM x GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
      sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
    FROM d LEFT JOIN y USING (doc_id)
    """,
)
def op4(spark, sf_dir):
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


@query(
    "op9_minhash",
    r"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
    e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    r AS (SELECT doc_id AS v, doc_id AS u FROM n UNION SELECT v, b FROM r JOIN e ON u = a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(l, doc_id) AS component_id, coalesce(l, doc_id) = doc_id AS kept
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v AS doc_id, min(u) AS l FROM r GROUP BY v) USING (doc_id)
    """,
)
def op9(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_lm_scoring")
def op7(spark, sf_dir):
    return ppm.score(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    """The templates as SQL rows, and units, word pairs and Dice coefficients by list functions."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(i)}, {quoted(text)})" for i, _, text in licenses.TEMPLATES)
    norm = "list_filter(string_split(regexp_replace({}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
    pairs = "list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))"
    return f"""
    WITH t AS (SELECT license_id, {pairs} AS tp FROM (SELECT license_id, {norm.format("lower(body)")} AS w FROM (VALUES {rows}) v(license_id, body))),
    known AS (SELECT list_distinct(flatten(list(tp))) AS every FROM t),
    x AS (SELECT doc_id, lower(coalesce(text, '')) AS text FROM documents),
    q AS (SELECT DISTINCT doc_id, text, p, {norm.format("p")} AS w FROM (SELECT doc_id, text, unnest(list_distinct(list_concat([text], string_split(text, chr(10))))) AS p FROM x)),
    a AS (SELECT doc_id, text, row_number() OVER () AS r, regexp_split_to_array(text, '\\n\\s*\\n') AS ps FROM (SELECT DISTINCT doc_id, text FROM x)),
    b AS (SELECT doc_id, r, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM a),
    c AS (SELECT doc_id, r, i, {norm.format("p")} AS w FROM b),
    n AS (SELECT *, coalesce(w = lag(w) OVER (PARTITION BY r ORDER BY i) AND w = lag(w, 2) OVER (PARTITION BY r ORDER BY i), false) AS again FROM c WHERE len(w) > 0),
    e AS (SELECT doc_id, r, w, list_has_any({pairs}, every) AS ends, row_number() OVER (PARTITION BY r ORDER BY i) AS i, sum(len(w)) OVER (PARTITION BY r ORDER BY i) AS upto FROM n, known WHERE NOT again),
    f AS (SELECT s.doc_id, s.r, s.i, z.i AS j FROM e s JOIN e z ON z.r = s.r AND z.i >= s.i AND z.upto - s.upto + len(s.w) <= {licenses.RUN_WORDS} WHERE s.ends AND z.ends),
    g AS (SELECT f.doc_id, f.r, f.i, f.j, flatten(list(m.w ORDER BY m.i)) AS w FROM f JOIN e m ON m.r = f.r AND m.i BETWEEN f.i AND f.j GROUP BY ALL),
    p AS (SELECT DISTINCT doc_id, {pairs} AS up FROM (SELECT doc_id, w FROM q UNION ALL SELECT doc_id, w FROM g) WHERE len(w) > 1),
    m AS (SELECT doc_id, license_id, up, (2000 * len(list_intersect(up, tp))) // (len(up) + len(tp)) AS d FROM p JOIN t
      ON len(up) * 3 >= len(tp) * 2 AND len(tp) * 3 >= len(up) * 2),
    best AS (SELECT *, max(d) OVER (PARTITION BY doc_id, up) AS top FROM m WHERE d >= 800)
    SELECT doc_id, license_id, CAST(max(d) AS BIGINT) AS dice_permille, count(DISTINCT up) AS n_units FROM best WHERE d = top GROUP BY ALL
    """


@query("op2_license_scan", _license_sql())
def op2(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op6_decontamination")
def op6(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op11_importance_resampling",
    r"""
    WITH crc AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    x AS (SELECT true AS raw, doc_id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT false, NULL, row_number() OVER (), text FROM benchmark),
    w AS MATERIALIZED (SELECT raw, doc_id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
    f AS (SELECT raw, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
    n AS MATERIALIZED (SELECT raw, r, f, count(*) AS n FROM f GROUP BY ALL),
    b AS MATERIALIZED (SELECT f, xor(list_reduce([4294967295] || list_transform(range(CAST(length(hex(encode(f))) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT)),
      lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1])), 4294967295) % 10000 AS b FROM (SELECT DISTINCT f FROM n), crc),
    c AS (SELECT b, coalesce(sum(n) FILTER (WHERE raw), 0) AS s, coalesce(sum(n) FILTER (WHERE NOT raw), 0) AS t FROM n JOIN b USING (f) GROUP BY b),
    g AS (SELECT b, CAST(floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM c) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM c) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM c),
    m AS (SELECT r, CAST(sum(n) AS BIGINT) AS k, CAST(sum(n * gain) AS BIGINT) AS total FROM n JOIN b USING (f) JOIN g USING (b) WHERE raw GROUP BY r),
    y AS (SELECT doc_id, len(w) AS words, coalesce(k, 0) AS n_features, coalesce((total - ((total % k) + k) % k) // k, 0) AS weight,
      CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN m USING (r) WHERE raw),
    z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM y),
    e AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS place, count(*) OVER (PARTITION BY words >= 20) AS many FROM z)
    SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 25 * many // 100 THEN place END AS rank FROM e
    """,
)
def op11(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op13_fill_in_middle",
    r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
    h AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t, list_transform(range(4), lambda i: CAST('0x' || substr(x, 8 * i + 1, 8) AS BIGINT)) AS h FROM d),
    c AS (SELECT *, len(t) AS n, h[1] % (len(t) + 1) AS a, h[2] % (len(t) + 1) AS b FROM h),
    p AS (SELECT *, coalesce(array_to_string(t[1:least(a, b)], ''), '') AS p, coalesce(array_to_string(t[least(a, b) + 1:greatest(a, b)], ''), '') AS m, coalesce(array_to_string(t[greatest(a, b) + 1:], ''), '') AS s,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
    """,
)
def op13(spark, sf_dir):
    got = fim.transform(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query("op12_language_id")
def op12(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))
