"""Ranked search over metadata or any table of named texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import glob_regex, stored


def scored(entries: DataFrame, needle: str, limit: int = 20) -> DataFrame:
    """Entries (id, name, description, tags, columns, sql) by their best hit: name 100 or 80, description 50, tag 40, column 30, SQL 10; then by id."""
    q = needle.lower()
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q))
    any_has = lambda c: F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), F.lit(q)))
    score = F.when(F.lower("name") == q, 100).when(has("name"), 80).when(has("description"), 50).when(any_has("tags"), 40).when(any_has("columns"), 30).when(has("sql"), 10)
    out = entries.withColumn("score", score).where("score IS NOT NULL")
    return out.select("id", "name", "score", F.substring(F.coalesce("description", F.lit("")), 1, 200).alias("description")).orderBy(F.desc("score"), "id").limit(limit)


def fuzzy_hit(name, needle: str):
    """Prefix of any word of the name, or within a fifth of the needle's length in edits."""
    q = needle.lower()
    return F.exists(F.split(F.lower(name), r"[^a-z0-9]+"), lambda w: F.startswith(w, F.lit(q)) | (F.levenshtein(w, F.lit(q)) <= int(0.2 * len(q))))


def two_tier(resources: DataFrame, columns: DataFrame, needle: str, few: int = 5, limit: int = 20) -> DataFrame:
    """(tier, id, name): resources that hit; columns only where fewer than ``few`` resources do."""
    hit = lambda df, tier: df.where(fuzzy_hit(F.col("name"), needle)).select(F.lit(tier).alias("tier"), "id", "name").orderBy("name", "id").limit(limit)
    first = hit(resources, 1).collect()  # as many rows as are shown
    found = resources.sparkSession.createDataFrame(first, T.StructType.fromDDL(f"tier int, id {resources.schema['id'].dataType.simpleString()}, name string"))
    return found if len(first) >= min(few, limit) else found.unionByName(hit(columns, 2)).orderBy("tier", "name", "id").limit(limit)


def inverted_index(texts: DataFrame) -> DataFrame:
    """(token, id, tf) of (id, text): words as runs of letters and digits, lower-cased."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return texts.select("id", F.explode(words).alias("token")).groupBy("token", "id").agg(F.count(F.lit(1)).alias("tf"))


def column_occurrences(columns: DataFrame, name: str) -> DataFrame:
    """Where a column name occurs, whatever its case."""
    return columns.where(F.lower("name") == name.lower())


def list_models(models: DataFrame, pattern: str = "*", folder: str = "", tag: str | None = None, packages: bool = False) -> DataFrame:
    """Models by name glob, folder prefix and tag; those of other packages on demand."""
    out = models.where(F.col("name").rlike(glob_regex(pattern)) & F.startswith("folder", F.lit(folder)))
    out = out if tag is None else out.where(F.array_contains("tags", tag))
    return out if packages else out.where("not is_package")


#: What a hit in a name counts more than one in other texts.
NAME_BOOST = 2


#: Deletions that the variants of a token go to, and letters of a needle for each edit that is allowed.
DEPTH, LETTERS_PER_EDIT = 2, 5


def deletions(word: Column, edits: int) -> Column:
    """All texts that are left of ``word`` when at most so many letters are taken out of it."""
    out = F.array(word)
    for _ in range(edits):
        less = F.transform(out, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(x), F.lit(1))), lambda i, x=x: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.char_length(x)))))
        out = F.array_distinct(F.concat(out, F.flatten(less)))
    return out


def token_variants(tokens: DataFrame) -> DataFrame:
    """(variant, token) of distinct tokens, each under its deletions up to the edits that any needle near it is allowed, DEPTH at most.

    A needle of q letters is allowed q // LETTERS_PER_EDIT edits, so a token within them has at least four letters for each.
    """
    edits = F.least(F.floor(F.char_length("token") / (LETTERS_PER_EDIT - 1)), F.lit(DEPTH))
    made = F.when(edits == 0, deletions(F.col("token"), 0)).when(edits == 1, deletions(F.col("token"), 1)).otherwise(deletions(F.col("token"), 2))
    return tokens.select("token").distinct().select(F.explode(made).alias("variant"), "token")


def near_tokens(tokens: DataFrame, needles: list[str], variants: DataFrame | None = None) -> DataFrame:
    """(q, token) of the tokens within the edits that each needle is allowed.

    Two words within k edits have a text in common that is left of both after k deletions: needle and tokens meet
    by equality of variants, and only those that do are compared. Needles that are allowed more than DEPTH edits are compared with
    the distinct tokens of about their length.
    """
    spark, found = tokens.sparkSession, None
    for k in sorted({len(q) // LETTERS_PER_EDIT for q in needles}):
        some = [q for q in needles if len(q) // LETTERS_PER_EDIT == k]
        asked = spark.createDataFrame([(q,) for q in dict.fromkeys(some)], "q string")
        if k <= DEPTH:
            variants = token_variants(tokens) if variants is None else variants
            pairs = variants.join(asked.select("q", F.explode(deletions(F.col("q"), k)).alias("variant")), "variant").select("q", "token").distinct()
        else:
            of_length = F.char_length("token").between(min(map(len, some)) - k, max(map(len, some)) + k)
            pairs = tokens.where(of_length).select("token").distinct().select(F.explode(F.array(*[F.lit(q) for q in dict.fromkeys(some)])).alias("q"), "token")
        near = pairs.where(F.levenshtein("token", "q") <= k)
        found = near if found is None else found.unionByName(near)
    return found


def indexed_search(index: DataFrame, needle: str, limit: int = 20, variants: DataFrame | None = None) -> DataFrame:
    """(id, score) from an index (token, id, tf, is_name): every word of the needle that a token equals (1), begins with (1/2) or nearly is (1/4), by tf and boost.

    ``variants``: those of the index's tokens (see ``token_variants``), where they are stored.
    """
    words = needle.lower().split()
    if not words:
        return index.select("id", F.lit(0.0).alias("score")).limit(0)
    hits = [F.struct(F.lit(q).alias("q"), F.when(F.col("token") == q, 1.0).when(F.startswith("token", F.lit(q)), 0.5).alias("worth")) for q in dict.fromkeys(words)]
    begins = index.select("token").distinct().select("token", F.inline(F.array(*hits))).where("worth IS NOT NULL")
    near = near_tokens(index.select("token"), words, variants).withColumn("worth", F.lit(0.25))
    worth = begins.unionByName(near.select("token", "q", "worth")).groupBy("q", "token").agg(F.max("worth").alias("worth"))
    times = F.element_at(F.create_map(*[x for q in dict.fromkeys(words) for x in (F.lit(q), F.lit(words.count(q)))]), F.col("q"))
    rows = index.join(worth.groupBy("token").agg(F.sum(F.col("worth") * times).alias("worth")), "token")
    score = F.sum(F.col("worth") * F.col("tf") * F.when(F.col("is_name"), NAME_BOOST).otherwise(1))
    return rows.groupBy("id").agg(score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def refreshed(index: DataFrame, changed: DataFrame) -> DataFrame:
    """The index with the rows of changed texts (id, text; null: gone) put in place of their old ones."""
    kept = index.join(changed.select("id").distinct(), "id", "left_anti")
    return kept.unionByName(inverted_index(changed.where("text IS NOT NULL")).select(*index.columns))


#: Parts that an index is stored in.
BUCKETS = 64


def _bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))


def write_index(texts: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Stores the index of (id, text) in buckets by id; every bucket has a row without a token, so that none is ever empty."""
    rows = inverted_index(texts)
    marks = rows.sparkSession.range(buckets).select(F.lit(None).cast("string").alias("token"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.lit(0).cast("bigint").alias("tf"), F.col("id").cast("int").alias("bucket"))
    _bucketed(rows, buckets).unionByName(marks).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("token IS NOT NULL").select("token", "id", "tf")


def refresh_index(spark: SparkSession, path: str, changed: DataFrame) -> None:
    """Brings a stored index up to date with changed texts (id, text; null: gone): only their buckets are read and written.

    The new rows are stored before the first is put in place, so a refresh that failed half-way can be run again.
    """
    old = spark.read.parquet(path)
    buckets = old.select("bucket").distinct().count()  # every bucket has a row
    changed = _bucketed(changed, buckets)
    touched = changed.select("bucket").distinct()
    kept = old.join(F.broadcast(touched), "bucket", "left_semi")  # at most as many rows as there are buckets
    kept = kept.join(changed.select("id").distinct(), "id", "left_anti").select("token", "id", "tf", "bucket")
    fresh = _bucketed(inverted_index(changed.where("text IS NOT NULL")), buckets).select("token", "id", "tf", "bucket")
    stored(kept.unionByName(fresh)).repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
