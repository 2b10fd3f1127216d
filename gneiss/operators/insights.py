"""Column insights as Column expressions: semantic type, role, confidence, description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Semantic types by name pattern, first match wins.
SEMANTIC = [
    ("identifier", r".*_id$|.*_key$|^id$"),
    ("timestamp", r".*_at$|.*_date$|.*_time$|.*_timestamp$|^created_.*|^updated_.*"),
    ("boolean", r"^is_.*|^has_.*|^was_.*"),
    ("amount", r".*_amount$|.*_total$|.*_price$|.*_cost$|.*_revenue$|.*_fee$"),
    ("count", r".*_count$|.*_num$|.*_qty$|.*_quantity$"),
    ("percentage", r".*_pct$|.*_percent$|.*_rate$|.*_ratio$"),
    ("categorical", r".*_status$|.*_state$|.*_type$|.*_category$|^status$|^type$"),
    ("name", r".*_name$|.*_title$|.*_label$|^name$"),
    ("email", r".*_email$|^email$"),
    ("url", r".*_url$|.*_uri$|.*_link$"),
]
# What supports a role's confidence: tests, usages, semantic types.
SUPPORT = {
    "primary_key": (("unique", "not_null"), ("join_key",), ("identifier",)), "foreign_key": (("relationships",), ("join_key", "filtered"), ("identifier",)),
    "timestamp": ((), (), ("timestamp",)), "metric": ((), ("aggregated",), ("amount", "count", "percentage")),
    "categorical": (("accepted_values",), ("filtered",), ("categorical",)), "dimension": ((), ("group_by",), ("name", "email", "url")),
}


def semantic_type(name: Column, data_type: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for kind, pattern in SEMANTIC:
        out = out.when(F.lower(name).rlike(pattern), kind)
    upper = F.upper(F.coalesce(data_type, F.lit("")))
    return out.when(upper.isin("BOOLEAN", "BOOL"), "boolean").when(upper.contains("TIMESTAMP") | upper.contains("DATE"), "timestamp")


def role(semantic: Column, tests: Column, usages: Column) -> Column:
    """The first role that fits; ``tests`` and ``usages`` are string arrays."""
    has, used = (lambda t: F.array_contains(tests, t)), (lambda u: F.array_contains(usages, u))
    out = F.when(has("unique") & has("not_null"), "primary_key")
    out = out.when(has("relationships") | ((semantic == "identifier") & used("join_key") & ~has("unique")), "foreign_key")
    out = out.when(semantic == "timestamp", "timestamp").when(semantic.isin("amount", "count", "percentage") | used("aggregated"), "metric")
    out = out.when((semantic == "categorical") | has("accepted_values"), "categorical")
    return out.when(semantic.isin("name", "email", "url") | used("group_by"), "dimension")


def confidence(role_: Column, semantic: Column, tests: Column, usages: Column) -> Column:
    """0 without a role, else 0.5, 0.2 for a supporting test, 0.2 for a fitting usage, 0.1 for a fitting name."""
    extra = F.lit(0.0)
    any_of = lambda where, names: F.arrays_overlap(where, F.array(*[F.lit(n) for n in names])) if names else F.lit(False)
    for name, (test, usage, kinds) in SUPPORT.items():
        points = F.when(any_of(tests, test), 0.2).otherwise(0.0) + F.when(any_of(usages, usage), 0.2).otherwise(0.0) + F.when(semantic.isin(*kinds), 0.1).otherwise(0.0)
        extra = F.when(role_ == name, points).otherwise(extra)
    return F.when(role_.isNull(), 0.0).otherwise(F.round(F.least(F.lit(1.0), F.lit(0.5) + F.coalesce(extra, F.lit(0.0))), 2))


def described(role_: Column, name: Column, model: Column) -> Column:
    """A sentence for each role."""
    plain = F.translate(F.lower(name), "_", " ")
    entity = F.translate(F.regexp_replace(F.lower(name), "_(id|key|fk)$", ""), "_", " ")
    event = F.translate(F.regexp_replace(F.lower(name), "_(at|dttm|date|time|timestamp|ts)$", ""), "_", " ")
    out = F.when(role_ == "primary_key", F.concat(F.lit("Unique identifier for each record in "), model, F.lit(".")))
    out = out.when(role_ == "foreign_key", F.concat(F.lit("References a related "), entity, F.lit(" record.")))
    out = out.when(role_ == "timestamp", F.concat(F.lit("Timestamp recording when the "), event, F.lit(" occurred.")))
    for kind, start in (("metric", "Numeric measure: "), ("categorical", "Category or classification: "), ("dimension", "Descriptive attribute: ")):
        out = out.when(role_ == kind, F.concat(F.lit(start), plain, F.lit(".")))
    return out


def merged_description(own: Column, made: Column, mode: str = "skip") -> Column:
    """append, replace or skip (only where there is none)."""
    empty = F.trim(F.coalesce(own, F.lit(""))) == ""
    if mode == "replace":
        return F.coalesce(made, own)
    if mode == "append":
        return F.when(empty, made).when(made.isNull(), own).otherwise(F.concat(own, F.lit("\n\n"), made))
    return F.when(empty, made).otherwise(own)


def enrich(columns: DataFrame, mode: str = "skip") -> DataFrame:
    """Columns (model, name, data_type, description, tests, usages) with semantic_type, role, confidence, description."""
    out = columns.withColumn("semantic_type", semantic_type(F.col("name"), F.col("data_type")))
    out = out.withColumn("role", role(F.coalesce("semantic_type", F.lit("")), F.col("tests"), F.col("usages")))
    out = out.withColumn("confidence", confidence(F.col("role"), F.coalesce("semantic_type", F.lit("")), F.col("tests"), F.col("usages")))
    return out.withColumn("description", merged_description(F.col("description"), described(F.col("role"), F.col("name"), F.col("model")), mode))
