"""Quality rules: robust multivariate outliers per language and source, in DataFrame functions only.

Each document becomes a vector of transformed statistics. For every (lang, source) group a
minimum-covariance-determinant estimate is sought from many starts: all rows, medians with quartile
ranges, and ELEMENTAL ones of ELEMENT different vectors each, which are few enough that some start has no outlier among
them (copies are one vector, so a hot group of copies is in few starts). Concentration steps are taken from
all starts at once: distances
under each estimate are put in fine buckets, sums per bucket give mean and covariance of the h nearest
rows, and these are the next estimate. After FIRST_STEPS steps the KEPT starts of least determinant go on; when
determinants fall no more, the start of the least one is the group's estimate. Each step is one partially aggregated pass over a thin table of statistics; no
group is ever gathered. Documents beyond a Mahalanobis cutoff are rejected.

Defined results: null text counts as empty (no words, base_failed); null lang or source form groups
of their own; an empty table gives an empty table; repeated rows are judged one by one and alike;
a group of a single row lies at its own centre. Variance floors keep degenerate groups invertible.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, stored, words

#: Names of the transformed statistics, and the least standard deviation that each is given.
FLOORS = {"x_len": 0.10, "x_sym": 0.35, "x_dup": 0.15, "x_rep": 0.15}
#: 0.9999 quantile of chi-square with four degrees of freedom.
CUTOFF = 23.5127
#: Share of a group's rows that the estimate must cover, and the most concentration steps taken.
COVER, STEPS = 0.6, 10
#: Elemental starts, the vectors of each, and the rows that these are drawn from; steps with all starts, and starts that then go on.
ELEMENTAL, ELEMENT, DRAWN, FIRST_STEPS, KEPT = 32, 3, 9, 2, 4
#: Buckets a unit of a statistic for its quartiles.
QUARTILE_RESOLUTION = 256
#: Distance buckets: the square root of the shape of log(1 + d2) at this resolution, and their number.
RESOLUTION, BUCKETS = 64, 2048
#: An estimate table of at most so many groups is broadcast.
MAX_BROADCAST_GROUPS = 100_000


def text_stats(docs: DataFrame) -> DataFrame:
    """Adds the counts that the rules use; every other column, clashing names aside, stays."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn("_w", words(F.col("text"))).withColumn("n_words", F.size("_w").cast("long"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(SPACE.replace("[", "[^")))
    out = out.withColumns(
        {
            "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
            "n_symbols": F.octet_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "_l": lines,
            "_h": F.when(
                F.col("n_words") > 2,
                F.transform(F.slice("_w", 1, F.size("_w") - 2), lambda w, i: F.xxhash64(w, F.col("_w")[i + 1], F.col("_w")[i + 2])),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    )
    out = out.withColumns(
        {
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_s": F.when(
                F.size(F.array_distinct("_h")) < F.size("_h"),
                F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
        }
    )
    at = F.col("_s")
    same = lambda e, j: ((j > 0) & (F.get(at, j - 1)["h"] == e["h"])) | ((j < F.size(at) - 1) & (F.get(at, j + 1)["h"] == e["h"]))
    out = out.withColumn("_d", F.sort_array(F.transform(F.filter("_s", same), lambda e: e["i"])))
    covered = F.aggregate(
        "_d",
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return out.withColumn("n_repeat_words", covered.cast("long")).drop("_w", "_l", "_h", "_s", "_d")


def vectors(stats: DataFrame, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """Adds base_failed and the transformed statistic vector."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns(
        {
            "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words")),
            "x_len": F.log1p(F.col("word_chars") / n),
            "x_sym": F.log1p(20 * F.col("n_symbols") / n),
            "x_dup": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "x_rep": F.col("n_repeat_words") / n,
        }
    )


GROUP = ["g_lang", "g_source"]


def _distance(dims: list[str]) -> Column:
    """Squared Mahalanobis distance by forward substitution with the Cholesky columns."""
    solved: list[Column] = []
    for i, x in enumerate(dims):
        rest = F.col(x) - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"c_{i}_{k}") * solved[k]
        solved.append(rest / F.col(f"c_{i}_{i}"))
    return sum((y * y for y in solved[1:]), solved[0] * solved[0])


def consistency(cover: float, dims: int) -> float:
    """What the covariance of the nearest ``cover`` of normal rows in an even number of dimensions is to be multiplied by."""
    below = lambda x, k: 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(k // 2))  # noqa: E731  chi-square, k even
    low, high = 0.0, 100.0
    for _ in range(100):
        low, high = ((low + high) / 2, high) if below((low + high) / 2, dims) < cover else (low, (low + high) / 2)
    return cover / below(low, dims + 2)


def _cholesky(est: DataFrame, dims: list[str], floors: list[float]) -> DataFrame:
    """Per group and start the mean m_i, the Cholesky factor c_i_k of the covariance v_i_k, and the logarithm of its determinant."""
    for i in range(len(dims)):
        for k in range(i + 1):
            rest = F.col(f"v_{i}_{k}")
            for j in range(k):
                rest = rest - F.col(f"c_{i}_{j}") * F.col(f"c_{k}_{j}")
            est = est.withColumn(f"c_{i}_{k}", F.sqrt(F.greatest(rest, F.lit(floors[i] ** 2 / 4))) if i == k else rest / F.col(f"c_{k}_{k}"))
    keep = [f"m_{i}" for i in range(len(dims))] + [f"c_{i}_{k}" for i in range(len(dims)) for k in range(i + 1)]
    log_det = sum((F.log(F.col(f"c_{i}_{i}")) for i in range(1, len(dims))), F.log(F.col("c_0_0")))
    return est.select(*GROUP, "start", *keep, log_det.alias("log_det"))


def _estimate(sums: DataFrame, dims: list[str], floors: list[float], inflate: float) -> DataFrame:
    """The estimate per group and start from its sums."""
    n = F.col("n").cast("double")
    out = sums.withColumns({f"m_{i}": F.col(f"s_{i}") / n for i in range(len(dims))})
    out = out.withColumns(
        {
            f"v_{i}_{k}": (F.col(f"q_{i}_{k}") / n - F.col(f"m_{i}") * F.col(f"m_{k}")) * inflate + (floors[i] ** 2 if i == k else 0.0)
            for i in range(len(dims))
            for k in range(i + 1)
        }
    )
    return _cholesky(out, dims, floors)


def _quartile_start(rows: DataFrame, dims: list[str], floors: list[float], start: int) -> DataFrame:
    """Medians and quartile ranges per group, by counts of fine buckets."""
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(x) * QUARTILE_RESOLUTION).alias("b")) for i, x in enumerate(dims)])).alias("x")
    counts = rows.select(*GROUP, one).groupBy(*GROUP, "x.i", "x.b").agg(F.count(F.lit(1)).alias("n"))
    each = Window.partitionBy(*GROUP, "i")
    counts = counts.withColumns({"upto": F.sum("n").over(each.orderBy("b")), "every": F.sum("n").over(each)})
    at = lambda share, i: F.min(F.when((F.col("i") == i) & (F.col("upto") >= share * F.col("every")), F.col("b") + 0.5)) / QUARTILE_RESOLUTION
    found = counts.groupBy(*GROUP).agg(*[at(q / 4, i).alias(f"q{q}_{i}") for i in range(len(dims)) for q in (1, 2, 3)])
    made = {f"m_{i}": F.col(f"q2_{i}") for i in range(len(dims))}
    for i in range(len(dims)):
        for k in range(i + 1):
            # a normal variable's quartiles are 1.349 deviations apart
            made[f"v_{i}_{k}"] = F.pow((F.col(f"q3_{i}") - F.col(f"q1_{i}")) / 1.349, 2) + floors[i] ** 2 if i == k else F.lit(0.0)
    return _cholesky(found.withColumns(made).withColumn("start", F.lit(start)), dims, floors)


def _small(est: DataFrame) -> DataFrame:
    """The estimates, to be broadcast if their counted number is within the bound."""
    return F.broadcast(est) if est.count() <= MAX_BROADCAST_GROUPS else est


def fit(vectored: DataFrame, steps: int = STEPS, cover: float = COVER) -> DataFrame:
    """One MCD estimate (mean, Cholesky factor, log_det) per group of the rows that pass the base rules."""
    dims, floors = list(FLOORS), list(FLOORS.values())
    pairs = [(i, k) for i in range(len(dims)) for k in range(i + 1)]
    rows = vectored.where(~F.col("base_failed")).select(*GROUP, *dims)
    names = [f"s_{i}" for i in range(len(dims))] + [f"q_{i}_{k}" for i, k in pairs]
    sums = [F.sum(x).alias(f"s_{i}") for i, x in enumerate(dims)]
    sums += [F.sum(F.col(dims[i]) * F.col(dims[k])).alias(f"q_{i}_{k}") for i, k in pairs]
    every = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), *sums).checkpoint()
    est = _estimate(every.withColumn("start", F.lit(0)), dims, floors, 1.0)
    est = est.unionByName(_quartile_start(rows, dims, floors, ELEMENTAL + 1))
    est = est.unionByName(_estimate(_elements(rows, every, dims).groupBy(*GROUP, "start").agg(F.count(F.lit(1)).alias("n"), *sums), dims, floors, 1.0))
    inflate, before = consistency(cover, len(dims)), None
    by_determinant = F.row_number().over(Window.partitionBy(*GROUP).orderBy("log_det", "start"))
    for step in range(FIRST_STEPS + steps):
        near = rows.join(_small(est.checkpoint()), GROUP).withColumn("b", F.least(F.floor(F.log1p(_distance(dims)) * RESOLUTION), F.lit(BUCKETS - 1)))
        by = near.groupBy(*GROUP, "start", "b").agg(F.count(F.lit(1)).alias("n"), *sums)
        each = Window.partitionBy(*GROUP, "start")
        by = by.withColumns({"below": F.sum("n").over(each.orderBy("b")) - F.col("n"), "all": F.sum("n").over(each)})
        core = by.where(F.col("below") < cover * F.col("all")).groupBy(*GROUP, "start").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names])
        est = _estimate(core, dims, floors, inflate)
        if step < FIRST_STEPS - 1:
            continue
        if step == FIRST_STEPS - 1:
            est = est.withColumn("place", by_determinant).where(F.col("place") <= KEPT).drop("place")
        est = est.checkpoint()
        least = est.groupBy(*GROUP).agg(F.min("log_det").alias("d")).agg(F.sum("d")).first()[0]
        if least is None or before is not None and abs(before - least) < 1e-9:
            break
        before = least
    return est.withColumn("place", by_determinant).where("place = 1").drop("place", "start").checkpoint()


def _elements(rows: DataFrame, every: DataFrame, dims: list[str]) -> DataFrame:
    """The ELEMENT different vectors of least hash of every group and elemental start, among about DRAWN rows that their hashes draw."""
    drawn = F.filter(F.sequence(F.lit(1), F.lit(ELEMENTAL)), lambda start: F.pmod(F.xxhash64(*dims, start), F.col("n")) < DRAWN)
    some = rows.join(_small(every.select(*GROUP, "n")), GROUP).withColumn("start", F.explode(drawn))
    some = some.groupBy(*GROUP, "start", *dims).agg(F.first(F.xxhash64(*dims, "start")).alias("h"))
    first = F.row_number().over(Window.partitionBy(*GROUP, "start").orderBy("h", *dims))
    return some.withColumn("place", first).where(F.col("place") <= ELEMENT).drop("place", "h")


def _grouped(df: DataFrame) -> DataFrame:
    """Group keys in which a null is a value like any other."""
    key = lambda c: F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(c).cast("string")))
    return df.withColumns({"g_lang": key("lang"), "g_source": key("source")})


def judge(stored_vectors: DataFrame, est: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Adds d2 and kept. The estimates are broadcast only if their counted number is within the bound."""
    out = stored_vectors.join(_small(est), ["g_lang", "g_source"], "left").withColumn("d2", _distance(list(FLOORS)))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= cutoff))
    return out.drop(*[c for c in est.columns if c not in ("g_lang", "g_source")])


def quality_rules(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``docs`` (text, lang, source) with the counts, base_failed, d2 and kept; of docs' columns those in ``keep`` stay."""
    out = _grouped(vectors(text_stats(docs.select(*dict.fromkeys([*keep, "text", "lang", "source"])))))
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    table = stored(out.select(*keep, *[c for c in made if c not in keep], "g_lang", "g_source", *FLOORS), "quality")
    return judge(table, fit(table)).drop("g_lang", "g_source", *FLOORS)


def without_poor(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*others).alias("row"), "text", F.col("lang").alias("lang"), F.col("source").alias("source"))
    kept = quality_rules(packed, keep=["row", "text"]).where("kept")
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
