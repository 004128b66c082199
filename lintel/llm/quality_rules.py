"""Quality rules in DataFrame functions alone: counts per text, two fixed limits, and robust multivariate outliers.

Texts within the limits become vectors of transformed statistics. For each language and source, the minimum
covariance determinant is approached from three starts (coordinate-wise medians, all rows, the rows near all medians) by
concentration steps: take the `SHARE` of rows with the least Mahalanobis distances, estimate mean and covariance on those, and
again until the determinant doesn't fall by more than `SETTLED` in a step. A histogram finds those rows; its last bin counts in part, so that exactly
`SHARE` of the weight is taken each time and the determinant can't rise by more than the width of a bin. It has a lower bound (`FLOORS`), so the steps
end whatever the rows, each start for itself. Of the three the one with the least determinant counts. A row is rejected if its distance from that estimate is beyond `CUT`. A covariance of five statistics needs some rows: groups of fewer than
`LEAST` share one estimate per language, and where even that has fewer there is none and all rows are kept.

Each step is two aggregations with partial sums (a histogram of distances that gives the group's quantile, then means and
covariances), so one source with a third of all rows is no more work for any one task. Estimates and quantiles are one row per
group and start; they are written after every step, and rows are joined with those tables only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import long_id, saved

#: Rows that a concentration step keeps, fall of a determinant's logarithm that counts as none, rows a group needs (ten for each statistic), bins of a distance histogram per unit of its logarithm.
SHARE, SETTLED, LEAST, BINS = 0.75, 0.02, 50, 40
#: Squared distance beyond which a row is rejected (chi-square with 5 degrees of freedom: 0.999999), and the median of that distribution.
CUT, MEDIAN = 35.9, 4.351
#: Least standard deviation of each statistic, so that a group of near-constants rejects nothing for a trifle: 5 % of the number of words and of their
#: length, and shares of the words of 1 % (symbols), 1 % (repeated lines) and 2 % (repeated windows), as square roots.
FLOORS = (0.05, 0.05, 0.1, 0.1, 0.15)
STATS = ("x1", "x2", "x3", "x4", "x5")


def repeated_words(hashes: Column) -> Column:
    """Sorted starts of 8-word windows that stand in the text more than once, from sorted (hash, start) pairs."""
    last = F.size(hashes) - 1
    twice = F.filter(
        F.transform(hashes, lambda x, i: F.struct(x["at"].alias("at"), (((i > 0) & (F.get(hashes, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(hashes, i + 1)["h"] == x["h"]))).alias("twice"))),
        lambda x: x["twice"],
    )
    return F.sort_array(F.transform(twice, lambda x: x["at"]))


def covered(starts: Column, width: int = 8) -> Column:
    """Words under windows of `width` words at sorted starts."""

    def step(state, at):
        end = at + width
        return F.struct((state["n"] + end - F.greatest(at, state["end"])).alias("n"), end.alias("end"))

    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda s: s["n"])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs) of each whole text.

    Null text is empty: all zero. Rows with null or repeated doc_ids are counted like any others.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(long_id(docs), "lang", "source", text.alias("text"))
    blanks = " \t\n\x0b\f\r"
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.char_length(F.translate(x, blanks, "")) > 0)
    words = F.transform(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    rows = rows.select(
        "doc_id", "lang", "source",
        F.char_length(F.translate("text", blanks, "")).alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).alias("n_symbols"),
        lines.alias("lines"), words.alias("words"),
    )
    at = F.sequence(F.lit(0), F.size("words") - 8)
    rows = rows.select("doc_id", "lang", "source", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.size("words").alias("n_words"), F.when(F.size("words") >= 8, F.transform(at, lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(8)]))).alias("hashes"))
    # Most texts repeat no window, and need no more than a set of hashes.
    rows = rows.withColumn("pairs", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at")))))).drop("hashes")
    rows = rows.withColumn("starts", F.when(F.col("pairs").isNotNull(), repeated_words(F.col("pairs")))).drop("pairs")
    repeats = F.when(F.col("starts").isNull(), 0).otherwise(covered(F.col("starts")))
    return rows.select("doc_id", "lang", "source", *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")], repeats.cast("long").alias("n_repeat_words"))


def _vectors(rows: DataFrame) -> DataFrame:
    n = F.col("n_words")
    return rows.select(
        "*",
        F.log(n).alias("x1"), F.log(F.col("word_chars") / n).alias("x2"), F.sqrt(F.col("n_symbols") / n).alias("x3"), F.sqrt(F.col("n_dup_lines") / n).alias("x4"), F.sqrt(F.col("n_repeat_words") / n).alias("x5"),
    )


def _bin(value: str) -> Column:
    return F.ceil(F.log(F.col(value) + 1e-6) * BINS)


def _reached(rows: DataFrame, value: str, share: float, keys: tuple[str, ...]) -> DataFrame:
    """keys, bin, part: the histogram bin in which `share` of a group's rows is reached, and the part of its rows that it takes. The same at every run."""
    bins = rows.groupBy(*keys, _bin(value).alias("bin")).agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))
    wanted = share * F.sum("n").over(Window.partitionBy(*keys))
    found = bins.select(*keys, "bin", (so_far - wanted).alias("over"), "n").where("over >= 0")
    return found.groupBy(*keys).agg(F.min("bin").alias("bin"), F.min_by(1 - F.col("over") / F.col("n"), "bin").alias("part"))


def _quantile(rows: DataFrame, value: str, share: float) -> DataFrame:
    """g, limit: the upper edge of the bin in which `share` of a group's rows is reached."""
    return saved(_reached(rows, value, share, ("g",)).select("g", (F.exp(F.col("bin") / BINS) - 1e-6).alias("limit")), "quantiles")


def _nearest(rows: DataFrame) -> DataFrame:
    """The rows of each group and start with the least d2, with weights w that add up to SHARE of the rows."""
    bounds = saved(_reached(rows, "d2", SHARE, ("g", "start")).withColumnRenamed("bin", "last"), "quantiles")
    near = rows.join(bounds, ["g", "start"]).withColumn("bin", _bin("d2")).where("bin <= last")
    return near.withColumn("w", F.when(F.col("bin") < F.col("last"), 1.0).otherwise(F.col("part")))


def _factor(moments: DataFrame) -> DataFrame:
    """g, start, means, the lower Cholesky factor of each covariance as columns, and the logarithm of its determinant."""
    out = moments
    for i in range(len(STATS)):
        for j in range(i + 1):
            inner = reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)], F.lit(0.0))
            left = F.col(f"c{i}{j}") - inner
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(0.0)) + FLOORS[i] ** 2) if i == j else left / F.col(f"l{j}{j}"))
    det = reduce(lambda a, b: a + b, [2 * F.log(f"l{i}{i}") for i in range(len(STATS))])
    return out.select("g", "start", *[f"m{i}" for i in range(len(STATS))], *[f"l{i}{j}" for i in range(len(STATS)) for j in range(i + 1)], det.alias("det"))


def _distances(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """rows with start and d2, the squared Mahalanobis distance by forward substitution, for each start."""
    out = rows.join(factors, "g")
    for i, x in enumerate(STATS):
        inner = reduce(lambda a, b: a + b, [F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)], F.lit(0.0))
        out = out.withColumn(f"y{i}", (F.col(x) - F.col(f"m{i}") - inner) / F.col(f"l{i}{i}"))
    d2 = reduce(lambda a, b: a + b, [F.col(f"y{i}") ** 2 for i in range(len(STATS))])
    return out.select(*rows.columns, "start", d2.alias("d2"))


def _moments(rows: DataFrame) -> DataFrame:
    """Means and covariances of each group and start, rows weighted by w."""
    pairs = [(i, j) for i in range(len(STATS)) for j in range(i + 1)]
    sums = [F.sum(F.col("w") * F.col(x)).alias(f"s{i}") for i, x in enumerate(STATS)] + [F.sum(F.col("w") * F.col(STATS[i]) * F.col(STATS[j])).alias(f"q{i}{j}") for i, j in pairs]
    mean = [F.col(f"s{i}") / F.col("n") for i in range(len(STATS))]
    return rows.groupBy("g", "start").agg(F.sum("w").alias("n"), *sums).select("g", "start", *[m.alias(f"m{i}") for i, m in enumerate(mean)], *[(F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j]).alias(f"c{i}{j}") for i, j in pairs])


def _starts(rows: DataFrame) -> DataFrame:
    """First estimates of each group: medians with mean deviations, all rows, rows within two mean deviations of every median."""
    shifted = rows
    for i, x in enumerate(STATS):
        # Medians from histograms; every statistic is at least 0.
        shifted = shifted.join(_quantile(rows.select("g", F.greatest(F.col(x), F.lit(0.0)).alias("v")), "v", 0.5).select("g", F.col("limit").alias(f"m{i}")), "g")
    spread = shifted.groupBy("g").agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(len(STATS))], *[F.avg(F.abs(F.col(x) - F.col(f"m{i}"))).alias(f"s{i}") for i, x in enumerate(STATS)])
    spread = saved(spread, "spreads")
    pairs = [(i, j) for i in range(len(STATS)) for j in range(i + 1)]
    flat = spread.select("g", F.lit(1).alias("start"), *[f"m{i}" for i in range(len(STATS))], *[(F.pow(f"s{i}", F.lit(2)) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in pairs])
    near = reduce(lambda a, b: a & b, [F.abs(F.col(x) - F.col(f"m{i}")) <= 2 * F.greatest(F.col(f"s{i}"), F.lit(FLOORS[i])) for i, x in enumerate(STATS)])
    inner = F.explode(F.when(near, F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(2))))
    return flat.unionByName(_moments(rows.join(spread, "g").select("g", *STATS, F.lit(1.0).alias("w"), inner.alias("start"))))


def estimates(rows: DataFrame) -> DataFrame:
    """Robust mean, Cholesky factor and scale of each group g of vectors x1 to x5."""
    # A start's own determinant isn't one of SHARE of the rows: the first step counts as a fall.
    state = saved(_factor(_starts(rows)).withColumns({"det": F.lit(float("inf")), "live": F.lit(True)}), "estimates")
    columns = [c for c in state.columns if c not in ("g", "start", "live")]
    fall = F.col("det") - F.col("new.det")
    while state.where("live").head(1):
        new = _factor(_moments(_nearest(_distances(rows, state.where("live").drop("live")))))
        both = state.join(new.select("g", "start", F.struct(*columns).alias("new")), ["g", "start"], "left")
        state = saved(both.select("g", "start", *[F.when(fall > 0, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in columns], F.coalesce(fall > SETTLED, F.lit(False)).alias("live")), "estimates")
    factors = state.drop("live")
    factors = saved(factors.groupBy("g").agg(F.min_by(F.struct(*[c for c in factors.columns if c != "g"]), F.struct("det", "start")).alias("best")).select("g", "best.*"), "estimates")
    # The kept share is too narrow; its median distance says by how much.
    scale = _quantile(_distances(rows, factors), "d2", 0.5).select("g", F.greatest(F.col("limit") / MEDIAN, F.lit(1.0)).alias("scale"))
    return factors.join(scale, "g")


def judge(docs: DataFrame) -> DataFrame:
    """statistics() of each row with base_failed and kept.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated 8-word windows. kept: false if base_failed, else
    whether the vector is within CUT of its group's robust centre. Null lang or source is a group of its own. An empty table gives an empty
    result; columns other than doc_id, text, lang and source are ignored. Null texts are empty, null and repeated doc_ids are judged like any
    others, equal rows alike, very long texts whole.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = saved(statistics(docs).withColumn("base_failed", failed), "statistics")
    own = F.struct("lang", "source", F.lit(True).alias("own"))
    wide = F.struct("lang", F.lit(None).cast("string").alias("source"), F.lit(False).alias("own"))
    sizes = rows.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    groups = sizes.withColumn("g", F.when(F.col("n") >= LEAST, own).otherwise(wide))
    groups = groups.withColumn("of_group", F.sum("n").over(Window.partitionBy("g"))).where(F.col("of_group") >= LEAST)
    groups = saved(groups.select("lang", "source", F.to_json("g").alias("g")), "groups").select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "g")
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    vectors = _vectors(rows.where("not base_failed")).join(groups, same).select("g", *STATS)
    factors = saved(estimates(saved(vectors, "vectors")), "estimates")
    marked = _vectors(rows).join(groups, same & ~F.col("base_failed"), "left").drop("g_lang", "g_source")
    scaled = _distances(marked.where("g is not null"), factors.drop("scale")).join(factors.select("g", "scale"), "g").withColumn("d2", F.col("d2") / F.col("scale"))
    columns = [*rows.columns]
    kept = scaled.select(*columns, (F.col("d2") <= CUT).alias("kept"))
    rest = marked.where("g is null").select(*columns, (~F.col("base_failed")).alias("kept"))
    return kept.unionByName(rest)
