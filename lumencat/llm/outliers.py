"""Operator 11: quality rules by robust multivariate outliers.

Statistics of each text become a vector of four transformed rates: mean word length, symbols, repeated lines and repeated
words a word. For each language and source the minimum covariance determinant of the vectors of the rows that pass the
base rules gives a location and a scatter that no minority of odd documents can move. A document goes if it fails the base
rules, or if its Mahalanobis distance has a probability below REJECT.

The determinant is sought from three deterministic starts (median and median deviation; sign covariance; covariance of
hyperbolic tangents), each followed by concentration steps: the half of the rows of least distance gives the next location
and scatter. After FIRST_STEPS the start of least determinant goes on alone until its determinant stays as it is (CHANGE) or
ROUNDS are done, and is reweighted by the rows within the 97.5 per cent ellipsoid. FLOOR is added to the scatter, as rates of clean text are mostly
zero, and short texts are drawn towards the median, as their rates vary with their length (SHORT).

Scale: statistics are columns of Spark's own functions, no Python runs in tasks. Texts are read once; their statistics are
stored, a few numbers a row. Medians and the least half come from counts of fixed-point values and of distance classes
with map-side combining, so a group's rows never meet in a task, however many it has; a group's counts are bounded by the
number of values and classes. Sums are of whole numbers, so that results do not depend on the order of rows.

Defined cases: null text has no word and fails the base rules; null language is ``und``, null source an empty one; a group of
under GROUP passing rows is judged with the other small groups of its language, these if still under it with those of all
languages, and if even those are too few every passing row is kept. Repeated rows are rows of their own; extra columns are
ignored; an empty table gives an empty result. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumencat.llm.common import stored, table

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
GROUP = 40
REJECT = 1e-6
#: Concentration steps of every start, then of the best one in each round, of which there are ROUNDS at most.
FIRST_STEPS, ROUNDS = 3, 12
CHANGE = 1e-4
#: Words at which half of a rate's variance is due to the text's length.
SHORT = 50
#: Standard deviations that are added to those of word length, symbols, repeated lines and repeated words.
FLOOR = (0.05, 0.04, 0.04, 0.08)
#: Distance classes to a unit of its logarithm; fixed-point steps to a unit of a vector.
CLASSES, FIXED = 16, 4096

D = len(FLOOR)
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_X = [f"x{i}" for i in range(D)]
_PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def _chi2(x: float, half: int) -> float:
    """Probability of at most x under 2 * half degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))


def _quantile(p_above: float, half: int) -> float:
    """Where _chi2 leaves p_above."""
    lo, hi = 0.0, 2000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.exp(-mid / 2) * sum((mid / 2) ** k / math.factorial(k) for k in range(half)) > p_above else (lo, mid)
    return lo


def _consistency(share: float) -> float:
    """What the scatter of the inner share of a normal sample is multiplied by."""
    return share / _chi2(_quantile(1 - share, D // 2), D // 2 + 1)


def statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """carry and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) of each row's ``text``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(*carry, text.alias("_text"))
    trimmed = F.btrim("_text", F.lit(SPACE))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    d = d.select(
        *carry, F.when(F.length(trimmed) > 0, F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+")).otherwise(F.array().cast("array<string>")).alias("_words"), lines.alias("_lines"),
        F.length(F.translate("_text", SPACE, "")).cast("long").alias("word_chars"), (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    n = F.size("_words")
    windows = F.transform(F.slice("_words", 1, F.greatest(n - (WINDOW - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get("_words", i + k) for k in range(1, WINDOW)]))
    stats = ("n_words", "word_chars", "n_symbols", "n_dup_lines")
    d = d.select(*carry, n.cast("long").alias("n_words"), "word_chars", "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), windows.alias("_windows"))
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    d = d.select(*carry, *stats, F.when(again, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))).alias("_sorted"))
    same = lambda x, i, k: F.get("_sorted", i + k)["h"].eqNullSafe(x["h"])
    starts = F.filter(F.transform("_sorted", lambda x, i: F.when(same(x, i, 1) | same(x, i, -1), x["at"])), lambda x: x.isNotNull())
    d = d.select(*carry, *stats, F.sort_array(starts).alias("_starts"))
    covered = F.transform("_starts", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", i + 1) - x, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select(*carry, *stats, F.coalesce(total, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _vector(d: DataFrame) -> DataFrame:
    """d with the fixed-point vector x0.. of its rates and the weight of its length."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")  # a row without words fails the base rules and is not looked at
    rate = lambda c: F.asinh(F.sqrt(F.col(c) / n))
    values = [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), rate("n_symbols"), rate("n_dup_lines"), rate("n_repeat_words")]
    return d.withColumns({x: F.round(v * FIXED).cast("long") for x, v in zip(_X, values, strict=True)} | {"_n": n})


def _groups(passing: DataFrame) -> DataFrame:
    """(lang, source, g): the group that each language's source is judged by; null where all that is left is too little."""
    n = passing.groupBy("lang", "source").agg(F.count("*").alias("_own"))
    small = n.where(F.col("_own") < GROUP)
    langs = small.groupBy("lang").agg(F.sum("_own").alias("_lang"))
    rest = langs.where(F.col("_lang") < GROUP).agg(F.coalesce(F.sum("_lang"), F.lit(0)).alias("_rest"))
    name = lambda level, *parts: F.concat_ws("\x00", F.lit(level), *parts)
    g = F.when(F.col("_own") >= GROUP, name("s", "lang", "source")).when(F.col("_lang") >= GROUP, name("l", "lang")).when(F.col("_rest") >= GROUP, F.lit("r"))
    return n.join(langs, "lang", "left").crossJoin(rest).select("lang", "source", g.alias("g"))


def _at_count(counts: DataFrame, keys: list[str], value: str, share: Column) -> DataFrame:
    """The least value at which the counts (n) of the keys reach ``share``, a number that may use _all."""
    w = Window.partitionBy(*keys).orderBy(value)
    totals = Window.partitionBy(*keys)
    c = counts.withColumns({"_sum": F.sum("n").over(w), "_all": F.sum("n").over(totals)})
    return c.where(F.col("_sum") >= share).groupBy(*keys).agg(F.min(value).alias(value))


def _medians(rows: DataFrame) -> DataFrame:
    """Lower medians of x0.. by group, one column each; from the counts of their values."""
    each = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(x).alias("v")) for i, x in enumerate(_X)])).alias("e")).select("g", "e.i", "e.v")
    counts = each.groupBy("g", "i", "v").agg(F.count("*").alias("n"))
    found = _at_count(counts, ["g", "i"], "v", F.col("_all") / 2)
    return found.groupBy("g").agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(x) for i, x in enumerate(_X)])


# Sums over vectors are written as SQL texts: a text is parsed at once, where a tree of columns is built call by call.


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Number, sums and sums of products of the whole numbers y0.. of rows by keys."""
    sums = [f"sum(cast(y{i} as double)) as s{i}" for i in range(D)] + [f"sum(cast(y{i} as double) * y{j}) as p{i}{j}" for i, j in _PAIRS]
    return rows.groupBy(*keys).agg(F.count("*").alias("m"), *map(F.expr, sums))


def _estimate(moments: DataFrame, factor: float, *keep: str) -> DataFrame:
    """Location u0.., scatter c00.. of moments: the covariance times factor, and FLOOR."""
    floor = lambda i, j: (FLOOR[i] * FIXED) ** 2 if i == j else 0.0
    scatter = [f"(p{i}{j} / m - s{i} / m * (s{j} / m)) * {factor!r}D + {floor(i, j)!r}D as c{i}{j}" for i, j in _PAIRS]
    return moments.selectExpr(*keep, *[f"s{i} / m as u{i}" for i in range(D)], *scatter)


def _inverted(e: DataFrame) -> DataFrame:
    """e with k00.., the inverse of the scatter's Cholesky factor, and the logarithm of its determinant.

    Each selection computes what depends on the ones before, so that no expression is written out twice.
    """
    kept = e.columns
    less = lambda first, a, b, over: first + "".join(f" - {a(k)} * {b(k)}" for k in over)
    for j in range(D):
        own = less(f"c{j}{j}", lambda k: f"l{j}{k}", lambda k: f"l{j}{k}", range(j))
        e = e.selectExpr("*", f"sqrt(greatest({own}, 1e-9D)) as l{j}{j}")
        below = [f"({less(f'c{i}{j}', lambda k: f'l{i}{k}', lambda k: f'l{j}{k}', range(j))}) / l{j}{j} as l{i}{j}" for i in range(j + 1, D)]
        e = e.selectExpr("*", *below) if below else e
    e = e.selectExpr("*", *[f"1 / l{j}{j} as k{j}{j}" for j in range(D)], " + ".join(f"2 * ln(l{i}{i})" for i in range(D)) + " as det")
    for gap in range(1, D):
        ends = [(j + gap, j) for j in range(D - gap)]
        e = e.selectExpr("*", *[f"({less('0D', lambda m: f'l{i}{m}', lambda m: f'k{m}{j}', range(j, i))}) / l{i}{i} as k{i}{j}" for i, j in ends])
    return e.select(*kept, *[f"k{i}{j}" for i, j in _PAIRS], "det")


def _distance() -> Column:
    """The squared Mahalanobis distance of y0.. by u0.. and k00..."""
    z = ["(" + " + ".join(f"k{i}{j} * (y{j} - u{j})" for j in range(i + 1)) + ")" for i in range(D)]
    return F.expr(" + ".join(f"{v} * {v}" for v in z))


def _shifted(rows: DataFrame, medians: DataFrame) -> DataFrame:
    """rows with y0..: what is left of x0.. without the group's median, less for short texts; whole numbers again."""
    weight = F.sqrt(F.col("_n") / (F.col("_n") + SHORT))
    return rows.join(medians.select("g", *[F.col(x).alias(f"_m{i}") for i, x in enumerate(_X)]), "g").withColumns({f"y{i}": F.round((F.col(x) - F.col(f"_m{i}")) * weight).cast("long") for i, x in enumerate(_X)})


def _starts(rows: DataFrame) -> DataFrame:
    """Three scatters a group around the median (0): (g, start, u0.., c00..)."""
    spread = _medians(rows.select("g", *[F.abs(f"y{i}").alias(x) for i, x in enumerate(_X)]))
    spread = spread.selectExpr("g", *[f"sqrt(power(1.4826D * {x}, 2) + {(FLOOR[i] * FIXED) ** 2!r}D) as d{i}" for i, x in enumerate(_X)])
    z = rows.join(spread, "g").selectExpr("g", *[f"y{i} / d{i} as z{i}" for i in range(D)])
    z = z.selectExpr("*", " + ".join(f"z{i} * z{i}" for i in range(D)) + " as length", *[f"tanh(z{i}) as t{i}" for i in range(D)])
    whole = float(FIXED * FIXED)  # sums of whole numbers do not depend on their order
    sign = [f"sum(if(length > 0, round(z{i} * z{j} / length * {whole!r}D), 0D)) as a{i}{j}" for i, j in _PAIRS]
    bent = [f"sum(round(t{i} * t{j} * {whole!r}D)) as b{i}{j}" for i, j in _PAIRS]
    sums = z.groupBy("g").agg(F.count("*").alias("m"), *map(F.expr, [*sign, *bent])).join(spread, "g")

    def start(k: int, scatter) -> DataFrame:
        return sums.selectExpr("g", f"{k} as start", *[f"0D as u{i}" for i in range(D)], *[f"{scatter(i, j)} as c{i}{j}" for i, j in _PAIRS])

    floor = lambda i, j: (FLOOR[i] * FIXED) ** 2 if i == j else 0.0
    of = lambda at, times: lambda i, j: f"{at}{i}{j} / (m * {whole!r}D) * {times} * d{i} * d{j} + {floor(i, j)!r}D"
    return start(0, lambda i, j: f"d{i} * d{j}" if i == j else "0D").unionByName(start(1, of("a", D))).unionByName(start(2, of("b", 1)))


def _concentrated(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One step of each start: the estimate of the half of the rows of least distance, with ``was``, the determinant before.

    The moments of each class of distances are summed first; those of the classes up to the one that reaches the half are the next
    estimate's. Rows are read once, and only a group's classes meet.
    """
    at = ["g", "start"]
    distance_class = F.floor(F.log(F.greatest(_distance(), F.lit(1e-12))) * CLASSES).cast("int")
    near = rows.join(estimates.select(*at, *_PLACE, "det"), "g").select(*at, "det", *_Y, distance_class.alias("class"))
    sums = _moments(near, [*at, "class", "det"])
    w = Window.partitionBy(*at).orderBy("class")
    so_far = sums.select(*at, F.col("det").alias("was"), F.col("m").alias("_m"), F.sum("m").over(Window.partitionBy(*at)).alias("_all"), *[F.sum(c).over(w).alias(c) for c in ("m", *_MOMENTS)])
    half = F.floor((F.col("_all") + D + 1) / 2)
    reached = so_far.where((F.col("m") >= half) & (F.col("m") - F.col("_m") < half))
    return _inverted(_estimate(reached, _consistency(0.5), *at, "was"))


def minimum_determinant(rows: DataFrame) -> DataFrame:
    """(g, u0.., k00..): the reweighted estimate of each group of the rows' y0..; distances are those of normal vectors."""
    estimates = _starts(rows).transform(_inverted)
    for _ in range(FIRST_STEPS):
        estimates = _concentrated(rows, estimates)
    estimates = stored(estimates, "estimates")
    best = estimates.groupBy("g").agg(F.min_by("start", F.struct("det", "start")).alias("start"))
    estimates = estimates.join(best, ["g", "start"])
    for _ in range(ROUNDS):
        for _ in range(FIRST_STEPS):
            estimates = _concentrated(rows, estimates)
        estimates = stored(estimates, "estimates")
        change = estimates.agg(F.max(F.abs(F.col("det") - F.col("was")))).first()[0]
        if change is None or change < CHANGE:
            break
    inner = rows.join(estimates.select("g", *_PLACE), "g").where(_distance() <= _quantile(0.025, D // 2)).select("g", *_Y)
    return stored(_inverted(_estimate(_moments(inner, ["g"]), _consistency(0.975), "g")).select("g", *_PLACE), "estimate")


_MOMENTS = [*(f"s{i}" for i in range(D)), *(f"p{i}{j}" for i, j in _PAIRS)]
_Y = [f"y{i}" for i in range(D)]
_PLACE = [*(f"u{i}" for i in range(D)), *(f"k{i}{j}" for i, j in _PAIRS)]


def judged(stats: DataFrame, *carry: str) -> DataFrame:
    """carry, the statistics, base_failed, distance (null where none is estimated) and kept for rows with lang and source."""
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    stats = stats.withColumns({"lang": F.coalesce(F.col("lang").cast("string"), F.lit("und")), "source": F.coalesce(F.col("source").cast("string"), F.lit("")), "base_failed": base_failed()})
    passing = _vector(stats.where(~F.col("base_failed")))
    groups = stored(_groups(passing), "groups")
    rows = passing.join(groups.where(F.col("g").isNotNull()), ["lang", "source"]).select("g", "_n", *_X)
    medians = stored(_medians(rows), "medians")
    estimate = minimum_determinant(stored(_shifted(rows, medians).select("g", *_Y), "vectors"))
    own = _vector(stats).join(groups, ["lang", "source"], "left")
    # a row that fails has no say and no distance, and a group without an estimate judges nothing
    placed = medians.join(estimate, "g").select("g", *[F.col(x).alias(f"_m{i}") for i, x in enumerate(_X)], *_PLACE)
    own = own.join(placed, "g", "left")
    weight = F.sqrt(F.col("_n") / (F.col("_n") + SHORT))
    own = own.withColumns({f"y{i}": F.round((F.col(x) - F.col(f"_m{i}")) * weight) for i, x in enumerate(_X)})
    distance = F.when(~F.col("base_failed"), _distance())
    own = own.withColumn("distance", distance)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= _quantile(REJECT, D // 2), F.lit(True))
    return own.select(*carry, *numbers, "base_failed", "distance", kept.alias("kept"))


def op11_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their statistics and verdict; native: no Python runs in tasks."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    stats = stored(statistics(docs, "doc_id", "lang", "source"), "statistics")
    return judged(stats, "doc_id")
