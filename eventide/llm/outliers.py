"""Quality rules: robust multivariate outliers per language and source.

Each document gets a vector of transformed statistics. For every language and source a
minimum-covariance-determinant estimate is fitted by concentration steps: start from
coordinate-wise medians, keep the ``KEEP`` share of rows nearest by Mahalanobis distance,
take mean and covariance of those, repeat. A document is rejected when its distance is over
the cutoff. Everything is DataFrame functions: the Cholesky factor of a group's covariance is
a set of column expressions, and a step is one partial aggregate of moments per group.

Estimates of a group are drawn towards those of its language by ``PRIOR`` rows, so a small
group has a usable covariance, and each variance has a floor, so a statistic that is constant
in a group (no symbols at all) does not make it singular.

Defined results: NULL or empty text has no words and fails the base rule; NULL language or
source is a group of its own; repeated rows count as often as they come; an empty table gives
an empty result; extra columns are carried through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, empty_text, released, written

#: Characters counted as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
KEEP = 0.75
STEPS = 4
PRIOR = 100.0
#: Chi-square scale cutoff of the squared distance (6 statistics, a clean document in 10^9 is
#: beyond 53 under normality; ratios have heavier tails).
CUTOFF = 80.0
#: Smallest standard deviation of each statistic of :func:`vector`. Repeats get a wide one: the
#: base rule already judges them, and one repeated line is no fault.
FLOORS = (0.03, 0.03, 0.12, 0.12, 0.03, 0.03)
#: Words by which ratios are drawn to their usual value, so that short texts are not noisy.
SMOOTH = 25.0
#: Characters of a usual word.
USUAL_CHARS = 5.2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    t = F.btrim(text, F.lit(WHITE))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \t-\r]+"))


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words that lie in a window of ``width`` words found twice or more, the first included.

    Windows are compared by 64-bit hashes. Only a text that has equal windows pays for sorting
    them; the others stop at the count of distinct hashes."""
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        def places(sorted_: Column) -> Column:
            nxt = F.slice(sorted_, 2, F.size(sorted_) - 1)
            pairs = F.filter(F.arrays_zip(sorted_.alias("a"), nxt.alias("b")),
                             lambda p: p["a"]["h"] == p["b"]["h"])
            return F.sort_array(F.array_distinct(F.flatten(
                F.transform(pairs, lambda p: F.array(p["a"]["i"], p["b"]["i"])))))

        def cover(at: Column) -> Column:
            gaps = F.zip_with(at, F.slice(at, 2, F.size(at) - 1),
                              lambda p, q: F.least(F.lit(width), F.coalesce(q - p, F.lit(width))))
            return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)

        spots = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(let(spots, places), cover)

    def windows(h: Column) -> Column:
        m = n - (width - 1)
        names = [f"w{k}" for k in range(width)]
        zipped = F.arrays_zip(*[F.slice(h, F.lit(k + 1), m).alias(names[k]) for k in range(width)])
        return F.transform(zipped, lambda w: F.xxhash64(w))

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    found = let(hashes, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(n < width + 1, F.lit(0)).otherwise(found).cast("long")


def base_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` as a struct column ``row`` with the counts of the base rules beside it."""
    text = empty_text(F.col("text"))
    df = docs.select(F.struct(*docs.columns).alias("row"), text.alias("text"), F.col("lang"), F.col("source"))
    df = df.withColumn("words", words_of(F.col("text")))
    t = F.col("text")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    solid = F.array_join("words", "")
    without = lambda c, pattern: F.length(F.regexp_replace(c, pattern, ""))
    return df.select(
        "row", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length(t) - without(t, f"[{SYMBOLS}]+")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(lines, F.size).cast("long").alias("n_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        without(solid, r"[^\p{L}]+").cast("long").alias("n_letters"),
        (F.length(solid) - without(solid, r"\p{Lu}+")).cast("long").alias("n_upper"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def vector() -> list[Column]:
    """Transformed statistics: square roots of smoothed shares, logarithms of smoothed means."""
    n = F.col("n_words") + F.lit(SMOOTH)
    chars = F.col("word_chars") + F.lit(SMOOTH * USUAL_CHARS)
    return [
        F.log((F.col("word_chars") + F.lit(SMOOTH * USUAL_CHARS)) / n),
        F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + F.lit(5.0))),
        F.sqrt(F.col("n_repeat_words") / n),
        F.sqrt((F.col("n_upper") + F.lit(SMOOTH * 0.2)) / (F.col("n_letters") + F.lit(SMOOTH * USUAL_CHARS))),
        F.sqrt((F.col("word_chars") - F.col("n_letters")) / chars),
    ]


def _cholesky(df: DataFrame, d: int) -> DataFrame:
    """``df(c_0_0..)`` with the columns ``l_i_j`` of the lower factor in place of the covariance.

    A projection per column of the factor: each needs only those before it, and the diagonal is written
    out in the entries below it. One per entry would be a chain that the planner walks again and again."""
    for j in range(d):
        def left(i: int, j: int = j) -> Column:
            s = F.col(f"c_{i}_{j}")
            for k in range(j):
                s = s - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            return s
        diagonal = F.sqrt(F.greatest(left(j), F.lit(min(FLOORS) ** 2 * 0.01)))
        done = [f"c_{i}_{j}" for i in range(j, d)]
        df = df.select(*[c for c in df.columns if c not in done], diagonal.alias(f"l_{j}_{j}"),
                       *[(left(i) / diagonal).alias(f"l_{i}_{j}") for i in range(j + 1, d)])
    return df


def _distance(d: int) -> Column:
    """Squared Mahalanobis distance of x_0.. from m_0.. under the factor l_i_j."""
    z: list[Column] = []
    for i in range(d):
        s = F.col(f"x_{i}") - F.col(f"m_{i}")
        for k in range(i):
            s = s - F.col(f"l_{i}_{k}") * z[k]
        z.append(s / F.col(f"l_{i}_{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _estimates(moments: DataFrame, d: int, factor: float) -> DataFrame:
    """Means and Cholesky factors from sums: language groups first, then sources drawn to them."""
    def mean_cov(n: Column, p: str) -> tuple[list[Column], dict]:
        m = [F.col(f"{p}s_{i}") / n for i in range(d)]
        c = {(i, j): F.col(f"{p}s_{i}_{j}") / n - m[i] * m[j] for i in range(d) for j in range(i + 1)}
        return m, c

    sums = ["n"] + [f"s_{i}" for i in range(d)] + [f"s_{i}_{j}" for i in range(d) for j in range(i + 1)]
    whole = moments.where("level = 0").select(F.col("lang").alias("p_lang"), *[F.col(c).alias(f"p{c}") for c in sums])
    both = moments.join(whole, F.col("lang").eqNullSafe(F.col("p_lang")))
    n = F.col("n")
    m, c = mean_cov(n, "")
    pm, pc = mean_cov(F.col("pn"), "p")
    w = F.when(F.col("level") == 0, F.lit(1.0)).otherwise(n / (n + F.lit(PRIOR)))
    out = both.select("level", "lang", "source",
                      *[(w * m[i] + (1 - w) * pm[i]).alias(f"m_{i}") for i in range(d)],
                      *[(F.lit(factor) * (w * c[k] + (1 - w) * pc[k])
                         + F.lit(FLOORS[k[0]] ** 2 if k[0] == k[1] else 0.0)).alias(f"c_{k[0]}_{k[1]}") for k in c])
    return _cholesky(out, d)


def _moments(rows: DataFrame, d: int) -> DataFrame:
    return rows.groupBy("level", "lang", "source").agg(
        F.count("*").cast("double").alias("n"), *[F.sum(f"x_{i}").alias(f"s_{i}") for i in range(d)],
        *[F.sum(F.col(f"x_{i}") * F.col(f"x_{j}")).alias(f"s_{i}_{j}") for i in range(d) for j in range(i + 1)])


def _with_distance(points: DataFrame, est: DataFrame, d: int) -> DataFrame:
    """``points`` and the squared distance from the estimate of their own group."""
    e = est.select(*[F.col(c).alias(f"e_{c}") if c in ("level", "lang", "source") else F.col(c) for c in est.columns])
    same = ((F.col("level") == F.col("e_level")) & F.col("lang").eqNullSafe(F.col("e_lang"))
            & F.col("source").eqNullSafe(F.col("e_source")))
    return points.join(e, same).withColumn("distance", _distance(d)).drop(*e.columns)


def fit(points: DataFrame, d: int, steps: int = STEPS, keep: float = KEEP) -> DataFrame:
    """Robust estimates of ``points(lang, source, x_0..)``: one row per group at level 1
    (language and source) and at level 0 (language).

    Every pass reads the narrow ``points`` table; medians, edges, moments and estimates are written
    (one row per group), so that their small size is known when they are joined. The estimates read
    the moments of languages and of sources, so with these written no plan holds a pass twice; the
    driver lets go of each plan before it makes the next."""
    spark = points.sparkSession
    xs = [f"x_{i}" for i in range(d)]
    both = points.select("lang", "source", *xs).withColumn("level", F.lit(1)).unionByName(
        points.select("lang", F.lit(None).cast("string").alias("source"), *xs).withColumn("level", F.lit(0)))
    keys = ["level", "lang", "source"]
    mid = both.groupBy(*keys).agg(*[F.percentile_approx(x, 0.5, 1000).alias(x.replace("x", "m")) for x in xs])
    # the first distances are from the medians with equal scales: an identity factor
    unit = [F.lit(1.0 if i == j else 0.0).alias(f"l_{i}_{j}") for i in range(d) for j in range(i + 1)]
    est = written(mid.select("*", *unit), "mcd")
    released(spark)
    # the covariance of the inner rows is too small; drawn up by one fixed factor
    factor = 1.0 / keep
    for _ in range(steps):
        near = _with_distance(both, est, d)
        edge = written(near.groupBy(*keys).agg(F.percentile_approx("distance", keep, 1000).alias("edge")), "mcd-edge")
        released(spark)
        e = edge.select(*[F.col(k).alias(f"e_{k}") for k in keys], "edge")
        same = ((F.col("level") == F.col("e_level")) & F.col("lang").eqNullSafe(F.col("e_lang"))
                & F.col("source").eqNullSafe(F.col("e_source")) & (F.col("distance") <= F.col("edge")))
        moments = written(_moments(near.join(e, same), d), "mcd-moments")
        released(spark)
        est = written(_estimates(moments, d, factor), "mcd")
        released(spark)
    return est


def statistics(docs: DataFrame) -> DataFrame:
    """``row`` (the whole document as a struct), the base counts, ``base_failed`` and the vector."""
    return base_statistics(docs).select(
        "*", base_failed().alias("base_failed"),
        *[x.cast("double").alias(f"x_{i}") for i, x in enumerate(vector())])


def judged(stats: DataFrame, est: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``stats`` with ``distance`` and ``kept`` by the estimate of each row's language and source."""
    d = len(vector())
    out = _with_distance(stats.withColumn("level", F.lit(1)), est, d).drop("level")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= F.lit(cutoff)))


def quality(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """One row per document of ``docs(doc_id, text, lang, source)``: doc_id, lang, source, the base
    counts, base_failed, distance and kept."""
    stats = statistics(docs)
    points = written(stats.select("row.doc_id", *[c for c in stats.columns if c != "row"]), "mcd-points")
    return judged(points, fit(points, len(vector())), cutoff)


def keep_good(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The documents that the rules keep, with their own columns only.

    The statistics are computed twice, once narrow for the fit and once beside the text for the
    filter, so that no text is shuffled. A generator of one row stands between them and the
    distance: without it the optimizer puts each statistic's whole expression into every place
    of the distance that names it."""
    stats = statistics(docs)
    counted = F.explode(F.array(F.struct(*[c for c in stats.columns if c != "row"]))).alias("s")
    stats = stats.select("row", counted).select("row", "s.*")
    points = written(stats.select("lang", "source", *[f"x_{i}" for i in range(len(vector()))]), "mcd-points")
    return judged(stats, fit(points, len(vector())), cutoff).where("kept").select("row.*")
