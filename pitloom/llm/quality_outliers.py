"""Operator 10: quality rules and robust multivariate outliers (minimum covariance determinant), native throughout.

Each text gives four base counts and, from them, a vector of four transformed statistics. For every (lang, source)
group the minimum-covariance-determinant estimate is found by concentration steps: from medians and scaled absolute
deviations, the half of the rows with the least Mahalanobis distance gives the next mean and covariance, and so on.
A row is rejected if it fails the base rules or if its squared distance under its group's consistent, reweighted
estimate is beyond a high chi-square quantile.

All of it is grouped sums and joins with one row per group: nothing is collected, and a group of any size is summed
map-side first. Order statistics of distances come from histograms in steps of 1/64 on the log scale (exact counts,
mergeable), so the half is known to 1.6 % of a distance. A covariance of few rows means nothing, so every group's estimate
is mixed with that of all rows as if the group had ``PRIOR`` more rows that are spread like all rows: its mean, and its
covariance with the part that lies between the two means. The weight falls smoothly with the group's size.

Defined results: a null or wordless text has no words, all counts are 0, it fails the base rules and takes no part in
the estimates; null lang or source are groups like any other; repeated rows are judged alike; an empty table gives no
rows; input columns are kept by ``filter_outliers`` and other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitloom.llm.common import materialise, stored, text_or_empty

#: Fixed rules: fewest words, and the largest share of repeated words in percent.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Share of a group's rows in the estimate, concentration steps, tail beyond which a row is an outlier.
HALF, STEPS, TAIL = 0.5, 5, 1e-9
PRIOR = 20
#: Least standard deviation of each statistic, in its own transformed unit: statistics that are zero for most rows
#: have no spread in the half, and a single symbol is no outlier. The cut is 6.92 of them away, and each statistic can
#: reach it: repetition from none at 31 in 100 words.
FLOORS = (0.5, 0.1, 0.5, 0.5)

P = len(FLOORS)
_WHITE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Steps of the log scale in distance histograms; statistics are rounded to this fraction, so that their sums and
#: sums of products are exact in doubles and do not depend on the order of rows.
_BINS, _GRID = 64, 256
#: The most groups whose estimates are broadcast; more are joined by a shuffle.
BROADCAST_GROUPS = 10_000
_X = [f"x{i}" for i in range(P)]
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def chi2_quantile(q: float, p: int = P) -> float:
    """Quantile of the chi-square distribution with even ``p`` degrees of freedom (closed tail sum, bisection)."""
    if p % 2:
        raise ValueError("even degrees of freedom only")
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))
        low, high = (x, high) if tail > 1 - q else (low, x)
    return (low + high) / 2


def _tail(x: float, p: int) -> float:
    """Chance that a chi-square variable with even ``p`` degrees of freedom exceeds ``x``."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def _consistency(share: Column) -> Column:
    """What a covariance of the ``share`` of rows of least distance is multiplied by, for normal data (by percent)."""
    factors = [F.lit(k / 100 / (1 - _tail(chi2_quantile(k / 100), P + 2))) for k in range(1, 100)]
    percent = F.least(F.greatest(F.round(100 * share), F.lit(1)), F.lit(99)).cast("int")
    return F.element_at(F.array(*factors), percent)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


#: Hashes of all 3-word windows, each with its position in as many low bits as the number of words needs.
_WINDOWS = """
  CASE WHEN size({w}) < 3 THEN cast(array() AS array<bigint>)
       ELSE sort_array(transform(sequence(0, size({w}) - 3), i ->
              shiftleft(shiftright(xxhash64({w}[i], {w}[i + 1], {w}[i + 2]), {b}), {b}) | cast(i AS bigint))) END
"""
#: Once sorted, windows of equal hashes are neighbours: x and the next one y of a sorted array.
_SAME_HASH = "shiftright({x} ^ {y}, {b}) = 0"
_PLACE = "cast({x} & (shiftleft(1L, {b}) - 1) AS int)"
_SAME_WORDS = "({w}[{p}] = {w}[{q}] AND {w}[{p} + 1] = {w}[{q} + 1] AND {w}[{p} + 2] = {w}[{q} + 2])"
#: Neighbours of equal hashes whose words differ: where there are none, equal hashes are equal windows.
_COLLISIONS = """
  size(filter({s}, (x, k) -> {same_hash} AND NOT {same_words}))
"""
#: Places of windows found twice or more, by their hashes, and by their words (words hold no space).
_BY_HASH = """
  transform(filter({s}, (x, k) -> {same_hash} OR {same_before}), x -> {place})
"""
_BY_WORDS = """
  flatten(transform(
    array(sort_array(transform({s}, x -> named_struct(
      'g', concat_ws(' ', {w}[{place}], {w}[{place} + 1], {w}[{place} + 2]), 'p', {place})))),
    a -> transform(filter(a, (x, k) -> x.g = get(a, k + 1).g OR x.g = get(a, k - 1).g), x -> x.p)))
"""
_REPEATED = """
  cast(size(array_distinct(flatten(transform(
    CASE WHEN {collisions} = 0 THEN {by_hash} ELSE {by_words} END,
    p -> array(p, p + 1, p + 2))))) AS bigint)
"""


def _repeated(w: str, s: str, b: str) -> Column:
    """Words in 3-word windows found twice or more, from the words, the sorted window hashes and the bits of a place."""
    after, before = f"get({s}, k + 1)", f"get({s}, k - 1)"
    place, place_after = _PLACE.format(x="x", b=b), _PLACE.format(x=after, b=b)
    parts = {
        "s": s,
        "w": w,
        "place": place,
        "same_hash": _SAME_HASH.format(x="x", y=after, b=b),
        "same_before": _SAME_HASH.format(x="x", y=before, b=b),
        "same_words": _SAME_WORDS.format(w=w, p=place, q=place_after),
    }
    made = {"collisions": _COLLISIONS, "by_hash": _BY_HASH, "by_words": _BY_WORDS}
    return F.expr(_REPEATED.format(**{name: sql.format(**parts) for name, sql in made.items()}))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_BASE, _ESTIMATE, _KEPT = "__pitloom_base", "__pitloom_estimate", "__pitloom_kept"
_GROUP = ("__pitloom_everything", "lang", "source")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once a row: a filter on it is not moved below, where each use would repeat it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_counts(docs: DataFrame, text_col: str = "text", name: str = _BASE) -> DataFrame:
    """``docs`` with a struct column ``name`` of the five counts.

    3-word windows are found by hashes and compared by their words, so the counts are exact.
    """
    w, s, b = f"{name}_w", f"{name}_s", f"{name}_b"
    text = text_or_empty(text_col)
    bare = _without(text, _WHITE)
    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, _WHITE) != "")
    split = _once(docs, w, F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != ""))
    sized = split.withColumn(b, F.length(F.bin(F.size(w).cast("long"))))
    hashed = _once(sized, s, F.expr(_WINDOWS.format(w=f"`{w}`", b=f"`{b}`")))
    counted = _once(
        hashed,
        name,
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(bare).cast("long").alias("word_chars"),
            (F.length(bare) - F.length(_without(bare, _SYMBOLS))).cast("long").alias("n_symbols"),
            F.aggregate(
                F.array(lines), F.lit(0).cast("long"), lambda a, x: a + F.size(x) - F.size(F.array_distinct(x))
            ).alias("n_dup_lines"),
            _repeated(f"`{w}`", f"`{s}`", f"`{b}`").alias("n_repeat_words"),
        ),
    )
    return counted.drop(w, s, b)


def base_failed(c: Column) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def statistics(c: Column) -> list[Column]:
    """Transformed statistics of a counts struct: words, word length, symbols and repetition per 100 words, as logs."""
    n = F.greatest(c["n_words"], F.lit(1)).cast("double")
    raw = [
        F.log1p(c["n_words"].cast("double")),
        F.log(F.greatest(c["word_chars"].cast("double") / n, F.lit(1.0))),
        F.log1p(100 * c["n_symbols"] / n),
        F.log1p(100 * (c["n_repeat_words"] + c["n_dup_lines"]) / n),
    ]
    return [F.round(x * _GRID) / _GRID for x in raw]


def _distance(x: list[Column], of: Callable[[str], Column]) -> Column:
    """Squared Mahalanobis distance under the mean m0... and inverse Cholesky factor i00... that ``of`` gives."""
    z = [sum((of(f"i{r}{k}") * (x[k] - of(f"m{k}")) for k in range(r + 1)), F.lit(0.0)) for r in range(P)]
    return sum((v * v for v in z), F.lit(0.0))


def _covariances(moments: DataFrame, factor: Column) -> DataFrame:
    """Mean and covariance from sums: the covariance times ``factor``, plus the floors' variances."""
    df = moments.withColumn("f", factor)
    for k in range(P):
        df = df.withColumn(f"m{k}", F.col(f"s{k}") / F.col("h"))
    for r, k in _PAIRS:
        cov = (F.col(f"s{r}{k}") / F.col("h") - F.col(f"m{r}") * F.col(f"m{k}")) * F.col("f")
        df = df.withColumn(f"c{r}{k}", cov + F.lit(FLOORS[r] ** 2 if r == k else 0.0))
    return df.select(*_GROUP, "n", *[f"m{k}" for k in range(P)], *[f"c{r}{k}" for r, k in _PAIRS])


def _mixed(covariances: DataFrame) -> DataFrame:
    """Means and covariances mixed with those of all rows, which count as ``PRIOR`` rows of each group."""
    whole = covariances.filter(F.col(_GROUP[0])).first()  # one row
    if whole is None:
        return covariances
    own = F.col("n") / (F.col("n") + F.lit(PRIOR))
    gap = [F.col(f"m{k}") - F.lit(float(whole[f"m{k}"])) for k in range(P)]
    mean = [(F.lit(float(whole[f"m{k}"])) + own * gap[k]).alias(f"m{k}") for k in range(P)]
    cov = [
        (own * F.col(f"c{r}{k}") + (1 - own) * F.lit(float(whole[f"c{r}{k}"])) + own * (1 - own) * gap[r] * gap[k]).alias(f"c{r}{k}")
        for r, k in _PAIRS
    ]
    return covariances.select(*_GROUP, "n", *mean, *cov)


def _factored(covariances: DataFrame) -> DataFrame:
    """Mean and inverse Cholesky factor from mean and covariance."""
    df = covariances
    for r in range(P):  # Cholesky, row by row
        for k in range(r + 1):
            rest = F.col(f"c{r}{k}") - sum((F.col(f"l{r}{j}") * F.col(f"l{k}{j}") for j in range(k)), F.lit(0.0))
            df = df.withColumn(f"l{r}{k}", F.sqrt(rest) if r == k else rest / F.col(f"l{k}{k}"))
    for r in range(P):
        for k in range(r + 1):
            inner = sum((F.col(f"l{r}{j}") * F.col(f"i{j}{k}") for j in range(k, r)), F.lit(0.0))
            df = df.withColumn(f"i{r}{k}", ((1.0 if r == k else 0.0) - inner) / F.col(f"l{r}{r}"))
    return df.select(*_GROUP, "n", *[f"m{k}" for k in range(P)], *[f"i{r}{k}" for r, k in _PAIRS])


def _with_estimates(rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    """Adds the struct column ``_ESTIMATE`` of each row's group; ``rows`` has the columns of ``_GROUP``."""
    keys = [F.col(c).alias(f"{_ESTIMATE}_{c}") for c in _GROUP]
    e = estimates.select(*keys, F.struct(*[c for c in estimates.columns if c not in _GROUP]).alias(_ESTIMATE))
    same = [F.col(c).eqNullSafe(F.col(f"{_ESTIMATE}_{c}")) for c in _GROUP]
    small = estimates.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    joined = rows.join(F.broadcast(e) if small else e, same, how)
    return joined.drop(*[f"{_ESTIMATE}_{c}" for c in _GROUP])


def _bin(d: Column) -> Column:
    return F.floor(F.log2(d + 2.0**-20) * _BINS).cast("int")


def _sums() -> list[Column]:
    return (
        [F.count(F.lit(1)).alias("h")]
        + [F.sum(f"x{k}").alias(f"s{k}") for k in range(P)]
        + [F.sum(F.col(f"x{r}") * F.col(f"x{k}")).alias(f"s{r}{k}") for r, k in _PAIRS]
    )


def _nearest(rows: DataFrame, estimates: DataFrame, upto: Column) -> DataFrame:
    """Sums over each group's rows of least distance; ``upto`` says by (cumulated, n, bin) whether a bin belongs."""
    d = _distance([F.col(f"x{k}") for k in range(P)], lambda c: F.col(f"{_ESTIMATE}.{c}"))
    binned = _with_estimates(rows, estimates).withColumn("bin", _bin(d)).withColumn("n", F.col(f"{_ESTIMATE}.n"))
    by_bin = binned.groupBy(*_GROUP, "n", "bin").agg(*_sums())
    # A few thousand bins a group at most.
    before = Window.partitionBy(*_GROUP).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    chosen = by_bin.withColumn("cumulated", F.coalesce(F.sum("h").over(before), F.lit(0))).filter(upto)
    names = ["h", *[f"s{k}" for k in range(P)], *[f"s{r}{k}" for r, k in _PAIRS]]
    return chosen.groupBy(*_GROUP, "n").agg(*[F.sum(c).alias(c) for c in names])


def estimate(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant estimates of ``docs`` (lang, source and the counts struct): a row per group.

    The group of all rows has its first column true and null lang and source.
    """
    counts = F.col(_BASE)
    xs = [x.alias(f"x{k}") for k, x in enumerate(statistics(counts))]
    own = materialise(docs.filter(counts["n_words"] > 0).select(F.lit(False).alias(_GROUP[0]), "lang", "source", *xs))
    null = F.lit(None)
    whole = own.select(
        F.lit(True).alias(_GROUP[0]),
        null.cast(own.schema["lang"].dataType).alias("lang"),
        null.cast(own.schema["source"].dataType).alias("source"),
        *[f"x{k}" for k in range(P)],
    )
    rows = own.unionAll(whole)
    # Statistics lie on a grid, so exact medians hold a bounded number of distinct values per group.
    middle = materialise(
        rows.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"), *[F.median(f"x{k}").alias(f"m{k}") for k in range(P)])
    )
    away = [F.median(F.abs(F.col(f"x{k}") - F.col(f"{_ESTIMATE}.m{k}"))).alias(f"a{k}") for k in range(P)]
    first = [F.first(f"{_ESTIMATE}.{c}").alias(c) for c in ("n", *[f"m{k}" for k in range(P)])]
    spread = _with_estimates(rows, middle).groupBy(*_GROUP).agg(*first, *away)
    inverse = [
        (1 / F.sqrt((1.4826 * F.col(f"a{r}")) ** 2 + FLOORS[r] ** 2) if r == k else F.lit(0.0)).alias(f"i{r}{k}")
        for r, k in _PAIRS
    ]
    current = materialise(spread.select(*_GROUP, "n", *[f"m{k}" for k in range(P)], *inverse))
    for _ in range(steps):
        half = _nearest(rows, current, F.col("cumulated") < HALF * F.col("n"))
        current = materialise(_factored(_covariances(half, _consistency(F.col("h") / F.col("n")))))
    # One reweighting step over all rows that are no clear outliers.
    edge = chi2_quantile(0.975)
    last = math.floor(math.log2(edge + 2.0**-20) * _BINS)
    kept = _nearest(rows, current, F.col("bin") <= last)
    return materialise(_factored(_mixed(materialise(_covariances(kept, F.lit(0.975 / (1 - _tail(edge, P + 2))))))))


def with_verdict(docs: DataFrame, estimates: DataFrame, tail: float = TAIL) -> DataFrame:
    """Adds ``_KEPT``: the base rules hold and the row is no outlier of its group (of all rows if that has no estimate)."""
    everything = estimates.filter(F.col(_GROUP[0])).first()  # one row
    own = estimates.filter(~F.col(_GROUP[0]))
    joined = _with_estimates(docs.withColumn(_GROUP[0], F.lit(False)), own, "left").drop(_GROUP[0])

    def of(name: str) -> Column:
        whole = F.lit(float(everything[name]) if everything else 0.0)
        return F.coalesce(F.col(f"{_ESTIMATE}.{name}"), whole)

    counts = F.col(_BASE)
    d = _distance(statistics(counts), of)
    return joined.withColumn(_KEPT, ~base_failed(counts) & (d <= chi2_quantile(1 - tail))).drop(_ESTIMATE)


def filter_outliers(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """The rows of ``docs`` (any columns that Parquet holds) that pass the base rules and are no outliers.

    Rows are stored once with their counts: copying texts costs less than counting them again.
    """
    counted = stored(with_counts(docs), "outlier-counts")
    return with_verdict(counted, estimate(counted), tail).filter(F.col(_KEPT)).drop(_BASE, _KEPT)


def outlier_report(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """doc_id, the five counts, base_failed and kept for every row; the text is read once."""
    counted = materialise(with_counts(docs.select("doc_id", "lang", "source", "text")).drop("text"))
    judged = with_verdict(counted, estimate(counted), tail)
    counts = F.col(_BASE)
    return judged.select(
        "doc_id", *[counts[c].alias(c) for c in COUNTS], base_failed(counts).alias("base_failed"), F.col(_KEPT).alias("kept")
    )
