"""Robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Six transformed statistics of each text form a vector. For every (lang, source) the centre
and covariance come from the half of its vectors that concentration steps settle on, run from
several starts until no determinant falls any more, the least one kept. To the covariance comes
the sampling variance of the document's own statistics, so that a short text is not an outlier
for being short. A document goes when its squared Mahalanobis distance exceeds a quantile of
chi-squared. All of it is column arithmetic: no Python runs on executors.

Defined results
- null text: no words, so base_failed and not kept; null lang or source: a group of its own.
- groups under `min_group` documents are pooled by language, then all together; a pool still
  under it rejects nothing beyond the base rule.
- repeated rows each get their own, equal verdict; further columns, whatever their names, are passed through.
- ties: rows at the edge of a half belong to it; of starts with equal determinants the first counts.
- very long texts: counted whole, a row at a time. An empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WHITE, cut, discard, let, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
FEATURES = ["x1", "x2", "x3", "x4", "x5", "x6"]
#: Against singular matrices: the ridge's standard deviation, as a share of the statistic's own in the group.
RIDGE = 0.1
TINY = 1e-8
#: Median of chi-squared with six degrees of freedom, for consistency at the normal.
CHI_MEDIAN = 5.348
#: Its quantile at 0.9999.
CUTOFF = 27.856
#: A determinant that falls by less (in logarithms) has converged.
SETTLED = 1e-3
MIN_GROUP = 50
#: The sampling variance of each statistic, as output columns of with_statistics.
NOISE = ["v1", "v2", "v3", "v4", "v5", "v6"]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeats(w: Column) -> Column:
    """Words inside 8-word windows that occur twice or more, the first occurrence included."""

    def covered(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twin = lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"])
            starts = F.sort_array(F.transform(F.filter(s, lambda e, j: F.coalesce(twin(e, j), F.lit(False))), lambda e: e["i"]))
            gaps = lambda p: F.transform(p, lambda q, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - q, F.lit(WINDOW))))
            return let(starts, lambda p: F.aggregate(gaps(p), F.lit(0), lambda a, b: a + b))

        numbered = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(numbered), of_sorted))

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(hashes, covered))


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The base counts and the transformed statistics of every whole text, beside the columns `keep`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(
        *keep,
        F.length(text).alias("__chars"),
        without(WHITE).alias("word_chars"),
        F.length(F.translate(text, SYMBOLS, "")).alias("__plain"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("__upper"),
        F.length(F.regexp_replace(text, r"\p{L}+", "")).alias("__other"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("__lines"),
        let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), _repeats(w).alias("rep"))).alias("__words"),
    )
    n, chars = F.greatest(F.col("__words.n"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    symbols, spaces = F.col("__chars") - F.col("__plain"), F.col("__chars") - F.col("word_chars")
    return counted.select(
        *keep,
        F.col("__words.n").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        F.col("__lines.dup").cast("long").alias("n_dup_lines"),
        F.col("__words.rep").cast("long").alias("n_repeat_words"),
        ((F.col("__words.n") < 20) | (100 * F.col("__words.rep") > 30 * F.col("__words.n"))).alias("base_failed"),
        F.sqrt(symbols / chars).alias("x1"),
        F.sqrt(F.greatest(F.col("__other") - spaces - symbols, F.lit(0)) / chars).alias("x2"),
        F.sqrt(F.col("__upper") / chars).alias("x3"),
        F.log(chars / n).alias("x4"),
        F.sqrt(F.col("__lines.dup") / F.greatest(F.col("__lines.n"), F.lit(1))).alias("x5"),
        F.sqrt(F.col("__words.rep") / n).alias("x6"),
        # a square root of a count's share varies by 1/(4n), repeats come by windows, a word's length varies by half of itself
        *[(0.25 / chars).alias(f"v{i}") for i in (1, 2, 3)],
        (0.25 / n).alias("v4"),
        (0.25 / F.greatest(F.col("__lines.n"), F.lit(1))).alias("v5"),
        (0.25 * (WINDOW + 1) / n).alias("v6"),
    )


def _with_groups(stats: DataFrame, min_group: int) -> DataFrame:
    """Adds __g: the group whose estimate judges the row, null where there is none."""
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    stats = stats.withColumn("__a", F.concat_ws("\x01", text("lang"), text("source"))).withColumn("__l", text("lang"))
    sizes = stats.where(~F.col("base_failed")).groupBy("__a", "__l").agg(F.count("*").alias("n"))
    small = sizes.withColumn("g", F.when(F.col("n") >= min_group, F.col("__a")).otherwise(F.concat(F.lit("lang\x01"), F.col("__l"))))
    pools = small.groupBy("g").agg(F.sum("n").alias("m")).withColumn("h", F.when(F.col("m") >= min_group, F.col("g")).otherwise(F.lit("all")))
    every = pools.groupBy("h").agg(F.sum("m").alias("t"))
    names = small.join(pools, "g").join(every, "h").select("__a", F.when(F.col("t") >= min_group, F.col("h")).alias("__g"))
    return stats.join(names, "__a", "left").drop("__a", "__l")


def _swept(matrix: Column, pivots: int) -> Column:
    """A struct of the symmetric matrix (an array of rows) with its first `pivots` rows swept, and the logarithm of their determinant.

    The swept block is minus its inverse; what is left of the matrix is the Schur complement. One
    expression whatever the size, so that plans stay small.
    """

    def pivot(held: Column, k: Column) -> Column:
        own = F.get(held["a"], k)
        d = F.greatest(F.get(own, k), F.lit(TINY**2))
        cell = lambda row, v, i, j: F.when((i == k) & (j == k), -1 / d).when((i == k) | (j == k), v / d).otherwise(v - F.get(row, k) * F.get(own, j) / d)
        rows = F.transform(held["a"], lambda row, i: F.transform(row, lambda v, j: cell(row, v, i, j)))
        return F.struct(rows.alias("a"), (held["ld"] + F.log(d)).alias("ld"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(pivots - 1)), F.struct(matrix.alias("a"), F.lit(0.0).alias("ld")), pivot)


def _matrix(entry) -> Column:
    """An array of rows of entry(i, j)."""
    p = len(FEATURES)
    return F.array(*[F.array(*[entry(max(i, j), min(i, j)) for j in range(p)]) for i in range(p)])


def _moments() -> list[Column]:
    """Weighted sums, by a column w, that _factor reads."""
    p, x = len(FEATURES), [F.col(c) for c in FEATURES]
    sums = [F.sum(F.col("w") * x[i]).alias(f"s{i}") for i in range(p)]
    return [F.sum("w").alias("n"), *sums, *[F.sum(F.col("w") * x[i] * x[j]).alias(f"q{i}{j}") for i in range(p) for j in range(i + 1)]]


def _factor(moments: DataFrame, scales: DataFrame) -> DataFrame:
    """(__g, __s, m, c, inv, ld): means, covariance with its ridge, minus its inverse and the logarithm of its determinant."""
    p = len(FEATURES)
    mean = lambda i: F.col(f"s{i}") / F.col("n")
    part = lambda i, j: F.col(f"q{i}{j}") / F.col("n") - mean(i) * mean(j)
    entry = lambda i, j: F.greatest(part(i, i), F.lit(0.0)) + F.get("r", F.lit(i)) if i == j else part(i, j)
    full = moments.join(scales.select("__g", "r"), "__g").select("__g", "__s", F.array(*[mean(i) for i in range(p)]).alias("m"), _matrix(entry).alias("c"))
    return _inverted(full)


def _inverted(full: DataFrame) -> DataFrame:
    return full.select("__g", "__s", "m", "c", _swept(F.col("c"), len(FEATURES)).alias("x")).select("__g", "__s", "m", "c", F.col("x.a").alias("inv"), F.col("x.ld").alias("ld"))


def _distance() -> Column:
    """The squared Mahalanobis distance by the columns m and inv beside a row."""
    p = len(FEATURES)
    off = [F.col(x) - F.get("m", F.lit(i)) for i, x in enumerate(FEATURES)]
    terms = [-F.get(F.get("inv", F.lit(i)), F.lit(j)) * off[i] * off[j] * (1.0 if i == j else 2.0) for i in range(p) for j in range(i + 1)]
    return sum(terms[1:], terms[0])


def _step(rows: DataFrame, state: DataFrame, scales: DataFrame) -> DataFrame:
    """A concentration step of every group and start in state.

    The half of a group nearest to its centre is found on a histogram of distances, so that no
    group is sorted in one task.
    """
    near = rows.join(state.select("__g", "__s", "m", "inv"), "__g").select("__g", "__s", *FEATURES, F.floor(F.log2(_distance() + 1e-6) * 64).cast("int").alias("__bin"))
    bins = near.groupBy("__g", "__s", "__bin").agg(F.count("*").alias("n"))
    own = Window.partitionBy("__g", "__s")
    ranked = bins.withColumn("upto", F.sum("n").over(own.orderBy("__bin"))).withColumn("all", F.sum("n").over(own))
    edge = cut(ranked.where(2 * F.col("upto") >= F.col("all")).groupBy("__g", "__s").agg(F.min("__bin").alias("__edge")), "mcd")
    inner = near.join(edge, ["__g", "__s"]).where(F.col("__bin") <= F.col("__edge")).withColumn("w", F.lit(1.0))
    out = cut(_factor(inner.groupBy("__g", "__s").agg(*_moments()), scales), "mcd")
    discard(edge)
    return out


def estimate(rows: DataFrame) -> DataFrame:
    """(__g, m, c, __c): the minimum-covariance-determinant estimate of each group __g, by concentration steps.

    Starts: median and median absolute deviation; moments weighted by the distance from them;
    plain moments. A start takes part until its determinant falls no more; the least one is kept.
    __c widens the covariance to the median distance of the normal.
    """
    p = len(FEATURES)
    half = lambda c: F.percentile_approx(c, F.lit(0.5), F.lit(2000))
    ridge = F.array(*[F.var_pop(x) * RIDGE**2 + TINY for x in FEATURES]).alias("r")
    scales = cut(rows.groupBy("__g").agg(F.array(*[half(F.col(x)) for x in FEATURES]).alias("m"), ridge), "mcd")
    spread = [half(F.abs(F.col(x) - F.get("m", F.lit(i)))).alias(f"a{i}") for i, x in enumerate(FEATURES)]
    spread = rows.join(scales.select("__g", "m"), "__g").groupBy("__g").agg(*spread).join(scales, "__g")
    entry = lambda i, j: F.pow(F.col(f"a{i}") * 1.4826, 2) + F.get("r", F.lit(i)) if i == j else F.lit(0.0)
    plain = _inverted(spread.select("__g", F.lit(0).alias("__s"), "m", _matrix(entry).alias("c")))
    plain = cut(plain.withColumn("ld", F.lit(float("inf"))), "mcd")
    weights = F.explode(F.array(F.struct(F.lit(1).alias("__s"), (1 / (1 + F.col("d2"))).alias("w")), F.struct(F.lit(2).alias("__s"), F.lit(1.0).alias("w"))))
    weighted = rows.join(plain.select("__g", "m", "inv"), "__g").select("__g", *FEATURES, _distance().alias("d2")).select("__g", *FEATURES, weights.alias("x")).select("__g", *FEATURES, "x.*")
    others = _factor(weighted.groupBy("__g", "__s").agg(*_moments()), scales)
    state = cut(plain.unionByName(others.withColumn("ld", F.lit(float("inf")))).withColumn("moved", F.lit(True)), "mcd")
    discard(plain)
    while not state.where("moved").isEmpty():  # ends: a start goes on only where its determinant, bounded by the ridge, fell
        stepped = _step(rows, state.where("moved"), scales)
        new = stepped.select("__g", "__s", F.struct("m", "c", "inv", "ld").alias("new"))
        fell = F.coalesce(F.col("new.ld") < F.col("ld") - SETTLED, F.lit(False))
        took = [F.when(fell, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in ("m", "c", "inv", "ld")]
        before, state = state, cut(state.join(new, ["__g", "__s"], "left").select("__g", "__s", *took, fell.alias("moved")), "mcd")
        discard(before), discard(stepped)
    best = F.min_by(F.struct("m", "c", "inv"), F.struct("ld", "__s"))
    params = cut(state.groupBy("__g").agg(best.alias("x")).select("__g", "x.*"), "mcd")
    scale = rows.join(params, "__g").select("__g", _distance().alias("d2")).groupBy("__g").agg((half(F.col("d2")) / CHI_MEDIAN).alias("__c"))
    # so that the median distance of a group is that of the normal; never narrower than estimated
    out = cut(params.join(scale, "__g").select("__g", "m", "c", F.greatest("__c", F.lit(1.0)).alias("__c")), "mcd")
    for done in (scales, state, params):
        discard(done)
    return out


def _judged(docs: DataFrame, keep: list[str], cutoff: float, min_group: int) -> tuple[DataFrame, dict[str, str]]:
    """The verdict on every row, and under which names the columns `keep` are in it."""
    names = {f"__own{i}": c for i, c in enumerate(keep)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()], *[F.col(c) for c in ("text", "lang", "source")])
    stats = cut(with_statistics(renamed, [*names, "lang", "source"]), "stats")
    rows = _with_groups(stats, min_group)
    # the vectors alone are read again and again, so they are a small table of their own
    core = cut(rows.where(~F.col("base_failed") & F.col("__g").isNotNull()).select("__g", *FEATURES), "core")
    params = estimate(core)
    discard(core)
    beside = rows.join(params, "__g", "left")
    p = len(FEATURES)
    off = [F.col(x) - F.get("m", F.lit(i)) for i, x in enumerate(FEATURES)]
    entry = lambda i, j: F.col("__c") * F.get(F.get("c", F.lit(i)), F.lit(j)) + (F.col(NOISE[i]) if i == j else F.lit(0.0))
    # the covariance with the vector beside it: sweeping the covariance leaves minus the distance in the corner
    beside_it = F.array(*[F.array(*[entry(i, j) for j in range(p)], off[i]) for i in range(p)], F.array(*off, F.lit(0.0)))
    judged = beside.withColumn("d2", F.when(~F.col("base_failed") & F.col("__c").isNotNull(), -F.get(F.get(_swept(beside_it, p)["a"], F.lit(p)), F.lit(p))))
    d2 = F.col("d2")
    kept = ~F.col("base_failed") & F.coalesce(d2 <= cutoff, F.lit(True))
    return judged.select(*names, *BASE, "base_failed", d2.alias("d2"), kept.alias("kept")), names


def judge(docs: DataFrame, keep: list[str], cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """The columns `keep`, the base counts, base_failed, the distance d2 and kept, a row for each of docs."""
    out, names = _judged(docs, keep, cutoff, min_group)
    return out.withColumnsRenamed(names)


def filter_quality(docs: DataFrame, cutoff: float = CUTOFF, min_group: int = MIN_GROUP) -> DataFrame:
    """The documents that are kept, with all their columns and no others."""
    out, names = _judged(docs, docs.columns, cutoff, min_group)
    return out.where("kept").select(*[F.col(n).alias(c) for n, c in names.items()])


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, ["doc_id"])
