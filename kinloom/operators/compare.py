"""Methods against each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinloom.functions.genotype import allele
from kinloom.operators.graph import assignment_summary
from kinloom.sources.staging import staged


def stacked(assignments: dict[str, DataFrame]) -> DataFrame:
    """(method, grp, sample, ord, individual)."""
    return reduce(DataFrame.unionByName, [a.select(F.lit(m).alias("method"), "grp", "sample", "ord", "individual") for m, a in assignments.items()])


def method_summary(assignments: dict[str, DataFrame]) -> DataFrame:
    return assignment_summary(stacked(assignments), "method")


def _rand(s: str, a: str, b: str, n: str):
    """The adjusted Rand index from the pairs that agree, those of either side, and the number of samples."""
    expected = F.col(a) * F.col(b) / F.nullif(F.col(n) * (F.col(n) - 1) / 2, F.lit(0))
    most = (F.col(a) + F.col(b)) / 2
    same = F.abs(most - expected) <= 1.5e-8 * F.abs(most)
    return F.when(F.col(n) < 2, F.lit(1.0)).when(same, 1.0).otherwise((F.col(s) - expected) / F.nullif(most - expected, F.lit(0.0)))


def adjusted_rand(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., ari) for two assignments of the same samples; by: columns of a."""
    two = lambda n: n * (n - 1) / 2
    every = a.select(*by, "ord", F.col("individual").alias("i")).join(b.select("ord", F.col("individual").alias("j")), "ord")
    cells = every.groupBy(*by, "i", "j").agg(F.count("*").alias("n"))
    pairs_of = lambda key, name: cells.groupBy(*by, key).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(two(F.col("n"))).alias(name))
    one = cells.groupBy(*by).agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    for other in (pairs_of("i", "a"), pairs_of("j", "b")):  # a row a group, one row without groups
        one = one.join(other, list(by)) if by else one.join(other)
    return one.select(*by, _rand("s", "a", "b", "n").alias("ari"))


def rand_matrix(assignments: dict[str, DataFrame]) -> DataFrame:
    """(method1, method2, ari) of each pair of methods, each with itself included, in one job: the stacked assignments are
    joined with themselves on the sample once, and the cells of all pairs of methods are counted in one grouping."""
    place = {m: k for k, m in enumerate(assignments)}
    every = stacked(assignments).withColumn("at", F.element_at(F.create_map(*[x for m, k in place.items() for x in (F.lit(m), F.lit(k))]), F.col("method")))
    two = lambda n: n * (n - 1) / 2
    # the methods of a sample are one short list, so the self-join is a pair of positions in it
    lists = every.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("at", "method", "individual"))).alias("own"))
    cells = lists.select(F.posexplode("own").alias("k", "a"), "own").select("a", F.explode(F.expr("slice(own, k + 1, size(own))")).alias("b"))
    key = (F.col("a.method").alias("method1"), F.col("b.method").alias("method2"))
    cells = cells.groupBy(*key, F.col("a.individual").alias("i"), F.col("b.individual").alias("j")).agg(F.count("*").alias("n"))
    # the sizes of each side's individuals, and the cells, as rows of three kinds
    kinds = F.explode(F.array(F.struct(F.lit("s").alias("kind"), F.concat_ws("\x1f", "i", "j").alias("x")), F.struct(F.lit("a").alias("kind"), F.col("i").alias("x")), F.struct(F.lit("b").alias("kind"), F.col("j").alias("x")))).alias("e")
    sums = cells.select("method1", "method2", "n", kinds).groupBy("method1", "method2", "e").agg(F.sum("n").alias("n"))
    of = lambda k: F.sum(F.when(F.col("e.kind") == k, two(F.col("n"))))
    one = sums.groupBy("method1", "method2").agg(of("s").alias("s"), of("a").alias("a"), of("b").alias("b"), F.sum(F.when(F.col("e.kind") == "s", F.col("n"))).alias("n"))
    return one.select("method1", "method2", _rand("s", "a", "b", "n").alias("ari"))


def disputed(assignments: dict[str, DataFrame]) -> DataFrame:
    """Samples whose cluster-mates differ between methods.

    A cluster is told by an order-free fingerprint of its members (count and two sums of hashes), so no member lists
    are gathered or compared.
    """
    every = stacked(assignments)
    mark = every.groupBy("method", "individual").agg(F.count("*").alias("n"), *[F.sum(F.shiftright(F.xxhash64(F.lit(k), "ord"), 20)).alias(f"h{k}") for k in (1, 2)])
    seen = every.join(mark, ["method", "individual"]).groupBy("grp", "sample", "ord")
    return seen.agg(F.count_distinct("n", "h1", "h2").alias("n_versions")).filter("n_versions > 1")


def individual_consensus(panel: DataFrame, assignment: DataFrame) -> DataFrame:
    """(individual, locus, gt, n_typed, n_versions): the most frequent genotype, ties to the first in string order."""
    typed = panel.filter(F.col("gt").isNotNull()).select("ord", "locus", "gt").join(assignment.select("ord", "individual"), "ord")
    counts = typed.groupBy("individual", "locus", "gt").agg(F.count("*").alias("c"))
    return counts.groupBy("individual", "locus").agg(F.min(F.struct((-F.col("c")).alias("k"), "gt"))["gt"].alias("gt"), F.sum("c").alias("n_typed"), F.count("*").alias("n_versions"))


def discordance(panel: DataFrame, assignment: DataFrame) -> DataFrame:
    """(individual, locus, versions) where an individual's samples differ: `AG(3) AA(1)`, most frequent first."""
    typed = panel.filter(F.col("gt").isNotNull()).select("ord", "locus", "gt").join(assignment.select("ord", "individual"), "ord")
    counts = typed.groupBy("individual", "locus", "gt").agg(F.count("*").alias("c"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("k"), "gt", "c")))
    text = F.array_join(F.transform(ordered, lambda x: F.concat(F.replace(x["gt"], F.lit("/"), F.lit("")), F.lit("("), x["c"], F.lit(")"))), " ")
    return counts.groupBy("individual", "locus").agg(F.count("*").alias("n_versions"), text.alias("versions")).filter("n_versions > 1")


def attribute_conflicts(assignment: DataFrame, attribute: DataFrame) -> DataFrame:
    """Individuals whose samples carry more than one value; attribute: (ord, value), nulls ignored."""
    return assignment.join(attribute, "ord").groupBy("individual").agg(F.count_distinct("value").alias("n_values")).filter("n_values > 1")


def positive_controls(assignment: DataFrame, controls: DataFrame) -> DataFrame:
    """(control, n_rows, together): rows known to be one individual; controls: (control, ord)."""
    return controls.join(assignment, "ord").groupBy("control").agg(F.count("*").alias("n_rows"), (F.count_distinct("individual") == 1).alias("together"))


def majority(votes: DataFrame, allowed: list[str]) -> DataFrame:
    """(sample, call): the most frequent allowed vote (ties: string order), else `unknown`; votes: (sample, vote)."""
    counts = votes.filter(F.col("vote").isin(allowed)).groupBy("sample", "vote").agg(F.count("*").alias("c"))
    best = counts.groupBy("sample").agg(F.min(F.struct((-F.col("c")).alias("k"), "vote"))["vote"].alias("call"))
    return votes.select("sample").distinct().join(best, "sample", "left").select("sample", F.coalesce("call", F.lit("unknown")).alias("call"))


def recapture_weights(assignment: DataFrame) -> DataFrame:
    """(ord, weight): one over the size of the sample's cluster."""
    return assignment.select("ord", (1 / F.count("*").over(W.partitionBy("individual"))).alias("weight"))


def het_share(panel: DataFrame) -> DataFrame:
    het = allele(F.col("gt"), 1) != allele(F.col("gt"), 2)
    return panel.groupBy("grp", "sample", "ord").agg(F.avg(het.cast("double")).alias("het_share"))


def controls_named(assignments: dict[str, DataFrame], text: str) -> DataFrame:
    """(method, n_rows, same_individual) over the samples whose name holds text: runs of one control sample."""
    own = stacked(assignments).filter(F.contains(F.col("sample").cast("string"), F.lit(text)))
    return own.groupBy("method").agg(F.count("*").alias("n_rows"), (F.count_distinct("individual") == 1).alias("same_individual"))


def linkage_stability(single: DataFrame, complete: DataFrame) -> DataFrame:
    """(n_single, n_complete, ari): does it matter that members of an individual all match each other?"""
    n = lambda a, name: a.agg(F.count_distinct("individual").alias(name))
    return n(single, "n_single").join(n(complete, "n_complete")).join(adjusted_rand(single, complete))  # one row each


def evidence(scored: DataFrame | None, stats: DataFrame, min_loci: int = 15) -> tuple[DataFrame, str, bool]:
    """(pairs with a column `value`, what it is, borrowed): the evidence a method gave for its pairs; a method that has
    no pairs borrows the counts of differing loci, which are a property of the data."""
    ok = F.col("n_compared") >= min_loci
    if scored is None or not scored.head(1):
        return stats.filter(ok).withColumn("value", F.col("n_mismatch").cast("double")), "n_mismatch", True
    name = next(c for c in ("lr", "log10_lambda", "n_mismatch") if c in scored.columns)
    return scored.filter(ok).withColumn("value", F.col(name).cast("double")), name, False


#: Bars of the histogram of evidence.
BARS = 60


def _start():
    """The lower edge of the first bar, of columns least and width."""
    return F.col("width") / 2 + F.floor((F.col("least") - F.col("width") / 2) / F.col("width") + 1e-9) * F.col("width")


def evidence_histogram(pairs: DataFrame, value: str = "value", accepted=None, bars: int = BARS, width: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., bar, low, high, n_pairs, n_accepted) over even bars, those without pairs left out.

    Two passes: the range, then the counts.  The bars span the range bars - 1 times (or have the given width, as counts
    of loci do), and their edges lie half a width off the multiples of it; a bar holds its upper edge.  pairs: with
    a number `value`; accepted: a condition.
    """
    ends = pairs.groupBy(*by).agg(F.min(value).alias("least"), F.max(value).alias("most"))
    wide = F.lit(float(width)) if width else F.when(F.col("most") > F.col("least"), (F.col("most") - F.col("least")) / max(bars - 1, 1)).otherwise(F.lit(1.0))
    ends = staged(ends.withColumn("width", wide), "range")  # a row a group
    ends = ends.select(*by, _start().alias("start"), "width")
    told = pairs.select(*by, F.col(value).cast("double").alias("v"), (F.lit(False) if accepted is None else accepted).alias("ok")).filter("v is not null")
    told = told.join(ends, list(by)) if by else told.join(ends)  # one row without groups
    bar = F.greatest(F.lit(1), F.ceil((F.col("v") - F.col("start")) / F.col("width") - 1e-9)).cast("int")
    counts = told.groupBy(*by, "start", "width", bar.alias("bar")).agg(F.count("*").alias("n_pairs"), F.count_if("ok").alias("n_accepted"))
    low = F.col("start") + (F.col("bar") - 1) * F.col("width")
    return counts.select(*by, "bar", low.alias("low"), (low + F.col("width")).alias("high"), "n_pairs", "n_accepted")


def margin_strip(confidence: DataFrame, steps: int = 4, least: float = 1e-6) -> DataFrame:
    """(status, step, n_samples, lowest, highest): samples by state along the logarithm of their margin, `steps` to a
    power of ten; margins under `least`, and negative ones, stand at it."""
    at = F.log10(F.greatest("margin", F.lit(least)))
    rows = confidence.filter(F.col("margin").isNotNull()).select("status", at.alias("at"))
    return rows.groupBy("status", F.floor(F.col("at") * steps + 1e-9).cast("int").alias("step")).agg(F.count("*").alias("n_samples"), F.min("at").alias("lowest"), F.max("at").alias("highest"))


def separation(scored: DataFrame, truth: DataFrame, min_loci: int = 1, share: float = 0.999, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., mean_same, high_different, margin): the weakest evidence for a true pair less the strongest for a false one."""
    a, b = truth.select(F.col("ord").alias("ord1"), F.col("individual").alias("t1")), truth.select(F.col("ord").alias("ord2"), F.col("individual").alias("t2"))
    told = scored.filter(F.col("n_compared") >= min_loci).join(a, "ord1").join(b, "ord2")
    same = F.when(F.col("t1") == F.col("t2"), F.col("lr"))
    other = F.percentile(F.when(F.col("t1") != F.col("t2"), F.col("lr")), share)
    return told.groupBy(*by).agg(F.avg(same).alias("mean_same"), other.alias("high_different"), (F.min(same) - other).alias("margin"))


def mean_by(runs: DataFrame, by: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """Means of the values of repeated runs, by setting; missing values do not count."""
    return runs.groupBy(*by).agg(F.count("*").alias("n_runs"), *[F.avg(v).alias(v) for v in values])


def paired_t(runs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, mean_gain, t, df) of the paired differences a - b."""
    d = F.col(a) - F.col(b)
    one = runs.select(d.alias("d")).filter("d is not null").agg(F.count("*").alias("n"), F.avg("d").alias("mean_gain"), F.stddev_samp("d").alias("s"))
    return one.select("n", "mean_gain", F.when(F.col("s") > 0, F.col("mean_gain") / (F.col("s") / F.sqrt("n"))).alias("t"), (F.col("n") - 1).alias("df"))


def t_chance(t: float, df: float) -> float:
    """Two-sided chance of a t as large, by the continued fraction of the incomplete beta function."""
    import math

    x = df / (df + t * t)
    a, b = df / 2, 0.5
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    return _beta_share(a, b, x) if not math.isnan(x) else math.nan


def _beta_share(a: float, b: float, x: float) -> float:
    import math

    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a if x > 0 else 0.0
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d)
            c = 1 + k / c
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out
