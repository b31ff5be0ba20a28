"""Lookup tables of the probabilistic methods, per block and locus, as small joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions.genotype import allele, floor_log10
from kinloom.sources.staging import staged

# Chance that two relatives share 0, 1 or 2 alleles by descent.
KINSHIP = {"unrelated": (1.0, 0.0, 0.0), "half_sib": (0.5, 0.5, 0.0), "full_sib": (0.25, 0.5, 0.25), "parent_offspring": (0.0, 1.0, 0.0)}
LEAST_MASS = 1e-12
KEY = ["grp", "locus"]


def _with_alleles(dic: DataFrame) -> DataFrame:
    return dic.select(*KEY, "gt", "code", allele(F.col("gt"), 1).alias("t1"), allele(F.col("gt"), 2).alias("t2"))


def genotype_prob(dic: DataFrame, freq: DataFrame) -> DataFrame:
    """(grp, locus, gt, code, gp): p^2 or 2pq, not scaled to the dictionary."""
    f1 = freq.select(*KEY, F.col("allele").alias("t1"), F.col("p").alias("p1"))
    f2 = freq.select(*KEY, F.col("allele").alias("t2"), F.col("p").alias("p2"))
    gp = F.when(F.col("t1") == F.col("t2"), F.col("p1") * F.col("p2")).otherwise(2 * F.col("p1") * F.col("p2"))
    return _with_alleles(dic).join(f1, [*KEY, "t1"]).join(f2, [*KEY, "t2"]).select(*KEY, "gt", "code", gp.alias("gp"))


def observation_mass(dic: DataFrame, freq: DataFrame, dropout: float, false_allele: float) -> DataFrame:
    """(grp, locus, g, t, e): chance to observe genotype g when t is true; dropout first, then false alleles.

    Genotypes outside the dictionary are left out, so the chances of a t need not add up to 1.  The chance is linear in
    each of the two rates.
    """
    d, f = F.lit(float(dropout)), F.lit(float(false_allele))
    true = _with_alleles(dic).withColumnRenamed("code", "t")
    het = F.col("t1") != F.col("t2")
    first = true.select(
        *KEY,
        "t",
        F.explode(
            F.when(het, F.array(F.struct(F.col("t1").alias("s1"), F.col("t1").alias("s2"), (d / 2).alias("pr")), F.struct(F.col("t2").alias("s1"), F.col("t2").alias("s2"), (d / 2).alias("pr")), F.struct(F.col("t1").alias("s1"), F.col("t2").alias("s2"), (1 - d).alias("pr")))).otherwise(
                F.array(F.struct(F.col("t1").alias("s1"), F.col("t2").alias("s2"), F.lit(1.0).alias("pr")))
            )
        ).alias("s"),
    ).select(*KEY, "t", "s.*")
    pair = lambda a, b: F.concat_ws("/", F.least(a, b), F.greatest(a, b))
    stay = first.select(*KEY, "t", pair(F.col("s1"), F.col("s2")).alias("gt"), (F.col("pr") * (1 - f)).alias("e"))
    drawn = first.join(freq.select(*KEY, F.col("allele").alias("x"), "p"), KEY)
    half = F.col("pr") * f * 0.5 * F.col("p")
    change = drawn.select(*KEY, "t", F.explode(F.array(pair(F.col("x"), F.col("s2")), pair(F.col("s1"), F.col("x")))).alias("gt"), half.alias("e"))
    mass = stay.unionByName(change).groupBy(*KEY, "t", "gt").agg(F.sum("e").alias("e"))
    cells = dic.select(*KEY, "gt", F.col("code").alias("g")).join(dic.select(*KEY, F.col("code").alias("t")), KEY)
    return cells.join(mass, [*KEY, "t", "gt"], "left").select(*KEY, "g", "t", F.coalesce("e", F.lit(0.0)).alias("e"))


def observation_model(dic: DataFrame, freq: DataFrame, dropout: float, false_allele: float) -> DataFrame:
    """observation_mass with a least chance for everything, scaled to add up to 1 for each true genotype."""
    full = observation_mass(dic, freq, dropout, false_allele).withColumn("e", F.col("e") + LEAST_MASS)
    column = full.groupBy(*KEY, "t").agg(F.sum("e").alias("total"))
    return full.join(column, [*KEY, "t"]).select(*KEY, "g", "t", (F.col("e") / F.col("total")).alias("e"))


def pair_prob(dic: DataFrame, freq: DataFrame, k: tuple[float, float, float]) -> DataFrame:
    """(grp, locus, t, u, pp): chance of the true genotypes of two relatives."""
    k0, k1, k2 = map(float, k)
    gp = genotype_prob(dic, freq)
    cells = gp.select(*KEY, F.col("code").alias("t"), F.col("gp").alias("gt_p")).join(gp.select(*KEY, F.col("code").alias("u"), F.col("gp").alias("gu_p")), KEY)
    fa = freq.select(*KEY, F.col("allele").alias("a"), F.col("p").alias("pa"))
    shared = freq.select(*KEY, F.col("allele").alias("s"), F.col("p").alias("ps")).join(fa, KEY)
    one = shared.select(*KEY, "s", F.concat_ws("/", F.least("s", "a"), F.greatest("s", "a")).alias("gt"), "ps", "pa").join(dic.select(*KEY, "gt", "code"), [*KEY, "gt"])
    t = one.select(*KEY, "s", "ps", F.col("code").alias("t"), F.col("pa").alias("p_t"))
    u = one.select(*KEY, "s", F.col("code").alias("u"), F.col("pa").alias("p_u"))
    ibd1 = t.join(u, [*KEY, "s"]).groupBy(*KEY, "t", "u").agg(F.sum(F.col("ps") * F.col("p_t") * F.col("p_u")).alias("p1"))
    same = F.when(F.col("t") == F.col("u"), F.col("gt_p")).otherwise(0.0)
    return cells.join(ibd1, [*KEY, "t", "u"], "left").select(*KEY, "t", "u", (k0 * F.col("gt_p") * F.col("gu_p") + k1 * F.coalesce("p1", F.lit(0.0)) + k2 * same).alias("pp"))


def log_likelihoods(dic: DataFrame, freq: DataFrame, dropout: float, false_allele: float, alternatives: dict[str, tuple]) -> DataFrame:
    """(grp, locus, g1, g2, same, name...): log10 likelihood of two observations under each hypothesis."""
    dic, freq = staged(dic, "dictionary"), staged(freq, "freq")  # a few rows a locus, read by every step below
    e = staged(observation_model(dic, freq, dropout, false_allele), "observation")
    gp = genotype_prob(dic, freq).select(*KEY, F.col("code").alias("t"), "gp")
    left = e.select(*KEY, F.col("g").alias("g1"), "t", F.col("e").alias("e1"))
    right = e.select(*KEY, F.col("g").alias("g2"), "t", F.col("e").alias("e2"))
    out = left.join(gp, [*KEY, "t"]).join(right, [*KEY, "t"]).groupBy(*KEY, "g1", "g2").agg(floor_log10(F.sum(F.col("e1") * F.col("gp") * F.col("e2"))).alias("same"))
    for name, k in alternatives.items():
        half = left.join(pair_prob(dic, freq, k), [*KEY, "t"]).groupBy(*KEY, "g1", "u").agg(F.sum(F.col("e1") * F.col("pp")).alias("h"))
        full = half.join(right.withColumnRenamed("t", "u"), [*KEY, "u"]).groupBy(*KEY, "g1", "g2").agg(floor_log10(F.sum(F.col("h") * F.col("e2"))).alias(name))
        out = out.join(full, [*KEY, "g1", "g2"])
    return out


def lr_table(dic: DataFrame, freq: DataFrame, dropout: float = 0.02, false_allele: float = 0.005, kinship: str | tuple = "full_sib") -> DataFrame:
    """(grp, locus, g1, g2, lr): log10 likelihood ratio of one individual against relatives."""
    k = KINSHIP[kinship] if isinstance(kinship, str) else kinship
    t = log_likelihoods(dic, freq, dropout, false_allele, {"alt": k})
    return t.select(*KEY, "g1", "g2", (F.col("same") - F.col("alt")).alias("lr"))
