"""Simulated panels with a known answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _u(*parts):
    """A uniform number from a hash of its parts: the same on every run and for every partitioning."""
    return (F.abs(F.xxhash64(*parts) % F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


def simulate(spark: SparkSession, individuals: int = 30, loci: int = 30, most_captures: int = 8, dropout: float = 0.03, false_allele: float = 0.01, missing: float = 0.07, reps: int = 0, groups: int = 1, seed: int = 1, hard: float = 0.0) -> DataFrame:
    """(grp, sample, ord, individual, rep, locus, gt): each individual sampled 1 to most_captures times.

    reps: replicate reactions for each sample; 0 gives one consensus genotype (rep null).  hard: share of a sample's
    loci that fail in all its reactions.
    """
    s = F.lit(seed)
    who = spark.range(individuals).select(F.col("id").alias("individual"), (F.col("id") % groups).alias("grp"))
    captured = who.withColumn("capture", F.explode(F.sequence(F.lit(1), 1 + F.floor(_u(s, F.lit("n"), "individual") * most_captures).cast("int"))))
    samples = captured.select("grp", "individual", (F.col("individual") * (most_captures + 1) + F.col("capture")).alias("ord"))
    cells = samples.withColumn("locus", F.explode(F.sequence(F.lit(1), F.lit(loci))))
    cells = cells.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))) if reps else F.lit(None).cast("int"))
    p = 0.2 + 0.6 * _u(s, F.lit("p"), "locus")
    base = lambda tag, *k: F.when(_u(s, F.lit(tag), *k) < p, "A").otherwise("G")
    read = ("ord", "locus", F.coalesce("rep", F.lit(0)))
    a, b = base("a", "individual", "locus"), base("b", "individual", "locus")
    lost = _u(s, F.lit("d"), *read)
    a1, a2 = F.when((a != b) & (lost < dropout / 2), b).otherwise(a), F.when((a != b) & (lost >= dropout / 2) & (lost < dropout), a).otherwise(b)
    wrong = _u(s, F.lit("f"), *read)
    a1 = F.when(wrong < false_allele / 2, base("x", *read)).otherwise(a1)
    a2 = F.when((wrong >= false_allele / 2) & (wrong < false_allele), base("x", *read)).otherwise(a2)
    gt = F.when((_u(s, F.lit("m"), *read) >= missing) & (_u(s, F.lit("h"), "ord", "locus") >= hard), F.concat_ws("/", F.least(a1, a2), F.greatest(a1, a2)))
    return cells.select("grp", F.col("ord").alias("sample"), "ord", "individual", "rep", "locus", gt.alias("gt"))


def truth_of(simulated: DataFrame) -> DataFrame:
    return simulated.select("grp", "sample", "ord", F.col("individual").cast("string").alias("individual")).distinct()
