"""Replicates against their consensus: simulated panels with a known answer, resolved both ways."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators import compare, graph, matching, replicates
from kinloom.sources.simulate import simulate, truth_of
from kinloom.sources.staging import staged


def experiment(
    spark: SparkSession, loci: tuple[int, ...] = (20, 30, 40), dropouts: tuple[float, ...] = (0.03, 0.10, 0.25), runs: int = 20, individuals: int = 30,
    cut: float = 0.99, false_allele: float = 0.01, hard: float = 0.09, missing: float = 0.045, reps: int = 3, seed: int = 1,
) -> DataFrame:
    """(n_loci, dropout, run, truth_n, and for both routes n, ari, median loci, mean_same, margin): one row a run.

    The runs of a setting are blocks of one panel, so a setting is one pass whatever the number of runs; the driver
    only goes over the settings.
    """
    out = None
    for n in loci:
        for k, d in enumerate(dropouts):
            data = staged(simulate(spark, individuals * runs, n, 4, d, false_allele, missing, reps, runs, seed * 1000 + 10 * n + k, hard), "experiment")
            calls = data.select("grp", "sample", "ord", "rep", "locus", "gt")
            own, truth, least = staged(replicates.consensus(calls), "consensus"), staged(truth_of(data), "truth"), max(6, math.floor(n * 0.4))
            left = replicates.residual_error(spark, d, false_allele, hard + (1 - hard) * missing, reps).first()
            routes = {
                "cons": matching.likelihood_ratio(own, max(left["dropout"], 1e-5), max(left["false_allele"] or 0.0, 1e-5), cut=cut, min_loci=least),
                "reps": matching.likelihood_ratio(own, cut=cut, min_loci=least, scored=replicates.lr_pairs(own, calls, d, false_allele)),
            }
            row = truth.groupBy("grp").agg(F.count_distinct("individual").alias("truth_n"))
            for name, (scored, matched) in routes.items():
                found = staged(graph.single_linkage(graph.samples_of(own), matched), "experiment-found")
                figures = found.groupBy("grp").agg(F.count_distinct("individual").alias(f"{name}_n"))
                typed = scored.groupBy("grp").agg(F.percentile("n_compared", 0.5).alias(f"{name}_loci"))
                apart = compare.separation(scored, truth, least, by=("grp",)).select("grp", F.col("mean_same").alias(f"{name}_same_lr"), F.col("margin").alias(f"{name}_margin"))
                ari = compare.adjusted_rand(found, truth, ("grp",)).withColumnRenamed("ari", f"{name}_ari")
                for part in (figures, typed, apart, ari):
                    row = row.join(part, "grp", "left")
            row = staged(row.select(F.lit(n).alias("n_loci"), F.lit(d).alias("dropout"), F.col("grp").alias("run"), *[c for c in row.columns if c != "grp"]), "experiment-row")
            out = row if out is None else out.unionByName(row)
    return out


def closer(table: DataFrame) -> DataFrame:
    """(replicates, consensus, tied): how often each route's count of individuals is closer to the truth."""
    off = lambda name: F.abs(F.col(f"{name}_n") - F.col("truth_n"))
    return table.agg(F.count_if(off("reps") < off("cons")).alias("replicates"), F.count_if(off("reps") > off("cons")).alias("consensus"), F.count_if(off("reps") == off("cons")).alias("tied"))
