"""From a file of genotypes to individuals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.operators import graph, inference, matching, pairs, panel, replicates, similarity
from kinloom.sources.staging import measured_joins, staged
from kinloom.sources.tables import read_table, suffix_duplicates

#: Column with the place of a row in its file.
ORDER = "row_order"
#: Settings for the example panel of the documentation: the rates it was simulated at, and its column of species.
EXAMPLE = {"dropout": 0.03, "false_allele": 0.01, "min_loci": 12, "group_col": "TrueSpecies"}

#: Methods by name: (panel, replicates or None, settings) -> (pairs, matched pairs), and the assignment if the method makes
#: its own.  Any function of this shape may be passed; `kinloom.operators.blocks.block_method` makes one of a Python
#: function for one block.
Method = Callable[[DataFrame, DataFrame | None, dict], tuple[DataFrame, ...]]


@dataclass
class Result:
    method: str
    assignment: DataFrame
    pairs: DataFrame
    matched: DataFrame
    conflicts: DataFrame
    panel: DataFrame
    settings: dict = field(default_factory=dict)


def _counted(rule):
    def run(own, reps, s):
        stats = staged(pairs.pair_stats(own), "stats")
        return stats, rule(stats, s)

    return run


def _likelihood_ratio(own, reps, s):
    scored = None if reps is None else replicates.lr_pairs(own, reps, s["dropout"], s["false_allele"], s["kinship"])
    return matching.likelihood_ratio(own, s["dropout"], s["false_allele"], s["kinship"], s["cut"], s["min_loci"], s.get("prior"), scored)


def _best_alternative(own, reps, s):
    args = (s["dropout"], s["false_allele"])
    scored = matching.best_alternative_pairs(own, *args) if reps is None else replicates.best_alternative_pairs(own, reps, *args)
    scored = staged(scored, "best")
    return scored, matching.best_alternative(scored, s["lambda_cut"], s["min_loci"])


def _similarity(own, reps, s):
    distances, assignment = similarity.similarity(own, s.get("m_hat"), s.get("most_mismatches"))
    inside = assignment.select("ord", "individual")
    a, b = inside.toDF("ord1", "i1"), inside.toDF("ord2", "i2")
    return distances, distances.join(a, "ord1").join(b, "ord2").filter("i1 = i2").select(*distances.columns), assignment


def _mismatch_number(stats, s):
    m = s.get("m_hat")
    if m is None:
        m = matching.fallback_mismatches(stats, s["min_loci"]).first()["m_hat"]
    return stats.filter((F.col("n_compared") >= s["min_loci"]) & (F.col("n_mismatch") <= m))


METHODS: dict[str, Method] = {
    "exact": _counted(lambda stats, s: matching.exact(stats, s["min_loci"])),
    "threshold": _counted(lambda stats, s: matching.threshold(stats, s["k"], s["hard"], s["min_loci"])),
    "similarity": _similarity,
    "mismatch_number": _counted(_mismatch_number),
    "likelihood_ratio": _likelihood_ratio,
    "best_alternative": _best_alternative,
}
DEFAULTS = {"min_loci": 15, "k": 1, "hard": 0, "dropout": 0.02, "false_allele": 0.005, "kinship": "full_sib", "cut": 0.999, "lambda_cut": 1.0, "linkage": "single"}


def resolve(own: DataFrame, method: str | Method = "likelihood_ratio", reps: DataFrame | None = None, **settings) -> Result:
    """Individuals of a panel; blocks are columns, so no loop runs over them."""
    measured_joins(own.sparkSession)
    s = DEFAULTS | settings
    run = METHODS[method] if isinstance(method, str) else method
    if not own.filter("gt is not null").head(1) or own.select("ord").distinct().limit(2).count() < 2:
        raise ValueError("fewer than two samples, or no genotype, are left")
    scored, matched, *found = run(own, reps, s)
    matched = staged(matched, "matched")
    link = graph.complete_linkage if s["linkage"] == "complete" else graph.single_linkage
    assignment = staged(found[0] if found else link(graph.samples_of(own), matched), "assignment")
    return Result(method if isinstance(method, str) else method.__name__, assignment, scored, matched, graph.conflicts(assignment, matched), own, s)


def identify(
    spark: SparkSession, path: str, method: str | Method = "likelihood_ratio", id_col: str | None = None, loci: list[str] | None = None, group_col: str | None = None,
    sep: str | None = None, replicate_col: str | None = None, drop_labels: tuple[str, ...] = (), min_locus_call: float = 0.25, min_sample_call: float = 0.5, min_maf: float = 0.0, **settings,
) -> Result:
    """Reads a table, finds out what is not said, and resolves its individuals.

    `ord` is the place of a row in the file, or of a sample's first replicate, so individuals are numbered as they
    appear there.  replicate_col "auto": where ids occur more than once, the column and the labels that are no
    replicates are guessed.
    """
    measured_joins(spark)
    raw = staged(read_table(spark, path, order_col=ORDER), "table")
    columns = [c for c in raw.columns if c != ORDER]
    id_col = id_col or inference.guess_id(raw, columns)
    sep = sep or inference.guess_separator(raw, [c for c in columns if c != id_col])
    given = tuple(x for x in (id_col, group_col, replicate_col) if x)
    loci = loci or inference.detect_loci(raw.drop(ORDER), sep, given)
    raw = raw.withColumn(id_col, F.coalesce(F.col(id_col).cast("string"), F.lit("NA")))
    if replicate_col == "auto":
        replicate_col, found = inference.replicate_plan(raw.drop(ORDER), id_col, loci)
        drop_labels = drop_labels or found
    if replicate_col:
        raw = raw.filter(~F.coalesce(F.col(replicate_col).isin(*drop_labels), F.lit(False))) if drop_labels else raw
        first = raw.groupBy(id_col).agg(F.min(ORDER).alias("first_row"))
        cells = raw.join(first, id_col).select(F.struct(id_col, replicate_col).alias("reaction"), F.col("first_row").alias(ORDER), *([group_col] if group_col else []), *loci)
        reps = panel.to_panel(cells, "reaction", loci, ORDER, group_col, sep)
        reps = reps.select("grp", F.col(f"sample.{id_col}").alias("sample"), "ord", F.col(f"sample.{replicate_col}").alias("rep"), "locus", "gt")
        own = replicates.consensus(reps)
    else:
        own, reps = panel.to_panel(suffix_duplicates(raw, id_col, ORDER), id_col, loci, ORDER, group_col, sep), None
    own = staged(panel.filter_panel(own, min_locus_call, min_sample_call, min_maf), "panel")
    return resolve(own, method, reps, **settings)


def example(spark: SparkSession, path: str, method: str | Method = "likelihood_ratio", **settings) -> Result:
    """identify with the settings of the example panel, whose file is at path."""
    return identify(spark, path, method, **(EXAMPLE | settings))
