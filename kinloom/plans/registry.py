"""Queries of the genotype engine: name -> (spark, sf_dir) -> DataFrame, each over all events."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions.genotype import normalise
from kinloom.operators import blocks, compare, confidence, evidence, graph, inference, likelihood, matching, pairs, panel, replicates, similarity
from kinloom.plans import fixtures
from kinloom.plans.oracles import CUTS, SQL  # noqa: F401
from kinloom.sources.staging import staged

MIN_LOCI = 15
QUERIES: dict = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _r(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded (and -0 as 0), counts as long, the helper columns of pairs left out."""
    out = []
    for f in df.schema:
        kind = f.dataType.typeName()
        if f.name in ("ord", "ord1", "ord2"):
            continue
        c = F.col(f.name)
        if kind == "double":
            c = F.round(c, own.get(f.name, digits)) + F.lit(0.0)
        elif kind in ("integer", "decimal"):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def _panel(spark, sf):
    return fixtures.panel(spark, sf)


def _stats(spark, sf):
    return pairs.pair_stats(_panel(spark, sf))


def _exact(spark, sf):
    return staged(matching.exact(_stats(spark, sf), MIN_LOCI), "exact")


def _thresh(spark, sf):
    return staged(matching.threshold(_stats(spark, sf), 1, 0, MIN_LOCI), "threshold")


def _assign(spark, sf, matched):
    return staged(graph.single_linkage(graph.samples_of(_panel(spark, sf)), matched), "assignment")


def _evidence(spark, sf):
    return evidence.Evidence(_panel(spark, sf), min_loci=MIN_LOCI)


def _lr_pairs(spark, sf):
    return staged(_evidence(spark, sf).matched, "lr-matched")


def _counted(spark, sf):
    """The exact matches and those within the threshold; the former are among the latter, so no other pair is kept."""
    within = _thresh(spark, sf)
    return {"exact": _assign(spark, sf, matching.exact(within, MIN_LOCI)), "threshold": _assign(spark, sf, within)}


def _three(spark, sf):
    return _counted(spark, sf) | {"likelihood_ratio": _assign(spark, sf, _lr_pairs(spark, sf))}


@_query
def norm_genotype(spark, sf):
    return fixtures.raw_cells(spark, sf).select("sample", "locus", normalise(F.col("raw")).alias("gt"))


@_query
def quality_flags(spark, sf):
    return panel.quality_flags(fixtures.raw_cells(spark, sf))


@_query
def locus_stats(spark, sf):
    return _r(panel.locus_stats(_panel(spark, sf)))


@_query
def sample_stats(spark, sf):
    return _r(panel.sample_stats(_panel(spark, sf)))


@_query
def allele_freq(spark, sf):
    return _r(panel.allele_freq(_panel(spark, sf)))


@_query
def allele_freq_weighted(spark, sf):
    weights = compare.recapture_weights(_assign(spark, sf, _exact(spark, sf)))
    return _r(panel.allele_freq(_panel(spark, sf), weights=weights))


FILTERS = {"min_locus_call": 0.925, "min_sample_call": 0.9, "min_maf": 0.05}


def _filtered(spark, sf):
    return panel.filter_panel(_panel(spark, sf), **FILTERS)


@_query
def filter_panel(spark, sf):
    return _filtered(spark, sf).groupBy("locus").agg(F.count("*").alias("n_rows"), F.count("gt").alias("n_typed"))


@_query
def dropped_loci(spark, sf):
    return panel.dropped(_panel(spark, sf), _filtered(spark, sf), "locus")


@_query
def dropped_samples(spark, sf):
    return panel.dropped_samples(_panel(spark, sf), **FILTERS)


@_query
def ld_r2(spark, sf):
    return _r(panel.linkage_r2(_panel(spark, sf)))


def _power(spark, sf):
    return panel.identity_power(panel.allele_freq(_panel(spark, sf), ()))


@_query
def pid_locus(spark, sf):
    return _r(_power(spark, sf))


@_query
def pid_cumulative(spark, sf):
    return _r(panel.cumulative_power(_power(spark, sf)).drop("pid", "pid_sib"))


@_query
def loci_needed(spark, sf):
    return panel.loci_needed(panel.cumulative_power(_power(spark, sf))).select("band", F.col("n_loci").cast("long").alias("n_loci"))


@_query
def sample_power(spark, sf):
    return _r(panel.sample_power(_panel(spark, sf), _power(spark, sf)))


@_query
def encode_dict(spark, sf):
    return _r(panel.dictionary(_panel(spark, sf)))


@_query
def pairwise(spark, sf):
    return _r(_stats(spark, sf).groupBy("grp", "n_compared", "n_mismatch", "n_mismatch_2allele").agg(F.count("*").alias("n_pairs")))


@_query
def mismatch_histogram(spark, sf):
    return _r(matching.mismatch_histogram(_stats(spark, sf), MIN_LOCI))


@_query
def match_exact(spark, sf):
    return _r(matching.exact(_stats(spark, sf), MIN_LOCI).select("grp", "id1", "id2", "n_compared"))


@_query
def match_threshold(spark, sf):
    return _r(matching.threshold(_stats(spark, sf), 1, 0, MIN_LOCI).select("grp", "id1", "id2", "n_compared", "n_mismatch"))


@_query
def near_matches(spark, sf):
    return _r(matching.near(_stats(spark, sf), 2, MIN_LOCI).select("grp", "id1", "id2", "n_compared", "n_mismatch"))


@_query
def matched_pid(spark, sf):
    own = _panel(spark, sf)
    found, loci = pairs.pair_masks(own)
    return _r(matching.masked_power(matching.exact(found, MIN_LOCI), loci, panel.identity_power(panel.allele_freq(own), ("grp",))))


@_query
def threshold_sweep(spark, sf):
    return _r(matching.sweep(graph.samples_of(_panel(spark, sf)), _stats(spark, sf), 6, MIN_LOCI))


@_query
def fallback_mismatches(spark, sf):
    return _r(matching.fallback_mismatches(_stats(spark, sf), MIN_LOCI))


@_query
def assignment_exact(spark, sf):
    return _r(_assign(spark, sf, _exact(spark, sf)))


@_query
def assignment_threshold(spark, sf):
    return _r(_assign(spark, sf, _thresh(spark, sf)))


@_query
def assignment_summary(spark, sf):
    return _r(graph.assignment_summary(_assign(spark, sf, _exact(spark, sf))))


@_query
def cluster_sizes(spark, sf):
    return graph.cluster_sizes(_assign(spark, sf, _thresh(spark, sf)))


@_query
def conflicts(spark, sf):
    m = _thresh(spark, sf)
    return _r(graph.conflicts(_assign(spark, sf, m), m))


@_query
def complete_linkage(spark, sf):
    return _r(graph.complete_linkage(graph.samples_of(_panel(spark, sf)), _thresh(spark, sf)))


def _tables_of(spark, sf):
    return panel.dictionary_and_freq(_panel(spark, sf))


@_query
def hwe_prob(spark, sf):
    return _r(likelihood.genotype_prob(*_tables_of(spark, sf)).drop("code"))


@_query
def obs_matrix(spark, sf):
    return _r(likelihood.observation_model(*_tables_of(spark, sf), 0.02, 0.005))


@_query
def pair_prob(spark, sf):
    return _r(likelihood.pair_prob(*_tables_of(spark, sf), likelihood.KINSHIP["full_sib"]))


@_query
def lr_table(spark, sf):
    return _r(likelihood.lr_table(*_tables_of(spark, sf)))


def _lr_profile(df):
    return _r(df.groupBy("grp", "n_compared").agg(F.count("*").alias("n_pairs"), F.sum("lr").alias("lr_sum"), F.max("lr").alias("lr_max")), lr_sum=4)


@_query
def lr_pairs(spark, sf):
    return _lr_profile(matching.lr_pairs(_panel(spark, sf)))


@_query
def lr_prior(spark, sf):
    own = _panel(spark, sf)
    scored = staged(matching.lr_pairs(own), "lr-pairs")
    return _r(matching.priors(scored, own.groupBy("grp").agg(F.count_distinct("sample").alias("n")), 0.999, MIN_LOCI), 9)


@_query
def lr_matched(spark, sf):
    return _r(_lr_pairs(spark, sf).select("grp", "id1", "id2", "n_compared", "lr"))


@_query
def lr_assignment(spark, sf):
    return _r(_assign(spark, sf, _lr_pairs(spark, sf)))


@_query
def best_alternative_counts(spark, sf):
    return _r(matching.best_alternative_pairs(_panel(spark, sf)).groupBy("best_alternative").agg(F.count("*").alias("n_pairs"), F.max("log10_lambda").alias("top")))


@_query
def best_alternative_assignment(spark, sf):
    return _r(_assign(spark, sf, staged(matching.best_alternative(matching.best_alternative_pairs(_panel(spark, sf)), 1.0, MIN_LOCI).select("ord1", "ord2"), "best")))


def _calibrated(spark, sf, linkage="single"):
    found, rest = _evidence(spark, sf).calibrated(min(CUTS))
    return confidence.calibration(graph.samples_of(_panel(spark, sf)), found, CUTS, MIN_LOCI, linkage, rest)


@_query
def calibration(spark, sf):
    table = _calibrated(spark, sf)
    return _r(table.select("cutoff", "n_accepted", "false_merges", "missed", "n_individuals"), 4, cutoff=6)


@_query
def calibration_verdict(spark, sf):
    table = staged(_calibrated(spark, sf), "calibration")
    return confidence.verdict(table).join(confidence.recommended_cutoff(table))  # one row each


def _confidence(spark, sf):
    of = _evidence(spark, sf)
    matched = staged(of.matched, "lr-matched")
    power = panel.sample_power(_panel(spark, sf), _power(spark, sf))
    assignment = _assign(spark, sf, matched)
    return confidence.sample_confidence(assignment, None, matched, power, MIN_LOCI, of.nearest(assignment))


@_query
def sample_confidence(spark, sf):
    return _r(_confidence(spark, sf).drop("log10_pid_sib", "status_rank"))


@_query
def roster(spark, sf):
    return _r(confidence.roster(_confidence(spark, sf)))


@_query
def ari_matrix(spark, sf):
    return _r(compare.rand_matrix(_three(spark, sf)))


@_query
def method_summary(spark, sf):
    return _r(compare.method_summary(_three(spark, sf)))


@_query
def disputed(spark, sf):
    both = _counted(spark, sf)
    return _r(compare.disputed(both).drop("grp"))


@_query
def individual_consensus(spark, sf):
    return _r(compare.individual_consensus(_panel(spark, sf), _assign(spark, sf, _exact(spark, sf))))


@_query
def discordance(spark, sf):
    return _r(compare.discordance(_panel(spark, sf), _assign(spark, sf, _thresh(spark, sf))))


@_query
def attribute_conflicts(spark, sf):
    return compare.attribute_conflicts(_assign(spark, sf, _thresh(spark, sf)), fixtures.marker(spark, sf))


@_query
def positive_controls(spark, sf):
    return compare.positive_controls(_assign(spark, sf, _thresh(spark, sf)), fixtures.truth(spark, sf).withColumnRenamed("value", "control"))


@_query
def rep_consensus(spark, sf):
    return replicates.consensus(fixtures.replicates(spark, sf)).select("sample", "locus", "gt")


@_query
def genotype_likelihood(spark, sf):
    lik = replicates.genotype_likelihood(_panel(spark, sf), fixtures.replicates(spark, sf))
    return _r(lik.select("sample", "locus", "t", F.log10("lik").alias("log10_lik"), "n_obs"))


@_query
def lr_replicates(spark, sf):
    return _lr_profile(replicates.lr_pairs(_panel(spark, sf), fixtures.replicates(spark, sf)))


@_query
def best_alternative_replicates(spark, sf):
    scored = replicates.best_alternative_pairs(_panel(spark, sf), fixtures.replicates(spark, sf))
    ok = (F.col("n_compared") >= MIN_LOCI) & (F.col("log10_lambda") > 0)
    return scored.groupBy("best_alternative").agg(F.count("*").alias("n_pairs"), F.count_if(ok).alias("n_matched"))


def _errors(spark, sf):
    reps = fixtures.replicates(spark, sf)
    return replicates.error_counts(reps, replicates.consensus(reps))


@_query
def replicate_errors(spark, sf):
    return _errors(spark, sf)


@_query
def pooled_errors(spark, sf):
    return _r(replicates.pooled_rates(_errors(spark, sf)))


@_query
def heterozygote_deficit(spark, sf):
    return _r(replicates.heterozygote_deficit(_panel(spark, sf)))


@_query
def ml_patterns(spark, sf):
    return replicates.ml_patterns(fixtures.replicates(spark, sf))


@_query
def ml_error_rates(spark, sf):
    freq = panel.allele_freq(_panel(spark, sf), ())
    got = replicates.ml_error_rates(fixtures.replicates(spark, sf), freq)
    row = (round(got["dropout"], 5), round(got["false_allele"], 5), *(round(x, 6) for x in (*got["dropout_ci"], *got["false_ci"])))
    return spark.createDataFrame([row], "dropout double, false_allele double, dropout_lo double, dropout_hi double, false_lo double, false_hi double")


@_query
def ml_grid(spark, sf):
    model = replicates.ErrorModel(fixtures.replicates(spark, sf), panel.allele_freq(_panel(spark, sf), ()))
    table = model(*replicates.grid_around(math.log(0.05 / 0.95), math.log(0.01 / 0.99), 1.0))
    return _r(table, 4, d=9, f=9)


@_query
def residual_error(spark, sf):
    reps = fixtures.replicates(spark, sf)
    got = replicates.ml_error_rates(reps, panel.allele_freq(_panel(spark, sf), ()))
    missing = reps.agg(F.avg(F.col("gt").isNull().cast("double")).alias("m"))
    return _r(replicates.residual_rates(missing.select(F.lit(got["dropout"]).alias("d"), F.lit(got["false_allele"]).alias("f"), "m")))


@_query
def separator_shares(spark, sf):
    return inference.separator_shares(fixtures.raw_cells(spark, sf), ["raw"])


@_query
def locus_tests(spark, sf):
    raw = fixtures.raw_table(spark, sf)
    return inference.locus_tests(raw, raw.columns)


@_query
def id_scores(spark, sf):
    raw = fixtures.raw_table(spark, sf)
    return _r(inference.id_scores(raw, raw.columns))


@_query
def sensitivity_grid(spark, sf):
    return _r(matching.in_grid_order(matching.sensitivity(_panel(spark, sf), min_loci=MIN_LOCI)))


@_query
def ld_top(spark, sf):
    return _r(panel.top_linked(panel.linkage_r2(_panel(spark, sf)), 25))


def _unique(spark, sf):
    return staged(replicates.unique_individuals(_panel(spark, sf)), "unique")


@_query
def ld_flagged(spark, sf):
    return _r(panel.linked_loci(panel.linkage_r2(_unique(spark, sf)), 0.01))


@_query
def fis_flagged(spark, sf):
    return _r(panel.odd_fis(panel.locus_stats(_unique(spark, sf)), 0.1))


def _amplicons(spark, sf):
    """The panel with every third locus as a second site of the marker before it."""
    name = F.expr("CASE WHEN locus % 3 = 0 THEN concat('L', lpad(locus - 1, 2, '0'), 'SNP2') ELSE concat('L', lpad(locus, 2, '0')) END")
    return staged(_panel(spark, sf).withColumn("locus", name), "amplicons")


@_query
def same_amplicon(spark, sf):
    return _r(panel.same_amplicon(panel.linkage_r2(_amplicons(spark, sf))))


@_query
def pid_pruned(spark, sf):
    return _r(panel.cumulative_power(panel.pruned(panel.identity_power(panel.allele_freq(_amplicons(spark, sf), ())))).drop("pid", "pid_sib"))


@_query
def dead_loci(spark, sf):
    return _r(panel.dead_loci(_panel(spark, sf), 0.9246))


@_query
def lr_top(spark, sf):
    return _r(matching.top_pairs(_evidence(spark, sf).top_pairs(200), 200).select("grp", "id1", "id2", "n_compared", "lr"))


@_query
def near_table(spark, sf):
    return _r(matching.in_near_order(matching.near(_stats(spark, sf), 2, MIN_LOCI)).select("grp", "id1", "id2", "n_compared", "n_mismatch"))


@_query
def final_assignments(spark, sf):
    own = _panel(spark, sf)
    power = panel.sample_power(own, panel.identity_power(panel.allele_freq(own, ())))
    return _r(graph.final_table(_assign(spark, sf, _lr_pairs(spark, sf)), own, power))


@_query
def roster_table(spark, sf):
    return _r(confidence.in_roster_order(confidence.roster(_confidence(spark, sf))))


@_query
def review_table(spark, sf):
    return _r(confidence.in_review_order(_confidence(spark, sf)).select("sample", "individual", "status", "status_rank", "margin"))


@_query
def plateau(spark, sf):
    return _r(matching.plateau(matching.sweep(graph.samples_of(_panel(spark, sf)), _stats(spark, sf), 6, MIN_LOCI)))


@_query
def power_ceiling(spark, sf):
    of = _evidence(spark, sf)
    return _r(matching.power_ceiling(of.samples, of.best(), of.lr_table, 0.999, MIN_LOCI), 5, max_posterior=9)


@_query
def allele_freq_corrected(spark, sf):
    weights = compare.recapture_weights(_assign(spark, sf, _lr_pairs(spark, sf)))
    return _r(panel.allele_freq(_panel(spark, sf), weights=weights))


@_query
def linkage_stability(spark, sf):
    matched = _thresh(spark, sf)
    samples = graph.samples_of(_panel(spark, sf))
    return _r(compare.linkage_stability(_assign(spark, sf, matched), staged(graph.complete_linkage(samples, matched), "complete")))


@_query
def controls_named(spark, sf):
    both = _counted(spark, sf)
    return _r(compare.controls_named(both, "77"))


@_query
def species_calls(spark, sf):
    return _r(compare.majority(fixtures.votes(spark, sf), ["coyote", "wolf"]))


@_query
def het_share(spark, sf):
    return _r(compare.het_share(_panel(spark, sf)).drop("grp"))


@_query
def mismatch_scores(spark, sf):
    scored = confidence.mismatch_score(_stats(spark, sf)).filter(F.col("n_mismatch") <= 1)
    return _r(scored.groupBy("grp", "n_mismatch").agg(F.count("*").alias("n_pairs"), F.max("score").alias("score")))


@_query
def error_from_deficit(spark, sf):
    found = replicates.applied_error(_panel(spark, sf))
    return spark.createDataFrame([(found["n_samples"], round(found["dropout"], 6), found["use_dropout"], found["use_false_allele"])], "n_samples long, dropout double, use_dropout double, use_false_allele double")


@_query
def applied_errors(spark, sf):
    found = replicates.applied_error(_panel(spark, sf), fixtures.replicates(spark, sf))
    row = (found["method"], found["n_samples"], found["converted"], found["use_dropout"], found["use_false_allele"])
    return spark.createDataFrame([row], "method string, n_samples long, converted boolean, use_dropout double, use_false_allele double")


@_query
def simulation_means(spark, sf):
    return _r(compare.mean_by(fixtures.runs(spark, sf), ("n_loci", "dropout"), ("cons_ari", "reps_ari")))


@_query
def paired_t(spark, sf):
    return _r(compare.paired_t(fixtures.runs(spark, sf), "reps_ari", "cons_ari"))


@_query
def separation(spark, sf):
    truth = fixtures.truth(spark, sf).select("ord", F.col("value").alias("individual"))
    return _r(_evidence(spark, sf).separation(truth), 5)


@_query
def similarity_assignment(spark, sf):
    return _r(similarity.similarity(_panel(spark, sf), similarity.MISMATCHES)[1])


@_query
def similarity_profile(spark, sf):
    own = _panel(spark, sf)
    return _r(similarity.profile(graph.samples_of(own), staged(pairs.slot_distances(own), "slot-distances"), 6))


@_query
def similarity_near_misses(spark, sf):
    stats = staged(_stats(spark, sf), "stats")
    m = matching.fallback_mismatches(stats, MIN_LOCI).first()["m_hat"]
    return similarity.near_misses(stats, m, MIN_LOCI).select("grp", "sample")


def _same_everywhere(genotypes):
    """A method in plain Python: samples are one individual where no locus that both have differs, by chains."""
    import numpy as np
    import pandas as pd

    cells = genotypes.to_numpy()
    typed = pd.notna(cells)
    both = typed.astype("float32") @ typed.T.astype("float32")
    equal = np.zeros_like(both)
    for gt in pd.unique(cells[typed]):
        own = (cells == gt).astype("float32")
        equal += own @ own.T
    same, label, was = (both == equal) & (both >= MIN_LOCI), np.arange(len(cells)), None
    np.fill_diagonal(same, True)
    while was is None or (label != was).any():
        was = label
        label = np.where(same, label, len(cells)).min(axis=1)
    number = {x: n + 1 for n, x in enumerate(dict.fromkeys(label.tolist()))}
    return pd.DataFrame({"sample": genotypes.index, "individual": [f"IND_{number[x]:03d}" for x in label.tolist()]})


@_query
def block_method(spark, sf):
    return _r(blocks.by_block(_panel(spark, sf), _same_everywhere)[0])


@_query
def evidence_histogram(spark, sf):
    return _r(_evidence(spark, sf).histogram(compare.BARS))


@_query
def mismatch_bars(spark, sf):
    ok = (F.col("n_mismatch") <= 1) & (F.col("n_mismatch_2allele") <= 0)
    return _r(compare.evidence_histogram(_stats(spark, sf).filter(F.col("n_compared") >= MIN_LOCI), "n_mismatch", ok, width=1.0))


@_query
def margin_strip(spark, sf):
    return _r(compare.margin_strip(_confidence(spark, sf)))


@_query
def quality_report(spark, sf):
    own = _panel(spark, sf)  # its cells are made faster than they are read from a file
    kept = panel.filter_panel(own, min_locus_call=0.925, min_sample_call=0.9)
    return _r(panel.quality_report(fixtures.raw_cells(spark, sf), fixtures.written_ids(spark, sf), own, kept))


@_query
def calibration_complete(spark, sf):
    table = _calibrated(spark, sf, "complete")
    return _r(table.select("cutoff", "n_accepted", "false_merges", "missed", "n_individuals"), 4, cutoff=6)
