"""Matching methods: which pairs of samples are the same individual."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions.genotype import posterior
from kinloom.operators import likelihood, pairs
from kinloom.operators.panel import allele_freq, dictionary, encode
from kinloom.sources.staging import few, staged

ALTERNATIVES = ("unrelated", "full_sib", "parent_offspring")


def exact(stats: DataFrame, min_loci: int = 1) -> DataFrame:
    return stats.filter((F.col("n_compared") >= min_loci) & (F.col("n_mismatch") == 0))


def threshold(stats: DataFrame, k: int = 1, hard: int = 0, min_loci: int = 20) -> DataFrame:
    """At most k loci differ, at most `hard` of them without a common allele."""
    return stats.filter((F.col("n_compared") >= min_loci) & (F.col("n_mismatch") <= k) & (F.col("n_mismatch_2allele") <= hard))


def near(stats: DataFrame, near_loci: int = 2, min_loci: int = 1) -> DataFrame:
    """Pairs that differ at up to near_loci loci, the most similar first."""
    return stats.filter((F.col("n_compared") >= min_loci) & F.col("n_mismatch").between(1, near_loci))


def in_near_order(found: DataFrame) -> DataFrame:
    return found.orderBy("n_mismatch", F.desc("n_compared"), "ord1", "ord2")


def top_pairs(scored: DataFrame, n: int = 200, digits: int = 6) -> DataFrame:
    """The n pairs with most evidence; evidence that agrees to so many digits is a tie, decided by row order."""
    return scored.orderBy(F.desc(F.round("lr", digits)), "ord1", "ord2").limit(n)


def mismatch_histogram(stats: DataFrame, min_loci: int = 1) -> DataFrame:
    return stats.filter(F.col("n_compared") >= min_loci).groupBy("n_mismatch").agg(F.count("*").alias("n_pairs"))


def fallback_mismatches(stats: DataFrame, min_loci: int = 20, max_m: int = 6) -> DataFrame:
    """The m in 0..max_m with the fewest pairs at m + 1 mismatches, the smallest of equals; one row (m_hat, n_ambiguous)."""
    spark = stats.sparkSession
    counts = stats.filter((F.col("n_compared") >= min_loci) & (F.col("n_mismatch") <= max_m + 1)).groupBy("n_mismatch").agg(F.count("*").alias("c"))
    every = spark.range(max_m + 1).select(F.col("id").cast("int").alias("m"))
    at = every.join(counts, every["m"] + 1 == counts["n_mismatch"], "left").select("m", F.coalesce("c", F.lit(0)).alias("c"))
    return at.agg(F.min(F.struct("c", "m")).alias("b")).select("b.m", "b.c").toDF("m_hat", "n_ambiguous")


def lr_pairs(panel: DataFrame, dropout: float = 0.02, false_allele: float = 0.005, kinship: str | tuple = "full_sib") -> DataFrame:
    """(grp, ord1, ord2, id1, id2, n_compared, lr) from consensus genotypes."""
    panel = staged(panel, "panel")
    table = likelihood.lr_table(dictionary(panel), allele_freq(panel), dropout, false_allele, kinship)
    return pairs.lookup_sums(encode(panel), table, ["lr"])


def priors(scored: DataFrame, sizes: DataFrame, cut: float | str = 0.999, min_loci: int = 15, rounds: int = 25, by: tuple[str, ...] = ("grp",)) -> DataFrame:
    """(by..., prior): share of matching pairs, found by repeated estimation for all blocks (and settings) at once.

    scored: (by..., lr, n_compared); sizes: (by..., n, the cut if it is a column).  A block stops at the value it had
    when the next one is equal to it.  No prior is over a half, so only pairs that would match then are kept; each
    round is one aggregation with partial counts, and its table of a row a block is written to the shared folder.
    """
    n, total = F.col("n"), F.col("n") * (F.col("n") - 1) / 2
    least = 1 / F.greatest(n, F.lit(2))
    at = F.col(cut) if isinstance(cut, str) else F.lit(float(cut))
    state = staged(sizes.select(*by, "n", at.alias("at"), least.alias("prior"), (total == 0).alias("done")), "priors")
    lowest = at * (1 - 1e-9)
    usable = scored.filter((F.col("n_compared") >= min_loci) & (posterior(F.col("lr"), F.lit(0.5)) >= lowest)).select(*by, "lr")
    usable = staged(usable, "may-match")
    for _ in range(rounds):
        open_ = state.filter("not done")
        if not open_.head(1):
            break
        hits = usable.join(few(open_).select(*by, "prior", "at"), list(by)).filter(posterior(F.col("lr"), F.col("prior")) >= F.col("at")).groupBy(*by).agg(F.count("*").alias("m"))
        new = F.least(F.lit(0.5), F.greatest(least, (F.coalesce("m", F.lit(0)) + 1) / F.nullif(total, F.lit(0))))
        stays = F.col("done") | (F.abs(new - F.col("prior")) < 1e-10)
        state = staged(state.join(hits, list(by), "left").select(*by, "n", "at", F.when(stays, F.col("prior")).otherwise(new).alias("prior"), stays.alias("done")), "priors")
    return few(state).select(*by, "prior")


def with_posterior(scored: DataFrame, prior: DataFrame) -> DataFrame:
    return scored.join(prior, "grp").withColumn("posterior", posterior(F.col("lr"), F.col("prior")))


def likelihood_ratio(panel: DataFrame, dropout: float = 0.02, false_allele: float = 0.005, kinship: str | tuple = "full_sib", cut: float = 0.999, min_loci: int = 15, prior: float | None = None, scored: DataFrame | None = None):
    """(pairs with posterior, matched pairs); scored: pairs of another route, with lr and n_compared."""
    scored = staged(scored if scored is not None else lr_pairs(panel, dropout, false_allele, kinship), "lr-pairs")
    sizes = panel.groupBy("grp").agg(F.count_distinct("ord").alias("n"))
    p = priors(scored, sizes, cut, min_loci) if prior is None else sizes.select("grp", F.lit(float(prior)).alias("prior"))
    found = with_posterior(scored, p)
    return found, found.filter((F.col("n_compared") >= min_loci) & (F.col("posterior") >= cut))


def best_alternative_pairs(panel: DataFrame, dropout: float = 0.02, false_allele: float = 0.005, alternatives: tuple[str, ...] = ALTERNATIVES) -> DataFrame:
    """(..., n_compared, same, alternatives..., best_alternative, log10_lambda)."""
    panel = staged(panel, "panel")
    table = likelihood.log_likelihoods(dictionary(panel), allele_freq(panel), dropout, false_allele, {a: likelihood.KINSHIP[a] for a in alternatives})
    return decided(pairs.lookup_sums(encode(panel), table, ["same", *alternatives]), alternatives)


def decided(sums: DataFrame, alternatives: tuple[str, ...] = ALTERNATIVES) -> DataFrame:
    """The alternative that explains a pair best (ties: the first), and the evidence against it."""
    top = F.greatest(*alternatives) if len(alternatives) > 1 else F.col(alternatives[0])
    best = None
    for a in alternatives:
        best = F.when(F.col(a) == top, F.lit(a)) if best is None else best.when(F.col(a) == top, F.lit(a))
    return sums.withColumn("best_alternative", best).withColumn("log10_lambda", F.col("same") - top)


def best_alternative(scored: DataFrame, lambda_cut: float = 1.0, min_loci: int = 15) -> DataFrame:
    """Pairs better explained as one individual than by any alternative; the cut is strict."""
    return scored.filter((F.col("n_compared") >= min_loci) & (F.col("log10_lambda") > F.log10(F.lit(float(lambda_cut)))))


def matched_power(matched: DataFrame, panel: DataFrame, power: DataFrame) -> DataFrame:
    """(id1, id2, log10_pid, log10_pid_sib) over the loci that both samples of a matched pair have; power: by block."""
    typed = panel.filter(F.col("gt").isNotNull()).join(power, ["grp", "locus"]).select("ord", "locus", "pid", "pid_sib")
    first = matched.select("ord1", "ord2", "id1", "id2").join(typed.withColumnRenamed("ord", "ord1"), "ord1")
    both = first.join(typed.select(F.col("ord").alias("ord2"), "locus"), ["ord2", "locus"])
    return both.groupBy("id1", "id2").agg(F.sum(F.log10("pid")).alias("log10_pid"), F.sum(F.log10("pid_sib")).alias("log10_pid_sib"))


def masked_power(matched: DataFrame, loci: list, power: DataFrame) -> DataFrame:
    """matched_power of pairs that carry `common` (see pair_masks): a row a pair and none a locus; power: by block."""
    index = power.sparkSession.createDataFrame([(x, k) for k, x in enumerate(loci)], power.select("locus").schema.add("lidx", "integer"))
    held = F.map_from_entries(F.collect_list(F.struct("lidx", F.struct(F.log10("pid").alias("pid"), F.log10("pid_sib").alias("pid_sib")))))
    held = power.join(F.broadcast(index), "locus").groupBy("grp").agg(held.alias("held"))
    # sums for the sixteen values of four loci at a time: few terms a pair, so that the step stays small enough to compile
    fours = -(-len(loci) // 4)
    value = lambda x, i, b: F.when(F.shiftright(i, b) % 2 == 1, F.coalesce(F.element_at("held", (F.shiftright(i, 4) * 4 + b).cast("int"))[x], F.lit(0.0))).otherwise(0.0)
    of = lambda x: F.transform(F.sequence(F.lit(0), F.lit(fours * 16 - 1)), lambda i: value(x, i, 0) + value(x, i, 1) + value(x, i, 2) + value(x, i, 3)).alias(x)
    rows = matched.filter("n_compared > 0").join(staged(held.select("grp", of("pid"), of("pid_sib")), "block-power"), "grp")
    total = lambda x: F.expr(" + ".join(f"{x}[cast(shiftright(common[{k // 16}], {4 * (k % 16)}) & 15 as int) + {16 * k}]" for k in range(fours)))
    return rows.select("id1", "id2", total("pid").alias("log10_pid"), total("pid_sib").alias("log10_pid_sib"))


def sweep(samples: DataFrame, stats: DataFrame, max_k: int = 6, min_loci: int = 20) -> DataFrame:
    """(k, n_matched_pairs, n_individuals, max_cluster, n_conflicting) for 0..max_k mismatches, whatever their kind."""
    from kinloom.operators.graph import nested_counts

    matched = stats.filter((F.col("n_compared") >= min_loci) & (F.col("n_mismatch") <= max_k)).withColumn("level", F.col("n_mismatch"))
    return nested_counts(samples, matched, list(range(max_k + 1))).select(F.col("key").cast("long").alias("k"), "n_matched_pairs", "n_individuals", "max_cluster", "n_conflicting")


def power_ceiling(panel: DataFrame, scored: DataFrame, table: DataFrame, cut: float = 0.999, min_loci: int = 15) -> DataFrame:
    """(grp, max_lr_theoretical, max_lr, max_posterior, reachable): what a block's loci can say at most, and what its
    most similar pair says; a cutoff over that leaves every sample alone.

    scored: pairs with posterior; table: lr_table of the panel.
    """
    most = table.groupBy("grp", "locus").agg(F.max("lr").alias("m")).groupBy("grp").agg(F.sum("m").alias("max_lr_theoretical"))
    seen = scored.filter(F.col("n_compared") >= min_loci).groupBy("grp").agg(F.max("lr").alias("max_lr"), F.max("posterior").alias("max_posterior"))
    rows = panel.select("grp").distinct().join(most, "grp", "left").join(seen, "grp", "left")
    top = F.coalesce("max_posterior", F.lit(0.0))
    return rows.select("grp", F.coalesce("max_lr_theoretical", F.lit(0.0)).alias("max_lr_theoretical"), "max_lr", top.alias("max_posterior"), (top >= cut).alias("reachable"))


def plateau(table: DataFrame) -> DataFrame:
    """The largest k whose number of individuals is that of k - 1, without conflicts; else 1."""
    from pyspark.sql import Window as W

    flat = table.withColumn("was", F.lag("n_individuals").over(W.orderBy("k"))).filter((F.col("n_individuals") == F.col("was")) & (F.col("n_conflicting") == 0))
    return flat.agg(F.coalesce(F.max("k"), F.lit(1)).alias("k"))


#: The grid of settings.
GRID = {"dropouts": (0.001, 0.01, 0.05), "kinships": ("unrelated", "full_sib"), "cuts": (0.95, 0.99, 0.999, 0.9999)}


def in_grid_order(table: DataFrame) -> DataFrame:
    return table.orderBy("kinship", "dropout", "cutoff")


def sensitivity(panel: DataFrame, dropout: float = 0.02, kinship: str = "full_sib", cut: float = 0.999, false_allele: float = 0.005, min_loci: int = 15, grid: dict = GRID) -> DataFrame:
    """(kinship, dropout, cutoff, n_individuals, n_conflicting, current) over the grid with the current settings in it.

    The evidence for all dropouts and kinships is one pass over the pairs; priors and components of all settings share
    their rounds.
    """
    from kinloom.operators.graph import linkage_counts, samples_of

    panel = staged(panel, "panel")
    dropouts, cuts, kinships = sorted({*grid["dropouts"], dropout}), sorted({*grid["cuts"], cut}), grid["kinships"]
    dic, freq = dictionary(panel), allele_freq(panel)
    table = None
    for k, d in enumerate(dropouts):
        own = likelihood.log_likelihoods(dic, freq, d, false_allele, {x: likelihood.KINSHIP[x] for x in kinships})
        own = own.select("grp", "locus", "g1", "g2", *[(F.col("same") - F.col(x)).alias(f"lr{k}_{j}") for j, x in enumerate(kinships)])
        table = own if table is None else table.join(own, ["grp", "locus", "g1", "g2"])
    names = [f"lr{k}_{j}" for k in range(len(dropouts)) for j in range(len(kinships))]
    scored = pairs.lookup_sums(encode(panel), table, names)
    lrs = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col(n).alias("lr")) for s, n in enumerate(names)])).alias("x")
    steps = F.explode(F.array(*map(F.lit, cuts))).alias("cut")
    long = scored.filter(F.col("n_compared") >= min_loci).select("grp", "ord1", "ord2", "n_compared", lrs).select("grp", "ord1", "ord2", "n_compared", "x.*")
    long = staged(long.filter(posterior(F.col("lr"), F.lit(0.5)) >= min(cuts) * (1 - 1e-9)).select("*", steps), "grid")
    samples = staged(samples_of(panel), "samples")
    settings = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(c).alias("cut")) for s in range(len(names)) for c in cuts])).alias("y")
    sizes = samples.groupBy("grp").agg(F.count("*").alias("n")).select("grp", "n", settings).select("grp", "n", "y.*")
    prior = priors(long, sizes, "cut", min_loci, by=("grp", "s", "cut"))
    # a setting is a number: s and the place of its cutoff
    key = (F.col("s") * len(cuts) + F.array_position(F.array(*map(F.lit, cuts)), F.col("cut")) - 1).cast("int").alias("key")
    matched = long.join(prior, ["grp", "s", "cut"]).filter(posterior(F.col("lr"), F.col("prior")) >= F.col("cut")).select(key, "ord1", "ord2")
    told = [(x, d, c, (d, x, c) == (dropout, kinship, cut)) for d in dropouts for x in kinships for c in cuts]
    rows = [(k, *r) for k, r in enumerate(told)]
    named = panel.sparkSession.createDataFrame(rows, "key int, kinship string, dropout double, cutoff double, current boolean")
    return named.join(linkage_counts(samples, matched, [r[0] for r in rows]), "key").select("kinship", "dropout", "cutoff", "n_individuals", "n_conflicting", "current")
