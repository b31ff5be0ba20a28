"""Column names and codes of result tables in words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of use to the engine only.
HIDDEN = ("ord", "ord1", "ord2", "status_rank")
#: column -> (label, what it says)
LABELS = {
    "grp": ("Group", "Block within which samples are compared"),
    "sample": ("Sample", "Name of the sample"),
    "individual": ("Individual", "Number of the individual the sample was given to"),
    "n_samples": ("Samples", "How many samples an individual has"),
    "cluster_size": ("Samples of the individual", "How many samples share the individual"),
    "call_rate": ("Call rate", "Share of loci that have a genotype"),
    "n_compared": ("Loci compared", "Loci typed in both samples"),
    "n_mismatch": ("Loci that differ", "Compared loci with different genotypes"),
    "n_mismatch_2allele": ("Loci without a common allele", "Compared loci at which the samples share no allele"),
    "lr": ("log10 likelihood ratio", "Evidence for one individual against relatives"),
    "posterior": ("Posterior", "Chance that both samples are one individual"),
    "log10_lambda": ("log10 lambda", "Evidence against the best alternative"),
    "best_alternative": ("Best alternative", "Relation that explains the pair best if it is not one individual"),
    "support": ("Support", "Weakest score to a sample of the same individual"),
    "rival": ("Rival score", "Strongest score to a sample of another individual"),
    "margin": ("Margin", "Support less the rival score"),
    "status": ("Status", "How firmly the sample sits in its individual"),
    "maf": ("Rarest allele", "Frequency of the rarest allele"),
    "ho": ("Observed heterozygosity", "Share of heterozygotes"),
    "he": ("Expected heterozygosity", "Share expected under random mating"),
    "fis": ("Fis", "Shortage of heterozygotes"),
    "cutoff": ("Cutoff", "Posterior at which pairs are accepted"),
    "false_merges": ("Expected false merges", "Accepted pairs that are expected to be wrong"),
    "missed": ("Expected missed pairs", "Rejected pairs that are expected to be right"),
}
#: Columns whose contents are codes, and the words for these.
CODED = ("method", "kinship", "best_alternative", "linkage")
WORDS = {
    "exact": "Exact match", "threshold": "Mismatch threshold", "similarity": "Similarity", "likelihood_ratio": "Likelihood ratio", "best_alternative": "Best alternative",
    "unrelated": "Unrelated", "full_sib": "Full siblings", "half_sib": "Half siblings", "parent_offspring": "Parent and offspring", "single": "Single linkage", "complete": "Complete linkage",
}


def relabelled(df: DataFrame) -> DataFrame:
    """df for reading: helper columns hidden, codes and column names in words; a column's comment says what it holds."""
    out, taken = [], {}
    for name in df.columns:
        if name in HIDDEN:
            continue
        c, (label, about) = F.col(f"`{name}`"), LABELS.get(name, (name, ""))
        if name in CODED:
            words = F.create_map(*[F.lit(x) for pair in WORDS.items() for x in pair])
            c = F.coalesce(F.try_element_at(words, c), c)
        taken[label] = taken.get(label, 0) + 1
        out.append(c.alias(label if taken[label] == 1 else f"{label}.{taken[label] - 1}", metadata={"comment": f"{about} (column {name})" if about else ""}))
    return df.select(*out)
