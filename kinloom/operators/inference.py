"""What a raw table holds: separator, loci, sample id, replicates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions.genotype import SEPARATORS, allele, normalise
from kinloom.sources.staging import staged

# Names of id and replicate columns, labels of summary rows, letters of DNA.
ID_NAME = re.compile(r"sample|specimen|individual|indiv|barcode|(^|[^a-z])id$|^id", re.I)
REPLICATE_NAME = re.compile(r"^(rep|replicate|pcr|run)", re.I)
SUMMARY_LABEL = r"(?i)consensus|final|combined|summary"
DNA = "^[ACGTN]$"


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, raw) of all cells, in one pass over the table."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("raw")) for c in columns])
    return df.select(F.explode(pairs).alias("c")).select("c.*")


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, raw, c): the values of each column and how many cells hold them, summed before the shuffle."""
    return _cells(df, columns).groupBy("column", "raw").agg(F.count("*").alias("c"))


def _cells_if(ok):
    """How many cells of _values fulfil ok."""
    return F.sum(F.when(ok, F.col("c")).otherwise(0))


def _number(x):
    """The number that a text spells, else null; a trailing d or f spells none."""
    return F.when(~x.rlike(r"[0-9.][dDfF]\s*$"), x.try_cast("double"))


def separator_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """(sep, share) of non-empty cells that each separator cuts in two; an empty piece at the very end is none."""
    cells = _cells(df, columns).filter(F.length("raw") > 0)

    def pieces(s):
        parts = F.split("raw", re.escape(s), -1)
        return F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0)

    shares = [F.avg((pieces(s) == 2).cast("double")).alias(str(k)) for k, s in enumerate(SEPARATORS)]
    return cells.agg(*shares).select(F.explode(F.array(*[F.struct(F.lit(s).alias("sep"), F.col(str(k)).alias("share")) for k, s in enumerate(SEPARATORS)])).alias("s")).select("s.*")


def guess_separator(df: DataFrame, columns: list[str]) -> str | None:
    share = {r["sep"]: r["share"] or 0.0 for r in separator_shares(df, columns).collect()}
    return next((s for s in SEPARATORS if share[s] > 0.4), None)


def locus_tests(df: DataFrame, columns: list[str], sep: str | None = None) -> DataFrame:
    """(column, figures..., is_locus): what each column's values look like, and whether it passes every test."""
    cells = staged(_values(df, columns), "values").withColumn("x", F.upper(F.trim(F.coalesce("raw", F.lit(""))))).withColumn("gt", normalise(F.col("raw"), sep))
    number = _number(F.col("x"))
    filled = F.col("x") != ""
    base = cells.groupBy("column").agg(
        _cells_if(filled).alias("n_filled"),
        _cells_if(filled & number.isNull()).alias("n_text"),
        F.count_distinct(F.when(filled, number)).alias("n_values"),
        F.sum("c").alias("n_rows"),
        _cells_if(F.col("gt").isNotNull()).alias("n_typed"),
        F.count_distinct("gt").alias("n_genotypes"),
    )
    a = cells.filter("gt is not null").select("column", F.explode(F.array(allele(F.col("gt"), 1), allele(F.col("gt"), 2))).alias("a"))
    own = a.groupBy("column").agg(
        F.count_distinct("a").alias("n_alleles"),
        F.min(F.length("a")).alias("narrow"),
        F.max(F.length("a")).alias("wide"),
        F.min(F.col("a").rlike(DNA).cast("int")).alias("dna"),
        F.min(F.col("a").rlike("^[0-9]+$").cast("int")).alias("digits"),
    )
    rows = base.join(own, "column", "left")
    ok = (
        (F.col("n_filled") > 0)
        & ~((F.col("n_text") == 0) & (F.col("n_values") > 12))
        & (F.col("n_typed") / F.col("n_rows") >= 0.05)
        & F.col("n_genotypes").between(1, 60)
        & (F.col("n_genotypes") <= F.greatest(F.lit(3.0), 0.5 * F.col("n_typed")))
        & F.col("n_alleles").between(2, 40)
        & (F.col("narrow") == F.col("wide"))
        & ((F.col("dna") == 1) | ((F.col("digits") == 1) if sep else F.lit(False)))
    )
    return rows.select("column", "n_filled", "n_typed", "n_genotypes", F.coalesce("n_alleles", F.lit(0)).alias("n_alleles"), F.coalesce(ok, F.lit(False)).alias("is_locus"))


def detect_loci(df: DataFrame, sep: str | None = None, exclude: tuple[str, ...] = ()) -> list[str]:
    """Columns that hold genotypes, in table order; columns of a numeric type are none."""
    texts = [f.name for f in df.schema if f.dataType.typeName() == "string" and f.name not in exclude]
    found = {r["column"] for r in locus_tests(df, texts, sep).filter("is_locus").collect()}
    return [c for c in texts if c in found]


def id_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, score): share of distinct values (null is one), less 1 when all are numbers, plus 2 when the name tells."""
    hints = {c: 2.0 if ID_NAME.search(c) else 0.0 for c in columns}
    bonus = df.sparkSession.createDataFrame([(c, v) for c, v in hints.items()], "column string, bonus double")
    raw = F.col("raw")
    own = _values(df, columns).groupBy("column").agg(  # null is one of the values
        (F.count("*") / F.sum("c")).alias("share"), _cells_if(raw.isNotNull()).alias("n"), _cells_if(raw.isNotNull() & _number(raw).isNull()).alias("n_text")
    )
    numbers = (F.col("n") > 0) & (F.col("n_text") == 0)
    return own.join(F.broadcast(bonus), "column").select("column", (F.col("share") - F.when(numbers, 1.0).otherwise(0.0) + F.col("bonus")).alias("score"))


def guess_id(df: DataFrame, columns: list[str] | None = None) -> str:
    columns = columns or df.columns
    score = {r["column"]: r["score"] for r in id_scores(df, columns).collect()}
    return max(columns, key=lambda c: (score[c], -columns.index(c)))


def has_replicates(df: DataFrame, id_col: str) -> bool:
    return df.groupBy(id_col).count().filter("count > 1").limit(1).count() > 0


def guess_replicate_column(columns: list[str], loci: list[str]) -> str | None:
    """The first column that is no locus and has a replicate's name, else the first that is no locus."""
    rest = [c for c in columns if c not in loci]
    return next((c for c in rest if REPLICATE_NAME.search(c)), rest[0] if rest else None)


def summary_labels(df: DataFrame, column: str) -> DataFrame:
    """Replicate labels that mark summary rows, which are not replicates."""
    return df.select(column).distinct().filter(F.col(column).rlike(SUMMARY_LABEL))


def replicate_plan(df: DataFrame, id_col: str, loci: list[str]) -> tuple[str | None, tuple[str, ...]]:
    """(replicate column, labels that are no replicates) where ids occur more than once, else (None, ())."""
    if not has_replicates(df, id_col):
        return None, ()
    column = guess_replicate_column([c for c in df.columns if c != id_col], loci)
    if column is None:
        return None, ()
    return column, tuple(sorted(r[0] for r in summary_labels(df, column).collect()))  # a few labels
