"""Genotype panels derived from the table `events` by integer arithmetic, the same in Spark and in SQL.

Every event is a sample and every user an individual; five users make a block.  24 loci with two alleles, 7 % missing,
3 % dropout; a second fixture has three replicate reactions for each sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.sources.staging import measured_joins

LOCI = 24
H1 = "(user_id * 7919 + locus * 104729 + user_id * locus * 1299709) % 1009"
H2 = "(user_id * 15485863 + locus * 32452843 + user_id * locus * 49979687) % 1013"
E = "((event_id * 6700417 + locus * 2147483 + event_id * locus * 433494437) % 1021) % 100"
R = "(event_id * 6700417 + locus * 2147483 + rep * 86028121 + event_id * locus * rep * 433494437) % 1021"
ALLELE = "CASE WHEN {h} % 100 < 30 + locus THEN 'A' ELSE 'G' END"
PANEL_GT = "CASE WHEN e < 7 THEN NULL WHEN a1 <> a2 AND e < 10 THEN a1 || '/' || a1 ELSE least(a1, a2) || '/' || greatest(a1, a2) END"
REP_GT = (
    "CASE WHEN e % 100 < 13 THEN NULL WHEN a1 <> a2 AND e % 100 < 18 THEN CASE WHEN e % 2 = 0 THEN a1 || '/' || a1 ELSE a2 || '/' || a2 END "
    "WHEN e % 100 < 20 THEN 'A/G' ELSE least(a1, a2) || '/' || greatest(a1, a2) END"
)
#: The same in Spark, with x1 and x2 for an allele being A: no text is built or compared for a cell, and the code of a step
#: stays small enough for the JVM to compile.
IS_A = "coalesce({h} % 100 < 30 + locus, false)"
ONE = "CASE WHEN {x} THEN 'A/A' ELSE 'G/G' END"
PANEL_CODE = f"CASE WHEN e < 7 THEN NULL WHEN x1 = x2 OR e < 10 THEN {ONE.format(x='x1')} ELSE 'A/G' END"
REP_CODE = (
    f"CASE WHEN e % 100 < 13 THEN NULL WHEN x1 <> x2 AND e % 100 < 18 THEN {ONE.format(x='coalesce(e % 2 = 0, false) = x1')} "
    f"WHEN x1 <> x2 OR e % 100 < 20 THEN 'A/G' ELSE {ONE.format(x='x1')} END"
)
#: Cells as a laboratory would write them: no separator, some reversed, some flagged.
RAW = (
    "concat(CASE WHEN gt IS NULL THEN '00' WHEN (sample + locus) % 7 = 0 THEN concat(substr(gt, 3, 1), substr(gt, 1, 1)) "
    "ELSE concat(substr(gt, 1, 1), substr(gt, 3, 1)) END, CASE WHEN (sample * 24 + locus) % 31 = 0 THEN '*' ELSE '' END)"
)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured_joins(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, event_id, user_id): a block in one partition before its cells are made.

    The file of all events is small for what is made of it (a few tasks would read it), and steps that group by the block
    or the sample find it in place, so that a row an event is shuffled and none a cell.
    """
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return events(spark, sf_dir).selectExpr("user_id div 5 AS grp", "event_id", "user_id").repartition(n, "grp")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir).withColumn("locus", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(LOCI).cast("long"))))
    rows = rows.selectExpr("grp", "event_id AS sample", "event_id AS ord", "locus", f"{IS_A.format(h=H1)} AS x1", f"{IS_A.format(h=H2)} AS x2", f"{E} AS e")
    return rows.selectExpr("grp", "sample", "ord", "locus", f"{PANEL_CODE} AS gt")


def replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir).withColumn("locus", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(LOCI).cast("long"))))
    rows = rows.withColumn("rep", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))))
    rows = rows.selectExpr("grp", "event_id AS sample", "event_id AS ord", "rep", "locus", f"{IS_A.format(h=H1)} AS x1", f"{IS_A.format(h=H2)} AS x2", f"{R} AS e")
    return rows.selectExpr("grp", "sample", "ord", "rep", "locus", f"{REP_CODE} AS gt")


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).selectExpr("sample", "locus", f"{RAW} AS raw")


def raw_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cells as a wide table of strings, with an id, a read count and a label as other columns."""
    cells = raw_cells(spark, sf_dir).groupBy("sample").agg(*[F.max(F.when(F.col("locus") == k, F.col("raw"))).alias(f"LOC{k:02d}") for k in range(1, LOCI + 1)])
    return cells.selectExpr("concat('S', sample) AS SampleID", "cast(sample * 37 % 1000 AS string) AS Reads", "CASE WHEN sample % 3 = 0 THEN 'alpha' ELSE 'beta' END AS Species", *[f"LOC{k:02d}" for k in range(1, LOCI + 1)])


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, value): the individual each sample came from."""
    return events(spark, sf_dir).selectExpr("event_id AS ord", "user_id AS value")


#: A marker of two values as read: each individual has one, one reading in forty is wrong, some are missing.
MARKER = "CASE WHEN event_id % 13 = 0 THEN NULL WHEN (user_id + CASE WHEN event_id % 40 = 7 THEN 1 ELSE 0 END) % 2 = 0 THEN 'XX' ELSE 'XY' END"


def marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, value): an attribute that should be the same in all samples of an individual."""
    return events(spark, sf_dir).selectExpr("event_id AS ord", f"{MARKER} AS value")


def written_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id): sample names as a laboratory wrote them, one in ninety of them twice."""
    return events(spark, sf_dir).selectExpr("CASE WHEN event_id % 90 = 1 THEN event_id - 1 ELSE event_id END AS id")


#: Three species calls for each sample, some of them not to be used.
VOTE = "CASE (event_id * 31 + call * 17 + user_id * call) % 7 WHEN 0 THEN 'dog' WHEN 1 THEN 'none' WHEN 2 THEN 'coyote' WHEN 3 THEN 'coyote' ELSE 'wolf' END"
#: A row a run of a simulated experiment.
RUN = "20 + 10 * (event_id % 3) AS n_loci, 0.05 * (event_id % 2) AS dropout, (event_id * 37 % 1000) / 1000.0 AS cons_ari, CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id * 91 % 1000 + 40) / 1000.0 END AS reps_ari"


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("call", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))))
    return rows.selectExpr("event_id AS sample", f"{VOTE} AS vote")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).selectExpr(*[x.strip() for x in RUN.split(", ")])
    return rows.select("n_loci", *[F.col(c).cast("double").alias(c) for c in ("dropout", "cons_ari", "reps_ari")])


SQL_VOTES = f"votes AS (SELECT event_id AS sample, {VOTE} AS vote FROM events, (SELECT unnest(range(1, 4)) AS call))"
SQL_RUNS = f"runs AS (SELECT n_loci, dropout::DOUBLE AS dropout, cons_ari::DOUBLE AS cons_ari, reps_ari::DOUBLE AS reps_ari FROM (SELECT {RUN} FROM events))"
SQL_PANEL = f"""
cells AS (SELECT user_id, event_id, locus FROM events, (SELECT unnest(range(1, {LOCI + 1})) AS locus)),
panel AS MATERIALIZED (
  SELECT grp, sample, locus, {PANEL_GT} AS gt FROM (
    SELECT user_id // 5 AS grp, event_id AS sample, locus, {ALLELE.format(h=H1)} AS a1, {ALLELE.format(h=H2)} AS a2, {E} AS e FROM cells)),
samples AS (SELECT DISTINCT grp, sample FROM panel)"""
SQL_REPS = f"""
reps AS MATERIALIZED (
  SELECT grp, sample, rep, locus, {REP_GT} AS gt FROM (
    SELECT user_id // 5 AS grp, event_id AS sample, rep, locus, {ALLELE.format(h=H1)} AS a1, {ALLELE.format(h=H2)} AS a2, {R} AS e
    FROM cells, (SELECT unnest(range(1, 4)) AS rep)))"""
