"""Mixing sources to target weights by a low-discrepancy schedule (built-in functions only).

Plan
1. every row becomes (row, id, source, size), size being its words; sources are summed, numbered in code point order by
   ranges, and weighed in turn;
2. targets: the sources share ``share`` of all words by weight, none more than ``most`` times its own words; the level at
   which the capped ones stop is found by a few sums over the table of sources;
3. schedule: slot t has the van der Corput point j / 2^m, j being the m bits of t in reverse.  The point falls to the
   source whose interval of the cumulative shares holds it, so every stretch of the schedule has the sources in
   proportion.  A slot's rank among the slots of its source is counted, not sorted: the slots before t are one dyadic
   block for each bit of t, and a block's points are evenly spaced;
4. a source's documents, shuffled anew for each pass over them, are one stream of words, cut into blocks of ``block``
   words; the slot of rank k is joined with block k.  A stream ends at the source's target (rounded down), so a source's
   taken words are its target to less than a word.

A document's place in its stream is a running sum in two steps: over ranges of the shuffled order, and inside each, so a
source with a third of all rows is in many tasks.  The table of sources is broadcast only when it is counted to be short.

Defined results: a null text has size 0; a null source is a source of its own, the last one; null ids are allowed and
repeated rows each count; documents of size 0 are never taken; where no document has a word, all targets are 0; an empty
table gives empty results; other columns play no part.  Reruns agree: the order depends on id, pass and size only (rows
that agree in these and in their source have one result between them).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import documents, looked_up, staged

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Words of a block.
BLOCK = 1024
#: Rows of a range of a shuffled order, about, and ranges at most (a power of 16).
RANGE_ROWS, MAX_RANGES = 20_000, 1 << 16
#: Points that one row of the table of points becomes.
CHUNK = 1 << 12
#: Tasks that make points, at most.
MOST_TASKS = 20_000

WORD = r"[^\x20\x09-\x0D]+"


def _numbered(sources: DataFrame) -> DataFrame:
    """sources (source, source_size) with their number src from 0 in code point order, null last."""
    parts = sources.repartitionByRange(F.col("source").asc_nulls_last())
    parts = staged(parts.select(F.spark_partition_id().alias("part"), "*"), "sources")
    place = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return parts.select("*", place.alias("place")).join(_before(parts, F.count("*")), "part").select("source", "source_size", (F.col("before") + F.col("place") - 1).alias("src"))


def _before(parts: DataFrame, value) -> DataFrame:
    """(part, before): what the partitions before each hold; a row a partition."""
    out, total = [], 0
    for part, n in sorted(parts.groupBy("part").agg(value).collect()):
        out.append((part, total))
        total += n
    return parts.sparkSession.createDataFrame(out, "part int, before long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, src, source_size, target) from (source, source_size)."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("src", F.lit(len(weights))) + 1).cast("int")).cast("double")
    table = _numbered(sources).withColumns({"weight": weight, "cap": F.col("source_size").cast("double") * most})
    table = staged(table, "weights")
    goal = share * (table.agg(F.sum("source_size")).first()[0] or 0)

    def level(at: float):
        under = F.col("cap") < F.col("weight") * at
        capped, open_ = table.agg(F.coalesce(F.sum(F.when(under, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~under, F.col("weight"))), F.lit(0.0))).first()
        return goal - capped, open_

    rest, open_ = level(0.0)
    while open_:  # each round caps at least one more source
        at = rest / open_
        again = level(at)
        if again == (rest, open_):
            break
        rest, open_ = again
    at = rest / open_ if open_ else float("inf")
    target = F.when(F.col("cap") < F.col("weight") * at, F.col("cap")).otherwise(F.col("weight") * rest / (open_ or 1.0))
    return staged(table.select("source", "src", "source_size", target.alias("target")), "targets")


def reverse_bits(t, bits: int):
    """The lowest bits of t in reverse order."""
    return F.conv(F.reverse(F.lpad(F.bin(t), bits, "0")), 2, 10).cast("long")


def rank_before(bits: int):
    """SQL: how many of the slots before `slot` have a point in [lo, hi); `point` is the slot's own."""

    def count(edge: str) -> str:
        # of the points o, o + step, ... (2^b of them) those under the edge; o: the point of the block's first slot
        step, first = f"shiftleft(1L, {bits} - b)", f"(point & (shiftleft(1L, {bits} - b - 1) - 1))"
        return f"least(shiftleft(1L, b), greatest(0L, ({edge} - {first} + {step} - 1) div {step}))"

    return f"aggregate(filter(sequence(0, {bits - 1}), b -> shiftright(slot, b) & 1 = 1), 0L, (n, b) -> n + {count('hi')} - {count('lo')})"


def slots(table: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, src, block): which block of which source stands where in the mix; table: of `targets`."""
    need = F.ceil(F.floor("target") / block).cast("long")
    rows = table.select("src", need.alias("need")).filter("need > 0")
    rows = staged(rows.repartitionByRange("src").select(F.spark_partition_id().alias("part"), "*"), "needs")
    total = rows.agg(F.sum("need")).first()[0] or 0
    bits = max(1, (total - 1).bit_length())
    end = F.sum("need").over(W.partitionBy("part").orderBy("src").rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("before")
    ends = rows.join(_before(rows, F.sum("need")), "part").withColumn("end", end)
    # an interval has a source's share of the 2^bits points, never fewer than it needs
    edge = lambda c: F.expr(f"cast({c} AS decimal(19,0)) * cast({1 << bits} AS decimal(19,0)) div cast({max(total, 1)} AS decimal(19,0))")
    shares = ends.select("src", "need", edge("(end - need)").alias("lo"), edge("end").alias("hi"))
    chunks = shares.withColumn("chunk", F.explode(F.expr(f"sequence(lo div {CHUNK}, (hi - 1) div {CHUNK})")))
    # a row becomes CHUNK points: the number of tasks goes by the points, not by the bytes of these rows
    chunks = chunks.repartition(min(MOST_TASKS, 1 + (1 << bits) // (16 * CHUNK)), "chunk")
    points = chunks.withColumn("point", F.explode(F.expr(f"sequence(greatest(lo, chunk * {CHUNK}), least(hi, (chunk + 1) * {CHUNK}) - 1)")))
    ranked = points.withColumn("slot", reverse_bits(F.col("point"), bits)).withColumn("block", F.expr(rank_before(bits)))
    return ranked.filter("block < need").select("slot", "src", "block")


def pieces(rows: DataFrame, passes: int, block: int = BLOCK) -> DataFrame:
    """(row, src, pass, block, start, length): stretches of documents in the blocks of their source's stream.

    rows: (row, id, size, src, source_size, target).
    """
    n = rows.count()
    width = 1
    while width < MAX_RANGES and n * passes > width * RANGE_ROWS:
        width *= 16
    quota = F.floor("target").cast("long")
    every = rows.filter("size > 0").select("row", "id", "size", "src", "source_size", quota.alias("quota"), F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
    every = every.filter(F.col("pass") * F.col("source_size") < F.col("quota"))
    key = F.md5(F.concat(F.col("pass").cast("string"), F.lit(":"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    at = F.conv(F.substring("key", 1, 4), 16, 10).cast("long")
    every = staged(every.withColumn("key", key).withColumn("range", F.expr("0L") if width == 1 else F.floor(at * width / F.lit(1 << 16)).cast("long")), "streams")
    held = every.groupBy("src", "pass", "range").agg(F.sum("size").alias("words"))
    run = W.partitionBy("src", "pass").orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)  # MAX_RANGES rows at most
    held = held.select("src", "pass", "range", (F.sum("words").over(run) - F.col("words")).alias("before"))
    inside = W.partitionBy("src", "pass", "range").orderBy("key", "size", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = every.join(held, ["src", "pass", "range"]).withColumn("own", F.sum("size").over(inside) - F.col("size"))
    first = F.col("pass") * F.col("source_size") + F.col("before") + F.col("own")
    placed = placed.withColumn("first", first).filter("first < quota").withColumn("end", F.least(F.col("first") + F.col("size"), F.col("quota")))
    cut = placed.withColumn("block", F.explode(F.expr(f"sequence(first div {block}, (end - 1) div {block})")))
    start, stop = F.greatest("first", F.col("block") * block), F.least("end", (F.col("block") + 1) * block)
    return cut.select("row", "src", "pass", "block", (start - F.col("first")).alias("start"), (stop - start).alias("length"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK):
    """(documents, schedule).

    documents: (row, id, size, source_size, target, taken), one row for each row of df; schedule: (slot, src, block, row,
    pass, start, length), the words of each document that stand in each slot; slots are gapless but for the last few.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    rows = staged(df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")), "mix-rows")
    table = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    rows = looked_up(rows, table, "source").select("row", "id", "size", "src", "source_size", "target")
    schedule = staged(slots(table, block).hint("merge").join(pieces(rows, int(most), block), ["src", "block"]), "schedule")
    taken = schedule.groupBy("row").agg(F.sum("length").alias("taken"))
    found = rows.join(taken, "row", "left").select("row", "id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    return found, schedule


def query(spark, sf_dir):
    return mix(documents(spark, sf_dir))[0].select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM s) AS goal FROM s),
r AS (
  SELECT *, goal - coalesce(sum(cap) OVER (ORDER BY cap / w RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS rest,
         sum(w) OVER (ORDER BY cap / w RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM c),
level AS (SELECT min_by(rest, cap / w) AS rest, min_by(open, cap / w) AS open FROM r WHERE cap >= w * rest / open),
t AS (
  SELECT source, source_size, CASE WHEN cap < w * level.rest / level.open THEN cap ELSE w * level.rest / level.open END AS target
  FROM c, level),
p AS (
  SELECT d.doc_id, size, source_size, target, floor(target)::BIGINT AS quota,
         (sum(size) OVER (PARTITION BY d.source ORDER BY md5('0:' || coalesce(doc_id::VARCHAR, '')), size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS a,
         (source_size + sum(size) OVER (PARTITION BY d.source ORDER BY md5('1:' || coalesce(doc_id::VARCHAR, '')), size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(a + size, quota) - a) + greatest(0, least(b + size, quota) - b))::BIGINT AS taken
FROM p
"""
