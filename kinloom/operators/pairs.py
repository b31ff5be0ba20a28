"""All pairs of samples within blocks.

A sample's genotypes are packed into bit planes: one long for each 64 loci says which loci are typed, and a few more
hold the allele numbers.  A pair's counts are then a handful of word operations inside whole-stage code generation;
what is shuffled is one short row for each sample, and the pairs of a block come from an equi-join on the block with
`ord` in ascending order.  Sums of table values over the loci are matrix products of tiles of a block instead.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructType

from kinloom.functions.genotype import allele
from kinloom.sources.staging import staged


def locus_index(panel: DataFrame) -> list:
    """Loci of a panel in order; a panel has few."""
    return sorted(r[0] for r in panel.select("locus").distinct().collect())


def _indexed(panel: DataFrame, loci: list) -> DataFrame:
    table = panel.sparkSession.createDataFrame([(x, k) for k, x in enumerate(loci)], panel.select("locus").schema.add("lidx", IntegerType()))
    return panel.join(F.broadcast(table), "locus")  # Spark does not know that a table made here is small


def bit_planes(panel: DataFrame):
    """(DataFrame (grp, sample, ord, t_w, a_w_j, b_w_j), words, planes, loci in the order of the bits)."""
    seen = staged(panel.select("locus", "gt").distinct(), "genotypes")  # a row a genotype of a locus
    loci = locus_index(seen)
    names = sorted({r[0] for r in seen.filter(F.col("gt").isNotNull()).select(F.explode(F.array(allele(F.col("gt"), 1), allele(F.col("gt"), 2)))).distinct().collect()})
    words, planes = max(1, -(-len(loci) // 64)), max(1, (len(names) - 1).bit_length())
    code = panel.sparkSession.createDataFrame([(x, k) for k, x in enumerate(names)] or [("", 0)], "allele string, k int")
    c1, c2 = (F.broadcast(code.withColumnsRenamed({"allele": f"x{k}", "k": f"k{k}"})) for k in (1, 2))
    rows = _indexed(panel, loci).withColumns({"x1": allele(F.col("gt"), 1), "x2": allele(F.col("gt"), 2)}).join(c1, "x1", "left").join(c2, "x2", "left")
    out = []
    for w in range(words):
        own = f"gt is not null and lidx div 64 = {w}"
        out.append(F.expr(f"bit_or(if({own}, shiftleft(1L, lidx % 64), 0L))").alias(f"t_{w}"))
        for j in range(planes):
            for side, k in (("a", "k1"), ("b", "k2")):
                out.append(F.expr(f"bit_or(if({own} and shiftright({k}, {j}) % 2 = 1, shiftleft(1L, lidx % 64), 0L))").alias(f"{side}_{w}_{j}"))
    return staged(rows.groupBy("grp", "sample", "ord").agg(*out), "bits"), words, planes, loci  # both sides of a pair read it


def joined(samples: DataFrame) -> DataFrame:
    """Unordered pairs within blocks, as columns of x and y, x before y in row order."""
    x, y = samples.alias("x"), samples.alias("y")
    return x.join(y, (F.col("x.grp") == F.col("y.grp")) & (F.col("x.ord") < F.col("y.ord")))


def _ids():
    return [F.col("x.grp").alias("grp"), F.col("x.ord").alias("ord1"), F.col("y.ord").alias("ord2"), F.col("x.sample").alias("id1"), F.col("y.sample").alias("id2")]


def pair_stats(panel: DataFrame) -> DataFrame:
    """(grp, ord1, ord2, id1, id2, n_compared, n_mismatch, n_mismatch_2allele), pairs without a common locus included."""
    return pair_masks(panel)[0].drop("common")


def pair_masks(panel: DataFrame) -> tuple[DataFrame, list]:
    """(pair_stats with `common`, an array of longs whose bits are the loci typed in both samples, the loci in order)."""
    bits, words, planes, loci = bit_planes(panel)

    def differ(w, p, q):
        return "(" + " | ".join(f"(x.{p}_{w}_{j} ^ y.{q}_{w}_{j})" for j in range(planes)) + ")"

    both = [f"(x.t_{w} & y.t_{w})" for w in range(words)]
    some = [f"bit_count({b} & ({differ(w, 'a', 'a')} | {differ(w, 'b', 'b')}))" for w, b in enumerate(both)]
    none = [f"bit_count({b} & {differ(w, 'a', 'a')} & {differ(w, 'b', 'b')} & {differ(w, 'a', 'b')} & {differ(w, 'b', 'a')})" for w, b in enumerate(both)]
    total = lambda parts: F.expr(" + ".join(parts)).cast("int")
    found = joined(bits).select(
        *_ids(), total([f"bit_count({b})" for b in both]).alias("n_compared"), total(some).alias("n_mismatch"), total(none).alias("n_mismatch_2allele"), F.expr(f"array({', '.join(both)})").alias("common")
    )
    return found, loci


def slot_distances(panel: DataFrame) -> DataFrame:
    """(grp, ord1, ord2, id1, id2, d): allele slots that differ, a slot typed in one sample only counting half.

    With both alleles of a genotype in order, d is the loci typed in x, plus those typed in y, less the slots that agree.
    """
    bits, words, planes, _ = bit_planes(panel)

    def agree(w, side):
        return f"bit_count(x.t_{w} & y.t_{w} & ~(" + " | ".join(f"(x.{side}_{w}_{j} ^ y.{side}_{w}_{j})" for j in range(planes)) + "))"

    parts = [f"bit_count(x.t_{w}) + bit_count(y.t_{w}) - {agree(w, 'a')} - {agree(w, 'b')}" for w in range(words)]
    return joined(bits).select(*_ids(), F.expr(" + ".join(parts)).cast("int").alias("d"))


#: Samples of a block that are compared with so many others in one task, about.
TILE = 512


def in_tiles(samples: DataFrame, fn, schema: str, arrays: list[str], shared: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """Rows of fn(x, y, within, shared) for all pairs of tiles of each block; x and y are dictionaries of columns.
    whole: fn(x, y, within, shared, grp) gives the table itself, of columns (grp, schema).

    A block is cut into tiles by a hash of its samples; two tiles meet in one task, so a large block spreads over many
    tasks, and no task holds more than two tiles.  samples: (grp, sample, ord, arrays...); shared: (grp, table), an
    array of doubles that every pair of tiles of the block needs.
    """
    kind = samples.schema["sample"].dataType
    sizes = samples.groupBy("grp").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    spread = samples.join(sizes, "grp").withColumn("tile", F.pmod(F.xxhash64("ord"), F.col("tiles")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    i, j = F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j")
    rows = spread.select("grp", i, j, (F.col("tile") > F.col("other")).cast("int").alias("side"), "sample", "ord", *arrays, F.lit(None).cast("array<double>").alias("table"))
    if shared is not None:
        pairs = shared.join(sizes, "grp").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("j", F.explode(F.sequence(F.col("i"), F.col("tiles") - 1)))
        empty = [F.lit(None).cast(samples.schema[a].dataType).alias(a) for a in arrays]
        rows = rows.unionByName(pairs.select("grp", "i", "j", F.lit(-1).alias("side"), F.lit(0).cast(kind).alias("sample"), F.lit(0).cast("long").alias("ord"), *empty, "table"))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = table.column("side").to_numpy()
        held = [table.filter(pa.array(own == k)).sort_by("ord") for k in (0, 1)]
        cells = np.empty(0)
        if (own < 0).any():
            cells = table.filter(pa.array(own < 0)).column("table").combine_chunks().values.to_numpy()
        within = key[1].as_py() == key[2].as_py()
        x, y = held[0], held[0] if within else held[1]
        if whole:
            return fn(x, y, within, cells, key[0]).cast(out)
        columns, first, second, swap = fn(x, y, within, cells)
        if not len(first):
            return out.empty_table()
        low, high = [(x if k == 0 else y) for k in (0, 1)]
        ids = [low.column(c).combine_chunks().take(pa.array(first)) for c in ("ord", "sample")], [high.column(c).combine_chunks().take(pa.array(second)) for c in ("ord", "sample")]
        (o1, s1), (o2, s2) = ids
        if swap is not None:
            m = pa.array(swap)
            o1, o2, s1, s2 = pc.if_else(m, o2, o1), pc.if_else(m, o1, o2), pc.if_else(m, s2, s1), pc.if_else(m, s1, s2)
        grp = pa.repeat(key[0], len(first)).cast(out.field("grp").type)
        return pa.table([grp, o1, o2, s1, s2, *columns], schema=out)

    of = samples.schema
    full = f"grp {of['grp'].dataType.simpleString()}, " + (schema if whole else f"ord1 long, ord2 long, id1 {kind.simpleString()}, id2 {kind.simpleString()}, {schema}")
    out = to_arrow_schema(StructType.fromDDL(full))
    return rows.groupBy("grp", "i", "j").applyInArrow(run, full)


def chosen_pairs(x, y, within: bool):
    """(rows of x, rows of y, whether the one of y comes first) of the pairs of two tiles, both sorted by ord."""
    if within:
        first, second = np.triu_indices(len(x), 1)
        return first, second, None
    first, second = np.divmod(np.arange(len(x) * len(y)), max(1, len(y)))
    return first, second, x.column("ord").to_numpy()[first] > y.column("ord").to_numpy()[second]


def arranged(upper: np.ndarray, lower: np.ndarray | None, first, second, swap) -> pa.Array:
    """Values of the chosen pairs; lower: the same with y before x, where that may differ."""
    v = upper[first, second]
    return pa.array(v if swap is None or lower is None else np.where(swap, lower[first, second], v))


def matrix(table, column: str, width: int, dtype) -> np.ndarray:
    values = table.column(column).combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, width)


def code_arrays(encoded: DataFrame, loci: list) -> DataFrame:
    """(grp, sample, ord, codes): genotype numbers in the order of loci, 0 when missing."""
    rows = _indexed(encoded, loci)
    return rows.groupBy("grp", "sample", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("lidx", "code"))), lambda x: x["code"]).alias("codes"))


def lookup_arrays(tables: DataFrame, loci: list, names: list[str]) -> DataFrame:
    """(grp, table): the lookup tables (grp, locus, g1, g2, name...) as one array a block, as wide as the block's longest
    dictionary.

    Entry ((k * loci + l) * width + g1) * width + g2 holds the value of name k; rows and columns 0 (missing) are zero.
    """
    n = len(loci)
    widths = tables.groupBy("grp").agg((F.max("g1") + 1).alias("width"))
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(name).alias("v")) for k, name in enumerate(names)]))
    rows = _indexed(tables, loci).select("grp", "lidx", "g1", "g2", cells.alias("c")).join(widths, "grp")
    at = ((F.col("c.k") * n + F.col("lidx")) * F.col("width") + F.col("g1")) * F.col("width") + F.col("g2")
    grid = widths.select("grp", F.explode(F.sequence(F.lit(0), F.lit(len(names) * n) * F.col("width") * F.col("width") - 1)).alias("at"))
    full = grid.join(rows.select("grp", at.alias("at"), "c.v"), ["grp", "at"], "left").select("grp", "at", F.coalesce("v", F.lit(0.0)).alias("v"))
    arrays = full.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("rows"))
    return arrays.select("grp", F.transform("rows", lambda r: r["v"]).alias("table"))


def lookup_sums(panel_encoded: DataFrame, tables: DataFrame, names: list[str]) -> DataFrame:
    """(grp, ord1, ord2, id1, id2, n_compared, name...): sums of table values over the loci typed in both samples.

    Two tiles are one matrix product a table: the table's rows for the genotypes of one tile, side by side over the
    loci, times the genotypes of the other as zeros and ones.
    """
    loci = locus_index(panel_encoded)
    n = len(loci)
    tables = lookup_arrays(staged(tables, "tables"), loci, names)

    def sums(x, y, within, cells):
        first, second, swap = chosen_pairs(x, y, within)
        if not len(first):
            return [], first, second, swap
        a, b = matrix(x, "codes", n, "int64"), matrix(y, "codes", n, "int64")
        width = max(1, math.isqrt(len(cells) // (len(names) * n)))
        cells = cells if len(cells) else np.zeros(len(names) * n)  # a block without a genotype
        where = np.arange(n) * width

        def ones(codes):
            out = np.zeros((len(codes), n * width))
            np.put_along_axis(out, where + codes, 1.0, axis=1)
            return out

        has_a, has_b = ones(a), ones(b)
        both = (a > 0).astype("float64") @ (b > 0).astype("float64").T
        columns = [pa.array(both[first, second].astype("int32"))]
        for t in cells.reshape(len(names), n, width, width):
            upper = t[np.arange(n), a].reshape(len(a), -1) @ has_b.T
            lower = None if within else (t[np.arange(n), b].reshape(len(b), -1) @ has_a.T).T
            columns.append(arranged(upper, lower, first, second, swap))
        return columns, first, second, swap

    schema = "n_compared int, " + ", ".join(f"{x} double" for x in names)
    return in_tiles(code_arrays(panel_encoded, loci), sums, schema, ["codes"], tables)
