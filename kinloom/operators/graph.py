"""Match graphs: connected components, cliques, cluster names, conflicts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from kinloom.sources.staging import staged


#: A hub has more than this share of all edge ends, so there are fewer hubs than one over it; small graphs need none.
HUB_SHARE, HUB_EDGES = 1 / 2000, 5_000_000


def _with_least(e: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """e (u, ...) with the m of least (u, m, n) of its u; ends: about as many as the rows of e."""
    if ends < HUB_EDGES:
        return e.join(least.drop("n"), "u")
    hubs = F.broadcast(least.filter(F.col("n") > ends * HUB_SHARE).select("u", F.col("m").alias("hub_m")))
    marked = e.join(hubs, "u", "left")
    rest = marked.filter("hub_m is null").drop("hub_m").join(least.drop("n"), "u")
    return marked.filter("hub_m is not null").withColumnRenamed("hub_m", "m").unionByName(rest)


#: Edges that a task holds at once while it looks for a forest of them.
FOREST_EDGES = 1 << 19


def _stars(u: list, v: list) -> tuple[np.ndarray, np.ndarray]:
    """Places (node, centre) of a forest of the edges (u, v), as stars around the least node of each component; u and v
    are lists of columns that make up a node, and a place counts through u, then v."""
    code = np.zeros(2 * len(u[0]), dtype="int64")
    for a, b in zip(u, v):
        values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        code = code * len(values) + at
    nodes, where, at = np.unique(code, return_index=True, return_inverse=True)
    a, b = np.split(at, 2)
    least = np.arange(len(nodes))
    while len(a):
        x, y = least[a], least[b]
        low = np.minimum(x, y)
        np.minimum.at(least, x, low)
        np.minimum.at(least, y, low)
        while (least[least] != least).any():
            least = least[least]
        open_ = least[a] != least[b]
        a, b = a[open_], b[open_]
    moved = np.flatnonzero(least != np.arange(len(nodes)))
    return where[moved], where[least[moved]]


def forest(edges: DataFrame) -> DataFrame:
    """Edges (u, v), v < u, fewer than nodes in each portion of a task's edges, that connect what edges connects and hold
    each node that has an edge to another.

    Pairs of a block come out of one task, so most edges of a large cluster never reach a shuffle; a task holds at most
    FOREST_EDGES and a batch.
    """
    schema = edges.select("u", "v").schema

    def contracted(table):
        u, v = (table.column(k).combine_chunks() for k in (0, 1))
        parts = [[c.to_numpy(zero_copy_only=False) for c in (x.flatten() if pa.types.is_struct(x.type) else [x])] for x in (u, v)]
        node, centre = _stars(*parts)
        ends = pa.chunked_array([u, v])
        return pa.table([ends.take(pa.array(node)), ends.take(pa.array(centre))], names=["u", "v"])

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(pa.table(b.columns, names=["u", "v"]))
            n += len(b)
            if n >= FOREST_EDGES:
                one = contracted(pa.concat_tables(held))
                held, n = ([one], len(one)) if len(one) < n // 2 else ([], 0)
                if not held:
                    yield from one.to_batches()
        if n:
            yield from contracted(pa.concat_tables(held)).to_batches()

    return edges.select("u", "v").filter("u != v").mapInArrow(run, schema)


def linked(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for each node of edges (u, v): component is the smallest node reachable.

    Each task first reduces its edges to a forest.  What is left is contracted towards the smallest neighbour, large stars and small stars in turn; each step groups by a
    node with partial sums, so a node with very many neighbours is no hot group.  Edges of such nodes get their least
    neighbour from a broadcast table, which has a bound (see HUB_SHARE), those of all others by a shuffle.  Every round
    is written to the shared folder, so lineage does not grow; rounds grow with the logarithm of the longest path.
    """

    def mark(e):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = staged(forest(edges).distinct(), "edges")
    seen = mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both, least, 2 * seen[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, down, seen[0]).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        e = staged(small.filter("u != v").distinct(), "edges")
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(found.select("component").distinct().select(F.col("component").alias("node"), "component"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) for each node of nodes (node); ends of edges (u, v) that are no node do not count."""
    few = staged(forest(edges), "forest")  # it holds every end, so it tells whether all of them are nodes
    if few.select(F.explode(F.array("u", "v")).alias("node")).join(nodes, "node", "left_anti").head(1):
        few = edges.join(nodes.select(F.col("node").alias("u")), "u", "left_semi").join(nodes.select(F.col("node").alias("v")), "v", "left_semi")
    return nodes.join(linked(few), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def samples_of(panel: DataFrame) -> DataFrame:
    return panel.select("grp", "sample", "ord").distinct()


def named(clusters: DataFrame) -> DataFrame:
    """(grp, sample, ord, cluster) to (grp, sample, ord, individual): numbers by first appearance, grp_IND_001."""
    first = clusters.groupBy("grp", "cluster").agg(F.min("ord").alias("first"))
    number = first.withColumn("n", F.row_number().over(W.partitionBy("grp").orderBy("first")))
    label = F.format_string("%s_IND_%03d", F.col("grp").cast("string"), F.col("n"))
    return clusters.join(number.select("grp", "cluster", label.alias("individual")), ["grp", "cluster"]).select("grp", "sample", "ord", "individual")


def single_linkage(samples: DataFrame, matched: DataFrame) -> DataFrame:
    """(grp, sample, ord, individual); matched: (grp, ord1, ord2) pairs.  Samples without a match stay alone."""
    found = components(samples.select(F.col("ord").alias("node")), matched.select(F.col("ord1").alias("u"), F.col("ord2").alias("v")))
    return named(samples.join(found.withColumnsRenamed({"node": "ord", "component": "cluster"}), "ord"))


#: Cliques listed for one vertex and its later neighbours at most; a graph with more is no match graph, and the job says so.
MOST_CLIQUES = 1_000_000


def maximal_cliques(order: list, neighbours: dict, most: int = MOST_CLIQUES, start: tuple = (), done: list = (), prune: bool = False) -> list[list]:
    """All maximal cliques that hold `start` and else vertices of order, none of `done`; each in the order given.

    Each step branches on the vertices outside the neighbourhood of a pivot with most of them.  prune: leaves out cliques
    that are smaller than one already found for each of their members.
    """
    found, place, held = [], {v: k for k, v in enumerate([*start, *order])}, {}
    stack = [(list(start), list(order), list(done))]
    while stack:
        chosen, open_, shut = stack.pop()
        if not open_:
            if not shut:
                found.append(sorted(chosen, key=place.get))
                if len(found) > most:
                    raise ValueError(f"a sample with {len(order)} others around it has over {most} maximal cliques: use single linkage or a stricter rule")
                for v in chosen:
                    held[v] = max(held.get(v, 0), len(chosen))
            continue
        if prune and all(held.get(v, 0) > len(chosen) + len(open_) for v in chosen + open_):
            continue
        pivot = max(open_ + shut, key=lambda v: len(neighbours[v].intersection(open_)))
        branches, left, closed = [], list(open_), list(shut)
        for v in [v for v in open_ if v not in neighbours[pivot]]:
            near = neighbours[v]
            branches.append((chosen + [v], [x for x in left if x in near], [x for x in closed if x in near]))
            left.remove(v)
            closed.append(v)
        stack += reversed(branches)
    return found


def clique_claims(edges: DataFrame) -> DataFrame:
    """(key, node, clique) of the ends of edges (key, u, v): the first maximal clique that holds the node, the larger
    first, of equal ones that with the smaller members.

    Cliques that take what is free, largest first, give each vertex to the first clique that holds it, so the claim is
    one aggregation.  Vertices are ordered by degree; the cliques whose first vertex is v lie among v and its neighbours,
    and the edges between later neighbours, or an earlier and a later one, come from triangles.  A task lists the
    cliques of one vertex at a time: it never holds a component.  The vertices after v are at most the square root of
    twice the number of edges.
    """
    e = staged(edges.select("key", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u != v").distinct(), "clique-edges")
    degree = e.select("key", F.explode(F.array("u", "v")).alias("node")).groupBy("key", "node").agg(F.count("*").alias("degree"))
    of = lambda c: degree.select("key", F.col("node").alias(c), F.struct("degree", "node").alias(f"at_{c}"))
    placed = e.join(of("u"), ["key", "u"]).join(of("v"), ["key", "v"])
    placed = staged(placed.select("key", F.least("at_u", "at_v").alias("a"), F.greatest("at_u", "at_v").alias("b")), "clique-placed")
    wedge = placed.join(placed.withColumnRenamed("b", "c"), ["key", "a"]).filter("b < c")
    triangle = wedge.join(placed.select("key", F.col("a").alias("b"), F.col("b").alias("c")), ["key", "b", "c"])
    later, edge = F.lit("later"), F.lit("edge")
    none = F.lit(None).cast("long")
    row = lambda kind, x, y=none: F.struct(kind.alias("kind"), x.alias("x"), y.alias("y"))
    a, b, c = (F.col(f"{x}.node") for x in "abc")
    rows = placed.select("key", F.explode(F.array(F.struct(a.alias("first"), row(later, b).alias("r")), F.struct(b.alias("first"), row(F.lit("earlier"), a).alias("r")))).alias("s"))
    rows = rows.unionByName(triangle.select("key", F.explode(F.array(F.struct(a.alias("first"), row(edge, b, c).alias("r")), F.struct(b.alias("first"), row(edge, a, c).alias("r")))).alias("s")))
    around = rows.select("key", "s.first", "s.r").groupBy("key", "first").agg(F.collect_list("r").alias("r")).filter(F.exists("r", lambda r: r["kind"] == "later"))
    kind = e.schema["key"].dataType.simpleString()

    def listed(batches):
        for pdf in batches:
            out: dict = {"key": [], "clique": []}
            for key, first, around_ in pdf.itertuples(index=False):
                near: dict = {}
                ends: dict = {"later": [], "earlier": []}
                for r in around_:
                    if r["kind"] == "edge":
                        near.setdefault(r["x"], set()).add(r["y"])
                        near.setdefault(r["y"], set()).add(r["x"])
                    else:
                        ends[r["kind"]].append(r["x"])
                for v in (*ends["later"], *ends["earlier"]):
                    near.setdefault(v, set())
                for clique in maximal_cliques(sorted(ends["later"]), near, start=(first,), done=sorted(ends["earlier"]), prune=True):
                    out["key"].append(key)
                    out["clique"].append(sorted(clique))
            yield pd.DataFrame(out)

    cliques = around.mapInPandas(listed, f"key {kind}, clique array<bigint>")
    best = cliques.select("key", F.explode("clique").alias("node"), F.struct((-F.size("clique")).alias("k"), "clique").alias("c"))
    return best.groupBy("key", "node").agg(F.min("c")["clique"].alias("clique"))


#: A component of so many nodes and edges at most is searched for cliques whole, by one task among many others.
PART_NODES, PART_EDGES = 2048, 1 << 17


def _bits(mask: int):
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def first_cliques(u: list, v: list, most: int = 4 * MOST_CLIQUES) -> list[tuple[int, int]]:
    """(node, least node with the same claim) of the nodes of a graph (u, v): see clique_claims.

    No list of cliques is made: the largest clique is found by branch and bound (a colouring of what is left bounds its
    size), then the first one of that size in the order of the nodes.  Sets of nodes are bits of a number.  The first
    clique of the graph claims its members, each other node has a search among its neighbours.  A search of over `most`
    steps is an error.
    """
    nodes = sorted({*u, *v})
    place = {x: k for k, x in enumerate(nodes)}
    masks = [0] * len(nodes)
    for a, b in zip(u, v):
        masks[place[a]] |= 1 << place[b]
        masks[place[b]] |= 1 << place[a]
    steps = 0

    def step():
        nonlocal steps
        steps += 1
        if steps > most:
            raise ValueError(f"cliques of {len(nodes)} samples took over {most} steps: use single linkage or a stricter rule")

    def certain(open_):
        """Nodes of open_ that all others of it are linked with: every largest clique in it holds them."""
        return sum(1 << x for x in _bits(open_) if not open_ & ~masks[x] & ~(1 << x))

    def coloured(open_):
        """(node, colour from 1) of open_; no clique in the nodes up to one is larger than its colour."""
        out, colour = [], 0
        while open_:
            colour, free = colour + 1, open_
            while free:
                low = free & -free
                x = low.bit_length() - 1
                out.append((x, colour))
                open_ ^= low
                free &= ~(masks[x] | low)
        return out

    def largest(open_, over):
        """The size of the largest clique in open_, or `over` if none is larger."""
        step()
        sure = certain(open_)
        open_, n = open_ & ~sure, sure.bit_count()
        over = max(over, n)
        for x, colour in reversed(coloured(open_)):
            if n + colour <= over:
                break
            over = max(over, n + 1 + largest(open_ & masks[x], over - n - 1))
            open_ ^= 1 << x
        return over

    def first(open_, need):
        """The first clique of so many nodes in open_, none being larger, or None."""
        step()
        sure = certain(open_)
        open_, need = open_ & ~sure, need - sure.bit_count()
        if not need:
            return sure
        for x in _bits(open_):
            if open_.bit_count() < need or coloured(open_)[-1][1] < need:
                return None
            open_ ^= 1 << x
            found = first(open_ & masks[x], need - 1) if need > 1 else 0
            if found is not None:
                return sure | 1 << x | found
        return None

    every = (1 << len(nodes)) - 1
    own = first(every, largest(every, 0))
    claim = dict.fromkeys(_bits(own), own)
    for k in range(len(nodes)):
        if k not in claim:
            steps = 0
            claim[k] = 1 << k | first(masks[k], largest(masks[k], 0))
    least: dict = {}
    for k in range(len(nodes)):
        least.setdefault(claim[k], nodes[k])
    return [(nodes[k], least[claim[k]]) for k in range(len(nodes))]


def part_claims(edges: DataFrame) -> DataFrame:
    """(key, part, node, cluster) of edges (key, part, n, m, u, v), part being a component of n nodes and m edges: cluster
    is the least node that claims the same clique (see clique_claims).

    Components within PART_NODES and PART_EDGES pass their edges to one task each, where far fewer rows move than there
    are triangles; larger ones are listed node by node.
    """
    small = (F.col("n") <= PART_NODES) & (F.col("m") <= PART_EDGES)
    names, of = ["key", "part", "node", "cluster"], edges.schema
    schema = StructType([StructField(x, of[y].dataType) for x, y in zip(names, ("key", "part", "u", "u"))])
    to = to_arrow_schema(schema)

    def listed(batches):
        held = None
        for b in batches:
            rows = pa.table(b.columns, names=b.schema.names)
            rows = rows if held is None else pa.concat_tables([held, rows])
            key, part = (rows.column(c).to_numpy() for c in ("key", "part"))
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1).tolist()]
            for a, z in zip(cuts, cuts[1:]):  # the last component may go on in the next batch
                yield one(rows.slice(a, z - a))
            held = rows.slice(cuts[-1]) if len(rows) else None
        if held is not None:
            yield one(held)

    def one(rows):
        found = first_cliques(rows.column("u").to_pylist(), rows.column("v").to_pylist())
        same = [pa.repeat(rows.column(c)[0], len(found)) for c in ("key", "part")]
        return pa.record_batch([x.cast(f.type) for x, f in zip([*same, *map(pa.array, zip(*found))], to)], schema=to)

    whole = edges.filter(small).select("key", "part", "u", "v").repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(listed, schema)
    large = edges.filter(~small)
    if not large.head(1):
        return whole
    claims = clique_claims(large.select("key", "u", "v"))
    claims = claims.select("key", "node", F.min("node").over(W.partitionBy("key", "clique")).alias("cluster"))  # a window holds a clique
    part = large.select("key", "part", F.explode(F.array("u", "v")).alias("node")).distinct()
    return whole.unionByName(claims.join(part, ["key", "node"]))


def _known(samples: DataFrame, matched: DataFrame, *keys: str) -> DataFrame:
    """(keys..., u, v) of the pairs of two different samples that are in samples, u < v, each once."""
    nodes = samples.select(F.col("ord").alias("u"))
    e = matched.select(*keys, F.least("ord1", "ord2").alias("u"), F.greatest("ord1", "ord2").alias("v")).filter("u != v").distinct()
    return e.join(nodes, "u", "left_semi").join(nodes.toDF("v"), "v", "left_semi").select(*keys, "u", "v")


def complete_linkage(samples: DataFrame, matched: DataFrame) -> DataFrame:
    """As single_linkage, but members of an individual all match each other: cliques by size, each claims what is free
    (of equal ones the one with the smaller members first).

    Pairs of a sample with itself or with one that is not in samples do not count.  A component that is a clique is
    one individual by the number of its edges; only the others, chains of recaptures, are searched for cliques.
    """
    edges = staged(_known(samples, matched), "linkage-edges")
    single = staged(components(samples.select(F.col("ord").alias("node")), edges), "linkage")
    inside = edges.join(single, F.col("u") == F.col("node")).groupBy("component").agg(F.count("*").alias("n_edges"))
    size = single.groupBy("component").agg(F.count("*").alias("n")).join(inside, "component", "left")
    chains = size.filter(F.col("n_edges") * 2 < F.col("n") * (F.col("n") - 1)).withColumnsRenamed({"component": "part", "n_edges": "m"})
    chains = staged(single.join(chains, F.col("component") == F.col("part")).select("node", "part", "n", "m"), "linkage-chains")
    split = part_claims(edges.join(chains.withColumnRenamed("node", "u"), "u").select(F.lit(0).alias("key"), "part", "n", "m", "u", "v")).select("node", "cluster")
    whole = single.join(chains.select("node"), "node", "left_anti").select("node", F.col("component").alias("cluster"))
    return named(samples.join(whole.unionByName(split).withColumnRenamed("node", "ord"), "ord"))


def complete_counts(samples: DataFrame, matched: DataFrame, keys: list) -> DataFrame:
    """(key, n_individuals) of complete linkage for nested settings: the pairs of one hold all pairs of the next, or the
    other way round.

    matched: (key, ord1, ord2); keys: the settings, which may have no pair.  All settings share the rounds of one search
    for components.  Of two settings with a component of the same least sample, size and number of edges, one has no
    other edges than the other, so the component is the same: it is searched for cliques once.
    """
    e = staged(_known(samples, matched, "key"), "setting-edges")
    found = staged(linked(e.select(F.struct("key", F.col("u").alias("ord")).alias("u"), F.struct("key", F.col("v").alias("ord")).alias("v"))), "setting-components")
    found = found.select(F.col("node.key").alias("key"), F.col("node.ord").alias("node"), F.col("component.ord").alias("component"))
    inside = e.join(found.withColumnRenamed("node", "u"), ["key", "u"]).groupBy("key", "component").agg(F.count("*").alias("m"))
    size = staged(found.groupBy("key", "component").agg(F.count("*").alias("n")).join(inside, ["key", "component"]), "setting-sizes")
    once = size.filter("m * 2 < n * (n - 1)").groupBy("component", "n", "m").agg(F.min("key").alias("key"))
    nodes = staged(found.join(once, ["key", "component"]).select("key", F.col("node").alias("u"), F.col("component").alias("part"), "n", "m"), "setting-chains")
    claims = part_claims(e.join(nodes, ["key", "u"]).select("key", "part", "n", "m", "u", "v"))
    parts = claims.groupBy("key", F.col("part").alias("component")).agg(F.count_distinct("cluster").alias("parts"))
    parts = once.join(parts, ["key", "component"]).select("component", "n", "m", "parts")
    merged = size.join(parts, ["component", "n", "m"], "left").groupBy("key").agg(F.sum(F.col("n") - F.coalesce("parts", F.lit(1))).alias("merged"))
    total = samples.agg(F.count("*").alias("total"))  # one row
    every = samples.sparkSession.createDataFrame([(k,) for k in keys], matched.select("key").schema)
    return every.join(merged, "key", "left").join(total).select("key", (F.col("total") - F.coalesce("merged", F.lit(0))).alias("n_individuals"))


def conflicts(assignment: DataFrame, matched: DataFrame) -> DataFrame:
    """(individual, n_samples, n_edges, completeness, members) of clusters of three or more that are no clique."""
    size = assignment.groupBy("individual").agg(F.count("*").alias("n_samples"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("sample").cast("string").alias("s")))), lambda x: x["s"]), ", ").alias("members"))
    a = assignment.select(F.col("ord").alias("ord1"), F.col("individual"))
    b = assignment.select(F.col("ord").alias("ord2"), F.col("individual").alias("individual2"))
    inside = matched.join(a, "ord1").join(b, "ord2").filter("individual = individual2").groupBy("individual").agg(F.count("*").alias("n_edges"))
    full = F.col("n_samples") * (F.col("n_samples") - 1) / 2
    return size.filter("n_samples >= 3").join(inside, "individual").filter(F.col("n_edges") < full).select("individual", "n_samples", "n_edges", (F.col("n_edges") / full).alias("completeness"), "members")


def assignment_summary(assignment: DataFrame, *by: str) -> DataFrame:
    """(by..., counts): how many individuals, how often each was sampled, and sampled again."""
    size = assignment.groupBy(*by, "individual").agg(F.count("*").alias("n"))
    return size.groupBy(*by).agg(
        F.sum("n").alias("n_samples"),
        F.count("*").alias("n_individuals"),
        F.count_if(F.col("n") == 1).alias("n_singletons"),
        F.max("n").alias("max_cluster"),
        (1 - F.count("*") / F.sum("n")).alias("recapture_rate"),
        F.avg("n").alias("mean_samples"),
        F.percentile("n", 0.5).alias("median_samples"),
        F.avg(F.col("n") - 1).alias("mean_recaptures"),
        F.percentile(F.col("n") - 1, 0.5).alias("median_recaptures"),
    )


def cluster_sizes(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("individual").agg(F.count("*").alias("cluster_size")).groupBy("cluster_size").agg(F.count("*").alias("n_individuals"))


def linkage_counts(samples: DataFrame, matched: DataFrame, keys: list) -> DataFrame:
    """(key, n_matched_pairs, n_individuals, max_cluster, n_conflicting) of single linkage for several settings at once.

    matched: (key, ord1, ord2), each pair once; keys: the settings, which may have no pair.  All settings share the
    rounds of one search for components.
    """
    e = matched.select(F.struct("key", F.col("ord1").alias("ord")).alias("u"), F.struct("key", F.col("ord2").alias("ord")).alias("v"))
    e = staged(e, "setting-edges")
    found = staged(linked(e), "setting-components")
    inside = e.join(found, F.col("u") == F.col("node")).groupBy("component").agg(F.count("*").alias("m"))
    size = found.groupBy("component").agg(F.count("*").alias("n")).join(inside, "component")
    broken = (F.col("n") >= 3) & (F.col("m") < F.col("n") * (F.col("n") - 1) / 2)
    per = size.groupBy("component.key").agg(F.sum("m").alias("m"), F.sum(F.col("n") - 1).alias("merged"), F.max("n").alias("top"), F.count_if(broken).alias("broken"))
    return _per_key(samples, per, keys, matched.schema["key"].dataType)


#: Rows that nested_blocks hands on for a block which one task takes at most.
BLOCK_ROWS = 4_000_000


def _portion(by: list[pa.Array], u: np.ndarray, v: np.ndarray, level: np.ndarray):
    """(place of a row with the block, u, v, level, c) of a portion of pairs: first edges (c = 0) that connect at each level what
    the pairs up to it connect, then (u, u, level, c), c pairs of the level that begin at u."""
    block = np.zeros(len(u), dtype="int64")
    for b in by:
        at = b.dictionary_encode().indices.to_numpy()
        block = block * (int(at.max()) + 1) + at
    nodes, inner = np.unique(np.concatenate([u, v]), return_inverse=True)
    code = np.tile(block, 2) * len(nodes) + inner
    keys, where, at = np.unique(code, return_index=True, return_inverse=True)
    a, b = np.split(at, 2)
    name, row = np.concatenate([u, v])[where], where % len(u)
    least, out = np.arange(len(keys)), []
    for k in np.unique(level):
        own = level == k
        was = least.copy()
        x, y = a[own], b[own]
        while len(x):
            p, q = least[x], least[y]
            low = np.minimum(p, q)
            np.minimum.at(least, p, low)
            np.minimum.at(least, q, low)
            while (least[least] != least).any():
                least = least[least]
            open_ = least[x] != least[y]
            x, y = x[open_], y[open_]
        moved = np.flatnonzero((was == np.arange(len(keys))) & (least != was))
        out.append((row[moved], name[moved], name[least[moved]], np.full(len(moved), k), np.zeros(len(moved), dtype="int64")))
    top = int(level.max()) + 1
    starts, c = np.unique(a * top + level, return_counts=True)
    node = starts // top
    out.append((row[node], name[node], name[node], starts % top, c))
    return [np.concatenate(x) for x in zip(*out)]


def nested_blocks(matched: DataFrame, by: tuple[str, ...], levels: int) -> DataFrame:
    """(by..., level, m, merged, top, broken) of single linkage at each level of a block, if it has a pair there: pairs, samples
    less individuals among them, the largest cluster, clusters of three or more that are no clique.

    matched: (by..., level, ord1, ord2), a pair counting at its level and all later ones; pairs join samples of one block.
    A task reduces its pairs to edges that connect as much at every level, and to counts, before any shuffle; no pair is
    written.  A block of at most BLOCK_ROWS such rows is then one task's; larger ones share the rounds of one search.
    """
    schema = StructType([matched.schema[c] for c in by]).add("u", "long").add("v", "long").add("level", "integer").add("c", "long")
    to = to_arrow_schema(schema)

    def reduced(batches):
        held, n = [], 0

        def portion():
            t = pa.table({c: pa.chunked_array([b.column(k) for b in held]) for k, c in enumerate([*by, "level", "u", "v"])}).combine_chunks()
            keys = [t.column(c).combine_chunks() for c in by]
            row, u, v, level, c = _portion(keys, *(t.column(x).to_numpy() for x in ("u", "v", "level")))
            return pa.table([*(k.take(pa.array(row)) for k in keys), u, v, pa.array(level, pa.int32()), c], schema=to).to_batches()

        for b in batches:
            held.append(b)
            n += len(b)
            if n >= FOREST_EDGES:
                yield from portion()
                held, n = [], 0
        if n:
            yield from portion()

    own = matched.filter("ord1 != ord2").select(*by, F.col("level").cast("int").alias("level"), F.col("ord1").cast("long").alias("u"), F.col("ord2").cast("long").alias("v"))
    rows = staged(own.mapInArrow(reduced, schema), "nested")
    told = StructType([matched.schema[c] for c in by]).add("level", "integer").add("m", "long").add("merged", "long").add("top", "long").add("broken", "long")
    out = to_arrow_schema(told)

    def counted(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        u, v, level, c = (t.column(x).to_numpy() for x in ("u", "v", "level", "c"))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = np.split(at, 2)
        least, found = np.arange(len(nodes)), []
        for k in range(levels):
            now = (level == k) & (c == 0)
            x, y = a[now], b[now]
            while len(x):
                p, q = least[x], least[y]
                low = np.minimum(p, q)
                np.minimum.at(least, p, low)
                np.minimum.at(least, q, low)
                while (least[least] != least).any():
                    least = least[least]
                open_ = least[x] != least[y]
                x, y = x[open_], y[open_]
            upto = (level <= k) & (c > 0)
            n, m = np.bincount(least, minlength=len(nodes)), np.bincount(least[a[upto]], c[upto], len(nodes)).astype("int64")
            n, m = n[n > 1], m[n > 1]
            if len(n):
                found.append((k, m.sum(), (n - 1).sum(), n.max(), ((n >= 3) & (m < n * (n - 1) // 2)).sum()))
        columns = [pa.array([int(x) for x in f]) for f in zip(*found)] if found else [pa.array([], pa.int64())] * 5
        return pa.table([*(pa.repeat(k, len(found)) for k in key), *columns], names=out.names).cast(out)

    size = rows.groupBy(*by).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > BLOCK_ROWS)
    if not size.head(1):
        return rows.groupBy(*by).applyInArrow(counted, told)
    large = staged(size.select(*by), "large-blocks")
    small = rows.join(large, list(by), "left_anti").groupBy(*by).applyInArrow(counted, told)
    rest = rows.join(large, list(by), "left_semi").withColumn("level", F.explode(F.sequence("level", F.lit(levels - 1))))
    rest = rest.withColumns({c: F.struct(*by, "level", F.col(c).alias("ord")) for c in ("u", "v")})
    found = staged(linked(rest.filter("c = 0").select("u", "v")), "level-components")
    m = rest.filter("c > 0").groupBy(F.col("u").alias("node")).agg(F.sum("c").alias("c")).join(found, "node").groupBy("component").agg(F.sum("c").alias("m"))
    per = found.groupBy("component").agg(F.count("*").alias("n")).join(m, "component").select("component.*", "n", "m")
    broken = (F.col("n") >= 3) & (F.col("m") < F.col("n") * (F.col("n") - 1) / 2)
    per = per.groupBy(*by, "level").agg(F.sum("m").alias("m"), F.sum(F.col("n") - 1).alias("merged"), F.max("n").alias("top"), F.count_if(broken).alias("broken"))
    return small.unionByName(per)


def _per_key(samples: DataFrame, per: DataFrame, keys: list, key) -> DataFrame:
    """The rows of linkage_counts from (key, m, merged, top, broken), one row a key that has a pair."""
    total = samples.agg(F.count("*").alias("total"))
    every = samples.sparkSession.createDataFrame([(k,) for k in keys], StructType([StructField("key", key)]))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return every.join(per, "key", "left").join(total).select(  # total is one row
        "key", zero("m").alias("n_matched_pairs"), (F.col("total") - zero("merged")).alias("n_individuals"), F.when(F.col("total") > 0, F.coalesce("top", F.lit(1))).alias("max_cluster"), zero("broken").alias("n_conflicting")
    )


def nested_counts(samples: DataFrame, matched: DataFrame, keys: list) -> DataFrame:
    """As linkage_counts for settings of which each holds the pairs of the one before: matched (grp, level, ord1, ord2), a pair
    being in the settings keys[level:]."""
    per = nested_blocks(matched, ("grp",), len(keys)).groupBy("level").agg(F.sum("m").alias("m"), F.sum("merged").alias("merged"), F.max("top").alias("top"), F.sum("broken").alias("broken"))
    kind = DoubleType() if isinstance(keys[0], float) else IntegerType()
    return _per_key(samples, per.withColumn("key", F.element_at(F.array(*[F.lit(k).cast(kind) for k in keys]), F.col("level") + 1)), keys, kind)


def final_table(assignment: DataFrame, panel: DataFrame, power: DataFrame) -> DataFrame:
    """One row a sample with its call rate, power and cluster size; large clusters first, then the best-typed sample."""
    from kinloom.operators.panel import sample_stats

    size = assignment.groupBy("individual").agg(F.count("*").alias("n_samples_for_individual"))
    rows = assignment.join(size, "individual").join(sample_stats(panel).select("ord", "call_rate"), "ord", "left").join(power.select("ord", "log10_pid_sib"), "ord", "left")
    return rows.select("grp", "sample", "ord", "individual", "call_rate", "log10_pid_sib", "n_samples_for_individual").orderBy(F.desc("n_samples_for_individual"), "individual", F.desc("call_rate"), "ord")
