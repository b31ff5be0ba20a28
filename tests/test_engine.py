"""The genotype engine: worked examples, brute force and properties."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from kinloom.functions.genotype import normalise
from kinloom.operators import blocks, compare, confidence, graph, inference, likelihood, matching, pairs, panel, replicates, similarity
from kinloom.plans import fixtures, registry
from kinloom.plans.pipeline import identify, resolve
from kinloom.sources import staging, tables
from kinloom.sources.simulate import simulate, truth_of

SCHEMA = "grp string, sample string, ord long, locus string, gt string"
EXAMPLE = {"A": ["A/G", "C/C", "T/T", "A/A", "G/T", "C/T"], "B": ["A/A", "C/C", "T/T", "A/A", "G/T", None]}


def make(spark, samples, grp="g"):
    return spark.createDataFrame([(grp, s, k, f"L{j}", g) for k, (s, gts) in enumerate(samples.items()) for j, g in enumerate(gts)], SCHEMA)


CASES = [
    ("ga", None, "A/G"), ("A", None, "A/A"), ("00", None, None), ("NN", None, None), ("NA", None, None), ("..", None, None), ("", None, None), (None, None, None),
    ("T/C", None, None), ("AG*", None, "A/G"), ("?", None, None), ("AGT", None, None), ("T/C", "/", "C/T"), ("124/120", "/", "120/124"), ("102/98", "/", "102/98"),
    ("120/", "/", None), ("A/G/", "/", "A/G"), ("A/G/T", "/", None), ("0/0", "/", None), (" a / g ", "/", "A/G"),
]


def test_normalise(spark):
    for sep in (None, "/"):
        own = [(r, w) for r, s, w in CASES if s == sep]
        got = spark.createDataFrame([(k, r) for k, (r, _) in enumerate(own)], "k int, raw string").select("k", normalise(F.col("raw"), sep).alias("gt")).collect()
        assert {r["k"]: r["gt"] for r in got} == {k: w for k, (_, w) in enumerate(own)}


def test_worked_example(spark):
    stats = pairs.pair_stats(make(spark, EXAMPLE)).first()
    assert (stats["n_compared"], stats["n_mismatch"], stats["n_mismatch_2allele"]) == (5, 1, 0)
    df = pairs.pair_stats(make(spark, EXAMPLE))
    assert matching.exact(df).count() == 0 and matching.threshold(df, 1, 0, 5).count() == 1 and matching.near(df, 2).count() == 1


def test_pair_stats_many_alleles(spark):
    """Against brute force, with more than 64 loci and more than two alleles."""
    import random

    rng = random.Random(1)
    gts = lambda: [None if rng.random() < 0.1 else "/".join(sorted(rng.choice(["98", "102", "104", "110", "112"]) for _ in "ab")) for _ in range(70)]
    samples = {f"s{k}": gts() for k in range(8)}
    samples["t"] = [None] * 70
    for r in pairs.pair_stats(make(spark, samples)).collect():
        both = [(a, b) for a, b in zip(samples[r["id1"]], samples[r["id2"]]) if a and b]
        assert r["n_compared"] == len(both) and r["n_mismatch"] == sum(a != b for a, b in both)
        assert r["n_mismatch_2allele"] == sum(not set(a.split("/")) & set(b.split("/")) for a, b in both)


@pytest.fixture(scope="module")
def simulated(spark):
    rows = simulate(spark, individuals=14, loci=70, most_captures=4, groups=2, seed=5)
    rows.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/sim")
    return spark.read.parquet(f"{spark.conf.get('spark.checkpoint.dir')}/sim")


def test_likelihood_properties(spark, simulated):
    own = simulated.select("grp", "sample", "ord", "locus", "gt")
    dic, freq = panel.dictionary(own), panel.allele_freq(own)
    e = likelihood.observation_model(dic, freq, 0.05, 0.02)
    assert all(abs(r["s"] - 1) < 1e-9 for r in e.groupBy("grp", "locus", "t").agg(F.sum("e").alias("s")).collect())
    assert all(abs(r["s"] - 1) < 1e-9 for r in freq.groupBy("grp", "locus").agg(F.sum("p").alias("s")).collect())
    whole = dic.groupBy("grp", "locus").count().filter("count = 3").select("grp", "locus")
    for k in likelihood.KINSHIP.values():
        sums = likelihood.pair_prob(dic, freq, k).join(whole, ["grp", "locus"], "left_semi").groupBy("grp", "locus").agg(F.sum("pp").alias("s"))
        assert all(abs(r["s"] - 1) < 1e-9 for r in sums.collect())
    table = {(r["grp"], r["locus"], r["g1"], r["g2"]): r["lr"] for r in likelihood.lr_table(dic, freq).collect()}
    assert all(math.isclose(v, table[g, l, b, a], abs_tol=1e-9) for (g, l, a, b), v in table.items())


def test_methods_find_the_individuals(spark, simulated):
    own = simulated.select("grp", "sample", "ord", "locus", "gt")
    truth = truth_of(simulated)
    score = {m: compare.adjusted_rand(resolve(own, m).assignment, truth).first()["ari"] for m in ("exact", "threshold", "likelihood_ratio", "best_alternative")}
    assert score["likelihood_ratio"] > 0.9 and score["best_alternative"] > 0.9 and score["exact"] <= score["threshold"] + 1e-9
    assert math.isclose(compare.adjusted_rand(truth, truth).first()["ari"], 1.0)
    found = resolve(own, "likelihood_ratio")
    power = panel.sample_power(own, panel.identity_power(panel.allele_freq(own, ())))
    conf = confidence.sample_confidence(found.assignment, found.pairs.withColumn("score", F.col("posterior")), found.matched, power).collect()
    assert len(conf) == found.assignment.count() and {r["status"] for r in conf} <= set(confidence.STATUS)


def test_replicate_route(spark):
    rows = simulate(spark, individuals=8, loci=20, most_captures=3, reps=3, dropout=0.1, seed=9)
    reps = rows.select("grp", "sample", "ord", "rep", "locus", "gt")
    own = replicates.consensus(reps)
    found = resolve(own, "best_alternative", reps, dropout=0.1, false_allele=0.01).assignment
    assert compare.adjusted_rand(found, truth_of(rows)).first()["ari"] > 0.9
    rates = replicates.ml_error_rates(reps, panel.allele_freq(own, ()))
    assert 0.05 < rates["dropout"] < 0.16 and rates["false_allele"] < 0.03 and rates["dropout_ci"][0] <= rates["dropout"] <= rates["dropout_ci"][1]


def test_consensus_rules(spark):
    calls = {"x": ["A/G", "A/G", "A/A"], "y": ["A/A", "A/A", "A/A"], "z": ["A/A", "A/A", None], "w": ["A/A", "A/G", "G/G"], "v": [None] * 3, "u": ["A/A", "A/G", None]}
    rows = [("g", s, k, r, "L", g) for k, (s, gts) in enumerate(calls.items()) for r, g in enumerate(gts)]
    got = replicates.consensus(spark.createDataFrame(rows, "grp string, sample string, ord long, rep int, locus string, gt string"))
    assert {r["sample"]: r["gt"] for r in got.collect()} == {"x": "A/G", "y": "A/A", "z": None, "w": "A/G", "v": None, "u": None}


def test_residual_error(spark):
    row = replicates.residual_error(spark, 0.0, 0.0, 0.0).first()
    assert (row["dropout"], row["false_allele"], row["missing_het"], row["missing_hom"]) == (0, 0, 0, 0)
    row = replicates.residual_error(spark, 0.1, 0.02, 0.1, rule="unanimous").first()
    assert math.isclose(row["dropout"], 2 * (0.9 * 0.05) ** 3, rel_tol=1e-9)


def test_cliques_and_linkage(spark):
    near = {1: {2, 3}, 2: {1, 3}, 3: {1, 2, 4}, 4: {3}, 5: set()}
    assert sorted(graph.maximal_cliques([1, 2, 3, 4, 5], near)) == [[1, 2, 3], [3, 4], [5]]
    samples = spark.createDataFrame([("g", f"s{k}", k) for k in range(1, 6)], "grp string, sample string, ord long")
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4)], "ord1 long, ord2 long")
    single = {r["ord"]: r["individual"] for r in graph.single_linkage(samples, edges).collect()}
    assert single == {1: "g_IND_001", 2: "g_IND_001", 3: "g_IND_001", 4: "g_IND_001", 5: "g_IND_002"}
    full = {r["ord"]: r["individual"] for r in graph.complete_linkage(samples, edges).collect()}
    assert full == {1: "g_IND_001", 2: "g_IND_001", 3: "g_IND_001", 4: "g_IND_002", 5: "g_IND_003"}
    broken = graph.conflicts(graph.single_linkage(samples, edges), edges).first()
    assert (broken["n_samples"], broken["n_edges"], broken["members"]) == (4, 4, "s1, s2, s3, s4")


def test_components_of_a_path(spark):
    n = 200
    nodes = spark.range(n).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(k, k + 1) for k in range(n - 1) if k != 99], "u long, v long")
    got = {r["node"]: r["component"] for r in graph.components(nodes, edges).collect()}
    assert got == {k: 0 if k < 100 else 100 for k in range(n)}


def test_files_and_inference(spark, tmp_path):
    import random

    rng = random.Random(2)
    lines = ["SampleID,Reads,Species,L1,L2,L3"]
    for k in range(40):
        lines.append(",".join([f"S{k:02d}", str(rng.randrange(10_000)), "ab"[k % 2], *("".join(rng.choice("AG") for _ in "xx") if rng.random() > 0.1 else "00" for _ in "123")]))
    path = tmp_path / "t.csv"
    path.write_text("﻿" + "\n".join(lines))
    raw = tables.read_table(spark, str(path))
    assert raw.columns[0] == "SampleID" and inference.guess_id(raw) == "SampleID" and inference.guess_separator(raw, raw.columns[1:]) is None
    assert inference.detect_loci(raw) == ["L1", "L2", "L3"]
    found = identify(spark, str(path), "exact", group_col="Species", min_loci=2)
    assert found.assignment.count() == 40 and {r[0] for r in found.assignment.select("grp").distinct().collect()} == {"a", "b"}
    tables.write_bundle({"assignment": found.assignment}, found.settings, str(tmp_path / "out.zip"))
    assert (tmp_path / "out.zip").exists() and "identify" in tables.script_text("x.csv", "exact", {"min_loci": 2})


def test_duplicate_ids(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "id string, k long")
    assert sorted(r["id"] for r in tables.suffix_duplicates(df, "id", "k").collect()) == ["a#1", "a#2", "b"]


def test_prior_matches_the_loop(spark, simulated):
    own = simulated.select("grp", "sample", "ord", "locus", "gt")
    rows = matching.lr_pairs(own).select("grp", "lr", "n_compared").collect()
    sizes = {r["grp"]: r["n"] for r in own.groupBy("grp").agg(F.count_distinct("sample").alias("n")).collect()}
    scored = spark.createDataFrame(rows, "grp long, lr double, n_compared int")
    got = {r["grp"]: r["prior"] for r in matching.priors(scored, spark.createDataFrame(list(sizes.items()), "grp long, n long")).collect()}
    for g, n in sizes.items():
        pi, total = 1 / max(n, 2), n * (n - 1) / 2
        for _ in range(25):
            m = sum(r["n_compared"] >= 15 and 1 / (1 + 10 ** -(math.log10(pi / (1 - pi)) + r["lr"])) >= 0.999 for r in rows if r["grp"] == g)
            new = min(0.5, max(1 / max(n, 2), (m + 1) / total))
            if abs(new - pi) < 1e-10:
                break
            pi = new
        assert math.isclose(got[g], pi)


def test_stream(spark, tmp_path, simulated):
    from kinloom.streaming import ingest

    rows = simulated.selectExpr("cast(grp as string) grp", "cast(sample as string) sample", "ord", "cast(locus as string) locus", "replace(coalesce(gt, '00'), '/', '') raw")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    ingest.start(ingest.read_stream(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "check"), "exact").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "store/assignment"))
    assert got.count() == simulated.select("sample").distinct().count()


def test_stream_corrections(spark, tmp_path):
    """A cell that comes again counts as the latest batch has it; only the blocks of a batch are resolved again."""
    from kinloom.streaming import ingest

    def send(name, rows):
        spark.createDataFrame(rows, "grp string, sample string, ord long, locus string, raw string").coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream = ingest.read_stream(spark, str(tmp_path / "in" / "*"))
        ingest.start(stream, str(tmp_path / "store"), str(tmp_path / "check"), "exact", min_loci=2).awaitTermination()
        got = spark.read.schema("sample string, ord long, individual string, grp string").parquet(str(tmp_path / "store/assignment")).collect()
        return {(r["grp"], r["sample"]): r["individual"] for r in got}

    cells = lambda grp, s, k, a, b: [(grp, s, k, "L1", a), (grp, s, k, "L2", b)]
    first = send("one", cells("007", "a", 1, "AA", "GG") + cells("007", "b", 2, "AA", "GT") + cells("8", "c", 3, "AA", "GG") + cells("8", "d", 4, "AA", "GG"))
    assert first[("007", "a")] != first[("007", "b")] and first[("8", "c")] == first[("8", "d")]
    second = send("two", [("007", "b", 2, "L2", "GG")])
    assert second[("007", "a")] == second[("007", "b")] == "007_IND_001" and second[("8", "c")] == first[("8", "c")]


def test_stream_compaction(spark, tmp_path, monkeypatch):
    """The store of a block is written again in one piece and its old folders go; no cell changes."""
    from kinloom.streaming import ingest

    monkeypatch.setattr(ingest, "COMPACT", 2)

    def send(k, rows):
        spark.createDataFrame(rows, "grp string, sample string, ord long, locus string, raw string").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
        ingest.start(ingest.read_stream(spark, str(tmp_path / "in" / "*")), str(tmp_path / "store"), str(tmp_path / "check"), "exact", min_loci=1).awaitTermination()

    send(0, [("x", "a", 1, "L1", "AA"), ("x", "b", 2, "L1", "AG"), (None, "n", 7, "L1", "CC"), (" ", "m", 8, "L1", "CC")])
    send(1, [("x", "b", 2, "L1", "AA"), ("x", "c", 3, "L1", "GG")])
    send(2, [("x", "c", 3, "L1", "AA")])
    send(3, [("x", "d", 4, "L1", "GG")])
    folders = sorted(p.name for p in (tmp_path / "store/panel/grp=x").iterdir())
    assert folders == ["batch=5", "batch=6"]
    kept = ingest._latest(spark.read.schema(ingest.PANEL).parquet(str(tmp_path / "store/panel"))).collect()
    assert {(r["grp"], r["sample"]): r["gt"] for r in kept} == {("x", "a"): "A/A", ("x", "b"): "A/A", ("x", "c"): "A/A", ("x", "d"): "G/G", ("unassigned", "n"): "C/C", ("unassigned", "m"): "C/C"}
    got = spark.read.schema("sample string, ord long, individual string, grp string").parquet(str(tmp_path / "store/assignment")).collect()
    assert {(r["grp"], r["sample"]): r["individual"] for r in got} == {**{("x", s): "x_IND_001" for s in "abc"}, ("x", "d"): "x_IND_002", ("unassigned", "n"): "unassigned_IND_001", ("unassigned", "m"): "unassigned_IND_001"}


def test_inference_rules(spark):
    raw = spark.createDataFrame([("A/", "ACG/TTA", None, "1"), ("A/", "ACG/ACG", None, "1"), ("C/", "TTA/TTA", None, "2"), ("G/T", "ACG/TTA", None, "2d")], "x string, y string, z string, w string")
    share = {r["sep"]: r["share"] for r in inference.separator_shares(raw, ["x"]).collect()}
    assert share["/"] == 0.25  # an empty piece at the end is none
    blank = spark.createDataFrame([(" A",), ("B ",), ("A B",)], "x string")
    assert {r["sep"]: r["share"] for r in inference.separator_shares(blank, ["x"]).collect()}[" "] == pytest.approx(2 / 3)  # blanks are not trimmed
    assert inference.detect_loci(raw.select("y"), "/") == []  # alleles of several letters are no DNA
    many = raw.union(raw).union(raw)
    assert inference.detect_loci(many.selectExpr("if(w = '1', 'A/G', 'A/A') AS m", "if(w = '1', '98/99', '98/98') AS n"), "/") == ["m", "n"]
    score = {r["column"]: r["score"] for r in inference.id_scores(raw, ["x", "z", "w"]).collect()}
    assert score == {"x": 0.75, "z": 0.25, "w": 0.75}  # null is a value and no number; 2d is none
    reps = spark.createDataFrame([("s1", "a", "AG"), ("s1", "b", "AG"), ("s1", "Consensus", "AG"), ("s2", None, "AA")], "id string, pcr_run string, L1 string")
    assert inference.replicate_plan(reps, "id", ["L1"]) == ("pcr_run", ("Consensus",))
    assert inference.replicate_plan(reps.filter("id = 's2'"), "id", ["L1"]) == (None, ())
    assert inference.has_replicates(reps, "id") and inference.guess_replicate_column(["L1", "box"], ["L1"]) == "box"


def test_file_order(spark, tmp_path):
    """Individuals are numbered as they appear in the file, whatever their names, and so are repeated ids."""
    rows = ["SampleID,L1,L2,L3,L4", "z9,AG,AA,GG,AG", "b1,AA,AG,GG,AA", "z9,AA,AG,GG,AA", "a0,AG,AA,GG,AG"] + [f"m{k},AG,AG,AG,{'AG' if k % 2 else 'GG'}" for k in range(8)]
    path = tmp_path / "order.csv"
    path.write_text("\n".join(rows))
    got = {r["sample"]: r["individual"] for r in identify(spark, str(path), "exact", min_loci=4, loci=["L1", "L2", "L3", "L4"], id_col="SampleID").assignment.collect()}
    assert (got["z9#1"], got["b1"], got["z9#2"], got["a0"]) == ("all_IND_001", "all_IND_002", "all_IND_002", "all_IND_001")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40b")
    try:
        order = [r["SampleID"] for r in tables.read_table(spark, str(path), order_col="k").orderBy("k").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert order == [r.split(",")[0] for r in rows[1:]]


def test_replicates_from_a_file(spark, tmp_path):
    rows = ["id,rep,L1,L2"] + [f"{s},{r},{a},{b}" for s, a, b in (("y", "AG", "AA"), ("x", "GG", "AG"), ("w", "AG", "AA")) for r in ("a", "b", "c")] + ["y,consensus,AA,GG", "y,,AG,AA"]
    path = tmp_path / "reps.csv"
    path.write_text("\n".join(rows))
    found = identify(spark, str(path), "exact", id_col="id", loci=["L1", "L2"], replicate_col="auto", min_loci=2)
    assert {r["sample"]: r["individual"] for r in found.assignment.collect()} == {"y": "all_IND_001", "x": "all_IND_002", "w": "all_IND_001"}


def test_consensus_counts_het_n(spark):
    calls = {"x": ["A/A", "A/A", "G/G", "G/G"], "y": ["A/G", "A/G", "A/G", "A/A"], "z": ["A/G", "A/G", "A/A", "A/A"]}
    rows = [("g", s, k, r, "L", g) for k, (s, gts) in enumerate(calls.items()) for r, g in enumerate(gts)]
    reps = spark.createDataFrame(rows, "grp string, sample string, ord long, rep int, locus string, gt string")
    assert {r["sample"]: r["gt"] for r in replicates.consensus(reps, het_n=3).collect()} == {"x": None, "y": "A/G", "z": None}
    assert replicates.residual_error(spark, 0.2, 0.1, 0.0, n_rep=4, het_n=3).first()["missing_het"] > replicates.residual_error(spark, 0.2, 0.1, 0.0, n_rep=4).first()["missing_het"]


def linkage_brute(n, edges):
    """Maximal cliques by size, then by listing; each claims what is free."""
    near = {k: set() for k in range(n)}
    for a, b in edges:
        if a != b and a < n and b < n:
            near[a].add(b)
            near[b].add(a)
    cliques = [c for k in range(n, 0, -1) for c in itertools.combinations(range(n), k) if all(b in near[a] for a, b in itertools.combinations(c, 2))]
    top = [c for c in cliques if not any(set(c) < set(d) for d in cliques)]
    return near, top


def test_complete_linkage_brute(spark):
    """Against all subsets: individuals are cliques, the largest clique of each component is one of them whole."""
    import random

    rng = random.Random(3)
    for _ in range(3):
        n = 9
        edges = [(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.35] + [(2, 2), (3, 77)]
        samples = spark.createDataFrame([("g", f"s{k}", k) for k in range(n)], "grp string, sample string, ord long")
        got = {r["ord"]: r["individual"] for r in graph.complete_linkage(samples, spark.createDataFrame(edges, "ord1 long, ord2 long")).collect()}
        near, top = linkage_brute(n, edges)
        assert set(got) == set(range(n))
        groups = {}
        for k, i in got.items():
            groups.setdefault(i, []).append(k)
        assert all(b in near[a] for g in groups.values() for a, b in itertools.combinations(g, 2))
        assert max(map(len, groups.values())) == max(map(len, top))
        assert all(any(set(g) <= set(c) for c in top) for g in groups.values())
    with pytest.raises(ValueError):
        graph.maximal_cliques(list(range(12)), {k: {x for x in range(12) if x // 2 != k // 2} for k in range(12)}, most=20)


def test_settings_share_their_components(spark):
    samples = spark.createDataFrame([("g", f"s{k}", k) for k in range(8)], "grp string, sample string, ord long")
    edges = [(1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 1, 2), (2, 0, 2), (2, 5, 6)]
    got = {r["key"]: tuple(r)[1:] for r in graph.linkage_counts(samples, spark.createDataFrame(edges, "key int, ord1 long, ord2 long"), [1, 2, 3]).collect()}
    assert got == {1: (2, 6, 3, 1), 2: (4, 5, 3, 0), 3: (0, 8, 1, 0)}


def test_sensitivity_matches_single_runs(spark, simulated):
    own = simulated.select("grp", "sample", "ord", "locus", "gt")
    grid = {"dropouts": (0.05,), "kinships": ("unrelated", "full_sib"), "cuts": (0.99,)}
    got = {(r["kinship"], r["dropout"], r["cutoff"]): r for r in matching.sensitivity(own, dropout=0.02, cut=0.999, grid=grid).collect()}
    assert len(got) == 8 and [k for k, r in got.items() if r["current"]] == [("full_sib", 0.02, 0.999)]
    for key in (("unrelated", 0.05, 0.99), ("full_sib", 0.02, 0.999)):
        alone = resolve(own, "likelihood_ratio", dropout=key[1], kinship=key[0], cut=key[2])
        assert got[key]["n_individuals"] == alone.assignment.select("individual").distinct().count() and got[key]["n_conflicting"] == alone.conflicts.count()


def test_error_estimates(spark):
    rows = simulate(spark, individuals=8, loci=20, most_captures=3, reps=3, dropout=0.1, seed=9)
    reps = rows.select("grp", "sample", "ord", "rep", "locus", "gt")
    own = replicates.consensus(reps)
    found = replicates.applied_error(own, reps)
    assert found["method"] == "replicates" and found["converted"] and found["applied_dropout"] < found["dropout"]
    kept = replicates.applied_error(own, reps, use_reps=True)
    assert not kept["converted"] and kept["use_dropout"] == round(kept["dropout"], 3)
    few = replicates.applied_error(own, reps.filter("rep = 1"))
    assert few["method"] == "heterozygote deficit" and few["use_false_allele"] == max(0.001, round(few["dropout"] / 3, 3))
    two = own.filter(F.col("ord").isin([r[0] for r in own.select("ord").distinct().limit(2).collect()]))
    assert replicates.estimate_error(two)["n_samples"] == 2


def test_comparisons(spark, simulated):
    own = simulated.select("grp", "sample", "ord", "locus", "gt")
    stats = pairs.pair_stats(own)
    _, kind, borrowed = compare.evidence(None, stats)
    assert (kind, borrowed) == ("n_mismatch", True)
    _, kind, borrowed = compare.evidence(matching.lr_pairs(own), stats)
    assert (kind, borrowed) == ("lr", False)
    runs = spark.createDataFrame([(1.0, 0.5), (0.9, 0.7), (0.8, 0.75), (0.6, 0.65), (None, 0.1)], "a double, b double")
    t = compare.paired_t(runs, "a", "b").first()
    assert (t["n"], t["df"]) == (4, 3) and math.isclose(t["t"], 0.175 / (0.2397915 / 2), rel_tol=1e-5)
    for x, df, p in ((2.0, 10, 0.0733880), (0.5, 3, 0.6514376), (12.7062, 1, 0.05), (0.0, 5, 1.0)):
        assert math.isclose(compare.t_chance(x, df), p, rel_tol=1e-4)
    conf = spark.createDataFrame([(0.25,), (1.0,)], "x double").select(confidence.lambda_score(F.log10("x")).alias("s"))
    assert [round(r["s"], 6) for r in conf.collect()] == [0.2, 0.5]
    votes = spark.createDataFrame([("a", "wolf"), ("a", "dog"), ("b", "dog"), ("c", "wolf"), ("c", "coyote")], "sample string, vote string")
    assert {r["sample"]: r["call"] for r in compare.majority(votes, ["wolf", "coyote"]).collect()} == {"a": "wolf", "b": "unknown", "c": "coyote"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a, b"), (2, None)], "k long, t string")
    tables.write_csv(df, str(tmp_path / "csv"), single=True)
    tables.write_parquet({"one": df}, str(tmp_path / "all"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2 and spark.read.parquet(str(tmp_path / "all/one")).count() == 2
    import zipfile

    path = tables.write_bundle({"one": df}, {"min_loci": 3}, str(tmp_path / "out.zip"))
    with zipfile.ZipFile(path) as z:
        assert z.read("one.csv").decode().splitlines() == ["k,t", '1,"a, b"', "2,"] and "min_loci" in z.read("settings.txt").decode()


def test_experiment(spark):
    from kinloom.plans.experiment import closer, experiment

    table = experiment(spark, loci=(20,), dropouts=(0.1,), runs=2, individuals=6)
    rows = table.collect()
    assert len(rows) == 2 and all(r["truth_n"] == 6 and r["reps_ari"] >= r["cons_ari"] - 0.3 and r["reps_loci"] >= r["cons_loci"] for r in rows)
    assert sum(closer(table).first()) == 2
    means = compare.mean_by(table, ("n_loci", "dropout"), ("cons_ari", "reps_ari")).first()
    assert math.isclose(means["reps_ari"], sum(r["reps_ari"] for r in rows) / 2)


def test_labels(spark):
    from kinloom.functions.labels import relabelled

    df = spark.createDataFrame([(1, "full_sib", 0.5, None), (2, "other", 0.1, "x")], "ord int, kinship string, margin double, Margin string")
    with pytest.raises(Exception):
        relabelled(df).collect()  # a name that Spark cannot tell from another
    got = relabelled(df.toDF("ord", "kinship", "margin", "extra"))
    assert got.columns == ["kinship", "Margin", "extra"] and [r["kinship"] for r in got.collect()] == ["Full siblings", "other"]
    assert got.schema["Margin"].metadata["comment"].startswith("Support less")


def test_example_settings(spark, tmp_path):
    """The example's settings reach the run: its species column groups, its rates are used, and settings may differ."""
    from kinloom.plans.pipeline import EXAMPLE, example

    rng, lines = random.Random(8), ["SampleID,TrueSpecies," + ",".join(f"LOC{k:02d}" for k in range(1, 31))]
    for who in range(8):
        own = ["".join(rng.choice("AG") for _ in "ab") for _ in range(30)]
        lines += [",".join([f"S{who}{c}", "alpha" if who < 5 else "beta", *own]) for c in "xy"]
    path = tmp_path / "panel.csv"
    path.write_text("\n".join(lines) + "\n")
    found = example(spark, str(path), "exact")
    assert {k: found.settings[k] for k in ("dropout", "false_allele", "min_loci")} == {k: v for k, v in EXAMPLE.items() if k != "group_col"}
    names = [r["individual"] for r in found.assignment.orderBy("ord").collect()]
    assert names == [f"{'alpha' if w < 5 else 'beta'}_IND_{(w if w < 5 else w - 5) + 1:03d}" for w in range(8) for _ in "xy"]


def test_disputed(spark):
    a = spark.createDataFrame([("g", k, k, i) for k, i in enumerate("xxyyz")], "grp string, sample long, ord long, individual string")
    b = spark.createDataFrame([("g", k, k, i) for k, i in enumerate("ppqrs")], "grp string, sample long, ord long, individual string")
    assert sorted(r["sample"] for r in compare.disputed({"a": a, "b": b}).collect()) == [2, 3]
    brute = list(itertools.combinations(range(5), 2))
    assert brute


def random_graph(rng, n, p):
    return [(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < p]


def test_cliques_over_tasks(spark):
    """Claims of many graphs at once against all subsets: largest first, of equal ones the one with the smaller members."""
    rng, rows, want = random.Random(1), [], {}
    for key in range(24):
        n = rng.randrange(3, 10)
        edges = random_graph(rng, n, rng.choice([0.2, 0.5, 0.85]))
        rows += [(key, b, a) if rng.random() < 0.5 else (key, a, b) for a, b in edges]
        near, top = linkage_brute(n, edges)
        for c in sorted(top, key=lambda c: (-len(c), c)):
            for v in c:
                want.setdefault((key, v), list(c))
        want = {k: c for k, c in want.items() if k[0] != key or near[k[1]]}
    got = {(r["key"], r["node"]): r["clique"] for r in graph.clique_claims(spark.createDataFrame(rows + rows[:5], "key int, u long, v long")).collect()}
    assert got == want


def test_cliques_of_one_vertex_only(spark):
    """A component of 400 vertices around a hub: no task is given more than a vertex and its neighbourhood."""
    edges = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1, 399, 3)]
    samples = spark.createDataFrame([("g", f"s{k}", k) for k in range(400)], "grp string, sample string, ord long")
    got = graph.complete_linkage(samples, spark.createDataFrame(edges, "ord1 long, ord2 long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["individual"], []).append(r["ord"])
    assert max(map(len, groups.values())) == 3 and sorted(map(len, groups.values())).count(2) == 132 and len(got) == 400


def test_complete_calibration(spark):
    """All cutoffs in one search give what each gives alone."""
    rng, n = random.Random(5), 14
    samples = spark.createDataFrame([("g", f"s{k}", k) for k in range(n)], "grp string, sample string, ord long")
    cuts = (0.3, 0.5, 0.7, 0.9, 0.99)
    scored = [("g", a, b, 20, rng.random()) for a, b in random_graph(rng, n, 0.5)]
    df = spark.createDataFrame(scored, "grp string, ord1 long, ord2 long, n_compared int, posterior double")
    table = {r["cutoff"]: r["n_individuals"] for r in confidence.calibration(samples, df, cuts, 15, "complete").collect()}
    for c in cuts:
        alone = graph.complete_linkage(samples, df.filter(F.col("posterior") >= c))
        assert table[c] == alone.select("individual").distinct().count()


def hierarchy_brute(n, d, cut):
    """Merges the nearest two clusters until none are within the cut."""
    m, own = 2147483647, {v: [v] for v in range(n)}
    while True:
        best = None
        for a, b in itertools.combinations(sorted(own), 2):
            far = max(d[min(x, y), max(x, y)] for x in own[a] for y in own[b])
            key = (far, ((a + 1) * 7919 % m) * ((b + 1) * 104729 % m) % m, a, b)
            if far <= cut and (best is None or key < best):
                best = key
        if best is None:
            return {v: c for c, vs in own.items() for v in vs}
        own[best[2]] += own.pop(best[3])


def test_complete_linkage_hierarchy(spark):
    rng, rows, want = random.Random(6), [], {}
    for key in range(12):
        n = rng.randrange(3, 12)
        d = {e: rng.randrange(0, 8) for e in itertools.combinations(range(n), 2)}
        own = [(key, "g", a, b, x) for (a, b), x in d.items() if x <= 4]
        rows += own
        ends = {v for r in own for v in r[2:4]}
        want |= {(key, v): c for v, c in hierarchy_brute(n, d, 4).items() if v in ends}
    got = {(r["key"], r["node"]): r["cluster"] for r in similarity.agglomerate(spark.createDataFrame(rows, "key int, grp string, u long, v long, d int")).collect()}
    assert got == want


def test_similarity_example(spark):
    """The worked example: ten of twelve slots agree, so the two match at a mismatch number of 2 and not of 1."""
    own = make(spark, EXAMPLE)
    assert pairs.slot_distances(own).first()["d"] == 2
    assert [similarity.similarity(own, m)[1].select("individual").distinct().count() for m in (1, 2)] == [2, 1]


def test_similarity_classes(spark):
    samples = spark.createDataFrame([("g", f"s{k}", k) for k in range(7)], "grp string, sample string, ord long")
    near = {(0, 1): 0, (0, 2): 1, (1, 2): 1, (4, 5): 2}
    rows = [("g", a, b, near.get((a, b), 9)) for a, b in itertools.combinations(range(7), 2)]
    got = {r["ord"]: (r["class"], r["n_matches"], r["representative"]) for r in similarity.classified(samples, spark.createDataFrame(rows, "grp string, ord1 long, ord2 long, d int"), (2,)).collect()}
    assert got[0] == ("UNIQUE", 0, 0) and got[1] == ("MATCH", 1, 0) and got[2] == ("MATCH", 1, 0)
    assert got[3] == ("UNIQUE", 0, 3) and got[6] == ("UNIQUE", 0, 6) and {got[4][0], got[5][0]} == {"UNIQUE", "MATCH"}
    near |= {(2, 3): 2, (3, 6): 0}  # 2 is within reach of two representatives
    rows = [("g", a, b, near.get((a, b), 9)) for a, b in itertools.combinations(range(7), 2)]
    got = {r["ord"]: r["class"] for r in similarity.classified(samples, spark.createDataFrame(rows, "grp string, ord1 long, ord2 long, d int"), (2,)).collect()}
    assert got[2] == "MULTIPLE_MATCH" and got[3] == "UNIQUE" and got[6] == "MATCH"
    profile = spark.createDataFrame([(0, 3), (1, 7), (2, 5), (3, 3), (4, 3)], "m int, n_ambiguous int")
    assert similarity.chosen(profile).first()["m_hat"] == 3
    assert similarity.chosen(profile.filter("m < 2")).first()["m_hat"] == 1
    found = resolve(make(spark, EXAMPLE), "similarity", m_hat=2)
    assert found.assignment.select("individual").distinct().count() == 1 and found.matched.count() == 1


def test_method_for_a_block(spark, simulated):
    import pandas as pd

    own = simulated.select("grp", "sample", "ord", "locus", "gt")

    def by_first_locus(genotypes):
        assert genotypes.columns.tolist() == sorted(genotypes.columns) and genotypes.index.is_unique
        return {"assignment": pd.DataFrame({"individual": genotypes.iloc[:, 0].fillna("none").tolist(), "sample": genotypes.index}), "matched_pairs": pd.DataFrame({"id1": genotypes.index[:1], "id2": genotypes.index[1:2]})}

    found = resolve(own, blocks.block_method(by_first_locus))
    first = {(r["grp"], r["sample"]): f"{r['grp']}_{r['gt'] or 'none'}" for r in own.filter("locus = 1").collect()}
    assert found.method == "by_first_locus" and {(r["grp"], r["sample"]): r["individual"] for r in found.assignment.collect()} == first
    assert found.matched.count() == 2 and found.matched.filter("ord1 < ord2").count() == 2
    for wrong in (lambda g: pd.DataFrame({"sample": g.index[1:], "individual": "x"}), lambda g: pd.DataFrame({"sample": g.index}), lambda g: {"assignment": None}):
        with pytest.raises(Exception, match="a method"):
            blocks.by_block(own, wrong)
    alone = blocks.by_block(own.filter("ord = 1 or grp = 1"), lambda g: pd.DataFrame({"sample": g.index, "individual": "x"}))[0]
    assert {r["individual"] for r in alone.collect()} <= {"0_IND_001", "1_x"}


def test_null_ids(spark, tmp_path):
    """None, one and two rows without an id, beside a real sample 1: each row is a sample of its own."""
    for nulls in (0, 1, 2):
        rows = [("1", "AA", "AG", "CC"), *[("NA", "AA", "GG", "CT")] * nulls, ("2", "AG", "AG", "TT"), ("3", "GG", "AA", "CT")]
        path = tmp_path / f"ids{nulls}.csv"
        path.write_text("\n".join(",".join(r) for r in [("SampleID", "L1", "L2", "L3"), *rows]) + "\n")
        found = identify(spark, str(path), "exact", id_col="SampleID", loci=["L1", "L2", "L3"], min_loci=1)
        got = [(r["sample"], r["individual"]) for r in found.assignment.orderBy("ord").collect()]
        names = ["1", *(["NA"] if nulls == 1 else ["NA#1", "NA#2"][:nulls]), "2", "3"]
        assert [s for s, _ in got] == names and len({i for _, i in got}) == len(names) - (nulls == 2)
        power = panel.sample_power(found.panel, panel.identity_power(panel.allele_freq(found.panel, ())))
        assert power.count() == len(names) and {r["n_loci"] for r in power.collect()} == {3}
    own = spark.createDataFrame([("g", None, 1, "L", "A/A"), ("g", None, 2, "L", None), ("g", "1", 3, "L", "A/G")], SCHEMA)
    kept = panel.filter_panel(own, min_sample_call=0.5)
    assert sorted(r["ord"] for r in kept.collect()) == [1, 3] and panel.dropped(own, kept, "ord").first()["ord"] == 2
    assert panel.dropped(own, own.filter("ord = 3"), "sample").first()["sample"] is None


def test_histogram_and_strip(spark):
    rng = random.Random(4)
    values = [round(rng.gauss(0, 5), 3) for _ in range(500)] + [None]
    df = spark.createDataFrame([(v, bool(v and v > 4)) for v in values], "value double, ok boolean")
    got = compare.evidence_histogram(df, accepted=F.col("ok"), bars=20).collect()
    own = sorted(v for v in values if v is not None)
    width = (own[-1] - own[0]) / 19
    assert all(math.isclose(r["high"] - r["low"], width) for r in got) and sum(r["n_pairs"] for r in got) == 500 and sum(r["n_accepted"] for r in got) == sum(v > 4 for v in own)
    for r in got:
        assert r["n_pairs"] == sum(r["low"] < v <= r["high"] or (r["bar"] == 1 and v <= r["low"] + 1e-9) for v in own)
        assert math.isclose((r["low"] / width - 0.5) % 1, 0, abs_tol=1e-6) or math.isclose((r["low"] / width - 0.5) % 1, 1, abs_tol=1e-6)
    counts = compare.evidence_histogram(spark.createDataFrame([(k,) for k in (0, 0, 1, 3)], "n int"), "n", width=1.0).collect()
    assert sorted((r["low"], r["n_pairs"]) for r in counts) == [(-0.5, 2), (0.5, 1), (2.5, 1)]
    assert compare.evidence_histogram(df.filter("false")).count() == 0
    strip = compare.margin_strip(spark.createDataFrame([("Check", 0.05), ("Check", 0.051), ("Uncertain", -1.0), ("Uncertain", None)], "status string, margin double"))
    assert sorted((r["status"], r["step"], r["n_samples"]) for r in strip.collect()) == [("Check", -6, 2), ("Uncertain", -24, 1)]


def test_likelihood_of_rates(spark):
    """The grid's sums against the sum over all true genotypes, cell by cell."""
    rows = [("g", s, k, r, "L", g) for k, (s, gts) in enumerate({"a": ["A/G", "A/A", "A/G"], "b": ["A/A", "A/A", None], "c": ["G/G", "A/G", "G/G"], "d": ["A/A", None, None]}.items()) for r, g in enumerate(gts)]
    reps = spark.createDataFrame(rows, "grp string, sample string, ord long, rep int, locus string, gt string")
    freq = spark.createDataFrame([("L", "A", 0.7), ("L", "G", 0.3)], "locus string, allele string, p double")
    model, d, f = replicates.ErrorModel(reps, freq), 0.1, 0.04
    got = model(1, f"{d}D", f"{f}D").first()["ll"]
    p, names = {"A": 0.7, "G": 0.3}, ["A/A", "A/G", "G/G"]

    def observe(t):
        a, b = t.split("/")
        mass = dict.fromkeys(names, 1e-12)
        for s, pr in ([((a, a), d / 2), ((b, b), d / 2), ((a, b), 1 - d)] if a != b else [((a, b), 1.0)]):
            mass["/".join(sorted(s))] += pr * (1 - f)
            for x in p:
                mass["/".join(sorted((x, s[1])))] += pr * f / 2 * p[x]
                mass["/".join(sorted((s[0], x)))] += pr * f / 2 * p[x]
        return {g: m / sum(mass.values()) for g, m in mass.items()}

    e = {t: observe(t) for t in names}
    prior = {"A/A": 0.49, "A/G": 0.42, "G/G": 0.09}
    cells = [["A/G", "A/A", "A/G"], ["A/A", "A/A"], ["G/G", "A/G", "G/G"]]
    want = sum(math.log(sum(prior[t] * math.prod(e[t][g] for g in c) for t in names)) for c in cells)
    assert math.isclose(got, want, rel_tol=1e-9)
    with pytest.raises(ValueError):
        replicates.ml_error_rates(reps.filter("rep = 0"), freq)


def test_residual_rules(spark):
    """Each rule against a list of all outcomes."""
    d, f, m = 0.1, 0.03, 0.2
    models = {"het": {"AA": (1 - m) * d / 2, "BB": (1 - m) * d / 2, "AB": (1 - m) * (1 - d), "": m}, "hom": {"AB": (1 - m) * f, "AA": (1 - m) * (1 - f), "": m}}

    def call(rule, reads):
        got = [r for r in reads if r]
        count = {g: got.count(g) for g in set(got)}
        if rule == "unanimous":
            return got[0] if len(got) == len(reads) and len(count) == 1 else None
        if rule == "majority":
            top = [g for g, c in count.items() if c == max(count.values()) and c >= 2]
            return top[0] if len(top) == 1 else None
        held = [x for x in "AB" if sum(x in g for g in got) >= 2]
        if count.get("AB", 0) >= 2 or len(held) == 2:
            return "AB"
        return next((g for g in ("AA", "BB") if count.get(g, 0) >= 3), None)

    for rule in ("multi_tube", "majority", "unanimous"):
        for n in (2, 3, 4):
            chance = {k: {} for k in models}
            for kind, model in models.items():
                for reads in itertools.product(model, repeat=n):
                    g = call(rule, reads)
                    chance[kind][g] = chance[kind].get(g, 0) + math.prod(model[r] for r in reads)
            row = replicates.residual_error(spark, d, f, m, n, rule).first()
            hom = sum(v for g, v in chance["hom"].items() if g)
            want = (chance["het"].get("AA", 0) + chance["het"].get("BB", 0), chance["hom"].get("AB", 0) / hom if hom else None, chance["het"].get(None, 0), chance["hom"].get(None, 0))
            assert all((a is None and b is None) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for a, b in zip(row, want)), (rule, n, row, want)


def test_hubs(spark, monkeypatch):
    """Hubs are looked up in a broadcast table; the components are the same."""
    edges = [(0, k) for k in range(1, 60)] + [(100, k) for k in range(101, 130)] + [(129, 200), (300, 301)]
    df = spark.createDataFrame(edges, "u long, v long")
    want = {r["node"]: r["component"] for r in graph.linked(df).collect()}
    monkeypatch.setattr(graph, "HUB_EDGES", 1)
    monkeypatch.setattr(graph, "HUB_SHARE", 0.1)
    assert {r["node"]: r["component"] for r in graph.linked(df).collect()} == want and set(want.values()) == {0, 100, 300}


def test_bundle_without_zip(spark, tmp_path, monkeypatch):
    def broken(*_, **__):
        raise RuntimeError("no compression")

    monkeypatch.setattr(tables.zipfile, "ZipFile", broken)
    path = tables.write_bundle({"one": spark.createDataFrame([(1, "x, y")], "k int, t string")}, {"min_loci": 3}, str(tmp_path / "out.zip"))
    assert path.endswith("out.txt") and open(path).read().splitlines() == ["##### one #####", "k,t", '1,"x, y"', "", "##### settings #####", "min_loci : 3"]


def test_signif(spark):
    from kinloom.functions.genotype import signif

    rows = [0.00123456, 123456.0, -0.5, 0.0, None, 9.9996]
    got = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(rows)], "k int, v double").orderBy("k").select(signif(F.col("v"), 4)).collect()]
    assert got[3] == 0 and got[4] is None and all(math.isclose(a, float(f"{v:.4g}")) for a, v in zip(got, rows) if v)


def test_only_small_tables_are_broadcast(spark):
    """A panel is many times what Spark guesses from its source: neither it nor its bit planes may go to the driver."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    held = [spark.conf.get(n, None) for n in names]
    try:
        spark.conf.set(names[0], "10485760b")
        staging.measured_joins(spark)
        own = spark.range(100_000).selectExpr("id div 5 AS grp", "id AS sample", "id AS ord", "explode(array(1, 2)) AS locus", "if(id % 2 = 0, 'A/A', 'A/G') AS gt")
        plan = pairs.pair_stats(own)._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan and plan.count("BroadcastHashJoin") == 6 and plan.count("SortMergeJoin") == 1
        spark.conf.set(names[0], "-1")
        staging.measured_joins(spark)
        assert spark.conf.get(names[0]) == "-1"  # a lower limit of the session stays
    finally:
        for n, x in zip(names, held):
            spark.conf.set(n, x) if x is not None else spark.conf.unset(n)


def test_staged_lookup_tables_are_not_broadcast(spark):
    """A table of a few rows a block and locus is a small file and a large hash table: it may not go to the driver whole."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    held = [spark.conf.get(n, None) for n in names]
    try:
        spark.conf.set(names[0], "10485760b")
        spark.conf.unset(names[1])
        staging.measured_joins(spark)
        table = staging.staged(spark.range(130_000).selectExpr("id div 72 AS grp", "id div 3 % 24 AS locus", "id % 3 + 1 AS code"), "lookup")
        assert int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 256 * 1024
        cells = staging.staged(spark.range(300_000).selectExpr("id % 1800 AS grp", "id % 24 AS locus", "id * id AS ord"), "cells")
        found = cells.join(table, ["grp", "locus"])
        assert found.count() == 3 * 300_000 and "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
        found.tail(1)  # so that the plan knows the sizes measured in the shuffle
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, x in zip(names, held):
            spark.conf.set(n, x) if x is not None else spark.conf.unset(n)


def test_priors_meet_pairs_without_a_shuffle(spark, monkeypatch):
    """A row a block is broadcast while they are few, by their count; else the pairs are shuffled."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1024b")
        scored = staging.staged(spark.range(4000).selectExpr("id % 400 AS grp", "id AS ord1", "id + 1 AS ord2", "20 AS n_compared", "if(id % 3 = 0, 9.0D, -5.0D) AS lr"), "scored")
        sizes = spark.range(400).selectExpr("id AS grp", "20L AS n")
        found = []
        for most in (staging.FEW_ROWS, 399):
            monkeypatch.setattr(staging, "FEW_ROWS", most)
            told = matching.with_posterior(scored, matching.priors(scored, sizes))
            plan = told._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in plan) == (most > 399)
            found.append(sorted((r["ord1"], r["posterior"]) for r in told.collect()))
        assert found[0] == found[1] and len(found[0]) == 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_dropped_samples(spark):
    """Samples under the call rate over the loci left; without a locus left no sample has a call rate."""
    own = make(spark, {"a": ["A/G", None, "C/C"], "b": ["A/A", "C/T", None], "c": [None, "C/C", "C/T"]})
    found = lambda **s: {r["sample"] for r in panel.dropped_samples(own, **s).collect()}
    assert found(min_locus_call=0.9, min_sample_call=0.9) == set()
    assert found(min_locus_call=0.5, min_sample_call=0.9) == {"a", "b", "c"} and found(min_sample_call=0.5) == set()
    own = make(spark, {"a": ["A/G", "C/C"], "b": ["A/A", None]})
    assert {r["sample"] for r in panel.dropped_samples(own, min_sample_call=0.9).collect()} == {"b"}


def test_inference_reads_values_once(spark):
    """A column's cells are summed to its values before anything is told of them, and no cell is expanded for a count."""
    df = spark.createDataFrame([("s1", "AG"), ("s2", "AA"), ("s3", "AG"), ("s3", None), (None, "")], "SampleID string, L1 string")
    plan = lambda found: found._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan(inference.locus_tests(df, df.columns))  # both counts read the staged values
    assert "count(distinct" not in plan(inference.id_scores(df, df.columns))
    row = {r["column"]: r for r in inference.locus_tests(df, df.columns).collect()}["L1"]
    assert (row["n_filled"], row["n_typed"], row["n_genotypes"], row["n_alleles"]) == (3, 3, 2, 2)
    score = {r["column"]: r["score"] for r in inference.id_scores(df, df.columns).collect()}
    assert score == {"SampleID": 4 / 5 + 2, "L1": 4 / 5}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fixture_cells_follow_the_written_rule(spark, tmp_path):
    """Cells are coded without texts; they are those of the rule that the SQL uses, null ids included."""
    rows = [(k * 37, k % 11) for k in range(60)] + [(None, 3), (5, None)]
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    for made, rule, e in ((fixtures.panel, fixtures.PANEL_GT, fixtures.E), (fixtures.replicates, fixtures.REP_GT, fixtures.R)):
        got = made(spark, str(tmp_path))
        assert "concat" not in _plan(got) and "least" not in _plan(got)
        base = fixtures.events(spark, str(tmp_path)).withColumn("locus", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(24).cast("long"))))
        base = base.withColumn("rep", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3 if "rep" in got.columns else 1).cast("long"))))
        base = base.selectExpr("*", f"{fixtures.ALLELE.format(h=fixtures.H1)} AS a1", f"{fixtures.ALLELE.format(h=fixtures.H2)} AS a2", f"{e} AS e")
        want = base.selectExpr("event_id", "user_id div 5 AS grp", "locus", "rep" if "rep" in got.columns else "1 AS rep", f"{rule} AS gt")
        own = got.select("sample", "grp", "locus", "rep" if "rep" in got.columns else F.lit(1), "gt")
        assert want.exceptAll(own).count() == 0 and own.exceptAll(want).count() == 0


def test_block_tables_come_from_one_count(spark, tmp_path):
    """hwe_prob and those on its tables read the panel once, for counts."""
    spark.createDataFrame([(k, k % 7) for k in range(70)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    own = fixtures.panel(spark, str(tmp_path))
    dic, freq = registry._tables_of(spark, str(tmp_path))
    assert "user_id" not in _plan(dic) + _plan(freq)
    assert sorted(dic.collect()) == sorted(panel.dictionary(own).collect()) and sorted(freq.collect()) == sorted(panel.allele_freq(own).collect())


def test_linkage_against_brute_force(spark):
    """Over 64 loci, several alleles, missing cells; no row is made for a pair of loci of a sample."""
    rng = random.Random(5)
    samples = {f"s{k}": [None if rng.random() < 0.2 else "/".join(sorted(rng.choice("AACGT") for _ in "ab")) for _ in range(67)] for k in range(40)}
    own = make(spark, samples)
    ld = panel.linkage_r2(own)
    assert "posexplode" not in _plan(ld)
    names = sorted(f"L{j}" for j in range(67))
    major = {}
    for x in names:
        seen = [a for g in samples.values() if g[int(x[1:])] for a in g[int(x[1:])].split("/")]
        major[x] = min(set(seen), key=lambda a: (-seen.count(a), a))
    dose = lambda g, x: sum(a != major[x] for a in g[int(x[1:])].split("/"))
    want = {}
    for x, y in itertools.combinations(names, 2):
        both = [(dose(g, x), dose(g, y)) for g in samples.values() if g[int(x[1:])] and g[int(y[1:])]]
        n, sx, sy = len(both), sum(a for a, _ in both), sum(b for _, b in both)
        vx, vy = n * sum(a * a for a, _ in both) - sx * sx, n * sum(b * b for _, b in both) - sy * sy
        if n >= 20 and vx > 0 and vy > 0:
            want[x, y] = n, (n * sum(a * b for a, b in both) - sx * sy) ** 2 / (vx * vy)
    got = {(r["locus1"], r["locus2"]): (r["n"], r["r2"]) for r in ld.collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], abs_tol=1e-12) for k in want)


@pytest.mark.parametrize("many", [5, 140])
def test_packed_cells_against_lists(spark, many):
    """Consensus and patterns of packed cells are those of lists: over eight genotypes a locus, missing cells, and more
    replicates than a count holds."""
    rng = random.Random(9)
    names = ["/".join(p) for p in itertools.combinations_with_replacement("ACGTX", 2)]
    rows = [("g", f"s{k}", k, r, f"L{j}", None if rng.random() < 0.3 else rng.choice(names[:3] if k % 2 else names)) for k in range(20) for j in range(3) for r in range(many if k == 0 else 4)]
    rows += [("g", "none", 99, r, "L0", None) for r in range(3)]
    reps = spark.createDataFrame(rows, "grp string, sample string, ord long, rep long, locus string, gt string")
    lists = reps.groupBy(*replicates.KEY).agg(F.collect_list("gt").alias("gts"))
    got = replicates.consensus(reps)
    assert many > 127 or "collect_list" not in _plan(got) + _plan(replicates.ml_patterns(reps)).replace("collect_list(gts", "")
    assert sorted(got.collect(), key=str) == sorted(replicates._decided(lists, 2, 3).collect(), key=str) and got.count() == 61
    want = lists.filter(F.size("gts") >= 2).groupBy("locus", F.array_join(F.array_sort("gts"), " ").alias("pattern")).agg(F.count("*").alias("n"))
    assert sorted(replicates.ml_patterns(reps).collect()) == sorted(want.collect())


def test_cells_stay_with_their_block(spark, tmp_path):
    """A row an event is shuffled and no cell: counts by block, sample or locus of a block find their cells in place."""
    from kinloom.plans import fixtures

    spark.range(400).selectExpr("id AS event_id", "id % 50 AS user_id").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    for own in (fixtures.panel(spark, str(tmp_path)), fixtures.replicates(spark, str(tmp_path))):
        assert own.rdd.getNumPartitions() >= 4
        for by in (["grp"], ["grp", "sample", "ord"], ["grp", "locus", "gt"]):
            plan = own.groupBy(*by).count()._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") == 1


def test_flags_are_told_of_values(spark):
    raw = spark.createDataFrame([(k, 1, x) for k, x in enumerate(["GA", "AG", "GA*", "00", None, "A"] * 50)], "sample long, locus long, raw string")
    flags = panel.quality_flags(raw)
    assert flags.first().asDict() == {"n_cells": 300, "n_missing": 100, "n_reordered": 100, "n_flagged": 50}
    assert panel.quality_flags(raw.limit(0)).first().asDict() == dict.fromkeys(flags.columns, 0)
    assert "Aggregate [raw#" in flags._jdf.queryExecution().optimizedPlan().toString()


def test_block_method_by_chains():
    import pandas as pd

    from kinloom.plans import registry

    own = pd.DataFrame([["A/A"] * 20, ["A/A"] * 15 + [None] * 5, ["A/A"] * 15 + ["G/G"] * 5, ["G/G"] * 20, [None] * 20], index=[5, 3, 9, 1, 7], dtype=object)
    got = registry._same_everywhere(own)
    assert dict(zip(got["sample"], got["individual"])) == {5: "IND_001", 3: "IND_001", 9: "IND_001", 1: "IND_002", 7: "IND_003"}


def test_forest_of_a_tasks_edges(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(b * 30 + i, b * 30 + j) for b in range(8) for i, j in itertools.permutations(range(30), 2) if rng.random() < 0.3] + [(500, 500)]
    for most in (1 << 19, 40):
        monkeypatch.setattr(graph, "FOREST_EDGES", most)
        for kind in ("u long, v long", "u struct<key:double,ord:long>, v struct<key:double,ord:long>"):
            own = edges if kind == "u long, v long" else [((k, u), (k, v)) for u, v in edges for k in (0.5, 0.9)]
            got = graph.forest(spark.createDataFrame(own, kind).coalesce(1)).collect()
            assert all(r["v"] < r["u"] for r in got)
            assert len(got) < (len(own) if most == 40 else len({x for e in own for x in e}))
            tree = {x: x for e in own for x in e}

            def root(x):
                while tree[x] != x:
                    x = tree[x]
                return x

            for u, v in ((tuple(r["u"]), tuple(r["v"])) if "struct" in kind else (r["u"], r["v"]) for r in got):
                tree[max(root(u), root(v))] = min(root(u), root(v))
            assert all(root(u) == root(v) for u, v in own)


def test_first_cliques_brute():
    rng = random.Random(7)
    for _ in range(200):
        n, p = rng.randint(2, 12), rng.random()
        names = rng.sample(range(100), n)
        edges = [(a, b) for a, b in itertools.combinations(names, 2) if rng.random() < p]
        near = {x: {a + b - x for a, b in edges if x in (a, b)} for x in {x for e in edges for x in e}}
        if not edges:
            continue
        cliques = [sorted(c) for c in graph.maximal_cliques(sorted(near), near)]
        best = {x: min((-len(c), c) for c in cliques if x in c) for x in near}
        assert dict(graph.first_cliques(*zip(*edges))) == {x: min(y for y in near if best[y] == best[x]) for x in near}


def test_complete_linkage_of_millions_of_cliques(spark):
    """44 samples of which each matches all but one other: 2^22 cliques of one size.  The first claims its own, and the best
    clique of each other sample is the first one with that sample in place of its opposite, so it stays alone."""
    samples = spark.range(44).selectExpr("0L AS grp", "id AS sample", "id AS ord")
    matched = spark.createDataFrame([(i, j) for i, j in itertools.combinations(range(44), 2) if j != i + 22], "ord1 long, ord2 long")
    got = graph.complete_linkage(samples, matched).groupBy("individual").agg(F.collect_set("ord").alias("m")).collect()
    assert sorted(sorted(r["m"]) for r in got) == [list(range(22)), *([x] for x in range(22, 44))]


def test_parts_whole_or_node_by_node(spark, monkeypatch):
    rng = random.Random(11)
    samples = spark.range(60).selectExpr("0L AS grp", "id AS sample", "id AS ord")
    rows = [(k, 12 * b + i, 12 * b + j) for b in range(5) for i, j in itertools.combinations(range(12), 2) for x in [rng.random()] for k in (0.1, 0.5) if x > k]
    matched = spark.createDataFrame(rows, "key double, ord1 long, ord2 long")
    found = []
    for nodes in (2048, 11, 0):
        monkeypatch.setattr(graph, "PART_NODES", nodes)
        one = graph.complete_linkage(samples, matched.filter("key = 0.5")).select("ord", "individual")
        found.append((sorted(map(tuple, one.collect())), sorted(map(tuple, graph.complete_counts(samples, matched, [0.1, 0.5]).collect()))))
    assert found[0] == found[1] == found[2]
