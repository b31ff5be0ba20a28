"""The queries of the registry in SQL, from common table expressions that build on each other."""

from __future__ import annotations

import math
import re

from kinloom.operators.confidence import CUTOFFS
from kinloom.operators.matching import GRID
from kinloom.operators.replicates import FIRST_RATES, GRID_POINTS, GRID_REACH, GRID_ROUNDS, PROFILE_DROP, PROFILE_POINTS, PROFILE_RATES
from kinloom.plans.fixtures import LOCI, MARKER, RAW, SQL_PANEL, SQL_REPS, SQL_RUNS, SQL_VOTES

ALLELES = "alleles AS (SELECT grp, sample, locus, unnest([split_part(gt, '/', 1), split_part(gt, '/', 2)]) AS allele FROM panel WHERE gt IS NOT NULL)"
FREQ = f"{ALLELES}, freq AS MATERIALIZED (SELECT grp, locus, allele, count(*) / sum(count(*)) OVER (PARTITION BY grp, locus) AS p FROM alleles GROUP BY grp, locus, allele)"
FREQ_ALL = f"{ALLELES}, freq_all AS (SELECT locus, allele, count(*) / sum(count(*)) OVER (PARTITION BY locus) AS p FROM alleles GROUP BY locus, allele)"
DIC = "dic AS MATERIALIZED (SELECT grp, locus, gt, split_part(gt, '/', 1) AS t1, split_part(gt, '/', 2) AS t2, dense_rank() OVER (PARTITION BY grp, locus ORDER BY gt) AS code FROM (SELECT DISTINCT grp, locus, gt FROM panel WHERE gt IS NOT NULL))"
LOCUS = f"""{FREQ_ALL},
locus_stats AS (
  SELECT p.locus, count(gt) AS n, count(gt) / count(*) AS call_rate, any_value(n_alleles) AS n_alleles, any_value(maf) AS maf,
         avg(CASE WHEN split_part(gt, '/', 1) <> split_part(gt, '/', 2) THEN 1.0 WHEN gt IS NOT NULL THEN 0.0 END) AS ho, any_value(he) AS he
  FROM panel p LEFT JOIN (SELECT locus, count(*) AS n_alleles, min(p) AS maf, 1 - sum(p * p) AS he FROM freq_all GROUP BY locus) f USING (locus) GROUP BY p.locus)"""
POWER = f"""{FREQ_ALL},
power AS (SELECT locus, 2 * pow(sum(p * p), 2) - sum(pow(p, 4)) AS pid,
  0.25 + 0.5 * sum(p * p) + 0.5 * pow(sum(p * p), 2) - 0.25 * sum(pow(p, 4)) AS pid_sib FROM freq_all GROUP BY locus)"""
TYPED = "typed AS MATERIALIZED (SELECT grp, sample, locus, gt, split_part(gt, '/', 1) AS a1, split_part(gt, '/', 2) AS a2 FROM panel WHERE gt IS NOT NULL)"
STATS = f"""{TYPED},
stats AS MATERIALIZED (
  SELECT grp, s1, s2, coalesce(n_compared, 0) AS n_compared, coalesce(n_mismatch, 0) AS n_mismatch, coalesce(n_hard, 0) AS n_mismatch_2allele
  FROM (SELECT a.grp, a.sample AS s1, b.sample AS s2 FROM samples a JOIN samples b ON a.grp = b.grp AND a.sample < b.sample) LEFT JOIN (
    SELECT a.grp, a.sample AS s1, b.sample AS s2, count(*) AS n_compared, count(*) FILTER (a.gt <> b.gt) AS n_mismatch,
           count(*) FILTER (a.a1 <> b.a1 AND a.a1 <> b.a2 AND a.a2 <> b.a1 AND a.a2 <> b.a2) AS n_hard
    FROM typed a JOIN typed b ON a.grp = b.grp AND a.locus = b.locus AND a.sample < b.sample GROUP BY ALL) USING (grp, s1, s2))"""


def components(edges: str, name: str, rounds: int = 14) -> str:
    """Least labels spread over `edges` (s1, s2), a fixed number of times; then names by first appearance."""
    out = [f"{name}_e AS MATERIALIZED (SELECT s1 AS a, s2 AS b FROM {edges} UNION ALL SELECT s2, s1 FROM {edges})", f"{name}_0 AS (SELECT sample AS s, sample AS c FROM samples)"]
    for k in range(rounds):
        out.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT s, min(c) AS c FROM (SELECT s, c FROM {name}_{k} UNION ALL SELECT a, c FROM {name}_e JOIN {name}_{k} ON b = s) GROUP BY s)")
    out.append(
        f"{name} AS MATERIALIZED (SELECT grp, sample, grp || '_IND_' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0') AS individual FROM ("
        f"SELECT grp, sample, dense_rank() OVER (PARTITION BY grp ORDER BY c) AS n FROM samples JOIN {name}_{rounds} ON sample = s))"
    )
    return ",\n".join(out)


def rule(name: str, where: str, source: str = "stats") -> str:
    return f"{name}_m AS MATERIALIZED (SELECT * FROM {source} WHERE {where})"


EXACT = rule("exact", "n_compared >= 15 AND n_mismatch = 0") + ",\n" + components("exact_m", "exact")
THRESHOLD = rule("thresh", "n_compared >= 15 AND n_mismatch <= 1 AND n_mismatch_2allele <= 0") + ",\n" + components("thresh_m", "thresh")
SUMMARY = """SELECT {label} sum(n)::BIGINT AS n_samples, count(*) AS n_individuals, count(*) FILTER (n = 1) AS n_singletons, max(n) AS max_cluster,
  round(1 - count(*) / sum(n), 6) AS recapture_rate, round(avg(n), 6) AS mean_samples, round(quantile_cont(n, 0.5), 6) AS median_samples, round(avg(n - 1), 6) AS mean_recaptures, round(quantile_cont(n - 1, 0.5), 6) AS median_recaptures
FROM (SELECT individual, count(*) AS n FROM {name} GROUP BY individual)"""
CONFLICT = """SELECT individual, n_samples, n_edges, round(n_edges / (n_samples * (n_samples - 1) / 2), 6) AS completeness, members FROM (
  SELECT individual, count(*) AS n_samples, string_agg(sample::VARCHAR, ', ' ORDER BY sample) AS members FROM {a} GROUP BY individual) JOIN (
  SELECT x.individual, count(*) AS n_edges FROM {m} JOIN {a} x ON s1 = x.sample JOIN {a} y ON s2 = y.sample WHERE x.individual = y.individual GROUP BY 1) USING (individual)
WHERE n_samples >= 3 AND n_edges < n_samples * (n_samples - 1) / 2"""


def likelihood(d: float = 0.02, f: float = 0.005) -> str:
    pair = "least({a}, {b}) || '/' || greatest({a}, {b})"
    return f"""{FREQ}, {DIC},
gp AS MATERIALIZED (SELECT d.grp, d.locus, d.gt, d.code, CASE WHEN t1 = t2 THEN x.p * y.p ELSE 2 * x.p * y.p END AS gp
  FROM dic d JOIN freq x ON (x.grp, x.locus, x.allele) = (d.grp, d.locus, t1) JOIN freq y ON (y.grp, y.locus, y.allele) = (d.grp, d.locus, t2)),
st AS (SELECT grp, locus, code AS t, t1 AS s1, t2 AS s2, CASE WHEN t1 = t2 THEN 1.0::DOUBLE ELSE {1 - d}::DOUBLE END AS pr FROM dic
  UNION ALL SELECT grp, locus, code, t1, t1, {d / 2}::DOUBLE FROM dic WHERE t1 <> t2 UNION ALL SELECT grp, locus, code, t2, t2, {d / 2}::DOUBLE FROM dic WHERE t1 <> t2),
em AS (SELECT grp, locus, t, gt, sum(e) AS e FROM (
    SELECT grp, locus, t, {pair.format(a='s1', b='s2')} AS gt, pr * {1 - f}::DOUBLE AS e FROM st
    UNION ALL SELECT grp, locus, t, {pair.format(a='allele', b='s2')}, pr * {f}::DOUBLE * 0.5::DOUBLE * p FROM st JOIN freq USING (grp, locus)
    UNION ALL SELECT grp, locus, t, {pair.format(a='s1', b='allele')}, pr * {f}::DOUBLE * 0.5::DOUBLE * p FROM st JOIN freq USING (grp, locus)) GROUP BY ALL),
ef AS (SELECT a.grp, a.locus, a.code AS g, b.code AS t, coalesce(e, 0) + 1e-12::DOUBLE AS e FROM dic a JOIN dic b USING (grp, locus)
  LEFT JOIN em ON (em.grp, em.locus, em.t, em.gt) = (a.grp, a.locus, b.code, a.gt)),
obs AS MATERIALIZED (SELECT grp, locus, g, t, e / sum(e) OVER (PARTITION BY grp, locus, t) AS e FROM ef)"""


def pair_prob(name: str, k0: float, k1: float, k2: float) -> str:
    return f"""
{name}_o AS (SELECT grp, locus, s.allele AS s, s.p AS ps, d.code AS code, a.p AS pa FROM freq s JOIN freq a USING (grp, locus)
  JOIN dic d USING (grp, locus) WHERE d.gt = least(s.allele, a.allele) || '/' || greatest(s.allele, a.allele)),
{name}_1 AS (SELECT x.grp, x.locus, x.code AS t, y.code AS u, sum(x.ps * x.pa * y.pa) AS p1 FROM {name}_o x JOIN {name}_o y USING (grp, locus, s) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT a.grp, a.locus, a.code AS t, b.code AS u,
  {k0}::DOUBLE * a.gp * b.gp + {k1}::DOUBLE * coalesce(p1, 0) + {k2}::DOUBLE * CASE WHEN a.code = b.code THEN a.gp ELSE 0 END AS pp
  FROM gp a JOIN gp b USING (grp, locus) LEFT JOIN {name}_1 o ON (o.grp, o.locus, o.t, o.u) = (a.grp, a.locus, a.code, b.code))"""


KIN = {"unrelated": (1.0, 0.0, 0.0), "full_sib": (0.25, 0.5, 0.25), "parent_offspring": (0.0, 1.0, 0.0)}


def tables(names=("full_sib",), d: float = 0.02, f: float = 0.005) -> str:
    parts = [likelihood(d, f), *[pair_prob(f"pp_{n}", *KIN[n]) for n in names]]
    parts.append("ll_same AS (SELECT x.grp, x.locus, x.g AS g1, y.g AS g2, log10(greatest(sum(x.e * gp * y.e), 1e-300)) AS v FROM obs x JOIN obs y USING (grp, locus, t) JOIN gp ON (gp.grp, gp.locus, gp.code) = (x.grp, x.locus, x.t) GROUP BY ALL)")
    for n in names:
        parts.append(f"ll_{n} AS (SELECT x.grp, x.locus, x.g AS g1, y.g AS g2, log10(greatest(sum(x.e * pp * y.e), 1e-300)) AS v FROM obs x JOIN pp_{n} q USING (grp, locus, t) JOIN obs y ON (y.grp, y.locus, y.t) = (x.grp, x.locus, q.u) GROUP BY ALL)")
    cols = ", ".join(f"{n}.v AS {n}" for n in names)
    joins = " ".join(f"JOIN ll_{n} {n} USING (grp, locus, g1, g2)" for n in names)
    parts.append(f"tabs AS MATERIALIZED (SELECT grp, locus, g1, g2, s.v AS same, {cols} FROM ll_same s {joins})")
    return ",\n".join(parts)


CODED = "coded AS MATERIALIZED (SELECT p.grp, p.sample, p.locus, code FROM panel p JOIN dic USING (grp, locus, gt))"


def scored(names=("full_sib",), d: float = 0.02, f: float = 0.005) -> str:
    sums = ", ".join(f"coalesce({n}, 0) AS {n}" for n in ("same", *names))
    agg = ", ".join(f"sum({n}) AS {n}" for n in ("same", *names))
    return f"""{tables(names, d, f)},
{CODED},
sc AS MATERIALIZED (SELECT grp, s1, s2, coalesce(n_compared, 0) AS n_compared, {sums} FROM (
    SELECT a.grp, a.sample AS s1, b.sample AS s2 FROM samples a JOIN samples b ON a.grp = b.grp AND a.sample < b.sample) LEFT JOIN (
    SELECT a.grp, a.sample AS s1, b.sample AS s2, count(*) AS n_compared, {agg} FROM coded a JOIN coded b ON a.grp = b.grp AND a.locus = b.locus AND a.sample < b.sample
    JOIN tabs t ON t.grp = a.grp AND t.locus = a.locus AND t.g1 = a.code AND t.g2 = b.code GROUP BY ALL) USING (grp, s1, s2))"""


def posterior(lr: str, prior: str) -> str:
    return f"1 / (1 + pow(10, greatest(least(-(log10({prior} / (1 - {prior})) + {lr}), 300), -300)))"


def prior_path(source: str, lr: str, cut: float = 0.999, min_loci: int = 15, rounds: int = 25) -> str:
    """Repeated estimation of each block's prior, step by step; a block stops at the value before one that repeats it."""
    out = [f"pr_0 AS MATERIALIZED (SELECT grp, count(*) AS n, 1 / greatest(count(*), 2) AS pri, false AS done FROM samples GROUP BY grp)"]
    for k in range(rounds):
        new = f"least(0.5, greatest(1 / greatest(n, 2), (coalesce(m, 0) + 1) / (n * (n - 1) / 2)))"
        out.append(
            f"pr_{k + 1} AS MATERIALIZED (SELECT grp, n, CASE WHEN done OR n < 2 OR abs({new} - pri) < 1e-10 THEN pri ELSE {new} END AS pri, done OR n < 2 OR abs({new} - pri) < 1e-10 AS done "
            f"FROM pr_{k} LEFT JOIN (SELECT s.grp, count(*) AS m FROM {source} s JOIN pr_{k} q ON s.grp = q.grp WHERE NOT q.done AND s.n_compared >= {min_loci} AND {posterior('s.' + lr, 'q.pri')} >= {cut} GROUP BY s.grp) USING (grp))"
        )
    out.append(f"prior AS (SELECT grp, pri AS prior FROM pr_{rounds})")
    return ",\n".join(out)


LR = f"""{scored()},
lr AS MATERIALIZED (SELECT grp, s1, s2, n_compared, same - full_sib AS lr FROM sc),
{prior_path('lr', 'lr', rounds=12)},
post AS MATERIALIZED (SELECT l.grp, s1, s2, n_compared, lr, prior, {posterior('lr', 'prior')} AS posterior FROM lr l JOIN prior p ON l.grp = p.grp),
{rule('lrm', 'n_compared >= 15 AND posterior >= 0.999', 'post')},
{components('lrm_m', 'lrm')}"""
ALTS = ("unrelated", "full_sib", "parent_offspring")
BEST = f"""{scored(ALTS)},
best AS MATERIALIZED (SELECT *, same - greatest(unrelated, full_sib, parent_offspring) AS log10_lambda,
  CASE greatest(unrelated, full_sib, parent_offspring) WHEN unrelated THEN 'unrelated' WHEN full_sib THEN 'full_sib' ELSE 'parent_offspring' END AS best_alternative FROM sc),
{rule('bestm', 'n_compared >= 15 AND log10_lambda > 0', 'best')},
{components('bestm_m', 'bestm')}"""

CONF = f"""{POWER},
{LR},
spow AS (SELECT s.grp, s.sample, count(locus) AS n_loci, coalesce(sum(log10(pid_sib)), 0) AS l FROM samples s LEFT JOIN (SELECT sample, locus FROM panel WHERE gt IS NOT NULL) t USING (sample) LEFT JOIN power USING (locus) GROUP BY ALL),
told AS (SELECT s1, s2, round(posterior, 9) AS score, x.individual = y.individual AS mates FROM post JOIN lrm x ON s1 = x.sample JOIN lrm y ON s2 = y.sample WHERE n_compared >= 15),
both_ways AS (SELECT * FROM told UNION ALL SELECT s2, s1, score, mates FROM told),
per AS (SELECT s1 AS sample, min(score) FILTER (mates) AS low, max(score) FILTER (NOT mates) AS rival, min(s2) FILTER (NOT mates AND score = top) AS rival_sample FROM (
  SELECT *, max(score) FILTER (NOT mates) OVER (PARTITION BY s1) AS top FROM both_ways) GROUP BY s1),
lk AS (SELECT s AS sample, count(*) AS linked FROM (SELECT unnest([s1, s2]) AS s FROM lrm_m JOIN lrm x ON s1 = x.sample JOIN lrm y ON s2 = y.sample WHERE x.individual = y.individual) GROUP BY s),
conf0 AS (SELECT a.grp, a.sample, a.individual, c.n AS cluster_size, CASE WHEN c.n = 1 THEN 1.0 ELSE low END AS support, rival, rival_sample,
    r.individual AS rival_individual, CASE WHEN c.n > 1 THEN coalesce(linked, 0) ELSE 0 END AS linked_to, CASE WHEN c.n > 1 THEN coalesce(linked, 0) || ' of ' || (c.n - 1) END AS held_by, n_loci, l
  FROM lrm a JOIN (SELECT individual, count(*) AS n FROM lrm GROUP BY 1) c USING (individual) LEFT JOIN per USING (sample) LEFT JOIN lk USING (sample) LEFT JOIN spow p ON p.sample = a.sample LEFT JOIN lrm r ON r.sample = rival_sample
  WHERE a.grp IN (SELECT grp FROM samples GROUP BY grp HAVING count(*) > 1)),
conf AS MATERIALIZED (SELECT *, support - coalesce(rival, 0) AS margin, CASE WHEN n_loci < 15 OR l > {math.log10(0.01)} THEN 'Underpowered' WHEN support IS NULL OR support - coalesce(rival, 0) < 0.01 THEN 'Uncertain'
  WHEN support - coalesce(rival, 0) < 0.2 OR (cluster_size > 2 AND linked_to / (cluster_size - 1) < 0.5) THEN 'Check' ELSE 'Confident' END AS status FROM conf0)"""

CUTS = CUTOFFS


def calibration() -> str:
    parts = [LR]
    rows = []
    for k, c in enumerate(CUTS):
        parts += [rule(f"c{k}", f"n_compared >= 15 AND posterior >= {c}", "post"), components(f"c{k}_m", f"c{k}", 10)]
        rows.append(
            f"SELECT {c}::DOUBLE AS cutoff, count(*) FILTER (posterior >= {c}) AS n_accepted, coalesce(sum(1 - posterior) FILTER (posterior >= {c}), 0) AS false_merges, "
            f"coalesce(sum(posterior) FILTER (posterior < {c}), 0) AS missed, (SELECT count(DISTINCT individual) FROM c{k}) AS n_individuals, max(posterior) AS max_posterior FROM post WHERE n_compared >= 15"
        )
    parts.append("cal AS MATERIALIZED (" + " UNION ALL ".join(rows) + ")")
    return ",\n".join(parts)


def cliques(name: str, rounds: int = 14) -> str:
    """`{name}_full` (sample, cluster) of complete linkage, the cluster named after its first member.

    The maximal cliques of every component that is no clique are listed with a pivot; each sample goes to the largest of
    its cliques, of equal ones to that with the smaller members.
    """
    e, lab = f"{name}_e", f"{name}_{rounds}"
    return f"""{name}_cs AS (SELECT c AS comp, count(*) AS n FROM {lab} GROUP BY c),
{name}_cm AS (SELECT c AS comp, count(*) AS m FROM {e} JOIN {lab} ON a = s GROUP BY c),
{name}_ch AS MATERIALIZED (SELECT comp FROM {name}_cs JOIN {name}_cm USING (comp) WHERE m < n * (n - 1)),
{name}_nb AS MATERIALIZED (SELECT a AS v, list_sort(list(b)) AS n FROM {e} GROUP BY a),
{name}_bk AS (
  SELECT c AS comp, []::BIGINT[] AS r, list_sort(list(s)) AS p, []::BIGINT[] AS x FROM {lab} WHERE c IN (SELECT comp FROM {name}_ch) GROUP BY c
  UNION ALL (
  WITH cand AS (SELECT comp, r, p, x, unnest(list_concat(p, x)) AS u, unnest(range(len(p) + len(x))) AS o FROM {name}_bk WHERE len(p) > 0),
  piv AS (SELECT comp, r, any_value(p) AS p, any_value(x) AS x, arg_max(n, (len(list_intersect(p, n)), -o)) AS n FROM cand JOIN {name}_nb ON v = u GROUP BY comp, r),
  branch AS (SELECT comp, r, p, x, list_filter(p, lambda w: NOT list_contains(n, w)) AS b FROM piv),
  each AS (SELECT comp, r, p, x, b, unnest(b) AS w, unnest(range(len(b))) AS k FROM branch)
  SELECT comp, list_append(r, w), list_filter(p, lambda y: list_contains(n, y) AND NOT list_contains(b[:k], y)), list_filter(list_concat(x, b[:k]), lambda y: list_contains(n, y)) FROM each JOIN {name}_nb ON v = w)),
{name}_cl AS (SELECT v AS sample, arg_min(q, (-len(q), q)) AS q FROM (SELECT unnest(q) AS v, q FROM (SELECT list_sort(r) AS q FROM {name}_bk WHERE len(p) = 0 AND len(x) = 0)) GROUP BY v),
{name}_full AS MATERIALIZED (SELECT s AS sample, coalesce(min(sample) OVER (PARTITION BY q), c) AS cluster FROM {lab} LEFT JOIN {name}_cl ON sample = s)"""


def calibration_complete() -> str:
    """calibration with the individuals of complete linkage."""
    parts, rows = [calibration()], []
    for k, c in enumerate(CUTS):
        parts.append(cliques(f"c{k}", 10))
        rows.append(f"SELECT {c}::DOUBLE AS cutoff, count(DISTINCT cluster) AS n_full FROM c{k}_full")
    parts.append("calfull AS (" + " UNION ALL ".join(rows) + ")")
    return ",\n".join(parts)


REP_CONSENSUS = f"""{SQL_REPS},
rc AS (SELECT grp, sample, locus, gt, split_part(gt, '/', 1) AS a1, split_part(gt, '/', 2) AS a2, count(*) AS c FROM reps WHERE gt IS NOT NULL GROUP BY ALL),
rheld AS (SELECT sample, locus, min(a) || '/' || max(a) AS two FROM (SELECT sample, locus, a, sum(c) AS c FROM (
    SELECT sample, locus, c, a1 AS a FROM rc UNION ALL SELECT sample, locus, c, a2 FROM rc WHERE a1 <> a2) GROUP BY ALL HAVING sum(c) >= 2) GROUP BY ALL HAVING count(*) = 2),
rcall AS MATERIALIZED (SELECT s.grp, s.sample, s.locus, coalesce(
    (arg_min(gt, (-c, gt)) FILTER (a1 <> a2 AND c >= 2)), any_value(two), (arg_min(gt, (-c, gt)) FILTER (a1 = a2 AND c >= 3))) AS gt
  FROM (SELECT DISTINCT grp, sample, locus FROM reps) s LEFT JOIN rc USING (grp, sample, locus) LEFT JOIN rheld USING (sample, locus) GROUP BY ALL)"""

GLIK = f"""{SQL_REPS},
{likelihood()},
gseen AS (SELECT r.grp, r.sample, r.locus, d.code AS g, count(*) AS c FROM reps r JOIN dic d USING (grp, locus, gt) GROUP BY ALL),
gl0 AS (SELECT grp, sample, locus, t, exp(sum(c * ln(e))) AS lik, sum(c)::BIGINT AS n_obs FROM gseen JOIN obs USING (grp, locus, g) GROUP BY ALL),
glik AS MATERIALIZED (SELECT p.grp, p.sample, p.locus, d.code AS t, coalesce(lik, 1) AS lik, coalesce(n_obs, 0) AS n_obs
  FROM panel p JOIN dic d USING (grp, locus) LEFT JOIN gl0 ON (gl0.grp, gl0.sample, gl0.locus, gl0.t) = (p.grp, p.sample, p.locus, d.code))"""


def rep_pairs(names) -> str:
    """Dot products of likelihood vectors over a block's loci; blocks have three genotypes at most."""
    parts = [GLIK, *[pair_prob(f"pp_{n}", *KIN[n]) for n in names]]
    parts.append("pp_same AS (SELECT grp, locus, code AS t, code AS u, gp AS pp FROM gp)")
    every = ("same", *names)
    for n in every:
        parts.append(f"mv_{n} AS (SELECT grp, sample, locus, q.u AS t, sum(lik * pp) AS v FROM glik JOIN pp_{n} q USING (grp, locus, t) GROUP BY ALL)")
    cols = ", ".join(f"coalesce(max(v_{n}) FILTER (t = {k}), 0) AS {n}{k}" for n in every for k in (1, 2, 3))
    joins = " ".join(f"JOIN (SELECT grp, sample, locus, t, v AS v_{n} FROM mv_{n}) USING (grp, sample, locus, t)" for n in every)
    liks = ", ".join(f"coalesce(max(lik) FILTER (t = {k}), 0) AS m{k}" for k in (1, 2, 3))
    parts.append(f"vec AS MATERIALIZED (SELECT grp, sample, locus, max(n_obs) AS n_obs, {liks}, {cols} FROM glik {joins} GROUP BY ALL)")
    sums = ", ".join(f"sum(log10(greatest(a.m1 * b.{n}1 + a.m2 * b.{n}2 + a.m3 * b.{n}3, 1e-300))) AS {n}" for n in every)
    parts.append(f"rp AS MATERIALIZED (SELECT a.grp, a.sample AS s1, b.sample AS s2, count(*) FILTER (a.n_obs > 0 AND b.n_obs > 0) AS n_compared, {sums} FROM vec a JOIN vec b ON a.grp = b.grp AND a.locus = b.locus AND a.sample < b.sample GROUP BY ALL)")
    return ",\n".join(parts)


ERRORS = f"""{REP_CONSENSUS},
er AS (SELECT r.locus, split_part(r.gt, '/', 1) AS r1, split_part(r.gt, '/', 2) AS r2, split_part(t.gt, '/', 1) AS t1, split_part(t.gt, '/', 2) AS t2
  FROM reps r JOIN rcall t USING (sample, locus) WHERE r.gt IS NOT NULL AND t.gt IS NOT NULL),
errs AS (SELECT locus, count(*) FILTER (t1 <> t2) AS n_het, count(*) FILTER (t1 <> t2 AND r1 = r2 AND r1 IN (t1, t2)) AS n_dropout,
  count(*) FILTER (t1 = t2) AS n_hom, count(*) FILTER (t1 = t2 AND (r1 <> t1 OR r2 <> t1)) AS n_false FROM er GROUP BY locus)"""

ARI = """SELECT '{m1}' AS method1, '{m2}' AS method2, round(CASE WHEN abs((a + b) / 2 - a * b / t) <= 1.5e-8 * abs((a + b) / 2) THEN 1 ELSE (s - a * b / t) / ((a + b) / 2 - a * b / t) END, 6) AS ari FROM (
  SELECT (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM {x} x JOIN {y} y USING (sample) GROUP BY x.individual, y.individual)) AS s,
         (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM {x} GROUP BY individual)) AS a,
         (SELECT sum(c * (c - 1) / 2) FROM (SELECT count(*) AS c FROM {y} GROUP BY individual)) AS b,
         (SELECT count(*) * (count(*) - 1) / 2 FROM samples) AS t)"""


M31 = 2147483647


def similarity(keys: tuple[int, ...]) -> str:
    """Classes of samples at each mismatch number: nearest clusters merge, and where none is left, representatives stay."""
    ks = ", ".join(map(str, keys))
    pair = "JOIN lab x ON (x.key, x.node) = (e.key, e.u) JOIN lab y ON (y.key, y.node) = (e.key, e.v)"
    return f"""{TYPED},
slots AS MATERIALIZED (SELECT s.sample, count(locus) AS n FROM samples s LEFT JOIN typed t USING (sample) GROUP BY s.sample),
apart AS (SELECT a.grp, a.sample AS u, b.sample AS v, x.n + y.n - coalesce(k, 0) AS d
  FROM samples a JOIN samples b ON a.grp = b.grp AND a.sample < b.sample JOIN slots x ON x.sample = a.sample JOIN slots y ON y.sample = b.sample LEFT JOIN (
    SELECT a.sample AS s1, b.sample AS s2, count(*) FILTER (a.a1 = b.a1) + count(*) FILTER (a.a2 = b.a2) AS k FROM typed a JOIN typed b ON a.grp = b.grp AND a.locus = b.locus AND a.sample < b.sample GROUP BY ALL)
    ON s1 = a.sample AND s2 = b.sample),
e AS MATERIALIZED (SELECT key, grp, u, v, d FROM apart JOIN (SELECT unnest([{ks}]) AS key) ON d <= key),
lab AS (
  SELECT DISTINCT key, unnest([u, v]) AS node, node AS c, 0 AS it FROM e
  UNION ALL (
  WITH ce AS (SELECT e.key, least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, max(d) AS d, count(*) AS n FROM e {pair} WHERE x.c <> y.c GROUP BY ALL),
  sz AS (SELECT key, c, count(*) AS n FROM lab GROUP BY ALL),
  ok AS (SELECT ce.key, a, b, d, ((a % {M31} + 1) * 7919 % {M31}) * ((b % {M31} + 1) * 104729 % {M31}) % {M31} AS h
    FROM ce JOIN sz p ON (p.key, p.c) = (ce.key, a) JOIN sz q ON (q.key, q.c) = (ce.key, b) WHERE ce.n = p.n * q.n),
  near AS (SELECT key, node, min(k) AS k FROM (SELECT key, unnest([a, b]) AS node, {{'d': d, 'h': h, 'a': a, 'b': b}} AS k FROM ok) GROUP BY ALL),
  mut AS (SELECT key, k.a AS a, k.b AS b FROM near GROUP BY key, k HAVING count(*) = 2),
  tot AS (SELECT key, c, node, sum(d) AS d FROM (SELECT e.key, x.c, unnest([u, v]) AS node, d FROM e {pair} WHERE x.c = y.c) GROUP BY ALL),
  best AS (SELECT key, c, min({{'d': d, 'node': node}}).node AS best FROM tot GROUP BY ALL)
  SELECT lab.key, lab.node, coalesce(mut.a, lab.c), it + 1 FROM lab LEFT JOIN mut ON (mut.key, mut.b) = (lab.key, lab.c) WHERE EXISTS (SELECT 1 FROM mut)
  UNION ALL SELECT lab.key, lab.node, lab.node, it + 1 FROM lab LEFT JOIN best ON (best.key, best.c) = (lab.key, lab.c)
  WHERE NOT EXISTS (SELECT 1 FROM mut) AND EXISTS (SELECT 1 FROM best) AND coalesce(best, node) = node)),
stands AS MATERIALIZED (SELECT key, node FROM lab WHERE it = (SELECT max(it) FROM lab)),
met AS (SELECT DISTINCT key, unnest([u, v]) AS sample FROM e),
seen AS (SELECT key, sample, count(*) AS n, min(rep) AS rep FROM (
  SELECT e.key, u AS sample, v AS rep FROM e JOIN stands s ON (s.key, s.node) = (e.key, v) UNION ALL SELECT e.key, v, u FROM e JOIN stands s ON (s.key, s.node) = (e.key, u)) GROUP BY ALL),
classes AS MATERIALIZED (SELECT k.key, grp, s.sample, CASE WHEN met.sample IS NULL OR st.node IS NOT NULL THEN 'UNIQUE' WHEN n = 1 THEN 'MATCH' WHEN n > 1 THEN 'MULTIPLE_MATCH' ELSE 'UNCLASSIFIED' END AS class,
    CASE WHEN met.sample IS NULL OR st.node IS NOT NULL THEN 0 ELSE coalesce(n, 0) END AS n_matches, CASE WHEN met.sample IS NULL OR st.node IS NOT NULL THEN s.sample ELSE rep END AS rep
  FROM samples s JOIN (SELECT unnest([{ks}]) AS key) k ON true LEFT JOIN met ON (met.key, met.sample) = (k.key, s.sample)
  LEFT JOIN stands st ON (st.key, st.node) = (k.key, s.sample) LEFT JOIN seen ON (seen.key, seen.sample) = (k.key, s.sample))"""


PROFILE = """SELECT key AS m, count(*) FILTER (class = 'UNIQUE') AS n_unique, count(*) FILTER (class = 'UNCLASSIFIED') AS n_unclassified,
  count(*) FILTER (class = 'MULTIPLE_MATCH') AS n_multiple, count(*) FILTER (class IN ('UNCLASSIFIED', 'MULTIPLE_MATCH')) AS n_ambiguous FROM classes GROUP BY key"""
SIMILAR = """SELECT c.grp, c.sample, CASE WHEN class = 'UNCLASSIFIED' THEN c.grp || '_IND_U' || lpad(r::VARCHAR, greatest(2, length(r::VARCHAR))::INTEGER, '0')
    ELSE c.grp || '_IND_' || lpad(q.n::VARCHAR, greatest(3, length(q.n::VARCHAR))::INTEGER, '0') END AS individual, class, n_matches
FROM (SELECT *, row_number() OVER (PARTITION BY grp, class ORDER BY sample) AS r FROM classes) c
LEFT JOIN (SELECT sample, row_number() OVER (PARTITION BY grp ORDER BY sample) AS n FROM classes WHERE class = 'UNIQUE') q ON q.sample = c.rep"""


def query(body: str, *ctes: str) -> str:
    """Expressions that several of ctes define are kept where they come first."""
    head, *rest = (SQL_PANEL + ",\n" + ",\n".join(ctes) if ctes else SQL_PANEL).split(ALLELES)
    rest = [r if k == 0 else r.lstrip().removeprefix(",") for k, r in enumerate(rest)]
    return "WITH RECURSIVE " + head + (ALLELES if rest else "") + "".join(rest) + "\n" + body


def _of(cte: str, name: str) -> str:
    """The expressions of cte over another panel."""
    return re.sub(r"\bFROM panel\b", f"FROM {name}", cte)


def linkage(name: str = "panel") -> list[str]:
    return [
        _of(FREQ_ALL, name),
        _of("major AS (SELECT locus, arg_min(allele, (-p, allele)) AS m FROM freq_all GROUP BY locus), dose AS MATERIALIZED (SELECT sample, locus, (split_part(gt, '/', 1) <> m)::INT + (split_part(gt, '/', 2) <> m)::INT AS x FROM panel JOIN major USING (locus) WHERE gt IS NOT NULL)", name),
        "ld AS (SELECT a.locus AS locus1, b.locus AS locus2, count(*) AS n, pow(corr(a.x, b.x), 2) AS r2 FROM dose a JOIN dose b ON a.sample = b.sample AND a.locus < b.locus GROUP BY ALL HAVING count(*) >= 20)",
    ]


UNIQUE = [
    STATS, rule("uniq", "n_compared >= 9 AND n_mismatch = 0"), components("uniq_m", "uniq"),
    "upanel AS MATERIALIZED (SELECT * FROM panel WHERE sample IN (SELECT min(sample) FROM uniq GROUP BY individual))",
]
AMPLICONS = "apanel AS MATERIALIZED (SELECT grp, sample, 'L' || lpad((CASE WHEN locus % 3 = 0 THEN locus - 1 ELSE locus END)::VARCHAR, 2, '0') || CASE WHEN locus % 3 = 0 THEN 'SNP2' ELSE '' END AS locus, gt FROM panel)"
CALLED = f"""wide AS (SELECT sample, locus, {RAW} AS raw FROM panel),
wcells AS (SELECT 'LOC' || lpad(locus::VARCHAR, 2, '0') AS "column", raw FROM wide UNION ALL SELECT 'SampleID', 'S' || sample FROM samples UNION ALL SELECT 'Reads', (sample * 37 % 1000)::VARCHAR FROM samples
  UNION ALL SELECT 'Species', CASE WHEN sample % 3 = 0 THEN 'alpha' ELSE 'beta' END FROM samples),
clean AS (SELECT "column", raw, upper(trim(raw)) AS x, regexp_replace(upper(trim(raw)), '[*?!#]', '', 'g') AS y FROM wcells),
called AS MATERIALIZED (SELECT "column", raw, x, try_cast(x AS DOUBLE) AS num, CASE WHEN length(y) NOT BETWEEN 1 AND 2 OR y IN ('NA', 'NN', '--', '..') OR regexp_matches(y, '[-0?.]') THEN NULL
  ELSE least(y[1], y[-1]) || '/' || greatest(y[1], y[-1]) END AS gt FROM clean)"""

#: The grid search of the replicates' error rates, as the engine runs it.
ML_TERMS = f"""{SQL_REPS},
{FREQ_ALL},
mp AS MATERIALIZED (SELECT locus, pattern, count(*) AS n FROM (SELECT sample, locus, string_agg(gt, ' ' ORDER BY gt) AS pattern FROM reps WHERE gt IS NOT NULL GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL),
mo AS MATERIALIZED (SELECT locus, pattern, n, gt AS g, count(*) AS c FROM (SELECT *, unnest(string_split(pattern, ' ')) AS gt FROM mp) GROUP BY ALL),
md AS MATERIALIZED (SELECT DISTINCT locus, g AS t, split_part(g, '/', 1) AS t1, split_part(g, '/', 2) AS t2 FROM mo),
mg AS MATERIALIZED (SELECT md.locus, t, CASE WHEN t1 = t2 THEN x.p * y.p ELSE 2 * x.p * y.p END AS gp FROM md JOIN freq_all x ON (x.locus, x.allele) = (md.locus, t1) JOIN freq_all y ON (y.locus, y.allele) = (md.locus, t2)),
ms AS (SELECT locus, t, t1 AS s1, t2 AS s2, 1.0::DOUBLE AS k0, CASE WHEN t1 = t2 THEN 1.0 ELSE 0.0 END::DOUBLE AS k1 FROM md
  UNION ALL SELECT locus, t, t1, t1, 0, 0.5 FROM md WHERE t1 <> t2 UNION ALL SELECT locus, t, t2, t2, 0, 0.5 FROM md WHERE t1 <> t2),
mf AS (SELECT locus, t, gt, sum(e00) AS e00, sum(e10) AS e10, sum(e01) AS e01, sum(e11) AS e11 FROM (
  SELECT locus, t, least(s1, s2) || '/' || greatest(s1, s2) AS gt, k0 AS e00, k1 AS e10, 0.0::DOUBLE AS e01, 0.0::DOUBLE AS e11 FROM ms
  UNION ALL SELECT locus, t, least(allele, s2) || '/' || greatest(allele, s2), 0, 0, k0 * 0.5 * p, k1 * 0.5 * p FROM ms JOIN freq_all USING (locus)
  UNION ALL SELECT locus, t, least(s1, allele) || '/' || greatest(s1, allele), 0, 0, k0 * 0.5 * p, k1 * 0.5 * p FROM ms JOIN freq_all USING (locus)) GROUP BY ALL),
mt AS MATERIALIZED (SELECT a.locus, a.t AS g, b.t, coalesce(e00, 0) AS e00, coalesce(e10, 0) AS e10, coalesce(e01, 0) AS e01, coalesce(e11, 0) AS e11
  FROM md a JOIN md b USING (locus) LEFT JOIN mf ON (mf.locus, mf.t, mf.gt) = (a.locus, b.t, a.t))"""


def grid_ll(name: str, points: str) -> str:
    """`name` (point, d, f, ll) for the expression `points` (point, d, f)."""
    return f"""
{name}_p AS MATERIALIZED ({points}),
{name}_e AS (SELECT point, locus, g, t, ln(e / sum(e) OVER (PARTITION BY point, locus, t)) AS l FROM (
  SELECT point, locus, g, t, (1 - d) * (1 - f) * e00 + d * (1 - f) * e10 + (1 - d) * f * e01 + d * f * e11 + 1e-12 AS e FROM mt, {name}_p)),
{name}_c AS (SELECT point, locus, pattern, n, t, exp(sum(c * l)) AS lik FROM mo JOIN {name}_e USING (locus, g) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT point, d, f, ll FROM {name}_p JOIN (SELECT point, sum(n * ln(greatest(lik, 1e-300))) AS ll FROM (
  SELECT point, locus, pattern, n, sum(lik * gp) AS lik FROM {name}_c JOIN mg USING (locus, t) GROUP BY ALL) GROUP BY point) USING (point))"""


def _grid(x: str, y: str, reach: str, source: str) -> str:
    n = GRID_POINTS
    at = lambda c, k: f"1 / (1 + exp(-({c} + (2 * {reach} * ({k}) / {n - 1} - {reach}))))"
    return f"SELECT k AS point, {at(x, f'k // {n}')} AS d, {at(y, f'k % {n}')} AS f FROM {source}, (SELECT unnest(range({n * n})) AS k)"


def ml_search() -> str:
    """Each round's grid is centred on the best point before; `mlx` (d, f, ll) is the top of the last one's paraboloid."""
    low, high = (math.log(q / (1 - q)) for q in FIRST_RATES)
    n, reach = GRID_POINTS, (high - low) / 2
    parts, centre = [ML_TERMS, f"z0 AS (SELECT {(low + high) / 2}::DOUBLE AS x, {(low + high) / 2}::DOUBLE AS y, {reach}::DOUBLE AS r)"], "z0"
    for k in range(GRID_ROUNDS):
        parts.append(grid_ll(f"gl{k}", _grid("x", "y", "r", centre)))
        parts.append(f"b{k} AS MATERIALIZED (SELECT point // {n} AS i, point % {n} AS j, ll FROM gl{k} ORDER BY ll DESC, point LIMIT 1)")
        if k < GRID_ROUNDS - 1:
            parts.append(f"z{k + 1} AS MATERIALIZED (SELECT x - r + 2 * r / {n - 1} * i AS x, y - r + 2 * r / {n - 1} * j AS y, {GRID_REACH} * (2 * r / {n - 1}) AS r FROM {centre}, b{k})")
            centre = f"z{k + 1}"
    last = GRID_ROUNDS - 1
    near = ", ".join(f"max(g.ll - b.ll) FILTER (point // {n} = i + {a} AND point % {n} = j + {c}) AS n{a + 1}{c + 1}" for a in (-1, 0, 1) for c in (-1, 0, 1))
    parts.append(f"nb AS (SELECT i, j, b.ll, {near} FROM gl{last} g, b{last} b GROUP BY ALL)")
    parts.append("nd AS (SELECT *, (n21 - n01) / 2 AS gx, (n12 - n10) / 2 AS gy, n21 + n01 AS xx, n12 + n10 AS yy, (n22 - n20 - n02 + n00) / 4 AS xy FROM nb)")
    step = lambda top: f"coalesce(greatest(-1, least(1, CASE WHEN xx * yy - xy * xy > 0 THEN ({top}) / (xx * yy - xy * xy) END)), 0)"
    odds = lambda c, i, u: f"1 / (1 + exp(-({c} - r + 2 * r / {n - 1} * ({i} + {u}))))"
    parts.append(f"mlx AS MATERIALIZED (SELECT {odds('x', 'i', step('xy * gy - yy * gx'))} AS d, {odds('y', 'j', step('xy * gx - xx * gy'))} AS f, ll FROM nd, {centre})")
    return ",\n".join(parts)


def ml_profile() -> str:
    (a, b), n = PROFILE_RATES, PROFILE_POINTS
    even = f"({a}::DOUBLE + {b - a}::DOUBLE * k / {n - 1})"
    points = f"SELECT k AS point, {even} AS d, f FROM mlx, (SELECT unnest(range({n})) AS k) UNION ALL SELECT {n} + k, d, {even} FROM mlx, (SELECT unnest(range({n})) AS k)"
    return grid_ll("mlp", points) + f""",
mle AS MATERIALIZED (SELECT rate, min(q) AS lo, max(q) AS hi FROM (
  SELECT point // {n} AS rate, CASE WHEN point < {n} THEN d ELSE f END AS q, ll, max(ll) OVER (PARTITION BY point // {n}) AS most FROM mlp) WHERE ll >= most - {PROFILE_DROP} GROUP BY rate)"""


def residual(source: str) -> str:
    """`res`: what the multi-tube rule leaves of the rates of `source` (d, f, m) with three reactions."""
    return f"""
rr AS (SELECT d, f, m, [o % 4, o // 4 % 4, o // 16 % 4] AS r FROM {source}, (SELECT unnest(range(64)) AS o)),
rn AS (SELECT d, f, m, len(list_filter(r, lambda x: x = 0)) AS c0, len(list_filter(r, lambda x: x = 1)) AS c1, len(list_filter(r, lambda x: x = 2)) AS c2, len(list_filter(r, lambda x: x = 3)) AS c3 FROM rr),
rp0 AS (SELECT pow((1 - m) * d / 2, c0 + c1) * pow((1 - m) * (1 - d), c2) * pow(m, c3) AS het, CASE WHEN c1 = 0 THEN pow((1 - m) * (1 - f), c0) * pow((1 - m) * f, c2) * pow(m, c3) ELSE 0 END AS hom,
  CASE WHEN c2 >= 2 OR (c0 + c2 >= 2 AND c1 + c2 >= 2) THEN 2 WHEN c0 >= 3 THEN 0 WHEN c1 >= 3 THEN 1 END AS call FROM rn),
res AS (SELECT coalesce(sum(het) FILTER (call < 2), 0) AS dropout, sum(hom) FILTER (call = 2) / sum(hom) FILTER (call IS NOT NULL) AS false_allele,
  coalesce(sum(het) FILTER (call IS NULL), 0) AS missing_het, coalesce(sum(hom) FILTER (call IS NULL), 0) AS missing_hom FROM rp0)"""


RATES = "rate AS (SELECT d, f, (SELECT avg((gt IS NULL)::INT) FROM reps) AS m FROM mlx)"
UNIQUE_ML = re.sub(r"\bFROM panel\b", "FROM upanel", ml_search())


def histogram(source: str, value: str, accepted: str, width: str | None = None) -> str:
    """Even bars over the values of source, edges half a width off the multiples of the width."""
    w = width or "CASE WHEN most > least_ THEN (most - least_) / 59 ELSE 1.0 END"
    return f"""hr AS (SELECT {w} AS w, least_ FROM (SELECT min({value})::DOUBLE AS least_, max({value})::DOUBLE AS most FROM {source})),
hs AS (SELECT w, w / 2 + floor((least_ - w / 2) / w + 1e-9) * w AS s FROM hr),
hb AS (SELECT greatest(1, ceil(({value} - s) / w - 1e-9))::INTEGER AS bar, s, w, {accepted} AS ok FROM {source}, hs WHERE {value} IS NOT NULL),
bars AS (SELECT bar::BIGINT AS bar, round(s + (bar - 1) * w, 6) AS low, round(s + (bar - 1) * w + w, 6) AS high, count(*) AS n_pairs, count(*) FILTER (ok) AS n_accepted FROM hb GROUP BY bar, s, w)"""


def _sweep(top: int = 6, outer: str | None = None) -> str:
    parts, rows = [STATS], []
    for k in range(top + 1):
        parts += [rule(f"w{k}", f"n_compared >= 15 AND n_mismatch <= {k}"), components(f"w{k}_m", f"w{k}", 12)]
        rows.append(
            f"SELECT {k}::BIGINT AS k, (SELECT count(*) FROM w{k}_m) AS n_matched_pairs, (SELECT count(DISTINCT individual) FROM w{k}) AS n_individuals, (SELECT max(c) FROM (SELECT count(*) AS c FROM w{k} GROUP BY individual)) AS max_cluster, "
            f"(SELECT count(*) FROM ({CONFLICT.format(a=f'w{k}', m=f'w{k}_m')})) AS n_conflicting"
        )
    if outer:
        return query(outer, *parts, "swept AS (" + " UNION ALL ".join(rows) + ")")
    return query(" UNION ALL ".join(rows), *parts)


def sensitivity(grid: dict = GRID, d: float = 0.02, kin: str = "full_sib", cut: float = 0.999, rounds: int = 8) -> str:
    """Evidence for all dropouts and kinships from one join of the samples of a block; priors and labels by setting (s, cut)."""
    drops, cuts, names = sorted({*grid["dropouts"], d}), sorted({*grid["cuts"], cut}), grid["kinships"]
    settings = [(k, x) for k in range(len(drops)) for x in names]
    rates = ", ".join(f"({k}, {v}::DOUBLE)" for k, v in enumerate(drops))
    lrs = ", ".join(f"sum(lr{s}) AS lr{s}" for s in range(len(settings)))
    told = ", ".join(f"max(q.v - r_{x}.v) FILTER (q.k = {k}) AS lr{s}" for s, (k, x) in enumerate(settings))
    parts = [
        likelihood(),
        *[pair_prob(f"pp_{x}", *KIN[x]) for x in names],
        f"rates AS (SELECT * FROM (VALUES {rates}) v(k, d))",
        """gst AS (SELECT k, grp, locus, code AS t, t1 AS s1, t2 AS s2, CASE WHEN t1 = t2 THEN 1 ELSE 1 - d END AS pr FROM dic, rates
  UNION ALL SELECT k, grp, locus, code, a, a, d / 2 FROM dic, rates, unnest([t1, t2]) x(a) WHERE t1 <> t2)""",
        """gem AS (SELECT k, grp, locus, t, least(a, b) || '/' || greatest(a, b) AS gt, sum(e) AS e FROM (SELECT k, grp, locus, t, s1 AS a, s2 AS b, pr * 0.995::DOUBLE AS e FROM gst
  UNION ALL SELECT k, grp, locus, t, allele, s2, pr * 0.0025::DOUBLE * p FROM gst JOIN freq USING (grp, locus) UNION ALL SELECT k, grp, locus, t, s1, allele, pr * 0.0025::DOUBLE * p FROM gst JOIN freq USING (grp, locus)) GROUP BY ALL)""",
        """gobs AS MATERIALIZED (SELECT k, grp, locus, g, t, e / sum(e) OVER (PARTITION BY k, grp, locus, t) AS e FROM (SELECT rates.k, a.grp, a.locus, a.code AS g, b.code AS t, coalesce(e, 0) + 1e-12::DOUBLE AS e
  FROM dic a JOIN dic b USING (grp, locus) CROSS JOIN rates LEFT JOIN gem m ON (m.k, m.grp, m.locus, m.t, m.gt) = (rates.k, a.grp, a.locus, b.code, a.gt)))""",
        "g_same AS MATERIALIZED (SELECT x.k, x.grp, x.locus, x.g AS g1, y.g AS g2, log10(greatest(sum(x.e * gp * y.e), 1e-300)) AS v FROM gobs x JOIN gobs y USING (k, grp, locus, t) JOIN gp ON (gp.grp, gp.locus, gp.code) = (x.grp, x.locus, x.t) GROUP BY ALL)",
        *[
            f"r_{x} AS MATERIALIZED (SELECT x.k, x.grp, x.locus, x.g AS g1, y.g AS g2, log10(greatest(sum(x.e * pp * y.e), 1e-300)) AS v FROM gobs x JOIN pp_{x} q USING (grp, locus, t) JOIN gobs y ON (y.k, y.grp, y.locus, y.t) = (x.k, x.grp, x.locus, q.u) GROUP BY ALL)"
            for x in names
        ],
        f"gtabs AS MATERIALIZED (SELECT q.grp, q.locus, q.g1, q.g2, {told} FROM g_same q {' '.join(f'JOIN r_{x} USING (k, grp, locus, g1, g2)' for x in names)} GROUP BY ALL)",
        CODED,
        f"""gsc AS MATERIALIZED (SELECT a.grp, a.sample AS s1, b.sample AS s2, count(*) AS n_compared, {lrs} FROM coded a JOIN coded b ON a.grp = b.grp AND a.locus = b.locus AND a.sample < b.sample
  JOIN gtabs t ON t.grp = a.grp AND t.locus = a.locus AND t.g1 = a.code AND t.g2 = b.code GROUP BY ALL HAVING count(*) >= 15)""",
        f"glr AS MATERIALIZED (SELECT * FROM (SELECT grp, s1, s2, s, [{', '.join(f'lr{s}' for s in range(len(settings)))}][s + 1] AS lr FROM gsc, unnest(range({len(settings)})) x(s)) WHERE {posterior('lr', '0.5')} >= {min(cuts)} * (1 - 1e-9))",
        f"h_0 AS MATERIALIZED (SELECT grp, s, cut, count(*) AS n, 1 / greatest(count(*), 2) AS pri, false AS done FROM samples, unnest(range({len(settings)})) x(s), unnest({cuts}::DOUBLE[]) y(cut) GROUP BY ALL)",
    ]
    new = "least(0.5, greatest(1 / greatest(n, 2), (coalesce(m, 0) + 1) / (n * (n - 1) / 2)))"
    for k in range(12):
        parts.append(
            f"h_{k + 1} AS MATERIALIZED (SELECT grp, s, cut, n, CASE WHEN done OR n < 2 OR abs({new} - pri) < 1e-10 THEN pri ELSE {new} END AS pri, done OR n < 2 OR abs({new} - pri) < 1e-10 AS done "
            f"FROM h_{k} LEFT JOIN (SELECT grp, s, cut, count(*) AS m FROM glr l JOIN h_{k} q USING (grp, s) WHERE NOT done AND {posterior('lr', 'pri')} >= cut GROUP BY ALL) USING (grp, s, cut))"
        )
    parts += [
        f"gm AS MATERIALIZED (SELECT s, cut, s1, s2 FROM glr JOIN h_12 USING (grp, s) WHERE {posterior('lr', 'pri')} >= cut)",
        "gc_0 AS (SELECT DISTINCT s, cut, x AS node, x AS c FROM gm, unnest([s1, s2]) y(x))",
    ]
    for k in range(rounds):
        parts.append(
            f"gc_{k + 1} AS MATERIALIZED (SELECT s, cut, node, min(c) AS c FROM (FROM gc_{k} UNION ALL SELECT s, cut, s2, c FROM gm JOIN gc_{k} USING (s, cut) WHERE node = s1 UNION ALL SELECT s, cut, s1, c FROM gm JOIN gc_{k} USING (s, cut) WHERE node = s2) GROUP BY ALL)"
        )
    parts += [
        f"gsize AS (SELECT s, cut, c, count(*) AS n FROM gc_{rounds} GROUP BY ALL)",
        f"gin AS (SELECT s, cut, c, count(*) AS m FROM gm JOIN gc_{rounds} USING (s, cut) WHERE node = s1 GROUP BY ALL)",
        "per AS (SELECT s, cut, sum(n - 1) AS merged, count(*) FILTER (n >= 3 AND m < n * (n - 1) / 2) AS broken FROM gsize JOIN gin USING (s, cut, c) GROUP BY ALL)",
    ]
    kinships, dropouts = (f"[{', '.join(map(repr, v))}][s + 1]" for v in ([x for _, x in settings], [drops[k] for k, _ in settings]))
    body = f"""SELECT *, kinship = '{kin}' AND dropout = {d} AND cutoff = {cut} AS current FROM (SELECT {kinships} AS kinship, {dropouts}::DOUBLE AS dropout, cut AS cutoff,
  ((SELECT count(*) FROM samples) - coalesce(merged, 0))::BIGINT AS n_individuals, coalesce(broken, 0)::BIGINT AS n_conflicting
  FROM (SELECT DISTINCT s, cut FROM h_0) LEFT JOIN per USING (s, cut)) ORDER BY kinship, dropout, cutoff"""
    return query(body, *parts)


WIDE = "(SELECT sample, locus, " + RAW + " AS raw FROM panel)"

SQL = {
    "norm_genotype": query(
        f"""SELECT sample, locus, CASE WHEN length(x) > 2 OR x IN ('00', '0', 'NA', 'NN', '..', '') THEN NULL
        ELSE least(substr(x, 1, 1), substr(x, 2, 1)) || '/' || greatest(substr(x, 1, 1), substr(x, 2, 1)) END AS gt
        FROM (SELECT sample, locus, regexp_replace(upper(trim(raw)), '[*?!#]', '', 'g') AS x FROM {WIDE})"""
    ),
    "quality_flags": query(
        f"""SELECT count(*) AS n_cells, count(*) FILTER (x = '00') AS n_missing, count(*) FILTER (x <> '00' AND x[1] > x[2]) AS n_reordered, count(*) FILTER (raw LIKE '%*%') AS n_flagged
        FROM (SELECT raw, replace(raw, '*', '') AS x FROM {WIDE})"""
    ),
    "locus_stats": query("SELECT locus, n, round(call_rate, 6) AS call_rate, n_alleles, round(maf, 6) AS maf, round(ho, 6) AS ho, round(he, 6) AS he, round(1 - ho / he, 6) AS fis FROM locus_stats", LOCUS),
    "sample_stats": query("SELECT grp, sample, count(gt) AS n_typed, round(count(gt) / count(*), 6) AS call_rate FROM panel GROUP BY ALL"),
    "allele_freq": query("SELECT grp, locus, allele, round(p, 6) AS p FROM freq", FREQ),
    "allele_freq_weighted": query(
        "SELECT grp, locus, allele, round(sum(1 / c) / sum(sum(1 / c)) OVER (PARTITION BY grp, locus), 6) AS p FROM alleles JOIN exact USING (grp, sample) JOIN (SELECT individual, count(*) AS c FROM exact GROUP BY 1) USING (individual) GROUP BY grp, locus, allele",
        ALLELES, STATS, EXACT,
    ),
    "filter_panel": query(
        """SELECT locus, count(*) AS n_rows, count(gt) AS n_typed FROM part WHERE sample IN (SELECT sample FROM part GROUP BY sample HAVING count(gt) / count(*) >= 0.9) GROUP BY locus""",
        LOCUS, "part AS (SELECT * FROM panel WHERE locus IN (SELECT locus FROM locus_stats WHERE call_rate >= 0.925 AND maf >= 0.05))",
    ),
    "dropped_loci": query("SELECT locus FROM locus_stats WHERE NOT (call_rate >= 0.925 AND maf >= 0.05)", LOCUS),
    "dropped_samples": query(
        "SELECT sample FROM part GROUP BY sample HAVING count(gt) / count(*) < 0.9", LOCUS, "part AS (SELECT * FROM panel WHERE locus IN (SELECT locus FROM locus_stats WHERE call_rate >= 0.925 AND maf >= 0.05))"
    ),
    "ld_r2": query(
        "SELECT a.locus AS locus1, b.locus AS locus2, count(*) AS n, round(pow(corr(a.x, b.x), 2), 6) AS r2 FROM dose a JOIN dose b ON a.sample = b.sample AND a.locus < b.locus GROUP BY ALL HAVING count(*) >= 20",
        FREQ_ALL,
        "major AS (SELECT locus, arg_min(allele, (-p, allele)) AS m FROM freq_all GROUP BY locus), dose AS MATERIALIZED (SELECT sample, locus, (split_part(gt, '/', 1) <> m)::INT + (split_part(gt, '/', 2) <> m)::INT AS x FROM panel JOIN major USING (locus) WHERE gt IS NOT NULL)",
    ),
    "pid_locus": query("SELECT locus, round(pid, 6) AS pid, round(pid_sib, 6) AS pid_sib FROM power", POWER),
    "pid_cumulative": query("SELECT locus, row_number() OVER w AS n_loci, round(sum(log10(pid)) OVER w, 6) AS log10_cum_pid, round(sum(log10(pid_sib)) OVER w, 6) AS log10_cum_pid_sib FROM power WINDOW w AS (ORDER BY pid, locus ROWS UNBOUNDED PRECEDING)", POWER),
    "loci_needed": query(
        f"SELECT 0.01::DOUBLE AS band, min(n) FILTER (c < {math.log10(0.01)}) AS n_loci FROM cum UNION ALL SELECT 0.001::DOUBLE, min(n) FILTER (c < {math.log10(0.001)}) FROM cum",
        POWER, "cum AS (SELECT row_number() OVER w AS n, sum(log10(pid_sib)) OVER w AS c FROM power WINDOW w AS (ORDER BY pid, locus ROWS UNBOUNDED PRECEDING))",
    ),
    "sample_power": query(
        "SELECT s.grp, s.sample, count(locus) AS n_loci, round(coalesce(sum(log10(pid)), 0), 6) AS log10_pid, round(coalesce(sum(log10(pid_sib)), 0), 6) AS log10_pid_sib FROM samples s LEFT JOIN (SELECT sample, locus FROM panel WHERE gt IS NOT NULL) t USING (sample) LEFT JOIN power USING (locus) GROUP BY ALL",
        POWER,
    ),
    "encode_dict": query("SELECT grp, locus, gt, code FROM dic", DIC),
    "pairwise": query("SELECT grp, n_compared, n_mismatch, n_mismatch_2allele, count(*) AS n_pairs FROM stats GROUP BY ALL", STATS),
    "mismatch_histogram": query("SELECT n_mismatch, count(*) AS n_pairs FROM stats WHERE n_compared >= 15 GROUP BY ALL", STATS),
    "match_exact": query("SELECT grp, s1 AS id1, s2 AS id2, n_compared FROM stats WHERE n_compared >= 15 AND n_mismatch = 0", STATS),
    "match_threshold": query("SELECT grp, s1 AS id1, s2 AS id2, n_compared, n_mismatch FROM stats WHERE n_compared >= 15 AND n_mismatch <= 1 AND n_mismatch_2allele <= 0", STATS),
    "near_matches": query("SELECT grp, s1 AS id1, s2 AS id2, n_compared, n_mismatch FROM stats WHERE n_compared >= 15 AND n_mismatch BETWEEN 1 AND 2", STATS),
    "matched_pid": query(
        "SELECT s1 AS id1, s2 AS id2, round(sum(log10(pid)), 6) AS log10_pid, round(sum(log10(pid_sib)), 6) AS log10_pid_sib FROM exact_m m JOIN typed a ON a.sample = s1 JOIN typed b ON b.sample = s2 AND a.locus = b.locus JOIN gpower g ON g.grp = m.grp AND g.locus = a.locus GROUP BY ALL",
        STATS, rule("exact", "n_compared >= 15 AND n_mismatch = 0"), FREQ,
        "gpower AS (SELECT grp, locus, 2 * pow(sum(p * p), 2) - sum(pow(p, 4)) AS pid, 0.25 + 0.5 * sum(p * p) + 0.5 * pow(sum(p * p), 2) - 0.25 * sum(pow(p, 4)) AS pid_sib FROM freq GROUP BY ALL)",
    ),
    "threshold_sweep": _sweep(),
    "fallback_mismatches": query(
        "SELECT m AS m_hat, c AS n_ambiguous FROM (SELECT m, (SELECT count(*) FROM stats WHERE n_compared >= 15 AND n_mismatch = m + 1) AS c FROM (SELECT unnest(range(0, 7)) AS m)) ORDER BY c, m LIMIT 1", STATS
    ),
    "assignment_exact": query("SELECT grp, sample, individual FROM exact", STATS, EXACT),
    "assignment_threshold": query("SELECT grp, sample, individual FROM thresh", STATS, THRESHOLD),
    "assignment_summary": query(SUMMARY.format(name="exact", label=""), STATS, EXACT),
    "cluster_sizes": query("SELECT c AS cluster_size, count(*) AS n_individuals FROM (SELECT count(*) AS c FROM thresh GROUP BY individual) GROUP BY c", STATS, THRESHOLD),
    "conflicts": query(CONFLICT.format(a="thresh", m="thresh_m"), STATS, THRESHOLD),
    "hwe_prob": query("SELECT grp, locus, gt, round(gp, 6) AS gp FROM gp", likelihood()),
    "obs_matrix": query("SELECT grp, locus, g, t, round(e, 6) AS e FROM obs", likelihood()),
    "pair_prob": query("SELECT grp, locus, t, u, round(pp, 6) AS pp FROM pp", likelihood(), pair_prob("pp", 0.25, 0.5, 0.25)),
    "lr_table": query("SELECT grp, locus, g1, g2, round(same - full_sib, 6) AS lr FROM tabs", tables()),
    "lr_pairs": query("SELECT grp, n_compared, count(*) AS n_pairs, round(sum(same - full_sib), 4) AS lr_sum, round(max(same - full_sib), 6) AS lr_max FROM sc GROUP BY ALL", scored()),
    "lr_prior": query("SELECT grp, round(prior, 9) AS prior FROM prior", LR),
    "lr_matched": query("SELECT grp, s1 AS id1, s2 AS id2, n_compared, round(lr, 6) AS lr FROM lrm_m", LR),
    "lr_assignment": query("SELECT grp, sample, individual FROM lrm", LR),
    "best_alternative_counts": query("SELECT best_alternative, count(*) AS n_pairs, round(max(log10_lambda), 6) AS top FROM best GROUP BY ALL", BEST),
    "best_alternative_assignment": query("SELECT grp, sample, individual FROM bestm", BEST),
    "calibration": query("SELECT cutoff, n_accepted, round(false_merges, 4) AS false_merges, round(missed, 4) AS missed, n_individuals FROM cal", calibration()),
    "calibration_verdict": query("SELECT count(*) AS n_usable, min(n_individuals) AS fewest, max(n_individuals) AS most, max(cutoff) AS highest_usable, (SELECT min(cutoff) FROM cal WHERE false_merges <= 1) AS recommended FROM cal WHERE cutoff <= max_posterior", calibration()),
    "sample_confidence": query("SELECT grp, sample, individual, cluster_size, round(support, 6) AS support, round(rival, 6) AS rival, rival_sample, rival_individual, linked_to, held_by, n_loci, round(margin, 6) AS margin, status FROM conf", CONF),
    "roster": query(
        "SELECT grp, individual, count(*) AS n_samples, round(min(margin), 6) AS weakest_margin, arg_min(status, (coalesce(margin, -1), sample)) AS weakest_status, string_agg(sample::VARCHAR, ', ' ORDER BY sample) AS members FROM conf GROUP BY ALL", CONF
    ),
    "ari_matrix": query(
        " UNION ALL ".join(ARI.format(m1=a, m2=b, x=x, y=y) for i, (a, x) in enumerate((("exact", "exact"), ("threshold", "thresh"), ("likelihood_ratio", "lrm"))) for b, y in (("exact", "exact"), ("threshold", "thresh"), ("likelihood_ratio", "lrm"))[i:]),
        STATS, EXACT, THRESHOLD, LR,
    ),
    "method_summary": query(" UNION ALL ".join(SUMMARY.format(name=n, label=f"'{m}' AS method,") for m, n in (("exact", "exact"), ("threshold", "thresh"), ("likelihood_ratio", "lrm"))), STATS, EXACT, THRESHOLD, LR),
    "disputed": query(
        "SELECT sample, count(DISTINCT mates) AS n_versions FROM (" + " UNION ALL ".join(f"SELECT sample, mates FROM {n} JOIN (SELECT individual, list(sample ORDER BY sample) AS mates FROM {n} GROUP BY 1) USING (individual)" for n in ("exact", "thresh")) + ") GROUP BY sample HAVING count(DISTINCT mates) > 1",
        STATS, EXACT, THRESHOLD,
    ),
    "individual_consensus": query(
        "SELECT individual, locus, arg_min(gt, (-c, gt)) AS gt, sum(c)::BIGINT AS n_typed, count(*) AS n_versions FROM (SELECT individual, locus, gt, count(*) AS c FROM typed JOIN exact USING (sample) GROUP BY ALL) GROUP BY ALL", STATS, EXACT
    ),
    "discordance": query(
        "SELECT individual, locus, count(*) AS n_versions, string_agg(replace(gt, '/', '') || '(' || c || ')', ' ' ORDER BY c DESC, gt) AS versions FROM (SELECT individual, locus, gt, count(*) AS c FROM typed JOIN thresh USING (sample) GROUP BY ALL) GROUP BY ALL HAVING count(*) > 1",
        STATS, THRESHOLD,
    ),
    "attribute_conflicts": query(f"SELECT individual, count(DISTINCT value) AS n_values FROM thresh JOIN (SELECT event_id, {MARKER} AS value FROM events) ON sample = event_id GROUP BY ALL HAVING count(DISTINCT value) > 1", STATS, THRESHOLD),
    "positive_controls": query("SELECT user_id AS control, count(*) AS n_rows, count(DISTINCT individual) = 1 AS together FROM thresh JOIN events ON sample = event_id GROUP BY ALL", STATS, THRESHOLD),
    "rep_consensus": query("SELECT sample, locus, gt FROM rcall", REP_CONSENSUS),
    "genotype_likelihood": query("SELECT sample, locus, t, round(log10(lik), 6) AS log10_lik, n_obs FROM glik", GLIK),
    "lr_replicates": query("SELECT grp, n_compared, count(*) AS n_pairs, round(sum(same - full_sib), 4) AS lr_sum, round(max(same - full_sib), 6) AS lr_max FROM rp GROUP BY ALL", rep_pairs(("full_sib",))),
    "best_alternative_replicates": query(
        "SELECT CASE greatest(unrelated, full_sib, parent_offspring) WHEN unrelated THEN 'unrelated' WHEN full_sib THEN 'full_sib' ELSE 'parent_offspring' END AS best_alternative, count(*) AS n_pairs, count(*) FILTER (n_compared >= 15 AND same > greatest(unrelated, full_sib, parent_offspring)) AS n_matched FROM rp GROUP BY ALL",
        rep_pairs(ALTS),
    ),
    "replicate_errors": query("SELECT locus, n_het, n_dropout, n_hom, n_false FROM errs", ERRORS),
    "pooled_errors": query("SELECT round(sum(n_dropout) / greatest(1, sum(n_het)), 6) AS dropout, round(sum(n_false) / greatest(1, sum(n_hom)), 6) AS false_allele FROM errs", ERRORS),
    "heterozygote_deficit": query("SELECT round(greatest(0, 1 - sum(ho * n) / sum(he * n)), 6) AS dropout, count(*) AS n_loci FROM locus_stats WHERE n_alleles >= 2 AND he > 0.05", LOCUS),
    "ml_patterns": query("SELECT locus, pattern, count(*) AS n FROM (SELECT sample, locus, string_agg(gt, ' ' ORDER BY gt) AS pattern FROM reps WHERE gt IS NOT NULL GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL", SQL_REPS),
    "sensitivity_grid": sensitivity(),
    "separator_shares": query(
        f"SELECT sep, avg((len(string_split(raw, sep)) - ends_with(raw, sep)::INT = 2)::INT::DOUBLE) AS share FROM {WIDE}, (SELECT unnest(['/', '|', ':', '-', ' ']) AS sep) WHERE length(raw) > 0 GROUP BY sep"
    ),
    "locus_tests": query(
        """SELECT "column", n_filled, n_typed, n_genotypes, coalesce(n_alleles, 0) AS n_alleles, coalesce(n_filled > 0 AND NOT (n_text = 0 AND n_values > 12) AND n_typed / n_rows >= 0.05 AND n_genotypes BETWEEN 1 AND 60
          AND n_genotypes <= greatest(3.0, 0.5 * n_typed) AND n_alleles BETWEEN 2 AND 40 AND dna = 1, false) AS is_locus
        FROM (SELECT "column", count(*) FILTER (x <> '') AS n_filled, count(*) FILTER (x <> '' AND num IS NULL) AS n_text, count(DISTINCT num) AS n_values, count(*) AS n_rows, count(gt) AS n_typed, count(DISTINCT gt) AS n_genotypes FROM called GROUP BY 1)
        LEFT JOIN (SELECT "column", count(DISTINCT a) AS n_alleles, min((a IN ('A', 'C', 'G', 'T', 'N'))::INT) AS dna FROM (SELECT "column", unnest([substr(gt, 1, 1), substr(gt, 3, 1)]) AS a FROM called WHERE gt IS NOT NULL) GROUP BY 1) USING ("column")""",
        CALLED,
    ),
    "id_scores": query(
        """SELECT "column", round((count(DISTINCT raw) + max((raw IS NULL)::INT)) / count(*) - CASE WHEN count(raw) > 0 AND count(*) FILTER (raw IS NOT NULL AND try_cast(raw AS DOUBLE) IS NULL) = 0 THEN 1 ELSE 0 END
          + CASE WHEN regexp_matches("column", 'sample|specimen|individual|indiv|barcode|(^|[^a-z])id$|^id', 'i') THEN 2 ELSE 0 END, 6) AS score FROM called GROUP BY 1""",
        CALLED,
    ),
    "residual_error": query("SELECT round(dropout, 6) AS dropout, round(false_allele, 6) AS false_allele, round(missing_het, 6) AS missing_het, round(missing_hom, 6) AS missing_hom FROM res", ml_search(), RATES, residual("rate")),
    "ml_grid": query("SELECT point::BIGINT AS point, round(d, 9) AS d, round(f, 9) AS f, round(ll, 4) AS ll FROM gl0", ML_TERMS, f"z0 AS (SELECT {math.log(0.05 / 0.95)}::DOUBLE AS x, {math.log(0.01 / 0.99)}::DOUBLE AS y, 1.0::DOUBLE AS r)", grid_ll("gl0", _grid("x", "y", "r", "z0"))),
    "ml_error_rates": query(
        "SELECT round(d, 5) AS dropout, round(f, 5) AS false_allele, round(max(lo) FILTER (rate = 0), 6) AS dropout_lo, round(max(hi) FILTER (rate = 0), 6) AS dropout_hi, round(max(lo) FILTER (rate = 1), 6) AS false_lo, round(max(hi) FILTER (rate = 1), 6) AS false_hi FROM mlx, mle GROUP BY d, f",
        ml_search(), ml_profile(),
    ),
    "applied_errors": query(
        "SELECT 'replicates' AS method, (SELECT count(*) FROM (SELECT sample FROM reps GROUP BY sample HAVING count(DISTINCT rep) >= 2)) AS n_samples, true AS converted, round(greatest(dropout, 1e-4), 3) AS use_dropout, round(greatest(false_allele, 1e-4), 3) AS use_false_allele FROM res",
        *UNIQUE, UNIQUE_ML, RATES, residual("rate"),
    ),
    "complete_linkage": query("SELECT grp, samples.sample, grp || '_IND_' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0') AS individual FROM samples JOIN (SELECT sample, dense_rank() OVER (PARTITION BY grp ORDER BY cluster) AS n FROM thresh_full JOIN samples USING (sample)) USING (sample)", STATS, THRESHOLD, cliques("thresh")),
    "linkage_stability": query(
        "SELECT count(DISTINCT individual) AS n_single, (SELECT count(DISTINCT individual) FROM tfull) AS n_complete, (SELECT ari FROM (" + ARI.format(m1="s", m2="c", x="thresh", y="tfull") + ")) AS ari FROM thresh",
        STATS, THRESHOLD, cliques("thresh"), "tfull AS MATERIALIZED (SELECT sample, cluster AS individual FROM thresh_full)",
    ),
    "calibration_complete": query("SELECT round(cutoff, 6) AS cutoff, n_accepted, round(false_merges, 4) AS false_merges, round(missed, 4) AS missed, n_full AS n_individuals FROM cal JOIN calfull USING (cutoff)", calibration_complete()),
    "similarity_assignment": query(SIMILAR, similarity((2,))),
    "similarity_profile": query(PROFILE, similarity(tuple(range(7)))),
    "similarity_near_misses": query("SELECT DISTINCT grp, unnest([s1, s2]) AS sample FROM stats WHERE n_compared >= 15 AND n_mismatch = 1 + (SELECT arg_min(m, (c, m)) FROM (SELECT m, (SELECT count(*) FROM stats WHERE n_compared >= 15 AND n_mismatch = m + 1) AS c FROM (SELECT unnest(range(7)) AS m)))", STATS),
    "block_method": query("SELECT grp, sample, individual FROM exact", STATS, EXACT),
    "evidence_histogram": query("SELECT * FROM bars", LR, "ev AS (SELECT round(lr, 6) AS v, posterior >= 0.999 AS ok FROM post WHERE n_compared >= 15)", histogram("ev", "v", "ok")),
    "mismatch_bars": query("SELECT * FROM bars", STATS, "ev AS (SELECT n_mismatch AS v, n_mismatch <= 1 AND n_mismatch_2allele <= 0 AS ok FROM stats WHERE n_compared >= 15)", histogram("ev", "v", "ok", "1.0::DOUBLE")),
    "margin_strip": query(
        "SELECT status, floor(m * 4 + 1e-9)::BIGINT AS step, count(*) AS n_samples, round(min(m), 6) AS lowest, round(max(m), 6) AS highest FROM (SELECT status, log10(greatest(margin, 1e-6)) AS m FROM conf WHERE margin IS NOT NULL) GROUP BY ALL", CONF
    ),
    "quality_report": query(
        f"""SELECT *, (SELECT count(*) - count(DISTINCT CASE WHEN event_id % 90 = 1 THEN event_id - 1 ELSE event_id END) FROM events) AS n_duplicated_ids,
          (SELECT count(DISTINCT locus) FROM panel) - (SELECT count(DISTINCT locus) FROM fpanel) AS n_dropped_loci, (SELECT count(DISTINCT sample) FROM panel) - (SELECT count(DISTINCT sample) FROM fpanel) AS n_dropped_samples,
          (SELECT count(*) FROM (SELECT locus, min(c) / sum(c) AS maf FROM (SELECT locus, a, count(*) AS c FROM (SELECT locus, unnest([split_part(gt, '/', 1), split_part(gt, '/', 2)]) AS a FROM fpanel WHERE gt IS NOT NULL) GROUP BY ALL) GROUP BY locus) WHERE maf < 0.05) AS n_rare_loci
        FROM (SELECT count(*) AS n_cells, count(*) FILTER (x = '00') AS n_missing, count(*) FILTER (x <> '00' AND x[1] > x[2]) AS n_reordered, count(*) FILTER (raw LIKE '%*%') AS n_flagged FROM (SELECT raw, replace(raw, '*', '') AS x FROM {WIDE}))""",
        "fl AS (SELECT locus FROM panel GROUP BY locus HAVING count(gt) / count(*) >= 0.925)", "fs AS (SELECT sample FROM panel WHERE locus IN (SELECT locus FROM fl) GROUP BY sample HAVING count(gt) / count(*) >= 0.9)",
        "fpanel AS MATERIALIZED (SELECT * FROM panel WHERE locus IN (SELECT locus FROM fl) AND sample IN (SELECT sample FROM fs))",
    ),
    "ld_top": query(f"SELECT locus1, locus2, n, round(r2, 6) AS r2 FROM ld ORDER BY round(r2, 6) DESC, locus1, locus2 LIMIT 25", *linkage()),
    "ld_flagged": query(f"SELECT locus1, locus2, n, round(r2, 6) AS r2 FROM ld WHERE r2 > 0.01", *UNIQUE, *linkage("upanel")),
    "fis_flagged": query("SELECT locus, round(1 - ho / he, 6) AS fis FROM locus_stats WHERE abs(1 - ho / he) > 0.1", *UNIQUE, _of(LOCUS, "upanel")),
    "same_amplicon": query("SELECT locus1, locus2, n, round(r2, 6) AS r2 FROM ld WHERE replace(locus1, 'SNP2', '') = replace(locus2, 'SNP2', '')", AMPLICONS, *linkage("apanel")),
    "pid_pruned": query(
        "SELECT locus, row_number() OVER w AS n_loci, round(sum(log10(pid)) OVER w, 6) AS log10_cum_pid, round(sum(log10(pid_sib)) OVER w, 6) AS log10_cum_pid_sib FROM power WHERE NOT ends_with(locus, 'SNP2') WINDOW w AS (ORDER BY pid, locus ROWS UNBOUNDED PRECEDING)",
        AMPLICONS, _of(POWER, "apanel"),
    ),
    "dead_loci": query("SELECT locus, n_alleles, round(call_rate, 6) AS call_rate FROM locus_stats WHERE n_alleles < 2 OR call_rate < 0.9246", LOCUS),
    "lr_top": query("SELECT grp, s1 AS id1, s2 AS id2, n_compared, round(lr, 6) AS lr FROM lr ORDER BY round(lr, 6) DESC, s1, s2 LIMIT 200", LR),
    "near_table": query("SELECT grp, s1 AS id1, s2 AS id2, n_compared, n_mismatch FROM stats WHERE n_compared >= 15 AND n_mismatch BETWEEN 1 AND 2 ORDER BY n_mismatch, n_compared DESC, s1, s2", STATS),
    "final_assignments": query(
        "SELECT a.grp, a.sample, individual, round(call_rate, 6) AS call_rate, round(l, 6) AS log10_pid_sib, n AS n_samples_for_individual FROM lrm a JOIN (SELECT individual, count(*) AS n FROM lrm GROUP BY 1) USING (individual) "
        "JOIN (SELECT sample, count(gt) / count(*) AS call_rate FROM panel GROUP BY sample) c ON c.sample = a.sample JOIN spow p ON p.sample = a.sample ORDER BY n DESC, individual, call_rate DESC, a.sample",
        CONF,
    ),
    "roster_table": query(
        "SELECT grp, individual, count(*) AS n_samples, round(min(margin), 6) AS weakest_margin, arg_min(status, (coalesce(margin, -1), sample)) AS weakest_status, string_agg(sample::VARCHAR, ', ' ORDER BY sample) AS members FROM conf GROUP BY ALL ORDER BY n_samples DESC, weakest_margin, individual", CONF
    ),
    "review_table": query(
        "SELECT sample, individual, status, list_position(['Uncertain', 'Check', 'Underpowered', 'Confident'], status) AS status_rank, round(margin, 6) AS margin FROM conf ORDER BY status_rank, margin, individual, sample", CONF
    ),
    "plateau": _sweep(outer="SELECT coalesce(max(k) FILTER (n_individuals = was AND n_conflicting = 0), 1) AS k FROM (SELECT *, lag(n_individuals) OVER (ORDER BY k) AS was FROM swept)"),
    "power_ceiling": query(
        "SELECT grp, round(t, 5) AS max_lr_theoretical, round(max_lr, 5) AS max_lr, round(coalesce(max_posterior, 0), 9) AS max_posterior, coalesce(max_posterior, 0) >= 0.999 AS reachable FROM (SELECT grp, sum(m) AS t FROM (SELECT grp, locus, max(same - full_sib) AS m FROM tabs GROUP BY ALL) GROUP BY grp) "
        "LEFT JOIN (SELECT grp, max(lr) AS max_lr, max(posterior) AS max_posterior FROM post WHERE n_compared >= 15 GROUP BY grp) USING (grp)",
        LR,
    ),
    "allele_freq_corrected": query(
        "SELECT grp, locus, allele, round(sum(1 / c) / sum(sum(1 / c)) OVER (PARTITION BY grp, locus), 6) AS p FROM alleles JOIN lrm USING (grp, sample) JOIN (SELECT individual, count(*) AS c FROM lrm GROUP BY 1) USING (individual) GROUP BY grp, locus, allele", LR
    ),
    "controls_named": query(
        " UNION ALL ".join(f"SELECT '{m}' AS method, count(*) AS n_rows, count(DISTINCT individual) = 1 AS same_individual FROM {x} WHERE contains(sample::VARCHAR, '77')" for m, x in (("exact", "exact"), ("threshold", "thresh"))), STATS, EXACT, THRESHOLD
    ),
    "species_calls": f"WITH {SQL_VOTES} SELECT sample, coalesce(arg_min(vote, (-c, vote)) FILTER (vote IN ('wolf', 'coyote')), 'unknown') AS call FROM (SELECT sample, vote, count(*) AS c FROM votes GROUP BY ALL) GROUP BY sample",
    "het_share": query("SELECT sample, round(avg((split_part(gt, '/', 1) <> split_part(gt, '/', 2))::INT), 6) AS het_share FROM panel GROUP BY sample"),
    "mismatch_scores": query("SELECT grp, n_mismatch, count(*) AS n_pairs, round(max(1 - n_mismatch / top), 6) AS score FROM stats JOIN (SELECT grp, greatest(1, max(n_mismatch)) AS top FROM stats GROUP BY grp) USING (grp) WHERE n_mismatch <= 1 GROUP BY grp, n_mismatch", STATS),
    "error_from_deficit": query(
        "SELECT n_samples, round(d, 6) AS dropout, round(d, 3) AS use_dropout, greatest(0.001, round(d / 3, 3)) AS use_false_allele FROM (SELECT greatest(0, 1 - sum(ho * n) / sum(he * n)) AS d, (SELECT count(DISTINCT sample) FROM upanel) AS n_samples FROM locus_stats WHERE n_alleles >= 2 AND he > 0.05)", *UNIQUE, _of(LOCUS, "upanel")
    ),
    "simulation_means": f"WITH {SQL_RUNS} SELECT n_loci, dropout, count(*) AS n_runs, round(avg(cons_ari), 6) AS cons_ari, round(avg(reps_ari), 6) AS reps_ari FROM runs GROUP BY ALL",
    "paired_t": f"WITH {SQL_RUNS} SELECT count(*) AS n, round(avg(d), 6) AS mean_gain, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, count(*) - 1 AS df FROM (SELECT reps_ari - cons_ari AS d FROM runs) WHERE d IS NOT NULL",
    "separation": query(
        "SELECT round(avg(lr) FILTER (same), 5) AS mean_same, round(quantile_cont(lr, 0.999) FILTER (NOT same), 5) AS high_different, round(min(lr) FILTER (same) - quantile_cont(lr, 0.999) FILTER (NOT same), 5) AS margin FROM (SELECT lr, x.user_id = y.user_id AS same FROM post JOIN events x ON x.event_id = s1 JOIN events y ON y.event_id = s2 WHERE n_compared >= 15)",
        LR,
    ),
}
