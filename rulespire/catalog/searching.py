"""Split search queries: all families over the joint histograms of whole tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Window as W, functions as F

from rulespire.catalog.base import (
    CUT_FEATURES, CUTS, cut_bin, cut_bin_sql, cut_value, cut_value_sql, gain_sql, line_cte, line_rows, line_wide, load, penalized_sql, query, rounded, rsql,
)
from rulespire.config import for_width
from rulespire.functions.rules import AFFINE, ANTIHORN, CONJUI, HORN, SQUARE2CNF, Literal, Rule
from rulespire.functions.scores import information_gain
from rulespire.operators import binning as B
from rulespire.operators import histograms as H
from rulespire.operators import search as X
from rulespire.sources.tables import LINE_FEATURES
from rulespire.operators.profile import unpivot
from rulespire.operators.wide import exact_wide_pairs

MIN_LEAF = 20
AXES = ["bi", "bj", "bk"]
NAMES = ["fi", "fj", "fk"]


# --- regions: Spark and SQL ------------------------------------------------------------------


#: Keys whose cells a task holds at once.
KEYS_A_TASK = 500


def key_parts(df, keys):
    """Partitions for the cells of all keys, in proportion to their number; None where the default will do."""
    n = df.agg(F.approx_count_distinct(F.struct(*keys))).first()[0] if keys else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // KEYS_A_TASK)) if n > KEYS_A_TASK else None


def tuple_cells(df, arity, keys=(), feats=CUT_FEATURES):
    """Joint class counts of every feature tuple in one job."""
    binned = df.select("y", *keys, *[cut_bin(f).alias(f) for f in feats])
    parts = key_parts(df, keys)
    if parts:  # many keys: few rows share all bins, so they are placed before they are counted
        binned = binned.repartition(parts, *keys, *feats)
    packed = H.class_counts(binned, [*keys, *feats])
    if parts:  # a key has at most as many cells as there are bins, however many rows
        packed = packed.repartition(parts, *keys)
    entry = F.array(*[
        F.struct(*[F.lit(f).alias(n) for n, f in zip(NAMES, t)], *[F.col(f).alias(a) for a, f in zip(AXES, t)])
        for t in combinations(feats, arity)])
    long = packed.select(*keys, "pos", "neg", F.inline(entry))
    by = [*keys, *NAMES[:arity], *AXES[:arity]]
    return long.groupBy(*by).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def scored_tuples(df, arity, families, step=1, keys=()):
    names, axes = NAMES[:arity], AXES[:arity]
    allowed = X.regions_for(set(families), arity)
    r = X.region_counts(tuple_cells(df, arity, keys), [*keys, *names], axes, step, allowed)
    return X.score_counts(r, arity, MIN_LEAF)


def best_tuples(df, arity, family, step=1, keys=()):
    """Best rule of a family for every feature tuple, written with its thresholds."""
    names, axes = NAMES[:arity], AXES[:arity]
    combine = {CONJUI: "and", AFFINE: "xor"}.get(family, "or")
    best = X.best_per(scored_tuples(df, arity, [family], step, keys), [*keys, *names], ["region", *axes], digits=9)
    polarity = F.lit("GE" + ",GE" * (arity - 1)) if combine == "xor" else X.polarity_text(F.col("region"), combine)
    out = best.select(*keys, *names, polarity.alias("polarity"), *[cut_value(F.col(n), F.col(a)).alias(f"t_{n}") for n, a in zip(names, axes)],
                      "ip", "ineg", "gain", "score")
    return rounded(out, "gain", "score")


def cells_sql(task, arity, keys=()):
    """CTEs s, b, c: cells of all tuples."""
    parts = []
    kk = "".join(f"{k}, " for k in keys)
    for t in combinations(CUT_FEATURES, arity):
        cols = ", ".join(f"'{f}' AS {n}" for n, f in zip(NAMES, t)) + ", " + ", ".join(f"b_{f} AS {a}" for a, f in zip(AXES, t))
        by = ", ".join([*keys, *[f"b_{f}" for f in t]])
        parts.append(f"SELECT {kk}{cols}, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM b GROUP BY {by}")
    bins = ", ".join(f"{cut_bin_sql(f)} AS b_{f}" for f in CUT_FEATURES)
    return f"{line_cte(task)}, b AS (SELECT y, {kk}{bins} FROM s), c AS ({' UNION ALL '.join(parts)})"


def regions_sql(task, arity, families, step=1, keys=()):
    """CTE chain ending in r: brute-force region counts for every cut combination."""
    names, axes = NAMES[:arity], AXES[:arity]
    cuts = ["ti", "tj", "tk"][:arity]
    size = "(CASE {0} WHEN 'q' THEN 9 WHEN 'd' THEN 10 WHEN 't' THEN 8 ELSE 10 END)"
    on = " AND ".join(f"{g} <= {size.format(n)}" + (f" AND {g} % {step} = 0" if step > 1 else "") for g, n in zip(cuts, names))
    grid = ", ".join(f"range(1, 11) g{g}({g})" for g in cuts)
    pieces = []
    for region in X.regions_for(set(families), arity):
        if region == "X":
            cond = "(" + " + ".join(f"({a} >= {g})::INT" for a, g in zip(axes, cuts)) + ") % 2 = 1"
        else:
            cond = " AND ".join(f"{a} {'<' if s == 'L' else '>='} {g}" for a, g, s in zip(axes, cuts, region))
        pieces.append((region, cond))
    kk = "".join(f"{k}, " for k in keys)
    head = f"{kk}{', '.join(names)}, {', '.join(cuts)}"
    wide = ", ".join(f"sum(CASE WHEN {cond} THEN pos ELSE 0 END) AS p{i}, sum(CASE WHEN {cond} THEN neg ELSE 0 END) AS n{i}" for i, (_, cond) in enumerate(pieces))
    tall = " UNION ALL ".join(f"SELECT {head}, '{region}' AS region, p{i} AS ip, n{i} AS ineg, tp, tn FROM w" for i, (region, _) in enumerate(pieces))
    gain = gain_sql("tp", "tn", "ip", "ineg")
    return f"""{cells_sql(task, arity, keys)}, w AS (SELECT {head}, {wide}, sum(pos) AS tp, sum(neg) AS tn FROM c, {grid} WHERE {on} GROUP BY {head}), r0 AS ({tall}),
      r1 AS (SELECT *, {gain} AS gain FROM r0 WHERE ip + ineg >= {MIN_LEAF} AND tp + tn - ip - ineg >= {MIN_LEAF}),
      r AS (SELECT * FROM (SELECT *, {penalized_sql('gain', str(arity), '(tp+tn)')} AS score FROM r1) WHERE score > 0)"""


def best_sql(task, arity, family, step=1, keys=()):
    names, cuts = NAMES[:arity], ["ti", "tj", "tk"][:arity]
    combine = {CONJUI: "and", AFFINE: "xor"}.get(family, "or")
    hi, lo = ("GE", "LT") if combine == "and" else ("LT", "GE")
    if combine == "xor":
        pol = "'" + "GE" + ",GE" * (arity - 1) + "'"
    else:
        pol = " || ',' || ".join(f"(CASE substr(region, {i + 1}, 1) WHEN 'H' THEN '{hi}' ELSE '{lo}' END)" for i in range(arity))
    part = ", ".join([*keys, *names])
    kk = "".join(f"{k}, " for k in keys)
    cols = ", ".join(f"{cut_value_sql(n, g)} AS t_{n}" for n, g in zip(names, cuts))
    return f"""WITH {regions_sql(task, arity, [family], step, keys)}, m AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY round(score, 9) DESC, region, {', '.join(cuts)}) AS rn FROM r)
      SELECT {kk}{', '.join(names)}, {pol} AS polarity, {cols}, ip, ineg, {rsql('gain')} AS gain, {rsql('score')} AS score FROM m WHERE rn = 1"""


# --- SEA1: single tests -------------------------------------------------------------------------


@query("sea1_best_single", best_sql("returns", 1, CONJUI, keys=("supp",)))
def sea1(spark, sf):
    return best_tuples(line_wide(spark, sf, "returns"), 1, CONJUI, keys=("supp",))


# --- SEA2 - SEA9: pairs and triples of every family ----------------------------------------------


def _register(name, task, arity, family, step=1, keys=()):
    def run(spark, sf):
        return best_tuples(line_wide(spark, sf, task), arity, family, step, keys)
    query(name, best_sql(task, arity, family, step, keys))(run)


_register("sea2_best_horn_pair", "or2", 2, HORN, keys=("rf",))
_register("sea3_best_horn_triple", "cnf4", 3, HORN)
_register("sea4_best_antihorn_pair", "cnf4", 2, ANTIHORN, keys=("rf",))
_register("sea5_best_antihorn_triple", "cnf4", 3, ANTIHORN)
_register("sea6_best_conjui_pair", "and2", 2, CONJUI, keys=("rf",))
_register("sea7_best_conjui_triple", "and2", 3, CONJUI)
_register("sea8_best_xor_pair", "xor2", 2, AFFINE, keys=("rf",))
_register("sea9_best_xor_triple", "xor2", 3, AFFINE)
_register("sea16_step_grid_triple", "cnf4", 3, HORN, step=2)


# --- SEA10, SEA11: two-clause rules ----------------------------------------------------------------


@query("sea10_cnf_literals", f"""WITH {line_cte('cnf4')}, l AS ({' UNION ALL '.join(f"SELECT rf, '{f}' AS feature, {f} AS value FROM s" for f in CUT_FEATURES)}),
    e AS (SELECT rf, feature, list_sort(list_distinct(quantile_cont(value, {[i / 24 for i in range(25)]!r}::DOUBLE[]))) AS e FROM l GROUP BY 1, 2),
    k AS (SELECT rf, feature, e, len(e) - 1 AS nb, greatest(1, (len(e) - 1) // 8) AS step FROM e)
    SELECT rf, feature, i::INT AS i, op, {rsql('e[i + 1]')} AS threshold FROM k, range(1, 25) g(i), (VALUES ('GE'), ('LT')) o(op) WHERE i < nb AND i % step = 0""")
def sea10(spark, sf):
    long = unpivot(line_wide(spark, sf, "cnf4"), CUT_FEATURES, ["rf"])
    e = B.quantile_edges(long, ["rf", "feature"], 24).withColumn("e", F.array_sort(F.array_distinct("edges")))
    step = F.greatest(F.lit(1), F.floor((F.size("e") - 1) / 8)).cast("int")
    at = F.explode(F.filter(F.sequence(F.lit(1), F.size("e") - 2), lambda i: i % step == 0)).alias("i")
    out = e.select("rf", "feature", "e", at).select("rf", "feature", "i", F.explode(F.array(F.lit("GE"), F.lit("LT"))).alias("op"), F.get("e", F.col("i")).alias("threshold"))
    return rounded(out, "threshold")


CNF_CUTS = {"q": [15.0, 25.0, 35.0], "d": [0.03, 0.05, 0.08], "t": [0.02, 0.04, 0.06], "p": [30000.0, 50000.0, 70000.0]}
_FEATS = list(CNF_CUTS)
_LITS = [(f, op, i + 1) for f in _FEATS for i in range(3) for op in ("GE", "LT")]
_CLAUSES = [(a, b) for a in range(len(_LITS)) for b in range(a + 1, len(_LITS)) if _LITS[a][0] != _LITS[b][0]]


def _lit_sql(k):
    f, op, i = _LITS[k]
    return f"{f} >= {i}" if op == "GE" else f"{f} < {i}"


def clause_text(c):
    return "|".join(f"{f}{'>=' if op == 'GE' else '<'}{CNF_CUTS[f][i - 1]:g}" for f, op, i in (_LITS[k] for k in c))


_CLAUSE_ROWS = ", ".join(f"({n}, '{clause_text(c)}', '{'/'.join(sorted({_LITS[k][0] for k in c}))}')" for n, c in enumerate(_CLAUSES))
CNF_SQL = f"""{line_cte('cnf4')}, cells AS (SELECT {', '.join(f'{cut_bin_sql(f, CNF_CUTS[f])} AS {f}' for f in _FEATS)}, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM s GROUP BY ALL),
    names(id, txt, fs) AS (VALUES {_CLAUSE_ROWS}), hit AS ({' UNION ALL '.join(f"SELECT {n} AS id, q, d, t, p, pos, neg FROM cells WHERE {_lit_sql(a)} OR {_lit_sql(b)}" for n, (a, b) in enumerate(_CLAUSES))}),
    tot AS (SELECT sum(pos) AS tp, sum(neg) AS tn FROM cells), cl AS (SELECT id, sum(pos) AS ip, sum(neg) AS ineg FROM hit GROUP BY 1),
    cs AS (SELECT id, {penalized_sql(gain_sql('tp', 'tn', 'ip', 'ineg'), '1', '(tp+tn)')} AS score FROM cl, tot),
    top AS (SELECT id, txt, fs, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 AS rk FROM cs JOIN names USING (id) WHERE score > 0),
    pr AS (SELECT a.id AS ia, b.id AS ib, a.txt AS ta, b.txt AS tb, row_number() OVER (ORDER BY a.rk + b.rk, a.rk) AS r FROM top a JOIN top b ON a.rk < b.rk AND a.fs <> b.fs QUALIFY r <= 500),
    n AS (SELECT ia, ib, ta, tb, sum(x.pos) AS ip, sum(x.neg) AS ineg FROM pr JOIN hit x ON x.id = ia JOIN hit z ON z.id = ib AND z.q = x.q AND z.d = x.d AND z.t = x.t AND z.p = x.p GROUP BY ALL),
    g AS (SELECT *, {gain_sql('tp', 'tn', 'ip', 'ineg')} AS gain, tp + tn AS nn FROM n, tot)"""


@query("sea11_best_cnf", f"""WITH {CNF_SQL} SELECT ta || ' & ' || tb AS rule, ip, ineg, {rsql('gain')} AS gain, {rsql(penalized_sql('gain', '2', 'nn'))} AS score FROM g WHERE {penalized_sql('gain', '2', 'nn')} > 0""")
def sea11(spark, sf):
    """Clauses ranked by their own gain, the first 500 pairs on other feature sets."""
    df = line_rows(spark, sf, "cnf4")
    cells = H.class_counts(df.select("y", *[cut_bin(f, CNF_CUTS[f]).alias(f) for f in _FEATS]), _FEATS)  # at most 4^4 cells
    lit = [F.col(f) >= i if op == "GE" else F.col(f) < i for f, op, i in _LITS]
    truths = F.array(*[F.struct(F.lit(n).alias("id"), F.lit(clause_text(c)).alias("txt"), F.lit("/".join(sorted({_LITS[k][0] for k in c}))).alias("fs"), (lit[c[0]] | lit[c[1]]).alias("on")) for n, c in enumerate(_CLAUSES)])
    rows = cells.withColumn("k", F.lit(0))
    tot = rows.groupBy("k").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("tn"))
    hit = rows.select("k", F.struct(*_FEATS).alias("cell"), "pos", "neg", F.inline(truths)).filter("on")
    counts = hit.groupBy("k", "id", "txt", "fs").agg(F.sum("pos").alias("ip"), F.sum("neg").alias("ineg")).join(tot, "k")
    scored = X.score_counts(counts, 1, 1)
    top = scored.withColumn("rk", F.row_number().over(W.partitionBy("k").orderBy(F.desc(F.round("score", 9)), "id")) - 1)
    a = top.select("k", *[F.col(c).alias(f"{c}_a") for c in ("id", "txt", "fs", "rk")])
    b = top.select("k", *[F.col(c).alias(f"{c}_b") for c in ("id", "txt", "fs", "rk")])
    pairs = a.join(b, "k").filter((F.col("rk_a") < F.col("rk_b")) & (F.col("fs_a") != F.col("fs_b")))  # clauses of the fixed cuts
    pairs = pairs.withColumn("r", F.row_number().over(W.partitionBy("k").orderBy(F.col("rk_a") + F.col("rk_b"), "rk_a"))).filter("r <= 500")
    hits_a = hit.select(F.col("id").alias("id_a"), "cell", "pos", "neg")
    hits_b = hit.select(F.col("id").alias("id_b"), "cell")
    n = pairs.join(hits_a, "id_a").join(hits_b, ["id_b", "cell"]).groupBy("k", "txt_a", "txt_b").agg(F.sum("pos").alias("ip"), F.sum("neg").alias("ineg"))
    best = X.score_counts(n.join(tot, "k"), 2, 1)
    out = best.select(F.concat("txt_a", F.lit(" & "), "txt_b").alias("rule"), "ip", "ineg", "gain", "score", "txt_a", "txt_b")
    return rounded(out.drop("txt_a", "txt_b"), "gain", "score")


# --- SEA12 - SEA15: comparisons and candidates -------------------------------------------------------

_CMP = [("q", "ln"), ("d", "t"), ("q", "d"), ("ln", "t")]


@query("sea12_compare_split", f"WITH {line_cte()}, c AS ({' UNION ALL '.join(f'SELECT rf, {chr(39)}{a}{chr(39)} AS fi, {chr(39)}{b}{chr(39)} AS fj, y, {a} <= {b} AS le FROM s' for a, b in _CMP)}), n AS (SELECT rf, fi, fj, sum(y)::DOUBLE AS tp, sum(1-y)::DOUBLE AS tn, sum(CASE WHEN le THEN y ELSE 0 END)::DOUBLE AS ip, sum(CASE WHEN le THEN 1-y ELSE 0 END)::DOUBLE AS ineg FROM c GROUP BY 1, 2, 3) SELECT rf, fi, fj, ip, ineg, {rsql(gain_sql('tp', 'tn', 'ip', 'ineg'))} AS gain FROM n")
def sea12(spark, sf):
    c = X.compare_counts(line_wide(spark, sf), _CMP, ["rf"])
    return rounded(c.select("rf", "fi", "fj", "ip", "ineg", information_gain(*[F.col(x) for x in ("tp", "tn", "ip", "ineg")]).alias("gain")), "gain")


SCORES_SQL = f"""sc AS (SELECT l_suppkey AS node, p_brand AS feature, round(avg(l_quantity), 6) AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    rk AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, feature) AS r FROM sc)"""


def brand_scores(spark, sf):
    """(node = supplier, feature = brand, score): a feature-score table from the data."""
    j = load(spark, sf, "lineitem").join(load(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("l_suppkey").alias("node"), F.col("p_brand").alias("feature")).agg(F.round(F.avg("l_quantity"), 6).alias("score"))


def ranked_brands(spark, sf):
    # one row per (node, feature): windows see feature lists, never rows
    return brand_scores(spark, sf).withColumn("r", F.row_number().over(W.partitionBy("node").orderBy(F.desc("score"), "feature")))


@query("sea13_top_features", f"WITH {SCORES_SQL} SELECT node, feature, r::INT AS r, score FROM rk WHERE r <= 15")
def sea13(spark, sf):
    return ranked_brands(spark, sf).filter("r <= 15")


PAIRS_SQL = "pr AS (SELECT a.node, least(a.feature, b.feature) AS fi, greatest(a.feature, b.feature) AS fj FROM rk a JOIN rk b ON a.node = b.node AND a.r < b.r AND b.r <= 10)"


def candidate_pairs(spark, sf, limit=10):
    """Combinations of the first ``limit`` features of each node, built inside one row per node."""
    top = ranked_brands(spark, sf).filter(F.col("r") <= limit).groupBy("node").agg(F.sort_array(F.collect_list("feature")).alias("fs"))
    pairs = F.flatten(F.transform("fs", lambda a: F.transform(F.filter("fs", lambda b: b > a), lambda b: F.struct(a.alias("fi"), b.alias("fj")))))
    return top.select("node", F.inline(pairs))


@query("sea14_candidate_pairs", f"WITH {SCORES_SQL}, {PAIRS_SQL} SELECT node, fi, fj FROM pr")
def sea14(spark, sf):
    return candidate_pairs(spark, sf)


@query("sea15_extra_pairs", f"""WITH {SCORES_SQL}, {PAIRS_SQL}, ex AS (SELECT DISTINCT l_suppkey AS node, least(a.p_brand, b.p_brand) AS fi, greatest(a.p_brand, b.p_brand) AS fj FROM lineitem JOIN part a ON l_partkey = a.p_partkey JOIN part b ON b.p_partkey = l_partkey + 1 WHERE a.p_brand <> b.p_brand)
    SELECT node, fi, fj, false AS extra FROM pr UNION ALL SELECT node, fi, fj, true FROM ex ANTI JOIN pr USING (node, fi, fj)""")
def sea15(spark, sf):
    base = candidate_pairs(spark, sf)
    p = load(spark, sf, "part")
    a = p.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ba"))
    b = p.select((F.col("p_partkey") - 1).alias("l_partkey"), F.col("p_brand").alias("bb"))
    extra = load(spark, sf, "lineitem").join(a, "l_partkey").join(b, "l_partkey").filter("ba <> bb").select(
        F.col("l_suppkey").alias("node"), F.least("ba", "bb").alias("fi"), F.greatest("ba", "bb").alias("fj")).distinct()
    return base.withColumn("extra", F.lit(False)).unionByName(extra.join(base, ["node", "fi", "fj"], "left_anti").withColumn("extra", F.lit(True)))


# --- SEA17 - SEA20 ----------------------------------------------------------------------------------


@query("sea17_width_settings", """WITH w AS (SELECT doc_id, len(regexp_split_to_array(trim(text), '\\s+')) AS d, len(list_distinct(regexp_split_to_array(trim(text), '\\s+'))) AS k FROM documents),
    c AS (SELECT doc_id, k, CASE WHEN d > 500 THEN 16 WHEN d > 100 THEN 32 ELSE 64 END AS nb, d <= 50 AS s3, CASE WHEN d > 500 THEN 10 WHEN d > 100 THEN 12 ELSE 15 END AS top_k FROM w)
    SELECT doc_id, (CASE WHEN k <= 3 THEN least(nb, 8) ELSE nb END)::INT AS n_bins, s3 AS search_3d, top_k::INT AS top_k FROM c""")
def sea17(spark, sf):
    """Settings of every table in a catalogue (width = words of a document)."""
    words = F.split(F.trim("text"), "\\s+")
    w = load(spark, sf, "documents").select("doc_id", F.size(words).alias("d"), F.size(F.array_distinct(words)).alias("k"))
    out = None
    for low, width in ((500, 501), (100, 101), (50, 51), (-1, 1)):
        few, many = for_width(width, 2), for_width(width)
        cfg = F.struct(F.when(F.col("k") <= 3, few.n_bins).otherwise(many.n_bins).alias("n_bins"), F.lit(many.search_3d).alias("search_3d"), F.lit(many.top_k).alias("top_k"))
        out = F.when(F.col("d") > low, cfg) if out is None else out.when(F.col("d") > low, cfg)
    return w.select("doc_id", out.alias("c")).select("doc_id", "c.*")


_ROUTES = [("Horn", False), ("AntiHorn", False), ("Affine", False), ("ConjUI", False), ("BestPerNode", False), ("BestPerNode", True), ("Any", False)]


# which families are searched, and which regions each can write: OR rules name the outside of a region, so one L is one GE (Horn), one H one LT (AntiHorn)
ROUTE_SQL = """searched(requested, family) AS (VALUES ('Horn', 'Horn'), ('AntiHorn', 'AntiHorn'), ('Affine', 'Affine'), ('ConjUI', 'ConjUI'),
      ('BestPerNode', 'Horn'), ('BestPerNode', 'AntiHorn'), ('BestPerNode', 'ConjUI'), ('BestPerNode+', 'Horn'), ('BestPerNode+', 'AntiHorn'), ('BestPerNode+', 'ConjUI'), ('BestPerNode+', 'Affine'),
      ('Any', 'Horn'), ('Any', 'AntiHorn'), ('Any', 'ConjUI'), ('Any', 'Affine')),
    route AS (SELECT requested, region, family FROM searched, (VALUES ('LL'), ('LH'), ('HL'), ('HH'), ('X')) g(region)
      WHERE CASE family WHEN 'Affine' THEN region = 'X' WHEN 'Horn' THEN region IN ('HH', 'HL', 'LH') WHEN 'AntiHorn' THEN region IN ('LL', 'HL', 'LH') ELSE region <> 'X' END)"""


@query("sea18_family_routing", f"""WITH {regions_sql('cnf4', 2, [HORN, ANTIHORN, CONJUI, AFFINE])}, {ROUTE_SQL},
    m AS (SELECT requested, family, max(round(score, 6)) + 0.0 AS best, count(*) AS n FROM r JOIN route USING (region) GROUP BY 1, 2) SELECT * FROM m""")
def sea18(spark, sf):
    scored = scored_tuples(line_rows(spark, sf, "cnf4"), 2, [HORN, ANTIHORN, CONJUI, AFFINE])
    table = []
    for fam, aff in _ROUTES:
        active = X.searched_families(fam, aff)
        table += [(fam + ("+" if aff else ""), region, form) for region in X.regions_of(2) for form, _ in X.forms(region) if form in active]
    route = F.broadcast(spark.createDataFrame(table, "requested string, region string, family string"))  # fixed size
    return scored.join(route, "region").groupBy("requested", "family").agg((F.max(F.round("score", 6)) + 0.0).alias("best"), F.count(F.lit(1)).alias("n"))


@query("sea19_min_leaf_filter", f"WITH {regions_sql('or2', 2, [CONJUI], keys=('supp',))} SELECT supp, fi, fj, count(*) AS n_kept, min(ip + ineg) AS least_inside, max(ip + ineg) AS most_inside FROM r GROUP BY 1, 2, 3")
def sea19(spark, sf):
    s = scored_tuples(line_wide(spark, sf), 2, [CONJUI], keys=("supp",))
    return s.groupBy("supp", "fi", "fj").agg(F.count(F.lit(1)).alias("n_kept"), F.min(F.col("ip") + F.col("ineg")).alias("least_inside"), F.max(F.col("ip") + F.col("ineg")).alias("most_inside"))


def _winner_sql():
    one, two = regions_sql("cnf4", 1, [CONJUI], keys=("rf",)), regions_sql("cnf4", 2, [HORN, ANTIHORN, CONJUI, AFFINE], keys=("rf",))
    strip = lambda q, tag: q.replace(line_cte("cnf4") + ", ", "").replace("b AS (SELECT y", f"b{tag} AS (SELECT y").replace("FROM b GROUP", f"FROM b{tag} GROUP").replace(" c AS (", f" c{tag} AS (").replace("FROM c,", f"FROM c{tag},").replace("w AS (SELECT", f"w{tag} AS (SELECT").replace("FROM w ", f"FROM w{tag} ").replace("FROM w)", f"FROM w{tag})").replace("r0 AS", f"r0{tag} AS").replace("FROM r0 ", f"FROM r0{tag} ").replace("r1 AS", f"r1{tag} AS").replace("FROM r1)", f"FROM r1{tag})").replace(" r AS (", f" r{tag}x AS (")
    return f"""WITH {line_cte('cnf4')}, {strip(one, "1")}, {strip(two, "2")},
      u AS (SELECT rf, 1 AS arity, region, fi, '' AS fj, ti, 0 AS tj, ip, ineg, score FROM r1x WHERE region = 'L' UNION ALL SELECT rf, 2, region, fi, fj, ti, tj, ip, ineg, score FROM r2x),
      f AS (SELECT *, CASE WHEN arity = 1 OR region = 'HH' OR region IN ('LH', 'HL') THEN 'Horn' WHEN region = 'LL' THEN 'AntiHorn' ELSE 'Affine' END AS family,
        CASE WHEN arity = 1 OR region IN ('HH', 'LH', 'HL') THEN 0 WHEN region = 'LL' THEN 1 ELSE 3 END AS rank_ FROM u),
      m AS (SELECT *, row_number() OVER (PARTITION BY rf ORDER BY round(score, 9) DESC, arity, rank_, fi, fj, region, ti, tj) AS rn FROM f)
      SELECT rf, rn::INT AS place, arity::INT AS arity, family, region, fi, fj, {rsql('score')} AS score FROM m WHERE rn <= 10"""


def ranked_rules(spark, sf, keys=("rf",)):
    """Single tests and pairs of all families in one order: score, arity, family, features, cuts."""
    df = line_wide(spark, sf, "cnf4")
    one = scored_tuples(df, 1, [CONJUI], keys=keys).filter("region = 'L'").select(*keys, F.lit(1).alias("arity"), "region", "fi", F.lit("").alias("fj"), "bi", F.lit(-1).alias("bj"), "score", "gain", "ip", "ineg")
    two = scored_tuples(df, 2, [HORN, ANTIHORN, CONJUI, AFFINE], keys=keys).select(*keys, F.lit(2).alias("arity"), "region", "fi", "fj", "bi", "bj", "score", "gain", "ip", "ineg")
    both = one.unionByName(two)
    family = F.when((F.col("arity") == 1) | F.col("region").isin("HH", "LH", "HL"), HORN).when(F.col("region") == "LL", ANTIHORN).otherwise(AFFINE)
    rank = F.when(family == HORN, 0).when(family == ANTIHORN, 1).otherwise(3)
    return both.withColumns({"family": family, "rank_": rank})


@query("sea20_winner_order", _winner_sql())
def sea20(spark, sf):
    r = ranked_rules(spark, sf)
    # candidates per node are histogram cells (tuples x cuts), not rows
    order = W.partitionBy("rf").orderBy(F.desc(F.round("score", 9)), "arity", "rank_", "fi", "fj", "region", "bi", "bj")
    top = r.withColumn("place", F.row_number().over(order)).filter("place <= 10")
    return rounded(top.select("rf", "place", "arity", "family", "region", "fi", "fj", "score"), "score")


@query("sea21_tie_order", f"""WITH {regions_sql('or2', 1, [CONJUI], keys=('supp',))}, o AS (SELECT supp, fi, ti, region, round(score, 2) AS s2, row_number() OVER (PARTITION BY supp ORDER BY round(score, 2) DESC, fi, ti, CASE region WHEN 'H' THEN 0 ELSE 1 END) AS rn FROM r)
    SELECT supp, fi, {cut_value_sql('fi', 'ti')} AS threshold, CASE region WHEN 'H' THEN 'GE' ELSE 'LT' END AS op, s2 + 0.0 AS score FROM o WHERE rn = 1""")
def sea21(spark, sf):
    s = scored_tuples(line_wide(spark, sf), 1, [CONJUI], keys=("supp",)).withColumn("op_rank", F.when(F.col("region") == "H", 0).otherwise(1))
    best = X.best_per(s, ["supp"], ["fi", "bi", "op_rank"], digits=2)
    return best.select("supp", "fi", cut_value(F.col("fi"), F.col("bi")).alias("threshold"), F.when(F.col("op_rank") == 0, "GE").otherwise("LT").alias("op"), (F.round("score", 2) + 0.0).alias("score"))


# --- SEA22: look-ahead ----------------------------------------------------------------------------------

_AHEAD = [("q >= 30", 0), ("q >= 30 OR d < 0.03", 1), ("q >= 20 AND t >= 0.03", 2), ("(q >= 25) <> (d >= 0.05)", 3)]


@query("sea22_look_ahead", f"""WITH {line_cte('cnf4')}, bl AS ({' UNION ALL '.join(f"SELECT {n} AS cand, ({c}) AS side, y, feature, b FROM (SELECT *, 'q' AS feature, {cut_bin_sql('q')} AS b FROM s UNION ALL SELECT *, 'd', {cut_bin_sql('d')} FROM s UNION ALL SELECT *, 't', {cut_bin_sql('t')} FROM s UNION ALL SELECT *, 'p', {cut_bin_sql('p')} FROM s)" for c, n in _AHEAD)}),
    h AS (SELECT cand, side, feature, b, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM bl GROUP BY ALL),
    cu AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER a AS tp, sum(neg) OVER a AS tn FROM h WINDOW w AS (PARTITION BY cand, side, feature ORDER BY b), a AS (PARTITION BY cand, side, feature)),
    g AS (SELECT cand, side, max(CASE WHEN cp + cn >= {MIN_LEAF} AND tp + tn - cp - cn >= {MIN_LEAF} THEN {gain_sql('tp', 'tn', 'cp', 'cn')} ELSE 0.0 END) AS g, max(tp) AS tp, max(tn) AS tn FROM cu GROUP BY 1, 2),
    n AS (SELECT cand, sum(tp) AS p, sum(tn) AS n, max(CASE WHEN side THEN tp END) AS ip, max(CASE WHEN side THEN tn END) AS ineg, sum(g * (tp + tn)) / sum(tp + tn) AS ahead FROM g GROUP BY 1),
    f AS (SELECT cand, {gain_sql('p', 'n', 'ip', 'ineg')} AS gain, ahead FROM n)
    SELECT cand::INT AS cand, {rsql('gain')} AS gain, {rsql('ahead')} AS ahead, {rsql('gain + 0.3 * ahead')} AS score, row_number() OVER (ORDER BY round(gain + 0.3 * ahead, 9) DESC, cand)::INT AS place FROM f""")
def sea22(spark, sf):
    """Candidates re-ranked by gain + 0.3 x the best next single gain of both sides."""
    df = line_rows(spark, sf, "cnf4")
    q, d, t = F.col("q"), F.col("d"), F.col("t")
    rules = [q >= 30, (q >= 30) | (d < 0.03), (q >= 20) & (t >= 0.03), (q >= 25) != (d >= 0.05)]
    # equal (sides, bins) are added up before candidates and features are spread out
    packed = H.class_counts(df.select("y", *[r.alias(f"r{i}") for i, r in enumerate(rules)], *[cut_bin(f).alias(f) for f in CUT_FEATURES]), [*[f"r{i}" for i in range(4)], *CUT_FEATURES])
    cand = F.array(*[F.struct(F.lit(i).alias("cand"), F.col(f"r{i}").alias("side")) for i in range(4)])
    feat = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("b")) for f in CUT_FEATURES])
    long = packed.select("pos", "neg", F.inline(cand), *CUT_FEATURES).select("pos", "neg", "cand", "side", F.inline(feat))
    cells = long.groupBy("cand", "side", "feature", "b").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cum = H.cumulate(cells, ["cand", "side", "feature"], ["b"])
    left, n = F.col("p_x") + F.col("n_x"), F.col("p_t") + F.col("n_t")
    ok = (left >= MIN_LEAF) & (n - left >= MIN_LEAF)
    g = F.when(ok, information_gain(F.col("p_t"), F.col("n_t"), F.col("p_x"), F.col("n_x"))).otherwise(F.lit(0.0))
    side = cum.groupBy("cand", "side").agg(F.max(g).alias("g"), F.max("p_t").alias("tp"), F.max("n_t").alias("tn"))
    on = lambda c: F.max(F.when(F.col("side"), F.col(c)))
    size = F.col("tp") + F.col("tn")
    per = side.groupBy("cand").agg(F.sum("tp").alias("p"), F.sum("tn").alias("n"), on("tp").alias("ip"), on("tn").alias("ineg"), (F.sum(F.col("g") * size) / F.sum(size)).alias("ahead"))
    per = per.withColumn("gain", information_gain(*[F.col(c) for c in ("p", "n", "ip", "ineg")])).withColumn("score", F.col("gain") + 0.3 * F.col("ahead"))
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(F.round("score", 9)), "cand"))  # four candidates
    return rounded(per.withColumn("place", place).select("cand", "gain", "ahead", "score", "place"), "gain", "ahead", "score")


# --- SEA23 - SEA25: given rules ----------------------------------------------------------------------------

_N = {"q": 0, "p": 1, "d": 2, "t": 3, "ln": 4, "ls": 5}


def _L(f, op, t):
    return Literal(_N[f], op, t)


RULES = {
    "sea23_score_conjui": (Rule.of("and", CONJUI, _L("q", "GE", 20.0), _L("t", "GE", 0.03)), "q >= 20 AND t >= 0.03", "and2"),
    "sea24_score_horn": (Rule.of("or", HORN, _L("q", "GE", 30.0), _L("d", "LT", 0.03)), "q >= 30 OR d < 0.03", "or2"),
    "sea24_score_antihorn": (Rule.of("or", ANTIHORN, _L("q", "GE", 30.0), _L("t", "GE", 0.05), _L("d", "LT", 0.03)), "q >= 30 OR t >= 0.05 OR d < 0.03", "or2"),
    "sea24_score_xor": (Rule.of("xor", AFFINE, _L("q", "GE", 25.0), _L("d", "GE", 0.05)), "(q >= 25) <> (d >= 0.05)", "xor2"),
    "sea25_score_cnf": (Rule("cnf", ((_L("q", "GE", 25.0), _L("d", "LT", 0.03)), (_L("t", "GE", 0.04), _L("p", "LT", 50000.0))), SQUARE2CNF), "(q >= 25 OR d < 0.03) AND (t >= 0.04 OR p < 50000)", "cnf4"),
}


def _register_rule(name, rule, cond, task):
    sql = f"""WITH {line_cte(task)}, n AS (SELECT sum(y)::DOUBLE AS tp, sum(1 - y)::DOUBLE AS tn, sum(CASE WHEN {cond} THEN y ELSE 0 END)::DOUBLE AS ip, sum(CASE WHEN {cond} THEN 1 - y ELSE 0 END)::DOUBLE AS ineg FROM s),
      g AS (SELECT *, {gain_sql('tp', 'tn', 'ip', 'ineg')} AS g FROM n) SELECT tp, tn, ip, ineg, {rsql('g')} AS gain, {rsql(penalized_sql('g', str(rule.arity), '(tp+tn)'))} AS score FROM g"""
    def run(spark, sf):
        df = line_rows(spark, sf, task)
        return rounded(X.score_rule(df, rule, [F.col(f) for f in _N], 5), "gain", "score")
    query(name, sql)(run)


for _name, (_rule, _cond, _task) in RULES.items():
    _register_rule(_name, _rule, _cond, _task)


# --- SEA26, SEA27: exact midpoints, all features ---------------------------------------------------------------

_EXACT = ["q", "d", "t", "ln", "ls"]  # the price has as many values as rows; its pairs are the sea26_wide queries


def value_codes(spark, sf, task):
    """Dense code of every distinct value per feature (few distinct values each)."""
    from rulespire.plans.encode import encode

    return encode(line_rows(spark, sf, task), "y", _EXACT)


def _exact_sql(task, family):
    pairs = list(combinations(_EXACT, 2))
    val = " UNION ALL ".join(f"SELECT '{f}' AS f, v, lead(v) OVER (ORDER BY v) AS nx FROM (SELECT DISTINCT {f} + 0.0 AS v FROM s)" for f in _EXACT)
    cells = " UNION ALL ".join(f"SELECT '{a}' AS fi, '{b}' AS fj, {a} + 0.0 AS vi, {b} + 0.0 AS vj, sum(y)::DOUBLE AS pos, sum(1-y)::DOUBLE AS neg FROM s GROUP BY {a} + 0.0, {b} + 0.0" for a, b in pairs)
    conds = {"HH": "vi >= ci AND vj >= cj", "LL": "vi < ci AND vj < cj", "LH": "vi < ci AND vj >= cj", "HL": "vi >= ci AND vj < cj", "X": "(vi >= ci) <> (vj >= cj)"}
    regs = X.regions_for({family}, 2)
    wide = ", ".join(f"sum(CASE WHEN {conds[r]} THEN pos ELSE 0 END) AS p{r}, sum(CASE WHEN {conds[r]} THEN neg ELSE 0 END) AS n{r}" for r in regs)
    tall = " UNION ALL ".join(f"SELECT fi, fj, ci, cj, '{r}' AS region, p{r} AS ip, n{r} AS ineg, tp, tn FROM w" for r in regs)
    return f"""WITH {line_cte(task)}, val AS ({val}), cut AS (SELECT f, (v + nx) / 2 AS c FROM val WHERE nx IS NOT NULL), cells AS ({cells}),
      w AS (SELECT fi, fj, a.c AS ci, b.c AS cj, {wide}, sum(pos) AS tp, sum(neg) AS tn FROM cells JOIN cut a ON a.f = fi JOIN cut b ON b.f = fj GROUP BY 1, 2, 3, 4), r0 AS ({tall}),
      r AS (SELECT *, {gain_sql('tp', 'tn', 'ip', 'ineg')} AS gain FROM r0 WHERE ip + ineg >= 5 AND tp + tn - ip - ineg >= 5), m AS (SELECT *, row_number() OVER (ORDER BY round(gain, 9) DESC, fi, fj, region, ci, cj) AS rn FROM r WHERE gain > 0)
      SELECT fi, fj, region, {rsql('ci')} AS t_fi, {rsql('cj')} AS t_fj, ip, ineg, {rsql('gain')} AS gain FROM m WHERE rn = 1"""


def _register_exact(name, task, family):
    def run(spark, sf):
        enc = value_codes(spark, sf, task)
        feats = list(range(len(_EXACT)))
        entry = F.array(*[F.struct(F.lit(a).alias("fi"), F.lit(b).alias("fj"), F.col("c")[a].cast("int").alias("bi"), F.col("c")[b].cast("int").alias("bj")) for a, b in combinations(feats, 2)])
        cells = H.class_counts(enc.df.select("y", "w", F.inline(entry)), ["fi", "fj", "bi", "bj"], w="w")
        r = X.region_counts(cells, ["fi", "fj"], ["bi", "bj"]).filter(F.col("region").isin(X.regions_for({family}, 2)))
        name_of = lambda c: F.get(F.array(*[F.lit(f) for f in _EXACT]), c)
        mids = F.array(*[F.array(*[F.lit(float(c)) for c in enc.cuts[f]]) for f in feats])
        r = X.score_counts(r, 2, 5).withColumn("fi_", name_of(F.col("fi"))).withColumn("fj_", name_of(F.col("fj"))).withColumn("score", F.col("gain")).withColumn("k", F.lit(0))
        best = X.best_per(r, ["k"], ["fi_", "fj_", "region", "bi", "bj"], digits=9)
        out = best.select(F.col("fi_").alias("fi"), F.col("fj_").alias("fj"), "region", F.get(F.get(mids, F.col("fi")), F.col("bi")).alias("t_fi"), F.get(F.get(mids, F.col("fj")), F.col("bj")).alias("t_fj"), "ip", "ineg", "gain")
        return rounded(out, "t_fi", "t_fj", "gain")
    query(name, _exact_sql(task, family))(run)


_register_exact("sea26_exact_conjui", "and2", CONJUI)
_register_exact("sea26_exact_horn", "or2", HORN)
_register_exact("sea26_exact_antihorn", "cnf4", ANTIHORN)
_register_exact("sea26_exact_affine", "xor2", AFFINE)


def _wide_sql(task, family):
    regs = X.regions_for({family}, 2)
    cells = " UNION ALL ".join(f"SELECT '{f}' AS fj, p + 0.0 AS w, {f} + 0.0 AS v, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM s GROUP BY ALL" for f in _EXACT)
    inside = {"LL": "l{0}", "LH": "a{0} - l{0}", "HL": "t{0}l - l{0}", "HH": "t{0} - a{0} - t{0}l + l{0}", "X": "a{0} + t{0}l - 2 * l{0}"}
    tall = " UNION ALL ".join(f"SELECT fj, w, nx, c, '{r}' AS region, {inside[r].format('p')} AS ip, {inside[r].format('n')} AS ineg, tp, tn FROM r1" for r in regs)
    return f"""WITH {line_cte(task)}, cells AS ({cells}), cut AS (SELECT fj, (v + nx) / 2 AS c FROM (SELECT fj, v, lead(v) OVER (PARTITION BY fj ORDER BY v) AS nx FROM (SELECT DISTINCT fj, v FROM cells)) WHERE nx IS NOT NULL),
      e AS (SELECT fj, c, w, sum(pos) AS ap, sum(neg) AS an, sum(CASE WHEN v < c THEN pos ELSE 0 END) AS lp, sum(CASE WHEN v < c THEN neg ELSE 0 END) AS ln FROM cells JOIN cut USING (fj) GROUP BY 1, 2, 3),
      r1 AS (SELECT fj, c, w, lead(w) OVER o AS nx, sum(ap) OVER o AS ap, sum(an) OVER o AS an, sum(lp) OVER o AS lp, sum(ln) OVER o AS ln, sum(ap) OVER g AS tp, sum(an) OVER g AS tn, sum(lp) OVER g AS tpl, sum(ln) OVER g AS tnl
        FROM e WINDOW o AS (PARTITION BY fj, c ORDER BY w), g AS (PARTITION BY fj, c)), r2 AS ({tall}),
      m AS (SELECT *, {gain_sql('tp', 'tn', 'ip', 'ineg')} AS gain FROM r2 WHERE nx IS NOT NULL AND ip + ineg >= 5 AND tp + tn - ip - ineg >= 5)
      SELECT fj AS feature, region, {rsql('(w + nx) / 2')} AS t_wide, {rsql('c')} AS t_short, ip, ineg, {rsql('gain')} AS gain FROM m WHERE gain > 0 ORDER BY round(gain, 9) DESC, fj, region, w, c LIMIT 1"""


def _register_wide(name, task, family):
    def run(spark, sf):
        best = exact_wide_pairs(line_rows(spark, sf, task), "p", _EXACT, X.regions_for({family}, 2), 5)
        return rounded(best, "t_wide", "t_short", "gain")
    query(name, _wide_sql(task, family))(run)


_register_wide("sea26_wide_conjui", "and2", CONJUI)
_register_wide("sea26_wide_horn", "cnf4", HORN)
_register_wide("sea26_wide_antihorn", "or2", ANTIHORN)
_register_wide("sea26_wide_affine", "xor2", AFFINE)


@query("sea27_stump", f"""WITH {line_cte('and2')}, l AS ({' UNION ALL '.join(f"SELECT '{f}' AS f, {i} AS pos_, {f} + 0.0 AS v, y FROM s" for i, f in enumerate(LINE_FEATURES))}),
    h AS (SELECT f, pos_, v, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM l GROUP BY ALL),
    c AS (SELECT *, sum(p) OVER w AS ip, sum(n) OVER w AS ineg, sum(p) OVER a AS tp, sum(n) OVER a AS tn, lead(v) OVER (PARTITION BY f ORDER BY v) AS nx FROM h WINDOW w AS (PARTITION BY f ORDER BY v), a AS (PARTITION BY f)),
    g AS (SELECT *, {gain_sql('tp', 'tn', 'ip', 'ineg')} AS gain FROM c WHERE nx IS NOT NULL AND ip + ineg >= 5 AND tp + tn - ip - ineg >= 5),
    b AS (SELECT *, row_number() OVER (ORDER BY round({penalized_sql('gain', '1', '(tp+tn)')}, 9) DESC, pos_, v) AS rn FROM g), w AS (SELECT * FROM b WHERE rn = 1)
    SELECT 1::BIGINT AS node_id, tp AS n_pos, tn AS n_neg, false AS is_leaf, f AS feature, {rsql('(v + nx) / 2')} AS threshold FROM w
    UNION ALL SELECT 2, tp - ip, tn - ineg, true, NULL, NULL FROM w UNION ALL SELECT 3, ip, ineg, true, NULL, NULL FROM w""")
def sea27(spark, sf):
    """Depth-1 model of one family with exact midpoints of all six columns: rule and both leaves."""
    best = X.exact_stump(line_rows(spark, sf, "and2"), LINE_FEATURES, 5)
    node = lambda k, p, n, f, t: F.struct(F.lit(k).cast("bigint").alias("node_id"), p.alias("n_pos"), n.alias("n_neg"), F.lit(k > 1).alias("is_leaf"), f.alias("feature"), t.alias("threshold"))
    p, n, no = (F.col("ip"), F.col("ineg"), F.lit(None))
    rows = F.array(
        node(1, F.col("tp"), F.col("tn"), F.col("feature"), F.col("threshold")),
        node(2, F.col("tp") - p, F.col("tn") - n, no.cast("string"), no.cast("double")), node(3, p, n, no.cast("string"), no.cast("double")))
    return rounded(best.select(F.inline(rows)), "threshold")
