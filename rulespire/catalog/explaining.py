"""Explanations, certificates, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulespire.catalog.base import line_cte, line_rows, line_wide, load, query, rounded, rsql
from rulespire.session import scratch_dir as scratch
from rulespire.catalog.trees import LEAF_SQL, LITS_SQL, NODES_SQL, PROBA_SQL, RULE_ROWS_SQL, THR_SQL, fixed_model, rule_rows, supplier_nodes, supplier_rules
from rulespire.functions.hashing import unit_hash
from rulespire.functions.rules import HORN, rule_problem
from rulespire.operators import certificates as K
from rulespire.operators import explain as E
from rulespire.operators.boxes import path_boxes
from rulespire.operators.results import value_summary
from rulespire.plans import model as M
from rulespire.sources.sinks import write_explanations

# Grid oracle for the fixed model: its thresholds cut q and d into 3 cells, t and p into 2.
# Feature bits in column order: q = 1, p = 2, d = 4, t = 8.
SIG_SQL = "(q >= 15)::INT + (q >= 30)::INT AS cq, (p >= 60000)::INT AS cp, (d >= 0.03)::INT + (d >= 0.06)::INT AS cd, (t >= 0.03)::INT AS ct"
GRID_SQL = f"""{line_cte()}, cells AS (SELECT cq, cp, cd, ct, {LEAF_SQL} AS leaf, ({PROBA_SQL} >= 0.5)::INT AS cls FROM (SELECT *, [0.0, 15.0, 30.0][cq + 1]::DOUBLE AS q, [0.0, 60000.0][cp + 1]::DOUBLE AS p, [0.0, 0.03, 0.06][cd + 1]::DOUBLE AS d, [0.0, 0.03][ct + 1]::DOUBLE AS t
      FROM range(0, 3) a(cq), range(0, 2) b(cp), range(0, 3) c(cd), range(0, 2) e(ct))),
    suff AS (SELECT x.cq, x.cp, x.cd, x.ct, x.cls, m::INT AS m, bool_and(z.cls = x.cls) AS ok FROM cells x, range(0, 16) g(m), cells z
      WHERE ((m & 1) = 0 OR z.cq = x.cq) AND ((m & 2) = 0 OR z.cp = x.cp) AND ((m & 4) = 0 OR z.cd = x.cd) AND ((m & 8) = 0 OR z.ct = x.ct) GROUP BY ALL),
    d1 AS (SELECT c.*, CASE WHEN (SELECT ok FROM suff s WHERE (s.cq, s.cp, s.cd, s.ct) = (c.cq, c.cp, c.cd, c.ct) AND m = 14) THEN 14 ELSE 15 END AS m1 FROM cells c),
    d2 AS (SELECT c.*, CASE WHEN (SELECT ok FROM suff s WHERE (s.cq, s.cp, s.cd, s.ct) = (c.cq, c.cp, c.cd, c.ct) AND m = m1 - 2) THEN m1 - 2 ELSE m1 END AS m2 FROM d1 c),
    d3 AS (SELECT c.*, CASE WHEN (SELECT ok FROM suff s WHERE (s.cq, s.cp, s.cd, s.ct) = (c.cq, c.cp, c.cd, c.ct) AND m = m2 - 4) THEN m2 - 4 ELSE m2 END AS m3 FROM d2 c),
    axp AS (SELECT c.*, CASE WHEN (SELECT ok FROM suff s WHERE (s.cq, s.cp, s.cd, s.ct) = (c.cq, c.cp, c.cd, c.ct) AND m = m3 - 8) THEN m3 - 8 ELSE m3 END AS m FROM d3 c),
    r AS (SELECT rk, y, rf, ln, {SIG_SQL} FROM s), ex AS (SELECT r.*, axp.cls, axp.m, (m & 1) + (m & 2) // 2 + (m & 4) // 4 + (m & 8) // 8 AS len,
      concat_ws(',', CASE WHEN m & 1 > 0 THEN '0' END, CASE WHEN m & 2 > 0 THEN '1' END, CASE WHEN m & 4 > 0 THEN '2' END, CASE WHEN m & 8 > 0 THEN '3' END) AS axp FROM r JOIN axp USING (cq, cp, cd, ct))"""

GRID_SQL = GRID_SQL.replace("m & 1 > 0", "(m & 1) > 0").replace("m & 2 > 0", "(m & 2) > 0").replace("m & 4 > 0", "(m & 4) > 0").replace("m & 8 > 0", "(m & 8) > 0")
GIVEN_SQL = "((ln::INT % 2) + (CASE WHEN ln::INT % 3 = 0 THEN 2 ELSE 0 END) + (CASE WHEN ln < 5 THEN 4 ELSE 0 END) + (CASE WHEN rf = 'R' THEN 8 ELSE 0 END))"


def given_set():
    """A feature set that depends on the row."""
    ln = F.col("ln").cast("int")
    return F.array_compact(F.array(
        F.when(ln % 2 == 1, 0), F.when(ln % 3 == 0, 1), F.when(F.col("ln") < 5, 2), F.when(F.col("rf") == "R", 3)))


def explained(spark, sf):
    return E.explain_rows(line_wide(spark, sf), fixed_model())


@query("exp1_sufficient_set", f"WITH {GRID_SQL} SELECT r.rk, suff.ok AS sufficient FROM r JOIN suff ON (r.cq, r.cp, r.cd, r.ct) = (suff.cq, suff.cp, suff.cd, suff.ct) AND suff.m = {GIVEN_SQL}")
def exp1(spark, sf):
    return E.sufficient_rows(line_wide(spark, sf), fixed_model(), given_set()).select("rk", "sufficient")


@query("exp2_minimal_sets", f"WITH {GRID_SQL} SELECT rk, cls AS y_pred, axp, len::INT AS axp_len FROM ex")
def exp2(spark, sf):
    text = F.array_join(F.transform("axp", lambda f: f.cast("string")), ",")
    return explained(spark, sf).select("rk", "y_pred", text.alias("axp"), "axp_len")


@query("exp3_reachable_leaves", f"""WITH {GRID_SQL}, rs AS (SELECT r.*, {GIVEN_SQL} AS m FROM r), sg AS (SELECT DISTINCT cq, cp, cd, ct, m FROM rs),
    re AS (SELECT g.cq, g.cp, g.cd, g.ct, g.m, string_agg(DISTINCT z.leaf::VARCHAR, ',' ORDER BY z.leaf::VARCHAR) AS leaves FROM sg g JOIN cells z ON ((g.m & 1) = 0 OR z.cq = g.cq) AND ((g.m & 2) = 0 OR z.cp = g.cp) AND ((g.m & 4) = 0 OR z.cd = g.cd) AND ((g.m & 8) = 0 OR z.ct = g.ct) GROUP BY ALL)
    SELECT rk, leaves FROM rs JOIN re USING (cq, cp, cd, ct, m)""")
def exp3(spark, sf):
    out = E.reachable_leaves(line_wide(spark, sf), fixed_model(), given_set())
    return out.select("rk", F.array_join(F.transform("reachable", lambda l: l.cast("string")), ",").alias("leaves"))


# Alternatives of every supplier rule, written out by hand.
ALT_SQL = f"""{THR_SQL}, {LITS_SQL}, li AS (SELECT *, CASE op WHEN 'GE' THEN threshold END AS plo, CASE op WHEN 'LT' THEN threshold END AS phi, CASE op WHEN 'LT' THEN threshold END AS nlo, CASE op WHEN 'GE' THEN threshold END AS nhi FROM lits),
    alt AS (SELECT tree_id, node_id, true AS side, 'o' || pos AS alt, feature, plo AS lo, phi AS hi FROM li WHERE combine = 'or' UNION ALL SELECT tree_id, node_id, false, 'o', feature, nlo, nhi FROM li WHERE combine = 'or'
      UNION ALL SELECT tree_id, node_id, true, 'a', feature, plo, phi FROM li WHERE combine = 'and' UNION ALL SELECT tree_id, node_id, false, 'a' || pos, feature, nlo, nhi FROM li WHERE combine = 'and'
      UNION ALL SELECT tree_id, node_id, false, 'c' || clause, feature, nlo, nhi FROM li WHERE combine = 'cnf'
      UNION ALL SELECT a.tree_id, a.node_id, true, 'c' || a.pos || b.pos, CASE g.k WHEN 0 THEN a.feature ELSE b.feature END, CASE g.k WHEN 0 THEN a.plo ELSE b.plo END, CASE g.k WHEN 0 THEN a.phi ELSE b.phi END FROM li a JOIN li b ON a.tree_id = b.tree_id AND a.node_id = b.node_id AND a.clause = 0 AND b.clause = 1, range(0, 2) g(k) WHERE a.combine = 'cnf'
      UNION ALL SELECT tree_id, node_id, (h.k % 2) = 0, 'x' || h.k, feature, CASE WHEN (h.k IN (0, 3) AND pos = 0) OR (h.k IN (2, 3) AND pos = 1) THEN plo ELSE nlo END, CASE WHEN (h.k IN (0, 3) AND pos = 0) OR (h.k IN (2, 3) AND pos = 1) THEN phi ELSE nhi END FROM li, range(0, 4) h(k) WHERE combine = 'xor'),
    ids AS (SELECT DISTINCT tree_id, node_id, side, alt FROM alt),
    pth AS (SELECT a.tree_id, leaf, a.alt AS a1, b.alt AS a2, b.node_id AS n2, a.side AS s1, b.side AS s2 FROM (VALUES (4, true, 2, true), (5, true, 2, false), (6, false, 3, true), (7, false, 3, false)) v(leaf, s1, n2, s2) JOIN ids a ON a.node_id = 1 AND a.side = v.s1 JOIN ids b ON b.tree_id = a.tree_id AND b.node_id = v.n2 AND b.side = v.s2),
    cond AS (SELECT p.tree_id, leaf, a1, a2, x.feature, max(x.lo) AS lo, min(x.hi) AS hi FROM pth p JOIN alt x ON x.tree_id = p.tree_id AND ((x.node_id = 1 AND x.side = p.s1 AND x.alt = p.a1) OR (x.node_id = p.n2 AND x.side = p.s2 AND x.alt = p.a2)) GROUP BY ALL),
    bx AS (SELECT tree_id, leaf, a1, a2, string_agg(feature || ':' || coalesce(round(lo * 1000)::BIGINT::VARCHAR, '*') || ':' || coalesce(round(hi * 1000)::BIGINT::VARCHAR, '*'), ' ' ORDER BY feature) AS box, bool_and(coalesce(lo, -1e18) < coalesce(hi, 1e18)) AS ok FROM cond GROUP BY 1, 2, 3, 4)"""


@query("exp4_path_boxes", f"WITH {ALT_SQL} SELECT DISTINCT tree_id, leaf::BIGINT AS leaf_id, box FROM bx WHERE ok")
def exp4(spark, sf):
    rules = supplier_rules(spark, sf)
    ids = rules.select("tree_id").distinct()
    leaves = ids.select("tree_id", F.explode(F.array(*[F.lit(n).cast("bigint") for n in (4, 5, 6, 7)])).alias("node_id"), F.lit(0.5).alias("proba"))
    b = path_boxes(rules, leaves, 2)
    end = lambda v: F.when(F.abs(v) == float("inf"), F.lit("*")).otherwise(F.round(v * 1000).cast("bigint").cast("string"))
    text = F.array_join(F.transform("box", lambda c: F.concat_ws(":", c.feature.cast("string"), end(c.lo), end(c.hi))), " ")
    return b.select("tree_id", "leaf_id", text.alias("box"))


# --- clause shapes of the supplier paths -------------------------------------------------------------

STEPS_SQL = f"""{NODES_SQL}, st AS (SELECT tree_id, node_id AS leaf_id, 0 AS step, 1 AS nid, node_id < 6 AS taken FROM nodes WHERE is_leaf UNION ALL SELECT tree_id, node_id, 1, (node_id // 2)::INT, node_id % 2 = 0 FROM nodes WHERE is_leaf),
    sl AS (SELECT st.tree_id, st.leaf_id, st.step, st.taken, l.family, l.combine, l.clause, l.pos, l.feature, l.op, l.threshold, (l.op = 'GE')::INT AS ge FROM st JOIN lits l ON l.tree_id = st.tree_id AND l.node_id = st.nid),
    cl AS (SELECT tree_id, leaf_id, step, 'w' AS ck, sum(ge) AS np, sum(1 - ge) AS nn FROM sl WHERE combine = 'or' AND taken GROUP BY 1, 2, 3
      UNION ALL SELECT tree_id, leaf_id, step, 'u' || pos, 1 - ge, ge FROM sl WHERE combine = 'or' AND NOT taken UNION ALL SELECT tree_id, leaf_id, step, 'u' || pos, ge, 1 - ge FROM sl WHERE combine = 'and' AND taken
      UNION ALL SELECT tree_id, leaf_id, step, 'w', sum(1 - ge), sum(ge) FROM sl WHERE combine = 'and' AND NOT taken GROUP BY 1, 2, 3
      UNION ALL SELECT tree_id, leaf_id, step, 'c' || clause, sum(ge), sum(1 - ge) FROM sl WHERE combine = 'cnf' AND taken GROUP BY 1, 2, 3, clause
      UNION ALL SELECT a.tree_id, a.leaf_id, a.step, 'p' || a.pos || b.pos, (1 - a.ge) + (1 - b.ge), a.ge + b.ge FROM sl a JOIN sl b ON a.tree_id = b.tree_id AND a.leaf_id = b.leaf_id AND a.step = b.step AND a.clause = 0 AND b.clause = 1 WHERE a.combine = 'cnf' AND NOT a.taken),
    px AS (SELECT tree_id, leaf_id, bool_or(combine = 'xor') AS has_xor, bool_and(combine = 'xor') AS all_xor, bool_and(family = 'Horn') AS all_horn, bool_and(family = 'AntiHorn') AS all_anti, bool_or(combine = 'cnf') AS has_cnf FROM sl GROUP BY 1, 2),
    mx AS (SELECT px.*, coalesce(max(np), 0)::INT AS max_pos, coalesce(max(nn), 0)::INT AS max_neg, coalesce(max(np + nn), 0)::INT AS max_len FROM px LEFT JOIN cl USING (tree_id, leaf_id) GROUP BY ALL),
    ce AS (SELECT *, CASE WHEN has_xor THEN 'none' WHEN max_pos <= 1 THEN 'horn' WHEN max_neg <= 1 THEN 'antihorn' WHEN max_len <= 2 THEN '2cnf' ELSE 'none' END AS certificate FROM mx)"""


def steps(spark, sf):
    paths = M.root_paths(supplier_nodes(spark, sf), 2)
    return paths.join(supplier_rules(spark, sf), ["tree_id", "node_id"])


@query("exp5_path_certificate", f"WITH {STEPS_SQL} SELECT tree_id, leaf_id, max_pos, max_neg, max_len, certificate FROM ce")
def exp5(spark, sf):
    return K.certificate(steps(spark, sf))


@query("exp6_clause_table", f"""WITH {STEPS_SQL}, th AS (SELECT DISTINCT tree_id, leaf_id, feature, round(threshold, 10) AS t FROM sl WHERE combine <> 'xor'), od AS (SELECT a.tree_id, a.leaf_id FROM th a JOIN th b ON a.tree_id = b.tree_id AND a.leaf_id = b.leaf_id AND a.feature = b.feature AND a.t < b.t),
    al AS (SELECT tree_id, leaf_id, 'path' AS kind, np + nn AS len FROM cl UNION ALL SELECT tree_id, leaf_id, 'order', 2 FROM od) SELECT tree_id, leaf_id, kind, len::INT AS len, count(*) AS n FROM al GROUP BY ALL""")
def exp6(spark, sf):
    c = K.path_clauses(steps(spark, sf))
    return c.groupBy("tree_id", "leaf_id", "kind", F.size("clause").alias("len")).agg(F.count(F.lit(1)).alias("n"))


@query("exp7_threshold_digits", """WITH t AS (SELECT l_suppkey AS supp, l_discount / 7 + CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN 1e-13 ELSE 1e-8 END AS t FROM lineitem)
    SELECT supp, count(DISTINCT t) AS n_values, count(DISTINCT round(t, 10)) AS n_thresholds FROM t GROUP BY 1""")
def exp7_digits(spark, sf):
    """Noise beyond the tenth digit is none, noise before it is."""
    ln = F.col("l_linenumber") % 3
    t = F.col("l_discount") / 7 + F.when(ln == 0, F.lit(0.0)).when(ln == 1, F.lit(1e-13)).otherwise(F.lit(1e-8))
    rows = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supp"), t.alias("t"))
    return rows.groupBy("supp").agg(F.count_distinct("t").alias("n_values"), F.count_distinct(K.threshold_key(F.col("t"))).alias("n_thresholds"))


@query("exp7_threshold_identity", "SELECT l_suppkey AS supp, count(DISTINCT round(l_extendedprice / 7 + CASE WHEN l_linenumber % 2 = 0 THEN 1e-13 ELSE 0 END, 3)) AS n_thresholds FROM lineitem GROUP BY 1")
def exp7(spark, sf):
    """Noise below the identity digits must not create new thresholds (3 digits: values are large)."""
    t = F.col("l_extendedprice") / 7 + F.when(F.col("l_linenumber") % 2 == 0, F.lit(1e-13)).otherwise(F.lit(0.0))
    key = F.round(K.threshold_key(t), 3)
    return load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("supp")).agg(F.count_distinct(key).alias("n_thresholds"))


@query("exp8_backend_labels", f"""WITH {STEPS_SQL} SELECT tree_id, leaf_id, certificate, CASE WHEN all_xor THEN 'affine' WHEN all_horn THEN 'structural_horn' WHEN all_anti THEN 'structural_antihorn' WHEN has_xor THEN 'interval_dfs_fallback' WHEN certificate = 'horn' THEN 'structural_horn' WHEN certificate = 'antihorn' THEN 'structural_antihorn'
    WHEN certificate = '2cnf' THEN 'two_sat' WHEN has_cnf THEN 'prototype_case_split' ELSE 'interval_dfs_fallback' END AS backend, certificate <> 'none' AS certified, CASE WHEN all_xor THEN 'affine paths are auxiliary' WHEN has_xor THEN 'mixed affine path' WHEN certificate = 'none' THEN 'clauses are neither horn, antihorn nor 2cnf' ELSE '' END AS reason FROM ce""")
def exp8(spark, sf):
    return K.backend_labels(steps(spark, sf))


@query("exp9_xor_guard", f"WITH {STEPS_SQL} SELECT tree_id, leaf_id, feature, count(DISTINCT round(threshold, 10)) AS n_thresholds, count(DISTINCT round(threshold, 10)) = 1 AS single FROM sl WHERE combine = 'xor' GROUP BY 1, 2, 3")
def exp9(spark, sf):
    return K.xor_guard(steps(spark, sf))


@query("exp10_audit", f"""WITH {GRID_SQL}, a AS (SELECT ex.*, (SELECT ok FROM suff s WHERE (s.cq, s.cp, s.cd, s.ct, s.m) = (ex.cq, ex.cp, ex.cd, ex.ct, ex.m)) AS ok,
      (SELECT count(*) FROM suff s WHERE (s.cq, s.cp, s.cd, s.ct) = (ex.cq, ex.cp, ex.cd, ex.ct) AND s.ok AND s.m IN (CASE WHEN (ex.m & 1) > 0 THEN ex.m - 1 END, CASE WHEN (ex.m & 2) > 0 THEN ex.m - 2 END, CASE WHEN (ex.m & 4) > 0 THEN ex.m - 4 END, CASE WHEN (ex.m & 8) > 0 THEN ex.m - 8 END)) AS spare FROM ex)
    SELECT count(*) AS n_rows, avg(ok::INT) + 0.0 AS valid_rate, avg((ok AND spare = 0)::INT) + 0.0 AS minimal_rate FROM a""")
def exp10(spark, sf):
    return E.audit(explained(spark, sf), fixed_model())


_VALUES = {"q": [5.0, 20.0, 40.0], "p": [1000.0, 70000.0], "d": [0.01, 0.04, 0.08], "t": [0.01, 0.05]}


def _draw_sql(f):
    u = f"(('0x' || substr(md5(concat_ws('-', '42', 'mc', cq, cp, cd, ct, g.f, k, '{f}')), 1, 8))::BIGINT / 4294967296.0)"
    n = len(_VALUES[f])
    bit = {"q": 1, "p": 2, "d": 4, "t": 8}[f]
    cell = {"q": "cq", "p": "cp", "d": "cd", "t": "ct"}[f]
    return f"CASE WHEN ((m - bit) & {bit}) > 0 THEN ({_VALUES[f]!r}::DOUBLE[])[{cell} + 1] ELSE ({_VALUES[f]!r}::DOUBLE[])[floor({u} * {n})::INT + 1] END AS {f}"


@query("exp11_random_completions", f"""WITH {GRID_SQL}, sg AS (SELECT cq, cp, cd, ct, cls, m, count(*) AS n_rows FROM ex GROUP BY ALL),
    g AS (SELECT sg.*, v.f, v.bit FROM sg JOIN (VALUES (0, 1), (1, 2), (2, 4), (3, 8)) v(f, bit) ON (m & v.bit) > 0),
    dr AS (SELECT g.*, k, {', '.join(_draw_sql(f) for f in _VALUES)} FROM g, range(0, 200) h(k)),
    rs AS (SELECT *, ({PROBA_SQL} >= 0.5)::INT = cls AS same FROM dr)
    SELECT cq, cp, cd, ct, f, n_rows, sum(same::INT)::BIGINT AS n_same, NOT bool_and(same) AS needed FROM (SELECT cq, cp, cd, ct, f, n_rows, same FROM rs) GROUP BY ALL""")
def exp11(spark, sf):
    """200 random completions of every dropped feature, once per distinct threshold signature."""
    df = explained(spark, sf)
    cell = lambda f, *cuts: sum(((F.col(f) >= c).cast("int") for c in cuts[1:]), (F.col(f) >= cuts[0]).cast("int"))
    sig = df.select(cell("q", 15.0, 30.0).alias("cq"), cell("p", 60000.0).alias("cp"), cell("d", 0.03, 0.06).alias("cd"), cell("t", 0.03).alias("ct"), "y_pred", "axp")
    sig = sig.groupBy("cq", "cp", "cd", "ct", "y_pred", "axp").agg(F.count(F.lit(1)).alias("n_rows"))
    drawn = sig.withColumn("f", F.explode("axp")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(199))))
    def value(f, idx, cell_col):
        vals = F.array(*[F.lit(v) for v in _VALUES[f]])
        u = unit_hash(42, "mc", F.col("cq"), F.col("cp"), F.col("cd"), F.col("ct"), F.col("f"), F.col("k"), f)
        fixed = F.array_contains("axp", F.lit(idx)) & (F.col("f") != idx)
        return F.when(fixed, F.get(vals, F.col(cell_col))).otherwise(F.get(vals, F.floor(u * len(_VALUES[f])).cast("int")))
    m = fixed_model()
    drawn = drawn.withColumns({f: value(f, i, c) for f, i, c in (("q", 0, "cq"), ("p", 1, "cp"), ("d", 2, "cd"), ("t", 3, "ct"))})
    same = (m.proba_column() >= 0.5).cast("int") == F.col("y_pred")
    return drawn.groupBy("cq", "cp", "cd", "ct", "f", "n_rows").agg(F.count_if(same).alias("n_same"), (~F.bool_and(same)).alias("needed")).select(
        *[F.col(c).cast("int").alias(c) for c in ("cq", "cp", "cd", "ct", "f")], "n_rows", "n_same", "needed")


@query("exp12_family_audit", f"WITH {NODES_SQL} SELECT tree_id, family, count(*) AS n_splits, family = 'Horn' AS as_expected FROM nodes WHERE NOT is_leaf GROUP BY 1, 2")
def exp12(spark, sf):
    return K.family_audit(supplier_nodes(spark, sf).filter("not is_leaf"), ["tree_id"], HORN)


@query("exp13_column_tests", "SELECT l_suppkey AS tree_id, sum((l_tax < l_discount)::INT)::BIGINT AS n_compare, count(*) AS n_literals FROM lineitem GROUP BY 1")
def exp13(spark, sf):
    """Literals that test a column against a column; a row counts as one when its tax is below its discount."""
    li = load(spark, sf, "lineitem")
    lit = F.struct(F.lit(2).alias("feature"), F.when(F.col("l_tax") < F.col("l_discount"), 3).alias("feature2"))
    rules = li.select(F.col("l_suppkey").alias("tree_id"), F.array(lit).alias("lits"))
    flat = rules.select("tree_id", F.inline("lits"))
    return flat.groupBy("tree_id").agg(F.count_if(F.col("feature2").isNotNull()).alias("n_compare"), F.count(F.lit(1)).alias("n_literals"))


@query("exp14_shape_audit", f"WITH {RULE_ROWS_SQL} SELECT problem, count(*) AS n FROM (SELECT CASE WHEN family = 'Horn' AND pos > 1 THEN 'horn_polarity' WHEN family = 'AntiHorn' AND arity - pos > 1 THEN 'antihorn_polarity' ELSE '' END AS problem FROM r) WHERE problem <> '' GROUP BY 1")
def exp14(spark, sf):
    r = rule_rows(spark, sf)
    return r.select(rule_problem(F.col("family"), F.col("combine"), F.col("lits")).alias("problem")).filter("problem <> ''").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("exp15_reading_length", f"""WITH {line_cte()}, w AS (SELECT rk, CASE WHEN q >= 30 OR d < 0.03 THEN CASE WHEN q >= 30 THEN ['q'] ELSE ['d'] END || CASE WHEN t >= 0.03 AND p < 60000 THEN ['t'] ELSE ['t', 'p'] END
      ELSE ['q', 'd'] || CASE WHEN (q >= 15) <> (d >= 0.06) THEN CASE WHEN q >= 15 THEN ['q'] ELSE ['d'] END ELSE ['q', 'd'] END END AS u FROM s) SELECT rk, len(list_distinct(u))::INT AS n_features FROM w""")
def exp15(spark, sf):
    return line_rows(spark, sf).select("rk", F.size(E.reading_features(fixed_model())).alias("n_features"))


@query("exp16_mean_length", f"WITH {GRID_SQL} SELECT rf, {rsql('avg(len)')} AS mean_len, count(*) AS n FROM ex GROUP BY 1")
def exp16(spark, sf):
    return rounded(explained(spark, sf).groupBy("rf").agg(F.avg("axp_len").alias("mean_len"), F.count(F.lit(1)).alias("n")), "mean_len")


@query("exp17_participation", f"""WITH {GRID_SQL}, n AS (SELECT rf, count(*) AS n FROM ex GROUP BY 1), f AS (SELECT rf, v.f AS feature, count(*) AS n_rows FROM ex JOIN (VALUES (0, 1), (1, 2), (2, 4), (3, 8)) v(f, bit) ON (m & v.bit) > 0 GROUP BY 1, 2)
    SELECT rf, feature, n_rows, {rsql('n_rows / n')} AS rate FROM f JOIN n USING (rf)""")
def exp17(spark, sf):
    return rounded(E.participation(explained(spark, sf), ["rf"]), "rate")


@query("exp18_size_distribution", f"WITH {GRID_SQL}, md AS (SELECT rf, quantile_cont(len, 0.5) AS median FROM ex GROUP BY 1) SELECT rf, len::INT AS axp_len, count(*) AS n, {rsql('any_value(median)')} AS median FROM ex JOIN md USING (rf) GROUP BY 1, 2")
def exp18(spark, sf):
    ex = explained(spark, sf)
    sizes = ex.groupBy("rf", "axp_len").agg(F.count(F.lit(1)).alias("n"))
    # weighted percentile over the few distinct lengths
    median = sizes.groupBy("rf").agg(F.percentile("axp_len", 0.5, F.col("n")).alias("median"))
    return rounded(sizes.join(median, "rf"), "median")


@query("exp19_metadata_summary", f"""WITH {STEPS_SQL}, c AS (SELECT tree_id, certificate, count(*) AS n FROM ce GROUP BY 1, 2)
    SELECT tree_id, CASE WHEN count(*) = 1 THEN any_value(certificate) ELSE 'mixed:' || string_agg(certificate || '=' || n, ',' ORDER BY certificate) END AS summary FROM c GROUP BY 1""")
def exp19(spark, sf):
    return value_summary(K.certificate(steps(spark, sf)), ["tree_id"], "certificate")


@query("snk5_explanations_csv", f"WITH {GRID_SQL} SELECT replace(axp, ',', ' ') AS axp, len::INT AS axp_len, rf AS task, count(*) AS n FROM ex GROUP BY ALL")
def snk5(spark, sf):
    path = scratch(spark, "axp")
    write_explanations(explained(spark, sf).select("rk", "axp", "axp_len", F.col("rf").alias("task")), path)
    back = spark.read.option("header", True).schema("rk string, axp string, axp_len int, task string").csv(path)
    return back.groupBy(F.coalesce("axp", F.lit("")).alias("axp"), "axp_len", "task").agg(F.count(F.lit(1)).alias("n"))
