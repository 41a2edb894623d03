"""Rules as columns, tree tables, scoring, pruning."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from rulespire.catalog.base import gain_sql, line_cte, line_rows, line_wide, load, query, rounded, rsql
from rulespire.config import FitConfig
from rulespire.functions import rules as R
from rulespire.functions.rules import AFFINE, ANTIHORN, CONJUI, HORN, SQUARE2CNF, Literal, Rule
from rulespire.functions.scores import information_gain
from rulespire.operators.prune import node_errors, prune
from rulespire.operators import binning as B
from rulespire.plans import model as M
from rulespire.plans.walk import leaves_of
from rulespire.plans.grow import fit_tree
from rulespire.plans.model import Node, TreeModel, score_rows
from rulespire.sources.sinks import load_model, save_model
from rulespire.sources.tables import LINE_FEATURES

_N = {f: i for i, f in enumerate(LINE_FEATURES)}


def L(f, op, t):
    return Literal(_N[f], op, t)


# --- a fixed depth-2 model, written once as rules and once as SQL ---------------------------

ROOT = Rule.of("or", HORN, L("q", "GE", 30.0), L("d", "LT", 0.03))
LEFT = Rule.of("and", CONJUI, L("t", "GE", 0.03), L("p", "LT", 60000.0))
RIGHT = Rule.of("xor", AFFINE, L("q", "GE", 15.0), L("d", "GE", 0.06))
CNF_RULE = Rule("cnf", ((L("q", "GE", 25.0), L("d", "LT", 0.03)), (L("t", "GE", 0.04), L("p", "LT", 50000.0))), SQUARE2CNF)
RULE_SQL = {"root": "(q >= 30 OR d < 0.03)", "left": "(t >= 0.03 AND p < 60000)", "right": "((q >= 15) <> (d >= 0.06))"}
PROBA = {4: 0.95, 5: 0.30, 6: 0.62, 7: 0.04, 2: 0.80, 3: 0.20, 1: 0.55}
LEAF_SQL = f"(CASE WHEN {RULE_SQL['root']} THEN CASE WHEN {RULE_SQL['left']} THEN 4 ELSE 5 END ELSE CASE WHEN {RULE_SQL['right']} THEN 6 ELSE 7 END END)"
PROBA_SQL = f"(CASE {LEAF_SQL} WHEN 4 THEN 0.95 WHEN 5 THEN 0.30 WHEN 6 THEN 0.62 ELSE 0.04 END)::DOUBLE"


def fixed_model() -> TreeModel:
    m = TreeModel(list(LINE_FEATURES))
    rules = {1: ROOT, 2: LEFT, 3: RIGHT}
    for node, p in PROBA.items():
        m.nodes[(0, node)] = Node(0, node, 0.0, 0.0, p, rules.get(node))
    return m


# --- RUL: rules as columns -----------------------------------------------------------------



def cols():
    return [F.col(f) for f in LINE_FEATURES]


def flags(spark, sf, **exprs):
    """Rows per supplier where each rule holds."""
    df = line_wide(spark, sf)
    return df.groupBy("supp").agg(*[F.count_if(e).alias(n) for n, e in exprs.items()])


def flags_sql(**conds):
    return f"WITH {line_cte()} SELECT supp, {', '.join(f'sum(({c})::INT)::BIGINT AS {n}' for n, c in conds.items())} FROM s GROUP BY 1"


@query("rul1_threshold_literal", flags_sql(ge="q >= 30", lt="d < 0.03"))
def rul1(spark, sf):
    return flags(spark, sf, ge=L("q", "GE", 30.0).column(cols()), lt=L("d", "LT", 0.03).column(cols()))


@query("rul2_negation", flags_sql(not_ge="NOT (q >= 30)", not_lt="NOT (d < 0.03)"))
def rul2(spark, sf):
    return flags(spark, sf, not_ge=L("q", "GE", 30.0).negate().column(cols()), not_lt=L("d", "LT", 0.03).negate().column(cols()))


@query("rul3_interval", """SELECT l_suppkey AS supp, l_linenumber AS ln, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS lo, CASE WHEN l_linenumber % 2 = 1 THEN l_quantity END AS hi, count(*) AS n FROM lineitem GROUP BY ALL""")
def rul3(spark, sf):
    """Every row read as a literal on quantity: GE on even line numbers, LT on odd ones."""
    li = load(spark, sf, "lineitem")
    op = F.when(F.col("l_linenumber") % 2 == 0, "GE").otherwise("LT")
    lit = F.struct(F.lit(0).alias("clause"), F.lit(0).alias("feature"), op.alias("op"), F.col("l_quantity").alias("threshold"))
    iv = li.withColumn("l", lit).withColumn("i", R.literal_interval(F.col("l")))
    finite = lambda c: F.when(F.abs(c) != float("inf"), c)
    return iv.groupBy(F.col("l_suppkey").alias("supp"), F.col("l_linenumber").alias("ln"), finite(F.col("i.lo")).alias("lo"), finite(F.col("i.hi")).alias("hi")).agg(F.count(F.lit(1)).alias("n"))


@query("rul4_column_literal", flags_sql(ge="q >= ln * 1", lt="NOT (q >= ln)"))
def rul4(spark, sf):
    lit = Literal(_N["q"], "GE", 0.0, _N["ln"])
    return flags(spark, sf, ge=lit.column(cols()), lt=lit.negate().column(cols()))


@query("rul5_compare_literal", flags_sql(le="d <= t", lt="d < t", ge="d >= t", gt="d > t", not_le="d > t"))
def rul5(spark, sf):
    c = {op.lower(): Literal(_N["d"], op, 0.0, _N["t"]).column(cols()) for op in ("LE", "LT", "GE", "GT")}
    return flags(spark, sf, **c, not_le=Literal(_N["d"], "LE", 0.0, _N["t"]).negate().column(cols()))


@query("rul6_or_rule", flags_sql(hit=RULE_SQL["root"]))
def rul6(spark, sf):
    return flags(spark, sf, hit=ROOT.column(cols()))


@query("rul7_and_rule", flags_sql(hit=RULE_SQL["left"]))
def rul7(spark, sf):
    return flags(spark, sf, hit=LEFT.column(cols()))


@query("rul8_xor_rule", flags_sql(hit=RULE_SQL["right"], three="((q >= 15)::INT + (d >= 0.06)::INT + (t >= 0.04)::INT) % 2 = 1"))
def rul8(spark, sf):
    three = Rule.of("xor", AFFINE, L("q", "GE", 15.0), L("d", "GE", 0.06), L("t", "GE", 0.04))
    return flags(spark, sf, hit=RIGHT.column(cols()), three=three.column(cols()))


@query("rul9_cnf_rule", flags_sql(hit="(q >= 25 OR d < 0.03) AND (t >= 0.04 OR p < 50000)"))
def rul9(spark, sf):
    return flags(spark, sf, hit=CNF_RULE.column(cols()))


def _known(f):
    """A feature is unknown on some rows; which ones depends on the row."""
    return {"q": "ln % 2 = 0", "d": "ln % 3 <> 0", "t": "ln < 5", "p": "ln <> 4"}[f]


def _partial_sql():
    null = ", ".join(f"CASE WHEN {_known(f)} THEN {f} END AS {f}" for f in ("q", "d", "t", "p"))
    parts = {"or_": RULE_SQL["root"], "and_": RULE_SQL["left"], "xor_": RULE_SQL["right"], "cnf_": "(q >= 25 OR d < 0.03) AND (t >= 0.04 OR p < 50000)"}
    out = ", ".join(f"CASE WHEN {c} IS NULL THEN 'unknown' WHEN {c} THEN 'true' ELSE 'false' END AS {n}" for n, c in ((k, f"({v})") for k, v in parts.items()))
    return f"WITH {line_cte()}, k AS (SELECT supp, {null} FROM s), e AS (SELECT supp, {out} FROM k) SELECT supp, or_, and_, xor_, cnf_, count(*) AS n FROM e GROUP BY ALL"


@query("rul10_partial_evaluation", _partial_sql())
def rul10(spark, sf):
    df = line_wide(spark, sf)
    known = df.withColumns({f: F.when(F.expr(_known(f)), F.col(f)) for f in ("q", "d", "t", "p")})
    word = lambda c: F.when(c.isNull(), "unknown").when(c, "true").otherwise("false")
    out = known.select("supp", *[word(r.column(cols())).alias(n) for n, r in (("or_", ROOT), ("and_", LEFT), ("xor_", RIGHT), ("cnf_", CNF_RULE))])
    return out.groupBy("supp", "or_", "and_", "xor_", "cnf_").agg(F.count(F.lit(1)).alias("n"))


# --- a rule table derived from the rows: one rule per line --------------------------------------

RULE_ROWS_SQL = """x AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rk, 1 + l_linenumber % 3 AS arity,
      CASE l_returnflag WHEN 'R' THEN 'Horn' WHEN 'A' THEN 'AntiHorn' ELSE CASE WHEN l_linestatus = 'F' THEN 'ConjUI' ELSE 'Affine' END END AS family,
      l_quantity >= 25 AS s0, l_discount >= 0.05 AS s1, l_tax >= 0.04 AS s2, l_quantity AS t0, l_discount + 0.0 AS t1, l_tax + 0.0 AS t2 FROM lineitem),
    r AS (SELECT *, CASE family WHEN 'ConjUI' THEN 'and' WHEN 'Affine' THEN 'xor' ELSE 'or' END AS combine,
      s0::INT + CASE WHEN arity > 1 THEN s1::INT ELSE 0 END + CASE WHEN arity > 2 THEN s2::INT ELSE 0 END AS pos FROM x)"""


def rule_rows(spark, sf):
    li = load(spark, sf, "lineitem")
    family = F.when(F.col("l_returnflag") == "R", HORN).when(F.col("l_returnflag") == "A", ANTIHORN).when(F.col("l_linestatus") == "F", CONJUI).otherwise(AFFINE)
    op = lambda c: F.when(c, "GE").otherwise("LT")
    lit = lambda i, s, t: F.struct(F.lit(0).alias("clause"), F.lit(i).alias("feature"), op(s).alias("op"), (t + F.lit(0.0)).alias("threshold"))
    lits = F.array(lit(0, F.col("l_quantity") >= 25, F.col("l_quantity")), lit(1, F.col("l_discount") >= 0.05, F.col("l_discount")), lit(2, F.col("l_tax") >= 0.04, F.col("l_tax")))
    rk = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = li.select(rk.alias("rk"), family.alias("family"), F.slice(lits, 1, 1 + F.col("l_linenumber") % 3).alias("lits"))
    combine = F.when(F.col("family") == CONJUI, "and").when(F.col("family") == AFFINE, "xor").otherwise("or")
    return out.withColumn("combine", combine)


@query("rul11_shape_check", f"WITH {RULE_ROWS_SQL} SELECT family, arity::INT AS arity, problem, count(*) AS n FROM (SELECT *, CASE WHEN family = 'Horn' AND pos > 1 THEN 'horn_polarity' WHEN family = 'AntiHorn' AND arity - pos > 1 THEN 'antihorn_polarity' ELSE '' END AS problem FROM r) GROUP BY ALL")
def rul11(spark, sf):
    r = rule_rows(spark, sf)
    return r.groupBy("family", F.size("lits").alias("arity"), R.rule_problem(F.col("family"), F.col("combine"), F.col("lits")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query("rul12_pattern_label", f"""WITH {RULE_ROWS_SQL} SELECT label, count(*) AS n FROM (SELECT CASE WHEN combine = 'xor' THEN 'AFF_' || arity || 'D' WHEN family = 'ConjUI' THEN CASE WHEN arity = 1 THEN 'CONJ_UI_1L' ELSE 'CONJ_UI_' || arity || 'D_' || CASE WHEN pos IN (0, arity) THEN 'ALL' ELSE 'MIX' END END
      WHEN family = 'AntiHorn' THEN CASE WHEN arity = 1 THEN CASE WHEN pos = 1 THEN 'AH_1L_POS' ELSE 'AH_1L_NEG' END WHEN pos = arity THEN 'AH_' || arity || 'L_ALL_POS' ELSE 'AH_' || arity || 'L_NEG_' || CASE WHEN NOT s0 THEN 0 WHEN NOT s1 THEN 1 ELSE 2 END END
      ELSE CASE WHEN arity = 1 THEN CASE WHEN pos = 1 THEN '1L_POS' ELSE '1L_NEG' END WHEN pos = 0 THEN arity || 'L_ALL_NEG' ELSE arity || 'L_POS_' || CASE WHEN s0 THEN 0 WHEN s1 THEN 1 ELSE 2 END END END AS label FROM r) GROUP BY 1""")
def rul12(spark, sf):
    r = rule_rows(spark, sf)
    return r.groupBy(R.pattern_label(F.col("family"), F.col("combine"), F.col("lits")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


_LT = lambda i, neg=False: f"'x[{i}]' || CASE WHEN {'NOT ' if neg else ''}s{i} THEN ' >= ' ELSE ' < ' END || format('{{:.4f}}', t{i})"


@query("rul13_rule_text", f"""WITH {RULE_ROWS_SQL}, g AS (SELECT *, CASE combine WHEN 'and' THEN ' & ' WHEN 'xor' THEN ' ^ ' ELSE ' | ' END AS glue FROM r),
    h AS (SELECT *, CASE WHEN s0 THEN {_LT(0)} WHEN arity > 1 AND s1 THEN {_LT(1)} WHEN arity > 2 AND s2 THEN {_LT(2)} END AS head,
      concat_ws(' & ', CASE WHEN NOT s0 THEN {_LT(0, True)} END, CASE WHEN arity > 1 AND NOT s1 THEN {_LT(1, True)} END, CASE WHEN arity > 2 AND NOT s2 THEN {_LT(2, True)} END) AS body FROM g)
    SELECT rk, {_LT(0)} || CASE WHEN arity > 1 THEN glue || {_LT(1)} ELSE '' END || CASE WHEN arity > 2 THEN glue || {_LT(2)} ELSE '' END AS text,
      CASE WHEN head IS NULL THEN body || ' -> false' WHEN body = '' THEN 'true -> ' || head ELSE body || ' -> ' || head END AS implication FROM h""")
def rul13(spark, sf):
    r = rule_rows(spark, sf)
    return r.select("rk", R.rule_text(F.col("combine"), F.col("lits")).alias("text"), R.implication_text(F.col("lits")).alias("implication"))


@query("rul14_features_used", f"WITH {RULE_ROWS_SQL} SELECT family, CASE arity WHEN 1 THEN '0' WHEN 2 THEN '0,1' ELSE '0,1,2' END AS features, count(*) AS n, sum(arity)::BIGINT AS n_literals FROM r GROUP BY 1, 2")
def rul14(spark, sf):
    r = rule_rows(spark, sf)
    feats = F.array_join(F.transform(R.features_used(F.col("lits")), lambda f: f.cast("string")), ",")
    return r.groupBy("family", feats.alias("features")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("lits").cast("bigint")).alias("n_literals"))


# --- one tree per supplier, thresholds from its rows ------------------------------------------------

THR_SQL = """thr AS (SELECT l_suppkey AS tree_id, floor(sum(l_quantity::BIGINT) / count(*))::DOUBLE AS tq, floor(sum(round(l_discount * 100)::BIGINT) / count(*)) / 100.0::DOUBLE AS td,
      floor(sum(round(l_tax * 100)::BIGINT) / count(*)) / 100.0::DOUBLE AS tt FROM lineitem GROUP BY 1)"""
LITS_SQL = """lits AS (SELECT * FROM (
      SELECT tree_id, 1 AS node_id, 'Horn' AS family, 'or' AS combine, 0 AS clause, 0 AS pos, 0 AS feature, 'GE' AS op, tq AS threshold FROM thr
      UNION ALL SELECT tree_id, 1, 'Horn', 'or', 0, 1, 2, 'LT', td FROM thr
      UNION ALL SELECT tree_id, 2, CASE tree_id % 3 WHEN 0 THEN 'ConjUI' WHEN 1 THEN 'Square2CNF' ELSE 'AntiHorn' END, CASE tree_id % 3 WHEN 0 THEN 'and' WHEN 1 THEN 'cnf' ELSE 'or' END, 0, 0, CASE WHEN tree_id % 3 = 2 THEN 0 ELSE 3 END, 'GE', CASE WHEN tree_id % 3 = 2 THEN tq + 10 ELSE tt END FROM thr
      UNION ALL SELECT tree_id, 2, CASE tree_id % 3 WHEN 0 THEN 'ConjUI' WHEN 1 THEN 'Square2CNF' ELSE 'AntiHorn' END, CASE tree_id % 3 WHEN 0 THEN 'and' WHEN 1 THEN 'cnf' ELSE 'or' END, 0, 1, CASE WHEN tree_id % 3 = 2 THEN 3 ELSE 0 END, 'LT', CASE WHEN tree_id % 3 = 2 THEN tt ELSE tq + 10 END FROM thr
      UNION ALL SELECT tree_id, 2, 'Square2CNF', 'cnf', 1, 2, 2, 'GE', td FROM thr WHERE tree_id % 3 = 1
      UNION ALL SELECT tree_id, 2, 'Square2CNF', 'cnf', 1, 3, 1, 'LT', 50000.0 FROM thr WHERE tree_id % 3 = 1
      UNION ALL SELECT tree_id, 3, CASE WHEN tree_id % 2 = 0 THEN 'Affine' ELSE 'Horn' END, CASE WHEN tree_id % 2 = 0 THEN 'xor' ELSE 'or' END, 0, 0, CASE WHEN tree_id % 2 = 0 THEN 2 ELSE 0 END, CASE WHEN tree_id % 2 = 0 THEN 'GE' ELSE 'LT' END, CASE WHEN tree_id % 2 = 0 THEN td + 0.02 ELSE tq - 5 END FROM thr
      UNION ALL SELECT tree_id, 3, 'Affine', 'xor', 0, 1, 3, 'GE', tt FROM thr WHERE tree_id % 2 = 0))"""
ROUTE_SQL = f"""rt AS (SELECT s.*, thr.tree_id, CASE WHEN (q >= tq OR d < td) THEN
        CASE WHEN (CASE tree_id % 3 WHEN 0 THEN t >= tt AND q < tq + 10 WHEN 1 THEN (t >= tt OR q < tq + 10) AND (d >= td OR p < 50000) ELSE q >= tq + 10 OR t < tt END) THEN 4 ELSE 5 END
      ELSE CASE WHEN (CASE WHEN tree_id % 2 = 0 THEN (d >= td + 0.02) <> (t >= tt) ELSE q < tq - 5 END) THEN 6 ELSE 7 END END AS leaf FROM s JOIN thr ON supp = tree_id)"""
NODES_SQL = f"""{line_cte()}, {THR_SQL}, {LITS_SQL}, {ROUTE_SQL}, lf AS (SELECT tree_id, leaf, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM rt GROUP BY 1, 2),
    nc AS (SELECT tree_id, node_id::BIGINT AS node_id, sum(pos) AS n_pos, sum(neg) AS n_neg FROM (SELECT tree_id, leaf AS node_id, pos, neg FROM lf UNION ALL SELECT tree_id, leaf // 2, pos, neg FROM lf UNION ALL SELECT tree_id, 1, pos, neg FROM lf) GROUP BY 1, 2),
    rl AS (SELECT tree_id, node_id, any_value(family) AS family, any_value(combine) AS combine, count(*) AS n_lits, count(DISTINCT clause) AS n_clauses, sum((op = 'GE')::INT) AS n_ge FROM lits GROUP BY 1, 2),
    nodes AS (SELECT nc.tree_id, nc.node_id, CASE WHEN nc.node_id = 1 THEN 0 WHEN nc.node_id < 4 THEN 1 ELSE 2 END AS depth, nc.n_pos + nc.n_neg AS n, nc.n_pos, nc.n_neg, (nc.n_pos + 1.0) / (nc.n_pos + nc.n_neg + 2.0) AS proba, nc.node_id >= 4 AS is_leaf,
      rl.family, rl.combine, CASE WHEN rl.combine = 'cnf' THEN n_clauses ELSE coalesce(n_lits, 0) END AS arity, coalesce(n_lits, 0) AS n_lits,
      CASE WHEN nc.node_id < 4 THEN round({gain_sql('nc.n_pos', 'nc.n_neg', 'coalesce(k.n_pos, 0.0)', 'coalesce(k.n_neg, 0.0)')}, 9) ELSE 0.0 END AS gain
      FROM nc LEFT JOIN rl ON rl.tree_id = nc.tree_id AND rl.node_id = nc.node_id LEFT JOIN nc k ON k.tree_id = nc.tree_id AND k.node_id = nc.node_id * 2 AND nc.node_id < 4)"""


def thresholds(spark, sf):
    li = load(spark, sf, "lineitem")
    mean = lambda c: F.floor(F.sum(c) / F.count(F.lit(1)))
    return li.groupBy(F.col("l_suppkey").alias("tree_id")).agg(
        mean(F.col("l_quantity").cast("bigint")).cast("double").alias("tq"),
        (mean(F.round(F.col("l_discount") * 100).cast("bigint")) / 100.0).alias("td"),
        (mean(F.round(F.col("l_tax") * 100).cast("bigint")) / 100.0).alias("tt"))


def supplier_rules(spark, sf):
    """(tree_id, node_id, family, combine, lits) of one depth-2 tree per supplier."""
    t = thresholds(spark, sf)
    lit = lambda c, f, op, v: F.struct(F.lit(c).alias("clause"), F.lit(f).alias("feature"), F.lit(op).alias("op"), v.cast("double").alias("threshold"))
    tq, td, tt = F.col("tq"), F.col("td"), F.col("tt")
    kind3, kind2 = F.col("tree_id") % 3, F.col("tree_id") % 2
    rule = lambda node, family, combine, lits: F.struct(F.lit(node).cast("bigint").alias("node_id"), family.alias("family"), combine.alias("combine"), lits.alias("lits"))
    two = F.when(kind3 == 0, F.array(lit(0, 3, "GE", tt), lit(0, 0, "LT", tq + 10))).when(
        kind3 == 1, F.array(lit(0, 3, "GE", tt), lit(0, 0, "LT", tq + 10), lit(1, 2, "GE", td), lit(1, 1, "LT", F.lit(50000.0)))).otherwise(
        F.array(lit(0, 0, "GE", tq + 10), lit(0, 3, "LT", tt)))
    three = F.when(kind2 == 0, F.array(lit(0, 2, "GE", td + 0.02), lit(0, 3, "GE", tt))).otherwise(F.array(lit(0, 0, "LT", tq - 5)))
    pick3 = lambda a, b, c: F.when(kind3 == 0, a).when(kind3 == 1, b).otherwise(c)
    rows = F.array(
        rule(1, F.lit(HORN), F.lit("or"), F.array(lit(0, 0, "GE", tq), lit(0, 2, "LT", td))),
        rule(2, pick3(CONJUI, SQUARE2CNF, ANTIHORN), pick3("and", "cnf", "or"), two),
        rule(3, F.when(kind2 == 0, AFFINE).otherwise(HORN), F.when(kind2 == 0, "xor").otherwise("or"), three))
    return t.select("tree_id", F.inline(rows))


def routed(spark, sf):
    """Rows with the leaf of their supplier's tree (joined on the supplier key)."""
    df = line_wide(spark, sf).withColumnRenamed("supp", "tree_id")
    j = df.join(thresholds(spark, sf), "tree_id")
    q, p, d, t = (F.col(c) for c in ("q", "p", "d", "t"))
    tq, td, tt = F.col("tq"), F.col("td"), F.col("tt")
    kind3, kind2 = F.col("tree_id") % 3, F.col("tree_id") % 2
    n1 = (q >= tq) | (d < td)
    n2 = F.when(kind3 == 0, (t >= tt) & (q < tq + 10)).when(kind3 == 1, ((t >= tt) | (q < tq + 10)) & ((d >= td) | (p < 50000))).otherwise((q >= tq + 10) | (t < tt))
    n3 = F.when(kind2 == 0, (d >= td + 0.02) != (t >= tt)).otherwise(q < tq - 5)
    leaf = F.when(n1, F.when(n2, 4).otherwise(5)).otherwise(F.when(n3, 6).otherwise(7))
    return j.withColumn("leaf", leaf.cast("bigint"))


def supplier_nodes(spark, sf):
    """Node table of all supplier trees with counts, probabilities and gains from their rows."""
    leaves = routed(spark, sf).groupBy("tree_id", "leaf").agg(F.sum("y").cast("double").alias("pos"), F.sum(1 - F.col("y")).cast("double").alias("neg"))
    up = leaves.withColumn("node_id", F.explode(F.array(F.col("leaf"), F.floor(F.col("leaf") / 2), F.lit(1).cast("bigint"))))
    counts = up.groupBy("tree_id", "node_id").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    true_child = counts.filter("node_id % 2 = 0").select("tree_id", (F.col("node_id") / 2).cast("bigint").alias("node_id"), F.col("n_pos").alias("ip"), F.col("n_neg").alias("ineg"))
    n = counts.join(supplier_rules(spark, sf), ["tree_id", "node_id"], "left").join(true_child, ["tree_id", "node_id"], "left").na.fill({"ip": 0.0, "ineg": 0.0})
    leaf = F.col("node_id") >= 4
    clauses = F.size(F.array_distinct(F.transform("lits", lambda l: l.clause)))
    gain = information_gain(F.col("n_pos"), F.col("n_neg"), F.col("ip"), F.col("ineg"))
    return n.select(
        "tree_id", "node_id", F.when(F.col("node_id") == 1, 0).when(F.col("node_id") < 4, 1).otherwise(2).alias("depth"),
        (F.col("n_pos") + F.col("n_neg")).alias("n"), "n_pos", "n_neg", ((F.col("n_pos") + 1.0) / (F.col("n_pos") + F.col("n_neg") + 2.0)).alias("proba"), leaf.alias("is_leaf"),
        "family", "combine", F.when(leaf, 0).when(F.col("combine") == "cnf", clauses).otherwise(F.size("lits")).alias("arity"), "lits",
        F.when(leaf, F.lit(0.0)).otherwise(F.round(gain, 9)).alias("gain"))


# --- TRE ------------------------------------------------------------------------------------------------


@query("tre1_fit_tree")
def tre1(spark, sf):
    """A fit on all rows; its nodes are checked by tests (counts, planted rule, brute force)."""
    m = fit_tree(line_rows(spark, sf, "or2"), "y", LINE_FEATURES, FitConfig(max_depth=2, search_3d=False))
    return m.frame(spark).select("node_id", "depth", "n_pos", "n_neg", "is_leaf", "stop_reason", "family", "pattern", F.round("gain", 6).alias("gain"))


@query("tre1_planted_root", f"""WITH {line_cte('or2')} SELECT 'q >= 29.5 | d < 0.025' AS root, sum(CASE WHEN q >= 29.5 OR d < 0.025 THEN y ELSE 0 END)::DOUBLE AS true_pos, sum(CASE WHEN q >= 29.5 OR d < 0.025 THEN 1 - y ELSE 0 END)::DOUBLE AS true_neg FROM s""")
def tre1b(spark, sf):
    """The root of a fit on planted data must be the planted rule with its exact counts."""
    m = fit_tree(line_rows(spark, sf, "or2"), "y", LINE_FEATURES, FitConfig(max_depth=1, search_3d=False))
    lits = sorted(m.nodes[(0, 1)].rule.literals, key=lambda l: l.feature)
    text = " | ".join(f"{LINE_FEATURES[l.feature]} {'>=' if l.op == 'GE' else '<'} {round(l.threshold, 6):g}" for l in lits)
    return m.frame(spark).filter("node_id = 2").select(F.lit(text).alias("root"), F.col("n_pos").alias("true_pos"), F.col("n_neg").alias("true_neg"))


@query("tre2_node_statistics", f"WITH {NODES_SQL} SELECT tree_id, node_id, n, n_pos, n_neg, {rsql('proba')} AS proba FROM nodes")
def tre2(spark, sf):
    return rounded(supplier_nodes(spark, sf).select("tree_id", "node_id", "n", "n_pos", "n_neg", "proba"), "proba")


@query("tre3_stop_rules", f"""WITH {NODES_SQL} SELECT tree_id, node_id, CASE WHEN depth >= 2 THEN 'MAX_DEPTH' WHEN n < 150 THEN 'MIN_SPLIT' WHEN n_pos = 0 OR n_neg = 0 THEN 'PURE' WHEN greatest(n_pos, n_neg) / n >= 0.9 THEN 'PURITY' WHEN gain < 0.01 THEN 'MIN_GAIN' WHEN gain - 0.1 * depth < 0 THEN 'COMPLEXITY' ELSE 'CONTINUE' END AS reason FROM nodes""")
def tre3(spark, sf):
    n = supplier_nodes(spark, sf)
    reason = (
        F.when(F.col("depth") >= 2, "MAX_DEPTH").when(F.col("n") < 150, "MIN_SPLIT").when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), "PURE")
        .when(F.greatest("n_pos", "n_neg") / F.col("n") >= 0.9, "PURITY").when(F.col("gain") < 0.01, "MIN_GAIN")
        .when(F.col("gain") - 0.1 * F.col("depth") < 0, "COMPLEXITY").otherwise("CONTINUE"))
    return n.select("tree_id", "node_id", reason.alias("reason"))


@query("tre4_score_inheritance", f"WITH {NODES_SQL} SELECT tree_id, node_id, CASE WHEN depth = 0 THEN 'mutual_information' WHEN depth <= 2 AND n >= 100 THEN 'gain' ELSE 'inherited' END AS source, CASE WHEN depth = 0 OR (depth <= 2 AND n >= 100) THEN node_id WHEN depth > 1 AND (SELECT n FROM nodes p WHERE p.tree_id = nodes.tree_id AND p.node_id = nodes.node_id // 2) >= 100 THEN node_id // 2 ELSE 1 END::BIGINT AS score_node FROM nodes")
def tre4(spark, sf):
    n = supplier_nodes(spark, sf).select("tree_id", "node_id", "depth", "n")
    parent = n.select("tree_id", F.col("node_id").alias("up"), F.col("n").alias("n_up"))
    j = n.withColumn("up", F.floor(F.col("node_id") / 2)).join(parent, ["tree_id", "up"], "left")
    fresh = (F.col("depth") == 0) | ((F.col("depth") <= 2) & (F.col("n") >= 100))
    source = F.when(F.col("depth") == 0, "mutual_information").when(fresh, "gain").otherwise("inherited")
    where = F.when(fresh, F.col("node_id")).when((F.col("depth") > 1) & (F.col("n_up") >= 100), F.col("up")).otherwise(F.lit(1))
    return j.select("tree_id", "node_id", source.alias("source"), where.cast("bigint").alias("score_node"))


@query("tre5_strict_family", f"WITH {NODES_SQL} SELECT expected, sum((family = expected)::INT)::BIGINT AS n_kept, sum((family <> expected)::INT)::BIGINT AS n_turned_leaf FROM nodes, (VALUES ('Horn'), ('ConjUI'), ('Affine')) e(expected) WHERE NOT is_leaf GROUP BY 1")
def tre5(spark, sf):
    n = supplier_nodes(spark, sf).filter(~F.col("is_leaf")).withColumn("expected", F.explode(F.array(*[F.lit(f) for f in (HORN, CONJUI, AFFINE)])))
    return n.groupBy("expected").agg(F.count_if(F.col("family") == F.col("expected")).alias("n_kept"), F.count_if(F.col("family") != F.col("expected")).alias("n_turned_leaf"))


@query("tre6_path_bounds", f"""WITH {THR_SQL}, {LITS_SQL}, b AS (SELECT tree_id, child, feature, max(CASE WHEN op = 'LT' THEN threshold END) AS lo, min(CASE WHEN op = 'GE' THEN threshold END) AS hi FROM (
      SELECT tree_id, 3 AS child, feature, op, threshold FROM lits WHERE node_id = 1 AND combine <> 'xor' UNION ALL SELECT tree_id, 5, feature, op, threshold FROM lits WHERE node_id = 2 AND combine <> 'xor'
      UNION ALL SELECT tree_id, 7, feature, op, threshold FROM lits WHERE node_id IN (1, 3) AND combine <> 'xor' UNION ALL SELECT tree_id, 6, feature, op, threshold FROM lits WHERE node_id = 1 AND combine <> 'xor') GROUP BY 1, 2, 3)
    SELECT tree_id, child::BIGINT AS node_id, feature, round(lo, 6) AS lo, round(hi, 6) AS hi FROM b""")
def tre6(spark, sf):
    """Bounds of nodes below false branches: every literal of a false rule bounds its feature, as in growth."""
    b = M.path_bounds(supplier_nodes(spark, sf))
    return b.select("tree_id", "node_id", "feature", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


_BOUNDS_SQL = f"""{THR_SQL}, {LITS_SQL}, paths AS (SELECT DISTINCT n.tree_id, n.node_id, a.up FROM (SELECT tree_id, unnest([2, 3, 4, 5, 6, 7]) AS node_id FROM thr) n
      JOIN (VALUES (3, 1), (5, 2), (6, 1), (7, 1), (7, 3)) a(node_id, up) USING (node_id)),
    bounds AS (SELECT p.tree_id, p.node_id, feature, max(CASE WHEN op = 'LT' THEN threshold END) AS lo, min(CASE WHEN op = 'GE' THEN threshold END) AS hi
      FROM paths p JOIN lits l ON l.tree_id = p.tree_id AND l.node_id = p.up WHERE combine <> 'xor' GROUP BY 1, 2, 3)"""


@query("bin8_live_features", f"""WITH {_BOUNDS_SQL} SELECT tree_id, node_id::BIGINT AS node_id, feature, round(lo, 6) AS lo, round(hi, 6) AS hi, coalesce(lo, '-inf'::DOUBLE) < coalesce(hi, 'inf'::DOUBLE) AS live FROM bounds""")
def bin8(spark, sf):
    """Features of every node with bounds, and whether their path interval still holds a value."""
    b = M.path_bounds(supplier_nodes(spark, sf))
    live = B.live_features(b.withColumns({"lo": F.coalesce("lo", F.lit(float("-inf"))), "hi": F.coalesce("hi", F.lit(float("inf")))})).select("tree_id", "node_id", "feature", F.lit(True).alias("live"))
    out = b.join(live, ["tree_id", "node_id", "feature"], "left").na.fill({"live": False})
    return out.select("tree_id", "node_id", "feature", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "live")


@query("tre7_route_rows", f"WITH {line_cte()}, {THR_SQL}, {ROUTE_SQL} SELECT tree_id, leaf::BIGINT AS leaf, count(*) AS n FROM rt GROUP BY 1, 2")
def tre7(spark, sf):
    return routed(spark, sf).groupBy("tree_id", "leaf").agg(F.count(F.lit(1)).alias("n"))


@query("tre8_split_counters", f"WITH {NODES_SQL} SELECT tree_id, family, count(*) AS n_splits FROM nodes WHERE NOT is_leaf GROUP BY 1, 2")
def tre8(spark, sf):
    return M.split_counters(supplier_nodes(spark, sf), ["tree_id"], "family")


IMPORTANCE_SQL = f"""{NODES_SQL}, u AS (SELECT DISTINCT n.tree_id, n.node_id, l.feature, n.gain / n.arity AS g FROM nodes n JOIN lits l ON l.tree_id = n.tree_id AND l.node_id = n.node_id WHERE NOT n.is_leaf),
    imp AS (SELECT tree_id, feature, CASE WHEN sum(sum(g)) OVER (PARTITION BY tree_id) > 0 THEN sum(g) / sum(sum(g)) OVER (PARTITION BY tree_id) ELSE sum(g) END AS importance FROM u GROUP BY 1, 2)"""


@query("tre9_importance", f"WITH {IMPORTANCE_SQL} SELECT tree_id, feature, {rsql('importance')} AS importance FROM imp")
def tre9(spark, sf):
    return rounded(M.importance(supplier_nodes(spark, sf), ["tree_id"]), "importance")


@query("tre10_predict", f"WITH {line_cte()} SELECT rk, {PROBA_SQL} AS proba, ({PROBA_SQL} >= 0.5)::INT AS pred FROM s")
def tre10(spark, sf):
    return score_rows(line_rows(spark, sf), fixed_model()).select("rk", "proba", "pred")


@query("tre11_decision_trace", f"WITH {line_cte()} SELECT rk, {LEAF_SQL}::BIGINT AS leaf, '1>' || ({LEAF_SQL} // 2) || '>' || {LEAF_SQL} AS trace FROM s")
def tre11(spark, sf):
    out = line_rows(spark, sf).withColumn("leaf", leaves_of(spark, fixed_model())[0])
    return out.select("rk", "leaf", F.array_join(F.transform(M.decision_trace(F.col("leaf")), lambda n: n.cast("string")), ">").alias("trace"))


@query("tre12_accuracy", f"WITH {line_cte()} SELECT rf, {rsql(f'avg(((({PROBA_SQL}) >= 0.5)::INT = y)::INT)')} AS accuracy FROM s GROUP BY 1")
def tre12(spark, sf):
    return rounded(M.accuracy(score_rows(line_wide(spark, sf), fixed_model()), "pred", "y", ["rf"]), "accuracy")


@query("tre13_summary", f"WITH {NODES_SQL} SELECT tree_id, count(*) AS n_nodes, sum(is_leaf::INT)::BIGINT AS n_leaves, sum((NOT is_leaf)::INT)::BIGINT AS n_internal, max(depth) AS max_depth FROM nodes GROUP BY 1")
def tre13(spark, sf):
    return M.tree_summary(supplier_nodes(spark, sf), ["tree_id"])


@query("tre14_structure", f"""WITH {NODES_SQL} SELECT tree_id, sum(is_leaf::INT)::BIGINT AS n_leaves, max(CASE WHEN is_leaf THEN depth END) AS max_leaf_depth, {rsql('avg(CASE WHEN is_leaf THEN depth END)')} AS avg_leaf_depth,
    {rsql('coalesce(avg(CASE WHEN NOT is_leaf THEN arity END), 0.0)')} AS avg_arity, coalesce(max(CASE WHEN NOT is_leaf THEN arity END), 0)::INT AS max_arity, coalesce(sum(CASE WHEN NOT is_leaf THEN n_lits END), 0)::BIGINT AS total_literals FROM nodes GROUP BY 1""")
def tre14(spark, sf):
    return rounded(M.structure_metrics(supplier_nodes(spark, sf), ["tree_id"]), "avg_leaf_depth", "avg_arity")


@query("tre15_printed_tree", f"""WITH {NODES_SQL}, c AS (SELECT tree_id, node_id, clause, any_value(combine) AS combine, string_agg('x[' || feature || '] ' || CASE op WHEN 'GE' THEN '>=' ELSE '<' END || ' ' || format('{{:.4f}}', threshold), CASE any_value(combine) WHEN 'x' THEN '' ELSE '@' END ORDER BY pos) AS txt FROM lits GROUP BY 1, 2, 3),
    t AS (SELECT tree_id, node_id, CASE any_value(combine) WHEN 'cnf' THEN string_agg('(' || replace(txt, '@', ' | ') || ')', ' & ' ORDER BY clause) WHEN 'and' THEN replace(any_value(txt), '@', ' & ') WHEN 'xor' THEN replace(any_value(txt), '@', ' ^ ') ELSE replace(any_value(txt), '@', ' | ') END AS txt FROM c GROUP BY 1, 2)
    SELECT n.tree_id, n.node_id, repeat('  ', n.depth) || CASE WHEN n.is_leaf THEN 'leaf ' || (n.proba >= 0.5)::INT || ' n=' || n.n::BIGINT ELSE 'if ' || t.txt END AS line FROM nodes n LEFT JOIN t ON t.tree_id = n.tree_id AND t.node_id = n.node_id""".replace("CASE any_value(combine) WHEN 'x' THEN '' ELSE '@' END ORDER BY pos", "'@' ORDER BY pos"))
def tre15(spark, sf):
    n = supplier_nodes(spark, sf)
    leaf = F.concat(F.lit("leaf "), (F.col("proba") >= 0.5).cast("int").cast("string"), F.lit(" n="), F.col("n").cast("bigint").cast("string"))
    text = F.when(F.col("is_leaf"), leaf).otherwise(F.concat(F.lit("if "), R.rule_text(F.col("combine"), F.col("lits"))))
    return n.select("tree_id", "node_id", F.concat(F.repeat(F.lit("  "), F.col("depth")), text).alias("line"))


@query("tre16_root_paths", f"""WITH {NODES_SQL} SELECT tree_id, node_id AS leaf_id, 0 AS step, 1::BIGINT AS node_id, node_id < 6 AS taken FROM nodes WHERE is_leaf UNION ALL SELECT tree_id, node_id, 1, node_id // 2, node_id % 2 = 0 FROM nodes WHERE is_leaf""")
def tre16(spark, sf):
    return M.root_paths(supplier_nodes(spark, sf), 2)


@query("tre17_majority_leaf", f"WITH {NODES_SQL} SELECT tree_id, node_id, (n_pos >= n_neg)::INT AS cls FROM nodes WHERE is_leaf")
def tre17(spark, sf):
    n = supplier_nodes(spark, sf).filter("is_leaf")
    return n.select("tree_id", "node_id", (F.col("n_pos") >= F.col("n_neg")).cast("int").alias("cls"))


@query("tre18_axis_baseline")
def tre18(spark, sf):
    from rulespire.plans.grid import axis_predict, axis_tree

    df = line_rows(spark, sf, "or2")
    scored = axis_predict(df, axis_tree(df, "y", LINE_FEATURES))
    return rounded(M.accuracy(scored, "pred", "y"), "accuracy")


@query("tre19_axis_path_length")
def tre19(spark, sf):
    from rulespire.plans.grid import axis_path_lengths, axis_tree

    df = line_rows(spark, sf, "or2")
    rows = axis_path_lengths(df, axis_tree(df, "y", LINE_FEATURES))
    return rounded(rows.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.avg("path_length").alias("mean_path_length")), "mean_path_length")


# --- PRU ---------------------------------------------------------------------------------------------------

_NODE_PRED = "(VALUES (1, 1), (2, 1), (3, 0), (4, 1), (5, 0), (6, 1), (7, 0)) c(node_id, cls)"
PRUNE_SQL = f"""{line_cte()}, v AS (SELECT rf, y, {LEAF_SQL} AS leaf FROM s), a AS (SELECT rf, y, leaf, leaf AS node_id FROM v UNION ALL SELECT rf, y, leaf, leaf // 2 FROM v UNION ALL SELECT rf, y, leaf, 1 FROM v),
    st AS (SELECT rf, a.node_id, count(*) AS n, sum((c.cls <> y)::INT)::BIGINT AS leaf_errors, sum(((CASE leaf WHEN 4 THEN 1 WHEN 6 THEN 1 ELSE 0 END) <> y)::INT)::BIGINT AS subtree_errors FROM a JOIN {_NODE_PRED} ON c.node_id = a.node_id GROUP BY 1, 2)"""


@query("pru1_node_errors", f"WITH {PRUNE_SQL} SELECT rf, node_id::BIGINT AS node_id, n, leaf_errors, subtree_errors FROM st")
def pru1(spark, sf):
    return node_errors(line_wide(spark, sf), fixed_model(), "y", keys=["rf"])


_A = 0.01


@query("pru2_pruned_tree", f"""WITH {PRUNE_SQL.replace('rf, ', '').replace('SELECT rf,', 'SELECT').replace('GROUP BY 1, 2)', 'GROUP BY 1)')}, d AS (SELECT node_id, n, leaf_errors::DOUBLE / n AS le FROM st),
    two AS (SELECT (SELECT le FROM d WHERE node_id = 2) + {_A} <= ((SELECT leaf_errors FROM st WHERE node_id = 4) + (SELECT leaf_errors FROM st WHERE node_id = 5))::DOUBLE / (SELECT n FROM d WHERE node_id = 2) + {_A} * 2 AS cut),
    three AS (SELECT (SELECT le FROM d WHERE node_id = 3) + {_A} <= ((SELECT leaf_errors FROM st WHERE node_id = 6) + (SELECT leaf_errors FROM st WHERE node_id = 7))::DOUBLE / (SELECT n FROM d WHERE node_id = 3) + {_A} * 2 AS cut),
    root AS (SELECT (SELECT le FROM d WHERE node_id = 1) + {_A} <= ((SELECT CASE WHEN cut THEN (SELECT leaf_errors FROM st WHERE node_id = 2) ELSE (SELECT sum(leaf_errors) FROM st WHERE node_id IN (4, 5)) END FROM two) + (SELECT CASE WHEN cut THEN (SELECT leaf_errors FROM st WHERE node_id = 3) ELSE (SELECT sum(leaf_errors) FROM st WHERE node_id IN (6, 7)) END FROM three))::DOUBLE / (SELECT n FROM d WHERE node_id = 1) + {_A} * (SELECT CASE WHEN two.cut THEN 1 ELSE 2 END + CASE WHEN three.cut THEN 1 ELSE 2 END FROM two, three) AS cut)
    SELECT st.node_id::BIGINT AS node_id, st.n, (st.node_id >= 4 OR (st.node_id = 1 AND root.cut) OR (st.node_id = 2 AND two.cut) OR (st.node_id = 3 AND three.cut)) AS is_leaf FROM st, two, three, root
    WHERE NOT (root.cut AND st.node_id > 1) AND NOT (two.cut AND st.node_id IN (4, 5)) AND NOT (three.cut AND st.node_id IN (6, 7))""")
def pru2(spark, sf):
    """The fixed model pruned on all rows, with the rows of the nodes that remain."""
    df = line_rows(spark, sf)
    m = prune(fixed_model(), df, "y", _A)
    return node_errors(df, m, "y").join(m.frame(spark).select("node_id", "is_leaf"), "node_id").select("node_id", "n", "is_leaf")


@query("snk4_model_round_trip", f"WITH {line_cte()} SELECT {PROBA_SQL} AS proba, count(*) AS n, sum(y)::BIGINT AS n_pos FROM s GROUP BY 1")
def snk4(spark, sf):
    from rulespire.session import scratch_dir as scratch

    path = scratch(spark, "model")
    save_model(spark, fixed_model(), path)
    return score_rows(line_rows(spark, sf), load_model(spark, path)).groupBy("proba").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"))
