"""Calibration, forests, boosting, one-call classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulespire.catalog.base import line_cte, line_rows, line_wide, load, query, rounded, rsql, unit_hash_sql
from rulespire.catalog.splits import POISSON_SQL
from rulespire.catalog.trees import IMPORTANCE_SQL, L, LEAF_SQL, PROBA_SQL, fixed_model, supplier_nodes
from rulespire.config import FitConfig
from rulespire.functions import scores as C
from rulespire.functions.rules import AFFINE, ANTIHORN, CONJUI, HORN, SQUARE2CNF, Rule
from rulespire.operators import calibrate as A
from rulespire.operators.profile import unpivot
from rulespire.plans import model as M
from rulespire.plans.boost import BoostModel, Stump, fit_boosting, stump_scan
from rulespire.plans.facade import RuleClassifier
from rulespire.plans.forest import ForestModel, fit_forest, forest_importance, oob_scores, score_forest
from rulespire.plans.grid import choose_family
from rulespire.plans.model import Node, score_rows
from rulespire.sources.tables import LINE_FEATURES


def scored(spark, sf):
    return score_rows(line_wide(spark, sf), fixed_model())


# --- CAL ------------------------------------------------------------------------------------


@query("cal1_platt", f"""WITH {line_cte()}, p AS (SELECT rf, {PROBA_SQL} AS proba, y FROM s) SELECT rf, count(*) AS n, {rsql('avg(y)', 4)} AS rate, {rsql('avg(y)', 4)} AS mean_calibrated FROM p GROUP BY 1""")
def cal1(spark, sf):
    """Per return flag: at the optimum the mean calibrated score equals the positive rate."""
    df = scored(spark, sf)
    parts = []
    for rf in ("A", "N", "R"):
        part = df.filter(F.col("rf") == rf)
        a, b = A.platt_fit(part, "proba", "y")
        parts.append(part.withColumn("cal", A.platt_apply(F.col("proba"), a, b)))
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("rf").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("y").cast("double")).alias("rate"), F.avg("cal").alias("mean_calibrated"))
    return rounded(out, "rate", "mean_calibrated", digits=4)


@query("cal1_platt_slope", f"""WITH {line_cte()}, p AS (SELECT rf, {PROBA_SQL} AS p, y FROM s), z AS (SELECT rf, ln(p / (1 - p)) AS z, y FROM p)
    SELECT rf, {rsql('avg(z * y)', 4)} AS moment, {rsql('avg(z * z)', 4)} AS spread FROM z GROUP BY 1""")
def cal1_slope(spark, sf):
    """Per return flag of the data: at the optimum the log-odds weigh calibrated scores as they weigh labels. Together with
    equal means this holds at one pair of parameters only."""
    df, z = scored(spark, sf).withColumn("z", C.log_odds(F.col("proba"))), None
    for r in df.select("rf").distinct().orderBy("rf").collect():  # the flags of a column of codes
        part = df.filter(F.col("rf").eqNullSafe(F.lit(r["rf"])))
        part = part.withColumn("cal", A.platt_apply(F.col("proba"), *A.platt_fit(part, "proba", "y"))).select("rf", "z", "cal")
        z = part if z is None else z.unionByName(part)
    return rounded(z.groupBy("rf").agg(F.avg(F.col("z") * F.col("cal")).alias("moment"), F.avg(F.col("z") * F.col("z")).alias("spread")), "moment", "spread", digits=4)


@query("cal2_binned", f"""WITH {line_cte()}, p AS (SELECT {PROBA_SQL} + ln / 100 AS p, y FROM s), o AS (SELECT p, y, row_number() OVER (ORDER BY p, y) - 1 AS i, count(*) OVER () AS n FROM p),
    b AS (SELECT p, y, least(floor(i / floor(n / least(20, floor(n / 10)))), least(20, floor(n / 10)) - 1)::INT AS bin FROM o) SELECT bin, count(*) AS n, {rsql('avg(p)')} AS mean_p, {rsql('avg(y)')} AS rate FROM b GROUP BY 1""")
def cal2(spark, sf):
    df = scored(spark, sf).withColumn("p2", F.col("proba") + F.col("ln") / 100)
    return rounded(A.binned_fit(df, "p2", "y"), "mean_p", "rate").withColumn("bin", F.col("bin").cast("int"))


@query("cal2_monotone", f"""WITH {line_cte()}, g AS (SELECT round({PROBA_SQL} - ln / 40, 6) AS p, count(*) AS n, sum(y) AS pos FROM s GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY p) AS i, sum(n) OVER (ORDER BY p) AS cn, sum(pos) OVER (ORDER BY p) AS cp FROM g),
    m AS (SELECT x.i, x.p, x.n, a.i AS a, min((b.cp - a.cp + a.pos)::DOUBLE / (b.cn - a.cn + a.n)) AS low FROM o x JOIN o a ON a.i <= x.i JOIN o b ON b.i >= x.i GROUP BY 1, 2, 3, 4),
    f AS (SELECT i, p, n, max(low) AS rate FROM m GROUP BY 1, 2, 3) SELECT min(p) AS lo, max(p) AS hi, sum(n)::BIGINT AS n, {rsql('any_value(rate)')} AS rate FROM f GROUP BY round(rate, 12)""")
def cal2b(spark, sf):
    """Rising step function by pooled violators; the SQL takes the largest of the least means over all spans."""
    df = scored(spark, sf).withColumn("p2", F.col("proba") - F.col("ln") / 40)
    return rounded(A.monotone_fit(df, "p2", "y"), "rate")


_KNOTS = [(0.1, 0.05), (0.3, 0.2), (0.5, 0.65), (0.8, 0.7)]


@query("cal3_apply", f"""SELECT event_id, {rsql('CASE WHEN p < 0.1 THEN 0.05 WHEN p < 0.3 THEN 0.05 + (p - 0.1) * (0.2 - 0.05) / (0.3 - 0.1) WHEN p < 0.5 THEN 0.2 + (p - 0.3) * (0.65 - 0.2) / (0.5 - 0.3) WHEN p < 0.8 THEN 0.65 + (p - 0.5) * (0.7 - 0.65) / (0.8 - 0.5) ELSE 0.7 END')} AS binned,
    {rsql('1 / (1 + exp(-(1.5 * ln(p / (1 - p)) - 0.2)))')} AS platt FROM (SELECT event_id, 0.01 + 0.98 * (user_id % 97) / 97.0::DOUBLE AS p FROM events)""")
def cal3(spark, sf):
    p = load(spark, sf, "events").select("event_id", (0.01 + 0.98 * (F.col("user_id") % 97) / 97.0).alias("p"))
    knots = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _KNOTS])
    return rounded(p.select("event_id", A.binned_apply(F.col("p"), knots).alias("binned"), A.platt_apply(F.col("p"), 1.5, -0.2).alias("platt")), "binned", "platt")


_CURVE = f"{line_cte()}, p AS (SELECT rf, {PROBA_SQL} * 0.9 + ln / 100 AS p, y FROM s), cv AS (SELECT rf, least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS mean_p, avg(y)::DOUBLE AS rate FROM p GROUP BY 1, 2)"


def curve(spark, sf):
    df = scored(spark, sf).withColumn("p2", F.col("proba") * 0.9 + F.col("ln") / 100)
    return A.reliability(df, "p2", "y", ["rf"])


@query("cal4_reliability", f"WITH {_CURVE} SELECT rf, bin, n, {rsql('mean_p')} AS mean_p, {rsql('rate')} AS rate, {rsql('abs(mean_p - rate)')} AS gap FROM cv")
def cal4(spark, sf):
    return rounded(curve(spark, sf), "mean_p", "rate", "gap")


@query("cal4_calibration_error", f"WITH {_CURVE} SELECT rf, {rsql('avg(abs(mean_p - rate))')} AS ece FROM cv GROUP BY 1")
def cal4b(spark, sf):
    return rounded(A.calibration_error(curve(spark, sf), ["rf"]), "ece")


# --- RF --------------------------------------------------------------------------------------

TREE2_SQL = "(CASE WHEN q >= 25 AND t >= 0.02 THEN 0.7 ELSE 0.35 END)::DOUBLE"
TREE3_SQL = "(CASE WHEN d >= 0.04 THEN 0.25 ELSE 0.8 END)::DOUBLE"


def fixed_forest() -> ForestModel:
    m = fixed_model()
    for tree, rule, yes, no in ((1, Rule.of("and", CONJUI, L("q", "GE", 25.0), L("t", "GE", 0.02)), 0.7, 0.35), (2, Rule.of("or", HORN, L("d", "GE", 0.04)), 0.25, 0.8)):
        for node, p, r in ((1, 0.5, rule), (2, yes, None), (3, no, None)):
            m.nodes[(tree, node)] = Node(tree, node, 0.0, 0.0, p, r)
    return ForestModel(m, [], 42, "rk")


@query("rf1_fit_forest")
def rf1(spark, sf):
    """Four bagged trees grown together; checked by tests."""
    f = fit_forest(line_rows(spark, sf), "y", LINE_FEATURES, "rk", 4, cfg=FitConfig(max_depth=2, n_bins=40, search_3d=False))
    return f.trees.frame(spark).select("tree_id", "node_id", "n_pos", "n_neg", "is_leaf", "family")


def _w(t):
    return POISSON_SQL.replace("u <", f"{unit_hash_sql(chr(39) + '42' + chr(39), chr(39) + 'boot' + chr(39), str(t), 'rk')} <")


@query("rf2_out_of_bag", f"""WITH {line_cte()}, w AS (SELECT y, {PROBA_SQL} AS p0, {TREE2_SQL} AS p1, {TREE3_SQL} AS p2, {_w(0)} AS w0, {_w(1)} AS w1, {_w(2)} AS w2 FROM s),
    o AS (SELECT y, (w0 = 0)::INT + (w1 = 0)::INT + (w2 = 0)::INT AS k, CASE WHEN w0 = 0 THEN p0 ELSE 0 END + CASE WHEN w1 = 0 THEN p1 ELSE 0 END + CASE WHEN w2 = 0 THEN p2 ELSE 0 END AS p FROM w)
    SELECT count(*) AS n_oob, {rsql('avg(((p / k >= 0.5)::INT = y)::INT)')} AS oob_accuracy FROM o WHERE k > 0""")
def rf2(spark, sf):
    return rounded(oob_scores(line_rows(spark, sf), fixed_forest(), "y"), "oob_accuracy")


@query("rf3_forest_importance", f"WITH {IMPORTANCE_SQL}, f AS (SELECT feature, sum(importance) AS s FROM imp GROUP BY 1) SELECT feature, {rsql('s / sum(s) OVER ()')} AS importance FROM f")
def rf3(spark, sf):
    """The supplier trees as one forest."""
    return rounded(forest_importance(supplier_nodes(spark, sf)), "importance")


@query("rf4_forest_probability", f"WITH {line_cte()} SELECT rk, {rsql(f'({PROBA_SQL} + {TREE2_SQL} + {TREE3_SQL}) / 3')} AS proba FROM s")
def rf4(spark, sf):
    return rounded(score_forest(line_rows(spark, sf), fixed_forest()).select("rk", "proba"), "proba")


# --- GB ---------------------------------------------------------------------------------------


@query("gb1_initial_score", f"WITH {line_cte()}, p AS (SELECT supp, least(greatest(avg(y), 1e-7), 1 - 1e-7) AS p FROM s GROUP BY 1) SELECT supp, {rsql('ln(p / (1 - p))')} AS init FROM p")
def gb1(spark, sf):
    g = line_wide(spark, sf).groupBy("supp").agg(F.avg(F.col("y").cast("double")).alias("p"))
    return rounded(g.select("supp", C.log_odds(F.col("p")).alias("init")), "init")


GB_F_SQL = "(0.3 + 0.05 * CASE WHEN q <= 29.5 THEN -0.4 ELSE 0.35 END + 0.04975 * CASE WHEN d <= 0.025 THEN 0.5 ELSE -0.2 END)"


def fixed_boost() -> BoostModel:
    m = BoostModel(list(LINE_FEATURES), 0.3, best_iteration=1)
    m.stumps = [Stump(0, 29.5, 0, -0.4, 0.35, 0.05, 100.0), Stump(2, 0.025, 0, 0.5, -0.2, 0.04975, 50.0)]
    return m


@query("gb2_residuals", f"WITH {line_cte()} SELECT rk, {rsql(f'(y - 1 / (1 + exp(-{GB_F_SQL}))) / 1.1')} AS residual FROM s")
def gb2(spark, sf):
    r = (F.col("y") - fixed_boost().proba_column()) / 1.1
    return rounded(line_rows(spark, sf).select("rk", r.alias("residual")), "residual")


_GB_FEATS = list(LINE_FEATURES)
STUMP_SQL = f"""{line_cte()}, rs AS (SELECT *, (y - (SELECT avg(y) FROM s)) / 1.1 AS r FROM s), l AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, {f} + 0.0 AS value, r FROM rs" for f in _GB_FEATS)}),
    h AS (SELECT feature, value, sum(r) AS r, count(*) AS n FROM l GROUP BY 1, 2), c AS (SELECT *, sum(r) OVER w AS ls, sum(n) OVER w AS ln_, sum(r) OVER a AS ts, sum(n) OVER a AS tn, lead(value) OVER (PARTITION BY feature ORDER BY value) AS nxt FROM h WINDOW w AS (PARTITION BY feature ORDER BY value), a AS (PARTITION BY feature)),
    st AS (SELECT feature, (value + nxt) / 2 AS threshold, ls / ln_ AS left_value, (ts - ls) / (tn - ln_) AS right_value, ln_ * pow(ls / ln_ - ts / tn, 2) + (tn - ln_) * pow((ts - ls) / (tn - ln_) - ts / tn, 2) AS reduction FROM c WHERE nxt IS NOT NULL AND ln_ >= 10 AND tn - ln_ >= 10),
    bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(reduction, 6) DESC, threshold) AS rn FROM st) WHERE rn = 1)"""


def best_stumps(spark, sf):
    """Best regression cut of every feature against first-round residuals."""
    from rulespire.operators.search import best_per

    df = line_rows(spark, sf)
    mean = df.agg(F.avg(F.col("y").cast("double")).alias("m")).first()["m"]
    long = unpivot(df.withColumn("r", (F.col("y") - F.lit(mean)) / 1.1), _GB_FEATS, ["r"]).withColumn("value", F.col("value") + 0.0)
    counts = long.groupBy("feature", "value").agg(F.sum("r").alias("r"), F.count(F.lit(1)).alias("n"))
    cuts = stump_scan(counts, ["feature"], "value", 10).withColumn("threshold", (F.col("value") + F.col("nxt")) / 2)
    return best_per(cuts.withColumn("score", F.col("reduction")), ["feature"], ["threshold"], digits=6).select("feature", "threshold", "left_value", "right_value", "reduction")


@query("gb3_regression_stump", f"WITH {STUMP_SQL} SELECT feature, {rsql('threshold')} AS threshold, {rsql('left_value')} AS left_value, {rsql('right_value')} AS right_value, {rsql('reduction', 4)} AS reduction FROM bs")
def gb3(spark, sf):
    return rounded(rounded(best_stumps(spark, sf), "threshold", "left_value", "right_value"), "reduction", digits=4)


@query("gb4_fit_boosting")
def gb4(spark, sf):
    """Rounds with shrinkage, decay, validation loss and early stop; checked by tests."""
    m = fit_boosting(line_rows(spark, sf), "y", LINE_FEATURES, "rk", n_rounds=6, learning_rate=0.3, refresh=3)
    return m.frame(spark)


@query("gb5_log_loss", f"WITH {line_cte()}, p AS (SELECT rf, y, least(greatest({PROBA_SQL}, 1e-15), 1 - 1e-15) AS p FROM s) SELECT rf, {rsql('-avg(y * ln(p) + (1 - y) * ln(1 - p))')} AS loss FROM p GROUP BY 1")
def gb5(spark, sf):
    return rounded(scored(spark, sf).groupBy("rf").agg(F.avg(C.log_loss(F.col("y"), F.col("proba"))).alias("loss")), "loss")


@query("gb6_boosted_probability", f"WITH {line_cte()} SELECT rk, {rsql(f'1 / (1 + exp(-{GB_F_SQL}))')} AS proba FROM s")
def gb6(spark, sf):
    return rounded(line_rows(spark, sf).select("rk", fixed_boost().proba_column().alias("proba")), "proba")


@query("gb7_boosting_importance", f"WITH {STUMP_SQL} SELECT feature, {rsql('reduction / sum(reduction) OVER ()')} AS importance FROM bs")
def gb7(spark, sf):
    """Importance of a model with the best stump of every feature."""
    m = BoostModel(_GB_FEATS, 0.0)
    m.stumps = [Stump(_GB_FEATS.index(r["feature"]), r["threshold"], -1, r["left_value"], r["right_value"], 1.0, r["reduction"]) for r in best_stumps(spark, sf).collect()]
    return rounded(spark.createDataFrame([(f, v) for f, v in m.importance().items()], "feature string, importance double"), "importance")


# --- PIP ----------------------------------------------------------------------------------------

DOC_FEATURES = ["n_chars", "n_words", "distinct_ratio", "digit_ratio"]


def doc_task(spark, sf):
    """Document quality from whole-text measures."""
    d = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id")
    words = F.split(F.trim("text"), "\\s+")
    digits = F.length("text") - F.length(F.regexp_replace("text", "[0-9]", ""))
    return d.select(
        F.col("doc_id").cast("string").alias("rk"), F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("n_chars"), F.size(words).cast("double").alias("n_words"),
        F.round(F.size(F.array_distinct(words)) / F.size(words), 6).alias("distinct_ratio"), F.round(digits / F.greatest(F.length("text"), F.lit(1)), 6).alias("digit_ratio"))


@query("pip1_auto_classifier")
def pip1(spark, sf):
    """Hold-out, model choice by size, fit, prune, calibrate on the document labels."""
    df = doc_task(spark, sf)
    clf = RuleClassifier(DOC_FEATURES, max_depth=3, n_bins=16).fit(df)
    return rounded(clf.predict(df).groupBy("pred", "y").agg(F.count(F.lit(1)).alias("n"), F.avg("proba").alias("mean_proba")), "mean_proba")


@query("pip2_calibrated_predict", f"WITH {line_cte()}, p AS (SELECT rk, 1 / (1 + exp(-(0.8 * ln({PROBA_SQL} / (1 - {PROBA_SQL})) + 0.1))) AS p FROM s) SELECT rk, {rsql('p')} AS proba, (p >= 0.5)::INT AS pred FROM p")
def pip2(spark, sf):
    clf = RuleClassifier(LINE_FEATURES)
    clf.model_, clf.kind_, clf.calibrator_ = fixed_model(), "single", ("platt", 0.8, 0.1)
    return rounded(clf.predict(line_rows(spark, sf)).select("rk", "proba", "pred"), "proba")


@query("pip3_family_front_end", f"""WITH {line_cte('and2')} SELECT 'q >= 19.5 & t >= 0.025' AS root, sum((q >= 19.5 AND t >= 0.025)::INT)::BIGINT AS n_true, sum((NOT (q >= 19.5 AND t >= 0.025))::INT)::BIGINT AS n_false FROM s""")
def pip3(spark, sf):
    """Named-family front end with an arity limit: the planted AND rule is the root."""
    df = line_rows(spark, sf, "and2")
    clf = RuleClassifier(LINE_FEATURES, family=CONJUI, max_arity=2, max_depth=1, model_type="single", use_calibration=False, use_pruning=False).fit(df)
    rule = clf.model_.nodes[(0, 1)].rule
    text = " & ".join(f"{LINE_FEATURES[l.feature]} >= {round(l.threshold, 6):g}" for l in sorted(rule.literals, key=lambda l: l.feature))
    hit = rule.column([F.col(f) for f in LINE_FEATURES])
    return df.agg(F.count_if(hit).alias("n_true"), F.count_if(~hit).alias("n_false")).select(F.lit(text).alias("root"), "n_true", "n_false")


@query("pip4_choose_family")
def pip4(spark, sf):
    df = line_rows(spark, sf, "and2")
    out = choose_family(df, "y", LINE_FEATURES, "rk", [HORN, ANTIHORN, CONJUI, SQUARE2CNF, AFFINE], k=3, cfg=FitConfig(max_depth=3))
    return rounded(out, "accuracy", "nodes", "axp_len", "objective")
