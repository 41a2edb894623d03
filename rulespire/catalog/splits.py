"""Splits and samples over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulespire.catalog.base import line_cte, line_rows, line_wide, load, query, rounded, rsql, unit_hash_sql
from rulespire.functions.hashing import POISSON_CDF
from rulespire.operators import sampling as S
from rulespire.operators.results import fold_statistics

H = unit_hash_sql


def lit(s: str) -> str:
    return f"'{s}'"


@query("spl1_stratified_runs", f"""WITH {line_cte()}, r AS (SELECT s.*, run, {H("'42'", lit('split'), 'run', 'rk')} AS u FROM s, range(0, 3) g(run)),
    k AS (SELECT *, row_number() OVER (PARTITION BY run, y ORDER BY u, rk) AS i, count(*) OVER (PARTITION BY run, y) AS n FROM r)
    SELECT run::INT AS run, rk, y, i <= floor(0.2 * n + 0.5) AS is_test FROM k""")
def spl1(spark, sf):
    return S.stratified_split(line_rows(spark, sf), ["y"], "rk", 0.2, 42, 3).select("run", "rk", "y", "is_test")


@query("spl2_guarded_split", f"""WITH e AS (SELECT event_id::VARCHAR AS rk, user_id AS stratum FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {H("'42'", lit('guarded'), 'rk')}, rk) AS i, count(*) OVER (PARTITION BY stratum) AS n FROM e)
    SELECT stratum, rk, i <= CASE WHEN n = 1 THEN 0 ELSE least(greatest(floor(0.25 * n + 0.5), 1), n - 1) END AS is_test FROM k""")
def spl2(spark, sf):
    ev = load(spark, sf, "events").select(F.col("event_id").cast("string").alias("rk"), F.col("user_id").alias("stratum"))
    return S.guarded_split(ev, ["stratum"], "rk", 0.25, 42).select("stratum", "rk", "is_test")


@query("spl3_permutation_split", f"""WITH {line_cte()}, k AS (SELECT rk, y, row_number() OVER (ORDER BY {H("'42'", lit('perm'), 'rk')}, rk) AS i, count(*) OVER () AS n FROM s)
    SELECT rk, y, i > floor(0.8 * n) AS is_test FROM k""")
def spl3(spark, sf):
    return S.permutation_split(line_rows(spark, sf), "rk", 0.8, 42).select("rk", "y", "is_test")


@query("spl4_calibration_hold_out", f"""WITH {line_cte()} SELECT rk, {H("'42'", lit('cal'), 'rk')} < 0.15 AS held_out FROM s""")
def spl4(spark, sf):
    return S.hold_out(line_rows(spark, sf), "rk", 0.15, 42, "cal").select("rk", "held_out")


@query("spl5_pruning_hold_out", f"""WITH {line_cte()}, k AS (SELECT *, row_number() OVER (PARTITION BY rf, y ORDER BY {H("'42'", lit('prune'), "'0'", 'rk')}, rk) AS i, count(*) OVER (PARTITION BY rf, y) AS n, count(*) OVER (PARTITION BY rf) AS task_n FROM s)
    SELECT rf, rk, y, task_n >= 500 AND i <= floor(0.2 * n + 0.5) AS is_test FROM k""")
def spl5(spark, sf):
    rows = line_wide(spark, sf)
    sizes = rows.groupBy("rf").agg(F.count(F.lit(1)).alias("task_n"))  # one row per task
    split = S.stratified_split(rows, ["rf", "y"], "rk", 0.2, 42, purpose="prune")
    return split.join(F.broadcast(sizes), "rf").select("rf", "rk", "y", ((F.col("task_n") >= 500) & F.col("is_test")).alias("is_test"))


@query("spl6_k_folds", f"""WITH {line_cte()}, k AS (SELECT rk, y, (row_number() OVER (ORDER BY {H("'42'", lit('fold'), 'rk')}, rk) - 1) % 5 AS fold, q FROM s),
    f AS (SELECT fold, avg((q >= 30)::INT = y)::DOUBLE AS accuracy FROM (SELECT fold, q, y FROM k) GROUP BY 1)
    SELECT fold::INT AS fold, {rsql('accuracy')} AS accuracy, count(*) OVER () AS k, {rsql('avg(accuracy) OVER ()')} AS mean, {rsql('stddev_pop(accuracy) OVER ()')} AS std,
    {rsql('1.96 * stddev_pop(accuracy) OVER () / sqrt(count(*) OVER ())')} AS ci95, row_number() OVER (ORDER BY round(accuracy, 9) DESC, fold) = 1 AS is_best FROM f""".replace("avg((q >= 30)::INT = y)::DOUBLE", "avg(((q >= 30)::INT = y)::INT)"))
def spl6(spark, sf):
    from pyspark.sql import Window as W

    folds = S.k_folds(line_rows(spark, sf), "rk", 5, 42)
    acc = folds.groupBy("fold").agg(F.avg(((F.col("q") >= 30).cast("int") == F.col("y")).cast("double")).alias("accuracy")).withColumn("g", F.lit(0))
    stats = fold_statistics(acc, ["g"], "accuracy")
    best = F.row_number().over(W.partitionBy("g").orderBy(F.desc(F.round("accuracy", 9)), "fold")) == 1  # k rows
    return rounded(acc.withColumn("is_best", best).join(stats, "g").drop("g"), "accuracy", "mean", "std", "ci95")


@query("spl7_contiguous_folds", """WITH n AS (SELECT count(*) AS n FROM orders) SELECT o_orderkey AS row_id, least(floor(o_orderkey / greatest(floor(n / 4), 1)), 3)::INT AS fold FROM orders, n""")
def spl7(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))  # keys are positions 0..n-1
    n = o.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return o.withColumn("fold", S.contiguous_folds(F.col("row_id"), F.lit(n), 4))


@query("spl8_boosting_validation", f"""WITH {line_cte()} SELECT rk, {H("'42'", lit('bval'), 'rk')} < 0.15 AS held_out FROM s""")
def spl8(spark, sf):
    return S.hold_out(line_rows(spark, sf), "rk", 0.15, 42, "bval").select("rk", "held_out")


POISSON_SQL = "CASE " + " ".join(f"WHEN u < {c} THEN {k}" for k, c in enumerate(POISSON_CDF)) + f" ELSE {len(POISSON_CDF)} END"


@query("smp1_bootstrap", f"""WITH {line_cte()}, b AS (SELECT tree_id, rk, y, {H("'42'", lit('boot'), 'tree_id', 'rk')} AS u FROM s, range(0, 4) g(tree_id)), w AS (SELECT *, {POISSON_SQL} AS w FROM b)
    SELECT tree_id::INT AS tree_id, y, w, count(*) AS n, bool_and(w = 0) AS oob FROM w GROUP BY 1, 2, 3""")
def smp1(spark, sf):
    b = S.bootstrap(line_rows(spark, sf), "rk", 4, 42)
    return b.groupBy("tree_id", "y", "w").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("w") == 0).alias("oob"))


@query("smp2_feature_subsets", f"""WITH f AS (SELECT DISTINCT p_brand || '/' || p_type AS feature FROM part), r AS (SELECT tree_id::INT AS tree_id, feature, row_number() OVER (PARTITION BY tree_id ORDER BY {H("'42'", lit('feat'), 'tree_id', 'feature')}, feature) AS r FROM f, range(0, 5) g(tree_id)),
    n AS (SELECT count(*) AS d FROM f) SELECT tree_id, feature FROM r, n WHERE r <= greatest(1, floor(sqrt(d)))""")
def smp2(spark, sf):
    f = load(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("feature")).distinct()
    return S.feature_subsets(f, 5, S.subset_size("sqrt", f.count()), 42)


@query("smp3_round_subsample", f"""WITH {line_cte()} SELECT round::INT AS round, y, count(*) AS n FROM s, range(0, 3) g(round) WHERE {H("'42'", lit('row'), 'round', 'rk')} < 0.8 GROUP BY 1, 2""")
def smp3(spark, sf):
    return S.round_subsample(line_rows(spark, sf), "rk", 3, 0.8, 42).groupBy("round", "y").agg(F.count(F.lit(1)).alias("n"))


@query("smp4_round_columns", f"""WITH f AS (SELECT DISTINCT p_type AS feature FROM part), r AS (SELECT tree_id::INT AS tree_id, feature, row_number() OVER (PARTITION BY tree_id ORDER BY {H("'42'", lit('col'), 'tree_id', 'feature')}, feature) AS r FROM f, range(0, 6) g(tree_id)),
    n AS (SELECT count(*) AS d FROM f) SELECT tree_id, feature FROM r, n WHERE r <= greatest(1, floor(d * 0.8))""")
def smp4(spark, sf):
    f = load(spark, sf, "part").select(F.col("p_type").alias("feature")).distinct()
    return S.feature_subsets(f, 6, S.subset_size(0.8, f.count()), 42, "col")


@query("smp5_k_rows", f"""WITH {line_cte()} SELECT rk, y, q, d FROM s ORDER BY {H("'42'", lit('pick'), 'rk')}, rk LIMIT 200""")
def smp5(spark, sf):
    return S.k_rows(line_rows(spark, sf), "rk", 200, 42).select("rk", "y", "q", "d")


@query("smp6_learning_fractions", f"""WITH {line_cte()}, u AS (SELECT y, {H("'42'", lit('curve'), 'rk')} AS u FROM s) SELECT fraction, count(*) AS n, sum(y)::BIGINT AS n_pos FROM u, (SELECT unnest([0.1, 0.2, 0.4, 0.6, 0.8, 1.0]::DOUBLE[]) AS fraction) WHERE u < fraction GROUP BY 1""")
def smp6(spark, sf):
    n = S.learning_fractions(line_rows(spark, sf), "rk", [0.1, 0.2, 0.4, 0.6, 0.8, 1.0], 42)
    return n.groupBy("fraction").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"))
