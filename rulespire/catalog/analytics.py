"""Experiment analytics over result rows derived from the tables."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from rulespire.catalog.base import line_cte, line_rows, line_wide, load, query, rounded, rsql
from rulespire.session import scratch_dir as scratch
from rulespire.config import FitConfig
from rulespire.operators import results as A
from rulespire.plans.grid import METHODS as GRID_METHODS, learning_curve, run_grid
from rulespire.sources.sinks import write_tables
from rulespire.sources.tables import LINE_FEATURES

# Five hand-written classifiers, judged per supplier (dataset), depth and run (line number mod 3).
METHODS = {
    "axis": ("q >= 25", "Baseline", 3), "horn": ("q >= 25 OR d < 0.03", "Horn", 5), "conj": ("q >= 20 AND t >= 0.03", "ConjUI", 5),
    "xor": ("(q >= 25) <> (d >= 0.05)", "Affine", 7), "cnf": ("(q >= 25 OR d < 0.03) AND (t >= 0.04 OR p < 50000)", "Square2CNF", 9),
}
_PRED = {1: "({c})", 2: "(({c}) AND p < 90000)"}


def _results_sql():
    cells = " UNION ALL ".join(
        f"SELECT supp, y, ln::INT % 3 AS run, '{m}' AS method, '{cat}' AS category, {d} AS depth, {nodes * d} AS nodes, {_PRED[d].format(c=c)} AS pred FROM s"
        for m, (c, cat, nodes) in METHODS.items() for d in (1, 2))
    return f"""{line_cte('cnf4')}, ce AS ({cells}), res AS (SELECT supp::VARCHAR AS dataset, method, category, depth, run, nodes::DOUBLE AS nodes,
      CASE WHEN supp % 7 = 0 AND run = 2 THEN 'nan'::DOUBLE ELSE avg((pred::INT = y)::INT) END AS accuracy, avg(CASE WHEN pred THEN 1 ELSE 2 END) AS axp_len, count(*)::DOUBLE AS cost FROM ce GROUP BY supp, method, category, depth, run, nodes)"""


RES = _results_sql()
CELL = f"{RES}, m AS (SELECT dataset, method, category, depth, avg(nodes) AS nodes, round(avg(CASE WHEN isnan(accuracy) THEN NULL ELSE accuracy END), 12) AS accuracy, round(avg(axp_len), 12) AS axp_len, avg(cost) AS cost FROM res GROUP BY 1, 2, 3, 4)"


def result_rows(spark, sf):
    """One row per (dataset, method, depth, run)."""
    df = line_wide(spark, sf, "cnf4")
    cells = [(m, cat, d, float(nodes * d), F.expr(_PRED[d].format(c=c))) for m, (c, cat, nodes) in METHODS.items() for d in (1, 2)]
    # all methods are judged side by side, one row per (dataset, run); rows are not repeated per method
    both = [a for i, (*_, pred) in enumerate(cells) for a in (
        F.avg((pred.cast("int") == F.col("y")).cast("double")).alias(f"hit{i}"), F.avg(F.when(pred, 1.0).otherwise(2.0)).alias(f"len{i}"))]
    per = df.groupBy("supp", (F.col("ln").cast("int") % 3).alias("run")).agg(*both, F.count(F.lit(1)).cast("double").alias("cost"))
    acc = lambda i: F.when((F.col("supp") % 7 == 0) & (F.col("run") == 2), F.lit(float("nan"))).otherwise(F.col(f"hit{i}"))
    entry = F.array(*[
        F.struct(F.lit(m).alias("method"), F.lit(cat).alias("category"), F.lit(d).alias("depth"), F.lit(nodes).alias("nodes"), acc(i).alias("accuracy"), F.col(f"len{i}").alias("axp_len"))
        for i, (m, cat, d, nodes, _) in enumerate(cells)])
    long = per.select("supp", "run", "cost", F.inline(entry))
    return long.select("method", "category", "depth", "run", "nodes", "accuracy", "axp_len", "cost", F.col("supp").cast("string").alias("dataset"))


def cell_rows(spark, sf):
    r = result_rows(spark, sf)
    return r.groupBy("dataset", "method", "category", "depth").agg(
        F.avg("nodes").alias("nodes"), F.round(F.avg(A.nan_safe(F.col("accuracy"))), 12).alias("accuracy"), F.round(F.avg("axp_len"), 12).alias("axp_len"), F.avg("cost").alias("cost"))


@query("ana1_run_grid")
def ana1(spark, sf):
    """All methods, two runs and three depths; failures would be rows with their error."""
    df = line_rows(spark, sf, "or2")
    g = run_grid(spark, {"or2": df}, {"or2": LINE_FEATURES}, GRID_METHODS, [1, 2, 3], 2)
    return rounded(g.drop("fit_sec"), "accuracy", "train_accuracy", "axp_len")


@query("ana2_cell_statistics", f"WITH {RES} SELECT dataset, method, depth, count(v) AS n, {rsql('avg(v)')} AS mean, {rsql('stddev_pop(v)')} AS std FROM (SELECT *, CASE WHEN isnan(accuracy) THEN NULL ELSE accuracy END AS v FROM res) GROUP BY 1, 2, 3")
def ana2(spark, sf):
    return rounded(A.cell_statistics(result_rows(spark, sf), ["dataset", "method", "depth"], "accuracy"), "mean", "std")


@query("ana3_long_rows", f"WITH {CELL} SELECT m.dataset, m.method, m.depth, m.nodes, {rsql('b.nodes / m.nodes')} AS compression FROM m JOIN m b ON b.dataset = m.dataset AND b.depth = m.depth AND b.method = 'axis'")
def ana3(spark, sf):
    return rounded(A.long_rows(cell_rows(spark, sf), "axis", ["dataset", "depth"]).select("dataset", "method", "depth", "nodes", "compression"), "compression")


@query("ana4_summary", f"WITH {CELL} SELECT method, category, depth, count(DISTINCT dataset) AS n_datasets, {rsql('avg(accuracy)')} AS avg_accuracy, {rsql('stddev_pop(accuracy)')} AS std_accuracy, {rsql('avg(nodes)')} AS avg_nodes, {rsql('stddev_pop(nodes)')} AS std_nodes FROM m GROUP BY 1, 2, 3")
def ana4(spark, sf):
    return rounded(A.summarize(cell_rows(spark, sf), ["method", "category", "depth"], ["accuracy", "nodes"]), "avg_accuracy", "std_accuracy", "avg_nodes", "std_nodes")


@query("ana5_complexity", f"WITH {CELL} SELECT dataset, {rsql('avg(nodes)')} AS avg_nodes, {rsql('min(nodes)')} AS min_nodes, {rsql('max(nodes)')} AS max_nodes, {rsql('avg(axp_len)')} AS avg_axp FROM m GROUP BY 1")
def ana5(spark, sf):
    g = cell_rows(spark, sf).groupBy("dataset").agg(F.avg("nodes").alias("avg_nodes"), F.min("nodes").alias("min_nodes"), F.max("nodes").alias("max_nodes"), F.avg("axp_len").alias("avg_axp"))
    return rounded(g, "avg_nodes", "min_nodes", "max_nodes", "avg_axp")


def _pareto_sql(cost):
    return f"WITH {CELL} SELECT dataset, method, depth, {rsql('m.' + cost)} AS {cost}, {rsql('m.accuracy')} AS accuracy FROM m WHERE accuracy IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m o WHERE o.dataset = m.dataset AND ((o.accuracy > m.accuracy AND o.{cost} <= m.{cost}) OR (o.accuracy >= m.accuracy AND o.{cost} < m.{cost})))"


@query("ana6_pareto_size", _pareto_sql("nodes"))
def ana6(spark, sf):
    front = A.pareto_front(cell_rows(spark, sf).filter("accuracy is not null"), ["dataset"], "accuracy", "nodes")
    return rounded(front.select("dataset", "method", "depth", "nodes", "accuracy"), "nodes", "accuracy")


@query("ana6_pareto_axp", _pareto_sql("axp_len"))
def ana6b(spark, sf):
    front = A.pareto_front(cell_rows(spark, sf).filter("accuracy is not null"), ["dataset"], "accuracy", "axp_len")
    return rounded(front.select("dataset", "method", "depth", "axp_len", "accuracy"), "axp_len", "accuracy")


def _outcome(tol):
    return f"CASE WHEN m.accuracy - b.accuracy > {tol} THEN 'win' WHEN m.accuracy - b.accuracy < -{tol} THEN 'loss' ELSE 'tie' END"


_BASE = "JOIN m b ON b.dataset = m.dataset AND b.depth = m.depth AND b.method = 'axis' WHERE m.method <> 'axis'"


@query("ana7_outcomes", f"WITH {CELL} SELECT m.dataset, m.method, m.depth, {rsql('m.accuracy - b.accuracy')} AS diff, {_outcome('1e-12')} AS outcome FROM m {_BASE}")
def ana7(spark, sf):
    o = A.outcomes(cell_rows(spark, sf), "axis", ["dataset", "depth"], "accuracy", 1e-12)
    return rounded(o.select("dataset", "method", "depth", "diff", "outcome"), "diff")


@query("ana8_outcome_counts", f"WITH {CELL}, o AS (SELECT m.method, m.depth, {_outcome('0.005')} AS outcome FROM m {_BASE}) SELECT method, depth, sum((outcome = 'win')::INT)::BIGINT AS n_win, sum((outcome = 'loss')::INT)::BIGINT AS n_loss, sum((outcome = 'tie')::INT)::BIGINT AS n_tie FROM o GROUP BY 1, 2")
def ana8(spark, sf):
    return A.outcome_counts(cell_rows(spark, sf), "axis", ["dataset", "depth"], ["method", "depth"], "accuracy", 0.005)


DIFF_SQL = f"{CELL}, df AS (SELECT m.method, m.depth, round(m.accuracy - b.accuracy, 9) AS diff FROM m {_BASE})"


def diffs(spark, sf):
    o = A.outcomes(cell_rows(spark, sf), "axis", ["dataset", "depth"], "accuracy", 0.0)
    return o.select("method", "depth", F.round("diff", 9).alias("diff"))


def t_p_sql(t, n):
    """Two-sided p of a t statistic, integrated in DuckDB."""
    simpson = lambda hi: f"list_sum(list_transform(range(0, 401), lambda i: pow(cos(i * ({hi}) / 400), {n} - 2) * CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)) * ({hi}) / 1200"
    return f"greatest(0.0, 1 - ({simpson(f'atan(abs({t}) / sqrt({n} - 1))')}) / ({simpson('pi() / 2')}))"


def z_p_sql(z):
    x = f"(abs({z}) / sqrt(2))"
    u, total = f"(1 / (1 + {A.ERFC[0]} * {x}))", "0.0"
    for c in reversed(A.ERFC[1:]):
        total = f"(({total} + {c}) * {u})"
    return f"{total} * exp(-{x} * {x})"


@query("ana9_paired_t", f"WITH {DIFF_SQL} SELECT method, depth, count(diff) AS n, {rsql('avg(diff)')} AS mean_diff, {rsql('avg(diff) / (stddev_samp(diff) / sqrt(count(diff)))', 4)} AS t, {rsql(t_p_sql('avg(diff) / (stddev_samp(diff) / sqrt(count(diff)))', 'count(diff)'), 5)} AS p FROM df GROUP BY 1, 2")
def ana9(spark, sf):
    out = A.paired_t(diffs(spark, sf), ["method", "depth"], "diff").withColumn("p", A.t_p_column(F.col("t"), F.col("n")))
    return rounded(rounded(rounded(out, "mean_diff"), "t", digits=4), "p", digits=5)


@query("ana10_signed_ranks", f"""WITH {DIFF_SQL}, nz AS (SELECT method, depth, diff, abs(diff) AS a FROM df WHERE diff <> 0), rk AS (SELECT *, rank() OVER (PARTITION BY method, depth ORDER BY a) + (count(*) OVER (PARTITION BY method, depth, a) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY method, depth, a) AS ties FROM nz),
    w AS (SELECT method, depth, count(*) AS n, sum(CASE WHEN diff > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN diff < 0 THEN r ELSE 0 END) AS w_minus, sum(ties * ties - 1.0) AS tt FROM rk GROUP BY 1, 2)
    SELECT method, depth, n, w_plus::DOUBLE AS w_plus, w_minus::DOUBLE AS w_minus, least(w_plus, w_minus)::DOUBLE AS w, {rsql('(least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tt / 48.0)', 4)} AS z, {rsql(z_p_sql('(least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tt / 48.0)'), 5)} AS p FROM w""")
def ana10(spark, sf):
    out = A.signed_ranks(diffs(spark, sf), ["method", "depth"], "diff").drop("p_exact").withColumn("p", A.z_p_column(F.col("z")))
    return rounded(rounded(out, "z", digits=4), "p", digits=5)


_ZP = "(least(w_plus, w_minus) - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - tt / 48.0)"


@query("ana10_pairwise_ranks", f"""WITH {CELL}, pw AS (SELECT a.method AS method_a, b.method AS method_b, round(a.accuracy - b.accuracy, 9) AS diff FROM m a JOIN m b ON a.dataset = b.dataset AND a.depth = b.depth AND a.method < b.method), nz AS (SELECT *, abs(diff) AS a FROM pw WHERE diff <> 0),
    rk AS (SELECT *, rank() OVER (PARTITION BY method_a, method_b ORDER BY a) + (count(*) OVER (PARTITION BY method_a, method_b, a) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY method_a, method_b, a) AS ties FROM nz),
    w AS (SELECT method_a, method_b, count(*) AS n, sum(CASE WHEN diff > 0 THEN r ELSE 0 END)::DOUBLE AS w_plus, sum(CASE WHEN diff < 0 THEN r ELSE 0 END)::DOUBLE AS w_minus, sum(ties * ties - 1.0) AS tt FROM rk GROUP BY 1, 2)
    SELECT method_a, method_b, n, w_plus, w_minus, {rsql(_ZP, 4)} AS z, {rsql(z_p_sql(_ZP), 5)} AS p FROM w""")
def ana10b(spark, sf):
    c = cell_rows(spark, sf).select("dataset", "depth", "method", "accuracy")
    # five methods: the accuracies of a cell side by side, pairs built inside the row
    wide = c.groupBy("dataset", "depth").agg(F.sort_array(F.collect_list(F.struct("method", "accuracy"))).alias("v"))
    pairs = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b.method > a.method), lambda b: F.struct(a.method.alias("method_a"), b.method.alias("method_b"), F.round(a.accuracy - b.accuracy, 9).alias("diff")))))
    out = A.signed_ranks(wide.select(F.inline(pairs)), ["method_a", "method_b"], "diff").withColumn("p", A.z_p_column(F.col("z")))
    return rounded(rounded(out.select("method_a", "method_b", "n", "w_plus", "w_minus", "z", "p"), "z", digits=4), "p", digits=5)


_BY_LINE = {m: c for m, (c, _, _) in METHODS.items() if m != "axis"}


@query("ana10_exact_signed_ranks", f"""WITH {line_cte('cnf4')}, a AS (SELECT supp, ln, avg((({METHODS['axis'][0]})::INT = y)::INT) AS base, {', '.join(f'avg((({c})::INT = y)::INT) AS {m}' for m, c in _BY_LINE.items())} FROM s GROUP BY 1, 2),
    df AS ({' UNION ALL '.join(f"SELECT supp, '{m}' AS method, round({m} - base, 9) AS diff FROM a" for m in _BY_LINE)}), nz AS (SELECT *, abs(diff) AS v FROM df WHERE diff <> 0),
    rk AS (SELECT *, rank() OVER (PARTITION BY supp, method ORDER BY v) + (count(*) OVER (PARTITION BY supp, method, v) - 1) / 2.0 AS r FROM nz),
    g AS (SELECT supp, method, count(*) AS n, least(sum(CASE WHEN diff > 0 THEN r ELSE 0 END), sum(CASE WHEN diff < 0 THEN r ELSE 0 END))::DOUBLE AS w, list(r) AS rs FROM rk GROUP BY 1, 2),
    e AS (SELECT supp, method, n, w, unnest(range(1 << n)) AS signs, rs FROM g),
    t AS (SELECT supp, method, n, w, list_sum(list_transform(range(n), lambda i: CASE WHEN (signs >> i) & 1 = 1 THEN rs[i + 1] ELSE 0 END)) AS sum_ FROM e)
    SELECT supp, method, n, w, {rsql('least(1.0, 2.0 * sum((sum_ <= w)::INT) / (1 << n))')} AS p FROM t GROUP BY 1, 2, 3, 4""")
def ana10c(spark, sf):
    """Per supplier: every method against the single test over its line numbers, with exact p values."""
    df = line_wide(spark, sf, "cnf4")
    hit = lambda c: F.avg((F.expr(c).cast("int") == F.col("y")).cast("double"))
    a = df.groupBy("supp", "ln").agg(hit(METHODS["axis"][0]).alias("base"), *[hit(c).alias(m) for m, c in _BY_LINE.items()])
    entry = F.array(*[F.struct(F.lit(m).alias("method"), F.round(F.col(m) - F.col("base"), 9).alias("diff")) for m in _BY_LINE])
    out = A.signed_ranks(a.select("supp", F.inline(entry)), ["supp", "method"], "diff")
    return rounded(out.select("supp", "method", "n", "w", F.col("p_exact").alias("p")), "p")


CERT_SQL = f"{CELL}, c AS (SELECT *, category IN ('Horn', 'Square2CNF') AND axp_len < 1.6 AS certified FROM m)"


def certified(spark, sf):
    return with_certified(cell_rows(spark, sf))


def with_certified(cells):
    return cells.withColumn("certified", F.col("category").isin("Horn", "Square2CNF") & (F.col("axp_len") < 1.6))


@query("ana11_certified_rows", f"WITH {CERT_SQL} SELECT dataset, method, depth FROM c WHERE certified")
def ana11(spark, sf):
    return certified(spark, sf).filter("certified").select("dataset", "method", "depth")


@query("ana12_certified_split", f"WITH {CERT_SQL} SELECT CASE WHEN certified THEN 'certified' ELSE 'auxiliary' END AS part, method, count(*) AS n FROM c GROUP BY 1, 2")
def ana12(spark, sf):
    c = certified(spark, sf)
    a = c.filter("certified").withColumn("part", F.lit("certified"))
    b = c.filter("not certified").withColumn("part", F.lit("auxiliary"))
    return a.unionByName(b).groupBy("part", "method").agg(F.count(F.lit(1)).alias("n"))


@query("ana13_best_per_metric", f"WITH {CELL} SELECT dataset, depth, " + ", ".join(f"first(method ORDER BY {m} {o} NULLS LAST, method) AS best_{m}" for m, o in (("accuracy", "DESC"), ("nodes", "ASC"), ("axp_len", "ASC"), ("cost", "ASC"))) + " FROM m GROUP BY 1, 2")
def ana13(spark, sf):
    return A.best_per_metric(cell_rows(spark, sf), ["dataset", "depth"], ["accuracy"], ["nodes", "axp_len", "cost"])


@query("ana14_normalized_profile", f"""WITH {CELL}, g AS (SELECT method, round(avg(accuracy), 12) AS accuracy, avg(nodes) AS nodes FROM m GROUP BY 1) SELECT method, {rsql('accuracy')} AS accuracy, nodes, {rsql('(accuracy - min(accuracy) OVER ()) / (max(accuracy) OVER () - min(accuracy) OVER ())')} AS accuracy_minmax, {rsql('accuracy / max(accuracy) OVER ()')} AS accuracy_ratio,
    {rsql('(nodes - min(nodes) OVER ()) / (max(nodes) OVER () - min(nodes) OVER ())')} AS nodes_minmax, {rsql('nodes / max(nodes) OVER ()')} AS nodes_ratio FROM g""")
def ana14(spark, sf):
    g = cell_rows(spark, sf).groupBy("method").agg(F.round(F.avg("accuracy"), 12).alias("accuracy"), F.avg("nodes").alias("nodes"))
    return rounded(A.normalized_profile(g, ["accuracy", "nodes"]), "accuracy", "accuracy_minmax", "accuracy_ratio", "nodes_minmax", "nodes_ratio")


_P = {m: c for m, (c, _, _) in METHODS.items() if m in ("axis", "horn", "cnf")}


@query("ana15_disagreements", f"WITH {line_cte('cnf4')}, p AS (SELECT rk, y, {', '.join(f'({c})::INT AS {m}' for m, c in _P.items())} FROM s) SELECT rk, axis, horn, cnf, (axis = y)::INT + (horn = y)::INT + (cnf = y)::INT AS n_correct FROM p WHERE NOT (axis = horn AND horn = cnf)")
def ana15(spark, sf):
    df = line_rows(spark, sf, "cnf4").select("rk", "y", *[F.expr(c).cast("int").alias(m) for m, c in _P.items()])
    return A.disagreements(df, list(_P), "y").drop("y")


@query("ana16_learning_curve")
def ana16(spark, sf):
    out = learning_curve(line_rows(spark, sf, "and2"), "y", LINE_FEATURES, "rk", [k / 10 for k in range(1, 11)], FitConfig(max_depth=3))
    return rounded(out, "train_accuracy", "test_accuracy")


@query("ana17_published_numbers", f"""WITH {CELL}, pub AS (SELECT l_suppkey::VARCHAR AS dataset, round(avg((l_returnflag <> 'N')::INT), 9) AS published FROM lineitem GROUP BY 1)
    SELECT m.method, m.depth, count(*) AS n, {rsql('avg(accuracy - published)')} AS mean_diff, sum((accuracy - published > 0.005)::INT)::BIGINT AS n_better, sum((accuracy - published < -0.005)::INT)::BIGINT AS n_worse FROM m JOIN pub USING (dataset) GROUP BY 1, 2""")
def ana17(spark, sf):
    """Join with a table of outside numbers per dataset (here a share taken from the data)."""
    pub = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("dataset")).agg(F.round(F.avg((F.col("l_returnflag") != "N").cast("double")), 9).alias("published"))
    j = cell_rows(spark, sf).join(pub, "dataset").withColumn("diff", F.col("accuracy") - F.col("published"))
    return rounded(j.groupBy("method", "depth").agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean_diff"), F.count_if(F.col("diff") > 0.005).alias("n_better"), F.count_if(F.col("diff") < -0.005).alias("n_worse")), "mean_diff")


@query("ana18_compression_averages", f"WITH {CELL} SELECT m.method, {rsql('avg(m.accuracy)')} AS accuracy, {rsql('avg(m.nodes)')} AS nodes, {rsql('avg(b.nodes / m.nodes)')} AS compression FROM m JOIN m b ON b.dataset = m.dataset AND b.depth = m.depth AND b.method = 'cnf' GROUP BY 1")
def ana18(spark, sf):
    r = A.long_rows(cell_rows(spark, sf), "cnf", ["dataset", "depth"])
    return rounded(r.groupBy("method").agg(F.avg("accuracy").alias("accuracy"), F.avg("nodes").alias("nodes"), F.avg("compression").alias("compression")), "accuracy", "nodes", "compression")


@query("ana19_fold_statistics", f"WITH {RES} SELECT method, depth, run, count(axp_len) AS k, {rsql('avg(axp_len)')} AS mean, {rsql('stddev_pop(axp_len)')} AS std, {rsql('1.96 * stddev_pop(axp_len) / sqrt(count(axp_len))')} AS ci95 FROM res GROUP BY 1, 2, 3")
def ana19(spark, sf):
    return rounded(A.fold_statistics(result_rows(spark, sf), ["method", "depth", "run"], "axp_len"), "mean", "std", "ci95")


@query("ana20_dashboard_rows", f"WITH {CELL} SELECT category AS family, count(*) AS n_cells, {rsql('avg(accuracy) * 100', 4)} AS accuracy_pct, {rsql('avg(nodes)')} AS nodes, {rsql('avg(axp_len)')} AS axp_len FROM m GROUP BY 1")
def ana20(spark, sf):
    g = cell_rows(spark, sf).groupBy(F.col("category").alias("family")).agg(F.count(F.lit(1)).alias("n_cells"), (F.avg("accuracy") * 100).alias("accuracy_pct"), F.avg("nodes").alias("nodes"), F.avg("axp_len").alias("axp_len"))
    return rounded(rounded(g, "accuracy_pct", digits=4), "nodes", "axp_len")


@query("snk3_evidence_tables", f"""WITH {CERT_SQL} SELECT 'full' AS name, count(*) AS n FROM m UNION ALL SELECT 'by_method', count(DISTINCT (method, category, depth)) FROM m UNION ALL SELECT 'certified', sum(certified::INT)::BIGINT FROM c UNION ALL SELECT 'auxiliary', sum((NOT certified)::INT)::BIGINT FROM c
    UNION ALL SELECT 'complexity', count(DISTINCT dataset) FROM m UNION ALL SELECT 'win_loss', count(*) FROM m {_BASE} UNION ALL SELECT 'pareto', count(*) FROM ({_pareto_sql('nodes')[_pareto_sql('nodes').index('SELECT dataset, method, depth, round'):]})""")
def snk3(spark, sf):
    """Write the evidence tables and count what was written."""
    path = scratch(spark, "evidence")
    write_tables({"full": cell_rows(spark, sf)}, path)
    # the other tables come from the written cells; the rows are read once
    cells = spark.read.parquet(f"{path}/full")
    cert = with_certified(cells)
    tables = {
        "by_method": A.summarize(cells, ["method", "category", "depth"], ["accuracy"]), "certified": cert.filter("certified"), "auxiliary": cert.filter("not certified"),
        "complexity": cells.groupBy("dataset").agg(F.avg("nodes").alias("nodes")), "win_loss": A.outcomes(cells, "axis", ["dataset", "depth"], "accuracy", 1e-12),
        "pareto": A.pareto_front(cells.filter("accuracy is not null"), ["dataset"], "accuracy", "nodes"),
    }
    write_tables(tables, path)
    out = None
    for name in ["full", *tables]:
        part = spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out
