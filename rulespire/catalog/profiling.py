"""Sources, profiling, sinks and registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulespire.catalog.base import LINE_KEY_SQL, line_cte, line_rows, line_wide, load, longs, query, rounded, rsql
from rulespire.operators import profile as P
from rulespire.session import scratch_dir as scratch
from rulespire.sources.label_text import read_label_text, restrict
from rulespire.sources.registry import Registry, config_key, restore_join
from rulespire.sources.sinks import load_model, save_model, write_csv, write_json
from rulespire.sources.tables import LINE_FEATURES, as_task

EVENT_BITS_SQL = """ev AS (SELECT event_type AS task, event_id, (value >= 20)::INT AS y, (value >= 10)::INT AS b0,
    (extract('hour' FROM ts) >= 12)::INT AS b1, (user_id % 2)::INT AS b2, (user_id % 7 = 0)::INT AS b3 FROM events)"""


def event_bits(spark, sf):
    ev = load(spark, sf, "events")
    return ev.select(
        F.col("event_type").alias("task"), "event_id", (F.col("value") >= 20).cast("int").alias("y"),
        (F.col("value") >= 10).cast("int").alias("b0"), (F.hour("ts") >= 12).cast("int").alias("b1"),
        (F.col("user_id") % 2).cast("int").alias("b2"), (F.col("user_id") % 7 == 0).cast("int").alias("b3"))


def event_text(spark, sf) -> str:
    """The event bits written as label-first text, one folder per task file."""
    path = scratch(spark, "text")
    line = F.concat_ws(" ", "y", "b0", "b1", "b2", "b3")
    event_bits(spark, sf).select("task", line.alias("value")).write.partitionBy("task").text(path)
    return path


@query("src1_read_label_text", f"""WITH {EVENT_BITS_SQL} SELECT y, b0::DOUBLE AS x0, b1::DOUBLE AS x1, b2::DOUBLE AS x2, b3::DOUBLE AS x3,
    count(*) AS n FROM ev GROUP BY ALL""")
def src1(spark, sf):
    rows = read_label_text(spark, event_text(spark, sf), "*.txt")
    return rows.groupBy("y", *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(4)]).agg(F.count(F.lit(1)).alias("n"))


@query("src2_discover_tasks", "SELECT event_type AS task, count(*) AS n_rows FROM events GROUP BY 1")
def src2(spark, sf):
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(event_text(spark, sf))
    task = F.regexp_extract(F.col("_metadata.file_path"), "task=([^/]+)/", 1)
    return raw.select(task.alias("task")).groupBy("task").agg(F.count(F.lit(1)).alias("n_rows"))


@query("src3_restrict_tasks", """SELECT event_type AS task, count(*) AS n_rows FROM events
    WHERE event_type IN (SELECT event_type FROM events WHERE event_type IN ('click','purchase','view','signup') GROUP BY 1 ORDER BY 1 LIMIT 3) GROUP BY 1""")
def src3(spark, sf):
    ev = event_bits(spark, sf).withColumn("n_features", F.lit(4))
    kept = restrict(ev, ["click", "purchase", "view", "signup"], first=3, max_width=5000)
    return kept.groupBy("task").agg(F.count(F.lit(1)).alias("n_rows"))


@query("src4_table_as_task", """SELECT CAST(o_orderstatus = 'F' AS INT) AS y, o_totalprice AS total, c_acctbal AS acctbal, c_nationkey::DOUBLE AS nation,
    (c_mktsegment = 'BUILDING')::INT::DOUBLE AS building, extract('month' FROM o_orderdate)::DOUBLE AS month, 'orders' AS task, o_orderkey::VARCHAR AS rk
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def src4(spark, sf):
    o = load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return as_task(o, F.col("o_orderstatus") == "F", {
        "total": F.col("o_totalprice"), "acctbal": F.col("c_acctbal"), "nation": F.col("c_nationkey"),
        "building": (F.col("c_mktsegment") == "BUILDING").cast("double"), "month": F.month("o_orderdate")}, F.col("o_orderkey"), "orders")


@query("prf1_validate", f"""WITH {line_cte()}, v AS (SELECT *, CASE WHEN rf = 'N' THEN NULL ELSE t END AS t2, CASE WHEN ln = 7 THEN 'nan'::DOUBLE ELSE d END AS d2 FROM s)
    SELECT count(*) AS n_rows, sum((y NOT IN (0,1))::INT)::BIGINT AS bad_labels, sum((t2 IS NULL)::INT)::BIGINT AS nulls,
    sum(isnan(d2)::INT)::BIGINT AS nans, sum(isinf(q)::INT)::BIGINT AS infs, 3 AS n_features FROM v""")
def prf1(spark, sf):
    df = line_wide(spark, sf).withColumn("t2", F.when(F.col("rf") != "N", F.col("t"))).withColumn(
        "d2", F.when(F.col("ln") == 7, F.lit(float("nan"))).otherwise(F.col("d")))
    return P.validate(df, "y", ["q", "t2", "d2"])


@query("prf2_binarize_labels", """WITH r AS (SELECT l_linestatus AS task, l_returnflag AS label FROM lineitem
      UNION ALL SELECT 'events', event_type FROM events UNION ALL SELECT 'one', 'x' FROM nation),
    c AS (SELECT task, label, count(*) AS n FROM r GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n DESC, label) AS rk, count(*) OVER (PARTITION BY task) AS k,
          max(label) OVER (PARTITION BY task) AS hi FROM c)
    SELECT task, y, sum(n)::BIGINT AS n FROM (SELECT task, n, CASE WHEN k = 1 THEN 0 WHEN k = 2 THEN (label = hi)::INT ELSE (rk = 1)::INT END AS y FROM k) GROUP BY 1, 2""")
def prf2(spark, sf):
    li = load(spark, sf, "lineitem").select(F.col("l_linestatus").alias("task"), F.col("l_returnflag").alias("label"))
    ev = load(spark, sf, "events").select(F.lit("events").alias("task"), F.col("event_type").alias("label"))
    one = load(spark, sf, "nation").select(F.lit("one").alias("task"), F.lit("x").alias("label"))
    out = P.binarize_labels(li.union(ev).union(one), ["task"], "label")
    return out.groupBy("task", "y").agg(F.count(F.lit(1)).alias("n"))


@query("prf3_drop_constant", f"""WITH {line_cte()}, v AS (SELECT var_pop(q) AS q, var_pop(p) AS p, var_pop(d) AS d, var_pop(t) AS t, var_pop(ln * 0) AS zero, var_pop(ls) AS ls FROM s),
    u AS (UNPIVOT v ON q, p, d, t, zero, ls INTO NAME feature VALUE variance) SELECT feature, {rsql('variance', 4)} AS variance FROM u WHERE variance > 1e-12""")
def prf3(spark, sf):
    df = line_rows(spark, sf).withColumn("zero", F.col("ln") * 0)
    v = P.feature_variance(df, ["q", "p", "d", "t", "zero", "ls"]).filter(F.col("variance") > 1e-12)
    return rounded(v, "variance", digits=4)


@query("prf4_task_profile", f"""WITH {EVENT_BITS_SQL} SELECT task, count(*) AS n_samples, ((var_pop(b0) > 1e-12)::INT + (var_pop(b1) > 1e-12)::INT + (var_pop(b2) > 1e-12)::INT + (var_pop(b3) > 1e-12)::INT) AS n_features,
    {rsql('avg(y)')} AS pos_rate, bool_and(b0 IN (0,1) AND b1 IN (0,1) AND b2 IN (0,1) AND b3 IN (0,1)) AS is_binary, 4 AS n_original FROM ev GROUP BY 1""")
def prf4(spark, sf):
    return rounded(P.task_profile(event_bits(spark, sf), "y", ["b0", "b1", "b2", "b3"], ["task"]), "pos_rate")


@query("prf5_expanded_width", f"""WITH w AS (SELECT doc_id, CAST(len(regexp_split_to_array(trim(text), '\\s+')) AS BIGINT) AS n FROM documents)
    SELECT doc_id, n, CAST(n + n * (n - 1) / 2 * 5 AS BIGINT) AS expanded FROM w""")
def prf5(spark, sf):
    w = load(spark, sf, "documents").select("doc_id", F.size(F.split(F.trim("text"), "\\s+")).cast("bigint").alias("n"))
    return w.withColumn("expanded", P.expanded_width(F.col("n")))


@query("prf6_feature_summary", " UNION ALL ".join(
    f"SELECT rf, '{f}' AS feature, min({f}) + 0.0 AS lo, max({f}) + 0.0 AS hi, min({f}) = max({f}) AS is_constant, bool_and({f} IN (0, 1)) AS is_binary FROM (SELECT * FROM (WITH {line_cte()} SELECT * FROM s)) GROUP BY rf"
    for f in LINE_FEATURES))
def prf6(spark, sf):
    s = P.feature_summary(line_wide(spark, sf), LINE_FEATURES, ["rf"])
    return s.withColumns({"lo": F.col("lo") + 0.0, "hi": F.col("hi") + 0.0})


@query("prf7_minority_share", f"""WITH {line_cte()} SELECT supp, count(*) AS n, sum(y)::BIGINT AS n_pos, {rsql('least(avg(y), 1 - avg(y))')} AS minority_share FROM s GROUP BY supp""")
def prf7(spark, sf):
    return rounded(P.minority_share(line_wide(spark, sf), "y", ["supp"]), "minority_share")


@query("snk1_csv_union", """SELECT rf, n, avg_q, CAST(NULL AS VARCHAR) AS status FROM (SELECT l_returnflag AS rf, count(*) AS n, round(avg(l_quantity), 6) AS avg_q FROM lineitem GROUP BY 1)
    UNION ALL SELECT NULL, n, NULL, status FROM (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1)""")
def snk1(spark, sf):
    a = load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("rf")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("avg_q"))
    b = load(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    path = scratch(spark, "csv")
    write_csv([a, b], path)
    return spark.read.option("header", True).schema("rf string, n bigint, avg_q double, status string").csv(path)


@query("snk2_json", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def snk2(spark, sf):
    df = load(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    path = scratch(spark, "json")
    write_json(df, path)
    return spark.read.schema("event_type string, n bigint, total double").json(path)


EXPERIMENT_SQL = """e AS (SELECT event_id AS experiment_id, ts AS created_at, '{"family":"' || event_type || '","seed":' || user_id || '}' AS config FROM events)"""


def experiments(spark, sf):
    """Experiment rows derived from events: a configuration text per event."""
    return load(spark, sf, "events").select(
        F.col("event_id").alias("experiment_id"), F.col("ts").alias("created_at"),
        F.to_json(F.struct(F.col("event_type").alias("family"), F.col("user_id").alias("seed"))).alias("config"))


def runs(spark, sf):
    return load(spark, sf, "events").select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("experiment_id"), F.col("ts").alias("created_at"),
        F.col("event_type").alias("method"), F.when(F.col("event_type") != "error", F.col("value")).alias("accuracy"))


RUNS_SQL = "r AS (SELECT event_id AS run_id, user_id AS experiment_id, ts AS created_at, event_type AS method, CASE WHEN event_type <> 'error' THEN value END AS accuracy FROM events)"


@query("reg1_merge_schema", f"WITH {RUNS_SQL} SELECT method, count(*) AS n, count(note) AS with_note FROM (SELECT method, NULL AS note FROM r UNION ALL SELECT method, 'new' FROM r WHERE method = 'view') GROUP BY 1")
def reg1(spark, sf):
    registry = Registry(spark, scratch(spark, "registry"))
    registry.add_runs(runs(spark, sf))
    registry.add_runs(runs(spark, sf).filter("method = 'view'").withColumn("note", F.lit("new")))
    return registry.runs().groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count("note").alias("with_note"))


@query("reg2_config_hash", f"WITH {EXPERIMENT_SQL} SELECT experiment_id, config, substr(sha256(config), 1, 16) AS config_hash FROM e")
def reg2(spark, sf):
    return experiments(spark, sf).select("experiment_id", "config", config_key(F.col("config")).alias("config_hash"))


@query("reg3_append_runs", f"WITH {RUNS_SQL} SELECT method, count(*) AS n, round(avg(accuracy), 6) AS accuracy FROM r GROUP BY 1")
def reg3(spark, sf):
    registry = Registry(spark, scratch(spark, "runs"))
    registry.add_runs(runs(spark, sf).filter("accuracy is null"))
    registry.add_runs(runs(spark, sf).filter("accuracy is not null"))
    return registry.runs().groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("accuracy"), 6).alias("accuracy"))


@query("reg4_list_newest", f"WITH {RUNS_SQL} SELECT run_id, experiment_id, method FROM r")
def reg4(spark, sf):
    registry = Registry(spark, scratch(spark, "newest"))
    registry.add_runs(runs(spark, sf))
    return registry.runs().select(F.col("run_id").cast("bigint").alias("run_id"), "experiment_id", "method")


@query("reg5_restore", f"""WITH {RUNS_SQL}, p AS (SELECT event_id AS run_id, value / 2 AS accuracy FROM events WHERE event_type IN ('view', 'error'))
    SELECT r.run_id, r.experiment_id, r.method, coalesce(p.accuracy, r.accuracy) AS accuracy FROM r LEFT JOIN p USING (run_id)""")
def reg5(spark, sf):
    payload = load(spark, sf, "events").filter(F.col("event_type").isin("view", "error")).select(F.col("event_id").alias("run_id"), (F.col("value") / 2).alias("accuracy"))
    return restore_join(runs(spark, sf), payload, ["accuracy"]).select("run_id", "experiment_id", "method", "accuracy")


@query("reg6_delete_runs", f"WITH {RUNS_SQL} SELECT r.run_id, r.method FROM r ANTI JOIN (SELECT event_id AS run_id FROM events WHERE event_type = 'click') USING (run_id)")
def reg6(spark, sf):
    gone = load(spark, sf, "events").filter("event_type = 'click'").select(F.col("event_id").alias("run_id"))
    registry = Registry(spark, scratch(spark, "deleted"))
    registry.add_runs(runs(spark, sf))
    registry.delete_runs(gone)
    return registry.runs().select(F.col("run_id").cast("bigint").alias("run_id"), "method")
