"""Binning, scores and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from rulespire.catalog.base import (
    CUT_FEATURES, CUTS, cut_bin, cut_bin_sql, entropy_sql, gain_sql, line_cte, line_rows, line_wide, load, penalized_sql, query, rounded, rsql,
)
from rulespire.functions import scores as C
from rulespire.operators import binning as B
from rulespire.operators import histograms as H
from rulespire.operators import search as X
from rulespire.operators.neighbours import neighbour_information
from rulespire.operators.profile import unpivot

FEATS = ["q", "p", "d", "t"]
LONG_SQL = "l AS (" + " UNION ALL ".join(f"SELECT rk, y, rf, '{f}' AS feature, {f} + 0.0 AS value FROM s" for f in FEATS) + ")"
COUNTS_SQL = "c AS (SELECT supp, rf, sum(y)::DOUBLE AS ip, sum(1 - y)::DOUBLE AS ineg FROM s GROUP BY 1, 2), k AS (SELECT *, sum(ip) OVER (PARTITION BY supp) AS tp, sum(ineg) OVER (PARTITION BY supp) AS tn FROM c)"


def long_rows(spark, sf, keep=("rk", "y", "rf"), feats=FEATS):
    long = unpivot(line_wide(spark, sf), feats, list(keep))
    return long.withColumn("value", F.col("value") + 0.0)


def edge_rows(edges, *keys):
    """Edges as rows (feature, i, edge)."""
    out = edges.select(*(keys or ("feature",)), F.posexplode("edges").alias("i", "edge"))
    return rounded(out, "edge")


def quantile_sql(n: int) -> str:
    probs = [i / n for i in range(n + 1)]
    return f"quantile_cont(value, {probs!r}::DOUBLE[])"


@query("bin1_quantile_edges", f"WITH {line_cte()}, {LONG_SQL}, e AS (SELECT feature, {quantile_sql(16)} AS edges FROM l GROUP BY 1) SELECT feature, (i - 1)::INT AS i, {rsql('edges[i]')} AS edge FROM e, range(1, 18) g(i)")
def bin1(spark, sf):
    return edge_rows(B.quantile_edges(long_rows(spark, sf), ["feature"], 16))


@query("bin2_equal_width_edges", f"WITH {line_cte()}, {LONG_SQL}, e AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM l GROUP BY 1) SELECT feature, i::INT AS i, {rsql('lo + i * ((hi - lo) / 10)', 5)} AS edge FROM e, range(0, 11) g(i)")
def bin2(spark, sf):
    out = B.equal_width_edges(long_rows(spark, sf), ["feature"], 10)
    return rounded(out.select("feature", F.posexplode("edges").alias("i", "edge")), "edge", digits=5)


DENSITY_SQL = f"""{line_cte()}, {LONG_SQL}, b0 AS (SELECT feature, {quantile_sql(8)} AS q FROM l GROUP BY 1), b AS (SELECT feature, list_sort(list_distinct(q)) AS e FROM b0),
    cells AS (SELECT feature, i, e[i] AS lo, e[i + 1] AS hi, i = len(e) - 1 AS is_last FROM b, range(1, 9) g(i) WHERE i < len(e)),
    cnt AS (SELECT c.feature, c.i, c.lo, c.hi, count(l.value) AS n FROM cells c LEFT JOIN l ON l.feature = c.feature AND l.value >= c.lo AND (l.value < c.hi OR (c.is_last AND l.value <= c.hi)) GROUP BY ALL),
    m AS (SELECT feature, quantile_cont(n, 0.5) AS mid FROM cnt GROUP BY 1),
    r AS (SELECT cnt.feature, lo AS edge FROM cnt UNION SELECT feature, hi FROM cnt UNION SELECT cnt.feature, (lo + hi) / 2 FROM cnt JOIN m USING (feature) WHERE n > mid * 1.5)"""


@query("bin3_density_edges", f"WITH {DENSITY_SQL} SELECT feature, (row_number() OVER (PARTITION BY feature ORDER BY edge) - 1)::INT AS i, {rsql('edge')} AS edge FROM r")
def bin3(spark, sf):
    return edge_rows(B.density_edges(long_rows(spark, sf), ["feature"], 16))


def _gini(p, n):
    return f"(CASE WHEN {p}+{n} > 0 THEN 2.0*({p})*({n})/({p}+{n}) ELSE 0.0 END)"


def _supervised_sql(feats: list[str], n_bins: int) -> str:
    """n_bins - 1 unrolled best-first rounds over value counts."""
    long = "l AS (" + " UNION ALL ".join(f"SELECT y, '{f}' AS feature, {f} + 0.0 AS value FROM s" for f in feats) + ")"
    ctes = [line_cte("or2"), long,
            "v0 AS (SELECT feature, value, sum(y)::DOUBLE AS pos, sum(1-y)::DOUBLE AS neg FROM l GROUP BY 1, 2)",
            "v AS (SELECT *, (value + lead(value) OVER (PARTITION BY feature ORDER BY value)) / 2 AS cut, 0 AS dummy FROM v0)",
            "cuts0 AS (SELECT feature, -1e300 AS cut FROM v GROUP BY 1)"]
    for i in range(n_bins - 1):
        ctes += [
            f"g{i} AS (SELECT v.feature, v.value, v.cut, v.pos, v.neg, (SELECT count(*) FROM cuts{i} c WHERE c.feature = v.feature AND c.cut <= v.value) AS seg FROM v)",
            f"h{i} AS (SELECT *, sum(pos) OVER w AS lp, sum(neg) OVER w AS ln, sum(pos) OVER a AS tp, sum(neg) OVER a AS tn, max(value) OVER a AS top FROM g{i} WINDOW w AS (PARTITION BY feature, seg ORDER BY value), a AS (PARTITION BY feature, seg))",
            f"d{i} AS (SELECT feature, cut, round({_gini('tp','tn')} - {_gini('lp','ln')} - {_gini('(tp-lp)','(tn-ln)')}, 9) AS drop_ FROM h{i} WHERE value < top)",
            f"b{i} AS (SELECT feature, cut FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY drop_ DESC, cut) AS r FROM d{i} WHERE drop_ > 0) WHERE r = 1)",
            f"cuts{i + 1} AS (SELECT * FROM cuts{i} UNION ALL SELECT * FROM b{i})",
        ]
    last = f"cuts{n_bins - 1}"
    return f"WITH {', '.join(ctes)}, e AS (SELECT feature, cut AS edge FROM {last} WHERE cut > -1e299 UNION SELECT feature, min(value) FROM l GROUP BY 1 UNION SELECT feature, max(value) FROM l GROUP BY 1) SELECT feature, (row_number() OVER (PARTITION BY feature ORDER BY edge) - 1)::INT AS i, {rsql('edge')} AS edge FROM e"


@query("bin4_supervised_edges", _supervised_sql(["q", "d", "t", "p"], 5))
def bin4(spark, sf):
    return edge_rows(B.supervised_edges(long_rows(spark, sf, feats=["q", "d", "t", "p"]), ["feature"], 5))


@query("bin5_clean_edges", f"""WITH g AS (SELECT l_suppkey AS supp, list_sort(list_distinct(list(l_discount + 0.0))) AS e FROM lineitem GROUP BY 1),
    c AS (SELECT supp, CASE WHEN len(e) = 1 THEN [e[1] - 1e-10::DOUBLE, e[1], e[1] + 1e-10::DOUBLE] WHEN len(e) = 2 THEN [e[1], (e[1] + e[2]) / 2, e[2]] ELSE e END AS e FROM g WHERE len(e) > 0)
    SELECT supp, len(e)::INT AS n_edges, round(e[1], 12) + 0.0 AS first_edge, round(e[2], 12) + 0.0 AS second_edge, round(e[-1], 12) + 0.0 AS last_edge FROM c""")
def bin5(spark, sf):
    li = load(spark, sf, "lineitem")
    g = li.groupBy(F.col("l_suppkey").alias("supp")).agg(F.collect_set(F.col("l_discount") + 0.0).alias("e")).withColumn("e", B.clean_edges(F.col("e")))
    out = g.select("supp", F.size("e").alias("n_edges"), F.get("e", F.lit(0)).alias("first_edge"), F.get("e", F.lit(1)).alias("second_edge"), F.element_at("e", -1).alias("last_edge"))
    return rounded(out, "first_edge", "second_edge", "last_edge", digits=12)


@query("bin6_assign_bins", f"""WITH {line_cte()}, {LONG_SQL}, e AS (SELECT feature, list_sort(list_distinct({quantile_sql(8)})) AS e FROM l GROUP BY 1),
    b AS (SELECT feature, y, len([x for x in e[2:-2] if x <= value])::INT AS bin FROM l JOIN e USING (feature)) SELECT feature, bin, y, count(*) AS n FROM b GROUP BY ALL""")
def bin6(spark, sf):
    long = long_rows(spark, sf)
    edges = B.quantile_edges(long, ["feature"], 8).withColumn("edges", B.clean_edges(F.col("edges")))
    return B.assign_bins(long, edges, ["feature"]).groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("n"))


LOCAL_SQL = f"""{line_cte()}, {LONG_SQL}, n AS (SELECT *, rf AS node FROM l),
    h AS (SELECT node, feature, count(DISTINCT value) AS k, quantile_cont(value, {[i / 16 for i in range(1, 16)]!r}::DOUBLE[]) AS qs FROM n GROUP BY 1, 2),
    v AS (SELECT DISTINCT node, feature, value FROM n), m AS (SELECT node, feature, (value + lead(value) OVER (PARTITION BY node, feature ORDER BY value)) / 2 AS cut FROM v),
    c AS (SELECT m.node, m.feature, m.cut AS threshold FROM m JOIN h USING (node, feature) WHERE k <= 16 AND m.cut IS NOT NULL UNION SELECT node, feature, unnest(qs) FROM h WHERE k > 16),
    j AS (SELECT c.node, c.feature, c.threshold, sum(CASE WHEN n.value < c.threshold THEN n.y ELSE 0 END)::DOUBLE AS cum_pos, sum(CASE WHEN n.value < c.threshold THEN 1 - n.y ELSE 0 END)::DOUBLE AS cum_neg, sum(n.y)::DOUBLE AS tot_pos, sum(1 - n.y)::DOUBLE AS tot_neg
      FROM c JOIN n USING (node, feature) GROUP BY 1, 2, 3),
    cuts AS (SELECT node, feature, min(threshold) AS threshold, cum_pos, cum_neg, tot_pos, tot_neg FROM j WHERE cum_pos + cum_neg > 0 GROUP BY node, feature, cum_pos, cum_neg, tot_pos, tot_neg)"""


def local_cut_table(spark, sf):
    """Cuts per (return flag as node, feature) with 16 bins."""
    long = long_rows(spark, sf).withColumnRenamed("rf", "node")
    hist = H.class_counts(long, ["node", "feature", "value"])
    return B.local_cuts(hist, ["node", "feature"], 16)


@query("bin7_local_cuts", f"WITH {LOCAL_SQL} SELECT node, feature, {rsql('threshold')} AS threshold, cum_pos, cum_neg, tot_pos, tot_neg FROM cuts")
def bin7(spark, sf):
    return rounded(local_cut_table(spark, sf), "threshold")


@query("bin9_bin_count", f"WITH {line_cte()}, {LONG_SQL} SELECT feature, (len(list_distinct({quantile_sql(32)})) - 1)::INT AS n_bins FROM l GROUP BY 1")
def bin9(spark, sf):
    e = B.quantile_edges(long_rows(spark, sf), ["feature"], 32)
    return e.select("feature", B.bin_count(B.clean_edges(F.col("edges"))).alias("n_bins"))


# --- scores -------------------------------------------------------------------------------


def supplier_counts(spark, sf):
    """Positives / negatives per (supplier, return flag) and per supplier."""
    from pyspark.sql import Window as W

    c = H.class_counts(line_wide(spark, sf), ["supp", "rf"]).withColumnsRenamed({"pos": "ip", "neg": "ineg"})
    w = W.partitionBy("supp")
    return c.withColumns({"tp": F.sum("ip").over(w), "tn": F.sum("ineg").over(w)})


def _cols(*names):
    return [F.col(n) for n in names]


@query("sco1_entropy", f"WITH {line_cte()}, {COUNTS_SQL} SELECT supp, rf, {rsql(entropy_sql('ip', 'ineg'))} AS h FROM k")
def sco1(spark, sf):
    return rounded(supplier_counts(spark, sf).select("supp", "rf", C.entropy(*_cols("ip", "ineg")).alias("h")), "h")


@query("sco2_information_gain", f"WITH {line_cte()}, {COUNTS_SQL} SELECT supp, rf, {rsql(gain_sql('tp', 'tn', 'ip', 'ineg'))} AS gain FROM k")
def sco2(spark, sf):
    return rounded(supplier_counts(spark, sf).select("supp", "rf", C.information_gain(*_cols("tp", "tn", "ip", "ineg")).alias("gain")), "gain")


@query("sco3_gain_ratio", f"""WITH {line_cte()}, {COUNTS_SQL}, g AS (SELECT *, {gain_sql('tp', 'tn', 'ip', 'ineg')} AS g, {entropy_sql('ip+ineg', 'tp+tn-ip-ineg')} AS si FROM k)
    SELECT supp, rf, {rsql('CASE WHEN g <= 0 THEN -1.0 WHEN si <= 1e-10 THEN g ELSE g / si END')} AS ratio FROM g""")
def sco3(spark, sf):
    return rounded(supplier_counts(spark, sf).select("supp", "rf", C.gain_ratio(*_cols("tp", "tn", "ip", "ineg")).alias("ratio")), "ratio")


@query("sco4_penalized_gain", f"WITH {line_cte()}, {COUNTS_SQL}, g AS (SELECT *, {gain_sql('tp', 'tn', 'ip', 'ineg')} AS g, tp + tn AS n FROM k) SELECT supp, rf, a::INT AS arity, {rsql(penalized_sql('g', 'a', 'n'))} AS score FROM g, range(1, 4) r(a)")
def sco4(spark, sf):
    g = supplier_counts(spark, sf).withColumn("g", C.information_gain(*_cols("tp", "tn", "ip", "ineg"))).withColumn("arity", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return rounded(g.select("supp", "rf", "arity", C.penalized_gain(F.col("g"), F.col("arity"), F.col("tp") + F.col("tn")).alias("score")), "score")


@query("sco5_best_cut_gain", f"""WITH {LOCAL_SQL}, g AS (SELECT node, feature, {gain_sql('tot_pos', 'tot_neg', 'cum_pos', 'cum_neg')} AS g FROM cuts WHERE cum_pos + cum_neg >= 50 AND tot_pos + tot_neg - cum_pos - cum_neg >= 50)
    SELECT k.node, k.feature, {rsql('coalesce(max(g), 0.0)')} AS feature_score FROM (SELECT DISTINCT node, feature FROM cuts) k LEFT JOIN g USING (node, feature) GROUP BY 1, 2""")
def sco5(spark, sf):
    return rounded(X.feature_scores(local_cut_table(spark, sf), ["node", "feature"], 50), "feature_score")


@query("sco6_feature_ratio", f"""WITH {LOCAL_SQL}, g0 AS (SELECT node, feature, {gain_sql('tot_pos', 'tot_neg', 'cum_pos', 'cum_neg')} AS g, {entropy_sql('cum_pos+cum_neg', 'tot_pos+tot_neg-cum_pos-cum_neg')} AS si FROM cuts WHERE cum_pos + cum_neg >= 5 AND tot_pos + tot_neg - cum_pos - cum_neg >= 5)
    SELECT node, feature, {rsql('greatest(max(CASE WHEN g <= 0 THEN -1.0 WHEN si <= 1e-10 THEN g ELSE g / si END), 0.0)')} AS feature_score FROM g0 GROUP BY 1, 2""")
def sco6(spark, sf):
    return rounded(X.feature_scores(local_cut_table(spark, sf), ["node", "feature"], 5, use_ratio=True), "feature_score")


def _bin_long_sql(task="or2"):
    return f"{line_cte(task)}, bl AS (" + " UNION ALL ".join(f"SELECT rf, supp, y, '{f}' AS feature, {cut_bin_sql(f)} AS b FROM s" for f in CUT_FEATURES) + ")"


def bin_long(spark, sf, task="or2"):
    df = line_wide(spark, sf, task)
    entry = F.array(*[F.struct(F.lit(f).alias("feature"), cut_bin(f).alias("b")) for f in CUT_FEATURES])
    return df.select("rf", "supp", "y", F.inline(entry))


@query("sco7_mutual_information", f"""WITH {_bin_long_sql()}, c AS (SELECT rf, feature, b, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM bl GROUP BY 1, 2, 3)
    SELECT rf, feature, {rsql('greatest(' + entropy_sql('sum(pos)', 'sum(neg)') + ' - sum((pos + neg) * ' + entropy_sql('pos', 'neg') + ') / sum(pos + neg), 0.0)')} AS feature_score FROM c GROUP BY 1, 2""")
def sco7(spark, sf):
    cells = H.class_counts(bin_long(spark, sf), ["rf", "feature", "b"])
    return rounded(X.mutual_information(cells, ["rf", "feature"]), "feature_score")


# H(n) - 0.5772... is the digamma function of n + 1; neighbours by rank, rows between the ends by the last running sum below them
NEIGHBOUR_SQL = f"""{line_cte()}, {LONG_SQL}, c0 AS (SELECT rf, feature, y, value AS v, count(*) AS n FROM l GROUP BY ALL),
    c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rf, feature, y ORDER BY v) AS i, sum(n) OVER (PARTITION BY rf, feature, y) AS n_c FROM c0) WHERE n_c > 1),
    cum AS (SELECT rf, feature, v, sum(sum(n)) OVER (PARTITION BY rf, feature ORDER BY v) AS cum FROM c GROUP BY 1, 2, 3),
    w AS (SELECT a.*, least(3, a.n_c - 1) AS k, b.v AS u, abs(b.v - a.v) AS dist, CASE WHEN b.i = a.i THEN b.n - 1 ELSE b.n END AS bn FROM c a JOIN c b ON a.rf = b.rf AND a.feature = b.feature AND a.y = b.y AND b.i BETWEEN a.i - 3 AND a.i + 3),
    g AS (SELECT *, sum(bn) OVER (PARTITION BY rf, feature, y, i ORDER BY dist) AS got FROM w),
    r AS (SELECT *, min(CASE WHEN got >= k THEN dist END) OVER (PARTITION BY rf, feature, y, i) AS r FROM g),
    e AS (SELECT rf, feature, v, n, n_c, 1 + coalesce(sum(CASE WHEN dist < r OR u = v THEN bn END), 0) AS k, coalesce(max(CASE WHEN dist = r AND u < v THEN u END), v - r) AS lo, coalesce(min(CASE WHEN dist = r AND u > v THEN u END), v + r) AS hi, r FROM r GROUP BY rf, feature, y, v, n, n_c, k, r),
    m AS (SELECT e.*, b.cum AS below FROM e ASOF LEFT JOIN cum b ON b.rf = e.rf AND b.feature = e.feature AND (CASE WHEN e.r = 0 THEN e.v ELSE nextafter(e.hi, '-inf'::DOUBLE) END) >= b.v),
    m2 AS (SELECT m.*, below - coalesce(b.cum, 0) AS m FROM m ASOF LEFT JOIN cum b ON b.rf = m.rf AND b.feature = m.feature AND (CASE WHEN m.r = 0 THEN nextafter(m.v, '-inf'::DOUBLE) ELSE m.lo END) >= b.v),
    h AS (SELECT i + 1 AS n, sum(CASE WHEN i = 0 THEN 0.0 ELSE 1.0::DOUBLE / i END) OVER (ORDER BY i) AS s FROM range(0, (SELECT count(*) FROM s)) t(i)),
    t AS (SELECT rf, feature, sum(m2.n) AS n, sum(m2.n * (a.s - b.s - d.s)) AS part FROM m2 JOIN h a ON a.n = m2.k JOIN h b ON b.n = m2.m JOIN h d ON d.n = m2.n_c GROUP BY 1, 2)"""


@query("sco7_neighbour_information", f"WITH {NEIGHBOUR_SQL} SELECT rf, feature, {rsql('greatest(h.s + part / t.n, 0.0)')} AS feature_score FROM t JOIN h ON h.n = t.n")
def sco7_neighbours(spark, sf):
    return rounded(neighbour_information(long_rows(spark, sf, keep=("y", "rf")), ["rf", "feature"]), "feature_score")


def median_bits(spark, sf, task="xor2"):
    """1 at or above the exact median of each column (four numbers through the driver)."""
    from rulespire.operators.scan import exact_quantiles

    df = line_rows(spark, sf, task)
    mids = {r["feature"]: r["quantile"] for r in exact_quantiles(unpivot(df, FEATS), ["feature"], "value", [0.5]).collect()}
    return df.select("y", *[(F.col(f) >= mids[f]).cast("int").alias(f) for f in FEATS])


_PAIRS = [(a, b) for i, a in enumerate(FEATS) for b in FEATS[i + 1:]]
SCAN_SQL = f"""{line_cte('xor2')}, m AS (SELECT {', '.join(f'quantile_cont({f}, 0.5) AS {f}' for f in FEATS)} FROM s),
    b AS (SELECT y, {', '.join(f'(s.{f} >= m.{f})::INT AS {f}' for f in FEATS)} FROM s, m),
    cells AS ({' UNION ALL '.join(f"SELECT '{a}' AS fi, '{b}' AS fj, {a} AS bi, {b} AS bj, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM b GROUP BY {a}, {b}" for a, b in _PAIRS)}),
    g AS (SELECT fi, fj, {entropy_sql('sum(pos)', 'sum(neg)')} - sum((pos + neg) * {entropy_sql('pos', 'neg')}) / sum(pos + neg) AS joint_gain,
      greatest({gain_sql('sum(pos)', 'sum(neg)', 'sum(CASE WHEN bi = 1 THEN pos ELSE 0 END)', 'sum(CASE WHEN bi = 1 THEN neg ELSE 0 END)')}, {gain_sql('sum(pos)', 'sum(neg)', 'sum(CASE WHEN bj = 1 THEN pos ELSE 0 END)', 'sum(CASE WHEN bj = 1 THEN neg ELSE 0 END)')}, 0.0) AS single_gain FROM cells GROUP BY 1, 2)"""


@query("sco8_interaction_scan", f"WITH {SCAN_SQL} SELECT fi, fj, {rsql('joint_gain')} AS joint_gain, {rsql('single_gain')} AS single_gain, {rsql('joint_gain - single_gain')} AS synergy FROM g WHERE joint_gain - single_gain > 1e-6 OR joint_gain > 1.1 * single_gain")
def sco8(spark, sf):
    return rounded(X.interaction_scan(median_bits(spark, sf), FEATS), "joint_gain", "single_gain", "synergy")


@query("sco9_candidate_pool", f"""WITH f AS (SELECT p_type || '/' || p_brand AS feature, l_suppkey % 4 AS node, {rsql('avg(l_quantity)', 6)} AS score FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, feature) AS rk, row_number() OVER (PARTITION BY node ORDER BY hash_u, feature) AS rr FROM (SELECT *, ('0x' || substr(md5(concat_ws('-', '42', 'extra', feature)), 1, 8))::BIGINT / 4294967296.0 AS hash_u FROM f))
    SELECT node, feature FROM (SELECT *, row_number() OVER (PARTITION BY node, rk <= 30 ORDER BY hash_u, feature) AS er FROM r) WHERE rk <= 30 OR er <= 10""")
def sco9(spark, sf):
    from pyspark.sql import Window as W
    from rulespire.functions.hashing import unit_hash

    j = load(spark, sf, "lineitem").join(load(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    f = j.groupBy(F.concat_ws("/", "p_type", "p_brand").alias("feature"), (F.col("l_suppkey") % 4).alias("node")).agg(F.round(F.avg("l_quantity"), 6).alias("score"))
    # one row per (node, feature): the feature list of a table, not its rows
    r = f.withColumn("u", unit_hash(42, "extra", F.col("feature"))).withColumn("rk", F.row_number().over(W.partitionBy("node").orderBy(F.desc("score"), "feature")))
    r = r.withColumn("er", F.row_number().over(W.partitionBy("node", F.col("rk") <= 30).orderBy("u", "feature")))
    return r.filter((F.col("rk") <= 30) | (F.col("er") <= 10)).select("node", "feature")


@query("sco10_rule_counts", f"""WITH {line_cte()} SELECT supp, sum(y)::DOUBLE AS tp, sum(1 - y)::DOUBLE AS tn, sum(CASE WHEN q >= 30 OR d < 0.03 THEN y ELSE 0 END)::DOUBLE AS ip, sum(CASE WHEN q >= 30 OR d < 0.03 THEN 1 - y ELSE 0 END)::DOUBLE AS ineg FROM s GROUP BY 1""")
def sco10(spark, sf):
    return X.rule_counts(line_wide(spark, sf), (F.col("q") >= 30) | (F.col("d") < 0.03), ["supp"])


@query("sco11_label_counts", f"WITH {line_cte()} SELECT supp, rf, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM s GROUP BY 1, 2")
def sco11(spark, sf):
    return H.class_counts(line_wide(spark, sf), ["supp", "rf"])


@query("sco12_laplace", f"WITH {line_cte()} SELECT supp, {rsql('(sum(y) + 1.0) / (count(*) + 2.0)')} AS proba FROM s GROUP BY 1")
def sco12(spark, sf):
    g = line_wide(spark, sf).groupBy("supp").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    return rounded(g.select("supp", C.laplace_proba(F.col("pos"), F.col("n")).alias("proba")), "proba")


# --- histograms -----------------------------------------------------------------------------

BINS_SQL = f"b AS (SELECT rf, y, {', '.join(f'{cut_bin_sql(f)} AS {a}' for f, a in zip(('q', 'd', 't'), ('bi', 'bj', 'bk')))} FROM s)"


def bins3(spark, sf):
    df = line_wide(spark, sf)
    return df.select("rf", "y", cut_bin("q").alias("bi"), cut_bin("d").alias("bj"), cut_bin("t").alias("bk"))


def _cells_sql(axes):
    return f"SELECT rf, {', '.join(axes)}, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM b GROUP BY ALL"


@query("hst1_histogram", f"WITH {_bin_long_sql()} SELECT supp, feature, b, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM bl GROUP BY 1, 2, 3")
def hst1(spark, sf):
    return H.class_counts(bin_long(spark, sf), ["supp", "feature", "b"])


@query("hst2_joint_histogram", f"WITH {line_cte()}, {BINS_SQL} {_cells_sql(['bi', 'bj'])}")
def hst2(spark, sf):
    return H.class_counts(bins3(spark, sf), ["rf", "bi", "bj"])


@query("hst3_joint_histogram_3d", f"WITH {line_cte()}, {BINS_SQL} {_cells_sql(['bi', 'bj', 'bk'])}")
def hst3(spark, sf):
    return H.class_counts(bins3(spark, sf), ["rf", "bi", "bj", "bk"])


def _prefix_sql(axes):
    sizes = {"bi": 10, "bj": 11, "bk": 9}
    grid = ", ".join(f"range(0, {sizes[a]}) g{a}({a})" for a in axes)
    on = " AND ".join(f"c.{a} <= g.{a}" for a in axes)
    cols = ", ".join(f"g.{a}::INT AS {a}" for a in axes)
    return f"""WITH {line_cte()}, {BINS_SQL}, c AS ({_cells_sql(axes)}), g AS (SELECT * FROM (SELECT DISTINCT rf FROM b), {grid})
      SELECT g.rf, {cols}, coalesce(sum(c.pos), 0.0) AS pos, coalesce(sum(c.neg), 0.0) AS neg FROM g LEFT JOIN c ON c.rf = g.rf AND {on} GROUP BY ALL"""


def _prefix(spark, sf, axes):
    cells = H.densify(H.class_counts(bins3(spark, sf), ["rf", *axes]), ["rf"], axes)
    tag = "x" * len(axes)
    return H.cumulate(cells, ["rf"], axes, placed=True).select("rf", *axes, F.col(f"p_{tag}").alias("pos"), F.col(f"n_{tag}").alias("neg"))


@query("hst4_prefix_1d", _prefix_sql(["bi"]))
def hst4(spark, sf):
    return _prefix(spark, sf, ["bi"])


@query("hst5_prefix_2d", _prefix_sql(["bi", "bj"]))
def hst5(spark, sf):
    return _prefix(spark, sf, ["bi", "bj"])


@query("hst6_prefix_3d", _prefix_sql(["bi", "bj", "bk"]))
def hst6(spark, sf):
    return _prefix(spark, sf, ["bi", "bj", "bk"])


@query("hst4_range_count", f"WITH {line_cte()}, {BINS_SQL} SELECT rf, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM b WHERE bi >= 2 AND bi < 6 AND bj >= 1 AND bj < 7 AND bk < 5 GROUP BY 1")
def hst4r(spark, sf):
    return H.range_counts(H.class_counts(bins3(spark, sf), ["rf", "bi", "bj", "bk"]), ["rf"], {"bi": (2, 6), "bj": (1, 7), "bk": (0, 5)})


def _union_sql(cond):
    return f"WITH {line_cte()}, {BINS_SQL} SELECT rf, sum(CASE WHEN {cond} THEN y ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN {cond} THEN 1 - y ELSE 0 END)::DOUBLE AS neg FROM b GROUP BY 1"


@query("hst7_union_2_ranges", _union_sql("(bi >= 4 AND bi < 10) OR (bj < 3)"))
def hst7(spark, sf):
    return H.union_counts(H.class_counts(bins3(spark, sf), ["rf", "bi", "bj"]), ["rf"], {"bi": (4, 10), "bj": (0, 3)})


@query("hst8_union_3_ranges", _union_sql("(bi >= 4 AND bi < 10) OR (bj < 3) OR (bk >= 6 AND bk < 9)"))
def hst8(spark, sf):
    return H.union_counts(H.class_counts(bins3(spark, sf), ["rf", "bi", "bj", "bk"]), ["rf"], {"bi": (4, 10), "bj": (0, 3), "bk": (6, 9)})
