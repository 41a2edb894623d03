"""Clause shapes of tree paths: clause tables, certificates, backend labels, audits.

Input is ``steps(tree_id, leaf_id, step, node_id, taken, family, combine, lits)``: one
row per rule on a root-to-leaf path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rulespire.functions.rules import negated


# Backend labels of explanation metadata.
AFFINE_BACKEND = "affine"
HORN_BACKEND = "structural_horn"
ANTIHORN_BACKEND = "structural_antihorn"
TWO_SAT_BACKEND = "two_sat"
INTERVAL_BACKEND = "interval_dfs_fallback"
CASE_SPLIT_BACKEND = "prototype_case_split"


def threshold_key(t: Column) -> Column:
    """Thresholds are the same when equal to 10 decimals."""
    return F.round(t, 10)


def step_clauses(combine: Column, lits: Column, taken: Column) -> Column:
    """array<array<literal>>: the rule's branch as a conjunction of clauses.

    OR is a clause when true and unit clauses when false; AND the other way round; the
    complement of a two-clause rule pairs the negated literals across clauses. XOR is
    not clausal and yields an empty list.
    """
    whole = F.array(lits)
    whole_neg = F.array(F.transform(lits, negated))
    units = F.transform(lits, lambda l: F.array(l))
    units_neg = F.transform(lits, lambda l: F.array(negated(l)))
    ids = F.array_sort(F.array_distinct(F.transform(lits, lambda l: l.clause)))
    per_clause = F.transform(ids, lambda c: F.filter(lits, lambda l: l.clause == c))
    first = F.filter(lits, lambda l: l.clause == 0)
    second = F.filter(lits, lambda l: l.clause == 1)
    across = F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.array(negated(a), negated(b)))))
    nothing = F.filter(whole, lambda _: F.lit(False))
    return (
        F.when(combine == "or", F.when(taken, whole).otherwise(units_neg))
        .when(combine == "and", F.when(taken, units).otherwise(whole_neg))
        .when(combine == "cnf", F.when(taken, per_clause).otherwise(across))
        .otherwise(nothing)
    )


def path_clauses(steps: DataFrame) -> DataFrame:
    """(tree_id, leaf_id, kind, clause) with the path's own and its threshold-order clauses."""
    own = steps.select("tree_id", "leaf_id", F.explode(step_clauses(F.col("combine"), F.col("lits"), F.col("taken"))).alias("clause"))
    own = own.select("tree_id", "leaf_id", F.lit("path").alias("kind"), F.col("clause"))
    order = order_clauses(steps).select("tree_id", "leaf_id", F.lit("order").alias("kind"), F.array(
        F.struct(F.lit(0).alias("clause"), F.col("feature"), F.lit("LT").alias("op"), F.col("hi").alias("threshold")),
        F.struct(F.lit(0).alias("clause"), F.col("feature"), F.lit("GE").alias("op"), F.col("lo").alias("threshold"))).alias("clause"))
    return own.unionByName(order)


def order_clauses(steps: DataFrame) -> DataFrame:
    """x >= hi implies x >= lo for every two thresholds lo < hi of a feature on a path.

    The thresholds of a (path, feature) - at most path length x 4 - are collected and
    paired inside the row.
    """
    atoms = steps.filter(F.col("combine") != "xor").select("tree_id", "leaf_id", F.inline("lits"))
    ts = atoms.groupBy("tree_id", "leaf_id", "feature").agg(F.array_sort(F.collect_set(threshold_key(F.col("threshold")))).alias("ts"))
    pairs = F.flatten(F.transform("ts", lambda a: F.transform(F.filter("ts", lambda b: b > a), lambda b: F.struct(a.alias("lo"), b.alias("hi")))))
    return ts.select("tree_id", "leaf_id", "feature", F.inline(pairs))


def certificate(steps: DataFrame) -> DataFrame:
    """horn / antihorn / 2cnf / none per path from its clause shapes; XOR is never certified.

    Order clauses and unit clauses fit all three shapes, so they cannot change the answer.
    """
    shaped = steps.withColumn("__c", step_clauses(F.col("combine"), F.col("lits"), F.col("taken")))
    pos = lambda c: F.size(F.filter(c, lambda l: l.op == "GE"))
    worst = lambda f: F.coalesce(F.array_max(F.transform("__c", f)), F.lit(0))
    per = shaped.groupBy("tree_id", "leaf_id").agg(
        F.bool_or(F.col("combine") == "xor").alias("has_xor"),
        F.max(worst(pos)).alias("max_pos"), F.max(worst(lambda c: F.size(c) - pos(c))).alias("max_neg"),
        F.max(worst(lambda c: F.size(c))).alias("max_len"))
    kind = (
        F.when(F.col("has_xor"), "none").when(F.col("max_pos") <= 1, "horn").when(F.col("max_neg") <= 1, "antihorn")
        .when(F.col("max_len") <= 2, "2cnf").otherwise("none"))
    return per.select("tree_id", "leaf_id", "max_pos", "max_neg", "max_len", kind.alias("certificate"))


def backend_labels(steps: DataFrame) -> DataFrame:
    """Decision procedure, certified flag and reason per path."""
    fam = steps.groupBy("tree_id", "leaf_id").agg(
        F.bool_or(F.col("combine") == "xor").alias("has_xor"), F.bool_and(F.col("combine") == "xor").alias("all_xor"),
        F.bool_and(F.col("family") == "Horn").alias("all_horn"), F.bool_and(F.col("family") == "AntiHorn").alias("all_anti"),
        F.bool_or(F.col("combine") == "cnf").alias("has_cnf"))
    d = fam.join(certificate(steps), ["tree_id", "leaf_id"])
    c = F.col("certificate")
    backend = (
        F.when(F.col("all_xor"), AFFINE_BACKEND).when(F.col("all_horn"), HORN_BACKEND).when(F.col("all_anti"), ANTIHORN_BACKEND)
        .when(F.col("has_xor"), INTERVAL_BACKEND).when(c == "horn", HORN_BACKEND).when(c == "antihorn", ANTIHORN_BACKEND)
        .when(c == "2cnf", TWO_SAT_BACKEND).when(F.col("has_cnf"), CASE_SPLIT_BACKEND).otherwise(INTERVAL_BACKEND))
    reason = (
        F.when(F.col("all_xor"), "affine paths are auxiliary").when(F.col("has_xor"), "mixed affine path")
        .when(c == "none", "clauses are neither horn, antihorn nor 2cnf").otherwise(""))
    return d.select("tree_id", "leaf_id", c, backend.alias("backend"), (c != "none").alias("certified"), reason.alias("reason"))


def require_certified(labels: DataFrame) -> DataFrame:
    """Strict mode: refuse when any path has no certificate."""
    bad = labels.filter("not certified").groupBy("reason").count().collect()
    if bad:
        raise ValueError("uncertified paths: " + ", ".join(f"{r['reason']} ({r['count']})" for r in bad))
    return labels


def xor_guard(steps: DataFrame) -> DataFrame:
    """XOR paths need one threshold per feature; counts of both per (path, feature)."""
    atoms = steps.filter(F.col("combine") == "xor").select("tree_id", "leaf_id", F.inline("lits"))
    return atoms.groupBy("tree_id", "leaf_id", "feature").agg(
        F.count_distinct(threshold_key(F.col("threshold"))).alias("n_thresholds")).withColumn("single", F.col("n_thresholds") == 1)


def family_audit(nodes: DataFrame, keys: list[str], expected: str) -> DataFrame:
    """Splits per family and whether the family is the expected one."""
    return nodes.groupBy(*keys, "family").agg(F.count(F.lit(1)).alias("n_splits")).withColumn("as_expected", F.col("family") == expected)
