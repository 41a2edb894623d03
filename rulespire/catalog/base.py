"""Registration and the pieces shared by the queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulespire.functions.hashing import unit_hash_sql
from rulespire.sources.tables import LINE_FEATURES, line_task, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where there is one, its SQL."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round results; + 0.0 turns a negative zero into zero."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in cols})


def longs(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


def rsql(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


# --- the line task in SQL ---------------------------------------------------------------

LINE_KEY_SQL = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
TRUTH_SQL = {
    "or2": "(l_quantity >= 30 OR l_discount < 0.03)",
    "and2": "(l_quantity >= 20 AND l_tax >= 0.03)",
    "xor2": "((l_quantity >= 25) <> (l_discount >= 0.05))",
    "cnf4": "((l_quantity >= 25 OR l_discount < 0.03) AND (l_tax >= 0.04 OR l_extendedprice < 50000))",
}


def line_cte(task: str = "or2", name: str = "s") -> str:
    """CTE with rk, y and the six features of lineitem."""
    if task == "returns":
        label = "l_returnflag = 'R'"
    else:
        label = f"CASE WHEN {unit_hash_sql('7', chr(39) + 'flip' + chr(39), LINE_KEY_SQL)} < 0.05 THEN NOT {TRUTH_SQL[task]} ELSE {TRUTH_SQL[task]} END"
    return f"""{name} AS (SELECT {LINE_KEY_SQL} AS rk, CAST({label} AS INT) AS y, l_quantity AS q, l_extendedprice AS p,
        l_discount AS d, l_tax AS t, l_linenumber::DOUBLE AS ln, (l_linestatus = 'F')::INT::DOUBLE AS ls,
        l_suppkey AS supp, l_returnflag AS rf FROM lineitem)"""


def line_rows(spark: SparkSession, sf: str, task: str = "or2") -> DataFrame:
    return line_task(spark, sf, task)


def line_wide(spark: SparkSession, sf: str, task: str = "or2") -> DataFrame:
    """The line task with supplier and return flag kept."""
    from rulespire.sources.tables import flipped, line_features, line_key, line_truth

    df = load(spark, sf, "lineitem")
    label = (F.col("l_returnflag") == "R") if task == "returns" else flipped(line_truth(task), line_key(), 0.05)
    return df.select(line_key().alias("rk"), label.cast("int").alias("y"), *[c.cast("double").alias(n) for n, c in line_features().items()],
                     F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("rf"))


# --- fixed cuts of four columns -----------------------------------------------------------

CUTS: dict[str, list[float]] = {
    "q": [10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0, 45.0, 50.0],
    "d": [0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.1],
    "t": [0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08],
    "p": [10000.0, 20000.0, 30000.0, 40000.0, 50000.0, 60000.0, 70000.0, 80000.0, 90000.0, 100000.0],
}
CUT_FEATURES = ["q", "d", "t", "p"]


def cut_bin(f: str, cuts: list[float] | None = None) -> Column:
    """Bin by fixed cuts as a codegen-friendly sum of tests."""
    total = F.lit(0)
    for c in cuts or CUTS[f]:
        total = total + (F.col(f) >= c).cast("int")
    return total


def cut_bin_sql(f: str, cuts: list[float] | None = None) -> str:
    return "(" + " + ".join(f"({f} >= {c!r}::DOUBLE)::INT" for c in cuts or CUTS[f]) + ")"


def cut_value(feature: Column, index: Column) -> Column:
    """Threshold of 0-based cut ``index`` of a feature name column."""
    out = F.lit(None).cast("double")
    for f, cuts in CUTS.items():
        out = F.when(feature == f, F.get(F.array(*[F.lit(c) for c in cuts]), index)).otherwise(out)
    return out


def cut_value_sql(feature: str, index: str) -> str:
    """Threshold of 1-based cut ``index``."""
    cases = " ".join(f"WHEN '{f}' THEN ({cuts!r}::DOUBLE[])[{index}]" for f, cuts in CUTS.items())
    return f"(CASE {feature} {cases} END)"


# --- scores in SQL ------------------------------------------------------------------------


def entropy_sql(p: str, n: str) -> str:
    return (f"(CASE WHEN ({p}) > 0 AND ({n}) > 0 THEN -(({p})/(({p})+({n})))*log2(({p})/(({p})+({n})))"
            f" -(({n})/(({p})+({n})))*log2(({n})/(({p})+({n}))) ELSE 0.0 END)")


def gain_sql(tp: str, tn: str, ip: str, ineg: str) -> str:
    """All arguments are DOUBLE columns."""
    inside, total = f"({ip}+{ineg})", f"({tp}+{tn})"
    return (f"(CASE WHEN {inside} <= 0 OR {total}-{inside} <= 0 THEN -1.0 ELSE greatest({entropy_sql(tp, tn)}"
            f" - {inside}/{total}*{entropy_sql(ip, ineg)} - ({total}-{inside})/{total}*{entropy_sql(f'{tp}-{ip}', f'{tn}-{ineg}')}, 0.0) END)")


def penalized_sql(gain: str, arity: str, n: str) -> str:
    left = f"({gain} - ({arity}+1.0)*ln(greatest({n}::DOUBLE, 2.0))/(2.0*{n}))"
    return f"(CASE WHEN {gain} <= 0 OR {n} <= 0 OR {left} <= 0 THEN -1.0 ELSE {left} END)"
