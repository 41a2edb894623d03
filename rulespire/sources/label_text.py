"""Label-first integer text files: one row per line, first number is the label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_label_text(spark: SparkSession, path: str, suffix: str = "*.dl8", check: bool = True) -> DataFrame:
    """task, line, y, x array<double> from every matching file below ``path``.

    Blank lines and lines starting with # are skipped. Ragged rows, non-integers and
    rows without a feature are errors, reported with their file.
    """
    raw = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", suffix).text(path)
        .select(F.col("_metadata.file_name").alias("file"), F.trim("value").alias("line"))
    )
    rows = raw.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    words = F.split("line", "\\s+")
    nums = F.transform(words, lambda w: w.try_cast("int"))
    parsed = rows.select(F.regexp_replace("file", "\\.[^.]*$", "").alias("task"), "line", nums.alias("v"))
    if check:
        _require_clean(parsed)
    return parsed.select("task", "line", F.get("v", F.lit(0)).alias("y"),
                         F.transform(F.slice("v", 2, F.size("v") - 1), lambda c: c.cast("double")).alias("x"))


def _require_clean(parsed: DataFrame) -> None:
    per_file = parsed.groupBy("task").agg(
        F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most"),
        F.min_by("line", F.size("v")).alias("shortest"),
        F.count_if(F.exists("v", lambda e: e.isNull())).alias("bad"),
        F.min(F.when(F.exists("v", lambda e: e.isNull()), F.col("line"))).alias("bad_line"))
    if per_file.limit(1).count() == 0:
        raise FileNotFoundError("no label text files with rows found")
    wrong = per_file.filter((F.col("least") != F.col("most")) | (F.col("least") < 2) | (F.col("bad") > 0)).limit(5).collect()
    if wrong:
        r = wrong[0]
        why = "non-integer value" if r["bad"] else "needs a label and a feature" if r["least"] == r["most"] else "rows of different width"
        raise ValueError(f"{r['task']}: {why}: {(r['bad_line'] or r['shortest'])[:80]!r}")


def discover(spark: SparkSession, path: str, suffix: str = "*.dl8") -> list[str]:
    """Task names (file stems) below a folder, sorted; message when there is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(path).select("path")
    names = sorted(r[0] for r in files.select(F.regexp_extract("path", "([^/]+)\\.[^./]*$", 1)).collect())
    if not names:
        raise FileNotFoundError(f"no files match {suffix} below {path}")
    return names


def restrict(df: DataFrame, names: list[str] | None = None, first: int | None = None, max_width: int | None = None, width: str = "n_features") -> DataFrame:
    """Keep tasks by name, the first ones by name order, or up to a width."""
    out = df
    if names:
        out = out.filter(F.col("task").isin(names))
    if max_width is not None:
        out = out.filter(F.col(width) <= max_width)
    if first is not None:
        keep = out.select("task").distinct().orderBy("task").limit(first)
        out = out.join(keep, "task", "left_semi")
    return out


def widen(df: DataFrame, width: int, prefix: str = "x") -> tuple[DataFrame, list[str]]:
    """x array -> one named double column per feature."""
    names = [f"{prefix}{i}" for i in range(width)]
    return df.select(*[c for c in df.columns if c != "x"], *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(names)]), names
