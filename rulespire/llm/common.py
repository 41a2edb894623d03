"""Column helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from rulespire.session import cut_lineage, ship_package

#: White space between words: the space and the control characters 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names derived from ``names`` that no column of ``df`` has, whatever its letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def document_hash(seed: str, doc_id: Column, text: Column) -> Column:
    """60 bits of md5 over (seed, doc_id, text) as a long from 0 to 2**60 - 1; null and empty differ."""
    said = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("~")), F.when(text.isNull(), F.lit("~")).otherwise(F.lit("|")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def document_hash_sql(seed: str, doc_id: str = "doc_id", text: str = "text") -> str:
    return (f"('0x' || substr(md5('{seed}|' || coalesce({doc_id}::VARCHAR, '~') || CASE WHEN {text} IS NULL THEN '~' ELSE '|' END"
            f" || coalesce({text}, '')), 1, 15))::BIGINT")


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of ASCII text in DuckDB, bit by bit."""
    bit = "lambda d, x: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END"
    byte = f"lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {bit})"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda a: ascii(a)::BIGINT)), {byte}), 4294967295)"


#: Rows that are broadcast; longer tables are joined by a shuffle.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """``df``, written and counted, marked for broadcast if it has at most ``SMALL`` (narrow) rows."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= SMALL else df


def bound(value: Column, use: Callable) -> Column:
    """``use`` of a value that is computed once, though expressions inside refer to it again and again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)
