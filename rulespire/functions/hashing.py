"""Reproducible pseudo-random draws.

A draw is a pure function of (seed, purpose, row key), so it does not depend on
how rows are spread over partitions and a lost task redraws the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_RANGE = 4294967296.0


def unit_hash(*parts: Column | str | int) -> Column:
    """Uniform value in [0, 1) from the first 32 bits of an md5 digest."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("-", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(HASH_RANGE)


def unit_hash_sql(*parts: str) -> str:
    """The same draw as DuckDB text; parts are SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296.0)"


def poisson_weight(u: Column) -> Column:
    """Poisson(1) count by inverting its distribution function at ``u``."""
    out = F.lit(len(POISSON_CDF))
    for k in range(len(POISSON_CDF) - 1, -1, -1):
        out = F.when(u < POISSON_CDF[k], k).otherwise(out)
    return out


# Cumulative probabilities of Poisson(1) at 0..7.
POISSON_CDF = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975]
