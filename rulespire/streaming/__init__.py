"""Scoring is a set of Column expressions, so it also runs on a streaming DataFrame.

There is no incremental learning here; fitted trees are applied to new rows as they
arrive with the same ``score_rows`` as in batch jobs.
"""

from rulespire.plans.model import score_rows

__all__ = ["score_rows"]
