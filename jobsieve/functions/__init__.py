"""Column-expression helpers (JVM-side, codegen friendly; no Python UDFs)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_where(df: DataFrame, cond: Column, name: str = "_keep") -> DataFrame:
    """``df.where(cond)`` evaluated *after* ``cond``'s inputs are projected.

    Catalyst pushes an ordinary filter below the projections that define its columns, inlining
    them into the condition; for a large computed column (taxonomy matches, relevance folds)
    that duplicates the work and bloats the plan. A generator is a barrier: the condition is
    evaluated once in the projection and the filter stays above it."""
    return df.select("*", F.explode_outer(F.when(cond, F.array(F.lit(True)))).alias(name)) \
        .where(F.col(name).isNotNull()).drop(name)
