"""Circular groups as sparse matrices: entries (component, holder, held, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import cut, placed, some


def groups(strong: DataFrame) -> DataFrame:
    """id (1 for the largest; of equal ones the smallest member decides), component, size of strong(node, component)."""
    sized = strong.groupBy("component").agg(F.count("*").alias("size"))
    return placed(sized, F.desc("size"), F.col("component")).select(F.col("place").alias("id"), "component", "size")


def group_matrix(edges: DataFrame, strong: DataFrame, target: str | None = None) -> DataFrame:
    """The edges inside each group; what a target holds is left out (its row is zero), as nothing passes through it."""
    strong = cut(strong.select("node", "component"))
    inner = edges.join(strong.toDF("holder", "component"), "holder").join(strong.toDF("held", "component"), ["held", "component"])
    inner = inner if target is None else inner.filter(F.col("holder") != target)
    return inner.select("component", "holder", "held", "stake")


def walk_sum(entries: DataFrame, least: float = 1e-15, limit: int = 10_000) -> DataFrame:
    """component, holder, held, total: I + A + A A + ... of each group's matrix, until no entry of a term reaches `least`.

    A term is one join of the term before with the entries. Groups whose terms don't fade raise ArithmeticError.
    """
    entries = cut(entries.select("component", "holder", "held", "stake"))
    step = entries.select("component", F.col("holder").alias("held"), F.col("held").alias("to"), "stake")
    nodes = entries.select("component", "holder").union(entries.select("component", "held")).distinct()
    term = cut(nodes.select("component", "holder", F.col("holder").alias("held"), F.lit(1.0).alias("x")))
    terms = [term]
    for _ in range(limit):
        term = term.join(step, ["component", "held"]).groupBy("component", "holder", F.col("to").alias("held")).agg(F.sum(F.col("x") * F.col("stake")).alias("x"))
        term = cut(term.filter(F.col("x") >= least))
        if not some(term):
            return reduce(DataFrame.unionByName, terms).groupBy("component", "holder", "held").agg(F.sum("x").alias("total"))
        terms.append(term)
    raise ArithmeticError(f"the walk sum has not converged after {limit} terms")
