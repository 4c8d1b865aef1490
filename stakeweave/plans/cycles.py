"""Back edges of a depth-first search, whose order matters: by component of the cyclic core."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .iterate import cut
from .network import least_labels, trimmed


def back_edges(edges: DataFrame) -> DataFrame:
    """holder, held, cycle array: edges to a node on the search's stack, roots by id, edges by (-stake, held).

    Edges outside the trimmed core lie on no cycle; the core's connected components are searched by themselves, each in
    one task. A core component is a group of cross-holdings, small beside the network.
    """
    core = trimmed(edges)
    parts = least_labels(core.toDF("a", "b"), core.select("holder").union(core.select("held")))
    rows = cut(core.join(edges.select("holder", "held", "stake"), ["holder", "held"]).join(parts.toDF("holder", "part"), "holder"))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        out_of: dict[str, list[str]] = {}
        for r in group.sort_values(["holder", "stake", "held"], ascending=[True, False, True]).itertuples():
            out_of.setdefault(r.holder, []).append(r.held)
        done, found = set(), []
        for root in sorted(set(group["holder"]) | set(group["held"])):
            if root in done:
                continue
            stack, place, left = [root], {root: 0}, [iter(out_of.get(root, ()))]
            while stack:
                to = next(left[-1], None)
                if to is None:
                    done.add(stack.pop())
                    place.popitem()
                    left.pop()
                elif to in place:
                    found.append((stack[-1], to, [*stack[place[to] :], to]))
                elif to not in done:
                    place[to] = len(stack)
                    stack.append(to)
                    left.append(iter(out_of.get(to, ())))
        return pd.DataFrame(found, columns=["holder", "held", "cycle"])

    return rows.groupBy("part").applyInPandas(search, "holder string, held string, cycle array<string>")


def example_cycles(edges: DataFrame, strong: DataFrame, most: int = 5) -> DataFrame:
    """component, place, cycle, loop_stake: of each circular group the `most` back edges' cycles with the largest product of stakes."""
    found = cut(back_edges(edges).withColumn("id", F.concat_ws("\u0001", "holder", "held")))
    steps = found.select("id", F.explode(F.sequence(F.lit(1), F.size("cycle") - 1)).alias("i"), "cycle").select("id", F.element_at("cycle", F.col("i")).alias("holder"), F.element_at("cycle", F.col("i") + 1).alias("held"))
    strength = steps.join(edges.select("holder", "held", "stake"), ["holder", "held"]).groupBy("id").agg(F.product("stake").alias("loop_stake"))
    rows = found.join(strength, "id").join(strong.select(F.col("node").alias("holder"), "component"), "holder")
    place = F.row_number().over(Window.partitionBy("component").orderBy(F.desc(F.round("loop_stake", 12)), F.concat_ws(">", "cycle")))
    return rows.withColumn("place", place).filter(F.col("place") <= most).select("component", "place", F.concat_ws(">", "cycle").alias("cycle"), "loop_stake")
