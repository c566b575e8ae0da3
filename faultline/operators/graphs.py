"""Graphs of control flow: edges, components, masking probabilities, dominators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components

#: Kinds at which a flipped value survives with half the probability.
HALVING = ("branch", "min", "max")
#: Kinds after which nothing follows.
ENDS = ("exit", "ret")


def successors(df: DataFrame, pc: str, kind: str, target: str, step: int = 8) -> DataFrame:
    """(pc, next): fall through, branch target, or both for a conditional branch; none after exit."""
    after = F.col(pc) + step
    nexts = F.when(F.col(kind) == "exit", F.array().cast("array<long>")).when(F.col(kind) == "jump", F.array(F.col(target))).when(F.col(kind) == "branch", F.array(F.col(target), after)).otherwise(F.array(after))
    return df.select(pc, F.explode(nexts).alias("next"))


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the least node that each can reach, undirected; a node that only meets itself is its own root."""
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    roots = components(both)
    alone = both.where("a = b").select(F.col("a").alias("node")).distinct().join(roots, "node", "left_anti")
    return roots.unionByName(alone.select("node", F.col("node").alias("root")))


def masking_probability(edges: DataFrame, program: str, pc: str, succ: str, kind: str, steps: int = 16) -> DataFrame:
    """(program, pc, probability): survival along equally likely successors, halved at ``HALVING``.

    ``edges`` has a row per instruction and successor (null: none). Successors that are no
    instruction of the program count as none; an instruction without any, or of a kind in
    ``ENDS``, keeps its own factor. The recurrence runs steps - 1 times over the edges; one
    program's graph is in a task at once.
    """
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, at = np.unique(pdf[pc], return_inverse=True)
        to = np.searchsorted(nodes, pdf[succ].fillna(nodes[-1]))
        there = pdf[succ].notna().to_numpy() & (nodes[np.minimum(to, len(nodes) - 1)] == pdf[succ].to_numpy()) & ~pdf[kind].isin(ENDS).to_numpy()
        halves = np.zeros(len(nodes), bool)
        halves[at[pdf[kind].isin(HALVING).to_numpy()]] = True
        factor, at, to = np.where(halves, 0.5, 1.0), at[there], to[there]
        n, alive = np.bincount(at, minlength=len(nodes)), np.ones(len(nodes))
        for _ in range(max(steps - 1, 0)):
            alive = factor * np.where(n > 0, np.bincount(at, alive[to], len(nodes)) / np.maximum(n, 1), 1.0)
        return pd.DataFrame({program: pdf[program].iloc[0], pc: nodes, "probability": np.clip(alive, 0, 1)})

    return edges.select(program, pc, succ, kind).groupBy(program).applyInPandas(run, f"{program} {kinds[program]}, {pc} {kinds[pc]}, probability double")


def site_probability(probabilities: DataFrame, edges: DataFrame, keys: list[str], pc: str, succ: str) -> DataFrame:
    """Mean over a site's successors."""
    p = probabilities.withColumnRenamed(pc, "_at")
    return edges.join(p, [F.col(succ) == F.col("_at"), *[edges[k] == p[k] for k in keys]]).groupBy(*[edges[k] for k in keys], edges[pc]).agg(F.avg("probability").alias("site_probability"))


def dominators(edges: DataFrame, program: str, a: str, b: str, entry: str) -> DataFrame:
    """(program, node, dominator) of every node reachable from the entry; reversed edges give post-dominators."""
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        start = pdf[entry].iloc[0]
        after: dict = {}
        for x, y in zip(pdf[a], pdf[b], strict=True):
            after.setdefault(x, set()).add(y)
        seen, stack = {start}, [start]
        while stack:
            for y in after.get(stack.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
        before: dict = {n: {x for x in seen if n in after.get(x, ())} for n in seen}
        dom = {n: set(seen) for n in seen} | {start: {start}}
        changed = True
        while changed:
            changed = False
            for n in seen - {start}:
                now = {n} | set.intersection(*(dom[x] for x in before[n]))
                if now != dom[n]:
                    dom[n], changed = now, True
        rows = [(pdf[program].iloc[0], n, d) for n in sorted(seen) for d in sorted(dom[n])]
        return pd.DataFrame(rows, columns=[program, "node", "dominator"])

    return edges.groupBy(program).applyInPandas(run, f"{program} {kinds[program]}, node {kinds[a]}, dominator {kinds[a]}")
