"""Connected components of a graph given by edges: minimum-edge contraction, round by round, in the shared folder.

Every vertex picks its least edge (by a hash of the edge, so that trees stay shallow), jumps along the picks to the root
and is contracted. The picked edges are a spanning forest. Rounds are logarithmic in the number of vertices, and jumps
in the depth of a tree. A vertex with very many edges is aggregated before the shuffle; only counts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import written


def contract(edges: DataFrame, max_rounds: int = 64) -> tuple[DataFrame, DataFrame | None]:
    """(label, root) of every vertex that has an edge, and the spanning forest (u, v, round).

    edges: u < v, strings, distinct; and, where an edge stands for another, the ends of that: ou, ov. The forest names
    those. No edges give an empty mapping and no forest.
    """
    if "ou" not in edges.columns:
        edges = edges.select("u", "v", F.col("u").alias("ou"), F.col("v").alias("ov"))
    edges = written(edges.select("u", "v", "ou", "ov"), "edges")
    comp = forest = None
    for turn in range(max_rounds):
        if edges.isEmpty():
            break
        least = F.struct(F.xxhash64("u", "v").alias("w"), "u", "v", "ou", "ov").alias("e")
        both = edges.select(F.col("u").alias("x"), least).unionByName(edges.select(F.col("v").alias("x"), least))
        picks = both.groupBy("x").agg(F.min("e").alias("e")).select("x", "e.u", "e.v", "e.ou", "e.ov", F.when(F.col("x") == F.col("e.u"), F.col("e.v")).otherwise(F.col("e.u")).alias("p"))
        picks = written(picks, "picks")
        grown = picks.select(F.col("ou").alias("u"), F.col("ov").alias("v"), F.lit(turn).alias("round")).distinct()
        forest = grown if forest is None else forest.unionByName(grown)
        # two vertices that picked the same edge: the smaller is the root
        up = picks.alias("a").join(picks.alias("b"), F.col("a.p") == F.col("b.x"))
        root = (F.col("b.p") == F.col("a.x")) & (F.col("a.x") < F.col("a.p"))
        parents = written(up.select(F.col("a.x").alias("x"), F.when(root, F.col("a.x")).otherwise(F.col("a.p")).alias("p")), "parents")
        while True:
            jump = parents.alias("a").join(parents.alias("b"), F.col("a.p") == F.col("b.x"))
            jump = written(jump.select("a.x", F.col("b.p").alias("p"), (F.col("a.p") != F.col("b.p")).alias("moved")), "parents")
            parents = jump.select("x", "p")
            if jump.where("moved").isEmpty():
                break
        if comp is None:
            comp = parents.select(F.col("x").alias("label"), F.col("p").alias("root"))
        else:
            comp = written(comp.join(parents, comp["root"] == parents["x"], "left").select("label", F.coalesce("p", "root").alias("root")), "components")
        ends = edges.join(parents.select(F.col("x").alias("u"), F.col("p").alias("pu")), "u").join(parents.select(F.col("x").alias("v"), F.col("p").alias("pv")), "v")
        ends = ends.where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"), F.struct("ou", "ov").alias("o"))
        edges = written(ends.groupBy("u", "v").agg(F.min("o").alias("o")).select("u", "v", "o.ou", "o.ov"), "edges")
    else:
        raise RuntimeError("the contraction didn't end")
    if comp is None:
        comp = edges.select(F.col("u").alias("label"), F.col("v").alias("root"))
    return comp, forest
