"""Connected components with the smallest node id as the label.

Alternating star contraction on an edge table: every round rewires each node's
larger neighbours to the smallest node it has seen (large star), then its
smaller ones (small star). The number of rounds is logarithmic in the component
diameter; rounds are tables in the shared folder, so nothing is collected and a
lost executor repeats one round only. Neighbourhood minima are partial
aggregates, so a hub is combined before it is shuffled; they meet the edges on
an image of the node, which gives both sides an exchange of their own, so that
a hub's edges are split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.runtime import discard, materialize, materialize_counted, redeal


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. edges(u, v); returns distinct (u, v) with v the centre."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"), redeal(F.col("u")).alias("kk"))
    joined = near.join(low.drop("k"), redeal(F.col("u")) == F.col("kk"))
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def component_labels(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, comp) for every node that has an edge to another node.

    Self loops and null ends are ignored; parallel edges and both directions are
    harmless; no edges give no rows. ``comp`` is the component's smallest id.
    """
    ends = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    state = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    cur, last = materialize_counted(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc", state=state)
    for _ in range(max_rounds if last["rows"] else 0):
        nxt, now = materialize_counted(_star(_star(cur, True), False), "cc", state=state)
        discard(cur)
        cur = nxt
        if now == last:
            break
        last = now
    else:
        if last["rows"]:
            raise RuntimeError("components did not settle")
    roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots)


def connected_components(graph, edges: DataFrame | None = None) -> DataFrame:
    """(node, comp) of all nodes of the undirected view; an isolated node is its own component."""
    found = component_labels(edges if edges is not None else graph.edges).select(F.col("node").alias("n"), "comp")
    return graph.nodes.join(found, F.col("node") == F.col("n"), "left").select("node", F.coalesce("comp", "node").alias("comp"))


def labels_as_edges(labels: DataFrame) -> DataFrame:
    """A labelling as edges to the labels: merging labellings is hooking them."""
    return labels.where("node <> comp").select(F.col("node").alias("src"), F.col("comp").alias("dst"))


def merge_components(graph, labels: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Labels after late edges: old labels enter as edges beside the new ones."""
    return connected_components(graph, labels_as_edges(labels).unionByName(new_edges.select("src", "dst")))


def hook(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """One hooking step: each label takes the smallest label across an edge (only ever downwards)."""
    lab = labels.select(F.col("node").alias("n"), F.col("comp").alias("c"))
    both = edges.select("src", "dst").union(edges.select("dst", "src"))
    seen = both.join(lab, F.col("dst") == F.col("n")).groupBy("src").agg(F.min("c").alias("low"))
    return labels.join(seen, F.col("node") == F.col("src"), "left").select("node", F.least("comp", F.coalesce("low", "comp")).alias("comp"))


def jump(labels: DataFrame) -> DataFrame:
    """One pointer jump: every label becomes its label's label."""
    up = labels.select(F.col("node").alias("n"), F.col("comp").alias("c"))
    return labels.join(up, F.col("comp") == F.col("n")).select("node", F.col("c").alias("comp"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))


def component_count(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count_if(F.col("node") == F.col("comp")).alias("components"))


def star_violations(labels: DataFrame) -> DataFrame:
    """One row: labels that are not their own label (deep), and labels above their node (upward)."""
    up = labels.select(F.col("node").alias("n"), F.col("comp").alias("c"))
    return labels.join(up, F.col("comp") == F.col("n"), "left").agg(
        F.count_if(F.coalesce(F.col("c") != F.col("comp"), F.lit(True))).alias("deep"), F.count_if(F.col("comp") > F.col("node")).alias("upward")
    )
