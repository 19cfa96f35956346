"""Diagram graphs: connectors joined to the boxes they touch, directions, groups, and agreement with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut

#: Fixed value: farthest distance of a connector's end from the box it belongs to.
REACH = 0.08


def box_distance(px: Column, py: Column) -> Column:
    """Distance of a point from the box x, y, w, h; 0 inside."""
    dx = F.greatest(F.col("x") - px, px - F.col("x") - F.col("w"), F.lit(0.0))
    dy = F.greatest(F.col("y") - py, py - F.col("y") - F.col("h"), F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def endpoints(connectors: DataFrame, boxes: DataFrame) -> DataFrame:
    """(deck_id, slide_number, connector_id, side, node_id, how): the box of each connector end.

    An end that names a native id of just one box belongs to it: 'named' if it
    lies within REACH of it or nowhere, else 'far'. Any other end belongs to the
    nearest box within REACH ('near'), ties to the lower drawing order; else
    node_id is null ('open'). connectors: from_id, to_id, x0, y0, x1, y1.
    """
    key = ["deck_id", "slide_number"]
    ends = connectors.select(*key, F.col("object_id").alias("connector_id"), F.explode(F.array(
        F.struct(F.lit("from").alias("side"), F.col("from_id").alias("native_id"), F.col("x0").alias("px"), F.col("y0").alias("py")), F.struct(F.lit("to").alias("side"), F.col("to_id").alias("native_id"), F.col("x1").alias("px"), F.col("y1").alias("py")),
    )).alias("e")).select(*key, "connector_id", "e.*")
    named = boxes.where("native_id is not null").groupBy(*key, "native_id").agg(F.count("*").alias("n"), F.min("object_id").alias("named"), *[F.min(c).alias(c) for c in "xywh"]).where("n = 1").drop("n")
    off = box_distance(F.col("px"), F.col("py"))
    ends = ends.join(named, [*key, "native_id"], "left").withColumn("far", F.coalesce(off > REACH, F.lit(False))).drop("x", "y", "w", "h")
    near = ends.where("named is null").join(boxes.select(*key, "object_id", "z_order", "x", "y", "w", "h"), key).withColumn("d", box_distance(F.col("px"), F.col("py"))).where(F.col("d") <= REACH)
    near = near.groupBy(*key, "connector_id", "side").agg(F.min_by("object_id", F.struct("d", "z_order", "object_id")).alias("nearest"))
    j = ends.join(near, [*key, "connector_id", "side"], "left")
    how = F.when(F.col("named").isNotNull(), F.when(F.col("far"), "far").otherwise("named")).when(F.col("nearest").isNotNull(), "near").otherwise("open")
    return j.select(*key, "connector_id", "side", F.coalesce("named", "nearest").alias("node_id"), how.alias("how"))


def graph_edges(connectors: DataFrame, boxes: DataFrame) -> DataFrame:
    """(deck_id, slide_number, connector_id, source, target, status): verified if both ends are named and differ, partial if both are known, else unverified.

    The arrow head tells the direction: one at the start only turns the edge round.
    """
    key = ["deck_id", "slide_number", "connector_id"]
    e = endpoints(connectors, boxes).groupBy(*key).pivot("side", ["from", "to"]).agg(F.first("node_id").alias("node"), F.first("how").alias("how"))
    heads = connectors.select("deck_id", "slide_number", F.col("object_id").alias("connector_id"), (F.coalesce("head", F.lit("none")) != "none").alias("at_start"), (F.coalesce("tail", F.lit("none")) != "none").alias("at_end"))
    e = e.join(heads, key)
    turn = F.col("at_start") & ~F.col("at_end")
    known = F.col("from_node").isNotNull() & F.col("to_node").isNotNull() & (F.col("from_node") != F.col("to_node"))
    status = F.when(known & (F.col("from_how") == "named") & (F.col("to_how") == "named"), "verified").when(known, "partial").otherwise("unverified")
    return e.select(*key, F.when(turn, F.col("to_node")).otherwise(F.col("from_node")).alias("source"), F.when(turn, F.col("from_node")).otherwise(F.col("to_node")).alias("target"), status.alias("status"))


def flow_direction(edges: DataFrame, boxes: DataFrame) -> DataFrame:
    """(deck_id, slide_number, direction, n_edges): the direction of most verified edges by their longer axis; unknown on a tie."""
    key = ["deck_id", "slide_number"]
    at = lambda n: boxes.select(*key, F.col("object_id").alias(n), (F.col("x") + F.col("w") / 2).alias(f"{n}_x"), (F.col("y") + F.col("h") / 2).alias(f"{n}_y"))
    d = edges.where("status = 'verified'").join(at("source"), [*key, "source"]).join(at("target"), [*key, "target"])
    dx, dy = F.col("target_x") - F.col("source_x"), F.col("target_y") - F.col("source_y")
    way = F.when(F.abs(dx) >= F.abs(dy), F.when(dx >= 0, "left_to_right").otherwise("right_to_left")).otherwise(F.when(dy >= 0, "top_to_bottom").otherwise("bottom_to_top"))
    n = d.groupBy(*key, way.alias("way")).agg(F.count("*").alias("n"))
    top = n.groupBy(*key).agg(F.max("n").alias("m"), F.sum("n").alias("n_edges"))
    best = n.join(top, key).where("n = m").groupBy(*key).agg(F.count("*").alias("ties"), F.min("way").alias("way"), F.max("n_edges").alias("n_edges"))
    return best.select(*key, F.when(F.col("ties") == 1, F.col("way")).otherwise("unknown").alias("direction"), "n_edges")


def group_paths(objects: DataFrame) -> DataFrame:
    """(deck_id, object_id, path): the groups around each object, outermost first; other parents aren't listed, and a cycle of parents ends the path.

    One join a level, only of objects whose path still grows; a path never holds
    an object twice, so the levels end by themselves.
    """
    key = "deck_id"
    parents = objects.select(key, F.col("object_id").alias("up"), F.col("parent_id").alias("next"), (F.coalesce("type", F.lit("")) == "group").alias("grouped"))
    none = F.array().cast("array<string>")
    live = cut(objects.select(key, "object_id", F.col("parent_id").alias("up"), none.alias("seen"), none.alias("path")))
    done = live.where("up is null").select(key, "object_id", "path")
    live = live.where("up is not null")
    while live.take(1):
        step = live.join(parents, [key, "up"], "left")
        path = F.when(F.coalesce("grouped", F.lit(False)), F.concat(F.array("up"), "path")).otherwise(F.col("path"))
        seen = F.concat(F.array("up"), "seen")
        step = cut(step.select(key, "object_id", F.when(~F.array_contains(seen, F.col("next")), F.col("next")).alias("up"), seen.alias("seen"), path.alias("path")))
        done = done.unionByName(step.where("up is null").select(key, "object_id", "path"))
        live = step.where("up is not null")
    return done


def node_matches(reference: DataFrame, hypothesis: DataFrame, keys: list[str], least_iou: float = 0.5) -> DataFrame:
    """(keys, reference_id, hypothesis_id, how): equal ids first, then equal labels, then boxes by falling overlap; each node once.

    The last pass depends on its order, so each diagram's nodes are matched in one task; a diagram is small.
    """
    n = [*keys, "node_id", "label", "x", "y", "w", "h"]
    both = reference.select(*n).withColumn("side", F.lit(0)).unionByName(hypothesis.select(*n).withColumn("side", F.lit(1)))
    schema = T.StructType([reference.schema[k] for k in keys] + [T.StructField(c, T.StringType()) for c in ("reference_id", "hypothesis_id", "how")])

    def match(pdf):
        import pandas as pd

        a, b = ([r for r in pdf[pdf.side == s].sort_values("node_id").to_dict("records")] for s in (0, 1))
        out, used = [], set()
        first = tuple(pdf[k].iloc[0] for k in keys)

        def take(r, q, how):
            used.update(((0, r["node_id"]), (1, q["node_id"])))
            out.append((*first, r["node_id"], q["node_id"], how))

        def free(s, r):
            return (s, r["node_id"]) not in used

        for how, test in (("id", lambda r, q: r["node_id"] == q["node_id"]), ("label", lambda r, q: bool(r["label"]) and bool(q["label"]) and " ".join(r["label"].lower().split()) == " ".join(q["label"].lower().split()))):
            for r in a:
                q = next((q for q in b if free(1, q) and test(r, q)), None) if free(0, r) else None
                if q:
                    take(r, q, how)
        pairs = [(iou(r, q), i, j) for i, r in enumerate(a) for j, q in enumerate(b) if free(0, r) and free(1, q)]
        for v, i, j in sorted(pairs, key=lambda x: (-x[0], x[1], x[2])):
            if v >= least_iou and free(0, a[i]) and free(1, b[j]):
                take(a[i], b[j], "box")
        return pd.DataFrame(out, columns=schema.names)

    return both.groupBy(*keys).applyInPandas(match, schema)


def iou(r: dict, q: dict) -> float:
    """Overlap of two boxes over their union; equal boxes without area count as 1."""
    w = min(r["x"] + r["w"], q["x"] + q["w"]) - max(r["x"], q["x"])
    h = min(r["y"] + r["h"], q["y"] + q["h"]) - max(r["y"], q["y"])
    i = max(0.0, w) * max(0.0, h)
    u = r["w"] * r["h"] + q["w"] * q["h"] - i
    return i / u if u > 0 else float(all(r[k] == q[k] for k in "xywh"))
