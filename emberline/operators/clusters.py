"""Connected groups of detections ("within eps metres of some member") and their statistics.

The reference semantics is a graph over detections.  The detection graph is
never built: detections of one small grid cell (diagonal below eps) are mutually
linked by construction, so cells are the vertices and a cell has at most a few
dozen neighbours.  Vertices, edges and iterations therefore grow with the
occupied area, not with the number of detections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.geo import arc_degrees, haversine, with_cell, with_cells_in_reach
from emberline.operators.neighbours import _boxes, box_distance_bounds
from emberline.operators.proximity import LAT, LON
from emberline.session import cut

NODE = ["cy", "cx", "py", "px"]
_FINE = 16


def _with_node(df: DataFrame, eps_m: float) -> DataFrame:
    """Cell of the detection; next to a pole, where cells stretch, the exact spot stands in."""
    out = with_cell(df, LAT, LON, arc_degrees(eps_m / 1.5))
    polar = F.abs(F.col(LAT)) > 89.9
    return (out.withColumn("py", F.when(polar, F.col(LAT)).otherwise(F.lit(0.0)))
            .withColumn("px", F.when(polar, F.col(LON)).otherwise(F.lit(0.0))))


def _box_pairs(boxes: DataFrame, id_col: str, reach_m: float, eps_m: float) -> DataFrame:
    """Box pairs (a < b) that may hold linked points, with the distance bounds ``_lo``/``_hi``."""
    step = arc_degrees(reach_m)
    middle = boxes.withColumn("m_lat", (F.col("s") + F.col("n")) / 2).withColumn("m_lon", (F.col("w") + F.col("e")) / 2)
    a = with_cell(middle, "m_lat", "m_lon", step, "ry", "rx").select(
        "ry", "rx", F.col(id_col).alias("a"), *[F.col(k).alias(f"a_{k}") for k in "snwe"])
    b = with_cells_in_reach(middle, "m_lat", "m_lon", step, step, "ry", "rx").select(
        "ry", "rx", F.col(id_col).alias("b"), *[F.col(k).alias(f"b_{k}") for k in "snwe"])
    low, high = box_distance_bounds()
    return (a.join(b, ["ry", "rx"]).filter("a < b").withColumn("_lo", low).filter(F.col("_lo") <= eps_m)
            .withColumn("_hi", high).select("a", "b", "_lo", "_hi"))


def node_links(members: DataFrame, nodes: DataFrame, eps_m: float) -> DataFrame:
    """Distinct linked vertex pairs (a < b); ``members`` holds (node, latitude, longitude)."""
    pairs = cut(_box_pairs(nodes, "node", 2.2 * eps_m, eps_m).select("a", "b", (F.col("_hi") <= eps_m).alias("sure")))
    sure, undecided = pairs.filter("sure").select("a", "b"), pairs.filter("not sure").select("a", "b")

    # Undecided: compare the extents of sub-cells (a bounded number per vertex).
    fine = with_cell(members, LAT, LON, arc_degrees(eps_m / 1.5) / _FINE, "fy", "fx")
    subs = _boxes(fine, ["node", "fy", "fx"], LAT, LON, "")
    low, high = box_distance_bounds()

    def side(name: str) -> DataFrame:
        return subs.select(F.col("node").alias(name), F.col("fy").alias(f"{name}_fy"), F.col("fx").alias(f"{name}_fx"),
                           *[F.col(k).alias(f"{name}_{k}") for k in "snwe"])

    def tested(which: DataFrame) -> DataFrame:
        return (which.join(side("a"), "a").join(side("b"), "b").withColumn("_lo", low)
                .filter(F.col("_lo") <= eps_m).withColumn("_hi", high))

    near = cut(tested(undecided).groupBy("a", "b").agg(F.min("_hi").alias("_hi")))
    by_extent = near.filter(F.col("_hi") <= eps_m).select("a", "b")

    # Still undecided: the points of sub-cells that straddle the limit.
    rim = tested(near.filter(F.col("_hi") > eps_m).select("a", "b")).select("a", "b", "a_fy", "a_fx", "b_fy", "b_fx")

    def points(name: str) -> DataFrame:
        return fine.select(F.col("node").alias(name), F.col("fy").alias(f"{name}_fy"), F.col("fx").alias(f"{name}_fx"),
                           F.col(LAT).alias(f"{name}_lat"), F.col(LON).alias(f"{name}_lon"))

    by_point = (rim.join(points("a"), ["a", "a_fy", "a_fx"]).join(points("b"), ["b", "b_fy", "b_fx"])
                .filter(haversine("a_lat", "a_lon", "b_lat", "b_lon") <= eps_m).select("a", "b").distinct())
    return sure.unionByName(by_extent).unionByName(by_point)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every vertex with a link; component = smallest vertex id.

    Min-label propagation with pointer jumping.  Each round is cut with a
    reliable checkpoint; the number of rounds follows the logarithm of the
    largest component's diameter.
    """
    both = cut(links.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                             F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))))
    labels = cut(both.groupBy("u").agg(F.min("v").alias("_m"))
                 .select(F.col("u").alias("node"), F.least("u", "_m").alias("label")))
    while True:
        heard = (both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("_m")))
        lowered = (labels.join(heard, F.col("node") == F.col("u"))
                   .select("node", F.col("label").alias("_old"), F.least("label", "_m").alias("_new")))
        parent = labels.select(F.col("node").alias("_p"), F.col("label").alias("_pl"))
        # The parent's label of the previous round can only be lower or equal: a safe jump.
        moved = cut(lowered.join(parent, F.col("_new") == F.col("_p"), "left")
                    .select("node", "_old", F.least("_new", F.coalesce("_pl", "_new")).alias("label")))
        labels = moved.select("node", "label")
        if moved.filter("label <> _old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))


def assign_clusters(events: DataFrame, eps_m: float, id_col: str = "event_id") -> DataFrame:
    """Add ``cluster_id``: the smallest id of the detections linked to the row through steps of at most eps.

    Rows without a position are kept, with a NULL cluster.
    """
    located = _with_node(events, eps_m)
    spots = cut(located.groupBy(*NODE, LAT, LON).agg(F.min(id_col).alias("_id")))
    boxes = (spots.groupBy(*NODE).agg(F.min("_id").alias("node"), F.min(LAT).alias("s"), F.max(LAT).alias("n"),
                                      F.min(LON).alias("w"), F.max(LON).alias("e")))
    boxes = cut(boxes)
    members = spots.join(boxes.select(*NODE, "node"), NODE).select("node", LAT, LON)
    roots = components(node_links(members, boxes.drop(*NODE), eps_m))
    ids = boxes.select(*NODE, "node").join(roots, "node", "left").select(
        *NODE, F.coalesce("component", "node").alias("cluster_id"))
    return located.join(ids, NODE, "left").select(*events.columns, "cluster_id")


def eps_edges(events: DataFrame, eps_m: float, id_col: str = "event_id") -> DataFrame:
    """Linked pairs of distinct spots: lowest ids ``id1 < id2``, detections per spot and the distance.

    Detections at one spot are one vertex with a count, so copies add no pairs.
    """
    spots = events.groupBy(LAT, LON).agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("n"))
    step = arc_degrees(eps_m)
    a = with_cell(spots, LAT, LON, step).select("cy", "cx", F.col("id").alias("id1"), F.col("n").alias("n1"),
                                                F.col(LAT).alias("lat1"), F.col(LON).alias("lon1"))
    b = with_cells_in_reach(spots, LAT, LON, step, step).select(
        "cy", "cx", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col(LAT).alias("lat2"), F.col(LON).alias("lon2"))
    return (a.join(b, ["cy", "cx"]).filter((F.col("id1") < F.col("id2")) & (F.abs(F.col("lat1") - F.col("lat2")) <= step))
            .withColumn("distance_m", haversine("lat1", "lon1", "lat2", "lon2")).filter(F.col("distance_m") <= eps_m)
            .select("id1", "id2", "n1", "n2", "distance_m"))


def cluster_stats(clustered: DataFrame) -> DataFrame:
    """Per cluster: size, centroid, FRP mean/max, distinct dates, whole days of span, detections per satellite."""
    per_sat = (clustered.groupBy("cluster_id", "satellite").agg(F.count(F.lit(1)).alias("k"))
               .groupBy("cluster_id")
               .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("satellite", "k")))).alias("satellites")))
    seconds = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(1e6)
    base = clustered.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"), F.avg(LAT).alias("centroid_lat"), F.avg(LON).alias("centroid_lon"),
        F.avg("frp").alias("frp_mean"), F.max("frp").alias("frp_max"),
        F.countDistinct(F.to_date("ts")).alias("distinct_dates"),
        F.floor(seconds / 86400).cast("long").alias("span_days"), F.min("ts").alias("first_ts"))
    base = base.withColumn("date_span_days", F.col("span_days") + 1)
    return base.join(per_sat, "cluster_id")


def join_cluster_stats(clustered: DataFrame, stats: DataFrame) -> DataFrame:
    """Cluster size, distinct dates and span onto the members."""
    return clustered.join(stats.select("cluster_id", F.col("size").alias("cluster_size_500"),
                                       "distinct_dates", "span_days"), "cluster_id", "left")


def cluster_summary(stats: DataFrame, min_size: int = 3) -> DataFrame:
    """Long form: hotspot clusters, noise points, groups, and the size distribution of the clusters."""
    big = F.col("size") >= min_size
    totals = stats.agg(
        F.count_if(big).alias("clusters"), F.coalesce(F.sum(F.when(~big, F.col("size"))), F.lit(0)).alias("noise_points"),
        F.count(F.lit(1)).alias("spatial_groups"))
    flat = totals.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(0).cast("long").alias("size"), F.col(m).cast("long").alias("value"))
        for m in ("clusters", "noise_points", "spatial_groups")])).alias("r")).select("r.*")
    sizes = stats.filter(big).groupBy("size").agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("size").alias("metric"), "size", "value")
    return flat.unionByName(sizes)


def persistence_summary(stats: DataFrame) -> DataFrame:
    """How long places stay active (one row)."""
    return stats.agg(
        F.count(F.lit(1)).alias("spatial_clusters"), F.count_if(F.col("size") == 1).alias("isolated"),
        F.count_if(F.col("size") >= 2).alias("repeated"), F.count_if(F.col("distinct_dates") >= 2).alias("multi_day"),
        F.count_if(F.col("span_days") >= 7).alias("multi_week"),
        F.count_if((F.col("size") >= 5) | (F.col("distinct_dates") >= 3)).alias("high_persistence"))


def top_clusters(stats: DataFrame, by: str, k: int) -> DataFrame:
    """The k largest (``by='size'``) or longest-lived (``by='span_days'``) clusters."""
    return stats.orderBy(F.desc(by), F.asc("cluster_id")).limit(k)
