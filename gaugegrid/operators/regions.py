"""Groups of stations: official regions, core stations, assignments and their agreement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import PowerIterationClustering
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugegrid.functions.geo import with_xy
from gaugegrid.operators.inference import normal_tail
from gaugegrid.operators.ranks import average_ranks
from gaugegrid.settings import CLUSTER_TEST_BANDS
from gaugegrid.sources.session import stored


def read_regions(spark, path: str, name: str = "REGION_N") -> DataFrame:
    """Vertices (``region``, ``ring``, ``i``, ``x``, ``y``) of the outer rings of a GeoJSON feature collection.

    Polygon and MultiPolygon features are read as one JSON document per file.
    """
    point, ring = "array<double>", "array<array<double>>"
    doc = spark.read.option("multiLine", True).schema(
        f"features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
    ).json(path)
    f = doc.select(F.explode("features").alias("f")).select(
        F.regexp_replace(F.initcap(F.col("f.properties")[name]), " Region$", "").alias("region"), "f.geometry.type", F.col("f.geometry.coordinates").alias("c")
    )
    polygons = F.when(F.col("type") == "Polygon", F.array(F.from_json("c", f"array<{ring}>"))).otherwise(F.from_json("c", f"array<array<{ring}>>"))
    rings = f.select("region", F.posexplode(F.transform(polygons, lambda p: p[0])).alias("ring", "points"))
    return rings.select("region", "ring", F.posexplode("points").alias("i", "p")).select("region", "ring", "i", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def ring_edges(vertices: DataFrame) -> DataFrame:
    """Consecutive vertices of each ring as edges, the last joined to the first."""
    order = Window.partitionBy("region", "ring").orderBy("i")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return vertices.select(
        "region", "ring", F.col("x").alias("x1"), F.col("y").alias("y1"),
        F.coalesce(F.lead("x").over(order), F.first("x").over(whole)).alias("x2"),
        F.coalesce(F.lead("y").over(order), F.first("y").over(whole)).alias("y2"),
    )


def region_of(points: DataFrame, vertices: DataFrame, key: str = "station_id", lon: str = "location_longitude", lat: str = "location_latitude", band: float = 0.01) -> DataFrame:
    """Region that contains each point, else the region of the nearest vertex.

    A point is inside a ring if a ray to the east crosses an odd number of its edges. Edges and points meet by
    equality of latitude bands (``band`` degrees), so a point is compared with the edges at its own height only.
    """
    edges = ring_edges(vertices).where("y1 <> y2").withColumn(
        "strip", F.explode(F.sequence(F.floor(F.least("y1", "y2") / band), F.floor(F.greatest("y1", "y2") / band)))
    )
    x, y = F.col(lon), F.col(lat)
    spans = (F.col("y1") > y) != (F.col("y2") > y)
    crossing = F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    inside = (
        points.select(key, lon, lat, F.floor(y / band).alias("strip"))
        .join(edges, "strip")
        .where(spans & (x < crossing))
        .groupBy(key, "region", "ring")
        .agg(F.count("*").alias("crossings"))
        .where(F.col("crossings") % 2 == 1)
        .groupBy(key)
        .agg(F.min("region").alias("inside"))
    )
    return points.select(key).join(inside, key, "left").join(
        _nearest_region(points.join(inside, key, "left_anti"), vertices, key, lon, lat), key, "left"
    ).select(key, F.coalesce("inside", "nearest").alias("region"), F.col("inside").isNotNull().alias("is_inside"))


def _nearest_region(points: DataFrame, vertices: DataFrame, key: str, lon: str, lat: str) -> DataFrame:
    """(key, nearest): region of the nearest vertex. Points and vertices meet in square cells whose side grows fourfold per level; the answer
    is that of the first level at which the nearest one found is no farther than a side, so no nearer one can lie outside the cells around."""
    corners, x, y = vertices.select("x", "y", "region").distinct(), F.col(lon), F.col(lat)
    sides = [0.02 * 4**k for k in range(8)]  # the last side spans the globe
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    level = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(side).alias("side")) for k, side in enumerate(sides)])).alias("l")
    cells = corners.select("x", "y", "region", level).select("x", "y", "region", "l.*")
    cells = cells.withColumns({"cx": F.floor(F.col("x") / F.col("side")), "cy": F.floor(F.col("y") / F.col("side"))})
    asked = points.select(key, lon, lat, level).select(key, lon, lat, "l.*")
    asked = asked.withColumn("cx", F.explode(F.transform(near, lambda i: F.floor(x / F.col("side")) + i)))
    asked = asked.withColumn("cy", F.explode(F.transform(near, lambda i: F.floor(y / F.col("side")) + i)))
    d = F.hypot(F.col("x") - x, F.col("y") - y)
    found = asked.join(cells, ["level", "side", "cx", "cy"]).groupBy(key, "level", "side").agg(F.min(F.struct(d.alias("d"), "region")).alias("best"))
    sure = found.where(F.col("best.d") <= F.col("side"))
    return sure.groupBy(key).agg(F.min_by("best.region", "level").alias("nearest"))


def core_stations(pairs: DataFrame, stations: DataFrame, least_shared: int, by: str | None = None) -> DataFrame:
    """Stations left after repeatedly dropping the one with most pairs that share too few slots, the smallest id of equals.

    ``pairs`` (``i``, ``j``, ``n``) holds pairs that share some slot; a pair that is missing shares none. A station's short pairs are
    therefore all others that are left, less those it shares enough with, so only the latter are kept. With ``by``, a column of both
    tables, every group has its own answer and all groups are worked on together.

    The order of dropping is worked out in rounds of up to ``FRONT`` stations, those that come first at the round's start: they are dropped one by
    one from the pairs among themselves, and then every other station is checked against that order, step by step. A step before which
    some other station would have come first ends the round; all steps before it are those of the plain loop. So a round costs
    a few passes over the pairs, however many stations wait for each other, and no task holds more than the pairs of a front.
    """
    return core_rounds(pairs, stations, least_shared, by)[0]


#: Stations that a round of :func:`core_rounds` may drop, and stations that one task checks against them, on average.
FRONT = 1024
_ORDER = "step int, name string, good long, chain int"


def _front_order(names: np.ndarray, good: np.ndarray, partners: np.ndarray, left: int) -> list[tuple[int, str, int, int]]:
    """(step, name, good, chain) of the stations that go one after the other, the one with fewest good partners first, and of the one that would
    be next: its ``chain`` is 0, or -1 if nothing is short any more. ``partners`` are places of good pairs, ``left`` all stations of the group."""
    near = np.zeros((len(names), len(names)), bool)
    near[partners[:, 0], partners[:, 1]] = True
    alike = np.argsort(np.argsort(names, kind="stable"), kind="stable")
    good, waits, there = good.astype(np.int64), np.zeros(len(names), np.int64), np.ones(len(names), bool)
    out = []
    while there.any():
        first = int(np.argmin(np.where(there, good * len(names) + alike, np.iinfo(np.int64).max)))
        if good[first] >= left - 1:
            return [*out, (len(out), names[first], int(good[first]), -1)]
        out.append((len(out), names[first], int(good[first]), int(waits[first]) + 1))
        there[first], left = False, left - 1
        waits[~near[first]] = np.maximum(waits[~near[first]], waits[first] + 1)  # its short partners wait for it
        good[near[first]] -= 1
    return out


def _steps_that_hold(names: np.ndarray, good: np.ndarray, lost: list[np.ndarray], order: pd.DataFrame) -> int:
    """Leading steps of ``order`` before which none of these stations would have come first; ``lost``: steps that take a good partner from each."""
    asked, holder = order["good"].to_numpy(), order["name"].to_numpy(dtype=object)
    holds = len(order)
    for start in range(0, len(names), 256):
        some = lost[start:start + 256]
        gone = np.zeros((len(some), len(order) + 1), np.int32)
        np.add.at(gone, (np.repeat(np.arange(len(some)), list(map(len, some))), np.concatenate(some) + 1), 1)
        now = good[start:start + 256][:, None] - gone[:, :-1].cumsum(axis=1)
        row, step = np.nonzero(now <= asked[None, :])
        early = (now[row, step] < asked[step]) | (names[start:start + 256][row] < holder[step])
        holds = min(holds, int(step[early].min(initial=len(order))))
    return holds


def core_rounds(pairs: DataFrame, stations: DataFrame, least_shared: int, by: str | None = None) -> tuple[DataFrame, int]:
    """The stations of :func:`core_stations` and the longest chains of stations that wait for each other, added over the rounds."""
    group = F.lit("all") if by is None else F.col(by)
    enough = pairs.where((F.col("n") >= least_shared) & (F.col("i") != F.col("j"))).select(group.alias("_g"), "i", "j")
    good = stored(enough.unionByName(enough.select("_g", F.col("j").alias("i"), F.col("i").alias("j"))).distinct())
    every = stations.select(group.alias("_g"), F.col("station_id").alias("i")).distinct()
    left = every.join(good.groupBy("_g", "i").agg(F.count(F.lit(1)).alias("good")), ["_g", "i"], "left").na.fill(0, ["good"])
    named = F.coalesce(F.concat(F.lit("1"), "i"), F.lit("0"))  # a missing id comes first, as in a sort
    left = stored(left.withColumns({"name": named, "_k": F.coalesce(F.concat(F.lit("1"), F.col("_g").cast("string")), F.lit("0"))}))
    buckets = left.count() // FRONT + 1

    def ordered(key, stations_of, inner):
        partners = inner[["of_i", "of_j"]].to_numpy(dtype=np.int64).reshape(-1, 2)
        front = stations_of.sort_values("place")
        steps = _front_order(front["name"].to_numpy(dtype=object), front["good"].to_numpy(), partners, int(front["n"].iloc[0])) if len(front) else []
        return pd.DataFrame([(key[0], *s) for s in steps], columns=["_k", "step", "name", "good", "chain"]).astype({"_k": object, "name": object})

    def judged(key, others, order):
        order = order.sort_values("step")
        if not len(order) or not len(others):
            return pd.DataFrame({"_k": np.array([], object), "holds": np.array([], np.int32)})
        lost = [np.asarray(x, np.int64) for x in others["lost"]]
        holds = _steps_that_hold(others["name"].to_numpy(dtype=object), others["good"].to_numpy(), lost, order)
        return pd.DataFrame({"_k": np.array([key[0]], object), "holds": [holds]})

    rounds = 0
    while True:
        place = F.row_number().over(Window.partitionBy("_k").orderBy("good", "name")) - 1
        sizes = left.groupBy("_k").agg(F.count(F.lit(1)).alias("n"))  # one row per group
        front = stored(left.select("_k", "_g", "i", "name", "good", place.alias("place")).where(F.col("place") < FRONT).join(sizes, "_k"))
        inner = (
            good.join(front.select("_k", "_g", "i", "place"), ["_g", "i"])
            .join(front.select("_g", F.col("i").alias("j"), F.col("place").alias("of_j")), ["_g", "j"])
            .select(F.concat("_k").alias("_k"), F.col("place").alias("of_i"), "of_j")
        )
        order = front.select("_k", "name", "good", "place", "n").groupBy("_k").cogroup(inner.groupBy("_k")).applyInPandas(ordered, f"_k string, {_ORDER}")
        order = stored(order)
        if order.where("chain > 0").isEmpty():
            return left.select(*([F.col("_g").alias(by)] if by else []), F.col("i").alias("station_id")), rounds
        gone = order.where("chain > 0").join(front.select("_k", "_g", "name", "i"), ["_k", "name"]).select("_g", F.col("i").alias("j"), "step")
        lost = good.join(gone, ["_g", "j"]).groupBy("_g", "i").agg(F.collect_list("step").alias("lost"))
        rest = left.join(lost, ["_g", "i"], "left").withColumn("lost", F.coalesce("lost", F.array().cast("array<int>")))
        rest = stored(rest.join(front.select("_k", "name", F.lit(True).alias("inside")), ["_k", "name"], "left"))
        bucket = F.pmod(F.xxhash64("name"), F.lit(buckets)).alias("_b")
        outside = rest.where("inside is null").select("_k", "name", "good", "lost", bucket)
        spread = order.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("_b"))
        checks = outside.groupBy("_k", "_b").cogroup(spread.groupBy("_k", "_b")).applyInPandas(judged, "_k string, holds int")
        holds = checks.groupBy("_k").agg(F.min("holds").alias("holds"))
        sure = stored(order.join(holds, "_k", "left").where("holds is null or step < holds"))
        rounds += sure.agg(F.max("chain")).first()[0]
        dropped = sure.where("chain > 0").groupBy("_k").agg(F.max("step").alias("last"))  # one row per group
        own = sure.where("chain > 0").select("_k", "name", F.lit(True).alias("goes"))
        fewer = F.size(F.filter("lost", lambda s: s <= F.coalesce("last", F.lit(-1))))
        after = rest.join(own, ["_k", "name"], "left").where("goes is null").join(dropped, "_k", "left")
        left = stored(after.select("_g", "i", (F.col("good") - fewer).alias("good"), "name", "_k"))
        if order.join(sure.where("chain = -1").select("_k"), "_k", "left_anti").isEmpty():  # every group came to its end
            return left.select(*([F.col("_g").alias(by)] if by else []), F.col("i").alias("station_id")), rounds


#: Links in a partition of the graph of :func:`station_clusters`, on average.
LINKS = 1 << 19


def node_links(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (``src``, ``dst``, ``weight``) between the nodes of the stations of each pair (``i``, ``j``, ``r``).

    ``nodes`` (``station_id``, ``id``) numbers the rows of a station one after the other. All m rows of a station and all n rows of another would
    take m * n links of weight r. In a power iteration the rows of a station have one value, as they have the same correlations, so only the
    weight between a row and all rows of another station counts: n * r. It is kept with m + n - 1 links at most: the rows of
    either station are laid side by side on a line of length m * n, and rows that overlap are linked by r times the length they share.

    The links lie in partitions of ``LINKS``; the number follows from the rows alone, as the draws of the first centres of clusters depend on it.
    """
    spans = nodes.groupBy("station_id").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows"))
    linked = stored(
        pairs.select("i", "j", "r")
        .join(spans.select(F.col("station_id").alias("i"), F.col("first").alias("a"), F.col("rows").alias("m")), "i")
        .join(spans.select(F.col("station_id").alias("j"), F.col("first").alias("b"), F.col("rows").alias("n")), "j")
        .select("a", "m", "b", "n", "r")
    )
    most = linked.agg(F.sum(F.col("m") + F.col("n") - 1)).first()[0] or 0
    own = linked.repartition(1 + most // LINKS).withColumn("p", F.explode(F.expr("sequence(0L, m - 1)")))
    met = own.withColumn("q", F.explode(F.expr("sequence(p * n div m, ((p + 1) * n - 1) div m)")))
    p, q, m, n = (F.col(c) for c in "pqmn")
    share = F.least((p + 1) * n, (q + 1) * m) - F.greatest(p * n, q * m)
    return met.select((F.col("a") + p).alias("src"), (F.col("b") + q).alias("dst"), (F.col("r") * share).alias("weight"))


def station_clusters(pairs: DataFrame, stations: DataFrame, k: int = 3) -> DataFrame:
    """Clusters of stations that vary together: power iteration on the positive correlations, named west to east.

    A different method from hierarchical linkage, so the labels are comparable in kind only. Every row of ``stations`` is a node, a repeated
    station too; links grow with the rows, not with their square (:func:`node_links`).
    """
    ids = stored(with_xy(stations).select("station_id", "x_km", F.row_number().over(Window.orderBy("station_id")).cast("long").alias("id")))
    pic = PowerIterationClustering(k=k, maxIter=20, initMode="degree", weightCol="weight")
    clusters = pic.assignClusters(node_links(pairs.where(F.col("r") > 0), ids))
    return name_by_position(clusters.join(ids, "id").select("station_id", "cluster", "x_km"))


def name_by_position(clusters: DataFrame) -> DataFrame:
    """Replace cluster numbers by their order from west to east (mean of ``x_km``)."""
    centres = clusters.groupBy("cluster").agg(F.avg("x_km").alias("x"))
    order = centres.select("cluster", F.row_number().over(Window.orderBy("x")).alias("position"))  # one row per cluster
    return clusters.join(F.broadcast(order), "cluster").select("station_id", "position")


def assign_by_correlation(pairs: DataFrame, members: DataFrame, least_shared: int, least_members: int = 5) -> DataFrame:
    """Cluster whose members a non-member correlates with best, if it shares enough slots with enough members."""
    both = pairs.select("i", "j", "n", "r").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "n", "r"))
    known = members.select(F.col("station_id").alias("j"), "cluster")
    linked = both.where((F.col("n") >= least_shared) & F.col("r").isNotNull()).join(known, "j")
    open_ends = linked.join(members.select(F.col("station_id").alias("i")), "i", "left_anti")
    means = open_ends.groupBy("i", "cluster").agg(F.avg("r").alias("r"), F.count("*").alias("n"))
    best = means.groupBy("i").agg(F.max_by("cluster", F.struct(F.round("r", 12), "cluster")).alias("cluster"), F.sum("n").alias("shared"), F.max("r").alias("mean_r"))
    return best.where(F.col("shared") >= least_members).select(F.col("i").alias("station_id"), "cluster", "shared", "mean_r")


def region_chain(pairs: DataFrame, stations: DataFrame, least_shared: int, k: int = 3, least_members: int = 5) -> DataFrame:
    """Clusters of the core stations, and of the others by their correlation with those: (``station_id``, ``cluster``, ``core``).

    Stations that share too few slots with the core have no cluster.
    """
    core = core_stations(pairs, stations, least_shared)
    members = stored(station_clusters(among(pairs, core), stations.join(core, "station_id", "left_semi"), k).withColumnRenamed("position", "cluster"))
    others = assign_by_correlation(pairs, members, least_shared, least_members).select("station_id", "cluster")
    named = members.select("station_id", "cluster", F.lit(True).alias("core")).unionByName(others.withColumn("core", F.lit(False)))
    return stations.select("station_id").distinct().join(named, "station_id", "left").select("station_id", "cluster", F.coalesce("core", F.lit(False)).alias("core"))


def among(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs whose two stations are members."""
    ids = members.select("station_id")
    return pairs.join(ids.withColumnRenamed("station_id", "i"), "i", "left_semi").join(ids.withColumnRenamed("station_id", "j"), "j", "left_semi").select(*pairs.columns)


def half_clusters(halves: DataFrame, stations: DataFrame, least_shared: int, k: int = 3) -> DataFrame:
    """Clusters (``odd``, ``even``) that each half of the time gives to the stations that are core stations in both halves.

    ``halves`` has the pairs of both halves under ``g`` = odd and even.
    """
    both = F.explode(F.array(F.lit("odd"), F.lit("even")))
    cores = core_stations(halves, stations.select("station_id").distinct().withColumn("g", both), least_shared, by="g")
    shared = stored(cores.groupBy("station_id").agg(F.count_distinct("g").alias("n")).where("n = 2").select("station_id"))
    inner, places = stored(among(halves, shared)), stations.join(shared, "station_id", "left_semi")
    odd, even = (station_clusters(inner.where(F.col("g") == half), places, k).withColumnRenamed("position", half) for half in ("odd", "even"))
    return odd.join(even, "station_id")


def _choose2(n: Column) -> Column:
    return n * (n - 1) / 2


def rand_index(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency table."""
    cells = labels.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(F.sum(_choose2(F.col("n"))).alias("both"), F.sum("n").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(_choose2(F.col("n")))).scalar()
    columns = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(_choose2(F.col("n")))).scalar()
    parts = both.withColumns({"rows": rows, "columns": columns})
    chance = F.col("rows") * F.col("columns") / _choose2(F.col("n"))
    ari = F.try_divide(F.col("both") - chance, (F.col("rows") + F.col("columns")) / 2 - chance)
    return parts.select("n", F.coalesce(ari, F.lit(1.0)).alias("ari"))


def within_across(pairs: DataFrame, members: DataFrame, bands=CLUSTER_TEST_BANDS) -> DataFrame:
    """Correlations of pairs inside one cluster against pairs across clusters, per distance band.

    Medians, Mann-Whitney U of the inside pairs, its tie-corrected normal deviate ``z`` (with continuity
    correction, large when inside pairs correlate more) and the one-sided ``p``.
    """
    a = members.select(F.col("station_id").alias("i"), F.col("cluster").alias("ci"))
    b = members.select(F.col("station_id").alias("j"), F.col("cluster").alias("cj"))
    band = F.lit(None).cast("string")
    for low, high in bands:
        band = F.when((F.col("d") >= low) & (F.col("d") < high), F.lit(f"{low}-{high} km")).otherwise(band)
    rows = (
        pairs.where(F.col("r").isNotNull()).join(a, "i").join(b, "j")
        .select(band.alias("band"), "r", (F.col("ci") == F.col("cj")).alias("inside"))
        .where(F.col("band").isNotNull())
    )
    return rank_test(rows, ["band"], "r", "inside", cells=[i / 128 for i in range(-127, 128)])


def rank_test(rows: DataFrame, keys: list[str], value: str, inside: str, cells: list[float] | None = None) -> DataFrame:
    """One-sided Mann-Whitney comparison of the ``inside`` rows with the others, per key."""
    sides = {"_in": F.count_if(F.col(inside)), "_out": F.count_if(~F.col(inside))}
    ties = rows.where(F.col(inside).isNotNull()).groupBy(*keys, value).agg(*[c.alias(k) for k, c in sides.items()], F.count(F.lit(1)).alias("n"))
    t = F.col("n").cast("double")
    # a value with t tied rows contributes t * (t^2 - 1)
    s = average_ranks(ties, keys, value, "n", cells).groupBy(*keys).agg(
        F.sum("_in").alias("n_within"), F.sum("_out").alias("n_across"),
        F.percentile(value, 0.5, F.col("_in")).alias("within"), F.percentile(value, 0.5, F.col("_out")).alias("across"),
        F.sum(F.col("_in") * F.col("rank")).alias("rank_sum"), F.sum(t * (t * t - 1)).alias("tie_term"),
    )
    n1, n2 = F.col("n_within").cast("double"), F.col("n_across").cast("double")
    n = n1 + n2
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("tie_term"), n * (n - 1))))
    z = F.try_divide(u - n1 * n2 / 2 - 0.5, sd)
    return s.select(*keys, "n_within", "n_across", "within", "across", u.alias("u"), z.alias("z"), normal_tail(z).alias("p"))
