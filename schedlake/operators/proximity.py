"""Nearest points inside a district.

No step pairs all points of a district. Equal coordinates are collapsed first. The sites are put into a pyramid of cells, and
only cells that hold too many sites are divided, so dense spots get a deep grid and lone sites a shallow one. Every cell knows how
many points it holds and the box around them, which bounds the distance to any of its points from both sides.

The search is best first, from the sites of one leaf cell together: it starts with the cells around their smallest ancestor that
holds enough points, keeps the cells that can still hold one of the k nearest given the counts and bounds of the others, and
divides these level by level until all are leaves. Only points of leaves that remain for a site are compared with it. The result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schedlake.functions.geo import EARTH_KM, LAT_RANGE, LNG_RANGE, haversine_km, valid_geo
from schedlake.operators.skew import first_rows
from schedlake.session import cut_lineage

BLOCK = ["city_slug", "district_slug"]
#: Side of the coarsest cell in degrees (the whole accepted range); each level divides the side by 4. At the last level a
#: cell is smaller than the step between double-precision coordinates.
ROOT_SIDE, FINEST = 8.0, 25
#: Sites a cell may hold per neighbour asked for before it is divided; levels looked at in one pass.
CELL_SITES, STEP = 8, 4
#: What rounding may add to a bound, as a share and in kilometres.
SLACK = 1e-8


def distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Haversine distance at a millionth of a metre, so that equal distances tie on every platform."""
    return F.round(haversine_km(lat1, lng1, lat2, lng2), 9)


def _side(level: Column) -> Column:
    return F.lit(ROOT_SIDE) / F.pow(F.lit(4.0), level)


def _cell(coord: Column, origin: float, level: Column) -> Column:
    return F.floor((coord - origin) / _side(level)).cast("long")


def _at_levels(df: DataFrame, first: Column, last: Column) -> DataFrame:
    out = df.withColumn("level", F.explode(F.sequence(first, last)))
    return out.withColumn("cy", _cell(F.col("lat"), LAT_RANGE[0], F.col("level"))).withColumn("cx", _cell(F.col("lng"), LNG_RANGE[0], F.col("level")))


def _above(coord: str, levels: Column) -> Column:
    """Number of the cell that holds a cell, ``levels`` levels up; exact, as sides are powers of two."""
    return F.call_function("shiftright", F.col(coord), (levels * 2).cast("int"))


def leaf_levels(sites: DataFrame, scope: list[str], full: int) -> DataFrame:
    """Sites (scope, lat, lng, ..) with ``leaf``, the first level on which their cell holds at most ``full`` sites.

    STEP levels are looked at in one pass, and only sites whose cells are still too full come into the next one.
    """
    site, cell = [*scope, "lat", "lng"], [*scope, "level", "cy", "cx"]
    done, left = None, sites
    for first in range(0, FINEST + 1, STEP):
        last = min(first + STEP - 1, FINEST)
        leveled = _at_levels(left.select(*site), F.lit(first), F.lit(last))
        fits = leveled.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") <= full) | (F.col("level") == FINEST)).drop("n")
        found = leveled.join(fits, cell).groupBy(*site).agg(F.min("level").alias("leaf"))
        placed = cut_lineage(left.join(found, site, "left"))
        here, left = placed.filter("leaf IS NOT NULL"), placed.filter("leaf IS NULL").drop("leaf")
        done = here if done is None else done.unionByName(here)
        if last == FINEST or left.isEmpty():
            break
    return done


def _box_bounds(a: str, b: str) -> tuple[Column, Column]:
    """Lower and upper bound of the distance between any points of two boxes (structs of south, north, west, east)."""
    box = lambda name, side: F.col(f"{name}.{side}")
    gap = lambda lo, hi: F.greatest(F.lit(0.0), box(a, lo) - box(b, hi), box(b, lo) - box(a, hi))
    span = lambda lo, hi: F.greatest(box(a, hi) - box(b, lo), box(b, hi) - box(a, lo))
    # latitudes are north of the equator, so a box is widest at its southern edge
    narrow, wide = (F.cos(F.radians(box(a, side))) * F.cos(F.radians(box(b, side))) for side in ("north", "south"))
    half = lambda degrees: F.pow(F.sin(F.radians(degrees) / 2), 2)
    km = lambda dy, dx, shrink: F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(half(dy) + shrink * half(dx))))
    low = km(gap("south", "north"), gap("west", "east"), narrow)
    high = km(span("south", "north"), span("west", "east"), wide)
    return low * (1 - SLACK) - SLACK, high * (1 + SLACK) + SLACK


def _within_reach(pairs: DataFrame, who: list[str], k: int) -> DataFrame:
    """Pairs whose cell can hold one of the k nearest: not farther than the k-th point must be, by the counts and upper bounds.

    ``pairs``: the columns ``who``, low, high, n. Adds the bound as ``reach`` (null while fewer than k points are known).
    """
    nearest = Window.partitionBy(*who).orderBy("high").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    enough = pairs.withColumn("known", F.sum("n").over(nearest))
    bound = F.min(F.when(F.col("known") >= k, F.col("high"))).over(Window.partitionBy(*who))
    return enough.withColumn("reach", bound).filter(F.col("reach").isNull() | (F.col("low") <= F.col("reach"))).drop("known")


def cells_in_reach(sites: DataFrame, scope: list[str], k: int) -> tuple[DataFrame, DataFrame]:
    """(site, level, cy, cx, reach): the leaf cells that can hold one of the ``k`` nearest points of each site, and a distance
    that the k-th is not beyond; and the sites with their leaf. ``sites``: scope, lat, lng, n (points to count there, at most k)."""
    site, cell = [*scope, "lat", "lng"], [*scope, "level", "cy", "cx"]
    placed = _at_levels(leaf_levels(sites, scope, CELL_SITES * k), F.col("leaf"), F.col("leaf"))
    box = F.struct(F.min("south").alias("south"), F.max("north").alias("north"), F.min("west").alias("west"), F.max("east").alias("east")).alias("box")
    cornered = placed.select(*cell, "n", F.col("lat").alias("south"), F.col("lat").alias("north"), F.col("lng").alias("west"), F.col("lng").alias("east"))
    leaves = cut_lineage(cornered.groupBy(*cell).agg(F.sum("n").alias("n"), box))

    # every cell above a leaf, from the leaves alone
    up = leaves.withColumn("top", F.explode(F.sequence(F.lit(0), F.col("level"))))
    rise = F.col("level") - F.col("top")
    raised = up.select(*scope, F.col("top").alias("level"), _above("cy", rise).alias("cy"), _above("cx", rise).alias("cx"), "n", "box.*", (rise == 0).alias("leaf"))
    nodes = cut_lineage(raised.groupBy(*cell).agg(F.sum("n").alias("n"), box, F.bool_or("leaf").alias("leaf")))

    # the smallest ancestor with k points, and the cells of its level that a circle around the leaf touches
    mine = [F.col(c).alias(f"q_{c}") for c in ("level", "cy", "cx")]
    who = [*scope, "q_level", "q_cy", "q_cx"]
    rich = nodes.filter(F.col("n") >= k).select(*cell, F.col("box").alias("around"))
    ancestors = up.select(*scope, *mine, F.col("box").alias("q_box"), F.col("top").alias("level"), _above("cy", rise).alias("cy"), _above("cx", rise).alias("cx"))
    start = ancestors.join(rich, cell).groupBy(*who).agg(F.max_by(F.struct("q_box", "around", "level"), "level").alias("s")).select(*who, "s.*")
    poor = leaves.select(*scope, *mine, F.col("box").alias("q_box")).join(start, who, "left_anti").withColumn("around", F.lit(None).cast(nodes.schema["box"].dataType)).withColumn("level", F.lit(0))
    start = start.unionByName(poor, allowMissingColumns=True)
    radius = _box_bounds("q_box", "around")[1]
    dy = F.degrees(F.col("r") / EARTH_KM)
    dx = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.least(F.col("r") / EARTH_KM, F.lit(1.5))) / F.cos(F.radians(F.col("q_box.north") + dy)))))
    edge = lambda side, delta, origin: F.when(F.col("level") == 0, F.lit(0)).otherwise(_cell(F.col(f"q_box.{side}") + delta, origin, F.col("level")))
    ringed = start.withColumn("r", radius).select(
        *who, "q_box", F.col("level").alias("own"), F.col("r").alias("reach"),
        edge("south", -dy, LAT_RANGE[0]).alias("y0"), edge("north", dy, LAT_RANGE[0]).alias("y1"), edge("west", -dx, LNG_RANGE[0]).alias("x0"), edge("east", dx, LNG_RANGE[0]).alias("x1"),
    )
    # a touched cell that was never divided so far is covered by a leaf above it
    covering = ringed.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("own"))))
    rise = F.col("own") - F.col("level")
    covering = covering.withColumn("cy", F.explode(F.sequence(_above("y0", rise), _above("y1", rise)))).withColumn("cx", F.explode(F.sequence(_above("x0", rise), _above("x1", rise))))
    low, high = _box_bounds("q_box", "box")
    kept = [*who, "q_box", "level", "cy", "cx", "leaf", "reach"]

    def narrowed(pairs: DataFrame) -> DataFrame:
        bounded = pairs.withColumn("low", low).withColumn("high", high).filter(F.col("reach").isNull() | (F.col("low") <= F.col("reach")))
        return cut_lineage(_within_reach(bounded.drop("reach"), who, k).select(*kept))

    met = narrowed(covering.join(nodes, cell).filter((F.col("level") == F.col("own")) | F.col("leaf")))
    below = nodes.filter("level > 0").select(*scope, (F.col("level") - 1).alias("level"), _above("cy", F.lit(1)).alias("cy"), _above("cx", F.lit(1)).alias("cx"), F.struct("level", "cy", "cx", "n", "box", "leaf").alias("to"))
    step = below.unionByName(nodes.filter("leaf").select(*cell, F.struct("level", "cy", "cx", "n", "box", "leaf").alias("to")))
    for _ in range(FINEST):
        if met.filter("NOT leaf").isEmpty():
            break
        met = narrowed(met.select(*who, "q_box", *cell[len(scope):], "reach").join(step, cell).select(*who, "q_box", "reach", "to.*"))

    # the same bounds once more for each site of a leaf
    at = placed.select(*site, *[F.col(c).alias(f"q_{c}") for c in ("level", "cy", "cx")])
    here = F.struct(F.col("lat").alias("south"), F.col("lat").alias("north"), F.col("lng").alias("west"), F.col("lng").alias("east"))
    each = met.select(*who, "level", "cy", "cx").join(leaves, cell).join(at, who).withColumn("q_box", here)
    bounded = each.withColumn("low", low).withColumn("high", high)
    return _within_reach(bounded, site, k).select(*site, "level", "cy", "cx", "reach"), placed


def nearest_sites(points: DataFrame, k: int, id_col: str = "ord", scope: list[str] = BLOCK) -> DataFrame:
    """Per site (scope, lat, lng) with valid coordinates: its nearest ``k`` points, those of the site itself included, as an array."""
    site = [*scope, "lat", "lng"]
    geo = points.filter(valid_geo(F.col("lat"), F.col("lng"))).select(*site, id_col)
    # read by the search and by the comparison, so written once
    candidates = cut_lineage(first_rows(geo, site, [id_col], k).drop("rank"))
    sites = candidates.groupBy(*site).agg(F.count(F.lit(1)).alias("n"))
    reached, placed = cells_in_reach(sites, scope, k)
    cell = [*scope, "level", "cy", "cx"]
    near = candidates.join(placed.select(*site, "level", "cy", "cx"), site).select(*cell, F.col(id_col).alias("n_id"), F.col("lat").alias("n_lat"), F.col("lng").alias("n_lng"))
    d = distance(F.col("lat"), F.col("lng"), F.col("n_lat"), F.col("n_lng"))
    found = reached.join(near, cell).withColumn("d", d).filter(F.col("reach").isNull() | (F.col("d") <= F.col("reach")))
    best = first_rows(found, site, ["d", "n_id"], k)
    return best.groupBy(*site).agg(F.sort_array(F.collect_list(F.struct("d", F.col("n_id").alias("id")))).alias("near"))


def knn_geo(points: DataFrame, k: int = 5, id_col: str = "ord") -> DataFrame:
    """(id, rank, neighbour, km) for points with valid coordinates among those of the same block; ties by id."""
    return _ranked(points, k, id_col, BLOCK)


def _ranked(points: DataFrame, k: int, id_col: str, scope: list[str], asks: str = "true") -> DataFrame:
    """Nearest points of the rows that ``asks``, among all rows of their scope."""
    lists = nearest_sites(points, k + 1, id_col, scope)
    geo = points.filter(valid_geo(F.col("lat"), F.col("lng"))).filter(asks).select(*scope, "lat", "lng", id_col)
    joined = geo.join(lists, [*scope, "lat", "lng"], "inner")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col(id_col)), 1, k)
    return joined.select(id_col, F.posexplode(others).alias("pos", "x")).select(
        id_col, (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("neighbour"), F.col("x.d").alias("km")
    )


def _head(points: DataFrame, keys: list[str], id_col: str, n: int, fields: list[str], name: str) -> DataFrame:
    """First ``n`` rows per key in input order, as one bounded array per key."""
    top = first_rows(points.select(*dict.fromkeys([*keys, id_col, *fields])), keys, [id_col], n)
    return top.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(id_col).alias("id"), *fields))).alias(name))


def _mixed_head(points: DataFrame, id_col: str, k: int) -> DataFrame:
    """Per block the first rows with at most ``k`` per village: whatever village is left out, the first k of the rest are among the first 2k."""
    village = F.coalesce(F.nullif("village", F.lit("")), F.lit(""))
    rows = points.select(*BLOCK, id_col, village.alias("v"))
    per_village = first_rows(rows.filter("v <> ''"), [*BLOCK, "v"], [id_col], k).drop("rank")
    no_village = first_rows(rows.filter("v = ''"), BLOCK, [id_col], 2 * k + 1).drop("rank")
    top = first_rows(per_village.unionByName(no_village), BLOCK, [id_col], 2 * k + 1)
    return top.groupBy(*BLOCK).agg(F.sort_array(F.collect_list(F.struct(F.col(id_col).alias("id"), "v"))).alias("block_head"))


def knn_fallback(points: DataFrame, k: int = 5, id_col: str = "ord") -> DataFrame:
    """(id, rank, neighbour, same_village) for points without valid coordinates: same village first, then the block, in input order.

    Works on heads of at most k+1 rows per village and 2k+1 per block, never on whole blocks.
    """
    village = F.coalesce(F.nullif("village", F.lit("")), F.lit(""))
    named = points.withColumn("v", village)
    villages = _head(named.filter("v <> ''"), [*BLOCK, "v"], id_col, k + 1, [], "village_head")
    targets = named.filter(~valid_geo(F.col("lat"), F.col("lng"))).select(*BLOCK, "v", id_col)
    joined = targets.join(villages, [*BLOCK, "v"], "left").join(_mixed_head(points, id_col, k), BLOCK, "left")
    me = F.col(id_col)
    empty = F.array().cast("array<struct<id:bigint,same:boolean>>")
    same = F.transform(F.filter("village_head", lambda x: x["id"] != me), lambda x: F.struct(x["id"].cast("long").alias("id"), F.lit(True).alias("same")))
    rest = F.transform(
        F.filter("block_head", lambda x: (x["id"] != me) & ((x["v"] == "") | (x["v"] != F.col("v")))),
        lambda x: F.struct(x["id"].cast("long").alias("id"), F.lit(False).alias("same")),
    )
    picks = F.slice(F.concat(F.coalesce(same, empty), F.coalesce(rest, empty)), 1, k)
    return joined.select(id_col, F.posexplode(picks).alias("pos", "x")).select(
        id_col, (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("neighbour"), F.col("x.same").alias("same_village")
    )


def knn_candidates(points: DataFrame, k: int = 5, enough: int = 15, id_col: str = "ord") -> DataFrame:
    """Neighbours from the village when it offers ``enough`` others, else from the block (``wide``).

    Points with coordinates get the nearest valid points of that scope, from the exact lists of the village or of the
    block; the others take their village first, then the block, in input order.
    """
    named = points.withColumn("v", F.coalesce(F.nullif("village", F.lit("")), F.lit("")))
    members = named.filter("v <> ''").groupBy(*BLOCK, "v").agg(F.count(F.lit(1)).alias("members"))
    # read by both scopes and by the points without coordinates
    scoped = cut_lineage(named.join(members, [*BLOCK, "v"], "left").withColumn("wide", F.coalesce(F.col("members") <= enough, F.lit(True))).drop("members"))
    blocks = scoped.filter("wide").select(*BLOCK).distinct()
    # one search over both scopes: villages by their name, blocks by a name that no village has
    whole = scoped.join(blocks, BLOCK, "left_semi").withColumn("asks", F.col("wide")).withColumn("v", F.lit(""))
    both = scoped.filter("NOT wide").withColumn("asks", F.lit(True)).unionByName(whole)
    near = _ranked(both, k, id_col, [*BLOCK, "v"], "asks")
    others = knn_fallback(points, k, id_col).select(id_col, "rank", "neighbour")
    found = near.select(id_col, "rank", "neighbour").unionByName(others)
    return found.join(scoped.select(id_col, "wide"), id_col).select(id_col, "rank", "neighbour", "wide")


def neighbour_heading(points: DataFrame, k: int = 5, id_col: str = "ord") -> DataFrame:
    """Heading class of a neighbour list: by distance, all of the same village, or of the same district."""
    lists = knn_fallback(points, k, id_col).groupBy(id_col).agg(F.bool_and("same_village").alias("all_same"))
    geo = valid_geo(F.col("lat"), F.col("lng"))
    has_village = F.coalesce(F.col("village") != "", F.lit(False))
    # an empty list counts as all of the same village
    same = has_village & F.coalesce("all_same", F.lit(True))
    return points.join(lists, id_col, "left").select(
        id_col, F.when(geo, "鄰近清運點").when(same, "同里的清運點").otherwise("同行政區的清運點").alias("heading")
    )
