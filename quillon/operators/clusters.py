"""Map clusters: points within a pixel radius of a centre, greedy in a fixed order, nested from zoom to zoom."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.sources.shared import discard, materialize

#: Pixel radius by zoom (below 5, below 10, from 10 on), zoom from which points stand alone, size steps.
RADII, ALONE, STEPS = ((5, 52), (10, 44), (None, 34)), 14, (10, 100)
#: Latitude at which the square map of the world ends.
LAST_LAT = 85.0511287798


@dataclass(frozen=True)
class Clusters:
    """levels: (zoom, id, lat, lng, n_points, mean_lat, mean_lng, size_class), one row a cluster, named by its centre;
    links: (zoom, member, member_lat, member_lng, id, lat, lng): a cluster of the zoom before (at the first zoom: a point)
    and the cluster it is in."""

    levels: DataFrame
    links: DataFrame


def radius_of(zoom: int) -> int:
    return next(r for below, r in RADII if below is None or zoom < below)


def pixels(lat: Column, lng: Column, zoom: int) -> tuple[Column, Column]:
    """Place on the square map of the world, 256 * 2 ** zoom pixels wide."""
    size = 256.0 * 2**zoom
    s = F.sin(F.radians(F.greatest(F.least(lat, F.lit(LAST_LAT)), F.lit(-LAST_LAT))))
    return (lng + 180.0) / 360.0 * size, (0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * size


def _around(centres: DataFrame) -> DataFrame:
    """Centres (c, cx, cy, c_gx, c_gy) once for each cell that their radius can reach."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3)])
    return centres.withColumn("s", F.explode(steps)).select("c", "cx", "cy", (F.col("c_gx") + F.col("s.i")).alias("gx"), (F.col("c_gy") + F.col("s.j")).alias("gy"))


def greedy_centres(points: DataFrame, radius: float, name: str = "centres") -> DataFrame:
    """Centres (c, cx, cy, c_gx, c_gy) among points (o, x, y): the points, taken in the order of o, that no centre before
    them has within its radius.

    Cells are so small that points of one are within the radius of each other, so only the first undecided point of a
    cell can be next. It is a centre if no undecided point before it is within its radius; then points near it are
    decided. Each point is compared with the firsts of 25 cells, however many points a cell holds; with an order that
    doesn't follow the map, a round decides a large share of what is left. Rounds are written to the shared folder.
    """
    side = radius / math.sqrt(2) * (1 - 1e-9)
    left = materialize(points.select("o", "x", "y", F.floor(F.col("x") / side).alias("gx"), F.floor(F.col("y") / side).alias("gy")), name)
    near = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) <= radius * radius
    found = None
    while found is None or left.limit(1).count():
        firsts = left.groupBy(F.col("gx").alias("c_gx"), F.col("gy").alias("c_gy")).agg(F.min(F.struct("o", "x", "y")).alias("f")).select(F.col("f.o").alias("c"), F.col("f.x").alias("cx"), F.col("f.y").alias("cy"), "c_gx", "c_gy")
        firsts = materialize(firsts, name)
        late = left.join(_around(firsts), ["gx", "gy"]).filter(near & (F.col("o") < F.col("c"))).select("c").distinct()
        new = materialize(firsts.join(late, "c", "left_anti").select(*firsts.columns), name)
        spread = _around(new).withColumnsRenamed({"gx": "h_gx", "gy": "h_gy"})
        rest = materialize(left.join(spread, (F.col("gx") == F.col("h_gx")) & (F.col("gy") == F.col("h_gy")) & near, "left_anti"), name)
        discard(left, firsts)
        left, found = rest, new if found is None else found.unionAll(new)
    return found


def radius_clusters(df: DataFrame, id_col: str, lat: str, lng: str, zooms: Sequence[int]) -> Clusters:
    """Clusters at each of the zooms, from the deepest on; at a zoom, the clusters of the one before are points at their
    centres, so a cluster lies in one cluster of every further zoom, and no cell has more than a few of them.

    The order of points is that of a hash of (id, lat, lng), then of these. A point goes to the first centre within the
    radius. Rows without coordinates are in no cluster; equal rows are one point that counts as often; ids may be null
    or stand in several places. From zoom 14 on every point is its own cluster.
    """
    ok = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lat}`").cast("double").alias("lat"), F.col(f"`{lng}`").cast("double").alias("lng")).filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    at = F.struct(F.xxhash64("id", "lat", "lng").alias("h"), "id", "lat", "lng")
    now = materialize(ok.groupBy("id", "lat", "lng").agg(F.count("*").alias("n"), F.sum("lat").alias("s_lat"), F.sum("lng").alias("s_lng")).select(at.alias("o"), "n", "s_lat", "s_lng"), "clusters")
    levels, links = [], []
    for zoom in sorted(set(zooms), reverse=True):
        if zoom >= ALONE:
            joined = now.select("o", "n", "s_lat", "s_lng", F.col("o").alias("c"))
        else:
            x, y = pixels(F.col("o.lat"), F.col("o.lng"), zoom)
            radius = float(radius_of(zoom))
            side = radius / math.sqrt(2) * (1 - 1e-9)
            placed = now.withColumns({"x": x, "y": y}).withColumns({"gx": F.floor(F.col("x") / side), "gy": F.floor(F.col("y") / side)})
            centres = greedy_centres(placed, radius, f"clusters-{zoom}")
            near = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) <= radius * radius
            first = placed.join(_around(centres), ["gx", "gy"]).filter(near).groupBy("o").agg(F.min("c").alias("c"), F.first("n").alias("n"), F.first("s_lat").alias("s_lat"), F.first("s_lng").alias("s_lng"))
            joined = materialize(first, f"clusters-{zoom}")
        links.append(joined.select(F.lit(zoom).alias("zoom"), F.col("o.id").alias("member"), F.col("o.lat").alias("member_lat"), F.col("o.lng").alias("member_lng"), "c.id", "c.lat", "c.lng"))
        now = materialize(joined.groupBy(F.col("c").alias("o")).agg(F.sum("n").alias("n"), F.sum("s_lat").alias("s_lat"), F.sum("s_lng").alias("s_lng")), f"clusters-{zoom}")
        n = F.col("n")
        levels.append(now.select(F.lit(zoom).alias("zoom"), "o.id", "o.lat", "o.lng", n.alias("n_points"), (F.col("s_lat") / n).alias("mean_lat"), (F.col("s_lng") / n).alias("mean_lng"), F.when(n < STEPS[0], "small").when(n < STEPS[1], "medium").otherwise("large").alias("size_class")))
    out = []
    for parts in (levels, links):
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionAll(p)
        out.append(whole)
    return Clusters(*out)
