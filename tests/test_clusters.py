"""Map clusters against a sequential greedy twin."""

import math
import random

from pyspark.sql import functions as F

from quillon.operators import clusters


def pixels(lat, lng, zoom):
    s = math.sin(math.radians(max(min(lat, clusters.LAST_LAT), -clusters.LAST_LAT)))
    size = 256.0 * 2**zoom
    return (lng + 180.0) / 360.0 * size, (0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)) * size


def twin(points, zooms):
    """{zoom: {point: cluster}} from points {(hash, id, lat, lng): n}, one after the other."""
    out, now = {}, {p: p for p in points}
    for zoom in sorted(zooms, reverse=True):
        r2, centres, into = clusters.radius_of(zoom) ** 2, [], {}
        for p in sorted(set(now.values())):
            x, y = pixels(*p[2:], zoom)
            hit = next((c for c, a, b in centres if (x - a) ** 2 + (y - b) ** 2 <= r2), None) if zoom < clusters.ALONE else None
            if hit is None:
                centres.append((p, x, y))
            into[p] = hit or p
        now = {p: into[c] for p, c in now.items()}
        out[zoom] = dict(now)
    return out


def test_clusters_at_five_zooms(spark):
    """A crowd in one place, points all over, one id in two places, equal rows, rows without coordinates."""
    rng = random.Random(6)
    rows = [(i, 35.6 + rng.gauss(0, 0.02), 139.7 + rng.gauss(0, 0.02)) for i in range(500)]
    rows += [(1000 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(250)]
    rows += [(1, -10.0, 20.0), (1, -10.0, 20.0), (1, -10.0, 20.0), (2, 90.0, 180.0), (3, -90.0, -180.0), (4, None, 3.0), (5, 3.0, None), (2000, 35.6, 139.7), (2001, 35.6, 139.7)]
    df = spark.createDataFrame(rows, "id int, lat double, lng double")
    keyed = df.filter("lat is not null and lng is not null").withColumn("h", F.xxhash64("id", "lat", "lng"))
    points = {}
    for r in keyed.collect():
        key = (r.h, r.id, r.lat, r.lng)
        points[key] = points.get(key, 0) + 1
    zooms = (14, 12, 9, 4, 0)
    want = twin(points, zooms)
    got = clusters.radius_clusters(df, "id", "lat", "lng", zooms)
    levels = sorted((r.zoom, r.id, r.lat, r.lng, r.n_points, round(r.mean_lat, 6), r.size_class) for r in got.levels.collect())
    for_zoom = []
    for z in zooms:
        sums = {}
        for p, c in want[z].items():
            n, lat = sums.get(c, (0, 0.0))
            sums[c] = (n + points[p], lat + points[p] * p[2])
        for_zoom += [(z, *c[1:], n, round(lat / n, 6), "small" if n < 10 else "medium" if n < 100 else "large") for c, (n, lat) in sums.items()]
    assert levels == sorted(for_zoom)
    assert len({x for x in levels if x[0] == 0}) < len({x for x in levels if x[0] == 12})
    link = {(r.zoom, r.member, r.member_lat, r.member_lng): (r.id, r.lat, r.lng) for r in got.links.collect()}
    for p in points:  # from link to link every point comes to its cluster
        at = p[1:]
        for z in sorted(zooms, reverse=True):
            at = link[(z, *at)]
            assert at == want[z][p][1:]


def test_no_points(spark):
    df = spark.createDataFrame([(1, None, 2.0)], "id int, lat double, lng double")
    got = clusters.radius_clusters(df, "id", "lat", "lng", (10, 3))
    assert got.levels.count() == got.links.count() == 0


def test_a_crowd_is_not_paired_with_itself(spark):
    """20,000 points within one radius: a few rounds, one centre."""
    df = spark.range(20_000).select("id", (F.lit(10.0) + F.col("id") * 1e-9).alias("lat"), F.lit(20.0).alias("lng"))
    (r,) = clusters.radius_clusters(df, "id", "lat", "lng", (10,)).levels.collect()
    assert r.n_points == 20_000 and r.size_class == "large"
