"""GeoJSON and KML files by tasks and commit."""

import json
import xml.etree.ElementTree as ET

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.sources import framed, sinks

SCHEMA = pa.schema([("group", pa.string()), ("body", pa.string())])


def batches(rows):
    for i in range(0, len(rows), 2):
        yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r)) for r in rows[i : i + 2]], schema=SCHEMA)


def files(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


def test_a_task_that_fails_and_runs_again(tmp_path):
    rows = [("a", "1"), ("a", "2"), ("a", "3"), ("b", "4")]

    def broken():
        yield from batches(rows[:2])
        raise OSError("lost")

    w = framed.FramedWriter(str(tmp_path), "geojson", 2, True)
    with pytest.raises(OSError):
        w.write_task(broken(), 0)
    first = w.write_task(batches(rows), 0)
    w.write_task(batches(rows), 0)  # speculative twin whose message doesn't count
    w.commit([first, None, w.write_task(batches([("b", "5")]), 1)])
    index = framed.read_index(str(tmp_path))
    read = {g: [json.loads((tmp_path / p["file"]).read_text())["features"] for p in parts] for g, parts in index.items()}
    assert read == {"a": [[1, 2], [3]], "b": [[4], [5]]}
    assert len(files(tmp_path)) == 5  # four documents and the index

    w = framed.FramedWriter(str(tmp_path), "geojson", 2, True)
    w.write_task(batches(rows), 0)
    w.abort([None])
    assert framed.read_index(str(tmp_path)) == index and len(files(tmp_path)) == 5


def test_geojson_of_a_group_of_any_size(spark, tmp_path):
    df = spark.range(2500).select("id", F.when(F.col("id") % 10 > 0, "big").otherwise("söm<e").alias("g"), (F.col("id") % 90).alias("lat"), F.lit(1.5).alias("lng"))
    features = sinks.geo_features(df, "lat", "lng", "id", "g")
    where = str(tmp_path / "out")
    framed.write_framed(features, "g", "id", "feature", where, "geojson", 400)
    framed.write_framed(features, "g", "id", "feature", where, "geojson", 400)  # the second set replaces the first
    index = framed.read_index(where)
    assert sum(p["rows"] for p in index["big"]) == 2250 and len(index["big"]) >= 6
    ids = {g: [f["properties"]["id"] for p in parts for f in json.loads((tmp_path / "out" / p["file"]).read_text())["features"]] for g, parts in index.items()}
    assert ids == {"big": [i for i in range(2500) if i % 10], "söm<e": list(range(0, 2500, 10))}
    assert len(files(tmp_path / "out")) == 1 + sum(map(len, index.values()))


def test_kml_is_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "R&D", "x <y>"), (2, "R&D", None), (3, None, "z")], "o int, g string, name string")
    df = df.withColumn("p", F.when(F.col("name").isNotNull(), sinks.kml_placemark(F.col("name"), "o", "o")))
    framed.write_framed(df, "g", "o", "p", str(tmp_path / "k"), "kml")
    got = {r.group: ET.fromstring(r.text) for r in framed.read_framed(spark, str(tmp_path / "k")).collect()}
    ns = "{http://www.opengis.net/kml/2.2}"
    assert {g: [x.text for x in t.iter(ns + "name")] for g, t in got.items()} == {"R&D": ["R&D", "x <y>"], "": [None, "z"]}
    framed.write_framed(df, "g", "o", "p", str(tmp_path / "k"), "kml", mode="append")
    assert framed.read_framed(spark, str(tmp_path / "k")).count() == 4
    framed.write_framed(df.limit(0), "g", "o", "p", str(tmp_path / "none"), "kml")
    assert framed.read_framed(spark, str(tmp_path / "none")).count() == 0


def test_a_job_that_fails_leaves_the_set_before(spark, tmp_path):
    where = str(tmp_path / "out")
    good = spark.createDataFrame([(1, "a", "1")], "o int, g string, body string")
    framed.write_framed(good, "g", "o", "body", where, "geojson")
    before = files(tmp_path)
    bad = good.withColumn("body", F.when(F.rand() >= 0, F.raise_error(F.lit("broken"))).cast("string"))
    with pytest.raises(Exception, match="broken"):
        framed.write_framed(bad, "g", "o", "body", where, "geojson")
    assert files(tmp_path) == before
