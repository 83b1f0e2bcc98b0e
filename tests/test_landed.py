"""Sitemap indexes and paged listings from one call."""

import gzip
import json

from quillon.sources import landed

HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
NS = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def urls(*paths):
    return f"{HEAD}<urlset {NS}>" + "".join(f"<url><loc> https://old.example/{p} </loc><lastmod>2026-01-01</lastmod></url>" for p in paths) + "<url><lastmod>x</lastmod></url></urlset>"


def index(*names):
    return f"{HEAD}<sitemapindex {NS}>" + "".join(f"<sitemap><loc>https://old.example/maps/{n}</loc></sitemap>" for n in names) + "</sitemapindex>"


def test_an_index_of_sitemaps(spark, tmp_path):
    maps = tmp_path / "maps"
    maps.mkdir()
    (tmp_path / "sitemap.xml").write_text(index("a.xml", "b.xml.gz", "missing.xml", "more.xml", "a.xml"))
    (maps / "a.xml").write_text(urls("x/1", "x/2"))
    (maps / "b.xml.gz").write_bytes(gzip.compress(urls("y/é&amp;1").encode()))
    (maps / "more.xml").write_text(index("c.xml", "more.xml"))
    (maps / "c.xml").write_text(urls(*(f"z/{i}" for i in range(3000))))
    df = landed.read_sitemaps(spark, f"{tmp_path}/sitemap.xml", str(tmp_path), "old.example", "new.example")
    assert df.rdd.getNumPartitions() == 3
    got = sorted(r.loc for r in df.collect())
    assert got == sorted(["https://new.example/x/1", "https://new.example/x/2", "https://new.example/y/é&1", *(f"https://new.example/z/{i}" for i in range(3000))])
    assert {r.lastmod for r in df.collect()} == {"2026-01-01"}
    assert landed.read_sitemaps(spark, f"{maps}/a.xml", str(tmp_path)).count() == 2
    assert landed.read_sitemaps(spark, f"{tmp_path}/none.xml", str(tmp_path)).count() == 0


def land(root, area, page, total, records):
    folder = root / f"area={area}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"page={page}.json").write_text(records if isinstance(records, str) else json.dumps({"metadata": {"totalPages": total}, "collection": records}))


def test_a_listing_of_two_areas(spark, tmp_path):
    for page in range(1, 6):
        land(tmp_path, "tokyo", page, 5, [{"id": page * 10 + i} for i in range(3)])
    land(tmp_path, "osaka", 1, None, [{"id": 1, "name": "é"}])
    land(tmp_path, "osaka", 2, 9, [{"id": 2}])  # beyond what the first page says
    land(tmp_path, "kyoto", 2, 9, [{"id": 3}])  # without a first page
    land(tmp_path, "nara", 1, 3, [{"id": 4}])
    land(tmp_path, "nara", 2, 3, "not json")
    df = landed.read_listing(spark, str(tmp_path), pages=2)
    assert df.rdd.getNumPartitions() == 3 + 1 + 1 + 2
    got = sorted((r.area, r.page, r.position, json.loads(r.record)["id"]) for r in df.collect())
    assert got == sorted([("tokyo", p, i, p * 10 + i) for p in range(1, 6) for i in range(3)] + [("osaka", 1, 0, 1), ("nara", 1, 0, 4)])


def test_pages_are_streamed_as_they_land(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "out"

    def run():
        q = landed.read_listing(spark, str(root), stream=True).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted((r.area, r.page, json.loads(r.record)) for r in spark.read.parquet(str(out)).collect())

    land(root, "a", 1, 3, [1])
    land(root, "a", 3, 3, [3])  # waits for the second
    assert run() == [("a", 1, 1)]
    land(root, "a", 2, 3, [2])
    land(root, "b", 1, 1, [9])
    assert run() == [("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 9)]
