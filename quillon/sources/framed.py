"""Documents of many parts as a Spark data source: GeoJSON, KML and sitemap files of any size, written by tasks, named at commit."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quillon.sources.shared import qualified

#: Text before, between and after the bodies of a document, and its suffix; {title} is the group's name.
FRAMES = {
    "geojson": ('{"type":"FeatureCollection","features":[', ",\n", "]}", ".geojson"),
    "kml": ('<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{title}</name>\n', "\n", "\n</Document></kml>\n", ".kml"),
    "sitemap": ('<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n', "\n", "\n</urlset>\n", ".xml"),
    "sitemapindex": ('<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n', "\n", "\n</sitemapindex>\n", ".xml"),
}
#: Bodies of a file; a group with more has several files, each a document of its own.
ROWS = 100_000
INDEX = "index.json"


@dataclass
class Parts(WriterCommitMessage):
    """Files that a task has finished: (group, partition, number within the task, file, bodies)."""

    files: list = field(default_factory=list)


def _store(path: str) -> tuple[pfs.FileSystem, str]:
    """File system and path in it; whatever scheme pyarrow knows."""
    return pfs.FileSystem.from_uri(path) if "://" in path else (pfs.LocalFileSystem(), path)


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


class FramedWriter(DataSourceArrowWriter):
    """Tasks write documents to a folder of the job; commit moves those of the tasks that count to their names, writes
    the index and deletes what the index before named; abort deletes the job's folder. What a task that failed or ran
    twice has left is never moved."""

    def __init__(self, path: str, frame: str, rows: int, overwrite: bool):
        self.path, self.frame, self.rows, self.overwrite, self.job = path.rstrip("/"), frame, rows, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        from pyspark import TaskContext

        context = TaskContext.get()
        return self.write_task(iterator, context.partitionId() if context else 0)

    def write_task(self, iterator: Iterator[pa.RecordBatch], partition: int) -> Parts:
        """Rows (group, body), sorted by group; a group's bodies follow each other."""
        head, between, tail, suffix = FRAMES[self.frame]
        store, root = _store(self.path)
        folder = f"{root}/_jobs/{self.job}/{partition}-{uuid.uuid4().hex}"
        out, done, group, n = None, Parts(), None, 0

        def close() -> None:
            out.write(tail.encode())
            out.close()
            done.files[-1][-1] = n

        for batch in iterator:
            for g, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None or g != group or n >= self.rows:
                    if out is not None:
                        close()
                    else:
                        store.create_dir(folder, recursive=True)
                    group, n = g, 0
                    done.files.append([g, partition, len(done.files), f"{folder}/{len(done.files)}{suffix}", 0])
                    out = store.open_output_stream(done.files[-1][3])
                    out.write(head.replace("{title}", _escaped(g or "")).encode())
                out.write((between if n else "").encode() + body.encode())
                n += 1
        if out is not None:
            close()
        return done

    def commit(self, messages: list[Parts | None]) -> None:
        store, root = _store(self.path)
        suffix = FRAMES[self.frame][3]
        before = read_index(self.path)
        index = {} if self.overwrite else {g: list(parts) for g, parts in before.items()}
        made = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: (f[0] or "", f[1], f[2]))
        for i, (g, _, _, file, n) in enumerate(made):
            name = f"{self.job}-{i:06d}{suffix}"
            store.move(file, f"{root}/{name}")
            index.setdefault(g or "", []).append({"file": name, "rows": n})
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{INDEX}.{self.job}") as out:
            out.write(json.dumps(index, ensure_ascii=False).encode())
        store.move(f"{root}/{INDEX}.{self.job}", f"{root}/{INDEX}")
        named = {p["file"] for parts in index.values() for p in parts}
        for old in {p["file"] for parts in before.values() for p in parts} - named:
            store.delete_file(f"{root}/{old}")
        self._clear(store, root)

    def abort(self, messages: list[Parts | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, store: pfs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/_jobs/{self.job}").type == pfs.FileType.Directory:
            store.delete_dir(f"{root}/_jobs/{self.job}")


class FramedFiles(DataSource):
    """Data source `framed` for writing: options path, frame (a key of FRAMES) and rows."""

    @classmethod
    def name(cls) -> str:
        return "framed"

    def schema(self) -> str:
        return "group string, body string"

    def writer(self, schema, overwrite: bool) -> FramedWriter:
        return FramedWriter(self.options["path"], self.options["frame"], int(self.options.get("rows", ROWS)), overwrite)


def read_index(path: str) -> dict[str, list[dict]]:
    """Group -> its files in order, with their number of bodies; {} if nothing was committed."""
    store, root = _store(path.rstrip("/"))
    if store.get_file_info(f"{root}/{INDEX}").type != pfs.FileType.File:
        return {}
    with store.open_input_stream(f"{root}/{INDEX}") as f:
        return json.loads(f.read())


def write_framed(df: DataFrame, group: str, order: str, body: str, path: str, frame: str, rows: int = ROWS, mode: str = "overwrite") -> None:
    """Documents of df's bodies by group, in the given order, below path; see read_index for the files.

    Rows are dealt by ranges of (group, order), so a group of any size is spread over tasks and files, each a whole
    document, and no row, task or driver holds a group. Null bodies are left out; a null group is the empty one.
    """
    spark = df.sparkSession
    spark.dataSource.register(FramedFiles)
    rows_ = df.select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("group"), F.col(order).alias("o_"), F.col(body).cast("string").alias("body")).filter("body is not null")
    dealt = rows_.withColumn("s_", F.monotonically_increasing_id()).repartitionByRange("group", "o_", "s_").sortWithinPartitions("group", "o_", "s_").select("group", "body")
    dealt.write.format("framed").mode(mode).option("path", qualified(spark, path)).option("frame", frame).option("rows", rows).save()


def read_framed(spark: SparkSession, path: str) -> DataFrame:
    """(group, file, rows, text): the documents of a committed set, one row a file."""
    path = qualified(spark, path)
    files = [(g, f"{path}/{p['file']}", p["file"], p["rows"]) for g, parts in read_index(path).items() for p in parts]
    if not files:
        return spark.createDataFrame([], "group string, file string, rows long, text string")
    named = spark.createDataFrame([(g, name, n) for g, _, name, n in files], "group string, file string, rows long")
    texts = spark.read.text([f for _, f, _, _ in files], wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return named.join(texts, "file").select("group", "file", "rows", "text")
