"""File catalogue: crawl, incremental skip, typed text extraction, inventories."""

from __future__ import annotations

import fnmatch
import io
import multiprocessing
import os
import re
import zipfile
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import kept

# Extensions read as plain text.
PLAIN = ("txt", "csv", "tsv", "json", "xml", "html", "htm", "md", "log", "yaml", "yml", "ini", "sql")
OFFICE = ("docx", "xlsx", "pptx", "odt", "ods", "odp")
ARCHIVES = ("zip",)


def crawl(spark: SparkSession, root: str, pattern: str = "*", excluded: Sequence[str] = (), reserved: Sequence[str] = ()) -> DataFrame:
    """Path, name, parent, extension, size, modified_at of files below ``root``; contents are not read.

    ``excluded`` names and ``reserved`` folders (whole subtrees) are left out; any error of the
    walk fails the scan, so that a partial one is never taken for deletions.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"))
    rows = rows.withColumns({"name": name, "parent": F.regexp_replace("path", "/[^/]*$", ""), "extension": F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1))})
    for n in excluded:
        rows = rows.where(F.col("name") != n)
    for zone in reserved:
        rows = rows.where(~F.col("path").startswith(zone.rstrip("/") + "/"))
    return rows.where(~F.col("name").startswith("~$"))


def walk(spark: SparkSession, root: str, excluded: Sequence[str] = (), reserved: Sequence[str] = (), pattern: str = "*") -> DataFrame:
    """S01 / S02 on a mounted tree: path, parent, name, kind (file or folder), extension, size, modified_at, level of all below ``root``.

    The folders of a level are listed by tasks, each its own; ``excluded`` names and ``reserved`` folders are left
    out before anything in them is listed. Links are told as files and not followed. Any error of a listing
    fails the scan, so that a partial one is never taken for deletions. Only whether a level has folders reaches the driver.
    """
    zones = tuple(z.rstrip("/") for z in reserved)
    names = frozenset(excluded)

    def listed(batches):
        for batch in batches:
            rows = []
            for folder in batch.column(0).to_pylist():
                with os.scandir(folder) as entries:
                    for e in entries:
                        folder_like = e.is_dir(follow_symlinks=False)
                        if e.name in names or e.name.startswith("~$") or e.path in zones or not (folder_like or fnmatch.fnmatch(e.name, pattern)):
                            continue
                        told = e.stat(follow_symlinks=False)
                        rows.append((e.path, folder, e.name, "folder" if folder_like else "file", None if folder_like else told.st_size, int(told.st_mtime * 1_000_000)))
            cells = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, [pa.string()] * 4 + [pa.int64()] * 2, strict=True)], ["path", "parent", "name", "kind", "size", "us"])

    level, found = spark.createDataFrame([(root.rstrip("/") or "/",)], "folder string"), []
    while not level.isEmpty():
        rows = level.repartition("folder").mapInArrow(listed, "path string, parent string, name string, kind string, size long, us long")
        found.append(kept(rows.withColumn("level", F.lit(len(found) + 1))))
        level = found[-1].where("kind = 'folder'").select(F.col("path").alias("folder"))
    every = reduce(DataFrame.unionByName, found)
    extension = F.when(F.col("kind") == "file", F.lower(F.regexp_extract("name", "\\.([^./]+)$", 1)))
    return every.select("path", "parent", "name", "kind", extension.alias("extension"), "size", F.timestamp_micros("us").alias("modified_at"), "level")


def changed(scan: DataFrame, manifest: DataFrame, version: str) -> DataFrame:
    """Rows whose size, time or extractor version differ from the manifest, and new ones."""
    old = manifest.select("path", F.col("size").alias("__size"), F.col("modified_at").alias("__at"), F.col("extractor_version").alias("__version"))
    same = F.col("size").eqNullSafe(F.col("__size")) & F.col("modified_at").eqNullSafe(F.col("__at")) & F.lit(version).eqNullSafe(F.col("__version"))
    return scan.join(old, "path", "left").where(~same).drop("__size", "__at", "__version")


def strip_markup(html: Column) -> Column:
    """Scripts, styles and tags out, entities for the five basic signs in, white space collapsed."""
    text = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</\\1>", " ")
    text = F.regexp_replace(text, "(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def _office_text(content: bytes, most_members: int, most_bytes: int) -> tuple[str, int]:
    """Text of the members, and how many were left out."""
    pieces = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        members = [i for i in z.infolist() if i.filename.endswith(".xml")]
        read = [i for i in members[:most_members] if i.file_size <= most_bytes]
        for info in read:
            pieces.append(re.sub(r"<[^>]+>", " ", z.read(info).decode("utf-8", "ignore")))
    return " ".join(" ".join(pieces).split()), len(members) - len(read)


def _manifest(content: bytes, most: int) -> tuple[str, int]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
    return "\n".join(names[:most]), max(0, len(names) - most)


class _Child:
    """Reads files in a process of its own, which is killed when a file takes too long."""

    def __init__(self, read):
        self.read, self.process = read, None

    def __call__(self, seconds: float, *given):
        if self.process is None:
            context = multiprocessing.get_context("fork")
            self.pipe, theirs = context.Pipe()
            self.process = context.Process(target=self._serve, args=(theirs,), daemon=True)
            self.process.start()
            theirs.close()
        self.pipe.send(given)
        try:
            if self.pipe.poll(seconds):
                return self.pipe.recv()
            told = ("timeout", f"{seconds} s", None, 0)
        except EOFError:  # the child died of the file
            told = ("error", "the reader died", None, 0)
        self.stop()
        return told

    def _serve(self, pipe):
        while True:
            try:
                pipe.send(self.read(*pipe.recv()))
            except EOFError:
                return

    def stop(self):
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.process = None


def _reader(most_chars: int, most_members: int, most_member_bytes: int, most_names: int):
    def read(extension: str, content: bytes):
        """status, detail, text, left_out."""
        try:
            if extension in PLAIN:
                text, lost = content.decode("utf-8", "ignore"), 0
            elif extension in OFFICE:
                text, lost = _office_text(content, most_members, most_member_bytes)
            elif extension in ARCHIVES:
                text, lost = _manifest(content, most_names)
            else:
                return "unavailable", extension, None, 0
        except Exception as e:
            return "error", type(e).__name__, None, 0
        what = "names" if extension in ARCHIVES else "members"
        if len(text) > most_chars:
            return "truncated", f"{len(text) - most_chars} characters" + (f", {lost} {what}" if lost else ""), text[:most_chars], len(text) - most_chars + lost
        return ("truncated", f"{lost} {what}", text, lost) if lost else ("extracted", None, text, 0)

    return read


def extract_text(files: DataFrame, most_chars: int = 1_000_000, most_bytes: int = 50_000_000, most_members: int = 500, most_member_bytes: int = 10_000_000, most_names: int = 10_000, seconds: float = 60.0) -> DataFrame:
    """Path, status, detail, text, left_out of ``files`` (path, extension, length, content).

    Statuses: extracted (whole), truncated (``left_out`` characters, members or names are missing, as ``detail``
    says), unavailable (no reader for the type), skipped (too large), timeout, error. The limits are parameters.
    A file is read in a child process that is killed after ``seconds``; a file that fails or is not done in
    time gives a row with its error and never stops the others.
    """
    read = _reader(most_chars, most_members, most_member_bytes, most_names)

    def run(batches):
        child = _Child(read)
        try:
            for batch in batches:
                rows = []
                for path, extension, length, content in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    if length > most_bytes:
                        rows.append((path, "skipped", f"{length} bytes", None, length))
                    elif extension not in (*PLAIN, *OFFICE, *ARCHIVES):
                        rows.append((path, "unavailable", extension, None, 0))
                    else:
                        rows.append((path, *child(seconds, extension, content)))
                cells = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, [pa.string()] * 4 + [pa.int64()], strict=True)], ["path", "status", "detail", "text", "left_out"])
        finally:
            child.stop()

    return files.select("path", "extension", "length", "content").mapInArrow(run, "path string, status string, detail string, text string, left_out long")


def folders_with(files: DataFrame, extension: str) -> DataFrame:
    """Folders that directly hold a file of the type."""
    return files.groupBy("parent").agg(F.count("*").alias("files"), F.count_if(F.col("extension") == extension).alias("hits")).where("hits > 0")


def inventory(files: DataFrame) -> DataFrame:
    """Files and bytes per type and per year, in one pass over grouping sets."""
    year = F.year("modified_at")
    return files.select("extension", year.alias("year"), "size").groupingSets([["extension"], ["year"]], "extension", "year").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
