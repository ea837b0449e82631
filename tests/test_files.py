"""Walking a tree level by level, and extraction within limits and in time."""

import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewell.sources import files


@pytest.fixture
def tree(tmp_path):
    for name in ("a/b/c/deep.txt", "a/x.TXT", "a/~$lock.docx", "skip/never.txt", "zone/in/er.txt", "zone2/kept.md", "top.csv"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "empty").mkdir()
    (tmp_path / "a/link").symlink_to(tmp_path / "zone2")
    return tmp_path


def test_walk_tells_files_and_folders(spark, tree):
    got = files.walk(spark, str(tree), excluded=["skip"], reserved=[f"{tree}/zone"]).collect()
    told = {os.path.relpath(r.path, tree): (r.kind, r.extension, r.size, r.level) for r in got}
    assert told == {
        "a": ("folder", None, None, 1), "empty": ("folder", None, None, 1), "zone2": ("folder", None, None, 1), "top.csv": ("file", "csv", 7, 1),
        "a/b": ("folder", None, None, 2), "a/x.TXT": ("file", "txt", 7, 2), "zone2/kept.md": ("file", "md", 13, 2), "a/b/c": ("folder", None, None, 3),
        "a/link": ("file", "", os.lstat(tree / "a/link").st_size, 2), "a/b/c/deep.txt": ("file", "txt", 14, 4),
    }
    assert all(abs(r.modified_at.timestamp() - os.lstat(r.path).st_mtime) < 1 for r in got)
    assert {r.name for r in files.walk(spark, str(tree), pattern="*.md").where("kind = 'file'").collect()} == {"kept.md"}


def test_an_unreadable_folder_fails_the_scan(spark, tree, monkeypatch):
    with pytest.raises(Exception, match="No such file|NotADirectory|Not a directory"):
        files.walk(spark, str(tree / "nothing"))
    assert files.walk(spark, str(tree / "empty")).count() == 0


def contents(spark, folder):
    read = spark.read.format("binaryFile").load(str(folder))
    return read.withColumn("extension", F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1)))


def test_what_is_cut_is_told(spark, tmp_path):
    (tmp_path / "long.txt").write_text("é" * 50)
    (tmp_path / "big.txt").write_text("x" * 2000)
    with zipfile.ZipFile(tmp_path / "some.docx", "w") as z:
        for n in range(4):
            z.writestr(f"m{n}.xml", f"<p>part{n}</p>")
    with zipfile.ZipFile(tmp_path / "names.zip", "w") as z:
        for n in range(5):
            z.writestr(f"n{n}", "")
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.text, r.left_out, r.detail) for r in files.extract_text(contents(spark, tmp_path), most_chars=20, most_bytes=1000, most_members=2, most_names=3).collect()}
    assert got["long.txt"] == ("truncated", "é" * 20, 30, "30 characters")
    assert got["big.txt"] == ("skipped", None, 2000, "2000 bytes")
    assert got["some.docx"] == ("truncated", "part0 part1", 2, "2 members")
    assert got["names.zip"] == ("truncated", "n0\nn1\nn2", 2, "2 names")


def test_a_file_that_takes_too_long_is_killed(spark, tmp_path, monkeypatch):
    child = files._Child(lambda extension, content: time.sleep(60) if extension == "slow" else ("extracted", None, content.decode(), 0))
    began = time.time()
    assert child(0.5, "slow", b"")[0] == "timeout" and time.time() - began < 20
    assert child(5, "txt", b"next") == ("extracted", None, "next", 0)  # a new process reads on
    child.stop()
    dying = files._Child(lambda *_: os._exit(1))
    assert dying(5, "txt", b"")[0] == "error"
    dying.stop()
