"""Small files and folders of any Hadoop file system, from the driver."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class File(NamedTuple):
    path: str
    size: int
    modified: int


def hadoop(path: str, spark: SparkSession | None = None):
    """The path and its file system."""
    sc = (spark or SparkSession.active()).sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    # without its checksum files, which know nothing of what other programs write
    return p, fs.getRaw() if p.toUri().getScheme() in (None, "file") and fs.getUri().getScheme() == "file" else fs


def _shown(path) -> str:
    """Local files by their plain path, all others by their URI."""
    return path.toUri().getPath() if path.toUri().getScheme() in (None, "file") else path.toString()


def shown(path: str) -> str:
    """The path as listings give it: with its scheme, unless it is local."""
    p, fs = hadoop(path)
    return _shown(fs.makeQualified(p))


def _file(status) -> File:
    return File(_shown(status.getPath()), int(status.getLen()), int(status.getModificationTime()))


def files_under(root: str) -> list[File]:
    """Every file below root, or root itself if it is a file, by path; nothing if it isn't there."""
    p, fs = hadoop(root)
    if not fs.exists(p):
        return []
    found, out = fs.listFiles(p, True), []
    while found.hasNext():
        out.append(_file(found.next()))
    return sorted(out)


def names_in(folder: str) -> list[str]:
    """Names of the files and folders right below a folder; none if it isn't there."""
    p, fs = hadoop(folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def is_folder(path: str) -> bool:
    p, fs = hadoop(path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def head(path: str, count: int | None = None) -> bytes | None:
    """The first bytes of a file (all without a count); None if it isn't there."""
    p, fs = hadoop(path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes() if count is None else stream.readNBytes(count))
    finally:
        stream.close()


def read_text(path: str) -> str | None:
    found = head(path)
    return None if found is None else found.decode()


def write_text(path: str, text: str) -> None:
    """Puts a small file in place whole."""
    (p, fs), (temp, _) = hadoop(path), hadoop(path + ".tmp")
    stream = fs.create(temp, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(p, False)
    if not fs.rename(temp, p):
        raise OSError(f"can't put {path} in place")


def remove(path: str) -> None:
    p, fs = hadoop(path)
    fs.delete(p, True)


def plain(uri):
    """A file name of Spark's _metadata.file_path (a string or a column) with one slash behind the scheme of local files."""
    return re.sub("^file:/+", "file:/", uri) if isinstance(uri, str) else F.regexp_replace(uri, "^file:/+", "file:/")


def uris(paths: list[str]) -> dict[str, str]:
    """Each path by its ``plain`` name in Spark's _metadata.file_path."""
    out = {}
    for path in paths:
        p, fs = hadoop(path)
        out[plain(fs.makeQualified(p).toUri().toString())] = path
    return out
