"""Files by path or URI, for data sources whose tasks read and write by themselves (``pyarrow.fs`` knows the stores)."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs


#: Partitions that a data source makes at most for the sake of its smallest share; larger inputs get larger shares.
MOST_PARTS = 2_000


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it; ``file:`` may have any number of slashes."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def listed(path: str, endings: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """(path, size) of the files below a folder that have one of the endings, or of the one file, in the order of paths."""
    fs, at = place(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at, recursive=True))
    front = path[: len(path) - len(at)] if path.endswith(at) else "file:" if path.startswith("file:") else ""
    return sorted((front + f.path, f.size) for f in found if f.type == pafs.FileType.File and (not endings or f.extension.lower() in endings))


def opened(path: str) -> pa.NativeFile:
    fs, at = place(path)
    return fs.open_input_file(at)


def put(path: str, data: bytes) -> None:
    """Writes a file beside its place and moves it there, so that a task that runs again does no harm."""
    fs, at = place(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(beside := f"{at}.{uuid.uuid4().hex}.part") as f:
        f.write(data)
    fs.move(beside, at)
