"""Files that tasks write and read themselves, below the shared folder, by any file system Arrow knows."""

from __future__ import annotations

from pyarrow import fs


def open_at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; plain paths are local ones."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def make_folder(path: str) -> None:
    system, inner = open_at(path)
    system.create_dir(inner, recursive=True)
