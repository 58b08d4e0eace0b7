"""Files of the data sources: local paths and the stores that Arrow knows by their addresses."""

from __future__ import annotations

from pyarrow import fs


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it)."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed(path: str, *endings: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The file itself, or all files below a folder with one of the endings, but for those in or of names
    that begin with an underscore."""
    store, where = store_of(path)
    info = store.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return store, [info]
    below = store.get_file_info(fs.FileSelector(where, recursive=True))
    kept = [x for x in below if x.is_file and x.path.lower().endswith(endings) and not any(p.startswith("_") for p in x.path[len(where) :].split("/"))]
    return store, sorted(kept, key=lambda x: x.path)
