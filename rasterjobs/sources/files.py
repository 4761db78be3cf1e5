"""Whole files and byte ranges in the cluster's file systems, from inside tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, data: bytes) -> None:
    """One file; folders above it are made."""
    system, path = located(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)


def ranges(uri: str) -> tuple[Callable[[int, int], bytes], int]:
    """(read(offset, length), size) of a file of any size; only what is asked for is read."""
    system, path = located(uri)
    file = system.open_input_file(path)
    return (lambda at, n: file.read_at(n, at)), file.size()
