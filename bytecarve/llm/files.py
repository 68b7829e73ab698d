"""Whole files in a folder that all executors share (any file system that pyarrow knows)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write under a name of its own, then rename: a task that runs again leaves one whole file."""
    system, path = _open(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part, compression=None) as out:
        out.write(data)
    system.move(part, path)


def read_file(uri: str) -> bytes:
    system, path = _open(uri)
    with system.open_input_stream(path, compression=None) as stream:  # the bytes as they are, whatever the name says
        return stream.read()


def open_file(uri: str):
    """A file for random access, to be closed by its user."""
    system, path = _open(uri)
    return system.open_input_file(path)
