"""Files in the shared folder, written and read by tasks through pyarrow's file systems."""

from __future__ import annotations

import posixpath
import uuid

from pyarrow import fs


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def open_new(folder: str, name: str):
    """(stream, uri) of a new file. The name is unique to the attempt: a task that runs twice leaves two
    files, and only the one named in the committed manifest is read."""
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    unique = f"{name}-{uuid.uuid4().hex}"
    return system.open_output_stream(posixpath.join(path, unique)), f"{folder}/{unique}"


def read_range(uri: str, start: int, size: int) -> bytes:
    system, path = file_system(uri)
    with system.open_input_file(path) as f:
        f.seek(start)
        return f.read(size)
