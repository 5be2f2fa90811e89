"""Binary files in the shared folder, opened from executors: local paths, file:// and any store pyarrow reaches."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


def _remote(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


@contextmanager
def writing(path: str):
    """A file that appears under its name only when it is whole; a repeated attempt replaces it."""
    own = f"{path}.{uuid.uuid4().hex}.part"
    local = _local(own)
    if local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "wb") as f:
            yield f
        os.replace(local, _local(path))
    else:
        fs, at = _remote(own)
        with fs.open_output_stream(at) as f:
            yield f
        fs.move(at, _remote(path)[1])


def reading(path: str):
    local = _local(path)
    if local:
        return open(local, "rb")
    fs, at = _remote(path)
    return fs.open_input_file(at)


def delete(path: str) -> None:
    local = _local(path)
    if local:
        os.unlink(local)
    else:
        fs, at = _remote(path)
        fs.delete_file(at)
