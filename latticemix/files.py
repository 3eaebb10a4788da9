"""Files that driver and executors share, below the shared folder."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import numpy as np


def _local(uri: str) -> str | None:
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def write_file(uri: str, parts) -> None:
    """Write byte strings as one file that appears whole or not at all.

    A repeated task writes the same bytes again, so the last rename wins.
    """
    local = _local(uri)
    if local is None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(os.path.dirname(path), recursive=True)
        with system.open_output_stream(path) as out:
            for part in parts:
                out.write(part)
        return
    os.makedirs(os.path.dirname(local), exist_ok=True)
    draft = f"{local}.{uuid.uuid4().hex}"
    with open(draft, "wb") as out:
        for part in parts:
            out.write(part)
    os.replace(draft, local)


def map_file(uri: str, dtype) -> np.ndarray:
    """The file as an array: memory-mapped, or read if the store can't be mapped."""
    local = _local(uri)
    if local is None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_stream(path) as stream:
            return np.frombuffer(stream.read(), dtype)
    if os.path.getsize(local) == 0:
        return np.empty(0, dtype)
    return np.memmap(local, dtype, mode="r")


def names_in(uri: str) -> list[str]:
    """Names of the files in a folder; none if it does not exist."""
    local = _local(uri)
    if local is not None:
        return sorted(os.listdir(local)) if os.path.isdir(local) else []
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)))


def read_bytes(uri: str) -> bytes:
    local = _local(uri)
    if local is None:
        return map_file(uri, np.uint8).tobytes()
    with open(local, "rb") as stream:
        return stream.read()
