"""Files that tasks write to the shared folder and read back, on any file system Arrow knows."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, data: bytes) -> str:
    """Write data below folder under a name that no other attempt uses; its URI.

    A retried or speculative task leaves a file of its own that no manifest names.
    """
    system, root = _open(folder)
    stem, dot, ending = name.partition(".")
    leaf = f"{stem}-{uuid.uuid4().hex[:12]}{dot}{ending}"
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{leaf}", compression=None) as out:
        out.write(data)
    return f"{folder}/{leaf}"


def read_file(uri: str) -> bytes:
    system, path = _open(uri)
    with system.open_input_stream(path, compression=None) as source:
        return source.read()
