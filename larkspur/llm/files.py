"""Raw files in the shared folder, from Python workers: written whole or not at all, read as memory maps."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def write_file(uri: str, data: bytes) -> None:
    """Written under another name first; a retried task writes the same bytes again."""
    temporary = f"{uri}.{uuid.uuid4().hex}"
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(temporary), "wb") as file:
            file.write(data)
        os.replace(_local(temporary), path)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(temporary)
    with store.open_output_stream(at) as file:
        file.write(data)
    store.move(at, fs.FileSystem.from_uri(uri)[1])


def map_file(uri: str) -> np.ndarray | None:
    """The file's bytes as a memory map, or None if there is none. From a store without paths it is fetched first to a
    local file that is unlinked at once, so nothing stays behind."""
    if path := _local(uri):
        if not os.path.exists(path):
            return None
        return np.memmap(path, dtype=np.uint8, mode="r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    if store.get_file_info(at).type == fs.FileType.NotFound:
        return None
    with tempfile.TemporaryFile() as copy, store.open_input_stream(at) as file:
        while block := file.read(1 << 22):
            copy.write(block)
        copy.flush()
        return np.memmap(copy, dtype=np.uint8, mode="r") if copy.tell() else np.zeros(0, np.uint8)
