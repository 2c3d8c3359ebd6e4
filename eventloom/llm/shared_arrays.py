"""Arrays in the shared folder: written once by a task, memory-mapped by all workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np


def local_path(uri: str) -> str | None:
    """The path of a folder that every machine has mounted; None if it is in a remote store."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        return None
    return unquote(parts.path)


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    """Write ``folder/name.npy`` in one step: a task that runs twice leaves the same file."""
    here = local_path(folder)
    if here is not None:
        os.makedirs(here, exist_ok=True)
        part = f"{here}/.{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            np.save(out, values)
        os.replace(part, f"{here}/{name}.npy")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        np.save(out, values)
    store.move(part, f"{path}/{name}.npy")


def map_array(folder: str, name: str) -> np.ndarray | None:
    """The array mapped into memory; None if no task wrote it. A remote file is copied first."""
    here = local_path(folder)
    if here is not None:
        try:
            return np.load(f"{here}/{name}.npy", mmap_mode="r")
        except FileNotFoundError:
            return None
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{path}/{name}.npy").type == fs.FileType.NotFound:
        return None
    with tempfile.TemporaryFile() as copy, store.open_input_stream(f"{path}/{name}.npy") as source:
        while block := source.read(1 << 22):
            copy.write(block)
        copy.flush()
        copy.seek(0)
        version = np.lib.format.read_magic(copy)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, _, kind = read(copy)
        return np.memmap(copy, kind, "r", copy.tell(), shape) if shape[0] else np.zeros(shape, kind)
