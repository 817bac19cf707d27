"""Array files in the shared folder: written whole or not at all, read as memory maps where the folder is mounted."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow.fs as pafs


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    fs, path = _at(uri)
    fs.create_dir(path, recursive=True)


@contextmanager
def writing(uri: str):
    """A stream to a new file. A second attempt of a task writes the same file again; readers see a complete file only."""
    fs, path = _at(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part, compression=None) as out:
        yield out
    fs.move(part, path)


def save_bytes(uri: str, parts: list[bytes]) -> None:
    with writing(uri) as out:
        for x in parts:
            out.write(x)


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    facts, at, parts = [], 0, []
    for name, array in arrays.items():
        data = np.ascontiguousarray(array).tobytes()
        data += bytes(-len(data) % 8)
        facts.append([name, array.dtype.str, array.size, at])
        parts.append(data)
        at += len(data)
    head = json.dumps(facts).encode()
    head += b" " * (-len(head) % 8)
    save_bytes(uri, [len(head).to_bytes(8, "little"), head, *parts])


def read_bytes(uri: str, start: int = 0, size: int | None = None) -> np.ndarray:
    fs, path = _at(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        whole = np.memmap(path, np.uint8, "r")
        return whole[start : len(whole) if size is None else start + size]
    with fs.open_input_file(path) as f:
        f.seek(start)
        return np.frombuffer(f.read(size), np.uint8)


def load(uri: str) -> dict[str, np.ndarray]:
    data = read_bytes(uri)
    body = 8 + int.from_bytes(data[:8].tobytes(), "little")
    out = {}
    for name, kind, n, at in json.loads(data[8:body].tobytes()):
        dtype = np.dtype(kind)
        out[name] = np.frombuffer(data, dtype, n, body + at) if n else np.zeros(0, dtype)
    return out
