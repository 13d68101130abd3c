"""Binary files in the shared folder, on any file system that pyarrow opens; local ones are memory-mapped."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    system, path = _open(uri)
    system.create_dir(path, recursive=True)


@contextmanager
def committed(uri: str):
    """A stream whose content appears under uri, whole, when the block ends; a task that dies or runs twice leaves no part of it."""
    system, path = _open(uri)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with system.open_output_stream(part) as out:
            yield out
        try:
            system.move(part, path)
        except OSError:  # some systems don't replace; what is there is a finished copy of the same content
            system.delete_file(part)
    except BaseException:
        try:
            system.delete_file(part)
        except OSError:
            pass
        raise


def numbers(uri: str, dtype: str, start: int = 0, count: int | None = None) -> np.ndarray:
    """count numbers of a flat file from the start-th on, all by default: mapped where the file is local, else this range of it is read."""
    from pyarrow import fs

    system, path = _open(uri)
    size = np.dtype(dtype).itemsize
    n = system.get_file_info(path).size // size - start if count is None else count
    if n <= 0:
        return np.empty(0, dtype)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r", offset=start * size, shape=(n,))
    return np.frombuffer(read_range(uri, start * size, n * size), dtype)


def read_range(uri: str, start: int, size: int) -> bytes:
    system, path = _open(uri)
    with system.open_input_file(path) as f:
        f.seek(start)
        return f.read(size)


def file_size(uri: str) -> int:
    system, path = _open(uri)
    return system.get_file_info(path).size
