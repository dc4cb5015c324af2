"""Flat files in the shared folder: written by tasks, memory-mapped by readers."""

from __future__ import annotations

import os
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs


def local(url: str) -> str | None:
    """A path for ``open``, if the folder is mounted here."""
    return url.removeprefix("file://") if url.startswith("file://") else url.removeprefix("file:") if url.startswith("file:") else url if url.startswith("/") else None


@contextmanager
def writer(url: str):
    if path := local(url):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            yield f
    else:
        fs, path = pafs.FileSystem.from_uri(url)
        fs.create_dir(os.path.dirname(path), recursive=True)
        with fs.open_output_stream(path) as f:
            yield f


class Mapped:
    """A file, read by ranges: views of the mapped file where it is mounted, else
    no more than what is asked for is fetched."""

    def __init__(self, url: str) -> None:
        if path := local(url):
            self.file = pa.memory_map(path)
        else:
            fs, path = pafs.FileSystem.from_uri(url)
            self.file = fs.open_input_file(path)

    def size(self) -> int:
        return self.file.size()

    def read(self, start: int = 0, size: int | None = None) -> pa.Buffer:
        self.file.seek(start)
        return self.file.read_buffer(self.size() - start if size is None else size)

    def close(self) -> None:
        self.file.close()


def read_file(url: str) -> pa.Buffer:
    """The whole file."""
    return Mapped(url).read()
