"""Files that Python workers write and read in the shared folder, whatever its file system."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.compute as pc
from pyarrow import dataset, fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path within it."""
    return fs.FileSystem.from_uri(uri)


def ensure_dir(uri: str) -> None:
    """Create a folder and those above it."""
    system, path = opened(uri)
    system.create_dir(path, recursive=True)


class AtomicFile:
    """A file that appears under its name only when complete.

    Each attempt writes under a name of its own and renames it at the end, so a
    task that is run twice, or lost half-way, never leaves a torn file.
    """

    def __init__(self, uri: str, attempt: str):
        self.system, self.path = opened(uri)
        self.part = f"{self.path}.{attempt}.part"
        self.stream = self.system.open_output_stream(self.part)

    def __enter__(self):
        return self.stream

    def __exit__(self, kind, value, trace):
        self.stream.close()
        if kind is None:
            self.system.move(self.part, self.path)
        else:
            self.system.delete_file(self.part)


def parquet_rows(uri: str, where: pc.Expression | None = None) -> Iterator[dict]:
    """The rows of a written table that meet a condition, one at a time, by the order of its files' names."""
    system, path = opened(uri)
    found = sorted(f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))
    for name in found:
        data = dataset.dataset(name, filesystem=system, format="parquet")
        for batch in data.to_batches(filter=where, batch_size=1, use_threads=False, batch_readahead=0, fragment_readahead=0):
            yield from batch.to_pylist()


def read_stream(uri: str):
    """A readable stream over one file."""
    system, path = opened(uri)
    return system.open_input_stream(path, compression=None)


def read_file(uri: str):
    """A seekable file."""
    system, path = opened(uri)
    return system.open_input_file(path)
