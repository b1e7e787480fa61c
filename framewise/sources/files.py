"""Files of Python data sources: any file system that Arrow knows, and outputs that appear when a job commits."""

from __future__ import annotations

import heapq
import itertools
import json
import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import WriterCommitMessage


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path within it."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/(?!/)", uri)
    if scheme:
        uri = f"{scheme[1]}:///{uri[scheme.end() :]}"
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def listed(uri: str, ending: str) -> list[fs.FileInfo]:
    """The files with an ending in a folder and those below, or the one file; hidden names are left out."""
    system, path = opened(uri)
    own = system.get_file_info(path)
    if own.type == fs.FileType.File:
        return [own]
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    hidden = lambda f: any(p[:1] in "_." for p in f.path[len(path) :].strip("/").split("/"))
    return sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(ending) and not hidden(f)), key=lambda f: f.path)


#: Bytes that are read of a list at once, and folders that a commit looks at side by side.
CHUNK, FOLDERS = 16 << 10, 1024


@dataclass
class Written(WriterCommitMessage):
    """Where a task has listed the files that it has written; None if none."""

    path: str | None


class AttemptFiles:
    """A job's files: an attempt writes under a hidden name of its own, and a file gets its name when its task is done.

    A task that is lost half-way leaves hidden files only. What a task finished
    twice, or a job that never committed, has left is removed by the next commit.
    Tasks list their files in hidden files too, and the commit reads the lists side
    by side in order: it holds a piece of each, however many files there are.
    """

    def __init__(self, uri: str):
        self.uri, self.job, self._made = uri.rstrip("/"), uuid.uuid4().hex[:12], set()

    def begin(self, name: str):
        """A stream, and the call that ends it and gives the file its name."""
        system, root = opened(self.uri)
        part = f"{root}/_attempts/{self.job}/{name.replace('/', '!')}.{TaskContext.get().taskAttemptId()}"
        self._make(system, part.rpartition("/")[0])
        stream = system.open_output_stream(part, compression=None)

        def end() -> None:
            stream.close()
            final = f"{root}/{name}"
            self._make(system, final.rpartition("/")[0])
            system.move(part, final)

        return stream, end

    def _make(self, system: fs.FileSystem, folder: str) -> None:
        if folder not in self._made:
            system.create_dir(folder, recursive=True)
            self._made = {*self._made, folder} if len(self._made) < 4 else {folder}

    def done(self, written: list[tuple[str, int]]) -> Written:
        """List what the task has written: (name of a file below the folder, rows)."""
        if not written:
            return Written(None)
        system, root = opened(self.uri)
        context = TaskContext.get()
        path = f"{root}/_attempts/{self.job}/lists/{context.partitionId()}-{context.taskAttemptId()}"
        system.create_dir(path.rpartition("/")[0], recursive=True)
        with system.open_output_stream(path, compression=None) as out:
            for folder, name, n in sorted((*f.rpartition("/")[::2], n) for f, n in written):
                out.write(json.dumps([folder, name, n]).encode() + b"\n")
        return Written(path)

    def commit(self, messages: list[Written | None], trailer: tuple[str, Callable[[int], bytes]] | None = None) -> None:
        """Folder by folder, remove what no list names beside files that lists name, then write the trailer (its name, its bytes for the folder's rows)."""
        system, root = opened(self.uri)

        def tidy(folder: str, names: set[str], n: int) -> None:
            for f in system.get_file_info(fs.FileSelector(f"{root}/{folder}")):
                if f.type == fs.FileType.File and f.base_name not in names:
                    system.delete_file(f.path)
            if trailer:
                self.write(f"{folder}/{trailer[0]}", trailer[1](n))

        merged = heapq.merge(*(self._entries(system, m.path) for m in messages if m and m.path))
        folders = ((folder, [*own]) for folder, own in itertools.groupby(merged, lambda f: f[0]) if folder)
        with ThreadPoolExecutor(16) as pool:
            while some := [*itertools.islice(folders, FOLDERS)]:
                for _ in pool.map(lambda f: tidy(f[0], {name for _, name, _ in f[1]}, sum(n for _, _, n in f[1])), some):
                    pass
        self.clear()

    def _entries(self, system: fs.FileSystem, path: str) -> Iterator[tuple[str, str, int]]:
        """A list's entries; no file stays open meanwhile."""
        at, rest = 0, b""
        while True:
            with system.open_input_file(path) as stream:
                stream.seek(at)
                data = stream.read(CHUNK)
            if not data:
                return
            at += len(data)
            *lines, rest = (rest + data).split(b"\n")
            yield from (tuple(json.loads(line)) for line in lines)

    def clear(self) -> None:
        system, root = opened(self.uri)
        if system.get_file_info(f"{root}/_attempts/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_attempts/{self.job}")

    def write(self, name: str, data: bytes) -> None:
        system, root = opened(self.uri)
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(data)
