"""Files in the shared folder, written and read by executors' Python through pyarrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def split(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Writer:
    """A file that gets its name only when it is whole: a task that is run again replaces it."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = split(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.temporary)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> int:
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return self.size


def reader(uri: str):
    """A seekable input file."""
    f, path = split(uri)
    return f.open_input_file(path)
