"""Files of the shared folder that workers write and map: local paths are mapped, other stores are read through Arrow."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Output:
    """A file that has its name only when it is complete, so a repeated or lost task leaves nothing half-written."""

    def __init__(self, uri: str):
        self.files, self.path = store(uri)
        self.files.create_dir(os.path.dirname(self.path), recursive=True)
        self.draft = f"{self.path}.{uuid.uuid4().hex}.draft"
        self.stream = self.files.open_output_stream(self.draft, compression=None)

    def write(self, data) -> None:
        self.stream.write(np.ascontiguousarray(data).data if isinstance(data, np.ndarray) else data)

    def __enter__(self) -> Output:
        return self

    def __exit__(self, kind, *_) -> None:
        self.stream.close()
        if kind is None:
            self.files.move(self.draft, self.path)
        else:
            self.files.delete_file(self.draft)


def read(uri: str, dtype) -> np.ndarray:
    """The numbers of a file, as a map of it where it is local."""
    files, path = store(uri)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype=dtype)
    with files.open_input_stream(path, compression=None) as stream:
        return np.frombuffer(stream.read(), dtype=dtype)
