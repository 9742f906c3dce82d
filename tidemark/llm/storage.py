"""Range reads and streamed writes in the shared folder, from Python workers."""

from __future__ import annotations

import uuid
from collections import OrderedDict

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """A path without a scheme is a local one."""
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


class Writer:
    """A new file in a folder. Each task attempt writes files of its own, so a retried task spoils nothing."""

    def __init__(self, folder: str, suffix: str):
        system, path = opened(folder)
        self.uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
        self.stream = system.open_output_stream(f"{path}/{self.uri.rpartition('/')[2]}", compression=None)
        self.at = 0

    def write(self, data: bytes) -> int:
        """Append; the offset that data begins at."""
        start, self.at = self.at, self.at + len(data)
        self.stream.write(data)
        return start

    def close(self) -> None:
        self.stream.close()


class Reader:
    """Range reads; keeps a few files open."""

    def __init__(self, most: int = 32):
        self.files: OrderedDict = OrderedDict()
        self.most = most

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri in self.files:
            self.files.move_to_end(uri)
        else:
            system, path = opened(uri)
            self.files[uri] = system.open_input_file(path)
            if len(self.files) > self.most:
                self.files.popitem(last=False)[1].close()
        return self.files[uri].read_at(length, offset)

    def size(self, uri: str) -> int:
        self.read(uri, 0, 0)
        return self.files[uri].size()

    def close(self) -> None:
        while self.files:
            self.files.popitem()[1].close()
