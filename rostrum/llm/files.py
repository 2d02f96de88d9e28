"""Binary files in the shared folder, opened inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import zstandard
from pyarrow import fs


def open_out(path: str):
    """A stream that writes the new file ``path``."""
    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inner, compression=None)  # whatever the name ends in


def open_in(path: str):
    """A file that can be read at any offset."""
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def own_name(prefix: str, suffix: str) -> str:
    """A name that no other attempt of any task uses.

    What an attempt writes counts only if its rows reach the committed table
    that names the file; files of lost or doubled attempts stay unnamed.
    """
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{prefix}-{task.partitionId():06d}-{task.taskAttemptId()}{suffix}"


class FrameWriter:
    """Bytes in compressed frames, each with its length before it."""

    def __init__(self, path: str, frame: int = 1 << 20):
        self.out, self.frame, self.held, self.size = open_out(path), frame, bytearray(), 0

    def write(self, data: bytes) -> None:
        self.held += data
        self.size += len(data)
        if len(self.held) >= self.frame:
            self._flush()

    def _flush(self) -> None:
        packed = zstandard.compress(bytes(self.held), 1)
        self.out.write(len(packed).to_bytes(4, "little") + packed)
        self.held.clear()

    def close(self) -> None:
        if self.held:
            self._flush()
        self.out.close()


def frames(path: str) -> Iterator[bytes]:
    """The frames of a file by ``FrameWriter``, unpacked."""
    with open_in(path) as f:
        while head := f.read(4):
            yield zstandard.decompress(f.read(int.from_bytes(head, "little")))
