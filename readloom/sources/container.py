"""Files that may be compressed: told by their first bytes, gzip opened, all other containers refused."""

from __future__ import annotations

import gzip
import io
import os
import zlib
from typing import BinaryIO

from readloom.errors import IO, EngineError
from readloom.functions.records import EXTENSIONS
from readloom.sources import store

#: How containers begin.
MAGICS = {b"\x1f\x8b": "gzip", b"BZh": "bzip2", bytes.fromhex("fd377a585a00"): "xz", bytes.fromhex("28b52ffd"): "zstd"}


def sniff(head: bytes) -> str:
    return next((name for m, name in MAGICS.items() if head.startswith(m)), "none")


def by_extension(path: str) -> str:
    return EXTENSIONS.get(os.path.splitext(path)[1][1:].lower(), "none")


class Inflated(io.RawIOBase):
    """All members of a gzip stream; truncated or other bytes among them are an I/O error, never an early end."""

    def __init__(self, raw: BinaryIO):
        self.file = gzip.GzipFile(fileobj=raw)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        try:
            data = self.file.read(len(buffer))
        except (OSError, EOFError, zlib.error) as e:
            raise EngineError(IO, f"bad gzip data: {e}") from None
        buffer[: len(data)] = data
        return len(data)


def container(path: str) -> tuple[str, int]:
    """The container of a file and its size. Of a file of a single byte the extension tells."""
    size = store.size(path)
    with store.opened(path) as f:
        head = f.read(8)
    return (by_extension(path) if size == 1 else sniff(head)), size


def opened(path: str) -> BinaryIO:
    kind, _ = container(path)
    if kind not in ("none", "gzip"):
        raise EngineError(IO, f"{path}: {kind} is not supported")
    f = store.opened(path)
    return io.BufferedReader(Inflated(f), 1 << 20) if kind == "gzip" else f


def spooled(stream: BinaryIO, path: str) -> None:
    """Standard input as a file, which then is sniffed like any other."""
    with open(path, "wb") as f:
        while data := stream.read(1 << 20):
            f.write(data)
