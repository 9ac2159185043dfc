"""Files by path or by address: a plain path is a disk that driver and tasks share, an address (s3://, gs://, hdfs://, file://) any store that pyarrow opens.

Tasks open inputs themselves, so this is no matter of the driver's disk. Nothing here holds a file as a whole.
"""

from __future__ import annotations

import io
import os
import shutil
from typing import BinaryIO

from readloom.errors import IO, EngineError


def _placed(path: str):
    """A file system of pyarrow's and the path in it; None for a plain path."""
    if "://" not in path:
        return None, path
    from pyarrow import ArrowException, fs

    try:
        return fs.FileSystem.from_uri(path)
    except (ArrowException, OSError, ValueError) as e:
        raise EngineError(IO, f"{path}: {e}") from None


def size(path: str) -> int:
    fs, at = _placed(path)
    try:
        if fs is None:
            return os.path.getsize(at)
        info = fs.get_file_info(at)
    except OSError as e:
        raise EngineError(IO, f"{path}: {e.strerror or e}") from None
    if not info.is_file:
        raise EngineError(IO, f"{path}: no such file")
    return info.size


def opened(path: str) -> BinaryIO:
    """For reading, with seek and tell."""
    fs, at = _placed(path)
    try:
        return open(at, "rb", buffering=1 << 20) if fs is None else io.BufferedReader(_Raw(fs.open_input_file(at)), 1 << 20)
    except OSError as e:
        raise EngineError(IO, f"{path}: {e.strerror or e}") from None


class _Raw(io.RawIOBase):
    """A file of pyarrow's with what io.BufferedReader needs."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        return self.file.seek(at, whence)

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()


def exists(path: str) -> bool:
    fs, at = _placed(path)
    return os.path.exists(at) if fs is None else fs.get_file_info(at).is_file


def created(path: str) -> BinaryIO:
    fs, at = _placed(path)
    return open(at, "wb") if fs is None else fs.open_output_stream(at)


def moved(path: str, to: str) -> None:
    fs, at = _placed(path)
    os.replace(at, to) if fs is None else fs.move(at, _placed(to)[1])


def removed(path: str) -> None:
    """A file or a folder, if it's there."""
    fs, at = _placed(path)
    if fs is None:
        shutil.rmtree(at, ignore_errors=True) if os.path.isdir(at) else os.path.exists(at) and os.unlink(at)
    elif (info := fs.get_file_info(at)).is_file:
        fs.delete_file(at)
    elif info.type.name == "Directory":
        fs.delete_dir(at)


def parts(folder: str) -> list[str]:
    """The part files of a folder, in the order of their names."""
    fs, at = _placed(folder)
    if fs is None:
        return sorted(f"{at}/{x}" for x in os.listdir(at) if x.startswith("part-"))
    from pyarrow.fs import FileSelector

    scheme = folder.split("://", 1)[0]
    return sorted(f"{scheme}://{x.path}" for x in fs.get_file_info(FileSelector(at)) if x.base_name.startswith("part-"))


def address(path: str) -> str:
    """What Spark calls it."""
    return path if "://" in path else f"file://{os.path.abspath(path)}"


def appended(out: BinaryIO, path: str) -> None:
    """A file's bytes to an open one: by the system where both are plain files."""
    with opened(path) as f:
        try:
            to, own, left = out.fileno(), f.fileno(), os.fstat(f.fileno()).st_size
        except (OSError, AttributeError, io.UnsupportedOperation):
            shutil.copyfileobj(f, out, 1 << 20)
            return
        out.flush()
        at = 0
        while left > at and (n := os.sendfile(to, own, at, left - at)):
            at += n
