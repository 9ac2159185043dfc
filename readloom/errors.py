"""Errors with the codes that the command line exits with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUCCESS, USAGE, IO, FORMAT, CHECKSUM, UNSUPPORTED, INTERNAL = 0, 1, 2, 3, 4, 5, 17

#: code: name, exit code.
NAMES = {
    SUCCESS: ("success", 0),
    USAGE: ("usage error", 1),
    IO: ("I/O error", 2),
    FORMAT: ("format error", 3),
    CHECKSUM: ("checksum error", 4),
    UNSUPPORTED: ("unsupported codec", 5),
    INTERNAL: ("internal error", 3),
}


class EngineError(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(f"{NAMES[code][0]}: {message}")
        self.code, self.message = code, message

    def __reduce__(self):
        return EngineError, (self.code, self.message)

    @property
    def exit_code(self) -> int:
        return NAMES[self.code][1]


def from_exception(e: BaseException) -> EngineError:
    """The engine's error in an exception, also where a task raised it and Spark passed its text on."""
    if isinstance(e, EngineError):
        return e
    text = str(e)
    for code, (name, _) in NAMES.items():
        if (mark := f"EngineError: {name}: ") in text:
            return EngineError(code, text.split(mark, 1)[1].split("\n", 1)[0])
    return EngineError(INTERNAL, text.split("\n", 1)[0])


def name_of(code: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, (n, _) in NAMES.items() for x in (F.lit(k), F.lit(n))]), code)


def exit_code_of(code: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, (_, n) in NAMES.items() for x in (F.lit(k), F.lit(n))]), code)
