"""Column expressions over reads: id, comment, sequence, quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters of a sequence, and what stands for a base in two bits.
ALPHABET = "ACGTRYSWKMBDHVNacgtryswkmbdhvn"
BASES = "ACGT"
#: Bytes that a read costs in a frame beside its text, which is four string headers of 24 bytes.
READ_OVERHEAD = 96
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Substrings of a lower-case header that tell a platform.
ONT_MARKS = ("runid=", " ch=", "channel=")
HIFI_MARKS = ("/ccs", "hifi")
CLR_MARKS = ("pacbio", "subread")
PROFILES = {1: "illumina", 2: "ont", 3: "pacbio-hifi", 4: "pacbio-clr"}

#: Extensions of containers.
EXTENSIONS = {"gz": "gzip", "gzip": "gzip", "bz2": "bzip2", "bzip2": "bzip2", "xz": "xz", "lzma": "xz", "zst": "zstd", "zstd": "zstd"}


def trim_cr(line: Column) -> Column:
    """A line without one trailing CR."""
    return F.regexp_replace(line, r"\r\z", "")


def header_id(header: Column) -> Column:
    """What comes before the first blank."""
    return F.when(F.instr(header, " ") > 0, F.substring(header, F.lit(1), F.instr(header, " ") - 1)).otherwise(header)


def header_comment(header: Column) -> Column:
    """From the first blank on, itself included; empty if there is none."""
    return F.when(F.instr(header, " ") > 0, F.substring(header, F.instr(header, " "), F.length(header))).otherwise("")


def record_length() -> Column:
    return F.length("sequence").cast("long")


def text_bytes() -> Column:
    return (F.length("id") + F.length("comment") + F.length("sequence") + F.length("quality")).cast("long")


def canonical_bytes() -> Column:
    """Size of the rendered record."""
    return text_bytes() + 6


def framing_cost() -> Column:
    return text_bytes() + READ_OVERHEAD + 4


def rendered() -> Column:
    return F.concat(F.lit("@"), "id", "comment", F.lit("\n"), "sequence", F.lit("\n+\n"), "quality", F.lit("\n"))


def header() -> Column:
    """A-Z of id and comment lowered, and nothing else, whatever the bytes."""
    return F.translate(F.concat("id", "comment"), UPPER, UPPER.lower())


def any_mark(text: Column, marks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in marks:
        found = found | F.contains(text, F.lit(m))
    return found


def is_insdc() -> Column:
    return F.col("id").rlike(r"\A[sSeEdD][rR][rR][0-9]")


def is_ont() -> Column:
    return any_mark(header(), ONT_MARKS)


def is_hifi() -> Column:
    return any_mark(header(), HIFI_MARKS)


def is_clr() -> Column:
    slashes = F.length("id") - F.length(F.replace("id", F.lit("/"), F.lit("")))
    return any_mark(header(), CLR_MARKS) | (F.startswith("id", F.lit("m")) & (slashes >= 2) & ~is_hifi())


def valid_sequence() -> Column:
    return F.col("sequence").rlike(rf"\A[{ALPHABET}]+\z")


def valid_quality() -> Column:
    return F.col("quality").rlike(r"\A[!-~]*\z")


def valid_shape() -> Column:
    return (F.length("id") > 0) & (F.length("sequence") > 0) & (F.length("sequence") == F.length("quality")) & ~F.col("id").rlike(r"[ \r\n]") & ~F.col("comment").rlike(r"[\r\n]")


def has_exceptions() -> Column:
    """Whether a letter is none of the four that two bits hold."""
    return F.col("sequence").rlike("[^ACGT]")


def reject_reason() -> Column:
    """The first check that a record fails, null if none."""
    return F.when(~valid_shape(), "shape").when(~valid_sequence(), "sequence").when(~valid_quality(), "quality")


def asserted() -> Column:
    """True, or an error that ends the job at the first bad record."""
    return F.when(reject_reason().isNull(), True).otherwise(F.raise_error(F.concat(F.lit("EngineError: usage error: bad "), reject_reason(), F.lit(" of record "), F.col("id"))).cast("boolean"))


def profile_name(code: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, n in PROFILES.items() for x in (F.lit(k), F.lit(n))]), code)


def profile_code(name: Column) -> Column:
    """Null for any other name, auto included."""
    return F.element_at(F.create_map(*[x for k, n in PROFILES.items() for x in (F.lit(n), F.lit(k))]), name)


def extension_format(path: Column) -> Column:
    """The container that a path's extension names, in any case; none without one."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)\z", 1))
    return F.coalesce(F.element_at(F.create_map(*[x for k, n in EXTENSIONS.items() for x in (F.lit(k), F.lit(n))]), ext), F.lit("none"))


def format_supported(name: Column) -> Column:
    return name.isin("none", "gzip")
