"""The command line: compress, decompress, verify."""

from __future__ import annotations

import argparse
import logging
import sys

from readloom import __version__
from readloom.errors import EngineError


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--memory-limit", type=int, default=argparse.SUPPRESS, metavar="MiB")
    common.add_argument("-q", "--quiet", action="store_true", default=argparse.SUPPRESS)
    top = argparse.ArgumentParser(prog="readloom", description=__doc__, parents=[common])
    top.add_argument("-V", "--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compress", aliases=["c"], parents=[common])
    c.add_argument("-i", "-1", "--input", required=True)
    c.add_argument("-2", "--mate")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--profile", default="auto", choices=["auto", "illumina", "ont", "pacbio-hifi", "pacbio-clr"])
    c.add_argument("--frame-mib", type=int, default=64)
    c.add_argument("--quality-level", type=int, default=1, choices=range(1, 20))
    c.add_argument("--parse-workers", type=int, default=4, choices=range(65))
    c.add_argument("--split-pairs", action="store_true", help="cut plain pairs into byte ranges, as unpaired files are")
    c.add_argument("-f", "--force", action="store_true")
    d = sub.add_parser("decompress", aliases=["d", "x"], parents=[common])
    d.add_argument("-i", "--input", required=True)
    d.add_argument("-o", "--output", required=True)
    d.add_argument("-f", "--force", action="store_true")
    v = sub.add_parser("verify", aliases=["v"], parents=[common])
    v.add_argument("input", nargs="?")
    v.add_argument("-i", "--input", dest="named")
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    logging.basicConfig(stream=sys.stderr, format="[%(levelname).3s] %(message)s", level=logging.ERROR if getattr(a, "quiet", False) else logging.INFO)
    logging.getLogger("py4j").setLevel(logging.ERROR)
    log = logging.getLogger("readloom")
    from readloom.plans import commands as k
    from readloom.session import session

    try:
        memory = k.mib(a.memory_limit) if hasattr(a, "memory_limit") else k.codec.DEFAULT_MEMORY
        run = {"c": "compress", "d": "decompress", "x": "decompress", "v": "verify"}.get(a.command, a.command)
        if run == "compress":
            q = k.CompressRequest(memory, a.input, a.output, a.mate, a.profile, k.mib(a.frame_mib), a.quality_level, a.parse_workers, a.force, a.split_pairs)
        elif run == "decompress":
            q = k.DecompressRequest(memory, a.input, a.output, a.force)
        else:
            if not (path := a.named or a.input):
                raise EngineError(1, "verify needs an input")
            q = k.VerifyRequest(memory, path)
        q.check()
        s = getattr(k, run)(spark or session(), q)
        log.info("%s: %s, %d frames, %d records, %d bases, %d -> %d bytes", run, s.profile + (", paired" if s.paired else ""), s.frames, s.records, s.bases, s.input_bytes, s.output_bytes)
        return 0
    except EngineError as e:
        log.error("%s", e)
        return e.exit_code
    except Exception as e:  # whatever else breaks is a failure of the data
        log.error("%s", e)
        return 3


if __name__ == "__main__":
    sys.exit(main())
