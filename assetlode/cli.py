"""The command line: ``python -m assetlode.cli --scan-exact FOLDER`` or ``--scan-qc FOLDER`` with the checks to make."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from assetlode.plans.params import QcParams, ScanParams, scan
from assetlode.sources import scan as scanning

EXTENSIONS = ("png", "jpg", "jpeg", "tga", "dds", "exr", "hdr", "tif", "tiff")
CHECKS = {"check_npot": "npot", "check_mipmaps": "mipmaps", "check_block": "block_align", "check_bit": "bit_depth"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="assetlode", description="Audits a folder of textures.")
    kind = out.add_mutually_exclusive_group(required=True)
    kind.add_argument("--scan-exact", metavar="FOLDER", help="files with the same bytes")
    kind.add_argument("--scan-qc", metavar="FOLDER", help="technical quality rules")
    out.add_argument("--check-npot", action="store_true", help="sides that are no powers of two")
    out.add_argument("--check-mipmaps", action="store_true", help="missing mipmaps")
    out.add_argument("--check-block", action="store_true", help="sides that aren't divisible by four")
    out.add_argument("--check-bit", action="store_true", help="more than eight bits a channel")
    return out


def print_exact(spark: SparkSession, folder: str, say: Callable[[str], None]) -> int:
    p = ScanParams(folder=folder, extensions=EXTENSIONS)
    shape = scanning.metadata(scanning.files(spark, folder, list(EXTENSIONS), [], contents=True)).select("path", "width", "height")
    rows = scan(spark, p).groups.join(shape, "path").orderBy("content_hash", "rank")
    number, last = 0, None
    for r in rows.toLocalIterator():
        if r["content_hash"] != last:
            number, last = number + 1, r["content_hash"]
            say(f"Group #{number} (Hash: {last})")
        say(f"  - {r['path']} (Size: {r['file_size']} bytes, Dim: {r['width']}x{r['height']})")
    say(f"{number} duplicate groups")
    return number


def print_qc(spark: SparkSession, folder: str, checks: dict[str, bool], say: Callable[[str], None]) -> int:
    p = ScanParams(folder=folder, method="qc", extensions=EXTENSIONS, qc=QcParams(**checks, color_space=True))
    number = 0
    for r in scan(spark, p).issues.orderBy("path", "issue").toLocalIterator():
        number += 1
        say(f"- File: {r['path']}\n  Issue: {r['issue']}\n  Details: {r['details']}")
    say(f"{number} issues")
    return number


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, say: Callable[[str], None] = print) -> int:
    """0 after a scan, 1 where the folder can't be read."""
    asked = parser().parse_args(arguments)
    session = spark or SparkSession.builder.appName("assetlode").getOrCreate()
    try:
        if asked.scan_exact:
            print_exact(session, asked.scan_exact, say)
        else:
            print_qc(session, asked.scan_qc, {field: getattr(asked, flag) for flag, field in CHECKS.items()}, say)
    except NotADirectoryError as e:
        print(f"no folder: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
