"""Command line: ``python -m bytecarve.cli SOURCE [options]``."""

from __future__ import annotations

import argparse
import sys
import time

from .functions.registry import GROUPS, SIGNATURES
from .operators.scan import CHUNK, parse_size


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="bytecarve", description="Recover files from raw bytes with Spark.")
    p.add_argument("source", nargs="?")
    p.add_argument("-o", "--output", default="carved")
    p.add_argument("-t", "--types")
    p.add_argument("-j", "--jobs", type=int, default=1, help="1: serial selection; other: parallel selection (0: all cores)")
    p.add_argument("--chunk", type=parse_size, default=CHUNK)
    p.add_argument("--align", type=parse_size, default=1)
    p.add_argument("--min-size", type=parse_size, default=0)
    p.add_argument("--max-size", type=parse_size, default=0)
    p.add_argument("--offset", type=parse_size, default=0)
    p.add_argument("--length", type=parse_size, default=0)
    for flag in ("no-skip", "no-dedup", "dry-run", "list-types", "parity"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.list_types:
        for s in SIGNATURES.values():
            print(f"{s.name:8} {s.description}")
        for name, types in GROUPS.items():
            print(f"{name:8} {','.join(types)}")
        return 0
    if not a.source:
        parser().print_usage(sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from .operators.sinks import manifest, write_files, write_manifest
    from .plans.carve import carve
    from .sources.readers import open_source

    try:
        source = open_source(a.source)
        spark = SparkSession.builder.appName("bytecarve").getOrCreate()
        began = time.time()
        records = carve(spark, a.source, a.types, "serial" if a.jobs == 1 or a.no_skip else "parallel", None if a.dry_run else a.output, chunk_size=max(a.chunk, 1 << 16), align=max(a.align, 1), skip_carved=not a.no_skip, min_size=a.min_size, max_size=a.max_size, start=a.offset, length=a.length, dedup=not a.no_dedup, parity=a.parity).persist()
        n, copies = records.count(), records.where("duplicate_of is not null").count()
    except (OSError, ValueError) as e:
        print(f"bytecarve: {e}", file=sys.stderr)
        return 2
    if not a.dry_run:
        write_files(records)
    took = time.time() - began
    if n or not a.dry_run:
        write_manifest(records, a.source, took, a.output)
    else:
        print(manifest(records, a.source, took), end="")
    if not a.quiet:
        print(f"{a.source}{source.describe()}: {n - copies} files, {copies} duplicates, {source.size / took / (1 << 20):.1f} MiB/s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
