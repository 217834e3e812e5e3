"""Command line: scan a tree and write its document."""

from __future__ import annotations

import argparse
import logging
import sys

from loamline.config import CouplingConfig, ScanConfig


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loamline", description="Indicators of a source tree and its history, as one JSON document.")
    p.add_argument("root", nargs="?", default=".")
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("-o", "--output", help="write here instead of to standard output")
    p.add_argument("--parquet", help="also write the flat nodes to this folder")
    p.add_argument("-n", "--name")
    p.add_argument("--id")
    p.add_argument("--years", type=int, default=3, help="how many years of history to read")
    p.add_argument("--no-git", action="store_true")
    p.add_argument("--no-detailed-git", action="store_true")
    p.add_argument("--no-file-stats", action="store_true")
    p.add_argument("--follow-symlinks", action="store_true")
    p.add_argument("-c", "--coupling", action="store_true")
    p.add_argument("--bucket-days", "--coupling-bucket-days", type=int, default=91)
    p.add_argument("--min-bursts", "--coupling-min-bursts", type=int, default=10)
    p.add_argument("--min-ratio", "--coupling-min-ratio", type=float, default=0.8)
    p.add_argument("--gap-minutes", "--coupling-min-activity-gap-minutes", type=int, default=60)
    p.add_argument("--overlap-minutes", "--coupling-time-overlap-minutes", type=int, default=60)
    p.add_argument("--min-distance", "--coupling-min-distance", type=int, default=3)
    p.add_argument("--max-common-roots", "--coupling-max-common-roots", type=int)
    return p


def config(args: argparse.Namespace) -> ScanConfig:
    if args.no_git and args.no_detailed_git:
        raise ValueError("--no-detailed-git says nothing without git")
    if args.no_git and args.coupling:
        raise ValueError("coupling needs git")
    coupling = None
    if args.coupling:
        coupling = CouplingConfig.from_minutes(
            args.gap_minutes, args.overlap_minutes, bucket_days=args.bucket_days, min_bursts=args.min_bursts, min_ratio=args.min_ratio, min_distance=args.min_distance, max_common_roots=args.max_common_roots
        )
    return ScanConfig(
        args.root, args.name, args.id, git=not args.no_git, git_details=not (args.no_git or args.no_detailed_git), file_stats=not args.no_file_stats, follow_symlinks=args.follow_symlinks, years=args.years, coupling=coupling
    )


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=(logging.WARNING, logging.INFO, logging.DEBUG)[min(args.verbose, 2)])
    try:
        wanted = config(args)
    except ValueError as error:
        print(error, file=sys.stderr)
        return 2
    from loamline.plans.scan import documented, scan
    from loamline.session import local_session
    from loamline.sinks.document import write, write_flat

    spark = local_session()
    scanned = scan(spark, wanted)
    found = documented(wanted, scanned)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as out:
            write(found, out)
    else:
        write(found, sys.stdout)
    if args.parquet:
        write_flat(scanned[0], args.parquet)
    return 0


if __name__ == "__main__":
    sys.exit(main())
