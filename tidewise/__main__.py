"""python -m tidewise convert SOURCE [OUTPUT]"""

from __future__ import annotations

import argparse

from .session import session
from .sources.tables import convert


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidewise")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("convert", help="write a table as Parquet")
    one.add_argument("source")
    one.add_argument("output", nargs="?")
    one.add_argument("--delimiter")
    one.add_argument("--compression", default="zstd")
    one.add_argument("--overwrite", action="store_true")
    a = parser.parse_args(arguments)
    print(convert(session(), a.source, a.output, delimiter=a.delimiter, compression=a.compression, overwrite=a.overwrite))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
