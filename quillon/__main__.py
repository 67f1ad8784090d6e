"""Command line: the version and where to start."""

from __future__ import annotations

import argparse

import quillon


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillon", description=quillon.__doc__)
    parser.add_argument("--version", action="version", version=quillon.__version__)
    parser.parse_args(args)
    parser.print_help()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
