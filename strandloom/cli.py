"""Command line: python -m strandloom.cli --reference a.fa --query b.fa"""

from __future__ import annotations

import sys

from strandloom.params import ParameterError, parse
from strandloom.plans.pipeline import run


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] in (["help"], ["-?"], ["--h"]):
        argv = ["--help"]
    try:
        run(parse(argv))
    except ParameterError as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
