"""Statements from standard input, results to standard output: python -m marlwick.cli [folder of Parquet tables]."""

from __future__ import annotations

import glob
import os
import re
import sys

from .errors import EngineError
from .session import Session

_PIECES = re.compile(r"('(?:[^']|'')*'|--[^\n]*)|(;)")


def statements(text: str) -> list[str]:
    """The statements of a text; semicolons in strings and comments don't part them."""
    out, at = [], 0
    for m in _PIECES.finditer(text):
        if m[2]:
            out.append(text[at : m.start()])
            at = m.end()
    out.append(text[at:])
    return [s for s in out if re.sub(r"--[^\n]*", "", s).strip()]


def run(session: Session, text: str, write=print) -> int:
    """Runs the statements; the number of those that failed."""
    failed = 0
    for s in statements(text):
        try:
            out = session.execute(s)
        except EngineError as e:
            failed += 1
            write(f"error: {e}")
            continue
        if out.rows is not None:
            write("\t".join(out.rows.columns))
            for r in out.rows.toLocalIterator():
                write("\t".join("NULL" if v is None else str(v) for v in r))
        else:
            write(out.text or (f"{out.affected} rows" if out.kind == "affected" else "ok"))
    return failed


def main() -> int:
    from pyspark.sql import SparkSession

    session = Session(SparkSession.builder.getOrCreate())
    for path in glob.glob(f"{sys.argv[1]}/*.parquet") if len(sys.argv) > 1 else []:
        session.register(os.path.basename(path)[:-8], session.spark.read.parquet(path))
    return 1 if run(session, sys.stdin.read()) else 0


if __name__ == "__main__":
    sys.exit(main())
