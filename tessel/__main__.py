"""Questions at the terminal: python -m tessel FOLDER answers them over the tables of the folder until quit."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

#: Words that end the questions.
QUIT = ("quit", "exit", "退出")


def questions(lines: Iterable[str]) -> Iterator[str]:
    """Lines without white space around them, blank ones left out, up to one that quits (F16)."""
    for line in lines:
        q = line.strip()
        if q.lower() in QUIT:
            return
        if q:
            yield q


def main(folder: str) -> None:
    from tessel.plans.catalog import STAR
    from tessel.plans.sql import CannotTranslate, ask, reading_session
    from tessel.session import session

    spark = reading_session(session())
    tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in STAR}
    for q in questions(sys.stdin):
        try:
            print(ask(spark, q, tables).answer)
        except CannotTranslate:
            print("?")


if __name__ == "__main__":
    main(sys.argv[1])
