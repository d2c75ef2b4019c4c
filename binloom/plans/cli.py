"""`python -m binloom.plans.cli bin|score ...`: a run of binning or scoring with every setting as an option.

Options are the fields of the settings (--contigs a.fasta --gnn-epochs 50 --binarise), or lines of such words in a file
given by --settings, which options on the line override.
"""

from __future__ import annotations

import argparse
import dataclasses
import inspect
import shlex
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from binloom.plans.binning import BinningConfig, run_binning
from binloom.plans.scoring import score_bins


def _add(parser: argparse.ArgumentParser, name: str, kind: str, default: object) -> None:
    flag = f"--{name.replace('_', '-')}"
    if kind == "bool":
        parser.add_argument(flag, action=argparse.BooleanOptionalAction, default=default)
    else:
        parser.add_argument(flag, type={"int": int, "float": float}.get(kind.split(" | ")[0], str), default=default, required=default is inspect.Parameter.empty)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="binloom", fromfile_prefix_chars="@")
    commands = out.add_subparsers(dest="command", required=True)
    binning, scoring = commands.add_parser("bin"), commands.add_parser("score")
    for one in (binning, scoring):
        one.add_argument("--settings", help="a file of further options, before those on the line")
    for f in dataclasses.fields(BinningConfig):
        _add(binning, f.name, str(f.type), inspect.Parameter.empty if f.default is dataclasses.MISSING else f.default)
    for name, p in list(inspect.signature(score_bins).parameters.items())[1:]:
        _add(scoring, name, str(p.annotation), p.default)
    return out


def parse(words: Sequence[str]) -> argparse.Namespace:
    """Options of a command; those of a settings file come first, so that the line's own win."""
    words = list(words)
    if "--settings" in words:
        at = words.index("--settings")
        with open(words[at + 1]) as f:
            more = shlex.split(f.read(), comments=True)
        words = [words[0], *more, *words[1:at], *words[at + 2 :]]
    return parser().parse_args(words)


def main(words: Sequence[str], spark: SparkSession | None = None, tell: Callable[[str], None] = print) -> None:
    options = vars(parse(words))
    command = options.pop("command")
    options.pop("settings")
    spark = spark or SparkSession.builder.appName("binloom").getOrCreate()
    if command == "bin":
        _, scores = run_binning(spark, BinningConfig(**options))
        tables = [scores] if scores is not None else []
    else:
        found = score_bins(spark, **options)
        tables = [t for t in (found.counts, found.estimate, found.summary, found.recovered) if t is not None]
    for t in tables:
        tell("\n".join(["\t".join(t.columns), *("\t".join(map(str, r)) for r in t.limit(1000).collect())]))  # a report


if __name__ == "__main__":
    import sys

    main(sys.argv[1:])
