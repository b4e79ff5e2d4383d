"""Command line: python -m loomgraph STAGE --name value ... (see loomgraph/plans/stages.py for each stage's parameters)."""

from __future__ import annotations

import argparse
import inspect
import sys

from loomgraph.plans import stages

#: Stages that warn of options they do not know and go on; the others end.
LENIENT = {"irreducible"}
STAGES = {"sampling": stages.sample, "fit": stages.fit, "irreducible": stages.make_irreducible, "inputs": stages.weight_inputs, "weights": stages.solve_weights}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="loomgraph")
    sub = out.add_subparsers(dest="stage", required=True)
    for name, f in STAGES.items():
        p = sub.add_parser(name, description=f.__doc__)
        for key, par in list(inspect.signature(f).parameters.items())[1:]:
            flag, default = "--" + key.replace("_", "-"), par.default
            if isinstance(default, bool):
                p.add_argument(flag, action=argparse.BooleanOptionalAction, default=default)
            elif default is inspect.Parameter.empty:
                p.add_argument(flag, required=True)
            elif default == "":  # a file that is only written where it is named: there is no default
                p.add_argument(flag, default=argparse.SUPPRESS)
            else:
                p.add_argument(flag, default=default, type=type(default) if default is not None else str)
    return out


def options(args: list[str] | None = None) -> dict:
    """The stage and its parameters; unknown options are an error, or a warning where the stage is lenient."""
    p = parser()
    given, unknown = p.parse_known_args(args)
    if unknown and given.stage not in LENIENT:
        p.error(f"unknown options: {' '.join(unknown)}")
    for u in unknown:
        print(f"warning: unknown option {u} is left out", file=sys.stderr)
    return vars(given)


def main(args: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    given = options(args)
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    print(STAGES[given.pop("stage")](spark, **given))


if __name__ == "__main__":
    main()
