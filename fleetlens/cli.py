"""Command line: run, validate and inspect pipeline scripts, and show checkpoint logs.

A pipeline script offers run(spark), a runner (`runner`, or create_runner()), or main().
"""

from __future__ import annotations

import argparse
import ast
import importlib.util
import logging
import os
import sys
from types import ModuleType
from typing import Any

from pyspark.sql import SparkSession

import fleetlens
from fleetlens.errors import CliError, FleetError
from fleetlens.operators.checkpoint import LocalCheckpoint
from fleetlens.operators.runner import EntityRunner

#: Names looked for by `validate`, and the order in which `run` tries them.
ENTRY_POINTS = ("run", "create_runner", "runner", "main")
EXECUTION = ("run", "runner", "create_runner", "main")


def session() -> SparkSession:
    return SparkSession.builder.appName("fleetlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def load(path: str) -> ModuleType:
    if not os.path.isfile(path):
        raise CliError(f"{path} doesn't exist", "give the path of a pipeline script")
    with open(path, encoding="utf-8") as file:
        try:
            ast.parse(file.read(), path)
        except SyntaxError as error:
            raise CliError(f"{path}, line {error.lineno}: {error.msg}") from error
    spec = importlib.util.spec_from_file_location("fleetlens_pipeline", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def entry_point(module: ModuleType) -> str:
    for name in ENTRY_POINTS:
        if hasattr(module, name):
            return name
    raise CliError("the script has no entry point", f"define one of {', '.join(ENTRY_POINTS)}")


def runner_of(module: ModuleType) -> EntityRunner | None:
    found = getattr(module, "runner", None) or (module.create_runner() if hasattr(module, "create_runner") else None)
    if found is not None and not isinstance(found, EntityRunner):
        raise CliError("runner must be an EntityRunner")
    return found


def execute(module: ModuleType, spark: SparkSession) -> Any:
    for name in EXECUTION:
        if not hasattr(module, name):
            continue
        if name == "run":
            return module.run(spark)
        if name == "main":
            return module.main()
        return runner_of(module).run(spark)
    raise CliError("the script has no entry point", f"define one of {', '.join(ENTRY_POINTS)}")


def command_run(args: argparse.Namespace) -> None:
    result = execute(load(args.pipeline), session())
    print(result.text() if hasattr(result, "text") else result if result is not None else "done")


def command_validate(args: argparse.Namespace) -> None:
    module = load(args.pipeline)
    name = entry_point(module)
    if hasattr(module, "validate"):
        module.validate()
    elif (runner := runner_of(module)) is not None and hasattr(runner.source, "validate"):
        runner.source.validate(session())
    print(f"{args.pipeline}: valid, entry point {name}")


def command_info(args: argparse.Namespace) -> None:
    print(f"fleetlens {fleetlens.__version__}\npython {sys.version.split()[0]}")
    if args.checkpoint:
        show(LocalCheckpoint(args.checkpoint), False)


def show(checkpoint: LocalCheckpoint, entities: bool) -> None:
    for key, value in checkpoint.summary().items():
        if not key.endswith("_ids"):
            print(f"{key}: {value}")
        elif entities:
            print(f"{key}: {', '.join(sorted(value))}")


def command_status(args: argparse.Namespace) -> None:
    if not os.path.isdir(args.checkpoint):
        raise CliError(f"{args.checkpoint} doesn't exist")
    show(LocalCheckpoint(args.checkpoint), args.show_entities)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="fleetlens", description=__doc__)
    top.add_argument("--version", action="version", version=fleetlens.__version__)
    sub = top.add_subparsers(required=True)
    for name, f in (("run", command_run), ("validate", command_validate)):
        p = sub.add_parser(name)
        p.add_argument("pipeline")
        p.add_argument("-v", "--verbose", action="store_true")
        p.set_defaults(f=f)
    p = sub.add_parser("info")
    p.add_argument("-c", "--checkpoint")
    p.set_defaults(f=command_info)
    p = sub.add_parser("checkpoint-status")
    p.add_argument("-c", "--checkpoint", required=True)
    p.add_argument("--show-entities", action="store_true")
    p.set_defaults(f=command_status)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if getattr(args, "verbose", False) else logging.INFO)
    try:
        args.f(args)
        return 0
    except FleetError as error:
        print(f"error: {error}", file=sys.stderr)
        if getattr(error, "hint", None):
            print(f"hint: {error.hint}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
