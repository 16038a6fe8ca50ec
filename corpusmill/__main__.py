"""Command line: ``python -m corpusmill INPUT [OUTPUT] [flags]``."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import fields

from corpusmill.errors import categorize
from corpusmill.sources import config


def parser() -> argparse.ArgumentParser:
    """One flag per option; a flag that is not given says nothing."""
    out = argparse.ArgumentParser(prog="corpusmill", description="Derive indexes, chunks, graphs and reports from a directory of documents.")
    out.add_argument("input", nargs="?")
    out.add_argument("output", nargs="?")
    out.add_argument("--config")
    out.add_argument("--init-config", choices=("json", "yaml"), help="print a sample configuration")
    for f in fields(config.Options):
        flag = "--" + f.name.replace("_", "-")
        if f.name in ("input", "output", "patterns"):
            continue
        if f.type == "bool":
            out.add_argument(flag, action=argparse.BooleanOptionalAction, default=None)
        elif f.type.startswith("list"):
            out.add_argument(flag, type=lambda s: [x.strip() for x in s.split(",") if x.strip()], default=None)
        else:
            out.add_argument(flag, type={"int": int, "float": float}.get(f.type, str), default=None)
    return out


def main(argv: list[str] | None = None) -> int:
    given = vars(parser().parse_args(argv))
    path, sample = given.pop("config"), given.pop("init_config")
    if sample:
        print(config.sample(sample), end="")
        return 0
    try:
        options = config.load(given["input"] or ".", given, path)
        from corpusmill.plans.build import build
        from corpusmill.session import build_session

        spark = build_session()
        if options.watch:
            from corpusmill.streaming.incremental import state_path
            from corpusmill.streaming.watch import Watcher

            state = state_path(options.cache_dir or f"{options.output}/.cache", options.input)
            inside = options.output.removeprefix(options.input).strip("/") if options.output.startswith(options.input) else ""
            watcher = Watcher(spark, options.input, state, lambda s, changes, batch: build(s, options), inside)
            watcher.start(state + "-checkpoint").awaitTermination()
            return 0
        result = build(spark, options)
        if not options.silent:
            print(json.dumps(result, default=str))
        return 0
    except Exception as error:  # noqa: BLE001 - every failure has an exit code
        known = categorize(error)
        print(f"{known.kind}: {known}", *(f"  - {a}" for a in known.advice), sep="\n", file=sys.stderr)
        return known.exit_code


if __name__ == "__main__":
    sys.exit(main())
