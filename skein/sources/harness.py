"""A connector for test harnesses that speak JSON commands, one a line: start, dialect, run, stop. Run as a module it
answers on standard output; as a column it answers a table of commands."""

from __future__ import annotations

import json
import platform
import sys
from typing import Any, TextIO

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

import skein
from skein.operators.interpreter import is_valid
from skein.operators.validator import Validator

# Dialects that can be run.
DIALECTS = ["https://json-schema.org/draft/2020-12/schema", "http://json-schema.org/draft-07/schema#"]


def answer(command: dict[str, Any]) -> dict[str, Any] | None:
    """The answer to a command; None to stop."""
    match command.get("cmd"):
        case "start":
            about = {"language": "python", "name": "skein", "version": skein.__version__, "dialects": DIALECTS, "homepage": "", "issues": "", "source": "", "os": platform.system(), "language_version": platform.python_version()}
            return {"version": 1, "implementation": about}
        case "dialect":
            return {"ok": command.get("dialect") in DIALECTS}
        case "run":
            return {"seq": command.get("seq"), **_run(command["case"])}
        case "stop":
            return None
        case other:
            return {"errored": True, "context": {"message": f"unknown command {other!r}"}}


def _run(case: dict[str, Any]) -> dict[str, Any]:
    try:
        v = Validator(case["schema"], case.get("registry") or None)
        node = v.node  # compiled even if there is no test
        return {"results": [{"valid": is_valid(node, test["instance"])} for test in case["tests"]]}
    except Exception as e:  # a case that can't be run is an answer here, not the end of the run
        return {"errored": True, "context": {"message": f"{type(e).__name__}: {e}"}}


def serve(lines: TextIO, out: TextIO) -> None:
    for line in lines:
        if line.strip():
            said = answer(json.loads(line))
            if said is None:
                return
            print(json.dumps(said), file=out, flush=True)


def answers(command: Column) -> Column:
    """The answer to each row's command, as JSON text; NULL for NULL and stop."""

    @arrow_udf("string")
    def told(commands: pa.Array) -> pa.Array:
        found = [None if c is None else answer(json.loads(c)) for c in commands.to_pylist()]
        return pa.array([None if x is None else json.dumps(x) for x in found], pa.string())

    return told(command)


if __name__ == "__main__":
    serve(sys.stdin, sys.stdout)
