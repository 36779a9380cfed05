"""Post-processors: what is done with a solution."""

from __future__ import annotations

import json
import re

from rulespark.lang.ast import RuleError
from rulespark.session import render, trace
from rulespark.sources.loaders import literal_arguments

_COMMAND = re.compile(r"\s*(?:post\s+)?([a-z][A-Za-z0-9_]*)\s*\((.*)\)\s*\.?\s*\Z", re.DOTALL)


def dump_solution(program, file: str | None = None) -> str:
    return _put(render.solution(program), file)


def save(program, path: str) -> str:
    program.save(path)
    return path


def dump_trace(program, file: str | None = None, limit: int = 30) -> str:
    """The derivation of every item."""
    parts = []
    for name in sorted(program.evaluate().relations):
        fn = name.rsplit("/", 1)[0]
        parts += ["\n".join(trace.Tracer(program, limit).lines(fn, args)) for args, _ in render.relation_rows(program, name)]
    return _put("\n\n".join(parts), file)


def draw_circuit(program, out: str | None = None, open: bool = False) -> str:  # noqa: A002
    """The hypergraph of items and groundings: JSON for a name in .json, else Graphviz text."""
    text = json.dumps(trace.circuit(program), indent=1) if (out or "").endswith(".json") else trace.dot(program)
    return _put(text, out)


def _put(text: str, file: str | None) -> str:
    if file:
        with open_text(file) as f:
            f.write(text)
    return text


def open_text(file: str):
    return open(file, "w", encoding="utf-8")


POSTS = {"dump_solution": dump_solution, "save": save, "trace": dump_trace, "draw_circuit": draw_circuit}


def run(program, command: str) -> str:
    m = _COMMAND.match(command)
    if not m:
        raise RuleError("Error: failed to parse post command.")
    if m[1] not in POSTS:
        raise RuleError(f"did not recognize post-processor '{m[1]}'")
    args, options = literal_arguments(m[2])
    return POSTS[m[1]](program, *args, **options)
