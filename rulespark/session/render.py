"""Text of a program's state: solution, errors, rules, answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rulespark.functions import types as ty
from rulespark.functions import values as vals
from rulespark.lang.ast import Term
from rulespark.lang.parser import _tokens

#: Width up to which items are padded, and errors listed of each kind.
PAD, LISTED = 40, 5


def relation_rows(program, name: str) -> list[tuple[tuple, object]]:
    """(arguments, value) in order; failed items have the value $error."""
    relation = program.evaluate().relations.get(name)
    if relation is None:
        return []
    kinds, n = relation.shape.args, len(relation.shape.args)
    rows = []
    for r in relation.frame.collect():
        rows.append((tuple(map(ty.to_python, tuple(r)[:n], kinds)), ty.to_python(r[n], relation.shape.value)))
    if relation.failed is not None:
        for r in relation.failed.collect():
            rows.append((tuple(map(ty.to_python, tuple(r)[:n], kinds)), Term("$error")))
    return sorted(rows, key=lambda x: vals.order(x[0]))


def _item(fn: str, args: tuple) -> str:
    return vals.render(Term(fn, args))


def chart(program, name: str) -> list[str]:
    """A relation: its name and one line for each item."""
    fn = name.rsplit("/", 1)[0]
    rows = [(_item(fn, a), v) for a, v in relation_rows(program, name)]
    if not rows:
        return []
    width = min(PAD, max(len(i) for i, _ in rows))
    truth = program.compiled.aggregators.get(name) == ":-"
    lines = [f"{i}." if truth and v is True else f"{i.ljust(width)} = {vals.render(v)}." for i, v in rows]
    return ["", name, "=" * len(name), *lines]


def keys_chart(program) -> list[str]:
    rows = []
    for name in program.compiled.shapes:
        fn = name.rsplit("/", 1)[0]
        rows += [(_item("$key", (Term(fn, a),)), k) for a, k in program.keys(name).items()]
    if not rows:
        return []
    width = min(PAD, max(len(i) for i, _ in rows))
    return ["", "$key/1", "======", *(f"{i.ljust(width)} = {vals.render(k)}." for i, k in sorted(rows))]


def solution(program) -> str:
    """All items: those without arguments first, then relations by name; then errors."""
    relations = program.evaluate().relations
    plain: list[str] = []
    for name in sorted(n for n in relations if n.endswith("/0")):
        truth = program.compiled.aggregators.get(name) == ":-"
        for _, v in relation_rows(program, name):
            fn = vals.render(Term(name[:-2]))
            plain.append(f"{fn}." if truth and v is True else f"{fn} = {vals.render(v)}.")
    charts = [keys_chart(program)] + [chart(program, n) for n in sorted(relations) if not n.endswith("/0")]
    lines = [*plain, *(line for c in charts for line in c)]
    text = ["", "Solution", "========", *lines] if lines else ["Solution empty."]
    return "\n".join([*text, *errors(program)]) + "\n"


def errors(program) -> list[str]:
    """Errors by relation and rule, the first few of each kind."""
    frame = program.errors()
    order = Window.partitionBy("rule", "functor").orderBy("message")
    rows = frame.withColumn("k", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("rule", "functor")))
    found = rows.where(F.col("k") <= LISTED).orderBy("functor", "rule", "k").collect()
    lines: list[str] = []
    for r in found:
        if r["k"] == 1:
            where = f"aggregating {r['functor']}" if r["rule"] is None else f"in rule {r['rule']}"
            lines.append(f"Error(s) {where}:")
            if r["rule"] is not None:
                lines.append(f"    {program.rules[r['rule']].text}")
        lines.append(f"  {r['message']}")
        if r["k"] == LISTED and r["n"] > LISTED:
            lines.append(f"  {r['n'] - LISTED} more ...")
    for rule, message in program.compiled.unplanned:
        lines += ["Failed to plan rule:", f"    {rule.text}", f"  {message}"]
    return ["", "Errors", "======", *lines] if lines else []


def rules(program) -> str:
    if not program.rules:
        return "No rules found."
    return "\n".join(["Rules", "=====", *(f"  {i}: {r.text}" for i, r in sorted(program.rules.items()))])


def _substituted(text: str, bindings: dict) -> str:
    out, at = [], 0
    for t in _tokens(text):
        if t.kind == "variable" and t.text in bindings:
            out += [text[at : t.start], vals.render(bindings[t.text])]
            at = t.end
    return "".join([*out, text[at:]])


def answers(program, text: str) -> str:
    """The query with its variables filled in, one line for each answer."""
    found = sorted(f"{_substituted(text, b)} = {vals.render(v)}." for b, v in program.answers(text))
    return "\n".join(found) or "No results."


def value_answers(program, text: str) -> str:
    """Values with their bindings, by value."""
    found = sorted(program.answers(text), key=lambda x: (vals.order(x[1]), str(x[0])))
    lines = [f"{vals.render(v)} where {{{', '.join(f'{n}={vals.render(x)}' for n, x in sorted(b.items()))}}}" for b, v in found]
    return "\n".join(lines) or "No results."


__all__ = ["answers", "chart", "errors", "relation_rows", "rules", "solution", "value_answers"]
