"""Commands of an interactive session, one text in and one text out."""

from __future__ import annotations

from rulespark.lang.ast import RuleError
from rulespark.session import post, render, trace
from rulespark.sources import loaders

HELP = {
    "query": "query EXPRESSION: the expression with its variables filled in, and its value, for each answer.",
    "vquery": "vquery EXPRESSION: values with their bindings, by value.",
    "trace": "trace ITEM [--limit=N]: which rules an item's value comes from, N levels deep.",
    "rules": "rules: the rules with their numbers.",
    "retract_rule": "retract_rule N: takes rule N back.",
    "load": 'load NAME = LOADER("path", ...): loaders are read_lines, tsv, matrix, sexpr and pickled.',
    "post": "post NAME(...): dump_solution, save, trace or draw_circuit.",
    "sol": "sol: all items and errors.",
    "paste": "paste RULES: adds rules in which lines may break anywhere; at the prompt, `paste` takes what follows up to an empty line.",
    "explain": "explain NAME: the steps of a relation's rules and Spark's plan.",
    "exit": "exit: ends the session.",
}

# Texts that users of such a session know.
NO_PERIOD = "ERROR: Line doesn't end with period."
NO_QUERY = "No query specified. Type `help {}` for usage."
NO_DOT = "Queries don't end with a dot."
NEW_ERRORS = ">>> {} new errors. Type `sol` for details."
CLEARED = ">>> {} errors cleared."
NO_NUMBER = "Please specify an integer. Type `help retract_rule` to read more."
NO_RULE = "Rule {} not found.\nList available by typing `rules`"
NO_HELP = 'No help available for "{}"'


class Session:
    """``run`` takes a command or rules (which end with a period); what changed comes back."""

    def __init__(self, program):
        self.program = program
        self.failing = 0

    def run(self, line: str) -> str:
        line = line.strip()
        if not line or line.startswith("%"):
            return ""
        word, *rest = line.split(maxsplit=1)
        rest = rest[0] if rest else ""
        try:
            if word in HELP and not (word in ("load", "post") and not rest) and hasattr(self, f"do_{word}"):
                return getattr(self, f"do_{word}")(rest)
            if word == "help":
                return self.do_help(rest)
            if not line.endswith("."):
                return NO_PERIOD
            return self.changed(self.program.add(line))
        except (RuleError, FileNotFoundError, KeyError, ValueError) as e:
            return str(e.args[0]) if e.args else str(e)

    def changed(self, changes) -> str:
        text = changes.text() if changes is not None else ""
        now = self.program.errors().count() + len(self.program.compiled.unplanned)
        more, self.failing = now - self.failing, now
        if more > 0:
            text += "\n" + NEW_ERRORS.format(more)
        elif more < 0:
            text += "\n" + CLEARED.format(-more)
        return text.strip("\n")

    def _expression(self, text: str, command: str) -> str | None:
        if not text:
            return NO_QUERY.format(command)
        return NO_DOT if text.endswith(".") else None

    def do_query(self, text: str) -> str:
        return self._expression(text, "query") or render.answers(self.program, text)

    def do_vquery(self, text: str) -> str:
        return self._expression(text, "query") or render.value_answers(self.program, text)

    def do_trace(self, text: str) -> str:
        text, _, limit = text.partition("--limit=")
        text = text.strip()
        return self._expression(text, "trace") or trace.trace(self.program, text, int(limit or 30))

    def do_rules(self, _: str) -> str:
        return render.rules(self.program)

    def do_retract_rule(self, text: str) -> str:
        if not text.isdigit():
            return NO_NUMBER
        if int(text) not in self.program.rules:
            return NO_RULE.format(text)
        return self.changed(self.program.retract(int(text)))

    def do_load(self, text: str) -> str:
        found = loaders.load(self.program, text)
        if isinstance(found, type(self.program)):
            self.program = found
            return ""
        return self.changed(found)

    def do_post(self, text: str) -> str:
        return post.run(self.program, text)

    def do_sol(self, _: str) -> str:
        return render.solution(self.program)

    def do_paste(self, text: str) -> str:
        return self.changed(self.program.add(text)) if text else ""

    def do_explain(self, text: str) -> str:
        return self.program.explain(text or None)

    def do_exit(self, _: str) -> str:
        raise SystemExit

    def do_help(self, text: str) -> str:
        return HELP.get(text.split(" ")[0], NO_HELP.format(text)) if text else "\n".join(HELP.values())
