"""A rule program over Spark: add and retract rules, bind data, read relations, query, trace."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulespark.functions import types as ty
from rulespark.functions import values as vals
from rulespark.functions.builtins import Function, _equal
from rulespark.functions.evaluator import Goals
from rulespark.lang.ast import AggregatorConflict, App, Const, PlanError, Pragma, Rule, RuleError, Var
from rulespark.lang.normal import NormalRule, normalize
from rulespark.lang.parser import Options, parse, parse_expression
from rulespark.operators.aggregate import item_type
from rulespark.operators.fixpoint import Evaluation, components
from rulespark.plans.frames import Builder, Failed
from rulespark.plans.infer import Inference, Unknown
from rulespark.plans.planner import Plan, plan
from rulespark.plans.relation import Shape
from rulespark.runtime import ship
from rulespark.session.changes import Changes
from rulespark.sources.bound import Source


class Compiled:
    """What follows from rules, pragmas and sources, before any data is read."""

    def __init__(self, program: "Program"):
        self.spark, self.sources = program.spark, program.sources
        self.functions, self.max_rounds, self.tolerance = program.functions, program.max_rounds, program.tolerance
        backchained = program.backchained
        called = backchained | {f"{n}/{k}" for n, f in program.functions.items() for k in range(8)}
        self.plans: dict[str, list[Plan]] = {}
        self.aggregators = dict(program.aggregators)
        self.unplanned: list[tuple[Rule, str]] = []
        self.rule_errors: dict[str, list] = {}
        goals: dict[str, list[Plan]] = {name: [] for name in backchained}
        self.normal: list[NormalRule] = []
        for rule in program.rules.values():
            n = normalize(rule, called)
            known = self.aggregators.setdefault(n.name, n.aggregator)
            if known != n.aggregator:
                raise AggregatorConflict(f"Conflicting aggregators; rule {rule.index} (`{rule.text}`) uses {n.aggregator} for {n.name}, which has {known}")
            self.normal.append(n)
            try:
                if n.name in backchained:
                    goals[n.name].append(plan(n, {a.name for a in n.args if isinstance(a, Var)}, scans=False))
                else:
                    self.plans.setdefault(n.name, []).append(plan(n))
            except PlanError as e:
                self.unplanned.append((rule, str(e)))
        self.goals = Goals(goals, {k: f.run for k, f in program.functions.items()}) if goals else None
        for name in (*self.plans, *self.sources):
            self.aggregators.setdefault(name, ":-" if name in self.sources and self.sources[name].value is None else ":=")
        self.edges = {name: set().union(*(p.rule.mentions() for p in plans)) for name, plans in self.plans.items()}
        for name in self.sources:
            self.edges.setdefault(name, set())
        self._infer(goals)

    def _infer(self, goals: dict[str, list[Plan]]) -> None:
        """Types of all relations, by rounds from the sources and facts on."""
        self.elements: dict[str, Shape] = {name: s.shape() for name, s in self.sources.items()}
        self.shapes: dict[str, Shape] = {}
        self.nullable: set[str] = set()
        for round_ in range(24):
            self.shapes = {n: Shape(list(e.args), item_type(self.aggregators[n], e.value), e.key) for n, e in self.elements.items()}
            self.inference = Inference(self.shapes, goals, self.functions)
            before = {n: (tuple(e.args), e.value, e.key) for n, e in self.elements.items()}
            for name, plans in self.plans.items():
                for p in plans:
                    try:
                        args, value, key = self.inference.rule(p)
                    except Unknown:
                        continue
                    if value is None or any(a is None for a in args):
                        continue
                    if value == "null" or isinstance(p.rule.value, Const) and p.rule.value.value is None:
                        self.nullable.add(name)
                    own = self.elements.setdefault(name, Shape([None] * len(args)))
                    merged = [ty.unify(a, b) for a, b in zip(own.args, args, strict=True)]
                    grown = ty.unify(own.value, value)
                    if round_ > 8:  # types that keep growing have no static form
                        merged = ["term" if a != b else a for a, b in zip(merged, own.args, strict=True)]
                        grown = grown if grown == own.value else "term"
                    own.args, own.value = merged, grown
                    if key is not None:
                        own.key = ty.unify(own.key, key)
            for own in self.elements.values():
                if any(a == "null" for a in own.args):
                    own.args = ["term" if a == "null" else a for a in own.args]
                if own.key == "null":
                    own.key = "term"
            if before == {n: (tuple(e.args), e.value, e.key) for n, e in self.elements.items()}:
                return
        raise RuleError("the types of the program's relations do not settle")

    def affected(self, names: set[str]) -> set[str]:
        """``names`` and all relations that depend on them."""
        out, grew = set(names), True
        while grew:
            more = {n for n, e in self.edges.items() if e & out and n not in out}
            grew = bool(more)
            out |= more
        return out

    def reached(self, names: set[str]) -> set[str]:
        """``names`` and all relations that they depend on."""
        out: set[str] = set()
        todo = list(names)
        while todo:
            n = todo.pop()
            if n not in out:
                out.add(n)
                todo.extend(self.edges.get(n, ()))
        return out

    def calling(self, predicates: set[str]) -> set[str]:
        """Relations with rules that call one of the predicates, directly or through others."""
        calls: dict[str, set[str]] = {}
        for n in self.normal:
            calls.setdefault(n.name, set()).update(n.calls())
        grown, grew = set(predicates), True
        while grew:
            more = {n for n, c in calls.items() if c & grown and n not in grown}
            grew = bool(more)
            grown |= more
        return grown - predicates


class Program:
    """Rules and data. Relations are evaluated when they are first read; nothing runs before."""

    def __init__(self, spark: SparkSession, text: str = "", max_rounds: int = 500, tolerance: float = 0.0):
        """``tolerance``: relative change of doubles at which a recursive sum counts as settled."""
        ship(spark)
        self.spark, self.max_rounds, self.tolerance = spark, max_rounds, tolerance
        self.rules: dict[int, Rule] = {}
        self.next_index = 0
        self.options = Options()
        self.aggregators: dict[str, str] = {}
        self.backchained: set[str] = set()
        self.functions: dict[str, Function] = {}
        self.sources: dict[str, Source] = {}
        #: (rule's number, None for a pragma; text) in the order in which they came.
        self.statements: list[tuple[int | None, str]] = []
        self.compiled = Compiled(self)
        self.dirty: set[str] = set()
        self.evaluation = Evaluation(self.compiled)
        if text:
            self.add(text)

    # --- changing the program

    def _commit(self, dirty: set[str], change: Callable[[], None]) -> Changes:
        """Applies a change as a whole or, if it does not compile, not at all."""
        kept = {k: (v.copy() if isinstance(v, (dict, set, list)) else v) for k, v in self.__dict__.items()}
        before = self._snapshot()
        try:
            change()
            compiled = Compiled(self)
            old = {r.index for r, _ in before.compiled.unplanned} | set(before.program_rules)
            for rule, message in compiled.unplanned:
                if rule.index not in old:
                    raise PlanError(message)
        except Exception:
            self.__dict__.update(kept)
            raise
        old_shapes = self.compiled.shapes
        self.compiled = compiled
        moved = {n for n in compiled.shapes.keys() | old_shapes.keys() if compiled.shapes.get(n) != old_shapes.get(n)}
        self.dirty |= compiled.affected(dirty | moved) | (dirty | moved)
        return Changes(before, self)

    def _snapshot(self):
        return Snapshot(self)

    def add(self, text: str) -> Changes:
        """Adds rules and pragmas. Pragmas hold from their place on."""
        options = Options(dict(self.options.operators), dict(self.options.prefixes), dict(self.options.dispositions))
        statements = parse(text, options)

        def change() -> None:
            self.options = options
            for s in statements:
                if isinstance(s, Pragma):
                    self._pragma(s)
                else:
                    s.index = self.next_index
                    self.rules[s.index] = s
                    self.statements.append((s.index, s.text))
                    self.next_index += 1

        fresh = {f"{s.head.fn}/{len(s.head.args)}" for s in statements if isinstance(s, Rule)}
        late = {f"{s.args[0][0]}/{s.args[0][1]}" for s in statements if isinstance(s, Pragma) and s.name == "backchain"}
        functions = late | (fresh & self.backchained)
        changes = self._commit(fresh | late, change)
        if functions:
            callers = self.compiled.calling(functions)
            self.dirty |= self.compiled.affected(callers)
        return changes

    def _pragma(self, s: Pragma) -> None:
        self.statements.append((None, s.text))
        if s.name == "backchain":
            self.backchained.add(f"{s.args[0][0]}/{s.args[0][1]}")
        elif s.name == "iaggr":
            name = f"{s.args[0][0]}/{s.args[0][1]}"
            known = next((r.aggregator for r in self.rules.values() if f"{r.head.fn}/{len(r.head.args)}" == name), s.args[1])
            if known != s.args[1]:
                raise AggregatorConflict(f"{name} has the aggregator {known}, not {s.args[1]}")
            self.aggregators[name] = s.args[1]

    def retract(self, index: int) -> Changes:
        """Takes a rule back. What it alone supported goes; the aggregator goes with the last rule."""
        if index not in self.rules:
            raise KeyError(f"Rule {index} not found.")
        rule = self.rules[index]
        name = f"{rule.head.fn}/{len(rule.head.args)}"

        def change() -> None:
            del self.rules[index]

        changes = self._commit({name}, change)
        if name in self.backchained:
            self.dirty |= self.compiled.affected(self.compiled.calling({name}))
        return changes

    def bind(
        self, name: str, frame: DataFrame, keys: list[str], value: str | None = None, key: str | None = None,
        aggregator: str | None = None, unique: bool = False, bag: bool = False,
    ) -> Changes:
        """Makes the rows of ``frame`` items of ``name``/len(keys); without ``value`` they are true.

        ``unique``: the keys are known to be unique; ``bag``: each row counts by itself, as if it
        had a key of its own. Either way rows are scanned as they stand. Otherwise rows with equal
        keys are folded, by ``aggregator`` (default :=, for true values :-)."""
        full = f"{name}/{len(keys)}"
        source = Source(frame, list(keys), value, unique or bag, key)

        def change() -> None:
            self.sources[full] = source
            if aggregator:
                self.aggregators[full] = aggregator

        return self._commit({full}, change)

    def bind_terms(self, name: str, frame: DataFrame, keys: list[str], value: str) -> Changes:
        """Like ``bind``, with values that are encoded terms (see ``rulespark.functions.values``)."""
        full = f"{name}/{len(keys)}"
        source = Source(frame, list(keys), value, True, None, encoded=True)

        def change() -> None:
            self.sources[full] = source
            self.aggregators[full] = "="

        return self._commit({full}, change)

    def load(self, command: str):
        """``name = tsv("path")`` and the like; see ``rulespark.sources.loaders``."""
        from rulespark.sources.loaders import load

        return load(self, command)

    def trace(self, text: str, limit: int = 30) -> str:
        from rulespark.session.trace import trace

        return trace(self, text, limit)

    def solution(self) -> str:
        from rulespark.session.render import solution

        return solution(self)

    def insert(self, name: str, frame: DataFrame) -> Changes:
        """More rows for a bound relation, of its columns.

        They are written to the shared folder, and batches of like size are merged, so that the
        plan stays the bound frame and one table however often rows come. A relation read before
        keeps the rows it had."""
        full = name if "/" in name else next(n for n in self.sources if n.split("/")[0] == name)
        merged = self.sources[full].grown(frame)

        def change() -> None:
            self.sources[full] = merged

        return self._commit({full}, change)

    def register(self, name: str, run: Callable, returns: str = "str") -> None:
        """A Python function for rule bodies, as ``name(...)`` or ``pycall("name", ...)``.

        ``returns``: "bool", "long", "double", "str", "term", or a list type such as ("list", "str")."""
        self.functions[name] = Function(run, returns)
        self.compiled = Compiled(self)
        self.dirty |= set(self.compiled.edges)

    # --- reading

    def evaluate(self, names: set[str] | None = None) -> Evaluation:
        """Evaluates what is asked for and out of date; unaffected relations are taken over."""
        compiled = self.compiled
        if self.dirty or self.evaluation.program is not compiled:
            old, self.evaluation = self.evaluation, Evaluation(compiled)
            for n, r in old.relations.items():
                if n not in self.dirty and compiled.shapes.get(n) == r.shape:
                    self.evaluation.relations[n] = r
            self.evaluation.done = {n for n in getattr(old, "done", set()) if n not in self.dirty}
            self.dirty = set()
        done = self.evaluation.__dict__.setdefault("done", set())
        wanted = compiled.reached(names) if names is not None else set(compiled.edges)
        for group in components(compiled.edges):
            if set(group) & wanted and not set(group) <= done:
                self.evaluation.group(group, compiled.edges)
                done |= set(group)
        return self.evaluation

    def _full(self, name: str) -> str:
        if "/" in name:
            return name
        found = sorted(n for n in {*self.compiled.edges, *self.compiled.shapes} if n.split("/")[0] == name)
        if len(found) > 1:
            raise RuleError(f"{name} names {', '.join(found)}")
        return found[0] if found else f"{name}/0"

    def relation(self, name: str, *columns: str) -> DataFrame:
        """Items of ``name`` ("f/2", or "f" if there is one) with a0, ..., value and perhaps key.

        ``columns`` rename them, in this order."""
        full = self._full(name)
        found = self.evaluate({full}).relations.get(full)
        if found is None:
            arity = int(full.rsplit("/", 1)[1])
            shape = self.compiled.shapes.get(full) or Shape([None] * arity)
            parts = [f"a{i} {ty.ddl(t)}" for i, t in enumerate(shape.args)] + [f"value {ty.ddl(shape.value)}"]
            frame = self.spark.createDataFrame([], T._parse_datatype_string(", ".join(parts)))
        else:
            frame = found.frame
        return frame.toDF(*columns, *frame.columns[len(columns) :]) if columns else frame

    def items(self, name: str) -> dict[tuple, object]:
        """Arguments -> value, collected, as ground values; for small relations."""
        full = self._full(name)
        frame = self.relation(full)
        shape = self.compiled.shapes.get(full) or Shape([])
        n = len(shape.args)
        return {tuple(map(ty.to_python, tuple(r)[:n], shape.args)): ty.to_python(r[n], shape.value) for r in frame.collect()}

    def few_items(self, name: str, most: int) -> dict[str, object] | None:
        """Encoded arguments -> value, if there are at most ``most`` items; else None."""
        full = self._full(name)
        rows = self.relation(full).limit(most + 1).collect()
        if len(rows) > most:
            return None
        shape = self.compiled.shapes.get(full) or Shape([])
        n = len(shape.args)
        return {vals.encode(tuple(map(ty.to_python, tuple(r)[:n], shape.args))): ty.to_python(r[n], shape.value) for r in rows}

    def item(self, name: str, args: tuple):
        """The value of one item, by a filter on its arguments; None if there is none."""
        full = self._full(name)
        frame, shape = self.relation(full), self.compiled.shapes.get(full)
        if shape is None:
            return None
        for i, (v, t) in enumerate(zip(args, shape.args, strict=True)):
            own = ty.of_value(v)
            frame = frame.where(_equal(F.col(f"a{i}"), t, ty.literal(v, own), own))
        row = frame.select("value").first()
        return None if row is None else ty.to_python(row[0], shape.value)

    def value(self, name: str):
        """The value of an item without arguments; None if there is none."""
        return self.items(f"{name}/0").get(())

    def keys(self, name: str) -> dict[tuple, object]:
        """Arguments -> the key that came with the value (``with_key``)."""
        full = self._full(name)
        shape = self.compiled.shapes.get(full)
        if shape is None or shape.key is None:
            return {}
        n = len(shape.args)
        rows = self.relation(full).collect()
        return {tuple(map(ty.to_python, tuple(r)[:n], shape.args)): ty.to_python(r["key"], shape.key) for r in rows if r["key"] is not None}

    def failed_items(self) -> DataFrame:
        """(functor, arguments, message) of items whose aggregands have no fold: the value $error."""
        frames = []
        for name, r in self.evaluate().relations.items():
            if r.failed is not None:
                args = F.to_json(F.array(*(F.col(c).cast("string") for c in r.columns))) if r.columns else F.lit("[]")
                frames.append(r.failed.select(F.lit(name).alias("functor"), args.alias("arguments"), "message"))
        return reduce(DataFrame.union, frames) if frames else self.spark.createDataFrame([], "functor string, arguments string, message string")

    def errors(self) -> DataFrame:
        """(rule, functor, message): groundings that raised, and items without a fold (rule null)."""
        evaluation = self.evaluate()
        frames = [self.failed_items().select(F.lit(None).cast("int").alias("rule"), "functor", F.concat_ws(" ", "arguments", "message").alias("message"))]
        for name in {*evaluation.relations, *evaluation.program.rule_errors}:
            found = evaluation.relations[name].errors if name in evaluation.relations else evaluation.program.rule_errors[name]
            frames += [f.select("rule", F.lit(name).alias("functor"), "message") for f in found]
        return reduce(DataFrame.unionByName, frames)

    def rules_frame(self) -> DataFrame:
        """The rules as data: index, head functor, aggregator, source and the literals they became."""
        rows = [(n.rule.index, n.name, n.aggregator, n.rule.text, "; ".join(map(str, n.literals))) for n in self.compiled.normal]
        return self.spark.createDataFrame(rows, "rule int, functor string, aggregator string, source string, normal string")

    # --- queries

    def _query_plan(self, text: str):
        body = parse_expression(text, self.options)
        rule = Rule(App("$query"), "dict=", body, f"$query dict= {text}.", -2, dict(self.options.dispositions))
        called = self.backchained | {f"{n}/{k}" for n in self.functions for k in range(8)}
        p = plan(normalize(rule, called))
        self.evaluate(p.rule.mentions())
        return p

    def query(self, text: str) -> DataFrame:
        """The bindings of the variables of an expression, and its value; one row for each way."""
        p = self._query_plan(text)
        kinds = self._query_types(p)
        if kinds is None:
            return self.spark.createDataFrame([], ", ".join([*(f"`{v}` string" for v in p.rule.variables), "value string"]))
        builder = Builder(self.spark, self.evaluation.relations, self.compiled.inference, self.compiled.goals, self.functions).run(p)
        frame = builder.sound()
        out = [builder.get(Var(v))[0].alias(v) for v in p.rule.variables if v in builder.env]
        return frame.select(*out, builder.get(p.rule.value)[0].alias("value")).distinct()

    def _query_types(self, p: Plan):
        try:
            env = self.compiled.inference.steps(p, {})
        except Unknown:
            return None
        if any(f"{x.fn}/{len(x.args)}" not in self.evaluation.relations for x in (s.literal for s in p.steps if s.kind == "scan")):
            return None
        return {v: env[v] for v in p.rule.variables if v in env} | {"value": self.compiled.inference.of(p.rule.value, env)}

    def answers(self, text: str) -> list[tuple[dict, object]]:
        """(bindings, value) of each answer, collected as ground values."""
        p = self._query_plan(text)
        kinds = self._query_types(p)
        if kinds is None:
            return []
        try:
            rows = self.query(text).collect()
        except Failed:
            return []
        names = [v for v in p.rule.variables if v in kinds]
        found = [({v: ty.to_python(r[v], kinds[v]) for v in names}, ty.to_python(r["value"], kinds["value"])) for r in rows]
        return [(b, v) for b, v in found if v is not None]

    def explain(self, name: str | None = None) -> str:
        """The steps of each rule and, for a relation, Spark's plan of it."""
        lines = []
        for plans in self.compiled.plans.values():
            for p in plans:
                if name is None or p.rule.name == self._full(name):
                    lines += [p.rule.rule.text, *(f"    {s.kind} {s.literal}" for s in p.steps)]
        if name is not None:
            frame = self.relation(name)
            lines.append(frame._jdf.queryExecution().toString())
        return "\n".join(lines)

    # --- saving

    def source_text(self) -> str:
        """Pragmas and the rules that remain, in the order in which they came."""
        return "\n".join(t for i, t in self.statements if i is None or i in self.rules)

    def save(self, path: str) -> None:
        """The program's text and bound data, in a folder of any store that Spark writes to.

        Registered functions are Python objects and are not saved: register them before the
        restored program is read."""
        bound = {}
        for i, (name, s) in enumerate(sorted(self.sources.items())):
            s.frame.select([c for c in (*s.keys, s.value, s.key) if c is not None]).write.mode("overwrite").parquet(f"{path}/source-{i}")
            bound[name] = {"at": f"source-{i}", "keys": s.keys, "value": s.value, "key": s.key, "direct": s.direct, "encoded": s.encoded}
        kept = [[i, t] for i, t in self.statements if i is None or i in self.rules]
        data = {"statements": kept, "aggregators": self.aggregators, "sources": bound, "next": self.next_index, "functions": {n: f.returns for n, f in self.functions.items()}}
        self.spark.createDataFrame([(json.dumps(data),)], "program string").coalesce(1).write.mode("overwrite").text(f"{path}/program")

    @classmethod
    def restore(cls, spark: SparkSession, path: str, functions: dict[str, Callable] | None = None) -> "Program":
        """``functions``: those that the saved program had registered, by name."""
        data = json.loads(spark.read.text(f"{path}/program").first()[0])
        out = cls(spark)
        for name, returns in data["functions"].items():
            if functions and name in functions:
                out.register(name, functions[name], tuple(returns) if isinstance(returns, list) else returns)
        for full, s in data["sources"].items():
            name = full.rsplit("/", 1)[0]
            frame = spark.read.parquet(f"{path}/{s['at']}")
            if s["encoded"]:
                out.bind_terms(name, frame, s["keys"], s["value"])
            else:
                out.bind(name, frame, s["keys"], s["value"], s["key"], unique=s["direct"])
        out.aggregators.update(data["aggregators"])
        # In their order, as pragmas hold from their place on; rules keep their numbers, which := goes by.
        out.add("\n".join(t for _, t in data["statements"]))
        renumbered = dict(zip((i for i, _ in data["statements"] if i is not None), out.rules.values(), strict=True))
        for i, rule in renumbered.items():
            rule.index = i
        out.rules, out.next_index = renumbered, data["next"]
        out.statements = [tuple(x) for x in data["statements"]]
        out.compiled = Compiled(out)
        return out


class Snapshot:
    """A program as it was, to compare with."""

    def __init__(self, program: Program):
        self.program, self.compiled, self.evaluation = program, program.compiled, program.evaluation
        self.program_rules = dict(program.rules)
        self.dirty = set(program.dirty)

    def relations(self) -> dict:
        """Its relations; those never read are evaluated now, from the old rules and sources."""
        evaluation = self.evaluation
        if self.dirty or evaluation.program is not self.compiled:
            evaluation = Evaluation(self.compiled)
            for group in components(self.compiled.edges):
                evaluation.group(group, self.compiled.edges)
            self.evaluation, self.dirty = evaluation, set()
        else:
            done = evaluation.__dict__.setdefault("done", set())
            for group in components(self.compiled.edges):
                if not set(group) <= done:
                    evaluation.group(group, self.compiled.edges)
                    done |= set(group)
        return evaluation.relations
