"""What a change of the program did to its items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulespark.functions import types as ty
from rulespark.functions import values as vals
from rulespark.plans.relation import Relation


class Changes:
    """Compares lazily: nothing is evaluated before it is asked for."""

    def __init__(self, before, program):
        self.before, self.program = before, program
        self.after = None

    def _after(self) -> dict[str, Relation]:
        if self.after is None:
            self.after = dict(self.program.evaluate().relations)
        return self.after

    def frames(self) -> dict[str, DataFrame]:
        """For each relation that may have changed: a0, ..., old, new where they differ."""
        old, new = self.before.relations(), self._after()
        out = {}
        for name in sorted({*old, *new}):
            a, b = old.get(name), new.get(name)
            if a is b:
                continue
            kind = ty.unify(a and a.shape.value, b and b.shape.value)
            width = int(name.rsplit("/", 1)[1])
            kinds = [ty.unify(a and a.shape.args[i], b and b.shape.args[i]) for i in range(width)]
            sides = [self._side(r, kinds, kind, label) for r, label in ((a, "old"), (b, "new"))]
            columns = [f"a{i}" for i in range(width)]
            if sides[0] is None or sides[1] is None:
                only, other = (sides[0], "new") if sides[1] is None else (sides[1], "old")
                both = only.withColumn(other, F.lit(None).cast(ty.ddl(kind)))
            else:
                left, right = sides
                on = [left[c].eqNullSafe(right[c]) for c in columns] or F.lit(True)
                both = left.join(right, on, "full_outer").select(*(F.coalesce(left[c], right[c]).alias(c) for c in columns), "old", "new")
            out[name] = both.where(~F.col("old").eqNullSafe(F.col("new"))).select(*columns, "old", "new")
        return out

    @staticmethod
    def _side(relation: Relation | None, kinds: list, kind, label: str) -> DataFrame | None:
        if relation is None or relation.frame is None:
            return None
        args = [ty.coerce(F.col(f"a{i}"), t, to).alias(f"a{i}") for i, (t, to) in enumerate(zip(relation.shape.args, kinds, strict=True))]
        return relation.frame.select(*args, ty.coerce(F.col("value"), relation.shape.value, kind).alias(label))

    def items(self) -> dict[str, object]:
        """Rendered item -> new value (None: gone), collected."""
        out = {}
        old, new = self.before.relations(), self._after()
        for name, frame in self.frames().items():
            a, b = old.get(name), new.get(name)
            width = int(name.rsplit("/", 1)[1])
            kinds = [ty.unify(a and a.shape.args[i], b and b.shape.args[i]) for i in range(width)]
            kind = ty.unify(a and a.shape.value, b and b.shape.value)
            for r in frame.collect():
                args = tuple(ty.to_python(r[i], t) for i, t in enumerate(kinds))
                out[vals.render(vals.Term(name.rsplit("/", 1)[0], args))] = ty.to_python(r["new"], kind)
        return out

    def text(self) -> str:
        lines = [f"{item} = {vals.render(value)}." for item, value in sorted(self.items().items())]
        return "\n".join(["Changes", "=======", *lines]) if lines else ""
