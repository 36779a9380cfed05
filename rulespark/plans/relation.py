"""What a plan knows of a relation: its frame, the static types of its columns, its kind."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Shape:
    """Types of the arguments, the value and the key; None: unknown, as the relation has no row."""

    args: list
    value: object = None
    key: object = None

    def known(self) -> bool:
        return self.value is not None and all(a is not None for a in self.args)


@dataclass
class Relation:
    """``frame`` has columns a0, a1, ..., value, and key where the shape has one.

    ``error`` items are apart, in ``failed`` (a0, ..., message)."""

    name: str
    shape: Shape
    frame: DataFrame | None = None
    failed: DataFrame | None = None
    #: Texts of rule errors: frames (rule, message).
    errors: list = field(default_factory=list)
    #: Held rows or a written table, cheap to read again and again.
    settled: bool = False
    #: For true-valued relations: the contributions before the fold, enough for an existence test.
    raw: DataFrame | None = None

    @property
    def columns(self) -> list[str]:
        return [f"a{i}" for i in range(len(self.shape.args))]
