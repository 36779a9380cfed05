"""Syntax trees and values of the rule language.

Python values stand for ground terms: bool, int, float, str, None (null), tuples for lists
and ``Term`` for everything built from a functor.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Term:
    """A ground term ``fn(args)``; an atom has no arguments."""

    fn: str
    args: tuple = ()


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class App:
    fn: str
    args: tuple = ()


@dataclass(frozen=True)
class Listing:
    items: tuple
    tail: object = None


@dataclass(frozen=True)
class Quote:
    term: object


@dataclass(frozen=True)
class Evaluate:
    term: object


@dataclass(frozen=True)
class Typed:
    type: str
    term: object


@dataclass
class Rule:
    """``head AGGREGATOR body``; ``text`` is its source."""

    head: App
    aggregator: str
    body: object
    text: str
    index: int = -1
    dispositions: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Pragma:
    name: str
    args: tuple
    text: str


class RuleError(Exception):
    """A program that cannot be accepted."""


class RuleSyntaxError(RuleError):
    pass


class PlanError(RuleError):
    """A rule with variables that nothing can bind, or a use that no plan supports."""


class AggregatorConflict(RuleError):
    pass
