"""Syntax trees of statements."""

from __future__ import annotations

from dataclasses import dataclass, field


# -- expressions --------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class FieldRef:
    """segment.PID[3], in extended mode also with a component and subcomponent from 0."""

    segment: str
    field: int
    component: int | None = None
    subcomponent: int | None = None


@dataclass(frozen=True)
class ColumnRef:
    """A column of the message envelope (extended mode)."""

    name: str


@dataclass(frozen=True)
class TimestampRef:
    pass


@dataclass(frozen=True)
class Literal:
    value: str | int | float


@dataclass(frozen=True)
class LastN:
    """Seconds since 1970 of a number of hours or days before the statement's time; None if the number is no positive one."""

    unit: str
    n: int


@dataclass(frozen=True)
class Aggregate:
    """count, and in extended mode sum, avg, min, max; arg None is COUNT(*)."""

    name: str
    arg: object | None = None
    distinct: bool = False


# -- conditions ---------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Between:
    value: object
    low: object
    high: object


@dataclass(frozen=True)
class InList:
    value: object
    options: tuple


@dataclass(frozen=True)
class IsNull:
    value: object
    negated: bool = False


@dataclass(frozen=True)
class Not:
    condition: object


# -- statements ---------------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Item:
    """A selected expression and its alias."""

    expr: object
    alias: str | None = None


@dataclass(frozen=True)
class Source:
    """kind: queue, history, wildcard (FROM *) or all (FROM ALL)."""

    kind: str
    name: str | None = None


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...] | None  # None: *
    source: Source
    where: object | None = None
    group_by: tuple = ()
    having: object | None = None
    order_by: tuple[tuple[object, bool], ...] = ()
    limit: int | None = None
    distinct: bool = False
    extra: tuple[Item, ...] = field(default=())  # written after *, without effect


@dataclass(frozen=True)
class Insert:
    queue: str
    text: str


@dataclass(frozen=True)
class CreateQueue:
    queue: str


@dataclass(frozen=True)
class DropQueue:
    queue: str


@dataclass(frozen=True)
class Pop:
    queue: str


@dataclass(frozen=True)
class ClearHistory:
    queue: str
