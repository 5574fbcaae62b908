"""From syntax trees to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipehat.functions import hl7
from pipehat.functions.redact import Redaction, redact_field, redact_message
from pipehat.plans import ast

ENVELOPE = ("queue", "seq", "msg_id", "timestamp", "msg_type", "msg_type_code", "version", "raw_message", "num_segments", "parse_errors", "error_message")
WILDCARD = ("msg_id", "msg_type", "timestamp", "raw_message")


class BindProblem(ValueError):
    """The statement can't be answered."""


@dataclass(frozen=True)
class Semantics:
    """Choices where the language leaves one.

    now: seconds since 1970 that LAST_N_… count from. zero_means_all: LAST_N_…(0) anywhere drops the whole WHERE, else it is an
    error. numbering: of MSH. extended: whether the extensions bind. redaction: how what is shown, ordered by, grouped or
    aggregated is redacted, by the field it reads, whatever its name; conditions read plain values. guarded: conditions on
    protected fields or whole messages are refused, those on groups too.
    """

    now: int | None = None
    numbering: str = "as_coded"
    zero_means_all: bool = False
    extended: bool = False
    shredded: dict[str, tuple[str, int]] = field(default_factory=dict)
    redaction: Redaction | None = None
    guarded: bool = False


class NoFilter(Exception):
    """A time function of nothing, under zero_means_all."""


class Binder:
    """Binds expressions to the columns of a DataFrame of messages, parsed or as text alone.

    `unindexed` lists the fields in conditions that no shredded column holds, which makes their query a full scan.
    """

    def __init__(self, messages: DataFrame, how: Semantics):
        self.messages, self.how, self.unindexed = messages, how, []
        self.columns = set(messages.columns)
        self.kept = {v: k for k, v in (how.shredded or hl7.SHREDDED[how.numbering]).items() if k in self.columns}

    # -- expressions ----------------------------------------------------------------------------------------------------
    def column(self, e, inside: bool = False) -> Column:
        """inside: of a condition."""
        if isinstance(e, ast.Literal):
            return F.lit(e.value)
        if isinstance(e, ast.TimestampRef):
            return F.col("timestamp")
        if isinstance(e, ast.LastN):
            if e.n <= 0:
                if self.how.zero_means_all:
                    raise NoFilter
                raise BindProblem(f"LAST_N_{e.unit.upper()} takes a positive number")
            return F.lit(self.now() - e.n * (3600 if e.unit == "hours" else 86400)).cast("bigint")
        if isinstance(e, ast.FieldRef):
            return self.field_ref(e, inside)
        if isinstance(e, ast.ColumnRef):
            name = next((c for c in ENVELOPE if c == e.name.lower()), None)
            if name is None or name not in self.columns:
                raise BindProblem(f"no column {e.name}")
            if name == "raw_message":
                return self.shown(F.col(name), inside, None)
            return F.col(name)
        if isinstance(e, ast.Aggregate):
            raise BindProblem("an aggregate can't stand here")
        raise BindProblem(f"not an expression: {e}")

    def shown(self, x: Column, inside: bool, field_id: str | None) -> Column:
        """A field's value, or a whole message, as the statement may see it there."""
        how = self.how.redaction
        if how is None or field_id and not how.covers(field_id):
            return x
        if not inside:
            return redact_field(field_id, x, how) if field_id else redact_message(x, how)
        if self.how.guarded:
            raise BindProblem(f"no condition on {field_id or 'a whole message'} is allowed")
        return x

    def field_ref(self, e: ast.FieldRef, inside: bool) -> Column:
        return self.shown(self.plain_field(e, inside), inside, f"{e.segment}-{e.field}")

    def plain_field(self, e: ast.FieldRef, inside: bool) -> Column:
        if e.component is None and (name := self.kept.get((e.segment, e.field))):
            return F.col(name)
        if inside:
            self.unindexed.append(f"{e.segment}-{e.field}")
        if e.field <= 0:
            return F.lit(None).cast("string")
        path = hl7.FieldPath(e.segment, e.field, e.component, e.subcomponent)
        if "segments" not in self.columns:  # messages that aren't parsed yet
            return hl7.read_raw(F.col("raw_message"), path, self.how.numbering)
        return hl7.read_path(F.col("segments"), F.col("enc"), path, self.how.numbering)

    def now(self) -> int:
        if self.how.now is None:
            raise BindProblem("no statement time")
        return self.how.now

    @staticmethod
    def numeric(e) -> bool:
        return isinstance(e, ast.TimestampRef | ast.LastN) or isinstance(e, ast.Literal) and not isinstance(e.value, str) or isinstance(e, ast.ColumnRef) and e.name.lower() in ("seq", "msg_id", "timestamp", "num_segments", "parse_errors")

    def compared(self, *es) -> list[Column]:
        """Columns of one kind: numbers if any side is one, with texts that aren't numbers NULL; else texts."""
        if not any(map(self.numeric, es)):
            return [self.column(e, True) for e in es]
        kind = "double" if any(isinstance(e, ast.Literal) and isinstance(e.value, float) for e in es) else "bigint"
        return [self.column(e, True) if self.numeric(e) else F.lit(self.literal_number(e.value, kind)).cast(kind) if isinstance(e, ast.Literal) else self.column(e, True).try_cast(kind) for e in es]

    @staticmethod
    def literal_number(text: str, kind: str):
        try:
            return (float if kind == "double" else int)(text.strip())
        except ValueError:
            return None

    def condition(self, c) -> Column:
        if isinstance(c, ast.Binary):
            if c.op in ("AND", "OR"):
                left, right = self.condition(c.left), self.condition(c.right)
                return left & right if c.op == "AND" else left | right
            if c.op == "LIKE":
                pattern = c.right
                if isinstance(pattern, ast.Literal):
                    return self.column(c.left, True).cast("string").like(str(pattern.value).replace("\\", "\\\\"))
                return F.like(self.column(c.left, True).cast("string"), F.replace(self.column(pattern, True).cast("string"), F.lit("\\"), F.lit("\\\\")))
            a, b = self.compared(c.left, c.right)
            return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[c.op]
        if isinstance(c, ast.Between):
            a, low, high = self.compared(c.value, c.low, c.high)
            return a.between(low, high)
        if isinstance(c, ast.InList):
            a, *options = self.compared(c.value, *c.options)
            return a.isin(*options)
        if isinstance(c, ast.IsNull):
            x = self.column(c.value, True)
            return x.isNotNull() if c.negated else x.isNull()
        if isinstance(c, ast.Not):
            return ~self.condition(c.condition)
        raise BindProblem(f"not a condition: {c}")

    def where(self, c) -> Column | None:
        """The condition, None if there's none to apply."""
        if c is None:
            return None
        try:
            return self.condition(c)
        except NoFilter:
            return None

    # -- names and aggregates -------------------------------------------------------------------------------------------
    def name(self, item: ast.Item) -> str:
        e = item.expr
        if item.alias:
            return item.alias
        if isinstance(e, ast.FieldRef):
            return f"{e.segment}[{e.field}]" + "".join(f".{x}" for x in (e.component, e.subcomponent) if x is not None)
        if isinstance(e, ast.Aggregate):
            return f"{e.name}({'distinct ' if e.distinct else ''}{'*' if e.arg is None else self.name(ast.Item(e.arg))})"
        if isinstance(e, ast.TimestampRef):
            return "timestamp"
        if isinstance(e, ast.ColumnRef):
            return e.name
        if isinstance(e, ast.LastN):
            return f"last_n_{e.unit}({e.n})"
        return str(e.value)

    def aggregate(self, e: ast.Aggregate) -> Column:
        if e.arg is None:
            return F.count(F.lit(1))
        if isinstance(e.arg, ast.Aggregate):
            raise BindProblem("an aggregate of an aggregate")
        x = self.column(e.arg)
        if e.name == "count":
            return F.count_distinct(x) if e.distinct else F.count(x)
        if e.name in ("sum", "avg") and not self.numeric(e.arg):
            x = x.try_cast("double")
        f = {"sum": F.sum_distinct if e.distinct else F.sum, "avg": F.avg, "min": F.min, "max": F.max}[e.name]
        return f(x)


def has_aggregate(e) -> bool:
    if isinstance(e, ast.Aggregate):
        return True
    return any(has_aggregate(getattr(e, k)) for k in getattr(e, "__dataclass_fields__", ()) if not isinstance(getattr(e, k), str | int | float | tuple | None.__class__))


def select(messages: DataFrame, s: ast.Select, how: Semantics) -> DataFrame:
    """The rows a SELECT gives from the messages of its source."""
    b = Binder(messages, how)
    condition = b.where(s.where)
    if s.where is not None and has_aggregate(s.where):
        raise BindProblem("an aggregate in WHERE")
    rows = messages if condition is None else messages.where(condition)
    items = [ast.Item(ast.ColumnRef(c)) for c in WILDCARD] if s.items is None else list(s.items)
    aggregates = [i for i in items if isinstance(i.expr, ast.Aggregate)]
    if aggregates or s.group_by:
        if s.items is None:
            raise BindProblem("* can't be grouped")
        if not how.extended and len(aggregates) < len(items):
            raise BindProblem("COUNT can't stand beside plain columns")
        out = grouped(rows, b, s, items)
    else:
        out = rows
        keys = [_output_or_column(b, items, e, i) for i, (e, _) in enumerate(s.order_by)]
        if s.order_by and not s.distinct:
            out = out.orderBy(*(k.asc() if up else k.desc() for k, (_, up) in zip(keys, s.order_by, strict=True)))
        out = out.select(*(b.column(i.expr).alias(b.name(i)) for i in items))
        if s.distinct:
            out = out.distinct()
            if s.order_by:
                names = [b.name(i) for i in items]
                out = out.orderBy(*(F.col(f"`{_output_name(b, items, e, names)}`").asc() if up else F.col(f"`{_output_name(b, items, e, names)}`").desc() for e, up in s.order_by))
    return out if s.limit is None else out.limit(s.limit)


def _output_or_column(b: Binder, items: list[ast.Item], e, _: int) -> Column:
    if isinstance(e, ast.ColumnRef):
        for i in items:
            if i.alias == e.name:
                return b.column(i.expr)
    return b.column(e)


def _output_name(b: Binder, items: list[ast.Item], e, names: list[str]) -> str:
    for i, n in zip(items, names, strict=True):
        if i.expr == e or isinstance(e, ast.ColumnRef) and i.alias == e.name:
            return n
    raise BindProblem("this can't be ordered by what isn't selected")


def grouped(rows: DataFrame, b: Binder, s: ast.Select, items: list[ast.Item]) -> DataFrame:
    """SELECT with aggregates. Every plain column must be a key."""
    aliases = {i.alias: i.expr for i in items if i.alias and not isinstance(i.expr, ast.Aggregate)}
    resolve = lambda e: aliases.get(e.name, e) if isinstance(e, ast.ColumnRef) and e.name.lower() not in ENVELOPE else e
    keys = [resolve(e) for e in s.group_by]
    for i in items:
        if not isinstance(i.expr, ast.Aggregate) and i.expr not in keys:
            raise BindProblem(f"{b.name(i)} is neither grouped nor counted")
    wanted: list[ast.Aggregate] = []

    def collect(e) -> None:
        if isinstance(e, ast.Aggregate):
            if e not in wanted:
                wanted.append(e)
        else:
            for k in getattr(e, "__dataclass_fields__", ()):
                v = getattr(e, k)
                for x in v if isinstance(v, tuple) else (v,):
                    collect(x)

    for e in [*(i.expr for i in items), s.having, *(e for e, _ in s.order_by)]:
        collect(e)
    named = rows.select("*", *(b.column(k).alias(f"key{n}") for n, k in enumerate(keys)))
    out = named.groupBy(*(f"key{n}" for n in range(len(keys)))).agg(*(b.aggregate(a).alias(f"agg{n}") for n, a in enumerate(wanted)))

    class After(Binder):
        """Reads keys and aggregates by their place."""

        def column(self, e, inside: bool = False) -> Column:
            e = resolve(e)
            if e in wanted:
                return F.col(f"agg{wanted.index(e)}")
            if e in keys:
                return F.col(f"key{keys.index(e)}")
            if isinstance(e, ast.ColumnRef):
                for i in items:
                    if i.alias == e.name:
                        return self.column(i.expr)
            if isinstance(e, ast.Literal | ast.LastN):
                return super().column(e, inside)
            raise BindProblem(f"{e} is neither grouped nor counted")

        @staticmethod
        def numeric(e) -> bool:
            return isinstance(e, ast.Aggregate) and e.name in ("count", "sum", "avg") or Binder.numeric(e)

    after = After(rows, b.how)
    if s.having is not None:
        out = out.where(after.condition(s.having))
    if s.order_by:
        out = out.orderBy(*(after.column(e).asc() if up else after.column(e).desc() for e, up in s.order_by))
    out = out.select(*(after.column(i.expr).alias(b.name(i)) for i in items))
    return out.distinct() if s.distinct else out
