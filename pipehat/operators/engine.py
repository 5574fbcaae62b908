"""Statements against queues."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from pipehat.functions.redact import Redaction, redact_frame
from pipehat.operators.queues import QueueProblem, QueueStore
from pipehat.operators.result import EXECUTION_ERROR, PARSE_ERROR, Result
from pipehat.plans import ast
from pipehat.plans.bind import WILDCARD, BindProblem, Semantics, select
from pipehat.plans.lang import SyntaxProblem, parse


def query(messages: DataFrame, text: str, how: Semantics | None = None) -> DataFrame:
    """A SELECT over any DataFrame of parsed messages, whatever its FROM names."""
    how = how or Semantics(now=int(time.time()))
    tree = parse(text, how.extended)
    if not isinstance(tree, ast.Select):
        raise BindProblem("only SELECT reads a DataFrame")
    return select(messages, tree, how)


class Engine:
    """The query language over a QueueStore. clock gives the seconds since 1970 that a statement counts from."""

    def __init__(self, spark: SparkSession, root: str, extended: bool = False, zero_means_all: bool = False, clock: Callable[[], float] = time.time, **store):
        self.store = QueueStore(spark, root, clock=clock, **store)
        self.extended, self.zero_means_all, self.clock = extended, zero_means_all, clock

    def semantics(self, redact: Redaction | None = None, guarded: bool = False) -> Semantics:
        return Semantics(int(self.clock()), self.store.numbering, self.zero_means_all, self.extended, self.store.indexed, redact, guarded)

    def source(self, s: ast.Source) -> DataFrame:
        if s.kind == "queue":
            return self.store.active(s.name)
        if s.kind == "history":
            return self.store.history(s.name)
        return self.store.everything()

    def execute(self, tree, redact: Redaction | None = None, guarded: bool = False) -> Result:
        """redact: protected fields and messages come redacted, through whatever expression. guarded: and conditions on them are
        refused."""
        if isinstance(tree, ast.Select):
            return Result(select(self.source(tree.source), tree, self.semantics(redact, guarded)))
        if isinstance(tree, ast.Insert):
            self.store.insert(tree.queue, tree.text)
            return Result(affected=1)
        if isinstance(tree, ast.CreateQueue):
            self.store.create(tree.queue)
            return Result()
        if isinstance(tree, ast.DropQueue):
            self.store.drop(tree.queue)
            return Result()
        if isinstance(tree, ast.Pop):
            taken = self.store.pop(tree.queue).select(*WILDCARD)
            return Result(redact_frame(taken, redact) if redact else taken)
        return Result(affected=self.store.clear_history(tree.queue))

    def sql(self, text: str, redact: Redaction | None = None) -> DataFrame | int:
        """The rows of a SELECT or POP, or the number of rows affected; raises what is wrong."""
        out = self.execute(parse(text, self.extended), redact)
        return out.affected if out.frame is None else out.frame

    def run(self, text: str | None, redact: Redaction | None = None, guarded: bool = False) -> Result:
        """Like sql(), but problems come as results with a code."""
        if text is None:
            return Result(code=-1, message="Invalid arguments")
        try:
            return self.execute(parse(text, self.extended), redact, guarded)
        except SyntaxProblem as e:
            return Result(code=PARSE_ERROR, message=f"Parse error: {e}")
        except (BindProblem, QueueProblem) as e:
            return Result(code=EXECUTION_ERROR, message=str(e))

    def insert_frame(self, queue: str, df: DataFrame, order_by: Sequence[Column | str]) -> tuple[int, int]:
        return self.store.insert_frame(queue, df, order_by)
