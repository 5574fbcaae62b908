"""What a statement gives: rows, or a number of rows affected, or a problem; and its texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pipehat.functions import hl7
from pipehat.functions.redact import Redaction, covered, redact_message, redact_value, shortened

PARSE_ERROR, EXECUTION_ERROR, INTERNAL_ERROR = 1, 2, 3


@dataclass
class Result:
    """frame is None for statements without rows. code 0 is success."""

    frame: DataFrame | None = None
    affected: int = 0
    code: int = 0
    message: str = ""

    @property
    def columns(self) -> list[str]:
        return self.frame.columns if self.frame is not None else []

    def has_error(self) -> bool:
        return self.code != 0

    def rows(self, limit: int | None = None) -> list[list[str | None]]:
        """Cells as text. Ask for a limit where a result may be large: rows come to the driver."""
        if self.frame is None:
            return []
        frame = self.frame if limit is None else self.frame.limit(limit)
        texts = frame.select(*(F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(frame.columns)))
        return [list(r) for r in texts.collect()]

    def value(self, row: int, column: int) -> str | None:
        rows = self.rows(row + 1)
        return rows[row][column] if 0 <= row < len(rows) and 0 <= column < len(rows[row]) else None

    def text(self, limit: int | None = None) -> str:
        """`a | b` rows, NULL for nulls, then how many. Of more rows than limit the first are shown, and that there are more."""
        if self.code:
            return f"ERROR {self.code}: {self.message or 'Unknown error'}"
        rows = self.rows(None if limit is None else limit + 1)
        more = limit is not None and len(rows) > limit
        rows = rows[:limit] if more else rows
        if not rows:
            return f"OK ({self.affected} rows affected)" if self.affected else "OK (0 rows)"
        lines = [" | ".join(self.columns)] + [" | ".join("NULL" if c is None else c for c in r) for r in rows]
        return "\n".join([*lines, "", f"{len(rows)} row(s) returned" + ", there are more" * more])

    def table(self, limit: int | None = None, redaction: Redaction | None = None, redacted: bool = False) -> str:
        """Padded columns under their names; redacted, with raw messages redacted and cut to 50 characters."""
        if self.code:
            return f"ERROR {self.code}: {self.message or 'Unknown error'}"
        own = self
        if redacted and self.frame is not None:
            new = {c: shortened(redact_message(F.col(c), redaction)) for c in ("raw_message", "message") if c in self.columns}
            own = Result(self.frame.withColumns(new) if new else self.frame, self.affected)
        rows = own.rows(limit)
        out = []
        if self.columns:
            out += ["".join(f"{c:<20} " for c in self.columns), "-------------------- " * len(self.columns)]
        out += ["".join(f"{'NULL' if c is None else c:<20} " for c in r) for r in rows]
        out += ["", f"{len(rows)} row(s) returned" + " (PHI REDACTED)" * redacted]
        if self.affected:
            out.append(f"{self.affected} row(s) affected")
        return "\n".join(out)


class Rows:
    """Builds a small result row by row."""

    def __init__(self, columns: list[str]):
        self.columns, self.cells = list(columns), []

    def add_row(self, *values: str | None) -> None:
        """Values in the columns' order; those left out are NULL."""
        if len(values) > len(self.columns):
            raise ValueError(f"{len(values)} values for {len(self.columns)} columns")
        self.cells.append((*values, *[None] * (len(self.columns) - len(values))))

    def result(self, spark: SparkSession) -> Result:
        schema = StructType([StructField(c, StringType()) for c in self.columns])
        return Result(spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in self.cells], schema))


def failure(code: int, message: str) -> Result:
    return Result(code=code, message=message)


def message_text(verbose: bool = False, redaction: Redaction | None = None) -> Column:
    """Parsed messages for display: id, type, version and segments; verbose with each segment's text or, under a redaction, its
    fields' values with protected ones redacted."""
    head = " (PHI REDACTED)" if redaction else ""
    texts = [F.lit(f"=== HL7 Message{head} ===\nID: "), F.col("msg_id").cast("string"), F.lit("\nType: "), F.coalesce("msg_type", F.lit("")), F.lit(" ("), F.col("msg_type_code"), F.lit(")\nVersion: "), F.col("version")]
    texts += [F.lit("\nSegments: "), F.col("num_segments").cast("string"), F.lit("\n")]
    if verbose:
        texts.append(F.array_join(F.transform("segments", lambda s, i: _segment_text(s, i, redaction)), ""))
    texts.append(F.lit("=" * (35 if redaction else 18) + "\n"))
    return F.when(F.col("raw_message").isNull(), "NULL message\n").otherwise(F.concat(*texts))


def _segment_text(s: Column, i: Column, redaction: Redaction | None) -> Column:
    head = F.concat(F.lit("\n["), i.cast("string"), F.lit("] "), s["id"], F.lit(" ("), F.size(s["fields"]).cast("string"), F.lit(" fields)\n"))
    if redaction is None:
        return F.concat(head, F.lit("    Raw: "), F.call_function("array_join", F.concat(F.array(s["id"]), s["fields"]), F.col("enc.field")), F.lit("\n"))

    def one(f: Column, n: Column) -> Column:
        name = F.concat_ws("-", s["id"], (n + 1).cast("string"))
        value = hl7.field_value(f, F.col("enc"))
        shown = F.when(covered(name, redaction), redact_value(value, redaction.mode)).otherwise(value)
        return F.coalesce(F.concat(F.lit("    ["), (n + 1).cast("string"), F.lit("] "), shown, F.lit("\n")), F.lit(""))

    return F.concat(head, F.array_join(F.transform(s["fields"], one), ""))
