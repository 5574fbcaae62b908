"""Redaction of protected health information, as Catalyst expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE, PARTIAL, FULL, HASH = "none", "partial", "full", "hash"
MARK = "[REDACTED]"
# The protected fields, each with the switch that governs it ("" for always).
PHI_FIELDS = {
    "PID-3": "ids", "PID-5": "names", "PID-7": "dates", "PID-11": "addresses", "PID-13": "phone", "PID-14": "phone", "PID-18": "accounts", "PID-19": "ids", "PID-20": "",
    "NK1-2": "names", "NK1-4": "addresses", "NK1-5": "phone",
    "IN1-2": "accounts", "IN1-36": "accounts",
    "PV1-44": "dates", "PV1-45": "dates",
}
#: Any field whose id contains one of these is protected too.
PHI_WORDS = ("MRN", "SSN")


@dataclass(frozen=True)
class Redaction:
    """How to redact, and which kinds of field."""

    mode: str = FULL
    names: bool = True
    ids: bool = True
    addresses: bool = True
    dates: bool = True
    phone: bool = True
    accounts: bool = True

    def covers(self, field_id: str) -> bool:
        if self.mode == NONE or not is_phi_field(field_id):
            return False
        switch = PHI_FIELDS.get(field_id, "")
        return getattr(self, switch) if switch else True

    def covered(self) -> list[str]:
        return [f for f in PHI_FIELDS if self.covers(f)]


DEFAULT = Redaction()
#: For debugging: partly shown, dates visible.
DEBUG = Redaction(PARTIAL, dates=False)
OFF = Redaction(NONE)


def is_phi_field(field_id: str) -> bool:
    return field_id in PHI_FIELDS or any(w in field_id for w in PHI_WORDS)


def phi_predicate(field_id: Column) -> Column:
    """is_phi_field() for a column of field ids."""
    out = field_id.isin(*PHI_FIELDS)
    for w in PHI_WORDS:
        out = out | field_id.contains(w)
    return out


def djb2(value: Column) -> Column:
    """The 32-bit DJB2 hash of a text's UTF-8 bytes, as a number."""
    octets = F.hex(F.encode(value, "UTF-8"))
    byte = lambda i: F.conv(F.substring(octets, F.lit(2) * i - 1, F.lit(2)), 16, 10).cast("long")
    places = F.when(F.length(octets) > 0, F.sequence(F.lit(1), (F.length(octets) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(5381).cast("long"), lambda h, i: (h * 33 + byte(i)).bitwiseAND(F.lit(0xFFFFFFFF)))


def redact_value(value: Column, mode: str) -> Column:
    """A redacted text; NULL stays NULL."""
    if mode == NONE:
        return value
    if mode == HASH:
        out = F.concat(F.lit("[PHI:"), F.lower(F.lpad(F.hex(djb2(value)), 8, "0")), F.lit("]"))
    elif mode == PARTIAL:
        n, first = F.length(value), F.substring(value, 1, 1)
        shown = F.regexp_replace(value, r"[ \t\n\x0B\f\r]+$", "")
        # text of white space alone ends with its first character
        last = F.when(shown == "", first).otherwise(F.right(shown, F.lit(1)))
        out = F.when(n <= 2, MARK).when(n <= 4, F.concat(first, F.lit("***"))).otherwise(F.concat(first, F.lit("***"), last, F.lit("***")))
    else:
        out = F.lit(MARK)
    return F.when(value.isNotNull(), out)


def redact_field(field_id: str, value: Column, how: Redaction | None = None) -> Column:
    how = how or DEFAULT
    return redact_value(value, how.mode) if how.covers(field_id) else value


def redact_message(raw: Column, how: Redaction | None = None, drop_unterminated_tail: bool = False) -> Column:
    """A message's text with its protected fields redacted; fields are cut at '|' and counted from 1 after the id;
    empty ones stay empty.

    drop_unterminated_tail leaves out the last field of a message that doesn't end with CR.
    """
    how = how or DEFAULT
    if how.mode == NONE:
        return raw
    text = raw
    if drop_unterminated_tail:
        cut = F.regexp_replace(raw, r"(?<=\|)[^|\r]*$", "")
        text = F.when(raw.endswith("\r"), raw).otherwise(cut)
    numbers: dict[str, list[int]] = {}
    for f in how.covered():
        segment, n = f.split("-")
        numbers.setdefault(segment, []).append(int(n))

    def line(s: Column) -> Column:
        fields, own = F.split(s, r"\|", -1), F.substring(s, 1, 3)

        def field(f: Column, j: Column) -> Column:
            protected = own.isin(*PHI_WORDS)
            for segment, ns in numbers.items():
                protected = protected | (own == segment) & j.isin(*ns)
            return F.when((j > 0) & (f != "") & protected, redact_value(f, how.mode)).otherwise(f)

        # only segments with protected fields are cut into fields
        return F.when(own.isin(*PHI_WORDS, *numbers), F.array_join(F.transform(fields, field), "|")).otherwise(s)

    return F.array_join(F.transform(F.split(text, "\r", -1), line), "\r")


def redact_frame(df: DataFrame, how: Redaction | None = None, fields: dict[str, str] | None = None) -> DataFrame:
    """df with its columns raw_message and message redacted, and those columns that `fields` says hold a field."""
    how = how or DEFAULT
    new = {c: redact_message(F.col(c), how) for c in ("raw_message", "message") if c in df.columns}
    new |= {c: redact_field(f, F.col(c), how) for c, f in (fields or {}).items() if c in df.columns}
    return df.withColumns(new) if new else df


def covered(field_id: Column, how: Redaction) -> Column:
    """Whether the redaction covers the field that a column names."""
    out = field_id.isin(*how.covered())
    if how.mode != NONE:
        for w in PHI_WORDS:
            out = out | field_id.contains(w)
    return out


def redact_exploded(df: DataFrame, how: Redaction | None = None) -> DataFrame:
    """Exploded messages (segment, field, value) with protected values redacted."""
    how = how or DEFAULT
    protected = covered(F.concat_ws("-", "segment", F.col("field").cast("string")), how)
    return df.withColumn("value", F.when(protected & (F.col("value") != ""), redact_value(F.col("value"), how.mode)).otherwise(F.col("value")))


def shortened(text: Column, width: int = 50) -> Column:
    """A text for display: its first characters and an ellipsis where it is longer than width."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)
