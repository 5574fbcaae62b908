"""Parsing HL7 v2.x text into columns, and reading fields, as Catalyst expressions.

A message is text; its segments end with CR. The fourth to eighth characters name its separators, so nothing here assumes
`|^~\\&`; splitting at `|` merely takes a shorter path. Absent segments and fields read as NULL, present empty ones as ''.

Numbering of MSH: "as_coded" counts the text after the first separator as field 1, so MSH[8] is the message type;
"standard" counts the separator itself as field 1, so MSH[9] is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known message types, versions and the text of the one parse error.
MESSAGE_TYPES = ("ADT", "ORU", "ORM", "DFT", "SIU", "MDM", "ACK", "QRY", "RAS", "BAR")
VERSIONS = ("2.1", "2.2", "2.3", "2.3.1", "2.4", "2.5", "2.5.1", "2.6", "2.7", "2.8")
SPACES = "\t\n\x0b\x0c\r "
NO_MSH = "Message must start with MSH segment"
ENC = "struct<field: string, component: string, repetition: string, escape: string, subcomponent: string>"
SEGMENTS = "array<struct<id: string, idx: int, fields: array<string>>>"
#: Fields kept as columns of their own at ingest, by numbering: column -> (segment, field).
SHREDDED = {
    "as_coded": {"pid3": ("PID", 3), "msh9": ("MSH", 9), "msh3": ("MSH", 3), "msh10": ("MSH", 10), "pv119": ("PV1", 19), "msh7": ("MSH", 7)},
    "standard": {"pid3": ("PID", 3), "msh9": ("MSH", 9), "msh3": ("MSH", 3), "msh10": ("MSH", 10), "pv119": ("PV1", 19), "msh7": ("MSH", 7)},
}


@dataclass(frozen=True)
class FieldPath:
    """Segment id and occurrence (from 0), field (from 1); component, subcomponent and repetition count from 0, None: not given."""

    segment: str
    field: int
    component: int | None = None
    subcomponent: int | None = None
    repetition: int | None = None
    occurrence: int = 0

    @classmethod
    def parse(cls, text: str) -> FieldPath:
        """`PID-3`, `PID-3.1` or `PID-3.1.0`; the component counts from 0."""
        m = re.match(r"([^-]{0,3})-\s*\+?(\d+)[^.]*(?:\.(\d*)[^.]*(?:\.(\d*))?)?", text)
        if not m or int(m[2]) <= 0:
            raise ValueError(f"not a field path: {text!r}")
        number = lambda x: None if x is None else int(x or 0)
        return cls(m[1], int(m[2]), number(m[3]), number(m[4]))

    def __str__(self) -> str:
        return f"{self.segment}-{self.field}" + "".join(f".{x}" for x in (self.component, self.subcomponent) if x is not None)


def index_name(segment: str, field: int) -> str | None:
    """The shredded column that holds this field, if any."""
    return next((k for k, v in SHREDDED["as_coded"].items() if v == (segment, field)), None)


# -- splitting ----------------------------------------------------------------------------------------------------------
def parts(x: Column, sep: Column) -> Column:
    """x cut at every sep (one character), empty parts kept."""
    return F.split(x, F.concat(F.lit("\\Q"), sep, F.lit("\\E")), F.lit(-1))


def part(x: Column, sep: Column, i: int) -> Column:
    """Part number i (from 0) of x, NULL beyond the last; without arrays or regexes, and naming x once, so that expressions
    built of it stay small."""
    if i == 0:
        return F.call_function("substring_index", x, sep, F.lit(1))
    # a mark before each part tells an empty part from none
    marked = F.concat(F.lit("\x01"), F.replace(x, sep, F.concat(sep, F.lit("\x01"))))
    return F.substring(F.nullif(F.split_part(marked, sep, F.lit(i + 1)), F.lit("")), 2, 2**31 - 1)


def once(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), with x worked out once however often then names it."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def has(x: Column, sep: Column) -> Column:
    return F.call_function("instr", x, sep) > 0


def encoding(raw: Column) -> Column:
    """The separators a message names."""
    names = ("field", "component", "repetition", "escape", "subcomponent")
    return F.struct(*(F.substring(raw, 4 + i, 1).alias(n) for i, n in enumerate(names)))


def is_message(raw: Column) -> Column:
    return raw.startswith("MSH") & (F.length(raw) >= 8)


def lines_of(raw: Column, normalize_newlines: bool = False) -> Column:
    """Segments as text: only CR ends one; those that are empty or begin with white space don't count."""
    if normalize_newlines:
        raw = F.replace(F.replace(raw, F.lit("\r\n"), F.lit("\r")), F.lit("\n"), F.lit("\r"))
    first = lambda s: F.substring(s, 1, 1)
    return F.filter(F.split(raw, "\r", -1), lambda s: (s != "") & ~first(s).isin(*SPACES))


def segments_of(raw: Column, normalize_newlines: bool = False) -> Column:
    """SEGMENTS of a message; idx counts the earlier segments of the same id. Segments shorter than an id are errors."""
    sep = F.substring(raw, 4, 1)
    good = F.filter(lines_of(raw, normalize_newlines), lambda s: F.length(s) >= 3)

    def one(s: Column, i: Column, ids: Column) -> Column:
        own = F.substring(s, 1, 3)
        fields = F.when(sep == "|", F.split(s, r"\|", -1)).otherwise(parts(s, sep))
        earlier = F.size(F.filter(F.slice(ids, F.lit(1), i), lambda x: x == own))
        # without the first, which is the id; a split has one part at least
        return F.struct(own.alias("id"), earlier.alias("idx"), F.slice(fields, F.lit(2), F.lit(1 << 30)).alias("fields"))

    ids_of = lambda lines: F.transform(lines, lambda s: F.substring(s, 1, 3))
    segments = once(good, lambda lines: once(ids_of(lines), lambda ids: F.transform(lines, lambda s, i: one(s, i, ids))))
    return F.when(is_message(raw), segments).otherwise(F.array().cast(SEGMENTS))


# -- reading ------------------------------------------------------------------------------------------------------------
def all_segments(segments: Column, segment: str) -> Column:
    return F.filter(segments, lambda s: s["id"] == segment)


def get_segment(segments: Column, segment: str, n: int = 0) -> Column:
    return F.get(all_segments(segments, segment), F.lit(n))


def raw_field(fields: Column, n: int, segment: str = "", numbering: str = "as_coded") -> Column:
    """Field n of a segment's fields, as it stands in the message."""
    if segment == "MSH" and numbering == "standard":
        n -= 1
    return F.get(fields, F.lit(n - 1)) if n >= 1 else F.lit(None).cast("string")


def field_value(raw: Column, enc: Column) -> Column:
    """The first component of the first repetition, NULL if that has subcomponents."""
    return once(part(part(raw, enc["repetition"], 0), enc["component"], 0), lambda c: F.when(~has(c, enc["subcomponent"]), c))


def component_value(raw: Column, enc: Column, i: int) -> Column:
    """Component i (from 0); of one with subcomponents the first."""
    return part(part(raw, enc["component"], i), enc["subcomponent"], 0)


def subcomponent_value(raw: Column, enc: Column, i: int, j: int) -> Column:
    """Subcomponent j of component i (from 0); a component without subcomponents has none."""
    return once(part(raw, enc["component"], i), lambda c: F.when(has(c, enc["subcomponent"]), part(c, enc["subcomponent"], j)))


def segment_text(raw: Column, segment: str, n: int = 0) -> Column:
    """The text of occurrence n of a segment, straight from the message; NULL if there's none."""
    if len(segment) != 3 or segment[0] in SPACES:
        return F.lit(None).cast("string")
    if segment == "MSH" and n == 0:  # the text of a message begins with it
        return F.when(is_message(raw), F.substring_index(raw, "\r", 1))
    rest = part(F.concat(F.lit("\r"), raw), F.lit(f"\r{segment}"), n + 1)
    return F.when(is_message(raw), F.concat(F.lit(segment), F.substring_index(rest, "\r", 1)))


def _read(there: Column, field: Column, enc: Column, p: FieldPath, numbering: str) -> Column:
    """What a path leads to, from a segment that may be there and a field's text."""
    if p.segment == "MSH" and numbering == "standard" and p.field <= 2:
        return F.when(there.isNotNull(), enc["field"]) if p.field == 1 else field
    if p.repetition is not None:  # a field that isn't repeated takes no notice of the number
        field = F.when(has(field, enc["repetition"]), part(field, enc["repetition"], p.repetition)).otherwise(field)
    else:
        field = part(field, enc["repetition"], 0)
    if p.component is None:
        return field_value(field, enc)
    if p.subcomponent is None:
        return component_value(field, enc, p.component)
    return subcomponent_value(field, enc, p.component, p.subcomponent)


def read_path(segments: Column, enc: Column, path: FieldPath | str, numbering: str = "as_coded") -> Column:
    """The value a path leads to in parsed segments, NULL where it leads nowhere."""
    p = FieldPath.parse(path) if isinstance(path, str) else path
    s = get_segment(segments, p.segment, p.occurrence)
    return _read(s, raw_field(s["fields"], p.field, p.segment, numbering), enc, p, numbering)


def read_raw(raw: Column, path: FieldPath | str, numbering: str = "as_coded") -> Column:
    """The same straight from a message's text, without parsing the rest of it: for queries that touch few fields."""
    p = FieldPath.parse(path) if isinstance(path, str) else path
    line, sep = segment_text(raw, p.segment, p.occurrence), F.substring(raw, 4, 1)
    n = p.field - (p.segment == "MSH" and numbering == "standard")
    field = part(line, sep, n) if n >= 1 else F.lit(None).cast("string")
    enc = {"field": sep} | {k: F.substring(raw, 5 + i, 1) for i, k in enumerate(("component", "repetition", "escape", "subcomponent"))}
    return _read(line, field, enc, p, numbering)


# -- typed values -------------------------------------------------------------------------------------------------------
def message_type_code(x: Column) -> Column:
    """The first three characters if they name a known type, else UNKNOWN."""
    return F.when(F.substring(x, 1, 3).isin(*MESSAGE_TYPES), F.substring(x, 1, 3)).otherwise("UNKNOWN")


def version_code(x: Column) -> Column:
    return F.when(x.isin(*VERSIONS), x).otherwise("unknown")


def epoch(x: Column) -> Column:
    """Seconds since 1970 of a date and time, at least YYYYMMDD, read as UTC; NULL if it isn't one.

    Whole pairs of digits after the date count, a zone or fraction doesn't.
    """
    digits = F.rpad(F.regexp_extract(x, r"^([0-9]{8}(?:[0-9]{2}){0,3})", 1), 14, "0")
    number = lambda at, n: F.substring(digits, at, n).try_cast("int")
    at = F.try_make_timestamp_ntz(number(1, 4), number(5, 2), number(7, 2), number(9, 2), number(11, 2), number(13, 2).cast("decimal(16,6)"))
    return seconds(F.when(x.rlike("^[0-9]{8}"), at))


def seconds(at: Column) -> Column:
    """Whole seconds from 1970 to a timestamp without zone, whatever the session's zone."""
    days = F.date_diff(F.to_date(at), F.lit("1970-01-01").cast("date"))
    return (days.cast("bigint") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)).cast("bigint")


def validate(segments: Column, parse_errors: Column) -> Column:
    """0, or the first that holds: -2 no MSH, -3 MSH isn't first, -4 no segment, -5 parse errors."""
    return (
        F.when(F.size(all_segments(segments, "MSH")) == 0, -2)
        .when(F.get(segments, F.lit(0))["id"] != "MSH", -3)
        .when(F.size(segments) == 0, -4)
        .when(parse_errors > 0, -5)
        .otherwise(0)
    )


#: Fixed texts of the validation codes.
VALIDATION_TEXT = {0: "Message is valid", -2: "Message missing MSH segment", -3: "MSH must be first segment", -4: "Message has no segments", -5: "Message has parse errors", -6: "Invalid message structure"}


def validation_text(code: Column) -> Column:
    out = F.lit("Unknown error")
    for k, v in VALIDATION_TEXT.items():
        out = F.when(code == k, v).otherwise(out)
    return out


# -- whole messages -----------------------------------------------------------------------------------------------------
def parse(df: DataFrame, raw: str = "raw_message", numbering: str = "as_coded", normalize_newlines: bool = False, shred: bool | Mapping[str, tuple[str, int]] = True) -> DataFrame:
    """df with enc, segments, num_segments, parse_errors, error_message, msg_type, msg_type_code, version and, if shred, msh7_ts
    and the shredded columns: the usual ones, or those named. A null text stays a row with NULLs and no segments; text that is no message has one parse error."""
    r = F.col(raw)
    short = F.size(F.filter(lines_of(r, normalize_newlines), lambda s: F.length(s) < 3))
    out = df.withColumns(
        {
            "enc": F.when(is_message(r), encoding(r)),
            "segments": segments_of(r, normalize_newlines),
            "parse_errors": F.when(r.isNull(), F.lit(None)).when(is_message(r), short).otherwise(1).cast("int"),
            "error_message": F.when(r.isNotNull() & ~is_message(r), F.lit(NO_MSH)),
        }
    )
    read = lambda s, n: read_path(F.col("segments"), F.col("enc"), FieldPath(s, n), numbering)
    out = out.withColumns(
        {
            "num_segments": F.size("segments"),
            "msg_type": F.substring(read("MSH", 9), 1, 15),
            "msg_type_code": message_type_code(read("MSH", 9)),
            "version": version_code(read("MSH", 12)),
        }
    )
    if shred is not False:
        kept = SHREDDED[numbering] if shred is True else shred
        out = out.withColumns({k: read(*v) for k, v in kept.items() if k != "msh7"} | {"msh7_ts": epoch(read("MSH", 7))})
    return out


def exploded(df: DataFrame, keep: tuple[str, ...] = ("msg_id",)) -> DataFrame:
    """One row for each field of parsed messages: the kept columns, segment, occurrence, field (from 1) and its raw text."""
    rows = df.select(*keep, F.posexplode("segments").alias("place", "s")).select(*keep, "place", F.col("s.id").alias("segment"), F.col("s.idx").alias("occurrence"), F.posexplode("s.fields").alias("n", "value"))
    return rows.select(*keep, "place", "segment", "occurrence", (F.col("n") + 1).alias("field"), "value")


def build_segment(segment: str, *fields: Column | str) -> Column:
    """A segment's text from its fields; NULL fields are empty."""
    return F.concat_ws("|", F.lit(segment), *(F.coalesce(f if isinstance(f, Column) else F.lit(f), F.lit("")) for f in fields))


def build_message(*segments: Column, trailing: bool = False) -> Column:
    """Segments joined by CR."""
    text = F.concat_ws("\r", *segments)
    return F.concat(text, F.lit("\r")) if trailing else text


def rebuild(segments: Column, sep: Column) -> Column:
    """The text of parsed segments."""
    line = lambda s: F.call_function("array_join", F.concat(F.array(s["id"]), s["fields"]), sep)
    return F.array_join(F.transform(segments, line), "\r")
