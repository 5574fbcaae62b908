"""Messages from files: raw HL7 text, persisted lines, registries, INI settings; and the frames of the wire protocol."""

from __future__ import annotations

import configparser
import struct
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipehat.functions import codec, hl7
from pipehat.runtime import remove
from pipehat.storage import exists, files_below, read_text, replace_text, size_of

MAX_REQUEST = 1 << 20
#: Queues that one pass of an import takes.
QUEUES_AT_ONCE = 100
OK, PARSE_ERROR, EXECUTION_ERROR, INTERNAL_ERROR = 0, 1, 2, 3


def read_messages(spark: SparkSession, path: str, separator: str = "\nMSH|", parse: bool = True, numbering: str = "as_coded", normalize_newlines: bool = False) -> DataFrame:
    """Messages of text files, one after the other; each begins with MSH at the start of a line."""
    lines = spark.read.option("lineSep", separator).text(path)
    v = F.col("value")
    head = separator[separator.index("MSH") :] if "MSH" in separator else ""
    text = F.when(v.startswith("MSH"), v).otherwise(F.concat(F.lit(head), v)) if head else v
    rows = lines.where(F.trim(v) != "").select(text.alias("raw_message"))
    return hl7.parse(rows, numbering=numbering, normalize_newlines=normalize_newlines) if parse else rows


def read_files(spark: SparkSession, path: str, **how) -> DataFrame:
    """One message a file."""
    return hl7.parse(spark.read.text(path, wholetext=True).select(F.col("value").alias("raw_message")), **how)


def read_persisted(spark: SparkSession, path: str, key: Column | None = None, parse: bool = True, **how) -> DataFrame:
    """Messages of persisted queue files: PLN, ENC and prefix-less lines; lines that can't be read are left out."""
    rows = codec.from_lines(spark.read.option("lineSep", "\n").text(persisted_now(spark, path)), key)
    return hl7.parse(rows, **how) if parse else rows


def persisted_now(spark: SparkSession, path: str) -> str:
    """Where the lines of a persisted file lie: there, or in the generation that its pointer names."""
    pointer = f"{path}/CURRENT"
    return f"{path}/{read_text(spark, pointer)}" if exists(spark, pointer) else path


def write_persisted(df: DataFrame, path: str, key: Column | None = None, mode: str = "append") -> None:
    """msg_id, timestamp and raw_message as lines, with a key encrypted. mode overwrite puts them in the place of all that was
    there in one step: readers see the old lines or the new ones, and a failure leaves the old."""
    spark, lines = df.sparkSession, codec.to_lines(df, key)
    now = persisted_now(spark, path)
    if mode != "overwrite":
        lines.write.mode(mode).option("lineSep", "\n").text(now)
        return
    generation = f"generation-{uuid.uuid4().hex}"
    lines.write.option("lineSep", "\n").text(f"{path}/{generation}")
    replace_text(spark, f"{path}/CURRENT", generation)
    if now != path:
        remove(spark, now)
    else:  # lines from before there were generations
        remove(spark, *(f"{path}/{f}" for f, _ in files_below(spark, path) if f != "CURRENT" and not f.startswith("generation-")))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(name) of a registry's lines, blank ones left out."""
    name = F.rtrim(F.col("value"))
    return spark.read.text(path).select(name.alias("name")).where("name <> ''").distinct()


def write_registry(spark: SparkSession, path: str, names: Iterable[str]) -> None:
    """A registry of these names, sorted, each once, in place of what was there, in one step."""
    replace_text(spark, path, "".join(f"{n}\n" for n in sorted(set(names))))


def change_registry(spark: SparkSession, path: str, add: Iterable[str] = (), drop: Iterable[str] = ()) -> list[str]:
    """Add names to a registry and take others out; what it holds then."""
    old = [r.name for r in read_registry(spark, path).collect()] if exists(spark, path) else []
    names = sorted({*old, *add} - {*drop})
    write_registry(spark, path, names)
    return names


def export_persisted(store, root: str, key: Column | None = None) -> list[str]:
    """Write a QueueStore's queues and histories as persisted lines below a folder, with a registry; the names."""
    names = store.names()

    def export(name: str) -> None:
        write_persisted(store.active(name), persisted_path(root, name), key, "overwrite")
        write_persisted(store.history(name), persisted_path(root, name, True), key, "overwrite")

    with ThreadPoolExecutor(8) as pool:  # small queues side by side
        list(pool.map(export, names))
    write_registry(store.spark, f"{root.rstrip('/')}/channels/channels.dat", names)
    return names


def persisted_path(root: str, queue: str, history: bool = False) -> str:
    return f"{root.rstrip('/')}/channels/{queue}{'.history' if history else ''}/messages.dat"


def file_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row: messages (lines) and bytes."""
    now = persisted_now(spark, path)
    return spark.read.option("lineSep", "\n").text(now).agg(F.count(F.lit(1)).alias("messages")).withColumn("bytes", F.lit(size_of(spark, now)).cast("bigint"))


def import_persisted(store, root: str, key: Column | None = None) -> dict[str, int]:
    """Bring a folder of persisted queues, named by its registry, into a QueueStore; messages per queue."""
    spark = store.spark
    names = sorted(r.name for r in read_registry(spark, f"{root.rstrip('/')}/channels/channels.dat").collect())
    for name in names:
        if not store.has(name):
            store.create(name)
    out = dict.fromkeys(names, 0)
    for at in range(0, len(names), QUEUES_AT_ONCE):
        parts = [read_persisted(spark, persisted_path(root, n), key, parse=False).withColumn("queue", F.lit(n)) for n in names[at : at + QUEUES_AT_ONCE]]
        got = store.insert_dealt(reduce(DataFrame.unionAll, parts), "queue", ["msg_id"])
        out |= {q: n for q, (_, n) in got.items()}
    return out


def index_list(text: str) -> dict[str, tuple[str, int]]:
    """The fields that a setting like `PID-3,MSH-9` wants as columns of their own, by the columns' names."""
    out = {}
    for item in filter(None, (x.strip() for x in text.split(","))):
        p = hl7.FieldPath.parse(item)
        out[hl7.index_name(p.segment, p.field) or f"{p.segment.lower()}_{p.field}"] = (p.segment, p.field)
    return out


class Config:
    """Settings of an INI file, with typed getters and defaults; a value that doesn't fit reads as the default."""

    def __init__(self, text: str):
        self.parser = configparser.ConfigParser(strict=False, interpolation=None, comment_prefixes=("#", ";"), inline_comment_prefixes=None, default_section="\0")
        self.parser.optionxform = str
        self.parser.read_string(text)

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def text(self, section: str, key: str, default: str | None = None) -> str | None:
        return self.parser.get(section, key, fallback=default)

    def whole(self, section: str, key: str, default: int = 0) -> int:
        try:
            return int(self.text(section, key) or "")
        except ValueError:
            return default

    def real(self, section: str, key: str, default: float = 0.0) -> float:
        try:
            return float(self.text(section, key) or "")
        except ValueError:
            return default

    def flag(self, section: str, key: str, default: bool = False) -> bool:
        v = (self.text(section, key) or "").strip().lower()
        return True if v in ("true", "yes", "on", "1") else False if v in ("false", "no", "off", "0") else default


def request_frame(text: str) -> bytes:
    """A request: its length in four bytes, high byte first, then the text."""
    body = text.encode("utf-8")
    if not 0 < len(body) <= MAX_REQUEST:
        raise ValueError("a request has 1 byte to 1 MiB")
    return struct.pack(">I", len(body)) + body


def read_requests(data: bytes) -> Iterable[str]:
    """The whole requests at the front of data."""
    at = 0
    while at + 4 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        if not 0 < n <= MAX_REQUEST:
            raise ValueError("a request has 1 byte to 1 MiB")
        if at + 4 + n > len(data):
            return
        yield data[at + 4 : at + 4 + n].decode("utf-8", "replace")
        at += 4 + n


def response_frame(status: int, text: str) -> bytes:
    """A response: status and length in four bytes each, then the text."""
    body = text.encode("utf-8")
    return struct.pack(">II", status, len(body)) + body


def read_responses(data: bytes) -> Iterable[tuple[int, str]]:
    """(status, text) of the whole responses at the front of data."""
    at = 0
    while at + 8 <= len(data):
        status, n = struct.unpack_from(">II", data, at)
        if at + 8 + n > len(data):
            return
        yield status, data[at + 8 : at + 8 + n].decode("utf-8", "replace")
        at += 8 + n


def answer(engine, request: str, max_rows: int = 10_000) -> bytes:
    """The framed answer of an engine to a request; of larger results the first max_rows rows, and a line that says so."""
    try:
        out = engine.run(request)
        return response_frame(out.code if out.code in (PARSE_ERROR, EXECUTION_ERROR) else OK if out.code == 0 else EXECUTION_ERROR, out.text(max_rows))
    except Exception as e:  # what a client must hear of, whatever it is
        return response_frame(INTERNAL_ERROR, f"ERROR {INTERNAL_ERROR}: {type(e).__name__}")
