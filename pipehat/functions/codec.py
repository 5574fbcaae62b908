"""Codecs of persisted messages, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape(x: Column) -> Column:
    """CR, LF, | and \\ as two characters each."""
    x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for plain, letter in (("\r", "r"), ("\n", "n"), ("|", "|")):
        x = F.replace(x, F.lit(plain), F.lit("\\" + letter))
    return x


def unescape(x: Column) -> Column:
    """The inverse, as in one pass from the left; unknown escapes and a lone last \\ stay as they are."""
    # pairs of \\ are set aside under a mark, so that what follows them isn't taken for an escape
    for found, new in (("\x01", "\x01a"), ("\\\\", "\x01b"), ("\\r", "\r"), ("\\n", "\n"), ("\\|", "|"), ("\x01b", "\\"), ("\x01a", "\x01")):
        x = F.replace(x, F.lit(found), F.lit(new))
    return x


def encode64(x: Column) -> Column:
    return one_line(F.base64(F.encode(x, "UTF-8")))


def one_line(x: Column) -> Column:
    """Base64 without the line ends that may stand in it."""
    return F.translate(x, "\r\n", "")


def decode64(x: Column) -> Column:
    """NULL where x isn't base64 of UTF-8."""
    return F.try_to_binary(x, F.lit("base64")).cast("string")


def encrypt(x: Column, key: Column, message_id: Column, iv: Column | None = None) -> Column:
    """AES-GCM in base64, the message id as associated data; a random IV unless one is given."""
    aad = F.encode(message_id.cast("string"), "UTF-8")
    plain = F.encode(x, "UTF-8")
    mode, padding = F.lit("GCM"), F.lit("DEFAULT")
    iv = F.unhex(F.substring(F.replace(F.call_function("uuid"), F.lit("-"), F.lit("")), 1, 24)) if iv is None else iv
    return one_line(F.base64(F.aes_encrypt(plain, key, mode, padding, iv, aad)))


def decrypt(x: Column, key: Column, message_id: Column) -> Column:
    """NULL where the key, the id or the text doesn't fit."""
    aad = F.encode(message_id.cast("string"), "UTF-8")
    return F.try_aes_decrypt(F.try_to_binary(x, F.lit("base64")), key, F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string")


def to_lines(df: DataFrame, key: Column | None = None) -> DataFrame:
    """One line (value) for each row of msg_id, timestamp, raw_message: PLN|id|time|escaped, or ENC|id|time|base64 with a key."""
    body = F.concat(F.lit("PLN|"), F.col("msg_id"), F.lit("|"), F.col("timestamp"), F.lit("|"), escape(F.col("raw_message")))
    if key is not None:
        body = F.concat(F.lit("ENC|"), F.col("msg_id"), F.lit("|"), F.col("timestamp"), F.lit("|"), encrypt(F.col("raw_message"), key, F.col("msg_id")))
    return df.select(body.alias("value"))


def from_lines(lines: DataFrame, key: Column | None = None) -> DataFrame:
    """(msg_id, timestamp, raw_message) of the lines (value) that can be read: PLN, ENC and lines without a prefix."""
    v = F.col("value")
    coded = v.startswith("ENC|")
    rest = F.when(v.startswith("PLN|") | coded, F.substring(v, F.lit(5), F.length(v))).otherwise(v)
    rows = lines.select(coded.alias("coded"), F.split(rest, r"\|", 3).alias("parts"))
    part = lambda i: F.get("parts", F.lit(i))
    msg_id = F.when(part(0).rlike("^[0-9]+$"), part(0).try_cast("long"))
    timestamp = F.when(part(1).rlike("^-?[0-9]+$"), part(1).try_cast("long"))
    plain = F.when(~F.col("coded"), unescape(part(2)))
    text = plain if key is None else F.when(F.col("coded"), decrypt(part(2), key, msg_id)).otherwise(plain)
    # one row or none: a condition on the made columns would be carried down to the lines, and all of this done twice
    made = F.array(F.struct(msg_id.alias("msg_id"), timestamp.alias("timestamp"), text.alias("raw_message")))
    return rows.select(F.inline(F.filter(made, lambda r: r["msg_id"].isNotNull() & r["timestamp"].isNotNull() & r["raw_message"].isNotNull())))
