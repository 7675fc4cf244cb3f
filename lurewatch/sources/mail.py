"""Raw RFC-5322 mail and mbox files as rows, and header-only scans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurewatch.functions.common import extract_all
from lurewatch.rules import patterns as P

MAIL_SCHEMA = (
    "path STRING, message_id STRING, subject STRING, body STRING, html STRING, sender STRING, receiver STRING, "
    "date STRING, reply_to STRING, return_path STRING, auth_results STRING, in_reply_to STRING, references STRING, "
    "attachments STRING, error STRING"
)
DATE_FORMATS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss")


def parse_rfc2822(raw: Column) -> Column:
    """A mail date as a timestamp; weekday and trailing comment are dropped, an unreadable date is NULL."""
    text = F.trim(F.regexp_replace(F.regexp_replace(raw, r"^\s*[A-Za-z]{3,9},\s*", ""), r"\s*\([^)]*\)\s*$", ""))
    text = F.regexp_replace(text, r"\b(?:GMT|UTC|UT|Z)$", "+0000")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])


def _parse_one(raw: bytes) -> dict[str, str]:
    """Decode one message with the standard library's mail parser."""
    from email import message_from_bytes
    from email.header import decode_header, make_header

    def head(msg, name):
        value = msg.get(name)
        if not value:
            return ""
        try:
            return str(make_header(decode_header(value)))
        except Exception:  # noqa: BLE001 - a broken header keeps its raw spelling
            return str(value)

    msg = message_from_bytes(raw)
    bodies: dict[str, list[str]] = {"text/plain": [], "text/html": []}
    files = []
    for part in msg.walk():
        name = part.get_filename()
        if name:
            files.append(str(make_header(decode_header(name))))
            continue
        kind = part.get_content_type()
        if part.get_content_maintype() == "multipart" or kind not in bodies:
            continue
        payload = part.get_payload(decode=True)
        if payload is None:
            continue
        try:
            bodies[kind].append(payload.decode(part.get_content_charset() or "utf-8", errors="replace"))
        except LookupError:
            bodies[kind].append(payload.decode("utf-8", errors="replace"))
    plain, html = "\n".join(bodies["text/plain"]), "\n".join(bodies["text/html"])
    return {
        "message_id": head(msg, "Message-ID"), "subject": head(msg, "Subject"), "body": plain or html, "html": html,
        "sender": head(msg, "From"), "receiver": head(msg, "To"), "date": head(msg, "Date"),
        "reply_to": head(msg, "Reply-To"), "return_path": head(msg, "Return-Path"),
        "auth_results": head(msg, "Authentication-Results"), "in_reply_to": head(msg, "In-Reply-To"),
        "references": head(msg, "References"), "attachments": "|".join(files),
    }


def _decode_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in MAIL_SCHEMA.split(", ")]
    for pdf in batches:
        out = []
        for path, content in zip(pdf["path"], pdf["content"]):
            try:
                row = _parse_one(bytes(content))
            except Exception as e:  # noqa: BLE001 - one unreadable message must not stop the batch, nor vanish from it
                row = {"error": f"{type(e).__name__}: {e}"}
            out.append({"path": path, **row})
        yield pd.DataFrame({c: pd.Series([r.get(c) for r in out], dtype=object) for c in names})


def decoded(raw: DataFrame) -> DataFrame:
    """(path, content BINARY) to one canonical row each; `error` tells why a message could not be read."""
    return raw.select("path", "content").mapInPandas(_decode_batches, MAIL_SCHEMA)


def unreadable_mail(raw: DataFrame) -> DataFrame:
    """(path, error) of the messages that could not be read."""
    return decoded(raw).where("error IS NOT NULL").select("path", "error")


def decode_mail(raw: DataFrame) -> DataFrame:
    """Canonical rows; what has neither body nor subject is dropped, and `unreadable_mail` holds what failed."""
    df = decoded(raw).where("error IS NULL").drop("error")
    return df.where(F.col("body").rlike(r"\S") | F.col("subject").rlike(r"\S")).withColumn("sent_at", parse_rfc2822(F.col("date")))


def read_eml(spark: SparkSession, path: str, glob: str = "*.eml") -> DataFrame:
    """One message per file."""
    return decode_mail(spark.read.format("binaryFile").option("pathGlobFilter", glob).option(
        "recursiveFileLookup", True).load(path))


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """mbox files: Spark splits the file at the "From " lines, so one large file is read by many tasks. The bytes are
    handled as Latin-1, which keeps each of them, so a part's own charset still applies."""
    df = spark.read.option("lineSep", "\nFrom ").text(path).select(F.input_file_name().alias("path"), F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("v"))
    df = df.withColumn("v", F.regexp_replace(F.regexp_replace("v", r"^(?:From )?[^\n]*\n", ""), r"(?m)^>(>*From )", "$1"))
    df = df.where(F.col("v").rlike(r"(?m)^[A-Za-z-]+:"))
    return decode_mail(df.select("path", F.encode("v", "ISO-8859-1").alias("content")))


def header_scan(raw: DataFrame, text: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """From, To, Cc and Date of raw messages, read from the header block only."""
    head = F.substring_index(F.col(text), "\n\n", 1)

    def field(name):
        return F.trim(F.regexp_extract(head, r"(?im)^" + name + r":[ \t]*([^\n]*)$", 1))

    return raw.select(*keys, field("From").alias("from_raw"), field("To").alias("to_raw"), field("Cc").alias("cc_raw"),
                      field("Date").alias("date_raw"))


def parties(scan: DataFrame, keys: tuple[str, ...], sent: Column, own: Column) -> DataFrame:
    """One row per correspondent: the sender of received mail, every recipient of the owner's sent mail."""
    first = F.slice(extract_all(F.lower("from_raw"), P.MAIL_ADDRESS), 1, 1)
    to = extract_all(F.lower(F.concat_ws(",", "to_raw", "cc_raw")), P.MAIL_ADDRESS)
    out = scan.select(*keys, F.when(sent, F.lit("sent")).otherwise(F.lit("received")).alias("direction"), own.alias("own"),
                      parse_rfc2822(F.col("date_raw")).alias("ts"), F.explode(F.when(sent, to).otherwise(first)).alias("address"))
    return out.where("address <> own").drop("own")
