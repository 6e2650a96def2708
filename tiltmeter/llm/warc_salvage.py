"""WARC archives: deduplicated writing, and a salvage reader that survives damage.

Writing is a plain text write whose line separator is the end of a record, so Spark's own commit
protocol guards the files; where payloads must move between executors, they move deflated. Of records with equal payloads, the one with the least page id is a
``response``; the others are ``revisit`` records that keep the HTTP head only and refer to it.

The reader checks version line, head, length, record end and block digest of each record, and each
gzip member. After a failed check it searches for the next member or version line that passes, goes
on there, and logs the bytes between as a quarantined gap. Members are inflated piece by piece, and
what is read is handed on in batches of about ``OUT_BYTES``. A file is read whole by one task, so it must
be under 2 GB; the writer keeps files near ``FILE_BYTES``: records are written by sizes, so that no file
gets more than about ``SIZE_STEP`` times that, or one record.

Defined results: a null payload counts as empty; an empty table gives an empty archive; rows that
repeat the least page id of a payload are all responses; a null page id sorts after all others and
is read back as null; heads and URLs of any length are read back; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltmeter.llm.shared import broadcast_if_small, stored

END = b"\r\n\r\n"
FILE_BYTES, SIZE_STEP = 16_000_000, 16
#: Revisits up to this size (as text) are sent to all executors, so that payloads stay where they are read; beyond
#: it both sides are shuffled.
REVISIT_BYTES = 48_000_000
#: Input that is inflated at once, what a member's records may hold in memory, and what is handed on at once.
PIECE_BYTES, HELD_BYTES, OUT_BYTES = 1 << 16, 1 << 25, 1 << 23
#: Date of all records, so that equal tables give equal archives.
RECORD_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
_START = re.compile(_VERSION.pattern + rb"|\x1f\x8b\x08")
RECORDS = (
    "file string, start long, length long, kind string, note string, warc_type string, record_id string, "
    "target_uri string, refers_to string, payload_digest string, http_length long, payload binary"
)


def base32_of_hex(hexed: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hex: five hex digits make four of base 32."""
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def deflate(payload: pd.Series) -> pd.Series:
    """Payloads as they are moved between executors."""
    return payload.map(lambda p: zlib.compress(p, 1))


def inflate(payload: pd.Series) -> pd.Series:
    return payload.map(zlib.decompress)


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_revisit_bytes: int = 0, revisit_bytes: int = REVISIT_BYTES,
) -> None:
    """Write a WARC record for each row of ``pages`` under ``path``; payloads below the size are never revisited."""
    full = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload")
    ).withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    light = stored(full.select("id", "sha", F.octet_length("payload").cast("long").alias("size")), "warc-light")
    step_of = lambda size: F.ceil(F.log(float(SIZE_STEP), size + 700)).cast("int")
    steps = [tuple(r) for r in light.groupBy(step_of(F.col("size"))).agg(F.count(F.lit(1)), F.sum(F.col("size") + 700)).collect()]  # a few sizes
    # a null id sorts last: only payloads without any other id are first met there
    first = light.groupBy("sha").agg(F.min("id").alias("first_id"))
    again = ~F.col("id").eqNullSafe(F.col("first_id")) & (F.col("size") >= min_revisit_bytes)
    revisits = stored(
        light.distinct().join(first, "sha").where(again).select(
            F.xxhash64("id", "sha").alias("rk"), F.col("id").alias("i2"), F.col("sha").alias("s2"), "first_id"
        ),
        "warc-revisits",
    )
    keyed = full.withColumn("rk", F.xxhash64("id", "sha"))
    same = (F.col("rk") == F.col("r_rk")) & F.col("id").eqNullSafe(F.col("i2")) & (F.col("sha") == F.col("s2"))
    revisits_by = revisits.withColumnRenamed("rk", "r_rk")
    if (sent := broadcast_if_small(revisits_by, revisit_bytes)) is not revisits_by:
        both = keyed.join(sent, same, "left")
    else:
        files = -(-sum(total for *_, total in steps) // FILE_BYTES)
        moved = keyed.withColumn("payload", F.pandas_udf(deflate, "binary")(F.col("payload").cast("binary")))
        both = moved.repartition(files, "rk").join(
            revisits_by.repartition(files, "r_rk"), same, "left"
        ).withColumn("payload", F.pandas_udf(inflate, "binary")("payload").cast("string"))

    size = F.octet_length("payload")
    is_response = F.col("s2").isNull()
    crlf = "\r\n"
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"),
        F.lit(crlf + crlf),
    )
    block = F.when(is_response, F.concat(http, "payload")).otherwise(http)
    url = F.regexp_replace(F.coalesce("url", F.lit("urn:unknown")), r"[\x00-\x20\x7f]", "%20")
    made = both.withColumn("block", block)
    head = F.concat_ws(
        crlf,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(is_response, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), urn("id")),
        F.lit(f"WARC-Date: {RECORD_DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha"))),
        F.concat(F.lit("WARC-Block-Digest: sha1:"), base32_of_hex(F.sha1(F.col("block").cast("binary")))),
        F.when(~is_response, F.concat(F.lit("WARC-Refers-To: "), urn("first_id"))),
        F.when(~is_response, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    )
    record = F.concat(head, F.lit(crlf + crlf), "block")
    made = made.select(record.alias("value"), step_of(F.octet_length("payload")).alias("step"))
    if not steps:
        made.select("value").write.option("lineSep", END.decode()).text(path)
    for nth, rows, total in steps:  # one pass for each order of size
        made.where(F.col("step") == nth).select("value").write.mode("append").option("lineSep", END.decode()).option(
            "maxRecordsPerFile", max(1, FILE_BYTES * rows // total)
        ).text(path)


def _head(lines: bytes) -> dict[str, str]:
    fields: dict[str, str] = {}
    for line in lines.split(b"\n")[1:]:
        name, colon, value = line.decode("utf-8", "replace").rstrip("\r").partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    return fields


def _record(data: bytes, at: int, head_end: int) -> tuple[dict | None, int, str]:
    """The record at an offset whose head ends there (below 0: nowhere), where it ends, and what check failed."""
    if not _VERSION.match(data, at):
        return None, at, "no version line"
    if head_end < 0:
        return None, at, "head without end"
    fields = _head(data[at:head_end])
    if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")):
        return None, at, "no content length"
    start = head_end + len(END)
    stop = start + int(fields["content-length"])
    if data[stop : stop + len(END)] != END:
        return None, at, "record does not end where its length says"
    block = data[start:stop]
    algorithm, _, digest = fields.get("warc-block-digest", "").partition(":")
    if algorithm == "sha1" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
        return None, at, "block digest differs"
    payload, http_length = block, None
    if fields.get("content-type", "").startswith("application/http"):
        http_head, _, payload = block.partition(END)
        said = _head(http_head).get("content-length", "")
        http_length = int(said) if re.fullmatch(r"\d{1,18}", said) else None
    return {
        "warc_type": fields.get("warc-type"),
        "record_id": fields.get("warc-record-id"),
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "http_length": http_length,
        "payload": payload,
    }, stop + len(END), ""


class _Broken(Exception):
    """A member that holds something else than whole records."""


class _Member:
    """The records of the gzip member at an offset, inflated piece by piece; ``end`` is known after the last one."""

    def __init__(self, data: memoryview, at: int):
        self.data, self.at, self.end = data, at, at

    def pieces(self) -> Iterator[bytes]:
        unzip, here = zlib.decompressobj(wbits=31), self.at
        while not unzip.eof:
            piece = self.data[here : here + PIECE_BYTES]
            if not piece:
                raise _Broken("gzip: member without end")
            here += len(piece)
            yield unzip.decompress(piece)
        self.end = here - len(unzip.unused_data)

    def __iter__(self) -> Iterator[dict]:
        buffer, head_end, searched, needed = bytearray(), -1, 0, 0
        for piece in self.pieces():
            buffer += piece
            while buffer:
                if len(buffer) >= 10 and not _VERSION.match(buffer):
                    raise _Broken("no version line")
                if head_end < 0:
                    head_end = buffer.find(END, searched)
                    if head_end < 0:
                        searched = max(0, len(buffer) - len(END))
                        break
                    length = _head(bytes(buffer[:head_end])).get("content-length", "")
                    needed = head_end + 2 * len(END) + (int(length) if re.fullmatch(r"\d{1,18}", length) else 0)
                if len(buffer) < needed:
                    break
                record, used, why = _record(bytes(buffer[:needed]), 0, head_end)
                if not record:
                    raise _Broken(why)
                yield record
                del buffer[:used]
                head_end, searched, needed = -1, 0, 0
        if buffer:
            raise _Broken(_record(bytes(buffer), 0, head_end)[2])


class _Archive:
    """An archive's bytes, and where the next head ends."""

    def __init__(self, data: bytes):
        self.data, self.view, self.low, self.high = data, memoryview(data), 0, -1

    def head_end(self, at: int) -> int:
        if not self.low <= at <= self.high:
            found = self.data.find(END, at)
            self.low, self.high = at, found if found >= 0 else len(self.data)
        return self.high if self.high < len(self.data) else -1

    def records_at(self, at: int) -> tuple[Iterable[dict], int, str]:
        """What stands at an offset: a plain record, or a gzip member of whole records."""
        if self.data[at : at + 2] != b"\x1f\x8b":
            record, end, why = _record(self.data, at, self.head_end(at))
            return ([record] if record else []), end, why
        member, held, size = _Member(self.view, at), [], 0
        try:
            for record in member:  # a member counts only if all of it is sound
                size += len(record["payload"])
                held.append(record)
                if size > HELD_BYTES:  # it is inflated again instead
                    held.clear()
        except (zlib.error, _Broken) as error:
            return [], at, str(error) if isinstance(error, _Broken) else f"gzip: {error}"
        return (held if size <= HELD_BYTES else _Member(self.view, at)), member.end, ""


def salvage(data: bytes) -> Iterator[dict]:
    """Records of an archive in order, and between them the gaps that no record could be read from."""
    archive, at = _Archive(data), 0
    while at < len(data):
        found, end, why = archive.records_at(at)
        if not why:
            for record in found:
                yield record | {"start": at, "length": end - at, "kind": "record", "note": None}
            at = end
            continue
        search = at + 1
        while next_ := _START.search(data, search):
            if not archive.records_at(next_.start())[2]:
                break
            search = next_.start() + 1
        resume = next_.start() if next_ else len(data)
        yield {"start": at, "length": resume - at, "kind": "gap", "note": why}
        at = resume


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records and gaps of the archives under ``path`` (columns as in ``RECORDS``)."""
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def table(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows).reindex(columns=names)
        return out.assign(http_length=out["http_length"].astype("Int64"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                for row in salvage(bytes(content)):
                    rows.append(row | {"file": file})
                    size += 500 + len(row.get("payload") or b"")
                    if size > OUT_BYTES:
                        yield table(rows)
                        rows, size = [], 0
        if rows:
            yield table(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, RECORDS)
