"""WARC archives compressed with zstandard, one frame per record.

An archive may begin with a skippable frame that holds a dictionary; every
further frame is one record. The reader loads the dictionary, decodes frame by
frame, and checks version, required headers, lengths and digests. Archives are
rows (archive, content), as Spark's ``binaryFile`` source gives them; writers
roll over to a new one after ``ARCHIVE_BYTES``, so a task holds one archive.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streakline.llm.common import small, stored

#: Fixed values of the two formats.
VERSION = b"WARC/1.1"
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

ARCHIVE_BYTES = 4_000_000
#: The dictionary is trained on an archive's first records, up to so many and so many bytes.
TRAIN_RECORDS, TRAIN_BYTES, DICTIONARY_BYTES = 256, 2_000_000, 32_768
LEVEL = 3
#: Payloads below this length are always stored whole.
REVISIT_FROM = 100
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_CHUNK = 8_192


def _uri(url: str) -> str:
    """A header value on one line: control characters, spaces and % are escaped."""
    return re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def _unescaped(uri: str) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m.group(1), 16)), uri)


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record: a response with its payload, or a revisit that names the response's page."""
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", _uri(url))] if url is not None else []),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Payload-Length", str(len(payload))),
    ]
    block = HTTP
    if refers_to is None:
        block += payload
    else:
        headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{name}: {value}\r\n" for name, value in headers).encode("utf-8", "replace")
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from the samples, or none where they are too few or too small for one."""
    if len(samples) < 8:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return None


def archives_of(records: Iterable[bytes]) -> Iterator[bytes]:
    """The records as archives of about ``ARCHIVE_BYTES``."""
    waiting: list[bytes] = []
    size, out, encoder = 0, bytearray(), None

    def begin() -> zstandard.ZstdCompressor:
        trained = _dictionary(waiting)
        if trained:
            content = zstandard.ZstdCompressor(level=19).compress(trained.as_bytes())
            out.extend(struct.pack("<II", DICTIONARY_FRAME, len(content)) + content)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)

    for record in records:
        if encoder is None:
            waiting.append(record)
            size += len(record)
            if len(waiting) < TRAIN_RECORDS and size < TRAIN_BYTES:
                continue
            encoder = begin()
            for one in waiting:
                out += encoder.compress(one)
            waiting, size = [], 0
        else:
            out += encoder.compress(record)
        if len(out) >= ARCHIVE_BYTES:
            yield bytes(out)
            out, encoder = bytearray(), None
    if waiting:
        encoder = begin()
        for one in waiting:
            out += encoder.compress(one)
    if out:
        yield bytes(out)


def frames(content: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive; ValueError where it is broken."""
    view, at, decoder = memoryview(content), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        if at + 4 > len(view):
            raise ValueError(f"{len(view) - at} bytes after the last frame")
        magic = struct.unpack_from("<I", view, at)[0]
        if magic in SKIPPABLE:
            if at + 8 > len(view):
                raise ValueError("cut within a skippable frame")
            size = struct.unpack_from("<I", view, at + 4)[0]
            body = bytes(view[at + 8 : at + 8 + size])
            if len(body) < size:
                raise ValueError("cut within a skippable frame")
            if magic == DICTIONARY_FRAME and not at:
                raw = zstandard.ZstdDecompressor().decompress(body) if body.startswith(ZSTD_MAGIC) else body
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
            continue
        one, parts = decoder.decompressobj(), []
        while not one.eof:
            chunk = bytes(view[at : at + _CHUNK])
            if not chunk:
                raise ValueError("cut within a record's frame")
            parts.append(one.decompress(chunk))
            at += len(chunk)
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse_record(record: bytes) -> dict:
    """Headers (lower-case names) and payload of a record; ValueError where it breaks the rules."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", VERSION):
        raise ValueError("no WARC version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("header without a colon")
        headers[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    missing = [name for name in REQUIRED if name not in headers]
    if missing:
        raise ValueError(f"no {missing[0]}")
    if not headers["content-length"].isascii() or not headers["content-length"].isdigit():
        raise ValueError("content-length is no number")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"content-length is {length}, the block has {len(rest) - 4}")
    block = rest[:length]
    payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
    digest = headers.get("warc-payload-digest", "")
    if headers["warc-type"] == "response" and digest.startswith("sha256:"):
        if hashlib.sha256(payload).hexdigest() != digest[7:]:
            raise ValueError("the payload does not have its digest")
    return {"headers": headers, "payload": payload}


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", urn or "")
    return int(found.group(1)) if found else None


_READ = "archive string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, problem string"


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of ``archives`` (archive, content), with its page, payload, digest, type and what it refers to.

    A record that breaks the rules is a row with ``problem`` and nothing else;
    a broken frame ends its archive with such a row. Null and empty archives
    have no records. The length and digest of a revisit are those of the full
    payload, as its headers state them.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _READ.split(", ")]
        for batch in batches:
            for archive, content in zip(batch["archive"], batch["content"]):
                rows, size = [], 0
                try:
                    for record in frames(content or b""):
                        try:
                            rows.append(_row(archive, parse_record(record), with_payload))
                            size += len(rows[-1][3] or b"")
                        except ValueError as error:
                            rows.append((archive, *[None] * 7, str(error)))
                        if len(rows) >= 1_000 or size > 8_000_000:
                            yield _typed(pd.DataFrame(rows, columns=names))
                            rows, size = [], 0
                except (ValueError, zstandard.ZstdError) as error:
                    rows.append((archive, *[None] * 7, str(error)))
                yield _typed(pd.DataFrame(rows, columns=names))

    return archives.select("archive", "content").mapInPandas(read, _READ)


def _typed(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})


def _row(archive: str, record: dict, with_payload: bool) -> tuple:
    headers, payload = record["headers"], record["payload"]
    whole = headers["warc-type"] != "revisit"
    stated = headers.get("warc-payload-length", "")
    uri = headers.get("warc-target-uri")
    return (
        archive,
        _page(headers["warc-record-id"]),
        None if uri is None else _unescaped(uri),
        payload if with_payload and whole else None,
        len(payload) if whole else int(stated) if stated.isdigit() else None,
        hashlib.sha256(payload).hexdigest() if whole else headers.get("warc-payload-digest", "").removeprefix("sha256:"),
        headers["warc-type"],
        _page(headers.get("warc-refers-to")),
        None,
    )


def write_archives(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as rows (archive, content).

    A null html is empty. Of equal payloads of ``REVISIT_FROM`` bytes or more
    the smallest page_id is stored and the others refer to it; rows that repeat
    that page are stored too. A row without page_id refers to the smallest one
    there is. Pages stay in their partitions: only digests are shuffled while
    the payloads that repeat are few enough for a broadcast.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    originals = stored(
        rows.where(F.octet_length("html") >= REVISIT_FROM)
        .groupBy("digest")
        .agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND original IS NOT NULL")
        .drop("n")
    )
    joined = rows.join(small(originals), "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()

        def records() -> Iterator[bytes]:
            for batch in batches:
                for page, url, html, digest, other in zip(*(batch[c] for c in ("page_id", "url", "html", "digest", "refers_to"))):
                    page, other = (None if pd.isna(x) else int(x) for x in (page, other))
                    yield record_bytes(page, url, html.encode("utf-8", "replace"), digest, other)

        for n, content in enumerate(archives_of(records())):
            yield pd.DataFrame({"archive": [f"part-{part:06d}-{n:04d}.warc.zst"], "content": [content]})

    ids = ("page_id", "refers_to")  # text keeps whole numbers whole where some are null
    shipped = joined.withColumn("refers_to", refers).select(*[F.col(c).cast("string").alias(c) for c in ids], "url", "html", "digest")
    return shipped.mapInPandas(write, "archive string, content binary")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Digest: every page written to an archive and read back."""
    read = read_archives(stored(write_archives(pages)), with_payload=False)
    checked = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.col("archive"), F.lit(": "), F.col("problem"))))
    return read.select("page_id", "payload_bytes", "payload_digest", F.coalesce(checked.cast("string"), "record_type").alias("record_type"), "refers_to")
