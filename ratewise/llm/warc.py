"""Derivatives of WARC responses: a metadata record and a plain-text conversion record for each.

Both records point to the response they come from (``WARC-Refers-To``, target URI, date), carry
its digests unchanged and name each other (``WARC-Concurrent-To``). The metadata block repeats the
source's HTTP headers. Record ids follow from the source's id, so a second run gives the same records.

``responses`` has ``record_id, target_uri, date, http_headers map<string,string>, payload string,
payload_digest``; columns named in ``keep`` pass through. Cases: a null or empty payload gives an
empty text; a null URI, date or digest leaves its header out; line breaks in header values become
spaces; a null header map counts as empty; repeated responses give repeated records; an empty table
gives none. A kept column with the name of an output column gets ``_source`` behind its name; other
columns are ignored. Each response is handled on its own, without a shuffle.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .arrowtext import slices
from .names import columns, renamed

VERSION = "WARC/1.1"
SOURCE = ["record_id", "target_uri", "date", "http_headers", "payload", "payload_digest"]

HIDDEN = re.compile("|".join([r"<!--.*?(?:-->|\Z)", *(rf"<{t}\b[^<>]*>.*?(?:</{t}\s*>|\Z)" for t in ("script", "style", "noscript", "template", "title"))]), re.I | re.S)
BLOCK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|"
    r"nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|tr|ul)\b[^<>]*>", re.I)
TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<![^<>]*>|<\?[^<>]*>")
BLANK = re.compile("[ \t\x0b\x0c\r ]+")
GAP = re.compile(r" ?\n[ \n]*")
TITLE = re.compile(r"<title\b[^<>]*>(.*?)</title\s*>", re.I | re.S)


def plain_text(page: str) -> str:
    """Visible text of an HTML page, a line per block. Unclosed hidden parts reach to the end."""
    text = TAG.sub("", BLOCK.sub("\n", HIDDEN.sub("", page)))
    return GAP.sub("\n", BLANK.sub(" ", html.unescape(text))).strip(" \n")


def title_of(page: str) -> str:
    found = TITLE.search(page)
    return BLANK.sub(" ", html.unescape(found[1]).replace("\n", " ")).strip() if found else ""


def digest(block: bytes) -> str:
    return "sha256:" + hashlib.sha256(block).hexdigest()


def _id(source: str, kind: str) -> str:
    h = hashlib.md5(f"{kind}:{source}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _line(name: str, value: str | None) -> str:
    return "" if value is None else f"{name}: {re.sub(r'[\r\n]+', ' ', value)}\r\n"


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A serialised record; headers without a value are left out."""
    lines = "".join(_line(n, v) for n, v in headers)
    return f"{VERSION}\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def derive_one(source: dict) -> list[dict]:
    """The metadata and the conversion record of one response."""
    page, of = source["payload"] or "", source["record_id"]
    ids = {kind: _id(of or "", kind) for kind in ("metadata", "conversion")}
    fields = [("title", title_of(page)), ("source-payload-digest", source["payload_digest"])]
    fields += [(f"http-{k.lower()}", v) for k, v in sorted(source["http_headers"] or [])]
    blocks = {
        "metadata": ("application/warc-fields", "".join(_line(n, v) for n, v in fields).encode()),
        "conversion": ("text/plain; charset=utf-8", plain_text(page).encode("utf-8", "replace")),
    }
    out = []
    for kind, (content, block) in blocks.items():
        other = ids["conversion" if kind == "metadata" else "metadata"]
        own = digest(block)
        headers = [
            ("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", source["date"]), ("WARC-Target-URI", source["target_uri"]),
            ("WARC-Refers-To", of), ("WARC-Refers-To-Target-URI", source["target_uri"]), ("WARC-Refers-To-Date", source["date"]),
            ("WARC-Concurrent-To", other), ("WARC-Source-Payload-Digest", source["payload_digest"]), ("WARC-Block-Digest", own),
            ("Content-Type", content),
        ]
        out.append({
            "warc_type": kind, "derived_id": ids[kind], "refers_to": of, "concurrent_to": other, "target_uri": source["target_uri"],
            "source_digest": source["payload_digest"], "block_digest": own, "content_length": len(block), "record": record(headers, block),
        })
    return out


FIELDS = {
    "warc_type": pa.string(), "derived_id": pa.string(), "refers_to": pa.string(), "concurrent_to": pa.string(), "target_uri": pa.string(),
    "source_digest": pa.string(), "block_digest": pa.string(), "content_length": pa.int64(), "record": pa.binary(),
}
KINDS = {pa.string(): StringType(), pa.int64(): LongType(), pa.binary(): BinaryType()}


def derive(responses: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and one row per derived record, its serialised bytes in ``record``."""
    names = renamed(keep, [*FIELDS, *SOURCE])
    inner = [f"_kept_{i}" for i in range(len(keep))]
    chosen = responses.select(*(c.alias(n) for c, n in zip(columns(responses, keep), inner)), *SOURCE)
    schema = StructType(chosen.schema.fields[: len(keep)] + [StructField(n, KINDS[t]) for n, t in FIELDS.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload"):
            made = [derive_one(s) for s in batch.select(SOURCE).to_pylist()]
            row = pa.array([i for i, records in enumerate(made) for _ in records], pa.int64())
            kept = [batch.column(n).take(row) for n in inner]
            cols = [pa.array([r[n] for records in made for r in records], t) for n, t in FIELDS.items()]
            yield pa.RecordBatch.from_arrays(kept + cols, names=[*inner, *FIELDS])

    made = chosen.mapInArrow(run, schema)
    return made.select(*(F.col(i).alias(n) for i, n in zip(inner, names)), *FIELDS)


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", date: Column | None = None) -> DataFrame:
    """Pages as response records: ids from page id and address, digests of the payload."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    h = F.md5(F.concat(F.lit("response:"), blank(page_id), F.lit(":"), blank(url)))
    part = lambda a, n: F.substring(h, a, n)
    uuid = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    return pages.select(
        page_id, F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">")).alias("record_id"), F.col(url).alias("target_uri"),
        (F.lit("1970-01-01T00:00:00Z") if date is None else date).cast("string").alias("date"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("Status"), F.lit("200")).alias("http_headers"),
        F.col(payload).alias("payload"), F.concat(F.lit("sha256:"), F.sha2(blank(payload), 256)).alias("payload_digest"),
    )
