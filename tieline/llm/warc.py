"""Operator 4: WARC derivatives. Responses become linked metadata records and plain-text conversion records."""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieline.llm.common import cut, small_side, table
from tieline.llm.html_extract import NAME, Scanner

CRLF = "\r\n"
#: WARC 1.1 field names and types written here.
VERSION, CONVERSION, METADATA = "WARC/1.1", "conversion", "metadata"
# Elements whose contents are no text of the page, and those that end a line of it.
HIDDEN = {"script", "style", "noscript", "template", "head"}
BREAKS = {"p", "div", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "section", "article", "header", "footer", "nav", "aside", "blockquote", "pre", "title", "form"}
CLOSERS = {name: re.compile(rf"</{name}\s*>", re.I) for name in HIDDEN}
BLANKS, BREAK_SPACE = re.compile(r"[ \t\x0b\f\r]+"), re.compile(r" ?\n[ \n]*")


def identifier(*parts: Column) -> Column:
    """A urn:uuid made from a digest of the parts: the same input always gets the same record id."""
    h = F.md5(F.concat_ws("\n", *parts))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def digest(body: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(body.cast("binary"), 256))


def visible(page: str) -> str:
    """The page's text: hidden elements and tags go, blocks end lines, all character references are decoded.

    One pass: a hidden element without an end hides nothing, and a '<' that begins no tag is text.
    """
    out: list[str] = []
    unclosed: set[str] = set()
    scan, at, size = Scanner(page), 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            break
        out.append(page[at:start])
        if page.startswith("<!--", start):
            close = page.find("-->", start + 4) if "!--" not in unclosed else -1
            if close < 0:
                unclosed.add("!--")
            else:
                out.append(" ")
                at = close + 3
                continue
        m = NAME.match(page, start + 1)
        close = scan.end(m.end()) if m else page.find(">", start) if page[start + 1: start + 2] in ("!", "?") else -1
        if close < 0:
            out.append("<")
            at = start + 1
            if m:  # no '>' follows at all
                break
            continue
        at = close + 1
        name = m[1].lower() if m else ""
        if name in HIDDEN and m[0][0] != "/" and name not in unclosed:
            end = CLOSERS[name].search(page, at)
            if end:
                out.append(" ")
                at = end.end()
                continue
            unclosed.add(name)
        if name in BREAKS:
            out.append("\n")
    out.append(page[at:])
    text = BLANKS.sub(" ", entities.unescape("".join(out)).replace("\xa0", " "))
    return BREAK_SPACE.sub("\n", text).strip(" \n")


def plain_text(html: Column) -> Column:
    """``visible`` of a column, in Arrow batches; a null page has an empty text."""
    return F.pandas_udf(lambda pages: pages.fillna("").map(visible), "string")(html)


def responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A response record of each crawled page: record_id, target_uri, warc_date, http_headers, payload, payload_digest.

    A null url is an empty target, a null page an empty payload. The record id comes from the page's own id, address and
    payload digest. Rows that are equal in these are one response, so ids are unique; only rows whose id repeats are shuffled.
    """
    target, payload = F.coalesce(F.col(url), F.lit("")), F.coalesce(F.col(html), F.lit(""))
    size = F.octet_length(payload).cast("string")
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF))
    base = pages.select(F.col(page_id).cast("string").alias("source_key"), target.alias("target_uri"), payload.alias("payload"), headers.alias("http_headers"), F.lit(date).alias("warc_date"))
    base = base.withColumn("payload_digest", digest(F.col("payload")))
    base = base.withColumn("record_id", identifier(F.lit("response"), F.coalesce("source_key", F.lit("")), "target_uri", "payload_digest"))
    again = cut(base.groupBy(F.col("record_id").alias("_id")).count().where("count > 1").select("_id"))
    some = small_side(again)
    here = F.col("record_id") == F.col("_id")
    return base.join(some, here, "left_anti").unionByName(base.join(some, here, "left_semi").dropDuplicates(["record_id"]))


def _record(kind: str, content_type: str, body: Column) -> list[Column]:
    """Columns of one derivative: its identifiers, its header block and its body."""
    own = identifier(F.lit(kind), F.col("record_id"), body)
    lines = [
        F.lit(VERSION), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), own), F.concat(F.lit("WARC-Refers-To: "), F.col("record_id")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("target_uri")), F.concat(F.lit("WARC-Date: "), F.col("warc_date")),
        F.concat(F.lit("WARC-Block-Digest: "), digest(body)), F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    return [
        F.col("source_key"), F.lit(kind).alias("warc_type"), own.alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "warc_date",
        F.concat_ws(CRLF, *lines).alias("headers"), body.alias("body"), digest(body).alias("block_digest"), F.col("payload_digest").alias("source_digest"), "http_headers",
    ]


def derivatives(source: DataFrame) -> DataFrame:
    """Two records of each response: metadata (its digest, its headers, the size of its text) and conversion (its text).

    Both carry WARC-Refers-To, the response's record id; the source's headers and payload digest are kept in columns of
    their own and in the metadata body. A response without text gets an empty conversion. Records depend on nothing but
    their response: no shuffle, and a lost task writes the same records again.
    """
    text = source.withColumn("_text", plain_text(F.col("payload")))
    fields = F.concat_ws(
        CRLF, F.concat(F.lit("source-payload-digest: "), F.col("payload_digest")), F.concat(F.lit("source-content-length: "), F.octet_length("payload").cast("string")),
        F.concat(F.lit("text-length: "), F.length("_text").cast("string")), F.concat(F.lit("text-digest: "), digest(F.col("_text"))),
        F.concat(F.lit("source-http-headers: "), F.regexp_replace(F.trim(F.translate("http_headers", "\r", "")), "\\n", " | ")),
    )
    # One row becomes two by an array of structs, so that the text is made once.
    names = ["source_key", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "headers", "body", "block_digest", "source_digest", "http_headers"]
    kinds = [_record(METADATA, "application/warc-fields", F.col("_fields")), _record(CONVERSION, "text/plain; charset=utf-8", F.col("_text"))]
    ready = text.withColumn("_fields", fields)
    both = F.array(*[F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in zip(names, cols)]) for cols in kinds])
    return ready.select(F.explode(both).alias("r")).select("r.*")


def records(derived: DataFrame) -> DataFrame:
    """Each derivative as the text of a WARC record, ready to be written."""
    return derived.select("record_id", F.concat(F.col("headers"), F.lit(CRLF + CRLF), F.col("body"), F.lit(CRLF + CRLF)).alias("value"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivatives of all pages, with the bodies as lengths and digests."""
    out = derivatives(responses(table(spark, sf_dir, "pages")))
    return out.select(
        F.col("source_key").cast("long").alias("page_id"), "warc_type", "record_id", "refers_to", "target_uri", "source_digest", "block_digest",
        F.octet_length("body").cast("long").alias("content_length"), F.sha2(F.col("headers").cast("binary"), 256).alias("headers_sha256"),
    )
