"""WARC derivative builder: response records become linked metadata and plain-text conversion records.

``responses`` gives crawled pages the form of WARC response records; ``derive`` makes two records of
each, both referring to the response's identifier and carrying its source headers and payload
digest; ``write_warc`` writes records as gzip members, and ``read_warc`` reads such files.
All but the file access is made of DataFrame operations, which run where the pages are read: no
shuffle. Digests are labelled SHA-256 values in lowercase hex.

Defined results: a null html counts as empty and a null url as empty; empty payloads give records
with an empty block; rows that are equal in id, url and html give equal records with the same identifiers, and
all others have identifiers of their own; comments, scripts and tags left open go on to the page's end; an empty
table gives no records; other columns of the input are ignored.
"""

from __future__ import annotations

import gzip
import io
import uuid
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import bound, ship, text_or_empty

# The patterns that turn HTML into text, in the order of their use. What's left open goes on to the
# end of the page, as in browsers; so every opening matches and nothing is searched twice.
DROP = "(?is)<!--.*?(?:-->|\\z)|" + "|".join(rf"<{x}\b[^>]*(?:\z|>.*?(?:</{x}\s*>|\z))" for x in ("script", "style", "noscript"))
BREAK = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*(?:>|\z)"
TAG = r"<(?:/?[A-Za-z]|[!?/])[^>]*(?:>|\z)"
BLANKS, LINES = r"[ \t\r\f]+", r" ?\n[ \n]*"
TITLE, TITLE_END = r"(?i)<title\b[^>]*(?:>|\z)", r"(?i)</title\s*>"
ANCHOR, HREF = r"(?i)<a\s[^>]*", r"""(?i)\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)"""
ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: Named entities by the standard library's table of HTML 4; a no-break space is a blank.
NAMES = {**{name: chr(n) for name, n in sorted(name2codepoint.items())}, "apos": "'", "nbsp": " "}
HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _digest(col: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col, 256))


def decoded(text: Column) -> Column:
    """``text`` with its entities, named and numeric, as characters; what's no known entity stays as it is."""
    names = F.split(F.lit(",".join(NAMES)), ",")
    chars = F.split(F.lit(",".join(NAMES.values())), ",")

    def known(m: Column, x: Column) -> Column:
        number = F.when(F.lower(F.substring(m, 2, 1)) == "x", F.conv(F.substring(m, 3, 6), 16, 10)).otherwise(F.substring(m, 2, 7)).cast("int")
        usable = ((number > 0) & (number < 0xD800)) | ((number > 0xDFFF) & (number <= 0x10FFFF))
        number = F.when(number == 160, 32).when(usable, number).otherwise(0xFFFD)
        char = F.when(m.startswith("#"), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise(F.try_element_at(chars, F.nullif(F.array_position(names, m), F.lit(0)).cast("int")))
        return F.coalesce(F.concat(char, F.substr(x, F.char_length(m) + 2)), F.concat(F.lit("&"), x))

    def one(x: Column, i: Column) -> Column:
        return F.when(i == 0, x).otherwise(bound(F.regexp_extract(x, ENTITY, 1), lambda m: F.when(m == "", F.concat(F.lit("&"), x)).otherwise(known(m, x))))

    return bound(text, lambda t: F.when(t.contains("&"), F.array_join(F.transform(F.split(t, "&"), one), "")).otherwise(t))


def plain_text(html: Column) -> Column:
    """The text of an HTML page: scripts, styles and comments go, block tags break lines, blanks collapse."""
    t = F.regexp_replace(html, DROP, " ")
    t = F.regexp_replace(t, BREAK, "\n")
    t = decoded(F.regexp_replace(t, TAG, ""))
    t = F.regexp_replace(F.regexp_replace(t, BLANKS, " "), LINES, "\n")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+\z", "")


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, record_id, target_uri, http_headers, payload, payload_digest: the source records."""
    url, html = text_or_empty(F.col(url_col)), text_or_empty(F.col(html_col))
    page = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return pages.select(
        F.col(id_col).alias("page_id"),
        _urn(F.lit("response"), page, url, F.sha2(html, 256)).alias("record_id"),
        url.alias("target_uri"),
        F.concat(F.lit(HEAD), F.octet_length(html).cast("string"), F.lit("\r\n")).alias("http_headers"),
        html.alias("payload"),
        _digest(html).alias("payload_digest"),
    )


def derive(source: DataFrame) -> DataFrame:
    """Two records for each response: record_type ``metadata`` and ``conversion``."""
    text = plain_text(F.col("payload"))
    inside = F.split(F.try_element_at(F.split("payload", TITLE, 2), F.lit(2)), TITLE_END, 2)
    title = F.when(F.size(inside) == 2, F.trim(F.regexp_replace(decoded(F.regexp_replace(inside[0], TAG, "")), r"[ \t\r\n\f]+", " "))).otherwise("")
    hrefs = F.filter(F.transform(F.regexp_extract_all("payload", F.lit(ANCHOR), F.lit(0)), lambda a: F.regexp_extract(a, HREF, 1)), lambda x: x != "")
    links = F.transform(hrefs, lambda x: decoded(F.when(x.rlike("^[\"']"), F.substr(x, F.lit(2), F.char_length(x) - 2)).otherwise(x)))
    wide = source.withColumn("_w_text", text).withColumn("_w_title", title).withColumn("_w_links", links)
    fields = F.concat(
        F.lit("title: "), F.col("_w_title"),
        F.lit("\r\npayload-length: "), F.octet_length("payload").cast("string"),
        F.lit("\r\ntext-length: "), F.octet_length("_w_text").cast("string"),
        F.lit("\r\noutlinks: "), F.size("_w_links").cast("string"),
        F.array_join(F.transform("_w_links", lambda x: F.concat(F.lit("\r\noutlink: "), x)), ""),
        F.lit("\r\n"),
    )
    made = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), F.col("_w_text").alias("block")),
    )
    each = wide.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", F.col("http_headers").alias("source_headers"), "payload_digest", F.explode(made).alias("r"))
    return each.select(
        "page_id",
        "r.record_type",
        _urn(F.col("r.record_type"), F.col("refers_to")).alias("record_id"),
        "refers_to",
        "target_uri",
        "r.content_type",
        "source_headers",
        "payload_digest",
        _digest(F.col("r.block")).alias("block_digest"),
        F.octet_length("r.block").cast("long").alias("content_length"),
        "r.block",
    )


def record_bytes(row: dict, date: str) -> bytes:
    """One WARC/1.1 record."""
    block = row["block"].encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {row['record_id']}",
        f"WARC-Refers-To: {row['refers_to']}",
        f"WARC-Target-URI: {row['target_uri']}",
        f"WARC-Date: {date}",
        f"WARC-Source-Payload-Digest: {row['payload_digest']}",
        *(f"WARC-Source-Header: {x}" for x in row["source_headers"].split("\r\n") if x),
        f"WARC-Block-Digest: {row['block_digest']}",
        f"Content-Type: {row['content_type']}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", file_bytes: int = 64 << 20) -> DataFrame:
    """Write ``records`` under the URI ``folder`` as .warc.gz files, a gzip member for each record; one row (path, records) for each file."""
    ship(records.sparkSession)

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        buffer, n = io.BytesIO(), 0

        def close():
            name = f"{top}/{uuid.uuid4().hex}.warc.gz"  # a retried task writes anew; only files that are returned count
            with store.open_output_stream(name, compression=None) as f:
                f.write(buffer.getvalue())
            return pa.RecordBatch.from_pydict({"path": [name], "records": [n]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

        for batch in batches:
            for row in batch.to_pylist():
                buffer.write(gzip.compress(record_bytes(row, date), 6, mtime=0))
                n += 1
                if buffer.tell() >= file_bytes:
                    yield close()
                    buffer, n = io.BytesIO(), 0
        if n:
            yield close()

    return records.mapInArrow(write, "path string, records long")


def parse_warc(data: bytes) -> list[dict]:
    """The records of one .warc.gz file: their headers, and ``block``."""
    out, at, data = [], 0, gzip.decompress(data)
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        fields: dict = {"WARC-Source-Header": []}
        for name, _, value in (x.partition(": ") for x in lines[1:]):
            if name == "WARC-Source-Header":
                fields[name].append(value)
            else:
                fields[name] = value
        size = int(fields["Content-Length"])
        fields["block"] = data[end + 4 : end + 4 + size].decode()
        out.append(fields)
        at = end + 4 + size + 4
    return out


def warc_query(spark, sf_dir: str) -> DataFrame:
    return derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def _sql_decoded(x: str) -> str:
    quoted = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
    m = f"regexp_extract(x, '{ENTITY}', 1)"
    number = f"(CASE WHEN lower({m}[2]) = 'x' THEN ('0x' || {m}[3:])::INTEGER ELSE {m}[2:]::INTEGER END)"
    char = f"(CASE WHEN {number} = 160 THEN ' ' WHEN {number} BETWEEN 1 AND 55295 OR {number} BETWEEN 57344 AND 1114111 THEN chr({number}) ELSE chr(65533) END)"
    known = f"({quoted(NAMES.values())})[list_position({quoted(NAMES)}, {m})]"
    each = f"CASE WHEN i = 1 THEN x WHEN {m} = '' THEN '&' || x WHEN {m}[1] = '#' THEN {char} || x[length({m}) + 2:] ELSE coalesce({known} || x[length({m}) + 2:], '&' || x) END"
    return f"array_to_string(list_transform(string_split({x}, '&'), lambda x, i: {each}), '')"


def _sql_text() -> str:
    t = f"regexp_replace(html, '{DROP}', ' ', 'g')"
    t = _sql_decoded(f"regexp_replace(regexp_replace({t}, '{BREAK}', chr(10), 'g'), '{TAG}', '', 'g')")
    t = f"regexp_replace(regexp_replace({t}, '{BLANKS}', ' ', 'g'), '{LINES}', chr(10), 'g')"
    return rf"regexp_replace({t}, '^[ \n]+|[ \n]+$', '', 'g')"


def _sql_urn(x: str) -> str:
    return "'<urn:uuid:' || substr({0},1,8) || '-' || substr({0},9,4) || '-' || substr({0},13,4) || '-' || substr({0},17,4) || '-' || substr({0},21,12) || '>'".format(f"md5({x})")


WARC_SQL = rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, url, html, {_sql_urn("'response|' || coalesce(page_id::VARCHAR, '') || '|' || url || '|' || sha256(html)")} AS refers_to,
    '{HEAD.split(chr(13))[0]}' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) AS source_headers,
    'sha256:' || sha256(html) AS payload_digest, {_sql_text()} AS text,
    trim(regexp_replace({_sql_decoded("regexp_replace(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1), '" + TAG + "', '', 'g')")}, '[ \t\r\n\f]+', ' ', 'g')) AS title,
    list_transform(list_filter(list_transform(regexp_extract_all(html, '{ANCHOR}'), lambda a: regexp_extract(a, '{HREF.replace(chr(39), chr(39) * 2)}', 1)), lambda h: h <> ''),
        lambda h: {_sql_decoded("(CASE WHEN h[1] IN (chr(34), chr(39)) THEN h[2:-2] ELSE h END)")}) AS links FROM p),
r AS (SELECT *, 'conversion' AS record_type, 'text/plain' AS content_type, text AS block FROM s
    UNION ALL SELECT *, 'metadata', 'application/warc-fields', 'title: ' || title || chr(13) || chr(10) || 'payload-length: ' || strlen(html) || chr(13) || chr(10) || 'text-length: ' || strlen(text)
    || chr(13) || chr(10) || 'outlinks: ' || len(links) || coalesce(array_to_string(list_transform(links, lambda x: chr(13) || chr(10) || 'outlink: ' || x), ''), '') || chr(13) || chr(10) FROM s)
SELECT page_id, record_type, {_sql_urn("record_type || '|' || refers_to")} AS record_id, refers_to, url AS target_uri, content_type, source_headers, payload_digest,
    'sha256:' || sha256(block) AS block_digest, strlen(block) AS content_length, block FROM r
"""
