"""WARC derivatives: metadata and plain-text conversion records from responses.

A record is a row: ``record_id``, ``record_type``, ``target_uri``, ``date``, ``refers_to``,
``content_type``, ``block`` (its content) and ``digests``. :func:`derive` makes two records from
each response: *metadata* (title, outlinks, the response's status line, every source header
and both of its digests) and *conversion* (the page's text). Both keep the response's target and
date, and refer to its identifier. New identifiers are made from the response's identifier
and the record's type, so a second run gives the same records. All of it is one projection
of SQL functions and one explode by two: no shuffle, no state.

Digests are labelled ``sha256:`` with lowercase hex, as the format allows.

Defined results: a null page is an empty body; a null url is an empty target; a response
without a blank line has no body; repeated rows give repeated records with equal
identifiers; an empty table gives an empty table; other columns are ignored by :func:`responses`
and kept by :func:`derive` unless it makes a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

DATE = "2024-01-01T00:00:00Z"
_STATUS = "HTTP/1.1 200 OK"
_FIELDS = ("record_id", "record_type", "target_uri", "date", "refers_to", "content_type", "block")


def _uuid(seed: Column) -> Column:
    h = F.md5(seed)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def responses(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> DataFrame:
    """Pages as response records; the id column stays beside them."""
    body = F.coalesce(F.col(html), F.lit(""))
    head = F.concat(F.lit(f"{_STATUS}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"))
    target = F.coalesce(F.col(url), F.lit(""))
    d = pages.select(F.col(id_column), target.alias("target_uri"), F.concat(head, F.lit("\r\n\r\n"), body).alias("block"))
    return d.select(
        id_column,
        _uuid(F.concat_ws("|", F.lit("response"), F.coalesce(F.col(id_column).cast("string"), F.lit("null")), "target_uri")).alias("record_id"),
        F.lit("response").alias("record_type"),
        "target_uri",
        F.lit(date).alias("date"),
        F.lit(None).cast("string").alias("refers_to"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        "block",
    )


def text_of(html: Column) -> Column:
    """A page's text: no scripts, styles, comments or tags; block elements end lines; common entities are decoded."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)\s*>", " ")
    t = F.regexp_replace(t, r"(?i)</?(p|br|div|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|title|pre|blockquote)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", "")
    for entity, plain in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(plain))
    t = F.regexp_replace(t, r"[ \t\r\f]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r" ?\n[\n ]*", "\n"), r"^[\n ]+|[\n ]+$", "")


def derive(found: DataFrame) -> DataFrame:
    """The metadata and the conversion record of each response, with ``block_digest`` and, of the source, ``source_block_digest``, ``source_payload_digest``, ``source_status`` and ``source_headers``."""
    made = (*_FIELDS, "block_digest", "source_block_digest", "source_payload_digest", "source_status", "source_headers")
    keep = [c for c in found.columns if c not in made]
    d = found.where("record_type = 'response'").select(
        *keep, "record_id", "target_uri", "date", digest(F.col("block")).alias("source_block_digest"),
        F.regexp_extract("block", r"(?s)^(.*?)(\r\n\r\n|$)", 1).alias("__head"),
        F.expr("CASE WHEN instr(block, '\\r\\n\\r\\n') > 0 THEN substr(block, instr(block, '\\r\\n\\r\\n') + 4) ELSE '' END").alias("__body"),
    )
    d = d.select(
        "*", digest(F.col("__body")).alias("source_payload_digest"), F.split("__head", "\r\n").alias("__lines"),
        F.regexp_replace(F.regexp_extract("__body", r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ").alias("__title"),
        F.regexp_extract_all("__body", F.lit(r'(?i)<a\b[^>]*\bhref\s*=\s*"([^"]*)"'), 1).alias("__links"),
    )
    d = d.withColumns({"source_status": F.get("__lines", 0), "source_headers": F.slice("__lines", 2, F.greatest(F.size("__lines") - 1, F.lit(0)))})
    fields = F.concat(
        F.array(F.concat(F.lit("title: "), "__title"), F.concat(F.lit("status: "), "source_status")),
        F.transform("source_headers", lambda h: F.concat(F.lit("header: "), h)),
        F.array(F.concat(F.lit("block-digest: "), "source_block_digest"), F.concat(F.lit("payload-digest: "), "source_payload_digest")),
        F.transform("__links", lambda x: F.concat(F.lit("outlink: "), x)),
    )
    meta = F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content"), F.concat(F.array_join(fields, "\r\n"), F.lit("\r\n")).alias("block"))
    text = F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("content"), text_of(F.col("__body")).alias("block"))
    d = d.withColumn("__new", F.explode(F.array(meta, text)))
    return d.select(
        *keep, _uuid(F.concat_ws("|", "__new.type", "record_id")).alias("record_id"), F.col("__new.type").alias("record_type"), "target_uri", "date",
        F.col("record_id").alias("refers_to"), F.col("__new.content").alias("content_type"), F.col("__new.block").alias("block"),
        digest(F.col("__new.block")).alias("block_digest"), "source_block_digest", "source_payload_digest", "source_status", "source_headers",
    )


def to_warc(records: DataFrame) -> DataFrame:
    """Adds ``record``: the record as it stands in a WARC file."""
    named = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("Content-Type", "content_type"))
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c))) for name, c in named]
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines, F.concat(F.lit("WARC-Block-Digest: "), digest(F.col("block"))), F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")))
    return records.withColumn("record", F.concat(head, F.lit("\r\n\r\n"), "block", F.lit("\r\n\r\n")))


def from_warc(records: DataFrame, record: str = "record") -> DataFrame:
    """Rows of :func:`to_warc` text back to record columns; the block is exactly as long as its header says, or all that follows if it does not say."""
    found = F.instr(F.col(record), "\r\n\r\n")
    cut = F.when(found > 0, found).otherwise(F.length(record) + 1)
    d = records.withColumns({"__head": F.substring(F.col(record), F.lit(1), cut - 1), "__rest": F.substring(F.col(record), cut + 4, F.length(record))})
    value = lambda name: F.nullif(F.regexp_extract("__head", rf"(?im)^{name}: *([^\r\n]*)", 1), F.lit(""))
    names = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "content_type": "Content-Type"}
    d = d.withColumns({c: value(n) for c, n in names.items()}).withColumn("target_uri", F.coalesce("target_uri", F.lit("")))
    raw = F.encode("__rest", "UTF-8")
    length = F.coalesce(F.regexp_extract("__head", r"(?im)^Content-Length: *(\d+)", 1).try_cast("int"), F.octet_length("__rest"))
    return d.withColumn("block", F.decode(F.substring(raw, F.lit(1), length), "UTF-8")).drop("__head", "__rest", record)


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derive(responses(table(spark, sf_dir, "pages")))
    return d.select(
        "page_id", "record_id", "record_type", "target_uri", "refers_to", "content_type", "source_status", F.array_join("source_headers", "; ").alias("source_headers"),
        "source_block_digest", "source_payload_digest", "block_digest", F.octet_length("block").cast("long").alias("block_bytes"),
    )


_SQL_UUID = "'<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>'"


def _sql_uuid(seed: str) -> str:
    return "(SELECT " + _SQL_UUID + f" FROM (SELECT md5({seed}) AS h))"


def _sql_text() -> str:
    t = r"regexp_replace(body, '(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)\s*>', ' ', 'g')"
    t = rf"regexp_replace({t}, '(?i)</?(p|br|div|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|title|pre|blockquote)\b[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    for entity, plain in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = f"replace({t}, '{entity}', '{plain}')"
    t = rf"regexp_replace({t}, '[ \t\r\f]+', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({t}, ' ?\n[\n ]*', chr(10), 'g'), '^[\n ]+|[\n ]+$', '', 'g')"


SQL = {
    "op3_warc_derivatives": rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS body, chr(13) || chr(10) AS nl FROM pages),
r AS (SELECT *, {_sql_uuid("'response|' || coalesce(page_id::VARCHAR, 'null') || '|' || target_uri")} AS rid,
        ['Content-Type: text/html; charset=utf-8', 'Content-Length: ' || strlen(body)] AS headers FROM p),
s AS (SELECT *, 'sha256:' || sha256('{_STATUS}' || nl || array_to_string(headers, chr(13) || chr(10)) || nl || nl || body) AS bd, 'sha256:' || sha256(body) AS pd FROM r),
m AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
        array_to_string(list_concat(['title: ' || regexp_replace(regexp_extract(body, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'), 'status: {_STATUS}'],
          list_transform(headers, lambda h: 'header: ' || h), ['block-digest: ' || bd, 'payload-digest: ' || pd],
          list_transform(regexp_extract_all(body, '(?i)<a\b[^>]*\bhref\s*=\s*"([^"]*)"', 1), lambda x: 'outlink: ' || x)), chr(13) || chr(10)) || nl AS block FROM s
      UNION ALL SELECT *, 'conversion', 'text/plain; charset=utf-8', {_sql_text()} FROM s)
SELECT page_id, {_sql_uuid("record_type || '|' || rid")} AS record_id, record_type, target_uri, rid AS refers_to, content_type, '{_STATUS}' AS source_status,
       array_to_string(headers, '; ') AS source_headers, bd AS source_block_digest, pd AS source_payload_digest, 'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS block_bytes
FROM m"""
}
QUERIES = {"op3_warc_derivatives": op3_warc_derivatives}
