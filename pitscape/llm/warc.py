"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing: a record is a string; the text writer sets the two line ends after each record as
its separator, so files are valid WARC/1.1, committed like any other Spark output.

Reading: the text reader cuts the archives at the magic ``WARC/1.1``, in splits of any
size and wherever it occurs, also inside payloads. Each piece is a candidate record at a byte offset
(pieces before it in its split, plus the sizes of the splits before); its header names the offset of its
successor. Pointer jumping from the start of each file keeps the offsets that the chain reaches. Pieces
that it does not reach belong to the payload of the record before them. All joins of the verification are on
offsets; payloads are exchanged only where a magic inside one has to be healed, or a repeated one be named.

Defined cases: a null html is an empty payload; a null url leaves its header out; control
characters in a url, and the magic in one, are percent-encoded, so they cannot end a header; a page without
an id has the empty id, and counts as the smallest id of its payload only if all are without; rows that repeat an id and a payload
are written and returned each; an empty table writes an empty archive and gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitscape.llm.common import columns, saved, small_batches
from pitscape.session import checkpoint_folder

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: A fixed date keeps archives of equal pages equal.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits in four runs of 40 bits, eight characters each."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, bytes and ``refers_to``: null for the smallest id of a payload and for short payloads."""
    p = columns(pages, "page_id", "url", "html").select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumns({"digest": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload").cast("long")})
    # a table of its own, so that the planner knows how many payloads repeat
    first = saved(p.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    refers = F.when((F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return p.join(first, "digest", "left").withColumn("refers_to", refers).drop("first")


def records(pages: DataFrame) -> DataFrame:
    """One string per record, without the two line ends that follow it."""
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")
    url = F.regexp_replace(url, r"WARC/1\.1", "WARC/1.%31")
    revisit = F.col("refers_to").isNotNull()
    identity = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    header = F.concat(
        F.lit(MAGIC),
        F.when(revisit, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        _line("WARC-Record-ID", identity(F.col("page_id"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _line("WARC-Refers-To", F.when(revisit, identity(F.col("refers_to")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
    )
    return pages.select(F.concat(header, block).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """One archive per task under ``path``; ``pages`` as :func:`deduplicated` returns them."""
    records(pages).write.option("lineSep", END).text(path)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to rows in the order of their split: ``inside``, the bytes before them in it, and ``n``, their own."""
    key, at = None, 0
    for batch in batches:
        path, split = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        n = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) + len(MAGIC)
        inside = np.zeros(len(n), np.int64)
        begin = 0
        for i in range(1, len(n) + 1):
            if i == len(n) or (path[i], split[i]) != (path[begin], split[begin]):
                if key != (path[begin], split[begin]):
                    key, at = (path[begin], split[begin]), 0
                inside[begin:i] = at + np.cumsum(n[begin:i]) - n[begin:i]
                at += int(n[begin:i].sum())
                begin = i
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside), pa.array(n)], ["path", "split", "value", "inside", "n"])


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """path, off (of its magic) and text of every piece between magics."""
    small_batches(spark)
    raw = spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), "value")
    placed = saved(raw.mapInArrow(_places, "path string, split long, value string, inside long, n long"), "zstd")  # the one copy of the payloads
    splits = placed.groupBy("path", "split").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = saved(splits.select("path", "split", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")))
    # the magic stands before its piece; the first piece of a file is the empty text before its first magic
    off = F.col("base") + F.col("inside") - len(MAGIC)
    return placed.join(splits, ["path", "split"]).select("path", off.alias("off"), "value").where("off >= 0")


def chain(candidates: DataFrame) -> DataFrame:
    """The (path, off) that following ``next`` from offset 0 of each file reaches.

    Round k knows who is reached within 2**k steps and where 2**k steps lead; both double,
    so the rounds grow with the logarithm of the records of a file.
    """
    jump = saved(candidates.select("path", "off", "next").where("next is not null"))
    reached = candidates.where("off = 0").select("path", "off")
    while not jump.isEmpty():
        further = reached.join(jump, ["path", "off"]).select("path", F.col("next").alias("off"))
        reached = saved(reached.union(further).distinct())
        onward = jump.select("path", F.col("off").alias("next"), F.col("next").alias("onward"))
        jump = saved(jump.join(onward, ["path", "next"]).select("path", "off", F.col("onward").alias("next")))
    # the last successor is the end of the file, where no record begins
    return reached.join(candidates.select("path", "off"), ["path", "off"], "left_semi")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest and payload (null for revisits) of every record."""
    pieces = _pieces(spark, path)
    head = F.instr("value", END)
    length = F.expr(r"try_cast(regexp_extract(substring(value, 1, instr(value, '\r\n\r\n') + 1), '(?:^|\r\n)Content-Length: ([0-9]{1,18})\r\n', 1) as bigint)")
    header_bytes = F.octet_length(F.substring_index("value", END, 1))
    successor = F.when(head > 0, F.col("off") + len(MAGIC) + header_bytes + len(END) + length + len(END))
    candidates = saved(pieces.select("path", "off", successor.alias("next")))
    starts = chain(candidates).withColumn("start", F.col("off"))
    upto = Window.partitionBy("path").orderBy("off").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = candidates.select("path", "off").join(starts, ["path", "off"], "left").select("path", "off", F.last("start", ignorenulls=True).over(upto).alias("start"))
    owner = saved(owner)
    # pieces that are not a whole record: parts of a healed one, or before any record
    healed = owner.where("off <> start").select("path", "start").distinct()
    odd = saved(owner.join(healed, ["path", "start"]).select("path", "off", "start").union(owner.where("start is null").select("path", "off", "start")))
    parts_of = F.transform(F.sort_array(F.collect_list(F.struct("off", "value"))), lambda x: x["value"])
    joined = pieces.join(odd.where("start is not null"), ["path", "off"]).groupBy("path", "start").agg(F.array_join(parts_of, MAGIC).alias("record"))
    whole = pieces.join(odd, ["path", "off"], "left_anti").select(F.col("value").alias("record")).union(joined.select("record"))
    field = lambda name, pattern: F.regexp_extract("header", rf"(?:^|\r\n){name}: {pattern}(?:\r\n|$)", 1)
    parts = whole.select(F.substring_index("record", END, 1).alias("header"), F.expr(r"substring(record, instr(record, '\r\n\r\n') + 4)").alias("block"))
    parts = parts.select("header", F.expr(r"substring_index(block, '\r\n\r\n', 1)").alias("http"), F.expr(r"substring(block, instr(block, '\r\n\r\n') + 4)").alias("payload"))
    revisit = field("WARC-Type", "(.*?)") == "revisit"
    parts = parts.withColumn("payload", F.when(~revisit, F.expr("substring(payload, 1, char_length(payload) - 4)")))
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    parts = parts.withColumns({"id": field("WARC-Record-ID", "<urn:page:(.*?)>"), "to": field("WARC-Refers-To", "<urn:page:(.*?)>"), "type": field("WARC-Type", "(.*?)"), "said": field("WARC-Payload-Digest", "sha1:(.*?)"), "sent": F.regexp_extract("http", r"Content-Length: ([0-9]+)", 1)})
    return parts.select(
        number("id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), number("sent")).alias("payload_bytes"),
        F.coalesce(base32_sha1(F.col("payload")), "said").alias("payload_digest"),
        F.col("type").alias("record_type"),
        number("to").alias("refers_to"),
        "payload",
    )


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write archives of ``pages`` to the shared folder and return what reading them gives."""
    path = f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(deduplicated(pages), path)
    return read_archives(spark, path)


ORACLE = """
with p as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hex from pages),
f as (select *, min(page_id) over (partition by hex) as first from p)
select page_id, strlen(payload)::bigint as payload_bytes,
  array_to_string(list_transform(range(4), lambda i: array_to_string(list_transform(range(8), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((cast('0x' || substr(hex, 1 + 10 * i::int, 10) as bigint) >> (35 - 5 * k::int)) & 31)::int + 1, 1)), '')), '') as payload_digest,
  case when page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first then first end as refers_to
from f
"""
