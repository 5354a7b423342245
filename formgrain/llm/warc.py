"""WARC archives: written with deduplicated payloads, read back with boundary-chain verification.

Writing: one record per page. Of pages with equal payloads the one with the smallest id is a ``response``, the others are
``revisit`` records without a block that name it. Spark's own text writer puts out the records (its line separator is the
blank line that ends a WARC record), so archives go to any file system and survive lost tasks.

Reading: archives are split anywhere. Spark's text reader cuts them at the record magic, whether that stands at a real
record or inside a payload. Each task walks its split and emits, for each magic with a readable header, a candidate offset
and the offset of its successor (from Content-Length). Within a split the candidates' chains are shortened to where they
leave it; between splits, pointer jumping from the start of each file marks the entries that are reachable. Only records on
the chain from the file's start are kept: a magic inside a payload is on no such chain. Bytes are never decoded, and
payloads are digested in the task that reads them; only a payload that holds a magic itself is put together by a second pass.

Defined cases: a null payload is empty; equal empty payloads are revisits like others unless ``least`` is larger; rows that
repeat the smallest id of a payload are all responses; a null id is written as an empty id, comes back as null and is never the
smallest while there is another; an
empty table gives no row; a record whose length runs past the end of its file ends the chain of that file.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formgrain.llm.common import materialise, prepare, shared_path, table

MAGIC = "WARC/1.1\r\n"
#: A WARC file's date; fixed, so that a task that runs twice writes the same bytes.
DATE = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 100_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> None:
    """Write ``pages`` as WARC files below ``path``. Payloads are shuffled once, compressed, to meet the first page of their digest."""
    kind = pages.schema[id_col].dataType.simpleString()

    def squeeze(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            payloads = [x or b"" for x in batch.column(2).to_pylist()]
            cols = [pa.array([hashlib.sha1(x).digest() for x in payloads], pa.binary()), pa.array([len(x) for x in payloads], pa.int64()), pa.array([packer.compress(x) for x in payloads], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["key", "url", "sha", "size", "packed"])

    def records(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for key, url, sha, size, packed, first in zip(*(c.to_pylist() for c in batch.columns)):
                again = first is not None and key != first
                head = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", f"<urn:page:{'' if key is None else key}>"), ("WARC-Date", DATE), ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", "%20", url or "")), ("WARC-Payload-Digest", f"sha1:{base64.b32encode(sha).decode()}")]
                if again:
                    head += [("WARC-Refers-To", f"<urn:page:{first}>"), ("WARC-Profile", REVISIT)]
                head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", "0" if again else str(size))]
                out.append((MAGIC + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + (b"" if again or not size else unpacker.decompress(packed)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).alias("url"), F.col(payload_col).cast("binary").alias("payload")).mapInArrow(squeeze, f"key {kind}, url string, sha binary, size long, packed binary")
    first = rows.where(F.col("size") >= least).groupBy("sha").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    values = rows.join(first, "sha", "left").select("key", "url", "sha", "size", "packed", "first").mapInArrow(records, "value string")
    values.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


HEADER = re.compile(rb"((?:[!-9;-~]+:[^\r\n]*\r\n)+)\r\n")
_FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*?)[ \t]*\r\n")
_PIECE = "file string, block long, at long, size long, head binary, body long, payload_bytes long, payload_digest string"
_RAW = "file string, block long, at long, line binary"
#: Bytes of a file in which a piece is looked up, when the payload of a record spans several pieces.
PART = 1 << 20


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _piece(file: str, block: int, at: int, line: bytes, first: bool):
    """What follows one magic. ``body``: bytes of the header with its magic, or -1 if none can be read there."""
    found = None if first else HEADER.match(line)
    if found:
        fields = {k.lower(): v for k, v in _FIELD.findall(found[1])}
        size = fields.get(b"content-length", b"")
        if size.isdigit():
            body, n = found.end(), int(size)
            if body + n + 4 <= len(line):  # no magic inside the payload: digested here, and its bytes stay here
                return file, block, at, len(line), found[1], body, n, _digest(line[body : body + n])
            return file, block, at, len(line), found[1], body, n, None
    return file, block, at, len(line), None, -1, None, None


def split_pieces(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """A row for what follows each magic: its offset in its split, and its header if it has one, or its bytes."""
    schema = _RAW if raw else _PIECE
    lines = spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))

    def run(batches):
        now, at = None, 0
        for batch in batches:
            out = []
            for file, block, line in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if now != (file, block):
                    now, at = (file, block), 0
                first = block == 0 and at == 0
                out.append((file, block, at, line) if raw else _piece(file, block, at, line, first))
                at += len(line) + len(MAGIC)
            if out:
                kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
                fields = [x.split() for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*out), fields)], [n for n, _ in fields])

    return lines.mapInArrow(run, schema)


def jump(at: list[int], to: list[int]) -> list[int]:
    """For each offset the first offset on its chain that is not among ``at``; both ascending, chains go forward."""
    out, where = list(to), {x: i for i, x in enumerate(at)}
    for i in range(len(at) - 1, -1, -1):
        j = where.get(out[i])
        if j is not None:
            out[i] = out[j]
    return out


def reachable(candidates: DataFrame) -> DataFrame:
    """Of (file, block, at, to), those on the chain from offset 0 of their file.

    ``exits`` has, for each candidate, where its chain leaves its split. Entries are doubled: after round r, every entry within
    2**r splits of the start is known, and each exit skips 2**r splits.
    """
    spark = candidates.sparkSession
    kind = "file string, block long, at long, leaves long"

    def shorten(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("at").sort_values("at")
        return rows.assign(leaves=jump(rows["at"].tolist(), rows["to"].tolist()))[["file", "block", "at", "leaves"]]

    exits = materialise(candidates.groupBy("file", "block").applyInPandas(shorten, kind), "exits")
    spots = exits.select("file", F.col("at").alias("leaves"))
    hops = materialise(exits.join(spots, ["file", "leaves"]).select("file", "at", "leaves"), "hops")  # that enter another split
    entries = exits.where("at = 0").select("file", "at")
    n = entries.count()
    while True:
        more = entries.join(hops, ["file", "at"]).select("file", F.col("leaves").alias("at"))
        entries = materialise(entries.unionByName(more).distinct(), "entries")
        m = entries.count()
        if m == n:
            break
        n = m
        nxt = hops.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("far"))
        hops = materialise(hops.join(nxt, ["file", "leaves"]).select("file", "at", F.col("far").alias("leaves")), "hops")

    def walk(key, rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        to, got = dict(zip(rows["at"], rows["to"])), []
        for at in sorted(starts["at"]):
            while at in to:
                got.append(at)
                at = to.pop(at)
        return pd.DataFrame({"file": key[0], "at": pd.Series(got, dtype="int64")})

    known = entries.join(exits.select("file", "block", "at"), ["file", "at"])
    return candidates.groupBy("file", "block").cogroup(known.groupBy("file", "block")).applyInPandas(walk, "file string, at long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, offset, header, payload_bytes, payload_digest (of the block that the record has)."""
    prepare(spark)
    parts = materialise(split_pieces(spark, path), "pieces")
    # What a split holds tells where the next one's first magic is.
    totals = parts.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("total"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("file", "block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))  # a row for each split of a file
    placed = parts.join(before, ["file", "block"]).withColumn("at", F.col("base") + F.col("at") - len(MAGIC))
    heads = placed.where("body >= 0").select("file", "block", "at", (F.col("at") + len(MAGIC) + F.col("body") + F.col("payload_bytes") + 4).alias("to"))
    kept = materialise(reachable(materialise(heads, "heads")), "kept")
    whole = placed.where("payload_digest is not null").join(kept, ["file", "at"], "left_semi").select("file", "at", "head", "payload_bytes", "payload_digest")
    # Payloads that hold a magic are rare: a second pass puts the pieces of each together.
    start = F.col("at") + len(MAGIC) + F.col("body")
    open_ = materialise(placed.where("body >= 0 and payload_digest is null").join(kept, ["file", "at"], "left_semi").select("file", F.col("at").alias("owner"), "head", F.col("payload_bytes").alias("n"), (start - F.col("at")).alias("skip"), (start + F.col("payload_bytes")).alias("end")), "open")
    if open_.isEmpty():
        return whole
    lines = split_pieces(spark, path, raw=True).join(before, ["file", "block"]).withColumn("at", F.col("base") + F.col("at") - len(MAGIC)).withColumn("part", F.expr(f"at div {PART}"))
    spans = open_.withColumn("part", F.explode(F.expr(f"sequence(owner div {PART}, end div {PART})")))

    def join_up(rows: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]
        data = b"".join(MAGIC.encode() + line for _, line in sorted(zip(rows["at"], rows["line"])))
        payload = data[row["skip"] : row["skip"] + row["n"]]
        return pd.DataFrame({"file": [row["file"]], "at": [row["owner"]], "head": [row["head"]], "payload_bytes": [len(payload)], "payload_digest": [_digest(payload)]})

    inside = lines.join(spans, ["file", "part"]).where("at >= owner and at < end").select("file", "owner", "head", "n", "skip", "at", "line")
    return whole.unionByName(inside.groupBy("file", "owner").applyInPandas(join_up, "file string, at long, head binary, payload_bytes long, payload_digest string"))


def header_field(head, name: str) -> F.Column:
    return F.trim(F.regexp_extract(head.cast("string"), rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1))


def records(rows: DataFrame) -> DataFrame:
    """Header fields as columns; a revisit takes size and digest of the payload that it refers to."""
    page = lambda name: F.regexp_extract(header_field(F.col("head"), name), r"^<urn:page:(.*)>$", 1)
    rows = rows.select(page("WARC-Record-ID").alias("id"), header_field(F.col("head"), "WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"), F.regexp_replace(header_field(F.col("head"), "WARC-Payload-Digest"), "^sha1:", "").alias("stated"), "payload_bytes", "payload_digest")
    own = rows.where("record_type = 'response'")
    sizes = own.groupBy("payload_digest").agg(F.max("payload_bytes").alias("full")).withColumnRenamed("payload_digest", "stated")
    back = rows.where("record_type = 'revisit'").join(sizes, "stated").select("id", "record_type", "refers_to", "stated", F.col("full").alias("payload_bytes"), F.col("stated").alias("payload_digest"))
    return own.unionByName(back)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Write, read back, and one row per page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    prepare(spark)
    path = shared_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, payload_col, least)
    kind = pages.schema[id_col].dataType
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    return records(materialise(read_archives(spark, path), "records")).select(number("id").alias("page_id"), F.col("payload_bytes").cast("long"), "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((c{i} >> {35 - 5 * j}) & 31 AS INTEGER), 1)" for i in range(4) for j in range(8))

ORACLE = {
    "op9_warc": f"""
WITH h AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
c AS (SELECT *, {', '.join(f"CAST('0x' || substr(h, {1 + 10 * i}, 10) AS BIGINT) AS c{i}" for i in range(4))}, min(page_id) OVER (PARTITION BY h) AS first FROM h)
SELECT page_id, payload_bytes, {_LETTERS} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM c""",
}
