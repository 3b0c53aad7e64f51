"""Fixity audit of web archives by Merkle trees.

Records are dealt into archives and stand in order of their id; a leaf is the SHA-256 of a record's WARC
bytes, and an inner node hashes an ordered range of ``FANOUT`` children, so it stands for a range of offsets. Above the archives,
a node hashes a run of ``SPAN`` archives, and so on up to one root for the whole replica.
Two replicas are compared by their roots. Only below a mismatch are the children joined, level by level,
down to the records that differ, are missing or are extra. A record's place is its id, not its offset, so a
missing record doesn't shift its followers.

Only ids, lengths and hashes are shuffled, never page contents; each level is written once; groups have ``SPAN`` rows at most, whatever the ids are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import durable, table

RECORDS, FANOUT = 1000, 16
#: Levels of an archive's tree above its records: 16, 256, and the archive's root.
LEVELS = 3
#: Archives in a node of the next level, as a power of two, and levels above archives: five hold all 64-bit ids.
SPAN_BITS, TOP = 12, LEVELS + 5
SPAN = 1 << SPAN_BITS
#: The archive of records without an id: the one before that of the least id.
NO_ID = -(1 << 63) // RECORDS - 1
#: Bytes of records that a reader hands on at once.
HELD_BYTES = 8 << 20


def warc_record(record_id: Column, url: Column, body: Column) -> Column:
    """A WARC 1.0 response record without its closing empty lines; nulls count as empty."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body,
    )


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Write rows as uncompressed WARC files, one for each partition."""
    df.select(warc_record(F.col(id_col), F.col(url_col), F.col(body_col)).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


_HEAD = re.compile(rb"WARC/\d")
_BLANK = re.compile(rb"\r\n\r\n")
_LENGTH = re.compile(rb"\s*(\d{1,18})\s*$")


def records(data) -> Iterator[tuple[int, int, str | None, str | None, bytes]]:
    """(offset, length, record id, url, body) of the records in a buffer, which is read in place.

    A Content-Length that is missing or no number ends its record at the next record's head or the end. A record cut short comes with the body it has.
    """
    view = memoryview(data)
    at = 0
    while m := _HEAD.search(view, at):
        at = m.start()
        blank = _BLANK.search(view, at)
        if not blank:
            return
        head = {}
        for line in bytes(view[at : blank.start()]).split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            head[name.strip().lower()] = value.strip()
        start = blank.end()
        n = _LENGTH.match(head.get(b"content-length", b""))
        if n:
            end = min(len(view), start + int(n[1]))
        else:
            later = _HEAD.search(view, start)
            end = later.start() if later else len(view)
        named = [head[k].decode("utf-8", "replace") if k in head else None for k in (b"warc-record-id", b"warc-target-uri")]
        yield at, end - at, *named, bytes(view[start:end])
        at = end


def members(data) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of a buffer; one that is damaged comes with what could be read, and is the last."""
    view, at = memoryview(data), 0
    while at < len(view):
        d = zlib.decompressobj(31)
        parts = []
        try:
            for k in range(at, len(view), 1 << 16):
                parts.append(d.decompress(view[k : k + (1 << 16)]))
                if d.eof:
                    break
        except zlib.error:
            d = None
        end = len(view) if d is None or not d.eof else min(k + (1 << 16), len(view)) - len(d.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, length, record_id, url, body) of each record of WARC files, read by their Content-Length.

    Each file is one row of Spark's binary reader, so files are at most 2 GB, as archives usually are. Gzip files hold a member for each record;
    offset and length are then the member's. See ``records`` and ``members`` for what is malformed; bytes before the first record are skipped.
    """
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = ["file", "offset", "length", "record_id", "url", "body"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    def found(name: str, data) -> Iterator[tuple]:
        if bytes(memoryview(data)[:2]) == b"\x1f\x8b":
            for offset, length, content in members(data):
                for _, _, *rest in records(content):
                    yield name, offset, length, *rest
        else:
            for r in records(data):
                yield name, *r

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, size = [], 0
                for r in found(name, data.as_buffer() if data.is_valid else b""):
                    rows.append(r)
                    size += len(r[-1])
                    if size > HELD_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
                yield batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parsed, "file string, offset long, length long, record_id string, url string, body binary")


def floor_div(x: Column, n: int) -> Column:
    """x / n rounded down, for all 64-bit numbers."""
    return F.call_function("div", x, F.lit(n).cast("long")) - F.when(x % n < 0, 1).otherwise(0)


def leaves(df: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(archive, slot, offset, length, hash): a row for each record id, in its archive's order.

    Rows of one id are one leaf over the multiset of their records, so repeated rows count. Rows without an id are one leaf in archive ``NO_ID``.
    """
    record = warc_record(F.col(id_col), F.col(url_col), F.col(body_col))
    key = F.col(id_col).cast("long")
    archive = F.when(key.isNull(), F.lit(NO_ID)).otherwise(floor_div(key, RECORDS))
    r = df.select(archive.alias("archive"), F.coalesce(F.pmod(key, F.lit(RECORDS)), F.lit(0)).alias("slot"), (F.octet_length(record) + 4).cast("long").alias("length"), F.sha2(record, 256).alias("hash"))
    part = lambda at: F.sum(F.conv(F.substring("hash", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    many = F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[part(at) for at in (1, 16, 31, 46)]), 256)
    r = r.groupBy("archive", "slot").agg(F.sum("length").alias("length"), F.when(F.count("*") == 1, F.max("hash")).otherwise(many).alias("hash"))
    before = Window.partitionBy("archive").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return r.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def parent(level: int) -> tuple[Column, Column, Column]:
    """(archive, node, place) of the node above one of ``level``, and the child's place in it. Above archives, ``archive`` is the number of a run and ``node`` is 0."""
    archive, node = F.col("archive"), F.col("node")
    if level < LEVELS:
        return archive, F.shiftright(node, 4) if level + 1 < LEVELS else F.lit(0).cast("long"), node
    return (F.shiftright(archive, SPAN_BITS) if level + 1 < TOP else F.lit(0).cast("long")), F.lit(0).cast("long"), archive


def tree(leaf: DataFrame, name: str = "fixity") -> list[DataFrame]:
    """Nodes by level, records first: (archive, node, offset, end, hash), each level written once. Above archives there are no offsets."""
    out = [leaf.select("archive", F.col("slot").alias("node"), "offset", (F.col("offset") + F.col("length")).alias("end"), "hash")]
    for level in range(TOP):
        archive, node, place = parent(level)
        child = out[-1].select(archive.alias("archive"), node.alias("node"), "offset", "end", F.struct(place.alias("place"), F.concat_ws(":", place.cast("string"), "hash").alias("child")).alias("c"))
        up = child.groupBy("archive", "node").agg(F.min("offset").alias("offset"), F.max("end").alias("end"), F.array_sort(F.collect_list("c")).alias("c"))
        none = F.lit(None).cast("long")
        ends = ("offset", "end") if level < LEVELS else (none.alias("offset"), none.alias("end"))
        up = up.select("archive", "node", *ends, F.sha2(F.array_join(F.transform("c", lambda x: x["child"]), ","), 256).alias("hash"))
        out.append(durable(up, f"{name}-{level + 1}"))
    return out


def audit(primary: DataFrame, replica: DataFrame, **cols: str) -> DataFrame:
    """(archive, level, node, offset, end, status): the root, and below a mismatch only the nodes that differ.

    ``status`` is same (the root only), differs, missing (not in the replica) or extra (only there). Level 0 are records, whose node is
    the record's place in its archive; level 3 are archives; above, ``archive`` is the number of a run of archives, and level 8 is the root. Offsets
    are the primary's, or the replica's for what is extra; there are none above archives. Two empty tables give no rows.
    """
    a = tree(durable(leaves(primary, **cols), "fixity-primary"), "fixity-primary")
    b = tree(durable(leaves(replica, **cols), "fixity-replica"), "fixity-replica")
    seen: list[DataFrame] = []
    for level in range(TOP, -1, -1):
        x, y = a[level], b[level]
        if seen:  # descend below mismatches only
            suspects = seen[-1].filter("status <> 'same'").select(F.col("archive").alias("in_archive"), F.col("node").alias("in_node"))
            archive, node, _ = parent(level)
            on = [F.col("above.archive") == F.col("in_archive"), F.col("above.node") == F.col("in_node")]
            x, y = (t.withColumn("above", F.struct(archive.alias("archive"), node.alias("node"))).join(suspects, on, "left_semi").drop("above") for t in (x, y))
        both = x.alias("x").join(y.alias("y"), ["archive", "node"], "full")
        status = F.when(F.col("y.hash").isNull(), "missing").when(F.col("x.hash").isNull(), "extra").when(F.col("x.hash") == F.col("y.hash"), "same").otherwise("differs")
        found = both.select("archive", F.lit(level).alias("level"), "node", F.coalesce("x.offset", "y.offset").alias("offset"), F.coalesce("x.end", "y.end").alias("end"), status.alias("status"))
        seen.append(durable(found if level == TOP else found.filter("status <> 'same'"), f"fixity-found-{level}"))
        if not seen[-1].filter("status <> 'same'").take(1):
            break
    out = seen[0]
    for x in seen[1:]:
        out = out.unionByName(x)
    return out


def audit_files(spark: SparkSession, primary: str, replica: str) -> DataFrame:
    """``audit`` of two folders of WARC files as ``write_warc`` makes them; records without such an id stand together in archive ``NO_ID``."""

    def rows(path: str) -> DataFrame:
        number = F.regexp_extract("record_id", r"^<urn:page:(-?\d+)>$", 1)
        return read_warc(spark, path).select(F.when(number != "", number).cast("long").alias("page_id"), "url", F.col("body").cast("string").alias("html"))

    return audit(rows(primary), rows(replica))


def damaged(pages: DataFrame) -> DataFrame:
    """A stand-in for a second replica: some records altered, some cut, some lost, by fixed rules on the id."""
    html = F.when(F.col("page_id") % 211 == 7, F.concat(F.lit("?"), F.col("html"))).when(F.col("page_id") % 307 == 5, F.lit("")).otherwise(F.col("html"))
    return pages.filter(F.coalesce(F.col("page_id") % 401 != 3, F.lit(True))).withColumn("html", html)


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(pages, damaged(pages))


def _tree_sql(name: str, source: str) -> str:
    record = r"""'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
      || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')"""
    sums = " || ':' || ".join(f"sum(('0x' || substr(hash, {at}, 15))::BIGINT)::VARCHAR" for at in (1, 16, 31, 46))
    sql = f"""{name}r AS (SELECT coalesce(page_id // {RECORDS} - (page_id % {RECORDS} < 0)::INTEGER, {NO_ID})::BIGINT AS archive, coalesce(((page_id % {RECORDS}) + {RECORDS}) % {RECORDS}, 0) AS slot, strlen(rec) + 4 AS length, sha256(rec) AS hash FROM (SELECT page_id, {record} AS rec FROM {source})),
{name}l AS (SELECT archive, slot, sum(length)::BIGINT AS length, CASE WHEN count(*) = 1 THEN max(hash) ELSE sha256(count(*) || ':' || {sums}) END AS hash FROM {name}r GROUP BY ALL),
{name}0 AS (SELECT archive, slot AS node, (sum(length) OVER w - length)::BIGINT AS "offset", (sum(length) OVER w)::BIGINT AS "end", hash FROM {name}l WINDOW w AS (PARTITION BY archive ORDER BY slot))"""
    for level in range(TOP):
        archive = "archive" if level < LEVELS else f"archive >> {SPAN_BITS}" if level + 1 < TOP else "0::BIGINT"
        node = f"node // {FANOUT}" if level + 1 < LEVELS else "0::BIGINT"
        place = "node" if level < LEVELS else "archive"
        ends = 'min("offset") AS "offset", max("end") AS "end"' if level < LEVELS else 'NULL::BIGINT AS "offset", NULL::BIGINT AS "end"'
        sql += f""",
{name}{level + 1} AS (SELECT {archive} AS archive, {node} AS node, {ends}, sha256(string_agg({place} || ':' || hash, ',' ORDER BY {place})) AS hash FROM {name}{level} GROUP BY {archive}, {node})"""
    return sql


_LEVEL = """SELECT archive, {n} AS level, node, coalesce(x."offset", y."offset") AS "offset", coalesce(x."end", y."end") AS "end",
  CASE WHEN y.hash IS NULL THEN 'missing' WHEN x.hash IS NULL THEN 'extra' WHEN x.hash = y.hash THEN 'same' ELSE 'differs' END AS status
FROM a{n} x FULL JOIN b{n} y USING (archive, node)"""
QUERIES = {"op6_warc_fixity": op6_warc_fixity}
ORACLE = {
    "op6_warc_fixity": f"""
WITH damaged AS (SELECT page_id, url, CASE WHEN page_id % 211 = 7 THEN '?' || html WHEN page_id % 307 = 5 THEN '' ELSE html END AS html FROM pages WHERE coalesce(page_id % 401 <> 3, true)),
{_tree_sql("a", "pages")},
{_tree_sql("b", "damaged")}
SELECT * FROM ({" UNION ALL ".join(_LEVEL.format(n=n) for n in range(TOP + 1))}) WHERE level = {TOP} OR status <> 'same'"""
}
