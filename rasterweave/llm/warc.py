"""WARC archives: write records, and read them back by boundary chains.

Writing: every page is one record.  Of pages with equal payloads the one with
the smallest id is written whole (response), others refer to it (revisit).
Records are lines of a text file whose line end is the record end CRLF CRLF.

Reading: archives are split at each record magic, anywhere in the cluster and
whatever the file size.  A piece is only a candidate: the magic may stand in a
payload.  Each task emits its candidates with the offset at which their own
header says the next record begins; chains are followed inside each split, and
pointer jumping from the file's start joins the splits.  Only candidates that
the chain reaches are records.  A payload that holds the magic lies in several
pieces; only such records are put together again across rows.

Defined cases: a null payload is empty; payloads below ``least`` bytes are all
responses; pages that repeat an id and a payload are all responses or all
revisits; a null id is never referred to when another id has the payload; null
urls are written as ``urn:none``; an empty table gives no records.  A file that
ends inside a record, or has no record at its start, raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import new_path, stored

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
_FIELD = re.compile(rb"^([!-9;-~]+):[ \t]*(.*?)[ \t]*\r?$", re.M)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data = [x or b"" for x in b.column("payload").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("payload"), pa.array([base32_sha1(x) for x in data])], ["page_id", "url", "payload", "digest"])


def write_warc(pages: DataFrame, path: str, *, least: int = 0, date: str = "2024-01-01T00:00:00Z", most_broadcast: int = 100_000) -> None:
    """Write page_id, url, payload (binary or string) of every row to path.

    Payloads that occur more than once are looked up by digest: by a broadcast
    table while there are at most ``most_broadcast`` of them (about 10 MB), which
    leaves payloads where they are, and by a shuffled join beyond."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.regexp_replace("url", r"[\x00-\x20]", "%20"), F.lit("urn:none")).alias("url"), F.coalesce(F.col("payload").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.mapInArrow(_digests, "page_id long, url string, payload binary, digest string").withColumn("bytes", F.octet_length("payload"))
    firsts = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    firsts = stored(firsts.filter("n > 1").drop("n"), "warc-repeated")
    firsts = F.broadcast(firsts) if firsts.count() <= most_broadcast else firsts
    rows = rows.join(firsts.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("bytes") >= least), "left")
    revisit = F.coalesce(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    head = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), urn(F.col("first_id")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string"), F.lit(END), http,
    )
    body = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    # A cast from bytes to string keeps the bytes as they are.
    rows.select(F.concat(head.cast("binary"), body).cast("string").alias("value")).write.option("lineSep", END).text(path)


def parse(piece: bytes) -> dict | None:
    """Header of the record that begins with this piece, without its magic;
    None where no whole header stands."""
    cut = piece.find(b"\r\n\r\n")
    if cut < 0:
        return None
    fields = {k.lower(): v for k, v in _FIELD.findall(piece[:cut])}
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or len(length) > 15:
        return None
    return {"fields": fields, "body": cut + 4, "length": int(length), "span": len(MAGIC) + cut + 4 + int(length) + len(END)}


def contents(head: dict, block: bytes, payload: bool) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url and the
    payload.  The digest of a response is that of the bytes read."""
    fields, kind = head["fields"], head["fields"].get(b"warc-type", b"").decode()
    cut = block.find(b"\r\n\r\n")
    body = block[cut + 4 :] if cut >= 0 else block
    http = {k.lower(): v for k, v in _FIELD.findall(block[: max(cut, 0)])}
    number = lambda x: int(m[1]) if (m := re.search(rb":(-?\d+)>", x)) else None
    revisit = kind == "revisit"
    size = int(http.get(b"content-length", b"0")) if revisit else len(body)
    digest = fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:") if revisit else base32_sha1(body)
    return number(fields.get(b"warc-record-id", b"")), size, digest, kind, number(fields.get(b"warc-refers-to", b"")) if revisit else None, fields.get(b"warc-target-uri", b"").decode(errors="replace"), (None if revisit else body) if payload else None


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read_warc(spark: SparkSession, path: str, *, payload: bool = True) -> DataFrame:
    """Records of all archives under path: the columns of RECORD, and file and
    start.  Without payload, payloads are read for their digests but not kept."""
    magic = len(MAGIC)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = Sequence()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b, rows = whole.slice(at, 256), []
                for file, split, piece in zip(b.column("file").to_pylist(), b.column("split").to_pylist(), b.column("value").to_pylist(), strict=True):
                    head = parse(piece)
                    span = head["span"] if head else 0
                    whole_here = bool(head) and span == magic + len(piece)
                    record = contents(head, piece[head["body"] : head["body"] + head["length"]], payload) if whole_here else None
                    rows.append((file, split, seq.next(file, split), len(piece), span, record and dict(zip(names, record, strict=True))))
                yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in rows], schema=SCHEMA)

    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    record_type = pa.struct([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
    SCHEMA = pa.schema([("file", pa.string()), ("split", pa.int64()), ("seq", pa.int64()), ("length", pa.int64()), ("span", pa.int64()), ("record", record_type)])
    text = spark.read.option("lineSep", MAGIC).text(path)
    text = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))
    pieces = stored(text.mapInArrow(candidates, f"file string, split long, seq long, length long, span long, record struct<{RECORD.replace(', ', ',').replace(' ', ':')}>"), "warc-pieces")

    # Offsets: the file's first piece is what precedes its first magic.
    inside = W.partitionBy("file", "split").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    narrow = pieces.select("file", "split", "seq", "length", "span", F.col("record").isNotNull().alias("single"))
    splits = narrow.groupBy("file", "split").agg(F.sum(F.col("length") + magic).alias("bytes"))
    splits = splits.withColumn("base", F.sum("bytes").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, 0)) - F.col("bytes") - magic)
    placed = narrow.withColumn("upto", F.sum(F.col("length") + magic).over(inside)).join(splits.select("file", "split", "base"), ["file", "split"])
    placed = stored(placed.withColumn("at", F.col("base") + F.col("upto") - F.col("length") - magic).drop("upto", "base"), "warc-places")
    starts = reached(placed)
    if (bad := placed.groupBy("file").agg(F.max(F.col("at") + F.col("length") + magic).alias("end")).join(starts.groupBy("file").agg(F.max("next").alias("last")), "file", "left").filter("end > 0 AND NOT (last <=> end)").first()) is not None:
        raise ValueError(f"{bad['file']}: its records end at {bad['last']}, the file at {bad['end']}")
    single = starts.filter("single").select("file", "split", "seq")
    whole = pieces.filter("record IS NOT NULL").join(single, ["file", "split", "seq"], "left_semi").select(*[F.col(f"record.{n}").alias(n) for n in names], "file")

    # Records whose payload holds the magic: their pieces, in order.  Each piece
    # belongs to the last record that began before it, in its own split or, where
    # none did, in an earlier one; one row a split carries that over.
    record = F.when(F.col("on"), F.struct(F.col("at").alias("start"), "next", "one"))
    marks = placed.join(starts.select("file", "split", "seq", "next", F.col("single").alias("one"), F.lit(True).alias("on")), ["file", "split", "seq"], "left")
    marks = marks.select("file", "split", "seq", "at", F.last(record, ignorenulls=True).over(W.partitionBy("file", "split").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)).alias("own"))
    ends = marks.groupBy("file", "split").agg(F.max_by("own", "seq").alias("end"))
    before = F.last("end", ignorenulls=True).over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1))
    marks = marks.join(ends.select("file", "split", before.alias("before")), ["file", "split"]).withColumn("of", F.coalesce("own", "before"))
    spread = starts.filter("NOT single")
    parts = marks.filter("NOT of.one AND at < of.next").select("file", "split", "seq", "at", F.col("of.start").alias("start"))
    parts = parts.join(numbered(text), ["file", "split", "seq"])

    def joined(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["at", "value", "file"]).to_pylist(), key=lambda r: r["at"])
        data = MAGIC.encode().join(r["value"] for r in rows)
        head = parse(data)
        record = contents(head, data[head["body"] : head["body"] + head["length"]], payload)
        return pa.Table.from_pylist([dict(zip(names, record, strict=True)) | {"file": rows[0]["file"]}], schema=pa.schema([*record_type, ("file", pa.string())]))

    if spread.limit(1).count() == 0:
        return whole
    return whole.unionByName(parts.groupBy("file", "start").applyInArrow(joined, f"{RECORD}, file string"))


def numbered(text: DataFrame) -> DataFrame:
    """file, split, seq (from 0 in each split), value of rows of a text scan."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = Sequence()
        for b in batches:
            n = [seq.next(*x) for x in zip(b.column("file").to_pylist(), b.column("split").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("split"), pa.array(n, pa.int64()), b.column("value")], ["file", "split", "seq", "value"])

    return text.mapInArrow(count, "file string, split long, seq long, value binary")


class Sequence:
    """Counts rows of each split; a task reads a split's rows in order."""

    def __init__(self) -> None:
        self.at, self.n = None, 0

    def next(self, *at) -> int:
        self.n = self.n + 1 if at == self.at else 0
        self.at = at
        return self.n


def reached(placed: DataFrame) -> DataFrame:
    """Of candidates (file, split, seq, at, span, single) those on the chain from
    their file's start; next added."""
    nodes = placed.filter("span > 0 AND at >= 0").select("file", "split", "seq", "at", (F.col("at") + F.col("span")).alias("next"), "single")

    def exits(table: pa.Table) -> pa.Table:
        t = table.sort_by([("at", "descending")])
        out: dict[int, int] = {}
        for at, nxt in zip(t["at"].to_pylist(), t["next"].to_pylist(), strict=True):
            out[at] = out.get(nxt, nxt)
        return pa.table({"file": pa.repeat(t["file"][0].as_py(), t.num_rows), "at": pa.array(list(out), pa.int64()), "exit": pa.array(list(out.values()), pa.int64())})

    entries = nodes.filter("at = 0").select("file", "at")
    deepest = nodes.groupBy("file").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).first()[0] or 0
    if deepest > 1:
        jump = stored(nodes.select("file", "split", "at", "next").groupBy("file", "split").applyInArrow(exits, "file string, at long, exit long"), "warc-jump")
        # Only what another split points at, or a start, can be entered.
        aims = jump.select("file", F.col("exit").alias("at")).union(entries).distinct()
        jump, entries = stored(jump.join(aims, ["file", "at"], "left_semi"), "warc-jump"), stored(entries, "warc-entries")
        for _ in range((deepest - 1).bit_length() + 1):
            ahead = entries.join(jump, ["file", "at"]).select("file", F.col("exit").alias("at"))
            entries = stored(entries.union(ahead).distinct(), "warc-entries")
            twice = jump.alias("a").join(jump.alias("b"), F.expr("a.file = b.file AND a.exit = b.at"), "left")
            jump = stored(twice.select("a.file", "a.at", F.coalesce("b.exit", "a.exit").alias("exit")), "warc-jump")

    def follow(table: pa.Table) -> pa.Table:
        t = table.sort_by([("at", "ascending")])
        wanted, keep = set(), []
        for at, nxt, enter in zip(t["at"].to_pylist(), t["next"].to_pylist(), t["enter"].to_pylist(), strict=True):
            on = enter or at in wanted
            keep.append(on)
            if on:
                wanted.add(nxt)
        return t.filter(pa.array(keep, pa.bool_())).drop_columns(["enter"])

    entered = nodes.join(entries.withColumn("enter", F.lit(True)), ["file", "at"], "left").select("file", "split", "seq", "at", "next", "single", F.coalesce("enter", F.lit(False)).alias("enter"))
    return stored(entered.groupBy("file", "split").applyInArrow(follow, "file string, split long, seq long, at long, next long, single boolean"), "warc-chain")
