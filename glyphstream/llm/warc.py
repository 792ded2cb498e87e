"""WARC archives: write records, segment long ones, read them back and reassemble.

Writing: each payload becomes an HTTP response in chunked transfer framing inside a WARC/1.1 response record; blocks above `segment`
bytes continue in continuation records that name the origin's id and their segment number, the last with the total length. A
payload that an earlier record already has becomes a revisit record without a body. Records are gzip members,
gathered into archives of about `archive_bytes`, and archives are rows of a Parquet table in the shared folder, so any store that
Spark writes can hold them and a lost executor's task is simply run again. write_files and read_files exchange them with
.warc.gz (and plain .warc) files.

Reading: archives are parsed record by record; only segmented records are shuffled, by origin id, put in the order of
their numbers, and held to the total length and to a gapless numbering before the chunked framing is decoded. A revisit's
payload is that of the record it refers to, found by a join of the narrow decoded rows.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstream.llm.common import fresh_path, materialize, read

RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, segment int, origin_id string, total_length bigint, page_id bigint, refers_page bigint, body binary"


class WarcError(ValueError):
    """A record, a set of segments or a transfer framing that is not whole."""


def chunked(payload: bytes, size: int = 8192) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[k : k + size] for k in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunk(framed: bytes) -> bytes:
    """Payload of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        eol = framed.find(b"\r\n", at)
        if eol < 0:
            raise WarcError("chunk size line without an end")
        try:
            n = int(framed[at:eol].split(b";")[0].strip(), 16)
        except ValueError:
            raise WarcError("chunk size is not a hexadecimal number") from None
        at = eol + 2
        if n == 0:
            return b"".join(out)
        if framed[at + n : at + n + 2] != b"\r\n":
            raise WarcError("chunk shorter than its size")
        out.append(framed[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes:
    """Payload of an HTTP response message, its transfer framing decoded."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise WarcError("HTTP message without an end of its headers")
    names = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return dechunk(body) if names.get(b"transfer-encoding") == b"chunked" else body


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def zipped(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def records(archive: bytes):
    """(headers, block) of each record of an archive, plain or of gzip members."""
    if archive[:2] == b"\x1f\x8b":
        while archive:
            z = zlib.decompressobj(31)
            raw = z.decompress(archive) + z.flush()
            if not z.eof:
                raise WarcError("gzip member without an end")
            archive = z.unused_data.lstrip(b"\x00")
            yield from _plain(raw)
    else:
        yield from _plain(archive)


def _plain(raw: bytes):
    at = 0
    while at < len(raw):
        end = raw.find(b"\r\n\r\n", at)
        if end < 0 or raw[at : at + 5] != b"WARC/":
            raise WarcError("no record where one should begin")
        names = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw[at:end].decode("utf-8").split("\r\n")[1:])}
        try:
            n = int(names["content-length"])
        except (KeyError, ValueError):
            raise WarcError("record without a length") from None
        block = raw[end + 4 : end + 4 + n]
        if len(block) < n:
            raise WarcError("record shorter than its length")
        yield names, block
        at = end + 4 + n
        while raw[at : at + 2] == b"\r\n":
            at += 2


def record_name(page_id: int | None, mark: str = "") -> str:
    """Record id of a page; the mark tells apart records of pages that share an id or have none."""
    return f"<urn:page:{'none' if page_id is None else page_id}{mark and ':'}{mark}>"


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment: int, mark: str = "") -> list[bytes]:
    """The records of one page: a revisit, a response, or a response and its continuations. The response that revisits refer to is marked by its digest."""
    me, uri = record_name(page_id, mark), "".join((url or "urn:none").split())
    common = [*([("X-Page-ID", str(page_id))] if page_id is not None else []), ("WARC-Target-URI", uri), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", me), ("WARC-Refers-To", record_name(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *common, ("Content-Type", "application/http; msgtype=response")], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    head = [("WARC-Type", "response"), ("WARC-Record-ID", me), *common, ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment:
        return [record(head, block)]
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    out = [record([*head, ("WARC-Segment-Number", "1")], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else []
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{me[:-1]}:{n}>"), ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", str(n)), ("WARC-Target-URI", uri), ("WARC-Date", "1970-01-01T00:00:00Z"), *last], part))
    return out


def with_revisits(pages: DataFrame, html: str = "html", least: int = 100, small: int = 200_000) -> DataFrame:
    """pages (page_id, url, html) with payload, digest, refers_to (the smallest page_id of those with an equal payload of `least` bytes) and
    lead, true for the one row that revisits of its payload refer to.

    A payload that very many pages share is one row of the grouped minimum. Digests that occur twice are gathered first: up to `small` of
    them (some 100 bytes each) go to every task, and payloads stay where they are; more meet their digest in a shuffle join, in which a
    very frequent one is a skewed key that adaptive execution splits. Where the smallest page_id itself repeats, its rows
    are written once, for only then a row can be told from its equals.
    """
    spark, payload = pages.sparkSession, F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    counts = rows.where(F.octet_length("payload") >= least).groupBy("digest", "page_id").count()
    twice = counts.groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("count", "page_id").alias("firsts"), F.sum("count").alias("n")).where("n > 1").drop("n")
    twice = materialize(spark, twice, "repeated-digests")
    n, repeated = twice.agg(F.count("*"), F.coalesce(F.max("firsts"), F.lit(0))).first()
    met = rows.join(F.broadcast(twice) if n <= small else twice, "digest", "left")
    leads = F.coalesce(F.col("first") == F.col("page_id"), F.lit(False))
    out = lambda df, lead: df.select("page_id", "url", "payload", "digest", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"), lead.alias("lead"))
    if repeated <= 1:
        return out(met, leads)
    several = leads & (F.col("firsts") > 1)
    equals = materialize(spark, met.where(several), "repeated-pages").withColumn("row", F.monotonically_increasing_id())
    low = equals.groupBy("digest").agg(F.min("row").alias("low"))
    return out(met.where(~F.coalesce(several, F.lit(False))), leads).union(out(equals.join(low, "digest"), F.col("row") == F.col("low")))


def write_archives(spark: SparkSession, rows: DataFrame, path: str, segment: int = 16_384, archive_bytes: int = 4 << 20) -> None:
    """rows (page_id, url, payload, digest, refers_to, lead) as a Parquet table of archives (archive binary) at path."""

    def write(batches):
        import pyarrow as pa

        held, size, task, n = [], 0, TaskContext.get().partitionId(), 0
        for b in batches:
            for *page, lead in zip(*(b.column(k).to_pylist() for k in range(6))):
                n += 1
                for r in page_records(*page, segment, page[3] if lead else f"row{task}.{n}"):
                    held.append(zipped(r))
                    size += len(held[-1])
                    if size >= archive_bytes:  # the segments of a long record may lie in two archives
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])

    # archives are gzip already
    rows.select("page_id", "url", "payload", "digest", "refers_to", "lead").mapInArrow(write, "archive binary").write.option("compression", "none").parquet(path)


def write_files(archives: DataFrame, path: str) -> int:
    """archives (archive binary) as .warc.gz files in a folder that executors share (a local path or a URI that pyarrow knows); their number.

    A file is named by its content, written beside its place and then moved, so a task that runs again replaces what it wrote.
    """

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        store.create_dir(base, recursive=True)
        for b in batches:
            names = []
            for archive in b.column(0).to_pylist():
                name = f"{base}/{hashlib.sha256(archive).hexdigest()[:32]}.warc.gz"
                part = f"{name}.{TaskContext.get().taskAttemptId()}.part"
                with store.open_output_stream(part) as out:
                    out.write(archive)
                store.move(part, name)
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    return archives.select("archive").mapInArrow(write, "name string").distinct().count()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Archives (archive binary) from .warc and .warc.gz files, one row a file."""
    return spark.read.format("binaryFile").load(path).select(F.col("content").alias("archive"))


def read_records(archives: DataFrame) -> DataFrame:
    """archives (archive binary) -> a row for each record; body is the record's block."""

    def parse(batches):
        import pyarrow as pa

        number = lambda x: int(x) if x else None
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("segment", pa.int32()), ("origin_id", pa.string()), ("total_length", pa.int64()), ("page_id", pa.int64()), ("refers_page", pa.int64()), ("body", pa.binary())])
        for b in batches:
            for archive in b.column(0).to_pylist():
                rows = [
                    (h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest"), number(h.get("warc-segment-number")), h.get("warc-segment-origin-id"), number(h.get("warc-segment-total-length")), number(h.get("x-page-id")), number(h.get("x-refers-to-page-id")), block)
                    for h, block in records(archive or b"")
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return archives.select("archive").mapInArrow(parse, RECORD)


def reassemble(found: DataFrame) -> DataFrame:
    """Records with the continuations joined to their origins: one row for each response or revisit, body whole.

    Segments must be numbered 1 to their count without a gap or a repeat, and add up to the total length that the last one
    states; anything else raises. The shuffle holds segmented records only.
    """
    whole = found.where("segment is null").withColumns({"segment": F.lit(None).cast("int"), "origin_id": F.lit(None).cast("string"), "total_length": F.lit(None).cast("bigint")})
    parts = found.where("segment is not null").withColumn("origin_id", F.coalesce("origin_id", "record_id"))
    heads = [c for c in whole.columns if c not in ("record_id", "body", "segment", "origin_id", "total_length")]
    grouped = parts.groupBy("origin_id").agg(
        *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in heads),
        F.max("total_length").alias("total"),
        F.array_sort(F.collect_list(F.struct("segment", "body"))).alias("parts"),
    )
    # no function joins an array of binaries; hexadecimal text does it in time that grows with the record, which a fold would not
    body = F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["body"])), ""))
    numbered = F.transform("parts", lambda x: x["segment"]) == F.sequence(F.lit(1), F.size("parts"))
    joined = grouped.withColumn("body", body)
    ok = numbered & F.coalesce(F.octet_length("body") == F.col("total"), F.lit(False))
    bad = F.raise_error(F.concat(F.lit("segments of "), F.col("origin_id"), F.lit(" are not whole"))).cast("binary")
    return whole.unionByName(joined.select(F.col("origin_id").alias("record_id"), *heads, F.when(ok, F.col("body")).otherwise(bad).alias("body")), allowMissingColumns=True)


def decode(found: DataFrame) -> DataFrame:
    """Records with payload_bytes and their own digest added, bodies dropped: transfer framing decoded, a response held to its stated digest.

    Segments pass as they are, body and all, for only whole records can be decoded.
    """
    fields = "record_id string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, segment int, origin_id string, total_length bigint, page_id bigint, refers_page bigint, body binary"

    def decoded(batches):
        import pyarrow as pa

        for b in batches:
            lengths, digests, bodies = [], [], []
            for rid, kind, digest, segment, body in zip(*(b.column(k).to_pylist() for k in ("record_id", "record_type", "payload_digest", "segment", "body"))):
                digest, length = (digest or "").removeprefix("sha256:"), None
                if kind == "response" and segment is None:
                    payload = http_payload(body)
                    length, got = len(payload), hashlib.sha256(payload).hexdigest()
                    if digest and digest != got:
                        raise WarcError(f"{rid}: payload digest differs")
                    digest = got
                lengths.append(length)
                digests.append(digest)
                bodies.append(None if segment is None else body)
            made = {"payload_bytes": pa.array(lengths, pa.int64()), "payload_digest": pa.array(digests, pa.string()), "body": pa.array(bodies, pa.binary())}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else b.column(c) for c in names], names)

    names = [x.split()[0] for x in fields.split(", ")]
    return found.select("record_id", "record_type", "refers_to", "payload_digest", "segment", "origin_id", "total_length", "page_id", "refers_page", "body").mapInArrow(decoded, fields)


def payloads(found: DataFrame) -> DataFrame:
    """Whole records with the payload's length and SHA-256, from records of which some may be segments.

    Archives are parsed once: records that are whole leave their digest, and only segments keep their bodies until they are joined.
    A revisit takes length and digest from the response that it refers to, and is held to its digest; where that record is not among
    those found, its length is null and the digest the one stated.
    """
    spark, names = found.sparkSession, ["record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "page_id", "refers_page"]
    first = materialize(spark, decode(found), "records")
    joined = materialize(spark, decode(reassemble(first.where("segment is not null"))).select(names), "joined-records")
    rows = first.where("segment is null").select(names).unionByName(joined)
    later = F.col("record_type") == "revisit"
    origins = rows.where(~later).join(rows.where(later).select(F.col("refers_to").alias("record_id")).distinct(), "record_id", "left_semi")
    met = rows.where(later).join(origins.select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d")), "refers_to", "left")
    differs = F.raise_error(F.concat(F.col("record_id"), F.lit(": payload digest differs"))).cast("string")
    resolved = met.withColumn("payload_bytes", F.col("n")).withColumn("payload_digest", F.when(F.col("d").isNull() | (F.col("payload_digest") == "") | (F.col("d") == F.col("payload_digest")), F.coalesce("d", "payload_digest")).otherwise(differs))
    return rows.where(~later).unionByName(resolved.select(names))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """pages written as archives and read back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Null html is the empty payload. Equal payloads of 100 bytes or more: the smallest page_id is the response. Rows
    that repeat that page_id are a response each, whatever their payloads, and so are rows without a page_id; an empty table gives no rows.
    """
    path = fresh_path(spark, "warc")
    write_archives(spark, with_revisits(pages), path)
    got = payloads(read_records(spark.read.schema("archive binary").parquet(path)))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_page").alias("refers_to"))


def op9_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, read(spark, sf_dir, "pages").select("page_id", "url", "html"))
