"""Operator 6: a deterministic, sharded WARC writer and the reader that checks what it wrote."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewspark.llm.common import range_cuts, range_of, sliced, table, text_bytes
from reviewspark.operators.graph import ensure_checkpoint_dir

#: Every record carries this date, so that equal input gives equal archives.
DATE = "2000-01-01T00:00:00Z"
SPACE = uuid.UUID("8a1b2f70-51d4-5d0c-9b43-0f4f6a0d6c11")
#: Pages from which on a payload is hot, hot payloads that are sent to all tasks, and parts of a hot payload beyond that.
HOT, FEW, SALTS = 10_000, 100_000, 64
#: Ranges at most.
MOST = 20_000
#: Bytes of an archive that are unpacked at once.
PIECE = 16 << 10
MANIFEST = "file string, records long, bytes long, sha1 string"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(key: int | None, url: str, payload: bytes, refers_to: int | None, level: int) -> bytes:
    """One record as a gzip member with regenerated headers."""
    digest = digest_of(payload)
    name = lambda k: f"<urn:uuid:{uuid.uuid5(SPACE, f'{k}')}>"
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(key)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        f"X-Page-Id: {'' if key is None else key}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[6:6] = [f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def revisits(pages: DataFrame, least: int, key: str = "page_id") -> DataFrame:
    """``page_id, refers_to`` of pages whose payload (of ``least`` bytes or more) a smaller page has too.

    Payloads are told apart by SHA-1 alone; only keys and digests are shuffled, and equal digests are
    aggregated before they meet. Payloads of more than ``HOT`` pages, of which there are at most one
    in ``HOT`` pages, are looked up in place (sent to all tasks while they are few), so that no task
    takes in a hot payload.
    """
    small = pages.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", F.sha1("html").alias("sha"))
    heads = small.groupBy("sha").agg(F.min("page_id").alias("head"), F.count("*").alias("n")).where("n > 1")
    hot = heads.where(F.col("n") > HOT).select("sha", F.col("head").alias("hot_head")).persist()
    if hot.count() <= FEW:
        seen = small.join(F.broadcast(hot), "sha", "left")
    else:
        salted = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        seen = small.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["sha", "salt"], "left").drop("salt")
    rest = seen.where("hot_head is null").join(heads.where(F.col("n") <= HOT).select("sha", "head"), "sha")
    both = seen.where("hot_head is not null").select("page_id", F.col("hot_head").alias("refers_to")).union(rest.select("page_id", F.col("head").alias("refers_to")))
    return both.where("page_id > refers_to").distinct()


def write(pages: DataFrame, folder: str, least: int = 0, roll_bytes: int = 8 << 20, level: int = 6, shard_bytes: int = 8 << 20) -> DataFrame:
    """Write a WARC record for each row of ``page_id, url, html`` and return the manifest.

    Rows are range-sorted by page, in ranges of about ``shard_bytes`` of payload (``MOST`` ranges at
    most) whose cuts depend on the rows alone; each range is written to files that are closed once
    they reach ``roll_bytes`` compressed. A file is written under a temporary name and then renamed to
    one that depends only on its range and number, so a task that runs again replaces it by equal
    bytes, and equal tables give equal archives. The manifest (``MANIFEST``) is written last, next to
    the files, and names the files that count. A null html is an empty payload, a null url an empty
    one; a null page is a response in the first range; repeated pages are repeated records; an empty
    table gives an empty manifest.
    """
    spark = pages.sparkSession
    clean = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    marks = revisits(clean, least)
    total = clean.agg(F.coalesce(F.sum(F.octet_length("html") + 200), F.lit(0)).alias("n")).first()["n"]
    cuts = range_cuts(clean, "page_id", min(MOST, max(1, -(-total // shard_bytes))), F.octet_length("html") + 200)
    rows = (
        marks.select("page_id", F.lit(0).alias("kind"), "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
        .union(clean.select("page_id", F.lit(1), F.lit(None).cast("long"), "url", "html"))
        .select(range_of("page_id", cuts).alias("part"), "page_id", "kind", "refers_to", "url", "html")
        .repartitionById(len(cuts) + 1, F.col("part"))
        .sortWithinPartitions("part", "page_id", "kind", "url", "html")
    )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        out, tmp, done, size, count, sha = None, "", [], 0, 0, hashlib.sha1()

        def close() -> None:
            nonlocal out, size, count, sha
            if out is not None:
                out.close()
                where.move(tmp, f"{base}/part-{part:05d}-{len(done):04d}.warc.gz")
                done.append((f"part-{part:05d}-{len(done):04d}.warc.gz", count, size, sha.hexdigest()))
            out, size, count, sha = None, 0, 0, hashlib.sha1()

        mark = (None, None)
        for b in sliced(it):
            for key, kind, refers, url, html in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                if not kind:
                    mark = (key, refers)
                    continue
                payload = text_bytes(html)
                raw = member(key, url, payload, mark[1] if key is not None and mark[0] == key and len(payload) >= least else None, level)
                if out is None:
                    tmp = f"{base}/.part-{part:05d}-{len(done):04d}.{attempt}.tmp"
                    out = where.open_output_stream(tmp, compression=None)
                out.write(raw)
                sha.update(raw)
                size += len(raw)
                count += 1
                if size >= roll_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["file", "records", "bytes", "sha1"])

    rows.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each gzip member."""
    view, at = memoryview(raw), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof and at < len(view):  # in pieces, so that what follows a member is copied once at most
            piece = view[at : at + PIECE]
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        text = b"".join(parts) + z.flush()
        head, _, rest = text.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Read the archives that the manifest names and check them.

    File digests, block digests, payload digests and lengths are recomputed; a difference raises.
    Returns ``page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to``.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
        if spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").head(1)
        else None
    )
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if files is None:
        return spark.createDataFrame([], schema)
    named = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    held = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path").join(named, "file")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder)
        for b in it:
            for file, sha in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with where.open_input_stream(f"{base}/{file}", compression=None) as f:
                    raw = f.read()
                if hashlib.sha1(raw).hexdigest() != sha:
                    raise ValueError(f"{file}: digest differs from the manifest")
                rows = []
                for h, block in records(raw):
                    body = block.partition(b"\r\n\r\n")[2]
                    response = h["WARC-Type"] == "response"
                    if h["WARC-Block-Digest"] != f"sha1:{digest_of(block)}" or response and (h["WARC-Payload-Digest"] != f"sha1:{digest_of(body)}" or int(h["X-Payload-Length"]) != len(body)):
                        raise ValueError(f"{file}: damaged record {h['WARC-Record-ID']}")
                    rows.append((int(h["X-Page-Id"]) if h["X-Page-Id"] else None, h["WARC-Target-URI"], body if response else None, int(h["X-Payload-Length"]), h["WARC-Payload-Digest"][5:], h["WARC-Type"], int(h["X-Refers-To-Page"]) if not response else None))
                for lo in range(0, len(rows), 500):
                    c = list(zip(*rows[lo : lo + 500], strict=True))
                    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return held.select("file", "sha1").repartition(n, "file").mapInArrow(run, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC archives to the shared folder and read them back."""
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
