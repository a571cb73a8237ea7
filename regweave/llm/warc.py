"""WARC archives of web pages: deterministic sharded writer and reader.

Writer. Payload digests are taken in SQL; for each digest the page of largest id
is the response, all others revisit it. Only digests that occur more than once are
joined, without the payloads, and reach the shards that hold them. Records are
range-sorted by page id. The
range limits come from a hash-chosen sample of ids, so they depend on the ids
alone. A task writes its range into files that roll at ``roll_bytes`` of
compressed size; each record is its own gzip member. A file is written under a
temporary name that holds the attempt and then renamed, so a task that runs again
replaces its files by equal ones. The last step writes a manifest of the files
with their sizes and digests; readers open only what it lists.

Reader. Files are loaded by Spark, checked against the manifest and parsed record
by record; the payload size and digest of a revisit are those of the payload that
was left out.

Edge cases: a null page is empty, a null url is empty; a null page id sorts first
and is a response only where all pages of its payload have none; rows that repeat
id and payload are responses alike if theirs is the largest id; payloads below
``least_bytes`` are always responses; an empty table gives an empty manifest and
no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regweave.session import cut_lineage, ensure_checkpoint_dir

DATE = "2020-01-01T00:00:00Z"
MANIFEST = "shard int, roll int, path string, records long, bytes long, sha256 string"
RECORDS = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
           "url string, payload binary, intact boolean")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: int | None, url: str, payload: bytes, is_revisit: bool, target: int | None) -> bytes:
    """One record with headers and digests made anew from the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"X-Page-ID: {'' if page is None else page}", f"X-Payload-Length: {len(payload)}",
    ]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_record_id(target)}", f"X-Refers-To-Page: {target}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def records(archive: bytes) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each gzip member of an archive."""
    while archive:
        member = zlib.decompressobj(31)
        data = member.decompress(archive) + member.flush()
        archive = member.unused_data
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                      for line in head.decode().split("\r\n")[1:])
        yield fields, rest[:int(fields["Content-Length"])]


def _limits(ids: DataFrame, n: int, each: int = 64) -> list[int]:
    """``n - 1`` range limits from about ``each * n`` ids chosen by hash."""
    total = ids.count()
    share = min(1.0, each * n / max(1, total))
    key = F.pmod(F.xxhash64(F.lit(3), "page_id"), F.lit(1 << 30))
    sample = sorted(r[0] for r in ids.filter(key < int(share * (1 << 30))).filter("page_id is not null").collect())
    return sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []


def _writer(folder: str, roll_bytes: int):
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        attempt = context.taskAttemptId()
        shard, roll, held, size, n = None, 0, [], 0, 0

        def close():
            data = b"".join(held)
            name = f"part-{shard:06d}-{roll:06d}.warc.gz"
            temporary = f"{base}/.{name}.{attempt}.tmp"
            with store.open_output_stream(temporary) as out:
                out.write(data)
            store.move(temporary, f"{base}/{name}")
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([roll], pa.int32()), pa.array([name]),
                 pa.array([n], pa.int64()), pa.array([len(data)], pa.int64()),
                 pa.array([hashlib.sha256(data).hexdigest()])],
                ["shard", "roll", "path", "records", "bytes", "sha256"])

        targets: dict[str, int] = {}
        for b in batches:
            for own, kind, page, url, payload, digest, target in zip(*(c.to_pylist() for c in b.columns)):
                if own != shard:
                    if held:
                        yield close()
                    shard, roll, held, size, n, targets = own, 0, [], 0, 0, {}
                if kind == 0:  # the shard's repeated payloads come before its pages
                    targets[digest] = target
                    continue
                if held and size >= roll_bytes:
                    yield close()
                    roll, held, size, n = roll + 1, [], 0, 0
                target = targets.get(hashlib.sha1(payload).hexdigest()) if targets else None
                is_revisit = target is not None and page != target
                held.append(gzip.compress(record(page, url, payload, is_revisit, target), 6, mtime=0))
                size, n = size + len(held[-1]), n + 1
        if held:
            yield close()
    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, roll_bytes: int = 4 << 20,
                   shard_bytes: int = 32 << 20) -> DataFrame:
    """Write one record per page below ``folder`` (a URI all executors share); returns the manifest."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    total = rows.agg(F.sum(F.length("payload"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limits = _limits(rows.select("page_id"), max(least, math.ceil(total / shard_bytes)))
    edges = np.array(limits, np.int64)

    def number(page: pd.Series) -> pd.Series:
        """How many limits are at or below the id."""
        return pd.Series(np.searchsorted(edges, page.to_numpy(), "right"))

    shard = F.pandas_udf(number, "int")(F.coalesce("page_id", F.lit(-(1 << 63))))
    placed = rows.withColumn("shard", shard)
    digests = cut_lineage(placed.filter(F.length("payload") >= least_bytes).select(
        "shard", "page_id", F.sha1("payload").alias("digest")))
    repeated = digests.groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).filter("n > 1")
    targets = digests.select("shard", "digest").distinct().join(repeated, "digest").filter("target is not null")
    none = lambda kind: F.lit(None).cast(kind)
    ordered = (placed.select("shard", F.lit(1).alias("kind"), "page_id", "url", "payload",
                             none("string").alias("digest"), none("long").alias("target"))
               .unionByName(targets.select("shard", F.lit(0).alias("kind"), none("long").alias("page_id"),
                                           none("string").alias("url"), none("binary").alias("payload"), "digest", "target"))
               .repartition(len(limits) + 1, "shard")
               .sortWithinPartitions("shard", "kind", "page_id", "url", F.sha1("payload")))
    from pyarrow import fs
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    files = cut_lineage(ordered.mapInArrow(_writer(folder, roll_bytes), MANIFEST))
    files.write.mode("overwrite").parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives that the manifest lists.

    A listed file that is absent, or whose digest or number of records is another than
    listed, raises an error.
    """
    listed = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("path"), "content")

    def run(batches):
        for b in batches:
            for path, sha, listed_records, content in zip(*(c.to_pylist() for c in b.columns)):
                if hashlib.sha256(content).hexdigest() != sha:
                    raise ValueError(f"{path}: not the bytes that were written")
                rows = []
                for fields, block in records(content):
                    is_revisit = fields["WARC-Type"] == "revisit"
                    payload = None if is_revisit else block.partition(b"\r\n\r\n")[2]
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    intact = base32_sha1(block) == fields["WARC-Block-Digest"].removeprefix("sha1:") and (
                        is_revisit or base32_sha1(payload) == digest)
                    page = fields["X-Page-ID"]
                    rows.append((int(page) if page else None, int(fields["X-Payload-Length"]), digest,
                                 fields["WARC-Type"], int(fields["X-Refers-To-Page"]) if is_revisit else None,
                                 fields["WARC-Target-URI"], payload, intact))
                if len(rows) != listed_records:
                    raise ValueError(f"{path}: {len(rows)} records instead of {listed_records}")
                columns = list(zip(*rows))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload", "intact"])

    absent = listed.join(named.select("path"), "path", "left_anti").limit(5).collect()  # names only, no contents
    if absent:
        raise ValueError(f"absent archives: {[r.path for r in absent]}")
    return listed.join(named, "path").select("path", "sha256", "records", "content").mapInArrow(run, RECORDS)


def new_folder(spark: SparkSession) -> str:
    """A new folder below the session's shared one."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    return f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/warc/{uuid.uuid4().hex}"
