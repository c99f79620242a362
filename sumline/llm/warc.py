"""A deterministic sharded WARC writer, and a reader.

Method. Records are range-partitioned and sorted by page id. Each task writes gzip members, one per
record, and starts a new file once one has reached roll_bytes of compressed size. Headers and
digests are regenerated from the payload; nothing depends on the clock. Of records with equal
payloads of at least min_bytes, the one with the largest page id is a response and the others are
revisits that refer to it. Files are written under temporary names of their own for each task
attempt; when the job has ended, the driver renames those that its result lists, writes the
manifest (under a temporary name, renamed last) and removes what other attempts left.

Which payloads recur is decided on digests alone; the payloads are shuffled once. The driver holds
one manifest row per file.

Files are opened through pyarrow.fs by the URI of the target folder, which executors must share.

Defined cases. A null payload is empty, a null url is written as an empty one, a null page id
writes no id header and its record never is the response of others. Rows that repeat a page id are
written each; if their payload is that of the largest id, all are responses. Line breaks in urls
become spaces. An empty table writes a manifest without files. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path

VERSION, DATE = "WARC/1.1", "2020-01-01T00:00:00Z"
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, file string, intact boolean"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri.removeprefix("file:"))


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _b32(hexdigest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexdigest)).decode()


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One uncompressed WARC record."""
    digest = hashlib.sha1(payload).hexdigest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    clean = " ".join(url.splitlines())
    lines = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    lines += [f"WARC-Payload-Digest: {_b32(digest)}", f"WARC-Block-Digest: {_b32(hashlib.sha1(block).hexdigest())}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page: {page_id}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _commit(spark: SparkSession, target: str, temporary: str, done: list[dict], overwrite: bool) -> None:
    """Rename the files listed in done, then the manifest. What was renamed before a failure is removed again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    store = path(target).getFileSystem(conf)
    manifest, renamed = path(f"{target}/manifest.json"), []

    def rename(old, new) -> None:
        if not store.rename(old, new):
            raise OSError(f"can't rename {old.toString()} to {new.toString()}")

    store.mkdirs(path(target))
    if store.exists(manifest):
        if not overwrite:
            raise FileExistsError(f"{target} holds an archive already")
        for r in spark.read.text(f"{target}/manifest.json").collect():
            store.delete(path(f"{target}/{json.loads(r.value)['name']}"), False)
        store.delete(manifest, False)
    try:
        for r in done:
            to = path(f"{target}/{r['name']}")
            rename(path(f"{temporary}/{r.pop('temporary')}"), to)
            renamed.append(to)
        stream = store.create(path(f"{target}/.manifest.json.tmp"), True)
        stream.write(bytearray("".join(json.dumps(r) + "\n" for r in done).encode()))
        stream.close()
        rename(path(f"{target}/.manifest.json.tmp"), manifest)
    except Exception:
        for to in renamed:
            store.delete(to, False)
        raise
    finally:
        store.delete(path(f"{target}/_temporary"), True)


def write_warc(pages: DataFrame, target: str, n_shards: int | None = None, roll_bytes: int = 16 << 20, min_bytes: int = 1000, prefix: str = "pages", overwrite: bool = False) -> list[dict]:
    """Write pages (page_id, url, html) to the folder target, a URI; the manifest's entries.

    A target that holds an archive is an error, or with overwrite its files are replaced."""
    spark = pages.sparkSession
    n_shards = n_shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("payload"))
    digests = rows.select("page_id", F.sha1("payload").alias("digest"), F.length("payload").alias("size")).filter(F.col("size") >= min_bytes)
    keeper = digests.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1 and keeper is not null").select("digest", "keeper")
    revisits = digests.join(keeper, "digest").filter(~F.col("page_id").eqNullSafe(F.col("keeper"))).select("page_id", "digest", "keeper").distinct()
    # A verdict sorts just before the rows of its page id and travels with them in one shuffle.
    told = revisits.select("page_id", F.lit(0).alias("kind"), F.col("digest").alias("url"), F.lit(None).cast("binary").alias("payload"), "keeper")
    whole = told.unionByName(rows.select("page_id", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("keeper")))
    ordered = whole.repartitionByRange(n_shards, "page_id").sortWithinPartitions("page_id", "kind", "url", "payload")
    temporary = f"{target}/_temporary/{uuid.uuid4().hex}"

    def write(batches):
        at = TaskContext.get()
        store, folder = _open(temporary)
        store.create_dir(folder, recursive=True)
        shard, attempt, n_files, out, told, now = at.partitionId(), at.taskAttemptId(), 0, None, {}, object()
        made = []

        def close():
            nonlocal out
            out[0].close()
            made.append((out[1], f"{prefix}-{shard:05d}-{n_files - 1:05d}.warc.gz", out[2], out[3], out[4].hexdigest()))
            out = None

        for batch in batches:
            for page_id, kind, url, payload, keeper in zip(*(batch.column(c) for c in ("page_id", "kind", "url", "payload", "keeper"))):
                page_id = page_id.as_py()
                if page_id != now:
                    now, told = page_id, {}
                if kind.as_py() == 0:
                    told[url.as_py()] = keeper.as_py()
                    continue
                body = payload.as_py()
                refers_to = told.get(hashlib.sha1(body).hexdigest()) if told else None
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = pack.compress(record(page_id, url.as_py(), body, refers_to)) + pack.flush()
                if out is None:
                    name = f"{shard:05d}-{n_files:05d}-{attempt}"
                    out, n_files = [store.open_output_stream(f"{folder}/{name}", compression=None), name, 0, 0, hashlib.sha1()], n_files + 1
                out[0].write(member)
                out[2], out[3] = out[2] + 1, out[3] + len(member)
                out[4].update(member)
                if out[3] >= roll_bytes:
                    close()
        if out is not None:
            close()
        cols = list(zip(*made)) or [[], [], [], [], []]
        yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string())], names=["temporary", "name", "records", "bytes", "sha1"])

    done = sorted((r.asDict() for r in ordered.mapInArrow(write, "temporary string, name string, records long, bytes long, sha1 string").collect()), key=lambda r: r["name"])
    _commit(spark, target, temporary, done, overwrite)
    return done


def parse(data: bytes):
    """Records of a .warc.gz file: headers (lower-case names) and block."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data))
    while line := stream.readline():
        if line.rstrip(b"\r\n") != VERSION.encode():
            raise ValueError("not a WARC record")
        heads = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            key, _, value = line.decode().partition(":")
            heads[key.strip().lower()] = value.strip()
        block = stream.read(int(heads["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where it should")
        yield heads, block


def read_warc(spark: SparkSession, target: str, with_payload: bool = True) -> DataFrame:
    """The records of the files that the manifest lists. intact: the block's digest holds."""
    names = [json.loads(r.value)["name"] for r in spark.read.text(f"{target}/manifest.json").collect()]
    if not names:
        return spark.createDataFrame([], READ_SCHEMA)
    files = spark.read.format("binaryFile").load([f"{target}/{n}" for n in names]).select("path", "content")

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                rows = []
                for heads, block in parse(content.as_py()):
                    number = lambda key: int(heads[key]) if key in heads else None
                    digest = base64.b32decode(heads["warc-payload-digest"].removeprefix("sha1:")).hex()
                    intact = _b32(hashlib.sha1(block).hexdigest()) == heads["warc-block-digest"]
                    payload = block.partition(b"\r\n\r\n")[2] if heads["warc-type"] == "response" else None
                    if payload is not None:
                        intact = intact and hashlib.sha1(payload).hexdigest() == digest and len(payload) == number("x-payload-length")
                    rows.append((number("x-page"), number("x-payload-length"), digest, heads["warc-type"], number("x-refers-to-page"), heads["warc-target-uri"], payload if with_payload else None, name.as_py(), intact))
                    if len(rows) >= 500:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return files.mapInArrow(read, READ_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.bool_()]
    cols = list(zip(*rows)) or [[] for _ in kinds]
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in READ_SCHEMA.split(", ")])


def round_trip(pages: DataFrame) -> DataFrame:
    """The contract's row per page, read back from archives in the shared folder."""
    target = new_path(pages.sparkSession, "warc")
    write_warc(pages, target)
    return read_warc(pages.sparkSession, target, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
