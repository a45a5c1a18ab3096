"""WARC archives with a two-level capture index."""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pandas as pd
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodetext.llm.shared import new_path, stored

#: Parts of a digest that many payloads share.
SALTS = 16
ENTRY = "key string, page string, url string, file string, at long, size long"
EPOCH = datetime(2000, 1, 1, tzinfo=timezone.utc)


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed and comma-joined, then ')', port, path and query; scheme, www and fragment go."""
    if not url:
        return ")"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:  # no URL: its text is the key
        return ")" + re.sub(r"\s", "%20", url)
    key = ",".join(reversed(host.split("."))) + ")" + (f":{port}" if port and port not in (80, 443) else "") + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return re.sub(r"\s", "%20", key)


def record(kind: str, page: str, url: str, payload: bytes, digest: bytes, refers_to: str | None) -> bytes:
    """One gzip member with a WARC/1.1 record; a revisit keeps the HTTP head and no payload. page: the page_id as text, '' for none."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {(EPOCH + timedelta(seconds=int(page or 0) % 10**9)).strftime('%Y-%m-%dT%H:%M:%SZ')}",
        f"WARC-Target-URI: {re.sub(r'\s', '%20', url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """The record in a gzip member: page_id, record_type, payload_bytes, payload_digest, refers_to. What a response says of its payload is checked."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    told = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).digest() != told or len(payload) != size):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">")) if x and x != "<urn:page:>" else None
    return {"page_id": page(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": told.hex(), "refers_to": page(fields.get("WARC-Refers-To")), "payload": payload}


def opened(base: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; executors and driver open shared storage by it, whatever its scheme."""
    return pafs.FileSystem.from_uri(base)


def attempt() -> str:
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}" if task else "000000-0"


def write_archives(pages: DataFrame, base: str, least: int = 1000) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) into archives under base; returns the captures, materialised.

    Of records with equal payloads of at least `least` bytes, that with the largest page_id is the response and the others revisit it.
    Null html is an empty payload, a null url the empty one. Rows with one page_id and the same payload are each responses if it is the
    largest; rows without page_id are responses where no equal payload has one. Digests are aggregated alone; the payloads move once, to join
    the largest page_id of their digest, dealt by salts, so that neither a digest that many share nor the payloads without one meet in a task. A task writes to a file of its own
    attempt, and only captures of tasks that were committed are listed, so lost executors leave no trace.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    marked = rows.withColumn("digest", F.when(F.octet_length("html") >= least, F.unhex(F.sha1(F.encode("html", "utf-8")))))
    shared = marked.where("digest IS NOT NULL").groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    shared = shared.withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    own = F.xxhash64("page_id", "url", "html")
    marked = marked.withColumn("salt", F.when(F.col("digest").isNull(), own).otherwise(F.pmod(own, F.lit(SALTS))))
    rows = marked.join(shared, ["digest", "salt"], "left").select(named("page_id").alias("page"), "url", "html", F.col("last").cast("string").alias("last"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = opened(base)
        name = f"{attempt()}.warc.gz"
        at, out = 0, None
        for rows in batches:
            found = []
            for page, url, html, last in zip(rows["page"], rows["url"], rows["html"], rows["last"], strict=True):
                url = url or ""
                payload = html.encode()
                refers = None if last is None or last == page else last
                member = record("response" if refers is None else "revisit", page, url, payload, hashlib.sha1(payload).digest(), refers)
                if out is None:
                    fs.create_dir(folder, recursive=True)
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                out.write(member)
                found.append((url_key(url), page, url, name, at, len(member)))
                at += len(member)
            yield pd.DataFrame(found, columns=["key", "page", "url", "file", "at", "size"])
        if out is not None:
            out.close()

    return stored(rows.mapInPandas(write, ENTRY), "captures")


def named(page_id: str):
    """page_id as text, '' for null: pandas would turn long columns with nulls into floats."""
    return F.coalesce(F.col(page_id).cast("string"), F.lit(""))


def line(key: str, page: str) -> str:
    """Place of a capture in the index, by key and then page_id, in code point order."""
    return f"{key} {page}"


def build_index(captures: DataFrame, base: str, lines: int = 3000) -> DataFrame:
    """Level one: captures range-partitioned and sorted by (key, page) in zlib blocks of `lines`, a file a partition. Level two: a
    directory file beside each with the first line, offset and size of its blocks. Returns (first, file) of the partitions that hold rows, materialised.

    Both parts of the key divide the ranges, so a host or URL with a third of all captures spreads over as many files as it fills.
    """
    spark = captures.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = captures.withColumn("line", F.concat_ws(" ", "key", "page")).repartitionByRange(parts, "line").sortWithinPartitions("line")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = opened(base)
        name, out, at, directory, held = f"{attempt()}.idx", None, 0, [], []

        def flush():
            nonlocal at
            block = zlib.compress("\n".join("\t".join(x) for x in held).encode(), 6)
            directory.append(f"{held[0][0]}\t{at}\t{len(block)}")
            out.write(block)
            at += len(block)
            held.clear()

        for rows in batches:
            if out is None and len(rows):
                fs.create_dir(folder, recursive=True)
                out = fs.open_output_stream(f"{folder}/{name}", compression=None)
            for here, file, a, n in zip(rows["line"], rows["file"], rows["at"], rows["size"], strict=True):
                held.append((here, file, str(a), str(n)))
                if len(held) == lines:
                    flush()
        if out is not None:
            if held:
                flush()
            out.close()
            with fs.open_output_stream(f"{folder}/{name}.dir", compression=None) as f:
                f.write("\n".join(directory).encode())
            yield pd.DataFrame([(directory[0].split("\t")[0], name)], columns=["first", "file"])

    return stored(ordered.mapInPandas(write, "first string, file string"), "directory")


class Index:
    """Looks captures up: binary search for the file among first lines, in its directory for the block, then a range read and a search in the block."""

    def __init__(self, base: str, files: list[tuple[str, str]]):
        self.fs, self.folder = opened(base)
        self.firsts, self.files = [list(x) for x in zip(*sorted(files), strict=True)] if files else ([], [])
        self.file, self.block = None, None

    def find(self, wanted: str) -> list[tuple[str, int, int]]:
        f = max(0, bisect.bisect_left(self.firsts, wanted) - 1)  # equal lines may begin in the file or block before
        found = []
        while f < len(self.files) and self.firsts[f] <= wanted:
            if self.file != f:
                with self.fs.open_input_stream(f"{self.folder}/{self.files[f]}.dir", compression=None) as x:
                    rows = [r.split("\t") for r in x.read().decode().split("\n")]
                self.starts, self.places = [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]
                self.file, self.block = f, None
            b = max(0, bisect.bisect_left(self.starts, wanted) - 1)
            while b < len(self.starts) and self.starts[b] <= wanted:
                if self.block != b:
                    at, size = self.places[b]
                    with self.fs.open_input_file(f"{self.folder}/{self.files[f]}") as x:
                        x.seek(at)
                        self.lines = [r.split("\t") for r in zlib.decompress(x.read(size)).decode().split("\n")]
                    self.block, self.keys = b, [r[0] for r in self.lines]
                i = bisect.bisect_left(self.keys, wanted)
                while i < len(self.keys) and self.keys[i] == wanted:
                    found.append((self.lines[i][1], int(self.lines[i][2]), int(self.lines[i][3])))
                    i += 1
                b += 1
            f += 1
        return found


def look_up(wanted: DataFrame, directory: DataFrame, base: str) -> DataFrame:
    """(file, at, size) of each capture of each distinct (url, page_id) in wanted; one that isn't indexed gives no row.

    Lookups are sorted by key first, so that a task reads each block once. The list of index files, one row a partition of the
    build, is the only thing all tasks hold.
    """
    spark = wanted.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = [(r["first"], r["file"]) for r in directory.collect()]  # one row a file
    keyed = wanted.select(named("page_id").alias("page"), F.coalesce("url", F.lit("")).alias("url")).distinct()
    keyed = keyed.mapInPandas(lambda batches: (pd.DataFrame({"line": [line(url_key(u), p) for u, p in zip(x["url"], x["page"], strict=True)]}) for x in batches), "line string")
    ordered = keyed.repartitionByRange(parts, "line").sortWithinPartitions("line")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(base, files)
        for rows in batches:
            yield pd.DataFrame([x for wanted in rows["line"] for x in index.find(wanted)], columns=["file", "at", "size"])

    return ordered.mapInPandas(search, "file string, at long, size long")


def read_records(places: DataFrame, base: str, stretch: int = 1 << 22, payloads: bool = False) -> DataFrame:
    """Range-reads and parses the records at (file, at, size): page_id, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload.

    Places are grouped by stretches of `stretch` bytes of a file and read in order, adjacent ones in one request of at most that size.
    """
    spark = places.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = places.withColumn("part", F.floor(F.col("at") / stretch)).repartition(parts, "file", "part").sortWithinPartitions("file", "at")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = opened(base)
        name, source = None, None
        for rows in batches:
            found, todo = [], list(zip(rows["file"], rows["at"].astype(int), rows["size"].astype(int), strict=True))
            i = 0
            while i < len(todo):
                file, at, size = todo[i]
                j, end = i + 1, at + size
                while j < len(todo) and todo[j][0] == file and todo[j][1] <= end and end - at < stretch:
                    end = max(end, todo[j][1] + todo[j][2])
                    j += 1
                if name != file:
                    name, source = file, fs.open_input_file(f"{folder}/{file}")
                source.seek(at)
                data = source.read(end - at)
                found += [parse(data[a - at : a - at + n]) for _, a, n in todo[i:j]]
                i = j
            yield pd.DataFrame({k: pd.Series([x[k] for x in found], dtype="Int64" if k in ("page_id", "payload_bytes", "refers_to") else object) for k in names})

    return dealt.mapInPandas(read, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    base = new_path(spark, "warc")
    captures = write_archives(pages, base)
    directory = build_index(captures, base)
    return read_records(look_up(pages, directory, base), base)


#: The same result in DuckDB, from the pages themselves.
OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
last AS (SELECT payload_digest, max(page_id) AS last FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN last IS NULL OR last IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last IS DISTINCT FROM page_id THEN last END AS refers_to
FROM p LEFT JOIN last USING (payload_digest)
"""
