"""WARC archives with a two-level capture index.

Writing: each task writes one archive, a gzip member per record; payloads that
occur more than once are stored once (the response with the smallest page id) and
revisited by the others.  Every record gives a capture: key (reversed host, then
path, so that a site's captures are neighbours), archive, offset, length.

Index: the captures, sorted by key over the whole corpus, are cut into compressed
blocks, in one file for each range of keys; beside it lies the file's sparse directory, with
each block's first key and place.  A search finds the files that may hold a key by binary
search in their first keys, the blocks by binary search in the directory, the captures by
binary search in the block, and reads only their ranges of the archives; ranges that lie
close together are read at once.  A round trip looks up the URL of every page: keys are
dealt to the index files, captures to stretches of the archives.

Archives and index blocks are files in the shared folder; they are written and
read through pyarrow's file systems (file, hdfs, s3 ...), so that any task can
read any range.  A task that is run again writes files of fresh names, and only the
files that its committed rows name are read.

Null or empty html: an empty payload.  Null url: empty key.  Null page_id: a record
without a page id, last among equal payloads.  Rows that repeat are records that repeat: with equal ids and payloads, one is the response
and the others revisit it.  Empty table: no archives.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import sys
import uuid
from bisect import bisect_left, bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete_on_exit, map_arrow, shared_dir, small_side, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_CAPTURES = 1024
#: Captures that lie no farther apart are read at once, up to so many bytes.
READ_GAP, READ_BYTES = 1 << 16, 4 << 20
#: Bytes of an archive whose captures one task reads together.
STRETCH = 8 << 20
#: Repeated payloads that are broadcast to find their pages; beyond it, a shuffled join.
BROADCAST_DIGESTS = 200_000
CAPTURE = "key string, url string, archive string, offset long, length long"


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def qualified(spark, path: str) -> str:
    """path with its file system's scheme, as Spark's writers take it: a bare path lies in Hadoop's default one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def url_key(url: str | None) -> str:
    """com,example,www)/path?query in lower-case host, the scheme left out and line ends and tabs escaped."""
    try:
        parts = urlsplit(url or "")
        key = ",".join(reversed((parts.hostname or "").lower().split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    except ValueError:
        key = url or ""
    return key.replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id, seq: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{seq}>"


def make_record(page_id, seq: int, url: str | None, payload: bytes, refers_to, refers_seq: int) -> bytes:
    """A gzip member: a response with its payload, or a revisit (refers_seq >= 0) without."""
    revisit = refers_seq >= 0
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join(c for c in (url or "") if c > " ")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, seq)}",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, refers_seq)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(member: bytes) -> dict:
    """type, page_id, refers_to, payload_bytes, digest, payload (None for revisits); a response's digest is checked."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")).split(b":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page = lambda s: int(p) if (p := s.strip("<>").split(":")[2]) else None
    if fields["WARC-Type"] == "response" and digest_of(payload) != digest:
        raise ValueError(f"digest of {fields['WARC-Record-ID']} doesn't match its payload")
    return {
        "type": fields["WARC-Type"],
        "page_id": page(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "refers_to": page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "payload_bytes": size,
        "digest": digest,
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def _write(batches, folder: str):
    out, at, name, store = None, 0, "", None
    try:
        for b in batches:
            rows = []
            for page_id, seq, url, html, refers_to, refers_seq in zip(*(b.column(i).to_pylist() for i in range(6))):
                if out is None:
                    store, root = _store(folder)
                    name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(name, compression=None)
                member = make_record(page_id, seq, url, (html or "").encode("utf-8", "replace"), refers_to, refers_seq)
                out.write(member)
                rows.append((url_key(url), url, name.rsplit("/", 1)[1], at, len(member)))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()])], ["key", "url", "archive", "offset", "length"])
    finally:
        if out is not None:
            out.close()


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (page_id, url, html, digest) with seq: 0, but 0, 1, ... for rows that share page_id and payload, since only one of them may be the response."""
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    twins = rows.groupBy(F.col("page_id").alias("_page"), F.col("digest").alias("_digest")).count().filter("count > 1").drop("count")
    twins = written(twins, "twins")
    if twins.isEmpty():
        return rows.withColumn("seq", F.lit(0))
    twins = small_side(twins, BROADCAST_DIGESTS)
    match = same("page_id", "_page") & same("digest", "_digest")
    # Numbers go by part of the input, so that rows which all are alike don't meet in one task.
    own = written(rows.join(twins, match, "left_semi").withColumn("_part", F.spark_partition_id()), "twin_rows")
    parts = own.groupBy(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "_part").count()
    before = F.sum("count").over(Window.partitionBy("_page", "_digest").orderBy("_part")) - F.col("count")
    parts = written(parts.select("_page", "_digest", F.col("_part").alias("_of"), before.alias("_before")), "twin_parts")
    place = F.row_number().over(Window.partitionBy("page_id", "digest", "_part").orderBy("url"))
    own = own.join(small_side(parts, BROADCAST_DIGESTS), match & (F.col("_part") == F.col("_of"))).withColumn("seq", (F.col("_before") + place - 1).cast("int"))
    return own.select(*rows.columns, "seq").unionByName(rows.join(twins, match, "left_anti").withColumn("seq", F.lit(0)))


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the archives; returns the captures (cut off from their lineage)."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    # Which payloads repeat, and their first page: digests only, summed up before the shuffle.
    repeated = (
        rows.filter(F.octet_length("html") >= min_revisit_bytes)
        .groupBy(F.col("digest").alias("_repeated"))
        .agg(F.count(F.lit(1)).alias("copies"), F.min("page_id").alias("first"))
        .filter("copies > 1")
    )
    keyed = _numbered(rows).join(small_side(written(repeated, "repeated"), BROADCAST_DIGESTS), F.col("digest") == F.col("_repeated"), "left")
    response = F.col("copies").isNull() | (F.col("page_id").eqNullSafe(F.col("first")) & (F.col("seq") == 0))
    planned = keyed.select("page_id", "seq", "url", "html", F.when(~response, F.col("first")).alias("refers_to"), F.when(response, -1).otherwise(0).alias("refers_seq"))
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    return written(map_arrow(planned, lambda b: _write(b, folder), CAPTURE), "captures")


def _index(batches, folder: str):
    store, root = _store(folder)
    name = f"{root}/{uuid.uuid4().hex}"
    block, directory, out, at, n = [], [], None, 0, 0

    def flush():
        nonlocal out, at
        if out is None:
            out = store.open_output_stream(f"{name}.idx", compression=None)
        data = gzip.compress("\n".join("\t".join(map(str, r)) for r in block).encode(), 6, mtime=0)
        out.write(data)
        directory.append((block[0][0], at, len(data)))
        at += len(data)
        block.clear()

    try:
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "archive", "offset", "length"))):
                block.append(row)
                n += 1
                if len(block) == BLOCK_CAPTURES:
                    flush()
        if block:
            flush()
    finally:
        if out is not None:
            out.close()
    if directory:
        with store.open_output_stream(f"{name}.dir", compression=None) as f:
            f.write(gzip.compress("\n".join("\t".join(map(str, r)) for r in directory).encode(), 6, mtime=0))
        yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name.rsplit("/", 1)[1]]), pa.array([len(directory)], pa.int64()), pa.array([n], pa.int64())], ["first_key", "file", "blocks", "captures"])


FILES = "first_key string, file string, blocks long, captures long"


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Writes blocks and directories in key order; returns a row for each index file."""
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    ordered = captures.repartitionByRange("key", "archive", "offset").sortWithinPartitions("key", "archive", "offset")
    return written(map_arrow(ordered, lambda b: _index(b, folder), FILES), "index")


def holders(firsts: list[str], key: str) -> range:
    """Which of several sorted runs may hold the key, by binary search in their first keys; a key's captures may begin in the run before."""
    return range(max(bisect_left(firsts, key) - 1, 0), bisect_right(firsts, key))


class IndexFile:
    """Captures of a key by binary search in the file's directory, then in the block; the last block stays decoded."""

    def __init__(self, folder: str, file: str):
        store, root = _store(folder)
        with store.open_input_file(f"{root}/{file}.dir") as f:
            rows = [line.split("\t") for line in gzip.decompress(f.read()).decode().split("\n")]
        self.firsts, self.places = [r[0] for r in rows], [(int(o), int(n)) for _, o, n in rows]
        self.blocks, self.at, self.block = store.open_input_file(f"{root}/{file}.idx"), -1, []

    def _read(self, at: int) -> list[tuple[str, str, int, int]]:
        if at != self.at:
            offset, length = self.places[at]
            lines = gzip.decompress(self.blocks.read_at(length, offset)).decode().split("\n")
            self.at, self.block = at, [(k, a, int(o), int(n)) for k, a, o, n in (line.split("\t") for line in lines)]
        return self.block

    def captures(self, key: str) -> list[tuple[str, int, int]]:
        found = []
        for at in holders(self.firsts, key):
            block = self._read(at)
            i = bisect_left(block, (key,))
            while i < len(block) and block[i][0] == key:
                found.append(block[i][1:])
                i += 1
        return found

    def close(self) -> None:
        self.blocks.close()


class Archives:
    """Range reads; keeps the open files of one task, at most 64."""

    def __init__(self, folder: str):
        self.store, self.root = _store(folder)
        self.files: dict = {}

    def _file(self, archive: str):
        if archive not in self.files:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            self.files[archive] = self.store.open_input_file(f"{self.root}/{archive}")
        return self.files[archive]

    def read(self, captures: list[tuple[str, int, int]]):
        """The records of captures sorted by (archive, offset); close ones are read at once."""
        lo = 0
        while lo < len(captures):
            archive, begin, length = captures[lo]
            end, hi = begin + length, lo + 1
            while hi < len(captures) and captures[hi][0] == archive and captures[hi][1] - end <= READ_GAP and captures[hi][1] + captures[hi][2] - begin <= READ_BYTES:
                end, hi = captures[hi][1] + captures[hi][2], hi + 1
            raw = self._file(archive).read_at(end - begin, begin)
            for _, offset, n in captures[lo:hi]:
                yield parse_record(raw[offset - begin : offset - begin + n])
            lo = hi

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def lookup(index: list[tuple[str, str]], folder: str, url: str) -> list[dict]:
    """The records of one URL; index: (first_key, file) of each index file, sorted."""
    key, archives, found = url_key(url), Archives(folder), []
    for at in holders([x[0] for x in index], key):
        file = IndexFile(folder, index[at][1])
        found += archives.read(sorted(file.captures(key)))
        file.close()
    archives.close()
    return found


def _keys(batches, firsts: list[str]):
    """Which index files may hold each URL's key."""
    for b in batches:
        pairs = sorted({(at, key) for key in map(url_key, b.column(0).to_pylist()) for at in holders(firsts, key)})
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs], pa.int32()), pa.array([x[1] for x in pairs], pa.string())], ["file", "key"])


PLACE = "archive string, offset long, length long"


def _captures(batches, folder: str, files: list[str]):
    """Captures of the keys, which come sorted by index file and key."""
    file, open_at = None, -1
    for b in batches:
        found: list[tuple[str, int, int]] = []
        for at, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if at != open_at:
                if file is not None:
                    file.close()
                file, open_at = IndexFile(folder, files[at]), at
            found += file.captures(key)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "offset", "length"])
    if file is not None:
        file.close()


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read_all(batches, folder: str, with_payload: bool):
    archives = Archives(folder)
    for b in batches:
        rows = list(archives.read(list(zip(*(b.column(c).to_pylist() for c in ("archive", "offset", "length"))))))
        columns = [pa.array([r[k] for r in rows], t) for k, t in (("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("type", pa.string()), ("refers_to", pa.int64()))]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        if with_payload:
            columns.append(pa.array([r["payload"] for r in rows], pa.binary()))
            names.append("payload")
        yield pa.RecordBatch.from_arrays(columns, names)
    archives.close()


def read_archives(urls: DataFrame, index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record of the distinct values in urls' only column, through the index."""
    spark = urls.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = sorted((r["first_key"], r["file"]) for r in index.select("first_key", "file").collect())  # one row for each index file, as many as that job had partitions
    firsts, files = [k for k, _ in known], [f for _, f in known]
    keys = map_arrow(urls.distinct(), lambda b: _keys(b, firsts), "file int, key string").distinct()
    keys = keys.repartitionByRange(tasks, "file", "key").sortWithinPartitions("file", "key")
    places = map_arrow(keys, lambda b: _captures(b, folder, files), PLACE)
    places = places.repartition(tasks, "archive", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("archive", "offset")
    return map_arrow(places, lambda b: _read_all(b, folder, with_payload), READ + (", payload binary" if with_payload else ""))


def archive_round_trip(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes pages, builds the index, and reads the records of all their URLs back."""
    folder = qualified(spark, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    captures = write_archives(pages, folder, min_revisit_bytes)
    delete_on_exit(spark, folder)
    return read_archives(pages.select("url"), build_index(captures, folder), folder)
