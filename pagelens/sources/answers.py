"""Answers of servers as a Spark data source: stored ones by host, and live ones behind the same columns.

``spark.read.format("stored_answers").load(path)`` reads what ``df.write.format("stored_answers").save(path)`` stored: a
Parquet file for each task and bucket of hosts, and a list of them.  A bucket is a partition of the read; filters on host
reach the source, which opens only the buckets that may hold the host.  Deal rows out by host before a write, so that a
host is in few files.

``spark.read.format("live_answers").option("urls", path).load()`` fetches each address of the Parquet table at path
(column url) once when it is read, a partition for each bucket of hosts, so that a host is never asked by two tasks at a time.
``method`` = HEAD asks for a status without following redirects; location is then in the headers.

Both have host, url, final_url, status, headers (lower-case names), body and error; a failed connection has an error and
no status.  Reading a stored answer again gives the same rows, so a lost executor costs nothing; a live read that has to be
repeated asks again, and is meant to be stored first.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

BUCKETS, TIMEOUT, MOST_BYTES = 32, 20, 16 << 20
COLUMNS = "host string, url string, final_url string, status int, headers map<string,string>, body binary, error string"
SCHEMA = pa.schema(
    [("host", pa.string()), ("url", pa.string()), ("final_url", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary()), ("error", pa.string())]
)
_LIST = "_answers.json"
ROWS = 256


def bucket_of(host: str | None, buckets: int = BUCKETS) -> int:
    return zlib.crc32((host or "").encode()) % buckets


def host_of(url: str) -> str:
    """The host of an address as ``functions.urls.bare_host`` gives it."""
    found = re.match(r"(?:[a-z][a-z0-9+.\-]*://)?([^/?#]*)", url.lower())
    return re.sub(r"^www\.", "", found[1].split(":")[0])


def _place(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and folder of a path that the driver and all executors share."""
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Bucket(InputPartition):
    def __init__(self, bucket: int, files: list[str], hosts: list[str] | None):
        self.bucket, self.files, self.hosts = bucket, files, hosts


class _Hosts(DataSourceReader):
    """A reader that takes filters on host."""

    hosts: list[str] | None = None

    def pushFilters(self, filters):
        for f in filters:
            wanted = [f.value] if isinstance(f, EqualTo) and f.attribute == ("host",) else list(f.value) if isinstance(f, In) and f.attribute == ("host",) else None
            if wanted is None:
                yield f
            else:
                self.hosts = wanted if self.hosts is None else [h for h in self.hosts if h in wanted]

    def _asked(self, buckets: dict[int, list[str]], count: int) -> list[_Bucket]:
        known = None if self.hosts is None else {bucket_of(h, count) for h in self.hosts}
        found = [_Bucket(b, files, self.hosts) for b, files in sorted(buckets.items()) if known is None or b in known]
        return found or [_Bucket(-1, [], self.hosts)]


class _StoredReader(_Hosts):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        system, folder = _place(self.path)
        with system.open_input_stream(f"{folder}/{_LIST}") as f:
            told = json.loads(f.read())
        return self._asked({int(b): files for b, files in told["files"].items()}, told["buckets"])

    def read(self, partition: _Bucket) -> Iterator[pa.RecordBatch]:
        system, folder = _place(self.path)
        for name in partition.files:
            with pq.ParquetFile(f"{folder}/{name}", filesystem=system) as file:
                for batch in file.iter_batches(batch_size=ROWS):
                    if partition.hosts is not None:
                        batch = batch.filter(pc.is_in(batch.column("host"), pa.array(partition.hosts, pa.string())))
                    if batch.num_rows:
                        yield batch.cast(SCHEMA)


class _Written(WriterCommitMessage):
    def __init__(self, files: dict[int, str]):
        self.files = files


class _StoredWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, buckets: int):
        self.path, self.overwrite, self.buckets, self.run = path, overwrite, buckets, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        open_, files, task = {}, {}, uuid.uuid4().hex
        try:
            for batch in (b.slice(i, ROWS) for b in iterator for i in range(0, b.num_rows, ROWS)):
                told = pa.array([bucket_of(h, self.buckets) for h in batch.column("host").to_pylist()], pa.int32())
                for b in pc.unique(told).to_pylist():
                    if b not in open_:
                        files[b] = f"{self.run}-{task}-{b}.parquet"
                        open_[b] = pq.ParquetWriter(f"{folder}/{files[b]}", SCHEMA, filesystem=system, compression="zstd")
                    open_[b].write_batch(batch.filter(pc.equal(told, b)).select(SCHEMA.names).cast(SCHEMA), row_group_size=ROWS)
        finally:
            for writer in open_.values():
                writer.close()
        return _Written(files)

    def commit(self, messages) -> None:
        """The list names what was written; files of tasks that failed or were overwritten are in no list and are not read."""
        system, folder = _place(self.path)
        told: dict[str, list[str]] = {}
        if not self.overwrite and system.get_file_info(f"{folder}/{_LIST}").type != pyarrow.fs.FileType.NotFound:
            with system.open_input_stream(f"{folder}/{_LIST}") as f:
                before = json.loads(f.read())
            if before["buckets"] != self.buckets:
                raise ValueError(f"the answers at {self.path} have {before['buckets']} buckets")
            told = before["files"]
        for message in messages:
            for b, name in (message.files if message else {}).items():
                told.setdefault(str(b), []).append(name)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{_LIST}") as f:
            f.write(json.dumps({"buckets": self.buckets, "files": told}).encode())

    def abort(self, messages) -> None:
        system, folder = _place(self.path)
        for message in messages:
            for name in (message.files if message else {}).values():
                system.delete_file(f"{folder}/{name}")


class StoredAnswers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_answers"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return _StoredReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _StoredWriter(self.options["path"], overwrite, int(self.options.get("buckets", BUCKETS)))


def _answer(url: str, method: str, timeout: float, agent: str) -> tuple:
    """(host, url, final_url, status, headers, body, error) of one request."""
    import urllib.error
    import urllib.request

    url = url if re.match("https?://", url) else f"https://{url}"

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *a, **k):
            return None

    opener = urllib.request.build_opener(*([Stay] if method == "HEAD" else []))
    request = urllib.request.Request(url, headers={"User-Agent": agent, "Accept-Encoding": "gzip"}, method=method)
    try:
        try:
            found, error = opener.open(request, timeout=timeout), None
        except urllib.error.HTTPError as e:
            found, error = e, f"http_{e.code}"
        with found:
            headers = [(k.lower(), v) for k, v in dict(found.headers.items()).items()]
            return host_of(url), url, found.geturl() or url, found.status, headers, found.read(MOST_BYTES), error
    except Exception as e:  # whatever keeps an answer from coming is the answer's error
        return host_of(url), url, None, None, [], None, f"{type(e).__name__}: {e}"


class _LiveReader(_Hosts):
    def __init__(self, options: dict):
        self.urls, self.method = options["urls"], options.get("method", "GET").upper()
        self.timeout, self.agent, self.buckets = float(options.get("timeout", TIMEOUT)), options.get("agent", "Mozilla/5.0 (compatible; pagelens)"), int(options.get("buckets", BUCKETS))

    def _table(self) -> Iterator[pa.RecordBatch]:
        system, path = _place(self.urls)
        info = system.get_file_info(path)
        names = [path] if info.type == pyarrow.fs.FileType.File else [x.path for x in system.get_file_info(pyarrow.fs.FileSelector(path)) if x.path.endswith(".parquet")]
        for name in sorted(names):
            with pq.ParquetFile(name, filesystem=system) as file:
                yield from file.iter_batches(batch_size=1 << 16, columns=["url"])

    def partitions(self):
        return self._asked({b: [] for b in range(self.buckets)}, self.buckets)

    def read(self, partition: _Bucket) -> Iterator[pa.RecordBatch]:
        for batch in self._table():
            for url in batch.column("url").to_pylist():
                host = host_of(url) if url else None
                if host is None or bucket_of(host, self.buckets) != partition.bucket or (partition.hosts is not None and host not in partition.hosts):
                    continue
                row = _answer(url, self.method, self.timeout, self.agent)
                yield pa.record_batch([pa.array([x], f.type) for x, f in zip(row, SCHEMA, strict=True)], schema=SCHEMA)


class LiveAnswers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live_answers"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return _LiveReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session, with filters handed down to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (StoredAnswers, LiveAnswers):
        spark.dataSource.register(source)
