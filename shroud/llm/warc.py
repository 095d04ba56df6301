"""Deterministic sharded WARC files.

Records are range-sorted by id; each range is one shard, whose files roll by compressed size, a
gzip member a record. The ranges' borders come from exact running sums of payload bytes over the sorted ids, so
they depend on the rows alone. Headers, digests and record ids are made anew from the payload and the id,
so the same rows give the same bytes. Of equal payloads the smallest id is the response and the
others are revisits, which carry no payload. A task writes under a temporary name of its own
attempt; the names that succeeded form a manifest, tasks rename them, and the manifest table,
written last, is the commit. Rereading takes only files that the manifest lists.

Defined cases: a null payload is empty. Repeated ids are each written, and one id's rows may span shards;
among equal payloads all rows of the smallest id are responses. Null ids come first. An empty table writes an
empty manifest. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shroud.llm.scratch import new_path, write_table

DATE = "1970-01-01T00:00:00Z"
NULL_ID = -(1 << 63)
HEAD_BYTES = 600  # about what a record's headers add to its payload
MANIFEST = "shard long, file_no long, name string, temp string, records long, bytes long, sha256 string"
RECORD = "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(id_: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'record:{id_}')}>"


def build_record(id_: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record of WARC/1.1; the payload's digest and length are in the headers of revisits too."""
    digest, revisit = payload_digest(payload), refers_to is not None
    url = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(id_),
        "WARC-Date": DATE,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{payload_digest(block)}",
        "X-Record-Key": "" if id_ is None else str(id_),
    }
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Key": str(refers_to)}
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int) -> bytes:
    """A gzip member without time or name."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def revisits(narrow: DataFrame) -> DataFrame:
    """(id, place, digest, refers_to) of payloads whose response is another id, the smallest one.

    Narrow rows group by the payload's digest with partial minima, so a payload that a third of the
    rows share is no hot task there; the join back is one that adaptive execution splits.
    """
    first = narrow.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return narrow.join(first, "digest").where("not (id <=> refers_to)").select("id", "place", "digest", "refers_to").distinct()


def shard_borders(narrow: DataFrame, shard_bytes: int, max_shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Least (id, place) of every shard but the first, at most ``max_shards`` of them, by running sums of bytes."""
    spark = narrow.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = narrow.groupBy(F.coalesce("id", F.lit(NULL_ID)).alias("id"), "place").agg(F.sum("size").alias("size"))
    ordered = keys.repartitionByRange(parts, "id", "place").sortWithinPartitions("id", "place").withColumn("part", F.spark_partition_id())

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = 0
        for b in batches:
            ends = at + b["size"].cumsum()
            yield b.assign(start=ends - b["size"])
            at = int(ends.iloc[-1]) if len(ends) else at

    placed = write_table(ordered.mapInPandas(sums, "id long, place long, size long, part int, start long"), "sizes")
    of_part = placed.groupBy("part").agg(F.sum("size").alias("bytes"))
    before = of_part.select("part", (F.sum("bytes").over(Window.orderBy("part")) - F.col("bytes")).alias("before"))  # one row a range
    total = of_part.agg(F.sum("bytes")).first()[0] or 0
    size = max(shard_bytes, -(-total // max_shards), 1)
    shard = F.floor((F.col("start") + F.col("before")) / size).alias("shard")
    firsts = placed.join(F.broadcast(before), "part").groupBy(shard).agg(F.min(F.struct("id", "place")).alias("k")).where("shard > 0").select("k.*").orderBy("id", "place").collect()
    return np.array([r["id"] for r in firsts], np.int64), np.array([r["place"] for r in firsts], np.int64)


def shard_of(ids: np.ndarray, places: np.ndarray, borders: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many borders are at or before each (id, place)."""
    of_id, of_place = borders
    low, high = np.searchsorted(of_id, ids, "left"), np.searchsorted(of_id, ids, "right")
    for i in np.flatnonzero(high > low):  # rows of an id at which a shard begins
        low[i] += np.searchsorted(of_place[low[i] : high[i]], places[i], "right")
    return low


def write(
    pages: DataFrame,
    target: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    shard_bytes: int = 32 << 20,
    max_shards: int = 20_000,
    roll_bytes: int = 256 << 20,
    level: int = 6,
) -> DataFrame:
    """Write all rows under ``target`` and return the manifest as reread from there.

    Shards hold about ``shard_bytes`` of payload, more once that would make over ``max_shards``;
    files hold at most ``roll_bytes`` compressed or one record. Payloads are shuffled once, each
    shard to a task of its own: which rows are revisits arrives as narrow rows that sort right
    before the records of the same id.
    """
    spark = pages.sparkSession
    text = dict(pages.dtypes)[payload_col] == "string"
    payload = F.encode(F.col(payload_col), "UTF-8") if text else F.col(payload_col)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(payload, F.lit(b"")).alias("payload"))
    place = F.xxhash64("payload").alias("place")
    narrow = rows.select("id", place, F.sha2("payload", 256).alias("digest"), (F.octet_length("payload") + HEAD_BYTES).cast("long").alias("size"))
    narrow = write_table(narrow, "narrow")
    borders = shard_borders(narrow, shard_bytes, max_shards)

    @F.pandas_udf("int")
    def shard_number(id_: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series(shard_of(id_.to_numpy(np.int64), place.to_numpy(np.int64), borders))

    def dealt(df: DataFrame) -> DataFrame:
        shard: Column = shard_number(F.coalesce("id", F.lit(NULL_ID)), F.col("place")) if len(borders[0]) else F.lit(0)
        return df.withColumn("shard", shard).drop("place")

    null = F.lit(None)
    records = dealt(rows.select("id", F.lit(1).alias("part"), "url", "payload", null.cast("string").alias("digest"), null.cast("long").alias("refers_to"), place))
    marks = dealt(revisits(narrow).select("id", F.lit(0).alias("part"), null.cast("string").alias("url"), null.cast("binary").alias("payload"), "digest", "refers_to", "place"))
    both = records.unionByName(marks).repartitionById(len(borders[0]) + 1, "shard").sortWithinPartitions("id", "part", "url", "payload")

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_fs(target)
        fs.create_dir(f"{base}/temporary", recursive=True)
        fs.create_dir(f"{base}/archive", recursive=True)
        out, stream, no, done, marked_id, marked = None, None, 0, [], None, {}

        def close() -> None:
            nonlocal out, no
            if out:
                stream.close()
                done.append((out["shard"], no, f"{out['shard']:05d}-{no:05d}.warc.gz", out["temp"], out["records"], out["bytes"], out["sha"].hexdigest()))
                no += 1
            out = None

        for batch in batches:
            for id_, part, url, body, digest, refers, shard in batch[["id", "part", "url", "payload", "digest", "refers_to", "shard"]].itertuples(index=False):
                key = None if pd.isna(id_) else int(id_)
                if key != marked_id:
                    marked_id, marked = key, {}
                if not part:
                    marked[digest] = int(refers)
                    continue
                body = bytes(body)
                data = member(build_record(key, url, body, marked.get(hashlib.sha256(body).hexdigest()) if marked else None), level)
                if out and out["bytes"] + len(data) > roll_bytes:
                    close()
                if not out:
                    temp = f"{shard:05d}-{no:05d}-{uuid.uuid4().hex}"
                    stream = fs.open_output_stream(f"{base}/temporary/{temp}", compression=None)
                    out = {"shard": int(shard), "temp": temp, "records": 0, "bytes": 0, "sha": hashlib.sha256()}
                stream.write(data)
                out["sha"].update(data)
                out["bytes"] += len(data)
                out["records"] += 1
        close()
        yield pd.DataFrame(done, columns=[c.split()[0] for c in MANIFEST.split(", ")])

    attempt = f"{target}/attempt-{uuid.uuid4().hex}"
    both.mapInPandas(save, MANIFEST).write.parquet(attempt)  # files of attempts that failed are in no manifest

    def rename(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_fs(target)
        for batch in batches:
            for r in batch.itertuples(index=False):
                if fs.get_file_info(f"{base}/temporary/{r.temp}").type == pafs.FileType.File:  # else a task before did it
                    fs.move(f"{base}/temporary/{r.temp}", f"{base}/archive/{r.name}")
            yield batch

    spark.read.schema(MANIFEST).parquet(attempt).mapInPandas(rename, MANIFEST).write.parquet(f"{target}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{target}/manifest")


def parse_records(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of a WARC stream, decompressed; raises if a digest does not hold."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline().strip()) != b"":
            k, _, v = line.partition(b":")
            head[k.decode().lower()] = v.strip().decode()
        block = stream.read(int(head["content-length"]))
        if f"sha1:{payload_digest(block)}" != head["warc-block-digest"]:
            raise ValueError(f"block digest differs in {head['warc-record-id']}")
        http, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(h.partition(b":")[2]) for h in http.split(b"\r\n") if h.lower().startswith(b"content-length:"))
        if head["warc-type"] == "response" and (len(payload) != size or f"sha1:{payload_digest(payload)}" != head["warc-payload-digest"]):
            raise ValueError(f"payload differs in {head['warc-record-id']}")
        yield head | {"payload": payload, "payload_bytes": size}


def read(spark: SparkSession, target: str, with_payload: bool = False) -> DataFrame:
    """Records of the files that the manifest lists, a file a row of work, streamed."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_fs(target)
        columns = [c.split()[0] for c in RECORD.split(", ")]
        for batch in batches:
            for name in batch["name"]:
                out = []
                with fs.open_input_stream(f"{base}/archive/{name}", compression=None) as f, gzip.GzipFile(fileobj=f) as raw, io.BufferedReader(raw, 1 << 20) as stream:
                    for r in parse_records(stream):
                        key, refers = r["x-record-key"], r.get("x-refers-to-key")
                        out.append((int(key) if key else None, r["warc-target-uri"], r["warc-type"], int(refers) if refers else None, r["payload_bytes"], r["warc-payload-digest"].removeprefix("sha1:"), r["payload"] if with_payload else None))
                        if len(out) == 1000:
                            yield _frame(out, columns)
                            out = []
                yield _frame(out, columns)

    files = spark.read.schema(MANIFEST).parquet(f"{target}/manifest")
    return files.repartition(max(1, min(20_000, files.count()))).mapInPandas(load, RECORD)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns).astype({"id": "Int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write to a new place in the shared folder and read back."""
    target = new_path(pages.sparkSession, "warc")
    write(pages, target, **options)
    return read(pages.sparkSession, target)
