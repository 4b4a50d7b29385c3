"""Media columns: texts stored as 8-bit sound in archives, read back through a Spark data source.

`media_archive` is a Spark data source. Its writer puts one WAV member (8-bit mono samples) for each row into ZIP
archives, one archive for each task, and its commit writes a manifest with the archives of the tasks that won, so
that lost or repeated attempts leave nothing visible. Its reader plans byte ranges over the archives of the folder;
a task reads the directory at the end of its archive, takes the members that begin in its range, streams them as Arrow
batches, and retries each member by itself at its offset. A member that can't be read gives a row with `error`.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import cut, new_folder, remove, shared_dir

UNIT = 192
PAD = b" "
RATE = 8000
RANGE_BYTES = 32 << 20
TRIES = 3
BATCH_BYTES = 8 << 20
MANIFEST = "_manifest.json"

SCHEMA = "member string, doc_id long, n_bytes long, archive string, at long, media binary, error string"
FIELDS = pa.schema([("member", pa.string()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("archive", pa.string()), ("at", pa.int64()), ("media", pa.binary()), ("error", pa.string())])


def filesystem(uri: str):
    """The file system and the path in it; pyarrow knows local folders and the usual stores."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def padded(payload: bytes) -> bytes:
    """payload with bytes 32 up to a positive multiple of the unit."""
    return payload + PAD * (UNIT - len(payload) % UNIT if len(payload) % UNIT or not payload else 0)


def wav(samples: bytes) -> bytes:
    """A RIFF file of 8-bit mono samples, the same bytes for the same samples."""
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples))
    return b"RIFF" + struct.pack("<I", len(head) + len(samples)) + head + samples


def samples(media: bytes) -> bytes:
    """The samples of a RIFF file made by wav(); ValueError if it is another."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not an 8-bit wave file")
    n = struct.unpack_from("<I", media, 40)[0]
    if len(media) != 44 + n:
        raise ValueError("wave file cut short")
    return media[44:]


@dataclass
class Written(WriterCommitMessage):
    archive: str | None
    members: int


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows (doc_id, payload) of one task become one archive under a name that no other attempt uses."""
        archive, n = f"part-{uuid.uuid4().hex}.zip", 0
        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/{archive}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
            for batch in iterator:
                for doc_id, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    info = zipfile.ZipInfo(f"{n:08d}.wav", (1980, 1, 1, 0, 0, 0))
                    info.compress_type = zipfile.ZIP_DEFLATED
                    info.comment = json.dumps([doc_id, len(payload)]).encode()
                    z.writestr(info, wav(padded(payload)))
                    n += 1
        if not n:
            files.delete_file(f"{root}/{archive}")
        return Written(archive if n else None, n)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        kept = sorted(m.archive for m in messages if m and m.archive)
        with files.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(kept).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, root = filesystem(self.path)
        for m in messages:
            if m and m.archive:
                files.delete_file(f"{root}/{m.archive}")


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int) -> None:
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[ByteRange]:
        """Byte ranges over the archives that the manifest names; no archive is opened here."""
        files, root = filesystem(self.path)
        with files.open_input_stream(f"{root}/{MANIFEST}") as f:
            names = json.loads(f.read())
        infos = files.get_file_info([f"{root}/{n}" for n in names])
        cuts = [ByteRange(i.path, s, min(i.size, s + self.range_bytes)) for i in infos for s in range(0, i.size, self.range_bytes)]
        return cuts or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        files, _ = filesystem(self.path)
        with files.open_input_file(partition.archive) as f:
            with zipfile.ZipFile(f) as z:
                members = [i for i in z.infolist() if partition.start <= i.header_offset < partition.end]
        rows, held = [], 0
        for info in members:
            row = self.member(files, partition.archive, info)
            rows.append(row)
            held += len(row[5] or b"")
            if held >= BATCH_BYTES:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def member(self, files, archive: str, info: zipfile.ZipInfo) -> tuple:
        """One member, read at its own offset as often as needed; the others don't see its failures."""
        doc_id, n_bytes = json.loads(info.comment)
        for k in range(TRIES):
            try:
                return info.filename, doc_id, n_bytes, archive, info.header_offset, self.payload(files, archive, info), None
            except Exception as e:  # noqa: BLE001  any failure of a store or of the member's bytes
                error = f"{type(e).__name__}: {e}"
                time.sleep(0.05 * 2**k)
        return info.filename, doc_id, n_bytes, archive, info.header_offset, None, error

    @staticmethod
    def payload(files, archive: str, info: zipfile.ZipInfo) -> bytes:
        with files.open_input_file(archive) as f:
            f.seek(info.header_offset)
            head = f.read(30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError("no member begins at this offset")
            f.seek(info.header_offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
            media = zlib.decompress(f.read(info.compress_size), -15)
        if zlib.crc32(media) != info.CRC:
            raise ValueError("checksum of the member differs")
        return media

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FIELDS, strict=True)], schema=FIELDS)


class ArchiveSource(DataSource):
    """Options: path, range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def feature(values: np.ndarray) -> str:
    """Root mean square, mean crossings for each thousand samples, and the busiest of sixteen levels."""
    level = values.astype(np.float64) - 128.0
    crossings = int(np.count_nonzero(np.diff(np.signbit(level - level.mean()))))
    levels = np.bincount(values >> 4, minlength=16)
    return f"rms={np.sqrt((level**2).mean()):.4f};crossings={1000 * crossings // len(values)};level={int(levels.argmax())}"


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def described(media: DataFrame, on_error: str = "row") -> DataFrame:
    """Digests and features of stored members (rows of `media_archive`), computed from their bytes.

    A member that can't be read after all tries becomes a row of nulls with its error, or, with on_error `fail`, ends
    the job: then a result is complete.
    """
    if on_error not in ("row", "fail"):
        raise ValueError("on_error must be row or fail")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, body, error in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if body is None and on_error == "fail":
                    raise OSError(f"the member of document {doc_id} can't be read: {error}")
                if body is None:
                    rows.append((doc_id, n, None, None, None, None, None, None, error))
                    continue
                payload = samples(body)
                tail = zlib.crc32(payload[-16:])
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), tail, len(body), hashlib.sha256(body).hexdigest(), feature(np.frombuffer(payload, np.uint8)), None))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64()] + [pa.string()] * 3
            names = [c.split()[0] for c in RESULT.split(", ")]
            cols = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return media.select("doc_id", "n_bytes", "media", "error").mapInArrow(run, RESULT)


def store(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the texts of docs as an archive folder and return it as a DataFrame of members.

    A null text is empty; an empty text gives one unit of padding. Null ids, repeated rows and an empty table are
    kept as they are. Other columns aren't read.
    """
    spark = docs.sparkSession
    spark.dataSource.register(ArchiveSource)
    payload = F.coalesce(F.col(text), F.lit("")).cast("binary")
    docs.select(F.col(doc_id).cast("long").alias("doc_id"), payload.alias("payload")).write.format("media_archive").option("path", path).mode("append").save()
    return spark.read.format("media_archive").option("path", path).load()


def media_columns(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", on_error: str = "fail") -> DataFrame:
    """Store the texts of docs as media and describe what is read back, one row for each row of docs.

    A member that can't be read back ends the job, unless on_error is `row`.

    Without a path the archives go to a folder of their own, which is removed once they are described.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    if path:
        return described(store(docs, path, doc_id, text), on_error)
    folder = new_folder(spark, "media")
    out = cut(described(store(docs, folder, doc_id, text), on_error))
    remove(spark, folder)
    return out
