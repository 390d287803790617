"""Media columns: texts as lossless 8-bit images in archives, and the data source that reads them.

A payload is the text's bytes padded with zeros to rows of 64 samples; its stored form is
an 8-bit grey PNG. Each task writes one tar archive and beside it a list of member offsets
about ``RANGE_BYTES`` apart. The data source ``media_archive`` plans byte ranges from those
lists over a directory of archives, streams members as Arrow batches of bounded bytes, and
reads each member again by its offset, alone, when reading or decoding it fails. An archive
is written under a task's own name and renamed when whole, so a task that is run again, or
twice, leaves the same file.

Defined cases: a null or empty text has 0 bytes and a payload of 64 zeros; equal texts give
equal values; null ids and repeated rows are kept; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import tarfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import arrow_rows, documents, new_path

WIDTH = 64
RANGE_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
TRIES = 3
_SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format


def payload(text: str | None) -> tuple[bytes, int]:
    """The text's bytes padded to a positive multiple of 64, and their number before padding."""
    raw = (text or "").encode()
    return raw + b"\0" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw)), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(samples: bytes, level: int = 6) -> bytes:
    """Rows of 64 grey samples as PNG, unfiltered."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """Samples of an 8-bit grey PNG without interlace, row filters None, Sub or Up."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, body, width, height = 8, [], 0, 0
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", data)
            if (depth, colour, lace) != (8, 0, 0):
                raise ValueError("only 8-bit grey without interlace")
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    out = lines[:, 1:].copy()
    for i in np.flatnonzero(lines[:, 0]):
        if lines[i, 0] == 1:
            out[i] = np.cumsum(out[i], dtype=np.uint8)
        elif lines[i, 0] == 2:
            out[i] += out[i - 1] if i else 0
        else:
            raise ValueError("row filter not supported")
    return out.tobytes()


def intact(media: bytes) -> bool:
    """Whether a PNG's chunks follow each other to its end chunk, each with its checksum."""
    at, kind = 8, b""
    while at + 12 <= len(media) and kind != b"IEND":
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        if at + 12 + n > len(media) or zlib.crc32(media[at + 4 : at + 8 + n]) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            return False
        at += 12 + n
    return media[:8] == _SIGNATURE and kind == b"IEND" and at == len(media)


def feature(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, mean step between neighbours, and a 16-bin histogram hash."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    step = np.abs(np.diff(x.astype(np.int16))).mean() if len(x) > 1 else 0.0
    bins = counts.reshape(16, 16).sum(axis=1)
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={abs(-(p * np.log2(p)).sum()):.4f};step={step:.4f};hist={','.join(map(str, bins.tolist()))}"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class ArchiveWriter:
    """A tar archive and its list of range starts, renamed into place when whole."""

    def __init__(self, uri: str, name: str, attempt: int):
        self.files, base = _opened(uri)
        self.files.create_dir(base, recursive=True)
        self.final, self.temp = f"{base}/{name}.tar", f"{base}/_{name}.{attempt}"
        self.out = self.files.open_output_stream(self.temp)
        self.at, self.ranges = 0, []

    def add(self, name: str, body: bytes) -> None:
        if not self.ranges or self.at - self.ranges[-1] >= RANGE_BYTES:
            self.ranges.append(self.at)
        info = tarfile.TarInfo(name)
        info.size = len(body)
        block = info.tobuf(tarfile.USTAR_FORMAT) + body + b"\0" * (-len(body) % 512)
        self.out.write(block)
        self.at += len(block)

    def close(self) -> int:
        self.out.write(b"\0" * 1024)
        self.out.close()
        with self.files.open_output_stream(self.temp + ".ranges") as f:
            f.write(json.dumps({"starts": self.ranges, "stop": self.at}).encode())
        self.files.move(self.temp + ".ranges", self.final + ".ranges")
        self.files.move(self.temp, self.final)
        return self.at


def write_archives(docs: DataFrame, uri: str) -> list[tuple[str, int, int]]:
    """Writes ``docs(doc_id, text)`` as archives under ``uri``; (name, members, bytes) of each."""

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        writer, n = None, 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                writer = writer or ArchiveWriter(uri, f"part-{task.partitionId():06d}", task.taskAttemptId())
                samples, size = payload(text)
                writer.add(f"{'' if doc is None else doc}.{size}.png", encode_png(samples))
                n += 1
        if writer:
            yield pa.RecordBatch.from_pydict({"name": [writer.final], "members": [n], "bytes": [writer.close()]})

    return [tuple(r) for r in docs.mapInArrow(write, "name string, members long, bytes long").collect()]


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    stop: int

    def __post_init__(self) -> None:
        super().__init__(self.path)


class ArchiveReader(DataSourceReader):
    """Byte ranges of every archive of a directory; one task reads one range."""

    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self):
        files, base = _opened(self.uri)
        found = []
        for info in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if info.path.endswith(".tar"):
                with files.open_input_stream(info.path + ".ranges") as f:
                    plan = json.loads(f.read())
                found += [ByteRange(info.path, a, b) for a, b in zip(plan["starts"], plan["starts"][1:] + [plan["stop"]])]
        return sorted(found, key=lambda r: (r.path, r.start)) or [ByteRange("", 0, 0)]

    def member(self, path: str, offset: int) -> tuple[str, bytes, int]:
        """Name, stored bytes and the next offset of the member at an offset, read alone and checked; tried again when that fails."""
        for left in range(TRIES - 1, -1, -1):
            try:
                files, _ = _opened(self.uri)
                with files.open_input_file(path) as f:
                    f.seek(offset)
                    info = tarfile.TarInfo.frombuf(f.read(512), "utf-8", "strict")
                    body = f.read(info.size)
                    if len(body) != info.size:
                        raise OSError(f"short member at {offset} of {path}")
                    decode_png(body)
                    return info.name, body, offset + 512 + -(-info.size // 512) * 512
            except (OSError, ValueError, tarfile.TarError, zlib.error):
                if not left:
                    raise
        raise AssertionError

    def read(self, partition):
        if partition.path:
            files, _ = _opened(self.uri)
            rows, held, at = [], 0, partition.start
            with files.open_input_file(partition.path) as f:
                while at < partition.stop:
                    window = 0
                    block = b""
                    try:
                        f.seek(at)
                        block = f.read(min(BATCH_BYTES, partition.stop - at))
                    except OSError:
                        pass
                    while at < partition.stop:
                        try:
                            info = tarfile.TarInfo.frombuf(block[window : window + 512], "utf-8", "strict")
                            body = block[window + 512 : window + 512 + info.size]
                            if len(body) < info.size:
                                raise tarfile.TruncatedHeaderError("beyond the window")
                            name, following = info.name, at + 512 + -(-info.size // 512) * 512
                            if not intact(body):
                                name, body, following = self.member(partition.path, at)
                        except tarfile.TarError:
                            if window:
                                break  # the window ends inside this member: move it
                            name, body, following = self.member(partition.path, at)
                            block = b""
                        rows.append((int(name.split(".")[0]) if name[0] != "." else None, int(name.split(".")[1]), body, partition.path, at))
                        held, window, at = held + len(body), window + following - at, following
                        if held >= BATCH_BYTES:
                            yield self._batch(rows)
                            rows, held = [], 0
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_bytes", "media", "path", "member_offset"])


class MediaArchives(DataSource):
    """``spark.read.format("media_archive").load(directory)``."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return "doc_id bigint, n_bytes bigint, media binary, path string, member_offset bigint"

    def reader(self, schema):
        return ArchiveReader(self.options["path"])


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document, from the stored bytes read back: sizes, checksums and the feature of its payload."""
    spark = df.sparkSession
    uri = new_path(spark, "media")
    write_archives(documents(arrow_rows(df), id_col, text_col), uri)
    spark.dataSource.register(MediaArchives)
    stored = spark.read.format("media_archive").load(uri)

    def read_back(batches):
        for batch in batches:
            rows = []
            for doc, n, media in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                samples = decode_png(media)
                rows.append((doc, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(read_back, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
