"""The chunked container: a header, then tagged chunks to the end of the file.

    magic | u64 frames, f32 fps, u16 width, u16 height, u8 flags | chunks
    chunk: u8 type, u8 compressed, u32 length | payload

All numbers are big-endian; a compressed payload is a zlib stream. Files are read with Spark's binaryFile
source and written with its text writer, so any Hadoop file system serves; the writer puts the
metadata last, whose JSON ends in the line end that the text writer adds.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format.
MAGIC = b"DFY\x01"
HEADER, CHUNK = struct.Struct(">QfHHB"), struct.Struct(">BBI")
KINDS = {1: "background", 2: "cycle_canon", 3: "cycle_delta", 4: "imu", 5: "frame_skip", 6: "metadata", 7: "codebook"}
IMU, METADATA = 4, 6
TEMPORAL, BBOX, VQ = 1, 2, 4
LEVEL = 6

HEADER_TYPE = "frames long, fps double, width int, height int, flags int"


def pack_header(frames: int, fps: float, width: int, height: int, flags: int = 0) -> bytes:
    return MAGIC + HEADER.pack(frames, fps, width, height, flags)


def pack_chunk(kind: int, payload: bytes, compress: bool = True) -> bytes:
    data = zlib.compress(payload, LEVEL) if compress else payload
    return CHUNK.pack(kind, int(compress), len(data)) + data


def parse_header(content: bytes) -> tuple[int, float, int, int, int]:
    if bytes(content[:4]) != MAGIC or len(content) < 4 + HEADER.size:
        raise ValueError("not a container: wrong magic or a short header")
    return HEADER.unpack_from(content, 4)


def parse_chunks(content: bytes, lenient: bool = False) -> Iterator[tuple[int, int, bool, int, bytes]]:
    """(pos, kind, compressed, stored length, payload). Strict: unknown kinds and truncation raise; lenient: skipped, and the end."""
    parse_header(content)
    at, pos = 4 + HEADER.size, 0
    while at < len(content):
        if at + CHUNK.size > len(content):
            if lenient:
                return
            raise ValueError("truncated chunk header")
        kind, compressed, length = CHUNK.unpack_from(content, at)
        at += CHUNK.size
        data = bytes(content[at : at + length])
        at += length
        if len(data) < length:
            if lenient:
                return
            raise ValueError("truncated chunk")
        if kind not in KINDS:
            if lenient:
                continue
            raise ValueError(f"unknown chunk type {kind}")
        yield pos, kind, bool(compressed), length, zlib.decompress(data) if compressed else data
        pos += 1


def files(spark: SparkSession, path: str) -> DataFrame:
    """All container files below path: (path, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("path", "content")


def discover(spark: SparkSession, path: str, suffix: str = ".dfy") -> DataFrame:
    """(path, length) of the files with suffix below a folder, or of one file, by path. An error if there is none, or the file has another suffix."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in name and not name.endswith(suffix):
        raise ValueError(f"expected a file with suffix {suffix} or a folder, not {path}")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path).select("path", "length").orderBy("path")
    if found.limit(1).count() == 0:
        raise FileNotFoundError(f"no {suffix} files below {path}")
    return found


def describe(of: DataFrame) -> DataFrame:
    """(path, frames, fps, width, height, seconds, bytes, raw_bytes, ratio, n_cycles, n_canonicals, quality) of (path, content)."""
    h = headers(of).select("path", "header.*").join(of.select("path", F.octet_length("content").cast("long").alias("bytes")), "path")
    meta = metadata(chunks(of)).select("path", "meta.n_cycles", "meta.n_canonicals", "meta.quality")
    raw = F.col("frames") * F.col("width") * F.col("height") * 3
    seconds = F.when(F.col("fps") > 0, F.col("frames") / F.col("fps")).otherwise(0.0)
    return h.join(meta, "path", "left").select(
        "path", "frames", "fps", "width", "height", seconds.alias("seconds"), "bytes", raw.alias("raw_bytes"), (raw / F.col("bytes")).alias("ratio"), "n_cycles", "n_canonicals", "quality"
    )


def orientations(of: DataFrame) -> DataFrame:
    """(path, k, x, y, z, w) from the orientation chunks of (path, kind, payload): half floats, little-endian, read without Python."""
    def half(at: Column) -> Column:
        bits = F.conv(F.concat(F.substr(F.hex("payload"), at + 3, F.lit(2)), F.substr(F.hex("payload"), at + 1, F.lit(2))), 16, 10).cast("int")
        sign = F.when(bits.bitwiseAND(F.lit(0x8000)) != 0, -1.0).otherwise(1.0)
        exponent, fraction = F.shiftright(bits, 10).bitwiseAND(F.lit(31)), bits.bitwiseAND(F.lit(1023)) / 1024.0
        return sign * F.when(exponent == 0, fraction * 2.0**-14).otherwise((1 + fraction) * F.pow(F.lit(2.0), exponent - 15))

    rows = of.where((F.col("kind") == IMU) & (F.octet_length("payload") >= 8)).select("path", "payload", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("payload") / 8).cast("int") - 1)).alias("k"))
    return rows.select("path", "k", *(half(F.col("k") * 16 + 4 * j).alias(c) for j, c in enumerate("xyzw")))


def headers(of: DataFrame) -> DataFrame:
    """(path, header struct) of (path, content), without Python: the numbers are read from the bytes."""
    def number(start: int, size: int) -> Column:
        return F.conv(F.hex(F.substring("content", start, size)), 16, 10).cast("long")

    bits = number(13, 4)
    exponent, fraction = F.shiftright(bits, 23).bitwiseAND(F.lit(255)), bits.bitwiseAND(F.lit((1 << 23) - 1))
    fps = F.when(exponent == 0, F.lit(0.0)).otherwise((1 + fraction / float(1 << 23)) * F.pow(F.lit(2.0), exponent - 127))
    good = F.substring("content", 1, 4) == F.lit(MAGIC)
    header = F.struct(number(5, 8).alias("frames"), fps.alias("fps"), number(17, 2).cast("int").alias("width"), number(19, 2).cast("int").alias("height"), number(21, 1).cast("int").alias("flags"))
    return of.select("path", F.when(good, header).otherwise(F.raise_error(F.lit("not a container: wrong magic"))).alias("header"))


def chunks(of: DataFrame, lenient: bool = False) -> DataFrame:
    """(path, pos, kind, compressed, length, payload) of (path, content); one file's bytes are in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for pos, kind, compressed, length, payload in parse_chunks(content.as_py(), lenient):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]), pa.array([pos], pa.int32()), pa.array([kind], pa.int32()), pa.array([compressed]), pa.array([length], pa.int64()), pa.array([payload], pa.binary())],
                        ["path", "pos", "kind", "compressed", "length", "payload"],
                    )

    return of.select("path", "content").mapInArrow(run, "path string, pos int, kind int, compressed boolean, length long, payload binary")


def assemble(parts: DataFrame) -> DataFrame:
    """(video, content) of parts (video, header struct, metadata json string, chunks array<struct<kind, compress, payload>>)."""

    @F.arrow_udf("binary")
    def whole(header: pa.Array, metadata: pa.Array, of: pa.Array) -> pa.Array:
        out = []
        for h, m, c in zip(header.to_pylist(), metadata.to_pylist(), of.to_pylist(), strict=True):
            body = [pack_chunk(x["kind"], x["payload"] or b"", bool(x["compress"])) for x in c or ()]
            tail = pack_chunk(METADATA, (m or "{}").rstrip().encode() + b"\n", compress=False)
            out.append(b"".join([pack_header(*(h[k] for k in ("frames", "fps", "width", "height", "flags"))), *body, tail]))
        return pa.array(out, pa.binary())

    return parts.select("video", whole("header", "metadata", "chunks").alias("content"))


def write(containers: DataFrame, path: str) -> None:
    """A file for each row of containers (content, as assemble() makes it)."""
    text = F.substring("content", F.lit(1), F.octet_length("content") - 1).cast("string")
    containers.select(text.alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def bytes_written(of: DataFrame) -> DataFrame:
    """(path, bytes): the size of a file from its chunks' stored lengths."""
    return of.groupBy("path").agg((F.sum("length") + 4 + HEADER.size + CHUNK.size * F.count("*")).alias("bytes"))


def metadata(of: DataFrame) -> DataFrame:
    """(path, meta struct) from the metadata chunks."""
    shape = "total_frames long, fps double, n_cycles int, n_canonicals int, quality int, use_temporal boolean, use_bbox boolean, cycle_map array<array<int>>"
    return of.where(F.col("kind") == METADATA).select("path", F.from_json(F.col("payload").cast("string"), shape).alias("meta"))


def playback(of: DataFrame) -> DataFrame:
    """(path, pos, kind, idx) in the order of the cycle map: kind 0 is a representative, 1 another cycle."""
    return of.select("path", F.posexplode("meta.cycle_map").alias("pos", "e")).select("path", "pos", F.get("e", 0).alias("kind"), F.get("e", 1).alias("idx"))


def to_json(record: dict) -> str:
    return json.dumps(record, separators=(",", ":"))
