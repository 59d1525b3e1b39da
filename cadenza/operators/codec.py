"""The whole codec: frames of pixels to container files and back.

Frames are rows (video, frame_idx from 0, height, width, pixels binary of height x width x 3 bytes). Encoding
is a plan of set-based steps (moments, energies, segmentation) around two coding steps whose groups are
independent: runs of 26 frames between intra frames in representative cycles, and single frames of
other cycles against the decoded representative. Only the last step gathers a video: into its file.

    box              u16 height, width, y0, x0, box height, box width
    frame            [box, if boxed] u16 height, u16 width, u8 quality | zlib of run lengths
    frame of codes   u8 1 [box, if boxed] u8 quality, u16 height, u16 width, u32 blocks | zlib of a code for each block, channel by channel
    representative   u32 frames, u8 flags | each: u8 type, u32 size, frame (flags without TEMPORAL: no type, all intra, in luma and colour differences)
    other cycle      u16 representative, u32 frames | each: u32 size, frame
    codebook         u16 codes, u16 64 | half floats

Whether frames are boxed is told by the flags, never guessed from the bytes. Beyond the end of its
representative a cycle is coded against the background. The background is stored without loss.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.transform import KB, KG, KR, basis, quant_table
from cadenza.operators import cycles as seg
from cadenza.operators import imu
from cadenza.operators.background import ABSOLUTE, FLOOR, SIGMA, WARMUP
from cadenza.operators.prediction import RUN
from cadenza.operators.sequence import with_previous
from cadenza.session import written
from cadenza.sources import container

_PAIR = np.dtype([("value", ">i2"), ("run", "u1")])
MARGIN = 8


def pack_levels(flat: np.ndarray) -> bytes:
    """Run lengths of levels: zeros as (0, up to 255), others as (value, 1)."""
    at = np.flatnonzero(flat)
    gaps = np.diff(np.concatenate([[-1], at, [len(flat)]])) - 1
    whole, rest = np.divmod(gaps, 255)
    zeros = whole + (rest > 0)
    ends = np.cumsum(zeros[:-1] + 1) - 1  # where each level other than 0 goes
    out = np.zeros(int(zeros.sum()) + len(at), _PAIR)
    out["run"] = 255
    starts = np.concatenate([[0], ends + 1])
    part = rest > 0
    out["run"][starts[part] + zeros[part] - 1] = rest[part]
    out["value"][ends], out["run"][ends] = flat[at], 1
    return out.tobytes()


def unpack_levels(raw: bytes, n: int) -> np.ndarray:
    pairs = np.frombuffer(raw[: len(raw) // 3 * 3], _PAIR)
    value = pairs["value"].astype(np.int16)
    span = np.where(value == 0, pairs["run"].astype(np.int64), 1)
    at = np.cumsum(span) - span
    held = (value != 0) & (at < n)
    out = np.zeros(n, np.int16)
    out[at[held]] = value[held]
    return out


def _blocks(plane: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    return plane.reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3).reshape(-1, 64)


def _plane(blocks: np.ndarray, h: int, w: int) -> np.ndarray:
    return blocks.reshape(h // 8, w // 8, 8, 8).transpose(0, 2, 1, 3).reshape(h, w)


def _tables(quality: int) -> list[np.ndarray]:
    return [np.array(quant_table(quality, luma=c == 0), np.float64) for c in range(3)]


_LUMA = np.array([KB, KG, KR])
#: Rows: luma and the two colour differences of a blue, green, red pixel.
_COLOUR = np.stack([_LUMA, (np.array([1, 0, 0]) - _LUMA) * (0.5 / (1 - KB)), (np.array([0, 0, 1]) - _LUMA) * (0.5 / (1 - KR))])


def _cropped(residual: np.ndarray, mask: np.ndarray | None, boxed: bool) -> tuple[bytes, np.ndarray]:
    """The box's header, and the masked residual within the box."""
    height, width = residual.shape[:2]
    part = residual.astype(np.float64)
    if mask is not None:
        part = part * mask[:, :, None]
    if not boxed:
        return b"", part
    ys, xs = (np.flatnonzero(mask.any(axis=a)) if mask is not None else np.zeros(0, int) for a in (1, 0))
    y0, y1 = (max(0, ys[0] - MARGIN), min(height, ys[-1] + MARGIN + 1)) if len(ys) else (0, height)
    x0, x1 = (max(0, xs[0] - MARGIN), min(width, xs[-1] + MARGIN + 1)) if len(xs) else (0, width)
    return struct.pack(">6H", height, width, y0, x0, y1 - y0, x1 - x0), part[y0:y1, x0:x1]


def _placed(part: np.ndarray, data: bytes, at: int | None) -> np.ndarray:
    """A decoded box in its frame, in whole levels."""
    h, w = part.shape[:2]
    height, width, y0, x0 = struct.unpack_from(">4H", data, at) if at is not None else (h, w, 0, 0)
    out = np.zeros((height, width, 3), np.int16)
    out[y0 : y0 + h, x0 : x0 + w] = np.clip(part, -32768, 32767).astype(np.int16)
    return out


def _levels(part: np.ndarray, quality: int) -> list[np.ndarray]:
    """The quantised blocks of each channel, padded with zeros."""
    part = np.pad(part, ((0, -part.shape[0] % 8), (0, -part.shape[1] % 8), (0, 0)))
    return [np.clip(np.rint(_blocks(part[:, :, c]) @ basis().T / t), -32767, 32767) for c, t in enumerate(_tables(quality))]


def _restored(levels: list[np.ndarray], quality: int, h: int, w: int) -> np.ndarray:
    planes = [_plane(x * t @ basis(), h + -h % 8, w + -w % 8) for x, t in zip(levels, _tables(quality), strict=True)]
    return np.stack(planes, axis=-1)[:h, :w]


def encode_frame(residual: np.ndarray, mask: np.ndarray | None, quality: int, boxed: bool = True, colour: bool = False) -> bytes:
    """A residual (height, width, 3) to bytes: masked, cropped to the foreground, padded to blocks, transformed."""
    head, part = _cropped(residual, mask, boxed)
    h, w = part.shape[:2]
    levels = _levels(part @ _COLOUR.T if colour else part, quality)
    flat = np.stack([_plane(x, h + -h % 8, w + -w % 8) for x in levels], axis=-1).astype(np.int16).ravel()
    return head + struct.pack(">HHB", h, w, quality) + zlib.compress(pack_levels(flat), 9)


def decode_frame(data: bytes, boxed: bool = True, colour: bool = False) -> np.ndarray:
    """The residual (height, width, 3) in whole levels, 0 outside the box."""
    at = 12 if boxed else 0
    h, w, quality = struct.unpack_from(">HHB", data, at)
    h8, w8 = h + -h % 8, w + -w % 8
    flat = unpack_levels(zlib.decompress(data[at + 5 :]), h8 * w8 * 3).reshape(h8, w8, 3)
    part = _restored([_blocks(flat[:, :, c].astype(np.float64)) for c in range(3)], quality, h, w)
    return _placed(part @ np.linalg.inv(_COLOUR).T if colour else part, data, 0 if boxed else None)


def encode_frame_vq(residual: np.ndarray, mask: np.ndarray | None, quality: int, book: np.ndarray, boxed: bool = True) -> bytes:
    """A residual as the nearest code of each block of levels; book has at most 256 rows of 64."""
    head, part = _cropped(residual, mask, boxed)
    h, w = part.shape[:2]
    levels = _levels(part, quality)
    codes = [((book**2).sum(axis=1) - 2 * x @ book.T).argmin(axis=1).astype(np.uint8).tobytes() for x in levels]
    return b"\x01" + head + struct.pack(">BHHI", quality, h, w, len(levels[0])) + zlib.compress(b"".join(codes), 9)


def decode_frame_vq(data: bytes, book: np.ndarray, boxed: bool = True) -> np.ndarray:
    at = 13 if boxed else 1
    quality, h, w, n = struct.unpack_from(">BHHI", data, at)
    codes = np.frombuffer(zlib.decompress(data[at + 9 :]), np.uint8).reshape(3, n)
    return _placed(_restored([book[c] for c in codes], quality, h, w), data, 1 if boxed else None)


def pack_codebook(book: np.ndarray) -> bytes:
    return struct.pack(">HH", *book.shape) + book.astype("<f2").tobytes()


def unpack_codebook(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f2", -1, 4).reshape(struct.unpack_from(">HH", data)).astype(np.float64)


def _pixels(raw: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(height, width, 3).astype(np.int16)


def _mask(frame: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    off = np.abs(frame - mean)
    return ((off > ABSOLUTE) | (off / std > SIGMA)).any(axis=2)


def moments(frames: DataFrame, warmup: int = WARMUP) -> DataFrame:
    """(video, height, width, plate, mean, std): the background of the first warmup frames.

    Each task adds its frames up; what is shuffled is a sum for each task and video, not cells.
    """
    kind = frames.schema["video"].dataType.simpleString()
    shape = f"video {kind}, height int, width int, n long, total binary, square binary"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for video, h, w, px in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(px, np.uint8).astype(np.float64)
                s = sums.setdefault((video, h, w), [0, np.zeros(len(x)), np.zeros(len(x))])
                s[0] += 1
                s[1] += x
                s[2] += x * x
        for (video, h, w), (n, a, b) in sums.items():
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"video": [video], "height": [h], "width": [w], "n": [n], "total": [a.tobytes()], "square": [b.tobytes()]}), schema=to_arrow, preserve_index=False)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        total, square = (np.sum([np.frombuffer(b) for b in pdf[c]], axis=0) for c in ("total", "square"))
        mean = total / n
        std = np.maximum(np.sqrt(np.maximum(0, square - n * mean**2) / max(1, n - 1)), FLOOR)
        plate = np.clip(mean, 0, 255).astype(np.uint8)
        first = pdf.iloc[0]
        return pd.DataFrame({"video": [first["video"]], "height": [first["height"]], "width": [first["width"]], "plate": [plate.tobytes()], "mean": [mean.tobytes()], "std": [std.tobytes()]})

    rows = frames.where(F.col("frame_idx") < warmup).select("video", "height", "width", "pixels")
    video = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind]
    to_arrow = pa.schema([("video", video), ("height", pa.int32()), ("width", pa.int32()), ("n", pa.int64()), ("total", pa.binary()), ("square", pa.binary())])
    return rows.mapInArrow(add, shape).groupBy("video").applyInPandas(finish, f"video {kind}, height int, width int, plate binary, mean binary, std binary")


@F.arrow_udf(T.DoubleType())
def _change(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        out.append(0.0 if x is None or y is None else float(np.abs(np.frombuffer(x, np.uint8).astype(np.int16) - np.frombuffer(y, np.uint8)).mean()))
    return pa.array(out, pa.float64())


def segment(frames: DataFrame, **limits) -> DataFrame:
    """The cycles of frames by their change energy, with representatives: see cycles.representatives()."""
    changes = with_previous(frames.select("video", "frame_idx", "pixels"), "video", "frame_idx", ["pixels"])
    signal = changes.select("video", F.col("frame_idx").cast("long").alias("t"), _change("pixels", "prev_pixels").alias("energy"))
    return seg.representatives(seg.cycles(signal, seg.boundaries(signal, **limits)))


def stabilised(frames: DataFrame, orientation: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """frames turned back to the view of their reference; those without an orientation stay as they are.

    orientation and reference are (video, frame_idx, q); see imu.relative().
    """
    size = frames.select("height", "width").first()
    if size is None:
        return frames
    # a homography depends on the frame's size, which a table of one camera shares
    of = imu.relative(frames.join(orientation.select("video", "frame_idx", "q"), ["video", "frame_idx"], "left"), reference)
    rows = of.select(*frames.columns, imu.mapping(size["width"], size["height"]))
    at = frames.columns.index("pixels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, h, w, matrix in zip(*(batch.column(c).to_pylist() for c in ("pixels", "height", "width", "_map")), strict=True):
                out.append(raw if matrix is None else np.clip(np.rint(imu.resample(np.frombuffer(raw, np.uint8).reshape(h, w, 3).astype(np.float64), matrix)), 0, 255).astype(np.uint8).tobytes())
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(out, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return rows.mapInArrow(run, frames.schema)


def _packed(orientation: DataFrame, kind: str) -> DataFrame:
    """(video, imu): the orientations of a video's frames in order, as half floats."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("frame_idx")[["x", "y", "z", "w"]].to_numpy()
        return pd.DataFrame({"video": pdf["video"].iloc[:1], "imu": [imu.pack(rows)]})

    return orientation.where("q is not null").select("video", "frame_idx", "q.*").groupBy("video").applyInPandas(pack, f"video {kind}, imu binary")


def encode(
    frames: DataFrame, quality: int = 25, fps: float = 30.0, warmup: int = WARMUP, boxed: bool = True, temporal: bool = True,
    codebook: np.ndarray | None = None, skip: float | None = None, orientation: DataFrame | None = None, **limits,
) -> DataFrame:
    """(video, content): a container file's bytes for each video. limits are those of cycles.boundaries().

    temporal: predict frames of representatives, or code each against the background. codebook: code
    representatives as its codes. skip: a cycle whose mean squared difference from its representative
    is below it only repeats it. orientation: (video, frame_idx, q), by which frames are stabilised before
    they are coded, and which is stored.

    A background model is sent once to each group of frames, and what is coded of representatives is
    written, since the other cycles are coded against it. Only payloads meet in a video's file.
    """
    book = None if codebook is None else unpack_codebook(pack_codebook(codebook))
    kind = frames.schema["video"].dataType.simpleString()
    if orientation is not None:
        frames = written(stabilised(frames, orientation), "stabilised")
    model = written(moments(frames, warmup), "model")
    cycles = written(segment(frames, **limits), "cycles")
    starts = cycles.select("video", F.col("start_frame").alias("frame_idx"), F.struct("cycle_id", "start_frame", "is_canonical", "canonical_cycle").alias("c"))
    order = W.partitionBy("video").orderBy("frame_idx").rowsBetween(W.unboundedPreceding, 0)
    tagged = frames.select("video", F.col("frame_idx").cast("long").alias("frame_idx")).join(starts, ["video", "frame_idx"], "left").withColumn("c", F.last("c", ignorenulls=True).over(order))
    places = tagged.select("video", "frame_idx", "c.cycle_id", "c.is_canonical", "c.canonical_cycle", (F.col("frame_idx") - F.col("c.start_frame")).cast("int").alias("k")).withColumn("g", F.floor(F.col("k") / (RUN + 1)))
    places = written(places, "places")
    rows = frames.withColumn("frame_idx", F.col("frame_idx").cast("long")).select("video", "frame_idx", "pixels").join(places, ["video", "frame_idx"])
    group = ["video", "cycle_id", "g"]
    of = [f"of_{c}" for c in group]
    models = places.select(*(F.col(c).alias(n) for c, n in zip(group, of, strict=True)), F.col("is_canonical").alias("canonical")).distinct().join(model, F.col("of_video") == model["video"]).drop("video")

    def parts(of: pd.DataFrame) -> tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray]:
        r = of.iloc[0]
        size = (int(r["height"]), int(r["width"]))
        mean, std = (np.frombuffer(r[c]).reshape(*size, 3) for c in ("mean", "std"))
        return size, mean, std, _pixels(r["plate"], *size)

    def representative(pdf: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        size, mean, std, plate = parts(of)
        prev, before, payloads, decoded = None, None, [], []
        for px in pdf["pixels"]:
            frame = _pixels(px, *size)
            mask = _mask(frame, mean, std)
            ref = plate if prev is None or not temporal else prev
            if not temporal:
                payloads.append(encode_frame(frame - ref, mask, quality, boxed=False, colour=True))
                residual = decode_frame(payloads[-1], boxed=False, colour=True)
            else:
                # a cell that was foreground a frame ago is coded too: it has just been uncovered
                shown = mask if before is None else mask | before
                payloads.append(encode_frame(frame - ref, shown, quality, boxed) if book is None else encode_frame_vq(frame - ref, shown, quality, book, boxed))
                residual = decode_frame(payloads[-1], boxed) if book is None else decode_frame_vq(payloads[-1], book, boxed)
            prev, before = np.clip(ref + residual, 0, 255), mask
            decoded.append(prev.astype(np.uint8).tobytes())
        return pd.DataFrame({"video": pdf["video"], "cycle_id": pdf["cycle_id"], "k": pdf["k"], "type": (pdf["k"] % (RUN + 1) != 0).astype("int32"), "payload": payloads, "decoded": decoded})

    def other(pdf: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        size, mean, std, plate = parts(of)
        payloads, errors = [], []
        for px, decoded in zip(pdf["pixels"], pdf["decoded"], strict=True):
            frame = _pixels(px, *size)
            ref = plate if decoded is None else _pixels(decoded, *size)
            errors.append(float(((frame - ref).astype(np.float64) ** 2).mean()))
            # where the reference shows foreground that the frame lacks is coded too
            payloads.append(encode_frame(frame - ref, _mask(frame, mean, std) | _mask(ref, mean, std), quality, boxed))
        return pd.DataFrame({"video": pdf["video"], "cycle_id": pdf["cycle_id"], "k": pdf["k"], "type": np.int32(1), "payload": payloads, "error": errors})

    shape = f"video {kind}, cycle_id int, k int, type int, payload binary"
    runs = rows.where("is_canonical").select(*group, "k", "pixels").groupBy(*group)
    coded = written(runs.cogroup(models.where("canonical").groupBy(*of)).applyInPandas(representative, f"{shape}, decoded binary"), "coded")
    refs = coded.select("video", F.col("cycle_id").alias("canonical_cycle"), "k", "decoded")
    rest = rows.where("not is_canonical").join(refs, ["video", "canonical_cycle", "k"], "left").select(*group, "k", "pixels", "decoded")
    deltas = rest.groupBy(*group).cogroup(models.where("not canonical").groupBy(*of)).applyInPandas(other, f"{shape}, error double")
    every = coded.drop("decoded").withColumn("error", F.lit(0.0)).unionByName(deltas).join(cycles.select("video", "cycle_id", "is_canonical", "canonical_cycle"), ["video", "cycle_id"])
    head = model.select("video", "height", "width", "plate")
    head = head.withColumn("imu", F.lit(None).cast("binary")) if orientation is None else head.join(_packed(orientation, kind), "video", "left")

    def file(pdf: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        of = of.iloc[0]
        held = [c for _, c in pdf.sort_values(["cycle_id", "k"]).groupby("cycle_id")]
        first = [c.iloc[0] for c in held]
        canon = {c["cycle_id"]: i for i, c in enumerate(c for c in first if c["is_canonical"])}
        chunks, others, order, n = [container.pack_chunk(1, of["plate"])], [], [], len(pdf)
        flags = (container.TEMPORAL | (container.BBOX if boxed else 0) | (0 if book is None else container.VQ)) if temporal else 0
        if of["imu"] is not None:
            chunks.append(container.pack_chunk(container.IMU, of["imu"]))
        if book is not None:
            chunks.append(container.pack_chunk(7, pack_codebook(book), compress=False))
        for c, f in zip(first, held, strict=True):
            if c["is_canonical"]:
                heads = [struct.pack(">BI", t, len(p)) if temporal else struct.pack(">I", len(p)) for t, p in zip(f["type"], f["payload"], strict=True)]
                body = struct.pack(">IB", len(f), flags) + b"".join(h + p for h, p in zip(heads, f["payload"], strict=True))
                chunks.append(container.pack_chunk(2, body))
                order.append([0, canon[c["cycle_id"]]])
            elif skip is not None and f["error"].mean() < skip:
                order.append([1, len(others)])
                others.append(container.pack_chunk(5, struct.pack(">HH", canon[c["canonical_cycle"]], len(f))))
            else:
                body = struct.pack(">HI", canon[c["canonical_cycle"]], len(f)) + b"".join(struct.pack(">I", len(p)) + p for p in f["payload"])
                order.append([1, len(others)])
                others.append(container.pack_chunk(3, body))
        meta = {"total_frames": n, "fps": fps, "n_cycles": len(held), "n_canonicals": len(canon), "quality": quality, "use_temporal": temporal, "use_bbox": boxed, "cycle_map": order}
        tail = container.pack_chunk(container.METADATA, json.dumps(meta).encode() + b"\n", compress=False)
        content = b"".join([container.pack_header(n, fps, int(of["width"]), int(of["height"])), *chunks, *others, tail])
        return pd.DataFrame({"video": pdf["video"].iloc[:1], "content": [content]})

    return every.groupBy("video").cogroup(head.groupBy("video")).applyInPandas(file, f"video {kind}, content binary")


def orientations(content: bytes, lenient: bool = False) -> np.ndarray | None:
    """The stored orientations, rows x, y, z, w, or None."""
    return next((imu.unpack(c[4]) for c in container.parse_chunks(content, lenient) if c[1] == container.IMU), None)


def decode_content(content: bytes, lenient: bool = False) -> Iterator[np.ndarray]:
    """The frames of a container in playback order, one at a time."""
    for cycle in decode_cycles(content, lenient):
        yield from cycle


def decode_cycles(content: bytes, lenient: bool = False) -> Iterator[Iterator[np.ndarray]]:
    """The cycles of a container in playback order, each an iterator of frames; without a cycle map representatives come first."""
    _, _, width, height, _ = container.parse_header(content)
    chunks = list(container.parse_chunks(content, lenient))
    meta = next((json.loads(c[4]) for c in chunks if c[1] == container.METADATA), {})
    plate = next((_pixels(c[4], height, width) for c in chunks if c[1] == 1), np.zeros((height, width, 3), np.int16))
    boxed = bool(meta.get("use_bbox", True))
    book = next((unpack_codebook(c[4]) for c in chunks if c[1] == 7), None)
    canon: list[list[np.ndarray]] = []
    for c in chunks:
        if c[1] == 2:
            n, flags = struct.unpack_from(">IB", c[4])
            at, prev, frames = 5, plate, []
            for _ in range(n):
                kind, size = struct.unpack_from(">BI", c[4], at) if flags & container.TEMPORAL else (0, *struct.unpack_from(">I", c[4], at))
                at += 5 if flags & container.TEMPORAL else 4
                data = c[4][at : at + size]
                at += size
                if not flags & container.TEMPORAL:
                    residual = decode_frame(data, boxed=False, colour=True)
                elif flags & container.VQ:
                    residual = decode_frame_vq(data, book, bool(flags & container.BBOX))
                else:
                    residual = decode_frame(data, bool(flags & container.BBOX))
                prev = np.clip((plate if kind == 0 else prev) + residual, 0, 255)
                frames.append(prev)
            canon.append(frames)

    def other(kind: int, body: bytes) -> Iterator[np.ndarray]:
        if kind == 5:  # a cycle that repeats its representative
            index, n = struct.unpack_from(">HH", body)
            yield from canon[index][:n] if index < len(canon) else [plate] * n
            return
        index, n = struct.unpack_from(">HI", body)
        at = 6
        for i in range(n):
            (size,) = struct.unpack_from(">I", body, at)
            ref = canon[index][i] if index < len(canon) and i < len(canon[index]) else plate
            yield np.clip(ref + decode_frame(body[at + 4 : at + 4 + size], boxed), 0, 255)
            at += 4 + size

    others = [(c[1], c[4]) for c in chunks if c[1] in (3, 5)]
    order = meta.get("cycle_map") or [[0, i] for i in range(len(canon))] + [[1, i] for i in range(len(others))]
    for kind, index in order:
        if kind == 0 and index < len(canon):
            yield iter(canon[index])
        elif kind == 1 and index < len(others):
            yield other(*others[index])


def decode(containers: DataFrame, key: str = "video", lenient: bool = False) -> DataFrame:
    """(key, frame_idx, cycle, height, width, pixels) of containers (key, content): cycle counts in playback order."""
    kind = containers.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf[key], pdf["content"], strict=True):
                frames = ((c, f) for c, cycle in enumerate(decode_cycles(bytes(content), lenient)) for f in cycle)
                for k, (c, frame) in enumerate(frames):
                    yield pd.DataFrame({key: [name], "frame_idx": [k], "cycle": [c], "height": [frame.shape[0]], "width": [frame.shape[1]], "pixels": [frame.astype(np.uint8).tobytes()]})

    return containers.select(key, "content").mapInPandas(run, f"{key} {kind}, frame_idx long, cycle int, height int, width int, pixels binary")
