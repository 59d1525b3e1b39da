"""Token ids of documents in binary files that can be read a document at a time.

A file is a run of independent zstandard frames, each with its content checksum, and a trailing
seek table in a skippable frame, so plain zstandard tools read the file too:

    frame    u32 n_docs | n_docs x i64 doc_id | n_docs x u32 n_ids | all ids as u32
    table    u32 0x184D2A5E | u32 length | entries | u32 n_frames | magic "CZSEEK1\\n"
    entry    u32 compressed | u32 decompressed | u32 checksum | i64 first doc_id | i64 last doc_id | u32 n_docs | u64 n_ids

All numbers are little-endian; checksum is the low half of XXH64 of the decompressed frame.
A reader takes the end of the file, finds the frames whose range of doc_id holds a requested one,
and decompresses only those. Frames hold whole documents in ascending doc_id.

The files are written by Spark's own text writer, one row a file, whose line end is the last byte
of the magic: any Hadoop file system serves, and the commit protocol survives lost executors.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.llm.common import for_worker, partitions, written

SKIPPABLE, MAGIC = 0x184D2A5E, b"CZSEEK1\n"
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4"), ("first", "<i8"), ("last", "<i8"), ("docs", "<u4"), ("ids", "<u8")])
#: Ids after which a frame, and a file, is closed.
FRAME_IDS, FILE_IDS = 1 << 16, 1 << 23
#: Words that a task remembers of late; as many again are those before, and no word of more bytes is remembered.
WORDS, LONGEST = 150_000, 64
#: Bytes of texts that are encoded at once, about, or one text.
GROUP = 2 << 20
#: Closing punctuation, which never begins a contraction.
_CLOSING = b".,;:!?)*#$%&|"
_CLOSED = r"([a-z0-9])([.,;:!?])(\s)"
#: The normaliser's and splitter's parts in vocabularies that are encoded by words.
PARTS = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
)
#: A null doc_id in a file.
NULL_ID = -(1 << 63)


def _lower(word: bytes) -> bytes:
    """Letters of Latin-1 in lower case, as every normaliser has them; other words as they are."""
    if word.isalpha():
        return word.lower()
    s = word.decode()
    return s.lower().encode() if s.isalpha() and max(s) <= "\xff" else word


class Encoder:
    """Ids of whole texts by the tokenizers library, for word vocabularies a word at a time.

    A vocabulary that drops white space, with words that end in a mark of their own, never joins
    characters across ASCII white space, and its special tokens hold none, so the ids of a text are
    those of its words in order. Closing punctuation after a letter or digit is a piece of its own in
    such a vocabulary, and letters are lower-cased, so A-Z are lower-cased and the commonest closing
    punctuation is set apart in the whole text first, which leaves fewer different words. Words repeat:
    the library sees what is new, and a task remembers the words it met of late, in two generations of
    WORDS words of at most LONGEST bytes. This holds for vocabularies with the very normaliser and
    splitter of PARTS; others get whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        parts = ((made.get("normalizer") or {}).get("normalizers"), (made.get("pre_tokenizer") or {}).get("pretokenizers"))
        self.by_words = made["model"].get("end_of_word_suffix") == "</w>" and parts == PARTS and not any(
            t["lstrip"] or t["rstrip"] or t["content"].encode().split() != [t["content"].encode()] for t in made["added_tokens"]
        )
        self.added = [t["content"].lower().encode() for t in made["added_tokens"]]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.stand_in = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x100)}
        self.merge = self.tokenizer.model.tokenize
        self.packed = [struct.pack("<I", k) for k in range(max(self.tokenizer.get_vocab().values()) + 1)]
        self.forget()

    def forget(self) -> None:
        self.known = Known(self, {})

    def whole(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: bytes) -> bytes:
        """The ids of a new word: of what it is without closing punctuation and in lower case, and of the rest."""
        core = word.rstrip(_CLOSING)
        if len(core) < len(word) and (core[-1:].isalnum() or (core and core[-1] >= 0x80 and unicodedata.normalize("NFC", core.decode()).lower().isalpha())):
            return self.known[core] + self.known[word[len(core) :]]
        lower = _lower(word)
        if lower != word:
            return self.known[lower]
        return self.whole(word)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """For each text its ids as little-endian u32."""
        if not self.by_words:
            yield from map(self.whole, texts)
            return
        array = pa.array(texts, pa.binary()).cast(pa.string())
        lower = pc.ascii_lower(array)
        rows = pc.replace_substring_regex(lower, _CLOSED, r"\1 \2\3")
        for t in self.added:  # lower case must not make a special token
            if pc.any(found := pc.match_substring(lower, t.decode())).as_py():
                rows = pc.if_else(found, array, rows)
        words = pc.ascii_split_whitespace(rows)
        coded = words.flatten().dictionary_encode()
        at = coded.indices.to_numpy()
        # a word that comes again is looked up once
        ids = [self.known[w] for w in coded.dictionary.cast(pa.binary()).to_pylist()]
        if len(self.known) > WORDS:
            self.known.old = {}  # the generation before the last
            self.known = Known(self, self.known)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        n = size[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = pool[np.arange(ends[-1]) + np.repeat(first[at] - ends[:-1], n)]
        cuts = ends[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            yield out[a:z].tobytes()


class Known(dict):
    """The ids of words; a word that isn't there comes from the generation before, or else from the library."""

    def __init__(self, encoder: Encoder, old: dict[bytes, bytes]):
        super().__init__()
        self.encoder, self.old = encoder, old
        self.merge, self.packed, self.stand_in = encoder.merge, encoder.packed, encoder.stand_in

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if not word:  # before leading white space
                return word
            packed = self.packed
            if word.isalpha() and word.islower():  # as the normaliser and splitter have it: merges are left
                ids = b"".join([packed[t.id] for t in self.merge(word.decode())])
            elif (text := word.decode()).isalpha() and text.islower() and max(text) <= "\xff":  # bytes' stand-ins and merges
                ids = b"".join([packed[t.id] for t in self.merge(text.translate(self.stand_in))])
            else:
                ids = self.encoder.word(word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids


def encoder(path: str) -> Encoder:
    """The vocabulary, held by a worker while it writes tokens; tasks make it forget their words."""
    return for_worker(("tokens", path), lambda: Encoder(path))


class Writer:
    """Collects documents in order and gives whole files."""

    def __init__(self):
        self.pack = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frames, self.table, self.file_ids = [], [], 0
        self._open()

    def _open(self):
        self.docs, self.ids, self.frame_ids = [], [], 0

    def add(self, doc_id: int, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.ids.append(ids)
        self.frame_ids += len(ids) // 4
        if self.frame_ids >= FRAME_IDS:
            self._close_frame()

    def _close_frame(self):
        if not self.docs:
            return
        doc_id, n = (np.array(x, t) for x, t in zip(zip(*self.docs, strict=True), ("<i8", "<u4"), strict=True))
        raw = b"".join([struct.pack("<I", len(n)), doc_id.tobytes(), n.tobytes(), *self.ids])
        packed = self.pack.compress(raw)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF, doc_id[0], doc_id[-1], len(n), self.frame_ids))
        self.frames.append(packed)
        self.file_ids += self.frame_ids
        self._open()

    def full(self) -> bool:
        return self.file_ids >= FILE_IDS

    def take(self) -> bytes | None:
        """The file, if any document came."""
        self._close_frame()
        if not self.frames:
            return None
        entries = np.array(self.table, ENTRY).tobytes()
        tail = entries + struct.pack("<I", len(self.table)) + MAGIC
        out = b"".join([*self.frames, struct.pack("<II", SKIPPABLE, len(tail)), tail])
        self.frames, self.table, self.file_ids = [], [], 0
        return out


class Reader:
    """Reads a file's bytes; decompresses only the frames that are asked for, and checks each."""

    def __init__(self, content: bytes | memoryview):
        self.content = memoryview(content)
        if bytes(self.content[-8:]) != MAGIC:
            raise ValueError("no seek table at the end of the file")
        (n,) = struct.unpack("<I", self.content[-12:-8])
        self.table = np.frombuffer(self.content[len(self.content) - 12 - n * ENTRY.itemsize : len(self.content) - 12], ENTRY)
        self.at = np.concatenate([[0], np.cumsum(self.table["packed"].astype(np.int64))])
        self.unpack = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc_ids, counts and all ids of frame k."""
        raw = self.unpack.decompress(self.content[self.at[k] : self.at[k + 1]], max_output_size=int(self.table["size"][k]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table["check"][k]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        n = struct.unpack_from("<I", raw)[0]
        return np.frombuffer(raw, "<i8", n, 4), np.frombuffer(raw, "<u4", n, 4 + 8 * n), np.frombuffer(raw, "<u4", -1, 4 + 12 * n)

    def documents(self, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, ids of all documents before it in the file, ids) of all documents, or of the wanted (sorted)."""
        before = np.concatenate([[0], np.cumsum(self.table["ids"].astype(np.int64))])
        for k, e in enumerate(self.table):
            if wanted is not None and np.searchsorted(wanted, e["first"]) == np.searchsorted(wanted, e["last"], "right"):
                continue
            doc_id, n, ids = self.frame(k)
            ends = np.cumsum(n.astype(np.int64))
            for j in range(len(n)) if wanted is None else np.nonzero(np.isin(doc_id, wanted))[0]:
                yield int(doc_id[j]), int(before[k] + ends[j] - n[j]), ids[ends[j] - n[j] : ends[j]]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Write the ids of every row of docs (doc_id, text, ...) to files under path, in ascending doc_id.

    A null or empty text has only the end id; texts of any length are encoded whole, a document in one
    frame. Rows that repeat a doc_id are all written, ordered by text; a null doc_id comes first. An
    empty table writes no file with documents. Other columns are not read. tokenizer is the vocabulary file's place, the same on all machines.
    """

    def grouped(batch: pa.RecordBatch) -> Iterator[tuple[list[int | None], list[bytes]]]:
        start, size, texts = 0, 0, []
        for k, t in enumerate(batch.column(1).cast(pa.binary())):
            texts.append(t.as_py() or b"")
            size += len(texts[-1])
            if size >= GROUP or k + 1 == batch.num_rows:
                yield batch.column(0)[start : k + 1].to_pylist(), texts
                start, size, texts = k + 1, 0, []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, end, to_ids = Writer(), np.array([end_id], "<u4").tobytes(), encoder(tokenizer)
        for batch in batches:
            for ids_of, texts in grouped(batch):
                for doc_id, ids in zip(ids_of, to_ids.encode(texts), strict=True):
                    out.add(NULL_ID if doc_id is None else doc_id, ids + end)
                    if out.full():
                        yield pa.RecordBatch.from_pydict({"content": [out.take()[:-1]]})
        to_ids.forget()
        if (last := out.take()) is not None:
            yield pa.RecordBatch.from_pydict({"content": [last[:-1]]})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    files = ordered.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(d, at, len(ids), zlib.crc32(ids)) for d, at, ids in Reader(content.as_buffer()).documents()]
                doc_id, at, n, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(rows)), *(pa.array(x, pa.int64()) for x in (doc_id, at, n, crc))], ["path", "doc_id", "at", "n_tokens", "ids_crc32"]
                )

    rows = written(_files(spark, path).mapInArrow(run, "path string, doc_id long, at long, n_tokens long, ids_crc32 long"), "tokens")
    # one row for each file: files hold millions of ids, so they are few
    files = rows.groupBy("path").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    before = F.sum("n").over(W.orderBy("first", "last", "path").rowsBetween(W.unboundedPreceding, -1))
    files = files.select("path", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(files, "path").select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_ids(spark: SparkSession, path: str, doc_ids: Iterable[int]) -> DataFrame:
    """(doc_id, ids) of the requested documents; only the frames that hold them are decompressed."""
    wanted = np.unique(np.array(list(doc_ids), np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                for doc_id, _, ids in Reader(content.as_buffer()).documents(wanted):
                    yield pa.RecordBatch.from_pydict({"doc_id": [doc_id], "ids": pa.array([ids.tolist()], pa.list_(pa.int64()))})

    return _files(spark, path).mapInArrow(run, "doc_id long, ids array<long>")
