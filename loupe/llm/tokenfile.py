"""Token files: concatenated token ids with Elias-Fano encoded document boundaries.

Documents are range-partitioned by id and each partition writes one file of segments in id order, so
the files in the order of their names hold the corpus in ascending id order.  They are written by
Spark's own committed writer (a lost task leaves nothing behind) and read by its binary file reader,
so any file system that Spark reaches will do.

A segment, all numbers little-endian:

    8 bytes  b"LOUPETK1"
    u32      n documents          u64  n ids           u8 bytes an id (2 or 4)
    u8       low bits l           u32  words of the upper bits
    i64[n]   document ids         u8[ceil(n/8)] bits that mark null document ids
    l bits each, packed: the low parts of the n boundaries (ends of the documents, in ids)
    u64[...] upper bits: bit (end >> l) + i is set for document i
    u32[ceil(n/64)] select samples: place of every 64th set bit
    ids      n ids of 2 or 4 bytes
    b"\\n"   (the writer's line end)

A boundary takes l + 2 bits and a select sample half a bit, instead of 64 bits in a table of offsets.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loupe.llm.common import shared_path, small_batches, staged, worker_store

MAGIC = b"LOUPETK1"
HEAD = "<8sIQBBI"
SAMPLE = 64
END_ID = 1
#: A segment is closed once it holds so many ids (2 MB of 2-byte ids), a file after so many segments.
SEGMENT_IDS = 1 << 20
FILE_SEGMENTS = 32
#: Entries of a worker's memos of encoded chunks and pieces, in each of two generations.
CHUNKS_MOST, PIECES_MOST = 1 << 16, 1 << 18
#: Characters of a text that are cut into pieces at once.
STRETCH = 1 << 20


# ---------------------------------------------------------------- Elias-Fano

class EliasFano:
    """A non-decreasing sequence in l + 2 bits an entry; ``select(i)`` returns entry i."""

    def __init__(self, low_bits: int, lows: np.ndarray, upper: np.ndarray, samples: np.ndarray, n: int):
        self.low_bits, self.lows, self.upper, self.samples, self.n = low_bits, lows, upper, samples, n

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        l = max(0, int(int(values[-1]) // n).bit_length() - 1) if n else 0  # noqa: E741
        places = (values >> l) + np.arange(n)
        bits = np.zeros((int(places[-1]) // 64 + 1) * 64 if n else 0, np.uint8)
        bits[places] = 1
        upper = np.packbits(bits, bitorder="little").view("<u8")
        rows = (values[:, None] >> np.arange(l) & 1).astype(np.uint8)
        return cls(l, np.packbits(rows.reshape(-1), bitorder="little"), upper, places[::SAMPLE].astype("<u4"), n)

    def _low(self, i: np.ndarray) -> np.ndarray:
        """The low parts of entries i."""
        out = np.zeros(len(i), np.int64)
        for k in range(self.low_bits):
            at = i * self.low_bits + k
            out |= (self.lows[at >> 3].astype(np.int64) >> (at & 7) & 1) << k
        return out

    def select(self, i: int) -> int:
        """Entry i: from the sample before it, set bits are counted by word."""
        rank, place = i % SAMPLE, int(self.samples[i // SAMPLE])
        word = place >> 6
        bits = int(self.upper[word]) >> (place & 63) << (place & 63)
        while (held := bits.bit_count()) <= rank:
            rank, word = rank - held, word + 1
            bits = int(self.upper[word])
        for _ in range(rank):
            bits &= bits - 1
        place = (word << 6) + (bits & -bits).bit_length() - 1
        return (place - i) << self.low_bits | int(self._low(np.array([i]))[0])

    def all(self) -> np.ndarray:
        """All entries, in one pass."""
        places = np.flatnonzero(np.unpackbits(self.upper.view(np.uint8), bitorder="little"))
        i = np.arange(self.n)
        return (places - i) << self.low_bits | self._low(i)


def pack_segment(doc_ids: list[int | None], ends: np.ndarray, ids: bytes, width: int) -> bytes:
    """A segment; ``ends`` are the documents' ends in ids, ``ids`` the bytes of all ids."""
    n = len(doc_ids)
    ef = EliasFano.encode(ends)
    nulls = np.packbits(np.array([d is None for d in doc_ids], np.uint8), bitorder="little").tobytes()
    names = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    head = struct.pack(HEAD, MAGIC, n, len(ids) // width, width, ef.low_bits, len(ef.upper))
    return b"".join([head, names, nulls, ef.lows.tobytes(), ef.upper.tobytes(), ef.samples.tobytes(), ids])


def unpack_segments(data: bytes) -> Iterator[tuple[list[int | None], EliasFano, np.ndarray]]:
    """(document ids, boundaries, token ids) of each segment of a file."""
    at = 0
    while at < len(data):
        magic, n, n_ids, width, low_bits, words = struct.unpack_from(HEAD, data, at)
        if magic != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        at += struct.calcsize(HEAD)

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype, count, at)
            at += out.nbytes
            return out

        names, nulls = take("<i8", n), take("u1", -(-n // 8))
        ef = EliasFano(low_bits, take("u1", -(-n * low_bits // 8)), take("<u8", words), take("<u4", -(-n // SAMPLE)), n)
        ids = take(f"<u{width}", n_ids)
        missing = np.unpackbits(nulls, bitorder="little")[:n]
        at += 1  # the line end
        yield [None if m else int(d) for d, m in zip(names, missing)], ef, ids


# ---------------------------------------------------------------- encoding

#: A chunk that the library's normaliser only lower-cases: printable ASCII and precomposed Latin
#: letters, no special token.  Its pieces follow the tokenizer's split pattern.
SIMPLE = re.compile(r"(?!.*<\|)[!-~À-ÖØ-öø-į]+", re.S)
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-į]+|[0-9]|[^a-z0-9ß-öø-į\x20\x09-\x0D]+")
#: A text of such chunks and ASCII white space is cut into pieces as a whole.
SIMPLE_TEXT = re.compile(r"[!-~À-ÖØ-öø-į\x20\x09-\x0D]*")
SPACE_AT = re.compile(r"[\x20\x09-\x0D]")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes bytes as: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Memo:
    """A bounded dict: when the young generation is full it becomes the old one, and what is found in
    the old one moves to the young, so what is used often stays."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def older(self, key):
        found = self.old.get(key)
        if found is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Encoder:
    """Encodes texts of simple chunks piece by piece, others chunk by chunk (chunks stand between ASCII
    white space, which the tokenizer drops), and remembers pieces and chunks; the result equals encoding
    the whole text."""

    def __init__(self, path: str, width: int, memos: tuple[Memo, Memo] | None = None):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.type = self.tokenizer.model, _byte_letters(), f"<u{width}"
        self.chunks, self.pieces = memos or (Memo(CHUNKS_MOST), Memo(PIECES_MOST))

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.young.get(piece) or self.pieces.older(piece)
        if found is None:
            name = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            found = np.array([t.id for t in self.model.tokenize(name)], self.type).tobytes()
            if len(piece) <= 64:
                self.pieces.put(piece, found)
        return found

    def _chunk(self, chunk: bytes) -> bytes:
        found = self.chunks.older(chunk)
        if found is not None:
            return found
        text = chunk.decode()
        if SIMPLE.fullmatch(text):
            found = b"".join(map(self._piece, PIECE.findall(text.lower())))
        else:
            found = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()
        if len(chunk) <= 64:
            self.chunks.put(chunk, found)
        return found

    @staticmethod
    def _stretches(text: str) -> Iterator[str]:
        """The text, cut at white space where it is long."""
        at = 0
        while len(text) - at > STRETCH and (cut := SPACE_AT.search(text, at + STRETCH)):
            yield text[at:cut.start()]
            at = cut.start()
        yield text[at:]

    def _simple(self, text: str) -> bytes:
        pieces = PIECE.findall(text.lower())
        found = list(map(self.pieces.young.get, pieces))
        if None in found:
            found = [self._piece(p) if f is None else f for p, f in zip(pieces, found)]
        return b"".join(found)

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as bytes."""
        text = text or ""
        if "<|" not in text and SIMPLE_TEXT.fullmatch(text):
            return b"".join(map(self._simple, self._stretches(text)))
        get, chunk, words = self.chunks.young.get, self._chunk, text.encode().split()
        found = [get(w) for w in words]
        if None in found:
            found = [chunk(w) if f is None else f for w, f in zip(words, found)]
        return b"".join(found)


def whole_encoder(path: str, width: int):
    """A plain encoder for any tokenizer file: each whole text through the library."""
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, f"<u{width}").tobytes()


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = END_ID, width: int = 2, by_chunks: bool = True) -> None:
    """Encode every whole text (null counts as empty), append ``end_id``, and write the files in
    ascending id order (null ids first; rows of equal ids in the order of their texts' hashes).  ``by_chunks``: for the
    lower-casing word BPE tokenizer; other tokenizers encode whole texts.  ``tokenizer_path`` is read
    on the executors, which have the tokenizer's package.  An empty table writes no segment."""
    small_batches(docs.sparkSession)
    tail = np.array([end_id], f"<u{width}").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if by_chunks:
            key = ("tokens", tokenizer_path, width)  # a worker's tasks share the memos
            memos = worker_store().setdefault(key, (Memo(CHUNKS_MOST), Memo(PIECES_MOST)))
            one = Encoder(tokenizer_path, width, memos).encode
        else:
            one = whole_encoder(tokenizer_path, width)
        names, sizes, parts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            data = pack_segment(names, np.cumsum(sizes), b"".join(parts), width)
            return pa.RecordBatch.from_pydict({"value": pa.array([data], pa.binary())})

        for batch in batches:
            for name, null, text in zip(*(batch.column(c).to_pylist() for c in ("id", "no_id", "text"))):
                ids = one(text) + tail
                names.append(None if null else name)
                sizes.append(len(ids) // width)
                parts.append(ids)
                held += sizes[-1]
                if held >= SEGMENT_IDS:
                    yield close()
                    names, sizes, parts, held = [], [], [], 0
        if names:
            yield close()

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-2**63)).alias("id"), F.col(id_col).isNull().alias("no_id"), F.col(text_col).alias("text"))
    order = [F.col("id"), F.desc("no_id"), F.xxhash64("text")]  # the hash parts rows that share an id, or have none
    (rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(encode, "value binary")
     .select(F.col("value").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", FILE_SEGMENTS).option("lineSep", "\n").text(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files under ``path``; start counts
    the ids of all documents before it.  A file is one task's work; per document only its numbers leave it."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("file").to_pylist(), batch.column("content")):
                before = 0
                for names, ef, ids in unpack_segments(content.as_buffer()):
                    ends = ef.all()
                    starts = np.concatenate([[0], ends[:-1]])
                    wide = ids.astype("<u4")
                    checks = [zlib.crc32(wide[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_pydict({
                        "file": pa.array([name] * len(names), pa.string()), "doc_id": pa.array(names, pa.int64()), "local": pa.array(starts + before),
                        "n_tokens": pa.array(ends - starts), "ids_crc32": pa.array(checks, pa.int64())})
                    before += len(ids)

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
             .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"))
    found = staged(files.mapInArrow(decode, "file string, doc_id long, local long, n_tokens long, ids_crc32 long"), "token-starts")
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    piece = F.regexp_extract("file", r"-c(\d+)", 1).cast("long")
    totals = found.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
    w = Window.orderBy(number, piece).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = totals.select("file", (F.sum("ids").over(w) - F.col("ids")).alias("before"))  # a row a file
    return found.join(F.broadcast(before), "file").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write the token files (under a new shared folder unless ``path`` is given) and read them back."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    write_token_files(docs, tokenizer_path, path, **options)
    return read_token_files(spark, path)


def default_tokenizer() -> str:
    import public_tokenizers
    return os.fspath(public_tokenizers.path("word_bpe_49k.json"))
