"""Token-ID shards as wavelet matrices: bit-planes with rank and select in one compressed file."""

from __future__ import annotations

import codecs
import json
import os
import re
import string
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import giving_back, materialize, scratch_path

MAGIC = b"WVMX0001"
CHUNK = 1 << 15  # bytes of a plane that are compressed together
SHARD_TOKENS = 1 << 21
END_ID = 0
#: Where texts are cut: before a space that a non-space follows. The pre-tokenizer always ends a piece there.
CUT = re.compile(r" (?=\S)")
#: Letters below this one, and then maybe punctuation: one or two pre-tokens, whatever stands around them.
LATIN_END, PUNCTUATION = "\u0250", string.punctuation
#: Pieces of up to so many characters are kept, so many of them at most (and those of one text more), and as many that came before: some 0.2 KB each.
LONGEST_CACHED, CACHED = 32, 300_000
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in shown)}


class Pieces(dict):
    """What `encode` makes of pieces of text, filled as they're met; long pieces aren't kept.

    `younger` bounds how many are: what is met again stays, and a piece that occurs once goes after a while.
    """

    def __init__(self, encode: Callable[[str], bytes | None], older: dict | None = None):
        super().__init__()
        self.encode, self.older = encode, older or {}

    def __missing__(self, piece: str) -> bytes | None:
        out = self.older.get(piece)
        if out is None:
            out = self.encode(piece)
        if len(piece) <= LONGEST_CACHED:
            self[piece] = out
        return out

    def younger(self) -> Pieces:
        """This, or an empty one that looks here for what it lacks if this is full."""
        if len(self) < CACHED:
            return self
        self.older = {}
        return Pieces(self.encode, self)


class Words:
    """Encodes what stands between single spaces, with the space before it.

    A piece that starts with a line end is that and what follows it, without a space. None where
    white space adjoins white space, so that no cut may be made there.
    """

    def __init__(self, encoder: Encoder):
        self.encoder, self.tokenize, self.kind = encoder, encoder.model.tokenize, encoder.kind
        self.space, self.tails = encoder.spelled(" "), Pieces(encoder.encoded)

    def __call__(self, piece: str) -> bytes | None:
        if piece.isalpha():
            if piece.isascii():  # most pieces, without another call
                return array(self.kind, [t.id for t in self.tokenize(self.space + piece)]).tobytes()
            return self.letters(piece, self.space)
        line = piece[:1] == "\n"
        body = piece[1:] if line else piece
        stem = body.rstrip(PUNCTUATION)
        if stem.isalpha():  # the punctuation after letters is a pre-token of its own
            # A word after a space is kept as a piece, whatever punctuation it is met with.
            out = self.letters(stem, "") if line else self.encoder.words[stem]
            if len(stem) < len(body):
                out += self.tails[body[len(stem) :]]
            return self.encoder.newline + out if line else out
        if body.split() != [body]:
            return None
        return self.encoder.newline + self.encoder.encoded(body) if line else self.encoder.encoded(" " + body)

    def letters(self, stem: str, before: str) -> bytes:
        """Letters are one pre-token, with a space before them or not."""
        if stem.isascii():
            return array(self.kind, [t.id for t in self.tokenize(before + stem)]).tobytes()
        if max(stem) < LATIN_END:
            return array(self.kind, [t.id for t in self.tokenize(before + self.encoder.spelled(stem))]).tobytes()
        return self.encoder.encoded((" " if before else "") + stem)


class Encoder:
    """A byte-level BPE tokenizer over whole texts, each distinct short piece encoded once while it stays in a bounded cache."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.kind = "H" if self.width is np.uint16 else "I"
        self.table = "".join(shown for _, shown in sorted(byte_alphabet().items()))
        self.newline = self.encoded("\n")
        self.words, self.first = Pieces(Words(self)), Pieces(self.encoded)
        self.loose = Pieces(lambda piece: self.encoded(" " + piece))

    def spelled(self, text: str) -> str:
        """Text in the vocabulary's letters for bytes."""
        return codecs.charmap_decode(text.encode(), "strict", self.table)[0]

    def encoded(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The tokenizer's ids of a text.

        The pre-tokenizer ends a piece before a space that a non-space follows, and a line end between
        non-spaces is a piece of its own; texts with other white space are cut at such spaces only.
        """
        self.words, self.first, self.loose = self.words.younger(), self.first.younger(), self.loose.younger()
        head, *rest = text.replace("\n", " \n").split(" ")
        try:
            data = b"".join([self.first[head], *map(self.words.__getitem__, rest)])
        except TypeError:
            head, *rest = CUT.split(text)
            data = b"".join([self.first[head], *map(self.loose.__getitem__, rest)])
        return np.frombuffer(data, self.width)


#: One encoder per file and Python worker; workers are reused by later tasks.
_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class WaveletMatrix:
    """A sequence of non-negative integers as `levels` bit-planes, each the stable partition of the one before by its bit.

    Planes live in compressed chunks with the count of ones before each; access, rank, count and
    select touch one chunk a level, decode() rebuilds everything.
    """

    def __init__(self, n: int, levels: int, zeros: list[int], chunks: list[list[bytes]], before: list[np.ndarray]):
        self.n, self.levels, self.zeros, self.chunks, self.before = n, levels, zeros, chunks, before
        self._open: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        s = np.asarray(ids)
        levels = max(1, int(s.max()).bit_length() if len(s) else 1)
        s = s.astype(np.uint16 if levels <= 16 else np.uint32)
        pack = zstandard.ZstdCompressor(level=3)
        zeros, chunks, before = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (s & s.dtype.type(1 << level)) != 0
            plane = np.packbits(bit, bitorder="little")
            ones = _ONES[plane].astype(np.int64)
            sums = np.add.reduceat(ones, np.arange(0, len(ones), CHUNK)) if len(ones) else np.zeros(0, np.int64)
            before.append(np.concatenate(([0], np.cumsum(sums))))
            data = plane.tobytes()
            chunks.append([pack.compress(data[a : a + CHUNK]) for a in range(0, len(data), CHUNK)])
            # Arrow parts by the plane itself, without a number for each place.
            values = pa.array(s)
            zero, one = (values.filter(pa.BooleanArray.from_buffers(pa.bool_(), len(s), [None, pa.py_buffer(x)])).to_numpy() for x in (~plane, plane))
            zeros.append(len(zero))
            s = np.concatenate((zero, one))
        return cls(len(ids), levels, zeros, chunks, before)

    def _chunk(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self._open:
            if len(self._open) > 256:
                self._open.clear()
            self._open[level, k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.chunks[level][k]), np.uint8)
        return self._open[level, k]

    def _rank1(self, level: int, i: int) -> int:
        """Ones before place i of a plane."""
        byte, k = i >> 3, (i >> 3) // CHUNK
        if k >= len(self.chunks[level]):
            return int(self.before[level][-1])
        part, at = self._chunk(level, k), byte - k * CHUNK
        ones = int(self.before[level][k]) + int(_ONES[part[:at]].sum(dtype=np.int64))
        return ones + (int(_ONES[part[at] & ((1 << (i & 7)) - 1)]) if i & 7 else 0)

    def _bit(self, level: int, i: int) -> int:
        k = (i >> 3) // CHUNK
        return int(self._chunk(level, k)[(i >> 3) - k * CHUNK] >> (i & 7)) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit = self._bit(level, i)
            ones = self._rank1(level, i)
            value, i = value << 1 | bit, self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        if symbol >> self.levels:
            return 0, 0
        for level in range(self.levels):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if symbol >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a symbol at the places lo..hi-1."""
        lo, hi = self._range(symbol, lo, self.n if hi is None else hi)
        return hi - lo

    def select(self, symbol: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of a symbol."""
        lo, hi = self._range(symbol, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for level in range(self.levels - 1, -1, -1):
            one = symbol >> (self.levels - 1 - level) & 1
            i = self._select_bit(level, i - self.zeros[level] if one else i, one)
        return i

    def _select_bit(self, level: int, k: int, one: int) -> int:
        before = self.before[level] if one else np.minimum(np.arange(len(self.before[level])) * CHUNK * 8, self.n) - self.before[level]
        c = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self._chunk(level, c), bitorder="little")[: self.n - c * CHUNK * 8]
        return c * CHUNK * 8 + int(np.flatnonzero(bits == one)[k - int(before[c])])

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def decode(self) -> np.ndarray:
        """The whole sequence: from the last plane up, each undoes its partition."""
        s = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        unpack = zstandard.ZstdDecompressor()
        for level in range(self.levels - 1, -1, -1):
            plane = b"".join(unpack.decompress(c) for c in self.chunks[level])
            bit = np.unpackbits(np.frombuffer(plane, np.uint8), bitorder="little")[: self.n].view(bool)
            up = np.empty_like(s)
            z = self.zeros[level]
            up[np.flatnonzero(~bit)] = s[:z]
            up[np.flatnonzero(bit)] = s[z:] | s.dtype.type(1 << (self.levels - 1 - level))
            s = up
        return s

    def save(self, doc_ids: list, lengths: np.ndarray) -> bytes:
        sizes = np.array([len(c) for plane in self.chunks for c in plane], np.uint32)
        head = {"n": self.n, "levels": self.levels, "zeros": self.zeros, "planes": [len(c) for c in self.chunks], "docs": len(doc_ids), "null": [i for i, d in enumerate(doc_ids) if d is None]}
        directory = b"".join([sizes.tobytes(), *(b.astype(np.int64).tobytes() for b in self.before), np.array([d or 0 for d in doc_ids], np.int64).tobytes(), np.asarray(lengths, np.int64).tobytes()])
        head["directory"] = len(directory)
        text = json.dumps(head).encode()
        packed = zstandard.ZstdCompressor(level=3).compress(directory)
        return b"".join([MAGIC, struct.pack("<II", len(text), len(packed)), text, packed, *(c for plane in self.chunks for c in plane)])

    @classmethod
    def load(cls, data: bytes) -> tuple[WaveletMatrix, list, np.ndarray]:
        """A shard's matrix, its documents' ids, in order, and their lengths."""
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        n_text, n_packed = struct.unpack_from("<II", data, 8)
        head = json.loads(data[16 : 16 + n_text])
        directory = zstandard.ZstdDecompressor().decompress(data[16 + n_text : 16 + n_text + n_packed])
        at, place = 0, 16 + n_text + n_packed

        def take(kind: type, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(directory, kind, n, at)
            at += out.nbytes
            return out

        sizes = take(np.uint32, sum(head["planes"])).tolist()
        before = [take(np.int64, p + 1) for p in head["planes"]]
        ids = take(np.int64, head["docs"]).tolist()
        lengths = take(np.int64, head["docs"])
        for i in head["null"]:
            ids[i] = None
        chunks, k = [], 0
        for p in head["planes"]:
            plane = []
            for size in sizes[k : k + p]:
                plane.append(data[place : place + size])
                place += size
            chunks.append(plane)
            k += p
        return cls(head["n"], head["levels"], head["zeros"], chunks, before), ids, lengths


def write_token_shards(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, folder: str | None = None) -> DataFrame:
    """Encode every whole text, append end_id and write shards in ascending doc_id order; returns (part, shard, file, n_tokens, n_docs).

    Documents are dealt by ranges of (doc_id, text hash), so a task encodes and writes neighbours
    and no token is shuffled. Null texts are empty and have the end id only; null doc_ids come
    first; documents of equal doc_id follow one another, ordered by their texts' hash and text. An
    empty table writes nothing. Each attempt has files of its own and the stored list names those of the
    attempts that succeeded.
    """
    target = folder or scratch_path(docs.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(tokenizer_path), TaskContext.get().partitionId()
        fs, base = FileSystem.from_uri(target)
        ids: list = []
        tokens: list[np.ndarray] = []
        held, shard = 0, 0
        end = np.array([end_id], encoder.width)

        def flush() -> pa.RecordBatch:
            nonlocal ids, tokens, held, shard
            lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
            data = WaveletMatrix.build(np.concatenate(tokens)).save(ids, lengths)
            fs.create_dir(base, recursive=True)
            name = f"{part:06d}-{shard:04d}-{uuid.uuid4().hex}.wvm"
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(data)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "file": [f"{target}/{name}"], "n_tokens": pa.array([int(lengths.sum())], pa.int64()), "n_docs": pa.array([len(ids)], pa.int64())})
            ids, tokens, held, shard = [], [], 0, shard + 1
            return row

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = encoder.encode(text.as_py())
                ids.append(doc_id)
                tokens.append(np.concatenate((found, end)))
                held += len(found) + 1
                if held >= shard_tokens:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    return materialize(dealt.mapInArrow(giving_back(run), "part int, shard int, file string, n_tokens long, n_docs long"), "token-shards")


def read_token_shards(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    order = Window.partitionBy(F.lit(0)).orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One narrow row per file of some two million tokens.
    placed = shards.withColumn("base", F.sum("n_tokens").over(order) - F.col("n_tokens")).select("file", "base")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.binary())] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = FileSystem.from_uri(file)
                with fs.open_input_file(path) as source:
                    matrix, doc_ids, lengths = WaveletMatrix.load(source.read())
                ids = memoryview(matrix.decode().astype("<u4").tobytes())
                starts = np.concatenate(([0], np.cumsum(lengths))).tolist()
                for lo in range(0, len(doc_ids), 1024):
                    hi = min(len(doc_ids), lo + 1024)
                    parts = [ids[4 * starts[i] : 4 * starts[i + 1]] for i in range(lo, hi)]
                    columns = [pa.array(doc_ids[lo:hi], pa.int64()), pa.array([base + x for x in starts[lo:hi]], pa.int64()), pa.array(lengths[lo:hi]), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(map(bytes, parts), pa.binary())] * with_ids, schema=schema)

    width = max(1, shards.sparkSession.sparkContext.defaultParallelism * 2)
    return placed.repartition(width).mapInArrow(giving_back(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
