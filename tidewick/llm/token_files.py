"""Token-id files: one concatenated id array per shard, with document boundaries in Elias-Fano form.

The n + 1 boundaries of a shard are a rising sequence, and so are its n document ids. Each number is split: the low bits
stand packed side by side, the high parts as a row of unary gaps in one bit string, about 2 + log2(mean gap) bits a
document in all. The place of every 64th one in the bit string is stored too, so `offset(i)` finds the i-th boundary
with a few words of the bit string, and `between(a, b)` a run of them.

Documents are range-partitioned by id, so shards follow each other in ascending order; each task encodes its texts and
streams the ids to its shard's file, a file of its own attempt, with the boundaries behind them. The settled manifest
names the files that count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .encoding import SLICE_BYTES, encoder
from .tables import folder as new_folder
from .tables import settled, table

MAGIC = b"TWTOKEN2"
END, TOKENIZER = 0, "byte_bpe_50k.json"
SAMPLE = 64
#: Bytes of text of a shard, about: there are at least as many shards as that takes.
SHARD_BYTES = 256_000_000
#: Stands at the end of a file: sizes of the sections before it (ids, then both indexes: low, high, samples).
_FOOTER = np.dtype([
    ("docs", "<u8"), ("ids", "<u8"), ("width", "<u4"), ("low", "<u4"), ("low_words", "<u8"), ("high_words", "<u8"),
    ("nulls", "<u8"), ("first_id", "<i8"), ("id_low", "<u4"), ("free", "<u4"), ("id_low_words", "<u8"), ("id_high_words", "<u8"), ("magic", "S8"),
])


class EliasFano:
    """A rising sequence of numbers below 2 ** 64."""

    def __init__(self, count: int, low: int, low_words: np.ndarray, high_words: np.ndarray, samples: np.ndarray):
        self.count, self.low, self.low_words, self.high_words, self.samples = count, low, low_words, high_words, samples

    @classmethod
    def encoded(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values).astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, int(top // max(n, 1)).bit_length() - 1)
        ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-(n + (top >> low) + 1) // 64) * 64, np.uint8)
        bits[ones] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        small = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        padded = np.zeros(-(-len(small) // 64) * 64, np.uint8)
        padded[: len(small)] = small
        return cls(n, low, np.packbits(padded, bitorder="little").view("<u8"), high, ones[::SAMPLE].astype("<u8"))

    def _low(self, i: int) -> int:
        at, word = i * self.low, 0
        for k in range(self.low):
            word |= ((int(self.low_words[(at + k) >> 6]) >> ((at + k) & 63)) & 1) << k
        return word

    def select(self, i: int) -> int:
        """The i-th number, from the sample before it and the words behind that."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        word = int(self.high_words[at >> 6]) >> (at & 63) << (at & 63)
        place = at >> 6
        while (ones := word.bit_count()) <= left:
            left -= ones
            place += 1
            word = int(self.high_words[place])
        for _ in range(left):
            word &= word - 1
        one = (place << 6) + (word & -word).bit_length() - 1
        return ((one - i) << self.low) | (self._low(i) if self.low else 0)

    def between(self, a: int, b: int) -> np.ndarray:
        """The numbers from the a-th up to the b-th, without that: one look at the samples, then only the words there."""
        if a >= b:
            return np.zeros(0, np.uint64)
        first = a // SAMPLE
        begin = int(self.samples[first]) >> 6
        end = (int(self.samples[-(-b // SAMPLE)]) >> 6) + 1 if -(-b // SAMPLE) < len(self.samples) else len(self.high_words)
        ones = np.flatnonzero(np.unpackbits(self.high_words[begin:end].view(np.uint8), bitorder="little")) + (begin << 6)
        skip = a - first * SAMPLE + int(np.searchsorted(ones, int(self.samples[first])))
        out = (ones[skip : skip + b - a] - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            word = a * self.low >> 6
            bits = np.unpackbits(self.low_words[word : (b * self.low >> 6) + 1].view(np.uint8), bitorder="little")
            bits = bits[a * self.low - (word << 6) :][: (b - a) * self.low].reshape(b - a, self.low)
            out |= (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def all(self) -> np.ndarray:
        return self.between(0, self.count)

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.low_words, self.high_words, self.samples


def _files(folder: str):
    """The file system and path of a folder, local or any other that pyarrow knows."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


class ShardWriter:
    """Streams one shard: ids as they come, the indexes at the end. Keeps two numbers for each document."""

    def __init__(self, path: str, width: int):
        system, name = _files(path)
        self.out, self.width = system.open_output_stream(name), width
        self.doc_ids, self.lengths = [], []

    def add(self, doc_ids: pa.Array, texts: list[np.ndarray]) -> None:
        """Documents in ascending order of their ids, nulls first."""
        self.doc_ids.append(doc_ids)
        self.lengths.append(np.array([len(x) for x in texts], np.int64))
        self.out.write(b"".join([x.tobytes() for x in texts]))

    def close(self) -> tuple[int, int]:
        """Writes what stands behind the ids; the number of documents and of ids."""
        ids = pa.concat_arrays(self.doc_ids)
        numbers = ids.drop_null().to_numpy().astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(self.lengths), dtype=np.int64)])
        first = int(numbers[0]) if len(numbers) else 0
        index, names = EliasFano.encoded(ends), EliasFano.encoded(numbers.view(np.uint64) - np.array(first, np.int64).view(np.uint64))
        footer = np.zeros(1, _FOOTER)
        footer[0] = (
            len(ids), int(ends[-1]), self.width, index.low, len(index.low_words), len(index.high_words),
            ids.null_count, first, names.low, 0, len(names.low_words), len(names.high_words), MAGIC,
        )
        for part in (*index.parts(), *names.parts(), footer):
            self.out.write(part.tobytes())
        self.out.close()
        return len(ids), int(ends[-1])


class Shard:
    """An open shard: document ids, boundaries, and the ids of any document by position."""

    def __init__(self, path: str):
        system, name = _files(path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        f = np.frombuffer(self._read(max(0, size - _FOOTER.itemsize), min(size, _FOOTER.itemsize)), _FOOTER)[0] if size >= _FOOTER.itemsize else None
        if f is None or f["magic"] != MAGIC:
            raise ValueError(f"{path} isn't a token file")
        self.docs, self.ids, self.width, self.nulls = int(f["docs"]), int(f["ids"]), int(f["width"]), int(f["nulls"])
        self.first_id = np.array(f["first_id"], np.int64).view(np.uint64)
        self.at = self.ids * self.width
        self.index = self._index(self.docs + 1, int(f["low"]), int(f["low_words"]), int(f["high_words"]))
        self.names = self._index(self.docs - self.nulls, int(f["id_low"]), int(f["id_low_words"]), int(f["id_high_words"]))

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _index(self, count: int, low: int, *words: int) -> EliasFano:
        sections = []
        for n in (*words, -(-count // SAMPLE)):
            sections.append(np.frombuffer(self._read(self.at, 8 * n), "<u8"))
            self.at += 8 * n
        return EliasFano(count, low, *sections)

    def offset(self, i: int) -> int:
        return self.index.select(i)

    def doc_ids(self, a: int, b: int) -> list[int | None]:
        """The ids of the documents at positions a to b, without b."""
        known = self.names.between(max(0, a - self.nulls), max(0, b - self.nulls)) + self.first_id
        return [None] * (b - a - len(known)) + known.view(np.int64).tolist()

    def tokens(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self._read(start * self.width, (end - start) * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.tokens(self.offset(i), self.offset(i + 1))

    def close(self) -> None:
        self.file.close()


def write_token_files(docs: DataFrame, folder: str, end: int = END, name: str = TOKENIZER, shards: int | None = None) -> DataFrame:
    """Writes `docs` (doc_id, text) in ascending doc_id order and returns the manifest: shard, path, docs, ids.

    Null ids come first, null texts are empty, equal ids are ordered by a hash of the text and then by the text; each
    document ends with the id `end`. A shard is one partition of the sort: `shards` of them, or as many as
    spark.sql.shuffle.partitions says, and more if texts have more than SHARD_BYTES for each. A task holds two numbers
    for each document of its shard, and no ids. An empty table gives no shards.
    """
    if shards is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    laid = docs.select("doc_id", "text").repartitionByRange(shards, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, context, out = encoder(name), TaskContext.get(), None
        path = f"{folder}/shard-{context.partitionId():06d}-{context.taskAttemptId()}.bin"
        for part in tokens.slices(batches, "text", SLICE_BYTES, keep="encoder"):
            out = out or ShardWriter(path, own.type.itemsize)
            out.add(part.column("doc_id"), own.ended(part.column("text"), end))
        if out:
            n, ids = out.close()
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([path]), pa.array([n], pa.int64()), pa.array([ids], pa.int64())], ["shard", "path", "docs", "ids"])

    system, at = _files(folder)
    system.create_dir(at, recursive=True)
    return settled(laid.mapInArrow(write, "shard int, path string, docs long, ids long"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Rows doc_id, start, n_tokens, ids_crc32 of all documents in the files of a manifest, in no order."""
    w = Window.orderBy("shard")  # one row for each shard
    placed = manifest.withColumn("base", F.sum("ids").over(w) - F.col("ids"))
    shards = manifest.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = Shard(path)
                for k in range(0, shard.docs, 1000):
                    some = shard.index.between(k, min(k + 1001, shard.docs + 1)).astype(np.int64)
                    ids = shard.tokens(int(some[0]), int(some[-1]))
                    crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(some - some[0], some[1:] - some[0], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids(k, k + len(some) - 1), pa.int64()), pa.array(some[:-1] + base), pa.array(np.diff(some)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                shard.close()

    spread = placed.select("shard", "path", "base").repartition(max(1, shards))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9(spark, sf_dir: str) -> DataFrame:
    """Places and checksums of all documents, as read back from the files that the whole table was written to.

    Nulls, empty texts, repeats and empty tables as in write_token_files; only doc_id and text are read.
    """
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), new_folder(spark, "token-files")))
