"""Token-ID output (7): files of plane-shuffled, compressed id chunks with an index, written and read back.

A file holds the ids of consecutive documents. Ids go in chunks of a fixed number; a chunk is transposed into byte
planes (or bit planes), each plane is compressed with zstandard, and planes of zeros alone cost a few bytes.

    magic | chunk planes ... | documents (ids, token counts; zstandard) | index | footer
    index, per chunk: offset u64, ids u32, planes u16, then the planes' sizes u32
    footer: offset of documents u64, of index u64, documents u64, chunks u32, bits of a plane u32, magic
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliary.llm import textops
from foliary.llm.common import shared_folder, table, written
from foliary.llm.wordcache import WordCache

MAGIC = b"FOLIDS01"
#: Ids of a chunk, bytes of text for each file, entries of a task's word cache.
CHUNK, FILE_BYTES, CACHE = 1 << 16, 1 << 24, 400_000
END = 2


def pack_chunk(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of a chunk, lowest first: plane k holds byte k, or bit k, of every id."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1)
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if bits == 1:
        raw = np.concatenate([np.packbits((raw[k] >> b) & 1)[None] for k in range(4) for b in range(8)])
    top = max((k + 1 for k in range(len(raw)) if raw[k].any()), default=0)
    return [squeeze.compress(np.ascontiguousarray(raw[k]).tobytes()) for k in range(top)]


def unpack_chunk(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    import zstandard

    grow = zstandard.ZstdDecompressor()
    out = np.zeros(n, np.uint32)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(grow.decompress(plane), np.uint8)
        raw = np.unpackbits(raw)[:n] if bits == 1 else raw
        out |= raw.astype(np.uint32) << np.uint32(k * bits)
    return out


class Writer:
    """Appends documents; full chunks leave memory at once."""

    def __init__(self, out, bits: int = 8):
        self.out, self.bits, self.at = out, bits, 0
        self.index: list[bytes] = []
        self.held, self.waiting = [], 0
        self.docs: list[np.ndarray] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs.append(np.stack([doc_ids.astype("<i8"), counts.astype("<i8")]))
        self.held.append(ids.astype(np.uint32))
        self.waiting += len(ids)
        if self.waiting >= CHUNK:
            self._chunks(np.concatenate(self.held), False)

    def _chunks(self, ids: np.ndarray, last: bool) -> None:
        end = len(ids) if last else len(ids) - len(ids) % CHUNK
        for a in range(0, end, CHUNK):
            part = ids[a : min(a + CHUNK, end)]
            planes = pack_chunk(part, self.bits)
            self.index.append(struct.pack("<QIH", self.at, len(part), len(planes)) + b"".join(struct.pack("<I", len(p)) for p in planes))
            for p in planes:
                self._put(p)
        self.held, self.waiting = [ids[end:]], len(ids) - end

    def close(self) -> None:
        import zstandard

        self._chunks(np.concatenate(self.held) if self.held else np.zeros(0, np.uint32), True)
        docs_at, docs = self.at, np.concatenate(self.docs, 1) if self.docs else np.zeros((2, 0), "<i8")
        self._put(zstandard.ZstdCompressor(level=1).compress(docs.tobytes()))
        index_at = self.at
        self._put(b"".join(self.index))
        self._put(struct.pack("<QQQII", docs_at, index_at, docs.shape[1], len(self.index), self.bits) + MAGIC)


def read_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """doc_ids, token counts, and the chunks of ids in order."""
    import zstandard

    if raw[:8] != MAGIC or raw[-8:] != MAGIC:
        raise ValueError("not a file of token ids, or not whole")
    docs_at, index_at, n, chunks, bits = struct.unpack("<QQQII", raw[-40:-8])
    docs = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[docs_at:index_at], max_output_size=16 * n + 1), "<i8").reshape(2, -1) if n else np.zeros((2, 0), np.int64)

    def ids() -> Iterator[np.ndarray]:
        at = index_at
        for _ in range(chunks):
            offset, count, planes = struct.unpack_from("<QIH", raw, at)
            sizes = struct.unpack_from(f"<{planes}I", raw, at + 14)
            at += 14 + 4 * planes
            parts = []
            for size in sizes:
                parts.append(raw[offset : offset + size])
                offset += size
            yield unpack_chunk(parts, count, bits)

    return docs[0], docs[1], ids()


class Encoder:
    """Ids of whole texts as the tokenizers library gives them; it encodes each distinct pre-token of a cache's life once.

    The byte-level pre-tokenizer cuts at changes of letter, number, space and other characters. Texts whose
    characters are all under U+0250 are cut here in whole batches; any other text, and one with an apostrophe before a
    letter that may be a contraction or with the content of an added token, goes to the library as it is.
    """

    LIMIT = 0x250

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
        import unicodedata

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        kinds = []
        for c in range(self.LIMIT):
            name = unicodedata.category(chr(c))
            white = c in (32, 0x85, 0xA0) or 9 <= c <= 13
            kinds.append(2 if c == 32 else 3 if white else 0 if name[0] == "L" else 1 if name[0] == "N" else 4)
        self.kinds = np.array(kinds + [5], np.uint8)
        self.cache = WordCache(self.library, CACHE)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cut(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts of all pre-tokens, and which documents need the library itself."""
        # Characters of one or two bytes only: a code point is known from its bytes.
        lead = (data & 0xC0) != 0x80
        where = np.flatnonzero(lead)
        first = data[where]
        code = first.astype(np.int32)
        two = (first >= 0xC0) & (first < 0xE0)
        code[two] = ((first[two] & 0x1F).astype(np.int32) << 6) | (data[where[two] + 1] & 0x3F)
        code[first >= 0xE0] = self.LIMIT
        kind = self.kinds[np.minimum(code, self.LIMIT)]
        doc = np.searchsorted(where, at)
        edge = np.zeros(len(where) + 1, bool)
        edge[doc] = True
        white = (kind == 2) | (kind == 3)
        prev, prev_white = np.roll(kind, 1), np.roll(white, 1)
        next_solid = ~np.roll(white, -1) & ~edge[1:]
        start = np.where(white, ~prev_white | next_solid, (~prev_white & (prev != kind)) | (prev == 3))
        start |= edge[:-1]
        odd = kind == 5
        quote = code == 39
        if quote.any():
            after = np.roll(code, -1)
            odd |= quote & np.isin(after, np.frombuffer(b"stmdrvl", np.uint8))
        hard = np.add.reduceat(np.append(odd, False).astype(np.int64), np.minimum(doc[:-1], len(odd)))
        hard[doc[1:] == doc[:-1]] = 0
        raw = data.tobytes()
        for content in self.added:
            k = raw.find(content)
            while k >= 0:
                hard[np.searchsorted(at, k, "right") - 1] = 1
                k = raw.find(content, k + 1)
        return where[start], hard > 0

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column's texts end to end, and how many each text has."""
        data, at = textops.utf8(column)
        n = len(at) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        starts, hard = self.cut(data, at)
        doc = np.searchsorted(at, starts, "right") - 1
        soft = ~hard[doc]
        ends = np.append(starts[1:], len(data))[soft]
        starts, doc = starts[soft], doc[soft]
        ends = np.minimum(ends, at[doc + 1])
        ids, sizes = self.cache.ids(data, starts, ends)
        counts = np.bincount(doc, sizes, n).astype(np.int64)
        if hard.any():
            own = np.flatnonzero(hard)
            parts, cuts = [], np.concatenate([[0], np.cumsum(counts)])
            direct = self.library([data[at[k] : at[k + 1]].tobytes().decode() for k in own])
            done = 0
            for k, got in zip(own, direct, strict=True):
                parts += [ids[cuts[done] : cuts[k]], np.array(got, np.uint32)]
                counts[k], done = len(got), k
            ids = np.concatenate([*parts, ids[cuts[done] :]])
        return ids, counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, so the cache outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _write(folder: str, path: str, end: int, bits: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        part = TaskContext.get().partitionId()
        system, base = fs.FileSystem.from_uri(folder)
        # Another attempt writes the same bytes under its own name; the rename makes the file appear whole.
        name, own = f"{base}/part-{part:06d}.ids", f"{base}/_try-{part:06d}-{TaskContext.get().taskAttemptId()}"
        writer, docs, tokens = None, 0, 0
        for batch in textops.batches(source):
            if writer is None:
                system.create_dir(base, recursive=True)
                stream = system.open_output_stream(own)
                writer = Writer(stream, bits)
            ids, counts = encoder(path).encode(batch.column(1))
            at = np.cumsum(counts)
            ids, counts = np.insert(ids, at, end), counts + 1
            writer.add(ids, batch.column(0).to_numpy(zero_copy_only=False), counts)
            docs, tokens = docs + len(counts), tokens + len(ids)
        if writer is not None:
            writer.close()
            stream.close()
            system.move(own, name)
            yield pa.record_batch([pa.array([part], pa.int64()), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64())], names=["part", "docs", "tokens"])

    return run


def _read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = int(name.rpartition("part-")[2].partition(".")[0])
            doc_ids, counts, chunks = read_file(raw.as_py())
            sums = np.zeros(len(counts), np.int64)
            ends = np.cumsum(counts)
            doc = done = crc = 0
            for ids in chunks:
                raw_ids = ids.astype("<u4")
                at = 0
                while at < len(ids):
                    take = min(len(ids) - at, int(ends[doc]) - done)
                    crc = zlib.crc32(raw_ids[at : at + take].data, crc)
                    at, done = at + take, done + take
                    if done == ends[doc]:
                        sums[doc] = crc
                        doc, crc = doc + 1, 0
            yield pa.record_batch([pa.array(doc_ids, pa.int64()), pa.array(np.full(len(counts), part, np.int64)), pa.array(ends - counts), pa.array(counts, pa.int64()), pa.array(sums)], names=["id", "part", "within", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END, bits: int = 8) -> DataFrame:
    """Writes files of ids in ascending id order to ``folder``; (part, docs, tokens) of each, as a written table.

    Null and empty texts hold the end id alone. A null id counts as -2 ** 63, the least. Repeated rows follow each other.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)).cast("long")).alias("id"), F.col(text_col).alias("text"))
    nbytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    ranged = rows.repartitionByRange(max(1, -(-nbytes // FILE_BYTES)), "id").sortWithinPartitions("id")
    return written(ranged.mapInArrow(_write(folder, path, end, bits), "part long, docs long, tokens long"))


def read_token_files(spark: SparkSession, folder: str, parts: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of each document, from the files alone; ``parts`` gives each file's first position."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.ids").load(folder).select("path", "content")
    found = files.mapInArrow(_read, "id long, part long, within long, n_tokens long, ids_crc32 long")
    first = parts.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("first"))
    return found.join(first, "part").select(F.expr(f"nullif(id, {-(2**63) + 1} - 1)").alias("id"), (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark)
    parts = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    docs = read_token_files(spark, folder, parts) if not parts.isEmpty() else spark.createDataFrame([], "id long, start long, n_tokens long, ids_crc32 long")
    return docs.withColumnRenamed("id", "doc_id")
