"""Token ids in seekable zstandard files.

Each document is one independent zstandard frame, whose content is its ids as little-endian unsigned 32-bit integers.
A skippable frame with the document ids follows (magic 0x184D2A5D: 8 bytes a document, then a byte map of nulls), then
the seek table, itself a skippable frame in the public seekable format: for each frame its compressed size, its
decompressed size and the low 32 bits of the XXH64 of its content; then the number of frames, a descriptor with the
checksum flag, and the magic number 0x8F92EAB1. A reader takes the tables from the end of the file, and then only the
frames of the documents asked for. A plain zstandard decoder reads all ids in order.

Documents are dealt by ranges of their id, each range sorted and written by one task as files of bounded size, into the
shared folder, first under another name and then moved, so that a repeated task does no harm. Equal ids are sorted by
text, so repeated rows stand side by side, each with a frame. Null texts are empty and hold the end id only; null ids
come first. Ids are integers; others are refused. Very long texts are one frame like others, split at white space into
chunks that are encoded one by one. Strings of special tokens are taken as the library takes them. Extra columns are
ignored. Empty tables make no files.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .words import PIECE, Table, _hash, _pieces
from .work import Work, keep_memory

SKIPPABLE, IDS, SEEKABLE = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
#: A file is closed once it holds so many bytes; one document more may follow.
FILE_BYTES = 128 << 20
#: Chunks of text whose ids a worker remembers, and the bytes of the longest that it remembers.
REMEMBERED, LONGEST = 1 << 20, 64
#: Marks that, after a letter or digit, are a token apart from it.
_MARKS = b".,!?;:|$*&#%"


class Chunks:
    """Ids of whole texts, from the ids of the parts between ASCII white space, each encoded once and remembered.

    For tokenizers that lower-case, drop white space and let no token span it, these are the ids of the whole text;
    ``whole`` encodes a text at once, for comparison and for texts that hold the string of a special token. Marks after
    a chunk's last letter or digit are encoded apart from it, which gives the same ids for fewer different chunks. Chunks
    are known by 64-bit hashes, and a text's ids are gathered at once from one array of all that are remembered. Memory is
    bounded: when it is full, all is forgotten.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self._t = Tokenizer.from_file(path)
        self._many = getattr(self._t, "encode_batch_fast", self._t.encode_batch)
        self._forget(0)
        pieces = self._t.get_vocab()
        self._last = [False] * (max(pieces.values(), default=0) + 1)  # ids that end a word, if the vocabulary marks them
        for piece, i in pieces.items():
            self._last[i] = piece.endswith("</w>")
        self._marked = any(self._last)
        self._special = [t.content.lower().encode() for t in self._t.get_added_tokens_decoder().values()]

    _held: dict[str, Chunks] = {}

    @classmethod
    def of(cls, path: str) -> Chunks:
        """The one of this process, whose memory serves one task after another."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def many(self, parts: list[bytes]) -> list[bytes]:
        """Packed ids of parts without white space, not remembered."""
        out: list[bytes | None] = [None] * len(parts)
        texts = [p.decode(errors="replace") for p in parts]
        if self._marked:  # words of letters only go in one text, and are told apart by the ids that end a word
            plain = [i for i, t in enumerate(texts) if t.isalpha()]
            for k in range(0, len(plain), 1024):
                at = plain[k : k + 1024]
                got, word = [], []
                for x in self._many([" ".join([texts[i] for i in at])], add_special_tokens=False)[0].ids:
                    word.append(x)
                    if self._last[x]:
                        got.append(struct.pack(f"<{len(word)}I", *word))
                        word = []
                if len(got) == len(at) and not word:
                    for i, ids in zip(at, got):
                        out[i] = ids
        rest = [i for i, ids in enumerate(out) if ids is None]
        for k in range(0, len(rest), 4096):
            at = rest[k : k + 4096]
            for i, e in zip(at, self._many([texts[i] for i in at], add_special_tokens=False)):
                out[i] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        return out

    def whole(self, text: str) -> list[int]:
        return self._t.encode(text, add_special_tokens=False).ids

    def packed(self, batch: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, packed."""
        i = 0
        while i < len(batch):
            j, size = i, 0
            while j < len(batch) and (j == i or size + len(batch[j]) <= PIECE):
                size += len(batch[j])
                j += 1
            group = batch[i:j]
            special = [any(x in low for x in self._special) for low in (text.lower() for text in group)]
            plain = [b"" if s else text for s, text in zip(special, group)]
            buf, ends = np.frombuffer(b"".join(plain), np.uint8), np.cumsum([0, *map(len, plain)])
            if len(buf) > 2 * PIECE:  # one long text
                got = [b"".join(self._gather(x, np.array([0, len(x)]))[0] for x in _pieces(buf, PIECE))]
            else:
                got = self._gather(buf, ends)
            for s, text, ids in zip(special, group, got):
                if s:
                    whole = self.whole(text.decode(errors="replace"))
                    ids = struct.pack(f"<{len(whole)}I", *whole)
                yield ids
            i = j

    def _gather(self, buf: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The packed ids of the texts in a buffer, of which each is between two bounds."""
        h, begin, n = _hash(buf, bounds[:-1])
        short = n <= LONGEST
        at, here = self._table.find(h)
        new = np.flatnonzero(~here & short)
        if len(new):
            u, first = np.unique(h[new], return_index=True)
            if self._table.filled + 3 * len(u) > self._table.room:
                new = np.flatnonzero(short)
                u, first = np.unique(h[new], return_index=True)
                self._forget(3 * len(u))
            spelled = buf.tobytes()
            self._learn(u, [spelled[b : b + k].lower() for b, k in zip(begin[new[first]].tolist(), n[new[first]].tolist())])
            at[new], _ = self._table.find(h[new])
        start, count = self._start[at], self._count[at].astype(np.int64)
        long = np.flatnonzero(~short)
        if len(long):
            raw = self.many([buf[b : b + k].tobytes().lower() for b, k in zip(begin[long].tolist(), n[long].tolist())])
            start[long], count[long] = self._keep(raw, False)
        ends = np.append(0, np.cumsum(count))
        ids = self._ids[np.repeat(start - ends[:-1], count) + np.arange(ends[-1])]
        cuts = 4 * ends[np.searchsorted(begin, bounds)]
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def texts(self, batch: list[bytes]) -> Iterator[list[int]]:
        for raw in self.packed(batch):
            yield np.frombuffer(raw, "<u4").tolist()

    def _forget(self, room: int) -> None:
        """Begins anew, with room for so many chunks or REMEMBERED."""
        self._table = Table(max(REMEMBERED, room))
        self._start, self._count = np.zeros(len(self._table), np.int64), np.zeros(len(self._table), np.int32)
        self._ids, self._filled = np.zeros(1 << 20, "<u4"), 0

    def _keep(self, raw: list[bytes], stay: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Where packed ids begin in the array of all, and how many they are; those that don't stay are overwritten by the next."""
        new, n = np.frombuffer(b"".join(raw), "<u4"), np.array([len(x) // 4 for x in raw], np.int64)
        end = self._filled + len(new)
        if end > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros(max(len(self._ids), len(new)), "<u4")])
        self._ids[self._filled : end] = new
        start = self._filled + np.cumsum(n) - n
        if stay:
            self._filled = end
        return start, n

    def _add(self, keys: np.ndarray, raw: list[bytes]) -> None:
        at = self._table.add(keys)
        self._start[at], self._count[at] = self._keep(raw)

    def _learn(self, keys: np.ndarray, parts: list[bytes]) -> None:
        """Adds chunks that aren't remembered, and those that they are made of."""
        stems = [p.rstrip(_MARKS) for p in parts]
        for i, (p, stem) in enumerate(zip(parts, stems)):
            if not (len(stem) < len(p) and stem and stem.decode(errors="replace")[-1].isalnum()):
                stems[i] = p
        some = list({*stems, *(p[len(x) :] for p, x in zip(parts, stems) if len(x) < len(p))})
        h, _, _ = _hash(np.frombuffer(b" ".join(some), np.uint8), np.zeros(0, np.int64))
        _, here = self._table.find(h)
        absent = np.flatnonzero(~here)
        self._add(h[absent], self.many([some[i] for i in absent.tolist()]))
        at, here = self._table.find(keys)
        rest, place = np.flatnonzero(~here).tolist(), dict(zip(some, self._table.find(h)[0].tolist()))
        held = lambda x: self._ids[self._start[place[x]] : self._start[place[x]] + self._count[place[x]]].tobytes()
        self._add(keys[rest], [held(stems[i]) + held(parts[i][len(stems[i]) :]) for i in rest])


class SeekableWriter:
    """Writes frames to an open binary file, then the tables."""

    def __init__(self, out, level: int = 3):
        self._out, self._c = out, zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=False)
        self._entries: list[tuple[int, int, int]] = []
        self._ids: list[int | None] = []
        self.size = self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray | bytes) -> None:
        """A document's ids: an array, or packed."""
        raw = ids if isinstance(ids, bytes) else ids.astype("<u4").tobytes()
        data = self._c.compress(raw)
        self._out.write(data)
        self._entries.append((len(data), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self._ids.append(doc_id)
        self.size += len(data)
        self.tokens += len(raw) // 4

    @property
    def frames(self) -> int:
        return len(self._entries)

    def close(self) -> None:
        ids = b"".join(struct.pack("<q", i or 0) for i in self._ids) + bytes(i is None for i in self._ids)
        self._out.write(struct.pack("<II", IDS, len(ids)) + ids)
        table = b"".join(struct.pack("<III", *e) for e in self._entries) + struct.pack("<IBI", len(self._entries), 0x80, SEEKABLE)
        self._out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self._out.close()


class SeekableReader:
    """Random access to the documents of a file: ``ids`` lists them, ``tokens(i)`` reads and checks one frame only."""

    def __init__(self, file, size: int):
        self._f = file
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        length = 12 * n + 9
        head = struct.unpack("<II", self._at(size - length - 8, 8))
        if head != (SKIPPABLE, length):
            raise ValueError("broken seek table")
        table = np.frombuffer(self._at(size - length, 12 * n), "<u4").reshape(n, 3)
        self._sums, self._raw = table[:, 2], table[:, 1]
        self._starts = np.zeros(n + 1, np.int64)
        np.cumsum(table[:, 0], out=self._starts[1:])
        if struct.unpack("<II", self._at(int(self._starts[-1]), 8)) != (IDS, 9 * n):
            raise ValueError("broken table of documents")
        held = self._at(int(self._starts[-1]) + 8, 9 * n)
        values, nulls = np.frombuffer(held[: 8 * n], "<i8"), np.frombuffer(held[8 * n :], np.uint8)
        self.ids = [None if z else int(v) for v, z in zip(values, nulls)]
        self._d = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.ids)

    def _at(self, at: int, n: int) -> bytes:
        self._f.seek(at)
        return self._f.read(n)

    def tokens(self, i: int) -> np.ndarray:
        raw = self._d.decompress(self._at(int(self._starts[i]), int(self._starts[i + 1] - self._starts[i])), max_output_size=max(1, int(self._raw[i])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self._sums[i]):
            raise ValueError(f"frame {i} doesn't match its checksum")
        return np.frombuffer(raw, "<u4")


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = 1, parts: int | None = None) -> DataFrame:
    """Writes documents (doc_id, text) to ``folder``; rows (path, bytes, documents, tokens, least) of the files, unsorted.

    ``least`` orders the files: (range, number in it). It runs when the result is used; save the result.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("token files hold integer ids")
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def put(batches):
        from pyspark import TaskContext

        keep_memory()
        part, last = TaskContext.get().partitionId(), struct.pack("<I", end)
        chunks, (fs, base) = Chunks.of(tokenizer), store(folder)
        fs.create_dir(base, recursive=True)
        rows, w, tmp, n = [], None, None, 0

        def shut():
            w.close()
            name = f"{base}/part-{part:06d}-{n:05d}.ids.zst"
            size = fs.get_file_info(tmp).size
            fs.move(tmp, name)
            rows.append((name, size, w.frames, w.tokens, part, n))

        for b in batches:
            texts = b.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist()
            for doc_id, ids in zip(b.column(0).to_pylist(), chunks.packed(texts)):
                if w is None:
                    tmp = f"{base}/.{uuid.uuid4().hex}"
                    w = SeekableWriter(fs.open_output_stream(tmp))
                w.add(doc_id, ids + last)
                if w.size >= FILE_BYTES:
                    shut()
                    w, n = None, n + 1
        if w is not None:
            shut()
        cols = list(zip(*rows)) or [[]] * 6
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["path", "bytes", "documents", "tokens", "part", "nth"])

    dealt = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(put, "path string, bytes long, documents long, tokens long, part long, nth long")


def read(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in files (path, ..., base), decoded frame by frame."""

    def take(batches):
        fs, _ = store(folder)
        for b in batches:
            for path, size, base in zip(*(b.column(i).to_pylist() for i in range(3))):
                with fs.open_input_file(path) as f:
                    r, start = SeekableReader(f, size), base
                    ids, starts, counts, sums = [], [], [], []
                    for i in range(len(r)):
                        t = r.tokens(i)
                        ids.append(r.ids[i])
                        starts.append(start)
                        counts.append(len(t))
                        sums.append(zlib.crc32(t.tobytes()))
                        start += len(t)
                        if len(ids) == 8192 or i == len(r) - 1:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, counts, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                            ids, starts, counts, sums = [], [], [], []

    return files.select("path", "bytes", "base").mapInArrow(take, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end: int = 1, work: Work | None = None) -> tuple[DataFrame, str]:
    """Writes documents (doc_id, text) as files in the shared folder; their rows with ``base``, the ids before each file, and the folder."""
    work = work or Work(docs.sparkSession)
    folder = work.path("token-files")
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    files = work.save(write(docs, folder, tokenizer, end), "files")
    # one row a file of up to 128 MB: summed by range first, so that no task holds the rows of all files but for those sums
    per = files.groupBy("part").agg(F.sum("tokens").alias("all"))
    before = per.select("part", F.coalesce(F.sum("all").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.coalesce(F.sum("tokens").over(W.partitionBy("part").orderBy("nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("inner", inner).join(before, "part").withColumn("base", F.col("before") + F.col("inner")), folder


def token_rows(docs: DataFrame, tokenizer: str, end: int = 1, work: Work | None = None) -> DataFrame:
    """Writes and reads back: rows (doc_id, start, n_tokens, ids_crc32)."""
    files, folder = token_files(docs, tokenizer, end, work)
    return read(files.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), folder)


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"))


QUERIES = {"op8_token_ids": op8_token_ids}
SQL: dict[str, str] = {}
