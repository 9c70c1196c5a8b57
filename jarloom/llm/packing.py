"""Token ids in fixed-width bit-packed files."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import in_use, read, saved, small

MAGIC = b"IDPACK01"
BLOCK_IDS = 65_536
RECORD_IDS = 2_000_000
HEAD = struct.Struct("<8sBxxxIQQ")  # magic, bits, documents, ids, blocks
RECORD = "part int, seq int, n_ids long, record binary"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in `bits` bits, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for k in range(0, len(ids), BLOCK_IDS):
        part = ids[k : k + BLOCK_IDS].astype(np.uint32)
        out.append(np.packbits(((part[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    one = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return one.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def write_record(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, bits: int) -> bytes:
    """header | null flags u8 | doc ids i64 | counts u32 | byte offsets of blocks u64 | blocks of BLOCK_IDS ids, each from a whole byte on."""
    blocks = [pack(ids[k : k + BLOCK_IDS], bits) for k in range(0, len(ids), BLOCK_IDS)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype="<u8")[:-1] if blocks else np.zeros(0, "<u8")
    head = HEAD.pack(MAGIC, bits, len(doc_ids), len(ids), len(blocks))
    flags = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    return b"".join([head, flags, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array(counts, "<u4").tobytes(), offsets.tobytes(), *blocks])


class Record:
    """A record, read in place: documents(), and ids(a, b) for any range without touching other blocks."""

    def __init__(self, data: bytes):
        magic, self.bits, self.n_docs, self.n_ids, n_blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a packed record")
        at = HEAD.size
        self.nulls = np.frombuffer(data, np.uint8, self.n_docs, at)
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at := at + self.n_docs)
        self.counts = np.frombuffer(data, "<u4", self.n_docs, at := at + 8 * self.n_docs)
        self.offsets = np.frombuffer(data, "<u8", n_blocks, at := at + 4 * self.n_docs)
        self.data, self.at = memoryview(data), at + 8 * n_blocks

    def block(self, k: int) -> np.ndarray:
        n = min(BLOCK_IDS, self.n_ids - k * BLOCK_IDS)
        a = self.at + int(self.offsets[k])
        return unpack(self.data[a : a + (n * self.bits + 7) // 8], n, self.bits)

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        b = self.n_ids if b is None else min(b, self.n_ids)
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // BLOCK_IDS, (b - 1) // BLOCK_IDS
        return np.concatenate([self.block(k) for k in range(first, last + 1)])[a - first * BLOCK_IDS : b - first * BLOCK_IDS]


MARK, FAR = b"!\xff"
#: Bytes of ASCII marks as MARK; those of characters other than ASCII and U+00C0 to U+00FF as FAR, but for the second ones; others as a space.
KIND = bytes(32 if chr(b).isalnum() and b < 128 or b in b" \t\n\r\v\f" or 128 <= b < 192 or b == 0xC3 else MARK if b < 128 else FAR for b in range(256))
RUN = re.compile(rb"(?<=[A-Za-z0-9\x80-\xff])(?=[!-/:-@\[-`{-~])")


def words_of(text: bytes) -> list[bytes]:
    """Words that are encoded one by one to the ids of the text.

    In texts of ASCII and the letters from U+00C0 to U+00FF without special tokens' strings, the ids stay the same if A-Z are lower-cased and marks that follow a letter or
    digit begin a word of their own, as the pre-tokenizer has it (of marks that don't stand side by side, this is done for full stops and commas). That makes for far fewer
    different words.
    """
    kind = text.translate(KIND)
    if FAR in kind or b"\xc3\x97" in text or b"\xc3\xb7" in text:
        return text.split()
    if b"!!" not in kind:
        return text.lower().replace(b".", b" .").replace(b",", b" ,").split()
    return text.split() if b"<|" in text else RUN.sub(b" ", text.lower()).split()


class Encoder:
    """A tokenizer whose normalizer and pre-tokenizer never look across ASCII white space, so that words can be encoded once each and remembered.

    New words are encoded together, with a special token between them (mark), if that gives the ids that they have alone.
    """

    MOST = 1_000_000
    JOINED = 256

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bits = max(1, (self.tokenizer.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.mark = None
        for k, t in sorted(self.tokenizer.get_added_tokens_decoder().items()):
            if t.special and not (t.normalized or t.single_word or t.lstrip or t.rstrip):
                self.mark = k, t.content.encode()
                some = [b"ab", b"C1", b"it's", "\u00e9.".encode()]
                ids, length = self.encoded(some)
                if [x.tolist() for x in np.split(ids, np.cumsum(length)[:-1])] == [self.alone(w) for w in some]:
                    break
                self.mark = None
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def alone(self, word: bytes) -> list[int]:
        return self.tokenizer.encode(word.decode(), add_special_tokens=False).ids

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after the other, and how many each has."""
        n = self.JOINED if self.mark else 1
        number, mark = self.mark or (-1, b"")
        groups = [words[k : k + n] for k in range(0, len(words), n)]
        ids, length = [], []
        for g, enc in zip(groups, self.tokenizer.encode_batch_fast([mark.join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            x = np.array(enc.ids, np.uint32)
            ends = np.flatnonzero(x == number) if self.mark else np.zeros(0, np.int64)
            if len(ends) == len(g) - 1:
                ids.append(x[x != number] if len(ends) else x)
                length.append(np.diff(ends, prepend=-1, append=len(x)) - 1)
            else:  # a word holds the mark
                each = [self.alone(w) for w in g]
                ids.append(np.array([i for e in each for i in e], np.uint32))
                length.append(np.array(list(map(len, each)), np.int64))
        return np.concatenate(ids), np.concatenate(length)

    def learn(self, words: list[bytes], index: dict[bytes, int]) -> None:
        k, n = len(self.index), len(words)
        ids, length = self.encoded(words)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(ids), np.uint32)])
        if k + n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros(len(x) + n, x.dtype)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k : k + n], self.length[k : k + n] = self.used + np.cumsum(length) - length, length
        index.update(zip(words, range(k, k + n), strict=True))
        self.used += len(ids)

    def __call__(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, `end` after each, and how many each text has. Words beyond the bound are encoded again each time."""
        words = list(map(words_of, texts))
        many = np.fromiter(map(len, words), np.int64, len(words))
        every = [w for ws in words for w in ws]
        got = np.fromiter(map(self.index.get, every, repeat(-1)), np.int64, len(every))
        used = None
        if (miss := np.flatnonzero(got < 0)).size:
            new = list(dict.fromkeys(every[k] for k in miss.tolist()))
            more = self.index
            if len(self.index) + len(new) > self.MOST:
                more, used = {}, self.used
            self.learn(new, more)
            got[miss] = [more[every[k]] for k in miss.tolist()]
        # a word of one id stands for the end of each text
        first, length = np.insert(self.start[got], np.cumsum(many), 0), np.insert(self.length[got], np.cumsum(many), 1)
        before = np.cumsum(length) - length
        ids = self.flat[np.repeat(first - before, length) + np.arange(int(length.sum()))] if len(length) else np.zeros(0, np.uint32)
        ends = np.cumsum(many + 1) - 1
        ids[before[ends]] = end
        if used is not None:
            self.used = used
        return ids, np.add.reduceat(length, ends - many) if len(texts) else np.zeros(0, np.int64)


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    return ENCODERS[path] if path in ENCODERS else ENCODERS.setdefault(path, Encoder(path))


def pack_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """docs (doc_id, text, ...) to records of the packed format, written to the shared folder and read back as rows (part, seq, n_ids, record).

    Documents stand in ascending order of doc_id (null first; rows of one doc_id by text) by (part, seq) and within a record. Texts are range-partitioned by doc_id, a
    task encodes its range in order and cuts a record after RECORD_IDS ids, so a record's size is bounded by that and one document. A null or empty text gives its end
    id alone; an empty table gives no records. Other columns are not read. Records are stored through Spark's committer: a task that is run again leaves one copy.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_use("ids", ENCODERS.clear)
        enc, part, seq = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        doc_ids, counts, pieces, held = [], [], [], 0

        def record() -> pa.RecordBatch:
            data = write_record(doc_ids, counts, np.concatenate(pieces), enc.bits)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "n_ids", "record"])

        for b in small(batches):
            texts, of = b.column(1).cast(pa.binary()).to_pylist(), b.column(0).to_pylist()
            for k in range(0, len(texts), 128):
                ids, n = enc(texts[k : k + 128], end_id)
                doc_ids += of[k : k + 128]
                counts += n.tolist()
                pieces.append(ids)
                held += len(ids)
                if held >= RECORD_IDS:
                    yield record()
                    doc_ids, counts, pieces, held, seq = [], [], [], 0, seq + 1
        if doc_ids:
            yield record()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return saved(d.mapInArrow(encode, RECORD), "packed", "uncompressed", rows=512)  # packed ids don't compress; a record is read without unpacking others


def located(records: DataFrame) -> DataFrame:
    """(p, s, base): where the ids of each record begin among all ids. Only the records' sizes are read."""
    per = records.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each part
    parts = per.select(F.col("part").alias("p"), (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    within = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    places = records.select("part", "seq", "n_ids").withColumn("inner", F.sum("n_ids").over(within) - F.col("n_ids"))
    return places.join(parts, F.col("part") == F.col("p")).select(F.col("part").alias("p"), F.col("seq").alias("s"), (F.col("base") + F.col("inner")).alias("base"), "n_ids")


def tokens(records: DataFrame, start: int, end: int) -> DataFrame:
    """(start, ids): the ids from `start` up to `end` among all, in pieces by record. Records outside are not read, and of those inside only the blocks that hold them."""
    where = located(records).filter((F.col("base") < end) & (F.col("base") + F.col("n_ids") > start)).drop("n_ids")
    x = records.join(F.broadcast(where), (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).select("base", "record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                a = max(0, start - base)
                yield pa.RecordBatch.from_arrays([pa.array([base + a]), pa.array([Record(data.as_py()).ids(a, end - base).astype(np.int32)], pa.list_(pa.int32()))], ["start", "ids"])

    return x.mapInArrow(run, "start long, ids array<int>")


def unpacked(records: DataFrame) -> DataFrame:
    """Read records: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers)."""
    places = located(records).drop("n_ids")
    x = records.join(places, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s"))).select("base", "record")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_use("decode", lambda: None)  # words that encoding remembered go
        for b in batches:
            for base, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                r = Record(data.as_py())
                ids = memoryview(r.ids().astype("<u4")).cast("B")
                ends = np.cumsum(r.counts, dtype=np.int64)
                starts = ends - r.counts
                crc = [zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids, pa.int64(), mask=r.nulls.astype(bool)), pa.array(starts + base), pa.array(r.counts.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return saved(x.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long"), "unpacked", rows=4)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpacked(pack_tokens(read(spark, sf_dir, "documents"), tokenizer_file()))
