"""Token-ID output as sorted-string-table shards.

A shard holds documents in ascending key order:

    magic(8) | data blocks | block index | Bloom filter | footer(80) | 0x0A

A data block is a zstd frame over entries `varint shared | varint suffix length | varint value length | suffix |
value`; each key shares a prefix with the key before it, and the first key of a block is whole. The index has per
block its first key, offset, length, entries, and the tokens before it in the shard. A key is 0x00 for a null
identifier, else 0x01 and the identifier as 8 big-endian bytes with the sign bit flipped, so byte order is numeric
order. A value is the token ids, little-endian, 2 or 4 bytes each. The closing 0x0A is part of the format: Spark's
text writer puts it there, and that writer brings the file-commit protocol of every Hadoop store with it.

Defined cases: a null text is the empty text; repeated identifiers are repeated entries, ordered by text, and equal rows
are as many equal entries, which one task writes; a null
identifier sorts first; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from marlspike.llm.text import byte_chunks
from marlspike.operators.prefix import running
from marlspike.session import RECORDS, materialize, scratch_path, settings, ship

MAGIC = b"MSSTABL1"
#: index offset, index length, Bloom offset, Bloom length, documents, tokens, bytes per id, Bloom hashes, crc32 of
#: index and Bloom filter, reserved, magic.
FOOTER = struct.Struct(">QQQQQQQIIQ8s")
BLOCK_BYTES, SHARD_BYTES, BLOOM_BITS, BLOOM_HASHES = 64 << 10, 8 << 20, 10, 7
SIGN = 1 << 63
#: Texts in a batch that goes to Python.
TEXTS = 2048
#: A small letter, a run of what is neither letter nor digit, and the end of a piece; the run is a token run of its own.
TAIL = r"(\p{Ll})([!-/:-@\[-`{-~]+)( |$)"
#: ASCII characters that are neither letters nor digits nor white space.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + ((doc_id + SIGN) & (2**64 - 1)).to_bytes(8, "big")


def doc_of(key: bytes) -> int | None:
    return None if key == b"\x00" else int.from_bytes(key[1:], "big") - SIGN


def put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def bloom_positions(key: bytes, n_bits: int, hashes: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % n_bits for i in range(hashes)]


class ShardWriter:
    """Builds one shard in memory; entries must come in key order."""

    def __init__(self, id_bytes: int):
        self.id_bytes, self.body, self.block, self.index, self.keys = id_bytes, bytearray(MAGIC), bytearray(), [], []
        self.first = self.last = b""
        self.entries = self.tokens = self.tokens_before = 0
        self.zip = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        shared = len(os.path.commonprefix([self.last, key])) if self.entries else 0
        if not self.entries:
            self.first = key
        for n in (shared, len(key) - shared, len(value)):
            put_varint(self.block, n)
        self.block += key[shared:]
        self.block += value
        self.entries, self.last = self.entries + 1, key
        self.tokens += len(value) // self.id_bytes
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self.close_block()

    def close_block(self) -> None:
        if self.entries:
            packed = self.zip.compress(bytes(self.block))
            self.index.append((self.first, len(self.body), len(packed), self.entries, self.tokens_before))
            self.body += packed
            self.block, self.entries, self.tokens_before = bytearray(), 0, self.tokens

    def size(self) -> int:
        return len(self.body) + len(self.block)

    def finish(self) -> bytes:
        self.close_block()
        index = bytearray()
        for first, offset, length, entries, before in self.index:
            for n in (len(first), offset, length, entries, before):
                put_varint(index, n)
            index += first
        n_bits = max(64, -(-len(self.keys) * BLOOM_BITS // 8) * 8)
        bits = np.zeros(n_bits, np.uint8)
        for k in self.keys:
            bits[bloom_positions(k, n_bits, BLOOM_HASHES)] = 1
        bloom = np.packbits(bits).tobytes()
        at = len(self.body)
        check = zlib.crc32(bytes(index) + bloom)
        foot = FOOTER.pack(at, len(index), at + len(index), len(bloom), len(self.keys), self.tokens, self.id_bytes, BLOOM_HASHES, check, 0, MAGIC)
        return bytes(self.body + index) + bloom + foot


class Shard:
    """Reads one shard: whole, or one key through the Bloom filter and a binary search over the block index."""

    def __init__(self, data: bytes):
        self.data = data
        *head, self.n_docs, self.n_tokens, self.id_bytes, self.hashes, check, _, magic = FOOTER.unpack(data[-FOOTER.size - 1 : -1])
        index_at, index_len, bloom_at, bloom_len = head
        if magic != MAGIC or data[:8] != MAGIC or zlib.crc32(data[index_at : bloom_at + bloom_len]) != check:
            raise ValueError("not a whole shard")
        self.bloom, self.index, at = data[bloom_at : bloom_at + bloom_len], [], index_at
        while at < index_at + index_len:
            row = []
            for _ in range(5):
                n, at = get_varint(data, at)
                row.append(n)
            self.index.append((data[at : at + row[0]], *row[1:]))
            at += row[0]

    def entries(self, i: int):
        """(key, ids) of block i."""
        _, offset, length, entries, _ = self.index[i]
        block, at, key = zstandard.ZstdDecompressor().decompress(self.data[offset : offset + length]), 0, b""
        kind = "<u2" if self.id_bytes == 2 else "<u4"
        for _ in range(entries):
            shared, at = get_varint(block, at)
            fresh, at = get_varint(block, at)
            size, at = get_varint(block, at)
            key = key[:shared] + block[at : at + fresh]
            at += fresh
            yield key, np.frombuffer(block, kind, size // self.id_bytes, at)
            at += size

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in bloom_positions(key, len(self.bloom) * 8, self.hashes))

    def get(self, key: bytes) -> list[np.ndarray]:
        """Ids of every entry with this key."""
        if not self.may_hold(key):
            return []
        lo, hi = 0, len(self.index)
        while lo < hi:  # first block that starts at or after the key; the one before it can end with the key
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < key else (lo, mid)
        found = []
        for i in range(max(0, lo - 1), len(self.index)):
            if self.index[i][0] > key:
                break
            found += [ids for k, ids in self.entries(i) if k == key]
        return found


def plain(word: str) -> bool:
    """Letters alone, of scripts where lower case and composition leave letters alone."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250" and "\u0130" not in word)


class WordMemo:
    """Encodes texts with the tokenizer, one library call for each distinct space-separated piece.

    The tokenizer lower-cases, drops white space and never merges across it, so a text's ids are those of its folded
    pieces in a row; the tests hold this against whole-text encoding. A-Z is folded first, unless a special token's mark
    is in the text. Pieces over `longest` characters go to the library each time.
    """

    def __init__(self, path: str, id_bytes: int, end_id: int, limit: int = 500_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.limit, self.longest = Tokenizer.from_file(path), f"<u{id_bytes}", limit, longest
        self.end, self.memo = np.array([end_id], self.kind).tobytes(), {"": b""}
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 2, bool)
        self.closes[[i for w, i in vocabulary.items() if suffix and w.endswith(suffix)]] = True

    def words(self, words: list[str]) -> list[bytes]:
        """Words of letters alone go to the library as one text; each ends with a token that closes a word."""
        found = []
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int64)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(part):
                flat, ends = ids.astype(self.kind).tobytes(), (ends * int(self.kind[-1])).tolist()
                found += [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]
            else:
                found += self.call(part)
        return found

    def call(self, pieces: list[str]) -> list[bytes]:
        found = []
        for lo in range(0, len(pieces), 20_000):
            part = self.tokenizer.encode_batch_fast(pieces[lo : lo + 20_000], add_special_tokens=False)
            ids = [e.ids for e in part]
            flat = np.array([i for x in ids for i in x], self.kind).tobytes()
            ends = np.cumsum([len(x) for x in ids]) * int(self.kind[-1])
            found += [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text, with the end id. Arrow splits the texts and numbers their distinct pieces."""
        texts = pc.fill_null(texts, "")
        lines = pc.replace_substring(texts, "\n", " ")
        parted = pc.replace_substring_regex(pc.ascii_lower(lines), TAIL, r"\1 \2\3")
        pieces = pc.split_pattern(pc.if_else(pc.match_substring(lines, "<|"), lines, parted), " ")
        coded = pieces.flatten().dictionary_encode()
        seen, number = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        value = [*map(self.memo.get, seen)]
        fresh = [i for i, v in enumerate(value) if v is None]
        for i, v in zip(fresh, self.learn([seen[i] for i in fresh])):
            value[i] = v
        width = int(self.kind[-1])
        flat, size = np.frombuffer(b"".join(value), self.kind), np.fromiter(map(len, value), np.int64, len(value)) // width
        first, each = np.cumsum(size) - size, size[number]
        upto = np.cumsum(each)
        ids = flat[np.repeat(first[number] - upto + each, each) + np.arange(upto[-1] if len(upto) else 0)].tobytes()
        ends = (np.r_[0, upto][pieces.offsets.to_numpy() - pieces.offsets[0].as_py()] * width).tolist()
        return [ids[a:b] + self.end for a, b in zip(ends, ends[1:])]

    def learn(self, fresh: list[str]) -> list[bytes]:
        """Ids of pieces that the memo lacks; those of up to `longest` characters are kept in it."""
        if len(self.memo) > self.limit:  # the older half goes
            self.memo = {"": b""} | dict(islice(self.memo.items(), len(self.memo) // 2, None))
        memo, letters, others, tails = self.memo, set(), set(), []
        for p in fresh:
            head = p.rstrip(PUNCTUATION)
            if not plain(head):
                others.add(p)
                continue
            if head not in memo:
                letters.add(head)
            if len(head) < len(p):  # what follows letters alone is a run of its own
                tail = p[len(head) :]
                tails.append((p, head, tail))
                if tail not in memo:
                    others.add(tail)
        letters, others = [*letters], [*others]
        memo |= zip(letters, self.words(letters))
        memo |= zip(others, self.call(others))
        memo |= [(p, memo[head] + memo[tail]) for p, head, tail in tails]
        found = [memo[p] for p in fresh]
        for p in [p for p in (*letters, *others, *fresh) if len(p) > self.longest]:
            memo.pop(p, None)
        return found


@functools.lru_cache(maxsize=2)
def memo_for(path: str, id_bytes: int, end_id: int) -> WordMemo:
    return WordMemo(path, id_bytes, end_id)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_bytes: int = 2, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write `docs` as shards under `path`, ascending by identifier over all shards.

    The range shuffle moves each text once, before it is tokenized. The text's hash is a second range key, so even one
    identifier with a third of the rows is split. A task holds one shard of about `shard_bytes`.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    ordered = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h", "t").select("k", "t")

    def shards(batches):
        memo, w = memo_for(tokenizer, id_bytes, end_id), ShardWriter(id_bytes)
        for b in batches:
            for lo, hi in byte_chunks(b.column(1), 3_000_000):
                for doc, value in zip(b.column(0)[lo:hi].to_pylist(), memo.encode(b.column(1)[lo:hi])):
                    w.add(key_of(doc), value)
                    if w.size() >= shard_bytes:
                        yield pa.record_batch([pa.array([w.finish()], pa.binary())], ["shard"])
                        w = ShardWriter(id_bytes)
        if w.keys:
            yield pa.record_batch([pa.array([w.finish()], pa.binary())], ["shard"])
        pa.default_memory_pool().release_unused()  # the worker lives on

    out = ordered.mapInArrow(shards, "shard binary").select(F.col("shard").cast("string").alias("value"))
    with settings(docs.sparkSession, {RECORDS: str(TEXTS)}):
        out.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    """Shards in order: `no` (task and file number), path, content. Empty files hold no shard."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where(F.col("length") > FOOTER.size)
    number = [F.regexp_extract("path", r"part-(\d+)-.*-c(\d+)", i).cast("long") for i in (1, 2)]
    return files.select(F.struct(number[0].alias("task"), number[1].alias("file")).alias("no"), "path", "content")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the shards themselves: doc_id, start, n_tokens, ids_crc32.

    Each shard is read once. `start` is a sum in three levels: over ranges of shards, over the shards of a range, and
    inside the shard.
    """
    ship(spark)
    files = shard_files(spark, path).select("no.task", "no.file", "content")

    def decode(batches):
        for b in batches:
            for task, file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                shard, rows, at = Shard(data.as_py()), [], 0
                for i in range(len(shard.index)):
                    for key, ids in shard.entries(i):
                        rows.append((task, file, doc_of(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], ["task", "file", "doc_id", "local", "n_tokens", "ids_crc32"])

    docs = materialize(files.mapInArrow(decode, "task long, file long, doc_id long, local long, n_tokens long, ids_crc32 long"), "index")
    totals = docs.groupBy("task", "file").agg(F.sum("n_tokens").alias("total"))
    base = running(totals, [F.col("task"), F.col("file")], F.col("total"), "upto").select("task", "file", (F.col("upto") - F.col("total")).alias("base"))
    return docs.join(base, ["task", "file"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of a given, bounded list of documents: doc_id, ids. Shards are asked in parallel; blocks are decoded on a hit only."""
    ship(spark)
    keys = [(d, key_of(d)) for d in sorted({*doc_ids})]

    def find(batches):
        for b in batches:
            for data in b.column(0):
                shard = Shard(data.as_py())
                hits = [(d, ids.tolist()) for d, k in keys for ids in shard.get(k)]
                yield pa.record_batch([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return shard_files(spark, path).select("content").mapInArrow(find, "doc_id long, ids array<int>")


def write_and_index(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Write the shards (into the shared folder unless `path` says where) and read their index back."""
    path = path or scratch_path(spark, "sstable")
    write(docs, path, tokenizer, end_id)
    return read_index(spark, path)
