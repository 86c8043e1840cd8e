"""Byte-level BPE encoding and decoding by one global shuffle of distinct words.

Texts are split into pre-tokens. A block of texts numbers its distinct pre-tokens ("words") by first use and keeps, for
every text, the word numbers by position. Only the distinct words of a block travel: they are dealt by hash into
buckets, a bucket meets the same words of all blocks, encodes each distinct word once, and sends each block the ids of
its words. There ids are joined back by word number and laid out by position. The ids then meet the token-byte table
again, which gives the decoded bytes.

No word can be hot, since a block lists it once however often its texts use it. Rows of the shuffles are packed: a row
holds all words of one block and bucket, so its size follows the block, not the corpus.

Defined cases: a null or empty text has no ids; repeated rows and ids are kept, each with its own ids; an empty table
gives an empty result; texts of any length stay whole (one longer than a block makes a block of its own).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirekit.llm.common import shuffle_partitions, texts_of

#: Text bytes of a block.
BLOCK_BYTES = 8 << 20
_WORDS = "block long, bucket int, words binary"
_PARTS = "block long, bucket int, doc_ids array<long>, body binary"


@cache
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern)


@cache
def load_ranks(file: str) -> dict[bytes, int]:
    with open(file, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@cache
def _encoding(file: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=load_ranks(file), special_tokens={})


@cache
def token_table(file: str) -> tuple[np.ndarray, np.ndarray]:
    """Token bytes end to end, and where each id's begin."""
    ranks = load_ranks(file)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    begin = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum([len(t) for t in tokens], out=begin[1:])
    return np.frombuffer(b"".join(tokens), np.uint8), begin


def gathered(source: np.ndarray, begin: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``source[begin[p]:begin[p + 1]]`` for each p of ``pick`` end to end, and the ends of the runs."""
    lengths = begin[pick + 1] - begin[pick]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return source[np.arange(total) + np.repeat(begin[pick] - (ends - lengths), lengths)], ends


def decoded(ids: np.ndarray, file: str) -> bytes:
    """The bytes of ids, by the token-byte table."""
    return gathered(*token_table(file), np.asarray(ids, np.int64))[0].tobytes()


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    raw = [a if isinstance(a, bytes) else np.ascontiguousarray(a, "<u4").tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(r) for r in raw], "<u4").tobytes() + b"".join(raw))


def _unpack(blob: bytes, count: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    ends = np.cumsum(np.r_[4 * count, np.frombuffer(raw, "<u4", count)])
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _planes(values: np.ndarray) -> bytes:
    """Low bytes first, then the next: numbers by first use are small, so the higher planes compress to little."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


class _Numbers(dict):
    """Words numbered by first use."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[tuple[list, list[np.ndarray], list[str]]]:
    """``(ids of documents, word numbers of each text, distinct words)`` of every block of a partition."""
    split, size = _splitter(pattern).findall, 0
    docs, texts, words = [], [], _Numbers()
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if docs and size + len(text) > BLOCK_BYTES:
                yield docs, texts, list(words)
                size, docs, texts, words = 0, [], [], _Numbers()
            docs.append(doc)
            texts.append(np.array([words[w] for w in split(text)], np.uint32))
            size += len(text)
    if docs:
        yield docs, texts, list(words)


def _bucket_of(words: list[bytes], buckets: int) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh32_intdigest(w) for w in words], np.int64) % buckets


def encode_documents(docs: DataFrame, file: str, pattern: str, decode: bool = False) -> DataFrame:
    """``doc_id, ids``: token ids of every text as packed unsigned 32-bit little-endian numbers.

    With ``decode`` also ``decoded``, read off the token-byte table while the ids are at hand.
    """
    spark = docs.sparkSession
    buckets = shuffle_partitions(spark)
    # Both branches cut the same rows into the same blocks. A block is named by its list of words, which fixes their
    # numbers, so rows that came in another order (an input recomputed after a shuffle) fail to meet instead of meeting
    # wrongly, and blocks with the same list may share its ids.
    rows = texts_of(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id")

    def name_of(words: list[str]) -> int:
        import xxhash

        return xxhash.xxh64_intdigest("\0".join(words).encode()) >> 1

    def to_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, words in _blocks(batches, pattern):
            name, raw = name_of(words), [w.encode() for w in words]
            bucket = _bucket_of(raw, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in range(buckets):
                some = order[cuts[b] : cuts[b + 1]]
                if len(some):
                    picked = [raw[i] for i in some]
                    blob = _pack(some, np.array([len(w) for w in picked]), b"".join(picked))
                    yield pa.record_batch([pa.array([name]), pa.array([b], pa.int32()), pa.array([blob], pa.binary())],
                                          ["block", "bucket", "words"])

    def to_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known, at = _encoding(file, pattern).encode_ordinary, {}, None
        for batch in batches:
            for block, bucket, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket != at:
                    known, at = {}, bucket
                places, lengths, text = _unpack(blob, 3)
                ids, counts, start = [], [], 0
                for n in np.frombuffer(lengths, "<u4").tolist():
                    word = text[start : start + n]
                    start += n
                    got = known.get(word)
                    if got is None:
                        got = known[word] = encode(word.decode())
                    ids += got
                    counts.append(len(got))
                body = _pack(places, np.array(counts), _planes(np.array(ids, np.uint32)))
                yield pa.record_batch([pa.array([block]), pa.array([bucket], pa.int32()), pa.array([None], pa.list_(pa.int64())),
                                       pa.array([body], pa.binary())], ["block", "bucket", "doc_ids", "body"])

    def to_positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, words in _blocks(batches, pattern):
            body = _pack(np.array([len(t) for t in texts]), _planes(np.concatenate(texts)), np.array([len(words)]))
            yield pa.record_batch([pa.array([name_of(words)]), pa.array([-1], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                                   pa.array([body], pa.binary())], ["block", "bucket", "doc_ids", "body"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Block | None = None
        table = token_table(file) if decode else None
        for batch in batches:
            for row in range(batch.num_rows):
                block, bucket, body = (batch.column(i)[row].as_py() for i in (0, 1, 3))
                if held is None or block != held.name:
                    if held:
                        yield from held.laid_out(table)
                    held = _Block(block)
                # Positions come first (bucket -1); words of blocks with the same list come once for each of them.
                if bucket < 0:
                    held.add_positions(batch.column(2)[row].values, body)
                elif bucket != held.last_bucket:
                    held.add_words(bucket, body)
        if held:
            yield from held.laid_out(table)

    words = rows.mapInArrow(to_words, _WORDS).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    ids = words.mapInArrow(to_ids, _PARTS)
    positions = rows.mapInArrow(to_positions, _PARTS)
    parts = ids.unionByName(positions).repartition(buckets, "block").sortWithinPartitions("block", "bucket")
    return parts.mapInArrow(assemble, "doc_id long, ids binary" + (", decoded binary" if decode else ""))


class _Block:
    """What has come for one block: positions of its texts, and ids of its words."""

    def __init__(self, name: int):
        self.name, self.last_bucket, self.words = name, -1, -1
        self.texts: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        none = np.zeros(0, np.uint32)
        self.places, self.counts, self.ids = [none], [none], [none]

    def add_positions(self, docs: pa.Array, body: bytes) -> None:
        lengths, numbers, count = _unpack(body, 3)
        self.texts.append((docs, np.frombuffer(lengths, "<u4"), _from_planes(numbers)))
        self.words = int(np.frombuffer(count, "<u4")[0])

    def add_words(self, bucket: int, body: bytes) -> None:
        places, counts, ids = _unpack(body, 3)
        self.last_bucket = bucket
        self.places.append(np.frombuffer(places, "<u4"))
        self.counts.append(np.frombuffer(counts, "<u4"))
        self.ids.append(_from_planes(ids))

    def laid_out(self, table: tuple[np.ndarray, np.ndarray] | None, step: int = 1 << 18) -> Iterator[pa.RecordBatch]:
        """Ids of the texts: the words' ids by number, then by position; about ``step`` words at a time."""
        places, counts = np.concatenate(self.places).astype(np.int64), np.concatenate(self.counts).astype(np.int64)
        if len(places) != self.words:
            raise ValueError("positions and words of a block do not fit: its rows came in another order the second time")
        source = np.concatenate(self.ids)
        # Words in order of number: where the ids of each begin, as in a table of runs.
        order = np.argsort(places)
        runs = np.r_[0, np.cumsum(counts[order])]
        source, _ = gathered(source, np.r_[0, np.cumsum(counts)], order)
        for docs, lengths, numbers in self.texts:
            ends = np.cumsum(lengths.astype(np.int64))
            first = 0
            while first < len(ends):
                low = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, low + step, "right")))
                some = ends[first:last]
                ids, stop = gathered(source, runs, numbers[low : int(some[-1])].astype(np.int64))
                marks = np.r_[0, np.r_[0, stop][some - low]]
                columns = [docs.slice(first, last - first), _parts(ids.astype("<u4").view(np.uint8), marks * 4)]
                if table:
                    text, close = gathered(*table, ids.astype(np.int64))
                    columns.append(_parts(text, np.r_[0, close][marks]))
                yield pa.record_batch(columns, ["doc_id", "ids", "decoded"][: len(columns)])
                first = last


def _parts(data: np.ndarray, marks: np.ndarray) -> pa.Array:
    """A binary column whose values lie end to end in ``data``."""
    buffers = [None, pa.py_buffer(marks.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.binary(), len(marks) - 1, buffers)


def decode_documents(encoded: DataFrame, file: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded``: each text's bytes, read off the token-byte table (50,256 rows in the query)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decoded(np.frombuffer(ids, "<u4"), file) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, file: str, pattern: str) -> DataFrame:
    """Per document: how many ids, and digests of the ids and of the bytes they decode to."""
    both = encode_documents(docs, file, pattern, decode=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def sha256_of(ids: list[int]) -> str:
    """What ``ids_sha256`` is for a list of ids."""
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
