"""Cross-tokenizer alignment with an identity-map fast path.

Two tokenizers cut the same bytes. Offsets where tokens of both end cut them into groups, and every pair of overlapping
tokens is a link. A table from each id of A to the id of B with the same bytes is made once; groups of one such pair are
only counted, in a vector as long as A's vocabulary, and never become rows. The links of all other groups are counted as
pairs, summed per block of documents before the shuffle, then over the corpus.

Texts are cut into units, white space and the word behind it, at places that no token of either vocabulary spans; each
distinct unit is encoded and aligned once and kept in a bounded store, so a text costs a look-up for each of its words. A
text in which such places cannot be told (other white space, the piece model's own space sign) is one unit. A block holds
its documents' unit numbers and its units' links; it ends early where the store is full, so a worker's memory does not hang
on how many units a text has. Corpus-wide counts come back to a block as the counts of the pairs it
holds, so a frequent pair is one row for each block and never one for each document. Only vectors as long as a
vocabulary reach the driver.

Defined cases: null and empty texts, and texts whose joined tokens of either side differ from a space and the text, have
no tokens (zeros, empty digest) and count in no pair; strings of special tokens are plain text; repeated rows each count;
a null id stays null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import ctypes
import hashlib
import json
import os
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirekit.llm.common import stored, texts_of
from quirekit.llm.wordhash import slices

#: Text bytes of a block, and bytes of units that a worker may hold.
BLOCK_BYTES, STORE_BYTES = 8 << 20, 96 << 20
#: Bytes that a unit takes besides its text, groups and links: the entries of a dictionary, a list and six arrays.
_UNIT_BYTES = 240
_WORK_BYTES = 1 << 20
_JOINED_CHARS = 1 << 16
#: Characters that some engine counts as white space, and the sign that stands for a space in pieces (parts of a class).
WIDE_BLANKS = ["\t", "\n", "\v", "\f", "\r", "\x1c-\x1f", "\x85", "\xa0", "\u1680", "\u180e", "\u2000-\u200f", "\u2028", "\u2029", "\u202f", "\u205f", "\u2060", "\u3000", "\ufeff", "\u2581"]
#: Those of them that all engines count as such; units may be cut before one if no piece holds it.
PLAIN_BLANKS = "\t\n"

BLOCK_SCHEMA = (
    "block long, doc_ids array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, digests array<string>, "
    "sizes array<int>, units binary, link_counts binary, link_a binary, link_b binary, link_same binary")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def release() -> None:
    """Hand freed memory back to the system, which else counts it to the worker for as long as that lives."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Growing:
    """An array that is appended to."""

    def __init__(self, dtype) -> None:
        self.room, self.size = np.zeros(1024, dtype), 0

    def append(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.room):
            self.room = np.concatenate([self.room[: self.size], np.zeros(need, self.room.dtype)])
        self.room[self.size : need] = values
        self.size = need

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.size]


def spread_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges ``start .. start + count - 1``, one range after the other."""
    begin = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(begin - starts, counts)


class Aligner:
    """Both tokenizers, their byte tables and the store of units met so far."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as file:
            model = json.load(file)
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in model["model"]["vocab"].items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token)
        for added in model.get("added_tokens", []):
            self.a_bytes[added["id"]] = added["content"].encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        # Of a byte piece and a piece of one character the latter is what ordinary text gives.
        same = {t: i for i, t in enumerate(self.b_bytes) if self.b.is_byte(i)} | {t: i for i, t in enumerate(self.b_bytes) if not self.b.is_byte(i)}
        self.identity = np.array([same.get(t, -1) for t in self.a_bytes], np.int64)
        self.kind = np.uint16 if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else np.uint32
        numbers_a, numbers_b = ([str(i).encode() for i in range(len(t))] for t in (self.a_bytes, self.b_bytes))
        self.printed = [*(n + b"," for n in numbers_a), *(n + b"|" for n in numbers_a), *(n + b"," for n in numbers_b), *(n + b";" for n in numbers_b)]
        cuts = [c for c in PLAIN_BLANKS if not any(c in p for p in pieces if len(p) > 1)]
        whole = any("▁" in p[1:] and set(p) != {"▁"} for p in pieces)
        blanks = " " + "".join(cuts)
        self.unit = re.compile(f"[{blanks}]*[^{blanks}]+|[{blanks}]+") if not whole else re.compile("(?s).+")
        self.odd = re.compile("[" + "".join(c for c in WIDE_BLANKS if c not in cuts) + "]")
        self.lead = len(self.b.encode("a"))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes_kept = 0
        self.groups: list[bytes] = []
        self.good, self.n_a, self.n_b, self.n_groups, self.n_links = (Growing(t) for t in (bool, np.int64, np.int64, np.int64, np.int64))
        self.link_a, self.link_b, self.link_same, self.link_end = Growing(self.kind), Growing(self.kind), Growing(bool), Growing(np.int64)

    def units_of(self, text: str) -> list[str]:
        """The units of a space and the text; none for a text without characters."""
        if not text:
            return []
        text = " " + text
        return [text] if self.odd.search(text) else self.unit.findall(text)

    def numbers_of(self, units: list[str]) -> np.ndarray:
        """The units' numbers in the store, new ones encoded and aligned first."""
        new = [u for u in dict.fromkeys(units) if u not in self.known]
        if new:
            self._learn(new)
        return np.fromiter(map(self.known.__getitem__, units), np.int32, len(units))

    def _alone(self, unit: str) -> tuple[list[int], list[int]] | None:
        """Ids of one unit by both tokenizers, or nothing if the bytes of either differ from it."""
        a = self.a.encode(unit, add_special_tokens=False).ids
        b = self.b.encode("a" + unit, num_threads=1)[self.lead :]
        raw = unit.encode()
        return (a, b) if b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b_bytes[i] for i in b]) else None

    def _together(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of units laid side by side, and how many each has; nothing if a unit does not end where tokens end."""
        joined = "".join(units)
        raw = joined.encode()
        ends = np.cumsum([len(u) for u in units] if joined.isascii() else [len(u.encode()) for u in units])
        out = []
        for ids, table, sizes in (
            (self.a.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.a_bytes, self.a_sizes),
            (self.b.encode("a" + joined, num_threads=1)[self.lead :], self.b_bytes, self.b_sizes),
        ):
            if b"".join(map(table.__getitem__, ids)) != raw:
                return None
            ids = np.array(ids, np.int64)
            token_ends = np.cumsum(sizes[ids])
            at = np.searchsorted(token_ends, ends)
            if (token_ends[at] != ends).any():
                return None
            out += [ids, np.diff(at, prepend=-1)]
        return tuple(out)

    def _learn(self, units: list[str]) -> None:
        # A unit of white space alone or one with other blanks would read differently with a unit behind it.
        single = [u for u in units if u.isspace() or self.odd.search(u)]
        apart = set(single)
        rest = [u for u in units if u not in apart]
        start = 0
        while start < len(rest):
            stop, chars = start, 0
            while stop < len(rest) and (chars < _JOINED_CHARS or stop == start):
                chars += len(rest[stop])
                stop += 1
            some = rest[start:stop]
            got = self._together(some)
            if got is None:
                single += some
            else:
                self._store(some, np.ones(len(some), bool), *got)
            start = stop
        if single:
            got = [self._alone(u) for u in single]
            good = np.array([g is not None for g in got])
            got = [g or ([], []) for g in got]
            a, b = (np.array([i for g in got for i in g[side]], np.int64) for side in (0, 1))
            self._store(single, good, a, np.array([len(g[0]) for g in got]), b, np.array([len(g[1]) for g in got]))

    def _store(self, units: list[str], good: np.ndarray, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> None:
        at = len(self.known)
        self.known.update(zip(units, range(at, at + len(units)), strict=True))
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        # Between two neighbouring ends of either side lies just one overlapping pair.
        ends = np.union1d(ends_a, ends_b)
        of_a, of_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        shared = (ends_a[of_a] == ends) & (ends_b[of_b] == ends) if len(ends) else np.zeros(0, bool)
        link_a, link_b = a[of_a], b[of_b]
        one_to_one = shared & np.r_[True, shared[:-1]][: len(shared)]
        unit = np.repeat(np.arange(len(units)), n_a)[of_a]
        n_links, n_groups = np.bincount(unit, minlength=len(units)), np.bincount(unit[shared], minlength=len(units))
        self.link_a.append(link_a)
        self.link_b.append(link_b)
        self.link_same.append(one_to_one & (self.identity[link_a] == link_b))
        self.link_end.append(self.link_a.size - len(link_a) + np.cumsum(n_links))
        for held, values in ((self.good, good), (self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups), (self.n_links, n_links)):
            held.append(values)
        # Printed groups: the ids of A, then those of B, each with the sign behind it.
        group = np.cumsum(shared) - shared
        group_a, group_b = group[np.searchsorted(ends, ends_a)], group[np.searchsorted(ends, ends_b)]
        codes = np.zeros(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + len(self.a_bytes) * np.r_[group_a[1:] != group_a[:-1], True][: len(a)]
        codes[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = (
            2 * len(self.a_bytes) + b + len(self.b_bytes) * np.r_[group_b[1:] != group_b[:-1], True][: len(b)])
        parts = list(map(self.printed.__getitem__, codes.tolist()))
        stops = np.cumsum(n_a + n_b).tolist()
        groups = [b"".join(parts[s:e])[:-1] for s, e in zip([0, *stops[:-1]], stops, strict=True)]
        self.groups += groups
        self.bytes_kept += sum(map(sys.getsizeof, units)) + sum(map(sys.getsizeof, groups)) + _UNIT_BYTES * len(units)
        self.bytes_kept += len(link_a) * (2 * np.dtype(self.kind).itemsize + 1)


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def planes(values: np.ndarray) -> bytes:
    """32-bit numbers as four runs of bytes, lowest first: small numbers leave runs of zeros."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class Block:
    """Documents gathered until they fill a block."""

    def __init__(self, known: Aligner) -> None:
        self.known, self.size = known, 0
        self.ids: list[pa.Array] = []
        self.digests: list[str] = []
        self.sizes: list[np.ndarray] = []
        self.numbers: list[np.ndarray] = []
        self.sums: list[list[np.ndarray]] = []

    def add(self, ids: pa.Array, texts: list[str]) -> None:
        known = self.known
        units = [known.units_of(t) for t in texts]
        sizes = np.array([len(u) for u in units], np.int64)
        numbers = known.numbers_of([u for some in units for u in some])
        first = np.r_[0, np.cumsum(sizes)]
        by_text = lambda values: np.diff(np.r_[0, np.cumsum(values)][first])
        bad = by_text(~known.good.values[numbers]) > 0
        numbers, sizes = numbers[~np.repeat(bad, sizes)], np.where(bad, 0, sizes)
        first = np.r_[0, np.cumsum(sizes)]
        self.sums.append([by_text(held.values[numbers]) for held in (known.n_a, known.n_b, known.n_groups, known.n_links)])
        groups, listed = known.groups, numbers.tolist()
        for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            self.digests.append(hashlib.sha256(b";".join([groups[i] for i in listed[low:high]])).hexdigest() if high > low else "")
        self.ids.append(ids.cast(pa.int64()))
        self.sizes.append(sizes)
        self.numbers.append(numbers)
        self.size += sum(map(len, texts))

    def row(self, number: int) -> pa.RecordBatch:
        known = self.known
        numbers = np.concatenate(self.numbers)
        counts = np.bincount(numbers, minlength=known.good.size)
        distinct = np.flatnonzero(counts)
        # Frequent units get small numbers, which take fewer bytes.
        distinct = distinct[np.argsort(-counts[distinct], kind="stable")]
        rank = np.zeros(known.good.size, np.uint32)
        rank[distinct] = np.arange(len(distinct))
        n_links = known.n_links.values[distinct]
        at = spread_ranges(known.link_end.values[distinct] - n_links, n_links)
        lists = [np.concatenate([s[i] for s in self.sums]) for i in range(4)]
        columns = [
            pa.array([number]), pa.array([pa.concat_arrays(self.ids).to_pylist()], pa.list_(pa.int64())),
            *(pa.array([v.astype(np.int32)], pa.list_(pa.int32())) for v in lists),
            pa.array([self.digests], pa.list_(pa.string())), pa.array([np.concatenate(self.sizes).astype(np.int32)], pa.list_(pa.int32())),
            *(pa.array([b], pa.binary()) for b in (
                planes(rank[numbers]), planes(n_links), known.link_a.values[at].tobytes(), known.link_b.values[at].tobytes(), np.packbits(known.link_same.values[at]).tobytes()))]
        return pa.record_batch(columns, [c.strip().split(" ")[0] for c in BLOCK_SCHEMA.split(",")])


def _blocks(batches: Iterator[pa.RecordBatch], known: Aligner, number: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's documents, numbered from ``number``; units are numbered by the store, so a block ends where that is full."""
    block = Block(known)
    for whole in batches:
        for batch in slices(whole, "text", min(_WORK_BYTES, block_bytes)):
            block.add(batch.column(0), batch.column(1).to_pylist())
            if block.size >= block_bytes or known.bytes_kept > STORE_BYTES:
                row = block.row(number)
                block = Block(known)
                number += 1
                # A store more than half full would end the next block before its time.
                if known.bytes_kept > STORE_BYTES // 2:
                    known.forget()
                release()
                yield row
    if block.ids:
        yield block.row(number)


def encode_blocks(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each block of documents, see ``BLOCK_SCHEMA``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _blocks(batches, aligner(a_path, b_path), TaskContext.get().partitionId() << 32, block_bytes)

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts_of(named, "doc_id").mapInArrow(run, BLOCK_SCHEMA)


def _links(batch: pa.RecordBatch, row: int, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of a block's units: how many each has, ids of A and B, and which are of the identity map."""
    counts = from_planes(batch.column("link_counts")[row].as_py())
    a, b = (np.frombuffer(batch.column(c)[row].as_py(), kind).astype(np.int64) for c in ("link_a", "link_b"))
    same = np.unpackbits(np.frombuffer(batch.column("link_same")[row].as_py(), np.uint8), count=len(a)).astype(bool)
    return counts, a, b, same


def _counted(batches: Iterator[pa.RecordBatch], kind, identity: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``block, code, n`` of blocks."""
    # Blocks are all that is needed from here on: the worker lets go of tokenizers and units.
    aligner.cache_clear()
    release()
    vector = np.zeros(len(identity), np.int64)
    for batch in batches:
        for row in range(batch.num_rows):
            counts, a, b, same = _links(batch, row, kind)
            times = np.repeat(np.bincount(from_planes(batch.column("units")[row].as_py()), minlength=len(counts)), counts)
            np.add.at(vector, a[same], times[same])
            codes, inverse = np.unique(a[~same] << 32 | b[~same], return_inverse=True)
            n = np.zeros(len(codes), np.int64)
            np.add.at(n, inverse.ravel(), times[~same])
            number = batch.column("block")[row].as_py()
            yield pa.record_batch([pa.array(np.full(len(codes), number, np.int64)), pa.array(codes), pa.array(n)], ["block", "code", "n"])
    held = np.flatnonzero(vector)
    yield pa.record_batch([pa.nulls(len(held), pa.int64()), pa.array(held << 32 | identity[held]), pa.array(vector[held])], ["block", "code", "n"])


def count_pairs(blocks: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``block, code, n``: pairs of irregular groups by block; pairs of the identity map by task, without a block.

    A code is the id of A times 2^32 and the id of B.
    """
    known = Aligner(a_path, b_path)
    kind, identity = known.kind, known.identity
    return blocks.select("block", "units", "link_counts", "link_a", "link_b", "link_same").mapInArrow(
        lambda batches: _counted(batches, kind, identity), "block long, code long, n long")


class Alignment:
    """Blocks, counts by block and corpus-wide counts, all stored in the shared folder."""

    def __init__(self, docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> None:
        self.paths = a_path, b_path
        # A block is megabytes: as many as Parquet gathers to a row group would be written, and read again, at once.
        self.blocks = stored(encode_blocks(docs, a_path, b_path, block_bytes), "align-blocks", **{"parquet.block.row.count.limit": "1"})
        self.counts = stored(count_pairs(self.blocks, a_path, b_path), "align-counts")
        self.totals = stored(self.counts.groupBy("code").agg(F.sum("n").alias("n")), "align-totals")

    def pairs(self) -> DataFrame:
        """``a_id, b_id, n, best``: every linked pair, its count, and whether no pair of that id of B has more."""
        split = self.totals.select(F.shiftright("code", 32).alias("a_id"), F.col("code").bitwiseAND(0xFFFFFFFF).alias("b_id"), "n")
        most = split.groupBy("b_id").agg(F.max("n").alias("most"))
        # The maxima are as many as B has ids.
        return split.join(F.broadcast(most), "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))

    def documents(self) -> DataFrame:
        """The contract's row for each document."""
        spark, paths = self.blocks.sparkSession, self.paths
        known = Aligner(*paths)
        most = np.zeros(len(known.b_bytes), np.int64)
        for row in self.totals.groupBy(F.col("code").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("n").alias("n")).collect():
            most[row.b] = row.n
        vector = np.zeros(len(known.a_bytes), np.int64)
        mapped = np.flatnonzero(known.identity >= 0)
        codes = spark.createDataFrame([(int(c),) for c in mapped << 32 | known.identity[mapped]], "code long")
        for row in self.totals.join(F.broadcast(codes), "code").collect():
            vector[row.code >> 32] = row.n
        kind = known.kind
        del known
        sizes = spark.sparkContext.broadcast((most, vector))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            aligner.cache_clear()
            release()
            most, vector = sizes.value
            for batch in batches:
                for row in range(batch.num_rows):
                    counts, a, b, same = _links(batch, row, kind)
                    total = np.where(same, vector[a], 0)
                    got = batch.column("pairs")[row]
                    if got.is_valid:
                        codes, n = (got.values.field(i).to_numpy() for i in (0, 1))
                        order = np.argsort(codes)
                        total[~same] = n[order][np.searchsorted(codes[order], a[~same] << 32 | b[~same])]
                    sums = np.r_[0, np.cumsum(total)], np.r_[0, np.cumsum(total == most[b])]
                    stop = np.cumsum(counts)
                    of_unit = [s[stop] - s[stop - counts] for s in sums]
                    units = from_planes(batch.column("units")[row].as_py())
                    first = np.r_[0, np.cumsum(batch.column("sizes")[row].values.to_numpy())]
                    count_sum, n_best = (np.diff(np.r_[0, np.cumsum(v[units])][first]) for v in of_unit)
                    held = lambda c: batch.column(c)[row].values  # noqa: B023, E731
                    yield pa.record_batch(
                        [held("doc_ids"), *(held(c).cast(pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(n_best), pa.array(count_sum), held("digests")],
                        ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

        # A block gets the counts of the pairs it holds, at most as many as it has links.
        found = self.counts.where("block IS NOT NULL").select("block", "code").join(self.totals, "code")
        per_block = found.groupBy("block").agg(F.collect_list(F.struct("code", "n")).alias("pairs"))
        joined = self.blocks.join(per_block, "block", "left")
        return joined.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align_documents(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    return Alignment(docs, a_path, b_path, block_bytes).documents()
