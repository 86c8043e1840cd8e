"""Token ids as binary files: frequency-ranked ids, byte-aligned variable length, control bytes apart from the data.

Ids are replaced by their rank in the corpus (commonest first), so most take one byte. Four values share a control byte
of four 2-bit lengths; the data bytes follow in a stream of their own. A control byte indexes a table of 16 source
places, so numpy decodes a whole block with two gathers and no loop.

A file set is a Parquet folder of blocks in ascending document order (``blocks``: range, place in the range, document
ids, lengths, control, data) and the rank table (``ranks``). Spark writes and reads both, so a lost task is repeated and
only committed files are seen; any store that Spark reaches will do.

Defined cases: a null text is empty; an empty text is the end id alone; rows with equal ids keep their place by text;
a null id comes first; an empty table writes an empty file set.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirekit.llm.common import range_bounds, range_bucket, shuffle_partitions, texts_of
from quirekit.llm.wordhash import slices
from quirekit.session import ensure_checkpoint_dir

END_ID = 2
#: Ids of a block (a longer document makes a longer block); words a worker remembers.
BLOCK_IDS, REMEMBERED = 1 << 18, 800_000
_WORK_BYTES = 2 << 20
#: Characters whose splitting and lower case are the same in every Unicode version; other texts go to the tokenizer whole.
#: Of numbers the plain set holds 0-9 alone.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-įĲ-ȳ‐-―‘-‧€™Ѐ-ҁぁ-ゖァ-ヺ一-龥]")
#: The file's split pattern, and the same one for texts of the plain set in the faster pattern engine.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_SPECIAL = "<|"


# --- Byte-aligned variable-length coding ------------------------------------------------


def encode(values: np.ndarray) -> tuple[bytes, bytes]:
    """``(control, data)`` of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    padded = np.zeros(-(-len(values) // 4) * 4, "<u4")
    padded[: len(values)] = values
    lengths = 1 + (padded > 0xFF) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    codes = (lengths - 1).astype(np.uint8).reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    kept = np.arange(4) < lengths[:, None]
    return control.tobytes(), padded.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each control byte: bytes it covers, source place of each of 16 output bytes, which of them are used."""
    codes = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
    lengths = codes + 1
    starts = np.cumsum(lengths, axis=1) - lengths
    used = np.arange(4) < lengths[:, :, None]
    places = np.where(used, starts[:, :, None] + np.arange(4), 0)
    return lengths.sum(axis=1), places.reshape(256, 16), used.reshape(256, 16)


_COVERED, _PLACES, _USED = _tables()


def decode(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The first ``count`` values."""
    codes = np.frombuffer(control, np.uint8)
    if not len(codes):
        return np.zeros(0, np.uint32)
    ends = np.cumsum(_COVERED[codes])
    places = (ends - _COVERED[codes])[:, None] + _PLACES[codes]
    values = np.frombuffer(data, np.uint8)[places] * _USED[codes]
    return values.astype(np.uint8).reshape(-1).view("<u4")[:count]


# --- Tokenizer ----------------------------------------------------------------------------


@cache
def _encoder(file: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to ids as bytes, equal to the tokenizers library on whole texts.

    No token crosses white space, so texts are lower-cased and parted there, the words of a batch are numbered, and each
    different word is looked up once; its ids are gathered by number. Words not seen before are cut into split parts, and
    parts not seen before are encoded in one call.
    Texts with a special token's string or with characters outside the plain set are given to the library whole.
    """
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import json

    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tokenizer = Tokenizer.from_file(file)
    with open(file, encoding="utf-8") as f:
        settings = json.load(f)
    if tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("ids of more than 16 bits")
    split, *rest = settings["pre_tokenizer"]["pretokenizers"]
    if split["pattern"]["Regex"] != _PATTERN or [(r["type"], r["add_prefix_space"], r["use_regex"]) for r in rest] != [("ByteLevel", False, False)]:
        raise ValueError("a tokenizer with another split pattern")
    suffix = settings["model"]["end_of_word_suffix"]
    ends_word = np.zeros(1 << 16, bool)
    ends_word[[i for token, i in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
    # Words are lower case already, and the plain set has one normal form. The parts of a text of parts stand between
    # spaces, so the pattern need not find them again.
    of_words = Tokenizer.from_file(file)
    of_words.normalizer = normalizers.Sequence([])
    of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    known: dict[str, bytes] = {}

    def whole(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(words: list[str]) -> None:
        """Encode new split parts as one text; each ends with its one id of a part's end. A part is a word too."""
        others = [w for w in words if not w.isalpha()]
        parts = list(map(_SPLIT.findall, others))
        new = [p for p in {*filter(str.isalpha, words), *chain.from_iterable(parts)} if p not in known]
        if new:
            # The fast form leaves out offsets, which nobody asks for; the ids are the same.
            ids = np.array(of_words.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u2")
            ends = np.flatnonzero(ends_word[ids]) + 1
            if len(ends) == len(new) and ends[-1] == len(ids):
                raw, marks = ids.tobytes(), (2 * np.r_[0, ends]).tolist()
                known.update(zip(new, [raw[a:b] for a, b in zip(marks[:-1], marks[1:], strict=True)], strict=True))
            else:
                known.update(zip(new, whole(new), strict=True))
        known.update([(w, b"".join([known[p] for p in found])) for w, found in zip(others, parts, strict=True) if found != [w]])

    def by_words(texts: list[str]) -> list[bytes]:
        parted = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        coded = parted.values.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(known.get, words))
        if None in found:
            learn([w for w, ids in zip(words, found, strict=True) if ids is None])
            found = list(map(known.get, words))
        table = np.frombuffer(b"".join(found), "<u2")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 2
        numbers = coded.indices.to_numpy()
        counts = sizes[numbers]
        ends = np.r_[0, np.cumsum(counts)]
        # A batch holds far fewer than 2^31 ids, so places fit 32 bits, unless one text is longer than that.
        place = np.int32 if ends[-1] + len(table) < 1 << 31 else np.int64
        shift = ((np.cumsum(sizes) - sizes)[numbers] - ends[:-1]).astype(place)
        ids = table[np.repeat(shift, counts) + np.arange(ends[-1], dtype=place)].tobytes()
        marks = (2 * ends[parted.offsets.to_numpy()]).tolist()
        return [ids[a:b] for a, b in zip(marks[:-1], marks[1:], strict=True)]

    def run(texts: list[str]) -> list[bytes]:
        if len(known) > REMEMBERED:
            # Common words come early, so the first half is worth keeping.
            kept = dict(islice(known.items(), REMEMBERED // 2))
            known.clear()
            known.update(kept)
        plain = [not _PLAIN.search(t) and _SPECIAL not in t for t in texts]
        parted = iter(by_words([t for t, p in zip(texts, plain, strict=True) if p]) if any(plain) else ())
        return [next(parted) if p else whole([t])[0] for t, p in zip(texts, plain, strict=True)]

    return run


# --- Writing ------------------------------------------------------------------------------

_RAW = "range int, place long, base long, doc_ids array<long>, lengths array<int>, ids binary"
_BLOCKS = "range int, place long, base long, doc_ids array<long>, lengths array<int>, control binary, data binary"


def tokenized(docs: DataFrame, file: str) -> DataFrame:
    """``doc_id, ids``: the ids of each text as packed 16-bit numbers, with the end id."""
    end = np.array([END_ID], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = _encoder(file)
        for whole in batches:
            for batch in slices(whole, "text", _WORK_BYTES):
                ids = [x + end for x in encode_texts(batch.column(1).to_pylist())]
                yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return texts_of(docs, "doc_id").mapInArrow(run, "doc_id long, ids binary")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order to blocks; ``base`` counts the ids of the range before the block."""
    squeeze = zstandard.ZstdCompressor(level=1)
    docs, parts, held, at = [], [], 0, (None, 0, 0)

    def block():
        lengths = [len(p) // 2 for p in parts]
        return pa.record_batch(
            [pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int64()), pa.array([at[2]], pa.int64()),
             pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())),
             pa.array([squeeze.compress(b"".join(parts))], pa.binary())],
            ["range", "place", "base", "doc_ids", "lengths", "ids"])

    for batch in batches:
        for where, doc, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if docs and (where != at[0] or held >= BLOCK_IDS):
                yield block()
                at = (at[0], at[1] + 1, at[2] + held)
                docs, parts, held = [], [], 0
            if where != at[0]:
                at = (where, 0, 0)
            docs.append(doc)
            parts.append(ids)
            held += len(ids) // 2
    if docs:
        yield block()


def _raw_ids(batch: pa.RecordBatch, row: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column("ids")[row].as_py()), "<u2")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for row in range(batch.num_rows):
            total += np.bincount(_raw_ids(batch, row), minlength=1 << 16)
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])


def write(docs: DataFrame, file: str, folder: str) -> None:
    """Tokenize, rank ids by how often the whole corpus uses them, and write the file set below ``folder``."""
    spark = docs.sparkSession
    width = 2 * shuffle_partitions(spark)
    bounds = range_bounds(docs.select("doc_id"), "doc_id", width)
    ids = tokenized(docs, file).withColumn("range", range_bucket(F.col("doc_id"), bounds))
    ordered = ids.repartition(width, "range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "ids")
    ordered.select("range", "doc_id", "ids").mapInArrow(_pack, _RAW).write.option("compression", "none").parquet(f"{folder}/raw")
    raw = spark.read.schema(_RAW).parquet(f"{folder}/raw")
    counts = raw.select("ids").mapInArrow(_count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # One row a vocabulary entry, 65,536 at most.
    ranked = [r.id for r in sorted(counts.collect(), key=lambda r: (-r.n, r.id))]
    rank_rows = list(enumerate(ranked))
    spark.createDataFrame(rank_rows, "rank int, id int").coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.zeros(1 << 16, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                control, data = encode(rank_of[_raw_ids(batch, row)])
                yield pa.record_batch(
                    [*(batch.column(n).slice(row, 1) for n in ("range", "place", "base", "doc_ids", "lengths")),
                     pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                    ["range", "place", "base", "doc_ids", "lengths", "control", "data"])

    raw.mapInArrow(code, _BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


# --- Reading ------------------------------------------------------------------------------


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from a file set; ``ids`` as unsigned 32-bit little-endian bytes."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    id_of = np.array([r.id for r in sorted(spark.read.parquet(f"{folder}/ranks").collect(), key=lambda r: r.rank)], "<u4")
    # A row a range, as many as there were shuffle partitions.
    sums = blocks.select("range", (F.col("base") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before, offsets = 0, {}
    for r in sorted(sums.groupBy("range").agg(F.max("n").alias("n")).collect(), key=lambda r: r["range"]):
        offsets[r["range"]] = before
        before += r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                docs, lengths = batch.column("doc_ids")[row].values, batch.column("lengths")[row].values.to_numpy()
                ends = np.cumsum(lengths)
                values = decode(batch.column("control")[row].as_py(), batch.column("data")[row].as_py(), int(ends[-1]))
                ids = id_of[values]
                first = offsets[batch.column("range")[row].as_py()] + batch.column("base")[row].as_py()
                yield pa.record_batch(
                    [docs, pa.array(first + ends - lengths), pa.array(lengths.astype(np.int64)),
                     pa.array([ids[e - n : e].tobytes() for e, n in zip(ends, lengths, strict=True)], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, file: str) -> DataFrame:
    """Write the file set into the shared folder and digest what reading it back gives."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    write(docs, file, folder)
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc_of(ids: list[int]) -> int:
    """What ``ids_crc32`` is for a list of ids."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
