"""Quality rules by repetition coverage: how many of a text's characters lie inside repeated n-grams and lines.

Words are maximal runs of characters other than space and ``\\t`` to ``\\r``, case kept. For each n-gram length a rolling
hash of all windows of that many words comes from one array of running sums; windows whose hash occurred earlier in the
text are repeats, and the characters of the words they cover, each word once, are counted. A window can only be repeated
if both shorter windows inside it are, so after the shortest length few windows are left to look at. Lines are repeats if
an equal line came before. The base measures (words, their characters, symbols, repeated lines, words in repeated 3-word
windows) come from the same pass, and the verdict is a column expression over the counts.

A text fails the base rules with fewer than ``LEAST_WORDS`` words or with over half of its words in repeated 3-word
windows. It is kept if it passes them and no share is above its limit in ``LIMITS``.

Equality of windows and lines is that of 64-bit hashes (two of a text's million windows meet by chance once in 10^7
texts). Whole texts are read and a row is handled alone: no shuffle, no state between rows.

Defined cases: a null text has no words and fails the base rules, like an empty or blank one; lines without a word never
count as repeated; a text of fewer words than a window has no such window; repeated rows and ids are judged each on its
own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirekit.llm.common import texts_of
from quirekit.llm.wordhash import mix, slices, text_bytes, window_keys, words_of

LEAST_WORDS, BASE_WINDOW, BASE_PERCENT = 50, 3, 50
#: Lengths whose covered characters are reported.
LENGTHS = (5, 6, 7, 8, 9, 10)
#: Largest share in percent that a kept text may have: of its word characters in repeated windows of each length and in
#: repeated lines, and of symbols to words.
LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10, "lines": 20, "symbols": 10}
SYMBOLS = b"#*$%&|<>"
_WORK_BYTES = 1 << 20

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
#: Bytes that begin a code point.
_LEADS = np.ones(256, bool)
_LEADS[0x80:0xC0] = False

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_chars_{n}" for n in LENGTHS)]


def _by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values between ``first[i]`` and ``first[i + 1]``."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether it occurs twice or more, and whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, again


def _covered(at: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in a window of n words that begins at one of the places."""
    edges = np.zeros(words + 1, np.int32)
    np.add.at(edges, at, 1)
    np.subtract.at(edges, at + n, 1)
    return np.cumsum(edges[:-1]) > 0


def _line_counts(data: np.ndarray, offsets: np.ndarray, word_starts: np.ndarray, first: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repeated lines of each text and the characters of their words; only lines that hold a word are looked at."""
    texts = len(first) - 1
    breaks = np.flatnonzero(data == 10)
    # A line begins behind a break and at the start of a text.
    begins = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    begins = begins[begins < len(data)]
    ends = np.minimum(np.r_[begins[1:], len(data)], len(data))
    ends = ends - (data[ends - 1] == 10) if len(ends) else ends
    low, high = np.searchsorted(word_starts, begins), np.searchsorted(word_starts, ends)
    held = high > low
    begins, ends, low, high = begins[held], ends[held], low[held], high[held]
    text = np.searchsorted(offsets, begins, "right") - 1
    view, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    keys = np.array([digest(view[a:b], t) for a, b, t in zip(begins.tolist(), ends.tolist(), text.tolist(), strict=True)], np.uint64)
    _, again = _repeats(keys)
    sums = np.r_[0, np.cumsum(chars)]
    lines = np.bincount(text[again], minlength=texts)
    return lines, np.bincount(text[again], (sums[high] - sums[low])[again], texts).astype(np.int64)


def counts_of(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` for each text of a column without nulls."""
    words = words_of(column, lower=False)
    data, first, total = words.data, words.first, len(words.starts)
    texts = len(column)
    sizes = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_LEADS[data], out=sizes[1:])
    chars = sizes[words.ends] - sizes[words.starts]
    _, offsets = text_bytes(column)
    out = {"n_words": np.diff(first), "word_chars": _by_text(chars, first), "n_symbols": _by_text(_IS_SYMBOL[data], offsets)}
    out["n_dup_lines"], out["dup_line_chars"] = _line_counts(data, offsets, words.starts, first, chars) if total else (np.zeros(texts, np.int64),) * 2
    # Hashes are salted by text, so that one sort serves all texts of the batch.
    owner = np.repeat(np.arange(texts), np.diff(first))
    salt = mix(np.arange(1, texts + 1, dtype=np.uint64))
    left = first[1:][owner] - np.arange(total)
    places, sums = np.arange(total), None
    for n in range(2, max(LENGTHS) + 1):
        places = places[left[places] >= n]
        keys, sums = window_keys(words.hashes, places, n, sums)
        twice, again = _repeats(keys ^ salt[owner[places]])
        if n == BASE_WINDOW:
            out["n_repeat_words"] = _by_text(_covered(places[twice], n, total), first)
        if n in LENGTHS:
            out[f"dup_chars_{n}"] = _by_text(np.where(_covered(places[again], n, total), chars, 0), first)
        # A longer window is repeated only if the windows at its first two words are.
        held = np.zeros(total + 1, bool)
        held[places[twice]] = True
        places = places[twice]
        places = places[held[places + 1]]
    return out


def count_documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", _WORK_BYTES):
                got = counts_of(batch.column(1))
                yield pa.record_batch([batch.column(0), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], ["doc_id", *COUNTS])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts_of(named, "doc_id").mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", *COUNTS]))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > BASE_PERCENT * F.col("n_words"))


def too_repetitive(limits: dict = LIMITS) -> Column:
    """Whether a share is above its limit."""
    parts = [(f"dup_chars_{n}", "word_chars", limits[n]) for n in LENGTHS]
    parts += [("dup_line_chars", "word_chars", limits["lines"]), ("n_symbols", "n_words", limits["symbols"])]
    over = F.lit(False)
    for part, whole, percent in parts:
        over = over | (100 * F.col(part) > percent * F.col(whole))
    return over


def judge_documents(docs: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """The counts of every row with ``base_failed`` and ``kept``."""
    judged = count_documents(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~too_repetitive(limits))
    lead = ["doc_id", *COUNTS[:5], "base_failed", "kept"]
    return judged.select(*lead, *(c for c in judged.columns if c not in lead))


def oracle() -> str:
    """DuckDB SQL for ``judge_documents`` over ``documents``."""
    lengths = ", ".join(map(str, LENGTHS))
    dup = ", ".join(f"COALESCE(SUM(chars) FILTER (WHERE n = {n}), 0)::BIGINT AS dup_chars_{n}" for n in LENGTHS)
    over = " OR ".join([*(f"100 * dup_chars_{n} > {LIMITS[n]} * word_chars" for n in LENGTHS), f"100 * dup_line_chars > {LIMITS['lines']} * word_chars", f"100 * n_symbols > {LIMITS['symbols']} * n_words"])
    columns = ", ".join(COUNTS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
word AS (SELECT r, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w),
gram AS (
  SELECT r, n, i, array_to_string(list_slice(words, i, i + n - 1), ' ') AS gram
  FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w CROSS JOIN (SELECT unnest([{BASE_WINDOW}, {lengths}]) AS n) AS lengths)),
found AS (SELECT r, n, i, count(*) OVER (PARTITION BY r, n, gram) AS times, row_number() OVER (PARTITION BY r, n, gram ORDER BY i) AS nth FROM gram),
inside AS (SELECT DISTINCT r, n, unnest(range(i, i + n)) AS i FROM found WHERE (n = {BASE_WINDOW} AND times > 1) OR (n > {BASE_WINDOW} AND nth > 1)),
cover AS (SELECT inside.r, n, count(*) AS n_in, sum(length(word)) AS chars FROM inside JOIN word ON word.r = inside.r AND word.i = inside.i GROUP BY inside.r, n),
covers AS (SELECT r, COALESCE(SUM(n_in) FILTER (WHERE n = {BASE_WINDOW}), 0)::BIGINT AS n_repeat_words, {dup} FROM cover GROUP BY r),
line AS (
  SELECT r, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS words, count(*) AS times
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) GROUP BY r, line),
lines AS (
  SELECT r, SUM(times - 1)::BIGINT AS n_dup_lines, SUM((times - 1) * length(array_to_string(words, '')))::BIGINT AS dup_line_chars
  FROM line WHERE len(words) > 0 GROUP BY r),
counts AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, COALESCE(n_dup_lines, 0) AS n_dup_lines,
    COALESCE(dup_line_chars, 0) AS dup_line_chars, COALESCE(n_repeat_words, 0) AS n_repeat_words,
    {", ".join(f"COALESCE(dup_chars_{n}, 0) AS dup_chars_{n}" for n in LENGTHS)}
  FROM w LEFT JOIN lines ON lines.r = w.r LEFT JOIN covers ON covers.r = w.r),
judged AS (
  SELECT doc_id, {columns}, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed, {over} AS over FROM counts)
SELECT doc_id, {columns}, base_failed, NOT base_failed AND NOT over AS kept FROM judged
"""
