"""Toxicity by a linear-chain conditional random field over tokens.

Each token is tagged toxic or not by a chain with two states. A token's features are its word and those of its
beginnings that several words share, so unseen forms of a known stem are tagged as well; the transitions let neighbours support each
other. Forward-backward gives each token's marginal chance of being toxic. A document's score is a logistic function of
the expected number of toxic tokens and of the greatest marginal; tokens above one half, joined where they touch, are the
offending spans.

Token labels for training come from the document labels: in a toxic document a token is labelled toxic if its word or
beginning is far commoner in toxic documents than in the others (a likelihood ratio test at a level that allows for the
number of words tried); tokens of other documents are labelled not toxic. The chain is fitted on a bounded sample of
labelled rows (``SAMPLE`` of each label at about most, drawn by hash), near copies counted once; scoring covers every text.

Defined cases: null and empty texts get the score of a text without toxic tokens; without labelled rows of both kinds
every score is the share of toxic labels (0 without labels); of several labels of a document the greatest holds; texts of
any length are one chain; repeated rows get equal scores.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirekit.llm.common import texts_of
from quirekit.llm.wordhash import slices

#: Labelled rows of each label to fit on, at about most; passes of the fit; words a worker remembers.
SAMPLE, PASSES, REMEMBERED = 1500, 25, 400_000
#: Predicted toxic from this score on.
LIMIT = 0.7
#: How many times commoner in toxic documents a word must be to label a token.
TIMES = 8.0
_PIECE, _WORK_BYTES = 64, 1 << 20
_TOKEN = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


#: Lengths of word beginnings, and how many different words must share one before it says anything.
BEGINNINGS, SHARED_BY = (4, 5, 6), 3


def beginnings(word: str) -> list[str]:
    return [f"{word[:k]}*" for k in BEGINNINGS if len(word) > k]


def shared_beginnings(docs: Iterable[list[str]]) -> set[str]:
    """Beginnings of several different words none of which makes up half of their documents.

    A beginning that stands for one word in the main would tag chance words that begin like it.
    """
    count = Counter(w for words in docs for w in set(words))
    total, most, kinds = Counter(), Counter(), Counter()
    for word, n in count.items():
        for b in beginnings(word):
            total[b] += n
            kinds[b] += 1
            most[b] = max(most[b], n)
    return {b for b, n in kinds.items() if n >= SHARED_BY and 2 * most[b] < total[b]}


def features(word: str, shared: set[str]) -> list[str]:
    """The word, and those of its beginnings that several words share."""
    return [word, *(b for b in beginnings(word) if b in shared)]


# --- The chain ----------------------------------------------------------------------------


def chain(scores: np.ndarray, begin: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state, and expected moves between states (2 x 2), of many texts at once.

    ``scores`` are the tokens' log-odds, ``begin`` the n + 1 places where texts begin, ``moves`` the log-weights of going
    from one state to the next. Texts are cut into pieces; the product of a piece's matrices carries the state across it,
    so pieces are worked out side by side and only their ends one after another.
    """
    lengths = np.diff(begin)
    pieces = -(-lengths // _PIECE)
    total = int(pieces.sum())
    if not total:
        return np.zeros(0), np.zeros((2, 2))
    first = np.cumsum(pieces) - pieces
    owner = np.repeat(np.arange(len(lengths)), pieces)
    rank = np.arange(total) - first[owner]
    start = begin[owner] + rank * _PIECE
    size = np.minimum(lengths[owner] - rank * _PIECE, _PIECE)
    grid = start[None, :] + np.arange(_PIECE)[:, None]
    real = np.arange(_PIECE)[:, None] < size[None, :]
    odds = np.exp(np.clip(np.where(real, scores[np.minimum(grid, len(scores) - 1)], 0.0), -30, 30))
    a = np.exp(moves)
    # Product of each piece's matrices, padding being the identity.
    product = np.broadcast_to(np.eye(2), (total, 2, 2)).copy()
    for t in range(_PIECE):
        stayed, gone = product[:, :, 0] * a[0, 0] + product[:, :, 1] * a[1, 0], product[:, :, 0] * a[0, 1] + product[:, :, 1] * a[1, 1]
        step = np.stack([stayed, gone * odds[t][:, None]], axis=2)
        product = np.where(real[t][:, None, None], step, product)
        product /= product.max(axis=(1, 2), keepdims=True)
    # State before each piece from the left, and after each from the right, piece by piece over all texts.
    left, right = np.full((total, 2), 0.5), np.ones((total, 2))
    left[:, 1] = 0.5
    deepest = int(pieces.max())
    order = np.argsort(rank, kind="stable")
    at = np.searchsorted(rank[order], np.arange(deepest + 1))
    for k in range(1, deepest):
        here = order[at[k] : at[k + 1]]
        state = np.einsum("pi,pij->pj", left[here - 1], product[here - 1])
        left[here] = state / state.max(axis=1, keepdims=True)
    for k in range(deepest - 2, -1, -1):
        here = order[at[k] : at[k + 1]]
        here = here[rank[here] < pieces[owner[here]] - 1]
        state = np.einsum("pij,pj->pi", product[here + 1], right[here + 1])
        right[here] = state / state.max(axis=1, keepdims=True)
    # Tokens of each piece, from both ends.
    ahead = np.empty((_PIECE, total, 2))
    state = left
    for t in range(_PIECE):
        moved = np.stack([state[:, 0] * a[0, 0] + state[:, 1] * a[1, 0], (state[:, 0] * a[0, 1] + state[:, 1] * a[1, 1]) * odds[t]], axis=1)
        state = np.where(real[t][:, None], moved / moved.max(axis=1, keepdims=True), state)
        ahead[t] = state
    marginal, expected = np.empty((_PIECE, total)), np.zeros((2, 2))
    state = right
    for t in range(_PIECE - 1, -1, -1):
        joint = ahead[t] * state
        marginal[t] = joint[:, 1] / joint.sum(axis=1)
        before = ahead[t - 1] if t else left
        weighted = np.stack([state[:, 0], state[:, 1] * odds[t]], axis=1)
        pair = before[:, :, None] * a[None] * weighted[:, None, :]
        counted = real[t] & ((t > 0) | (rank > 0))
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True))[counted].sum(axis=0)
        back = np.stack([weighted[:, 0] * a[0, 0] + weighted[:, 1] * a[0, 1], weighted[:, 0] * a[1, 0] + weighted[:, 1] * a[1, 1]], axis=1)
        state = np.where(real[t][:, None], back / back.max(axis=1, keepdims=True), state)
    out = np.empty(len(scores))
    out[grid[real]] = marginal[real]
    return out, expected


@dataclass
class Model:
    """Feature weights, moves between states, and the document score's coefficients."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -12.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    coefficients: tuple[float, float, float] = (-20.0, 0.0, 0.0)

    def document_score(self, expected: np.ndarray, greatest: np.ndarray) -> np.ndarray:
        x = self.coefficients[0] + self.coefficients[1] * np.log1p(expected) + self.coefficients[2] * greatest
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class TokenScores(dict):
    """Log-odds of each word, worked out when it is first seen."""

    def __init__(self, model: Model):
        self.weights, self.bias = model.weights, model.bias

    def __missing__(self, word: str) -> float:
        score = self[word] = self.bias + sum(self.weights.get(f, 0.0) for f in (word, *beginnings(word)))
        return score


# --- Fitting ------------------------------------------------------------------------------


def distinct_texts(texts: list[str], labels: list[int]) -> tuple[list[list[str]], list[int]]:
    """Tokens of texts, near copies once: texts that share both of two least hashes of word triples."""
    seen: set[tuple[int, int, int]] = set()
    pool: dict[str, str] = {}
    kept, own = [], []
    for text, label in zip(texts, labels, strict=True):
        # Equal words are one object: a sample repeats few words often.
        words = [pool.setdefault(w, w) for w in _TOKEN.findall(text.lower())]
        triples = {" ".join(words[i : i + 3]).encode() for i in range(max(1, len(words) - 2))}
        mark = (label, min(map(zlib.crc32, triples)), min(zlib.crc32(t, 1) for t in triples))
        if mark not in seen:
            seen.add(mark)
            kept.append(words)
            own.append(label)
    return kept, own


def toxic_stems(docs: list[list[str]], labels: list[int]) -> set[str]:
    """Words, and beginnings shared by several words of toxic documents, far commoner there than chance would have it."""
    with_stem: tuple[Counter, Counter] = (Counter(), Counter())
    shared = shared_beginnings(words for words, label in zip(docs, labels, strict=True) if label)
    for words, label in zip(docs, labels, strict=True):
        some = set(words)
        with_stem[label].update(some)
        with_stem[label].update({b for w in some for b in beginnings(w)} & shared)
    toxic, clean = sum(labels), len(labels) - sum(labels)
    level = 4 + 2 * math.log(max(2, len(with_stem[1])))

    def part(seen: int, due: float) -> float:
        return seen * math.log(seen / due) if seen else 0.0

    out = set()
    for stem, a in with_stem[1].items():
        b = with_stem[0][stem]
        if a < 3 or a / toxic < TIMES * (b + 0.5) / (clean + 1):
            continue
        share = (a + b) / (toxic + clean)
        ratio = 2 * (part(a, share * toxic) + part(b, share * clean) + part(toxic - a, (1 - share) * toxic) + part(clean - b, (1 - share) * clean))
        if ratio >= level:
            out.add(stem)
    return out


def fit_chain(docs: list[list[str]], labels: list[int]) -> Model:
    """Maximum likelihood of the token labels, by adaptive gradient steps on all texts."""
    marked = toxic_stems(docs, labels)
    model = Model()
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for words in docs for w in words))}
    if not marked or not vocabulary:
        return model
    # A word of one document has no weight of its own: it stands for the words that are not in the sample.
    shared = shared_beginnings(words for words, label in zip(docs, labels, strict=True) if label)
    often = Counter(w for words in docs for w in set(words))
    listed = [[f for f in features(w, shared) if often.get(f, 2) > 1] for w in vocabulary]
    names = {f: i for i, f in enumerate(dict.fromkeys(f for some in listed for f in some))}
    owner = np.repeat(np.arange(len(listed)), [len(x) for x in listed])
    feature = np.array([names[f] for some in listed for f in some], np.int64)
    is_toxic = np.array([w in marked or any(b in marked for b in beginnings(w)) for w in vocabulary])
    tokens = np.array([vocabulary[w] for words in docs for w in words])
    begin = np.r_[0, np.cumsum([len(words) for words in docs])]
    of_toxic = np.repeat(np.array(labels) == 1, np.diff(begin))
    target = (is_toxic[tokens] & of_toxic).astype(float)
    inner = np.setdiff1d(np.arange(1, len(tokens)), begin)
    seen = np.zeros((2, 2))
    np.add.at(seen, (target[inner - 1].astype(int), target[inner].astype(int)), 1)
    weights, moves, bias = np.zeros(len(names)), np.zeros((2, 2)), -7.0
    squares, move_squares, bias_square = np.full(len(names), 1e-6), np.full((2, 2), 1e-6), 1e-6
    for _ in range(PASSES):
        by_word = bias + np.bincount(owner, weights[feature], len(vocabulary))
        marginal, expected = chain(by_word[tokens], begin, moves)
        per_word = np.bincount(tokens, target - marginal, len(vocabulary))
        gradient = np.bincount(feature, per_word[owner], len(names)) - 0.05 * weights
        move_gradient, bias_gradient = seen - expected - 0.05 * moves, per_word.sum()
        squares += gradient**2
        move_squares += move_gradient**2
        bias_square += bias_gradient**2
        weights += 0.7 * gradient / np.sqrt(squares)
        moves += 0.2 * move_gradient / np.sqrt(move_squares)
        bias += 0.5 * bias_gradient / math.sqrt(bias_square)
    model.weights = {f: float(weights[i]) for f, i in names.items() if abs(weights[i]) >= 0.01}
    model.bias, model.moves = float(bias), moves
    return model


def document_facts(model: Model, docs: list[list[str]], known: TokenScores) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token marginals, where texts begin, and each text's expected toxic tokens and greatest marginal."""
    begin = np.r_[0, np.cumsum([len(words) for words in docs])].astype(np.int64)
    scores = np.array([known[w] for words in docs for w in words], np.float64)
    marginal, _ = chain(scores, begin, model.moves)
    expected, greatest = np.zeros(len(docs)), np.zeros(len(docs))
    full = np.flatnonzero(np.diff(begin))
    if len(full):
        expected[full] = np.add.reduceat(marginal, begin[full])
        greatest[full] = np.maximum.reduceat(marginal, begin[full])
    return marginal, begin, expected, greatest


def fit_scores(model: Model, docs: list[list[str]], labels: list[int], toxic_weight: float) -> None:
    """Logistic coefficients of the document score by Newton steps; ``toxic_weight`` undoes the sample's share of labels."""
    _, _, expected, greatest = document_facts(model, docs, TokenScores(model))
    x = np.stack([np.ones(len(docs)), np.log1p(expected), greatest], axis=1)
    y = np.array(labels, float)
    weight = np.where(y == 1, toxic_weight, 1.0)
    at = np.zeros(3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-2, 1e-2])
        at = at + np.linalg.solve(curve, x.T @ (weight * (y - p)) - np.array([1e-3, 1e-2, 1e-2]) * at)
    model.coefficients = tuple(float(v) for v in at)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows that are not held out.

    Labels are counted and sampled by hash of the id before any text is read; the sample, about ``2 SAMPLE`` ids, is
    broadcast to the scan of the texts.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    totals = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not clean or not toxic:
        share = toxic / (clean + toxic) if toxic else 0.0
        return Model(coefficients=(math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0))
    parts = 1 << 20
    place = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    share = F.when(F.col("toxic") == 1, min(parts, parts * SAMPLE // toxic)).otherwise(min(parts, parts * SAMPLE // clean))
    sampled = known.where(place < share).withColumnRenamed("doc_id", "__id")
    rows = texts_of(docs, "doc_id").join(F.broadcast(sampled), F.col("doc_id") == F.col("__id")).select("text", "toxic")
    got = sorted((r.text, r.toxic) for r in rows.collect())
    texts, own = distinct_texts([t for t, _ in got], [y for _, y in got])
    if not 0 < sum(own) < len(own):
        return Model(coefficients=(math.log(toxic / clean), 0.0, 0.0))
    model = fit_chain(texts, own)
    fit_scores(model, texts, own, (toxic / clean) / (sum(own) / (len(own) - sum(own))))
    return model


# --- Scoring ------------------------------------------------------------------------------


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, n_toxic, spans``: the score, the expected toxic tokens, and ``start, end`` code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        known = TokenScores(held)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for whole in batches:
            for batch in slices(whole, "text", _WORK_BYTES):
                if len(known) > REMEMBERED:
                    known.clear()
                texts = batch.column(1).to_pylist()
                marginal, begin, expected, greatest = document_facts(held, [_TOKEN.findall(t.lower()) for t in texts], known)
                spans = [offending(t, marginal[a:b]) if g > 0.5 else [] for t, a, b, g in zip(texts, begin[:-1], begin[1:], greatest, strict=True)]
                yield pa.record_batch(
                    [batch.column(0), pa.array(held.document_score(expected, greatest)), pa.array(expected), pa.array(spans, kind)],
                    ["doc_id", "score", "n_toxic", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts_of(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, score double, n_toxic double, spans array<struct<start:int,end:int>>")


def offending(text: str, marginal: np.ndarray) -> list[dict[str, int]]:
    """Spans of tokens above one half, joined where only one character is between them."""
    out: list[dict[str, int]] = []
    found = list(_TOKEN.finditer(text))
    if len(found) != len(marginal):
        # Lower-casing changed where tokens part; fall back on the positions of the lower-cased text.
        found = list(_TOKEN.finditer(text.lower()))
    for token, chance in zip(found, marginal, strict=True):
        if chance > 0.5:
            if out and token.start() - out[-1]["end"] <= 1:
                out[-1]["end"] = token.end()
            else:
                out.append({"start": token.start(), "end": token.end()})
    return out


def predict_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows and score every document."""
    done = score_documents(docs.select(F.col("doc_id").cast("long"), "text"), fit(docs.select("doc_id", "text"), labels))
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"), "n_toxic", "spans")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all columns; the text decides, so copies share their fate."""
    import pyspark.sql.types as T

    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        known = TokenScores(held)
        for whole in batches:
            filled = whole.set_column(at, "text", pa.compute.fill_null(whole.column(at), ""))
            start = 0
            for batch in slices(filled, "text", _WORK_BYTES):
                if len(known) > REMEMBERED:
                    known.clear()
                tokens = [_TOKEN.findall(t.lower()) for t in batch.column(at).to_pylist()]
                _, _, expected, greatest = document_facts(held, tokens, known)
                kept = held.document_score(expected, greatest) < LIMIT
                yield whole.slice(start, batch.num_rows).filter(pa.array(kept))
                start += batch.num_rows

    from quirekit.llm.common import bounded_batches

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
