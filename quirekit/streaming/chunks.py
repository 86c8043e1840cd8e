"""Chunked texts as streams: assembly, payload suppression and line carry (STM-01, STM-03, STM-05).

A stream row is ``(doc_id, seq, last, chunk)``. Chunks may come in any order and more than once; each counts once, in its
turn. State is kept per document in separate variables: whose turn it is with what is carried along, the chunks that came
before their turn, and for assembly the parts so far, each written once. A finished document leaves only its turn behind,
which tells late repeats from a new document. All of it goes ``idle_ms`` after it was last written, so state is bounded by
the documents of that time. The stream needs the RocksDB state store, which ``runs`` switches on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quirekit.functions.classify import ocr_line_html
from quirekit.functions.lines import slices_of

PAYLOAD_START = re.compile(r"(?is)(?P<head>src\s*=\s*)(?P<quote>[\"'])(?:data:image/[a-z0-9.+-]+;base64,|about:blank)")


def to_chunks(frame: DataFrame, key: str, text: Column, size: int = 64) -> DataFrame:
    """Cut a text column into numbered chunks; the empty text is one empty chunk."""
    held = frame.select(F.col(key).alias("_key"), text.alias("_text"))
    last = F.floor((F.greatest(F.length("_text"), F.lit(1)) - 1) / size).cast("int")
    cut = F.transform(
        slices_of(F.col("_text"), size),
        lambda chunk, i: F.struct(i.alias("seq"), (i == last).alias("last"), chunk.alias("chunk")),
    )
    return held.select("_key", F.explode(cut).alias("c")).select(F.col("_key").alias("doc_id"), "c.*")


DAY_MS = 86_400_000
TURN = "next int, done boolean"


class InTurn(StatefulProcessor):
    """Takes each document's chunks in turn; subclasses say what a chunk gives.

    ``carry`` is the schema of what goes from chunk to chunk, ``nothing`` its value at the beginning, ``columns`` those of
    the rows that come out, without ``doc_id``.
    """

    carry, nothing, columns = "", (), ()

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turn = handle.getValueState("turn", ", ".join(filter(None, [TURN, self.carry])), self.idle_ms)
        self.waiting = handle.getMapState("waiting", "seq int", "chunk string, last boolean", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turn, done, *carried = self.turn.get() if self.turn.exists() else (0, False, *self.nothing)
        came = {}
        for page in rows:
            came.update(zip(page["seq"].tolist(), zip(page["chunk"].tolist(), page["last"].tolist(), strict=True), strict=True))
        out: list[tuple] = []
        while not done:
            if turn in came:
                chunk, last = came.pop(turn)
            elif self.waiting.containsKey((turn,)):
                chunk, last = self.waiting.getValue((turn,))
                self.waiting.removeKey((turn,))
            else:
                break
            carried, given = self.take(turn, chunk, bool(last), carried)
            out += given
            turn, done = turn + 1, bool(last)
        if done:
            self.waiting.clear()
            carried = list(self.nothing)
        else:
            for seq, held in came.items():
                if seq > turn and not self.waiting.containsKey((seq,)):
                    self.waiting.updateValue((seq,), held)
        self.turn.update((turn, done, *carried))
        out = self.finish(out, done)
        if out:
            yield pd.DataFrame([(key[0], *row) for row in out], columns=["doc_id", *self.columns])

    def take(self, seq: int, chunk: str, last: bool, carried: list) -> tuple[list, list[tuple]]:
        """What is carried on after a chunk, and the rows it gives."""
        raise NotImplementedError

    def finish(self, out: list[tuple], done: bool) -> list[tuple]:
        """The rows that come out of one call."""
        return out

    def close(self) -> None:
        pass


def _per_document(chunks: DataFrame, step: InTurn, output: str) -> DataFrame:
    return chunks.groupBy("doc_id").transformWithStateInPandas(step, output, "Append", "ProcessingTime")


class _Assemble(InTurn):
    columns = ("text",)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.parts = handle.getListState("parts", "chunk string", self.idle_ms)

    def take(self, seq, chunk, last, carried):
        return carried, [(chunk,)]

    def finish(self, out, done):
        if not done:
            if out:
                self.parts.appendList(out)
            return []
        if not out:
            return []
        before = [part[0] for part in self.parts.get()] if self.parts.exists() else []
        self.parts.clear()
        return [("".join(before + [part[0] for part in out]),)]


def assemble(chunks: DataFrame, idle_ms: int = DAY_MS) -> DataFrame:
    """STM-01: whole texts, each given out once all its chunks are in, in whatever order they came.

    Rules that look across chunk borders can then run on the text as columns.
    """
    return _per_document(chunks, _Assemble(idle_ms), "doc_id bigint, text string")


def _beginning_of(text: str) -> str:
    """Pattern of any beginning of a literal text, the whole of it included."""
    pattern = ""
    for letter in reversed(text):
        pattern = f"(?:{re.escape(letter)}{pattern})?"
    return pattern


# A payload's start cut off by the end of a chunk, at whatever character.
_CUT_START = re.compile(
    r"(?is)(?:s|sr|src\s*|src\s*=\s*|src\s*=\s*[\"'](?:"
    + _beginning_of("about:blank")
    + "|" + _beginning_of("data:image/")
    + r"|data:image/[a-z0-9.+-]+" + _beginning_of(";base64,")
    + r"))\Z"
)


def suppress_payload(chunk: str, open_quote: str, last: bool = True) -> tuple[str, str, str]:
    """One chunk without inline image data, the quote still open at its end (empty when none), and what to hold back.

    The end of a chunk that may be the beginning of a payload's start goes with the next chunk.
    """
    kept: list[str] = []
    held = ""
    while chunk:
        if open_quote:
            _, closing, chunk = chunk.partition(open_quote)
            if not closing:
                break
            kept.append(closing)
            open_quote = ""
            continue
        found = PAYLOAD_START.search(chunk)
        if found is None:
            cut = None if last else _CUT_START.search(chunk)
            kept.append(chunk if cut is None else chunk[: cut.start()])
            held = "" if cut is None else cut[0]
            break
        kept += [chunk[: found.start()], found["head"], found["quote"], "about:blank"]
        open_quote, chunk = found["quote"], chunk[found.end():]
    return "".join(kept), open_quote, held


class _Suppress(InTurn):
    carry, nothing, columns = "quote string, held string", ("", ""), ("seq", "chunk")

    def take(self, seq, chunk, last, carried):
        text, quote, held = suppress_payload(carried[1] + chunk, carried[0], last)
        return [quote, held], [(seq, text)]


def suppress_images(chunks: DataFrame, idle_ms: int = DAY_MS) -> DataFrame:
    """STM-03: inline image data is dropped while it streams past; a chunk that comes early waits for its turn.

    Text that may begin a payload comes out with the chunk after it, so the chunks put together are the cleaned text
    wherever it was cut.
    """
    return _per_document(chunks, _Suppress(idle_ms), "doc_id bigint, seq int, chunk string")


class _CarryLines(InTurn):
    carry, nothing, columns = "rest string, lines bigint", ("", 0), ("line_no", "line")

    def take(self, seq, chunk, last, carried):
        *complete, rest = (carried[0] + chunk).split("\n")
        if last:
            complete.append(rest)
        number = carried[1]
        return [rest, number + len(complete)], list(enumerate(complete, number))


def lines_as_html(chunks: DataFrame, idle_ms: int = DAY_MS) -> DataFrame:
    """STM-05: complete lines as HTML blocks; a line cut by a chunk border is carried to the next chunk."""
    lines = _per_document(chunks, _CarryLines(idle_ms), "doc_id bigint, line_no bigint, line string")
    rendered = lines.select("doc_id", "line_no", ocr_line_html(F.col("line")).alias("html"))
    return rendered.filter("html <> ''")
