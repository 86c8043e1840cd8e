"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, range int, fp long, score double, bucket int, mark long, `__mark` string"
PROSE = "the river ran past the old mill and the miller counted sacks of grain until the lamp went out over the door"
LONG = " ".join(f"word{i % 997} and{i}" for i in range(20_000))


def rows() -> list[tuple]:
    texts = [
        (0, PROSE), (1, ""), (2, None), (3, "one"), (4, "two words"), (5, PROSE), (6, PROSE + "."), (7, LONG), (8, " \t\n "), (9, "ß ö 漢字 é́  x"),
        (10, PROSE.upper()), (3, "one"), (3, "one"), (4, "another text with the same id as a row before it"), (None, "a text without an id"), (None, None),
        (11, "<|endoftext|> it's 12,345 and don't"), (12, "a  b\r\nc\x0bd"),
    ]
    return [(i, t, "en", None, None if t is None else len(t), 7, -1, None, 3, 0, "clash") for i, t in texts]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
