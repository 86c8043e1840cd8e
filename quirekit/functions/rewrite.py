"""Ordered regex rewriting on string columns.

Rules are ``(pattern, replacement)`` pairs with back-references written ``\\1``.
``(?d)`` in a pattern makes ``\\n`` the only line terminator, as the rules assume.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, str]
BLANKS = " \t\n\r\x0b\f"
# No-break spaces count as blanks. A lone space is no match: it stays as it is, and most runs are one. The pattern begins
# with one class, as choices would be tried at every character.
_BLANK = r"[ \t\n\x0B\f\r\x{A0}]"
BLANK_RUN = rf"{_BLANK}(?<! (?!{_BLANK})){_BLANK}*"


class RuleIn(tuple):
    """A rule for texts that hold one of ``needs``, which every match must hold: literals, or one pattern.

    Substring tests are many times cheaper than patterns. To ``rewrite`` and the SQL helpers it is a rule like any other.
    """

    needs: list[str] | str

    def __new__(cls, needs: list[str] | str, pattern: str, replacement: str) -> RuleIn:
        rule = super().__new__(cls, (pattern, replacement))
        rule.needs = needs
        return rule


def java_replacement(replacement: str) -> str:
    """``\\1`` style replacement text -> Java's ``$1`` style; ``\\n`` is a newline."""
    return re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$").replace(r"\n", "\n"))


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` worked out once, however often ``fn`` uses it.

    An expression that mentions its input several times copies the whole input tree
    each time; chained, such trees grow exponentially. A one-element array transform
    binds the value to a lambda variable instead.
    """
    return F.transform(F.array(value), lambda bound: fn(bound))[0]


def rewrite(col: Column, rules: Iterable[Rule]) -> Column:
    groups = [(needs, list(group)) for needs, group in groupby(rules, key=lambda rule: getattr(rule, "needs", None))]
    if all(needs is None for needs, _ in groups):
        return reduce(_chain, [group for _, group in groups], col)
    # Rules side by side with the same needs are skipped together: none of them can match before another has.
    # The value stays in its array from group to group, which keeps the tree as flat as without needs.
    held = F.array(col)
    for needs, group in groups:
        held = F.transform(held, _only(needs, group))
    return held[0]


def _chain(col: Column, rules: list[Rule]) -> Column:
    for pattern, replacement in rules:
        col = F.regexp_replace(col, F.lit(pattern), F.lit(java_replacement(replacement)))
    return col


def _only(needs: list[str] | str | None, rules: list[Rule]):
    """The rules, in texts that hold their needs."""
    return lambda x: _chain(x, rules) if needs is None else F.when(holds(x, needs), _chain(x, rules)).otherwise(x)


def holds(col: Column, needs: Iterable[str] | str) -> Column:
    """Whether a text holds one of the literals, or matches the pattern."""
    return col.rlike(needs) if isinstance(needs, str) else reduce(lambda a, b: a | b, [F.contains(col, F.lit(n)) for n in needs])


def rewrite_first(col: Column, pattern: str, replacement: Column | str) -> Column:
    """Replace the first match only. A column replacement is taken literally."""
    if isinstance(replacement, str):
        # The lazy prefix is anchored, so the rule can fire only once.
        shifted = re.sub(r"\\(\d)", lambda m: "\\" + str(int(m.group(1)) + 1), replacement)
        return rewrite(col, [(r"(?s)\A(.*?)" + pattern, r"\1" + shifted)])
    return let(
        F.split(col, pattern, 2),
        lambda around: F.when(F.size(around) == 2, F.concat(around[0], replacement, around[1])).otherwise(around[0]),
    )


def rewrite_if(col: Column, hints: Iterable[str], fn) -> Column:
    """``fn(col)`` for texts that hold one of the lower-case ``hints``; others pass.

    Substring tests are many times cheaper than patterns, so texts without any hint
    skip the chain. Every text ``fn`` can change must hold a hint.
    """

    # Hints without letters need no text in lower case.
    hints = list(hints)
    bare, worded = ([h for h in hints if (h.upper() != h) is cased] for cased in (False, True))

    def run(body: Column) -> Column:
        found = [holds(body, bare)] if bare else []
        found += [let(F.lower(body), lambda low: holds(low, worded))] if worded else []
        return F.when(reduce(lambda a, b: a | b, found), fn(body)).otherwise(body)

    return let(col, run)


def replace_all(col: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    for old, new in pairs:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def strip(col: Column, chars: str = BLANKS) -> Column:
    return F.btrim(col, F.lit(chars))


def squash(col: Column, chars: str = BLANKS) -> Column:
    """Collapse whitespace runs to one space, then strip ``chars`` at both ends."""
    return strip(F.regexp_replace(col, BLANK_RUN, " "), chars)


def full(pattern: str, flags: str = "") -> str:
    """Anchor ``pattern`` to the whole string."""
    return f"{flags}\\A(?:{pattern})\\z"


def map_lines(col: Column, fn) -> Column:
    """Apply ``fn`` to every line inside the row (no explode, no shuffle)."""
    return F.array_join(F.transform(F.split(col, "\n"), fn), "\n")


def count_matches(col: Column, pattern: str) -> Column:
    return F.regexp_count(col, F.lit(pattern))


def count_chars(col: Column, chars: str) -> Column:
    """How many characters of a class a text has, without listing them one by one."""
    return F.length(F.regexp_replace(col, f"[^{chars}]+", ""))


def map_matches(col: Column, pattern: str, fn) -> Column:
    """Rewrite each match of ``pattern`` with ``fn(match)``.

    The pieces between matches and the matches themselves are interleaved, so any
    column expression can stand where a regex replacement string is too weak.
    """

    def run(body: Column) -> Column:
        found = F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), lambda match: fn(match))
        joined = F.zip_with(
            F.split(body, pattern, -1), F.concat(found, F.array(F.lit(""))), lambda piece, match: F.concat(piece, match)
        )
        return F.when(body.rlike(pattern), F.array_join(joined, "")).otherwise(body)

    return let(col, run)


def map_between(col: Column, pattern: str, fn) -> Column:
    """Rewrite the text between matches of ``pattern`` with ``fn(piece)``; the matches stay as they are."""

    def run(body: Column) -> Column:
        pieces = F.transform(F.split(body, pattern, -1), lambda piece: fn(piece))
        kept = F.concat(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
        return F.array_join(F.zip_with(pieces, kept, lambda piece, match: F.concat(piece, match)), "")

    return let(col, run)
