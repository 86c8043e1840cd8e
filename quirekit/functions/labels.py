"""Facts about the words of a legal label: a small vocabulary and conditions on neighbouring words.

A label is taken apart into tokens, runs of letters or of digits in lower case, and rules ask which tokens stand next to
each other or at an end. Rules take the label as ``plain`` (clean and with single spaces).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirekit.functions import fixed
from quirekit.functions.rewrite import let

STRUCTURES = ["chapter", "part", "division", "subdivision"]
ENACTMENTS = ["act", "bill", "code", "regulations", "rules"]
#: Words after which a heading must go on, and verbs that make a line a sentence.
OPEN_ENDS = ["and", "of", "or", "the", "this", "to", "under"]
VERBS = ["applies", "consists", "deals", "extends", "includes", "may", "means", "must", "permits", "relates", "requires"]
TOKEN = r"\p{L}+|[0-9]+"
YEAR = r"\A(?:18|19|20)[0-9]{2}\z"
FOUR_DIGITS = r"\A[0-9]{4}\z"
NUMERAL = r"\A(?:[ivxlcdm]{1,10}|[0-9]{1,4})\z"
TITLE_CHARS_ONLY = r"\A[A-Za-z0-9 ,.'&()/-]+\z"


def tokens(plain: Column) -> Column:
    return F.regexp_extract_all(F.lower(plain), F.lit(TOKEN), F.lit(0))


def at(items: Column, place: int) -> Column:
    """An element by place from 1, or from the end by a negative place; null outside."""
    return F.try_element_at(items, F.lit(place))


def adjacent(items: Column, first, second) -> Column:
    """Some element satisfies ``first`` and the one after it ``second``."""
    behind = F.greatest(F.size(items) - 1, F.lit(0))
    return F.exists(F.zip_with(F.slice(items, F.lit(1), behind), F.slice(items, F.lit(2), behind), lambda a, b: first(a) & second(b)), lambda yes: yes)


def _holds(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def enactment_facts(plain: Column) -> Column:
    """``struct(before, after)``: tokens in front of and behind the first enactment with its year; nulls without one.

    An enactment needs a title, so it is never the first token.
    """

    def facts(items: Column) -> Column:
        places = F.filter(
            F.sequence(F.lit(2), F.greatest(F.size(items), F.lit(2))),
            lambda i: _holds(F.try_element_at(items, i).isin(ENACTMENTS) & F.try_element_at(items, i + 1).rlike(FOUR_DIGITS)),
        )
        return let(at(places, 1), lambda place: F.struct(
            F.when(place.isNotNull(), F.slice(items, F.lit(1), place - 1)).alias("before"),
            F.when(place.isNotNull(), F.slice(items, place + 2, F.size(items))).alias("after"),
        ))

    return let(tokens(plain), facts)


def _number_of(items: Column) -> Column:
    """The tokens begin with a series number, as in ``No. 2004``."""
    return (at(items, 1) == "no") & at(items, 2).rlike(FOUR_DIGITS)


def _titled(plain: Column, test) -> Column:
    shaped = plain.rlike(TITLE_CHARS_ONLY) & plain.rlike(r"[A-Za-z0-9]\z")
    return shaped & let(enactment_facts(plain), lambda x: _holds(test(x["before"], x["after"])))


def ends_with_enactment(plain: Column) -> Column:
    """A title that ends with an enactment and its year."""
    return _titled(plain, lambda before, after: F.size(after) == 0)


def has_series_number(plain: Column) -> Column:
    """A titled enactment with a series number behind or in front of it, and perhaps a page number."""

    def test(before: Column, after: Column) -> Column:
        behind = _number_of(after) & ((F.size(after) == 2) | ((F.size(after) == 3) & at(after, 3).rlike(NUMERAL)))
        front = _number_of(before) & (F.size(before) > 2) & ((F.size(after) == 0) | ((F.size(after) == 1) & at(after, 1).rlike(NUMERAL)))
        return _holds(behind) | _holds(front)

    return _titled(plain, test)


def has_page_number(plain: Column) -> Column:
    """A titled enactment with nothing but a page number behind it."""
    return _titled(plain, lambda before, after: (F.size(after) == 1) & at(after, 1).rlike(NUMERAL))


def is_loose_end(plain: Column) -> Column:
    """What is left of a broken statutory reference: a year, a clause number, ``section 4 and 12``, ``Part or``."""
    words = F.split(F.lower(plain), " ")

    def test(items: Column) -> Column:
        pair = at(words, -4).isin("section", "sections") & (at(words, -2) == "and")
        return (
            plain.rlike(r"\A(?:(?:18|19|20)[0-9]{2}\.?|[0-9]{1,4}\.)\z")
            | adjacent(items, lambda w: w.isin([w for w in ENACTMENTS if w != "bill"]), lambda w: w.rlike(YEAR))
            | _holds(pair)
            | adjacent(items, lambda w: w.isin(STRUCTURES[:3]), lambda w: w.isin("or", "and", "must"))
        )

    return let(tokens(plain), test)


def is_cited_title(plain: Column) -> Column:
    """A whole citation: a title, an enactment and its year."""
    cited = F.regexp_replace(plain, r"\.\z", "")
    return ends_with_enactment(cited) & cited.rlike(r"\A[A-Za-z]") & at(tokens(cited), -1).rlike(YEAR)


def is_unfinished(plain: Column) -> Column:
    """A heading that stops in the middle, a date, a contents line, or labels of several structures."""
    words = F.split(F.lower(plain), " ")

    def test(items: Column) -> Column:
        structured = at(words, 1).isin(STRUCTURES)
        date = (F.size(items) == 3) & at(items, 1).rlike(r"\A[0-9]{1,2}\z") & at(items, 2).isin([m.lower() for m in fixed.MONTHS]) & at(items, 3).rlike(YEAR)
        within = structured & (F.size(words) == 5) & (at(words, 3) == "of") & at(words, 4).isin(STRUCTURES)
        open_end = structured & (F.size(words) > 2) & at(words, -1).isin(OPEN_ENDS)
        counted = F.size(F.filter(
            F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
            lambda p: F.regexp_replace(p["a"], r"\A[^a-z]+", "").isin(STRUCTURES) & p["b"].rlike(r"\A[0-9a-z.()/-]"),
        ))
        several = ~structured & ~plain.rlike(r"\A[0-9]") & (F.size(words) > 1) & (counted >= 2)
        return _holds(date) | plain.rlike(r"\.{5,} ?[0-9]{1,4}\z") | _holds(within) | _holds(open_end) | _holds(several)

    return let(tokens(plain), test)


def carries_on(plain: Column) -> Column:
    """A lower-case fragment without a verb, a number or an end of its own."""
    words = F.regexp_extract_all(F.lower(plain), F.lit(r"[a-z]+"), F.lit(0))
    return plain.rlike(r"\A[a-z]") & ~plain.rlike(r"[.?!;:]\z") & ~at(words, 1).isin("note", "example") & ~F.arrays_overlap(words, F.array(*map(F.lit, VERBS)))


# --- The same rules in SQL ------------------------------------------------------------------


def _any(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def sql_columns(p: str) -> tuple[str, str]:
    """Columns that the rules over label column ``p`` use: tokens and words, then (over those) the first enactment."""
    first = f"regexp_extract_all(lower({p}), '\\p{{L}}+|[0-9]+') AS {p}_t, string_split(lower({p}), ' ') AS {p}_w"
    place = f"list_filter(range(2, len({p}_t)), lambda i: {p}_t[i] IN {_any(ENACTMENTS)} AND regexp_full_match({p}_t[i + 1], '[0-9]{{4}}'))[1] AS {p}_at"
    return first, place


def sql_rules(p: str) -> dict[str, str]:
    """Each rule as SQL over a label column and its ``sql_columns``, written out from the description of the rule."""
    t, w, place = f"{p}_t", f"{p}_w", f"{p}_at"
    behind, front = f"{t}[{place} + 2:]", f"{t}[:{place} - 1]"
    number = lambda x: f"({x}[1] = 'no' AND regexp_full_match({x}[2], '[0-9]{{4}}'))"
    numeral = lambda x: f"regexp_full_match({x}, '[ivxlcdm]{{1,10}}|[0-9]{{1,4}}')"
    year = lambda x: f"regexp_full_match({x}, '(18|19|20)[0-9]{{2}}')"
    next_to = lambda x, a, b: f"len(list_filter(range(1, len({x})), lambda i: {a} AND {b})) > 0"
    titled = f"regexp_full_match({p}, '[A-Za-z0-9 ,.''&()/-]*[A-Za-z0-9]') AND {place} IS NOT NULL"
    cited = f"regexp_replace({p}, '\\.$', '')"
    safe = lambda x: f"coalesce({x}, false)"
    return {
        "title": safe(f"({titled} AND len({behind}) = 0)"),
        "series": safe(f"""({titled} AND (coalesce({number(behind)} AND (len({behind}) = 2 OR (len({behind}) = 3 AND {numeral(behind + '[3]')})), false)
          OR coalesce({number(front)} AND len({front}) > 2 AND (len({behind}) = 0 OR (len({behind}) = 1 AND {numeral(behind + '[1]')})), false)))"""),
        "paged": safe(f"({titled} AND len({behind}) = 1 AND {numeral(behind + '[1]')})"),
        "loose": f"""(regexp_full_match({p}, '(18|19|20)[0-9]{{2}}\\.?|[0-9]{{1,4}}\\.') OR {next_to(t, f"{t}[i] IN {_any([e for e in ENACTMENTS if e != 'bill'])}", year(f'{t}[i + 1]'))}
          OR {safe(f"{w}[-4] IN ('section', 'sections') AND {w}[-2] = 'and'")} OR {next_to(t, f"{t}[i] IN {_any(STRUCTURES[:3])}", f"{t}[i + 1] IN ('or', 'and', 'must')")})""",
        "cited": safe(f"(regexp_full_match({cited}, '[A-Za-z][A-Za-z0-9 ,.''&()/-]*') AND regexp_matches({cited}, ' (18|19|20)[0-9]{{2}}$') AND {t}[-2] IN {_any(ENACTMENTS)} AND len({t}) > 2)"),
        "unfinished": f"""({safe(f"len({t}) = 3 AND regexp_full_match({t}[1], '[0-9]{{1,2}}') AND {t}[2] IN {_any([m.lower() for m in fixed.MONTHS])} AND {year(f'{t}[3]')}")}
          OR regexp_matches({p}, '\\.{{5,}} ?[0-9]{{1,4}}$') OR {safe(f"{w}[1] IN {_any(STRUCTURES)} AND len({w}) = 5 AND {w}[3] = 'of' AND {w}[4] IN {_any(STRUCTURES)}")}
          OR {safe(f"{w}[1] IN {_any(STRUCTURES)} AND len({w}) > 2 AND {w}[-1] IN {_any(OPEN_ENDS)}")}
          OR {safe(f'''{w}[1] NOT IN {_any(STRUCTURES)} AND NOT regexp_matches({p}, '^[0-9]') AND
            len(list_filter(range(1, len({w})), lambda i: regexp_replace({w}[i], '^[^a-z]+', '') IN {_any(STRUCTURES)} AND regexp_matches({w}[i + 1], '^[0-9a-z.()/-]'))) >= 2''')})""",
        "carries": f"""(regexp_matches({p}, '^[a-z]') AND NOT regexp_matches({p}, '[.?!;:]$') AND regexp_extract(lower({p}), '[a-z]+') NOT IN ('note', 'example')
          AND NOT list_has_any(regexp_extract_all(lower({p}), '[a-z]+'), ['{"', '".join(VERBS)}']))""",
    }
