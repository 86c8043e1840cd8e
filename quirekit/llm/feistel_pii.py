"""Personal data replaced by format-preserving Feistel pseudonyms.

Values are found by pattern, validated (Luhn digit, mod-97 check, calendar date, octet range and so on), and permuted
within their format by a keyed Feistel network: digits stay digits, letters keep their case, separators their places,
check digits are worked out anew, and the result is valid by the same test. The permutation depends on the key and the
kind alone, so equal values get equal pseudonyms in every document and different values different ones, without any
table or shuffle. A result that fails its test is permuted again until it passes (cycle walking), which stays one to one.

``KINDS`` lists what is found. An e-mail address keeps its domain; a card its first digit; a phone number its country
code; keys and tokens keep their marker. Of a card, IBAN or phone number followed by more digits or words the longest
part that is valid and ends at a gap is taken (of an IBAN first the one of its country's length). Values that fail
validation are left as they are.

Defined cases: a null text stays null, an empty one empty; texts are scanned whole; overlapping values are taken from the
left, longest kind first; repeated rows get equal results.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import string
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirekit.llm.common import bounded_batches

#: Rounds of the network; the key of the registered query (a real run gives its own).
ROUNDS, QUERY_KEY = 8, b"example key, replace in production"
_ALPHABETS = (string.digits, string.ascii_lowercase, string.ascii_uppercase)
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


def _round(key: bytes, tweak: str, turn: int, half: tuple[int, ...], modulus: int) -> int:
    text = f"{tweak}|{turn}|{','.join(map(str, half))}".encode()
    return int.from_bytes(hashlib.blake2b(text, key=key, digest_size=32).digest(), "big") % modulus


def _number(values: Iterable[int], radices: list[int]) -> tuple[int, int]:
    """Mixed-radix digits as a number, and how many numbers there are."""
    number, count = 0, 1
    for value, radix in zip(values, radices, strict=True):
        number, count = number * radix + value, count * radix
    return number, count


def _values(number: int, radices: list[int]) -> tuple[int, ...]:
    out = []
    for radix in reversed(radices):
        number, value = divmod(number, radix)
        out.append(value)
    return tuple(reversed(out))


def _network(values: tuple[int, ...], radices: list[int], key: bytes, tweak: str, turns: Iterable[int], sign: int) -> tuple[int, ...]:
    cut = len(values) // 2
    halves, sizes = [values[:cut], values[cut:]], [radices[:cut], radices[cut:]]
    for turn in turns:
        side = (turn + 1) % 2
        number, count = _number(halves[side], sizes[side])
        halves[side] = _values((number + sign * _round(key, tweak, turn, halves[1 - side], count)) % count, sizes[side])
    return halves[0] + halves[1]


def permute(values: list[int], radices: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of mixed-radix numbers that leaves none of them in place (if there are two or more).

    The Feistel network adds to each half in turn a hash of the other. Its result is moved on by one and taken back
    through the network, which makes all numbers one cycle: a value never becomes itself, also where few are possible.
    """
    tweak = f"{tweak}|{','.join(map(str, radices))}"
    there = _network(tuple(values), radices, key, tweak, range(ROUNDS), 1)
    number, count = _number(there, radices)
    return list(_network(_values((number + 1) % count, radices), radices, key, tweak, range(ROUNDS - 1, -1, -1), -1))


def permute_text(text: str, key: bytes, tweak: str, alphabet: str | None = None) -> str:
    """Letters and digits permuted within their class (or within ``alphabet``); other characters stay in place."""
    places, values, sets = [], [], []
    for i, c in enumerate(text):
        own = alphabet if alphabet and c in alphabet else next((a for a in _ALPHABETS if c in a), None)
        if own:
            places.append(i)
            values.append(own.index(c))
            sets.append(own)
    out = list(text)
    for i, value, own in zip(places, permute(values, [len(a) for a in sets], key, tweak), sets, strict=True):
        out[i] = own[value]
    return "".join(out)


def walk(value: str, change: Callable[[str], str], valid: Callable[[str], bool]) -> str:
    """Apply the permutation until the result is valid again; it comes back to a valid value at the latest at ``value``."""
    value = change(value)
    while not valid(value):
        value = change(value)
    return value


# --- Kinds: validation and pseudonym ---------------------------------------------------


def luhn_digit(digits: str) -> str:
    """The check digit that follows the given digits."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = 2 * d if i % 2 == 0 else d
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _fill(text: str, digits: str) -> str:
    """The text with its digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in text)


def card_valid(text: str) -> bool:
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and digits[0] in "23456" and luhn_digit(digits[:-1]) == digits[-1]


def card(text: str, key: bytes) -> str:
    digits = _digits(text)
    body = digits[0] + permute_text(digits[1:-1], key, f"card {digits[0]}")
    return _fill(text, body + luhn_digit(body))


def phone_valid(text: str) -> bool:
    digits = _digits(text)
    if text.startswith("+1") or not text.startswith("+"):
        local = digits[-10:]
        return len(digits) in (10, 11) and local[0] in "23456789" and local[3] in "23456789"
    return 8 <= len(digits) <= 15


def phone(text: str, key: bytes) -> str:
    code = re.match(r"\+\d{1,3}(?=[ .(-])|\+1|1(?=[ .(-])|", text)[0]
    return walk(text, lambda t: code + permute_text(t[len(code) :], key, f"phone {code}"), phone_valid)


def ssn_valid(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def ssn(text: str, key: bytes) -> str:
    return walk(text, lambda t: permute_text(t, key, "ssn"), ssn_valid)


def ip_valid(text: str) -> bool:
    octets = [int(x) for x in text.split(".")]
    return all(o < 256 for o in octets) and 0 < octets[0] < 224 and all(str(o) == x for o, x in zip(octets, text.split("."), strict=True))


def ip(text: str, key: bytes) -> str:
    def change(t: str) -> str:
        return ".".join(map(str, permute([int(x) for x in t.split(".")], [256] * 4, key, "ip")))

    return walk(text, change, ip_valid)


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and _mod97(plain) == 1


def iban(text: str, key: bytes) -> str:
    plain = text.replace(" ", "")
    body = permute_text(plain[4:], key, f"iban {plain[:2]}")
    check = 98 - _mod97(plain[:2] + "00" + body)
    left = iter(plain[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(left) for c in text)


def _date(text: str) -> tuple[datetime.date, Callable[[datetime.date], str]] | None:
    """The date and how to write another in the same way; day first unless only month first is a date."""
    parts, marks = re.split(r"[-/.]", text), re.findall(r"[-/.]", text)
    if len(set(marks)) != 1:
        return None
    orders = ["ymd"] if len(parts[0]) == 4 else ["dmy", "mdy"]
    for order in orders:
        try:
            day = datetime.date(**{{"y": "year", "m": "month", "d": "day"}[o]: int(p) for o, p in zip(order, parts, strict=True)})
        except ValueError:
            continue
        if 0 <= day.toordinal() - _FIRST_DAY < _DAYS:
            return day, lambda d, order=order: marks[0].join(f"{getattr(d, {'y': 'year', 'm': 'month', 'd': 'day'}[o]):0{len(p)}d}" for o, p in zip(order, parts, strict=True))
    return None


def date_valid(text: str) -> bool:
    return _date(text) is not None


def date(text: str, key: bytes) -> str:
    """Dates of 1900 to 2099 permuted among those written with as many digits; an ambiguous result keeps the order it is read in."""
    day, write = _date(text)
    widths = [len(p) for p in re.split(r"[-/.]", text)]
    order = "ymd" if widths[0] == 4 else write(datetime.date(2000, 1, 31)).split(text[widths[0]])[0].zfill(2)
    rows, place = -(-_DAYS // 256), day.toordinal() - _FIRST_DAY
    while True:
        high, low = permute([place // 256, place % 256], [rows, 256], key, f"date {order}")
        place = high * 256 + low
        if place < _DAYS:
            new = write(datetime.date.fromordinal(_FIRST_DAY + place))
            again = _date(new)
            if again and write(again[0]) == new and [len(p) for p in re.split(r"[-/.]", new)] == widths:
                return new


def email(text: str, key: bytes) -> str:
    local, _, domain = text.rpartition("@")
    return f"{permute_text(local, key, 'email ' + domain.lower())}@{domain}"


def _after(mark: str) -> Callable[[str, bytes], str]:
    def change(text: str, key: bytes) -> str:
        cut = re.match(mark, text).end()
        return text[:cut] + permute_text(text[cut:], key, "secret")

    return change


def hex_token(text: str, key: bytes) -> str:
    return permute_text(text, key, "hex", "0123456789abcdef" if text.islower() or text.isdigit() else "0123456789ABCDEF")


def _always(text: str) -> bool:
    return True


#: Kind, pattern, test, pseudonym; tried at each place in this order.
KINDS: list[tuple[str, str, Callable[[str], bool], Callable[[str, bytes], str]]] = [
    ("email", r"(?<![\w.+%-])[A-Za-z0-9_][\w.+%-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])", _always, email),
    ("access_key", r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)", _always, _after("[A-Z]{4}")),
    ("secret", r"(?<!\w)(?:gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[bp]-[A-Za-z0-9-]{10,})(?![\w-])", _always, _after(r"gh\w_|sk-|xox\w-")),
    ("hex_token", r"(?<!\w)(?:[0-9a-f]{40}|[0-9A-F]{40}|[0-9a-f]{64}|[0-9a-f]{32})(?!\w)", _always, hex_token),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)", iban_valid, iban),
    ("date", r"(?<![\w./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}([/.-])\d{1,2}\1\d{4})(?=[Tt]\d{2}|(?!\w|[./-]\d))", date_valid, date),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", ssn_valid, ssn),
    ("ip", r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)", ip_valid, ip),
    ("card", r"(?<![\w-])\d(?:[ -]?\d){12,18}(?!\w)", card_valid, card),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<![\w+])\+\d{8,15}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,8}){1,5}(?!\w)", phone_valid, phone),
]
_ANY = re.compile("|".join(f"(?P<{kind}>{pattern.replace(chr(92) + '1', '(?P=mark)').replace('([/.-])', '(?P<mark>[/.-])')})" for kind, pattern, _, _ in KINDS))
_BY_KIND = {kind: (test, change) for kind, _, test, change in KINDS}
#: Kinds of varying length, without what may not stand beside them: shorter values are tried where the longest is not valid.
_SHORTER = {
    "iban": re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?"),
    "card": re.compile(r"\d(?:[ -]?\d){12,18}"),
    "phone": re.compile(r"\+\d{1,3}(?:[ .-]\d{2,8}){1,5}"),
}
_IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM TL SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_HINT = re.compile(r"[0-9@]|A[KS]IA|gh[pousr]_|sk-|xox")


@lru_cache(maxsize=100_000)
def pseudonym(kind: str, value: str, key: bytes) -> str:
    return _BY_KIND[kind][1](value, key)


def _end(kind: str, text: str, start: int) -> int | None:
    """Where the value of the kind that begins at ``start`` ends: an IBAN of its country's length, else the longest that is valid."""
    found, test = _PATTERNS[kind].match(text, start), _BY_KIND[kind][0]
    if not found:
        return None
    if kind not in _SHORTER:
        return found.end() if test(found[0]) else None
    if kind == "card" and text[start] not in "23456":
        return None
    ends, usual = [found.end()], _IBAN_LENGTHS.get(text[start : start + 2]) if kind == "iban" else None
    if usual or not test(found[0]):
        ends += [e for e in range(found.end() - 1, start + 7, -1) if text[e - 1].isalnum() and not (text[e].isalnum() or text[e] == "_")]
    if usual:
        ends.sort(key=lambda e: len(text[start:e].replace(" ", "")) != usual)
    return next((e for e in ends if (e == found.end() or _SHORTER[kind].fullmatch(text, start, e)) and test(text[start:e])), None)


def spans(text: str) -> Iterator[tuple[int, int, str]]:
    """``(start, end, kind)`` of the validated values of a text, in order."""
    at = 0
    while True:
        found = _ANY.search(text, at)
        if not found:
            return
        first, start = found.lastgroup if found.lastgroup != "mark" else "date", found.start()
        # Another kind may fit the same place; else go on behind the next character.
        for kind in (first, *(k for k in _BY_KIND if k != first)):
            end = _end(kind, text, start)
            if end is not None:
                yield start, end, kind
                at = end
                break
        else:
            at = start + 1


_PATTERNS = {kind: re.compile(pattern) for kind, pattern, _, _ in KINDS}


def pseudonymise(text: str | None, key: bytes) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with its values replaced, and the spans (in the old text) with their kinds."""
    if not text or not _HINT.search(text):
        return text, []
    out, at, found = [], 0, list(spans(text))
    for start, end, kind in found:
        out += [text[at:start], pseudonym(kind, text[start:end], key)]
        at = end
    return "".join([*out, text[at:]]), found


def pseudonymise_documents(docs: DataFrame, key: bytes = QUERY_KEY, text_col: str = "text") -> DataFrame:
    """All columns with ``text`` replaced, and ``pii``: an array of ``start, end, kind`` in code points of the old text."""
    from pyspark.sql import types as T

    bounded_batches(docs.sparkSession)
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("pii", T.ArrayType(span))])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in batches:
            done = [pseudonymise(t, key) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array([t for t, _ in done], pa.string())
            marks = [[{"start": a, "end": b, "kind": k} for a, b, k in s] for _, s in done]
            yield pa.record_batch([*columns, pa.array(marks, kind)], [*batch.schema.names, "pii"])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, key: bytes = QUERY_KEY) -> DataFrame:
    """``doc_id``, the new text, and how many values of which kinds were replaced."""
    done = pseudonymise_documents(docs.select("doc_id", "text"), key)
    return done.select("doc_id", "text", F.size("pii").alias("n_replaced"), F.array_join(F.array_sort(F.array_distinct("pii.kind")), ",").alias("kinds"), "pii")
