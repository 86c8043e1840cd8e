"""Abbreviation expansion (STR-30, JOI-06) from glossaries.

A glossary is a table of ``(abbreviation, wording)``. Its small built-in lists hold common English abbreviations; a
run adds or replaces entries with ``extra``. An abbreviation of capitals alone is read as initials: with or without
dots, in capitals only. Others match in any case. Both may end with a full stop.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirekit.functions import fixed
from quirekit.functions.models import literal_map
from quirekit.functions.rewrite import let, map_between, map_matches

Entry = tuple[str, str]

# Common English abbreviations, by field and in order of the alphabet.
GLOSSARIES: dict[str, list[Entry]] = {
    "civil_titles": [
        ("Bros", "Brothers"), ("Cllr", "Councillor"), ("Esq", "Esquire"), ("Gov", "Governor"), ("Hon", "Honourable"),
        ("JP", "Justice of the Peace"), ("Jnr", "Junior"), ("MP", "Member of Parliament"), ("Messrs", "Messieurs"),
        ("Prof", "Professor"), ("Rev", "Reverend"), ("Sen", "Senator"), ("Snr", "Senior"),
    ],
    "historical_newspaper": [
        ("Ald", "Alderman"), ("Ave", "Avenue"), ("Bldg", "Building"), ("Cnr", "Corner"), ("Cr", "Creditor"),
        ("Dept", "Department"), ("Govt", "Government"), ("NSW", "New South Wales"), ("NZ", "New Zealand"), ("Qld", "Queensland"),
        ("Rd", "Road"), ("SS", "Steamship"), ("Sq", "Square"), ("Tce", "Terrace"), ("UK", "United Kingdom"), ("US", "United States"),
        ("approx", "approximately"), ("cwt", "hundredweight"), ("doz", "dozen"), ("inst", "this month"), ("lb", "pound"),
        ("oz", "ounce"), ("pd", "paid"), ("prox", "next month"), ("recd", "received"), ("ult", "last month"), ("wk", "week"), ("yr", "year"),
    ],
    "medical": [
        ("BP", "blood pressure"), ("BMI", "body mass index"), ("CPR", "cardiopulmonary resuscitation"), ("CT", "computed tomography"),
        ("DNA", "deoxyribonucleic acid"), ("ECG", "electrocardiogram"), ("GP", "general practitioner"), ("ICU", "intensive care unit"),
        ("IV", "intravenous"), ("MRI", "magnetic resonance imaging"), ("PRN", "as needed"), ("RNA", "ribonucleic acid"),
        ("WHO", "World Health Organization"),
    ],
    "military": [
        ("ADC", "aide-de-camp"), ("Adjt", "Adjutant"), ("Adm", "Admiral"), ("Bde", "Brigade"), ("Bn", "Battalion"),
        ("CO", "Commanding Officer"), ("Capt", "Captain"), ("Cdr", "Commander"), ("Cmdre", "Commodore"), ("Col", "Colonel"),
        ("Coy", "Company"), ("Cpl", "Corporal"), ("FM", "Field Marshal"), ("Fus", "Fusilier"), ("Gen", "General"),
        ("HMS", "Her Majesty's Ship"), ("HQ", "Headquarters"), ("KIA", "killed in action"), ("LCpl", "Lance Corporal"), ("Lt", "Lieutenant"),
        ("Maj", "Major"), ("Mne", "Marine"), ("NCO", "non-commissioned officer"), ("OC", "Officer Commanding"), ("POW", "prisoner of war"),
        ("Pl", "Platoon"), ("Pte", "Private"), ("QM", "Quartermaster"), ("RAAF", "Royal Australian Air Force"), ("RAF", "Royal Air Force"),
        ("RN", "Royal Navy"), ("Regt", "Regiment"), ("Sgt", "Sergeant"), ("Sqn", "Squadron"), ("Tp", "Troop"), ("USN", "United States Navy"),
        ("WO", "Warrant Officer"),
    ],
    "modern_newspaper": [
        ("AP", "Associated Press"), ("ASAP", "as soon as possible"), ("BBC", "British Broadcasting Corporation"), ("CEO", "chief executive officer"),
        ("EU", "European Union"), ("FAQ", "frequently asked questions"), ("GDP", "gross domestic product"), ("IMF", "International Monetary Fund"),
        ("NATO", "North Atlantic Treaty Organization"), ("UN", "United Nations"), ("VAT", "value-added tax"), ("WHO", "World Health Organization"),
    ],
}


def is_initials(abbreviation: str) -> bool:
    return abbreviation.isupper()


def pattern_of(abbreviation: str) -> str:
    """The pattern of one abbreviation, its final full stop included."""
    if is_initials(abbreviation):
        return r"\b" + r"\.?".join(abbreviation) + r"\b\.?"
    return rf"(?i)\b{re.escape(abbreviation)}\b\.?"


def entries_for(profile: str | None, extra: list[Entry] = ()) -> list[Entry]:
    """JOI-06: a profile's entries in glossary order, each once, own additions first so that they win."""
    names = fixed.PROFILE_GLOSSARIES.get((profile or "military").lower(), fixed.DEFAULT_GLOSSARIES)
    entries: dict[str, str] = {}
    for abbreviation, wording in [*extra, *(entry for name in names for entry in GLOSSARIES[name])]:
        entries.setdefault(abbreviation, wording)
    return list(entries.items())


def glossary_table(spark: SparkSession) -> DataFrame:
    """``glossary, place, abbreviation, wording``: the built-in entries as a table."""
    rows = [(name, i, *entry) for name, entries in GLOSSARIES.items() for i, entry in enumerate(entries)]
    return spark.createDataFrame(rows, "glossary string, place int, abbreviation string, wording string")


def profile_table(spark: SparkSession) -> DataFrame:
    """``profile, rank, glossary``: which glossaries a profile uses; the null profile stands for any other."""
    named = [*fixed.PROFILE_GLOSSARIES.items(), (None, fixed.DEFAULT_GLOSSARIES)]
    rows = [(profile, i, name) for profile, names in named for i, name in enumerate(names)]
    return spark.createDataFrame(rows, "profile string, rank int, glossary string")


def _from_first_letter(letter: str, abbreviations: list[str]) -> str:
    """One choice of the pattern: initials first, other abbreviations in any case, all of them beginning with a letter."""
    initials = [r"\.?".join(["", *a[1:]]) for a in abbreviations if is_initials(a)]
    words = [re.escape(a[1:]) for a in abbreviations if not is_initials(a)]
    choices = [re.escape(letter.upper()) + f"(?:{'|'.join(initials)})"] if initials else []
    return "|".join(choices + ([f"(?i:{re.escape(letter)}(?:{'|'.join(words)}))"] if words else []))


def expand_with(col: Column, entries: list[Entry]) -> Column:
    """STR-30: expand the text between tags in one pass; tags stay untouched.

    All abbreviations are one literal pattern, and a map gives the wording of what it finds: initials by their letters,
    other abbreviations by their lower-case form.
    """
    longest = sorted((a for a, _ in entries), key=lambda a: (not is_initials(a), -len(a), a))
    choices = [_from_first_letter(letter, [a for a in longest if a[0].lower() == letter]) for letter in sorted({a[0].lower() for a in longest})]
    first = "".join(sorted({form for a in longest for form in ({a[0]} if is_initials(a) else {a[0].lower(), a[0].upper()})}))
    wording = literal_map({a if is_initials(a) else a.lower(): w for a, w in reversed(entries)})

    def worded(match: Column) -> Column:
        letters = F.translate(match, ".", "")
        return F.coalesce(wording[letters], wording[F.lower(letters)], match)

    def expand(segment: Column) -> Column:
        return map_matches(segment, rf"(?=[{re.escape(first)}])\b(?:{'|'.join(choices)})\b\.?", worded)

    return let(col, lambda body: F.when(F.contains(body, F.lit("<")), map_between(body, r"<[^>]+>", expand)).otherwise(expand(body)))


def expand_abbreviations(col: Column, profile: Column, extra: list[Entry] = ()) -> Column:
    """STR-30 with the profile as data: profiles that share glossaries share one pattern."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for name, glossaries in fixed.PROFILE_GLOSSARIES.items():
        groups.setdefault(tuple(glossaries), []).append(name)
    return let(F.lower(profile), lambda name: _by_group(col, name, groups, list(extra)))


def _by_group(col: Column, name: Column, groups: dict[tuple[str, ...], list[str]], extra: list[Entry]) -> Column:
    result = expand_with(col, entries_for(None, extra))
    for members in groups.values():
        result = F.when(name.isin(members), expand_with(col, entries_for(members[0], extra))).otherwise(result)
    return result
