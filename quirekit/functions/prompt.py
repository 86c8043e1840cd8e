"""Prompt assembly from rules as data (STR-41, STR-45, UDF-02)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Own wording: (profiles or None for all, formats or None for all, rule), in prompt order.
RULES = [
    (None, None, "Transcribe the document completely and in reading order."),
    (["newspaper"], None, "Keep articles, notices and advertisements apart; read each column from top to bottom."),
    (["modern_newspaper"], None, "Keep headlines, bylines and captions with their story; leave out page furniture."),
    (["legal", "government"], None, "Keep clause numbers, cross-references and schedules exactly."),
    (["handwritten", "archival", "medical"], None, "Mark every word you cannot read as [unclear]."),
    (["tabular", "forms"], ["html", "epub"], "Write tables with header cells and scopes."),
    (["poetry", "transcript"], None, "Keep line breaks as they are."),
    (None, ["html", "epub"], "Answer with semantic HTML blocks only."),
    (None, ["txt", "docx"], "Answer with plain text."),
    (None, ["md"], "Answer with Markdown."),
]


def build_prompt(profile: Column, fmt: Column, translate_to: Column, extra: Column) -> Column:
    """STR-41: the rules a profile and format call for, then translation and the user's own rule."""
    parts = []
    for profiles, formats, rule in RULES:
        applies = F.lit(True)
        if profiles:
            applies = applies & profile.isin(profiles)
        if formats:
            applies = applies & fmt.isin(formats)
        parts.append(F.when(applies, rule))
    parts.append(F.when(translate_to != "", F.concat(F.lit("Translate into "), translate_to, F.lit("."))))
    parts.append(F.when(extra != "", extra))
    return F.concat_ws("\n", *parts)
