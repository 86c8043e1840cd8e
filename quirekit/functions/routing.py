"""Engine routing, effort and quality policies (CLS-09 to CLS-19, STM-08, STM-17)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirekit.functions import fixed
from quirekit.functions.models import literal_map, model_name


def sample_positions(total: Column, limit: int = fixed.SAMPLE_PAGES) -> Column:
    """WIN-13: page positions (from 0) to sample: nine spread-out ones, then a stride, in that order."""
    n = total.cast("int")
    spread = F.array_sort(
        F.array_distinct(
            F.array(
                F.lit(0), F.least(n - 1, F.lit(1)), F.least(n - 1, F.lit(2)), F.floor(n / 4).cast("int"),
                F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int"), F.floor(n * 2 / 3).cast("int"),
                F.floor(n * 3 / 4).cast("int"), n - 1,
            )
        )
    )
    stride = F.sequence(F.lit(0), n - 1, F.greatest(F.floor(n / limit), F.lit(1)).cast("int"))
    many = F.slice(F.array_distinct(F.concat(spread, stride)), 1, limit)
    return F.when(n <= limit, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(many)


def difficulty(
    profile: Column, pages: Column, avg_mb: Column, sampled: Column, textful: Column, avg_chars: Column
) -> Column:
    """CLS-09: how hard a PDF looks from its sampled pages."""
    adaptive = profile.isin(fixed.ADAPTIVE_PROFILES)
    return (
        F.when(profile.isin(fixed.FORCE_DEEP_PROFILES), "hard")
        .when(profile.isin(fixed.SPECIALTY_PROFILES), "specialty")
        .when((pages >= 120) & (avg_mb >= 0.75) & (textful <= 1), "hard")
        .when((textful == sampled) & (avg_chars >= 1400) & (avg_mb <= 0.35) & adaptive, "easy")
        .when(
            (textful >= F.greatest(sampled - 1, F.lit(1))) & (avg_chars >= 700) & (avg_mb <= 0.55) & adaptive, "mixed"
        )
        .otherwise("hard")
    )


def route(baseline: Column, override: Column, ext: Column, profile: Column, hardness: Column) -> Column:
    """CLS-11: ``struct(model_name, routing_mode, auto_escalation_model, difficulty)``."""
    base = model_name(baseline)
    manual = F.trim(F.coalesce(override, F.lit(""))) != ""
    examined = ~manual & (ext == ".pdf")
    lighter = (
        examined
        & (base == fixed.PRO_MODEL)
        & hardness.isin("easy", "mixed")
        & profile.isin([*fixed.ADAPTIVE_PROFILES, "legal"])
    )
    deeper = examined & base.isin(fixed.FLASH_MODEL, fixed.PRO_MODEL) & (hardness == "hard")
    return F.struct(
        F.when(lighter, fixed.FLASH_MODEL).when(deeper, fixed.PRO_MODEL).otherwise(base).alias("model_name"),
        F.when(manual, "manual").otherwise("automatic").alias("routing_mode"),
        F.when(lighter, fixed.PRO_MODEL).alias("auto_escalation_model"),
        F.when(examined, hardness).otherwise("baseline").alias("difficulty"),
    )


def chunk_pages(model: Column, profile: Column, pages: Column, size_mb: Column) -> Column:
    """CLS-12: pages sent per request."""
    name = F.lower(model_name(model))
    avg_mb = size_mb / F.greatest(pages, F.lit(1))
    periodical = profile.isin(fixed.PERIODICAL_PROFILES)
    pro = name.contains(fixed.PRO_MODEL)
    records = profile.isin("legal", "government")
    return (
        F.when(periodical & (avg_mb >= 0.9), 1)
        .when(periodical & (pages >= 30) & (name.contains("claude") | name.contains("gpt")), 1)
        .when(periodical & (pages >= 30) & pro, 2)
        .when(records & (pages >= 150), 1)
        .when(records & pro & (pages >= 60), 2)
        .when(profile == "comic", 1)
        .otherwise(2)
    )


def effort(profile: Column, model: Column, units: Column, size_mb: Column) -> Column:
    """CLS-13."""
    name = F.lower(model_name(model))
    slow = (name == fixed.PRO_MODEL) | name.contains("claude") | name.contains("gpt")
    score = (
        F.greatest(F.coalesce(units, F.lit(0)), F.lit(0))
        + F.when(profile.isin(fixed.HEAVY_PROFILES), 8).otherwise(0)
        + F.when(slow, 6).otherwise(0)
        + F.when(size_mb >= 100, 10).otherwise(0)
    )
    return F.when(score >= 70, "very long").when(score >= 25, "long").when(score >= 8, "medium").otherwise("small")


def speed_warning_kind(profile: Column, model: Column) -> Column:
    """CLS-14: why a run may be slow: its profile, the deep engine, another vendor, or nothing."""
    name = F.lower(model_name(model))
    return (
        F.when(profile.isin(fixed.SLOW_PROFILES), "profile")
        .when(name == fixed.PRO_MODEL, "deep engine")
        .when(name.contains("claude") | name.contains("gpt"), "other vendor")
        .otherwise("")
    )


def quality_band(score10: Column) -> Column:
    """CLS-15: wording for a page score out of ten."""
    return (
        F.when(score10 >= 8.5, "Clear page quality.")
        .when(score10 >= 7.0, "Good quality with minor degradation.")
        .when(score10 >= 5.0, "Moderate degradation; some text may be difficult.")
        .otherwise("Heavy degradation; risk of missed text.")
    )


def page_score(penalty: Column) -> Column:
    """CLS-15: page score out of ten from summed penalties."""
    kept = F.least(F.greatest(1.0 - penalty, F.lit(0.0)), F.lit(1.0))
    return F.least(F.greatest(kept * 10.0, F.lit(1.0)), F.lit(10.0))


def image_quality(contrast: Column, luma: Column, blur: Column, stain: Column) -> Column:
    """CLS-16: ``struct(score, summary)`` from measured image statistics."""
    checks = [
        (contrast < 34, 1.8, "possible faded writing"),
        (luma > 205, 1.1, "washed background / low ink separation"),
        (blur < 85, 1.3, "soft/blurred text edges"),
        (stain > 0.09, 1.7, "possible water damage or staining artifacts"),
    ]
    lost = reduce(lambda a, b: a + b, [F.when(hit, cost).otherwise(0.0) for hit, cost, _ in checks])
    notes = F.concat_ws("; ", *[F.when(hit, note) for hit, _, note in checks])
    sentence = F.concat(F.upper(F.substring(notes, 1, 1)), F.substring(notes, 2, 1000), F.lit("."))
    return F.struct(
        F.least(F.greatest(9.5 - lost, F.lit(1.0)), F.lit(10.0)).alias("score"),
        F.when(notes == "", "Clear page quality.").otherwise(sentence).alias("summary"),
    )


# Fixed scorecard penalties and grade bands.
SCORE_PENALTIES = {
    "has_lang_dir_root": 10, "has_main_landmark": 10, "has_h1": 10, "has_h2": 10,
    "has_page_header_cite": 20, "has_source_footer_cite": 20, "has_image_description": 15,
    "no_empty_panel_sections": 15,
}
PROFILE_CHECKS = {
    "newspaper": ["has_page_header_cite", "has_source_footer_cite", "has_image_description"],
    "comic": ["has_image_description", "no_empty_panel_sections"],
}
GRADE_BANDS = [
    (97, "A+"), (93, "A"), (90, "A-"), (87, "B+"), (83, "B"), (80, "B-"),
    (77, "C+"), (73, "C"), (70, "C-"), (60, "D"), (0, "F"),
]


def accessibility_score(profile: Column, checks: dict[str, Column]) -> Column:
    """CLS-19: ``struct(score, grade)``; profile checks count only for their profile."""
    lost = F.lit(0)
    for name, cost in SCORE_PENALTIES.items():
        owners = [p for p, names in PROFILE_CHECKS.items() if name in names]
        applies = profile.isin(owners) if owners else F.lit(True)
        lost = lost + F.when(applies & ~checks[name], cost).otherwise(0)
    score = F.greatest(100 - lost, F.lit(0))
    grade = F.coalesce(*[F.when(score >= floor, name) for floor, name in GRADE_BANDS])
    return F.struct(score.cast("double").alias("score"), grade.alias("grade"))


def error_action(message: Column) -> Column:
    """STM-17: what to do about a provider error."""

    def among(tokens: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [F.lower(message).contains(t) for t in tokens])

    return (
        F.when(among(fixed.AUTH_ERRORS), "fail: authentication")
        .when(among(fixed.CONNECTION_ERRORS), "fail: connection")
        .when(among(fixed.RETRYABLE_ERRORS), "retry")
        .otherwise("raise")
    )


def backoff_seconds(attempt: Column, base: int = fixed.RETRY_BASE_SEC, cap: int = fixed.RETRY_CAP_SEC) -> Column:
    """STM-08: wait before the next try, without jitter; attempts count from 0."""
    return F.least(F.lit(float(cap)), base * F.pow(F.lit(2.0), attempt))


def language_code(target: Column, translating: Column) -> Column:
    """STR-40."""
    by_name = literal_map({name.lower(): code for name, code in fixed.TRANSLATION_TARGETS.items()})
    return F.when(~translating, "und").otherwise(F.coalesce(by_name[F.lower(F.trim(target))], F.lit("en")))


def text_direction(target: Column, translating: Column) -> Column:
    """STR-40."""
    rtl = language_code(target, translating).isin(fixed.RTL_LANGUAGES)
    return F.when(~translating, "auto").when(rtl, "rtl").otherwise("ltr")
