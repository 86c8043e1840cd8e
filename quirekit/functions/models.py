"""Engine names, vendors, presets and fallbacks, looked up without joins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirekit.functions import fixed


def quoted(value: str | None) -> str:
    """A string literal in Spark SQL."""
    if value is None:
        return "CAST(NULL AS STRING)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_array(values: list[str | None]) -> Column:
    """A fixed list as one array literal, parsed in a single call."""
    return F.expr("array(" + ", ".join(map(quoted, values)) + ")")


def literal_map(values: dict[str, str]) -> Column:
    """A fixed dictionary as a map literal, so that a lookup needs no join."""
    return F.expr("map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in values.items()) + ")")


def model_name(col: Column) -> Column:
    """CLS-14: blank means the default engine; retired names map to their successor."""
    name = F.trim(F.coalesce(col, F.lit("")))
    return F.when(name == "", fixed.FLASH_MODEL).otherwise(F.coalesce(literal_map(fixed.MODEL_ALIASES)[name], name))


def model_vendor(col: Column) -> Column:
    name = F.lower(model_name(col))
    return F.when(name.contains("claude"), "claude").when(name.contains("gpt"), "openai").otherwise("gemini")


def preset(profile: Column) -> Column:
    """JOI-05: a profile's preset flags; unknown profiles use the standard ones."""
    key = F.when(profile.isin(fixed.PROFILES), profile).otherwise("standard")

    def among(names: list[str]) -> Column:
        return key.isin(names)

    return F.struct(
        F.coalesce(literal_map(fixed.PRESET_MODEL_EXCEPTIONS)[key], F.lit(fixed.PRO_MODEL)).alias("model_name"),
        among(fixed.PRESET_PUNCTUATION).alias("modernize_punctuation"),
        among(fixed.PRESET_UNITS).alias("unit_conversion"),
        among(fixed.PRESET_ABBREVIATIONS).alias("abbrev_expansion"),
        (~among(fixed.PRESET_NO_IMAGES)).alias("image_descriptions"),
        among(fixed.PRESET_PAGE_NUMBERS).alias("preserve_original_page_numbers"),
        among(fixed.PRESET_MERGE).alias("merge_files"),
    )


def preferred_model(profile: Column, override: Column) -> Column:
    chosen = F.trim(F.coalesce(override, F.lit("")))
    return F.when(chosen != "", model_name(chosen)).otherwise(preset(profile)["model_name"])


def available_model(model: Column, keys: list[str]) -> Column:
    """JOI-07: first fallback whose vendor has a key, else the model asked for."""
    wanted = model_name(model)
    ranked = F.create_map(
        *[part for name, backups in fixed.MODEL_FALLBACKS.items() for part in (F.lit(name), F.array(*map(F.lit, backups)))]
    )
    usable = F.filter(F.coalesce(ranked[wanted], F.array(wanted)), lambda m: model_vendor(m).isin(keys))
    return F.coalesce(F.try_element_at(usable, F.lit(1)), wanted)
