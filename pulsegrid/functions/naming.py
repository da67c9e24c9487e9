"""Identifiers and names, as columns for rows and as strings for configurations."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = " :: "


def number_text(x: float) -> str:
    """A number as JSON writers of doubles print it: no trailing .0."""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, int) or float(x).is_integer() and abs(x) < 1e21:
        return str(int(x))
    return repr(float(x))


def window_id(record: Column, channel: Column, start: Column) -> Column:
    return F.concat(record.cast("string"), F.lit("/ch/"), channel.cast("string"), F.lit("/w"), start.cast("string"))


def candidate_id(model_id: str, version: str, analysis: Column, channel: Column, start: Column, end: Column) -> Column:
    span = F.concat(F.lit("["), start.cast("string"), F.lit(", "), end.cast("string"), F.lit(")"))
    return F.concat_ws(SEPARATOR, F.lit(f"{model_id}@{version}"), analysis, channel, span)


def filter_name(spec: dict) -> str:
    cut = spec["cutoff_hz"]
    cuts = "-".join(map(number_text, cut)) if isinstance(cut, (list, tuple)) else number_text(cut)
    return f"filter-{spec['type']}-{cuts}hz-{spec['phase']}"


def dwt_name(wavelet: str, level: int, mode: str = "periodic") -> str:
    return f"dwt-{wavelet}-level{level}-{mode}"


def idwt_name(wavelet: str, level: int, mode: str = "periodic") -> str:
    return f"i{dwt_name(wavelet, level, mode)}"


def normalisation_name(strategy: str, scope: str) -> str:
    return f"normalize-{strategy}-{scope}"


def resample_name(target_hz: float) -> str:
    return f"resample-{number_text(target_hz)}hz"


def derived_id(base: Column, transform: str) -> Column:
    return F.concat(base.cast("string"), F.lit(SEPARATOR + transform))


def with_transform(provenance: Column, name: str, parameters: dict | None = None, applied_at: str | None = None) -> Column:
    """provenance with one more step, the oldest first."""
    pairs = [F.lit(x) for k, v in (parameters or {}).items() for x in (k, v if isinstance(v, str) else json.dumps(v))]
    step = F.struct(F.lit(name).alias("name"), (F.create_map(*pairs) if pairs else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("parameters"), F.lit(applied_at).cast("string").alias("applied_at_iso"))
    return F.struct(provenance["source"].alias("source"), F.array_append(provenance["transforms"], step).alias("transforms"))


def analysis_id(dataset: Column, record: Column, dwt: str, filtered: str | None = None) -> Column:
    parts = [F.concat(dataset, F.lit("/"), record), *([F.lit(filtered)] if filtered else []), F.lit(dwt)]
    return F.concat_ws(SEPARATOR, *parts)


def selection_name(selection: dict) -> str:
    if selection["kind"] == "records":
        return f"records[{','.join(selection['recordIds'])}]"
    p = selection["partition"]
    return f"subject-partition:role={selection['role']}({'/'.join(number_text(p[k]) for k in ('train', 'validation', 'test'))})"


def window_name(window: dict) -> str:
    return f"w{window['windowLengthSamples']}s{window['strideSamples']}-{window['remainderPolicy']}"


def bare_name(name: str) -> str:
    return name.replace("\\", "/").rpartition("/")[2]


def bare_name_column(name: Column) -> Column:
    return F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1)


def split_name(name: str) -> tuple[str, str]:
    """(stem, extension in lower case); a leading dot is no extension."""
    stem, dot, ext = name.rpartition(".")
    return (stem, ext.lower()) if dot and stem else (name, "")


def stem_column(name: Column) -> Column:
    return F.when(name.rlike(r"^[\s\S]+\.[^.]*$"), F.regexp_extract(name, r"^([\s\S]+)\.[^.]*$", 1)).otherwise(name)


def extension_column(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"^[\s\S]+\.([^.]*)$", 1))


def canonical_json(value: object) -> str:
    """Key-sorted JSON without spaces; numbers that are not finite are null, and keys whose value is absent are left out."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return number_text(value) if math.isfinite(value) else "null"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in keys) + "}"
    return json.dumps(str(value))


#: The parameters of the 32-bit FNV-1a hash.
_FNV_START, _FNV_PRIME = 2166136261, 16777619


def fnv1a(text: str) -> str:
    """FNV-1a over UTF-16 code units, 8 hexadecimal digits."""
    h, raw = _FNV_START, text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = (h ^ int.from_bytes(raw[i : i + 2], "little")) * _FNV_PRIME % (1 << 32)
    return f"{h:08x}"


def utf16_units(text: Column) -> Column:
    """array<int> of a text's UTF-16 code units; characters above U+FFFF are two."""
    points = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c))
    beyond = lambda p: p - 0x10000
    pair = lambda p: F.array(F.lit(0xD800) + F.shiftright(beyond(p), 10), F.lit(0xDC00) + beyond(p).bitwiseAND(F.lit(0x3FF)))
    return F.flatten(F.transform(points, lambda p: F.when(p > 0xFFFF, pair(p)).otherwise(F.array(p))))


def fnv1a_column(text: Column) -> Column:
    """FNV-1a of a column's UTF-16 code units, 8 hexadecimal digits, as `fnv1a`."""
    step = lambda h, u: F.pmod(h.bitwiseXOR(u.cast("long")) * F.lit(_FNV_PRIME).cast("long"), F.lit(1 << 32).cast("long"))
    return F.lower(F.lpad(F.hex(F.aggregate(utf16_units(text), F.lit(_FNV_START).cast("long"), step)), 8, "0"))


def canonical_json_column(text: Column) -> Column:
    """JSON texts with sorted keys and without spaces, as `canonical_json`; null where a text is no JSON. Keys are sorted by code
    points, and numbers with an exponent are written as Spark writes them."""
    return F.to_json(F.try_parse_json(text))
