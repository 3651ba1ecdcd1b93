"""Scalar functions on names, paths and text fields (column in, column out)."""

from __future__ import annotations

import random
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of episode directories that are left out.
EXCLUDED_ENDINGS = ("failed", "ood", "ikbad", "heated", "stop", "hard")
# Words for true and for false.
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "y"), ("false", "0", "no", "n")
# Label and memory by pattern, first match counts.
GPU_LABELS = (("h200", "h200"), ("b200", "b200"), ("h100", "h100"), ("a100[_-]80g", "a100_80g"), ("a100[_-]40g", "a100_40g"), ("a100", "a100"), ("a40", "a40"), ("a6000", "a6000"), ("v100", "v100"), ("t4", "t4"))
GPU_MEMORY = (("b200", "180G"), ("h200", "141G"), ("h100", "80G"), ("a100", "40G/80G"), ("a40", "48G"), ("a6000", "48G"), ("v100", "16G/32G"), ("t4", "16G"))


def stream_base(name: Column) -> Column:
    """``base`` of ``base_N``; names without a number stay whole."""
    return F.when(name.rlike("^.*_[0-9]+$"), F.regexp_extract(name, "^(.*)_([0-9]+)$", 1)).otherwise(name)


def stream_index(name: Column) -> Column:
    """``N`` of ``base_N``; 0 for names without a number."""
    return F.coalesce(F.regexp_extract(name, "^(.*)_([0-9]+)$", 2).try_cast("int"), F.lit(0))


def is_excluded(name: Column, endings: tuple[str, ...] = EXCLUDED_ENDINGS) -> Column:
    return name.rlike(f"({'|'.join(endings)})$")


def starts_with_any(name: Column, prefixes: Column) -> Column:
    """prefixes: text such as ``a-b-c``; true if the name starts with any of them, or if there are none."""
    return prefixes.isNull() | (prefixes == "") | F.exists(F.split(prefixes, "-"), lambda p: name.startswith(p))


def stem_time(stem: Column) -> Column:
    """Time in a file stem such as 2024-01-31T12-34-56-789012, the fraction optional; null if it isn't one."""
    whole = F.try_to_timestamp(stem, F.lit("yyyy-MM-dd'T'HH-mm-ss-SSSSSS"))
    return F.when(stem.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}(-\d{1,6})?$"), F.coalesce(whole, F.try_to_timestamp(stem, F.lit("yyyy-MM-dd'T'HH-mm-ss"))))


def name_of_time(iso: Column) -> Column:
    return F.translate(iso, ":.", "--")


def average_fps(text: Column) -> Column:
    """The number after ``Average FPS:``; null if there is none or it isn't above 0."""
    value = F.regexp_extract(text, r"Average FPS:\s*([0-9.eE+-]+)", 1).try_cast("double")
    return F.when(value > 0, value)


def size_pair(text: Column) -> Column:
    """``WxH`` as struct<width, height>; null if it isn't one."""
    parts = F.split(F.lower(text), "x")
    w, h = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    return F.when((F.size(parts) == 2) & w.isNotNull() & h.isNotNull() & (w > 0) & (h > 0), F.struct(w.alias("width"), h.alias("height")))


def memory_mb(text: Column) -> Column:
    """Memory text such as 512M, 2G, 1T or 1024K in MB; a plain number is MB already."""
    n = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)[KMGT]?$", 1).try_cast("double")
    unit = F.right(text, F.lit(1))
    return F.when(unit == "K", F.floor(n / 1024)).when(unit == "G", F.floor(n * 1024)).when(unit == "T", F.floor(n * 1024 * 1024)).otherwise(F.floor(n)).cast("bigint")


def _first_match(text: Column, table: tuple[tuple[str, str], ...], other: str) -> Column:
    lower = F.lower(text)
    out = None
    for pattern, value in table:
        out = F.when(lower.rlike(pattern), value) if out is None else out.when(lower.rlike(pattern), value)
    return out.otherwise(other)


def gpu_label(text: Column) -> Column:
    return _first_match(text, GPU_LABELS, "gpu")


def gpu_memory(text: Column) -> Column:
    number = F.regexp_extract(F.lower(text), r"([0-9]+)[\s_-]*g(b)?", 1)
    return F.when(number != "", F.concat(number, F.lit("G"))).otherwise(_first_match(text, GPU_MEMORY, "unknown"))


def gpu_count(tres: Column) -> Column:
    """Sum of the plain numbers of gres/gpu=n and gres/gpu:type=n in a comma list; null if there is none."""
    items = F.filter(F.split(tres, ","), lambda x: x.rlike(r"^gres/gpu[=:].*=?[0-9]+$|^gres/gpu=[0-9]+$"))
    numbers = F.transform(items, lambda x: F.element_at(F.split(x, "="), -1).try_cast("int"))
    good = F.filter(numbers, lambda x: x.isNotNull())
    return F.when(F.size(good) > 0, F.aggregate(good, F.lit(0), lambda a, x: a + x))


def bool_word(text: Column) -> Column:
    """True and false words in any case; anything else raises."""
    low = F.lower(F.trim(text))
    return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False).otherwise(F.raise_error(F.concat(F.lit("not a truth value: "), text)).cast("boolean"))


def cache_key(text: Column, length: int = 12) -> Column:
    return F.substring(F.md5(text), 1, length)


def locator(path: Column, frame: Column) -> Column:
    return F.concat_ws("::", path, frame)


def natural_key(name: Column) -> Column:
    """Sort key in which runs of digits count as numbers."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda t: F.when(t.rlike(r"^\d+$"), F.lpad(t, 20, "0")).otherwise(t)), "")


def decoded(raw: Column) -> Column:
    return F.decode(raw, "UTF-8")


def coerced(text: Column) -> Column:
    """The kind of value a config line holds: int, float, bool, none or text."""
    low = F.trim(text)
    return F.when(low.isin("True", "False"), "bool").when(low == "None", "none").when(low.try_cast("bigint").isNotNull() & low.rlike(r"^[+-]?\d+$"), "int").when(low.try_cast("double").isNotNull(), "float").otherwise("text")


def filled(template: str, values: dict[str, object]) -> str:
    """``{key}`` replaced by its value; unknown keys stay."""
    for key, value in values.items():
        template = template.replace("{" + key + "}", str(value))
    return template


def random_tag(length: int = 8, seed: int | None = None) -> str:
    return "".join(random.Random(seed).choices(string.ascii_lowercase + string.digits, k=length))


def flattened(config: dict, prefix: str = "") -> dict[str, object]:
    """Nested dictionaries with dotted keys."""
    out: dict[str, object] = {}
    for key, value in config.items():
        name = f"{prefix}.{key}" if prefix else str(key)
        out |= flattened(value, name) if isinstance(value, dict) else {name: value}
    return out


def nested(flat: dict[str, object]) -> dict:
    """The inverse of flattened()."""
    out: dict = {}
    for key, value in flat.items():
        *path, last = key.split(".")
        spot = out
        for part in path:
            spot = spot.setdefault(part, {})
        spot[last] = value
    return out
