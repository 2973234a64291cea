"""Personal-data patterns and masking of single columns.

Patterns are folded into one chain of ``regexp_replace`` with literal patterns:
each is compiled once per task and each column is read once.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MaskRule
from .regex import spark_pattern, spark_replacement

# Personal-data patterns.  The word boundary is written as a
# look-around so that it is ASCII on every Java version.
SERVER_PATTERNS: dict[str, str] = {
    "EMAIL": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "CREDIT_CARD": r"(?<!\w)(?:\d[ \-]*?){13,19}(?!\w)",
    "PHONE": r"(\+81|0)\d{1,4}[\- ]?\d{1,4}[\- ]?\d{4}",
    "GOVERNMENT_ID": r"(?<!\w)\d{12}(?!\w)",
    "JAPAN_ACCOUNT": r"(?<!\w)\d{4}[\-]\d{3}[\-]\d{7}(?!\w)",
    "POSTAL_CODE": r"〒?\d{3}[\-]\d{4}",
    "DRIVER_LICENSE": r"(?<!\w)\d{2}\d{2}\d{6}\d{2}(?!\w)",
    "HEALTH_INSURANCE": r"(?<!\w)\d{2}\d{6}(?!\w)",
}

# The patterns of the client-side rule set.
CLIENT_PATTERNS: dict[str, str] = {
    "CREDIT_CARD": r"(?<!\w)(?:\d[ -]*?){13,19}(?!\w)",
    "PHONE": r"(\+81|0)\d{1,4}[- ]?\d{1,4}[- ]?\d{4}",
    "EMAIL": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "GOVERNMENT_ID": r"(?<!\w)\d{12}(?!\w)",
    "JAPAN_ACCOUNT": r"\d{3}[-]\d{7}|\d{4}[-]\d{7}",
    "POSTAL_CODE": r"(?:〒?\s?)?\d{3}[-]?\d{4}",
    "DRIVER_LICENSE": r"(?<!\w)[1-9]\d{5,7}[0-9\\*]\d{2,4}(?!\w)",
    "HEALTH_INSURANCE": r"[A-Z0-9]{8,10}",
}

PATTERN_SETS = {"server": SERVER_PATTERNS, "client": CLIENT_PATTERNS}

# Longest and most specific first, so that the label does not depend on chance.
ALL_ORDER = (
    "EMAIL", "JAPAN_ACCOUNT", "CREDIT_CARD", "GOVERNMENT_ID",
    "DRIVER_LICENSE", "PHONE", "POSTAL_CODE", "HEALTH_INSURANCE",
)

# What every match of a built-in pattern contains.  A text without it skips the
# pattern: most texts are decided by one search for "@" and one for a digit run.
HAS_AT, HAS_DIGITS = "@", r"[0-9][0-9 \-]{5}"
_UNGUARDED = {("client", "HEALTH_INSURANCE")}

KEY_REPLACEMENT = "[MASKED_KEY]"


def pattern_table(pattern_set: str | Mapping[str, str] = "server") -> Mapping[str, str]:
    return PATTERN_SETS[pattern_set] if isinstance(pattern_set, str) else pattern_set


def register_pattern(name: str, regex: str, base: str | Mapping[str, str] = "server") -> dict[str, str]:
    """A pattern table extended by one category; the base table is left as it is."""
    return {**pattern_table(base), name: spark_pattern(regex)}


def category_order(table: Mapping[str, str], categories: Iterable[str] | None = None) -> list[str]:
    names = [c for c in ALL_ORDER if c in table] + [c for c in table if c not in ALL_ORDER]
    wanted = None if categories is None else set(categories)
    return [c for c in names if wanted is None or not wanted or c in wanted]


def _family(table: Mapping[str, str], name: str) -> str:
    """at, digits, or any when nothing is known about the pattern."""
    for set_name, known in PATTERN_SETS.items():
        if known.get(name) == table[name] and (set_name, name) not in _UNGUARDED:
            return "at" if name == "EMAIL" else "digits"
    return "any"


def _has(c: Column, family: str) -> Column:
    return F.contains(c, F.lit(HAS_AT)) if family == "at" else c.rlike(HAS_DIGITS)


def _replace_chain(c: Column, table: Mapping[str, str], names: Sequence[str]) -> Column:
    for name in names:
        c = F.regexp_replace(c, F.lit(table[name]), F.lit(spark_replacement(f"[MASKED_{name}]")))
    return c


def mask_pii(c: Column, categories: Sequence[str], pattern_set: str | Mapping[str, str] = "server") -> Column:
    """Replace matches by ``[MASKED_<CATEGORY>]``, in the order given.

    Labels hold no "@" and no digit and never join two digits, so a family of
    patterns that cannot match the text cannot match it later in the chain either.
    """
    table = pattern_table(pattern_set)
    names = [n for n in categories if n in table]
    kinds = {n: _family(table, n) for n in names}
    families = sorted({k for k in kinds.values() if k != "any"})
    if not families:
        return _replace_chain(c, table, names)

    def chain(present: Sequence[str]) -> Column:
        return _replace_chain(c, table, [n for n in names if kinds[n] in ("any", *present)])

    if len(families) == 1:
        return F.when(_has(c, families[0]), chain(families)).otherwise(chain(()))
    at, digits = _has(c, "at"), _has(c, "digits")
    return F.when(at, F.when(digits, chain(families)).otherwise(chain(("at",)))).when(
        digits, chain(("digits",))).otherwise(chain(()))


def mask_all_pii(c: Column, pattern_set: str | Mapping[str, str] = "server") -> Column:
    return mask_pii(c, category_order(pattern_table(pattern_set)), pattern_set)


def mask_regex(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, F.lit(spark_pattern(pattern)), F.lit(spark_replacement(replacement)))


def mask_text(c: Column, rules: Sequence[MaskRule], pattern_set: str | Mapping[str, str] = "server") -> Column:
    """Apply rules in order, each to the result of the one before."""
    # KEY_MATCH works on keys, not on text.
    steps = [r for r in rules if r.type in ("REGEX", "PII_TYPE")]
    while steps:
        run = next((i for i, r in enumerate(steps) if r.type == "REGEX"), len(steps))
        if run:
            c = mask_pii(c, [r.category for r in steps[:run]], pattern_set)
            steps = steps[run:]
        else:
            c = mask_regex(c, steps[0].pattern, steps[0].replacement) if steps[0].pattern else c
            steps = steps[1:]
    return c


def contains_pii(c: Column, pattern_set: str | Mapping[str, str] = "server") -> Column:
    table = pattern_table(pattern_set)
    hit = F.lit(False)
    for family in ("at", "digits", "any"):
        any_of = F.lit(False)
        for name in category_order(table):
            if _family(table, name) == family:
                any_of = any_of | c.rlike(table[name])
        hit = hit | (any_of if family == "any" else _has(c, family) & any_of)
    return F.coalesce(hit, F.lit(False))


def first_match(c: Column, name: str, pattern_set: str | Mapping[str, str] = "server") -> Column:
    """The first match of a category, blank when there is none."""
    table = pattern_table(pattern_set)
    found, family = F.regexp_extract(c, table[name], 0), _family(table, name)
    return found if family == "any" else F.when(_has(c, family), found).otherwise("")


def key_rule_for(rules: Sequence[MaskRule]) -> dict[str, str]:
    """key -> replacement over all KEY_MATCH rules; the first rule wins."""
    out: dict[str, str] = {}
    for r in rules:
        if r.type == "KEY_MATCH":
            for k in r.keys:
                out.setdefault(k, r.replacement or KEY_REPLACEMENT)
    return out


def mask_keys(m: Column, keys: Sequence[str], replacement: str = KEY_REPLACEMENT) -> Column:
    """Replace whole values of a map column under sensitive keys."""
    return F.transform_values(m, lambda k, v: F.when(k.isin(*keys), F.lit(replacement)).otherwise(v))


def mask_struct_keys(s: Column, keys: Sequence[str], replacement: str = KEY_REPLACEMENT) -> Column:
    """The same for the top-level fields of a struct column."""
    for k in keys:
        s = s.withField(k, F.lit(replacement))
    return s
