"""Script predicates and counters as native Column expressions.

All of them stay inside whole-stage codegen: ``rlike`` / ``regexp_replace`` /
``length`` only, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, ScriptProfile, Settings

# Python's ``str.isspace`` set, the characters ``str.strip()`` removes.
# Java's ``\s`` and Spark ``trim`` do not agree with it (U+001C..U+001F,
# U+3000), so the class is spelled out.
PY_WHITESPACE_CLASS = (
    r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_script(c, profile: ScriptProfile = DEFAULT.profile) -> Column:
    """true when the string holds at least one source-script character."""
    return _col(c).rlike(f"[{profile.char_class()}]")


def is_nonblank(c) -> Column:
    """``s.strip() != ''`` with Python's whitespace set."""
    return _col(c).rlike(f"[^{PY_WHITESPACE_CLASS}]")


def is_translatable(c, profile: ScriptProfile = DEFAULT.profile) -> Column:
    """F1 and F2 together: the unit goes to the model."""
    return is_nonblank(c) & has_script(c, profile)


def script_char_count(c, profile: ScriptProfile = DEFAULT.profile) -> Column:
    """Number of source-script code points."""
    # other characters go by runs: one by one, each is a replacement of its own
    return F.length(F.regexp_replace(_col(c), f"[^{profile.char_class()}]+", ""))


def est_tokens(c, settings: Settings = DEFAULT) -> Column:
    """Estimated output tokens of one string's translation.

    ``int((script*0.7 + rest)*0.4) + 15`` with double arithmetic and
    truncation, as an INT column.
    """
    jp = script_char_count(c, settings.profile)
    rest = F.length(_col(c)) - jp
    raw = (jp * F.lit(settings.est_script_weight) + rest) * F.lit(settings.est_token_per_char)
    return (raw.cast("int") + F.lit(settings.est_overhead)).cast("int")


# --- Python twins, used inside model-stage tasks and by tests -------------

def py_has_script(s: str, profile: ScriptProfile = DEFAULT.profile) -> bool:
    return any(profile.contains(ch) for ch in s)


def py_script_chars(s: str, profile: ScriptProfile = DEFAULT.profile) -> int:
    return sum(1 for ch in s if profile.contains(ch))


def py_est_tokens(s: str, settings: Settings = DEFAULT) -> int:
    jp = py_script_chars(s, settings.profile)
    rest = len(s) - jp
    return int((jp * settings.est_script_weight + rest) * settings.est_token_per_char) + settings.est_overhead
