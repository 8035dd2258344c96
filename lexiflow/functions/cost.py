"""Cost formulas (C14) as Column arithmetic with double literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def est_input_tokens(chars, name_calls, s: Settings = DEFAULT) -> Column:
    """``int(chars*1.4) + calls*300`` with IEEE double, truncated."""
    return ((_col(chars) * F.lit(s.est_input_per_char)).cast("bigint")
            + _col(name_calls).cast("bigint") * F.lit(s.name_call_input_tokens))


def est_output_tokens(chars, name_calls, s: Settings = DEFAULT) -> Column:
    return ((_col(chars) * F.lit(s.est_output_per_char)).cast("bigint")
            + _col(name_calls).cast("bigint") * F.lit(s.name_call_output_tokens))


def cost_usd(input_tokens, output_tokens, s: Settings = DEFAULT) -> Column:
    return (_col(input_tokens) / F.lit(1_000_000.0) * F.lit(s.price_input_per_m)
            + _col(output_tokens) / F.lit(1_000_000.0) * F.lit(s.price_output_per_m))


def py_cost_usd(input_tokens: int, output_tokens: int, s: Settings = DEFAULT) -> float:
    return input_tokens / 1_000_000 * s.price_input_per_m + output_tokens / 1_000_000 * s.price_output_per_m
