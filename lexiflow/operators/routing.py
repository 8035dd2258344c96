"""Format routing (F3, F4) and the handler registry.

The registry maps a lower-cased extension to a handler.  Text formats are handlers of two DataFrame functions, a unit
source and a rebuild, which the corpus job composes into its plan; a new one is registered with
:func:`register_handler`.  Packages and layout have plans of their own.  Unknown extensions are copied as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SUPPORTED_EXTS


@dataclass(frozen=True)
class TextHandler:
    """A text format.

    ``units``: ``path, text`` -> one row per unit with ``path``, ``ord`` (BIGINT, unique in the file), ``text`` (null: not a unit)
    and whatever columns the rebuild needs; an ``error`` column that is not null marks a file that can't be parsed.
    ``rebuild``: these rows with ``text_out`` -> ``path, text``, one row per file that has rows.
    Both are plans over whole tables: no file is a Python object unless the handler makes it one.
    """

    name: str
    units: Callable[[DataFrame], DataFrame]
    rebuild: Callable[[DataFrame], DataFrame]


# Extension -> handler (".txt" and ".md" share the line handler).
HANDLERS: dict[str, str] = {
    ".txt": "lines",
    ".md": "lines",
    ".csv": "csv",
    ".docx": "docx",
    ".xlsx": "xlsx",
    ".pdf": "layout",
}
COPY = "copy"
BUILT_IN = {"lines", "csv", "docx", "xlsx", "layout", COPY}
#: registered text formats by name
TEXT_HANDLERS: dict[str, TextHandler] = {}


def register_handler(ext: str, handler: str | TextHandler) -> None:
    """Add a format: a :class:`TextHandler`, or the name of a handler that is there."""
    if not ext.startswith("."):
        raise ValueError(f"an extension starts with a dot: {ext!r}")
    if isinstance(handler, TextHandler):
        if handler.name in BUILT_IN:
            raise ValueError(f"{handler.name!r} is built in")
        TEXT_HANDLERS[handler.name] = handler
        handler = handler.name
    elif handler not in BUILT_IN and handler not in TEXT_HANDLERS:
        raise ValueError(f"no such handler: {handler!r}")
    HANDLERS[ext.lower()] = handler


def unregister_handler(ext: str) -> None:
    """Take a registered extension out again; its files are copied."""
    name = HANDLERS.pop(ext.lower(), None)
    if name not in HANDLERS.values():
        TEXT_HANDLERS.pop(name, None)


def text_handlers() -> list[str]:
    """Handlers whose files are decoded texts."""
    return ["lines", "csv", *TEXT_HANDLERS]


def is_supported(ext) -> Column:
    """lower-cased suffix is one of the supported or registered extensions."""
    col = F.col(ext) if isinstance(ext, str) else ext
    return F.lower(col).isin(*SUPPORTED_EXTS, *(e for e, h in HANDLERS.items() if h in TEXT_HANDLERS))


def handler_of(ext) -> Column:
    """handler name for an extension column, ``copy`` otherwise."""
    col = F.lower(F.col(ext) if isinstance(ext, str) else ext)
    expr = F.lit(COPY)
    for e, h in reversed(list(HANDLERS.items())):
        expr = F.when(col == e, F.lit(h)).otherwise(expr)
    return expr


def route(files: DataFrame, ext_col: str = "ext") -> DataFrame:
    return files.withColumn("handler", handler_of(ext_col)).withColumn("supported", is_supported(ext_col))
