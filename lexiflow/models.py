"""The model callable contract (U2) and deterministic models for tests.

A translator is any picklable callable ``fn(request: ModelRequest) -> ModelReply``.
It runs inside Spark tasks (``mapInPandas``), once per request.  A real model
may ignore ``items`` / ``attempt``; the test models use them so that their
faults are a pure function of the input and survive task retries.

Raise :class:`Throttled` for a rate-limit answer (it is retried with waits);
any other exception fails the request at once.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field


class Throttled(Exception):
    """The model asked us to slow down; the call is retried after a wait."""


class ModelCallFailed(RuntimeError):
    """Raised after the last throttled attempt."""


@dataclass(frozen=True)
class ModelRequest:
    kind: str                 # "batch" | "single" | "name"
    prompt: str
    items: tuple[str, ...] = field(default_factory=tuple)
    context: str = ""
    attempt: int = 0          # count-check attempt of a chunk (0-based)
    call_attempt: int = 0     # throttle retry of this call (0-based)
    max_tokens: int = 8096


@dataclass(frozen=True)
class ModelReply:
    text: str
    input_tokens: int = 0
    output_tokens: int = 0


# ---------------------------------------------------------------------------
# Fixed values of the mock model (shared with the SQL oracles):
#   source characters:  日本語文書報告資料採用表求
#   target characters:  abcdefghijklm
#   translation:        "<en>" + text with each source character replaced
#   tokens:             input = characters sent, output = characters returned
# The same source characters derive test text from the fixture corpus:
#   éèêçàäöüßñóíá  ->  日本語文書報告資料採用表求
# ---------------------------------------------------------------------------
MOCK_SRC = "日本語文書報告資料採用表求"
MOCK_DST = "abcdefghijklm"
FIXTURE_ACCENTS = "éèêçàäöüßñóíá"
_MOCK_PAIRS = tuple(zip(MOCK_SRC, MOCK_DST))


def mock_translate(s: str) -> str:
    # no target is a source, so one replacement after the other is the simultaneous one; ``translate`` looks every character up
    for src, dst in _MOCK_PAIRS:
        s = s.replace(src, dst)
    return "<en>" + s


def _usage(sent: list[str], got: list[str]) -> tuple[int, int]:
    return sum(len(s) for s in sent), sum(len(s) for s in got)


class MockTranslator:
    """Always answers correctly: JSON array for batches, plain text otherwise."""

    def __call__(self, req: ModelRequest) -> ModelReply:
        if req.kind == "batch":
            out = [mock_translate(s) for s in req.items]
            i, o = _usage(list(req.items), out)
            return ModelReply(json.dumps(out, ensure_ascii=False), i, o)
        src = req.items[0] if req.items else req.prompt
        out = mock_translate(src)
        i, o = _usage([src], [out])
        return ModelReply(out, i, o)


class IdentityTranslator:
    """Returns every string unchanged (rebuild must then equal the input)."""

    def __call__(self, req: ModelRequest) -> ModelReply:
        if req.kind == "batch":
            return ModelReply(json.dumps(list(req.items), ensure_ascii=False),
                              *_usage(list(req.items), list(req.items)))
        src = req.items[0] if req.items else req.prompt
        return ModelReply(src, len(src), len(src))


# Fault classes of ScriptedFaultTranslator, chosen by len(first item) % 5.
FAULT_GOOD, FAULT_FENCED, FAULT_SHORT, FAULT_NOT_JSON, FAULT_ONCE = range(5)


def fault_class(first_item: str) -> int:
    return len(first_item) % 5


class ScriptedFaultTranslator:
    """Mock translations with scripted faults on batch requests.

    0 good; 1 fenced reply; 2 one item short on every attempt; 3 never JSON;
    4 not JSON on the first attempt, good afterwards.  Single and name calls
    always succeed.  ``fail_if`` (optional) names strings whose *single* call
    raises a non-throttle error, to test per-file isolation.
    """

    def __init__(self, fail_marker: str | None = None, faults: bool = True):
        self.fail_marker = fail_marker
        self.faults = faults

    def __call__(self, req: ModelRequest) -> ModelReply:
        items = list(req.items)
        if self.fail_marker and any(self.fail_marker in s for s in items):
            raise RuntimeError(f"model refused: {self.fail_marker}")
        if req.kind != "batch" or not self.faults:
            return MockTranslator()(req)
        out = [mock_translate(s) for s in items]
        i, o = _usage(items, out)
        fc = fault_class(items[0]) if items else FAULT_GOOD
        if fc == FAULT_FENCED:
            return ModelReply("```json\n" + json.dumps(out, ensure_ascii=False) + "\n```", i, o)
        if fc == FAULT_SHORT:
            return ModelReply(json.dumps(out[:-1], ensure_ascii=False), i, o)
        if fc == FAULT_NOT_JSON or (fc == FAULT_ONCE and req.attempt == 0):
            return ModelReply("Sorry, here is my attempt: none", i, 0)
        return ModelReply(json.dumps(out, ensure_ascii=False), i, o)


class ThrottleByLength:
    """Throttles a batch call ``length of its first string % 4`` times, then answers correctly."""

    def __call__(self, req: ModelRequest) -> ModelReply:
        if req.kind == "batch" and req.call_attempt < len(req.items[0]) % 4:
            raise Throttled(f"throttled try {req.call_attempt + 1}")
        return MockTranslator()(req)


class ThrottlingTranslator:
    """Throttles the first ``n`` tries of every call, then delegates."""

    def __init__(self, n: int, inner=None):
        self.n = n
        self.inner = inner or MockTranslator()

    def __call__(self, req: ModelRequest) -> ModelReply:
        if req.call_attempt < self.n:
            raise Throttled(f"throttled try {req.call_attempt + 1}")
        return self.inner(req)
