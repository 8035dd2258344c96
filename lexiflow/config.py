"""Settings and script profiles.

Everything that the translation flow treats as a constant lives here, in one
frozen dataclass that is passed to the operators (no module globals).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values that must equal the behaviour being reproduced.
#
#   source script ranges (inclusive code points): U+3000..U+9FFF, U+F900..U+FAFF
#   chunk output-token budget: 6000        strings per chunk: 80
#   attempts per chunk (count check): 3    attempts per call (throttled): 3
#   throttle waits (seconds): 5, 10, 20
#   output-token estimate per string: int((script_chars*0.7 + other_chars)*0.4) + 15
#   cost estimate: input = int(chars*1.4) + name_calls*300
#                  output = int(chars*0.68) + name_calls*50
#   prices (USD per million tokens): input 3.00, output 15.00; overhead factor 1.3
#   reply caps (tokens): text 8096, name 200
#   supported extensions: .txt .md .csv .docx .xlsx .pdf
#   spreadsheet tab names: at most 31 characters; \ / ? * [ ] : become '-'
# ---------------------------------------------------------------------------

SUPPORTED_EXTS = (".txt", ".md", ".csv", ".docx", ".xlsx", ".pdf")
TAB_NAME_MAX = 31
TAB_NAME_BAD_CHARS = "\\/?*[]:"


@dataclass(frozen=True)
class ScriptProfile:
    """The source script: which code points make a string worth translating."""

    name: str = "japanese"
    ranges: tuple[tuple[int, int], ...] = ((0x3000, 0x9FFF), (0xF900, 0xFAFF))

    def char_class(self) -> str:
        """Body of a regex character class, e.g. ``\\x{3000}-\\x{9FFF}``.

        The same text works in Java (Spark), RE2 (DuckDB) and Python ``regex``.
        """
        return "".join(f"\\x{{{lo:04X}}}-\\x{{{hi:04X}}}" for lo, hi in self.ranges)

    def contains(self, ch: str) -> bool:
        o = ord(ch)
        return any(lo <= o <= hi for lo, hi in self.ranges)


JAPANESE = ScriptProfile()


@dataclass(frozen=True)
class Settings:
    profile: ScriptProfile = field(default_factory=ScriptProfile)
    # chunk packing limits
    chunk_token_budget: int = 6000
    chunk_max_strings: int = 80
    # estimate of output tokens per string
    est_script_weight: float = 0.7
    est_token_per_char: float = 0.4
    est_overhead: int = 15
    # model call policy
    chunk_attempts: int = 3
    call_attempts: int = 3
    throttle_waits: tuple[float, ...] = (5.0, 10.0, 20.0)
    text_reply_cap: int = 8096
    name_reply_cap: int = 200
    # cost estimate
    est_input_per_char: float = 1.4
    est_output_per_char: float = 0.68
    name_call_input_tokens: int = 300
    name_call_output_tokens: int = 50
    price_input_per_m: float = 3.00
    price_output_per_m: float = 15.00
    overhead_factor: float = 1.3
    # execution knobs (not semantics)
    pack_segment_units: int = 200_000  # max units one packing group holds (numbers only)
    pack_segment_bytes: int = 32 << 20  # max bytes of text one packing group holds
    call_partitions: int | None = None  # tasks of a model stage; None = by the number of calls
    calls_per_task: int = 100           # calls of a task, unless that makes more than call.TASKS_PER_CORE tasks a core
    calls_per_wave: int = 100_000       # calls written together; a lost driver pays one wave again
    call_batch_rows: int = 64           # Arrow batch size in the model stage (rows = calls)
    # behaviour options (defaults reproduce the reference)
    reject_blank: bool = False          # Q6: refuse a reply whose items are blank
    strip_phonetic: bool = False        # Q3: leave ruby text out of the string sent
    translate_all_names: bool = False   # Q14: also send names without source script

    def with_(self, **kw) -> "Settings":
        return replace(self, **kw)


DEFAULT = Settings()
