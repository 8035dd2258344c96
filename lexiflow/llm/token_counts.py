"""Token counts through a digest cache.

The cache is a Parquet table (version, digest, n_tokens).  ``version`` is the
digest of the tokenizer file and of the way it is called; ``digest`` is the
SHA-256 of the normalised content (null becomes the empty text; nothing else is
normalised, as every other character can change a count).  A run joins its
digests to the stored ones, encodes only the distinct misses, appends them, and
counts every row by a join on the digest.

The tokenizer file travels to the tasks as a broadcast of its bytes (checked
against ``MODEL_BYTES``).  A SentencePiece BPE model whose pieces hold the space
sign only at their start, and whose normaliser changes nothing but spaces, can
never merge across the start of a word, so each worker counts word by word and
remembers words (a bounded memory).  Any other model encodes whole texts.

Defined cases: null counts as empty (0 bytes, 0 tokens); every row has its own
result, equal texts the same; a null id stays null; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.session import checkpoint_root

#: a tokenizer file larger than this is refused rather than broadcast
MODEL_BYTES = 64 << 20
#: words that a worker remembers, and the longest that it remembers
MEMO_WORDS, MEMO_CHARS = 200_000, 64
SPACE = "▁"
_SCHEMA = "version string, digest string, n_tokens long"


def separable(sp) -> bool:
    """Whether a SentencePiece model can be counted word by word."""
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
        return False
    every = "".join(chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000 and i != 0x20)
    return sp.normalize("a  b ") == f"{SPACE}a{SPACE}{SPACE}b{SPACE}" and sp.normalize(every) == SPACE + every


class _Words(dict):
    """Tokens of a word with the space sign before it."""

    def __init__(self, sp):
        super().__init__()
        self.sp = sp

    def __missing__(self, word: str) -> int:
        n = len(self.sp.encode(word))
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = n
        return n


_RUN = re.compile(" +[^ ]*")


def by_words(sp):
    """Counter of one text; equals len(sp.encode(text)) for a separable model."""
    memo = _Words(sp)

    def count(text: str) -> int:
        if not text:
            return 0
        if SPACE in text:                              # the model takes it for a space
            text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            parts = [x[1:] for x in _RUN.findall(" " + text)]
            if text[-1] == " " and len(parts) > 1:     # spaces that end a text belong to the word before
                tail = parts.pop()
                parts[-1] += " " + tail
            return sum(map(memo.__getitem__, parts))
        return sum(map(memo.__getitem__, text.split(" ")))
    return count


def _counter(kind: str, model: bytes, words: bool):
    if kind == "sentencepiece":
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        if words:
            one = by_words(sp)
            return lambda texts: [one(t) for t in texts]
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer
    t = Tokenizer.from_str(model.decode())
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def _encode(model, kind: str, words: bool, version: str):
    def run(batches):
        count = _counter(kind, model.value, words)
        for batch in batches:
            texts, n = batch.column(1), []
            for i in range(0, len(texts), 256):
                n += count(texts.slice(i, 256).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * batch.num_rows, pa.string()), batch.column(0), pa.array(n, pa.int64())],
                ["version", "digest", "n_tokens"])
    return run


def _cache(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SCHEMA)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens.

    ``tokenizer``: a ``.model`` (sentencepiece) or ``.json`` (tokenizers) file that the driver can read.
    ``cache``: folder of the cache; by default a new one in the shared folder.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        model = f.read()
    if len(model) > MODEL_BYTES:
        raise ValueError(f"{tokenizer} has {len(model)} bytes; at most {MODEL_BYTES} are broadcast")
    kind = "sentencepiece" if tokenizer.endswith(".model") else "tokenizers"
    words = False
    if kind == "sentencepiece":
        import sentencepiece
        words = separable(sentencepiece.SentencePieceProcessor(model_proto=model))
    version = hashlib.sha256(kind.encode() + b" plain " + model).hexdigest()
    cache = cache or f"{checkpoint_root(spark).rstrip('/')}/lexiflow-llm/tokens-{uuid.uuid4().hex[:12]}"
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                       F.sha2(text.cast("binary"), 256).alias("digest"), text.alias("text"))
    stored = _cache(spark, cache).where(F.col("version") == version).select("digest")
    misses = rows.select("digest", "text").join(stored, "digest", "left_anti").dropDuplicates(["digest"])
    (misses.select("digest", "text").mapInArrow(_encode(spark.sparkContext.broadcast(model), kind, words, version), _SCHEMA)
     .write.mode("append").parquet(cache))
    known = (spark.read.schema(_SCHEMA).parquet(cache).where(F.col("version") == version)
             .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")))
    return rows.drop("text").join(known, "digest", "left").select("doc_id", "n_bytes", "n_tokens")
