"""Quality rules: base rules, and distance of a document's distributions from its language's.

DataFrame functions only.  Three passes read the texts; what meets between tasks is counts.

1. *Base numbers*, inside each row: words, code points, symbols, repeated lines, and the words in 8-word windows
   that occur twice.  A window is first known by a hash; windows whose hash occurs twice are
   compared as strings, so a number never rests on a hash.
2. *References*, by language: code points in seven character classes, and the ``COMMON`` most frequent lower-cased
   words with their shares of all words (map-side counts).
3. *Distances*, by document: the Jensen-Shannon distance (base 2, from 0 to 1) of its character classes and of its
   common words (all others are one more bin) from the reference.  A document of n words that follows its language
   exactly still has some distance from chance alone, about ``sqrt((bins - 1) / (8 n ln 2))``; a limit is a constant
   plus that.  Guards: a document under ``LEAST_WORDS`` words, or one whose language has
   under ``LEAST_REFERENCE`` words in all, is not judged by distances.

Documents are told apart by id, language and a hash of the text: rows equal in all three get equal results,
each its own row.

Defined cases: null text has no words (base_failed); a null language is the language ``und``; null ids are rows like others;
an empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import Scratch

#: words of a window; words of a document below which it fails; per cent of repeated words over which it fails
WINDOW, FEWEST, MOST_REPEATED = 8, 20, 30
#: bins of the word histogram (and one for all other words); guards
COMMON, LEAST_WORDS, LEAST_REFERENCE = 40, 50, 2000
#: limits of the two distances
CLASS_LIMIT, WORD_LIMIT = 0.2, 0.2

BLANK = r"[\x20\x09-\x0D]"
#: character classes, each taken from what the ones before it leave; what is left in the end is a class too
CLASSES = {"lower": "[a-z]+", "blank": BLANK + "+", "upper": "[A-Z]+", "beyond": r"[^\x00-\x7F]+",
           "stop": r"""[.,;:!?'"()\-]+""", "digit": "[0-9]+"}
SYMBOLS = "[#*$%&|<>]+"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it (also inside lambdas)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK + "+"), "")


def _twice(sorted_items: Column, key: str) -> Column:
    """Items of a sorted array whose ``key`` a neighbour has too."""
    def alike(e: Column, k: Column) -> Column:
        return (F.coalesce(F.get(sorted_items, k - 1)[key] == e[key], F.lit(False))
                | F.coalesce(F.get(sorted_items, k + 1)[key] == e[key], F.lit(False)))
    return F.filter(sorted_items, alike)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows of ``window`` consecutive words that occur twice or more in the array."""
    def of(w: Column) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - (window - 1), F.lit(0)))
        hashes = F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, window))))
        return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(w, h)))

    def covered(w: Column, h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        strings = _let(by_hash, lambda s: F.sort_array(F.transform(_twice(s, "h"), lambda e: F.struct(
            F.array_join(F.slice(w, e["i"] + 1, window), " ").alias("x"), e["i"].alias("i")))))
        places = _let(strings, lambda t: F.sort_array(F.transform(_twice(t, "x"), lambda e: e["i"])))
        zero = F.struct(F.lit(0).alias("till"), F.lit(0).alias("n"))
        return F.aggregate(places, zero, lambda a, i: F.struct(
            (i + window).alias("till"), (a["n"] + F.least(F.lit(window), i + window - a["till"])).alias("n")), lambda a: a["n"])

    return _let(words, of).cast("long")


def base_numbers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: key columns, the base numbers, ``base_failed`` and the character classes."""
    got = docs.select(F.col(id_col).alias("doc_id"), _lang(lang_col), _digest(text_col),
                      F.coalesce(F.col(text_col), F.lit("")).alias("left"))
    # every class is cut out of what the classes before it left, so the long first pass is the only one over the whole text
    got = got.select("*", F.length("left").cast("long").alias("n_all"), F.size(_written_lines("left")).alias("lines"),
                     _let(_written_lines("left"), lambda x: F.size(F.array_distinct(x))).alias("kinds"),
                     _let(words_of(F.col("left")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("again"))).alias("w"))
    for name, pattern in CLASSES.items():
        got = got.withColumn("next", F.regexp_replace("left", pattern, ""))
        got = got.withColumn(f"c_{name}", (F.length("left") - F.length("next")).cast("long")).drop("left").withColumnRenamed("next", "left")
    got = got.select(
        "doc_id", "lang", "digest", *(f"c_{k}" for k in CLASSES), F.length("left").cast("long").alias("c_rest"),
        F.col("w.n").alias("n_words"), (F.col("n_all") - F.col("c_blank")).alias("word_chars"),
        (F.length("left") - F.length(F.regexp_replace("left", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.col("lines") - F.col("kinds")).cast("long").alias("n_dup_lines"), F.col("w.again").alias("n_repeat_words"))
    return got.withColumn("base_failed", (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def _written_lines(text: str) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


_CLASS = [*(f"c_{k}" for k in CLASSES), "c_rest"]


def _lang(lang_col: str) -> Column:
    return F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")


def _digest(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest")


def _listed(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """One row per word of every document, lower-cased."""
    return docs.select(F.col(id_col).alias("doc_id"), _lang(lang_col), _digest(text_col),
                       F.explode(words_of(F.lower(F.coalesce(F.col(text_col), F.lit(""))))).alias("word"))


def common_words(words: DataFrame, totals: DataFrame, most: int = COMMON) -> DataFrame:
    """(lang, word, bin, share): the ``most`` most frequent words of each language, ties to the smaller word."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = (words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
           .withColumn("bin", F.row_number().over(order)).where(F.col("bin") <= most))
    return top.join(totals, "lang").select("lang", "word", "bin", (F.col("n") / F.col("t_words")).alias("share"))


def _term(p: Column, q: Column) -> Column:
    """One bin of the Jensen-Shannon divergence in bits."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b)) / 2).otherwise(F.lit(0.0))
    return part(p, q) + part(q, p)


def _distance(terms: Column) -> Column:
    return F.sqrt(F.greatest(terms, F.lit(0.0)))


def chance(bins: int, n: Column) -> Column:
    """About the distance of a sample of n from its own distribution."""
    return F.sqrt(F.lit(bins - 1.0) / (8 * F.log(F.lit(2.0)) * F.greatest(n, F.lit(1))))


def with_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  least_words: int = LEAST_WORDS, least_reference: int = LEAST_REFERENCE) -> DataFrame:
    """The base numbers of every row, ``class_distance``, ``word_distance`` (null where a guard holds) and ``kept``."""
    scratch = Scratch(docs.sparkSession)
    key = ["doc_id", "lang", "digest"]
    base = scratch.written(base_numbers(docs, id_col, text_col, lang_col), "base")
    totals = scratch.written(base.groupBy("lang").agg(
        F.sum("n_words").alias("t_words"), *(F.sum(c).alias(f"t{c[1:]}") for c in _CLASS)), "totals")
    words = _listed(docs, id_col, text_col, lang_col)
    common = scratch.written(common_words(words, totals.select("lang", "t_words")), "common")
    bins = (words.join(common, ["lang", "word"]).groupBy(*key, "bin", "share").agg(F.count(F.lit(1)).alias("c"))
            .groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("bin", "c", "share"))).alias("bins")))
    share = common.groupBy("lang").agg(F.sum("share").alias("in_bins"))
    # equal rows are counted together above; what is compared are shares, so only their number matters
    copies = Window.partitionBy(*(F.coalesce(F.col(c), F.lit(0)) if c == "doc_id" else F.col(c) for c in key))
    rows = base.withColumn("own", F.col("n_words") * F.count(F.lit(1)).over(copies))
    null_safe = [rows["doc_id"].eqNullSafe(bins["doc_id"]), rows["lang"] == bins["lang"], rows["digest"] == bins["digest"]]
    rows = (rows.join(bins, null_safe, "left").select(rows["*"], bins["bins"])
            .join(totals, "lang", "left").join(share, "lang", "left"))
    judged = (F.col("n_words") >= least_words) & (F.col("t_words") >= least_reference)
    found = F.coalesce(F.col("bins"), F.array().cast("array<struct<bin:int,c:bigint,share:double>>"))
    own = F.greatest(F.col("own"), F.lit(1))
    seen = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    sums = F.aggregate(found, seen, lambda a, x: F.struct(
        (a["d"] + _term(x["c"] / own, x["share"])).alias("d"), (a["p"] + x["c"] / own).alias("p"), (a["q"] + x["share"]).alias("q")))
    in_bins = F.coalesce(F.col("in_bins"), F.lit(0.0))
    # a common word that the document lacks adds half its share; the last bin holds all other words
    by_word = _let(sums, lambda s: s["d"] + F.greatest(in_bins - s["q"], F.lit(0.0)) / 2
                   + _term(F.greatest(1 - s["p"], F.lit(0.0)), F.greatest(1 - in_bins, F.lit(0.0))))
    all_doc = F.greatest(sum((F.col(c) for c in _CLASS), F.lit(0)), F.lit(1))
    all_ref = F.greatest(sum((F.col(f"t{c[1:]}") for c in _CLASS), F.lit(0)), F.lit(1))
    by_class = sum((_term(F.col(c) / all_doc, F.col(f"t{c[1:]}") / all_ref) for c in _CLASS), F.lit(0.0))
    rows = rows.withColumns({"class_distance": F.when(judged, _distance(by_class)), "word_distance": F.when(judged, _distance(by_word))})
    far = ((F.col("class_distance") > CLASS_LIMIT + chance(len(_CLASS), F.col("n_words")))
           | (F.col("word_distance") > WORD_LIMIT + chance(COMMON + 1, F.col("n_words"))))
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "class_distance", "word_distance", "kept")
