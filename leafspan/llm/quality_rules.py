"""Quality rules on DataFrame expressions: counts, and divergence from a language.

The histograms of a document, over character classes and over a language's
commonest words, are held against the language's references by Jensen-Shannon
distance. Everything is one projection over the table: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The twelve commonest words of each language, with shares of all
# words in running text (rounded from published frequency lists).
COMMON_WORDS = {
    "en": {"the": 0.062, "of": 0.030, "and": 0.028, "to": 0.026, "in": 0.021, "a": 0.021, "is": 0.011, "that": 0.011, "for": 0.010, "it": 0.010, "was": 0.009, "on": 0.008},
    "fr": {"de": 0.048, "la": 0.030, "le": 0.027, "et": 0.023, "les": 0.022, "des": 0.019, "en": 0.017, "un": 0.014, "du": 0.013, "une": 0.012, "que": 0.011, "est": 0.010},
    "de": {"der": 0.033, "die": 0.033, "und": 0.027, "in": 0.019, "den": 0.013, "von": 0.011, "zu": 0.011, "das": 0.010, "mit": 0.009, "sich": 0.009, "des": 0.009, "ist": 0.008},
    "es": {"de": 0.063, "la": 0.038, "que": 0.030, "el": 0.029, "en": 0.026, "y": 0.025, "a": 0.019, "los": 0.016, "se": 0.014, "del": 0.012, "las": 0.011, "un": 0.010},
}

# Shares of a text's characters by class (rounded, running text).
CHAR_CLASSES = {
    "en": {"blank": 0.180, "upper": 0.025, "stop": 0.030, "symbol": 0.002},
    "fr": {"blank": 0.170, "upper": 0.025, "stop": 0.035, "symbol": 0.002},
    "de": {"blank": 0.150, "upper": 0.050, "stop": 0.030, "symbol": 0.002},
    "es": {"blank": 0.175, "upper": 0.025, "stop": 0.030, "symbol": 0.002},
}

# What the classes hold; blanks and SYMBOLS are counted elsewhere, all else counts as letters.
CLASS_PATTERNS = {"upper": r"\p{Lu}+", "stop": r"[.,;:!?'\"()\-]+"}

# Punctuation that may stand around a word.
AROUND = ".,;:!?()\"'"
# No common word with the punctuation around it is longer.
LONGEST_COMMON = 12

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """The words of a text; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def _windows_found_twice(words: str, text_wise: bool) -> str:
    """SQL for the sorted starts, repeats included, of three-word windows that equal a neighbour in the sorted order."""
    if text_wise:
        keys = f"sort_array(transform(sequence(0, size({words}) - 3), i -> struct(concat_ws(' ', get({words}, i), get({words}, i + 1), get({words}, i + 2)) as k, i as at)))"
        pairs = "filter(sequence(1, size(keys) - 1), x -> get(keys, x).k = get(keys, x - 1).k)"
        return f"aggregate(array({keys}), cast(array() as array<int>), (z, keys) -> sort_array(flatten(transform({pairs}, x -> array(get(keys, x).at, get(keys, x - 1).at)))))"
    at = lambda x: f"cast({x} & (shiftleft(1L, _bits) - 1L) as int)"
    return f"sort_array(flatten(transform(_pairs, p -> array({at('_keys[p]')}, {at('_keys[p - 1]')}))))"


def with_repeat_words(df: DataFrame, words: str = "words", out: str = "n_repeat_words") -> DataFrame:
    """Adds how many words stand in a three-word window that is found at least twice, the first included.

    A window's hash and position share one BIGINT, the position in as many low
    bits as the text needs: one sort of a plain array brings equal windows
    together. Where neighbours of one hash differ in words, as two windows with
    one hash might hide an equal one between them, that text's windows are sorted
    as texts instead; so the count is exact.
    """
    df = df.withColumn("_bits", F.length(F.bin(F.size(words))).cast("int"))
    df = df.withColumn("_hashes", F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn(
        "_keys",
        F.expr(
            f"""if(size({words}) < 4, array(), sort_array(transform(sequence(0, size({words}) - 3),
            i -> shiftleft(xxhash64(get(_hashes, i), get(_hashes, i + 1), get(_hashes, i + 2)), _bits) | i)))"""
        ),
    )
    df = df.withColumn("_pairs", F.expr("if(size(_keys) < 2, array(), filter(sequence(1, size(_keys) - 1), k -> shiftright(get(_keys, k) ^ get(_keys, k - 1), _bits) = 0L))"))
    at = lambda x: f"cast({x} & (shiftleft(1L, _bits) - 1L) as int)"
    same = " AND ".join(f"{words}[{at('_keys[p]')} + {k}] = {words}[{at('_keys[p - 1]')} + {k}]" for k in range(3))
    df = df.withColumn("_found", F.expr(f"if(forall(_pairs, p -> {same}), {_windows_found_twice(words, False)}, {_windows_found_twice(words, True)})"))
    covered = F.aggregate(
        "_found",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, p: F.struct((p + 3).alias("end"), (acc["n"] + F.least(F.lit(3), p + 3 - acc["end"])).alias("n")),
        lambda acc: acc["n"],
    )
    return df.withColumn(out, covered).drop("_bits", "_hashes", "_keys", "_pairs", "_found")


def js_distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of a histogram, an array of shares, to a reference."""
    terms = []
    for i, ref in enumerate(q):
        own, ref = p[i], F.lit(float(ref))
        mid = (own + ref) / 2
        terms.append(F.when(own > 0, own * F.log2(own / mid)).otherwise(0.0) + F.when(ref > 0, ref * F.log2(ref / mid)).otherwise(0.0))
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def _with_rest(shares: list[float]) -> list[float]:
    return [*shares, 1.0 - sum(shares)]


def divergence(df: DataFrame, text: str, lang: str, words: str, word_chars: str, n_symbols: str) -> DataFrame:
    """Adds char_distance and word_distance to the references of the row's language.

    Where the language is null or has no reference, the nearest one counts. The
    references are fixed, so a row's verdict doesn't hang on the rest of the table.
    """
    length = F.greatest(F.length(text), F.lit(1))
    upper, stop = (F.length(text) - F.length(F.regexp_replace(text, CLASS_PATTERNS[k], "")) for k in ("upper", "stop"))
    counts = F.array(*[x.cast("double") for x in (F.length(text) - F.col(word_chars), upper, stop, F.col(n_symbols))])
    df = df.withColumn("_chars", F.transform(counts, lambda x: x / length))
    df = df.withColumn("_chars", F.concat("_chars", F.array(F.greatest(F.lit(0.0), 1.0 - F.get("_chars", F.lit(0)) - F.get("_chars", F.lit(1)) - F.get("_chars", F.lit(2)) - F.get("_chars", F.lit(3))))))
    every = sorted({w for own in COMMON_WORDS.values() for w in own})
    # Common words count in any case and with punctuation around them.
    plain = F.transform(F.filter(words, lambda w: F.length(w) <= LONGEST_COMMON), lambda w: F.lower(F.btrim(w, F.lit(AROUND))))
    df = df.withColumn("_common", F.filter(plain, lambda w: w.isin(every)))
    known = F.col(lang).isin(list(COMMON_WORDS))
    chars, common = [], []
    for code in COMMON_WORDS:
        own = (F.col(lang) == code) | known.isNull() | ~known
        total = F.greatest(F.size(words), F.lit(1)).cast("double")
        shares = F.array(*[(F.size("_common") - F.size(F.array_remove("_common", w))) / total for w in COMMON_WORDS[code]])
        df = df.withColumn(f"_words_{code}", F.when(own, shares))
        df = df.withColumn(f"_words_{code}", F.concat(F.col(f"_words_{code}"), F.array(F.greatest(F.lit(0.0), 1.0 - F.aggregate(f"_words_{code}", F.lit(0.0), lambda a, x: a + x)))))
        chars.append(F.when(own, js_distance(F.col("_chars"), _with_rest(list(CHAR_CLASSES[code].values())))))
        common.append(F.when(own, js_distance(F.col(f"_words_{code}"), _with_rest(list(COMMON_WORDS[code].values())))))
    df = df.withColumn("char_distance", F.least(*chars)).withColumn("word_distance", F.least(*common))
    return df.drop("_chars", "_common", *[f"_words_{c}" for c in COMMON_WORDS])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_char_distance: float = 0.16, max_word_distance: float = 0.33, min_chars: int = 200, min_words: int = 100) -> DataFrame:
    """Per row of docs: (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept).

    A text of fewer than min_chars characters isn't held against the character
    reference, one of fewer than min_words words not against the word reference.
    A null or blank text has no words, fails the base rule and isn't kept.
    Repeated rows are judged row by row; an empty table gives an empty table.

    The columns come out of one struct by inline(), below which Spark pushes no
    filter on them: a filter on kept computes them once, as no filter does.
    """
    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    df = df.withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("lines", lines)
    df = df.select(
        "id", "text", "lang", "words",
        F.size("words").cast("bigint").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
    )
    df = divergence(with_repeat_words(df), "text", "lang", "words", "word_chars", "n_symbols")
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    odd = ((F.length("text") >= min_chars) & (F.col("char_distance") > max_char_distance)) | ((F.col("n_words") >= min_words) & (F.col("word_distance") > max_word_distance))
    df = df.withColumn("kept", ~F.col("base_failed") & ~odd)
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    return df.select(F.inline(F.array(F.struct(*names))))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"),
    )
