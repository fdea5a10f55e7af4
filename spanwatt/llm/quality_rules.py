"""Line-first quality rules.  DataFrame functions only.

Every line of a text is judged by itself: punctuation, navigation and boilerplate rules.
Lines that fail go; a document that loses too much of its text goes as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"\x20\x09-\x0D"
SYMBOL_CLASS = "[#*$%&|<>]"
#: A line that holds one of these, in any case, is boilerplate.
BOILERPLATE = ("javascript", "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "lorem ipsum", "click here", "sign up for our")
#: A line with this many separators of menu entries is navigation.
SEPARATORS = r"[|»›•·]| > | :: "


@dataclass(frozen=True)
class Rules:
    repeat_window: int = 8  #: words
    least_words: int = 20
    most_repeated_percent: int = 30
    symbol_line: float = 0.4  #: a line with a larger part of symbols among its non-spaces fails
    least_separators: int = 3
    letterless_words: int = 4  #: a line of so many words without a letter fails
    most_lost: float = 0.5  #: a document losing a larger part of its non-space characters fails


def _trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def _spaceless(c: Column) -> Column:
    """The text without its spaces: splitting and joining costs less than a look at each character."""
    return F.array_join(F.split(c, f"[{SPACE_CLASS}]+"), "")


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def line_fails(line: Column, rules: Rules = Rules(), symbols: Column | None = None, phrases: Column | None = None) -> Column:
    """Punctuation: mostly symbols, or several words and no letter.  Navigation: many
    separators.  Boilerplate: a known phrase.  A line without a word never fails.

    symbols, phrases: what is known of the whole text; where it has no symbol, or no known
    phrase, its lines aren't searched for them.
    """
    symbols, phrases = (F.lit(True) if x is None else x for x in (symbols, phrases))
    letterless = ~line.rlike(r"\p{L}") & (_count(line, WORD) >= rules.letterless_words)
    punctuation = symbols & (_count(line, SYMBOL_CLASS) > F.length(_spaceless(line)) * rules.symbol_line)
    navigation = _count(line, SEPARATORS) >= rules.least_separators
    return letterless | punctuation | navigation | (phrases & F.lower(line).rlike("|".join(BOILERPLATE)))


def judged(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Every row with kept_text and the figures of the rules: n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_lines_removed, base_failed, kept.  Columns of such names
    give way.

    A null text has no words and fails; kept_text is then null.  An equal line is one with
    equal characters, whatever its case.  n_repeat_words counts words covered by windows of
    ``repeat_window`` words that the text holds twice or more; windows are told apart by
    64-bit hashes within one text.  Its cost is linear in the words of a text, n log n where
    something repeats.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", "base_failed", "kept", "kept_text"]
    docs = docs.drop(*made)
    text, w = F.coalesce(F.col(text_col), F.lit("")), rules.repeat_window
    trimmed = _trimmed(text)
    out = docs.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE_CLASS}]+")))
    out = out.withColumns({"n_words": F.size("_w").cast("long"), "word_chars": F.length(F.array_join("_w", "")).cast("long"), "_h": F.transform("_w", lambda x: F.xxhash64(x))}).drop("_w")
    have = 1  # a window's hash is put together from halves: 1, 2, 4, ... words, then what is left
    while have < w:
        step = min(have, w - have)
        n = F.greatest(F.col("n_words").cast("int") - have - step + 1, F.lit(0))
        out = out.withColumn("_h", F.zip_with(F.slice("_h", F.lit(1), n), F.slice("_h", F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b)))
        have += step
    out = out.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), _covered(F.col("_h"), w)).otherwise(0).cast("long")).drop("_h")
    low = F.lower(text)
    phrases = F.lit(False)
    for phrase in BOILERPLATE:
        phrases |= low.contains(phrase)
    out = out.withColumns({"n_symbols": _count(text, SYMBOL_CLASS).cast("long"), "_p": phrases, "_l": F.split(text, "\n")})
    out = out.withColumns({"_f": F.filter("_l", lambda x: x.rlike(f"[^{SPACE_CLASS}]")), "_k": F.filter("_l", lambda x: ~line_fails(x, rules, F.col("n_symbols") > 0, F.col("_p")))})
    out = out.withColumns(
        {
            "n_dup_lines": (F.size("_f") - F.size(F.array_distinct("_f"))).cast("long"),
            "n_lines_removed": (F.size("_l") - F.size("_k")).cast("long"),
            "kept_text": F.when(F.col(text_col).isNotNull(), F.array_join("_k", "\n")),
            "base_failed": (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeated_percent * F.col("n_words")),
        }
    ).drop("_l", "_f", "_k", "_p")
    lost = F.when(F.col("n_lines_removed") > 0, F.col("word_chars") - F.length(_spaceless(F.coalesce("kept_text", F.lit(""))))).otherwise(0)
    return out.withColumn("kept", ~F.col("base_failed") & (lost <= F.col("word_chars") * rules.most_lost))


def _covered(windows: Column, w: int) -> Column:
    """Words covered by the windows whose hash occurs twice or more."""
    pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    # fold over the sorted pairs: a position counts if its hash equals that of a neighbour
    n = F.size(windows)
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(pairs, F.lit(1), n - 1))
    same = F.zip_with(pairs, before, lambda a, b: F.coalesce(a.h == b.h, F.lit(False)))
    after = F.concat(F.slice(same, F.lit(2), n - 1), F.array(F.lit(False)))
    at = F.zip_with(pairs, F.zip_with(same, after, lambda a, b: a | b), lambda p, hit: F.when(hit, p.i))
    at = F.sort_array(F.filter(at, lambda i: i.isNotNull()))
    follow = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.lit(2**31 - 1)))
    return F.aggregate(F.zip_with(at, follow, lambda a, b: F.least(b - a, F.lit(w))), F.lit(0), lambda x, y: x + y)
