"""Text statistics as Column expressions; every function is map-only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetide.functions.html import bind

# ---- fixed values ---------------------------------------------------------
# White space as browsers define it; Spark's \s covers only the ASCII part.
SPACE = (
    r"\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}\x{feff}"
)
KANA_KANJI = r"[\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{4e00}-\x{9faf}]"
# Reading ease: base, weight of words per sentence, weight of syllables per word.
EASE_BASE, EASE_SENTENCE, EASE_WORD = 206.835, 1.015, 84.6
JAPANESE_SHARE = 0.1
# ---------------------------------------------------------------------------


# The same classes by Unicode property, which Java matches several times faster
# than a list of ranges; the next-line character is not white space here.
_GAP = r"(?U)[\s\x{feff}&&[^\x{85}]]+"
_INK = r"(?U)[!-~[^\s\x{feff}]\x{85}]+"


def trim_space(text: Column) -> Column:
    gap = _GAP.removeprefix("(?U)")
    return F.regexp_replace(text, rf"(?U)\A{gap}|{gap}\z", "")


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(trim_space(text), _GAP, " ")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_INK))


def sentence_count(text: Column) -> Column:
    """Non-blank pieces between runs of ``.``, ``!`` and ``?``."""
    return F.regexp_count(text, F.lit(rf"[^.!?{SPACE}][^.!?]*"))


def syllable_count(text: Column) -> Column:
    """Vowel runs over the letters alone (runs cross word borders), at least 1."""
    letters = F.regexp_replace(F.lower(text), "[^a-z]+", "")
    return F.greatest(F.lit(1), F.regexp_count(letters, F.lit("[aeiouy]+")))


def readability(words: Column, sentences: Column, syllables: Column) -> Column:
    score = (
        F.lit(EASE_BASE)
        - F.lit(EASE_SENTENCE) * (words / F.nullif(sentences, F.lit(0)))
        - F.lit(EASE_WORD) * (syllables / F.nullif(words, F.lit(0)))
    )
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    return F.when((sentences == 0) | (words == 0), F.lit(0.0)).otherwise(clamped)


def language_tag(text: Column) -> Column:
    total = F.length(F.regexp_replace(text, _GAP, ""))
    japanese = F.regexp_count(text, F.lit(KANA_KANJI))
    return (
        F.when(total == 0, "unknown")
        .when(japanese / F.nullif(total, F.lit(0)) > JAPANESE_SHARE, "ja")
        .otherwise("en")
    )


def keywords(text: Column, top: int = 10, min_length: int = 4, unicode_words: bool = False) -> Column:
    """Most frequent words, ties by first occurrence, as array<struct<word,n>>.

    A document is one row, so its words are sorted and run-length counted in
    place; nothing is exploded or shuffled.
    """
    word_chars = r"\p{L}\p{N}_" if unicode_words else "a-z0-9_"
    kept = F.regexp_replace(F.lower(text), rf"(?U)[^{word_chars}\s\x{{feff}}&&[^\x{{85}}]]+|\x{{85}}+", "")
    words = F.regexp_extract_all(kept, F.lit(rf"[{word_chars}]{{{min_length},}}"), F.lit(0))
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def count_runs(rows: Column) -> Column:
        starts = F.array_compact(
            F.transform(
                rows,
                lambda r, i: F.when((i == 0) | (F.get(rows, i - 1)["w"] != r["w"]), i),
            )
        )

        def ranked(st: Column) -> Column:
            runs = F.transform(
                st,
                lambda p, j: F.struct(
                    (p - F.coalesce(F.get(st, j + 1), F.size(rows))).alias("minus_n"),
                    F.get(rows, p)["i"].alias("first"),
                    F.get(rows, p)["w"].alias("w"),
                ),
            )
            return F.slice(F.sort_array(runs), 1, top)

        return bind(starts, ranked)

    return F.transform(
        bind(placed, count_runs),
        lambda r: F.struct(r["w"].alias("word"), (-r["minus_n"]).alias("n")),
    )
