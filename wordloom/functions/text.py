"""Tokenizers and per-text measures as JVM-side column expressions.

All patterns use explicit character classes so that Java regex and RE2
(the oracle) agree: ``\\w`` and ``\\s`` differ between the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
# The 32 ASCII punctuation characters, as one regex class: ! " # $ % & ' ( ) * + , - . / : ; < = > ? @ [ \ ] ^ _ ` { | } ~
ASCII_PUNCT_CLASS = "[!-/:-@\\[-`{-~]"
# Blank characters that separate lexicon tokens: space, tab, newline, carriage return, form feed, vertical tab.
BLANK_RUN = "[ \\t\\n\\r\\f\\x0B]+"
# Word token of the n-gram features: a run of two or more letters, digits or underscores.
WORD_TOKEN = "[\\p{L}\\p{N}_]{2,}"
# Sentence end marks for sentence counts.
SENTENCE_END_RUN = "[.!?]+"


def _text(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    # A missing text is treated as an empty text.
    return F.coalesce(c.cast("string"), F.lit(""))


# Fused words the Penn Treebank word tokenizer splits in two (first part, second part).
TREEBANK_FUSED = [("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me")]
# Fixed values: "wan" + "na" is split only when a blank follows.
TREEBANK_FUSED_BEFORE_BLANK = [("wan", "na")]
# Typographic double quotes become tokens of their own: opening as ``, closing as ''.
TREEBANK_QUOTES = [("\u201c", " `` "), ("\u201d", " '' ")]


def treebank_rules(text: Column) -> Column:
    """Optional treebank-style extras on lower-cased text: split fused words, pad typographic quotes."""
    for a, b in TREEBANK_FUSED:
        text = F.regexp_replace(text, f"\\b({a})({b})\\b", "$1 $2")
    for a, b in TREEBANK_FUSED_BEFORE_BLANK:
        text = F.regexp_replace(text, f"\\b({a})({b})([ \\t\\n\\r\\f\\x0B])", "$1 $2$3")
    for ch, rep in TREEBANK_QUOTES:
        text = F.regexp_replace(text, ch, rep)
    return text


def lexicon_tokens(col: Column | str, treebank: bool = False) -> Column:
    """Lower-case, drop ASCII punctuation, split on blanks, drop empty pieces.

    ``treebank=True`` then applies the word tokenizer's extras (fused words,
    quote tokens), which in the reference run after the punctuation pass.
    """
    cleaned = F.regexp_replace(F.lower(_text(col)), ASCII_PUNCT_CLASS, "")
    if treebank:
        cleaned = treebank_rules(cleaned)
    return F.array_remove(F.split(cleaned, BLANK_RUN), "")


def word_tokens(col: Column | str) -> Column:
    """Word analyzer of the vectorizers: lower-case runs of >= 2 word characters."""
    return F.regexp_extract_all(F.lower(_text(col)), F.lit(WORD_TOKEN), 0)


def count_matches(col: Column | str, pattern_class: str) -> Column:
    """Number of characters of ``text`` that fall in a regex character class."""
    t = _text(col)
    return (F.length(t) - F.length(F.regexp_replace(t, pattern_class, ""))).cast("long")


def sentence_marks(col: Column | str) -> Column:
    """Runs of sentence end marks."""
    return F.size(F.regexp_extract_all(_text(col), F.lit(SENTENCE_END_RUN), 0)).cast("long")


_BLANK, _END, _ALNUM = " \\t\\n\\r\\f\\x0B", ".!?", "\\p{L}\\p{N}"
# One match per blank-separated item that holds a letter or digit.
_WORD_ITEM = f"[{_ALNUM}][^{_BLANK}]*+"
# One match per piece between end marks that holds a word; group 1 is empty unless it holds three.
# Possessive, so that a text is passed once whatever it holds.
_NEXT_WORD = f"[^{_BLANK}{_END}]*+[{_BLANK}][^{_END}{_ALNUM}]*+[{_ALNUM}]"
_WORDY_PIECE = f"[{_ALNUM}]({_NEXT_WORD}{_NEXT_WORD})?+[^{_END}]*+"


def readability_parts(col: Column | str) -> tuple[Column, Column, Column]:
    """(characters, words, sentences) for the automated readability index.

    characters = non-blank characters; words = blank-separated items holding a
    letter or digit; sentences = pieces between end marks holding more than two
    words, at least 1.
    """
    t = _text(col)
    chars = F.length(F.regexp_replace(t, BLANK_RUN, "")).cast("long")
    words = F.size(F.regexp_extract_all(t, F.lit(_WORD_ITEM), 0)).cast("long")
    long_pieces = F.size(F.array_remove(F.regexp_extract_all(t, F.lit(_WORDY_PIECE), 1), ""))
    sentences = F.greatest(F.lit(1), long_pieces).cast("long")
    return chars, words, sentences


def _half_up(c: Column, scale: float) -> Column:
    """Rounding by plain double arithmetic, the same in every engine."""
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def with_readability(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """Add the automated readability index: 4.71 * chars/words + 0.5 * words/sentences - 21.43, both quotients to two
    places and the result to one, halves up; 0.0 for a text without words.

    The three counts are columns of their own, so that the formula, which names them several times, passes a text once.
    """
    names = ["_n_chars", "_n_words", "_n_sentences"]
    chars, words, sentences = map(F.col, names)
    value = F.lit(4.71) * _half_up(chars / words, 100.0) + F.lit(0.5) * _half_up(words / sentences, 100.0) - F.lit(21.43)
    value = _half_up(value, 10.0)
    return df.withColumns(dict(zip(names, readability_parts(text_col), strict=True))).withColumn(
        out_col, F.when(words > 0, value).otherwise(F.lit(0.0))).drop(*names)


def explode_rows(df: DataFrame, keep: list, arr: Column, alias: str | tuple[str, str]) -> DataFrame:
    """``df.select(*keep, explode(arr))`` for arrays computed from text, without a second tokenization.

    For an inner ``explode`` Catalyst infers ``size(arr) > 0`` and pushes that
    filter down to the scan, below the repartition that spreads the texts over
    the cores, so the whole array expression (regexes over every text) would run
    twice, once before the rows are spread.  ``explode_outer`` infers nothing;
    its extra row for an empty or missing array has a null element and is
    dropped here (token arrays never hold null elements).  A tuple ``alias``
    asks for ``posexplode`` (position, element).
    """
    if isinstance(alias, tuple):
        out = df.select(*keep, F.posexplode_outer(arr).alias(*alias))
        return out.filter(F.col(alias[1]).isNotNull())
    out = df.select(*keep, F.explode_outer(arr).alias(alias))
    return out.filter(F.col(alias).isNotNull())
