"""Cleaning, tokenising and n-grams as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as the cleaning rules mean it (Unicode).  Folding turns the characters that Java's \s
# does not know into plain spaces, so the later rules can use \s.
_ODD_SPACES = "\x1c\x1d\x1e\x1f\x85\u1680\u2028\u2029"
_ANY_SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NOT_BLANK = f"[^{_ANY_SPACE}]"

# Characters that survive cleaning besides word characters and white space.
_KEPT = (
    r".,!?;:'\"\-()&%$#@"
    r"\u0600-\u06ff\u0e00-\u0e7f\u4e00-\u9fff\u3040-\u309f\u30a0-\u30ff\uac00-\ud7af"
)
_URL = r"http\S+|www\S+|https\S+"
_DROPPED = rf"[^\p{{L}}\p{{N}}_\s{_KEPT}]"
# The same for pure ASCII text, listed one by one, which Java tests with a bit set.
_DROPPED_ASCII = "[" + "".join(
    f"\\x{code:02x}" for code in range(128)
    if not (chr(code).isalnum() or chr(code).isspace() or chr(code) in "_.,!?;:'\"-()&%$#@")
) + "]"
_WORD = r"[\p{L}\p{N}_]{2,}"

# Blocks whose NFKD form is reached by replacing single characters: Latin, Cyrillic, punctuation,
# CJK ideographs and emoji.  Text with any other non-ASCII character takes the full normaliser.
_SIMPLE_BLOCKS = [
    (0x00A1, 0x024F), (0x0400, 0x0482), (0x048A, 0x052F), (0x1E00, 0x1EFF), (0x2010, 0x2027),
    (0x2030, 0x205E), (0x2190, 0x21FF), (0x2600, 0x27BF), (0x4E00, 0x9FFF), (0x1F300, 0x1FAFF),
]
_LATIN_MARKS = range(0x0300, 0x0370)


def _fold_table() -> tuple[str, str, str]:
    """Derive (from, to, hard): the one-to-one NFKD replacements, and the block members without one.

    Cleaning drops Latin combining marks, so a letter plus such marks counts as one-to-one.  Letters
    that could touch the URL rule (p, w) or start a run (space) keep their marks and stay "hard".
    """
    source, target, hard = [], [], []
    for first, last in _SIMPLE_BLOCKS:
        for code in range(first, last + 1):
            char = chr(code)
            form = unicodedata.normalize("NFKD", char)
            if form == char:
                if unicodedata.combining(char):
                    hard.append(char)
                continue
            base = form[0]
            marks_only = all(ord(c) in _LATIN_MARKS for c in form[1:])
            risky = len(form) > 1 and (base.isspace() or base in "pPwW")
            if marks_only and not risky:
                source.append(char)
                target.append(base)
            else:
                hard.append(char)
    return "".join(source), "".join(target), "".join(hard)


_FOLD_FROM, _FOLD_TO, _FOLD_HARD = _fold_table()


def _escape(char: str) -> str:
    return f"\\x{{{ord(char):x}}}"


_BLOCKS = "".join(f"{_escape(chr(a))}-{_escape(chr(b))}" for a, b in _SIMPLE_BLOCKS)
# The first class rejects almost every character of common text, so the long one is rarely tried.
_NEEDS_NORMALISER = (
    r"[[^\x00-\xa7\xbf-\x{131}\x{4e00}-\x{9fff}]&&"
    rf"[[^\xa0{_BLOCKS}][{''.join(map(_escape, _FOLD_HARD))}]]]"
)
_ASCII_RUN = r"[\x00-\x7f]+"


def _nfkd(text: Column) -> Column:
    spaces = {ord(c): " " for c in _ODD_SPACES}

    # Defined inside so that it is shipped by value: executors need not have this package.
    def normalise(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKD", t).translate(spaces), na_action="ignore")

    return F.pandas_udf(normalise, T.StringType())(text)


def _is_ascii(text: Column) -> Column:
    """Counts bytes instead of looking for a character: a regular expression takes a predicate call for each one."""
    return (F.octet_length(text) == F.char_length(text)) & F.is_valid_utf8(text)


def compatibility_fold(text: Column) -> Column:
    """NFKD up to Latin combining marks (which cleaning drops), with plain spaces.

    Spark has no normaliser.  ASCII passes through, simple scripts use ``translate``, and only the
    remaining rows send text to the Arrow UDF; the other rows hand it a NULL.
    """
    foldable = ~_is_ascii(text)
    for code in range(0x1C, 0x20):
        foldable = foldable | F.contains(text, F.lit(chr(code)))
    # The long class looks only at what is left without the ASCII characters.
    hard = F.when(~_is_ascii(text), F.when(F.regexp_replace(text, _ASCII_RUN, "").rlike(_NEEDS_NORMALISER), text))
    spaces = "\u00a0" + _ODD_SPACES
    simple = F.when(
        foldable, F.translate(text, spaces + _FOLD_FROM, " " * len(spaces) + _FOLD_TO)
    ).otherwise(text)
    return F.coalesce(_nfkd(hard), simple)


def not_blank(text: Column) -> Column:
    """At least one non-space character (Unicode spaces count as spaces); NULL stays NULL."""
    return text.rlike(_NOT_BLANK)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{_ANY_SPACE}]+|[{_ANY_SPACE}]+$", "")


def clean_folded(folded: Column) -> Column:
    """Drop URLs, e-mail addresses and symbols from folded text, and collapse white space.

    Every rule runs only on texts that can contain what it removes.
    """
    urls = F.contains(folded, F.lit("http")) | F.contains(folded, F.lit("www"))
    bare = F.when(urls, F.regexp_replace(folded, _URL, "")).otherwise(folded)
    # An "@" with something on both sides marks the whole run between spaces.
    kept_runs = F.filter(
        F.split(bare, r"\s+"), lambda run: ~F.locate("@", run, 2).between(F.lit(1), F.char_length(run) - 1)
    )
    bare = F.when(F.contains(folded, F.lit("@")), F.array_join(kept_runs, " ")).otherwise(bare)
    kept = F.when(~_is_ascii(folded), F.regexp_replace(bare, _DROPPED, "")).otherwise(
        F.regexp_replace(bare, _DROPPED_ASCII, "")
    )
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def with_clean_text(df: DataFrame, source: str, target: str = "clean_text") -> DataFrame:
    """Add the cleaned form of a text column; never NULL."""
    given = F.coalesce(F.col(source), F.lit(""))
    folded = with_computed(df, _folded=compatibility_fold(given))
    return with_computed(folded, **{target: clean_folded(F.col("_folded"))}).drop("_folded")


def words(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased runs of two or more word characters, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(_WORD), 0)
    stop = list(stop_words)
    return F.filter(found, lambda w: ~w.isin(stop)) if stop else found


#: Published treebank conventions for splitting words, in their order: pattern and what replaces it, groups as $1 (fixed values).
#: They expect lower case and single blanks.  A dot after two letters or more ends a sentence, as no sentence model is at hand.
TREEBANK_RULES: list[tuple[str, str]] = [
    ('^"', "`` "),
    (r"([ (\[{<])\"", "$1 `` "),
    (r"([ (\[{<])''", "$1 `` "),
    (r"([^.])\.([\])}>\"'»” ]*)$", "$1 . $2"),
    (r"([^ .]{2})\. ", "$1 . "),
    (r"([:,])([^0-9])", " $1 $2"),
    (r"([:,])$", " $1 "),
    (r"(\.{2,})", " $1 "),
    (r"([;@#$%&?!])", " $1 "),
    (r"([^'])' ", "$1 ' "),
    (r"([\]\[(){}<>])", " $1 "),
    ("--", " -- "),
    ("$", " "),
    ("''", " '' "),
    ('"', " '' "),
    (r"([^' ])('[smd]|') ", "$1 $2 "),
    (r"([^' ])('ll|'re|'ve|n't) ", "$1 $2 "),
]
#: Words that the same conventions cut in two (fixed values).
TREEBANK_SPLITS: dict[str, tuple[str, str]] = {
    "cannot": ("can", "not"), "d'ye": ("d", "'ye"), "gimme": ("gim", "me"), "gonna": ("gon", "na"), "gotta": ("got", "ta"),
    "lemme": ("lem", "me"), "more'n": ("more", "'n"), "wanna": ("wan", "na"), "'tis": ("'t", "is"), "'twas": ("'t", "was"),
}


def treebank_words(text: Column) -> Column:
    """All words and marks of a cleaned text, lower-cased, by treebank conventions: an ordered cascade of rewrites.

    Contractions are cut (``do n't``, ``it 's``), quotes told apart by side, marks and final dots are words of their own, and
    numbers, dates and hyphenated words stay whole.  An empty text has none; NULL gives NULL.
    """
    rewritten = F.lower(text)
    for pattern, replacement in TREEBANK_RULES:
        rewritten = F.regexp_replace(rewritten, pattern, replacement)
    found = F.filter(F.split(rewritten, " "), lambda w: w != "")
    halves = {word: F.array(*map(F.lit, pair)) for word, pair in TREEBANK_SPLITS.items()}

    def cut(word: Column) -> Column:
        out = F.array(word)
        for whole, pair in halves.items():
            out = F.when(word == whole, pair).otherwise(out)
        return F.when(word.isin(list(halves)), out).otherwise(F.array(word))

    return F.flatten(F.transform(found, cut))


def tokens(text: Column, stop_words: Sequence[str], *, treebank: bool = False) -> Column:
    """``words``, or ``treebank_words`` of two characters or more, without stop words and all-digit ones."""
    stop = list(stop_words)

    def kept(word: Column) -> Column:
        # Lower-case ASCII words sort between these bounds and cannot start with a digit.
        maybe_digits = (word < ":") | (word > "{")
        return ~word.isin(stop) & ~(maybe_digits & word.rlike(r"^\p{Nd}+$"))

    if treebank:
        return F.filter(treebank_words(text), lambda w: (F.char_length(w) > 1) & kept(w))
    return F.filter(words(text), kept)


def ngrams(items: Column, n: int) -> Column:
    """Adjacent ``n``-grams joined by a space.

    Built by zipping shifted copies, so no lambda refers to a column outside itself (such a column
    may be re-evaluated for every element).  ``items`` must be a plain column.
    """
    grams = items
    for shift in range(1, n):
        grams = F.zip_with(
            grams, F.slice(items, F.lit(shift + 1), F.size(items)), lambda left, word: F.concat(left, F.lit(" "), word)
        )
    return F.filter(grams, lambda g: g.isNotNull()) if n > 1 else grams


def with_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    A filter on a plain projected column is pushed below the projection together with a second copy
    of its expression.  Generating the value from a one-element array stops that for the new
    columns, while filters on the other columns still reach the scan.
    """
    packed = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(packed)))
