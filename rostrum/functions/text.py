"""Text functions as column expressions; all run inside generated code, none in Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literals that the cleaning steps remove.
FILLERS_SHORT = ["xa0", "(Applause.)", "(Applause)", "(Laughter.)", "(Laughter)", "(Laughter and applause.)"]
FILLERS = [
    "xa0", "(Applause.)", "(APPLAUSE.)", "(applause.)", "(Laughter.)", "(LAUGHTER.)", "(laughter.)",
    "(Laughter and applause.)", "(Laughter and Applause.)", "(Applause)", "(APPLAUSE)", "(applause)",
    "(Laughter)", "(LAUGHTER)", "(laughter)", "(Laughter and applause)", "(Laughter and Applause)",
]
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
REACTION = r"(?i)\(\s*(?:laughter and applause|applause and laughter|applause|laughter)\.?\s*\)"


def remove_literals(text: Column, literals: list[str]) -> Column:
    """Each literal removed in turn, as plain text."""
    return reduce(lambda t, x: F.replace(t, F.lit(x), F.lit("")), literals, text)


def replace_filler(text: Column, mode: str = "intent") -> Column:
    """Reaction marks removed. ``reference`` takes out 17 exact literals; ``intent`` any such mark, and NBSP."""
    if mode == "reference":
        return remove_literals(text, FILLERS)
    return F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), REACTION, "")


def control_marks(text: Column) -> Column:
    """Code points written out as ``<U+0092>`` or ``<U+0097>`` become a space; bare ``0092``, ``0097`` vanish."""
    spaced = F.replace(F.replace(text, F.lit("<U+0092>"), F.lit(" ")), F.lit("<U+0097>"), F.lit(" "))
    return remove_literals(spaced, ["0092", "0097"])


def normalize_space(text: Column) -> Column:
    """Lower case, every run of white space (NBSP too) one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def word_tokens(text: Column) -> Column:
    """Maximal runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def vector_tokens(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+"))


def treebank_tokens(text: Column) -> Column:
    """Tokens after the conventions of the Penn Treebank: quotes to `` and '', clitics and punctuation apart, the
    final period apart. An ordered list of replacements, then one split; null gives null, blank an empty array."""
    steps = [
        (r'^"', "`` "), (r"``", " `` "), (r'([ (\[{<])"', "$1 `` "), (r'"', " '' "),
        (r"\.\.\.", " ... "), (r"([,:])([^\d])", " $1 $2"), (r"([,:])$", " $1 "), (r"([;@#$%&])", " $1 "),
        (r"([^\.])(\.)([\]\)}>\"'”’ ]*)\s*$", "$1 $2 $3 "), (r"([?!])", " $1 "), (r"([\]\[\(\)\{\}<>])", " $1 "), (r"--", " -- "),
        (r"([^'])' ", "$1 ' "), (r"(?i)([^' ])('s|'m|'d|') ", "$1 $2 "), (r"(?i)([^' ])('ll|'re|'ve|n't) ", "$1 $2 "),
        (r"(?i)\b(can)(not)\b", "$1 $2"), (r"(?i)\b(gon|gim|lem|wan|got)(na|me|ta)\b", "$1 $2"),
    ]
    out = F.concat(F.lit(" "), F.regexp_replace(text, r"\s+", " "), F.lit(" "))
    out = F.regexp_replace(F.ltrim(out), "[’]", "'")
    for pattern, new in steps:
        out = F.regexp_replace(out, pattern, new)
    return F.filter(F.split(F.trim(F.regexp_replace(out, r"\s+", " ")), " "), lambda t: t != "")


def is_punctuation(token: Column) -> Column:
    """Whether a token is a piece of the ASCII punctuation string: ``()`` and ``-.`` are, ``--`` and ``...`` are not."""
    return F.contains(F.lit(PUNCTUATION), token)


def split_lines(text: Column) -> Column:
    """Non-empty lines."""
    return F.filter(F.split(text, "\n"), lambda x: x != "")


def split_naive(text: Column) -> Column:
    return F.split(text, r"\. ")


def sentences(text: Column) -> Column:
    """Sentences of more than one token (word or sign) of a text in lower case with white space normalised: cut behind full
    stops, question and exclamation marks and the quotes and brackets that close with them."""
    marked = F.regexp_replace(normalize_space(text), r"([.!?][\"'”’)\]]*) ", "$1\n")
    return F.filter(F.split(marked, "\n"), lambda x: F.regexp_count(x, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]")) > 1)


def clean_document(text: Column, stop_words: list[str]) -> Column:
    """Lower case, stop words out, hyphens to spaces, punctuation characters out, plain plurals to singulars."""
    kept = F.filter(F.split(F.lower(text), r"\s+"), lambda w: (w != "") & ~w.isin(list(stop_words)))
    bare = F.translate(F.replace(F.array_join(kept, " "), F.lit("-"), F.lit(" ")), PUNCTUATION.replace("-", ""), "")
    return F.array_join(F.transform(F.filter(F.split(bare, r"\s+"), lambda w: w != ""), noun_lemma), " ")


def noun_lemma(word: Column) -> Column:
    """Regular plurals to singulars; other words as they are."""
    return (
        F.when(word.rlike("(?:ss|us|is)$"), word)
        .when(word.rlike("[^aeiou]ies$") & (F.length(word) > 4), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(?:ch|sh|x|ss|z)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("[^s]s$") & (F.length(word) > 3), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def parse_long_date(text: Column) -> Column:
    """``March 4, 1861`` to ``03/04/1861``; null where it is no such date."""
    return F.date_format(F.try_to_timestamp(F.replace(text, F.lit(","), F.lit("")), F.lit("MMMM d yyyy")), "MM/dd/yyyy")


def year_of(date: Column) -> Column:
    """The year of ``MM/dd/yyyy`` or ``yyyy-MM-dd`` as an int, null where there is none."""
    return F.coalesce(F.right(F.trim(date), F.lit(4)).try_cast("int"), F.left(F.trim(date), F.lit(4)).try_cast("int"))


def or_nan(text: Column, mode: str) -> Column:
    """Null text is the word ``nan`` in reference mode and stays null by intent."""
    return F.coalesce(text, F.lit("nan")) if mode == "reference" else text
