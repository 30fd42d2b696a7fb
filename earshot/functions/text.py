"""Phone, word and phrase normalisation, token edit distance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot import presets


def strip_stress(phone: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(phone)), r"\d", "")


def normalize_phone(phone: Column) -> Column:
    bare = strip_stress(phone)
    return F.when(bare.isin(*presets.SILENCE_PHONES), F.lit("SIL")).otherwise(bare)


def scoring_phones(phones: Column) -> Column:
    """Normalised phones that take part in scoring: no silence, no noise."""
    return F.filter(F.transform(phones, normalize_phone), lambda p: (p != "SIL") & (p != ""))


def normalize_word(word: Column) -> Column:
    upper = F.replace(F.upper(F.trim(word)), F.lit("’"), F.lit("'"))
    return F.regexp_replace(upper, r"^[^A-Z'<]+|[^A-Z'>]+$", "")


def safe_float(text: Column) -> Column:
    """The number that a text holds, NaN where it holds none."""
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(float("nan")))


def clean_text(text: Column) -> Column:
    """A quoted text less doubled quotes and outer blanks."""
    return F.trim(F.replace(text, F.lit('""'), F.lit('"')))


def is_visible(word: Column) -> Column:
    """True for a normalised word that is neither empty nor a noise marker."""
    return ~word.isin(*presets.NOISE_WORDS)


def word_allowed(word: Column, min_len=2, max_len=12, alpha_only=True, no_possessive=True) -> Column:
    rules = [F.length(word).between(min_len, max_len)]
    if alpha_only:
        rules.append(word.rlike(r"^[A-Z']+$"))
    if no_possessive:
        rules.append(~word.endswith("'S"))
    return reduce(lambda a, b: a & b, rules)


def split_tokens(text: Column) -> Column:
    """Tokens of a list written with blanks or commas."""
    return F.filter(F.split(F.trim(text), r"[,\s]+"), lambda t: t != "")


def _letter(position: Column) -> Column:
    # One code point per token, from the supplementary planes (no surrogates).
    return F.decode(F.unhex(F.lpad(F.hex((position + F.lit(0x10000)).cast("bigint")), 8, "0")), "UTF-32")


def token_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance over token arrays.

    Each distinct token of the pair becomes one character, which reduces the
    problem to the built-in string ``levenshtein``.
    """
    vocabulary = F.array_distinct(F.concat(a, b))

    def spell(tokens):
        return F.array_join(F.transform(tokens, lambda t: _letter(F.array_position(vocabulary, t))), "")

    return F.levenshtein(spell(a), spell(b))


def letters_of(alphabet: list[str]) -> dict[str, str]:
    """One character per token of an alphabet of any size: ASCII first, then code points without surrogates."""
    return {p: chr(33 + i if i < 90 else 0x10000 + i) for i, p in enumerate(alphabet)}


def spell_with(tokens: Column, alphabet: list[str]) -> Column:
    """Spell tokens of a fixed alphabet with one character each.

    Tokens outside the alphabet share no target token; they become ``~``.
    """
    return F.array_join(
        F.transform(
            tokens,
            lambda t: F.coalesce(
                F.element_at(F.create_map(*[F.lit(x) for pair in letters_of(alphabet).items() for x in pair]), t),
                F.lit("~"),
            ),
        ),
        "",
    )


def edit_similarity(distance: Column, len_a: Column, len_b: Column) -> Column:
    """1 - d / longer length, 0 when either side is empty."""
    longest = F.greatest(len_a, len_b)
    return F.when((len_a == 0) | (len_b == 0), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - distance / longest)
    )


def edit_distance_or_length(distance: Column, len_a: Column, len_b: Column) -> Column:
    return F.when((len_a == 0) | (len_b == 0), F.greatest(len_a, len_b)).otherwise(distance)


def normalized_distance(distance: Column, len_a: Column, len_b: Column) -> Column:
    return distance / F.greatest(len_a, len_b, F.lit(1))


def phrase_hits(phrase: Column, blacklist: list[str]) -> Column:
    """Phrase equals a listed one, starts with it, or ends with it (whole words).

    Phrases are words joined by single blanks, so an item of k words matches
    exactly when it is the first or the last k words: one set lookup each.
    """
    by_words: dict[int, list[str]] = {}
    for item in blacklist:
        by_words.setdefault(len(item.split(" ")), []).append(item)
    tests = [
        F.substring_index(phrase, " ", side * k).isin(*items) for k, items in sorted(by_words.items()) for side in (1, -1)
    ]
    return reduce(lambda a, b: a | b, tests, F.lit(False))
