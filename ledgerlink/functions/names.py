"""Company names and identifiers as columns.

Everything but the Unicode decomposition is built-in SQL. Names are normalised once a record; pair
operators only read the resulting columns.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Legal forms. The spellings of a row mean the same form; the first is its canonical token.
LEGAL_FORM_SPELLINGS = [
    ["ltd", "limited", "co ltd", "company limited"],
    ["plc", "public limited company"],
    ["llc", "limited liability company"],
    ["llp", "limited liability partnership"],
    ["lp", "limited partnership"],
    ["inc", "incorporated"],
    ["corp", "corporation"],
    ["gmbh", "gesellschaft mit beschraenkter haftung"],
    ["ag", "aktiengesellschaft"],
    ["sa", "societe anonyme"],
    ["sas", "societe par actions simplifiee"],
    ["sarl", "societe a responsabilite limitee"],
    ["bv", "besloten vennootschap"],
    ["nv", "naamloze vennootschap"],
    ["spa", "societa per azioni"],
    ["srl", "societa a responsabilita limitata"],
    ["spk", "sp k", "spolka komandytowa"],
    ["spzoo", "sp z oo", "spolka z ograniczona odpowiedzialnoscia"],
    ["as", "aktieselskab", "aksjeselskap"],
    ["ab", "aktiebolag"],
    ["oy", "osakeyhtio"],
    ["pty", "proprietary"],
    ["pvt", "private"],
    ["pte"],
    ["kk", "kabushiki kaisha"],
    ["bhd", "berhad"],
    ["sdn", "sendirian"],
]
# Characters that part tokens, and characters that vanish.
SEPARATORS = "[\\s ,;:/\\\\|+\\-_·•–—]+"
DROPPED = "[.\"'’`()\\[\\]{}*#]"
# Roman numerals that tell series apart.
ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xx", "xxx"]

LEGAL_FORMS = {spelling: row[0] for row in LEGAL_FORM_SPELLINGS for spelling in row}
CANONICAL_FORMS = [row[0] for row in LEGAL_FORM_SPELLINGS]
#: Wider spellings first, so that at each token the widest form wins; any other token stands alone.
FORM_ALTERNATIVES = "|".join([*sorted(LEGAL_FORMS, key=lambda s: (-s.count(" "), s)), "[^ ]+"])


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def _fold_udf(s: pd.Series) -> pd.Series:
    return s.map(_fold, na_action="ignore")


@F.pandas_udf(T.StringType())
def _fold_case_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: _fold(t).casefold(), na_action="ignore")


def _other_than_ascii(c: Column) -> Column:
    return F.when(c.rlike("[^\\x00-\\x7F]"), c)


def fold_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks; ASCII rows cross to Python as nulls only."""
    return F.coalesce(_fold_udf(_other_than_ascii(c)), c)


def fold_case(c: Column) -> Column:
    """Accents folded and full case folding."""
    return F.coalesce(_fold_case_udf(_other_than_ascii(c)), F.lower(c))


def canonicalise_forms(spaced: Column) -> Column:
    """Spellings of legal forms in a string of single-spaced tokens become their canonical token."""
    known = F.create_map(*[F.lit(x) for pair in LEGAL_FORMS.items() for x in pair])
    parts = F.regexp_extract_all(spaced, F.lit(f"(?:{FORM_ALTERNATIVES})(?= |$)"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, p), p)), " ")


def normalize_name(name: Column, folded: Column | None = None) -> Column:
    """Folded, lower case, ``&`` spelled out, noise dropped, single-spaced, legal forms canonical."""
    text = F.lower(fold_accents(name) if folded is None else folded)
    text = F.regexp_replace(F.replace(text, F.lit("&"), F.lit(" and ")), DROPPED, "")
    return canonicalise_forms(F.trim(F.regexp_replace(text, f"(?U){SEPARATORS}", " ")))


def words(normalized: Column) -> Column:
    """Tokens in order; none for an empty name."""
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def tokens(normalized: Column) -> Column:
    """Distinct tokens in order."""
    return F.array_distinct(words(normalized))


def _forms() -> Column:
    return F.array(*[F.lit(f) for f in CANONICAL_FORMS])


def strip_legal_form(normalized: Column) -> Column:
    """Without legal forms; a name of legal forms alone stays whole."""
    kept = F.filter(words(normalized), lambda t: ~F.array_contains(_forms(), t))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(normalized)


def acronym(normalized: Column) -> Column:
    return F.array_join(F.transform(words(strip_legal_form(normalized)), lambda t: F.left(t, F.lit(1))), "")


def legal_forms_of(normalized: Column) -> Column:
    return F.array_intersect(tokens(normalized), _forms())


def normalize_identifier(c: Column) -> Column:
    """ASCII letters and digits in upper case; null if none. Leading zeros stay."""
    return F.nullif(F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", "")), F.lit(""))


def is_discriminator(token: Column) -> Column:
    return token.rlike(r"^\p{Nd}+$") | token.isin(ROMAN) | (F.char_length(token) == 1)


def prefix_key(normalized: Column) -> Column:
    """First four characters of the alphabetically first token of at least four; null if none."""
    long = F.array_sort(F.filter(words(normalized), lambda t: F.char_length(t) >= 4))
    return F.left(F.try_element_at(long, F.lit(1)), F.lit(4))


def longest_token(normalized: Column) -> Column:
    """The longest token of at least four characters, the first of equals; null if none."""
    found = F.aggregate(words(normalized), F.lit(""), lambda best, t: F.when(F.char_length(t) > F.char_length(best), t).otherwise(best))
    return F.when(F.char_length(found) >= 4, found)


def differs_only_by_legal_form(left_norm: Column, right_norm: Column) -> Column:
    return (left_norm != right_norm) & (strip_legal_form(left_norm) == strip_legal_form(right_norm))


def differs_only_by_diacritics_or_case(left: Column, right: Column, left_norm: Column, right_norm: Column) -> Column:
    return (left != right) & (left_norm == right_norm) & (fold_case(left) == fold_case(right))


def pair_id(left: Column, right: Column, label: Column) -> Column:
    """First 16 hex digits of the digest of both ids in order, and the label."""
    return F.substring(F.sha2(F.concat_ws("|", F.least(left, right), F.greatest(left, right), label), 256), 1, 16)


def record_key(source: Column, source_id: Column) -> Column:
    return F.concat_ws(":", source, source_id)
