"""Text columns: cleaners, normalisers, tokenisers, windows and ids. All of it is built-in SQL functions."""

from __future__ import annotations

from string import ascii_lowercase, digits

from pyspark.sql import Column, functions as F

# Words that tokenisers leave out.
STOP_WORDS = (
    "the and or of to a an in on for with by from is are was were be being been as at that this it its wherein said comprising "
    "including having"
).split()
COMBINATION_STOP_WORDS = STOP_WORDS + ["configured"]
CLAIM_STOP_WORDS = (
    "the a an and or of to in on for with by from as at is are was were configured wherein comprising including said such"
).split()
CLAIM_GENERIC_WORDS = "method system device apparatus step first second third one more claim claims component element".split()
RETRIEVER_GENERIC_WORDS = (
    "wherein comprising including configured adapted said thereof therein method system device apparatus using providing having "
    "further plurality first second third one more least based"
).split()
QUERY_GENERIC_WORDS = (
    "wherein comprising including configured adapted said thereof therein method system device apparatus claim using providing "
    "having based according further plurality first second third"
).split()
PRIOR_ART_STOP_WORDS = (
    "the and for with from that this into configured wherein comprising including having thereof therein said one more least each "
    "based using system method device apparatus"
).split()
REVISION_STOP_WORDS = (
    "the and for with from that this which where when into using used such said may can comprising including thereof therein "
    "thereby having provided configured based"
).split()


def _col(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_in(text: Column) -> Column:
    """Parts of a cleaned text between single spaces; none for the empty text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def without(tokens: Column, left_out: list[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*left_out))


# cleaners -------------------------------------------------------------------------------------------------------------


def clean(text: Column | str) -> Column:
    """White space to single spaces, none at the ends; null is empty."""
    # single spaces, which are most, are no match
    return F.trim(F.regexp_replace(_col(text), r"[ \t\n\x0B\f\r](?:(?<! )\s*|\s+)", " "))


def _listed(kept: str) -> str:
    """The inside of a class with its ranges written out: java.util.regex looks characters up in a table, but asks about
    ranges one by one, through interfaces that threads of one executor hinder each other at."""
    return kept.replace("a-z", ascii_lowercase).replace("0-9", digits)


def _lower(text: Column | str) -> Column:
    """Lower case, for patterns of words: these are the same in a text and in the cleaned one."""
    return F.lower(_col(text))


def clean_keeping_lines(text: Column | str) -> Column:
    """Soft hyphens and NULs go, words broken at a line end are joined, blanks collapse, blank lines collapse to one."""
    t = F.regexp_replace(_col(text), "[­\u0000]", "")
    t = F.regexp_replace(t, r"(\w)-\s*\n\s*(\w)", "$1$2")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.btrim(t, F.lit(" \n\t\r"))


def clean_manual(text: Column | str) -> Column:
    t = F.replace(F.replace(_col(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.btrim(t, F.lit(" \n\t\r"))


# normalisers ----------------------------------------------------------------------------------------------------------


def normalize(text: Column | str, kept: str = r"a-z0-9\s\-/\.") -> Column:
    """Lower case, with every character outside the class ``kept`` a space, and white space collapsed."""
    # one pass: white space collapses with what is left out
    return F.trim(F.regexp_replace(_lower(text), f"[^{_listed(kept.replace(chr(92) + 's', ''))}]+", " "))


def normalize_strict(text: Column | str) -> Column:
    return normalize(text, r"a-z0-9\s\-")


def normalize_unicode(text: Column | str) -> Column:
    """Keeps letters and digits of every script, and ``_ - . % /``."""
    return normalize(text, r"\p{L}\p{N}_\s\-.%/")


def normalize_revision(text: Column | str) -> Column:
    """As ``normalize_unicode``, but spaces that characters turn into are not collapsed."""
    t = F.regexp_replace(F.lower(_col(text)), r"\s+", " ")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}_\s.%/-]", " "))


# tokenisers -----------------------------------------------------------------------------------------------------------


def meaningful_tokens(text: Column | str, stop_words: list[str] = STOP_WORDS) -> Column:
    """Words of the normalised text that aren't stop words and have over two characters, repeats included."""
    return F.filter(words_in(normalize(text)), lambda w: (F.length(w) > 2) & ~w.isin(*stop_words))


def chart_tokens(text: Column | str) -> Column:
    return F.filter(words_in(normalize_unicode(text)), lambda w: F.length(w) >= 2)


def amendment_tokens(text: Column | str) -> Column:
    return words_in(normalize_unicode(text))


def retriever_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(normalize_strict(text), F.lit(r"\b[a-zA-Z0-9][a-zA-Z0-9\-]{2,}\b"), F.lit(0))


def retriever_words(text: Column | str) -> Column:
    """A text whose words of three characters or more are ``retriever_tokens``: the normalised one without hyphens at ends."""
    return F.regexp_replace(normalize_strict(text), r"(?<![a-z0-9\-])-+|-++(?![a-z0-9])", "")


def technical_terms(text: Column | str, generic: list[str] = RETRIEVER_GENERIC_WORDS) -> Column:
    return without(retriever_tokens(text), generic)


def verifier_tokens(text: Column | str) -> Column:
    return F.filter(words_in(normalize(text)), lambda w: F.length(w) >= 3)


def prior_art_tokens(text: Column | str, least: int = 3) -> Column:
    found = F.regexp_extract_all(_lower(text), F.lit(rf"[{_listed('a-z')}][{_listed('a-z0-9')}\-]{{{least - 1},}}"), F.lit(0))
    return without(found, PRIOR_ART_STOP_WORDS)


def _plain_words(text: Column | str, pattern: str) -> Column:
    """Whole words, of letters and digits of any script, that are plain ones of a pattern; lower case, distinct."""
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: w.rlike(f"^{pattern}$")))


def manual_tokens(text: Column | str) -> Column:
    return _plain_words(text, "[a-z0-9]{3,}")


def manual_words(text: Column | str) -> Column:
    """The words among which ``manual_tokens`` are, between spaces, as one text."""
    return F.regexp_replace(F.lower(_col(text)), r"[^\p{L}\p{N}_ ]+", " ")


def claim_keywords(text: Column | str, most: int = 12) -> Column:
    found = F.regexp_extract_all(_lower(text), F.lit(rf"[{_listed('a-z')}][{_listed('a-z0-9')}_\-]{{2,}}"), F.lit(0))
    return F.slice(F.array_distinct(without(found, CLAIM_STOP_WORDS + CLAIM_GENERIC_WORDS)), 1, most)


def letter_words(text: Column | str, least: int) -> Column:
    return _plain_words(text, f"[a-z]{{{least},}}")


def revision_tokens(text: Column | str) -> Column:
    found = F.regexp_extract_all(normalize_revision(text), F.lit(r"\b[a-zA-Z][a-zA-Z0-9-]{2,}\b"), F.lit(0))
    return F.array_distinct(without(found, REVISION_STOP_WORDS))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens, joined by spaces."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def count_words(text: Column | str) -> Column:
    return F.regexp_count(_col(text), F.lit(r"(?U)\b\w+\b"))


# windows and chunks ---------------------------------------------------------------------------------------------------


def sentences(text: Column | str, ends: str = ".!?", least: int = 1) -> Column:
    """Parts between sentence ends (which stay off), trimmed; those with fewer than ``least`` characters are left out."""
    parts = F.transform(F.split(_col(text), f"[{ends}]"), lambda s: clean(s))
    return F.filter(parts, lambda s: F.length(s) >= least)


def sentences_with_ends(text: Column | str, ends: str = ".!?;") -> Column:
    """Parts after a sentence end and white space; the ends stay on."""
    return F.filter(F.split(clean(text), rf"(?<=[{ends}])\s+"), lambda s: F.length(s) > 0)


def sentence_windows(parts: Column, size: int = 3, overlap: int = 1) -> Column:
    """Windows of ``size`` sentences that share ``overlap``; the first window that reaches the end is the last."""
    step = size - overlap
    n = F.size(parts)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int"))
    starts = F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(parts, i * step + 1, size), " "))


def chunks(text: Column, size: int = 6000, overlap: int = 500) -> Column:
    """Structs of start and end of pieces of ``size`` characters that share ``overlap``; the last ends with the text."""
    n, step = F.length(text), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int"))
    starts = F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct((i * step).alias("start"), F.least(i * step + size, n).alias("end")))


def packed(parts: Column, most: int) -> Column:
    """Sentences packed in order, as many as fit in ``most`` characters with spaces between; a longer one stands alone."""

    def put(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = (F.size(acc) > 0) & (F.length(last) + 1 + F.length(s) <= most)
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), s)))
        return F.when(fits, joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(parts, F.array().cast("array<string>"), put)


# ids ------------------------------------------------------------------------------------------------------------------


def stable_id(prefix: str, value: Column, digits: int = 12) -> Column:
    """``prefix-`` and the first digits of the SHA-256 of the cleaned value."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(clean(value).cast("binary"), 256), 1, digits))


def stable_id_of(prefix: str, *parts: Column, digits: int = 16) -> Column:
    """As ``stable_id``, of several lower-cased parts."""
    joined = F.concat_ws("||", *[F.lower(clean(p.cast("string"))) for p in parts])
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(joined.cast("binary"), 256), 1, digits))


def unique_ignoring_case(values: Column) -> Column:
    """Cleaned values, the first of each that differ in case only; empty ones go."""
    cleaned = F.filter(F.transform(values, lambda v: clean(v)), lambda v: v != "")
    keys = F.transform(cleaned, lambda v: F.lower(v))
    firsts = F.filter(
        F.arrays_zip(cleaned.alias("v"), F.transform(keys, lambda k, i: F.array_position(keys, k) == i + 1).alias("first")),
        lambda z: z["first"],
    )
    return F.transform(firsts, lambda z: z["v"])
