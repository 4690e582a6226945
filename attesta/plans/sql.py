"""Pieces of DuckDB SQL that the oracle queries share."""

from attesta.functions import text as tx


def words_list(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def normalize(x: str, kept: str = r"a-z0-9\s\-/\.") -> str:
    return f"trim(regexp_replace(regexp_replace(lower({clean(x)}), '[^{kept}]', ' ', 'g'), '\\s+', ' ', 'g'))"


def normalize_strict(x: str) -> str:
    return normalize(x, r"a-z0-9\s\-")


def normalize_unicode(x: str) -> str:
    return normalize(x, r"\p{L}\p{N}_\s\-.%/")


def words_in(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def meaningful(x: str, stop: list[str] = tx.STOP_WORDS) -> str:
    return f"list_filter(string_split({normalize(x)}, ' '), lambda w: length(w) > 2 AND w NOT IN {words_list(stop)})"


def chart_tokens(x: str) -> str:
    return f"list_filter(string_split({normalize_unicode(x)}, ' '), lambda w: length(w) >= 2)"


def verifier_tokens(x: str) -> str:
    return f"list_filter(string_split({normalize(x)}, ' '), lambda w: length(w) >= 3)"


def retriever_tokens(x: str) -> str:
    return f"regexp_extract_all({normalize_strict(x)}, '\\b[a-zA-Z0-9][a-zA-Z0-9\\-]{{2,}}\\b')"


def technical_terms(x: str, generic: list[str] = tx.RETRIEVER_GENERIC_WORDS) -> str:
    return f"list_filter({retriever_tokens(x)}, lambda w: w NOT IN {words_list(generic)})"


def keywords(x: str) -> str:
    """In order of first appearance, the first twelve."""
    stop = words_list(tx.CLAIM_STOP_WORDS + tx.CLAIM_GENERIC_WORDS)
    found = f"list_filter(regexp_extract_all(lower({clean(x)}), '[A-Za-z][A-Za-z0-9_-]{{2,}}'), lambda w: w NOT IN {stop})"
    return f"list_filter({found}, lambda w, i: list_position({found}, w) = i)[1:12]"


def sentences(x: str, least: int = 1) -> str:
    parts = f"list_transform(regexp_split_to_array(coalesce({x}, ''), '[.!?]'), lambda s: {clean('s')})"
    return f"list_filter({parts}, lambda s: length(s) >= {least})"


def stable_id_of(prefix: str, *parts: str, digits: int = 16) -> str:
    joined = " || '||' || ".join(f"lower({clean(f'CAST({p} AS VARCHAR)')})" for p in parts)
    return f"'{prefix}-' || substr(sha256({joined}), 1, {digits})"


def ladder(x: str, steps: list[tuple[float, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {least} THEN '{name}'" for least, name in steps) + f" ELSE '{otherwise}' END"


#: Sentences of documents: doc_id, passage (from 0) and text.
PASSAGES = f"""
passages AS (
  SELECT doc_id, unnest(range(0, len(s))) AS passage, unnest(s) AS text
  FROM (SELECT doc_id, {sentences('text', 8)} AS s FROM documents))"""


#: Passages of documents of at most 700 characters, sentences packed in order: doc_id, passage (from 0) and text.
PACKED = f"""
packed AS (
  SELECT doc_id, list_reduce(list_transform(s, lambda x: [x]), lambda a, x: CASE WHEN length(a[-1]) + 1 + length(x[1]) <= 700 THEN list_concat(a[:-2], [a[-1] || ' ' || x[1]]) ELSE list_concat(a, x) END) AS s
  FROM (SELECT doc_id, list_filter(string_split(regexp_replace({clean('text')}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS s FROM documents) WHERE len(s) > 0),
passages AS MATERIALIZED (SELECT doc_id, unnest(range(0, len(s))) AS passage, unnest(s) AS text FROM packed)"""


def shared(left: str, right: str, left_key: str, right_keys: str, tokens_left: str, tokens_right: str) -> str:
    """CTEs lt, rt and pairs: pairs of rows that share a token, with shared, n_left and n_right."""
    return f"""
lt AS (SELECT {left_key}, len(t) AS n_left, unnest(t) AS token FROM (SELECT {left_key}, list_distinct({tokens_left}) AS t FROM {left})),
rt AS (SELECT {right_keys}, len(t) AS n_right, unnest(t) AS token FROM (SELECT {right_keys}, list_distinct({tokens_right}) AS t FROM {right})),
pairs AS (
  SELECT {left_key}, {right_keys}, count(*) AS shared, any_value(n_left) AS n_left, any_value(n_right) AS n_right
  FROM lt JOIN rt USING (token) GROUP BY {left_key}, {right_keys})"""


def plain_words(x: str, pattern: str) -> str:
    found = f"regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]+')"
    return f"list_distinct(list_filter({found}, lambda w: regexp_full_match(w, '{pattern}')))"


def revision_tokens(x: str) -> str:
    normal = f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '\\s+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s.%/-]', ' ', 'g'))"
    ascii_only = f"regexp_replace({normal}, '[^\\x00-\\x7F]', '_', 'g')"  # letters of other scripts stay inside words
    found = f"regexp_extract_all({ascii_only}, '\\b[a-zA-Z][a-zA-Z0-9-]{{2,}}\\b')"
    return f"list_distinct(list_filter({found}, lambda w: w NOT IN {words_list(tx.REVISION_STOP_WORDS)}))"
