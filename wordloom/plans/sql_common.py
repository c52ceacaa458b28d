"""SQL building blocks shared by the DuckDB oracles (tokenizers, lexicon parse and match)."""

from __future__ import annotations

from ..functions.text import (
    ASCII_PUNCT_CLASS,
    BLANK_RUN,
    TREEBANK_FUSED,
    TREEBANK_FUSED_BEFORE_BLANK,
    TREEBANK_QUOTES,
    WORD_TOKEN,
)
from ..sources.lexicon import builtin_lexicon_text


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_lex_tokens(expr: str = "text") -> str:
    cleaned = f"regexp_replace(lower(coalesce({expr}, '')), {q(ASCII_PUNCT_CLASS)}, '', 'g')"
    return f"list_filter(string_split_regex({cleaned}, {q(BLANK_RUN)}), lambda x: x <> '')"


def sql_treebank_tokens(expr: str = "text") -> str:
    """Lexicon tokens with the fused-word and quote rules."""
    out = f"regexp_replace(lower(coalesce({expr}, '')), {q(ASCII_PUNCT_CLASS)}, '', 'g')"
    for a, b in TREEBANK_FUSED:
        out = f"regexp_replace({out}, {q(chr(92) + 'b(' + a + ')(' + b + ')' + chr(92) + 'b')}, '\\1 \\2', 'g')"
    for a, b in TREEBANK_FUSED_BEFORE_BLANK:
        pattern = chr(92) + "b(" + a + ")(" + b + ")([ \\t\\n\\r\\f\\x0B])"
        out = f"regexp_replace({out}, {q(pattern)}, '\\1 \\2\\3', 'g')"
    for ch, rep in TREEBANK_QUOTES:
        out = f"replace({out}, {q(ch)}, {q(rep)})"
    return f"list_filter(string_split_regex({out}, {q(BLANK_RUN)}), lambda x: x <> '')"


def sql_word_tokens(expr: str = "text") -> str:
    return f"regexp_extract_all(lower(coalesce({expr}, '')), {q(WORD_TOKEN)})"


def sql_lexicon() -> str:
    """CTEs lex_categories, lex_resolved, lex_entry_cats parsed from the inlined lexicon lines."""
    lines = builtin_lexicon_text().split("\n")
    values = ", ".join(f"({i}, {q(l)})" for i, l in enumerate(lines))
    return f"""lex_raw(line_no, line) AS (VALUES {values}),
lex_l AS (SELECT line_no, trim(line) AS l FROM lex_raw WHERE trim(line) <> ''),
lex_s AS (
  SELECT line_no, l,
         sum(CASE WHEN starts_with(l, '%') THEN 1 ELSE 0 END) OVER (ORDER BY line_no) AS section,
         string_split_regex(l, '[ \\t]+') AS parts
  FROM lex_l),
lex_categories AS (
  SELECT parts[1] AS cat_id, parts[2] AS category,
         CAST(row_number() OVER (ORDER BY line_no) - 1 AS INTEGER) AS pos
  FROM lex_s WHERE section = 1 AND NOT starts_with(l, '%')),
lex_entries AS (
  SELECT line_no AS entry_no, lower(parts[1]) AS pattern,
         split_part(lower(parts[1]), '*', 1) AS stem, contains(parts[1], '*') AS is_prefix,
         parts[2:] AS ids
  FROM lex_s WHERE section = 2 AND NOT starts_with(l, '%')),
lex_resolved AS (
  SELECT * FROM lex_entries
  QUALIFY row_number() OVER (PARTITION BY is_prefix, stem ORDER BY entry_no DESC) = 1),
lex_entry_cats AS (
  SELECT r.entry_no, r.pattern, r.stem, r.is_prefix, c.category, c.pos AS cat_pos
  FROM (SELECT entry_no, pattern, stem, is_prefix, unnest(ids) AS cat_id FROM lex_resolved) r
  JOIN lex_categories c USING (cat_id))"""


def sql_lex_match(source: str = "documents", id_expr: str = "doc_id") -> str:
    """CTEs lex_doc_tok (doc_id, n_tokens, token), lex_tok_match (token, pattern, entry_no), lex_counts."""
    return f"""{sql_lexicon()},
lex_doc_tok AS (
  SELECT doc_id, len(toks) AS n_tokens, unnest(toks) AS token
  FROM (SELECT {id_expr} AS doc_id, {sql_lex_tokens('text')} AS toks FROM {source})),
lex_tokens AS (SELECT DISTINCT token FROM lex_doc_tok),
lex_tok_match AS (
  SELECT token, pattern, entry_no FROM (
    SELECT t.token, r.pattern, r.entry_no,
           row_number() OVER (PARTITION BY t.token
                              ORDER BY CASE WHEN r.is_prefix THEN 0 ELSE 1 END, length(r.stem)) AS rn
    FROM lex_tokens t JOIN lex_resolved r
      ON (r.is_prefix AND starts_with(t.token, r.stem)) OR (NOT r.is_prefix AND t.token = r.stem))
  WHERE rn = 1),
lex_counts AS (
  SELECT d.doc_id, d.n_tokens, c.category, count(*) AS cnt
  FROM lex_doc_tok d JOIN lex_tok_match m USING (token) JOIN lex_entry_cats c ON c.entry_no = m.entry_no
  GROUP BY d.doc_id, d.n_tokens, c.category),
lex_scores AS (
  SELECT doc_id, category, round(100.0 * CAST(cnt AS DOUBLE) / CAST(n_tokens AS DOUBLE), 6) AS score
  FROM lex_counts)"""
