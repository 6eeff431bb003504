"""DuckDB SQL of the operators that SQL can express, each by a plainer way than the operator's own."""

from __future__ import annotations

from . import chat, embeddings, quality_rules, secrets, substrings
from .common import UPPER, WORD, WS

_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: The smallest node reachable from every node of ``links`` (a, b; both directions), the least first.
_REACH = """reach AS (SELECT DISTINCT a AS node, a AS root FROM links UNION SELECT l.b, r.root FROM reach r
  JOIN links l ON l.a = r.node WHERE r.root < l.b),
comp AS (SELECT node, min(root) AS component_id FROM reach GROUP BY 1)"""

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY ALL),
pairs AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
{_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id FROM documents d LEFT
  JOIN n USING (doc_id) LEFT JOIN comp ON node = d.doc_id
"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL
  AND len(embedding) > 0),
ok AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= {embeddings.THRESHOLD} ELSE false END),
{_REACH},
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
  coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN comp ON node = vec_id
"""

# A control string may hold the beginning of the next one; a second pass finds what the first consumed.
_CONTROL = r"<(/?s>|\|[a-z_]+\||/?<?/?SYS>>)"


def _escaped(c: str) -> str:
    c = f"replace({c}, '\\', '\\s')"
    for _ in range(2):
        c = rf"regexp_replace({c}, '{_CONTROL}', '\\l\1', 'g')"
    return rf"regexp_replace({c}, '\[(/?INST\])', '\\b\1', 'g')"


CHAT = rf"""
WITH t AS (SELECT conv_id, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS x
  FROM (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST,
  text NULLS FIRST) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
p AS (SELECT *, sum({len(chat.TURN) + 1 + len(chat.END)} + length(replace({_escaped("r")}, chr(10),
  '\e')) + length({_escaped("x")})) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM o),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(r || chr(10) || x || chr(10), '' ORDER BY i) AS said,
  coalesce(string_agg(CASE WHEN r = 'assistant' THEN x END, '' ORDER BY i), '') AS loss,
  sum(CASE WHEN r = 'assistant' OR i = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars FROM p GROUP BY 1)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars FROM c
"""


def _matches(rank: int, kind: str, pattern: str, keep: str) -> str:
    """Rows doc_id, a, b, rank, kind, m; a match starts after the pieces and matches before it."""
    p = _quoted(pattern)
    return rf"""SELECT doc_id, a, a + length(m) AS b, {rank} AS rank, '{kind}' AS kind, m
      FROM (SELECT doc_id, m[k] AS m,
  (list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1],
    lambda x: length(x))), 0))::BIGINT AS a FROM
  (SELECT doc_id, m, string_split_regex(t, {p}) AS gaps, unnest(range(1, len(m) + 1)) AS k
    FROM (SELECT doc_id, t, regexp_extract_all(t, {p}) AS m FROM d))) WHERE {keep}"""


def _spans(rows: str) -> str:
    return f"(SELECT doc_id, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank, b) AS spans FROM {rows} GROUP BY 1)"


_VALUE = f"length(regexp_extract(m, {_quoted(secrets.ASSIGN)}, 1)) >= 8"
_KINDS = " ".join(
    f"WHEN regexp_full_match(m, {_quoted(whole)}) THEN CASE WHEN regexp_matches(m, {_quoted(inside)}) THEN {i} END"
    for i, (_, whole, inside, _) in enumerate(secrets.CLASSES)
)
_CLASSES = ", ".join(f"({i}, '{kind}', {limit})" for i, (kind, _, _, limit) in enumerate(secrets.CLASSES))
SECRETS = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
kinds(i, kind, least) AS (VALUES {_CLASSES}),
base AS ({_matches(0, "assign", secrets.ASSIGN, _VALUE)}
  UNION ALL {_matches(1, "access", secrets.ACCESS, "length(m) >= 16")}
  UNION ALL {_matches(2, "hex", secrets.HEX, "true")}),
c AS ({_matches(3, "candidate", secrets.CANDIDATE, f"NOT regexp_full_match(m, {_quoted('|'.join(secrets.ALLOW))})")}),
free AS (SELECT *, CASE {_KINDS} END AS i FROM c
  WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = c.doc_id AND base.a < c.b AND base.b > c.a)),
rated AS (SELECT *, list_max(list_transform(range(1, length(m) - {secrets.WINDOW} + 2),
  lambda j: list_entropy(string_split(substr(m, j, {secrets.WINDOW}), '')))) AS h FROM free WHERE i IS NOT NULL),
every AS (SELECT doc_id, a, b, rank, kind FROM base UNION ALL SELECT doc_id, a, b, 3 + i, kinds.kind FROM rated
  JOIN kinds USING (i) WHERE h >= least - 1e-12),
n AS (SELECT doc_id, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access,
  count_if(kind = 'hex') AS n_hex FROM base GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(x.spans, '')) AS base_sha256, coalesce(y.spans, '') AS spans
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN {_spans("base")} x USING (doc_id) LEFT
  JOIN {_spans("every")} y USING (doc_id)
"""

_LISTS = {k: list(dict.fromkeys(v)) for k, v in quality_rules.COMMON.items()}
_COMMON = "(VALUES " + ", ".join(
    f"('{lang}', {i}, '{w}')" for lang, ws in _LISTS.items() for i, w in enumerate(ws)
) + ")"
_EVERY = ", ".join(f"'{w}'" for w in sorted({w for ws in _LISTS.values() for w in ws}))
_W = quality_rules.WINDOW


def _class(inside: str) -> str:
    return f"length(regexp_replace(t, {_quoted(f'[^{inside}]+')}, '', 'g'))"


#: One character of any class but the last.
_KNOWN = r"^[\p{Ll}\p{Lu}0-9.,;:!?'\"()#*$%&|<>\x20\x09-\x0D-]$"
RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{WS}]')) AS l FROM d),
win AS (SELECT id, i, array_to_string(w[i:i + {_W - 1}], ' ') AS g
  FROM (SELECT id, w, unnest(range(1, len(w) - {_W - 2})) AS i FROM w)),
twice AS (SELECT id, i FROM win QUALIFY count(*) OVER (PARTITION BY id, g) > 1),
rep AS (SELECT id, sum(least({_W}, coalesce(nx - i, {_W})))::BIGINT AS n
  FROM (SELECT *, lead(i) OVER (PARTITION BY id ORDER BY i) AS nx FROM twice) GROUP BY 1),
b AS (SELECT id, doc_id, lang, len(w)::BIGINT AS n_words, length(t)::BIGINT AS n_chars,
  (length(t) - {_class(WS)})::BIGINT AS word_chars, {_class(r"#*$%&|<>")}::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  [{_class(r"\p{Lu}")}, {_class("0-9")}, {_class(r".,;:!?'" + chr(34) + r"()\-")}, {_class(r"#*$%&|<>")}, {_class(WS)},
    len(list_filter(string_split(t, ''), lambda x: x <> '' AND NOT regexp_matches(x, {_quoted(_KNOWN)})))] AS k FROM w
      LEFT JOIN rep USING (id)),
wc AS (SELECT id, lower(x) AS x, count(*) AS n FROM (SELECT id, unnest(w) AS x FROM w) WHERE lower(x) IN ({_EVERY})
  GROUP BY ALL),
lists(lang, i, x) AS {_COMMON},
listed AS (SELECT b.id, b.lang, 'word' AS kind, lists.i, coalesce(wc.n, 0)::DOUBLE AS c FROM b JOIN lists USING (lang)
  LEFT JOIN wc ON wc.id = b.id AND wc.x = lists.x),
hist AS (SELECT id, lang, 'class' AS kind, unnest(range(0, 7)) AS i, unnest([n_chars - list_sum(k)] || k)::DOUBLE AS c
  FROM b
  UNION ALL SELECT * FROM listed
  UNION ALL SELECT b.id, b.lang, 'word', 1000, greatest(0, n_words - coalesce(u.n, 0))::DOUBLE FROM b LEFT
    JOIN (SELECT id, sum(c) AS n FROM listed GROUP BY 1) u USING (id)
    WHERE lang IN (SELECT lang FROM lists)),
ref AS (SELECT lang, kind, i, sum(c) AS c FROM hist GROUP BY ALL),
unit AS (SELECT h.id, h.kind, h.c / nullif(sum(h.c) OVER p, 0) AS p, r.c / nullif(sum(r.c) OVER p, 0) AS q FROM hist h
  JOIN ref r ON h.lang IS NOT DISTINCT FROM r.lang AND h.kind = r.kind AND h.i = r.i
  WINDOW p AS (PARTITION BY h.id, h.kind)),
far AS (SELECT id, kind, sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE
  WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))) AS x
  FROM unit WHERE p IS NOT NULL AND q IS NOT NULL GROUP BY ALL),
v AS (SELECT b.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CASE
  WHEN n_words >= {quality_rules.MIN_WORDS} THEN f.x END AS cd, CASE
  WHEN n_words >= {quality_rules.MIN_WORDS} THEN g.x END AS wd
  FROM b LEFT JOIN far f ON f.id = b.id AND f.kind = 'class' LEFT JOIN far g ON g.id = b.id AND g.kind = 'word')
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  round(cd + 1e-7, 4) AS class_distance, round(wd + 1e-7, 4) AS word_distance,
  NOT base_failed AND coalesce(cd, 0) <= {quality_rules.MAX_CLASS_DISTANCE}
    AND coalesce(wd, 0) <= {quality_rules.MAX_WORD_DISTANCE} AS kept FROM v
"""

# Texts as hexadecimal digits, two for each byte. Of equal strings all but the first by (doc_id, place) are covered.
SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, {2 * substrings.LENGTH})) AS g
  FROM (SELECT doc_id, x, unnest(range(0, (length(x) // 2) - {substrings.LENGTH - 1})) AS i FROM d)),
again AS (SELECT doc_id, i FROM p QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
o AS (SELECT *, sum(CASE WHEN i <= before + {substrings.LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id
  ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM again)),
r AS (SELECT doc_id, min(i) AS a, max(i) + {substrings.LENGTH} AS b FROM o GROUP BY doc_id, run),
k AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS kept_from FROM r),
j AS (SELECT d.doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed,
  string_agg(substr(x, 2 * kept_from + 1, 2 * (a - kept_from)), ''
  ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept
  FROM k JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN j USING (doc_id)
"""

SQL: dict[str, str] = {
    "op4_ngram_jaccard": JACCARD,
    "op5_embedding_dedup": EMBEDDINGS,
    "op7_quality_rules": RULES,
    "op8_chat_format": CHAT,
    "op9_secrets": SECRETS,
    "op10_suffix_dedup": SUBSTRINGS,
}
