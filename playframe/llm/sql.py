"""The queries again in SQL, for those that SQL can express."""

from __future__ import annotations

import math

from playframe.llm.quality import QualityRules

_R = QualityRules()

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    count(*) FILTER (WHERE role = 'assistant') OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS later,
    22 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))
       + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS size
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, later + (last_value(role) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) <> 'assistant')::INT AS within FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(size * within)::BIGINT AS formatted_chars, max(within)::BIGINT AS n_examples
FROM e GROUP BY 1"""

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = (  # kind, pattern, group whose length counts, its least length
    ("assign", _ASSIGN, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1), ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1))
SECRETS = "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), m AS (" + " UNION ALL ".join(
    f"""SELECT rid, {k} AS rank, '{kind}' AS kind, unnest(regexp_extract_all(t, '{p}', 0)) AS hit, unnest(regexp_extract_all(t, '{p}', {g})) AS counted,
    unnest(string_split_regex(t, '{p}')[:-2]) AS before, unnest(range(len(regexp_extract_all(t, '{p}', 0)))) AS i, {least} AS least FROM d"""
    for k, (kind, p, g, least) in enumerate(_KINDS)) + """),
s AS (SELECT *, (sum(length(before) + length(hit)) OVER (PARTITION BY rid, rank ORDER BY i))::BIGINT AS e FROM m),
f AS (SELECT rid, rank, kind, e - length(hit) AS b, e FROM s WHERE length(counted) >= least),
g AS (SELECT rid, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) FILTER (WHERE rank < 3) AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) AS spans
  FROM f GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""

_CHUNKS = " || ".join(
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v[{0}] >> {1}) % 32 + 1, 1)".format(c + 1, s) for c in range(8) for s in (15, 10, 5, 0))
WARC = f"""
WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS x, coalesce(html, '') AS html FROM pages),
c AS (SELECT *, list_transform(range(8), lambda c: list_sum(list_transform(range(5), lambda k:
  (instr('0123456789abcdef', substr(x, (5 * c + k + 1)::INT, 1)) - 1) * (16 ** (4 - k))::BIGINT))::BIGINT) AS v FROM h),
d AS (SELECT page_id, size, {_CHUNKS} AS digest, max(page_id) OVER (PARTITION BY html) AS last FROM c)
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM d"""


def _count(column: str, keep: str) -> str:
    return f"length(regexp_replace({column}, '[^{keep}]+', '', 'g'))"


def _js(p: str, q: str) -> str:
    return (f"sqrt(greatest(0.0, sum(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0.0 END / 2"
            f" + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0.0 END / 2)))")


QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
l AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
w AS (SELECT rid, lang, unnest(w) AS word, unnest(range(len(w))) AS i FROM l),
g AS (SELECT rid, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g WHERE gram IS NOT NULL) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(3) AS r(k) GROUP BY 1),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
b AS (SELECT rid, doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) AS chars,
  {_count('t', '#*$%&|<>')} AS n_symbols, {_count('t', chr(92) + 'p{Lu}')} AS upper, {_count('t', '0-9')} AS digits, {_count('t', '.,;:!?')} AS marks FROM l),
classes AS (SELECT rid, lang, unnest([upper, digits, n_symbols, marks, chars - word_chars, word_chars - upper - digits - n_symbols - marks]) AS n,
  unnest(range(6)) AS k FROM b),
ref_classes AS (SELECT lang, k, sum(n) AS n FROM classes GROUP BY 1, 2),
ref_words AS (SELECT lang, word, count(*) AS n FROM w GROUP BY 1, 2),
ref AS (SELECT lang, sum(n) AS words FROM ref_words GROUP BY 1),
common AS (SELECT lang, word, n FROM ref_words QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {_R.common_words}),
class_js AS (SELECT rid, {_js('p', 'q')} AS js FROM (
  SELECT c.rid, c.n / sum(c.n) OVER (PARTITION BY rid) AS p, r.n / sum(r.n) OVER (PARTITION BY rid) AS q
  FROM classes c JOIN ref_classes r USING (lang, k)) GROUP BY 1),
own AS (SELECT b.rid, b.lang, c.word, c.n AS q, count(w.word) AS p FROM b JOIN common c USING (lang) LEFT JOIN w ON w.rid = b.rid AND w.word = c.word GROUP BY 1, 2, 3, 4),
both_words AS (SELECT rid, lang, p, q FROM own
  UNION ALL SELECT o.rid, o.lang, any_value(b.n_words) - sum(p), any_value(ref.words) - sum(q) FROM own o JOIN b USING (rid) JOIN ref ON ref.lang = o.lang GROUP BY 1, 2),
word_js AS (SELECT rid, {_js('p', 'q')} AS js FROM (
  SELECT rid, p / sum(p) OVER (PARTITION BY rid) AS p, q / sum(q) OVER (PARTITION BY rid) AS q FROM both_words) GROUP BY 1),
j AS (SELECT b.*, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_dup_lines, 0) AS n_dup_lines, c.js AS cjs, x.js AS wjs, coalesce(ref.words, 0) AS words,
  n_words < {_R.min_words} OR 100 * coalesce(n_repeat_words, 0) > {_R.max_repeat_percent} * n_words AS base_failed
  FROM b LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN class_js c USING (rid) LEFT JOIN word_js x USING (rid) LEFT JOIN ref ON ref.lang = b.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (words < {_R.min_reference_words} OR (
    (n_words < {_R.min_words_classes} OR cjs <= {_R.max_class_distance}) AND (n_words < {_R.min_words_common} OR wjs <= sqrt({_R.max_word_distance ** 2} + {_R.common_words / (8 * math.log(2))} / greatest(n_words, 1))))) AS kept
FROM j"""
