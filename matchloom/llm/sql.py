"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_M = "chr(57344)"


def _spans(kind: str, pattern: str, keep: str, base: float, more: float, words: str, least: float) -> str:
    """Spans of one kind: cut the text around each match, then add up the lengths."""
    return f"""
      SELECT doc_id, '{kind}' AS kind, start, start + length(found) AS stop FROM (
        SELECT doc_id, clean, pieces[i] AS found,
          coalesce(list_sum(list_transform(pieces[1:i - 1], lambda p: length(p))), 0)::BIGINT AS start
        FROM (SELECT doc_id, clean, pieces, unnest(generate_series(2, len(pieces), 2)) AS i FROM (
          SELECT doc_id, clean, string_split(regexp_replace(clean, '{pattern}', {_M} || '\\0' || {_M}, 'g'), {_M}) AS pieces
          FROM texts))) s
      WHERE ({keep}) AND {base} + CASE WHEN regexp_matches(lower(clean[greatest(start - 40, 0) + 1:start]),
        '(^|[^a-z])({words})') THEN {more} ELSE 0 END >= {least}"""


_DIGITS = "regexp_replace(found, '[^0-9]', '', 'g')"
_LUHN = f"""length({_DIGITS}) BETWEEN 16 AND 19 AND list_sum(list_transform(generate_series(1, length({_DIGITS})),
  lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN {_DIGITS}[i]::INT
    WHEN {_DIGITS}[i]::INT > 4 THEN 2 * {_DIGITS}[i]::INT - 9 ELSE 2 * {_DIGITS}[i]::INT END)) % 10 = 0"""
_OCTET = "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_IBAN = "replace(found, ' ', '')"
_TURNED = f"({_IBAN}[5:] || {_IBAN}[1:4])"
_VALUE = f"""array_to_string(list_transform(string_split({_TURNED}, ''),
  lambda c: CASE WHEN c = '' THEN '' WHEN ascii(c) >= 65 THEN (ascii(c) - 55)::VARCHAR ELSE c END), '')"""
_MOD97 = f"list_reduce(list_prepend(0, list_transform(string_split({_VALUE}, ''), lambda c: c::INT)), lambda a, b: (a * 10 + b) % 97) = 1"
_EDGE = "NOT regexp_matches(clean[start:start], '{0}') AND NOT regexp_matches(clean[start + length(found) + 1:start + length(found) + 1], '{0}')"

OP2 = f"""
WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), {_M}, chr(57345)) AS clean FROM documents),
spans AS ({" UNION ALL ".join((
    _spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 0.9, 0, "mail", 0),
    _spans("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", rf"regexp_matches(found, '^({_OCTET}\.){{3}}{_OCTET}$')", 0.6, 0, "ip", 0),
    _spans("card", r"[0-9]([\x20-]?[0-9])+", _LUHN, 0.8, 0, "card", 0),
    _spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15", 0.7, 0, "phone", 0),
    _spans("iban", r"[A-Z]{2}[0-9]{2}([A-Z0-9]{11,30}|( [A-Z0-9]{4}){2,7}( [A-Z0-9]{1,3})?)",
           f"{_EDGE.format('[A-Za-z0-9]')} AND {_MOD97}", 0.7, 0.2, "iban|account|bank", 0.5),
    _spans("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
           f"{_EDGE.format('[0-9-]')} AND NOT regexp_matches(found, '^(000|666|9)|-00-|-0000$')",
           0.3, 0.4, "ssn|social security", 0.5),
))}),
ordered AS (SELECT doc_id, kind, start, kind || ':' || start || ':' || stop AS span,
  list_position(['email', 'ip', 'card', 'phone', 'iban', 'ssn'], kind) AS place FROM spans),
found AS (SELECT doc_id,
  count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
  count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(span, ',' ORDER BY place, start) FILTER (place <= 4) AS base,
  string_agg(span, ',' ORDER BY place, start) AS spans FROM ordered GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
  coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN found USING (doc_id)
"""

OP4 = """
WITH vectors AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, x.vec_id,
    list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * x.v[i]))::BIGINT AS score
  FROM vectors q JOIN vectors x ON q.vec_id % 50 = 0 AND q.vec_id <> x.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_WORDS = r"""list_filter(string_split(regexp_replace(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda w: w <> '')"""

OP5 = f"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_WORDS.format('text')} AS words FROM benchmark),
windows AS (SELECT DISTINCT item, size, array_to_string(words[i:i + size - 1], ' ') AS win FROM (
  SELECT item, words, least(10, len(words)) AS size, unnest(generate_series(1, len(words) - least(10, len(words)) + 1)) AS i
  FROM items WHERE len(words) > 0)),
docs AS (SELECT doc_id, {_WORDS.format('text')} AS words FROM documents),
starts AS (SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS win FROM (
  SELECT doc_id, words, size, unnest(generate_series(1, len(words) - size + 1)) AS i
  FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size)),
hits AS (SELECT DISTINCT doc_id, size, i, item FROM starts JOIN windows USING (size, win)),
words AS (SELECT doc_id, count(DISTINCT word_no) AS n_hit FROM (
  SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS word_no FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP1 = """
WITH RECURSIVE docs AS (SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13),
  'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda w: w <> '') AS words FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle FROM (
  SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM docs WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (shingle)
  WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
  WHERE 100 * c >= 75 * (s.n + t.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id AS node, doc_id AS label FROM docs
  UNION SELECT b.y, r.label FROM reached r JOIN both_ways b ON b.x = r.node),
labels AS (SELECT node AS doc_id, min(label) AS component_id FROM reached GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM labels LEFT JOIN sizes USING (doc_id)
"""

OP7 = r"""
WITH docs AS (SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''),
  chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda w: w <> '') AS words FROM documents),
starts AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS win FROM (
  SELECT doc_id, words, unnest(generate_series(1, len(words) - 49)) AS i FROM docs WHERE len(words) >= 50)),
owners AS (SELECT win, min(doc_id) AS least FROM starts GROUP BY win HAVING min(doc_id) <> max(doc_id)),
covered AS (SELECT doc_id, list(DISTINCT word_no) AS gone FROM (
  SELECT doc_id, unnest(generate_series(i, i + 49)) AS word_no
  FROM starts JOIN owners USING (win) WHERE doc_id > least) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(words, ' ') ELSE array_to_string(
    list_transform(list_filter(generate_series(1, len(words)), lambda k: NOT list_contains(gone, k)), lambda k: words[k]),
    ' ') END) AS kept_sha256
FROM docs LEFT JOIN covered USING (doc_id)
"""

_INLINE = (
    "a|abbr|b|bdi|bdo|big|button|cite|code|data|del|dfn|em|font|i|img|input|ins|kbd|label|mark|q|s|samp|small|span"
    "|strike|strong|sub|sup|time|tt|u|var|wbr"
)


def line_dedup(source: str, site: str, key: str, columns: str, ratio: float = 0.1) -> str:
    """SQL of the line dedup: ``source`` has ``key``, ``text``, a site expression and other ``columns``."""
    return f"""
WITH base AS (SELECT *, coalesce({site}, '') AS site_key FROM ({source})),
lines AS (SELECT {key}, site_key, unnest(parts) AS line, unnest(generate_series(1, len(parts))) AS place FROM (
  SELECT {key}, site_key, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS parts FROM base WHERE text IS NOT NULL)),
trimmed AS (SELECT *, trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(133) || chr(160)) AS short FROM lines),
totals AS (SELECT site_key, count(*) AS pages FROM base GROUP BY site_key),
boiler AS (SELECT site_key, short FROM (SELECT DISTINCT {key}, site_key, short FROM trimmed WHERE short <> '')
  JOIN totals USING (site_key)
  GROUP BY site_key, short, pages HAVING count(*) > 1 AND count(*) > {ratio}::DOUBLE * pages),
marked AS (SELECT t.*, b.short IS NOT NULL AS drop_it FROM trimmed t LEFT JOIN boiler b USING (site_key, short)),
short_texts AS (SELECT {key}, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT drop_it), '') AS kept,
  bool_or(drop_it) AS changed FROM marked GROUP BY {key})
SELECT {columns}, CASE WHEN changed THEN kept ELSE text END AS text FROM base LEFT JOIN short_texts USING ({key})
"""


OP8 = line_dedup(
    rf"""SELECT page_id,
      nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
      trim(regexp_replace(regexp_replace(html,
        '(?is)<(?:script.*?(?:</script>|\z)|style.*?(?:</style>|\z)|!--.*?(?:-->|\z)|/?(?:{_INLINE})(?:[\s/][^<>]*)?>)', '', 'g'),
        '(?:\n|<[^<>]*>)(?:[ \t\n]|<[^<>]*>)*', chr(10), 'g'), chr(10)) AS text FROM pages""",
    "host",
    "page_id",
    "page_id, host",
)


def vector_codes(parts: int, entries: int, rounds: int) -> str:
    """SQL of the product codes: a table of codebooks and one of assignments for each round."""
    steps = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT vec_id, part, v[part * size + 1:(part + 1) * size] AS p
  FROM (SELECT vec_id, v, len(v) // {parts} AS size, unnest(range({parts})) AS part FROM kept)),
book0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, p FROM cut
  QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {entries})"""
    for i in range(rounds + 1):
        steps += f""",
near{i} AS MATERIALIZED (SELECT c.vec_id, c.part, any_value(c.p) AS p, min(struct_pack(far := list_inner_product(c.p, c.p)
    - 2 * list_inner_product(c.p, b.p) + list_inner_product(b.p, b.p), entry := b.entry)) AS best
  FROM cut c JOIN book{i} b USING (part) GROUP BY c.vec_id, c.part)"""
        if i < rounds:
            steps += f""",
mean{i} AS (SELECT part, entry, list(x ORDER BY place) AS p FROM (
  SELECT part, entry, place, floor(sum(x) / count(*)) AS x FROM (
    SELECT part, best.entry AS entry, unnest(p) AS x, unnest(range(len(p))) AS place FROM near{i}) GROUP BY ALL)
  GROUP BY part, entry),
book{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.p, b.p) AS p FROM book{i} b LEFT JOIN mean{i} m USING (part, entry))"""
    return f"""{steps},
codes AS (SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.far)::BIGINT AS error
  FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, place))
   FROM (SELECT part, entry, unnest(p) AS x, unnest(range(len(p))) AS place FROM book{rounds})) AS codebooks_sha256
FROM codes JOIN kept USING (vec_id)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_filter(host_rules: list[tuple[str, str]], patterns: list) -> str:
    """SQL of the url filter: every pattern runs on every url."""
    fits = lambda p: f"regexp_matches(low, {_quoted(p.regex.replace(chr(92) + 'A', '^').replace(chr(92) + 'Z', '$'))}, 's')"
    any_of = lambda some: " OR ".join(fits(p) for p in some) or "false"
    rows = ", ".join(f"({_quoted(v)}, {_quoted(t.partition('/')[0])}, {_quoted(t[t.index('/'):])}, {_quoted(t)})" for v, t in host_rules)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    at = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
    return f"""
WITH rules(verdict, host, path, rule) AS (VALUES {rows}),
urls AS (SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
  translate(regexp_extract(coalesce(url, ''), '{at}', 1), '{upper}', '{lower}') AS host,
  regexp_extract(coalesce(url, ''), '{at}', 2) AS path FROM pages),
fits AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(r.verdict, length(rule)) AS verdict
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE
  WHEN ({any_of(p for p in patterns if not p.exception)}) AND NOT ({any_of(p for p in patterns if p.exception)})
  THEN 'block' ELSE 'allow' END) AS verdict
FROM urls LEFT JOIN fits USING (page_id)
"""


OP13 = """
WITH base AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
  list_transform(range(4), lambda i: ('0x' || sha256('1:' || doc_id)[8 * i + 1:8 * i + 8])::BIGINT) AS h FROM documents),
cut AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90
    THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM base),
made AS (SELECT *, CASE form WHEN 'plain' THEN t
  WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
  ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END AS made FROM cut),
pieces AS (SELECT *, CASE form WHEN 'psm' THEN string_split(made[4:], '<S>') WHEN 'spm' THEN string_split(made[4:], '<P>') END AS x,
  string_split(made, '<M>')[2] AS middle FROM made)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(made) AS output_sha256, sha256(CASE form WHEN 'plain' THEN made
    WHEN 'psm' THEN x[1] || middle || string_split(x[2], '<M>')[1]
    ELSE string_split(x[2], '<M>')[1] || middle || x[1] END) AS restored_sha256
FROM pieces
"""
