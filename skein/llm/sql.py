"""SQL for DuckDB that gives the rows of the queries."""

from __future__ import annotations

from .common import WORD_SQL
from .decontaminate import UNITS

_CASED = WORD_SQL.replace("[0-9a-z", "[0-9a-zA-Z")
_GAP = _CASED.replace("[", "[^", 1).removesuffix("+") + "*"
_UNITS = ", ".join(f"'{u}'" for u in UNITS)


def _template_tokens(table: str, id_col: str) -> str:
    """id, row, pos, kind, token of each template token: numbers and names in a row are one."""
    return f"""
    (WITH texts AS (SELECT {id_col} AS id, row_number() OVER () AS rid, text FROM {table} WHERE {id_col} IS NOT NULL AND text IS NOT NULL),
    raw AS (SELECT id, rid, unnest(regexp_extract_all(text, '{_GAP}{_CASED}')) AS piece,
            generate_subscripts(regexp_extract_all(text, '{_GAP}{_CASED}'), 1) AS n FROM texts),
    parts AS (SELECT id, rid, n, regexp_extract(piece, '^{_GAP}') AS gap, substr(piece, length(regexp_extract(piece, '^{_GAP}')) + 1) AS w FROM raw),
    kinds AS (SELECT id, rid, n, gap, lower(w) AS w, CASE WHEN w[1] BETWEEN '0' AND '9' THEN '<num>' WHEN n > 1 AND gap = ' ' AND lower(w[1]) <> w[1] THEN '<name>' ELSE '' END AS kind FROM parts),
    flags AS (SELECT *, CASE WHEN n > 1 AND kind <> '' AND kind = lag(kind) OVER (PARTITION BY rid ORDER BY n) AND (kind = '<name>' AND gap = ' ' OR kind = '<num>' AND gap IN ('.', ',', ':', '/')) THEN 0 ELSE 1 END AS fresh FROM kinds),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY n) AS g FROM flags),
    tokens AS (SELECT id, rid, g - 1 AS pos, first(kind ORDER BY n) AS kind, string_agg(CASE WHEN fresh = 1 THEN w ELSE gap || w END, '' ORDER BY n) AS w FROM runs GROUP BY id, rid, g),
    final AS (SELECT id, rid, pos, CASE WHEN kind <> '<num>' AND lag(kind) OVER (PARTITION BY rid ORDER BY pos) = '<num>' AND w IN ({_UNITS}) THEN '<unit>' ELSE kind END AS kind, w FROM tokens)
    SELECT id, rid, CAST(pos AS BIGINT) AS pos, kind, w, count(*) OVER (PARTITION BY rid) AS total FROM final)"""


def _template_windows(table: str, frame: str) -> str:
    return f"""SELECT id, pos, total, wide, template, slots FROM (
      SELECT id, rid, pos, total, {frame} AS wide,
        string_agg(CASE WHEN kind = '' THEN w ELSE kind END, ' ') OVER f AS template,
        list(CASE WHEN kind <> '' THEN kind || w END) OVER f AS slots, count(*) OVER f AS n, count(*) FILTER (kind = '') OVER f AS literals
      FROM {table} WINDOW f AS (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING))
    WHERE n = wide AND literals >= least(4, wide)"""


OP1 = f"""
WITH dt AS MATERIALIZED (SELECT * FROM {_template_tokens("documents", "doc_id")}),
bt AS MATERIALIZED (SELECT * FROM {_template_tokens("benchmark", "item_id")}),
bw AS MATERIALIZED (SELECT DISTINCT * FROM ({_template_windows("bt", "least(total, 8)")})),
dw AS MATERIALIZED ({_template_windows("dt", "8")}),
hits AS (SELECT d.id AS doc_id, b.id AS item_id, d.pos, b.pos AS item_pos, b.total - b.wide + 1 AS item_windows, d.slots, b.slots AS item_slots
  FROM dw d JOIN bw b ON d.template = b.template AND b.wide = 8),
pairs AS (SELECT doc_id, item_id, item_windows, pos - item_pos AS shift, unnest(item_slots) AS a, unnest(slots) AS b FROM hits),
slots AS (SELECT doc_id, item_id, item_windows, shift, count(DISTINCT a) AS n, count(DISTINCT (a, b)) AS m FROM pairs WHERE a IS NOT NULL GROUP BY ALL),
lined AS (SELECT doc_id, item_id, item_windows, pos - item_pos AS shift, count(DISTINCT item_pos) AS matched, min(pos) AS first_token FROM hits GROUP BY ALL)
SELECT doc_id, item_id, CAST(max(matched) AS BIGINT) AS matched, CAST(max(item_windows) AS BIGINT) AS item_windows, CAST(min(first_token) AS BIGINT) AS first_token, CAST(max(coalesce(n, 0)) AS BIGINT) AS slots
FROM lined LEFT JOIN slots USING (doc_id, item_id, item_windows, shift)
WHERE coalesce(n, 0) = coalesce(m, 0) AND matched >= least(6, ceil(item_windows * 0.5)) GROUP BY doc_id, item_id"""

OP2 = f"""
WITH words AS (SELECT doc_id, text, row_number() OVER () AS rid, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{WORD_SQL}'))) AS terms FROM documents),
each AS (SELECT doc_id, rid, unnest(terms) AS t FROM words),
n AS (SELECT ln(greatest(count(text), 2)) AS x FROM documents),
lexicon AS (SELECT t, md5(t) AS d FROM each, n GROUP BY t, x HAVING (x - ln(count(*))) / x BETWEEN 0.15 AND 0.8),
kept AS (SELECT rid, subset, t FROM each JOIN lexicon USING (t), range(5) s(subset) WHERE subset = 0 OR substr(d, CAST(subset AS INTEGER), 1) < 'b'),
made AS (SELECT rid, subset, count(*) AS n_terms, md5(string_agg(t, ' ' ORDER BY t)) AS fingerprint FROM kept GROUP BY rid, subset)
SELECT doc_id, CAST(s.subset AS INTEGER) AS subset, coalesce(n_terms, 0) AS n_terms, fingerprint
FROM words CROSS JOIN range(5) s(subset) LEFT JOIN made USING (rid, subset)"""

OP3 = f"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
words AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM docs),
edges AS MATERIALIZED (SELECT doc_id, rid, unnest(range(0, len(w) - 49)) AS pos, unnest(list_transform(range(1, len(w) - 48), lambda i: md5_number(array_to_string(w[i : i + 49], ' ')))) AS e,
  unnest(list_transform(range(1, len(w) - 48), lambda i: md5_number(array_to_string(w[i : i + 48], ' ')))) AS a, unnest(list_transform(range(1, len(w) - 48), lambda i: md5_number(array_to_string(w[i + 1 : i + 49], ' ')))) AS b
  FROM words WHERE len(w) >= 50),
twice AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY e) AS n FROM edges) WHERE n > 1),
ends AS (SELECT a AS node, rid, pos, e AS o, NULL AS i FROM twice UNION ALL SELECT b, rid, pos + 1, NULL, e FROM twice),
nodes AS MATERIALIZED (SELECT node, rid, pos, max(o) AS o, max(i) AS i FROM ends GROUP BY ALL),
inner_ AS MATERIALIZED (SELECT node FROM nodes GROUP BY node HAVING count(*) = count(o) AND count(*) = count(i) AND count(DISTINCT o) = 1 AND count(DISTINCT i) = 1),
marks AS (SELECT doc_id, rid, pos, n, CASE WHEN lag(pos) OVER r = pos - 1 THEN 0 ELSE 1 END AS fresh, CASE WHEN lag(pos) OVER r = pos - 1 AND a IN (SELECT node FROM inner_) THEN 0 ELSE 1 END AS start
  FROM twice WINDOW r AS (PARTITION BY rid ORDER BY pos)),
spans AS (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY pos) AS g FROM marks)
SELECT doc_id, CAST(min(pos) AS BIGINT) AS first_word, CAST(count(*) + 49 AS BIGINT) AS n_words, CAST(sum(start) AS BIGINT) AS n_paths, CAST(max(n) AS BIGINT) AS copies FROM spans GROUP BY doc_id, rid, g"""

OP7 = r"""
WITH raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE doc_id IS NOT NULL),
lines AS MATERIALIZED (SELECT doc_id, line, trim(s, ' ' || chr(9) || chr(13)) AS s FROM raw WHERE length(trim(s, ' ' || chr(9) || chr(13))) >= 1),
uniq AS MATERIALIZED (SELECT s, min({'d': doc_id, 'l': line}) AS p FROM lines GROUP BY s),
keys AS (SELECT s, p, length(s) - d AS n, i, CASE WHEN i = 0 THEN left(s, (length(s) - d) // 2) ELSE substr(s, (length(s) - d) // 2 + d + 1) END AS k FROM uniq, range(2) a(d), range(2) b(i) WHERE length(s) >= 16),
near AS (SELECT DISTINCT x.s, y.p FROM keys x JOIN keys y ON x.n = y.n AND x.i = y.i AND x.k = y.k AND x.p > y.p WHERE abs(length(x.s) - length(y.s)) <= 1 AND levenshtein(x.s, y.s) = 1),
best AS (SELECT s, min({'d': p.d, 'l': p.l, 'e': e}) AS b FROM (SELECT s, p, 0 AS e FROM uniq UNION ALL SELECT s, p, 1 FROM near) GROUP BY s)
SELECT DISTINCT doc_id, CAST(line AS BIGINT) AS line, b.d AS kept_doc_id, CAST(b.l AS BIGINT) AS kept_line, CAST(b.e AS BIGINT) AS edits
FROM lines JOIN best USING (s) WHERE {'d': doc_id, 'l': line} > {'d': b.d, 'l': b.l}"""

OP8 = f"""
WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD_SQL}') AS w FROM documents WHERE doc_id IS NOT NULL),
sets AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words WHERE len(w) > 0),
each AS MATERIALIZED (SELECT doc_id, hash(unnest(s)) AS h FROM sets),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM each a JOIN each b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
near AS MATERIALIZED (SELECT x, y FROM met JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y WHERE n >= 0.5 * (len(p.s) + len(q.s) - n)),
links AS MATERIALIZED (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT x AS doc_id, min(y) AS kept_doc_id FROM reach GROUP BY x HAVING min(y) < x"""

OP10 = """
SELECT conv_id, count(*) AS n_turns,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op2_fingerprints": OP2, "op3_substring_dedup": OP3, "op7_line_dedup": OP7, "op8_near_duplicates": OP8, "op10_chat": OP10}
