"""SQL for DuckDB that gives the rows of the queries."""

from __future__ import annotations

from .functions.paths import CATEGORIES
from .operators.analyze import NOISE, STRUCTURAL, WHY
from .operators.extract import KEYWORDS, REASONS
from .operators.query import terms
from .queries import CUT, QUESTION
from .sources.files import CODE, MARKDOWN, NOISE_DIRS, SECRET, SECRET_ENDS, SENSITIVE

T = 10**12
W = r"[\p{L}\p{N}_]+"


def _in(xs) -> str:
    return "(" + ", ".join(f"'{x}'" for x in sorted(xs)) + ")"


def trade_nodes(name: str = "nodes", where: str = "true") -> str:
    return f"""{name} AS MATERIALIZED (SELECT * FROM (
  SELECT 'region:' || r_regionkey AS id, r_name AS label, 'geo/region.tbl' AS source_file, NULL::INT AS community, 'region' AS node_type, CAST(r_regionkey AS BIGINT) AS ord FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'geo/nation.tbl', n_nationkey, 'nation', {T} + n_nationkey FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'supply/n' || s_nationkey || '/supplier.tbl', s_nationkey, 'supplier', {2 * T} + s_suppkey FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'sales/n' || c_nationkey || '/' || c_mktsegment || '.tbl', c_nationkey, 'customer', {3 * T} + c_custkey FROM customer
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'catalog/' || p_brand || '/' || p_type || '.tbl', NULL, 'part', {4 * T} + p_partkey FROM part) WHERE {where})"""


def trade_edges(name: str = "edges", where: str = "true") -> str:
    K = 1000 * T
    return f"""{name} AS MATERIALIZED (
  SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'contains' AS relation, 'EXTRACTED' AS confidence, {K} + n_nationkey AS ord FROM nation
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in', 'EXTRACTED', {2 * K} + s_suppkey FROM supplier
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located_in', 'EXTRACTED', {3 * K} + c_custkey FROM customer
  UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'calls', CASE WHEN count(*) >= 3 THEN 'EXTRACTED' WHEN count(*) = 2 THEN 'INFERRED' ELSE 'AMBIGUOUS' END, {4 * K} + l_partkey * 1000000 + l_suppkey
    FROM lineitem WHERE {where} GROUP BY l_partkey, l_suppkey)"""


TRADE = f"WITH RECURSIVE {trade_nodes()}, {trade_edges()}"
STEPS = """steps AS MATERIALIZED (SELECT * FROM (SELECT 'u' || user_id || ':' || event_type AS source, lead('u' || user_id || ':' || event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target, 'calls' AS relation, 'EXTRACTED' AS confidence, event_id AS ord FROM events) WHERE target IS NOT NULL)"""
SESSIONS = f"""WITH RECURSIVE {STEPS},
nodes AS MATERIALIZED (SELECT 'u' || user_id || ':' || event_type AS id, event_type AS label, 'users/d' || (user_id // 3) || '/u' || user_id || '.log' AS source_file, user_id::INT AS community, 'event' AS node_type, min(event_id) AS ord FROM events GROUP BY user_id, event_type),
edges AS MATERIALIZED (SELECT source, target, relation, confidence, min(ord) AS ord FROM steps GROUP BY ALL)"""
WEB = r"""WITH raw AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS n FROM pages),
edges AS MATERIALIZED (SELECT 'page:' || page_id AS source, lower(translate(regexp_replace(trim(href), '^\.+', ''), '\/.', '___')) AS target, page_id * 100000 + n AS ord FROM raw),
page AS (SELECT 'page:' || page_id AS id, url AS label, page_id AS ord FROM pages)"""
FILES = r"""files AS MATERIALIZED (SELECT 'catalog/' || p_brand || '/' || p_type || '.py' AS path,
  string_agg('# NOTE: part ' || p_partkey || chr(10) || 'class Part' || p_partkey || ':' || chr(10) || 'def ' || translate(p_name, ' -', '__') || '_' || p_partkey || '():' || chr(10) || '  fn size' || p_size || '() {' || chr(10) || '    return (' || p_size || ')' || chr(10) || '  }' || chr(10), '' ORDER BY p_partkey) AS content FROM part GROUP BY p_brand, p_type)"""
LINES = "lines AS (SELECT path, unnest(string_split(content, chr(10))) AS s, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files)"
INCIDENT = "incident AS MATERIALIZED (SELECT n.id, coalesce(d.degree, 0) AS degree FROM nodes n LEFT JOIN (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges WHERE target <> source) GROUP BY id) d USING (id))"
ENDS = "ends AS MATERIALIZED (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id)"
ADJ = "adj AS MATERIALIZED (SELECT source AS a, target AS b, ord AS pos FROM edges UNION ALL SELECT target, source, ord FROM edges)"
NAME = "regexp_extract({}, '([^/]*)$', 1)"
EXT = r"lower(regexp_extract({}, '[^/]\.([^./]*)$', 1))"
STEM = r"regexp_replace(regexp_extract({}, '([^/]*)$', 1), '(.)\.[^.]*$', '\1')"
DIR = "regexp_extract({}, '^(.*)/[^/]*$', 1)"
LAST = "regexp_extract({}, '([^/]+)/[^/]*$', 1)"
TOP = "CASE WHEN starts_with({0}, '/') THEN '/' ELSE split_part({0}, '/', 1) END"
CATEGORY = "CASE " + " ".join(f"WHEN {EXT} IN {_in(xs)} THEN '{k}'" for k, xs in CATEGORIES.items()) + " ELSE 'other' END"
FILE_NODE = f"label = {NAME.format('source_file')}"
SIZES = "sizes AS (SELECT community, count(*) AS size FROM nodes WHERE community IS NOT NULL GROUP BY community)"
SCORED = " + ".join(f"CASE WHEN contains(lower(label), '{w}') THEN 1.0 ELSE 0.0 END + CASE WHEN contains(lower(source_file), '{w}') THEN 0.5 ELSE 0.0 END" for w in terms(QUESTION))
SCORES = f"scores AS MATERIALIZED (SELECT * FROM (SELECT *, CAST({SCORED} AS DOUBLE) AS score FROM nodes) WHERE score > 0)"
LABELLED = "SELECT e.*, coalesce(s.label, e.source) AS source_label, coalesce(t.label, e.target) AS target_label FROM {} e LEFT JOIN nodes s ON s.id = e.source LEFT JOIN nodes t ON t.id = e.target"
GROUP_SCORE = """touch AS (SELECT g, source, target, relation, ord, count(*) AS n FROM (SELECT m.g, e.source, e.target, e.relation, e.ord FROM edges e JOIN m ON m.id = e.source UNION ALL SELECT m.g, e.source, e.target, e.relation, e.ord FROM edges e JOIN m ON m.id = e.target) GROUP BY ALL),
score AS (SELECT g, count(*) FILTER (n = 2) / count(*) AS score FROM touch GROUP BY g)"""


def bfs(start: str, depth: int) -> str:
    out = [f"l0 AS MATERIALIZED (SELECT DISTINCT id, 0 AS level FROM ({start}))", "seen0 AS (SELECT * FROM l0)"]
    for d in range(1, depth + 1):
        out.append(f"h{d} AS MATERIALIZED (SELECT a, b FROM adj JOIN l{d - 1} ON a = id WHERE b NOT IN (SELECT id FROM seen{d - 1}))")
        out.append(f"l{d} AS MATERIALIZED (SELECT DISTINCT b AS id, {d} AS level FROM h{d})")
        out.append(f"seen{d} AS MATERIALIZED (SELECT * FROM seen{d - 1} UNION ALL SELECT * FROM l{d})")
    return ", ".join(out)


def surprise(pairs: str) -> str:
    a, b = CATEGORY.format(*["s_file"] * 4), CATEGORY.format(*["t_file"] * 4)
    return f"""ends2 AS (SELECT n.id, source_file AS file, coalesce(community, 0) AS comm, degree AS deg FROM nodes n JOIN incident i ON i.id = n.id WHERE NOT ({FILE_NODE})),
all_pairs AS (SELECT e.*, s.file AS s_file, t.file AS t_file, s.comm AS s_comm, t.comm AS t_comm, s.deg AS s_deg, t.deg AS t_deg FROM edges e JOIN ends2 s ON s.id = e.source JOIN ends2 t ON t.id = e.target WHERE relation NOT IN {_in(STRUCTURAL)}),
pairs AS ({pairs}),
marks AS (SELECT *, {a} AS ca, {b} AS cb, {TOP.format("s_file")} AS da, {TOP.format("t_file")} AS db, s_comm <> t_comm AS bridges, (s_deg <= 2 AND t_deg >= 5) OR (t_deg <= 2 AND s_deg >= 5) AS reach FROM pairs),
found AS (SELECT *, ca <> cb AND ca <> 'other' AND cb <> 'other' AS crosses, da <> '' AND db <> '' AND da <> db AS apart FROM marks)
SELECT source, target, relation, confidence, CAST(CASE confidence WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END + 2 * crosses::INT + 2 * apart::INT + bridges::INT + reach::INT AS INTEGER) AS score,
  coalesce(nullif(concat_ws('; ', CASE confidence WHEN 'AMBIGUOUS' THEN '{WHY["AMBIGUOUS"]}' WHEN 'INFERRED' THEN '{WHY["INFERRED"]}' END, CASE WHEN crosses THEN 'crosses file types (' || ca || ' → ' || cb || ')' END, CASE WHEN apart THEN 'connects across different directories/repos' END,
    CASE WHEN bridges THEN 'bridges separate communities' END, CASE WHEN reach THEN 'peripheral node unexpectedly reaches hub' END), ''), 'cross-file semantic connection') AS why FROM found"""


DOUBT = "CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END"
OLD_NEW = f"""WITH {trade_nodes("nodes_old", "NOT (node_type = 'customer' AND ord % 2 = 1)")}, {trade_edges("edges_old", f"l_shipdate < '{CUT}'")}, {trade_nodes("nodes_new", "node_type <> 'region'")}, {trade_edges("edges_new", f"l_shipdate >= '{CUT}'")}"""
DIFF_NODES = """(SELECT 'new' AS change, id, label FROM nodes_new WHERE id NOT IN (SELECT id FROM nodes_old) UNION ALL SELECT 'removed', id, label FROM nodes_old WHERE id NOT IN (SELECT id FROM nodes_new))"""
_EDGE_DIFF = "SELECT '{0}' AS change, source, target, relation, upper(confidence[1]) || lower(confidence[2:]) AS confidence FROM edges_{1} ANTI JOIN edges_{2} USING (source, target, relation)"
DIFF_EDGES = f"({_EDGE_DIFF.format('new', 'new', 'old')} UNION ALL {_EDGE_DIFF.format('removed', 'old', 'new')})"
CHAINS = """links AS MATERIALIZED (SELECT source, target FROM edges WHERE source <> target),
chains(nodes) AS (SELECT [source, target] FROM links UNION ALL SELECT list_append(nodes, target) FROM chains JOIN links ON source = nodes[-1] WHERE NOT list_contains(nodes, target) AND len(nodes) < 20)"""


def grouped(key: str, keep: str, least: int, most: str, id_: str, label: str, relation: str, rank: int, extra: str = "") -> str:
    """CTEs that end in a table ``found{rank}``."""
    n = f"_{rank}"
    score = GROUP_SCORE.replace("touch", f"touch{n}").replace("score AS", f"score{n} AS").replace("JOIN m ", f"JOIN m{n} m ")
    return f"""keyed{n} AS (SELECT *, {key} AS g, {DIR.format("source_file")} AS dir FROM nodes WHERE {keep}),
g{n} AS (SELECT g, count(*) AS n, min(ord) AS ord, list(id ORDER BY id) AS nodes FROM keyed{n} GROUP BY g HAVING count(*) >= {least} AND count(*) <= {most}{extra}),
m{n} AS (SELECT k.g, k.id FROM keyed{n} k JOIN g{n} USING (g)), {score},
found{n} AS (SELECT {id_} AS id, {label} AS label, nodes, '{relation}' AS relation, coalesce(score, 0.5) AS confidence_score, {rank} AS rank, ord FROM g{n} LEFT JOIN score{n} USING (g))"""


FILE_GROUPS = grouped("source_file", "true", 3, "20", f"'file_' || replace(lower({STEM.format('g')}), ' ', '_')", f"{STEM.format('g')} || ' module'", "participate_in", 0)
DIR_GROUPS = grouped(LAST.format("source_file"), f"{LAST.format('source_file')} NOT IN ('', 'root') AND NOT starts_with({LAST.format('source_file')}, '.')", 6, "20", "'dir_' || lower(g)", "g || ' directory'", "directory_module", 3, " AND count(DISTINCT dir) = 1")
CONFIG_GROUPS = grouped(EXT.format("source_file"), f"{EXT.format('source_file')} IN ('yaml', 'yml', 'json', 'toml', 'tf', 'dockerfile')", 3, "20", "'config_' || g", "'Config files (.' || g || ')'", "config_group", 2)
SHOWN = "SELECT id, label, array_to_string(list_sort(nodes), ',') AS members, relation, CAST(confidence_score AS DOUBLE) AS confidence_score FROM"
COHESION = f"""{SIZES}, pairs AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM edges WHERE source <> target),
inside AS (SELECT x.community, count(*) AS n FROM pairs JOIN nodes x ON x.id = a JOIN nodes y ON y.id = b WHERE x.community = y.community GROUP BY x.community),
cohesion AS (SELECT community, size, CASE WHEN size <= 1 THEN 1.0 ELSE CAST(round(coalesce(n, 0) / (size * (size - 1) / 2) * 100) / 100 AS DOUBLE) END AS cohesion FROM sizes LEFT JOIN inside USING (community))"""
FIRST = "(SELECT min(source) FROM edges WHERE source <> target)"
START = f"start AS (SELECT {FIRST} AS s, (SELECT max(target) FROM edges WHERE split_part(source, ':', 1) = split_part({FIRST}, ':', 1)) AS t)"
HELD = f"{FILE_GROUPS}, member AS (SELECT unnest(nodes) AS id, id AS he, label AS he_label, ord AS he_ord FROM found_0)"
CHANGED = "past AS (SELECT path, CASE WHEN length(path) % 2 = 0 THEN content || chr(10) || '# more' ELSE content END AS content FROM files WHERE length(path) % 3 > 0)"
HASH = "sha256({} || chr(10) || chr(0) || {})"
KINDS = ["py", "rs", "TS", "md", "png", "toml", "key", "exe", ""]
DIRS = ["src", "node_modules", "lib/target", "my_env", "docs", "a.egg-info", "token-svc"]
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
CLASSIFIED = f"""WITH made AS (SELECT {_list(DIRS)}[(p_partkey // 9) % {len(DIRS)} + 1] || CASE WHEN p_partkey % 11 = 0 THEN '/.f' ELSE '/f' END || p_partkey || CASE WHEN {_list(KINDS)}[p_partkey % {len(KINDS)} + 1] <> '' THEN '.' || {_list(KINDS)}[p_partkey % {len(KINDS)} + 1] ELSE '' END AS path FROM part),
kinds AS (SELECT path, {EXT.format("path")} AS extension, {NAME.format("path")} AS name, list_filter(string_split({DIR.format("path")}, '/'), lambda d: d IN {_in(NOISE_DIRS)} OR regexp_matches(d, '(\\.egg-info|_env|_venv)$')) AS noisy FROM made),
classified AS (SELECT path, extension, CASE WHEN extension IN {_in(CODE)} THEN 'code' WHEN extension IN {_in(MARKDOWN)} THEN 'markdown' ELSE 'binary' END AS file_type,
  CASE WHEN starts_with(name, '.') THEN 'hidden' WHEN len(noisy) > 0 THEN 'noise' WHEN regexp_matches(path, '{SENSITIVE}') THEN 'sensitive' WHEN extension = '' THEN 'no extension' END AS skipped FROM kinds)"""
_WORDS = f"""dirs AS (SELECT community, d, count(*) AS n, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, d) AS r FROM (SELECT community, {DIR.format("source_file")} AS d FROM nodes WHERE community IS NOT NULL) WHERE d NOT IN ('', '.') GROUP BY community, d),
humps AS (SELECT community, regexp_extract_all(label, '(\\p{{Lu}}[^\\p{{Lu}}]*|^[^\\p{{Lu}}]+)', 1) AS h, string_split(lower(label), '_') AS p FROM nodes WHERE community IS NOT NULL),
terms AS (SELECT community, unnest(list_concat(p, list_transform(h[1:len(h) - 1], lambda x: lower(x)))) AS x FROM humps),
words AS (SELECT community, x, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, x) AS r FROM terms WHERE strlen(x) > 3 AND x NOT IN {_in(NOISE)} GROUP BY community, x)"""


SHELVES = f"""WITH RECURSIVE nodes AS MATERIALIZED (SELECT 'part:' || p_partkey AS id, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INT) AS community, p_brand, p_type, CAST(p_partkey AS BIGINT) AS ord FROM part),
edges AS MATERIALIZED (SELECT id AS source, next AS target, k * {T} + ord AS ord FROM (SELECT id, ord, 0 AS k, lead(id) OVER (PARTITION BY p_brand ORDER BY ord) AS next FROM nodes UNION ALL SELECT id, ord, 1, lead(id) OVER (PARTITION BY p_type ORDER BY ord) FROM nodes) WHERE next IS NOT NULL)"""
SHELF_ENDS = "start AS (SELECT (SELECT id FROM nodes ORDER BY ord LIMIT 1) AS s, (SELECT id FROM nodes WHERE p_brand = (SELECT p_brand FROM nodes ORDER BY ord LIMIT 1) ORDER BY ord LIMIT 1 OFFSET 5) AS t)"
WALKS = """walks(path, keys) AS (SELECT [s], []::BIGINT[] FROM start UNION ALL SELECT list_append(path, b), list_append(keys, pos) FROM walks JOIN adj ON a = path[-1], start WHERE NOT list_contains(path, b) AND NOT list_contains(path, t) AND len(path) <= 8),
            won AS (SELECT path FROM walks, start WHERE path[-1] = t ORDER BY len(path), keys LIMIT 1) SELECT CAST(generate_subscripts(path, 1) - 1 AS BIGINT) AS pos, unnest(path) AS id FROM won"""
HISTORY = "WITH seq AS (SELECT 'o' || o_orderkey AS id, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)"
#: What ``extract_edges`` finds in each source: $ is the file's stem, @ the number.
FACTS = [
    ("rs", "node", "$:Box@", "class", "L2"), ("rs", "node", "$:new", "function", "L4"), ("rs", "node", "$:make@", "function", "L6"), ("rs", "node", "$:helper", "function", "L?"),
    ("rs", "edge", "$:new", "$:make@", "calls EXTRACTED"), ("rs", "edge", "$:make@", "$:helper", "calls INFERRED"),
    ("go", "node", "$:Run@", "function", "L6"), ("go", "node", "$:Main@", "function", "L9"), ("go", "node", "$:Print", "function", "L?"), ("go", "edge", "$", "fmt", "imports EXTRACTED"), ("go", "edge", "$", "lib_u@", "imports EXTRACTED"),
    ("go", "edge", "$:Run@", "$:Print", "calls INFERRED"), ("go", "edge", "$:Main@", "$:Run@", "calls EXTRACTED"),
    ("js", "node", "$:aa@", "function", "L1"), ("js", "node", "$:bb@", "function", "L1"), ("js", "node", "$:cc", "function", "L?"), ("js", "edge", "$", "lib_z@", "imports EXTRACTED"), ("js", "edge", "$:aa@", "$:bb@", "calls EXTRACTED"), ("js", "edge", "$:bb@", "$:cc", "calls INFERRED"),
    ("rb", "node", "$:match", "function", "L2"), ("rb", "node", "$:grow@", "function", "L?"), ("rb", "node", "$:global", "function", "L?"), ("rb", "edge", "$", "set", "imports EXTRACTED"), ("rb", "edge", "$:match", "$:grow@", "calls INFERRED"), ("rb", "edge", "$:global", "$:match", "calls EXTRACTED"),
    ("java", "node", "$:Two@", "class", "L2"), ("java", "node", "$:one@", "function", "L2"), ("java", "node", "$:more", "function", "L2"), ("java", "edge", "$", "a_b_c@", "imports EXTRACTED"), ("java", "edge", "$:one@", "$:more", "calls EXTRACTED"), ("java", "edge", "$:more", "$:one@", "calls EXTRACTED"),
    ("py", "node", "$:Kind@", "class", "L3"), ("py", "node", "$:go", "function", "L4"), ("py", "node", "$:run@", "function", "L?"), ("py", "edge", "$", "x@", "imports_from EXTRACTED"), ("py", "edge", "$", "a_b", "imports_from EXTRACTED"), ("py", "edge", "$", "c", "imports_from EXTRACTED"),
    ("py", "edge", "$:go", "$:run@", "calls INFERRED"),
]
_filled = lambda c: f"replace(replace({c}, '$', 'f_' || x || '_' || k), '@', k) AS {c}"
_REASONS = [f"WHEN regexp_matches(path, '{x.replace('.', '[.]') if x == 'service.account' else x}') THEN 'has ''{x}'''" for x in SECRET] + [f"WHEN ends_with(path, '.{x}') THEN 'ends in ''.{x}'''" for x in SECRET_ENDS]


def oracle_sql() -> dict[str, str]:
    counts = "count(*) FILTER (confidence = 'EXTRACTED') AS extracted, count(*) FILTER (confidence = 'INFERRED') AS inferred, count(*) FILTER (confidence = 'AMBIGUOUS') AS ambiguous"
    stub = "(ends_with(label, '()') AND (starts_with(label, '.') OR i.degree <= 1))"
    gods = f"SELECT n.id, label, e.degree FROM nodes n JOIN ends e ON e.id = n.id JOIN incident i ON i.id = n.id WHERE NOT ({FILE_NODE}) AND NOT {stub} ORDER BY e.degree DESC, n.id LIMIT 10"
    best = "SELECT id FROM scores ORDER BY score DESC, ord LIMIT 3"
    details = "SELECT '{0}' AS direction, e.{2} AS id, e.{2}_label AS label, relation, upper(confidence[1]) || lower(confidence[2:]) AS confidence FROM named e WHERE e.{1} = {3}"
    out = {
        "query_subgraph": f"{TRADE}, {SCORES}, {ADJ}, {INCIDENT}, {bfs(best, 2)} SELECT s.id, label, source_file, CAST(level AS BIGINT) AS level, degree FROM seen2 s JOIN nodes USING (id) JOIN incident USING (id)",
        "graph_stats": f"{TRADE}, {INCIDENT} SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(DISTINCT community) FROM nodes) AS communities, count(*) AS total_edges, {counts}, CAST((SELECT round(sum(degree) / count(*) * 100) / 100 FROM incident) AS DOUBLE) AS avg_degree FROM edges",
        "confidence_stats": f"{TRADE} SELECT {counts} FROM edges",
        "confidence_pct": f"{TRADE} SELECT extracted * 100 // n AS extracted_pct, inferred * 100 // n AS inferred_pct, ambiguous * 100 // n AS ambiguous_pct, n AS total FROM (SELECT {counts}, count(*) AS n FROM edges)",
        "god_nodes": f"{TRADE}, {ENDS}, {INCIDENT} {gods}",
        "god_neighbours": f"{TRADE}, {ENDS}, {INCIDENT}, {ADJ}, gods AS ({gods}), near AS (SELECT g.id, n.label, row_number() OVER (PARTITION BY g.id ORDER BY pos, b) AS i FROM gods g JOIN adj ON a = g.id JOIN nodes n ON n.id = b) SELECT id, string_agg(label, ', ' ORDER BY i) AS neighbours FROM near WHERE i <= 5 GROUP BY id",
        "most_connected": f"{TRADE}, {INCIDENT} SELECT id, label, degree FROM nodes JOIN incident USING (id) ORDER BY degree DESC, ord LIMIT 10",
        "community_sizes": f"{TRADE}, {SIZES} SELECT * FROM sizes",
        "surprises_cross_file": f"{TRADE}, {INCIDENT}, {surprise(chr(39).join(['SELECT * FROM all_pairs WHERE s_file <> ', '', ' AND t_file <> ', '', ' AND s_file <> t_file']))} ORDER BY score DESC, {DOUBT}, ord LIMIT 10",
        "surprises_cross_community": f"{TRADE}, {INCIDENT}, {surprise('SELECT * FROM all_pairs WHERE s_comm <> t_comm QUALIFY row_number() OVER (PARTITION BY least(s_comm, t_comm), greatest(s_comm, t_comm) ORDER BY ord) = 1')} ORDER BY {DOUBT}, ord LIMIT 10",
        "community_labels": f"""{TRADE}, {SIZES}, {_WORDS} SELECT community, coalesce(CASE WHEN d.n * 2 >= size THEN array_to_string(list_transform(string_split(string_split(d, '/')[-1], '_'), lambda x: upper(x[1]) || x[2:]), '') END, upper(x[1]) || x[2:], 'Community ' || community) AS label
            FROM sizes LEFT JOIN (SELECT * FROM dirs WHERE r = 1) d USING (community) LEFT JOIN (SELECT * FROM words WHERE r = 1) w USING (community)""",
        "isolated_nodes": f"{TRADE}, {INCIDENT} SELECT id, label, degree FROM nodes JOIN incident USING (id) WHERE NOT ({FILE_NODE}) AND degree <= 1",
        "ambiguous_edges": f"{TRADE} SELECT source, target, relation, source_label, target_label FROM ({LABELLED.format('edges')}) WHERE confidence = 'AMBIGUOUS'",
        "score_nodes": f"{TRADE}, {SCORES} SELECT id, score FROM scores",
        "score_filtered": f"{TRADE}, {SCORES} SELECT id, score FROM scores WHERE contains(lower(node_type), 'supp') AND community = 7 AND contains(lower(source_file), 'n7')",
        "neighbors": f"{TRADE}, near AS (SELECT * FROM edges WHERE source = 'nation:7' OR target = 'nation:7' ORDER BY ord LIMIT 20) SELECT CASE WHEN source = 'nation:7' THEN 'out' ELSE 'in' END AS direction, CASE WHEN source = 'nation:7' THEN target ELSE source END AS id, CASE WHEN source = 'nation:7' THEN target_label ELSE source_label END AS label, relation, upper(confidence[1]) || lower(confidence[2:]) AS confidence FROM ({LABELLED.format('near')})",
        "bfs_nodes": f"{TRADE}, {ADJ}, {bfs(chr(39).join(['SELECT ', 'nation:3', ' AS id']), 2)} SELECT id, CAST(level AS BIGINT) AS level FROM seen2",
        "bfs_edges": f"{TRADE}, {ADJ}, {bfs(chr(39).join(['SELECT ', 'supplier:5', ' AS id']), 2)}, hops AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2), fwd AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY ord) = 1) SELECT source, target, relation, confidence FROM hops JOIN fwd ON a = source AND b = target",
        "degree_endpoints": f"{SESSIONS}, {ENDS} SELECT * FROM ends",
        "degree_incident": f"{SESSIONS}, {INCIDENT} SELECT * FROM incident",
        "file_groups": f"{SESSIONS}, {FILE_GROUPS} {SHOWN} found_0",
        "dir_groups": f"{SESSIONS}, {DIR_GROUPS} {SHOWN} found_3",
        "config_groups": f"""WITH {trade_nodes("base", "node_type IN ('supplier', 'nation', 'region')")}, {trade_edges()}, nodes AS (SELECT * REPLACE ('cfg/' || (ord % 400) || '.' || CASE WHEN ord % 400 < 4 THEN 'yaml' WHEN ord % 400 < 10 THEN 'toml' ELSE 'TF' END AS source_file) FROM base), {CONFIG_GROUPS} {SHOWN} found_2""",
        "group_cohesion": f"{SESSIONS}, m AS (SELECT label AS g, id FROM nodes), {GROUP_SCORE} SELECT DISTINCT m.g, CAST(coalesce(score, 0.5) AS DOUBLE) AS score FROM m LEFT JOIN score USING (g)",
        "call_chains": f"{SESSIONS}, {CHAINS} SELECT array_to_string(nodes, '>') AS chain, CAST(len(nodes) AS BIGINT) AS n_nodes, source_file FROM chains JOIN nodes n ON n.id = nodes[1] WHERE len(nodes) >= 3",
        "hyperedges": f"""{SESSIONS}, {FILE_GROUPS}, {CONFIG_GROUPS}, {DIR_GROUPS}, {CHAINS},
            ranked AS (SELECT nodes, list_prepend(n.ord, list_transform(range(1, len(nodes)), lambda i: 0::BIGINT)) AS k, n.ord FROM chains JOIN nodes n ON n.id = nodes[1] WHERE len(nodes) >= 3),
            sets AS (SELECT list_sort(nodes) AS members, 'participate_in' AS relation, confidence_score, rank, ord, id, label FROM found_0 UNION ALL SELECT list_sort(nodes), 'flow', 1.0, 1, min(ord), NULL, NULL FROM ranked GROUP BY 1
              UNION ALL SELECT list_sort(nodes), relation, confidence_score, rank, ord, id, label FROM found_2 UNION ALL SELECT list_sort(nodes), relation, confidence_score, rank, ord, id, label FROM found_3),
            kept AS (SELECT * FROM sets QUALIFY row_number() OVER (PARTITION BY members ORDER BY rank, ord, id) = 1)
            SELECT array_to_string(members, ',') AS members, relation, CAST(confidence_score AS DOUBLE) AS confidence_score FROM kept WHERE confidence_score >= 0.3 AND len(members) BETWEEN 3 AND 20""",
        "community_cohesion": f"{SESSIONS}, {COHESION} SELECT * FROM cohesion",
        "thin_communities": f"{SESSIONS}, {SIZES} SELECT * FROM sizes WHERE size < 6",
        "connected_components": f"{SESSIONS}, {ADJ}, reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT r.id, b FROM reach r JOIN adj ON a = r.other) SELECT id, min(other) AS root FROM reach GROUP BY id",
        "community_info": f"{SESSIONS}, {INCIDENT}, {COHESION} SELECT id, label, degree, 'Community 7' AS community_label, size, cohesion FROM nodes JOIN incident USING (id) JOIN cohesion USING (community) WHERE community = 7",
        "shortest_path": f"""{SESSIONS}, {ADJ}, {START}, walks(path, keys) AS (SELECT [s], []::BIGINT[] FROM start UNION ALL SELECT list_append(path, b), list_append(keys, pos) FROM walks JOIN adj ON a = path[-1], start WHERE NOT list_contains(path, b) AND NOT list_contains(path, t) AND len(path) <= 8),
            won AS (SELECT path FROM walks, start WHERE path[-1] = t ORDER BY len(path), keys LIMIT 1) SELECT CAST(generate_subscripts(path, 1) - 1 AS BIGINT) AS pos, unnest(path) AS id FROM won""",
        "node_details": f"""{SESSIONS}, {HELD}, named AS MATERIALIZED ({LABELLED.format("edges")}), links AS ({details.format("out", "source", "target", FIRST)} UNION ALL {details.format("in", "target", "source", FIRST)})
            SELECT l.*, n.id AS node_id, n.label AS node_label, n.source_file, (SELECT arg_min(he, he_ord) FROM member m WHERE m.id = n.id) AS hyperedge FROM links l JOIN nodes n ON n.id = {FIRST}""",
        "hyperedge_info": f"{SESSIONS}, {HELD} SELECT id, label, array_to_string(list_sort(nodes), ',') AS members FROM found_0 WHERE contains(lower(label), 'u7 mod') ORDER BY ord LIMIT 1",
        "score_by_hyperedge": f"{SESSIONS}, {HELD} SELECT id, score FROM (SELECT id, CAST(CASE WHEN contains(label, 'click') THEN 1 ELSE 0 END + CASE WHEN contains(source_file, 'click') THEN 0.5 ELSE 0 END + CASE WHEN contains(label, 'log') THEN 1 ELSE 0 END + CASE WHEN contains(source_file, 'log') THEN 0.5 ELSE 0 END AS DOUBLE) AS score FROM nodes) WHERE score > 0 AND id IN (SELECT id FROM member WHERE contains(lower(he_label), 'u1'))",
        "dedup_nodes": f"WITH {trade_nodes()}, copies AS (SELECT id, label, ord FROM nodes UNION ALL SELECT id, lower(label), ord + {10**15} FROM nodes UNION ALL SELECT id, upper(label), ord - {10**15} FROM nodes WHERE ord % 3 = 0) SELECT * FROM copies QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1",
        "dedup_edges": f"WITH {STEPS} SELECT source, target, relation, min(ord) AS ord FROM steps GROUP BY ALL",
        "merge_extractions": f"{OLD_NEW} SELECT source, target, relation, confidence FROM (SELECT *, 0 AS g FROM edges_old UNION ALL SELECT *, 1 FROM edges_new) QUALIFY row_number() OVER (PARTITION BY source, target, relation ORDER BY g, ord) = 1",
        "merge_into_graph": f"{OLD_NEW} SELECT 'node' AS what, id AS a, label AS b FROM (SELECT * FROM nodes_old UNION ALL SELECT * FROM nodes_new WHERE id NOT IN (SELECT id FROM nodes_old)) UNION ALL SELECT 'edge', source || '>' || target, confidence FROM (SELECT * FROM edges_old UNION ALL SELECT n.* FROM edges_new n ANTI JOIN edges_old USING (source, target))",
        "diff_nodes": f"{OLD_NEW} SELECT * FROM {DIFF_NODES}",
        "diff_edges": f"{OLD_NEW} SELECT * FROM {DIFF_EDGES}",
        "diff_summary": f"""{OLD_NEW}, k AS (SELECT change || '_nodes' AS k FROM {DIFF_NODES} UNION ALL SELECT change || '_edges' FROM {DIFF_EDGES}),
            c AS (SELECT count(*) FILTER (k = 'new_nodes') AS new_nodes, count(*) FILTER (k = 'new_edges') AS new_edges, count(*) FILTER (k = 'removed_nodes') AS removed_nodes, count(*) FILTER (k = 'removed_edges') AS removed_edges FROM k)
            SELECT *, coalesce(nullif(concat_ws(', ', CASE WHEN new_nodes > 0 THEN new_nodes || ' new node' || CASE WHEN new_nodes = 1 THEN '' ELSE 's' END END, CASE WHEN new_edges > 0 THEN new_edges || ' new edge' || CASE WHEN new_edges = 1 THEN '' ELSE 's' END END,
              CASE WHEN removed_nodes > 0 THEN removed_nodes || ' node' || CASE WHEN removed_nodes = 1 THEN '' ELSE 's' END || ' removed' END, CASE WHEN removed_edges > 0 THEN removed_edges || ' edge' || CASE WHEN removed_edges = 1 THEN '' ELSE 's' END || ' removed' END), ''), 'no changes') AS summary FROM c""",
        "validate_graph": f"""{WEB}, nodes AS MATERIALIZED (SELECT id, CASE WHEN ord % 7 = 0 THEN '' ELSE label END AS label, ord FROM (SELECT * FROM page UNION ALL SELECT id, label, ord + 1000000 FROM page WHERE ord % 5 = 0))
            SELECT 'EmptyLabel' AS kind, ord, id FROM nodes WHERE label = '' UNION ALL SELECT 'DuplicateNodeId', ord, id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS i FROM nodes) WHERE i > 1
            UNION ALL SELECT 'UnknownNodeReference', ord, source FROM edges WHERE source NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'UnknownNodeReference', ord, target FROM edges WHERE target NOT IN (SELECT id FROM nodes)""",
        "import_ids": f"{WEB} SELECT target, count(*) AS n FROM edges GROUP BY target",
        "path_parts": f"WITH {trade_nodes()}, {FILES}, p AS (SELECT source_file AS f FROM nodes UNION SELECT path FROM files) SELECT f AS source_file, {NAME.format('f')} AS name, {STEM.format('f')} AS stem, {EXT.format('f')} AS ext, {DIR.format('f')} AS dir, {LAST.format('f')} AS last, {TOP.format('f')} AS top, {CATEGORY.format(*['f'] * 4)} AS category FROM p",
        "word_counts": f"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS prose, CAST(len(regexp_extract_all(text, '{W}')) AS BIGINT) AS code FROM documents",
        "content_hash": f"SELECT doc_id, {HASH.format('text', 'source')} AS hash FROM documents",
        "corpus_verdict": "SELECT *, CASE WHEN words < 50000 THEN 'fits one context' WHEN words > 500000 THEN 'very large' ELSE 'ok' END AS verdict, CASE WHEN words < 10 THEN 'tiny' WHEN words < 100 THEN 'small' WHEN words < 1000 THEN 'medium' ELSE 'large' END AS size FROM (SELECT source, CAST(sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS BIGINT) AS words FROM documents GROUP BY source)",
        "line_rules_extract": f"WITH {FILES}, {LINES}, k AS (SELECT unnest({_list(KEYWORDS)}) AS k) SELECT * FROM (SELECT path, line, rtrim(k) AS keyword, regexp_extract(substr(s, strpos(s, k) + length(k)), '^({W})', 1) AS name FROM lines, k WHERE contains(s, k)) WHERE name <> ''",
        "rationale_lines": f"WITH {FILES}, {LINES} SELECT path, line, {STEM.format('path')} || '_rationale_' || line AS id, t AS text, {STEM.format('path')} AS target FROM (SELECT *, trim(regexp_extract(trim(s), '^(?:#|//|/\\*) (?:{'|'.join(REASONS)}):(.*)$', 1)) AS t FROM lines) WHERE strlen(t) > 5",
        "brace_balance": f"WITH {FILES}, {LINES} SELECT path, line, CAST(sum(len(regexp_extract_all(s, '[({{]')) - len(regexp_extract_all(s, '[)}}]'))) OVER (PARTITION BY path ORDER BY line) AS BIGINT) AS balance FROM lines",
        "cache_changed": f"WITH {FILES}, {CHANGED} SELECT f.path, t.path IS NULL OR {HASH.format('f.content', 'f.path')} <> {HASH.format('t.content', 't.path')} AS changed FROM files f LEFT JOIN past t ON t.path = f.path",
        "classify_files": f"{CLASSIFIED} SELECT * FROM classified",
        "file_stats": f"{CLASSIFIED} SELECT count(*) AS total, count(*) FILTER (file_type = 'code') AS code, count(*) FILTER (file_type = 'markdown') AS markdown, count(*) FILTER (file_type = 'binary') AS binary FROM classified WHERE skipped IS NULL",
        "components_deep": f"{SHELVES}, links AS (SELECT DISTINCT p_brand, p_type FROM nodes), reach(b, o) AS (SELECT p_brand, p_brand FROM links UNION SELECT r.b, m.p_brand FROM reach r JOIN links l ON l.p_brand = r.o JOIN links m ON m.p_type = l.p_type) SELECT id, root FROM nodes JOIN (SELECT b, min(n.id) AS root FROM reach JOIN nodes n ON n.p_brand = o GROUP BY b) ON b = p_brand",
        "bfs_deep": f"{SHELVES}, {ADJ}, {bfs('SELECT id FROM (SELECT id FROM nodes ORDER BY ord LIMIT 1)', 3)} SELECT id, CAST(level AS BIGINT) AS level FROM seen3",
        "shortest_path_deep": f"{SHELVES}, {ADJ}, {SHELF_ENDS}, {WALKS}",
        "cohesion_deep": f"{SHELVES}, {COHESION} SELECT * FROM cohesion",
        "components_histories": "SELECT 'o' || o_orderkey AS id, min('o' || o_orderkey) OVER (PARTITION BY o_custkey) AS root FROM orders",
        "call_chains_deep": f"{HISTORY} SELECT a.id AS first, b.id AS last, b.n - a.n + 1 AS n_nodes, 'customers/c' || a.c || '.log' AS source_file FROM seq a JOIN seq b ON a.c = b.c AND b.n - a.n BETWEEN 2 AND 19",
        "hyperedge_ranking": f"""{SESSIONS}, {FILE_GROUPS}, {DIR_GROUPS}, sets AS (SELECT id, label, array_to_string(list_sort(nodes), ',') AS members, len(nodes) AS n, relation, CAST(confidence_score AS DOUBLE) AS confidence_score, rank, ord FROM (SELECT * FROM found_0 UNION ALL SELECT * FROM found_3)),
            kept AS (SELECT * FROM sets QUALIFY row_number() OVER (PARTITION BY members ORDER BY rank, ord, id) = 1) SELECT id, label, members, relation, confidence_score, row_number() OVER (ORDER BY confidence_score DESC, rank, ord, id) - 1 AS ord FROM kept WHERE confidence_score >= 0.3 AND n BETWEEN 3 AND 20""",
        "chain_cohesion": f"""{SESSIONS}, links AS (SELECT DISTINCT least(source, target) AS lo, greatest(source, target) AS hi FROM edges), walk AS (SELECT source_file AS c, id, lead(id) OVER (PARTITION BY source_file ORDER BY ord) AS nxt FROM nodes)
            SELECT c, CAST(CASE WHEN count(nxt) = 0 THEN 0.5 ELSE least(CAST(count(lo) AS DOUBLE) / count(nxt) + 0.1::DOUBLE, 1.0::DOUBLE) END AS DOUBLE) AS score FROM walk LEFT JOIN links ON lo = least(id, nxt) AND hi = greatest(id, nxt) AND nxt IS NOT NULL GROUP BY c""",
        "build_graph": f"""{SESSIONS} SELECT 'node' AS what, id AS a, CASE WHEN label <> 'click' THEN upper(label) ELSE label END AS b, row_number() OVER (ORDER BY id) - 1 AS ord FROM nodes
            UNION ALL SELECT 'edge', source || '>' || target, CASE WHEN ends_with(source, 'click') THEN 'INFERRED' ELSE confidence END, row_number() OVER (ORDER BY NOT ends_with(source, 'click'), ord) - 1 FROM edges""",
        "error_texts": f"""{WEB} SELECT 'UnknownNodeReference' AS kind, target AS id, 'Edge ''' || source || ' -> ' || target || ''' references unknown node: ' || target AS message FROM edges WHERE target NOT IN (SELECT id FROM page)
            UNION ALL SELECT 'InvalidConfidence', 'LIKELY', 'Invalid confidence value: LIKELY (not EXTRACTED, INFERRED or AMBIGUOUS)' FROM edges WHERE ord % 3 = 0""",
        "sensitive_reasons": f"{CLASSIFIED} SELECT path, CASE {' '.join(_REASONS)} END AS reason FROM classified WHERE skipped = 'sensitive'",
        "ignored_files": f"{CLASSIFIED} SELECT path, CASE WHEN skipped IN ('hidden', 'noise') THEN skipped WHEN regexp_matches(path, '/f[^/]*7[.]py$') OR starts_with(path, 'docs/') THEN 'ignored' ELSE skipped END AS skipped FROM classified",
        "cache_stats": f"WITH {FILES} SELECT count(*) AS total_entries, count(DISTINCT path) AS files_by_source FROM files WHERE length(path) % 3 <> 0",
        "cache_entries": f"WITH {FILES} SELECT path, {HASH.format('content', 'path')} AS hash, strlen(content) AS size, path AS source_file FROM files",
        "confidence_scores": f"{TRADE} SELECT confidence, CAST(CASE confidence WHEN 'EXTRACTED' THEN 1.0 WHEN 'INFERRED' THEN 0.75 ELSE 0.2 END AS DOUBLE) AS confidence_score, count(*) AS n FROM edges GROUP BY ALL",
        "extract_edges": f"WITH kinds AS (SELECT CAST(min(p_partkey) AS VARCHAR) AS k FROM part GROUP BY p_type), facts(x, what, a, b, c) AS (VALUES {', '.join(map(str, FACTS))}) SELECT what, {_filled('a')}, {_filled('b')}, c FROM kinds, facts",
        "questions_ambiguous": f"""{TRADE} SELECT CAST(row_number() OVER (ORDER BY ord) - 1 AS BIGINT) AS pos, 'ambiguous_edge' AS question_type, 'What is the exact relationship between `' || source_label || '` and `' || target_label || '`?' AS question, 'Edge tagged AMBIGUOUS (relation: ' || relation || ') - confidence is low.' AS why
            FROM ({LABELLED.format("edges")}) WHERE confidence = 'AMBIGUOUS' ORDER BY ord LIMIT 7""",
    }
    sections = {
        "god": ("id", "degree", out["god_nodes"]), "size": ("community", "size", out["community_sizes"]), "label": ("community", "label", out["community_labels"]),
        "cohesion": ("community", "percent", f"{TRADE}, {COHESION} SELECT community, CAST(round(cohesion * 100) AS BIGINT) AS percent FROM cohesion"), "confidence": ("k", "n", f"SELECT * FROM ({out['confidence_stats']}) UNPIVOT (n FOR k IN (extracted, inferred, ambiguous))"),
    }
    out["analysis"] = " UNION ALL ".join(f"SELECT '{name}' AS section, CAST({k} AS VARCHAR) AS key, CAST({v} AS VARCHAR) AS value FROM ({sql})" for name, (k, v, sql) in sections.items())
    return out
