"""DuckDB text of queries that SQL can say, over all pairs; for the small tables of the comparison only."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Links (a, b) both ways and nodes (id) -> smallest id reachable, by spreading the smallest one along the links.
REACH = """
reach AS (
  SELECT id, id AS least FROM nodes
  UNION
  SELECT l.b, r.least FROM reach r JOIN links l ON l.a = r.id WHERE r.least < l.b),
component AS (SELECT id, min(least) AS component_id FROM reach GROUP BY id)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words),
sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
sized AS (SELECT s, id, n FROM shingles JOIN sizes USING (id)),
both_ways AS (
  SELECT a.id AS a, b.id AS b FROM sized a JOIN sized b ON a.s = b.s AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM both_ways UNION ALL SELECT b, a FROM both_ways),
nodes AS (SELECT DISTINCT id FROM words),{REACH}
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = id AS kept
FROM words LEFT JOIN sizes USING (id) JOIN component USING (id)"""

NEAR_VECTORS = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.id AS a, b.id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.id <> b.id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
nodes AS (SELECT DISTINCT vec_id AS id FROM embeddings),{REACH},
counted AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, component_id = e.vec_id AS kept
FROM embeddings e JOIN component c ON c.id = e.vec_id LEFT JOIN counted k ON k.id = e.vec_id"""


def _hosts(column):
    return f"translate(regexp_extract(coalesce({column}, ''), '://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}')"


def url_rules(rules, default="allow"):
    """Rules: (host, path, verdict)."""
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {rows}),
urls AS (SELECT page_id, {_hosts('url')} AS host, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
looked AS (
  SELECT DISTINCT host, path, rule_host || rule_path AS rule, verdict FROM (SELECT DISTINCT host, path FROM urls) u JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
best AS (
  SELECT *, row_number() OVER (PARTITION BY host, path ORDER BY length(rule) DESC, verdict DESC) AS k FROM looked)
SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict FROM urls LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (host, path)"""


TERMS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

RANKED_SEARCH = f"""
WITH held AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERMS}') AS w FROM documents),
facts AS (SELECT CAST(count(*) AS bigint) AS nd, CAST(sum(len(w)) AS bigint) AS nt FROM held WHERE len(w) > 0),
docs AS (SELECT r, doc_id, 100 - 25 + (25 * len(w) * nd) // nt AS m FROM held, facts WHERE len(w) > 0),
often AS (SELECT r, t, CAST(count(*) AS bigint) AS tf FROM (SELECT r, unnest(w) AS t FROM held) GROUP BY r, t),
asked AS (
  SELECT item_id, t, CAST(count(*) AS bigint) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERMS}')) AS t FROM benchmark) GROUP BY item_id, t),
weights AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS double) / (2 * count(*) + 1))) AS bigint) AS w
  FROM often, facts WHERE t IN (SELECT t FROM asked) GROUP BY t, nd),
scored AS (
  SELECT item_id, r, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS bigint) AS score
  FROM asked JOIN weights USING (t) JOIN often USING (t) JOIN docs USING (r) GROUP BY item_id, r),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM scored JOIN docs USING (r) WHERE score > 0)
SELECT item_id, CAST(k AS int) AS rank, doc_id, score FROM ranked WHERE k <= 20"""


def centroid_clusters(k=40, rounds=5, size=64, scale=256):
    distance = "list_sum(list_transform(range(1, {n} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))".format(n=size)
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (
  SELECT r, arg_min({{'num': num, 'd': d}}, d * {k} + num) AS best FROM (
    SELECT r, num, CAST({distance} AS bigint) AS d FROM kept CROSS JOIN c{i}) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (
  SELECT num, j, CAST(floor(sum(x) / CAST(count(*) AS double)) AS bigint) AS x FROM (
    SELECT best.num AS num, unnest(range(1, {size} + 1)) AS j, unnest(v) AS x FROM a{i} JOIN kept USING (r)) GROUP BY num, j),
n{i} AS (SELECT num, list(x ORDER BY j) AS c FROM m{i} GROUP BY num),
c{i + 1} AS MATERIALIZED (SELECT c{i}.num, coalesce(n{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN n{i} USING (num))""")
    return f"""
WITH good AS (
  SELECT vec_id, CAST(embedding AS double[]) AS e FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(e, lambda x: CAST(floor({scale} * x) AS bigint)) AS v FROM good),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS num, v AS c FROM (
    SELECT v, sha256('2:' || CAST(vec_id AS varchar)) AS h FROM kept ORDER BY h LIMIT {k})),{','.join(steps)},
given AS (SELECT r, best.num AS num, best.d AS d FROM a{rounds}),
parts AS (SELECT num, sum(d) AS cluster_inertia FROM given GROUP BY num)
SELECT vec_id, CAST(num AS int) AS cluster, d AS distance, CAST(cluster_inertia AS bigint) AS cluster_inertia,
  CAST((SELECT sum(d) FROM given) AS bigint) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM given JOIN kept USING (r) JOIN parts USING (num) JOIN c{rounds} USING (num)"""
