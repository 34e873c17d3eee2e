"""DuckDB SQL for the queries that SQL can say."""

from __future__ import annotations

from collections.abc import Sequence

WORD = "[^\\x20\\x09-\\x0D]+"

QUALITY_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM rep, range(3) r(k) GROUP BY rid),
f AS (
  SELECT w.rid, doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > word_chars OR 100 * n_repeat_words > 20 * n_words OR 20 * n_dup_lines > n_words AS soft_failed FROM f),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR soft_failed) AS failed FROM j GROUP BY source),
p AS (SELECT sum(failed) / sum(n) AS m, sum(n * (failed / n) * (failed / n)) / sum(n) AS sq, count(*) AS k, sum(n) AS total FROM h),
q AS (SELECT m, sq - m * m - m * (1 - m) * (k - 1) / total AS spread FROM p),
r AS (SELECT source, rate, rate - 1.645::DOUBLE * sqrt(rate * (1 - rate) / (n + wt + 1)) > m AS above FROM (SELECT source, n, m, wt, (failed + m * wt) / (n + wt) AS rate FROM h, (SELECT m, CASE WHEN spread > 0 THEN greatest(1.0, least(1000.0, m * (1 - m) / spread - 1)) ELSE 1000.0 END AS wt FROM q)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.6 AND NOT (above AND soft_failed) AS kept
FROM j JOIN r ON j.source IS NOT DISTINCT FROM r.source"""


def chat_format(probe: str) -> str:
    escape = lambda x: f"replace(replace({x}, '\\', '\\\\'), '<|', '<\\|')"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{probe}' UNION ALL SELECT -1, 1, 'assistant', '{probe}'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, count(*) OVER (PARTITION BY conv_id) AS turns,
  length('<|im_start|>') + length(replace({escape("role")}, chr(10), '\\n')) + 1 + length({escape("text")}) + length('<|im_end|>') + 1 AS size FROM c),
e AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(upto) FILTER (WHERE role = 'assistant' OR n = turns), 0)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


def mixing(weights: Sequence[int] = (1, 2, 3), most: int = 3) -> str:
    """All numbers that enter a comparison come of the same operations in the same order as in ``mixing``."""
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
v AS (SELECT *, CAST(floor(1000 * size / (size + 256)) AS BIGINT) AS pref FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * pref)::BIGINT AS tilt FROM v GROUP BY source),
k AS (SELECT *, {list(weights)}[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} AS INT) + 1] AS weight, source_size * {most} AS cap FROM s),
b AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS rest_words, sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest_weight
  FROM k WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT *, cap * rest_weight <= weight * rest_words AS "full" FROM b),
t AS (SELECT source, source_size, tilt, CASE WHEN "full" THEN cap::DOUBLE ELSE (weight * (sum(source_size) OVER () - coalesce(sum(CASE WHEN "full" THEN cap END) OVER (), 0)))::DOUBLE / (coalesce(sum(CASE WHEN NOT "full" THEN weight END) OVER (), 0))::DOUBLE END AS target FROM u),
e AS (SELECT v.*, source_size, target, CASE WHEN source_size > 0 THEN greatest(0.0::DOUBLE, least({most}.0::DOUBLE, target / source_size + 0.5::DOUBLE * least(target / source_size, {most}.0::DOUBLE - target / source_size) * ((pref - tilt / source_size) / 1000.0::DOUBLE))) ELSE 0.0::DOUBLE END AS ex,
    (('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix'), 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM v JOIN t ON v.source IS NOT DISTINCT FROM t.source),
z AS (SELECT *, CAST(floor(ex) AS BIGINT) AS sure, ex - floor(ex) AS p FROM e),
q AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN ((u / (1 - u)) * ((1 - p) / p)) / (1 + (u / (1 - u)) * ((1 - p) / p)) END AS z FROM z),
c AS (SELECT *, target - sum(sure * size) OVER (PARTITION BY source) AS room, sum(CASE WHEN z IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY z NULLS LAST, doc_id NULLS FIRST, size) AS upto FROM q),
i AS (SELECT *, z IS NOT NULL AND upto <= room AS inside FROM c),
g AS (SELECT source, any_value(room) - coalesce(sum(size) FILTER (WHERE inside), 0) AS gap FROM i GROUP BY source),
l AS (SELECT i.source, arg_min({{'doc_id': i.doc_id, 'size': i.size}}, [abs(size - gap), i.z, coalesce(i.doc_id, -1)::DOUBLE, size::DOUBLE]) AS last FROM i JOIN g ON i.source IS NOT DISTINCT FROM g.source WHERE z IS NOT NULL AND NOT inside AND abs(size - gap) < gap GROUP BY i.source)
SELECT i.doc_id, i.size, source_size, target, (sure + CASE WHEN inside OR (z IS NOT NULL AND coalesce(i.doc_id, -1) = coalesce(l.last.doc_id, -1) AND l.last IS NOT NULL AND i.size = l.last.size) THEN 1 ELSE 0 END) * i.size AS taken
FROM i LEFT JOIN l ON i.source IS NOT DISTINCT FROM l.source"""


def url_filters(rules: Sequence[tuple[str, str]], many: int = 20, varied: float = 0.3, alike: float = 2.0, smoothing: float = 5.0, of_parent: float = 1.0, reject_at: float = 0.6) -> str:
    def fits(rule: str) -> str:
        host, slash, path = rule.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}')"

    def share(name: str, keys: str, behind: str) -> str:
        return f"(sum(b) OVER (PARTITION BY {keys}) + {smoothing} * {behind}) / (sum(l) OVER (PARTITION BY {keys}) + {smoothing}) AS {name}"

    longest_first = sorted(rules, key=lambda r: -len(r[1]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in longest_first)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{v}'" for v, r in longest_first)
    return f"""
WITH RECURSIVE u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
t AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS rv,
  list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(regexp_replace(x, '[0-9a-fA-F]{{8,}}', '{{h}}', 'g'), '[0-9]+', '{{n}}', 'g')) AS shape FROM u),
shapes AS (SELECT host, shape, count(DISTINCT path) AS paths, count(rv) AS labelled, count(*) FILTER (WHERE rv = 'block') AS blocked FROM t GROUP BY host, shape),
walk AS (
  SELECT host, shape, paths, labelled, blocked, 0 AS d, '' AS template, true AS goes FROM shapes
  UNION ALL
  SELECT host, shape, paths, labelled, blocked, d + 1, CASE WHEN len(shape) <= d THEN template
      WHEN below < {many} THEN template || '/' || array_to_string(shape[d + 1:], '/')
      WHEN (k >= {many} AND k * k >= {varied}::DOUBLE * total) OR (fp >= {many} AND contains(shape[d + 1], '{{') AND CASE WHEN cl > 0 THEN abs(cb / cl - fb / fl) <= {alike} * sqrt(fb / fl * (1 - fb / fl) / cl) ELSE fl = 0 END) THEN template || '/*'
      ELSE template || '/' || shape[d + 1] END, len(shape) > d AND below >= {many}
  FROM (SELECT *, count(DISTINCT CASE WHEN len(shape) > d THEN shape[d + 1] END) OVER x AS k, count(*) FILTER (WHERE len(shape) > d) OVER x AS total,
      coalesce(sum(paths) FILTER (WHERE len(shape) > d) OVER x, 0) AS below, coalesce(sum(paths) FILTER (WHERE contains(shape[d + 1], '{{')) OVER x, 0) AS fp,
      coalesce(sum(labelled) FILTER (WHERE contains(shape[d + 1], '{{')) OVER x, 0)::DOUBLE AS fl, coalesce(sum(blocked) FILTER (WHERE contains(shape[d + 1], '{{')) OVER x, 0)::DOUBLE AS fb,
      sum(labelled) OVER (PARTITION BY host, template, shape[d + 1])::DOUBLE AS cl, sum(blocked) OVER (PARTITION BY host, template, shape[d + 1])::DOUBLE AS cb
    FROM walk WHERE goes WINDOW x AS (PARTITION BY host, template))),
tree AS (SELECT * FROM walk WHERE NOT goes),
a AS (SELECT host, template, sum(labelled)::DOUBLE AS l, sum(blocked)::DOUBLE AS b, regexp_replace(template, '[^/]*\\{{[^/]*', '*', 'g') AS common, array_to_string(string_split(host, '.')[-2:], '.') AS domain, regexp_replace(template, '/[^/]*$', '') AS parent,
  regexp_replace(template, '/[^/{{}}*]+((?:/[^/]*[{{}}*][^/]*)*)$', '/*\\1') AS branch FROM tree GROUP BY host, template),
c AS (SELECT *, coalesce((SELECT sum(b) / sum(l) FROM a HAVING sum(l) > 0), 0.0::DOUBLE) AS corpus FROM a),
e1 AS (SELECT *, {share("everywhere", "common", "corpus")}, {share("of_host", "host", "corpus")} FROM c),
e2 AS (SELECT *, {share("nearby", "domain, common", "everywhere")}, {share("par", "host, parent", "of_host")} FROM e1),
f AS (SELECT *, ({smoothing} * nearby + {of_parent} * par) / ({smoothing} + {of_parent}) AS prior, sum(l) OVER x AS fl, sum(b) OVER x AS fb, count(*) FILTER (WHERE l > 0) OVER x AS fn FROM e2 WINDOW x AS (PARTITION BY host, branch)),
g AS (SELECT *, (fb + {smoothing} * corpus) / (fl + {smoothing}) AS share FROM f),
m AS (SELECT *, CASE WHEN fn > 1 AND l > 0 AND abs(b / l - share) <= {alike} * sqrt(share * (1 - share) / greatest(1, l)) THEN branch ELSE template END AS merged FROM g),
v AS (SELECT host, template, CASE WHEN round((sum(b) OVER y + {smoothing + of_parent} * (sum(greatest(l, 1) * prior) OVER y / sum(greatest(l, 1)) OVER y)) / (sum(l) OVER y + {smoothing + of_parent}), 9) >= {reject_at} THEN 'block' ELSE 'allow' END AS verdict FROM m WINDOW y AS (PARTITION BY host, merged))
SELECT page_id, t.host, path, rule, coalesce(rv, v.verdict) AS verdict FROM t JOIN tree USING (host, shape) JOIN v ON v.host = t.host AND v.template = tree.template"""


def part_codes(rounds: int = 6, entries: int = 16, parts: int = 8) -> str:
    """SQL of ``op13_part_codes``: every part against every entry in every round."""
    steps = [f"""
kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, (i - 1) // (len(v) // {parts}) AS part, (i - 1) % (len(v) // {parts}) AS place, v[i] AS x FROM (SELECT r, v, unnest(range(1, len(v) + 1)) AS i FROM kept)),
c0 AS MATERIALIZED (SELECT part, place, e, x AS c FROM x JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept QUALIFY e < {entries}) USING (r))"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT r, part, min(d * 256 + e) % 256 AS e, min(d * 256 + e) // 256 AS d FROM (SELECT r, part, e, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN c{i} USING (part, place) GROUP BY ALL) GROUP BY ALL)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (SELECT c.part, c.place, c.e, coalesce((s - ((s % n) + n) % n) // n, c.c) AS c FROM c{i} c LEFT JOIN (SELECT part, place, e, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{i} USING (r, part) GROUP BY ALL) USING (part, place, e))""")
    return "WITH" + ",".join(steps) + f""",
book AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, e, place)) AS codebooks_sha256 FROM c{rounds}),
code AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN code USING (r), book"""
