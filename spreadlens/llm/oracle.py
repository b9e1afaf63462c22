"""DuckDB SQL for the queries that SQL can express, written from their definitions."""

from spreadlens.llm import license_scan

W = r"[^\x20\x09-\x0D]+"

# Cutoffs in thousandths: (rule, top, bottom, list).
_RULES = """
    ('symbols', [10, 20, 30, 50, 75, 100, 150, 200, 300, 400]),
    ('dup_lines', [2, 5, 10, 15, 20, 30, 50, 75, 100, 150]),
    ('repeats', [50, 75, 100, 150, 200, 250, 300, 350, 400, 450]),
    ('long_words', [7000, 8000, 9000, 10000, 12000, 15000, 20000, 30000, 50000, 100000]),
    ('few_words', [-200000, -150000, -125000, -100000, -90000, -80000, -75000, -70000, -60000, -55000])
"""


def _measures(source: str = "documents") -> str:
    """Base measures of each row of `source`, numbered as `r`."""
    return f"""
d AS (SELECT row_number() OVER () AS r, * FROM {source}),
tok AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(coalesce(text, ''), '{W}') AS ws FROM d)),
tri AS (SELECT r, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM tok WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS n FROM tri WHERE w3 IS NOT NULL) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS t(k) GROUP BY r),
lin AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM d) WHERE regexp_matches(l, '{W}') GROUP BY r),
cnt AS (SELECT r, count(*) AS n, sum(length(w)) AS c, max(i) FROM tok GROUP BY r),
m AS (
  SELECT d.r, d.doc_id, coalesce(d.lang, '') AS stratum, coalesce(cnt.n, 0)::BIGINT AS n_words, coalesce(cnt.c, 0)::BIGINT AS word_chars,
    length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lin.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cnt USING (r) LEFT JOIN lin USING (r) LEFT JOIN cov USING (r)
),
mb AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)"""


def _verdicts(source: str = "documents") -> str:
    """CTEs up to `verdict` (r, doc_id, measures, base_failed, kept)."""
    return f"""
WITH {_measures(source)},
grid AS (SELECT rule, unnest(cuts) AS cutoff FROM (VALUES {_RULES}) AS t(rule, cuts)),
hits AS (
  SELECT mb.r, rule, cutoff, CASE rule
    WHEN 'symbols' THEN 1000 * n_symbols > cutoff * word_chars
    WHEN 'dup_lines' THEN 1000 * n_dup_lines > cutoff * n_words
    WHEN 'repeats' THEN 1000 * n_repeat_words > cutoff * n_words
    WHEN 'long_words' THEN 1000 * word_chars > cutoff * n_words
    ELSE -1000 * n_words > cutoff END AS hit
  FROM mb, grid
),
lab AS (SELECT doc_id, min(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
known AS (SELECT mb.r, mb.stratum, lab.q > 0 AS good FROM mb JOIN lab USING (doc_id) WHERE NOT base_failed),
tests AS (SELECT greatest(count(DISTINCT stratum), 1) * 50 AS n FROM known),
counted AS (
  SELECT stratum, rule, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND hit) AS k, count(*) FILTER (NOT good AND hit) AS b
  FROM known JOIN hits USING (r) GROUP BY ALL
),
sure AS (
  SELECT * FROM counted WHERE b - 20 * k > 0 AND
    (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99))) FROM range(k + 1) AS t(i)) <= 0.05 / (SELECT n FROM tests)
),
best AS (SELECT stratum, rule, max(cutoff) AS cutoff FROM (SELECT *, rank() OVER (PARTITION BY stratum, rule ORDER BY b - 20 * k DESC) AS p FROM sure) WHERE p = 1 GROUP BY ALL),
bad AS (SELECT DISTINCT h.r FROM hits h JOIN mb USING (r) JOIN best USING (stratum, rule, cutoff) WHERE hit),
verdict AS (SELECT mb.*, NOT base_failed AND mb.r NOT IN (SELECT r FROM bad) AS kept FROM mb)"""


def _mix(source: str = "documents") -> str:
    """CTEs up to `mix` (r, doc_id, size, source_size, target, copies)."""
    return f"""
d AS (SELECT row_number() OVER () AS r, * FROM {source}),
z AS (SELECT r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{W}'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS spot FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 3 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS p FROM w),
l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_rest
  FROM o WINDOW before AS (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(rest, p) AS rest, arg_min(w_rest, p) AS w_rest FROM l WHERE cap * w_rest >= rest * w),
t AS (SELECT l.source, source_size, CASE WHEN cap * l.w_rest < l.rest * w THEN cap::DOUBLE ELSE f.rest::DOUBLE * w::DOUBLE / f.w_rest::DOUBLE END AS target FROM l, f),
q AS (SELECT z.*, source_size, target, sum(size) OVER (PARTITION BY z.source ORDER BY substr(spot, 1, 3), spot, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source),
c AS (SELECT r, size, e, (e * source_size + upto)::DOUBLE / target AS finish, source, spot, doc_id FROM q, (VALUES (0), (1), (2)) AS x(e) WHERE size > 0),
k AS (SELECT r, sum(size) OVER (ORDER BY finish, source NULLS LAST, spot, doc_id, e ROWS UNBOUNDED PRECEDING) <= (SELECT sum(size) FROM z) AS ok FROM c),
mix AS (SELECT q.*, coalesce(n, 0) AS copies FROM q LEFT JOIN (SELECT r, count(*) AS n FROM k WHERE ok GROUP BY r) USING (r))"""


def _near(width: int, source: str = "documents") -> str:
    """CTEs up to `near` (doc_id, n_shingles, component_id), for unique doc_ids; recursive."""
    parts = " || chr(32) || ".join(f"ws[i + {k}]" for k in range(width))
    return f"""
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{W}') AS ws FROM {source}),
sh AS (
  SELECT DISTINCT doc_id, {parts} AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {width - 2})) AS i FROM words WHERE len(ws) >= {width})
  UNION ALL SELECT doc_id, '<' || array_to_string(ws, ' ') FROM words WHERE len(ws) BETWEEN 1 AND {width - 1}
),
sized AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY ALL),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM pairs JOIN sized p ON p.doc_id = a JOIN sized q ON q.doc_id = b WHERE 100 * both_ >= 80 * (p.n + q.n - both_)),
ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach(a, b) AS (SELECT doc_id, doc_id FROM {source} UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b),
near AS (SELECT d.doc_id, coalesce(any_value(sized.n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
  FROM {source} d JOIN reach ON reach.a = d.doc_id LEFT JOIN sized ON sized.doc_id = d.doc_id GROUP BY d.doc_id)"""


def _licenses() -> str:
    """Every template against every offset of every document, by an equality join of words."""
    rows = []
    for n, t in enumerate(license_scan.PHRASES + license_scan.NOTICES):
        own, must = license_scan.template_words(t.text), license_scan.mandatory_places(t)
        base = n < len(license_scan.PHRASES)
        rows += [f"({n}, '{t.label}', {base}, {len(own)}, {len(must)}, {k}, '{w}', {k in must})" for k, w in enumerate(own)]
    return f"""
WITH t AS (FROM (VALUES {", ".join(rows)}) AS t(n, label, base, size, keys, k, w, must)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
tok AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
hit AS (
  SELECT r, label, base, greatest(i - k, 0) AS start, count(*)::DOUBLE / size AS share FROM tok JOIN t USING (w)
  GROUP BY r, n, label, base, size, keys, i - k HAVING count(*) FILTER (must) = keys AND 1000 * count(*) >= {license_scan.LEAST} * size
),
s AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM hit GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN s USING (r)"""


# Every repair of a conversation, row by row: the cheapest audit, then the least in ASCII, that leads to each state of the role pattern.
_REPAIR = r"""
WITH RECURSIVE
g AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c FROM conversations),
x AS (SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda s: ord(s)::BIGINT) AS b FROM g),
k AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, n: list_reduce(list_prepend(xor(a, n), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, o: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 20 AS kind FROM x),
d AS (SELECT c, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text)) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM d),
f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  coalesce(lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal FROM o),
e AS (FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) AS t(p, initial, q)),
edit AS (
  SELECT p, p AS q, 'D' AS act, '' AS initial, 3 AS price, NULL::VARCHAR AS told FROM range(4) AS t(p)
  UNION ALL SELECT p, q, 'K', initial, 0, NULL::VARCHAR FROM e
  UNION ALL SELECT p, q, 'R', '', 2, CASE initial WHEN 'u' THEN 'user' ELSE 'assistant' END FROM e WHERE initial <> 's'
),
ins AS (
  SELECT p, p AS q, '' AS acts, []::VARCHAR[] AS said FROM range(4) AS t(p)
  UNION ALL FROM (VALUES (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']),
    (2, 3, 'I', ['assistant:']), (2, 2, 'II', ['assistant:', 'user:']), (3, 2, 'I', ['user:']), (3, 3, 'II', ['user:', 'assistant:'])) AS t(p, q, acts, said)
),
best AS (
  SELECT DISTINCT c, 0::BIGINT AS i, 0::BIGINT AS state, {'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]} AS way FROM g
  UNION ALL
  SELECT f.c, f.i, edit.q, min({
    'cost': way.cost + 2 * length(acts) + price + CASE WHEN act <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END, 'audit': way.audit || acts || act,
    'said': list_concat(way.said, ins.said, CASE WHEN act = 'D' THEN []::VARCHAR[] ELSE [coalesce(told, role) || ':' || text] END)})
  FROM best JOIN f ON f.c = best.c AND f.i = best.i + 1 JOIN ins ON ins.p = best.state JOIN edit ON edit.p = ins.q
  WHERE act = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (act = 'R' OR edit.initial = substr(role, 1, 1)))
  GROUP BY f.c, f.i, edit.q
),
last AS (SELECT c, max(i) AS i FROM best GROUP BY c),
done AS (SELECT best.c, min({'cost': way.cost + 2 * length(acts), 'audit': way.audit || acts, 'said': list_concat(way.said, ins.said)}) AS way
  FROM best JOIN last USING (c, i) JOIN ins ON ins.p = best.state WHERE ins.q IN (0, 3) GROUP BY best.c),
n AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, way.cost::BIGINT AS cost, way.audit AS audit, sha256(array_to_string(way.said, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM g) JOIN done USING (c) LEFT JOIN n USING (c)
"""


_PHRASES = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, range(1, 6) AS t(k) WHERE len(ws) >= k)),
f AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM g GROUP BY lang, phrase),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 100),
cut AS (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS x, array_to_string(ws[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cut.lang, cut.phrase, a, n, min({'score': (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f), 'j': j, 'l': x.f, 'r': y.f}) AS best
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.x JOIN f y ON y.lang = cut.lang AND y.phrase = cut.y JOIN n ON n.lang = cut.lang GROUP BY ALL),
o AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN c q ON q.lang = c.lang AND q.k > c.k AND 100 * q.a >= 100 * c.a AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' ')),
z AS (SELECT s.* FROM s ANTI JOIN o USING (lang, phrase))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY best.score DESC, a DESC, phrase) AS rank, phrase, a, best.l AS l, best.r AS r, n::BIGINT AS n, best.score::BIGINT AS score
FROM z QUALIFY rank <= 2000
"""


ORACLE = {
    "op12_phrase_mining": _PHRASES,
    "op13_turn_repair": _REPAIR,
    "op11_license_scan": _licenses(),
    "op2_minhash_forest": f"WITH RECURSIVE {_near(2)} SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM near",
    "op1_quality_rules": f"{_verdicts()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdict",
    "op8_url_filter": """
WITH u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules AS (FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS t(h, q, verdict)),
fit AS (SELECT r, h || q AS rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(h || q) DESC, length(h) DESC) AS n
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM fit WHERE n = 1) USING (r)
""",
    "op9_mixing": f"WITH {_mix()} SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM mix",
}
