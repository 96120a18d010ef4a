"""SQL for the text queries that SQL can express, over whole tables and whole texts."""

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), l AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r AS (
  SELECT a AS doc_id, b AS other FROM l
  UNION
  SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles,
  least(s.doc_id, coalesce(min(r.other), s.doc_id)) AS component_id
FROM s LEFT JOIN r ON r.doc_id = s.doc_id
GROUP BY s.doc_id, len(s.s)
"""

# Windows start where a shared shingle puts the item; a shingle's number of occurrences is its weight.
OP1 = f"""
WITH d AS (
  SELECT doc_id, {_WORDS.format("lower(coalesce(text, ''))")} AS w FROM documents
), i AS (
  SELECT item_id, {_WORDS.format("lower(coalesce(text, ''))")} AS w FROM benchmark
), ds AS (
  SELECT doc_id, len(w) AS n, unnest(range(0, len(w) - 4)) AS pos,
    unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS g
  FROM d WHERE len(w) >= 5
), s AS (
  SELECT item_id, len(w) AS l, unnest(range(0, len(w) - 4)) AS pos,
    unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS g
  FROM i WHERE len(w) >= 5
), win AS (
  SELECT DISTINCT ds.doc_id, s.item_id, greatest(ds.pos - s.pos, 0) AS start,
    least(ds.pos - s.pos + s.l, ds.n) AS stop, s.l
  FROM ds JOIN s ON ds.g = s.g
), wg AS (
  SELECT win.doc_id, item_id, start, stop, l, g, count(*) AS c
  FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.pos BETWEEN start AND stop - 5
  GROUP BY ALL
), ig AS (
  SELECT item_id, g, count(*) AS c FROM s GROUP BY ALL
), shared AS (
  SELECT doc_id, wg.item_id, start, stop, l, sum(least(wg.c, ig.c)) AS b
  FROM wg JOIN ig ON wg.item_id = ig.item_id AND wg.g = ig.g GROUP BY ALL
), r AS (
  SELECT *, b / (stop - start - 4 + l - 4 - b) AS sim FROM shared
  WHERE 100 * b >= 80 * (stop - start - 4 + l - 4 - b)
)
SELECT doc_id, item_id, start::INT AS start, l::INT AS n_words, round(sim, 9) AS similarity
FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, start) = 1
"""

# Only texts that would be read back differently are escaped; each control string in them grows by one.
OP7 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), f AS (
  SELECT *, len(regexp_extract_all(text, '<\|\\*(im_start|im_end|nl)\|>')) AS more
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + length(text) + 11 + more)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

def _spread(name: str, edges: str, seeds: str, rounds: int = 200, damping: float = 0.85) -> str:
    """Personalised PageRank, round by round until it stands to the last digits."""
    return f"""{name}_out AS (SELECT a, sum(weight) AS total FROM {edges} GROUP BY a),
{name}_share AS (SELECT e.a, e.b, e.weight / o.total AS share FROM {edges} e JOIN {name}_out o ON e.a = o.a),
{name}_0 AS (SELECT host, mass / (SELECT sum(mass) FROM {seeds}) AS mass FROM {seeds}),
{name}_rank AS (
  SELECT 0 AS k, host, mass FROM {name}_0
  UNION ALL
  SELECT k + 1, host, sum(mass) FROM (
    SELECT r.k, s.b AS host, {damping} * r.mass * s.share AS mass FROM {name}_rank r JOIN {name}_share s ON s.a = r.host
    UNION ALL SELECT r.k, z.host, {round(1 - damping, 9)} * z.mass FROM (SELECT DISTINCT k FROM {name}_rank) r CROSS JOIN {name}_0 z) moved
  WHERE k < {rounds} GROUP BY k, host),
{name}_last AS (SELECT host, mass FROM {name}_rank WHERE k = {rounds}),
"""


_HOST = "translate(coalesce(regexp_extract({}, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
# (rule, verdict), the longest first; fixed values.
_RULES = (
    ("example.org", "/en/1", "block"),
    ("example.org", "/es/", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
    ("org", "/", "allow"),
)
_RULE = "CASE " + " ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{h}{p}'" for h, p, _ in _RULES) + " END"
_RULED = "CASE " + " ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{v}'" for h, p, v in _RULES) + " END"
_LINK = r"""(?i)(?:href|src)\s*=\s*["'']?((?:https?:)?//[^\s"''<>]+)"""

OP3 = f"""
WITH RECURSIVE u AS (
  SELECT page_id, html, {_HOST.format("url")} AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), j AS (
  SELECT page_id, html, host, path, {_RULE} AS rule, {_RULED} AS ruled FROM u
), l AS (
  SELECT host AS a, unnest(regexp_extract_all(html, '{_LINK}', 1)) AS t FROM j
), m AS (
  SELECT a, {_HOST.format("CASE WHEN starts_with(t, '//') THEN 'http:' || t ELSE t END")} AS b FROM l
), links AS (
  SELECT a, b, count(*)::DOUBLE AS weight FROM m WHERE a <> '' AND b <> '' AND a <> b GROUP BY a, b
), hosts AS (
  SELECT host FROM j WHERE host <> '' UNION SELECT b FROM links
), chains AS (
  SELECT list_append(list_transform(range(2, len(string_split(host, '.'))),
    lambda i: array_to_string(string_split(host, '.')[-i:], '.')), host) AS c FROM hosts
), steps AS (
  SELECT DISTINCT unnest(c[:len(c) - 1]) AS x, unnest(c[2:]) AS y FROM chains
), edges AS (
  SELECT a, b, sum(weight) AS weight FROM (
    SELECT * FROM links UNION ALL SELECT x, y, 1.0 FROM steps UNION ALL SELECT y, x, 1.0 FROM steps) GROUP BY a, b
), back AS (
  SELECT b AS a, a AS b, weight FROM edges
), good AS (
  SELECT host, count(*)::DOUBLE AS mass FROM j WHERE ruled = 'allow' AND host <> '' GROUP BY host
), bad AS (
  SELECT host, count(*)::DOUBLE AS mass FROM j WHERE ruled = 'block' AND host <> '' GROUP BY host
),
{_spread("trust", "edges", "good")}{_spread("distrust", "back", "bad")}masses AS (
  SELECT coalesce(t.host, d.host) AS host, coalesce(t.mass, 0) AS t, coalesce(d.mass, 0) AS d
  FROM trust_last t FULL JOIN distrust_last d ON t.host = d.host
)
SELECT page_id, j.host, path, rule,
  coalesce(ruled, CASE WHEN coalesce(d, 0) > 0.5 * (coalesce(t, 0) + coalesce(d, 0)) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN masses ON j.host = masses.host
"""

_SPACE = r"\x20\x09-\x0D"


def _edit(state: str, cost: str, initial: str) -> str:
    """A state is its cost in nine digits and its audit, so the least string is the cheapest and then the ASCII-least."""
    return f"lpad((substr({state}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{initial}'"


_U = ("s0", "s1", "s3")
_ARRIVED = f"""
    {_edit("s0", "2", "D")} AS a0,
    least({_edit("s1", "2", "D")}, CASE WHEN NOT gone AND initial = 's' THEN {_edit("s0", "pen", "K")} END) AS a1,
    least({_edit("s2", "2", "D")},
      CASE WHEN NOT gone AND initial = 'u' THEN least({", ".join(_edit(s, "pen", "K") for s in _U)}) END,
      CASE WHEN NOT gone THEN least({", ".join(_edit(s, "pen + 1", "R") for s in _U)}) END) AS a2,
    least({_edit("s3", "2", "D")},
      CASE WHEN NOT gone AND initial = 'a' THEN {_edit("s2", "pen", "K")} END,
      CASE WHEN NOT gone THEN {_edit("s2", "pen + 1", "R")} END) AS a3"""
_INSERTED = f"least(a2, {_edit('a0', '5', 'I')}, {_edit('a1', '5', 'I')}, {_edit('a3', '5', 'I')})"

# crc32 bit by bit; the repair row by row over four states; roles of the repaired turns alternate behind a kept system turn.
OP11 = f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), c AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(k) + 1),
      lambda i: [ascii(substr(k, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) % 20 AS fault
  FROM k
), d AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM c
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen,
    regexp_matches(text, '[^{_SPACE}]') AS body,
    regexp_extract(text, '([^{_SPACE}])[{_SPACE}]*$', 1) AS final
  FROM p
), f AS (
  SELECT *, NOT body AS blank, body AND seen > 1 AS duplicate, NOT body OR seen > 1 AS gone,
    body AND seen = 1 AND final NOT IN ('.', '!', '?') AS truncated, left(role, 1) AS initial,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS earlier,
    CASE WHEN body AND seen = 1 AND final NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS pen
  FROM n
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (earlier IS NOT NULL AND earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows
  FROM f GROUP BY conv_id
), r AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' AS s0, NULL::VARCHAR AS s1, '000000005I' AS s2, '000000010II' AS s3 FROM g
  UNION ALL
  SELECT conv_id, i, a0, a1, {_INSERTED}, least(a3, {_edit(f"({_INSERTED})", "5", "I")}) FROM (
    SELECT r.conv_id, f.i, {_ARRIVED}
    FROM r JOIN f ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = r.i + 1)
), b AS (
  SELECT g.*, least(s0, s3) AS s FROM r JOIN g ON r.conv_id IS NOT DISTINCT FROM g.conv_id AND r.i = g.rows
), e AS (
  SELECT conv_id, substr(s, 10) AS audit, unnest(range(1, length(s) - 8)) AS p FROM b
), t AS (
  SELECT e.conv_id, p, audit[p] AS edit, length(replace(audit[1:p], 'I', '')) AS i, length(replace(audit[1:p], 'D', '')) AS q FROM e
), o AS (
  SELECT t.conv_id, p, q, edit, f.role, f.text,
    max(CASE WHEN q = 1 AND edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY t.conv_id) AS led
  FROM t LEFT JOIN f ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.i = f.i WHERE edit <> 'D'
), h AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (q - led) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS repaired
  FROM o GROUP BY conv_id
)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(substr(s, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(s, 10), '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN b ON i.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN h ON i.conv_id IS NOT DISTINCT FROM h.conv_id
"""

OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT alike
  AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 5
"""

ORACLES = {
    "op13_hard_negatives": OP13,
    "op11_conversation_repair": OP11,
    "op7_chat_formatting": OP7,
    "op1_benchmark_decontamination": OP1,
    "op3_url_filters": OP3,
    "op2_ngram_jaccard_join": OP2,
}
