"""SQL twins of the queries of this package, where SQL can express them."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS words FROM documents WHERE doc_id IS NOT NULL),
copies AS (SELECT words, min(doc_id) AS rep, count(DISTINCT doc_id) AS size FROM w GROUP BY words),
shingles AS (
  SELECT DISTINCT rep, unnest(CASE
    WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: words[i:i + 4])
    WHEN len(words) > 0 THEN [words] ELSE [] END) AS s
  FROM copies),
n AS (SELECT rep, count(*) AS n FROM shingles GROUP BY rep),
met AS (
  SELECT a.rep AS a, b.rep AS b, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.rep < b.rep GROUP BY 1, 2),
link AS (
  SELECT a, b FROM met JOIN n na ON na.rep = a JOIN n nb ON nb.rep = b
  WHERE shared >= 0.8 * (na.n + nb.n - shared) - 1e-9),
two AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT rep AS node, rep AS root FROM copies UNION SELECT two.b, reach.root FROM reach JOIN two ON two.a = reach.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
stats AS (SELECT two.a AS rep, count(*) AS links, sum(c.size) AS docs FROM two JOIN copies c ON c.rep = two.b GROUP BY 1)
SELECT w.doc_id, copies.rep AS text_id, roots.root AS class_id, copies.size AS n_copies,
  coalesce(stats.links, 0)::BIGINT AS n_links, (coalesce(stats.docs, 0) + copies.size - 1)::BIGINT AS n_linked_docs
FROM w JOIN copies ON copies.words = w.words JOIN roots ON roots.node = copies.rep LEFT JOIN stats ON stats.rep = copies.rep
"""

OP9 = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
win AS (
  SELECT doc_id, i, words[i:i + 12] AS s
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)),
own AS (SELECT s, min(doc_id) AS owner FROM win GROUP BY s),
hit AS (SELECT win.doc_id, win.i FROM win JOIN own USING (s) WHERE own.owner < win.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, len(w.words) AS n_words, coalesce(len(lost.ps), 0) AS n_removed,
    CASE WHEN lost.ps IS NULL THEN w.words
      ELSE list_filter(w.words, lambda x, k: NOT list_contains(lost.ps, k)) END AS left_words
  FROM w LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(left_words, ' '), '')) AS kept_sha256
FROM kept
"""

OP2 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    lag(role, 1, '<start>') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    length(regexp_replace(role, '(###|:\n|</turn>|\\)', 'x\1', 'g')) + length(regexp_replace(text, '(###|:\n|</turn>|\\)', 'x\1', 'g'))
      + length('### :') + 1 + length(' </turn>') + 1 AS chars
  FROM rows),
steps AS (
  SELECT *, CASE WHEN (before, role) IN (('<start>', 'system'), ('<start>', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'))
    THEN NULL ELSE before || ' -> ' || role END AS bad
  FROM sized),
conv AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars,
    arg_min(bad, n) FILTER (bad IS NOT NULL) AS bad, arg_max(role, n) AS last_role
  FROM steps GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
  coalesce(bad, CASE WHEN last_role = 'assistant' THEN '' ELSE last_role || ' -> <end>' END) = '' AS valid,
  coalesce(bad, CASE WHEN last_role = 'assistant' THEN '' ELSE last_role || ' -> <end>' END) AS problem
FROM conv
"""

_RULES = """CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END"""

OP3 = rf"""
WITH RECURSIVE cut AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
base AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
ruled AS (SELECT *, {_RULES} AS rule FROM base),
judged AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS said FROM ruled),
places AS (
  SELECT DISTINCT page_id, host AS src, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s<>]+(?:/[^?#"''\s<>]*)?)', 1)) AS place
  FROM judged WHERE host != ''),
links AS (
  SELECT DISTINCT page_id, src, translate(regexp_extract(place, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN strpos(place, '/') > 0 THEN substr(place, strpos(place, '/')) ELSE '/' END AS path
  FROM places),
own AS (
  SELECT host, avg(CASE WHEN said = 'allow' THEN 1.0::DOUBLE ELSE 0.0 END) AS allowed, avg(CASE WHEN said = 'block' THEN 1.0::DOUBLE ELSE 0.0 END) AS blocked
  FROM judged WHERE host != '' GROUP BY host),
linked AS (SELECT host, {_RULES} AS rule FROM (SELECT DISTINCT host, path FROM links WHERE src != host AND host NOT IN (SELECT host FROM own))),
hosts AS (
  SELECT * FROM own
  UNION ALL
  SELECT host, avg(CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 1.0::DOUBLE ELSE 0.0 END), avg(CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1.0::DOUBLE ELSE 0.0 END)
  FROM linked GROUP BY host),
above AS (
  SELECT h.host AS src, max_by(k.host, length(k.host)) AS dst FROM hosts h JOIN hosts k ON ends_with(h.host, '.' || k.host) GROUP BY 1),
edges AS (
  SELECT src, dst, sum(w) AS w FROM (
    SELECT src, host AS dst, count(DISTINCT page_id) AS w FROM links WHERE src != host GROUP BY 1, 2
    UNION ALL SELECT src, dst, 1 FROM above) GROUP BY 1, 2),
both_ways AS (SELECT 'trust' AS kind, src AS host, dst AS goal, w FROM edges UNION ALL SELECT 'distrust', dst, src, w FROM edges),
moves AS (
  SELECT kind, b.host, goal, p * (1 - allowed - blocked) AS p
  FROM (SELECT *, w / sum(w) OVER (PARTITION BY kind, host) AS p FROM both_ways) b JOIN hosts ON hosts.host = goal),
seeds AS (SELECT 'trust' AS kind, host, allowed * 0.15 AS r, 0.15::DOUBLE AS q FROM hosts UNION ALL SELECT 'distrust', host, blocked * 0.15, 0.15 FROM hosts),
walk AS (
  SELECT 0 AS step, kind, host, r, q FROM seeds
  UNION ALL
  SELECT walk.step + 1, walk.kind, moves.goal, sum(walk.r * moves.p * 0.85), sum(walk.q * moves.p * 0.85)
  FROM walk JOIN moves ON moves.kind = walk.kind AND moves.host = walk.host WHERE walk.step < 160 GROUP BY ALL),
sums AS (
  SELECT kind, host, sum(r) AS r, CASE WHEN coalesce(sum(q) FILTER (step > 0), 0) > 1e-6 THEN sum(r) FILTER (step > 0) / sum(q) FILTER (step > 0) ELSE 0 END AS share
  FROM walk GROUP BY kind, host),
ranks AS (
  SELECT host, sum(r) FILTER (kind = 'trust') AS trust, sum(r) FILTER (kind = 'distrust') AS distrust,
    sum(share) FILTER (kind = 'trust') AS trust_share, sum(share) FILTER (kind = 'distrust') AS distrust_share
  FROM sums GROUP BY host)
SELECT page_id, j.host, path, rule,
  coalesce(said, CASE WHEN coalesce(distrust_share, 0) - coalesce(trust_share, 0) >= 0.5 - 1e-7 THEN 'block' ELSE 'allow' END) AS verdict,
  round(coalesce(trust, 0), 8) AS trust, round(coalesce(distrust, 0), 8) AS distrust,
  round(coalesce(trust_share, 0), 8) AS trust_share, round(coalesce(distrust_share, 0), 8) AS distrust_share
FROM judged j LEFT JOIN ranks ON ranks.host = j.host
"""

OP5 = """
WITH r AS (
  SELECT page_id, 'pages-' || (page_id // 500) AS archive, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
l AS (
  SELECT *, strlen('WARC/1.0WARC-Type: resourceWARC-Record-ID: <urn:page:' || page_id || '>WARC-Target-URI: '
    || replace(replace(url, chr(13), '%0D'), chr(10), '%0A') || 'Content-Type: text/htmlContent-Length: ' || strlen(html)) + strlen(html) + 18 AS length
  FROM r),
o AS (SELECT *, sum(length) OVER (PARTITION BY archive ORDER BY page_id, url, html ROWS UNBOUNDED PRECEDING) - length AS begins FROM l)
SELECT archive, begins::BIGINT AS "offset", length::BIGINT AS length, '<urn:page:' || page_id || '>' AS record_id, 'changed' AS kind, page_id
FROM o WHERE page_id % 97 = 5
"""

_LEAF = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "{n}", "text"))

#: crc32 of the id's decimal text, bit by bit.
_CRC = """xor(4294967295::BIGINT, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)))"""

OP12 = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_LEAF.format(n="n_chars")}) AS leaf,
    CASE WHEN {_CRC} % 7 = 0 AND n_chars IS NOT NULL THEN sha256({_LEAF.format(n="(n_chars + 1)")}) END AS changed
  FROM documents),
n AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size
  FROM leaves),
lv AS (
  SELECT tree, 0 AS lvl, pos, leaf AS node, size FROM n
  UNION ALL
  SELECT tree, lvl + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (any_value(size) + 1) // 2
  FROM lv WHERE size > 1 GROUP BY tree, lvl, pos // 2),
sub AS (SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS size FROM lv WHERE size = 1),
up AS (
  SELECT 0 AS lvl, pos, subroot AS node, size FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (any_value(size) + 1) // 2 FROM up WHERE size > 1 GROUP BY lvl, pos // 2),
steps AS (
  SELECT n.tree, n.pos, list(CASE WHEN b.node IS NULL THEN '=' WHEN b.pos < a.pos THEN 'L' || b.node ELSE 'R' || b.node END ORDER BY a.lvl) AS path
  FROM n JOIN lv a ON a.tree = n.tree AND a.pos = n.pos >> a.lvl AND a.size > 1
    LEFT JOIN lv b ON b.tree = a.tree AND b.lvl = a.lvl AND b.pos = xor(a.pos, 1)
  GROUP BY n.tree, n.pos),
upper AS (
  SELECT sub.tree, list(CASE WHEN b.node IS NULL THEN '=' WHEN b.pos < a.pos THEN 'L' || b.node ELSE 'R' || b.node END ORDER BY a.lvl) AS path
  FROM sub JOIN up a ON a.pos = sub.pos >> a.lvl AND a.size > 1 LEFT JOIN up b ON b.lvl = a.lvl AND b.pos = xor(a.pos, 1)
  GROUP BY sub.tree),
whole AS (
  SELECT n.doc_id, n.leaf, coalesce(n.changed, n.leaf) AS shown, sub.subroot, (SELECT node FROM up WHERE size = 1) AS root,
    list_concat(coalesce(steps.path, []), coalesce(upper.path, [])) AS path
  FROM n JOIN sub USING (tree) LEFT JOIN steps ON steps.tree = n.tree AND steps.pos = n.pos LEFT JOIN upper ON upper.tree = n.tree),
folded AS (
  SELECT *, list_reduce(list_concat([shown], path), lambda a, s: sha256(
    CASE substr(s, 1, 1) WHEN 'L' THEN substr(s, 2) || a WHEN 'R' THEN a || substr(s, 2) ELSE a END)) AS folded_root
  FROM whole)
SELECT doc_id, leaf, subroot, root,
  sha256(coalesce(array_to_string(list_transform(list_filter(path, lambda s: s <> '='), lambda s: substr(s, 2)), ''), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM folded
"""

OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 100),
subs AS (SELECT lang, k, a, ws, unnest(range(2, k)) AS m FROM cand),
inner_phrases AS (SELECT lang, a, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM subs),
longer AS (SELECT lang, phrase, max(a) AS a FROM inner_phrases GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN longer USING (lang, phrase) WHERE longer.a IS NULL OR 100 * longer.a < 100 * c.a),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, n.n,
    (1000::HUGEINT * c.a * n.n::HUGEINT) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN n USING (lang)
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:c.cut], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[c.cut + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""
