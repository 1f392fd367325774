"""SQL for DuckDB that gives the rows of the operators that SQL can express."""

from __future__ import annotations

from sitewise.llm.common import KEY_SQL
from sitewise.llm.rules import CLASSES, VOCABULARY, Rules


def _crc_table() -> list[int]:
    """CRC-32 of each half byte, from the reversed polynomial."""
    out = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string, half a byte at a time."""
    halves = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [ascii({text}[i]) & 15, ascii({text}[i]) >> 4]))"
    halves = f"list_transform({halves}, lambda h: h::BIGINT)"
    table = f"[{', '.join(map(str, _crc_table()))}]"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {halves}), lambda c, h: xor({table}[1 + (xor(c, h) & 15)], c >> 4)), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _climb(name: str, leaves: str) -> str:
    """CTEs of the trees over `leaves` (tree, pos, n, node): all nodes, and each node with its siblings."""
    return f"""
{name}_up(lvl, tree, pos, n, node) AS (
  SELECT 0, tree, pos, n, node FROM {leaves}
  UNION ALL
  SELECT lvl + 1, tree, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM {name}_up WHERE n > 1
  GROUP BY lvl, tree, pos // 3, n),
{name}_side AS (
  SELECT lvl, tree, pos, n,
    coalesce(string_agg(node, '' ORDER BY pos) OVER (PARTITION BY lvl, tree, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
    coalesce(string_agg(node, '' ORDER BY pos) OVER (PARTITION BY lvl, tree, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM {name}_up)"""


def _walk(name: str, start: str) -> str:
    """CTE that takes `start` (id, tree, pos, node, proof) up its tree."""
    return f"""
{name}_walk(id, lvl, tree, pos, n, node, proof) AS (
  SELECT s.id, 0, s.tree, s.pos, u.n, s.node, s.proof FROM {start} s JOIN {name}_up u ON u.lvl = 0 AND u.tree = s.tree AND u.pos = s.pos
  UNION ALL
  SELECT w.id, w.lvl + 1, w.tree, w.pos // 3, (w.n + 2) // 3, sha256(s.lft || w.node || s.rgt), w.proof || s.lft || s.rgt
  FROM {name}_walk w JOIN {name}_side s ON s.lvl = w.lvl AND s.tree = w.tree AND s.pos = w.pos WHERE w.n > 1)"""


_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || "
MERKLE = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('+' || source, '') AS tree, {_LEAF}{_field('text')}) AS leaf,
    CASE WHEN {crc32('(doc_id::VARCHAR)')} % 2 = 0 THEN {_LEAF}{_field("replace(text, chr(10), '')")}) END AS changed
  FROM documents),
leaves AS (
  SELECT id, doc_id, tree, leaf AS node, coalesce(changed, leaf) AS begun,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
  FROM docs),
{_climb('a', 'leaves')},
subroots AS (SELECT tree AS name, 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, node FROM a_up WHERE n = 1),
{_climb('b', 'subroots')},
starts AS (SELECT id, tree, pos, begun AS node, '' AS proof FROM leaves),
{_walk('a', 'starts')},
middle AS (SELECT w.id, 0 AS tree, s.pos, w.node, w.proof FROM a_walk w JOIN subroots s ON s.name = w.tree WHERE w.n = 1),
{_walk('b', 'middle')}
SELECT l.doc_id, l.node AS leaf, s.node AS subroot, r.node AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root,
  w.node = r.node AS verified
FROM leaves l JOIN subroots s ON s.name = l.tree JOIN b_walk w ON w.id = l.id AND w.n = 1 CROSS JOIN (SELECT node FROM b_up WHERE n = 1) r
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PHRASES = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
windows AS (SELECT lang, w[i : i + 4] AS win FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split)),
counted AS (SELECT lang, win, count(*) AS c FROM windows GROUP BY ALL),
grams AS (
  SELECT lang, win[1 : k] AS p, sum(c)::BIGINT AS f FROM counted, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE k <= len(win)
  GROUP BY ALL HAVING sum(c) >= 100),
longer AS (
  SELECT lang, p, max(f) AS f FROM (
    SELECT lang, p[1 : len(p) - 1] AS p, f FROM grams WHERE len(p) > 2 UNION ALL SELECT lang, p[2 : len(p)], f FROM grams WHERE len(p) > 2)
  GROUP BY ALL),
opened AS (
  SELECT g.lang, g.p, g.f FROM grams g LEFT JOIN longer l ON l.lang = g.lang AND l.p = g.p WHERE len(g.p) > 1 AND coalesce(l.f < g.f, true)),
cuts AS (SELECT lang, p, f, unnest(range(1, len(p))) AS k FROM opened),
scored AS (
  SELECT c.lang, array_to_string(c.p, ' ') AS phrase, c.k, c.f AS a, l.f AS l, r.f AS r, t.n,
    ((1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN grams l ON l.lang = c.lang AND l.p = c.p[1 : c.k] JOIN grams r ON r.lang = c.lang AND r.p = c.p[c.k + 1 : len(c.p)]
  JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

_TEXT_CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, strlen(t) + 1),
  lambda i: [('0x' || x[2 * i])::BIGINT, ('0x' || x[2 * i - 1])::BIGINT]))),
  lambda c, h: xor([{', '.join(map(str, _crc_table()))}][1 + (xor(c, h) & 15)], c >> 4)), 4294967295)"""
SHARDS = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, hex(coalesce(text, '')) AS x, strlen(coalesce(text, '')) + 1 AS size, {KEY_SQL} AS key FROM documents),
keys AS (SELECT key, sum(size) AS b FROM docs GROUP BY key),
placed AS (SELECT key, sum(b) OVER (ORDER BY key) - b AS before, sum(b) OVER () AS total FROM keys),
sized AS (SELECT d.doc_id, d.size::BIGINT AS size, ({_TEXT_CRC})::BIGINT AS text_crc32, d.key, (16 * p.before // p.total)::INTEGER AS shard FROM docs d JOIN placed p ON p.key = d.key)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY key, doc_id NULLS FIRST, text_crc32) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM sized
"""

_SPACES = r"[\x20\x09-\x0D]+"
_N, _W = len(CLASSES) + 1, len(VOCABULARY) + 1


def _js(shares: str, reference: str, n: int) -> str:
    """Jensen-Shannon distance of two lists of n shares."""
    part = "(CASE WHEN {0} > 0 THEN {0} * log2({0} / (({0} + {1}) / 2)) ELSE 0 END)"
    pairs = [(f"{shares}[{i}]", f"{reference}[{i}]") for i in range(1, n + 1)]
    return f"sqrt(greatest(({' + '.join(part.format(p, q) + ' + ' + part.format(q, p) for p, q in pairs)}) / 2, 0))"


def _words_in(tokens: str) -> str:
    counts = [f"len(list_filter({tokens}, lambda y: y = '{w}'))" for w in VOCABULARY]
    return f"[{', '.join(counts)}]"


def _classes_in(text: str) -> str:
    counts = [f"length({text}) - length(regexp_replace({text}, '{p}', '', 'g'))" for p in ("".join(c).replace("'", "''") for c in CLASSES.values())]
    return f"[{', '.join(counts)}]"


_RULES = Rules()
RULES = f"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '{_SPACES}'), lambda y: y <> '') AS w FROM documents),
counted AS (
  SELECT *, len(w) AS n, {_classes_in('t')} AS known, {_words_in('w')} AS common,
    list_filter(string_split(t, chr(10)), lambda y: length(regexp_replace(y, '{_SPACES}', '', 'g')) > 0) AS lines FROM docs),
shares AS (
  SELECT *, list_append(known, length(t) - list_sum(known)) AS classes, list_append(common, n - list_sum(common)) AS vocabulary FROM counted),
threes AS (SELECT id, i, w[i : i + 2] AS three FROM (SELECT id, w, unnest(range(1, n - 1)) AS i FROM shares WHERE n > 2)),
again AS (SELECT id, i FROM threes QUALIFY count(*) OVER (PARTITION BY id, three) > 1),
covered AS (SELECT id, count(DISTINCT i + j) AS n_repeat_words FROM again, (SELECT unnest([0, 1, 2]) AS j) GROUP BY id),
middles AS (
  SELECT lang, {', '.join(f'quantile_disc(classes[{i}] / length(t), 0.5) AS c{i}' for i in range(1, _N + 1))},
    {', '.join(f'avg(vocabulary[{i}] / n) AS w{i}' for i in range(1, _W + 1))}
  FROM shares WHERE lang IN ('en', 'de', 'fr', 'es') AND n >= 50 GROUP BY lang),
refs AS (
  SELECT [{', '.join(f'c{i} / (' + ' + '.join(f'c{k}' for k in range(1, _N + 1)) + ')' for i in range(1, _N + 1))}] AS rc,
    [{', '.join(f'w{i}' for i in range(1, _W + 1))}] AS rw FROM middles),
own AS (
  SELECT *, list_transform(classes, lambda y: y / greatest(length(t), 1)) AS sc, list_transform(vocabulary, lambda y: y / greatest(n, 1)) AS sw FROM shares),
apart AS (
  SELECT id, CASE WHEN length(t) >= {_RULES.min_chars} THEN {_js('sc', 'rc', _N)} ELSE 0 END AS c,
    CASE WHEN n >= {_RULES.min_words} THEN {_js('sw', 'rw', _W)} ELSE 0 END AS w FROM own, refs),
near AS (SELECT id, c, w FROM apart QUALIFY row_number() OVER (PARTITION BY id ORDER BY c + w, c, w) = 1),
judged AS (
  SELECT o.*, coalesce(v.n_repeat_words, 0) AS n_repeat_words, coalesce(a.c, 0)::DOUBLE AS dc, coalesce(a.w, 0)::DOUBLE AS dw,
    n < 50 OR 100 * coalesce(v.n_repeat_words, 0) > 50 * n AS failed
  FROM own o LEFT JOIN covered v ON v.id = o.id LEFT JOIN near a ON a.id = o.id)
SELECT doc_id, n::BIGINT AS n_words, (length(t) - classes[{list(CLASSES).index('space') + 1}])::BIGINT AS word_chars,
  classes[{list(CLASSES).index('symbol') + 1}]::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, failed AS base_failed, round(dc, 6) AS class_distance, round(dw, 6) AS word_distance,
  NOT failed AND dc <= {_RULES.max_class} AND dw <= {_RULES.max_word} AS kept
FROM judged
"""
