"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM_WORDS = rf"list_filter(regexp_split_to_array({LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

SHARED_PASSAGES = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
windows AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM starts),
firsts AS (SELECT s, min(doc_id) AS f FROM windows GROUP BY s),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hits, (SELECT unnest(range(13)) AS j)),
every AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM every ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

REPEATED_BYTES = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 98)) AS i FROM d),
windows AS (SELECT doc_id, i, substr(h, 2 * i - 1, 200) AS s FROM starts),
firsts AS (SELECT s, min(doc_id * 4294967296 + i) AS f FROM windows GROUP BY s),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE f < doc_id * 4294967296 + i),
edges AS (
  SELECT doc_id, i, CASE WHEN i > max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100
    OR row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1 THEN 1 ELSE 0 END AS fresh FROM hits),
runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edges),
spans AS (SELECT doc_id, r, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, r),
gone AS (SELECT doc_id, unnest(range(a, b)) AS p FROM spans),
counts AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * p - 1, 2), '' ORDER BY p) AS t
  FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {ALNUM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
parts AS (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM sized),
items AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS s FROM parts),
sizes AS (SELECT DISTINCT n FROM items),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
windows AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS s FROM starts),
hits AS (SELECT doc_id, n, i, item_id FROM windows JOIN items USING (n, s)),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""

LOWERED_WORDS = WORDS.replace("coalesce(text, '')", LOWERED)

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {LOWERED_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common.n >= 75 * (x.n + y.n - common.n)),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN sizes USING (doc_id)
"""

RANKED = f"""
WITH words AS (SELECT doc_id, {ALNUM_WORDS} AS w FROM documents),
size AS (SELECT count(*) FILTER (len(w) > 0) AS docs, coalesce(sum(len(w)), 1)::BIGINT AS total FROM words),
asked AS (SELECT DISTINCT item_id, unnest({ALNUM_WORDS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
terms AS (SELECT DISTINCT term FROM asked),
held AS (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM words),
counted AS (SELECT doc_id, n, term, count(*) AS tf FROM held SEMI JOIN terms USING (term) GROUP BY doc_id, n, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight
  FROM counted, size GROUP BY term),
scores AS (
  SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term), size GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 50
"""


def _reduced(start: str, levels: int) -> str:
    """Nodes of each level and their runs of eight, from (tree, i, h) in ``start``."""
    parts, last = [], start
    for level in range(levels):
        here = f"{start}_{level + 1}"
        parts.append(f"""{here}_runs AS (
  SELECT tree, i // 8 AS run, list(h ORDER BY i) AS hs, any_value(total) AS total
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS total FROM {last}) GROUP BY tree, run),
{here} AS (SELECT tree, run AS i, CASE WHEN total = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {here}_runs)""")
        last = here
    return ",\n".join(parts)


def _walked(start: str, nodes: str, levels: int) -> str:
    """(doc_id, tree, i, fold, proof) of ``start`` taken up through the runs of ``nodes``."""
    parts, last = [], start
    for level in range(levels):
        here, place = f"{start}_{level + 1}", "(i % 8)::INTEGER"
        before, after = f"array_to_string(hs[1:{place}], '')", f"array_to_string(hs[{place} + 2:], '')"
        parts.append(f"""{here} AS (
  SELECT w.* EXCLUDE (i, fold, proof), run AS i,
    CASE WHEN total = 1 THEN fold ELSE sha256({before} || fold || {after}) END AS fold,
    CASE WHEN total = 1 THEN proof ELSE proof || {before} || {after} END AS proof
  FROM {last} w JOIN {nodes}_{level + 1}_runs r ON w.tree = r.tree AND w.i // 8 = r.run)""")
        last = here
    return ",\n".join(parts)


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}) || ':' || {value} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Bit by bit: the byte of a character enters before the first of its eight steps.
_CRC = """xor(list_reduce(
  list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)), 4294967295::BIGINT)"""
#: Up to 8**8 rows of a language and 8**3 languages.
MERKLE = f"""
WITH d AS (
  SELECT doc_id, {_field('lang')} AS tree, lang, {_leaf('text')} AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(_LOWERED)} ELSE leaf END AS fold,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents),
base AS (SELECT tree, i, leaf AS h FROM d),
{_reduced('base', 8)},
subs AS (SELECT tree AS name, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place
  FROM base_8 JOIN (SELECT DISTINCT tree, lang FROM d) USING (tree)),
forest AS (SELECT '' AS tree, place AS i, subroot AS h FROM subs),
{_reduced('forest', 3)},
w AS (SELECT doc_id, tree, leaf, i, fold, '' AS proof FROM d),
{_walked('w', 'base', 8)},
u AS (SELECT doc_id, leaf, '' AS tree, subroot, place AS i, fold, proof FROM w_8 JOIN subs ON w_8.tree = subs.name),
{_walked('u', 'forest', 3)}
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified
FROM u_3, forest_3
"""
