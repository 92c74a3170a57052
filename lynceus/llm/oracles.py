"""SQL that gives the same rows, where SQL can express the operator."""

_SPACES = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_COMPONENTS = """
reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
  UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.b = l.a
),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)"""

_CHARS = "length({}) - length(regexp_replace({}, '{}', '', 'g'))"

_CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
)"""


def _crc(codes: str) -> str:
    """The unsigned crc32 of a list of byte values, beside ``crc_table``."""
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


_ID_CRC = _crc("list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)")


def _climb(name: str, levels: int) -> str:
    """Tables name_0, name_1, ... of the nodes of each level, each with its siblings joined, from name(tree, pos, n, h)."""
    beside = "coalesce(string_agg(h, '') OVER (PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN {}), '')"
    sides = f"{beside.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS b, {beside.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS a"
    out = [f"{name}_0 AS MATERIALIZED (SELECT tree, pos, n, h, {sides} FROM {name})"]
    for k in range(levels):
        raised = "CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END"
        out.append(
            f"{name}_{k + 1} AS MATERIALIZED (SELECT tree, pos, n, h, {sides} FROM (SELECT tree, pos // 3 AS pos, (any_value(n) + 2) // 3 AS n,"
            f" {raised} AS h FROM {name}_{k} GROUP BY tree, pos // 3))"
        )
    return ",\n".join(out)


def _paths(source: str, name: str, levels: int, out: str) -> str:
    """Rows of ``source`` (tree, pos, proof, folded) after the steps of all levels of a climbed table."""
    parts = []
    for k in range(levels):
        of, to = (source if k == 0 else f"{out}_{k}"), (out if k == levels - 1 else f"{out}_{k + 1}")
        parts.append(
            f"{to} AS MATERIALIZED (SELECT p.* REPLACE (p.pos // 3 AS pos, proof || b || a AS proof,"
            f" CASE WHEN n > 1 THEN sha256(b || folded || a) ELSE folded END AS folded) FROM {of} p JOIN {name}_{k} l ON l.tree = p.tree AND l.pos = p.pos)"
        )
    return ",\n".join(parts)


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR, '-')"


_ROW = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))

SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(8) r(j) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
worded AS (SELECT doc_id, line FROM lines WHERE trim(line, {_SPACES}) <> ''),
repeats AS (
  SELECT doc_id, sum(c) - count(*) AS n, sum(c * length(line)) AS chars, sum((c - 1) * length(line)) AS extra
  FROM (SELECT doc_id, line, count(*) AS c FROM worded GROUP BY 1, 2) GROUP BY doc_id
),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
by_word AS (
  SELECT doc_id, count(*) FILTER (word = before) AS stutters, count(*) FILTER (suffix(word, '!!')) AS shouts,
         count(*) FILTER (NOT regexp_matches(word, '[A-Za-z]|[^\x00-\x7F]')) AS bare
  FROM (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM words) GROUP BY doc_id
),
top AS (SELECT doc_id, max(c) AS most FROM (SELECT doc_id, word, count(*) AS c FROM words GROUP BY 1, 2) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, ({_CHARS.format('t', 't', r'[\x20\x09-\x0D]+').replace('length(t) - ', '')})::BIGINT AS word_chars,
         ({_CHARS.format('t', 't', r'[#*$%&|<>]')})::BIGINT AS n_symbols, coalesce(r.n, 0)::BIGINT AS n_dup_lines,
         coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(r.chars, 0) AS chars, coalesce(r.extra, 0) AS extra,
         coalesce(b.stutters, 0) AS stutters, coalesce(b.shouts, 0) AS shouts, coalesce(b.bare, 0) AS bare, coalesce(top.most, 0) AS most,
         {_CHARS.format('t', 't', '[A-Z]')} AS capitals, {_CHARS.format('t', 't', '[a-z]')} AS small
  FROM d LEFT JOIN repeats r USING (doc_id) LEFT JOIN repeated p USING (doc_id) LEFT JOIN by_word b USING (doc_id) LEFT JOIN top USING (doc_id)
),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR (n_dup_lines > 0 AND 10 * extra > 3 * chars) OR 10 * stutters > 3 * n_words OR 10 * capitals > 6 * (capitals + small)
            OR 2 * bare > n_words OR 10 * most > 4 * n_words OR 10 * shouts > 3 * n_words) AS kept
FROM f""",
    "op4_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS n, sha256(payload) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f""",
    "op5_embedding_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.95
),{_COMPONENTS},
degree AS (SELECT a, count(*) AS n FROM (SELECT a FROM links UNION ALL SELECT b FROM links) GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id,
       coalesce(m, e.vec_id) >= e.vec_id AS kept
FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id""",
    "op6_minhash": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace('text,', _LOWER.format('text') + ',')} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
),
links AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b
  WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)
),{_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       coalesce(m, d.doc_id) >= d.doc_id AS kept
FROM d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id""",
    "op9_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
),
found AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS first_id FROM windows) WHERE first_id < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
placed AS (SELECT w.doc_id, w.i, w.word, f.i AS found_at FROM words w ASOF LEFT JOIN found f ON w.doc_id = f.doc_id AND w.i >= f.i),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM placed WHERE found_at IS NULL OR i >= found_at + 50 GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op10_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
keyed AS (SELECT *, {_LOWER.format(f'trim(line, {_SPACES})')} AS k FROM each),
frequent AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS t
  FROM keyed LEFT JOIN frequent USING (k) WHERE keeper IS NULL OR keeper = doc_id GROUP BY doc_id
)
SELECT d.doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op11_merkle": f"""
WITH {_CRC_TABLE},
d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS tree, sha256({_ROW} || {_field('text')}) AS h,
         CASE WHEN {_ID_CRC} % 2 = 0 THEN sha256({_ROW} || {_field("replace(text, chr(10), '')")}) END AS tampered
  FROM documents, crc_table
),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_climb('leaves', 12)},
subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM leaves_12),
tops AS (SELECT '2' AS tree, place AS pos, count(*) OVER () AS n, subroot AS h FROM subroots),
{_climb('tops', 8)},
started AS (SELECT doc_id, tree, h AS leaf, pos, '' AS proof, coalesce(tampered, h) AS folded FROM leaves),
{_paths('started', 'leaves', 12, 'inside')},
between AS (SELECT doc_id, leaf, subroot, '2' AS tree, place AS pos, proof, folded FROM inside JOIN subroots USING (tree)),
{_paths('between', 'tops', 8, 'whole')}
SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.h AS verified
FROM whole JOIN tops_8 t ON t.tree = whole.tree""",
    "op13_spelling": f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[a-zÀ-ÿ]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n, doc_id::VARCHAR || ':' || run AS named FROM runs GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, CASE WHEN doc_id IS NULL THEN 1 ELSE {_crc("flatten(list_transform(string_split(named, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + (unicode(x) >> 6))::BIGINT, (128 + (unicode(x) & 63))::BIGINT] END))")} END AS h
  FROM each, crc_table
),
results AS (
  SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed
),
words AS (SELECT word, sum(n)::BIGINT AS n FROM results GROUP BY word HAVING length(word) >= 6 AND sum(n) >= 5),
cuts AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT x.word AS a, y.word AS b, y.n FROM cuts x JOIN cuts y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word AND length(x.word) = length(y.word)
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest
),
best AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS m FROM pairs GROUP BY a),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN b END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM words LEFT JOIN best ON a = word),
chain(word, root, further) AS (
  SELECT word, word, form FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON f.word = c.further
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word AND c.further IS NULL""",
}
