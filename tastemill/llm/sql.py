"""The same results in DuckDB's SQL, where SQL can express them."""

from tastemill.llm.licenses import RULES, TRIGGER, known_sentences

# words of a text, as a pattern
_W = r"[^\x20\x09-\x0D]+"

QUALITY_SQL = rf"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '{_W}') AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)),
                       lambda x: regexp_matches(x, '{_W}')) AS ls
    FROM documents),
windows AS (
    SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS win
    FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
covered AS (
    SELECT rid, count(DISTINCT i + k) AS n
    FROM (SELECT rid, i, unnest(range(0, 5)) AS k FROM twice) GROUP BY rid),
m AS (
    SELECT d.rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
           CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
           CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT)
               AS n_symbols,
           CAST(len(ls) AS BIGINT) AS n_lines,
           CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM d LEFT JOIN covered ON d.rid = covered.rid),
f AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           10 * n_symbols > n_words AS f1, 10 * n_dup_lines > 3 * n_lines AS f2,
           word_chars < 2 * n_words OR word_chars > 15 * n_words AS f3
    FROM m),
hosts AS (
    SELECT source, CAST(count(*) AS DOUBLE) AS n, sum(CAST(f1 AS INT)) AS s1,
           sum(CAST(f2 AS INT)) AS s2, sum(CAST(f3 AS INT)) AS s3
    FROM f GROUP BY source),
means AS (SELECT sum(s1) / sum(n) AS m1, sum(s2) / sum(n) AS m2, sum(s3) / sum(n) AS m3 FROM hosts),
spread AS (
    SELECT sum(n * (s1 / n - m1) ** 2) / sum(n) AS v1, sum(n * (s2 / n - m2) ** 2) / sum(n) AS v2,
           sum(n * (s3 / n - m3) ** 2) / sum(n) AS v3
    FROM hosts, means),
prior AS (
    SELECT *,
        least(1000, greatest(1, CASE WHEN v1 > 0 THEN m1 * (1 - m1) / v1 - 1 ELSE 1000 END)) AS k1,
        least(1000, greatest(1, CASE WHEN v2 > 0 THEN m2 * (1 - m2) / v2 - 1 ELSE 1000 END)) AS k2,
        least(1000, greatest(1, CASE WHEN v3 > 0 THEN m3 * (1 - m3) / v3 - 1 ELSE 1000 END)) AS k3
    FROM means, spread),
verdicts AS (
    SELECT source, (s1 + m1 * k1) / (n + k1) AS r1, (s2 + m2 * k2) / (n + k2) AS r2,
           (s3 + m3 * k3) / (n + k3) AS r3
    FROM hosts, prior),
odds AS (
    SELECT *, coalesce(r1 > 0.3::DOUBLE, false) AS h1, coalesce(r2 > 0.3::DOUBLE, false) AS h2,
           coalesce(r3 > 0.3::DOUBLE, false) AS h3,
           coalesce(pow(10 * n_symbols / nullif(n_words, 0), 2) * r1 * 0.7::DOUBLE
                    > 0.3::DOUBLE * (1 - r1), false) AS p1,
           coalesce(pow(7 * n_dup_lines / nullif(3 * (n_lines - n_dup_lines), 0), 2) * r2 * 0.7::DOUBLE
                    > 0.3::DOUBLE * (1 - r2), false) AS p2,
           coalesce(pow(greatest(2 * n_words / nullif(word_chars, 0), word_chars / nullif(15 * n_words, 0)), 2)
                    * r3 * 0.7::DOUBLE > 0.3::DOUBLE * (1 - r3), false) AS p3
    FROM f JOIN verdicts ON f.source IS NOT DISTINCT FROM verdicts.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (f1 AND (h1 OR p1) OR f2 AND (h2 OR p2) OR f3 AND (h3 OR p3)) AS kept,
       h1 OR h2 OR h3 AS host_flagged
FROM odds
"""


def _rounds(n: int) -> str:
    """Sharing the words out by weight, round after round, as table expressions."""
    steps = ["l0 AS (SELECT 0.0::DOUBLE AS level)"]
    for i in range(1, n + 1):
        steps.append(f"""
l{i} AS (
    SELECT coalesce(
        (sum(source_size) - coalesce(sum(CASE WHEN 3 * source_size < weight * level
                                              THEN 3 * source_size END), 0))::DOUBLE
        / nullif(sum(CASE WHEN NOT 3 * source_size < weight * level THEN weight END), 0)::DOUBLE,
        any_value(level)) AS level
    FROM weights, l{i - 1})""")
    return ",".join(steps)


MIXING_SQL = rf"""
WITH sized AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_W}')) AS BIGINT)
               AS size,
           ('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix-1')[1:8])::BIGINT AS h
    FROM documents),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
    FROM sized GROUP BY source),
weights AS (SELECT * FROM sources),
{_rounds(25)},
targets AS (
    SELECT source, source_size,
           CASE WHEN 3 * source_size < weight * level THEN CAST(3 * source_size AS DOUBLE)
                ELSE weight * level END AS target
    FROM weights, l25),
ranked AS (
    SELECT s.doc_id, s.size, t.source_size, t.target,
           CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
           (('0x' || md5(coalesce(s.source, chr(0)) || '|mix-1')[1:4])::BIGINT) / 65536.0::DOUBLE
               AS u,
           row_number() OVER (
               PARTITION BY s.source
               ORDER BY length(bin(s.size)), rpad(bin(s.size)[1:4], 4, '0'), h, doc_id, s.size) - 1
               AS rank
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate * (rank + 1) + u) - floor(rate * rank + u)) * size AS BIGINT) AS taken
FROM ranked
"""

NEAR_DUP_SQL = rf"""
WITH RECURSIVE d AS (
    SELECT doc_id,
           regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                         'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS ws
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ')
                                 ELSE array_to_string(ws[i:i + 4], ' ') END AS s
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) AS i
          FROM d)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
    SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
    WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles,
       least(d.doc_id, coalesce(b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(b, d.doc_id)) AS kept
FROM d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN least_of l ON d.doc_id = l.a
"""

TOP_K_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))
           AS q
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT)
               AS score
    FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
           AS rank,
       vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

WARC_SQL = """
WITH p AS (
    SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
           sha1(coalesce(html, '')) AS payload_digest
    FROM pages),
f AS (
    SELECT *, CASE WHEN payload_bytes >= 1000
                   THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first
    FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

CHAT_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (
    SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS safe,
           replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS safe_role
    FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
           AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT)
           AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ''
                                  ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>' || safe_role || chr(10) || safe || '<|im_end|>' || chr(10)))
            AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _rules(sequence: str) -> str:
    for name, ids in RULES:
        pattern = "".join(f";{i};" for i in ids)
        sequence = f"replace({sequence}, '{pattern}', ';={name};')"
    return sequence


_KNOWN = ", ".join(f"('{text}', '{name}')" for text, name in known_sentences().items())

LICENSE_SQL = rf"""
WITH known(norm, id) AS (VALUES {_KNOWN}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
units AS (
    SELECT rid, i, us[i] AS u
    FROM (SELECT rid, us, unnest(range(1, len(us) + 1)) AS i
          FROM (SELECT rid, string_split_regex(t, '[.!?]+(?:\s+|$)|\n\s*\n') AS us FROM d
                WHERE regexp_matches(t, '{TRIGGER}')))),
parts AS (
    SELECT rid, i, 0 AS j, u AS s FROM units
    UNION ALL
    SELECT rid, i, j, ls[j] FROM (
        SELECT rid, i, ls, unnest(range(1, len(ls) + 1)) AS j
        FROM (SELECT rid, i, string_split(u, chr(10)) AS ls FROM units) WHERE len(ls) > 1)),
found AS (
    SELECT rid, i, j, id FROM parts
    JOIN known ON norm = trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))),
seqs AS (
    SELECT rid, count(*) AS n, string_agg(id, ',' ORDER BY i, j) AS ids,
           string_agg(';' || id || ';', '' ORDER BY i, j) AS seq
    FROM found GROUP BY rid),
rest AS (SELECT rid, n, ids, {_rules("seq")} AS r FROM seqs)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids,
       coalesce(array_to_string(regexp_extract_all(r, ';=([^;]*);', 1), ','), '') AS licenses,
       coalesce(array_to_string(regexp_extract_all(r, ';([^=;][^;]*);', 1), ','), '') AS unmatched
FROM d LEFT JOIN rest ON d.rid = rest.rid
"""

EMBED_DUP_SQL = """
WITH RECURSIVE v AS (
    SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x
    FROM embeddings),
ok AS (
    SELECT rid, vec_id, label, x, sqrt(list_dot_product(x, x)) AS len FROM v
    WHERE label IS NOT NULL AND x IS NOT NULL
      AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0
      AND len(list_filter(x, lambda e: e <> 0)) > 0),
links AS (
    SELECT a.rid AS a, b.rid AS b, b.vec_id
    FROM ok a JOIN ok b ON a.label = b.label AND a.rid <> b.rid AND len(a.x) = len(b.x)
    WHERE list_dot_product(a.x, b.x) / (a.len * b.len) >= 0.98),
reach AS (
    SELECT a, b, vec_id FROM links
    UNION SELECT r.a, l.b, l.vec_id FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(vec_id) AS least_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links,
       least(vec_id, coalesce(least_id, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(least_id, vec_id)) AS kept
FROM v LEFT JOIN least_of l ON v.rid = l.a LEFT JOIN counts c ON v.rid = c.a
"""

COLLOCATION_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                               'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
    SELECT lang, m, ws[i:i + m - 1] AS p
    FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
          FROM (SELECT lang, ws, unnest([1, 2, 3, 4]) AS m FROM w WHERE len(ws) > 0))),
f AS (SELECT lang, m, p, count(*) AS f FROM grams GROUP BY lang, m, p),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
often AS (SELECT * FROM f WHERE f >= 30),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM often WHERE m > 1),
scored AS (
    SELECT c.lang, c.m, c.p, c.f AS a, k, x.f AS l, y.f AS r,
           (2000000::HUGEINT * c.f) // (x.f + y.f) AS score
    FROM cuts c JOIN often x ON c.lang = x.lang AND x.p = c.p[1:k]
                JOIN often y ON c.lang = y.lang AND y.p = c.p[k + 1:c.m]),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (
    SELECT lang, p[i:i + q - 1] AS p, max(f) AS longer
    FROM (SELECT lang, p, m, f, q, unnest(range(1, m - q + 2)) AS i
          FROM (SELECT *, unnest(range(2, m)) AS q FROM often WHERE m > 2))
    GROUP BY 1, 2),
rest AS (
    SELECT w.*, array_to_string(w.p, ' ') AS phrase
    FROM weakest w LEFT JOIN inside i ON w.lang = i.lang AND w.p = i.p
    WHERE longer IS NULL OR 100 * longer < 80 * a),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM rest)
SELECT ranked.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n ON ranked.lang = n.lang WHERE rank <= 2000
"""

# The checksum is linear: every byte adds a value that depends on it and on its
# distance from the end; ``zeros`` is what the start value becomes.
SPELLING_SQL = r"""
WITH RECURSIVE bits(i, b, v) AS (
    SELECT 0, CAST(b AS BIGINT), CAST(b AS BIGINT) FROM range(256) t(b)
    UNION ALL
    SELECT i + 1, b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE i < 8),
base AS (SELECT b, v FROM bits WHERE i = 8),
runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents),
counted AS (
    SELECT run, length(run) AS chars, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, count(*) AS k
    FROM runs WHERE length(run) >= 6 GROUP BY run, doc_id),
coded AS (SELECT row_number() OVER () AS rid, run, chars, k, hex(encode(s)) AS h FROM counted),
longest AS (SELECT coalesce(max(length(h) // 2), 0) AS most FROM coded),
steps(j, b, v) AS (
    SELECT CAST(0 AS BIGINT), b, v FROM base
    UNION ALL
    SELECT j + 1, s.b, xor(s.v >> 8, base.v)
    FROM steps s JOIN base ON base.b = s.v & 255 WHERE j < (SELECT most FROM longest)),
zeros(j, v) AS (
    SELECT CAST(0 AS BIGINT), CAST(4294967295 AS BIGINT)
    UNION ALL
    SELECT j + 1, xor(z.v >> 8, base.v)
    FROM zeros z JOIN base ON base.b = z.v & 255 WHERE j < (SELECT most FROM longest)),
parts AS (
    SELECT rid, length(h) // 2 - 1 - i AS j, CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT) AS b
    FROM (SELECT rid, h, unnest(range(0, length(h) // 2)) AS i FROM coded)),
sums AS (SELECT rid, bit_xor(v) AS v FROM parts JOIN steps USING (j, b) GROUP BY rid),
damaged AS (
    SELECT k, run, chars, xor(xor(sums.v, zeros.v), 4294967295) AS h
    FROM coded JOIN sums USING (rid) JOIN zeros ON zeros.j = length(coded.h) // 2),
words AS (
    SELECT CASE WHEN h % 199 = 0 THEN run[1:h % chars] || run[h % chars + 2:] ELSE run END AS word, k FROM damaged),
v AS (
    SELECT word, CAST(sum(k) AS BIGINT) AS n FROM words GROUP BY word HAVING length(word) >= 6 AND sum(k) >= 5),
holes AS (
    SELECT word, n, word[1:i] || word[i + 2:] AS hole
    FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
keys AS (SELECT DISTINCT word, hole FROM holes UNION SELECT word, word FROM v),
near AS (
    SELECT DISTINCT a.word AS word, b.word AS near FROM keys a JOIN keys b USING (hole)
    WHERE a.word <> b.word
      AND (length(a.word) <> length(b.word)
           OR len(list_filter(range(1, length(a.word) + 1), lambda i: a.word[i] <> b.word[i])) = 1)),
best AS (
    SELECT word, count(*) AS n_near, min_by(near, (-n, near)) AS form, max(n) AS form_n
    FROM (SELECT near.word, near.near, v.n FROM near JOIN v ON near.near = v.word) GROUP BY word),
forms AS (
    SELECT v.word, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
           CASE WHEN form_n >= 5 * v.n THEN form END AS form,
           CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n
    FROM v LEFT JOIN best ON v.word = best.word),
follow(word, goal, i) AS (
    SELECT word, form, 1 FROM forms WHERE form IS NOT NULL
    UNION ALL SELECT follow.word, forms.form, i + 1 FROM follow JOIN forms ON follow.goal = forms.word
    WHERE forms.form IS NOT NULL),
ends AS (SELECT word, max_by(goal, i) AS root FROM follow GROUP BY word)
SELECT forms.word, form, coalesce(root, forms.word) AS root, n, n_near, form_n
FROM forms LEFT JOIN ends ON forms.word = ends.word
"""
