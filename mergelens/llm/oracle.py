"""DuckDB SQL of the operators' queries, where SQL can express them."""

from __future__ import annotations

_CHATS = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    SELECT *, role = 'assistant' AS loss,
        -- each of four characters is escaped to two
        length(text) + length(regexp_replace(text, '[^\[\]<\\]', '', 'g')) AS chars,
        CASE role WHEN 'user' THEN 6 + 7 WHEN 'assistant' THEN 5 + 4 WHEN 'system' THEN 7 + 8
            ELSE 6 + length(role) + length(regexp_replace(role, '[^\[\]<\\]', '', 'g')) + 1 + 7 END AS marks,
        CASE WHEN role IN ('user', 'assistant', 'system') THEN role[1] ELSE 'x' END AS letter
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN loss THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (loss), '')) AS loss_sha256,
    CAST(sum(chars + marks) AS BIGINT) AS formatted_chars,
    regexp_full_match(string_agg(letter, '' ORDER BY turn NULLS FIRST, role, text), 's|s?u(au)*a?') AS valid
FROM sized GROUP BY conv_id
"""

_SETS = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE
        WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM worded
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), pairs AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * i >= 85 * (x.n + y.n - i)
), links AS (
    SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
), components AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM components LEFT JOIN sizes USING (doc_id)
"""

_VECTORS = """
WITH RECURSIVE sound AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), pairs AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.95
), reach AS (
    SELECT vec_id, vec_id AS other FROM sound
    UNION SELECT reach.vec_id, pairs.b FROM reach JOIN pairs ON pairs.a = reach.other
), components AS (
    SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), counts AS (
    SELECT a AS vec_id, count(*) AS n FROM pairs GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM components LEFT JOIN counts USING (vec_id)
"""

_WARC = """
WITH bodies AS (
    SELECT page_id, url, coalesce(html, '') AS body FROM pages
), digests AS (
    SELECT page_id, url, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM bodies
), last AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response FROM digests
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND page_id < response THEN response END AS refers_to, url
FROM last
"""

ORACLE: dict[str, str] = {
    "op2_chat_format": _CHATS,
    "op6_minmax_near_dedup": _SETS,
    "op7_subspace_pigeonhole": _VECTORS,
    "op9_warc_revisits": _WARC,
}

# crc32 is linear over bytes: ``place`` says what a byte adds by its distance from the
# end, ``start`` what a text of so many bytes begins with.
ORACLE["op11_bloom_variants"] = r"""
WITH RECURSIVE
tab AS (
  SELECT b, list_reduce(
    list_prepend(b::BIGINT, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM range(256) r(b)
),
runs AS (
  SELECT id, run, count(*) AS times FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL
),
sized AS (SELECT *, id || ':' || run AS said, octet_length(encode(id || ':' || run)) AS size FROM runs),
bytes AS (
  SELECT id, run, size - i AS p, ('0x' || substr(hex(encode(said)), 2 * i - 1, 2))::INTEGER AS b
  FROM (SELECT *, unnest(range(1, size + 1)) AS i FROM sized)
),
longest AS (SELECT max(size) AS n FROM sized),
place AS (
  SELECT 0 AS p, b, v FROM tab
  UNION ALL
  SELECT place.p + 1, place.b, xor(place.v // 256, tab.v)
  FROM place JOIN tab ON tab.b = place.v % 256, longest WHERE place.p + 1 < longest.n
),
start AS (
  SELECT 0 AS size, 4294967295 AS r
  UNION ALL
  SELECT start.size + 1, xor(start.r // 256, tab.v)
  FROM start JOIN tab ON tab.b = start.r % 256, longest WHERE start.size < longest.n
),
crcs AS (SELECT id, run, bit_xor(v) AS x FROM bytes JOIN place USING (p, b) GROUP BY id, run),
words AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times
  FROM (
    SELECT run, times, xor(xor(x, r), 4294967295) AS h
    FROM sized JOIN crcs USING (id, run) JOIN start USING (size))
),
vocabulary AS (
  SELECT word, sum(times)::BIGINT AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
),
spots AS (SELECT word, n, unnest(range(length(word))) AS i FROM vocabulary),
replaced AS (SELECT word, n, left(word, i) || chr(1) || substr(word, i + 2) AS shape FROM spots),
deleted AS (SELECT DISTINCT word, n, left(word, i) || substr(word, i + 2) AS shorter FROM spots),
one AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM replaced a JOIN replaced b ON a.shape = b.shape AND a.word <> b.word
  UNION ALL
  SELECT d.word, v.word, v.n FROM deleted d JOIN vocabulary v ON d.shorter = v.word
  UNION ALL
  SELECT v.word, d.word, d.n FROM deleted d JOIN vocabulary v ON d.shorter = v.word
),
best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM one GROUP BY word
),
told AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n
  FROM vocabulary v LEFT JOIN best USING (word)
),
chain AS (
  SELECT word, word AS root, form AS onward FROM told
  UNION ALL
  SELECT chain.word, told.word, told.form FROM chain JOIN told ON chain.onward = told.word
)
SELECT told.word, n, n_near, form, form_n, root FROM told JOIN chain ON chain.word = told.word AND chain.onward IS NULL
"""

ORACLE["op13_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
counts AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f
  FROM spots, range(1, 6) s(k) WHERE i + k - 1 <= len(w)
  GROUP BY ALL HAVING count(*) >= 100
),
longer AS (
  SELECT lang, unnest([array_to_string(w[1:k - 1], ' '), array_to_string(w[2:k], ' ')]) AS phrase, f
  FROM (SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE k >= 3)
),
candidates AS (
  SELECT * FROM counts c WHERE k >= 2
  AND NOT EXISTS (SELECT 1 FROM longer o WHERE o.lang = c.lang AND o.phrase = c.phrase AND o.f = c.f)
),
cuts AS (
  SELECT lang, phrase, f AS a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:k], ' ') AS rest
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM candidates)
),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, cut, h.f AS l, r.f AS r, n,
    (1000::HUGEINT * a * n) // (h.f::HUGEINT * r.f) AS score
  FROM cuts JOIN totals USING (lang)
  JOIN counts h ON h.lang = cuts.lang AND h.phrase = cuts.head
  JOIN counts r ON r.lang = cuts.lang AND r.phrase = cuts.rest
),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""
