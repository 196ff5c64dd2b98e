"""DuckDB SQL of the queries that SQL expresses, over the same tables."""

from __future__ import annotations

LLM_ORACLE: dict[str, str] = {}

LLM_ORACLE["op10_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
    FROM documents
), keyed AS (
    SELECT doc_id, pos, line,
           translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), frequent AS (
    SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (key)
GROUP BY doc_id
"""

LLM_ORACLE["op9_decontaminate"] = r"""
WITH docs AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
    FROM documents
), items AS (
    SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
    FROM benchmark
), cut AS (
    SELECT item_id, words, least(13, len(words)) AS size, unnest(range(len(words) - least(13, len(words)) + 1)) AS beg
    FROM items WHERE len(words) > 0
), wanted AS (
    SELECT DISTINCT item_id, size, list_slice(words, beg + 1, beg + size) AS seq FROM cut
), sizes AS (
    SELECT DISTINCT size FROM wanted
), doc_windows AS (
    SELECT doc_id, size, words, unnest(range(len(words) - size + 1)) AS beg FROM docs, sizes WHERE len(words) >= size
), hits AS (
    SELECT d.doc_id, d.beg, d.size, w.item_id
    FROM (SELECT doc_id, beg, size, list_slice(words, beg + 1, beg + size) AS seq FROM doc_windows) d JOIN wanted w USING (size, seq)
), hit_words AS (
    SELECT doc_id, count(DISTINCT pos) AS n_hit
    FROM (SELECT doc_id, unnest(range(beg, beg + size)) AS pos FROM (SELECT DISTINCT doc_id, beg, size FROM hits))
    GROUP BY doc_id
), hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

LLM_ORACLE["op7_substring_dedup"] = r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), cut AS (
    SELECT doc_id, words, unnest(range(len(words) - 19)) AS beg FROM docs WHERE len(words) >= 20
), hashed AS (
    SELECT doc_id, beg, md5(array_to_string(list_slice(words, beg + 1, beg + 20), ' ')) AS seq FROM cut
), ranked AS (
    SELECT doc_id, beg, row_number() OVER (PARTITION BY seq ORDER BY doc_id, beg) AS n FROM hashed
), gone AS (
    SELECT doc_id, list(DISTINCT pos) AS removed
    FROM (SELECT doc_id, unnest(range(beg, beg + 20)) AS pos FROM ranked WHERE n > 1) GROUP BY doc_id
), words AS (
    SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM docs
), kept AS (
    SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.pos) AS kept
    FROM words w LEFT JOIN (SELECT doc_id, unnest(removed) AS pos FROM gone) g ON w.doc_id = g.doc_id AND w.pos = g.pos
    WHERE g.pos IS NULL GROUP BY w.doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(removed), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

LLM_ORACLE["op6_zip_archives"] = """
WITH rows AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM rows
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id = page_id THEN NULL ELSE first_id END AS refers_to
FROM firsts
"""

LLM_ORACLE["op8_chat_events"] = r"""
WITH turns AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
    SELECT *, length(regexp_replace(replace(text, '\', '\\'),
        '(<)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|s>|/s>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])', '\1\3\\\2\4', 'g')) AS escaped
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(escaped + length(role) + 24) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

LLM_ORACLE["op11_ranked_search"] = r"""
WITH words AS (
    SELECT row_number() OVER () AS doc, doc_id,
           unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), lengths AS (
    SELECT doc, doc_id, count(*) AS n FROM words GROUP BY doc, doc_id
), totals AS (
    SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths
), sized AS (
    SELECT doc, doc_id, 50 + (50 * n * n_docs) // n_terms AS m FROM lengths, totals
), counted AS (
    SELECT doc, term, count(*) AS tf FROM words GROUP BY doc, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), totals
), items AS (
    SELECT DISTINCT item_id, text, term
    FROM (SELECT item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
), scores AS (
    SELECT item_id, text, doc, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
    FROM items JOIN counted USING (term) JOIN weights USING (term) JOIN sized USING (doc)
    GROUP BY item_id, text, doc, doc_id
), ranked AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
    FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

LLM_ORACLE["op13_spelling_variants"] = r"""
WITH RECURSIVE steps(byte, c, k) AS (
    SELECT range, range, 0 FROM range(256)
    UNION ALL
    SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), checksums AS (
    SELECT list(c ORDER BY byte) AS cs FROM steps WHERE k = 8
), runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM documents
), pairs AS (
    SELECT doc_id, run, count(*) AS c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS digits FROM runs GROUP BY doc_id, run
), marked AS (
    SELECT run, c, xor(4294967295, list_reduce(
               list_prepend(4294967295, list_transform(range(len(digits) // 2),
                   lambda i: CAST(instr('0123456789ABCDEF', digits[2 * i + 1]) * 16 + instr('0123456789ABCDEF', digits[2 * i + 2]) - 17 AS BIGINT))),
               lambda h, b: xor(h >> 8, cs[(xor(h, b) & 255) + 1]))) AS h
    FROM pairs, checksums
), words AS (
    SELECT word, CAST(sum(c) AS BIGINT) AS n
    FROM (SELECT CASE WHEN h % 97 = 0 THEN run[:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, c FROM marked)
    GROUP BY word HAVING len(word) >= 5 AND sum(c) >= 3
), places AS (
    SELECT word, n, unnest(range(len(word) + 1)) AS i FROM words
), patterns AS (
    SELECT word, n, word[:i] || '*' || word[i + 1:] AS pattern FROM places
    UNION ALL SELECT word, n, word[:i] || '*' || word[i + 2:] FROM places WHERE i < len(word)
), near AS (
    SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM patterns a JOIN patterns b USING (pattern) WHERE a.word <> b.word
), forms AS (
    SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word, n
), judged AS (
    SELECT word, CASE WHEN other_n >= 2 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
    FROM words LEFT JOIN forms USING (word, n)
), chains AS (
    SELECT word, word AS root, form AS next FROM judged
    UNION ALL
    SELECT c.word, j.word, j.form FROM chains c JOIN judged j ON j.word = c.next
)
SELECT j.word, j.form, c.root, j.n, j.n_near, j.form_n FROM judged j JOIN chains c ON c.word = j.word AND c.next IS NULL
"""
