"""DuckDB SQL for the operators that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS d FROM x GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM x JOIN f USING (h) WHERE d < doc_id),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL)
          JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_NORMALISED = r"trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'))"

QUOTATIONS = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, * FROM conversations),
l AS (SELECT id, conv_id, turn, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT *, regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n') AS ls FROM m)),
p AS (SELECT *, regexp_extract(line, '^((?:[ \t]*>)+)', 1) AS mark FROM l),
q AS (SELECT id, conv_id, turn, i, len(mark) - len(replace(mark, '>', '')) AS level, substr(line, len(mark) + 1) AS body FROM p),
g AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY i) AS run FROM (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY id ORDER BY i) = level THEN 0 ELSE 1 END AS new FROM q)),
runs AS (SELECT id, conv_id, turn, run, any_value(level) AS level, string_agg(body, ' ' ORDER BY i) AS body, list(body ORDER BY i) AS bodies FROM g GROUP BY id, conv_id, turn, run),
own AS (SELECT id, conv_id, turn, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE level = 0), ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS text FROM q GROUP BY id, conv_id, turn),
wrote AS (SELECT conv_id, turn, text AS unit FROM own UNION SELECT conv_id, turn, body FROM runs WHERE level = 0
          UNION SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\n[\x20\x09]*\n')) FROM own UNION SELECT conv_id, turn, unnest(string_split(text, chr(10))) FROM own),
origins AS (SELECT conv_id, {_NORMALISED.format('unit')} AS unit, min(turn) AS origin FROM wrote WHERE turn IS NOT NULL GROUP BY ALL),
quotes AS (SELECT DISTINCT id, conv_id, turn, level, body, bodies FROM runs WHERE level > 0),
asked AS (SELECT id, conv_id, turn, level, bodies, 1 AS whole, body AS unit FROM quotes UNION ALL SELECT id, conv_id, turn, level, bodies, 0, unnest(bodies) FROM quotes),
found AS (SELECT a.*, origin FROM asked a JOIN origins o ON o.conv_id = a.conv_id AND o.unit = {_NORMALISED.format('a.unit')} AND o.unit <> '' AND origin < turn),
links AS (SELECT id, count(DISTINCT {{'l': level, 'b': bodies}}) AS n_linked, (max({{'w': whole, 'o': origin}}) FILTER (WHERE level = 1)).o AS reply_to FROM found GROUP BY id),
e AS (SELECT DISTINCT conv_id, turn, reply_to FROM m JOIN links USING (id) WHERE reply_to IS NOT NULL),
up AS (SELECT conv_id, turn, reply_to AS thread FROM e UNION SELECT up.conv_id, up.turn, e.reply_to FROM up JOIN e ON e.conv_id = up.conv_id AND e.turn = up.thread),
root AS (SELECT conv_id, turn, min(thread) AS thread FROM up GROUP BY ALL),
t AS (SELECT m.conv_id, m.turn, m.role, coalesce(n.n, 0)::BIGINT AS n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked, reply_to, coalesce(thread, m.turn) AS thread,
      '<|' || coalesce(m.role, 'unknown') || '|>' || chr(10) || own.text AS message
      FROM m JOIN own USING (id) LEFT JOIN (SELECT id, count(*) AS n FROM quotes GROUP BY id) n USING (id) LEFT JOIN links USING (id) LEFT JOIN root ON root.conv_id = m.conv_id AND root.turn = m.turn)
SELECT conv_id, turn, role, n_quotes, n_linked, reply_to, thread, (row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn, role, message) - 1)::BIGINT AS position, message FROM t
"""

WARC = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, upper(sha1(html)) AS hex, max(page_id) OVER (PARTITION BY html) AS response FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || hex[(i // 4) * 5 + 1:(i // 4) * 5 + 5])::INTEGER >> ((3 - i % 4) * 5)::INTEGER) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to, url
FROM d
"""

EXACT = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256 FROM d
"""

FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents),
c AS (SELECT *, len(units) AS n, list_transform(range(4), lambda i: ('0x' || h[8 * i + 1:8 * i + 8])::BIGINT) AS draws FROM d),
p AS (SELECT *, least(draws[1] % (n + 1), draws[2] % (n + 1)) AS low, greatest(draws[1] % (n + 1), draws[2] % (n + 1)) AS high,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR draws[3] % 100 >= 100 THEN 'plain'
                  WHEN draws[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
o AS (SELECT *, array_to_string(units[1:low], '') AS prefix, array_to_string(units[low + 1:high], '') AS middle, array_to_string(units[high + 1:], '') AS suffix FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM o
"""

# A step of the recursion takes one row of every conversation, from the last to the first. For each of the states nothing yet,
# after system, after user, after assistant it holds the cost to the end, the audit from here and the repaired text from here.
_STATES = range(4)
_NEXT, _KEEP = (2, 2, 3, 2), ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})


def _repair_step() -> str:
    made = {2: "user:", 3: "assistant:"}

    def edit(letter: str, cost: str, to: int, text: str) -> str:
        return f"{{'c': v[{to + 1}].c + {cost}, 'a': '{letter}' || v[{to + 1}].a, 't': {text} || v[{to + 1}].t}}"

    own = []
    for q in _STATES:
        options = [edit("D", "4", q, "''")]
        options += [f"CASE WHEN NOT must AND left(role, 1) = '{x}' THEN {edit('K', '3 * cut', to, 'chr(10) || role || chr(58) || text')} END" for x, to in _KEEP[q].items()]
        options.append(f"CASE WHEN NOT must THEN {edit('R', '3 + 3 * cut', _NEXT[q], f'chr(10) || {made[_NEXT[q]]!r} || text')} END")
        own.append(f"list_min(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))")
    inserted = [f"list_min([b[{q + 1}], {{'c': b[{_NEXT[q] + 1}].c + 3, 'a': 'I' || b[{_NEXT[q] + 1}].a, 't': chr(10) || {made[_NEXT[q]]!r} || b[{_NEXT[q] + 1}].t}}])" for q in _STATES]
    step = f"SELECT conv, k, [{', '.join(own)}] AS b FROM todo"
    for _ in range(3):
        step = f"SELECT conv, k, [{', '.join(inserted)}] AS b FROM ({step})"
    return step


_CRC_TABLE = "list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n))"
_END = "[{'c': 0, 'a': '', 't': ''}, {'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}, {'c': 3, 'a': 'I', 't': chr(10) || 'assistant:'}, {'c': 0, 'a': '', 't': ''}]"

REPAIR = rf"""
WITH RECURSIVE t AS (SELECT {_CRC_TABLE} AS crcs),
k AS (SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(c // 256, crcs[xor(c % 256, x) + 1]), 4294967295), 4294967295) % 20 AS kind FROM k, t),
d AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text), copy) AS k, count(*) OVER (PARTITION BY conv) AS n FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN k > min(k) OVER (PARTITION BY conv, role, text) THEN 'duplicate'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY k) AS before FROM r),
g AS (SELECT conv, k, n, role, text, fault IN ('blank', 'duplicate') AS must, (fault = 'truncated')::INTEGER AS cut FROM f),
walk AS (SELECT DISTINCT conv, n + 1 AS k, {_END} AS b FROM g
         UNION ALL (WITH todo AS (SELECT g.*, walk.b AS v FROM walk JOIN g ON g.conv IS NOT DISTINCT FROM walk.conv AND g.k = walk.k - 1) {_repair_step()})),
told AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(b[1].c, 0)::BIGINT AS cost, coalesce(b[1].a, '') AS audit, sha256(coalesce(b[1].t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN told ON told.conv IS NOT DISTINCT FROM e.conv_id LEFT JOIN (SELECT * FROM walk WHERE k = 1) w ON w.conv IS NOT DISTINCT FROM e.conv_id
"""
