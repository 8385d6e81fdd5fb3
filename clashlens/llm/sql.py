"""DuckDB twins of the operators that SQL can express, written apart from the operators' own method."""

from __future__ import annotations

from html.entities import html5

_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n + b.n) AS n, count(*) AS i
      FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * i >= 85 * (n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT doc_id, any_value(len(s.s))::BIGINT AS n_shingles, min(c) AS component_id FROM s JOIN r USING (doc_id) GROUP BY doc_id
"""

_WORDS = rf"coalesce(regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

OP3 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS x
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS x
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.k, dw.n, iw.item_id FROM dw JOIN iw USING (n, x)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def _op11() -> str:
    """The cheapest edits by a table over all prefixes: per state a text of eight cost digits and the audit, '~' for none."""
    def add(v: str, cost: str, letter: str) -> str:
        return f"CASE WHEN {v} = '~' THEN '~' ELSE printf('%08d', left({v}, 8)::INT + {cost}) || substr({v}, 9) || '{letter}' END"

    none, a = "'~'", [f"acc[{k}]" for k in (1, 2, 3, 4)]
    pen = "CASE WHEN x.f = 3 THEN 5 ELSE 0 END"
    may = "x.f IN (0, 3)"
    insert = f"[{a[0]}, {a[1]}, least({a[2]}, {add(a[0], '5', 'I')}, {add(a[1], '5', 'I')}, {add(a[3], '5', 'I')}), least({a[3]}, {add(a[2], '5', 'I')})]"
    keep = lambda i, v: f"CASE WHEN {may} AND x.i = '{i}' THEN {add(v, pen, 'K')} ELSE {none} END"
    other = lambda v: f"CASE WHEN {may} THEN {add(v, f'1 + {pen}', 'R')} ELSE {none} END"
    row = (f"[{add(a[0], '2', 'D')}, least({add(a[1], '2', 'D')}, {keep('s', a[0])}), "
           f"least({add(a[2], '2', 'D')}, {', '.join(f'{keep(chr(117), a[k])}, {other(a[k])}' for k in (0, 1, 3))}), "
           f"least({add(a[3], '2', 'D')}, {keep('a', a[2])}, {other(a[2])})]")
    edge = "{'f': 9, 'i': '', 'role': '', 'text': ''}"
    new_role, line = "CASE WHEN acc.s = 2 THEN 'assistant' ELSE 'user' END", "CASE WHEN acc.s = 0 THEN '' ELSE chr(10) END"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH bits AS (SELECT [list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, n::BIGINT) FOR n IN range(256)] AS tab),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             [ascii(c)::BIGINT FOR c IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')] AS place FROM conversations),
k AS (SELECT o.*, xor(list_reduce(place, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS code FROM o, bits),
d AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
             CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE code <> 0),
m AS (SELECT *, sha256(len(role) || ':' || role || text) AS digest, right(rtrim(text, {blanks}), 1) AS last,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM d),
f AS (SELECT *, left(role, 1) AS i, CASE WHEN last = '' THEN 1 WHEN nth > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest, nth) AS before FROM m),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE f = 1) AS blank,
             count(*) FILTER (WHERE f = 2) AS duplicate, count(*) FILTER (WHERE f = 3) AS truncated,
             count(*) FILTER (WHERE before || i NOT IN ('su', 'ua', 'au')) AS illegal,
             list({{'f': f, 'i': i, 'role': role, 'text': text}} ORDER BY turn NULLS FIRST, digest, nth) AS turns FROM f GROUP BY conv_id),
t AS (SELECT *, list_reduce(flatten([[{edge}, {edge}, r] FOR r IN turns]) || [{edge}, {edge}],
                            lambda acc, x: CASE WHEN x.f = 9 THEN {insert} ELSE {row} END, ['00000000', '~', '~', '~']) AS ways FROM c),
b AS (SELECT *, least(ways[1], ways[4]) AS way FROM t),
e AS (SELECT *, left(way, 8)::BIGINT AS cost, substr(way, 9) AS audit FROM b),
p AS (SELECT *, list_reduce(string_split(audit, ''), lambda acc, x: CASE x
        WHEN 'D' THEN {{'p': acc.p + 1, 's': acc.s, 'o': acc.o}}
        WHEN 'I' THEN {{'p': acc.p, 's': CASE WHEN acc.s = 2 THEN 3 ELSE 2 END, 'o': acc.o || {line} || {new_role} || ':'}}
        WHEN 'R' THEN {{'p': acc.p + 1, 's': CASE WHEN acc.s = 2 THEN 3 ELSE 2 END, 'o': acc.o || {line} || {new_role} || ':' || turns[acc.p + 1].text}}
        WHEN 'K' THEN {{'p': acc.p + 1, 's': CASE turns[acc.p + 1].i WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END,
                        'o': acc.o || {line} || turns[acc.p + 1].role || ':' || turns[acc.p + 1].text}}
        ELSE acc END, {{'p': 0, 's': 0, 'o': ''}}).o AS said FROM e)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN p ON a.conv_id IS NOT DISTINCT FROM p.conv_id
"""


_TERMS = rf"coalesce(regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])"

OP12 = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
g AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS docs, sum(len(w))::BIGINT AS words FROM d),
t AS (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
qw AS (SELECT item_id, term, count(*) AS k, any_value(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)))::BIGINT AS w
       FROM q JOIN f USING (term), g GROUP BY item_id, term),
s AS (SELECT item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words))))::BIGINT AS score
      FROM qw JOIN p USING (term), g GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""


def _decoded(text: str) -> str:
    """Entities with a name of the standard's table, or a number, one by one; other text between them as it is."""
    literal = lambda x: "'" + x.replace("'", "''") + "'"
    names = [k for k in html5 if not any(ord(c) < 32 for c in html5[k])]
    known = f"map([{', '.join(literal('&' + k) for k in names)}], [{', '.join(literal(html5[k]) for k in names)}])"
    parts = f"regexp_extract_all({text}, '&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[a-zA-Z0-9]+;?|[^&]+|&')"
    number = "CASE WHEN lower(left(p, 3)) = '&#x' THEN chr(('0x' || rtrim(substr(p, 4), ';'))::INT) ELSE chr(rtrim(substr(p, 3), ';')::INT) END"
    return f"array_to_string([CASE WHEN p LIKE '&#%' AND len(p) > 2 THEN {number} WHEN left(p, 1) = '&' THEN coalesce({known}[p], p) ELSE p END FOR p IN {parts}], '')"


def _plain(html: str) -> str:
    drop = lambda x, pattern, to="''": f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    for name in ("script", "style", "head"):
        html = drop(html, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>")
    html = drop(html, "(?s)<!--.*?-->")
    html = drop(html, r"(?i)</?(p|div|br|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|table|section|article|header|footer|nav|aside|main|body|html|pre|blockquote)\b[^>]*>", "chr(10)")
    html = drop(html, r"(?i)</?t[dh]\b[^>]*>", "' '")
    html = _decoded(drop(html, "<[a-zA-Z/!][^>]*>"))
    lines = f"string_split(translate({html}, chr(9) || chr(12) || chr(13) || chr(160), '    '), chr(10))"
    return f"array_to_string([w FOR w IN [trim(regexp_replace(v, ' +', ' ', 'g')) FOR v IN {lines}] IF w <> ''], chr(10))"


def _record_id(text: str) -> str:
    h = f"md5({text})"
    cut = " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"('<urn:uuid:' || {cut} || '>')"


def _op6() -> str:
    nl, end = "chr(10)", "chr(13) || chr(10)"
    one_line = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    title = _decoded("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title', 1)")
    lang = "regexp_extract(html, '(?i)<html[^>]*\\blang=\"([^\"]*)\"', 1)"
    meta = (f"'source-headers: ' || replace(left(http, length(http) - 2), {end}, {end} || ' ') || {end} || 'source-block-digest: ' || block_digest || {end}"
            f" || 'source-payload-digest: ' || payload_digest || {end} || 'title: ' || {one_line(title)} || {end} || 'language: ' || {one_line(lang)} || {end}")
    line = lambda k, c: f"coalesce('{k}: ' || {c}::VARCHAR || {end}, '')"
    fields = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Target-URI", "target_uri"),
              ("WARC-Refers-To", "refers_to"), ("WARC-Block-Digest", "record_digest"), ("WARC-Source-Payload-Digest", "source_digest"),
              ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    served = f"'HTTP/1.1 200 OK' || {end} || 'Content-Type: text/html; charset=utf-8' || {end} || 'Content-Length: ' || strlen(html) || {end}"
    resp_text = f"'response' || {nl} || coalesce(target, '') || {nl} || coalesce(page_id::VARCHAR, '') || {nl} || block_digest"
    return f"""
WITH p AS (SELECT page_id, regexp_replace(url, '[\\r\\n]+', '', 'g') AS target, coalesce(html, '') AS html FROM pages),
q AS (SELECT *, {served} AS http FROM p),
r AS (SELECT *, 'sha256:' || sha256(html) AS payload_digest, 'sha256:' || sha256(http || {end} || html) AS block_digest FROM q),
s AS (SELECT *, {_record_id(resp_text)} AS response_id FROM r),
k AS (SELECT page_id, 'metadata' AS record_type, target, response_id, 'application/warc-fields' AS content_type, NULL AS source_digest, {meta} AS block FROM s
      UNION ALL
      SELECT page_id, 'conversion', target, response_id, 'text/plain; charset=utf-8', payload_digest, {_plain('html')} FROM s),
f AS (SELECT page_id, record_type, {_record_id(f"record_type || {nl} || response_id")} AS record_id, response_id AS refers_to, target AS target_uri,
             '1970-01-01T00:00:00Z' AS date, content_type, strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS record_digest,
             source_digest::VARCHAR AS source_digest, block FROM k)
SELECT *, 'WARC/1.1' || {end} || {" || ".join(line(k, c) for k, c in fields)} || {end} AS header FROM f
"""


ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": OP2,
    "op3_benchmark_decontamination": OP3,
    "op6_warc_derivatives": _op6(),
    "op11_conversation_repair": _op11(),
    "op12_ranked_lexical_search": OP12,
}
