"""SQL on another engine for the queries that SQL can express."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

_SPACE = r"[\x20\x09-\x0D]+"


def _lower(text: str) -> str:
    return f"translate({text}, '{ascii_uppercase}', '{ascii_lowercase}')"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_SPACE}'), lambda x: x <> '')"


_KEY = _lower(f"regexp_replace(line, '^{_SPACE}|{_SPACE}$', '', 'g')")

#: Node and smallest node reached, from a table ``links`` (a, b) of links.
_REACHED = """
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (
    SELECT a, b FROM both_ways
    UNION
    SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
reached AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""

OP1 = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM split),
keyed AS (SELECT *, {_KEY} AS key FROM lines),
common AS (
    SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
    SELECT k.*, common.key IS NULL OR k.doc_id = common.top AS stays
    FROM keyed k LEFT JOIN common ON k.key = common.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE NOT stays) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP2 = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_words(_lower("coalesce(text, '')"))} AS w FROM documents),
shingles AS (
    SELECT doc_id, unnest(list_transform(range(greatest(len(w) - 4, 1)),
        lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s
    FROM words WHERE len(w) > 0),
sets AS (SELECT DISTINCT doc_id, s FROM shingles),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
    FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
    SELECT shared.a, shared.b FROM shared
    JOIN sizes p ON p.doc_id = shared.a JOIN sizes q ON q.doc_id = shared.b
    WHERE 100 * shared.n >= 75 * (p.n + q.n - shared.n)),{_REACHED}
SELECT d.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles,
       least(d.doc_id, coalesce(reached.b, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(reached.b, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN reached ON reached.a = d.doc_id
"""

OP5 = f"""
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y
    ON x.label = y.label AND x.vec_id < y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.93),{_REACHED},
counts AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT e.vec_id, CAST(coalesce(counts.n, 0) AS BIGINT) AS n_links,
       least(e.vec_id, coalesce(reached.b, e.vec_id)) AS component_id,
       e.vec_id <= coalesce(reached.b, e.vec_id) AS kept
FROM embeddings e LEFT JOIN counts ON counts.a = e.vec_id LEFT JOIN reached ON reached.a = e.vec_id
"""

OP10 = f"""
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
           {_words("coalesce(text, '')")} AS w FROM documents),
windows AS (
    SELECT doc_id, unnest(range(len(w) - 2)) AS pos,
           unnest(list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1:i + 3], ' '))) AS s
    FROM texts WHERE len(w) > 2),
often AS (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows),
repeated AS (
    SELECT doc_id, count(*) AS n FROM (
        SELECT doc_id, pos FROM often WHERE n > 1
        UNION SELECT doc_id, pos + 1 FROM often WHERE n > 1
        UNION SELECT doc_id, pos + 2 FROM often WHERE n > 1) covered GROUP BY doc_id),
lines AS (
    SELECT doc_id, host, line, {_KEY} AS key, len({_words("line")}) AS words
    FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM texts) split),
doubled AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE words > 0 GROUP BY doc_id),
common AS (
    SELECT host, key FROM lines WHERE words > 0 GROUP BY host, key HAVING count(DISTINCT doc_id) > 20),
removed AS (
    SELECT l.doc_id, sum(l.words) AS n FROM lines l
    JOIN common ON common.host = l.host AND common.key = l.key GROUP BY l.doc_id),
counted AS (
    SELECT texts.doc_id, len(w) AS n_words,
           coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
           length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
           coalesce(doubled.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
           coalesce(removed.n, 0) AS n_removed_words
    FROM texts LEFT JOIN doubled ON doubled.doc_id = texts.doc_id
    LEFT JOIN repeated ON repeated.doc_id = texts.doc_id
    LEFT JOIN removed ON removed.doc_id = texts.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       CAST(n_removed_words AS BIGINT) AS n_removed_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
           AND 100 * (n_words - n_removed_words) >= 30 * n_words AS kept
FROM counted
"""

#: Host rules, the one that decides first, then the patterns as expressions over the lower-cased URL.
_RULES = (
    ("example.org/en/1", "block"), ("example.org/es/", "block"), ("com/de/", "block"),
    ("com/fr/", "allow"), ("org/", "allow"),
)
_END = "([^a-z0-9_.%-]|$)"
_AT_LABEL = "^[^:/?#]*://([^/?#]*[.])?"
_EXCEPT = {"@@||docs.": f"{_AT_LABEL}docs[.]", "@@^wiki^": f"{_END}wiki{_END}"}
_BLOCKED = {
    **{f"||{host}.": f"{_AT_LABEL}{host}[.]" for host in ("spam-farm", "casino", "adserver", "ads")},
    **{f"^{word}^": f"{_END}{word.replace('.', '[.]')}{_END}" for word in (
        "casino", "porn", "xxx", "viagra", "ads", "login", "signin", "logout", "cart", "checkout",
        "wp-admin", "wp-login.php", "cgi-bin", "phpsessid", "sessionid")},
    **{f".{kind}|": f"[.]{kind}$" for kind in ("jpg", "png", "gif", "zip", "exe", "mp4")},
    "-pills.": "-pills[.]", "?replytocom=": "[?]replytocom=",
    "^download^*.pdf|": f"{_END}download{_END}.*[.]pdf$", "^tag^*^feed^": f"{_END}tag{_END}.*{_END}feed{_END}",
}


def _fitting(expressions: dict[str, str]) -> str:
    cases = " ".join(f"WHEN regexp_matches(low, '{expressions[text]}', 's') THEN '{text}'"
                     for text in sorted(expressions))
    return f"CASE {cases} END"


def _rule(column: int) -> str:
    cases = " ".join(
        f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
        f" THEN '{(text, verdict)[column]}'"
        for text, verdict in _RULES for host, _, path in (text.partition("/"),))
    return f"CASE {cases} END"


OP11 = f"""
WITH parts AS (
    SELECT page_id, coalesce({_lower("url")}, '') AS low,
           coalesce({_lower("regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host,
           coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages),
judged AS (
    SELECT *, {_rule(0)} AS rule, {_rule(1)} AS ruled, {_fitting(_EXCEPT)} AS excepted,
           {_fitting(_BLOCKED)} AS blocked
    FROM parts)
SELECT page_id, host, path, rule, coalesce(excepted, blocked) AS pattern,
       CASE WHEN ruled IS NOT NULL THEN ruled WHEN excepted IS NULL AND blocked IS NOT NULL THEN 'block'
            ELSE 'allow' END AS verdict
FROM judged
"""

OP12 = f"""
WITH pieces AS (
    SELECT lang, pieces, unnest(pieces) AS piece, unnest(range(len(pieces))) AS at, doc
    FROM (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
                 regexp_split_to_array({_lower("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]') AS pieces
          FROM documents) split),
worded AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
phrases AS (
    SELECT lang, size, unnest(list_transform(range(greatest(len(w) - size + 1, 0)),
               lambda i: array_to_string(w[i + 1:i + size], ' '))) AS phrase
    FROM worded, (SELECT unnest(range(1, 6)) AS size) sizes),
counted AS (SELECT lang, size, phrase, count(*) AS f FROM phrases GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, f AS a FROM counted WHERE size > 1 AND f >= 100),
cuts AS (
    SELECT c.*, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS first_part,
           array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
    FROM candidates c, (SELECT unnest(range(1, 5)) AS k) ks WHERE k < size),
scored AS (
    SELECT c.lang, c.size, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n,
           (CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
    FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.first_part
    JOIN counted y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang),
lowest AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place
                   FROM scored) placed WHERE place = 1),
left_in AS (
    SELECT * FROM lowest s WHERE NOT EXISTS (
        SELECT 1 FROM candidates c WHERE c.lang = s.lang AND c.size > s.size AND 100 * c.a >= 100 * s.a
        AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' '))),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_in)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

ORACLE: dict[str, str] = {
    "op1_line_dedup": OP1, "op2_minhash": OP2, "op5_embeddings": OP5, "op10_quality": OP10,
    "op11_url_filters": OP11, "op12_collocations": OP12,
}
