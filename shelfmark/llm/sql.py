"""Expected results of the queries, where SQL can express them."""

from __future__ import annotations

from shelfmark.llm.quality import PRIOR, RULES, SPREAD

_VALUES = ", ".join(
    f"ROW('{n}', coalesce(1000 * {r.part} // nullif({r.whole}, 0), 0), {r.part}, {r.whole}, {r.least}, {r.excess}, {r.low})"
    for n, r in RULES.items()
)

OP1 = rf"""
WITH t AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS body,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), windows AS (
    SELECT doc_id, i, len(w) AS n, count(*) OVER (PARTITION BY doc_id, w[i:i + 4]) AS times
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t)
), repeats AS (
    SELECT doc_id, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM windows WHERE times > 1) GROUP BY ALL
), lines AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM t)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL
), m AS (
    SELECT doc_id, lang, source, len(w) AS n_words,
           length(array_to_string(w, '')) AS word_chars,
           len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols,
           len(regexp_extract_all(body, '[A-Z]')) AS n_capitals,
           len(regexp_extract_all(body, '[!-/:-@\[-`{{-~]')) AS n_marks,
           coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM t LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
), b AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), v AS (
    SELECT doc_id, lang, source, base_failed, unnest([{_VALUES}]) AS r FROM b
), x AS (
    SELECT doc_id, lang, source, base_failed, r[1] AS rule, r[3] AS part, r[4] AS whole, r[5] AS least,
           r[6] AS excess, r[7] AS low,
           r[2] - r[2] % (1::BIGINT << greatest(length(bin(r[2])) - 6, 0)) AS edge
    FROM v
), g AS (
    SELECT 0 AS level, lang, source, rule, edge, least, low FROM x WHERE NOT base_failed
    UNION ALL SELECT 1, lang, NULL, rule, edge, least, low FROM x WHERE NOT base_failed
    UNION ALL SELECT 2, NULL, NULL, rule, edge, least, low FROM x WHERE NOT base_failed
), f AS (
    SELECT level, lang, source, rule, n,
           CASE WHEN low THEN greatest(q1 - {SPREAD} * greatest(q3 - q1, least), 0)
                ELSE q3 + {SPREAD} * greatest(q3 - q1, least) END AS cut
    FROM (SELECT level, lang, source, rule, count(*) AS n, any_value(least) AS least, any_value(low) AS low,
                 quantile_disc(edge, 0.25) AS q1, quantile_disc(edge, 0.75) AS q3 FROM g GROUP BY ALL)
), judged AS (
    SELECT x.doc_id, x.rule,
           CASE WHEN x.low THEN (f0.n * f0.cut + {PRIOR} * ((f1.n * f1.cut + {PRIOR} * f2.cut) // (f1.n + {PRIOR})))
                                // (f0.n + {PRIOR}) * x.whole - 1000 * x.part <= 1000 * x.excess
                ELSE 1000 * x.part - (f0.n * f0.cut + {PRIOR} * ((f1.n * f1.cut + {PRIOR} * f2.cut) // (f1.n + {PRIOR})))
                                // (f0.n + {PRIOR}) * x.whole <= 1000 * x.excess END AS ok
    FROM x
    JOIN f f0 ON f0.level = 0 AND f0.rule = x.rule AND f0.lang IS NOT DISTINCT FROM x.lang
                  AND f0.source IS NOT DISTINCT FROM x.source
    JOIN f f1 ON f1.level = 1 AND f1.rule = x.rule AND f1.lang IS NOT DISTINCT FROM x.lang
    JOIN f f2 ON f2.level = 2 AND f2.rule = x.rule
), fine AS (
    SELECT doc_id, bool_and(ok) AS ok FROM judged GROUP BY doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(ok, true) AS kept
FROM b LEFT JOIN fine USING (doc_id)
"""

OP7 = """
WITH t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS at_, role, text
    FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
), c AS (
    SELECT conv_id, list(ROW(role, text) ORDER BY at_) AS turns, count(*) AS n FROM t GROUP BY conv_id
), maximal AS (
    SELECT min(conv_id) AS conv_id, n, turns FROM c GROUP BY n, turns
), kept AS (
    SELECT m.conv_id, m.n FROM maximal m
    WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n > m.n AND c.turns[1] = m.turns[1] AND c.turns[1:m.n] = m.turns)
)
SELECT conv_id, at_ AS at, n AS n_turns,
       '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10)
       AS rendered
FROM t JOIN kept USING (conv_id)
"""

_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"

OP10 = rf"""
WITH rules(rule_host, rule_path, verdict) AS (
    VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
           ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), p AS (
    SELECT page_id, {_HOST} AS host, {_PATH} AS path, row_number() OVER () AS row_no,
           nullif(list_last(string_split(split_part(html, '</article>', 1), '<article>')), '') AS body,
           contains(html, '</article>') AND contains(split_part(html, '</article>', 1), '<article>') AS has_body
    FROM (SELECT page_id, url, html::VARCHAR AS html FROM pages)
), k AS (
    SELECT *, regexp_replace(host, '^(www|m|blog)\.', '') || regexp_replace(path, '(\.html?|/+)$', '') AS key,
           list_has_any(string_split(host, '.'),
                        ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) AS known
    FROM p
), listed AS (
    SELECT DISTINCT key FROM k
    WHERE host <> '' AND (known OR (has_body AND body IN (SELECT body FROM k WHERE known AND has_body AND body IS NOT NULL)))
), fit AS (
    SELECT row_no, rule_host || rule_path AS rule, verdict,
           row_number() OVER (PARTITION BY row_no ORDER BY length(rule_host || rule_path) DESC) AS place
    FROM k JOIN rules
      ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, fit.rule,
       coalesce(fit.verdict, CASE WHEN host <> '' AND key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END)
       AS verdict
FROM k LEFT JOIN fit ON fit.row_no = k.row_no AND place = 1
"""

_TOKENS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = f"""
WITH items AS (
    SELECT item_id, {_TOKENS} AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, array_to_string(w[i:i + n - 1], ' ') AS win, n
    FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
          FROM items WHERE len(w) > 0)
), d AS (
    SELECT doc_id, {_TOKENS} AS w FROM documents
), occurrences AS (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
          FROM d CROSS JOIN (SELECT DISTINCT n FROM windows))
), met AS (
    SELECT doc_id, i, o.n, item_id FROM occurrences o JOIN windows w ON o.win = w.win AND o.n = w.n
), hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY 1
), ids AS (
    SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM met GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
       sha256(array_to_string(coalesce(ids, []), ',')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

OP13 = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), w AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
), occurrences AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w CROSS JOIN range(1, 6) AS ks(k))
), f AS (
    SELECT lang, phrase, k, count(*) AS a FROM occurrences GROUP BY ALL HAVING count(*) >= 100
), held AS (
    SELECT DISTINCT lang, a, unnest([array_to_string(p[:k - 1], ' '), array_to_string(p[2:], ' ')]) AS phrase
    FROM (SELECT lang, a, k, string_split(phrase, ' ') AS p FROM f WHERE k > 2)
), cuts AS (
    SELECT lang, phrase, a, c, array_to_string(p[:c], ' ') AS x, array_to_string(p[c + 1:], ' ') AS y
    FROM (SELECT lang, phrase, a, string_split(phrase, ' ') AS p, unnest(range(1, k)) AS c
          FROM f ANTI JOIN held USING (lang, phrase, a) WHERE k > 1)
), scored AS (
    SELECT cuts.lang, cuts.phrase, cuts.a, c, x.a AS l, y.a AS r, t.n,
           ((1000::HUGEINT * cuts.a * t.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
    FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.x
    JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.y JOIN totals t ON t.lang = cuts.lang
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""
