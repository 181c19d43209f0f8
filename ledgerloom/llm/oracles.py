"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import rules, urltree

#: Levels of the tree of paths that the SQL grows; the tables' paths have fewer.
LEVELS = 6
BLANK = r"[ \t\n\x0B\f\r]+"

#: Counts by words and 8-word windows; lines by host over documents, which id and text tell apart.
OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host, row_number() OVER () AS r FROM documents),
w AS (SELECT r, list_filter(string_split_regex(t, '{BLANK}'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT r, i, string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {rules.WINDOW - 1} FOLLOWING) AS g,
             count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {rules.WINDOW - 1} FOLLOWING) AS k FROM p),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS times FROM g WHERE k = {rules.WINDOW}),
s AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS following FROM c WHERE times > 1),
rep AS (SELECT r, sum(least({rules.WINDOW}, coalesce(following - i, {rules.WINDOW}))) AS n FROM s GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
f AS (SELECT r, line FROM l WHERE regexp_replace(line, '{BLANK}', '', 'g') <> ''),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM f GROUP BY r),
n AS (SELECT DISTINCT host, doc_id, t, trim(regexp_replace(lower(x.line), '{BLANK}', ' ', 'g'), ' ') AS line FROM (SELECT host, doc_id, t, unnest(string_split(t, chr(10))) AS line FROM (SELECT DISTINCT host, doc_id, t FROM d)) x),
nw AS (SELECT host, doc_id, t, line, len(list_filter(string_split_regex(line, '{BLANK}'), lambda x: x <> '')) AS words FROM n),
lw AS (SELECT * FROM nw WHERE words > 0),
fr AS (SELECT host, line FROM lw GROUP BY host, line HAVING count(*) > {rules.LIMIT}),
de AS (SELECT lw.host, lw.doc_id, lw.t, sum(words) AS total, sum(CASE WHEN fr.line IS NOT NULL THEN words ELSE 0 END) AS lost FROM lw LEFT JOIN fr ON fr.host = lw.host AND fr.line = lw.line GROUP BY lw.host, lw.doc_id, lw.t),
b AS (SELECT d.doc_id, d.host, d.t, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)),
j AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(total - lost < {rules.LEFT} AND 2 * lost > total, false) AS kept
FROM j LEFT JOIN de ON de.host = j.host AND de.t = j.t AND de.doc_id IS NOT DISTINCT FROM j.doc_id
"""

#: Every document scored for every item.
OP11 = r"""
WITH low AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
tk AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM low),
d AS (SELECT r, doc_id, len(ts)::HUGEINT AS n, ts FROM tk WHERE len(ts) > 0),
s AS (SELECT count(*)::HUGEINT AS docs, sum(n)::HUGEINT AS every FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM s) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf GROUP BY term),
i AS (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark),
q AS (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i),
m AS (SELECT r, doc_id, (25 + (75 * n * docs) // every)::BIGINT AS m FROM d, s),
x AS (SELECT q.item_id, q.text, m.r, m.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id, r) AS rank FROM x WHERE score > 0) WHERE rank <= 10
"""

OP12 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

#: Every document is sent through every order.
OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS ws FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
        || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
      FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
st AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
e AS (SELECT c.*, filter_order, step, filter_order[step] AS own, len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: contains(fails, y) AND strpos(filter_order, y) < step)) > 0 AS gone, contains(fails, filter_order[step]) AS failing FROM c, st),
r AS (SELECT part, filter_order, step::INTEGER AS step, own, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN gone AND failing THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM e GROUP BY ALL)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""


def op2() -> str:
    rule, said = "NULL", "NULL"
    for text, verdict in sorted(urltree.RULES, key=lambda r: (len(r[0]), r[0])):
        own, _, rest = text.partition("/")
        fits = f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{rest}')"
        rule, said = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{verdict}' ELSE {said} END"
    u, mask = urltree, "CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END"
    sql = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
own AS (SELECT *, {rule} AS rule, {said} AS said, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: {mask}) AS segs FROM hp),
lab AS (SELECT *, (said = 'block')::INT AS label FROM own),
a0 AS (SELECT host, segs, count(*) AS n, count(label) AS labelled, coalesce(sum(label), 0) AS bad, '' AS template FROM lab GROUP BY host, segs)"""
    rate = "round(1000.0::DOUBLE * bad / labelled)::BIGINT"
    share = lambda own, every: f"abs(({own})::DOUBLE / n - (({every}) - ({own}))::DOUBLE / (all_n - n))"
    whole = lambda n, bad: f"((({bad}) + 0.5::DOUBLE) / (({n}) + 1.0::DOUBLE))"
    alike = lambda n, bad, every, worse: f"CASE WHEN {n} > 0 AND {every} - {n} > 0 THEN abs({bad} / {n} - ({worse} - {bad}) / ({every} - {n})) <= {u.ERRORS} * sqrt({whole(every, worse)} * (1.0 - {whole(every, worse)}) * (1.0::DOUBLE / {n} + 1.0::DOUBLE / ({every} - {n}))) END"
    for k in range(LEVELS):
        sql += rf""",
c{k} AS (SELECT host, template, segs[{k + 1}] AS seg, sum(n)::BIGINT AS n, sum(labelled)::BIGINT AS labelled, sum(bad)::BIGINT AS bad, sum(CASE WHEN len(segs) = {k + 1} THEN n ELSE 0 END)::BIGINT AS ends, sum(CASE WHEN segs[{k + 2}] = '*' THEN n ELSE 0 END)::BIGINT AS wild FROM a{k} WHERE len(segs) > {k} AND segs[{k + 1}] <> '*' GROUP BY ALL),
p{k} AS (SELECT template, seg, count(*) AS hosts, sum({rate})::BIGINT AS rate FROM c{k} WHERE labelled > 0 GROUP BY template, seg),
r{k} AS (SELECT template, sum(hosts)::BIGINT AS all_hosts, sum(rate)::BIGINT AS all_rate FROM p{k} GROUP BY template),
s{k} AS (SELECT host, template, count(*) AS children, sum(n)::BIGINT AS all_n, sum(ends)::BIGINT AS all_ends, sum(wild)::BIGINT AS all_wild, sum(labelled)::BIGINT AS all_labelled, sum(bad)::BIGINT AS all_bad FROM c{k} GROUP BY host, template),
k{k} AS (SELECT host, template, seg FROM c{k} JOIN s{k} USING (host, template) LEFT JOIN p{k} USING (template, seg) LEFT JOIN r{k} USING (template)
  WHERE NOT (children > {u.CHILDREN} AND n < {u.RARE}::DOUBLE * all_n)
  AND NOT (n >= {u.ENOUGH} AND all_n - n >= {u.ENOUGH} AND {share('ends', 'all_ends')} + {share('wild', 'all_wild')} + {share('n - ends - wild', 'all_n - all_ends - all_wild')} <= {2 * u.APART}
    AND (all_hosts IS NULL OR coalesce({alike('hosts', '(rate / 1000.0::DOUBLE)', 'all_hosts', '(all_rate / 1000.0::DOUBLE)')}, false))
    AND coalesce({alike('labelled', '(bad::DOUBLE)', 'all_labelled', '(all_bad::DOUBLE)')}, true))),
a{k + 1} AS (SELECT a.host, a.segs, a.n, a.labelled, a.bad, CASE WHEN len(a.segs) > {k} THEN a.template || '/' || CASE WHEN k.seg IS NOT NULL THEN k.seg ELSE '*' END ELSE a.template END AS template
  FROM a{k} a LEFT JOIN k{k} k ON k.host = a.host AND k.template = a.template AND k.seg = a.segs[{k + 1}])"""
    w = f"{u.WEIGHT}::DOUBLE"
    smooth = lambda bad, n, prior: f"(({bad}) + {w} * ({prior})) / (({n}) + {w})"
    part = lambda name: (f"coalesce({name}_rate, 0) / 1000.0::DOUBLE", f"coalesce({name}_n, 0)")
    purity = smooth("bad", "labelled", smooth(*part("near"), smooth(*part("wide"), f"{u.PRIOR}::DOUBLE")))
    return sql + rf""",
tr AS (SELECT host, segs, n, labelled, bad, template || list_aggregate(list_concat([''], list_transform(segs[{LEVELS + 1}:], lambda x: '/' || x)), 'string_agg', '') AS template FROM a{LEVELS}),
own_t AS (SELECT host, template, sum(labelled)::BIGINT AS labelled, sum(bad)::BIGINT AS bad, CASE WHEN regexp_extract(host, '([^.]*[.][^.]*)$', 1) = '' THEN host ELSE regexp_extract(host, '([^.]*[.][^.]*)$', 1) END AS dom FROM tr GROUP BY host, template),
ra AS (SELECT dom, template, {rate} AS rate FROM own_t WHERE labelled > 0),
ne AS (SELECT dom, template, count(*) AS near_n, sum(rate)::BIGINT AS near_rate FROM ra GROUP BY dom, template),
wi AS (SELECT template, count(*) AS wide_n, sum(rate)::BIGINT AS wide_rate FROM ra GROUP BY template),
pu AS (SELECT host, template, {purity} AS purity FROM own_t LEFT JOIN ne USING (dom, template) LEFT JOIN wi USING (template))
SELECT page_id, lab.host, path, rule, coalesce(said, CASE WHEN pu.purity >= {u.PURITY} THEN 'block' ELSE 'allow' END) AS verdict, tr.template, round(pu.purity, 9) AS purity
FROM lab LEFT JOIN tr ON tr.host = lab.host AND tr.segs = lab.segs LEFT JOIN pu ON pu.host = tr.host AND pu.template = tr.template
"""
