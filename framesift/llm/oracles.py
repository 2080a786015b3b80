"""DuckDB SQL for the queries that SQL can state."""

from __future__ import annotations

import math

from .licenses import LOWER, PHRASES, TEMPLATES, UPPER, LicenseConfig
from .quality import CLASSES, COMMON_WORDS, QualityConfig
from .urls import RULES, SOFT, STRICT, UrlConfig


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def urls_sql() -> str:
    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
    hits = lambda terms: f"len(list_filter({_list(terms)}, lambda t: regexp_matches(rest, '(^|[^\\p{{L}}\\p{{N}}])' || t || '($|[^\\p{{L}}\\p{{N}}])')))"
    return f"""WITH u AS (SELECT page_id, translate(CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END, '{UPPER}', '{LOWER}') AS rest,
  regexp_extract(CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END, '^[^?#]*') AS head FROM pages),
 v AS (SELECT page_id, rest, translate(regexp_extract(head, '^[^/]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(head, '/.*$', 0, 's') AS path FROM u),
 r(action, rhost, rpath) AS (VALUES {rules}),
 m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action FROM v JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1),
 k AS (SELECT page_id, host, path, CASE WHEN host || path = '' THEN 0 ELSE {hits(STRICT)} END AS strict_terms, CASE WHEN host || path = '' THEN 0 ELSE {hits(SOFT)} END AS soft_terms FROM v)
 SELECT k.page_id, host, path, rule, coalesce(action, CASE WHEN strict_terms > 0 OR soft_terms >= {UrlConfig().min_soft} THEN 'block' ELSE 'allow' END) AS verdict, strict_terms, soft_terms FROM k LEFT JOIN m USING (page_id)"""


NEIGHBOURS = """WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
 SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""

NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, md5(array_to_string(g, ' ')) AS g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM w)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 k AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 c AS (SELECT doc_id AS root, doc_id AS node FROM documents UNION SELECT c.root, e.b FROM c JOIN e ON c.node = e.a),
 m AS (SELECT root, min(node) AS component_id FROM c GROUP BY 1)
 SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN m ON root = doc_id"""


def licenses_sql() -> str:
    config = LicenseConfig()
    words = f"regexp_extract_all(translate({{}}, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    places = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        test = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts))
        places.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {test}), lambda i: {{'at': i - 1, 'label': '{label}'}})")
    size = lambda t: math.ceil(len(t.split()) / config.threshold - 1e-9)
    templates = ", ".join(f"({i}, '{label}', {_list(sorted(set(t.split())))}, {math.ceil(config.threshold * len(set(t.split())) - 1e-9)}, {size(t)})" for i, (label, t) in enumerate(TEMPLATES))
    return f"""WITH d AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
 p AS (SELECT doc_id, len(w) AS n_words, {" || ".join(places)} AS places FROM d),
 t(id, label, tokens, need, size) AS (VALUES {templates}),
 u AS (SELECT id, unnest(tokens) AS word FROM t),
 a AS (SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
 m AS (SELECT doc_id, id, i, word FROM a JOIN u USING (word)),
 e AS (SELECT doc_id, id FROM m JOIN t USING (id) GROUP BY doc_id, id HAVING count(DISTINCT word) >= any_value(need)),
 c AS (SELECT m.doc_id, m.id, m.i, m.word FROM m JOIN e ON e.doc_id = m.doc_id AND e.id = m.id),
 b AS (SELECT x.doc_id, x.id, x.i, count(DISTINCT y.word) AS n FROM c x JOIN t ON t.id = x.id JOIN c y ON y.doc_id = x.doc_id AND y.id = x.id AND y.i BETWEEN x.i AND x.i + t.size - 1 GROUP BY 1, 2, 3),
 h AS (SELECT doc_id, label, n / len(tokens) AS share FROM b JOIN t USING (id) WHERE n >= need),
 g AS (SELECT doc_id, list(DISTINCT label) AS found, max(share) AS best FROM h GROUP BY 1)
 SELECT doc_id, n_words, len(places) AS n_base, list_min(list_transform(places, lambda x: x.at)) AS first_word, list_max(list_transform(places, lambda x: x.at)) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(places, lambda x: x.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(places, lambda x: x.label), coalesce(found, [])))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score FROM p LEFT JOIN g USING (doc_id)"""


def quality_sql() -> str:
    c = QualityConfig()
    vocabulary = ", ".join(f"('{lang}', '{w}')" for lang, ws in COMMON_WORDS.items() for w in ws)
    classes = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "space": "[\\x20\\x09-\\x0D]", "stop": "[.,;:!?]", "symbol": "[#*$%&|<>]", "beyond_ascii": "[^\\x00-\\x7F]"}
    count = {k: f"CAST(length(regexp_replace(t, '{'[^' + v[1:] if k != 'beyond_ascii' else '[' + v[2:]}', '', 'g')) AS DOUBLE)" for k, v in classes.items()}
    count["ascii_other"] = "CAST(length(t) AS DOUBLE) - " + " - ".join(count[k] for k in classes)
    counts = ", ".join(f"{count[k]} AS {k}" for k in CLASSES)
    total = " + ".join(CLASSES)
    part = lambda p, q: f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END)"
    distance = " + ".join(part(f"(s.{k} / s.chars)", f"r.{k}") for k in CLASSES)
    return f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 v(lang, word) AS (VALUES {vocabulary}),
 g AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
 x AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1) GROUP BY 1),
 b AS (SELECT d.doc_id, lang, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
   len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
   coalesce(x.n, 0) AS n_repeat_words, {counts} FROM d LEFT JOIN x USING (doc_id)),
 s AS (SELECT *, {total} AS chars, n_words < {c.min_words} OR 100 * n_repeat_words > {c.max_repeat_percent} * n_words AS base_failed FROM b),
 a1 AS (SELECT lang, c, floor(1000 * n / chars) AS b, count(*) AS n FROM (SELECT lang, chars, unnest([{", ".join(f"'{k}'" for k in CLASSES)}]) AS c, unnest([{", ".join(CLASSES)}]) AS n FROM s WHERE chars >= {c.min_chars} AND lang IN (SELECT lang FROM v)) GROUP BY 1, 2, 3),
 a2 AS (SELECT lang, c, b, sum(n) OVER (PARTITION BY lang, c ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lang, c) AS n FROM a1),
 a3 AS (SELECT lang, c, (min(b) + 0.5) / 1000 AS m FROM a2 WHERE 2 * upto >= n GROUP BY 1, 2),
 r1 AS (SELECT lang, {", ".join(f"max(m) FILTER (c = '{k}') / sum(m) AS {k}" for k in CLASSES)} FROM a3 GROUP BY 1),
 i AS (SELECT s.doc_id, s.lang FROM s JOIN r1 r USING (lang) WHERE NOT base_failed AND chars > 0 AND sqrt(greatest(({distance}) / 2, 0)) <= {c.trim}),
 o AS (SELECT doc_id, lang FROM i UNION ALL SELECT doc_id, lang FROM s WHERE lang IN (SELECT lang FROM v) AND lang NOT IN (SELECT lang FROM i)),
 r AS (SELECT s.lang, {", ".join(f"sum({k}) / sum(chars) AS {k}" for k in CLASSES)} FROM s JOIN o USING (doc_id) GROUP BY 1),
 k AS (SELECT doc_id, lang, word, count(*) AS n FROM (SELECT doc_id, lang, unnest(string_split_regex(lower(t), '[\\x00-\\x60\\x7B-\\x7F]+')) AS word FROM d) WHERE word <> '' GROUP BY 1, 2, 3),
 y AS (SELECT doc_id, sum(n) AS tokens FROM k GROUP BY 1),
 q0 AS (SELECT lang, sum(tokens) AS tokens FROM o JOIN y USING (doc_id) GROUP BY 1),
 q AS (SELECT k.lang, k.word, sum(k.n) / any_value(q0.tokens) AS q FROM k JOIN o USING (doc_id) JOIN v ON v.lang = k.lang AND v.word = k.word JOIN q0 ON q0.lang = k.lang GROUP BY k.lang, k.word),
 q1 AS (SELECT lang, sum(q) AS listed FROM q GROUP BY 1),
 l AS (SELECT k.doc_id, q.lang, sum({part("(k.n / y.tokens)", "q.q")}) AS d, sum(q.q) AS q, sum(k.n) AS n FROM k JOIN q USING (word) JOIN y ON y.doc_id = k.doc_id GROUP BY 1, 2),
 z AS (SELECT y.doc_id, q1.lang, sqrt(greatest((coalesce(l.d, 0) + listed - coalesce(l.q, 0) + {part("((tokens - coalesce(l.n, 0)) / tokens)", "(1 - listed)")}) / 2, 0)) AS d FROM y CROSS JOIN q1 LEFT JOIN l ON l.doc_id = y.doc_id AND l.lang = q1.lang),
 h AS (SELECT s.doc_id, r.lang AS language, s.lang = r.lang AS own, coalesce(y.tokens, 0) AS tokens, CASE WHEN chars > 0 THEN sqrt(greatest(({distance}) / 2, 0)) ELSE 0 END AS cd, coalesce(z.d, 0) AS wd FROM s CROSS JOIN r LEFT JOIN z ON z.doc_id = s.doc_id AND z.lang = r.lang LEFT JOIN y ON y.doc_id = s.doc_id),
 f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(own, false) DESC, cd, wd) = 1)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (chars >= {c.min_chars} AND cd > {c.max_class_distance} + {c.class_slack} / sqrt(greatest(chars, 1)) OR tokens >= {c.min_tokens} AND wd > {c.max_word_distance} + {c.word_slack} / sqrt(greatest(tokens, 1))) AS kept,
  round(cd, 6) AS class_distance, round(wd, 6) AS word_distance, language FROM s JOIN f USING (doc_id)"""


ORACLES = {"op1_quality_rules": quality_sql(), "op5_minhash_near_dedup": NEAR_DUPLICATES, "op7_license_scans": licenses_sql(), "op9_nearest_neighbours": NEIGHBOURS, "op10_url_filters": urls_sql()}
