"""DuckDB statements for the registered queries that SQL can express."""

from __future__ import annotations

from tessera.llm.license_scan import PHRASES
from tessera.llm.quality_rules import _STOP_FORMS, RULES

_SPACE = r"[ \t-\r]+"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda w: w <> '')"


def _quality_rules() -> str:
    measures = {
        "mean_word_chars": "word_chars / n_words",
        "symbols_per_word": "n_symbols / n_words",
        "exclamations_per_word": "(len(t) - len(replace(t, '!', ''))) / n_words",
        "capital_share": "CASE WHEN word_chars > 0 THEN len(regexp_replace(t, '[^A-Z]', '', 'g')) / word_chars ELSE 0 END",
        "stop_share": "len(list_filter(w, lambda x: list_contains(stops, x))) / n_words",
        "dup_line_share": "n_dup_lines / len(lines)",
        "bullet_line_share": r"len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*([-*•]|[0-9]+[.)])[ \t]'))) / len(lines)",
        "ellipsis_line_share": r"len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) / len(lines)",
    }
    fails = []
    for r in RULES:
        m = f"coalesce({measures[r.measure]}, 0)"
        bad = " OR ".join([f"{m} < {r.least}"] * (r.least is not None) + [f"{m} > {r.most}"] * (r.most is not None))
        fails.append(f"CASE WHEN n_words >= {r.from_words} AND ({bad}) THEN '{r.name}' END")
    stops = ", ".join(f"'{w}'" for w in _STOP_FORMS)
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines FROM documents),
win AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM d WHERE len(w) >= 3),
rep AS (SELECT k, i FROM (SELECT *, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT k, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) x(o) GROUP BY k),
m AS (SELECT d.k, doc_id, t, w, lines, [{stops}] AS stops, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN cov ON cov.k = d.k),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {', '.join(fails)}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM r"""


_CHATS = """WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, turn, count(*) OVER w AS n, string_agg(coalesce(role, chr(3)) || chr(1) || coalesce(text, chr(3)), chr(2)) OVER w AS prefix,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '') OVER w AS rendered FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
f AS (SELECT *, max(n) OVER (PARTITION BY conv_id) AS last FROM p)
SELECT min(conv_id) AS conv_id, max(n) AS n_turns, count(*) AS n_copies, min(rendered) AS rendered FROM f WHERE n = last AND prefix NOT IN (SELECT prefix FROM f WHERE n < last) GROUP BY prefix"""

_NEAR_DUP = rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, w FROM (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda w: w <> '') AS w FROM documents)),
s AS (SELECT DISTINCT k, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
c AS (SELECT a.k AS u, b.k AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k < b.k GROUP BY ALL),
l AS (SELECT u, v FROM c JOIN n x ON x.k = u JOIN n y ON y.k = v WHERE 100 * c.c >= 75 * (x.n + y.n - c.c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT k, k AS o FROM d UNION SELECT r.k, e.v FROM r JOIN e ON e.u = r.o)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(o.doc_id), d.doc_id) AS component_id, d.doc_id IS NOT DISTINCT FROM coalesce(min(o.doc_id), d.doc_id) AS kept
FROM d JOIN r ON r.k = d.k JOIN d o ON o.k = r.o LEFT JOIN n ON n.k = d.k GROUP BY d.k, d.doc_id"""



def _license_phrases() -> str:
    starts = {label: " || ".join(f"[i - 1 FOR i IN range(1, len(w) + 1) IF w[i : i + {len(p.text.split()) - 1}] = {p.text.split()!r}]" for p in PHRASES if p.label == label) for label in sorted({p.label for p in PHRASES})}
    found = ", ".join(f"{x} AS p{k}" for k, x in enumerate(starts.values()))
    every = " || ".join(f"p{k}" for k in range(len(starts)))
    labels = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(starts))
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, {found} FROM d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len({every}) AS BIGINT) AS n_base, CAST(coalesce(list_min({every}), -1) AS BIGINT) AS first_word, CAST(coalesce(list_max({every}), -1) AS BIGINT) AS last_word, concat_ws(',', {labels}) AS base_labels FROM p"""


_HOSTS = r"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
f AS (SELECT p.*, row_number() OVER (PARTITION BY page_id, p.host, p.path ORDER BY len(x.host || x.start) DESC) AS i, x.host || x.start AS rule, x.verdict FROM p
  JOIN (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) x(host, start, verdict)
  ON (p.host = x.host OR ends_with(p.host, '.' || x.host)) AND starts_with(p.path, x.start))
SELECT p.page_id, p.host, p.path, f.rule, f.verdict FROM p LEFT JOIN (SELECT DISTINCT page_id, host, path, rule, verdict FROM f WHERE i = 1) f ON f.page_id = p.page_id AND f.host = p.host AND f.path = p.path"""

_TARGETS = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
c AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][sid % 3 + 1] AS w, 2.0::DOUBLE * n AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(n) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level, row_number() OVER (ORDER BY cap / w, sid) AS pos FROM c
  WINDOW o AS (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT arg_min(level, pos) AS unit FROM l WHERE level <= cap / w)
SELECT d.doc_id, d.size, l.n AS source_size, CASE WHEN unit IS NULL THEN cap ELSE least(cap, w * unit) END AS target FROM d JOIN l ON l.source IS NOT DISTINCT FROM d.source CROSS JOIN u"""

ORACLE_SQL = {"license_phrases": _license_phrases(), "url_fixed_rules": _HOSTS, "mix_targets": _TARGETS, "op4_minhash_near_dedup": _NEAR_DUP, "op9_chat_formatting": _CHATS, "op10_quality_rules": _quality_rules()}
