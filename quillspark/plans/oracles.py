"""DuckDB SQL of the queries that SQL can express, over the same tables."""

from __future__ import annotations

_B = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_S = f"[{_B}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def _pattern(x: str) -> str:
    inner = f"regexp_replace(regexp_replace(lower({x}), '\\p{{Nd}}+', '#', 'g'), '{_S}+', ' ', 'g')"
    return f"substr({_strip(inner)}, 1, 80)"


_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}\p{{M}}_]+')"
_NUMBER = f"nullif(regexp_extract(text, '^{_S}*(\\p{{Nd}}+(?:\\.\\p{{Nd}}+)*)\\.{_S}+[^{_B}]', 1), '')"
_SCOPE_RE = r"(?i)^\s*(Annex\s+\d+[A-Z]?(?:\s*[-–—]\s*(?:Part|Appendix)(?:\s+\d+)?)*)"
_SCOPE = f"regexp_replace({_strip(f'nullif(regexp_extract(text, $p${_SCOPE_RE}$p$, 1), $p$$p$)')}, '\\s*[-–—]\\s*', ' - ', 'g')"
_PATH = "list_transform(string_split({}, '.'), lambda x: x::INT)"
_REST = f"{_strip(r'''regexp_replace(text, '^\s*\p{Nd}+(?:\.\p{Nd}+)*\.', '')''')}"
_BARE = f"regexp_replace({_REST}, '^[ \"“”]+|[ \"“”]+$', '', 'g')"
_IS_LABEL = (
    f"(length({_BARE}) > 0 AND NOT regexp_matches({_BARE}, '(?i)^[(\\[]?(reserved|deleted)[)\\]]?\\.?$') AND length({_BARE}) <= 80 "
    f"AND NOT regexp_matches({_BARE}, '[.;:,]$') AND NOT regexp_matches({_BARE}, '\\b(and|or)$'))"
)
def _words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^{_B}]+')"


def _short(x: str) -> str:
    w = _words(x)
    return f"CASE WHEN len({w}) > 8 THEN array_to_string({w}[1:8], ' ') || '…' ELSE array_to_string({w}, ' ') END"


_BLOCKS = "b AS (SELECT * FROM blocks QUALIFY row_number() OVER (PARTITION BY id ORDER BY ordinal) = 1)"
_CHUNKS = "c AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY id ORDER BY chunk_index) = 1)"
_GOLDEN = "g AS (SELECT * FROM golden QUALIFY row_number() OVER (PARTITION BY id ORDER BY id) = 1)"
_RESULTS = "r AS (SELECT * FROM gen_results QUALIFY row_number() OVER (PARTITION BY run_id, id ORDER BY id) = 1)"
_REFS = "refs AS (SELECT id, i - 1 AS ref_no, gold[i].doc_id AS doc_id, gold[i].scope AS scope, gold[i].section AS section, gold[i].page AS page FROM (SELECT id, gold, unnest(range(1, len(gold) + 1)) AS i FROM g))"
_ZONED = (
    _BLOCKS + ", z AS (SELECT *, CASE WHEN bbox.y0 < 0.15::DOUBLE * 842.0::DOUBLE THEN 'top' WHEN 842.0::DOUBLE - bbox.y1 < 0.15::DOUBLE * 842.0::DOUBLE THEN 'bottom' END AS edge, "
    "CASE WHEN bbox.y0 < 0.15::DOUBLE * 842.0::DOUBLE THEN round_even(bbox.y0 / 5.0, 0)::INT WHEN 842.0::DOUBLE - bbox.y1 < 0.15::DOUBLE * 842.0::DOUBLE THEN round_even((842.0 - bbox.y1) / 5.0, 0)::INT END AS edge_band, "
    f"{_pattern('text')} AS pattern FROM b), np AS (SELECT doc_id, count(DISTINCT page_number) AS n_pages FROM z GROUP BY doc_id), "
    "rep AS (SELECT z.doc_id, edge, edge_band, pattern, count(DISTINCT page_number) AS pages FROM z JOIN np USING (doc_id) WHERE edge IS NOT NULL GROUP BY ALL "
    "HAVING count(DISTINCT page_number) >= greatest(3, ceil(0.3::DOUBLE * any_value(n_pages))::INT))"
)
_EVENTS = (
    f"body AS (SELECT *, CASE WHEN coalesce(heading_level, 0) > 0 THEN {_SCOPE} END AS heads FROM blocks WHERE role = 'body' QUALIFY row_number() OVER (PARTITION BY id ORDER BY ordinal) = 1), "
    f"nn AS (SELECT *, CASE WHEN heads IS NULL THEN {_NUMBER} END AS num FROM body), "
    "cc AS (SELECT *, count(heads) OVER w AS annexes, count(num) OVER w AS numbers, last_value(heads IGNORE NULLS) OVER w AS named FROM nn WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING)), "
    "ev AS (SELECT *, CASE WHEN annexes > 0 THEN annexes + 1 WHEN numbers > 0 THEN 1 ELSE 0 END AS segment, CASE WHEN annexes > 0 THEN named WHEN numbers > 0 THEN 'Regulation' ELSE 'Front matter' END AS scope_now, "
    f"CASE WHEN num IS NOT NULL THEN num || ' ' || CASE WHEN coalesce(heading_level, 0) > 0 OR {_IS_LABEL} THEN {_REST} ELSE {_short(_REST)} END END AS label FROM cc)"
)
_VEC = "list_transform(range(0, 8), lambda i: ('0x' || substr(sha256({}), (2 * i + 1)::INT, 2))::INT / 255.0::DOUBLE + 0.01::DOUBLE)"
_POOL = (
    f"{_GOLDEN}, {_CHUNKS}, q AS (SELECT id AS query_id, question AS query FROM g WHERE id LIKE 'q%' AND CAST(substr(id, 2) AS INT) % 50 = 0 AND question IS NOT NULL), "
    f"qv AS (SELECT query_id, {_VEC.format('query')} AS v FROM q), cv AS (SELECT id AS chunk_id, {_VEC.format('coalesce(embed_text, $p$$p$)')} AS v FROM c), "
    "dense AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM "
    "(SELECT query_id, chunk_id, round(list_cosine_similarity(qv.v, cv.v), 9) AS score FROM qv, cv) QUALIFY rank <= 30), "
    f"qt AS (SELECT DISTINCT query_id, unnest({_TOKENS.format('query')}) AS term FROM q), ct AS (SELECT DISTINCT id AS chunk_id, unnest({_TOKENS.format('coalesce(embed_text, $p$$p$)')}) AS term FROM c), "
    "sparse AS (SELECT query_id, chunk_id, count(*)::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, chunk_id) AS rank FROM qt JOIN ct USING (term) GROUP BY query_id, chunk_id QUALIFY rank <= 30), "
    "fu AS (SELECT query_id, chunk_id, d.rank AS dense_rank, s.rank AS sparse_rank, coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0) AS rrf_score FROM dense d FULL JOIN sparse s USING (query_id, chunk_id)), "
    "pool0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, least(dense_rank, sparse_rank), chunk_id) AS fused_rank FROM fu), "
    "ov AS (SELECT query_id, chunk_id, count(*)::DOUBLE AS n FROM qt JOIN ct USING (term) GROUP BY ALL), "
    "pool1 AS (SELECT p.*, fused_rank <= 20 AS is_candidate, CASE WHEN fused_rank <= 20 THEN coalesce(ov.n, 0) END AS rerank_score FROM pool0 p LEFT JOIN ov USING (query_id, chunk_id)), "
    "pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_candidate DESC, coalesce(rerank_score, 0) DESC, fused_rank) AS final_rank FROM pool1), "
    "stages AS (SELECT query_id, chunk_id, 'dense' AS stage, dense_rank AS rank FROM pool WHERE dense_rank IS NOT NULL UNION ALL SELECT query_id, chunk_id, 'sparse', sparse_rank FROM pool WHERE sparse_rank IS NOT NULL "
    "UNION ALL SELECT query_id, chunk_id, 'fused', fused_rank FROM pool UNION ALL SELECT query_id, chunk_id, 'reranked', final_rank FROM pool WHERE is_candidate)"
)
_COVERS = "({0} = {1} OR starts_with({0}, {1} || '.'))"
_SCORES = (
    _POOL + f", {_REFS}, asked AS (SELECT refs.* FROM refs JOIN q ON q.query_id = refs.id), "
    "hits AS (SELECT s.*, c.doc_id, c.scope, c.sections, c.page_start, c.page_end FROM stages s JOIN c ON c.id = s.chunk_id), "
    "best AS (SELECT h.query_id, stage, ref_no, min(rank) AS rank FROM hits h JOIN asked a ON a.id = h.query_id AND a.doc_id = h.doc_id AND a.scope IS NOT DISTINCT FROM h.scope "
    f"WHERE CASE WHEN a.section IS NOT NULL THEN coalesce(len(list_filter(h.sections, lambda x: {_COVERS.format('x', 'a.section')})) > 0, false) ELSE coalesce(a.page BETWEEN h.page_start AND h.page_end, false) END GROUP BY ALL), "
    "per AS (SELECT query_id, stage, min(rank) AS first_rank, count(*) FILTER (WHERE rank <= 5) AS n5, count(*) FILTER (WHERE rank <= 10) AS n10, count(*) FILTER (WHERE rank <= 20) AS n20 FROM best GROUP BY ALL), "
    "grid AS (SELECT id AS query_id, count(*) AS n FROM asked GROUP BY id), "
    "scores AS (SELECT query_id, s.stage, coalesce(n5, 0) / n AS recall_5, coalesce(n10, 0) / n AS recall_10, coalesce(n20, 0) / n AS recall_20, CASE WHEN first_rank <= 20 THEN 1.0::DOUBLE / first_rank ELSE 0 END AS reciprocal_rank, first_rank "
    "FROM grid CROSS JOIN (VALUES ('dense'), ('sparse'), ('fused'), ('reranked')) s(stage) LEFT JOIN per USING (query_id, stage))"
)
_SWEEP = (
    _RESULTS + ", " + _CHUNKS + f", ct AS (SELECT id AS chunk_id, list_distinct({_TOKENS.format('coalesce(embed_text, $p$$p$)')}) AS ws FROM c), "
    f"cd AS (SELECT run_id, id, list_distinct({_TOKENS.format('question')}) AS q, answerable, unnest(CASE WHEN len(citations) > 0 THEN citations ELSE [NULL] END).chunk_id AS chunk_id FROM r), "
    "x AS (SELECT run_id, id, answerable, max(len(list_intersect(q, ws)))::DOUBLE AS t FROM cd JOIN ct USING (chunk_id) WHERE answerable IS NOT NULL AND q IS NOT NULL GROUP BY ALL), "
    "k AS (SELECT t AS threshold, count(*) FILTER (WHERE answerable) AS p, count(*) FILTER (WHERE NOT answerable) AS n FROM x GROUP BY t), "
    "sw AS (SELECT threshold, round(((sum(p) OVER () - (sum(p) OVER (ORDER BY threshold) - p)) / sum(p) OVER () + (sum(n) OVER (ORDER BY threshold) - n) / sum(n) OVER ()) / 2, 9) AS accuracy FROM k)"
)
_DIFF = (
    "n AS (SELECT DISTINCT id AS chunk_id, doc_id, sha256(embed_text) AS sha, substr(sha1(unhex('6f1d2a8e4c3b5e7f9a0b1c2d3e4f5a6b') || encode(id)), 1, 32) AS h FROM chunks), "
    "now AS (SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(to_hex(((('0x' || substr(h, 17, 1))::INT & 3) | 8))) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id, ('0x' || substr(sha256(chunk_id), 1, 6))::INT % 1001 AS m FROM n), "
    "old AS (SELECT point_id, doc_id, CASE WHEN m % 7 = 0 THEN 'old' ELSE sha END AS sha FROM now WHERE m % 11 <> 0 UNION ALL SELECT point_id || '-stale', doc_id, sha FROM now WHERE m % 13 = 0), "
    "diff AS (SELECT coalesce(now.point_id, old.point_id) AS point_id, coalesce(now.doc_id, old.doc_id) AS doc_id, CASE WHEN old.point_id IS NULL THEN 'insert' WHEN now.point_id IS NULL THEN 'delete' WHEN now.sha IS NOT DISTINCT FROM old.sha THEN 'unchanged' ELSE 'update' END AS action FROM now FULL JOIN old ON now.point_id = old.point_id)"
)
def _match(x: str) -> str:
    even = f"regexp_replace(translate({x}, '“”‘’–—', '\"\"''''--'), '{_S}+', ' ', 'g')"
    return f"lower({_strip(even)})"


def _reference(group: int) -> str:
    pattern = r"(?i)paragraphs?\s+(\d+(?:\.\d+)*)\.?\s+(?:of|to|in)\s+(Annex\s+\d+|this\s+annex|this\s+Regulation)"
    return f"regexp_extract_all(text, '{pattern}', {group})"


_EVEN_T = r"lower(regexp_replace(t, '\s+', ' ', 'g'))"
_TITLE_PART = f"CASE WHEN heads IS NOT NULL THEN regexp_replace(regexp_replace(text, $p${_SCOPE_RE}$p$, ''), '^[ \\-–—:]+|[ \\-–—:]+$', '', 'g') ELSE {_strip('text')} END"


_OUTCOME = (
    "CASE WHEN error IS NOT NULL THEN 'error' WHEN NOT answerable THEN CASE WHEN covered THEN 'hallucinated' ELSE 'correct_refusal' END WHEN NOT covered THEN 'false_refusal' WHEN judge IS NULL THEN 'judge_error' ELSE 'answered' END"
)


def _pct(x: str, q: float) -> str:
    return f"round(list_sort(list({x}))[least(count({x}) - 1, floor({q}::DOUBLE * count({x}))::BIGINT) + 1], 1)"


_SOURCE = (
    "concat_ws(' · ', doc_id, coalesce(scope, ''), CASE WHEN len(sections) > 0 THEN sections[1] || '–' || sections[-1] ELSE 'unnumbered' END, "
    "'p.' || page_start || CASE WHEN page_start = page_end THEN '' ELSE '–' || page_end END)"
)
_SCOPED_RE = r"paragraphs?\s+(\d+(?:\.\d+)*)\.?\s+(?:of|to|in)\s+(Annex\s+\d+|this\s+annex|this\s+Regulation)"
_FIGURE_RE = r"Annex\s+(\d+),?\s+Figures?\s+(\d+[A-Za-z]?)"
# RE2 has no look-ahead: what must not follow is matched along and such hits are left out
_FOUND = (
    "rx AS (SELECT id, doc_id, scope AS own, text FROM c WHERE regexp_matches(text, '(?i)paragraph|annex')), "
    f"r0 AS (SELECT id, doc_id, own, 0 AS k, unnest(range(1, len(regexp_extract_all(text, '(?i){_SCOPED_RE}', 1)) + 1)) AS p, unnest(regexp_extract_all(text, '(?i){_SCOPED_RE}', 1)) AS section, unnest(regexp_extract_all(text, '(?i){_SCOPED_RE}', 2)) AS t FROM rx), "
    f"r1 AS (SELECT id, doc_id, own, 1 AS k, unnest(range(1, len(regexp_extract_all(text, '(?i){_FIGURE_RE}', 1)) + 1)) AS p, unnest(regexp_extract_all(text, '(?i){_FIGURE_RE}', 1)) AS a, unnest(regexp_extract_all(text, '(?i){_FIGURE_RE}', 2)) AS f FROM rx), "
    r"b2 AS (SELECT id, doc_id, own, list_filter(regexp_extract_all(text, '(?i)paragraphs?\s+[\d.]+(?:\s*(?:of|to|in)\s+(?:Annex|this))?', 0), lambda x: regexp_full_match(x, '(?i)paragraphs?\s+\d+(?:\.\d+)*\.?')) AS h FROM rx), "
    r"r2 AS (SELECT id, doc_id, own, 2 AS k, unnest(range(1, len(h) + 1)) AS p, regexp_extract(unnest(h), '\d+(?:\.\d+)*') AS section FROM b2), "
    f"b3 AS (SELECT id, doc_id, own, list_filter(regexp_extract_all(regexp_replace(text, '(?i)(?:{_SCOPED_RE}|{_FIGURE_RE})', chr(1), 'g'), "
    + r"'(?i)Annex\s+\d+\w*(?:\s*[-–]?\s*(?:Part|Appendix))?', 0), lambda x: regexp_full_match(x, '(?i)Annex\s+\d+')) AS h FROM rx), "
    r"r3 AS (SELECT id, doc_id, own, 3 AS k, unnest(range(1, len(h) + 1)) AS p, 'Annex ' || regexp_extract(unnest(h), '\d+') AS scope FROM b3), "
    f"ra AS (SELECT id, doc_id, own, k, p, CASE WHEN {_EVEN_T} = 'this annex' THEN own WHEN {_EVEN_T} = 'this regulation' THEN 'Regulation' ELSE 'Annex ' || regexp_extract(t, '[0-9]+') END AS scope, section, NULL::VARCHAR AS figure FROM r0 "
    "UNION ALL SELECT id, doc_id, own, k, p, 'Annex ' || a, NULL, 'Figure ' || f FROM r1 UNION ALL SELECT id, doc_id, own, k, p, own, section, NULL FROM r2 UNION ALL SELECT id, doc_id, own, k, p, scope, NULL, NULL FROM r3 WHERE scope IS DISTINCT FROM own), "
    "rd AS (SELECT * FROM ra QUALIFY row_number() OVER (PARTITION BY id, scope, section, figure ORDER BY k, p) = 1), "
    "found AS (SELECT id, doc_id, scope, section, figure, scope IS DISTINCT FROM own AS cross_scope, row_number() OVER (PARTITION BY id ORDER BY scope IS DISTINCT FROM own DESC, k, p)::INT AS seq FROM rd)"
)
_LED = (
    _FOUND + ", n AS (SELECT doc_id, scope, count(*) AS n FROM c GROUP BY ALL), "
    "pairs AS (SELECT f.id, f.seq, f.cross_scope, c.id AS target_id, c.chunk_index AS ci, CASE WHEN f.section IS NOT NULL THEN CASE WHEN list_contains(c.sections, f.section) THEN 0 WHEN len(list_filter(c.sections, lambda x: starts_with(x, f.section || '.'))) > 0 THEN 1 END "
    r"WHEN f.figure IS NOT NULL THEN CASE WHEN len(list_filter(regexp_extract_all(c.text, '(?i)\bFigure \d+[A-Za-z]*\w*', 0), lambda x: lower(x) = lower(f.figure))) > 0 THEN 2 END WHEN n.n <= 2 THEN 3 END AS match "
    "FROM found f JOIN c ON c.doc_id = f.doc_id AND coalesce(c.scope, '') = coalesce(f.scope, '') JOIN n ON n.doc_id = c.doc_id AND n.scope IS NOT DISTINCT FROM c.scope), "
    "led AS (SELECT id, seq, cross_scope, target_id, match FROM pairs WHERE match IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, seq ORDER BY match, ci, target_id) = 1)"
)
_CONTEXT = (
    _POOL + ", " + _LED + ", kept AS (SELECT query_id, chunk_id, final_rank FROM pool WHERE is_candidate AND final_rank <= 10), "
    "walk AS (SELECT query_id, target_id, min((CASE WHEN cross_scope THEN 0 ELSE 1 END, final_rank, seq)) AS first FROM kept JOIN led ON led.id = kept.chunk_id GROUP BY ALL), "
    "fresh AS (SELECT query_id, target_id FROM walk WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.query_id = walk.query_id AND kept.chunk_id = walk.target_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY first, target_id) <= 3), "
    "members AS (SELECT query_id, chunk_id, 'retrieved' AS origin FROM kept UNION ALL SELECT query_id, target_id, 'reference' FROM fresh), "
    "ctx AS (SELECT query_id, 'C' || row_number() OVER (PARTITION BY query_id ORDER BY c.doc_id, c.chunk_index, c.id) AS label, c.id AS chunk_id, c.doc_id, c.chunk_index, origin FROM members JOIN c ON c.id = members.chunk_id)"
)


_BOTH_WAYS = "both_ways AS (SELECT * FROM blocks UNION ALL BY NAME SELECT * REPLACE (id || '-turned' AS id, doc_id || '-turned' AS doc_id, -ordinal AS ordinal) FROM blocks)"


ORACLES: dict[str, str] = {
    "normalize_text": "SELECT DISTINCT id, " + _strip(f"regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '{_S}*\\n{_S}*', ' ', 'g')") + " AS norm FROM blocks",
    "normalize_pattern": f"SELECT DISTINCT id, {_pattern('text')} AS pattern FROM blocks",
    "doc_slug": "SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), ''), 'document') AS slug FROM documents",
    "section_numbers": f"SELECT DISTINCT id, {_NUMBER} AS number, len(string_split({_NUMBER}, '.'))::INT AS depth FROM blocks WHERE {_NUMBER} IS NOT NULL",
    "scope_names": f"SELECT DISTINCT id, {_SCOPE} AS scope_name FROM blocks WHERE {_SCOPE} IS NOT NULL",
    "heading_labels": f"SELECT DISTINCT id, {_IS_LABEL} AS is_label FROM blocks WHERE section_number IS NOT NULL",
    "sentence_split": f"WITH {_BLOCKS}, s AS (SELECT id, string_split(regexp_replace(text, '([.;:])[{_B}]+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM b WHERE role = 'body') SELECT id, (i - 1)::INT AS pos, l[i] AS sentence FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM s)",
    "word_tokens": f"SELECT term, count(DISTINCT id) AS chunks FROM (SELECT id, unnest({_TOKENS.format('text')}) AS term FROM chunks) GROUP BY term",
    "token_stats": f"WITH {_CHUNKS}, w AS (SELECT doc_id, len({_words('embed_text')}) AS n FROM c) SELECT doc_id, count(n) AS chunks, min(n)::INT AS min_tokens, floor(median(n))::INT AS median_tokens, list_sort(list(n))[least(count(n) - 1, floor(0.9::DOUBLE * count(n))::BIGINT) + 1]::INT AS p90_tokens, max(n)::INT AS max_tokens, count(*) FILTER (WHERE n < 64) AS below_min FROM w GROUP BY doc_id",
    "text_sha256": "SELECT DISTINCT id, sha256(embed_text) AS sha FROM chunks",
    "answer_hashes": "SELECT DISTINCT run_id, id, substr(sha256(coalesce(answer, '')), 1, 16) AS hash FROM gen_results",
    "point_ids": "WITH h AS (SELECT DISTINCT id, sha1(unhex('6f1d2a8e4c3b5e7f9a0b1c2d3e4f5a6b') || encode(id)) AS h FROM chunks) SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(to_hex(((('0x' || substr(h, 17, 1))::INT & 3) | 8))) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h",
    "golden_split": "WITH p AS (SELECT DISTINCT id, list_reduce(list_transform(range(1, 65), lambda i: ('0x' || substr(sha256(id), i::INT, 1))::INT), lambda a, x: (a * 16 + x) % 100) AS percent FROM golden) SELECT id, percent, CASE WHEN percent < 30 THEN 'test' ELSE 'dev' END AS derived_split FROM p",
    "label_sample": f"WITH {_GOLDEN} SELECT id FROM g ORDER BY sha256(id) LIMIT 50",
    "header_render": "WITH h AS (SELECT DISTINCT id, doc_id, section_path AS p, string_split(section_path[1], ': ') AS parts FROM chunks), t AS (SELECT *, parts[1] AS name, CASE WHEN len(parts) > 1 THEN substr(p[1], length(parts[1]) + 3) END AS title FROM h) "
    f"SELECT id, CASE WHEN len(p) = 0 THEN doc_id ELSE doc_id || ' | ' || array_to_string([CASE WHEN coalesce(title, '') = '' THEN name ELSE name || ': ' || {_short('title')} END] || p[2:], ' > ') END AS header FROM t",
    "common_paths": f"WITH {_CHUNKS}, k AS (SELECT doc_id, scope, list(section_path) AS ps, min(len(section_path)) AS m FROM c GROUP BY ALL) SELECT doc_id, scope, array_to_string(ps[1][1:coalesce(list_max(list_filter(range(1, (m + 1)::BIGINT), lambda k: len(list_distinct(list_transform(ps, lambda p: array_to_string(p[1:k], chr(1))))) = 1)), 0)], ' > ') AS shared FROM k",
    "hit_labels": f"SELECT DISTINCT id, {_SOURCE} AS source, coalesce(scope, '') || ' / ' || CASE WHEN len(sections) > 0 THEN sections[1] || '..' || sections[-1] ELSE 'p.' || page_start END AS hit FROM chunks",
    "gold_labels": f"WITH {_GOLDEN}, {_REFS} SELECT id, ref_no::INT AS ref_no, coalesce(scope, '') || ' / ' || coalesce(section, 'p.' || page) AS label FROM refs",
    "edge_zones": f"WITH {_ZONED} SELECT id, edge, edge_band FROM z WHERE edge IS NOT NULL",
    "repeated_lines": f"WITH {_ZONED} SELECT doc_id, edge, edge_band, pattern, pages FROM rep",
    "running_furniture": f"WITH {_ZONED}, s AS (SELECT z.*, rep.pages IS NOT NULL AS repeats FROM z LEFT JOIN rep USING (doc_id, edge, edge_band, pattern)), dep AS (SELECT doc_id, max(CASE WHEN edge = 'top' THEN bbox.y1 END) AS hd, max(CASE WHEN edge = 'bottom' THEN 842.0 - bbox.y0 END) AS fd FROM s WHERE repeats GROUP BY doc_id) "
    "SELECT id, CASE WHEN repeats AND edge = 'top' THEN 'header' WHEN repeats THEN 'footer' WHEN coalesce(hd, 0) > 0 AND bbox.y1 <= hd + 5 THEN 'header' WHEN coalesce(fd, 0) > 0 AND 842.0 - bbox.y0 <= fd + 5 THEN 'footer' ELSE 'body' END AS tagged FROM s LEFT JOIN dep USING (doc_id)",
    "body_font_size": f"WITH {_BLOCKS}, k AS (SELECT doc_id, round_even(font_size, 1) AS body_size, sum(length(text)) AS w, min(ordinal) AS o FROM b WHERE role = 'body' AND font_size IS NOT NULL AND text IS NOT NULL GROUP BY ALL) SELECT doc_id, body_size FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, o) = 1",
    "toc_noise_roles": f"WITH {_BLOCKS} SELECT id, CASE WHEN role = 'body' AND regexp_matches(text, '\\.{{4,}}{_S}*\\p{{Nd}}+{_S}*$') THEN 'toc' WHEN role = 'body' AND length(text) < 5 THEN 'noise' ELSE role END AS role FROM b",
    "role_counts": f"WITH {_BLOCKS} SELECT doc_id, coalesce(role, 'unknown') AS role, count(*) AS n FROM b GROUP BY ALL",
    "heading_styles": f"WITH {_BLOCKS}, k AS (SELECT doc_id, round_even(font_size * 2, 0) / 2 AS size, coalesce(is_bold, false) AS bold, sum(length(text)) AS chars, min(ordinal) AS o FROM b WHERE role = 'body' AND text IS NOT NULL AND font_size IS NOT NULL GROUP BY ALL), "
    "m AS (SELECT doc_id, size AS ms, bold AS mb FROM k QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chars DESC, o) = 1), t AS (SELECT doc_id, sum(chars) AS total FROM k GROUP BY doc_id), "
    "j AS (SELECT k.*, size = ms AND bold = mb AS is_body, NOT (size = ms AND bold = mb) AND (size >= ms + 1 OR (bold AND NOT mb AND abs(size - ms) < 1)) AND chars <= 0.05::DOUBLE * total AND chars >= 30 AS heading FROM k JOIN m USING (doc_id) JOIN t USING (doc_id)) "
    "SELECT doc_id, size, bold, chars::BIGINT AS chars, is_body, CASE WHEN heading THEN row_number() OVER (PARTITION BY doc_id, heading ORDER BY size DESC, bold DESC)::INT END AS level FROM j",
    "structure_scopes": f"WITH {_EVENTS} SELECT id, segment::INT AS segment, scope_now AS scope_found, num AS number_found FROM ev",
    "breadcrumbs": f"WITH {_EVENTS}, n AS (SELECT doc_id, segment, ordinal, num, label FROM ev WHERE num IS NOT NULL), "
    "brk AS (SELECT i.doc_id, i.segment, i.ordinal, i.num, i.label, min(j.ordinal) AS stop FROM n i LEFT JOIN n j ON j.doc_id = i.doc_id AND j.segment = i.segment AND j.ordinal > i.ordinal AND NOT starts_with(j.num, i.num || '.') GROUP BY ALL), "
    "op AS (SELECT e.id, string_agg(k.label, ' > ' ORDER BY k.ordinal) AS crumbs FROM ev e JOIN brk k ON k.doc_id = e.doc_id AND k.segment = e.segment AND k.ordinal <= e.ordinal AND (k.stop IS NULL OR e.ordinal < k.stop) GROUP BY e.id) "
    "SELECT ev.id, coalesce(crumbs, '') AS crumbs FROM ev LEFT JOIN op USING (id)",
    "backward_jumps": f"WITH {_EVENTS.replace('FROM blocks WHERE', 'FROM both_ways WHERE').replace('body AS (', _BOTH_WAYS + ', body AS (', 1)}, p AS (SELECT doc_id, scope_now AS scope, ordinal, num AS number, lag(num) OVER (PARTITION BY doc_id, segment ORDER BY ordinal) AS before FROM ev WHERE num IS NOT NULL) SELECT * FROM p WHERE {_PATH.format('number')} < {_PATH.format('before')}",
    "outline": f"WITH {_BLOCKS} SELECT doc_id, scope, heading_level, count(*) AS headings, min(ordinal) AS first_ordinal FROM b WHERE role = 'body' AND block_type = 'heading' GROUP BY ALL",
    "document_chars": f"WITH {_BLOCKS}, t AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ordinal, text) AS t FROM b WHERE role = 'body' GROUP BY doc_id) SELECT doc_id, length(t)::BIGINT AS chars, md5(t) AS hash FROM t",
    "chunk_pack": f"WITH RECURSIVE {_BLOCKS}, w AS (SELECT doc_id, ordinal, len({_words('text')})::BIGINT AS words, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, len({_words('text')})) AS k FROM b WHERE role = 'body'), "
    "f AS (SELECT doc_id, ordinal, words, k, 1::BIGINT AS bin, words AS used FROM w WHERE k = 1 UNION ALL SELECT w.doc_id, w.ordinal, w.words, w.k, CASE WHEN f.used + w.words > 350 THEN f.bin + 1 ELSE f.bin END, CASE WHEN f.used + w.words > 350 THEN w.words ELSE f.used + w.words END FROM f JOIN w ON w.doc_id = f.doc_id AND w.k = f.k + 1) "
    "SELECT doc_id, ordinal, words, bin FROM f",
    "excluded_scopes": f"WITH {_BLOCKS} SELECT doc_id, scope, count(*) AS kept FROM b WHERE role = 'body' AND text IS NOT NULL AND (scope IS NULL OR scope <> 'Front matter') GROUP BY ALL",
    "chunk_report": f"WITH {_BLOCKS}, o AS (SELECT *, coalesce(scope = 'Front matter', false) AS gone, len({_words('text')}) AS n FROM b WHERE role = 'body' AND text IS NOT NULL) SELECT doc_id, count(*) FILTER (WHERE NOT gone) AS input_blocks, count(*) FILTER (WHERE gone) AS excluded_blocks, (sum(n) FILTER (WHERE NOT gone))::BIGINT AS words, "
    "count(DISTINCT scope) FILTER (WHERE NOT gone) AS scopes, true AS within, count(DISTINCT id) FILTER (WHERE NOT gone) AS held_blocks FROM o GROUP BY doc_id HAVING count(*) FILTER (WHERE NOT gone) > 0",
    "index_diff": f"WITH {_DIFF} SELECT point_id, doc_id, action FROM diff",
    "index_report": f"WITH {_DIFF} SELECT doc_id, count(*) FILTER (WHERE action <> 'delete') AS chunks, count(*) FILTER (WHERE action IN ('insert', 'update')) AS embedded, count(*) FILTER (WHERE action = 'unchanged') AS unchanged, count(*) FILTER (WHERE action = 'delete') AS deleted FROM diff GROUP BY doc_id",
    "point_count": "SELECT doc_id, count(DISTINCT id) AS points FROM chunks GROUP BY doc_id",
    "dense_topk": "WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM q, embeddings e) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 30",
    "dense_topk_filtered": "WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM q, embeddings e WHERE e.label IN (1, 3)) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 10",
    "sparse_topk": f"WITH {_POOL} SELECT query_id, chunk_id, rank::INT AS rank, score FROM sparse",
    "rrf_fusion": f"WITH {_POOL} SELECT query_id, chunk_id, dense_rank::INT AS dense_rank, sparse_rank::INT AS sparse_rank, round(rrf_score, 9) AS rrf_score, fused_rank::INT AS fused_rank, is_candidate FROM pool",
    "hybrid_search": f"WITH {_POOL} SELECT query_id, chunk_id, dense_rank::INT AS dense_rank, sparse_rank::INT AS sparse_rank, fused_rank::INT AS fused_rank, rerank_score, final_rank::INT AS final_rank FROM pool WHERE is_candidate AND final_rank <= 5",
    "stage_rankings": f"WITH {_POOL} SELECT query_id, chunk_id, stage, rank::INT AS rank FROM stages",
    "recall_and_mrr": f"WITH {_SCORES} SELECT query_id, stage, round(recall_5, 6) AS recall_5, round(recall_20, 6) AS recall_20, round(reciprocal_rank, 6) AS reciprocal_rank, first_rank::INT AS first_rank FROM scores",
    "stage_summary": f"WITH {_SCORES}, x AS (SELECT scores.*, g.type FROM scores JOIN g ON g.id = scores.query_id) SELECT stage, type, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(recall_20), 6) AS recall_20, round(avg(reciprocal_rank), 6) AS mrr, count(*) AS questions FROM x GROUP BY GROUPING SETS ((stage), (stage, type))",
    "question_diagnosis": f"WITH {_SCORES}, w AS (SELECT query_id, max(CASE WHEN stage = 'fused' THEN first_rank END) AS f, max(CASE WHEN stage = 'reranked' THEN first_rank END) AS l FROM scores GROUP BY query_id) SELECT CASE WHEN l <= 5 THEN 'ok' WHEN f IS NULL THEN 'not_retrieved' WHEN f > 20 THEN 'below_cutoff' ELSE 'lost_in_rerank' END AS diagnosis, query_id FROM w",
    "find_references": f"WITH {_CHUNKS}, m AS (SELECT id, regexp_extract_all(text, '(?i)paragraphs?\\s+(\\d+(?:\\.\\d+)*)\\.?\\s+(?:of|to|in)\\s+(Annex\\s+\\d+|this\\s+annex|this\\s+Regulation)', 1) AS s, regexp_extract_all(text, '(?i)paragraphs?\\s+(\\d+(?:\\.\\d+)*)\\.?\\s+(?:of|to|in)\\s+(Annex\\s+\\d+|this\\s+annex|this\\s+Regulation)', 2) AS t FROM c), "
    "u AS (SELECT id, unnest(s) AS section, unnest(t) AS t FROM m) SELECT id, section, CASE WHEN lower(regexp_replace(t, '\\s+', ' ', 'g')) = 'this annex' THEN 'this annex' WHEN lower(regexp_replace(t, '\\s+', ' ', 'g')) = 'this regulation' THEN 'Regulation' ELSE 'Annex ' || regexp_extract(t, '(\\d+)', 1) END AS target FROM u",
    "context_labels": f"WITH {_GOLDEN}, {_REFS}, {_CHUNKS}, n AS (SELECT DISTINCT id, doc_id, scope FROM refs) SELECT n.id, 'C' || row_number() OVER (PARTITION BY n.id ORDER BY n.doc_id, c.chunk_index) AS label, c.id AS chunk_id FROM n JOIN c ON c.doc_id = n.doc_id AND c.scope = n.scope",
    "groundedness": f"WITH {_RESULTS} SELECT run_id, id, NOT coalesce(covered, false) OR coalesce(len(list_filter(citations, lambda x: x.verified)) > 0, false) AS is_grounded FROM r",
    "answer_outcomes": f"WITH {_RESULTS}, o AS (SELECT run_id, id, {_OUTCOME} AS outcome_found, judge.verdict AS v FROM r) SELECT run_id, id, outcome_found, CASE WHEN outcome_found IN ('error', 'hallucinated', 'false_refusal') THEN 0.0::DOUBLE WHEN outcome_found = 'correct_refusal' THEN 1.0 WHEN outcome_found = 'answered' THEN CASE v WHEN 'correct' THEN 1.0 WHEN 'partial' THEN 0.5 WHEN 'incorrect' THEN 0.0 END END AS score_found FROM o",
    "generation_summary": f"WITH {_RESULTS}, x AS (SELECT *, coalesce(answerable, false) AS yes, coalesce(covered, false) AND error IS NULL AS cov, coalesce(answerable, false) AND judge IS NOT NULL AS judged, coalesce(timings_ms['retrieve'], 0) + coalesce(timings_ms['llm'], 0) AS ms, coalesce(timings_ms['llm'], 0) AS llm, "
    "len(list_filter(citations, lambda c: coalesce(c.verified, false))) AS good, len(citations) AS cites FROM r) SELECT run_id, count(*) AS n, count(*) FILTER (WHERE yes) AS answerable, round(avg(score) FILTER (WHERE yes), 3) AS answer_score, "
    + ", ".join(f"count(*) FILTER (WHERE judged AND judge.verdict = '{v}') AS {v}" for v in ("correct", "partial", "incorrect"))
    + ", round(avg(coalesce(judge.overstated, false)::INT) FILTER (WHERE judged), 3) AS overstated_rate, round(avg(coalesce(judge.missing_condition, false)::INT) FILTER (WHERE judged), 3) AS missing_condition_rate, round(avg(coalesce(judge.contradicts_reference, false)::INT) FILTER (WHERE judged), 3) AS contradicts_rate, "
    "round(avg(coalesce(outcome = 'false_refusal', false)::INT) FILTER (WHERE yes), 3) AS false_refusal_rate, round(avg(coalesce(outcome = 'correct_refusal', false)::INT) FILTER (WHERE NOT yes), 3) AS refusal_accuracy, round(avg(coalesce(grounded, false)::INT) FILTER (WHERE cov), 3) AS grounded_rate, "
    "round(sum(good) / nullif(sum(cites), 0), 3) AS citation_verified_rate, round(avg(citation_precision) FILTER (WHERE yes), 3) AS citation_precision, round(avg(context_recall) FILTER (WHERE yes), 3) AS context_recall, count(*) FILTER (WHERE outcome IN ('error', 'judge_error')) AS errors, "
    f"{_pct('ms', 0.5)} AS latency_p50, {_pct('ms', 0.95)} AS latency_p95, {_pct('llm', 0.5)} AS llm_p50, round(avg(completion_tokens), 3) AS completion_tokens_mean FROM x GROUP BY run_id",
    "citation_precision": f"WITH {_RESULTS}, {_GOLDEN}, {_REFS}, t AS (SELECT run_id, id, unnest(citations) AS c FROM r), v AS (SELECT row_number() OVER () AS k, run_id, id, c.scope AS scope, c.sections AS sections FROM t WHERE c.verified), "
    f"m AS (SELECT DISTINCT k FROM v JOIN refs ON refs.id = v.id AND refs.scope IS NOT DISTINCT FROM v.scope WHERE len(list_filter(v.sections, lambda x: {_COVERS.format('x', 'refs.section')})) > 0) SELECT run_id, id, round(count(m.k) / count(*), 6) AS citation_precision FROM v LEFT JOIN m USING (k) GROUP BY run_id, id",
    "threshold_sweep": f"WITH {_SWEEP} SELECT threshold, accuracy FROM sw",
    "best_threshold": f"WITH {_SWEEP} SELECT threshold, accuracy FROM sw ORDER BY accuracy DESC, threshold LIMIT 1",
    "judge_agreement": f"WITH {_RESULTS}, l AS (SELECT id, answer_hash, judge AS label FROM r WHERE citations_verified > 0 AND judge IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, answer_hash ORDER BY run_id DESC) = 1) SELECT count(*) AS compared, round(avg((judge.verdict IS NOT DISTINCT FROM label.verdict)::INT), 3) AS verdict, round(avg((judge.overstated IS NOT DISTINCT FROM label.overstated)::INT), 3) AS overstated, round(avg((judge.missing_condition IS NOT DISTINCT FROM label.missing_condition)::INT), 3) AS missing_condition FROM r JOIN l USING (id, answer_hash) WHERE judge IS NOT NULL",
    "golden_profile": f"WITH {_GOLDEN} " + " UNION ALL ".join(f"SELECT '{f}' AS field, {f} AS value, count(*) AS n FROM g GROUP BY {f}" for f in ("status", "type", "lang", "source", "split")),
    "gold_text": f"WITH {_GOLDEN}, {_REFS}, {_BLOCKS}, o AS (SELECT *, CASE WHEN scope IS NOT DISTINCT FROM lag(scope) OVER (PARTITION BY doc_id ORDER BY ordinal) THEN 0 ELSE 1 END AS moved FROM b WHERE role = 'body'), s AS (SELECT *, sum(moved) OVER (PARTITION BY doc_id ORDER BY ordinal) AS stay FROM o), k AS (SELECT *, last_value(section_number IGNORE NULLS) OVER (PARTITION BY doc_id, stay ORDER BY ordinal) AS under FROM s) "
    f"SELECT refs.id, refs.ref_no::INT AS ref_no, string_agg(k.text, chr(10) ORDER BY k.ordinal, k.text) AS text FROM k JOIN refs ON refs.doc_id = k.doc_id AND refs.scope IS NOT DISTINCT FROM k.scope WHERE CASE WHEN refs.section IS NOT NULL THEN coalesce({_COVERS.format('k.under', 'refs.section')}, false) ELSE coalesce(k.page_number = refs.page, false) END GROUP BY ALL",
    "unknown_gold": f"WITH {_GOLDEN}, {_REFS}, {_BLOCKS} SELECT id, ref_no::INT AS ref_no, doc_id FROM refs WHERE doc_id NOT IN (SELECT doc_id FROM b GROUP BY doc_id HAVING max(page_number) > 10)",
    "section_match": f"WITH {_GOLDEN}, {_REFS}, {_CHUNKS} SELECT refs.id, ref_no::INT AS ref_no, c.id AS chunk_id FROM refs JOIN c ON c.doc_id = refs.doc_id AND c.scope = refs.scope WHERE section IS NOT NULL AND len(list_filter(c.sections, lambda x: {_COVERS.format('x', 'refs.section')})) > 0",
    "longest_shared_run": f"WITH {_GOLDEN}, t AS (SELECT id, {_TOKENS.format('question')} AS a, {_TOKENS.format('answer')} AS b FROM g WHERE question IS NOT NULL AND answer IS NOT NULL), x AS (SELECT id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS w FROM t), y AS (SELECT id, unnest(range(1, len(b) + 1)) AS j, unnest(b) AS w FROM t), "
    "m AS (SELECT id, j - i AS d, i FROM x JOIN y USING (id, w)), n AS (SELECT id, d, i - row_number() OVER (PARTITION BY id, d ORDER BY i) AS k FROM m), z AS (SELECT id, max(c) AS run FROM (SELECT id, d, k, count(*) AS c FROM n GROUP BY ALL) GROUP BY id) SELECT t.id, coalesce(run, 0) AS run FROM t LEFT JOIN z USING (id)",
    "not_fully_correct": f"WITH {_RESULTS} SELECT run_id, outcome, count(*) AS n FROM r WHERE score IS NULL OR score < 1 GROUP BY ALL",
    "role_samples": f"WITH {_BLOCKS}, f AS (SELECT doc_id, role, text, min(ordinal) AS first_at FROM b GROUP BY ALL) SELECT doc_id, role, text, row_number() OVER (PARTITION BY doc_id, role ORDER BY first_at, text)::INT AS n FROM f QUALIFY n <= 5",
    "judge_cache_keys": f"WITH {_RESULTS}, k AS (SELECT question, coalesce(answer, '') AS a, count(*) AS uses FROM r GROUP BY ALL) SELECT uses, count(*) AS keys FROM k GROUP BY uses",
    "parse_replies": f"WITH {_RESULTS}, k AS (SELECT *, answer IS NULL OR covered IS NULL OR coalesce(prompt_tokens % 5 = 0, false) AS bad FROM r) SELECT run_id, id, CASE WHEN coalesce(prompt_tokens % 5 = 0, false) THEN 'JSONDecodeError' WHEN bad THEN 'ValidationError' END AS error, CASE WHEN bad THEN false ELSE covered END AS covered, CASE WHEN bad THEN '' ELSE answer END AS answer, CASE WHEN bad THEN 0 ELSE coalesce(len(citations), 0) END::INT AS cited FROM k",
    "verify_citations": f"WITH {_RESULTS}, {_CHUNKS}, t AS (SELECT run_id, id, citations, unnest(range(1, len(citations) + 1)) AS k FROM r), e AS (SELECT run_id, id, (k - 1)::INT AS seq, citations[k].chunk_id AS chunk_id, citations[k].quote AS quote FROM t) "
    f"SELECT e.run_id, e.id, e.seq, coalesce({_match('e.quote')} <> '' AND contains({_match('c.text')}, {_match('e.quote')}), false) AS verified FROM e LEFT JOIN c ON c.id = e.chunk_id",
    "scope_titles": f"WITH {_EVENTS}, t AS (SELECT *, first_value(CASE WHEN heads IS NOT NULL THEN heading_level END IGNORE NULLS) OVER (PARTITION BY doc_id, segment ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS lv FROM ev WHERE segment > 0), "
    "o AS (SELECT *, coalesce(heads IS NULL AND num IS NULL AND coalesce(heading_level, 0) > 0 AND heading_level <= lv + 1, false) AS opens FROM t), k AS (SELECT *, sum(CASE WHEN heads IS NULL AND NOT opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, segment ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS closed FROM o), "
    f"p AS (SELECT doc_id, segment, scope_now, ordinal, CASE WHEN closed = 0 THEN {_TITLE_PART} END AS part FROM k), "
    "l AS (SELECT doc_id, segment, max(scope_now) AS scope, min(ordinal) AS first_ordinal, list(part ORDER BY ordinal) FILTER (WHERE part <> '') AS parts FROM p GROUP BY doc_id, segment) "
    "SELECT doc_id, segment::INT AS segment, scope, coalesce(substr(list_reduce(parts, lambda a, b: CASE WHEN ends_with(a, '-') AND regexp_matches(b, '^\\p{Ll}') THEN a || b ELSE a || ' ' || b END), 1, 200), '') AS title, first_ordinal FROM l",
    "all_references": f"WITH {_CHUNKS}, {_FOUND} SELECT id, doc_id, seq, scope, section, figure, cross_scope FROM found",
    "resolve_references": f"WITH {_CHUNKS}, {_LED} SELECT id, seq, target_id, match FROM led",
    "expand_context": f"WITH {_CONTEXT} SELECT * FROM ctx",
    "prompt_render": f"WITH {_CONTEXT}, tag AS (SELECT query_id, substr(label, 2)::INT AS n, '<chunk id=\"' || label || '\" source=\"' || replace(replace(replace({_SOURCE}, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;') || '\">' || chr(10) || coalesce(header, '') || chr(10) || coalesce(text, '') || chr(10) || '</chunk>' || chr(10) || chr(10) AS t "
    "FROM (SELECT ctx.query_id, ctx.label, c.* FROM ctx JOIN c ON c.id = ctx.chunk_id)), j AS (SELECT query_id, string_agg(t, '' ORDER BY n) AS body FROM tag GROUP BY query_id) "
    "SELECT q.query_id, 'Regulation excerpts:' || chr(10) || chr(10) || coalesce(body, '') || 'Question: ' || q.query || chr(10) || chr(10) || 'Respond with a JSON object: {\"answer\": \"\\u2026\", \"citations\": [{\"chunk\": \"C1\", \"quote\": \"\\u2026\"}], \"covered\": true}' AS prompt FROM q LEFT JOIN j USING (query_id)",
    "judge_disagreements": f"WITH {_RESULTS} SELECT run_id, id, id || ': human=' || l.v || ' judge=' || judge.verdict || ' (' || substr(coalesce(judge.explanation, ''), 1, 80) || ')' AS disagreement FROM r JOIN (SELECT id, answer_hash, arg_max(CASE WHEN coalesce(prompt_tokens % 3 = 0, false) THEN 'incorrect' ELSE judge.verdict END, run_id) AS v FROM r WHERE judge IS NOT NULL GROUP BY ALL) l USING (id, answer_hash) WHERE judge IS NOT NULL AND judge.verdict IS DISTINCT FROM l.v",
    "parse_verdicts": f"WITH {_RESULTS}, k AS (SELECT *, coalesce(prompt_tokens % 5 = 0, false) OR judge.verdict IS NULL AS bad FROM r WHERE judge IS NOT NULL) SELECT run_id, id, CASE WHEN NOT bad THEN judge.verdict END AS verdict, CASE WHEN NOT bad THEN coalesce(judge.overstated, false) END AS overstated, bad AS failed FROM k",
    "question_records": f"WITH {_SCORES}, w AS (SELECT query_id, max(CASE WHEN stage = 'fused' THEN first_rank END) AS f, max(CASE WHEN stage = 'reranked' THEN first_rank END) AS l, max(CASE WHEN stage = 'fused' THEN recall_20 END) AS r20 FROM scores GROUP BY query_id), "
    "tops AS (SELECT p.query_id, max(CASE WHEN final_rank = 1 THEN rerank_score END) AS top1_rerank, string_agg(coalesce(c.scope, '') || ' / ' || CASE WHEN len(c.sections) > 0 THEN c.sections[1] || '..' || c.sections[-1] ELSE 'p.' || c.page_start END, '; ' ORDER BY final_rank) AS top_hits FROM pool p JOIN c ON c.id = p.chunk_id WHERE is_candidate AND final_rank <= 5 GROUP BY p.query_id) "
    "SELECT q.query_id, g.type, g.split, top1_rerank, coalesce(top_hits, '') AS top_hits, round(r20, 6) AS fused_recall_20, CASE WHEN w.query_id IS NULL THEN NULL WHEN l <= 5 THEN 'ok' WHEN f IS NULL THEN 'not_retrieved' WHEN f > 20 THEN 'below_cutoff' ELSE 'lost_in_rerank' END AS diagnosis FROM q JOIN g ON g.id = q.query_id LEFT JOIN tops USING (query_id) LEFT JOIN w USING (query_id)",
}
