"""DuckDB SQL for the queries, written independently of the Spark plans."""

from __future__ import annotations

from framewise.functions.text import STOPWORDS

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _tokens(text: str) -> str:
    """Search terms of a text; the tables hold no scripts without word spaces."""
    words = rf"regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}_]+')"
    return rf"list_filter({words}, lambda t: t NOT IN ({_STOP}) AND (length(t) > 1 OR regexp_matches(t, '^\p{{Nd}}$')))"


_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_DOT = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
_FORMS = "regexp_extract_all(text, '[A-Z][a-z]{5,}')"
_QV = "(SELECT embedding FROM embeddings WHERE vec_id = 7)"
_QT = "(SELECT embedding FROM embeddings WHERE vec_id = 11)"

# the distinct names of a text, in order of their first places
_NAMES = f"(SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(f) AS x, generate_subscripts(f, 1) AS i FROM (SELECT {_FORMS} AS f)) GROUP BY x))"

_TEXTS = f"""
ts AS MATERIALIZED (
  SELECT doc_id AS row, 'c' || lpad(CAST(doc_id // 100 AS VARCHAR), 15, '0') AS content_id, CAST(doc_id % 100 AS INTEGER) AS shot_id, CAST(doc_id % 100 // 5 AS INTEGER) AS scene_id,
    text, text AS dialogue_en, source AS ocr_text, coalesce({_NAMES}, CAST([] AS VARCHAR[])) AS entities, doc_id IN (SELECT doc_id FROM labels) AS d_mask
  FROM documents
)"""

_ENTITY = """
term AS (SELECT lower(entities[1]) AS e FROM p WHERE len(entities) > 0 ORDER BY row LIMIT 1),
ent AS (
  SELECT row, CAST(list_contains(list_transform(entities, lambda x: lower(x)), e)
      OR regexp_matches(lower(dialogue_en || ' ' || ocr_text), '(^|[^\\p{L}\\p{N}_])' || e || '($|[^\\p{L}\\p{N}_])') AS DOUBLE) AS entity
  FROM p, term
)"""

#: The texts as shots, then those of them that have vectors; p is what the terms are looked up in.
_TEXT_P = f"{_TEXTS}, p AS (SELECT * FROM ts), {_ENTITY}"
_PLAIN = f"""{_TEXTS},
n AS (SELECT count(*) AS n FROM embeddings),
p AS MATERIALIZED (SELECT ts.*, e.embedding AS v, f.embedding AS d FROM ts JOIN embeddings e ON row = e.vec_id, n JOIN embeddings f ON f.vec_id = (row + 1) % n.n),
{_ENTITY}"""

_CENTER = f"""
cm AS (SELECT i, avg(CAST(v[i] AS DOUBLE)) AS m FROM p JOIN ent USING (row), range(1, 65) r(i) WHERE entity > 0 GROUP BY i),
center AS (SELECT list(m / greatest(s, 1e-8) ORDER BY i) AS c FROM cm, (SELECT sqrt(sum(m * m)) AS s FROM cm) WHERE (SELECT count(*) FROM ent WHERE entity > 0) BETWEEN 1 AND (SELECT count(*) - 1 FROM ent))"""

_SHOTS = f"""{_PLAIN},
sim AS (SELECT row, vec_id AS rep, {_DOT.format("v", "embedding")} AS sim FROM p, embeddings WHERE vec_id % 25 = 0),
near AS (SELECT row, rep, least(greatest(sim, 0), 1) AS conf FROM sim QUALIFY row_number() OVER (PARTITION BY row ORDER BY sim DESC, rep) = 1),
s AS (
  SELECT p.*, conf, d2.text AS caption, e2.embedding AS c,
    {_tokens("p.dialogue_en || ' ' || d2.text || ' ' || p.ocr_text || ' ' || array_to_string(p.entities, ' ')")} AS tokens
  FROM p JOIN near USING (row) JOIN documents d2 ON d2.doc_id = rep JOIN embeddings e2 ON e2.vec_id = rep
)"""


def _bm25(docs: str) -> str:
    """CTEs for the collection docs(row, tokens): its postings and inverse frequencies."""
    return f"""
dl AS MATERIALIZED (SELECT row, len(tokens) AS dl, tokens FROM {docs}),
st AS MATERIALIZED (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
tf AS MATERIALIZED (SELECT row, dl, term, count(*) AS tf FROM (SELECT row, dl, unnest(tokens) AS term FROM dl) GROUP BY ALL),
raw AS MATERIALIZED (SELECT term, count(*) AS df, ln(any_value(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, st GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def _asked(queries: str) -> str:
    """CTEs for the scores, plain and over the query's greatest, of queries(query_id, term)."""
    return f"""
bm AS MATERIALIZED (
  SELECT query_id, row, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25
  FROM {queries} JOIN idf USING (term) JOIN tf USING (term), st GROUP BY query_id, row
),
bn AS (SELECT query_id, row, CASE WHEN max(bm25) OVER (PARTITION BY query_id) > 0 THEN bm25 / max(bm25) OVER (PARTITION BY query_id) ELSE 0 END AS bm25 FROM bm)"""


_DOCS = f"""docs AS (SELECT doc_id AS row, {_tokens("text")} AS tokens FROM documents), {_bm25("docs")}"""
_DOCS_BM = f"""{_DOCS},
q AS (SELECT item_id AS query_id, unnest({_tokens("text || ' ' || text[1:20]")}) AS term FROM benchmark), {_asked("q")}"""

_SCORED = f"""{_SHOTS}, {_CENTER},
q AS (SELECT 0 AS query_id, unnest({_tokens("text")}) AS term FROM benchmark WHERE item_id = 0), {_bm25("s")}, {_asked("q")},
x AS (
  SELECT s.row, content_id, shot_id, scene_id, conf, entity, coalesce(bn.bm25, 0) AS bm25, {_DOT.format("v", _QV)} AS vis, CASE WHEN d_mask THEN {_DOT.format("d", _QT)} END AS dia,
    {_DOT.format("c", _QT)} AS cap, {_DOT.format("v", "(SELECT c FROM center)")} AS anc
  FROM s JOIN ent ON s.row = ent.row LEFT JOIN bn ON bn.row = s.row
),
w AS (
  SELECT *, 0.35 * greatest(0, least(3, (vis - avg(vis) OVER ()) / stddev_pop(vis) OVER ())) / 3 AS w_visual,
    CASE WHEN dia IS NULL THEN 0 ELSE 0.25 * greatest(0, least(3, (dia - avg(dia) OVER ()) / stddev_pop(dia) OVER ())) / 3 END AS w_dialogue,
    conf * 0.15 * greatest(0, least(3, (cap - avg(cap) OVER ()) / stddev_pop(cap) OVER ())) / 3 AS w_caption,
    0.15 * bm25 AS w_bm25, 0.1 * entity AS w_entity, CASE WHEN anc IS NULL THEN 0 ELSE 0.05 * greatest(0, least(3, (anc - avg(anc) OVER ()) / stddev_pop(anc) OVER ())) / 3 END AS w_anchor
  FROM x
),
cand AS (
  SELECT row FROM (FROM x ORDER BY vis DESC, row LIMIT {{k}}) UNION SELECT row FROM (FROM x WHERE dia IS NOT NULL ORDER BY dia DESC, row LIMIT {{k}})
  UNION SELECT row FROM (FROM x ORDER BY cap DESC, row LIMIT {{k}}) UNION SELECT row FROM (FROM x WHERE anc IS NOT NULL ORDER BY anc DESC, row LIMIT {{k}})
  UNION SELECT row FROM (FROM x WHERE bm25 > 0 ORDER BY bm25 DESC, row LIMIT {{k}}) UNION SELECT row FROM (FROM x WHERE entity > 0 ORDER BY entity + 1e-3 * bm25 DESC, row LIMIT {{k}})
),
t AS (SELECT *, w_visual + w_dialogue + w_caption + w_bm25 + w_entity + w_anchor AS score FROM w)"""


def _ranked(where: str, top: int, k: int = 512) -> str:
    return f"""WITH {_SCORED.replace("{k}", str(k))}
SELECT row, content_id, shot_id, scene_id, round(score, 6) AS score, round(w_visual, 6) AS w_visual, round(w_dialogue, 6) AS w_dialogue, round(w_caption, 6) AS w_caption, round(w_bm25, 6) AS w_bm25,
  round(w_entity, 6) AS w_entity, round(w_anchor, 6) AS w_anchor, round(vis, 6) AS raw_visual, round(dia, 6) AS raw_dialogue, round(cap, 6) AS raw_caption
FROM (SELECT * FROM t WHERE score > 0 {where} QUALIFY row_number() OVER (PARTITION BY content_id, scene_id ORDER BY round(score, 9) DESC, row) = 1)
ORDER BY round(score, 9) DESC, row LIMIT {top}"""


_BATCH = f"""WITH {_SHOTS},
i AS MATERIALIZED (SELECT item_id AS query_id, {_tokens("b.text")} AS tokens, e1.embedding AS qv, e2.embedding AS qt, lower(p.entities[1]) AS e
  FROM benchmark b JOIN embeddings e1 ON e1.vec_id = item_id JOIN embeddings e2 ON e2.vec_id = item_id + 1 LEFT JOIN p ON p.row = item_id),
q AS (SELECT query_id, unnest(tokens) AS term FROM i), {_bm25("s")}, {_asked("q")},
en AS MATERIALIZED (SELECT query_id, row, CASE WHEN e IS NULL THEN 0 WHEN list_contains(low, e) THEN 1.0 WHEN contains(said, e) THEN CAST(regexp_matches(said, '(^|[^\\p{{L}}\\p{{N}}_])' || e || '($|[^\\p{{L}}\\p{{N}}_])') AS DOUBLE) ELSE 0 END AS entity
  FROM (SELECT DISTINCT query_id, e FROM i), (SELECT row, list_transform(entities, lambda x: lower(x)) AS low, lower(dialogue_en || ' ' || ocr_text) AS said FROM s)),
hits AS (SELECT query_id FROM en GROUP BY query_id HAVING count(*) FILTER (entity > 0) > 0 AND count(*) FILTER (entity > 0) < count(*)),
qm AS (SELECT query_id, k, avg(CAST(v[k] AS DOUBLE)) AS m FROM en JOIN hits USING (query_id) JOIN s USING (row), range(1, 65) r(k) WHERE entity > 0 GROUP BY query_id, k),
qc AS (SELECT query_id, list(m / greatest(l, 1e-8) ORDER BY k) AS c FROM qm JOIN (SELECT query_id, sqrt(sum(m * m)) AS l FROM qm GROUP BY query_id) USING (query_id) GROUP BY query_id),
x AS (
  SELECT i.query_id, s.row, content_id, scene_id, conf, entity, coalesce(bn.bm25, 0) AS bm25, {_DOT.format("v", "qv")} AS vis, CASE WHEN d_mask THEN {_DOT.format("d", "qt")} END AS dia,
    {_DOT.format("s.c", "qt")} AS cap, CASE WHEN qc.c IS NOT NULL THEN {_DOT.format("v", "qc.c")} END AS anc
  FROM i CROSS JOIN s JOIN en ON en.query_id = i.query_id AND en.row = s.row LEFT JOIN bn ON bn.query_id = i.query_id AND bn.row = s.row LEFT JOIN qc ON qc.query_id = i.query_id
), w AS (
  SELECT *, 0.35 * greatest(0, least(3, (vis - avg(vis) OVER g) / stddev_pop(vis) OVER g)) / 3 AS w_visual,
    CASE WHEN dia IS NULL THEN 0 ELSE 0.25 * greatest(0, least(3, (dia - avg(dia) OVER g) / stddev_pop(dia) OVER g)) / 3 END AS w_dialogue,
    conf * 0.15 * greatest(0, least(3, (cap - avg(cap) OVER g) / stddev_pop(cap) OVER g)) / 3 AS w_caption,
    0.15 * bm25 AS w_bm25, 0.1 * entity AS w_entity, CASE WHEN anc IS NULL THEN 0 ELSE 0.05 * greatest(0, least(3, (anc - avg(anc) OVER g) / stddev_pop(anc) OVER g)) / 3 END AS w_anchor
  FROM x WINDOW g AS (PARTITION BY query_id)
), t AS (SELECT *, w_visual + w_dialogue + w_caption + w_bm25 + w_entity + w_anchor AS score FROM w),
u AS (SELECT * FROM t WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id, content_id, scene_id ORDER BY round(score, 9) DESC, row) = 1)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, row) AS INTEGER) AS place, row, round(score, 6) AS score, round(w_visual, 6) AS w_visual, round(w_dialogue, 6) AS w_dialogue,
  round(w_caption, 6) AS w_caption, round(w_bm25, 6) AS w_bm25, round(w_entity, 6) AS w_entity, round(w_anchor, 6) AS w_anchor FROM u QUALIFY place <= 3"""

_CAPTION = r"""list_filter(list_transform(string_split_regex(regexp_replace(trim(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '[\s]+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"""


def _caption(raw: str, most: int) -> str:
    sentences = _CAPTION.format(raw)
    return f"array_to_string(list_filter(ss, lambda x, i: list_position(list_transform(ss, lambda y: lower(y)), lower(x)) = i)[1:{most}], ' ')", sentences


_REGISTRY = """
r AS (
  SELECT substr(sha1('/footage/' || c_name), 1, 10) AS footage_key, '/footage/' || c_name AS path, 'c' || lpad(CAST(c_custkey % 40 AS VARCHAR), 15, '0') AS content_id, CAST(floor(abs(c_acctbal)) AS BIGINT) AS size,
    CAST(c_custkey * 1000 AS BIGINT) AS mtime_ns, CAST(c_custkey AS BIGINT) AS item_id, 25.0::DOUBLE AS frame_rate, CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 2 END AS format_version,
    CASE WHEN c_custkey % 11 = 0 THEN 'stale' WHEN c_custkey % 7 = 0 THEN 'error' WHEN c_custkey % 3 = 0 THEN 'indexing' ELSE 'ready' END AS state, CAST(c_custkey % 50 AS INTEGER) AS shot_count,
    CAST(c_custkey % 90 * 10.0 AS DOUBLE) AS duration_s, CASE WHEN c_custkey % 5 = 0 THEN CAST(floor(abs(c_acctbal)) AS BIGINT) + 1 END AS pending_size,
    CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey * 1000 AS BIGINT) END AS pending_mtime_ns, CASE WHEN c_custkey % 5 = 0 THEN 1 END AS pending_hits, c_custkey
  FROM customer
),
sn AS (
  SELECT substr(sha1('/footage/' || c_name), 1, 10) AS footage_key, '/footage/' || c_name AS path, CAST(CASE WHEN c_custkey % 19 = 0 THEN -1 WHEN c_custkey % 4 = 0 THEN floor(abs(c_acctbal)) + 1 ELSE floor(abs(c_acctbal)) END AS BIGINT) AS size,
    CAST(CASE WHEN c_custkey % 19 = 0 THEN 0 ELSE c_custkey * 1000 END AS BIGINT) AS mtime_ns, CAST(c_custkey AS BIGINT) AS item_id, 25.0::DOUBLE AS frame_rate
  FROM customer WHERE c_custkey % 17 <> 0
  UNION ALL SELECT substr(sha1('/new/' || s_name), 1, 10), '/new/' || s_name, CAST(floor(abs(s_acctbal)) AS BIGINT), CAST(s_suppkey AS BIGINT), CAST(s_suppkey AS BIGINT), 30.0 FROM supplier
),
b AS (
  SELECT * FROM (
    SELECT coalesce(sn.footage_key, r.footage_key) AS footage_key,
      CASE WHEN sn.path IS NULL THEN CASE WHEN r.state <> 'stale' THEN 'removed' END
        WHEN r.path IS NULL OR r.state = 'stale' THEN CASE WHEN sn.size > 0 AND sn.mtime_ns > 0 THEN 'added' ELSE 'pending' END
        WHEN NOT (sn.size > 0 AND sn.mtime_ns > 0) THEN 'unchanged'
        WHEN r.format_version <> 2 THEN 'changed'
        WHEN r.size = sn.size AND r.mtime_ns = sn.mtime_ns THEN 'unchanged'
        WHEN r.pending_size = sn.size AND r.pending_mtime_ns = sn.mtime_ns AND r.pending_hits + 1 >= 2 THEN 'changed'
        ELSE 'pending' END AS bucket
    FROM sn FULL JOIN r ON sn.footage_key = r.footage_key
  ) WHERE bucket IS NOT NULL
)"""

_JOBS = """
j AS (
  SELECT 'j' || o_orderkey AS job_id, CAST(o_custkey % 500 AS BIGINT) AS content_id, CASE WHEN o_orderkey % 5 = 0 THEN 'running' WHEN o_orderkey % 7 = 0 THEN 'queued' WHEN o_orderkey % 11 = 0 THEN 'error' ELSE 'done' END AS state,
    CAST(o_custkey % 97 AS DOUBLE) AS created_at FROM orders
),
lj AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY created_at DESC, job_id DESC) = 1),
vj AS (SELECT * FROM j WHERE state IN ('running', 'queued') QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY created_at DESC, job_id DESC) = 1),
ln AS (SELECT l_orderkey AS content_id, l_linenumber AS ln, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS length FROM lineitem GROUP BY ALL),
ch AS (
  SELECT content_id, unnest(CASE WHEN content_id % 7 = 2 AND ln = 3 THEN [16, 35] WHEN content_id % 5 = 1 AND ln = 1 THEN [10, 15] ELSE [10 * ln] END) AS seq, length,
    CAST(coalesce(sum(length) OVER (PARTITION BY content_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN content_id % 3 = 0 AND ln = 3 THEN 1 ELSE 0 END AS BIGINT) AS off,
    CAST(sum(length) OVER (PARTITION BY content_id) + CASE WHEN content_id % 11 = 3 AND ln = 2 THEN 1 ELSE 0 END AS BIGINT) AS size
  FROM ln
),
ck AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY seq) AS k FROM ch),
fold(content_id, k, received, size) AS (
  SELECT DISTINCT content_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ln
  UNION ALL
  SELECT f.content_id, c.k, CASE WHEN fits THEN f.received + c.length ELSE f.received END, CASE WHEN fits THEN c.size ELSE f.size END
  FROM (SELECT f.content_id, f.k, f.received, f.size, c.length, c.size AS declared, c.off = f.received AND (f.received = 0 OR c.size = f.size) AND c.off + c.length <= c.size AND (f.size = 0 OR f.received < f.size) AS fits
    FROM fold f JOIN ck c ON c.content_id = f.content_id AND c.k = f.k + 1) f JOIN ck c ON c.content_id = f.content_id AND c.k = f.k + 1
),
up AS (SELECT content_id, received, size FROM fold QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY k DESC) = 1)"""

_SEGMENTS = """
g AS (
  SELECT conv_id, turn AS seg_id, text, 4.0 * turn AS s, 4.0 * turn + 5.0 AS e, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM conversations
),
sp AS (SELECT conv_id, unnest(range(0, CAST(floor((max(e) - 1e-9) / 8.0) AS BIGINT) + 1)) AS shot_id FROM g GROUP BY conv_id),
win AS (SELECT conv_id, CAST(shot_id AS INTEGER) AS shot_id, 8.0 * shot_id - {pad} AS t0, 8.0 * shot_id + 8.0 + {pad} AS t1 FROM sp)"""


def _said(pad: float) -> str:
    inside = "list_filter(ws, lambda w, i: s + 5.0 * i / len(ws) > t0 AND s + 5.0 * (i - 1) / len(ws) < t1)"
    part = f"CASE WHEN seg_id % 2 = 1 OR len(ws) = 0 THEN ' ' || text WHEN NOT contains(text, ' ') THEN array_to_string({inside}, '') ELSE ' ' || array_to_string({inside}, ' ') END"
    return f"""WITH {_SEGMENTS.replace("{pad}", str(pad))},
m AS (SELECT win.conv_id, shot_id, string_agg({part}, '' ORDER BY seg_id) AS said FROM win JOIN g ON g.conv_id = win.conv_id AND e > t0 AND s < t1 GROUP BY ALL)
SELECT conv_id, shot_id, coalesce(trim(regexp_replace(said, '\\s+', ' ', 'g')), '') AS said FROM win LEFT JOIN m USING (conv_id, shot_id)"""


def _shot_rows(columns: str) -> str:
    """Shot rows of conversations: both tracks, the exact window and one three seconds wider, entities in order."""
    inside = "list_filter(ws, lambda w, i: s + 5.0 * i / len(ws) > t0 AND s + 5.0 * (i - 1) / len(ws) < t1)"
    part = f"CASE WHEN seg_id % 2 = 1 OR len(ws) = 0 THEN ' ' || text WHEN NOT contains(text, ' ') THEN array_to_string({inside}, '') ELSE ' ' || array_to_string({inside}, ' ') END"
    tidy = lambda x: f"coalesce(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"
    return f"""WITH {_SEGMENTS.replace("{pad}", "3.0")},
ex AS (SELECT conv_id, shot_id, 8.0 * shot_id AS x0, 8.0 * shot_id + 8.0 AS x1, t0, t1 FROM win),
a AS (SELECT ex.conv_id, shot_id, string_agg(' src ' || text, '' ORDER BY seg_id) AS said FROM ex JOIN g ON g.conv_id = ex.conv_id AND e > x0 AND s < x1 GROUP BY ALL),
b AS (SELECT ex.conv_id, shot_id, string_agg({part}, '' ORDER BY seg_id) AS en, string_agg(' src ' || text, '' ORDER BY seg_id) AS src FROM ex JOIN g ON g.conv_id = ex.conv_id AND e > t0 AND s < t1 GROUP BY ALL),
n AS (SELECT conv_id, seg_id, i, CASE WHEN seg_id % 3 = 0 THEN upper(x) ELSE x END AS form FROM (SELECT conv_id, seg_id, unnest(f) AS x, generate_subscripts(f, 1) AS i FROM (SELECT conv_id, seg_id, regexp_extract_all(text, '[A-Z][a-z]{{3,}}') AS f FROM g))),
o AS (SELECT conv_id, shot_id, CASE WHEN shot_id % 4 = 0 THEN 'Paris' ELSE 'PARIS' END AS form FROM win WHERE shot_id % 2 = 0),
al AS (SELECT conv_id, 0 AS t, seg_id AS y, i, form FROM n UNION ALL SELECT conv_id, 1, shot_id, 0, form FROM o),
vo AS (SELECT conv_id, form FROM (SELECT conv_id, form, count(*) AS c, min((t, y, i)) AS f FROM al GROUP BY conv_id, form) QUALIFY row_number() OVER (PARTITION BY conv_id, lower(form) ORDER BY c DESC, f) = 1),
en AS (SELECT ex.conv_id, shot_id, 0 AS t, n.seg_id AS y, i, form FROM ex JOIN g ON g.conv_id = ex.conv_id AND e >= t0 AND s <= t1 JOIN n ON n.conv_id = g.conv_id AND n.seg_id = g.seg_id UNION ALL SELECT conv_id, shot_id, 1, 0, 0, form FROM o),
ec AS (SELECT en.conv_id, shot_id, vo.form AS form, min((t, y, i)) AS f FROM en JOIN vo ON vo.conv_id = en.conv_id AND lower(vo.form) = lower(en.form) GROUP BY ALL),
es AS (SELECT conv_id, shot_id, string_agg(form, ',' ORDER BY f) AS es FROM ec GROUP BY ALL),
rw AS (SELECT ex.conv_id AS content_id, ex.shot_id, {tidy("a.said")} AS transcript, {tidy("b.en")} AS dialogue_en, CASE WHEN ex.conv_id % 2 = 0 THEN {tidy("b.en")} ELSE {tidy("b.src")} END AS dialogue_src,
  len(list_filter(string_split({tidy("b.en")}, ' '), lambda w: w <> '')) >= 3 AS has_dialogue, coalesce(es, '') AS entities
  FROM ex LEFT JOIN a USING (conv_id, shot_id) LEFT JOIN b USING (conv_id, shot_id) LEFT JOIN es USING (conv_id, shot_id))
SELECT {columns} FROM rw"""


def _z(masked: bool) -> str:
    x = f"CASE WHEN d_mask THEN {_DOT.format('v', _QV)} END" if masked else _DOT.format("v", _QV)
    return f"WITH {_PLAIN}, x AS (SELECT row, {x} AS x FROM p) SELECT row, round(CASE WHEN x IS NULL THEN 0 ELSE least(greatest((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 0), 3) / 3 END, 6) AS z FROM x"


def _nearest(ctes: str, rows: str) -> str:
    """The ten rows(row, v) nearest to each embedding whose id is divisible by 50."""
    return f"""WITH {ctes}x AS (SELECT q.vec_id AS query_id, row, {_DOT.format("v", "q.embedding")} AS cosine FROM ({rows}), embeddings q WHERE q.vec_id % 50 = 0)
SELECT query_id, row, round(cosine, 6) AS cosine FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, row) <= 10"""


_VOCAB = f"""WITH {_TEXTS},
f AS (SELECT content_id, row * 2147483648 + i - 1 AS pos, CASE WHEN row % 3 = 0 THEN upper(e) ELSE e END AS form FROM (SELECT content_id, row, unnest(entities) AS e, generate_subscripts(entities, 1) AS i FROM ts)),
c AS (SELECT content_id, form, lower(form) AS key, count(*) AS n, min(pos) AS first FROM f GROUP BY ALL),
v AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY n DESC, first) - 1 AS pos FROM (FROM c QUALIFY row_number() OVER (PARTITION BY content_id, key ORDER BY n DESC, first) = 1))"""

_cap, _sent = _caption("'<s>' || text || ' </s>'", 3)
_cap2, _sent2 = _caption("text || ' ' || upper(text)", 2)

ORACLE_SQL = {
    "batch_fused_search": _BATCH,
    "fused_search": _ranked("", 8),
    "fused_search_candidates": _ranked("AND row IN (SELECT row FROM cand)", 5, 60),
    "set1_candidates": f"WITH {_SCORED.replace('{k}', '20')} SELECT row FROM cand",
    "batch_search": f"WITH {_DOCS_BM} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, row) AS INTEGER) AS place, row, round(bm25, 6) AS bm25 FROM bn QUALIFY place <= 3",
    "srt3_block_max": f"WITH {_DOCS_BM} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, row) AS INTEGER) AS place, row, round(bm25, 6) AS bm25 FROM bn QUALIFY place <= 10",
    "srt3_top_scored": "SELECT doc_id AS row, CAST(n_chars % 7 AS DOUBLE) AS s FROM documents WHERE n_chars % 7 > 0 ORDER BY n_chars % 7 + 1e-3 * (n_chars % 1000 / 1000.0) DESC, doc_id LIMIT 50",
    "win1_scene_dedupe": f"WITH {_PLAIN} SELECT row, content_id, scene_id, round(s, 6) AS score FROM (SELECT *, {_DOT.format('v', _QV)} AS s FROM p) WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY content_id, scene_id ORDER BY round(s, 9) DESC, row) = 1",
    "fn1_tokenize": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "fn2_bm25_doc": f"""SELECT doc_id, array_to_string({_tokens("text || ' ' || lang || ' ' || source || ' ' || lang || ' ' || source || CASE WHEN doc_id % 2 = 1 THEN ' other source' ELSE '' END")}, ' ') AS tokens FROM documents""",
    "fn5_clean_caption": f"SELECT doc_id, {_cap} AS caption FROM (SELECT doc_id, {_sent} AS ss FROM documents)",
    "fn6_l2norm": "SELECT vec_id AS row, 1.0::DOUBLE AS norm, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS first FROM embeddings",
    "fn8_zscore": _z(False),
    "fn8_zscore_masked": _z(True),
    "fn11_content_id": "SELECT doc_id, substr(sha1(encode(CAST(octet_length(b) AS VARCHAR)) || b[1:4194304] || CASE WHEN octet_length(b) > 4194304 THEN b[octet_length(b) - 4194303:] ELSE ''::BLOB END), 1, 16) AS content_id FROM (SELECT doc_id, encode(text) AS b FROM documents)",
    "fn12_footage_key": f"WITH {_REGISTRY} SELECT footage_key, path FROM r",
    "fn14_safe_extension": r"SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN '.mp4' ELSE '.bin' END AS ext FROM part",
    "fn16_timecode": """SELECT l_orderkey, l_linenumber, lpad(CAST(total // f // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(total // f // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(total // f % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(total % f AS VARCHAR), 2, '0') AS tc,
  CAST(c // 60 AS VARCHAR) || ':' || lpad(CAST(c % 60 AS VARCHAR), 2, '0') AS clock
FROM (SELECT *, CAST(floor(s * f + 1e-6) AS BIGINT) AS total, CAST(floor(s + 0.5) AS BIGINT) AS c FROM (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) / 3.0 AS s, CASE WHEN l_linenumber = 1 THEN 25 ELSE 23 + l_linenumber END AS f FROM lineitem))""",
    "fn18_step_number": """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN CAST(d // 60 AS VARCHAR) || ':' || lpad(CAST(d % 60 AS VARCHAR), 2, '0') || ' / 16:40'
  WHEN o_orderkey % 3 = 1 THEN CAST(d AS VARCHAR) || '.0/1000.0 MB' ELSE CAST(CAST(floor(d / 1000 * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' END AS step FROM (SELECT o_orderkey, CAST(o_orderkey % 900 AS BIGINT) AS d FROM orders)""",
    "fn19_names": """SELECT p_partkey, p_name AS base, CASE WHEN length(p_name) > 20 THEN p_name[1:19] || '…' ELSE p_name END AS short, '&lt;&#39;' || p_name || '&amp;&quot;&gt;' AS html FROM part""",
    "win6_ngrams": rf"""SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY n DESC, i) - 1 AS BIGINT) AS pos, gram FROM (
  SELECT item_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM benchmark), range(1, 4) a(n), (SELECT unnest(range(1, 1 + (SELECT max(length(text)) FROM benchmark))) AS i) b WHERE i + n - 1 <= len(w)
) WHERE n > 1 OR (length(gram) >= 3 AND gram NOT IN ({_STOP}))""",
    "win7_bigrams": "SELECT p_partkey, array_to_string(list_transform(range(1, greatest(1, length(w) - 1) + 1), lambda i: substr(w, i, 2)), '|') AS pairs FROM (SELECT p_partkey, string_split(p_name, ' ')[1] AS w FROM part)",
    "win8_sentences": f"SELECT item_id, {_cap2} AS kept FROM (SELECT item_id, {_sent2} AS ss FROM benchmark)",
    "agg1_key_stats": f"""WITH {_PLAIN} SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, count(*) AS n, round(avg(CAST(v[i] AS DOUBLE)), 6) AS mean, round(avg(CAST(v[i] AS DOUBLE) * CAST(v[j] AS DOUBLE)), 6) AS gram FROM p, range(1, 9) a(i), range(1, 9) b(j) GROUP BY i, j""",
    "agg2_moments": f"SELECT count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd FROM (SELECT {_DOT.format('embedding', _QV)} AS x FROM embeddings)",
    "agg4_bm25_stats": f"WITH {_DOCS} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "j6_bm25": f"WITH {_DOCS_BM} SELECT query_id, row, round(bm25, 6) AS bm25 FROM bm",
    "agg7_bm25_norm": f"WITH {_DOCS_BM} SELECT query_id, row, round(bm25, 6) AS bm25 FROM bn",
    "agg5_vector_sum": """WITH s AS (SELECT vec_id // 3 AS shot, i, sum(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) GROUP BY ALL), u AS (SELECT shot, i, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY shot)), 1e-8) AS u FROM s)
SELECT CAST(shot AS BIGINT) AS shot, round(max(u) FILTER (WHERE i = 1), 6) AS u0, round(max(u) FILTER (WHERE i = 2), 6) AS u1, round(max(u) FILTER (WHERE i = 64), 6) AS u63 FROM u GROUP BY shot""",
    "agg6_centroid": f"WITH {_PLAIN}, {_CENTER} SELECT round(c[1], 6) AS u0, round(c[2], 6) AS u1, round(c[64], 6) AS u63 FROM center",
    "agg8_vocab": f"{_VOCAB} SELECT content_id, CAST(pos AS INTEGER) AS pos, key, form FROM v",
    "agg9_merged_vocab": f"{_VOCAB} SELECT key, form, CAST(content_id[2:] AS BIGINT) AS place FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY content_id) = 1",
    "agg12_medoid": f"""WITH m AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY ALL), u AS (SELECT label, list(m / l ORDER BY i) AS u FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY label)) AS l FROM m) GROUP BY label)
SELECT label, vec_id AS row FROM embeddings JOIN u USING (label) QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_DOT.format('embedding', 'u')} DESC, vec_id) = 1""",
    "agg13_quota": f"""WITH {_REGISTRY}, w AS (SELECT b.footage_key, bucket, state, duration_s, coalesce(item_id, 0) % 97 AS tenant FROM b LEFT JOIN r USING (footage_key)),
f AS (SELECT tenant, count(DISTINCT footage_key) FILTER (WHERE bucket IN ('added', 'changed', 'unchanged')) AS n_active, coalesce(sum(duration_s) FILTER (WHERE bucket IN ('added', 'changed', 'unchanged') AND state = 'ready'), 0) / 60.0 AS minutes, bool_or(bucket IN ('added', 'changed')) AS fresh FROM w GROUP BY tenant),
g AS (SELECT f.*, CASE c_mktsegment WHEN 'BUILDING' THEN 50 WHEN 'FURNITURE' THEN 500 ELSE 3 END AS lf, CASE c_mktsegment WHEN 'BUILDING' THEN 600 WHEN 'FURNITURE' THEN 6000 ELSE 120 END AS lm FROM f LEFT JOIN (SELECT * FROM customer WHERE c_custkey < 97) ON c_custkey = tenant)
SELECT tenant, n_active, round(minutes, 6) AS minutes, NOT fresh OR (n_active <= lf AND minutes <= lm) AS allowed FROM g""",
    "agg16_summaries": f"WITH {_TEXTS} SELECT content_id, count(*) FILTER (WHERE len(list_filter(string_split_regex(dialogue_en, '\\s+'), lambda w: w <> '')) >= 3) AS with_dialogue, count(*) FILTER (WHERE len(entities) > 0) AS with_entities, count(*) FILTER (WHERE d_mask) AS masked, count(*) FILTER (WHERE row % 3 <> 0 AND ocr_text <> '') AS with_ocr FROM ts GROUP BY content_id",
    "agg16_also_failed": f"WITH {_REGISTRY} SELECT footage_key, (SELECT count(*) - 1 FROM r WHERE state = 'error') AS others FROM r WHERE state = 'error'",
    "flt11_wanted_owners": f"WITH {_REGISTRY}, k AS (SELECT footage_key FROM r WHERE item_id % 2 = 0) SELECT content_id, min(footage_key) AS footage_key FROM r JOIN k USING (footage_key) WHERE state = 'ready' GROUP BY content_id",
    "j1_transcript_window": _said(0.0),
    "j1_dialogue_window": _said(3.0),
    "j2_entity_window": f"WITH {_SEGMENTS.replace('{pad}', '3.0')} SELECT win.conv_id, shot_id, count(*) AS n, min(seg_id) AS first, max(seg_id) AS last FROM win JOIN g ON g.conv_id = win.conv_id AND e >= t0 AND s <= t1 GROUP BY ALL",
    "j4_propagate": f"SELECT a.vec_id AS row, b.vec_id AS rep, round(least(greatest({_DOT.format('a.embedding', 'b.embedding')}, 0), 1), 6) AS confidence FROM embeddings a, embeddings b WHERE b.vec_id % 25 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT.format('a.embedding', 'b.embedding')} DESC, b.vec_id) = 1",
    "j7_entity_score": f"WITH {_TEXT_P} SELECT row, round(entity / 2, 6) AS entity FROM ent",
    # all terms at issue are ones where swaps of neighbours and edits do not overlap, so the two distances agree
    "j8_fuzzy": """WITH k AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS key FROM part),
t(term) AS (VALUES ('anvli'), ('widgte'), ('glzmo'), ('boltt'), ('plaet'), ('smalll'), ('zz'), ('xxxxxx'), ('ring'), ('hott'), ('gera'), ('widdgett'), ('gizzmoo'), ('annvill'), ('pllatee'), ('wigdtee'), ('wxdgexy'))
SELECT term, key, CAST(damerau_levenshtein(term, key) AS BIGINT) AS d FROM t, k WHERE length(term) >= 4 AND damerau_levenshtein(term, key) <= CASE WHEN length(term) <= 6 THEN 1 ELSE 2 END
QUALIFY row_number() OVER (PARTITION BY term ORDER BY d, key) = 1""",
    # swaps may overlap with no other edit: what lies between the common ends must not be two characters against the same two
    # in turn with one between them (the built-in distance counts two there, the other one three); it also counts bytes, so
    # letters beyond ASCII first become capitals, which lower-cased words do not have
    "j8_fuzzy_words": r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS w FROM benchmark), x AS (SELECT w, w[1] || w[3] || w[2] || w[4:] AS s FROM w WHERE length(w) >= 4),
t AS (SELECT DISTINCT unnest(CASE WHEN length(w) >= 8 THEN [s, s[:5] || w[7:]] ELSE [s] END) AS term FROM x),
k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS key FROM documents),
l AS (SELECT term, CASE WHEN length(term) <= 6 THEN 1 ELSE 2 END AS most, unnest(range(length(term) - most, length(term) + most + 1)) AS n FROM t WHERE length(term) >= 4),
p AS (SELECT term, key, damerau_levenshtein(tt, kk) AS d, most FROM (SELECT *, translate(term, '{0}', '{1}') AS tt FROM l) JOIN (SELECT key, translate(key, '{0}', '{1}') AS kk FROM k) ON length(key) = n WHERE damerau_levenshtein(tt, kk) <= most),
e AS (SELECT *, len(list_filter(range(1, least(length(term), length(key)) + 1), lambda i: term[:i] = key[:i])) AS a FROM p),
f AS (SELECT *, len(list_filter(range(1, least(length(term), length(key)) - a + 1), lambda i: right(term, i) = right(key, i))) AS z FROM e),
g AS (SELECT *, term[a + 1:length(term) - z] AS u, key[a + 1:length(key) - z] AS v FROM f)
SELECT term, key, CAST(d AS BIGINT) AS d FROM g WHERE d < 2 OR NOT (length(u) + length(v) = 5 AND u[1] = v[-1] AND u[-1] = v[1])
QUALIFY row_number() OVER (PARTITION BY term ORDER BY d, key) = 1""".replace("{0}", "àáâäçèéêëìíîïñòóôöùúûüß").replace("{1}", "ABCDEFGHIJKLMNOPQRSTUVW"),
    # names as typed (gizmo), then runs of three words, two and one that are a key or near one
    "fn4_query_entities": f"""WITH k AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS key FROM part), w AS (SELECT ['show', 'the', 'widgte', 'anvli', 'and', 'gizmo'] AS w),
g AS (SELECT 3 - n AS a, i, array_to_string(w[i:i + n - 1], ' ') AS term FROM w, range(1, 4) x(n), range(1, 7) y(i) WHERE i + n - 1 <= 6),
m AS (SELECT a, i, key FROM g, k WHERE (a < 2 OR (length(term) >= 3 AND term NOT IN ({_STOP}))) AND (term = key OR (length(term) >= 4 AND NOT EXISTS (SELECT 1 FROM k k2 WHERE k2.key = term) AND damerau_levenshtein(term, key) <= CASE WHEN length(term) <= 6 THEN 1 ELSE 2 END))
  QUALIFY row_number() OVER (PARTITION BY a, i ORDER BY damerau_levenshtein(term, key), key) = 1),
o AS (SELECT key, min(place) AS place FROM (SELECT key, (a + 1) * 100 + i AS place FROM m UNION ALL SELECT 'gizmo', 0) GROUP BY key)
SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS pos, key AS entity FROM o""",
    "j9_owner": f"WITH {_REGISTRY} SELECT content_id, min(footage_key) AS footage_key, arg_min(path, footage_key) AS source_path FROM r WHERE state = 'ready' GROUP BY content_id",
    "j10_sync_diff": f"WITH {_REGISTRY} SELECT footage_key, bucket FROM b",
    "j11_apply_sync": f"""WITH {_REGISTRY}, m AS (SELECT coalesce(r.footage_key, b.footage_key) AS k, r.* EXCLUDE (footage_key), bucket, sn.path AS sp, sn.size AS ss, sn.mtime_ns AS sm, sn.item_id AS si, sn.frame_rate AS sf, r.path IS NOT NULL AS known, coalesce(bucket IN ('added', 'changed'), false) AS fresh
  FROM r FULL JOIN b ON r.footage_key = b.footage_key LEFT JOIN sn ON sn.footage_key = coalesce(r.footage_key, b.footage_key))
SELECT k AS footage_key, CASE WHEN fresh THEN sp ELSE path END AS path, CASE WHEN fresh THEN '' ELSE content_id END AS content_id, CASE WHEN fresh THEN ss ELSE size END AS size, CASE WHEN fresh THEN sm ELSE mtime_ns END AS mtime_ns,
  CASE WHEN fresh THEN si ELSE item_id END AS item_id, CASE WHEN fresh THEN sf ELSE frame_rate END AS frame_rate, CASE WHEN fresh THEN 2 ELSE format_version END AS format_version, CASE WHEN fresh THEN 'indexing' WHEN bucket = 'removed' THEN 'stale' ELSE state END AS state,
  CASE WHEN fresh THEN 0 ELSE shot_count END AS shot_count, CASE WHEN fresh THEN 0.0 ELSE duration_s END AS duration_s, CASE WHEN bucket = 'pending' THEN ss WHEN bucket IS NULL THEN pending_size END AS pending_size,
  CASE WHEN bucket = 'pending' THEN sm WHEN bucket IS NULL THEN pending_mtime_ns END AS pending_mtime_ns,
  CASE WHEN bucket = 'pending' THEN CASE WHEN pending_size = ss AND pending_mtime_ns = sm THEN pending_hits + 1 ELSE 1 END WHEN bucket IS NULL THEN pending_hits END AS pending_hits
FROM m WHERE known OR fresh""",
    "j12_knn": _nearest("", "SELECT vec_id AS row, embedding AS v FROM embeddings"),
    "j12_knn_masked": _nearest(f"{_PLAIN}, ", "SELECT row, d AS v FROM p WHERE d_mask"),
    "j16_stranded": f"WITH RECURSIVE {_REGISTRY}, {_JOBS} SELECT footage_key, state FROM r WHERE state IN ('error', 'indexing', 'uploading') AND footage_key NOT IN (SELECT substr(sha1('/footage/Customer#' || lpad(CAST(content_id AS VARCHAR), 9, '0')), 1, 10) FROM j WHERE state = 'running')",
    "j17_ocr_codes": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'ch_sim+en' WHEN lang IN ('fr', 'es', 'de', 'it') THEN lang || '+en' ELSE 'en' END AS ocr FROM documents",
    "prj3_owned_results": f"WITH {_REGISTRY}, {_TEXTS}, o AS (SELECT content_id, min(footage_key) AS footage_key, arg_min(path, footage_key) AS source_path FROM r WHERE state = 'ready' GROUP BY content_id), h AS (SELECT row, 'c' || lpad(CAST(row % 60 AS VARCHAR), 15, '0') AS content_id FROM ts) SELECT * FROM h JOIN o USING (content_id)",
    "set3_removed": f"WITH {_REGISTRY} SELECT footage_key FROM b WHERE bucket = 'removed'",
    "flt2_valid_ids": f"WITH {_TEXTS} SELECT row FROM ts WHERE row % 3 = 0",
    "flt4_hallucination": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (CAST(l_discount AS DOUBLE) * 10 > 0.6 AND -CAST(l_tax AS DOUBLE) * 20 < -1.0) AND l_linenumber <> 2",
    "flt7_emotions": """SELECT o_orderkey, coalesce(string_agg(label, ',' ORDER BY score DESC, label DESC) FILTER (WHERE score > 0.3 AND o_orderkey % 9 <> 4), '') AS emotions FROM (
  SELECT o_orderkey, label, o_orderkey * m % 100 / 100.0 AS score FROM orders, (VALUES (7, 'joy'), (13, 'fear'), (29, 'anger'), (31, 'surprise')) t(m, label) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, label DESC) <= 3
) GROUP BY o_orderkey""",
    "flt12_ner_input": "SELECT doc_id, CAST(CASE WHEN trim(text) <> '' THEN length(text[1:1000]) END AS BIGINT) AS n FROM documents",
    "flt13_prune": f"WITH {_REGISTRY} SELECT footage_key, state FROM r WHERE state <> 'stale'",
    "win2_span_merge": """WITH s AS (SELECT l_orderkey AS k, l_linenumber * 10.0::DOUBLE AS b, l_linenumber * 10.0::DOUBLE + CAST(l_quantity AS DOUBLE) / 3.0 AS e, CAST(l_discount AS DOUBLE) AS score FROM lineitem),
i AS (SELECT *, sum(CASE WHEN b <= m THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, max(e) OVER (PARTITION BY k ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s))
SELECT k, round(min(b), 6) AS start, round(max(e), 6) AS "end", round(max(score), 6) AS score FROM i GROUP BY k, island""",
    "win3_latest_job": f"WITH RECURSIVE {_JOBS} SELECT * FROM lj",
    "win3_live_job": f"WITH RECURSIVE {_JOBS} SELECT * FROM vj",
    "win4_first_owner": f"WITH {_REGISTRY} SELECT content_id, min(footage_key) AS footage_key FROM r WHERE state = 'ready' GROUP BY content_id",
    "win5_debounce": "SELECT event_id, user_id AS footage, size, coalesce(lag(size) OVER (PARTITION BY user_id ORDER BY ts, event_id) = size, false) AS confirmed FROM (SELECT *, CAST(floor(value / 25) AS BIGINT) AS size FROM events)",
    "win9_ordinal": f"WITH {_TEXTS} SELECT row, content_id, shot_id, CAST(row_number() OVER (ORDER BY content_id, shot_id) - 1 AS BIGINT) AS ordinal FROM ts",
    "win10_split_spans": """WITH o AS (SELECT o_orderkey, 2.0::DOUBLE AS s, 2.0 + CAST(o_totalprice AS DOUBLE) / 5000.0 AS e FROM orders), n AS (SELECT *, greatest(1, CAST(ceil((e - s) / 8.0 - 1e-6) AS INTEGER)) AS k FROM o), u AS (SELECT *, unnest(range(0, k)) AS part FROM n)
SELECT o_orderkey, CAST(part AS INTEGER) AS part, round(s + part * ((e - s) / k), 8) AS t0, round(s + (part + 1) * ((e - s) / k), 8) AS t1 FROM u""",
    "fn3_clean_entities": r"""WITH s AS (SELECT doc_id, text, i * 9 + doc_id % 4 AS b, i * 9 + doc_id % 4 + 6 + i % 3 * 2 AS e, (doc_id * 13 + i * 29) % 100 / 100.0 AS score FROM documents, range(0, 20) r(i)),
i AS (SELECT *, sum(CASE WHEN b <= m THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY b ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s)),
g AS (SELECT doc_id, any_value(text) AS text, min(b) AS b, max(e) AS e, max(score) AS score FROM i GROUP BY doc_id, island),
n AS (SELECT doc_id, b, regexp_replace(regexp_replace(substr(text, b + 1, e - b), '\s+', ' ', 'g'), '^[^\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+$', '', 'g') AS entity FROM g WHERE score >= 0.6)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS INTEGER) AS pos, entity FROM n WHERE length(entity) >= 2 AND regexp_matches(entity, '\p{L}')""",
    "fn20_prompt": "SELECT p_partkey, 'this is a photo of ' || lower(p_name) || '.' AS prompt, 'Represent this sentence for searching relevant passages: ' || p_name AS asked FROM part",
    "fn23_utc_stamp": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, CASE WHEN event_id % 2 = 0 THEN coalesce(value, 0) ELSE 0 END AS value FROM events",
    "flt5_ocr_text": f"""WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w FROM documents),
k AS (SELECT doc_id, w, i FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM t) WHERE (doc_id + i * 7) % 100 >= 40 AND length(w) >= 2 AND doc_id % 50 >= 20),
o AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM (SELECT doc_id, w, min(i) AS i FROM k GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, length(coalesce(t, '')) AS n, md5(coalesce(t, '')) AS digest FROM documents LEFT JOIN o USING (doc_id)""",
    "agg14_keyframe": "SELECT DISTINCT l_orderkey AS content_id, l_linenumber % 2 AS shot_id, CAST(first_value(l_linenumber) OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_quantity DESC, l_linenumber) AS BIGINT) AS frame FROM lineitem WHERE l_partkey % 9 <> 0",
    "src1_cut_scenes": """WITH RECURSIVE f AS (SELECT CAST(event_id // 4000 AS BIGINT) AS content_id, event_id % 4000 AS frame, CASE WHEN event_id % 10 = 3 THEN value * 8 ELSE value END AS score FROM events),
g AS (SELECT *, (sum(score) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) + sum(score) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) / 4 AS mean, count(*) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM f WINDOW w AS (PARTITION BY content_id ORDER BY frame)),
k AS MATERIALIZED (SELECT content_id, frame FROM g WHERE n = 5 AND score >= 15 AND CASE WHEN abs(mean) < 1e-5 THEN 255 ELSE least(255, score / mean) END >= 3),
c AS (SELECT DISTINCT content_id, CAST(0 AS BIGINT) AS frame FROM f UNION ALL SELECT c.content_id, min(k.frame) FROM c JOIN k ON k.content_id = c.content_id AND k.frame >= c.frame + 15 GROUP BY c.content_id)
SELECT content_id, CAST(row_number() OVER (PARTITION BY content_id ORDER BY frame) - 1 AS INTEGER) AS scene_id, frame AS start_frame, coalesce(lead(frame) OVER (PARTITION BY content_id ORDER BY frame), (SELECT max(frame) + 1 FROM f WHERE f.content_id = c.content_id)) AS end_frame FROM c""",
    "agg15_sharpness": """WITH p AS (SELECT o_orderkey, i, j, (o_orderkey * (4 * i + j + 1)) % 251 AS x FROM orders, range(0, 4) a(i), range(0, 4) b(j)),
n AS (SELECT * FROM (VALUES (0, 1), (0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2), (3, 2)) t(place, near)),
v AS (SELECT o_orderkey, p.i, p.j, sum(q.x) AS s FROM p JOIN n ON place = p.i JOIN p q USING (o_orderkey) WHERE q.i = near AND q.j = p.j GROUP BY ALL),
h AS (SELECT o_orderkey, p.i, p.j, sum(q.x) AS s FROM p JOIN n ON place = p.j JOIN p q USING (o_orderkey) WHERE q.j = near AND q.i = p.i GROUP BY ALL)
SELECT o_orderkey, round(var_pop(v.s + h.s - 4 * x), 4) AS sharpness FROM p JOIN v USING (o_orderkey, i, j) JOIN h USING (o_orderkey, i, j) GROUP BY o_orderkey""",
    "prj1_shot_rows": _shot_rows("content_id, shot_id, transcript, dialogue_en, dialogue_src, has_dialogue, entities"),
    "j3_assembled": _shot_rows("content_id, shot_id, 8.0 * shot_id AS start_time, 8.0 * shot_id + 8.0 AS end_time, has_dialogue, CAST(1 - shot_id % 2 AS BIGINT) AS n_ocr"),
    "prj4_footage": f"""WITH {_REGISTRY} SELECT footage_key, CASE WHEN item_id % 4 <> 0 THEN path ELSE '' END AS path, CASE WHEN item_id % 5 <> 0 THEN content_id ELSE '' END AS content_id, CASE WHEN item_id % 6 <> 0 THEN shot_count ELSE 0 END AS shot_count,
  0.0::DOUBLE AS duration_s, CAST(NULL AS VARCHAR) AS indexed_at, CASE WHEN item_id % 8 <> 0 THEN state ELSE 'indexing' END AS state, false AS reused FROM r""",
    "prj6_status": f"WITH RECURSIVE {_JOBS} SELECT job_id, 'k' || content_id AS footage_key, state, content_id % 2 = 0 AS reused, state AS upload, CAST(CASE WHEN state = 'error' THEN 500 END AS INTEGER) AS n_error FROM j",
    "prj8_canonical": "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE w WHEN 'anvil' THEN 'Anvil' WHEN 'gizmo' THEN 'GIZMO' ELSE w END), ' ') AS shown FROM part",
    "prj9_cards": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN 'a caption' WHEN o_orderkey % 2 = 0 THEN 'said' ELSE '' END AS card, format('{:.1f}', CAST(greatest(0, o_custkey % 9 - 2) AS DOUBLE)) AS seconds FROM orders",
    "src6_corpus_order": f"""WITH {_TEXTS}, w(place, content_id) AS (VALUES (0, 'c000000000000003'), (1, 'c000000000000001'), (2, 'c000000000000000'), (3, 'c000000000000003'))
SELECT content_id, shot_id, CAST(row_number() OVER (ORDER BY place, shot_id) - 1 AS BIGINT) AS ordinal FROM w JOIN ts USING (content_id)""",
    "st2_lifecycle": """WITH o AS (SELECT o_orderkey AS job_id, o_orderkey % 6 AS k, o_orderkey % 7 AS m, o_custkey % 100 AS d FROM orders)
SELECT job_id, CASE WHEN k = 0 AND m = 0 THEN 'cancelled' WHEN k = 0 OR (k = 3 AND m = 2) THEN 'queued' WHEN k = 4 THEN 'error' WHEN k = 5 THEN 'done' ELSE 'running' END AS state,
  CAST(CASE WHEN k = 0 AND m = 0 THEN length('cancelled by user') WHEN k = 4 THEN 500 END AS INTEGER) AS n_error,
  'shots:' || CASE WHEN k < 2 THEN 'pending:0:0' WHEN k = 2 THEN 'running:' || d || ':100' ELSE 'done:100:100' END
  || ',visual:' || CASE WHEN k < 3 THEN 'pending:0:0' WHEN k = 3 THEN CASE WHEN m = 2 THEN 'pending' ELSE 'running' END || ':1:3' WHEN k = 4 THEN 'error:1:3' ELSE 'done:1:3' END
  || ',ocr:' || CASE WHEN k = 5 THEN 'done' ELSE 'pending' END || ':0:0' AS stages FROM o""",
    "st3_cancel": f"WITH RECURSIVE {_JOBS} SELECT job_id, CASE WHEN created_at % 10 = 0 THEN 'missing' WHEN state IN ('done', 'error') THEN 'terminal' WHEN state = 'queued' THEN 'cancelled' ELSE 'running' END AS outcome FROM j",
    "st5_handoff": """SELECT o_orderkey, CASE WHEN k = 0 THEN 'reuse' WHEN k = 1 AND o_orderkey % 2 = 0 THEN 'attach' WHEN o_orderkey % 3 = 0 THEN 'upload' ELSE 'index' END AS action, CAST(CASE WHEN k = 2 AND o_orderkey % 3 = 0 THEN o_custkey ELSE 0 END AS BIGINT) AS "offset"
FROM (SELECT *, o_orderkey % 5 AS k FROM orders)""",
    "st6_calls": """WITH c AS (SELECT l_orderkey, l_partkey % 7 AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem),
m AS (SELECT *, count(*) FILTER (WHERE c NOT IN (0, 3, 6)) OVER (PARTITION BY l_orderkey ORDER BY i) AS misses FROM c),
f AS (SELECT l_orderkey, min(i) FILTER (WHERE c = 6) AS answer, min(i) FILTER (WHERE misses >= 3) AS failed FROM m GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN answer IS NOT NULL AND (failed IS NULL OR answer < failed) THEN 'answered' WHEN failed IS NOT NULL THEN 'failed' ELSE 'waiting' END AS outcome FROM f""",
    "st4_upload": f"WITH RECURSIVE {_JOBS} SELECT content_id, received, size, size > 0 AND received = size AS complete FROM up",
    "st9_recover": f"""WITH RECURSIVE {_JOBS}, s AS (SELECT job_id, state, CAST(created_at AS BIGINT) AS c, state IN ('running', 'queued') AS run FROM j)
SELECT job_id, CASE WHEN run THEN 'queued' ELSE state END AS state, array_to_string(list_transform(range(0, 3), lambda i: ['shots', 'visual', 'ocr'][i + 1] || ':' || CASE WHEN c % 4 > i THEN 'done:' || (c + i) WHEN c % 4 = i THEN CASE WHEN run THEN 'pending:' ELSE 'running:' END || (c + i) ELSE 'pending:' || (c + i) END), ',') AS stages FROM s""",
    "st10_library_state": f"""WITH RECURSIVE {_JOBS} SELECT c.content_id, CASE WHEN vj.job_id IS NOT NULL AND c.content_id % 2 = 0 THEN 'indexing' WHEN c.content_id % 6 = 0 THEN 'ready' WHEN lj.state = 'error' THEN 'error' WHEN c.content_id % 6 = 1 THEN 'stale' WHEN size > 0 AND received = size THEN 'uploaded' WHEN received > 0 THEN 'partial' ELSE 'missing' END AS library_state
FROM (SELECT c_custkey - 1 AS content_id FROM customer) c LEFT JOIN lj ON lj.content_id = c.content_id LEFT JOIN vj ON vj.content_id = c.content_id LEFT JOIN up ON up.content_id = c.content_id""",
    "st11_screen": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 <> 0 AND o_orderkey % 3 = 0 THEN 'job' WHEN o_orderkey % 5 = 0 THEN 'searching' WHEN o_orderkey % 7 = 0 AND o_orderkey % 4 = 0 THEN 'error' WHEN o_orderkey % 2 <> 0 THEN 'empty' WHEN o_orderkey % 4 = 0 THEN 'nomatch' ELSE 'results' END AS screen FROM orders",
    "srt7_step_order": """WITH s AS (SELECT l_orderkey AS job_id, ['shots', 'visual', 'transcribe', 'ocr', 'captions', 'text', 'extra'][l_linenumber] AS name, ['pending', 'running', 'done', 'error'][min(l_partkey) % 4 + 1] AS state, l_linenumber AS pos FROM lineitem GROUP BY l_orderkey, l_linenumber),
t AS (SELECT *, CASE WHEN pos < 7 AND state = 'running' THEN 0 WHEN pos < 7 AND state = 'done' THEN 1 ELSE 2 END AS kind FROM s WHERE state <> 'pending')
SELECT job_id, name, state, row_number() OVER (PARTITION BY job_id ORDER BY kind, CASE WHEN kind = 0 THEN pos ELSE -pos END) AS place FROM t""",
    "snk9_layers": "SELECT o_orderkey, 60.0::DOUBLE - o_orderkey % 100 AS layer_start, 60.0::DOUBLE AS layer_in, 60.0::DOUBLE + o_custkey % 9 - 1 AS layer_out FROM orders WHERE o_custkey % 9 > 1",
    "src7_ready_contents": f"WITH {_TEXTS} SELECT content_id, count(*) AS n_shots FROM ts WHERE content_id[16:16] <> '1' GROUP BY content_id",
}
