"""Common table expressions shared by the reference SQL texts.

They restate the model tables (documents, passages, entities, questions) in plain SQL, independently
of the Spark operators.
"""

from __future__ import annotations

from bookloom import settings as S
from bookloom.functions.entities import EDGE_PUNCTUATION, NOT_A_PHRASE
from bookloom.functions.text import SPACE_CHARS
from bookloom.operators.keyword import STOP_WORDS

WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_TRIM = SPACE_CHARS.replace("'", "''")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"trim({x}, '{_TRIM}')"


def clean(x: str) -> str:
    return trim(f"regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '[ \\t]+', ' ', 'g')")


def word_list(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def sentence_list(x: str) -> str:
    return (
        f"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)), "
        f"lambda s: {trim('s')}), lambda s: s <> '')"
    )


def token_estimate(x: str) -> str:
    return f"greatest(1, length({x}) // 4)"


def _reflow(p: str) -> str:
    lines = (
        f"list_concat([string_split({p}, chr(10))[1]], list_filter(list_transform(string_split({p}, chr(10))[2:], "
        f"lambda l: {trim('l')}), lambda l: l <> ''))"
    )
    joined = f"list_reduce({lines}, lambda a, l: a || CASE WHEN right(a, 1) IN ('.','!','?',':',';','\"') THEN '' ELSE ' ' END || l)"
    return f"CASE WHEN contains({p}, chr(10)) AND length({p}) < {S.REFLOW_LIMIT} THEN {joined} ELSE {p} END"


def paragraph_list(t: str) -> str:
    blocks = f"list_filter(list_transform(string_split({t}, chr(10) || chr(10)), lambda b: {trim('b')}), lambda b: b <> '')"
    return f"list_transform({blocks}, lambda p: {_reflow('p')})"


def pack(units: str, limit: int, glue: str) -> str:
    """Greedy packing as a reduction over (finished blocks, open block) pairs."""
    sep = "chr(10) || chr(10)" if glue == "\n\n" else q(glue)
    seeds = f"list_transform({units}, lambda u: {{'done': []::VARCHAR[], 'open': u}})"
    folded = (
        f"list_reduce({seeds}, lambda a, x: CASE WHEN length(a.open) + length(x.open) + {len(glue)} > {limit} "
        f"THEN {{'done': list_append(a.done, a.open), 'open': x.open}} "
        f"ELSE {{'done': a.done, 'open': a.open || {sep} || x.open}} END)"
    )
    return f"list_transform([{folded}], lambda z: list_append(z.done, z.open))[1]"


def _units(size: int) -> str:
    sents = "list_transform([p], lambda pp: " + sentence_list("pp") + ")[1]"
    packed = pack(sents, size, " ")
    return (
        f"flatten(list_transform({paragraph_list('t')}, lambda p: CASE WHEN length(p) <= {size} THEN [p] "
        f"WHEN len({sents}) <= 1 THEN [p] ELSE {packed} END))"
    )


def _carry(units: str, size: int, overlap: int) -> str:
    piece = "(a.tail || x.done[1])"
    tail = f"list_transform([right({piece}, {overlap})], lambda r: {sentence_list('r')}[1])[1] || ' '"
    seeds = (
        f"list_concat([{{'done': []::VARCHAR[], 'tail': ''}}], list_transform({units}, lambda u: {{'done': [u], 'tail': ''}}))"
    )
    return (
        f"list_reduce({seeds}, lambda a, x: {{'done': list_append(a.done, {piece}), "
        f"'tail': CASE WHEN length({piece}) > {size} THEN {tail} ELSE '' END}}).done"
    )


def chunk_list(source: str, key: str, text: str, size: int, overlap: int, out: str) -> str:
    """CTEs ending in ``out(key, kids)``: the chunks of ``text`` for every row of ``source``."""
    return f"""
{out}_c AS (SELECT {key}, {clean(text)} AS t FROM {source}),
{out}_u AS (SELECT {key}, t, CASE WHEN length(t) > {size} THEN {_units(size)} END AS units FROM {out}_c),
{out}_m AS (SELECT {key}, t, CASE WHEN units IS NOT NULL THEN {pack('units', size, chr(10) * 2)} END AS merged FROM {out}_u),
{out} AS (SELECT {key}, t, CASE WHEN t = '' THEN []::VARCHAR[] WHEN length(t) <= {size} THEN [t]
  ELSE {_carry('merged', size, overlap)} END AS kids FROM {out}_m)"""


UPLOADED = """
uploaded AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS seq, 'doc-' || doc_id AS title, source AS corpus, text,
  [lang, 't' || (doc_id % 5)] AS tags, 'Author ' || (doc_id % 7) AS author,
  TIMESTAMP '2020-01-01' + to_days(CAST(doc_id % 1460 AS INTEGER)) AS doc_date, sha256(text) AS content_hash,
  TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS ingested_at, 'job-' || source AS job_id FROM documents)"""

DOCS = UPLOADED + """,
docs AS MATERIALIZED (SELECT * FROM uploaded QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY seq) = 1)"""


def embedding(x: str, dim: int = S.EMBED_DIM) -> str:
    raw = f"list_transform(range({dim}), lambda i: CAST(CAST('0x' || substr(h, CAST((i % 32) * 2 + 1 AS BIGINT), 2) AS INTEGER) AS DOUBLE) / 255.0)"
    unit = f"list_transform([{raw}], lambda v: list_transform(v, lambda e: CAST(e / sqrt(list_sum(list_transform(v, lambda y: y * y))) AS FLOAT)))[1]"
    return f"list_transform([sha256({x})], lambda h: {unit})[1]"


PASSAGES = DOCS + f""",
par_c AS (SELECT doc_id, seq, corpus, {clean('text')} AS t FROM docs),
par_l AS (SELECT doc_id, seq, corpus, CASE WHEN t = '' THEN []::VARCHAR[] WHEN length(t) <= {S.PARENT_SIZE} THEN [t]
  ELSE {pack(paragraph_list('t'), S.PARENT_SIZE, chr(10) * 2)} END AS ps FROM par_c),
par AS MATERIALIZED (SELECT doc_id, seq, corpus, unnest(ps) AS ptext, generate_subscripts(ps, 1) - 1 AS pp FROM par_l),
{chunk_list('par', 'doc_id, seq, corpus, ptext, pp', 'ptext', S.CHILD_SIZE, S.CHILD_OVERLAP, 'kid')},
kid_rows AS (SELECT doc_id, seq, corpus, pp, ptext, unnest(CASE WHEN len(kids) = 0 THEN [ptext] ELSE kids END) AS text,
  generate_subscripts(CASE WHEN len(kids) = 0 THEN [ptext] ELSE kids END, 1) - 1 AS cp FROM kid),
chunks AS MATERIALIZED (SELECT printf('%s#%06d', doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pp, cp) - 1) AS chunk_id,
  doc_id, seq, corpus, row_number() OVER (PARTITION BY doc_id ORDER BY pp, cp) - 1 AS chunk_index,
  printf('%s/%06d', doc_id, pp) AS parent_id, pp, cp, text, ptext FROM kid_rows)"""

# Image files as sample.image_files writes them, and the captions read from them.
IMAGES = rf"""
img_f AS (SELECT printf('img%06d', e.vec_id) AS image_id, CAST(d.doc_id AS VARCHAR) AS doc_id, d.source AS corpus, e.vec_id, coalesce(d.lang, '') AS lang,
  coalesce(string_split(d.text, chr(10))[1], '') AS line FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE e.vec_id % 17 <> 0),
img_b AS (SELECT *, regexp_replace(line, '["\\\x00-\x1f]', '', 'g') AS bare FROM img_f),
img_c AS (SELECT *, CASE WHEN vec_id % 3 = 0 THEN line ELSE concat('{{"caption": "', bare, '", "tags": ["', lang, '", "t', vec_id % 5, '"]}}') END AS content FROM img_b),
images AS MATERIALIZED (SELECT image_id, doc_id, corpus, vec_id, content,
  CASE WHEN vec_id % 3 = 0 THEN substr({trim('line')}, 1, 500) WHEN {trim('bare')} <> '' THEN substr({trim('bare')}, 1, 500) ELSE substr(content, 1, 500) END AS caption,
  CASE WHEN vec_id % 3 = 0 THEN '' ELSE concat_ws(',', nullif({trim('lang')}, ''), 't' || (vec_id % 5)) END AS tags FROM img_c WHERE content <> ''),
pics AS MATERIALIZED (SELECT i.* FROM images i WHERE doc_id IN (SELECT doc_id FROM docs)),
pic_w AS (SELECT image_id, list_filter(list_filter(regexp_extract_all(caption, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_matches(w, '^[A-Z][a-zA-Z]+$')),
  lambda w: lower(w) NOT IN ('the', 'a', 'an', 'this', 'that', 'image', 'picture', 'photo', 'painting'))[1:8] AS l FROM pics),
depicts AS MATERIALIZED (SELECT image_id, lower(word) AS canonical, min(word) AS name FROM (SELECT image_id, unnest(l) AS word FROM pic_w) GROUP BY ALL)"""

_GOOD = r"^[A-Z][a-zA-Z]+$"


def phrase_list(x: str) -> str:
    """Capitalised phrases: words that are clean as a whole are kept, everything else becomes a wall."""
    runs = rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')"
    walled = (
        f"array_to_string(list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, '{_GOOD}') OR regexp_matches(r, '^{WS}+$') "
        f"THEN r ELSE chr(1) END), '')"
    )
    banned = ", ".join(q(w) for w in NOT_A_PHRASE)
    return (
        f"list_filter(regexp_extract_all({walled}, '[A-Z][a-zA-Z]+(?:{WS}+[A-Z][a-zA-Z]+){{0,3}}'), "
        f"lambda p: lower(p) NOT IN ({banned}))"
    )


def canonical(x: str) -> str:
    return f"lower(regexp_replace(trim({trim(x)}, {q(EDGE_PUNCTUATION)}), '{WS}+', ' ', 'g'))"


def display(x: str) -> str:
    return f"substr(regexp_replace({trim(x)}, '{WS}+', ' ', 'g'), 1, 120)"


def entities(phrases: int | None, per_document: int | None, pairs: int | None) -> str:
    """Entities, mentions and relations, with or without limits."""
    keep = lambda name, limit: f"QUALIFY {name} <= {limit}" if limit else ""
    return PASSAGES + "," + IMAGES + f""",
ph_l AS (SELECT doc_id, seq, pp, {phrase_list('ptext')} AS l FROM par),
ph AS (SELECT doc_id, seq, pp, unnest(l) AS name, generate_subscripts(l, 1) AS p_at FROM ph_l),
ph_n AS (SELECT doc_id, seq, pp, name, count(*) AS n, min(p_at) AS p_at FROM ph GROUP BY ALL),
ext AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pp ORDER BY n DESC, p_at) AS pos FROM ph_n
  {keep('pos', phrases)}),
de_n AS (SELECT doc_id, seq, {canonical('name')} AS canonical, count(*) AS n, min(pp * 1000000 + pos) AS first_at,
  arg_min(name, pp * 1000000 + pos) AS name FROM ext GROUP BY ALL),
doc_entities AS MATERIALIZED (SELECT doc_id, seq, canonical, substr(name, 1, 120) AS name,
  row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at) AS pos FROM de_n WHERE canonical <> ''
  {keep('pos', per_document)}),
mentions AS MATERIALIZED (SELECT c.chunk_id, c.doc_id, c.corpus, c.seq, c.chunk_index, e.canonical, e.pos
  FROM chunks c JOIN doc_entities e ON e.doc_id = c.doc_id AND contains(lower(c.text), lower(e.name))),
doc_mentions AS MATERIALIZED (SELECT e.doc_id, e.canonical FROM doc_entities e
  WHERE NOT EXISTS (SELECT 1 FROM mentions m WHERE m.doc_id = e.doc_id AND m.canonical = e.canonical)),
told AS MATERIALIZED (SELECT canonical, arg_min({display('name')}, seq * 1000000 + pos) AS name, 'Concept' AS type FROM doc_entities GROUP BY canonical),
entities AS MATERIALIZED (SELECT * FROM told UNION ALL SELECT canonical, min(name), 'Concept' FROM depicts
  WHERE canonical NOT IN (SELECT canonical FROM told) GROUP BY canonical),
aliases AS MATERIALIZED (SELECT DISTINCT {display('d.name')} AS name, d.canonical FROM doc_entities d
  JOIN entities e ON e.canonical = d.canonical WHERE {display('d.name')} <> e.name),
obs AS (SELECT a.chunk_id, a.seq, a.chunk_index, a.canonical AS src, b.canonical AS dst,
  row_number() OVER (PARTITION BY a.chunk_id ORDER BY a.pos, b.pos) AS pair_no
  FROM mentions a JOIN mentions b ON a.chunk_id = b.chunk_id AND a.pos < b.pos {keep('pair_no', pairs)}),
relations AS MATERIALIZED (SELECT src, dst, 'RELATED_TO' AS type, CAST(count(*) AS DOUBLE) AS weight,
  arg_min(chunk_id, (seq * 1000000 + chunk_index) * 1000000 + pair_no) AS evidence FROM obs GROUP BY src, dst)"""


ENTITIES = entities(15, 200, 8)
WHOLE = entities(None, None, None)

GRAPH = ENTITIES + """,
ends AS (SELECT canonical FROM mentions UNION ALL SELECT canonical FROM doc_mentions UNION ALL SELECT src FROM relations
  UNION ALL SELECT dst FROM relations WHERE src <> dst UNION ALL SELECT canonical FROM aliases UNION ALL SELECT canonical FROM depicts),
deg AS MATERIALIZED (SELECT canonical, count(*) AS degree FROM ends GROUP BY canonical),
ent AS MATERIALIZED (SELECT e.*, coalesce(d.degree, 0) AS degree FROM entities e LEFT JOIN deg d ON d.canonical = e.canonical),
ent_corpora AS MATERIALIZED (SELECT canonical, corpus FROM mentions UNION SELECT m.canonical, d.corpus FROM doc_mentions m
  JOIN docs d ON d.doc_id = m.doc_id)"""

QUESTIONS = f"""
q_l AS (SELECT item_id, {sentence_list('text')} AS s FROM benchmark),
questions AS MATERIALIZED (SELECT printf('%s-%03d', CAST(item_id AS VARCHAR), i - 1) AS qid, item_id, question,
  CASE WHEN item_id % 2 = 1 THEN 'src' || (item_id % 20) END AS corpus
  FROM (SELECT item_id, unnest(s) AS question, generate_subscripts(s, 1) AS i FROM q_l))"""

MESSAGES = """
messages AS (SELECT printf('%s-%06d', CAST(conv_id AS VARCHAR), turn) AS message_id, CAST(conv_id AS VARCHAR) AS conversation_id,
  role, text AS content, 1704067200 + conv_id * 3600 + (turn // 2) * 60 AS ts, conv_id, turn FROM conversations)"""


def term_list(x: str) -> str:
    stop = ", ".join(q(w) for w in STOP_WORDS)
    return rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}'']+'), lambda t: t NOT IN ({stop}))"


def vector_arm(k: int, questions: str = "questions", where: str = "q.corpus IS NULL OR c.corpus = q.corpus", name: str = "vec") -> str:
    return f"""
c_vec AS MATERIALIZED (SELECT chunk_id, doc_id, corpus, CAST({embedding('text')} AS DOUBLE[]) AS v FROM chunks),
q_vec AS MATERIALIZED (SELECT *, CAST({embedding('question')} AS DOUBLE[]) AS v FROM {questions}),
{name} AS MATERIALIZED (SELECT q.qid, c.chunk_id, round(list_cosine_similarity(q.v, c.v), 9) AS sim,
  row_number() OVER (PARTITION BY q.qid ORDER BY round(list_cosine_similarity(q.v, c.v), 9) DESC, c.chunk_id) AS rnk
  FROM q_vec q JOIN (c_vec c JOIN docs d ON d.doc_id = c.doc_id) ON ({where}) QUALIFY rnk <= {k})"""


def keyword_arm(k: int, questions: str = "questions", where: str = "q.corpus IS NULL OR c.corpus = q.corpus", name: str = "kwd") -> str:
    tf = f"(tf * {S.BM25_K1 + 1}) / (tf + {S.BM25_K1} * ({1 - S.BM25_B} + {S.BM25_B} * dl / (SELECT avg(dl) FROM c_terms)))"
    return f"""
c_terms AS MATERIALIZED (SELECT chunk_id, doc_id, corpus, ts, len(ts) AS dl FROM (SELECT *, {term_list('text')} AS ts FROM chunks)),
c_tf AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(ts) AS term FROM c_terms) GROUP BY ALL),
c_df AS MATERIALIZED (SELECT term, count(*) AS df FROM c_tf GROUP BY term),
q_terms AS MATERIALIZED (SELECT qid, unnest(list_distinct({term_list('question')})) AS term FROM {questions}),
q_n AS (SELECT qid, count(*) AS n FROM q_terms GROUP BY qid),
k_all AS (SELECT t.qid, f.chunk_id, count(*) AS n, sum(ln(1 + ((SELECT count(*) FROM c_terms) - df + 0.5) / (df + 0.5)) * {tf}) AS score
  FROM q_terms t JOIN c_tf f ON f.term = t.term JOIN c_df d ON d.term = t.term JOIN c_terms c ON c.chunk_id = f.chunk_id GROUP BY ALL),
{name} AS MATERIALIZED (SELECT k.qid, k.chunk_id, round(k.score, 9) AS score,
  row_number() OVER (PARTITION BY k.qid ORDER BY round(k.score, 9) DESC, k.chunk_id) AS rnk
  FROM k_all k JOIN q_n ON q_n.qid = k.qid AND q_n.n = k.n JOIN {questions} q ON q.qid = k.qid
  JOIN c_terms c ON c.chunk_id = k.chunk_id JOIN docs d ON d.doc_id = c.doc_id WHERE ({where}) QUALIFY rnk <= {k})"""


def fused(top: int = S.CANDIDATES, name: str = "fused") -> str:
    return f"""
{name} AS MATERIALIZED (SELECT qid, chunk_id, round(raw, 4) AS score, raw, row_number() OVER (PARTITION BY qid
  ORDER BY raw DESC, vr NULLS LAST, kr NULLS LAST) AS rnk FROM (
    SELECT coalesce(v.qid, k.qid) AS qid, coalesce(v.chunk_id, k.chunk_id) AS chunk_id, v.rnk AS vr, k.rnk AS kr,
      coalesce(1.0::DOUBLE / ({S.RRF_K} + v.rnk), 0) + coalesce(1.0::DOUBLE / ({S.RRF_K} + k.rnk), 0) AS raw
    FROM vec v FULL JOIN kwd k ON v.qid = k.qid AND v.chunk_id = k.chunk_id) QUALIFY rnk <= {top})"""


NEIGHBORS = f"""
s_l AS (SELECT qid, {phrase_list('question')} AS l FROM questions),
s_n AS (SELECT qid, name, count(*) AS n, min(p_at) AS p_at FROM (SELECT qid, unnest(l) AS name, generate_subscripts(l, 1) AS p_at FROM s_l) GROUP BY ALL),
starts AS MATERIALIZED (SELECT DISTINCT qid, {canonical('name')} AS s FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, p_at) AS r
  FROM s_n QUALIFY r <= {S.GRAPH_NAMES})),
rel_id AS MATERIALIZED (SELECT row_number() OVER (ORDER BY src, dst, type) AS id, src, dst FROM relations WHERE src <> dst),
arcs AS MATERIALIZED (SELECT id, src AS u, dst AS v FROM rel_id UNION ALL SELECT id, dst, src FROM rel_id),
keys AS MATERIALIZED (SELECT DISTINCT s FROM starts),
reach AS MATERIALIZED (SELECT DISTINCT s, v AS e FROM keys JOIN arcs ON u = s UNION
  SELECT DISTINCT k.s, b.v FROM keys k JOIN arcs a ON a.u = k.s JOIN arcs b ON b.u = a.v AND b.id <> a.id),
near_a AS (SELECT DISTINCT st.qid, m.chunk_id FROM starts st JOIN reach r ON r.s = st.s JOIN mentions m ON m.canonical = r.e),
near_b AS (SELECT DISTINCT st.qid, c.chunk_id FROM starts st JOIN doc_mentions dm ON dm.canonical = st.s JOIN chunks c ON c.doc_id = dm.doc_id),
neighbors AS MATERIALIZED (SELECT qid, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY chunk_id) AS r FROM near_a QUALIFY r <= {S.GRAPH_LIMIT})
  UNION SELECT qid, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY chunk_id) AS r FROM near_b QUALIFY r <= {S.GRAPH_LIMIT}))"""


def merged(top: int = S.CANDIDATES) -> str:
    return f"""
merged AS MATERIALIZED (SELECT qid, chunk_id, max(score) AS score, row_number() OVER (PARTITION BY qid ORDER BY max(score) DESC, min(p_at)) AS rnk
  FROM (SELECT qid, chunk_id, score, rnk AS p_at FROM fused UNION ALL
    SELECT qid, chunk_id, {S.GRAPH_SCORE}, 1000 + row_number() OVER (PARTITION BY qid ORDER BY chunk_id) FROM neighbors)
  GROUP BY qid, chunk_id QUALIFY rnk <= {top})"""


def reranked(source: str, top: int = S.RERANK_TOP) -> str:
    bag = lambda x: f"list_distinct({word_list(f'lower({x})')})"
    return f"""
q_bag AS MATERIALIZED (SELECT qid, {bag('question')} AS b FROM questions),
reranked AS MATERIALIZED (SELECT f.qid, f.chunk_id, f.score, f.fused_rnk, s, row_number() OVER (PARTITION BY f.qid ORDER BY s DESC, f.fused_rnk) AS rnk
  FROM (SELECT h.qid, h.chunk_id, h.score, h.rnk AS fused_rnk, CAST(len(list_intersect(b.b, {bag('c.text')})) AS DOUBLE) / greatest(1, len(b.b)) AS s
    FROM {source} h JOIN chunks c ON c.chunk_id = h.chunk_id JOIN q_bag b ON b.qid = h.qid) f QUALIFY rnk <= {top})"""


EXPANDED = """
exp_j AS (SELECT r.*, c.parent_id, c.ptext, c.doc_id FROM reranked r JOIN chunks c ON c.chunk_id = r.chunk_id),
exp_b AS (SELECT *, row_number() OVER (PARTITION BY qid, parent_id ORDER BY score DESC, rnk) AS b,
  min(rnk) OVER (PARTITION BY qid, parent_id) AS first_rnk FROM exp_j),
expanded AS MATERIALIZED (SELECT e.qid, e.chunk_id, e.score, e.s, e.ptext AS text, 'doc-' || e.doc_id AS title, e.doc_id,
  row_number() OVER (PARTITION BY e.qid ORDER BY e.score DESC, e.first_rnk) AS rnk FROM exp_b e WHERE b = 1)"""

BLOCKS = f"""
blk AS (SELECT *, '[' || rnk || '] (' || title || ') ' || {trim('text')} AS block FROM expanded),
blk_t AS (SELECT *, {token_estimate('block')} AS bt, sum({token_estimate('block')}) OVER (PARTITION BY qid ORDER BY rnk) AS used FROM blk),
kept AS MATERIALIZED (SELECT * FROM blk_t WHERE rnk = 1 OR used <= {S.CONTEXT_BUDGET})"""


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(parts)
