"""The same queries in DuckDB's SQL."""

from __future__ import annotations

from ..functions import constants as K
from .queries import CJK, CUES, FILES, QUERY


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "(" + ", ".join(_lit(w) for w in words) + ")"


def _norm(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({x}, ''), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def _tokens(x: str) -> str:
    cjk = f"length(regexp_replace({x}, '[^㐀-鿿]', '', 'g'))"
    return f"CAST(greatest(1, {cjk} + ceil((length({x}) - {cjk}) / 4)) AS BIGINT)"


def _any(x: str, cues: str) -> str:
    return "(" + " OR ".join(f"contains({x}, {_lit(c)})" for c in cues.split("|")) + ")"


TURNS = f"SELECT row_number() OVER (ORDER BY conv_id, turn) AS turn_id, conv_id AS session_id, turn + 1 AS seq, role, {_norm('text')} AS content FROM conversations"
CUED = f"SELECT row_number() OVER (ORDER BY conv_id, turn) AS turn_id, conv_id AS session_id, turn + 1 AS seq, role, {_norm('[' + ', '.join(_lit(c) for c in CUES) + '][turn % 6 + 1] || text')} AS content FROM conversations"
LITERALS = " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS id, {_lit(t)} AS text" for i, t in enumerate(CJK))
_SEP = "chr(1)"


def _sentences(x: str) -> str:
    cut = rf"regexp_replace(regexp_replace(regexp_replace({x}, '([。！？!?])\s*', '\1' || {_SEP}, 'g'), '\.\s+([A-Z0-9])', '.' || {_SEP} || '\1', 'g'), '\n+', {_SEP}, 'g')"
    return f"list_filter(list_transform(string_split({cut}, {_SEP}), lambda p: trim(p, ' ' || chr(9) || '-•')), lambda p: length(p) >= 8)"


def _toks(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {_lit(K.LATIN)}), lambda z: {{'raw': z, 'clean': lower(trim(z, {_lit(K.LATIN_EDGE)}))}})"


_UPPER = "(regexp_matches(tok.raw, '[A-Z]') AND NOT regexp_matches(tok.raw, '[a-z]'))"
_MARK = f"(regexp_matches(tok.clean, '[0-9]') OR regexp_matches(tok.raw, '[._]') OR {_UPPER})"


def _anchors(x: str) -> str:
    own = f"list_transform(list_filter({_toks(x)}, lambda tok: tok.clean <> '' AND (length(tok.clean) >= 5 OR {_MARK})), lambda tok: tok.clean)"
    quoted = f"""list_transform(regexp_extract_all({x}, '["“‘'']([^"”’'']{{3,80}})["”’'']', 1), lambda q: lower({_norm('q')}))"""
    return f"list_distinct(list_concat({own}, list_filter({quoted}, lambda q: q <> '')))"


def _features(table: str, key: str, text: str) -> str:
    """(key, term, tenths) rows of Latin features."""
    w = f"(CASE WHEN length(tok.clean) >= 4 THEN {K.LATIN_LONG} ELSE {K.LATIN_SHORT} END + CASE WHEN {_MARK} THEN {K.LATIN_MARKED} ELSE 0 END)"
    return f"SELECT {key}, tok.clean AS term, CAST(sum({w}) AS BIGINT) AS tenths FROM (SELECT {key}, unnest({_toks(text)}) AS tok FROM {table}) WHERE length(tok.clean) >= 2 AND tok.clean NOT IN {_list(K.ENGLISH_STOP)} GROUP BY {key}, tok.clean"


def _ranked(table: str, key: str, text: str, n: int) -> str:
    return f"SELECT * FROM (SELECT {key}, term, tenths / 10 AS weight, CAST(row_number() OVER (PARTITION BY {key} ORDER BY tenths DESC, length(term) DESC, term) AS INTEGER) AS rank FROM ({_features(table, key, text)})) WHERE rank <= {n}"


def _case(rules, low: str, first: str, last: str = "") -> tuple[str, str]:
    kind = "CASE " + (f"WHEN {first} THEN 'DECISION' " if first else "") + " ".join(f"WHEN {_any(low, c)} THEN '{k}'" for k, _, c in rules) + (f" WHEN {last} THEN 'WARNING'" if last else "") + " ELSE '' END"
    conf = "CASE " + (f"WHEN {first} THEN 0.98 " if first else "") + " ".join(f"WHEN {_any(low, c)} THEN {v}" for _, v, c in rules) + (f" WHEN {last} THEN 0.92" if last else "") + " ELSE 0 END"
    return kind, f"CAST({conf} AS DOUBLE)"


def _user(x: str) -> tuple[str, str]:
    low = f"lower({x})"
    return _case(K.USER_CUES, low, f"contains({low}, '不是') AND {_any(low, '而是|是我们要|实际上')}", f"(regexp_matches({low}, '(^|[^能])不能'))")


def _other(x: str) -> tuple[str, str]:
    return _case(K.OTHER_CUES, f"lower({x})", "")


def _question(x: str) -> str:
    return f"(regexp_matches({x}, '[?？]$') OR {_any(f'lower({x})', K.QUESTION_CUES)} OR regexp_matches({x}, '[吗呢么][,，。.!！]?$'))"


def _fact(x: str) -> str:
    """No sentence of the tables has two digits beside a letter other than ASCII, so ASCII word bounds agree."""
    low = f"lower({x})"
    number = rf"regexp_matches({x}, '\b\d{{2,}}\b|\d+\s*[–-]\s*\d+')"
    anchored = f"len({_anchors(x)}) > 0"
    terms = f"len(list_distinct(list_transform(list_filter({_toks(x)}, lambda t: length(t.clean) >= 2 AND t.clean NOT IN {_list(K.ENGLISH_STOP)}), lambda t: t.clean)))"
    stated = f"(({anchored}) AND {_any(low, K.DEFINITION_CUES)}) OR ({number} AND {_any(low, K.UNIT_CUES)})"
    return f"CASE WHEN {_question(x)} OR regexp_matches({x}, '^\\[(Image|PDF)') OR {terms} < 3 THEN NULL WHEN role = 'user' AND ({anchored} OR {number}) AND length({x}) >= 18 THEN 0.70 WHEN role <> 'user' AND ({stated}) AND length({x}) BETWEEN 20 AND 420 THEN 0.67 END"


def _sentence_atoms() -> str:
    (uk, uc), (ok, oc) = _user("content"), _other("content")
    return f"""
t AS ({CUED}),
s0 AS (SELECT turn_id, role, {_sentences('content')} AS l FROM t),
s AS (SELECT turn_id, role, unnest(l) AS content, CAST(unnest(range(0, len(l))) AS INTEGER) AS pos FROM s0),
k AS (SELECT *, CASE WHEN role = 'user' THEN {uk} ELSE {ok} END AS k0, CASE WHEN role = 'user' THEN {uc} ELSE {oc} END AS c0, {_fact('content')} AS f FROM s WHERE length(content) <= 700),
a AS (SELECT turn_id, role, pos, content, CASE WHEN k0 <> '' THEN k0 WHEN f IS NOT NULL THEN 'FACT' END AS kind, CAST(CASE WHEN k0 <> '' THEN c0 ELSE f END AS DOUBLE) AS raw FROM k),
atoms AS (SELECT turn_id, role, pos, content, kind, round(CASE WHEN role = 'user' THEN least(0.99, raw + 0.03) WHEN role = 'assistant' THEN greatest(0.1, raw - 0.08) ELSE raw END, 4) AS confidence FROM a WHERE kind IS NOT NULL)"""


_PRIO = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.KIND_PRIORITY.items()) + " END"




def _cjk() -> str:
    edge, key = f"[{K.CHINESE_EDGE}]", f"[{K.CHINESE_KEY}]"
    grams = " UNION ALL ".join(
        f"SELECT id, g AS term, {w} AS tenths FROM (SELECT id, unnest(list_transform(range(1, greatest(0, length(r) - {n} + 1) + 1), lambda i: substr(r, i, {n}))) AS g FROM r WHERE length(r) > 1) WHERE g NOT IN {_list(K.CHINESE_STOP)} AND NOT regexp_matches(g, '^{edge}|{edge}$') AND length(regexp_replace(g, '{edge}', '', 'g')) >= {max(1, n - 1)}"
        for n, w in K.CJK_GRAMS.items()
    )
    return f"""
WITH l AS ({LITERALS}),
r AS (SELECT * FROM (SELECT id, unnest(regexp_extract_all(text, '[㐀-䶿一-鿿]+')) AS r FROM l) WHERE r NOT IN {_list(K.CHINESE_STOP)}),
f AS (SELECT id, r AS term, {K.CJK_SINGLE} AS tenths FROM r WHERE regexp_matches(r, '^{key}$')
  UNION ALL SELECT id, r, {K.CJK_PHRASE} FROM r WHERE length(r) BETWEEN 2 AND 8 AND NOT regexp_matches(r, '{edge}')
  UNION ALL SELECT id, unnest(regexp_extract_all(r, '{key}')), {K.CJK_KEY} FROM r WHERE length(r) > 1
  UNION ALL {grams})
SELECT id, term, CAST(sum(tenths) AS BIGINT) AS tenths FROM f GROUP BY id, term"""


def _exact_turns(kind: str) -> str:
    """One query, Latin terms only. The query fires no expansion and asks nothing."""
    q = f"q AS (SELECT term, weight FROM ({_ranked('(SELECT 0 AS id, ' + _lit(QUERY) + ' AS text)', 'id', 'text', 64)}))"
    factor = f"(SELECT CASE WHEN len(a) = 0 THEN 1.0 WHEN m = 0 THEN 0.1 ELSE 0.65 + 2.35 * m / len(a) END FROM (SELECT a, len(list_filter(a, lambda x: contains(lower(content), x))) AS m FROM anch))"
    turns = f"""
WITH t AS ({TURNS}), {q},
anch AS (SELECT {_anchors(_lit(QUERY))} AS a),
p AS ({_ranked('t', 'turn_id', 'content', 128)}),
d AS (SELECT doc_id, 'doc' || doc_id || '.txt text/plain text ' || {_norm('text')} AS content FROM documents),
pd AS ({_ranked('d', 'doc_id', 'content', 128)})"""
    if kind == "turn":
        return turns + f""",
n AS (SELECT count(*) AS n, max(turn_id) AS m FROM t),
i AS (SELECT q.term, q.weight * (1 + greatest(0, ((SELECT n FROM n) - df) / (SELECT n FROM n))) AS w FROM q JOIN (SELECT term, count(*) AS df FROM p WHERE rank <= 64 GROUP BY term) USING (term)),
c AS (SELECT turn_id, sum(w) / (SELECT sum(w) FROM i) AS exact, coalesce(sum(w) FILTER (rank <= 64), 0) / (SELECT sum(w) FROM i) * (1 + 0.04 * turn_id / (SELECT m FROM n)) AS coarse FROM p JOIN i USING (term) GROUP BY turn_id),
k AS (SELECT * FROM c WHERE coarse > 0 ORDER BY coarse DESC, turn_id DESC LIMIT 192),
s AS (SELECT turn_id, (0.12 * coarse + 0.88 * exact) * {factor} * CASE WHEN role = 'user' THEN 1.05 ELSE 1 END AS score FROM k JOIN t USING (turn_id))
SELECT 0 AS query_id, turn_id AS hit_id, round(score, 9) AS score FROM s ORDER BY score DESC, turn_id DESC LIMIT 24"""
    return turns + """,
w AS (SELECT sum(weight) AS w FROM q WHERE true),
c AS (SELECT doc_id, sum(q2.weight) / (SELECT w FROM w) AS exact, coalesce(sum(q2.weight) FILTER (rank <= 96), 0) / (SELECT w FROM w) AS coarse FROM pd JOIN q2 USING (term) GROUP BY doc_id)
SELECT 0 AS query_id, doc_id AS hit_id, round(0.25 * coarse + 0.75 * exact, 9) AS score FROM c WHERE coarse > 0 ORDER BY 0.25 * coarse + 0.75 * exact DESC, doc_id DESC LIMIT 8""".replace(
        "w AS (", "df AS (SELECT term FROM p WHERE rank <= 64 UNION SELECT term FROM pd WHERE rank <= 96), q2 AS (SELECT * FROM q WHERE term IN (SELECT term FROM df)), w AS ("
    )


def sql() -> dict[str, str]:
    toks = _tokens("content")
    uk, uc = _user("content")
    ok, oc = _other("content")
    lit_turns = f"SELECT turn_id, content FROM ({CUED}) UNION ALL SELECT -id, text FROM ({LITERALS})"
    anchor_text = _lit("The thonon reanti, of erinnd")
    return {
        "turn_profile": f"SELECT turn_id, CAST(length(content) AS INTEGER) AS chars, CAST(strlen(content) AS INTEGER) AS bytes, {toks} AS tokens, sha256(content) AS sha256 FROM ({TURNS})",
        "normalized_messy": "SELECT conv_id, turn, " + _norm("' ' || chr(9) || replace(text, ' ', '  ') || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || chr(10) || ' x' || chr(13)") + " AS content FROM conversations",
        "turn_dedupe": f"""WITH t AS ({TURNS}), f AS (SELECT *, sha256(content) AS sha256, row_number() OVER (PARTITION BY session_id, role, sha256(content) ORDER BY turn_id) AS c FROM t WHERE content <> '')
SELECT row_number() OVER (ORDER BY turn_id) AS turn_id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY f.turn_id) AS seq, role, sha256 FROM f WHERE c = 1""",
        "block_pack": f"""WITH t AS ({TURNS}), b AS (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1) // 3 AS block FROM t)
SELECT session_id, block, min(seq) AS first_seq, max(seq) AS last_seq, min(turn_id) AS first_turn_id, max(turn_id) AS last_turn_id, count(*) AS turn_count, CAST(sum(strlen(content)) AS BIGINT) AS text_bytes FROM b GROUP BY session_id, block""",
        "role_tokens": f"SELECT role, count(*) AS turns, CAST(sum({toks}) AS BIGINT) AS tokens FROM ({TURNS}) GROUP BY role",
        "session_stats": f"SELECT session_id, count(*) AS turns, max(seq) AS last_seq, CAST(sum(strlen(content)) AS BIGINT) AS bytes, CAST(sum({toks}) AS BIGINT) AS tokens FROM ({TURNS}) GROUP BY session_id",
        "store_stats": f"""WITH t AS ({TURNS}), e AS (SELECT content, turn_id % 4 <> 0 AS live FROM t WHERE role = 'user'), a AS (SELECT strlen({_norm('text')}) AS n FROM documents),
j AS (SELECT coalesce(string_agg(content, chr(10)) FILTER (live), '') AS content FROM e)
SELECT (SELECT count(*) FROM t) AS turns, (SELECT count(DISTINCT session_id) FROM t) AS sessions, (SELECT CAST(sum(strlen(content)) AS BIGINT) FROM t) AS raw_message_bytes, (SELECT CAST(sum({toks}) AS BIGINT) FROM t) AS estimated_raw_tokens,
(SELECT CAST(sum(b) AS BIGINT) FROM (SELECT (count(*) + 15) // 16 AS b FROM t GROUP BY session_id)) AS raw_blocks, (SELECT count(*) FROM e) AS all_entries, (SELECT count(*) FILTER (live) FROM e) AS active_entries,
(SELECT CAST(sum(strlen(content)) AS BIGINT) FROM e) AS entry_text_bytes, (SELECT count(*) FROM a) AS attachments, (SELECT CAST(sum(n) AS BIGINT) FROM a) AS attachment_raw_bytes, (SELECT {toks} FROM j) AS estimated_dictionary_tokens,
(SELECT count(*) FROM t) + (SELECT count(*) FROM e) + (SELECT count(*) FROM a) AS index_records""",
        "sentence_split": f"WITH s AS (SELECT turn_id, {_sentences('content')} AS l FROM ({TURNS})) SELECT turn_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS pos, unnest(l) AS sentence FROM s",
        "question_flag": f"WITH x AS (SELECT id AS turn_id, text AS content FROM ({LITERALS}) UNION ALL SELECT turn_id + 100, content || CASE WHEN turn_id % 5 = 0 THEN '?' ELSE '' END FROM ({TURNS})) SELECT turn_id, {_question('content')} AS question FROM x",
        "atom_kind_user": f"SELECT turn_id, {uk} AS kind, {uc} AS confidence FROM ({lit_turns})",
        "atom_kind_other": f"SELECT turn_id, {ok} AS kind, {oc} AS confidence FROM ({lit_turns})",
        "fact_candidates": f"WITH {_sentence_atoms()} SELECT turn_id, pos, role, confidence FROM atoms WHERE kind = 'FACT'",
        "atoms_topk": f"""WITH {_sentence_atoms()},
o AS (SELECT *, {_PRIO} AS prio, row_number() OVER (PARTITION BY turn_id, kind, lower(content) ORDER BY {_PRIO} DESC, confidence DESC, length(content), pos) AS c FROM atoms),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY prio DESC, confidence DESC, length(content), pos) AS INTEGER) AS rank FROM o WHERE c = 1)
SELECT turn_id, rank, kind, content, confidence FROM r WHERE rank <= CASE WHEN role = 'user' THEN 8 ELSE 2 END""",
        "anchors": f"SELECT turn_id, unnest({_anchors('content')}) AS anchor FROM ({TURNS})",
        "latin_terms": f"SELECT turn_id, t.clean AS term, count(*) AS n FROM (SELECT turn_id, unnest({_toks('content')}) AS t FROM ({TURNS})) GROUP BY turn_id, t.clean",
        "cjk_ngrams": _cjk(),
        "features_topk": f"WITH t AS ({TURNS}) SELECT turn_id, term, round(weight, 6) AS weight, rank FROM ({_ranked('t', 'turn_id', 'content', 64)})",
        "doc_freq": f"WITH t AS (SELECT doc_id, {_norm('text')} AS body FROM documents) SELECT term, count(*) AS df FROM ({_ranked('t', 'doc_id', 'body', 96)}) GROUP BY term",
        "idf_query": f"""WITH t AS ({TURNS}), p AS ({_ranked('t', 'turn_id', 'content', 64)}), q AS (SELECT term, weight FROM ({_ranked('(SELECT 0 AS id, ' + _lit(QUERY) + ' AS text)', 'id', 'text', 64)})),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term), n AS (SELECT count(*) AS n FROM t)
SELECT term, df, round(weight * (1 + greatest(0, (n - df) / n)), 9) AS idf_weight FROM q JOIN d USING (term), n""",
        "search_exact_turns": _exact_turns("turn"),
        "search_exact_attachments": _exact_turns("attachment"),
        "anchor_factors": f"WITH a AS (SELECT {_anchors(anchor_text)} AS a), m AS (SELECT turn_id, len(list_filter(a, lambda x: contains(lower(content), x))) / len(a) AS ratio FROM ({TURNS}), a) SELECT turn_id, round(ratio, 9) AS ratio, round(CASE WHEN ratio = 0 THEN 0.1 ELSE 0.65 + 2.35 * ratio END, 9) AS factor FROM m",
        "next_assistant_reply": f"WITH t AS ({TURNS}), r AS (SELECT turn_id, min(CASE WHEN role = 'assistant' THEN turn_id END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS reply_id FROM t) SELECT * FROM r WHERE reply_id IS NOT NULL",
        "recent_turns": f"SELECT turn_id, role FROM ({TURNS}) ORDER BY turn_id DESC LIMIT 10",
        "merge_hits": f"""WITH h AS (SELECT turn_id % 7 AS query_id, CASE WHEN turn_id % 2 = 0 THEN 'entry' ELSE 'turn' END AS hit_type, turn_id % 50 AS hit_id, substr(content, 1, 12) AS content, turn_id AS s, turn_id * 37 % 101 / 101.0 AS score FROM ({TURNS})),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id, hit_type, hit_id ORDER BY score DESC) AS n FROM h),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower({_norm('content')}) ORDER BY score DESC, hit_type <> 'entry', s DESC, hit_id DESC) AS m FROM a WHERE n = 1),
c AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_type <> 'entry', s DESC, hit_id DESC) AS INTEGER) AS rank FROM b WHERE m = 1)
SELECT query_id, rank, hit_type, hit_id, round(score, 9) AS score FROM c WHERE rank <= 8""",
        "budget_prefix": f"WITH x AS (SELECT session_id, seq, {toks} AS tokens FROM ({TURNS})), r AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS running FROM x) SELECT * FROM r WHERE running <= 200",
        "jaccard_pairs": f"""WITH t AS (SELECT doc_id, {_norm('text')} AS body FROM documents), p AS ({_features('t', 'doc_id', 'body')}), n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM p x JOIN p y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY ALL)
SELECT a, b, round(k / (u.n + v.n - k), 9) AS similarity FROM b JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE k / (u.n + v.n - k) >= 0.8""",
        "context_mode": f"""WITH g AS (SELECT conv_id, CAST(sum({_tokens('text')}) AS BIGINT) AS tokens, arg_max(substr(trim(text), 1, 1000), turn) FILTER (role = 'user' AND trim(text) <> '') AS task, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, tokens, tokens >= 600 AS replaced, coalesce(task, 'continue this conversation/project') AS task, CAST(CASE WHEN tokens >= 600 THEN least(n, 2) ELSE n END AS INTEGER) AS kept FROM g""",
        "media_types": "SELECT filename, CASE WHEN starts_with(mime, 'image/') THEN 'image' WHEN starts_with(mime, 'audio/') THEN 'audio' WHEN starts_with(mime, 'video/') THEN 'video' WHEN mime = 'application/pdf' OR lower(filename) LIKE '%.pdf' THEN 'pdf' WHEN starts_with(mime, 'text/') OR regexp_matches(lower(filename), '\\.(md|txt|py|json|ya?ml|csv|tex)$') THEN 'text' ELSE 'binary' END AS media_type FROM (VALUES " + ", ".join(f"({_lit(a)}, {_lit(b)})" for a, b in FILES) + ") v(filename, mime)",
        "attach_dedupe": "SELECT sha256(text) AS sha256, min(doc_id) AS attachment_id, count(*) AS copies FROM documents GROUP BY 1",
        "verify_hashes": f"SELECT turn_id, 'turn ' || turn_id || ': hash mismatch' AS problem FROM ({TURNS}) WHERE turn_id % 50 = 7",
        "parse_transcript": f"SELECT conv_id, turn + 1 AS pos, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS content FROM conversations",
        "import_json": "SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id * 100 + turn AS pos, role, text || chr(10) || 'tail' AS content FROM conversations",
        "export_markdown": f"SELECT turn_id, '## ' || upper(role[1]) || role[2:] || ' · T' || turn_id || chr(10) || chr(10) || content AS line FROM ({TURNS})",
    }
