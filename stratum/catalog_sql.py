"""Pieces of the SQL texts that the registered queries must agree with."""

from __future__ import annotations

CJK = "[\\x{3400}-\\x{9FFF}]"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def tokens(x: str) -> str:
    other = f"length(regexp_replace({x}, '{CJK}', '', 'g'))"
    return f"greatest(1, (length({x}) - {other} + ceil({other} / 3.5))::INTEGER)"


def split(x: str, target: int, overlap: int) -> str:
    """A list of chunks of the text ``x``, whose ends are trimmed already."""
    longest = max(1000, target * 2)
    stride = longest - overlap
    cut = f"CASE WHEN length(p) > {longest} THEN list_transform(range(0, ceil((length(p) - {longest}) / {float(stride)})::BIGINT + 1), lambda i: substring(p, i * {stride} + 1, {longest})) WHEN p <> '' THEN [p] ELSE []::VARCHAR[] END"
    units = f"flatten(list_transform(list_transform(regexp_split_to_array({x}, '\\n{{2,}}'), lambda y: {trim('y')}), lambda p: {cut}))"
    done = trim("array_to_string(a.cur, chr(10) || chr(10))")
    tail = f"right({done}, {overlap})" if overlap else "''"
    fresh = f"CASE WHEN {tail} <> '' THEN [{tail}, u.u] ELSE [u.u] END"
    full = f"(len(a.cur) > 0 AND a.n + {tokens('u.u')} > {target})"
    step = (
        f"{{'u': '', 'out': CASE WHEN {full} THEN list_append(a.out, {done}) ELSE a.out END, 'cur': CASE WHEN {full} THEN {fresh} ELSE list_append(a.cur, u.u) END, "
        f"'n': CASE WHEN {full} THEN {tokens(f'array_to_string({fresh}, chr(10) || chr(10))')} ELSE a.n + {tokens('u.u')} END}}"
    )
    wrapped = f"list_transform({units}, lambda v: {{'u': v, 'out': []::VARCHAR[], 'cur': []::VARCHAR[], 'n': 0::INTEGER}})"
    folded = f"list_reduce({wrapped}, lambda a, u: {step}, {{'u': '', 'out': []::VARCHAR[], 'cur': []::VARCHAR[], 'n': 0::INTEGER}})"
    return f"list_transform([{folded}], lambda a: CASE WHEN len(a.cur) > 0 THEN list_append(a.out, {done}) ELSE a.out END)[1]"


def lexical(x: str) -> str:
    """Tokens of a text without CJK characters."""
    return f"regexp_extract_all(lower({x}), '[a-zA-Z0-9_][a-zA-Z0-9_.-]*')"


def body(x: str) -> str:
    return trim(f"regexp_replace(coalesce({x}, ''), chr(13) || chr(10) || '?', chr(10), 'g')")


DOCS = f"docs AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS source_ord, 'doc_' || doc_id AS document, {body('text')} AS body, text FROM documents)"

SECTIONS = f"""
{DOCS}, part_lists AS (SELECT source_ord, document, CASE WHEN body = '' THEN []::VARCHAR[] ELSE {split("body", 6000, 0)} END AS parts FROM docs
), part_rows AS (SELECT source_ord, document, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS section_index FROM part_lists
), sections AS (
  SELECT row_number() OVER (ORDER BY source_ord, section_index) - 1 AS parent_ord, source_ord, document, section_index, '内容区段 ' || (section_index + 1) AS title, text FROM part_rows
)"""

CHUNKS = f"""{SECTIONS}, chunk_lists AS (SELECT parent_ord, source_ord, document, title, {split("text", 1200, 160)} AS parts FROM sections
), chunk_rows AS (SELECT parent_ord, source_ord, document, title, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS part_index FROM chunk_lists
), chunks AS (
  SELECT row_number() OVER (ORDER BY parent_ord, part_index) - 1 AS chunk_ord, row_number() OVER (PARTITION BY source_ord ORDER BY parent_ord, part_index) - 1 AS chunk_index, * FROM chunk_rows
)"""

POSTINGS = f"""{CHUNKS}, postings AS (
  SELECT chunk_ord, term, count(*) AS tf FROM (SELECT chunk_ord, unnest({lexical("text")}) AS term FROM chunks) GROUP BY ALL
), terms AS (SELECT term, count(*) AS df FROM postings GROUP BY term
), size AS (SELECT greatest(1, count(*)) AS n FROM chunks
), stats AS (
  SELECT c.chunk_ord, coalesce(sum(tf), 0) AS length, coalesce(nullif(sqrt(sum(pow((1 + ln(tf)) * (ln((n + 1.0) / (df + 1)) + 1), 2))), 0), 1) AS norm
  FROM chunks c CROSS JOIN size LEFT JOIN postings p ON p.chunk_ord = c.chunk_ord LEFT JOIN terms t ON t.term = p.term GROUP BY c.chunk_ord
)"""


def search(queries: str, ranged: bool = False, terms: str = lexical("query")) -> str:
    """CTEs up to ``scored`` for the queries of a CTE's SELECT (query_id, query[, s, e]), of which ``terms`` are searched."""
    inside = "AND st.chunk_ord >= q.s AND st.chunk_ord < q.e" if ranged else ""
    return f"""{POSTINGS}, q AS ({queries}
), average AS (SELECT query_id, avg(length) AS average FROM q JOIN stats st ON true {inside} GROUP BY query_id
), qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({terms}) AS term FROM q) GROUP BY ALL
), qw AS (
  SELECT qt.*, coalesce(df, 0) AS df, (1 + ln(qtf)) * (ln((n + 1.0) / (coalesce(df, 0) + 1)) + 1) AS w, count(*) OVER (PARTITION BY query_id) AS n_terms, n FROM qt CROSS JOIN size LEFT JOIN terms USING (term)
), qn AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS query_norm FROM qw
), sums AS (
  SELECT qn.query_id, p.chunk_ord, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(1, st.length) / average)))), 9) AS bm25,
    round(sum(w * (1 + ln(tf)) * (ln((n + 1.0) / (df + 1)) + 1)) / (any_value(query_norm) * any_value(norm)), 9) AS cosine, count(*) / any_value(n_terms) AS coverage
  FROM qn JOIN postings p USING (term) JOIN stats st ON st.chunk_ord = p.chunk_ord JOIN q ON q.query_id = qn.query_id {inside} JOIN average av ON av.query_id = qn.query_id
  WHERE df > 0 GROUP BY ALL
), ranks AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_ord) AS r1, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_ord) AS r2 FROM sums
), scored AS (
  SELECT query_id, chunk_ord, bm25, cosine, coverage,
    round((1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2)) * 100 + coverage * 4 + CASE WHEN contains(lower(c.text), lower({trim("q.query")})) THEN 8.0::DOUBLE ELSE 0 END, 6) AS score
  FROM ranks JOIN chunks c USING (chunk_ord) JOIN q USING (query_id)
)"""


def top(limit: int) -> str:
    return f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_ord)::INTEGER AS rank, chunk_ord, score FROM scored QUALIFY rank <= {limit}"


def text_list(values) -> str:
    return ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else "NULL" if v is None else str(v) for v in row) + ")" for row in values)
