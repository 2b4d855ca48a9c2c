"""DuckDB SQL of the operators that SQL can express on whole tables. The
nearest-neighbour, classifier, tokenizer, HTML and language-model queries have
none; tests/llm compares them with brute force."""

_BENCH_WORDS = r"regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1 = f"""
WITH item AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, w[j:j + least(13, len(w)) - 1] AS g
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS j FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT doc_id, j, n, w[j:j + n - 1] AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, j, occ.n AS n FROM occ JOIN win USING (g)),
cnt AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
               sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256
        FROM hit GROUP BY 1)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN cnt USING (doc_id) LEFT JOIN its USING (doc_id)
"""
_WORDS = r"regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+')"
OP9 = f"""
WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, j, md5(array_to_string(w[j:j + 34], ' ')) AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS j FROM doc WHERE len(w) >= 35)),
dup AS (SELECT doc_id, j FROM (SELECT doc_id, j, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM doc),
flag AS (SELECT word.doc_id, p, x, max(CASE WHEN j IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY word.doc_id ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
         FROM word LEFT JOIN dup ON dup.doc_id = word.doc_id AND j = p),
kept AS (SELECT doc_id, sum(gone) AS n, string_agg(CASE WHEN gone = 0 THEN x END, ' ' ORDER BY p) AS t FROM flag GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept ON kept.doc_id = doc.doc_id
"""
OP4 = """
WITH doc AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
win AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS g
        FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM doc WHERE length(h) >= 200)),
dup AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS r FROM win) WHERE r > 1),
edge AS (SELECT doc_id, p, p - lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) > 100 AS fresh FROM dup),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b
         FROM (SELECT doc_id, p, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM edge) GROUP BY doc_id, k),
cut AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS c, lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS final FROM runs),
piece AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed,
                 string_agg(substr(h, 2 * c + 1, 2 * (a - c)) || CASE WHEN final THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS left_hex
          FROM cut JOIN doc USING (doc_id) GROUP BY doc_id)
SELECT doc.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_hex, h))) AS kept_sha256
FROM doc LEFT JOIN piece USING (doc_id)
"""
OP2 = r"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
gram AS (SELECT DISTINCT doc_id, md5(array_to_string(w[j:j + least(4, len(w)) - 1], ' ')) AS g
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS j FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY 1),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN size s ON s.doc_id = x JOIN size t ON t.doc_id = y WHERE 100 * k >= 85 * (s.n + t.n - k)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT x AS a, y AS b FROM edge UNION SELECT a, y FROM reach JOIN edge ON b = x)
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, least(doc.doc_id, coalesce(m, doc.doc_id)) AS component_id
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) USING (doc_id)
"""
OP10 = """
WITH page AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
dig AS (SELECT page_id, octet_length(b) AS n, array_to_string([
          substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(sha1(b) || '000', i * 5 // 4 + 1, 3) AS INT) >> (7 - (i * 5) % 4)) & 31), 1)
          FOR i IN range(0, 32)], '') AS d FROM page),
lead_of AS (SELECT d, max(page_id) AS m FROM dig GROUP BY 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> m THEN m END AS refers_to
FROM dig JOIN lead_of USING (d)
"""


def _crc32(text: str) -> str:
    """crc32 of a string's UTF-8 bytes, bit by bit."""
    return f"""xor(list_reduce(list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT)),
  lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, j: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295), 4294967295)"""


def _cell(cost: str | int, audit: str, text: str) -> str:
    return f"{{'c': {cost}, 'a': {audit}, 't': {text}}}"


def _least(*cells: str) -> str:
    return f"list_min([{', '.join(cells)}])"


_LINE = ("chr(10) || 'user:'", "chr(10) || 'assistant:'")


def _insert(cell: str, who: int) -> str:
    return _cell(f"{cell}.c + 5", f"'I' || {cell}.a", f"{_LINE[who]} || {cell}.t")


def _edit(q: int, keeps: tuple, forced: int) -> str:
    """Cheapest of delete, keep and rerole from grammar state ``q``; ``f`` holds
    the cells of the row after."""
    def cell(t):
        return f"f[{t + 1}]"

    delete = _cell(f"{cell(q)}.c + 2", f"'D' || {cell(q)}.a", f"{cell(q)}.t")
    keep = "".join(
        f" WHEN init = '{r}' THEN " + _cell(f"{cell(t)}.c + extra", f"'K' || {cell(t)}.a", f"chr(10) || role || ':' || text || {cell(t)}.t") for r, t in keeps)
    rerole = _cell(f"{cell(forced)}.c + extra + 1", f"'R' || {cell(forced)}.a", f"{_LINE[forced - 2]} || text || {cell(forced)}.t")
    return _least(delete, f"CASE WHEN gone THEN {delete}{keep} ELSE {delete} END", f"CASE WHEN gone THEN {delete} ELSE {rerole} END")


_EDITS = ",\n        ".join(_edit(*x) for x in ((0, (("s", 1), ("u", 2)), 2), (1, (("u", 2),), 2), (2, (("a", 3),), 3), (3, (("u", 2),), 2)))
#: Row by row from the end of each conversation: per grammar state the cheapest
#: cost, audit and repaired text.
OP11 = f"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hashed AS (SELECT * EXCLUDE (k), {_crc32('k')} % 20 AS h FROM base),
hurt AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
                CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE h <> 0),
ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
line AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS i
         FROM hurt JOIN ids ON hurt.conv_id IS NOT DISTINCT FROM ids.conv_id),
flaw AS (SELECT *, CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'o' END AS init,
                NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again,
                NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut FROM line),
mark AS (SELECT *, blank OR again AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS extra,
                coalesce(lag(init) OVER (PARTITION BY c ORDER BY i) || init NOT IN ('su', 'ua', 'au'), false) AS bad FROM flaw),
tally AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
                 count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT gone) AS truncated, count(*) FILTER (bad) AS illegal FROM mark GROUP BY c),
best AS (
  SELECT c, n + 1 AS i, [{_cell(0,"''","''")}, {_cell(10,"'II'",f"{_LINE[0]} || {_LINE[1]}")}, {_cell(5,"'I'",_LINE[1])}, {_cell(0,"''","''")}] AS f FROM tally
  UNION ALL
  SELECT c, i, [{_least('x[1]', _insert('y[1]',0))}, {_least('x[2]', _insert('y[1]',0))}, y[1], y[2]] FROM (
    SELECT c, i, x, [{_least('x[3]', _insert('x[4]',1))}, {_least('x[4]', _insert('x[3]',0))}] AS y FROM (
      SELECT c, mark.i AS i, [{_EDITS}] AS x
      FROM best JOIN mark USING (c) WHERE mark.i = best.i - 1)))
SELECT ids.conv_id AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(f[1].c, 0) AS BIGINT) AS cost, coalesce(f[1].a, '') AS audit, sha256(coalesce(substr(f[1].t, 2), '')) AS repaired_sha256
FROM ids LEFT JOIN tally USING (c) LEFT JOIN best ON best.c = ids.c AND best.i = 1
"""
OP13 = f"""
WITH RECURSIVE run AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS r FROM documents),
runs AS (SELECT d || ':' || r AS k, r, count(*) AS c FROM run WHERE length(r) >= 6 GROUP BY 1, 2),
hashed AS (SELECT r, c, {_crc32('k')} AS h FROM runs),
word AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS w, c FROM hashed),
vocab AS (SELECT w, CAST(sum(c) AS BIGINT) AS n FROM word WHERE length(w) >= 6 GROUP BY 1 HAVING sum(c) >= 5),
place AS (SELECT w, n, unnest(range(0, length(w))) AS i FROM vocab),
gap AS (SELECT w, n, substr(w, 1, i) AS p, substr(w, i + 2) AS s FROM place),
pair AS (
  SELECT a.w AS w, b.w AS v, b.n AS m FROM gap a JOIN gap b ON a.p = b.p AND a.s = b.s AND a.w <> b.w
  UNION SELECT g.w, v.w, v.n FROM gap g JOIN vocab v ON v.w = g.p || g.s
  UNION SELECT v.w, g.w, g.n FROM gap g JOIN vocab v ON v.w = g.p || g.s),
best AS (SELECT w, v, m, count(*) OVER (PARTITION BY w) AS k, row_number() OVER (PARTITION BY w ORDER BY m DESC, v COLLATE "binary") AS r FROM pair),
named AS (SELECT vocab.w, vocab.n, coalesce(k, 0) AS k, CASE WHEN m >= 5 * n THEN v END AS f, CASE WHEN m >= 5 * n THEN m END AS fn
          FROM vocab LEFT JOIN best ON best.w = vocab.w AND r = 1),
chain AS (SELECT w, w AS e, f AS nxt FROM named
          UNION ALL SELECT chain.w, named.w, named.f FROM chain JOIN named ON named.w = chain.nxt)
SELECT named.w AS word, f AS form, e AS root, n, k AS n_near, fn AS form_n
FROM named JOIN chain ON chain.w = named.w AND nxt IS NULL
"""

ORACLE = {
    "op1_benchmark_decontamination": OP1,
    "op2_ngram_jaccard_join": OP2,
    "op4_suffix_array_dedup": OP4,
    "op9_substring_dedup": OP9,
    "op10_warc_salvage": OP10,
    "op11_conversation_repair": OP11,
    "op13_spelling_variants": OP13,
}
