"""DuckDB twins of the derived views (FIXTURES §2), as SQL CTE text.

The driver's oracle runs plain SQL over the registered tables; every oracle
query starts from these CTEs so both engines read the same derived rows.
"""

from __future__ import annotations

from ..functions.constants import STOP_WORDS

URL_AUTH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)"

PAGES = f"""pg AS (
  SELECT page_id, url, {URL_AUTH} AS domain, html
  FROM pages WHERE html IS NOT NULL AND trim(html) <> '')"""

TRAIN = """tr AS (
  SELECT domain, page_id, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS seq FROM pg)"""


def unescape(x: str) -> str:
    for ent, ch in (("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"),
                    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{ent}', '{ch}')"
    return x


def clean(x: str) -> str:
    """Strip tags, decode entities, collapse blanks, sentinel."""
    t = unescape(f"regexp_replace({x}, '<[^>]*>', '', 'g')")
    return f"coalesce(nullif(trim(regexp_replace({t}, '\\s+', ' ', 'g')), ''), 'empty')"


# The five structural nodes every page of the driver table has (FIXTURES §1):
# body, nav, div.ad, article, footer.  In direct mode only nav (its single
# ul child) and article (h1 and p children, a space between children) carry
# text; div and footer hold bare text and body only structural children and
# a comment, so they read 'empty'.
NAV_INNER = "regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)"
ART_INNER = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
ART_CHILDREN = f"regexp_replace({ART_INNER}, '<(h1|p)( [^>]*)?>', ' ', 'g')"

NODES = f"""node AS (
  SELECT page_id, domain, '/html/body' AS path, 'empty' AS item FROM pg
  UNION ALL SELECT page_id, domain, '/html/body/div', 'empty' FROM pg
  UNION ALL SELECT page_id, domain, '/html/body/footer', 'empty' FROM pg
  UNION ALL SELECT page_id, domain, '/html/body/nav', {clean(NAV_INNER)} FROM pg
  UNION ALL SELECT page_id, domain, '/html/body/article', {clean(ART_CHILDREN)} FROM pg)"""

# Character-exact edit distance: DuckDB's levenshtein counts bytes, so the 21
# non-ASCII letters present in the page texts are first mapped to spare ASCII
# control codes (one byte each, absent from the collapsed text).
NON_ASCII = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
SPARE = "".join(chr(c) for c in list(range(1, 9)) + list(range(14, 27)))


def char_lev(a: str, b: str) -> str:
    to = " || ".join(f"chr({ord(c)})" for c in SPARE)
    return (f"levenshtein(translate({a}, '{NON_ASCII}', {to}), "
            f"translate({b}, '{NON_ASCII}', {to}))")


def ratios_sql(limit: int = 50) -> str:
    return f"""it AS (
  SELECT n.domain, t.seq, n.path, n.item FROM node n JOIN tr t USING (page_id, domain) WHERE t.seq <= {limit}),
nit AS (SELECT domain, path, seq, count(*) AS n_items FROM it GROUP BY ALL),
bg AS (
  SELECT a.domain, a.path, a.seq AS k, a.item AS a, b.item AS b
  FROM it a JOIN it b ON a.domain = b.domain AND a.path = b.path AND b.seq < a.seq
  UNION ALL SELECT domain, path, seq, item, 'empty' FROM it),
pairs AS (SELECT DISTINCT least(a, b) AS x, greatest(a, b) AS y FROM bg),
dist AS (SELECT x, y, CASE WHEN x = y THEN 0 ELSE {char_lev('x', 'y')} END AS lev FROM pairs),
med AS (
  SELECT bg.domain, bg.path, bg.k, bg.a,
         quantile_cont(dist.lev * 2.0 / (length(bg.a) + length(bg.b)), 0.5) AS med
  FROM bg JOIN dist ON dist.x = least(bg.a, bg.b) AND dist.y = greatest(bg.a, bg.b)
  GROUP BY ALL),
rat AS (
  SELECT m.domain, m.path, m.k AS seq, nit.n_items, avg(m.med) / nit.n_items AS ratio
  FROM med m JOIN nit ON nit.domain = m.domain AND nit.path = m.path AND nit.seq = m.k
  GROUP BY m.domain, m.path, m.k, nit.n_items)"""


MODEL = """g AS (
  SELECT domain, seq, ratio AS v, count(*) AS c, sum(ratio) AS s, sum(ratio * ratio) AS q
  FROM rat GROUP BY ALL),
gw AS (
  SELECT *, sum(c) OVER w AS c1, sum(s) OVER w AS s1, sum(q) OVER w AS q1,
         sum(c) OVER (PARTITION BY domain, seq) AS cn, sum(s) OVER (PARTITION BY domain, seq) AS sn,
         sum(q) OVER (PARTITION BY domain, seq) AS qn
  FROM g WINDOW w AS (PARTITION BY domain, seq ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sp AS (
  SELECT domain, seq, v AS threshold,
         row_number() OVER (PARTITION BY domain, seq ORDER BY
           (q1 - s1 * s1 / c1) + ((qn - q1) - (sn - s1) * (sn - s1) / (cn - c1)), v) AS rn
  FROM gw WHERE c1 < cn),
np AS (SELECT domain, seq, count(*) AS n_paths FROM rat GROUP BY ALL),
model AS (
  SELECT r.domain, r.seq, r.path, r.ratio, coalesce(r.ratio > sp.threshold, true) AS is_content
  FROM rat r JOIN np USING (domain, seq)
  LEFT JOIN (SELECT * FROM sp WHERE rn = 1) sp USING (domain, seq)
  WHERE np.n_paths >= 2)"""


def main_extract_sql(limit: int = 50) -> str:
    return f"""WITH {PAGES}, {TRAIN}, {NODES}, {ratios_sql(limit)}, {MODEL},
x AS (
  SELECT p.page_id, p.domain, replace(n.path, '"', '''') AS xpath, replace(n.item, '"', '''') AS content
  FROM pg p JOIN tr USING (page_id, domain)
  JOIN model m ON m.domain = p.domain AND m.seq = least(tr.seq, {limit}) AND m.is_content
  JOIN node n ON n.page_id = p.page_id AND n.path = m.path
  WHERE n.item <> 'empty')
SELECT page_id, domain, xpath, content, content_length FROM (
  SELECT *, CAST(strlen(content) AS INTEGER) AS content_length,
         row_number() OVER (PARTITION BY page_id ORDER BY strlen(content) DESC, xpath, content) AS rn
  FROM x) WHERE rn = 1"""


# ------------------------------------------------------------------ extracts

EXTRACTS = """ex0 AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
ex1 AS (
  SELECT doc_id, source, ls[1] AS title, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS content FROM ex0),
extracts AS (
  SELECT doc_id * 1000000 + i AS extract_id, doc_id AS document_id, source AS domain,
         'p[' || i || ']' AS xpath, content, CAST(strlen(content) AS INTEGER) AS content_length,
         CAST(doc_id % 20 AS INTEGER) AS main_topic, title,
         TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 30 AS INTEGER)) AS extracted_at,
         array_to_string(list_sort(list_distinct(list_filter(string_split(content, ' '),
             lambda w: regexp_full_match(w, '[A-Z][a-z]+')))), ',') AS ner
  FROM ex1)"""

FEED_POLLS = """feed_polls AS (
  SELECT user_id AS feed_url, ts AS poll_ts, event_id, event_type <> 'error' AS ok,
         CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS etag
  FROM events)"""

VALIDATED_POLLS = FEED_POLLS + """,
validated_polls AS (
  SELECT feed_url, poll_ts, event_id, ok, CASE WHEN feed_url % 4 IN (2, 3) THEN etag END AS etag,
         CASE WHEN feed_url % 4 IN (0, 2) THEN '2024-01-' || lpad(CAST(CAST(etag AS INTEGER) % 28 + 1 AS VARCHAR), 2, '0') END AS modified
  FROM feed_polls)"""

TOKENS = """tk0 AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
tk1 AS (SELECT doc_id, unnest(range(0, len(ls))) AS sent, unnest(ls) AS line FROM tk0),
tk2 AS (SELECT doc_id, sent, string_split(line, ' ') AS ws FROM tk1),
tokens AS (
  SELECT doc_id, CAST(sent AS INTEGER) AS sent, CAST(pos AS INTEGER) AS pos, token,
         CASE WHEN regexp_full_match(token, '[A-Z][a-z]+') THEN 'PERSON' ELSE 'O' END AS tag
  FROM (SELECT doc_id, sent, unnest(range(0, len(ws))) AS pos, unnest(ws) AS token FROM tk2)
  WHERE token <> '')"""

GAZETTEER = """gz0 AS (
  SELECT replace(text, '. ', '.' || chr(10)) AS s,
         ['PERSON', 'ORG', 'WORK_OF_ART', 'PRODUCT', 'GPE'][CAST(item_id % 5 AS INTEGER) + 1] AS label
  FROM benchmark),
gazetteer AS (
  SELECT DISTINCT phrase, label FROM (
    SELECT unnest(string_split(s, chr(10)) || string_split(replace(s, ', ', ',' || chr(10)), chr(10))) AS phrase, label FROM gz0)
  WHERE phrase <> '')"""

STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS) + "]"
TOKEN_SEP = r"[\s!-,./:-@\[-^`{-~]+"


def clean_tokens_sql(text: str) -> str:
    """H3-H5 in DuckDB: same separators, stop words, strip and filter."""
    toks = f"string_split_regex(replace(lower({text}), 'n''t', ' '), '{TOKEN_SEP}')"
    kept = f"list_filter({toks}, lambda t: NOT list_contains({STOP_SQL}, t))"
    stripped = f"list_transform({kept}, lambda t: regexp_replace(t, '\\W+', '', 'g'))"
    return f"list_filter({stripped}, lambda t: regexp_full_match(t, '[a-z]{{3,}}'))"


TOPIC_TERMS = f"""tt0 AS (
  SELECT source, unnest({clean_tokens_sql('text')}) AS term FROM documents),
tt1 AS (SELECT source, term, count(*) AS n FROM tt0 GROUP BY ALL),
topic_terms AS (
  SELECT CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS topic, term,
         n / sum(n) OVER (PARTITION BY source) AS weight
  FROM tt1)"""
