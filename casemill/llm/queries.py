"""Queries over the operators of this package, one for each number, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm import bpe_tree, exact_dedup, jaccard, langid, lexical, licenses, line_dedup, packing, quality, rank_bpe, spelling, token_files, url_filter
from casemill.llm.common import table


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.coding_digests(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_predictions(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_bpe.coding_digests(table(spark, sf_dir, "documents"))


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

#: Hosts, paths and edges as the operator takes them; aliases are reached by recursion over the edges in both directions.
OP1_SQL = rf"""
WITH RECURSIVE p AS (SELECT page_id, url, html, coalesce(regexp_extract(url, '(?s)^.*?://([^#]*)', 1), '') AS rest FROM pages),
u AS (SELECT page_id, url, html, translate(regexp_extract(rest, '(?s)^([^/?]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
  regexp_extract(rest, '(?s)^[^/?]*([^?]*)', 1) AS path, regexp_extract(rest, '(?s)^[^/?]*(.*)$', 1) AS tail FROM p),
h AS (SELECT url, host || tail AS a, unnest([regexp_extract(regexp_extract(html, '{url_filter.CANONICAL_TAG.replace("'", "''")}'), '{url_filter.CANONICAL_HREF.replace("'", "''")}', 1),
  regexp_extract(regexp_extract(html, '{url_filter.REFRESH_TAG.replace("'", "''")}'), '{url_filter.REFRESH_URL.replace("'", "''")}', 1)]) AS href FROM u),
t AS (SELECT a, CASE WHEN contains(href, '://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || href
  WHEN starts_with(href, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || href
  ELSE coalesce(nullif(regexp_extract(url, '(?s)^(.*?://[^?#]*/)', 1), ''), regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || '/') || href END AS target
  FROM h WHERE href <> ''),
e AS (SELECT DISTINCT a, translate(regexp_extract(rest, '(?s)^([^/?]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') || regexp_extract(rest, '(?s)^[^/?]*(.*)$', 1) AS b
  FROM (SELECT a, coalesce(regexp_extract(target, '(?s)^.*?://([^#]*)', 1), '') AS rest FROM t)),
links AS (SELECT a, b FROM e WHERE a <> '' AND b <> '' UNION SELECT b, a FROM e WHERE a <> '' AND b <> ''),
reach(a, b) AS (SELECT a, a FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
rules(rule, host, path, verdict) AS (VALUES {", ".join("('" + "', '".join((r, r.partition('/')[0], ''.join(r.partition('/')[1:]), v)) + "')" for r, v in URL_RULES)}),
addresses AS (SELECT DISTINCT host || tail AS address FROM u WHERE host || tail <> '' UNION SELECT b FROM reach),
parts AS (SELECT address, regexp_extract(address, '(?s)^([^/?]*)', 1) AS host, regexp_extract(address, '(?s)^[^/?]*([^?]*)', 1) AS path FROM addresses),
m AS (SELECT address, rule, verdict FROM parts JOIN rules ON (parts.host = rules.host OR ends_with(parts.host, '.' || rules.host)) AND starts_with(parts.path, rules.path)
  QUALIFY row_number() OVER (PARTITION BY address ORDER BY length(rule) DESC, verdict, rule DESC) = 1),
alias AS (SELECT a FROM reach JOIN m ON m.address = reach.b GROUP BY a HAVING bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow'))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN alias.a IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN verdict IS NOT NULL THEN 'rule' WHEN alias.a IS NOT NULL THEN 'alias' ELSE 'default' END AS reason
FROM u LEFT JOIN m ON m.address = u.host || u.tail LEFT JOIN alias ON alias.a = u.host || u.tail
"""


OP2_SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
g AS (SELECT doc_id, i, n, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS g FROM u WHERE n >= 5 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM g WHERE i <= n - 4 UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN c m ON m.doc_id = a JOIN c n ON n.doc_id = b WHERE 100 * k >= 75 * (m.n + n.n - k)),
links AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, r.b AS component_id FROM d LEFT JOIN c ON c.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


def _path_sql(k: int) -> str:
    first = ", ".join(f"w[{i + 1}]" for i in range(line_dedup.DEPTH) if i != k)
    return f"'{k} ' || len(w) || ' ' || concat_ws(' ', {first})"


OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, text, dense_rank() OVER (ORDER BY doc_id, text) AS doc FROM documents),
raw AS (SELECT row_id, doc, text, string_split(text, chr(10)) AS lines FROM d WHERE text IS NOT NULL),
l AS (SELECT row_id, doc, unnest(lines) AS line_text, unnest(range(len(lines))) AS line FROM raw),
m AS (SELECT row_id, doc, line, line_text, trim(regexp_replace(regexp_replace(line_text, '{line_dedup.DIGITS}', '{line_dedup.DIGITS_MARK}', 'g'), '{line_dedup.LINE_BLANKS}', ' ', 'g')) AS plain FROM l),
n AS MATERIALIZED (SELECT *, string_split(plain, ' ') AS w FROM m WHERE plain <> ''),
as_is AS (SELECT plain FROM n GROUP BY plain HAVING count(DISTINCT doc) >= CASE WHEN any_value(len(w)) >= {line_dedup.LONG_WORDS} THEN {line_dedup.LONG_DOCUMENTS} ELSE {line_dedup.MIN_DOCUMENTS} END),
k AS MATERIALIZED (SELECT doc, line, plain, w, unnest([{", ".join(_path_sql(k) for k in range(line_dedup.DEPTH))}]) AS leaf FROM n WHERE len(w) >= {line_dedup.DEPTH}),
tree AS (SELECT leaf FROM k GROUP BY leaf HAVING count(DISTINCT doc) >= {line_dedup.MIN_DOCUMENTS} AND count(DISTINCT plain) > 1),
v AS (SELECT leaf, plain, any_value(w) AS w, count(DISTINCT (doc, line)) AS n FROM k WHERE leaf IN (SELECT leaf FROM tree) GROUP BY leaf, plain),
p AS (SELECT leaf, unnest(w) AS word, generate_subscripts(w, 1) AS place, n FROM v),
c AS (SELECT leaf, place, word, sum(n) AS n FROM p GROUP BY ALL),
o AS (SELECT leaf, place, max(n) AS top, sum(n) AS n FROM c GROUP BY leaf, place),
f AS (SELECT leaf, count(*) AS n_words, list(place ORDER BY place) FILTER (WHERE 2 * top >= n) AS fixed FROM o GROUP BY leaf),
g AS (SELECT leaf, fixed FROM f WHERE len(fixed) < n_words AND len(fixed) >= {line_dedup.MIN_FIXED} AND {line_dedup.FIXED_SHARE[1]} * len(fixed) >= {line_dedup.FIXED_SHARE[0]} * n_words),
t AS (SELECT v.leaf, plain, v.leaf || '|' || array_to_string(list_transform(fixed, lambda i: w[i]), ' ') AS template FROM v JOIN g ON g.leaf = v.leaf),
z AS MATERIALIZED (SELECT doc, line, template FROM k JOIN t ON t.leaf = k.leaf AND t.plain = k.plain),
often AS (SELECT template FROM z GROUP BY template HAVING count(DISTINCT doc) >= {line_dedup.MIN_DOCUMENTS}),
gone AS (SELECT doc, line FROM n WHERE plain IN (SELECT plain FROM as_is) UNION SELECT doc, line FROM z WHERE template IN (SELECT template FROM often)),
kept AS (SELECT l.row_id, coalesce(string_agg(line_text, chr(10) ORDER BY l.line) FILTER (WHERE gone.line IS NULL), '') AS body, count(gone.line) AS n_dropped, count(*) AS n_lines
  FROM l LEFT JOIN gone ON gone.doc = l.doc AND gone.line = l.line GROUP BY l.row_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, sha256(CASE WHEN text IS NULL THEN NULL ELSE body END) AS text_sha256
FROM d LEFT JOIN kept USING (row_id)
"""


def _ids_sql(cut: str) -> str:
    norm = f"trim(regexp_replace(translate(s, '{licenses.UPPER}', '{licenses.LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    ids = f"',' || array_to_string(list_transform(string_split({cut}, chr(10)), lambda s: coalesce(known[{norm}], 'u')), ',') || ','"
    marked = f"replace(regexp_replace({ids}, '{licenses.FAR_APART}', '_,', 'g'), 'u,', '')"
    return f"regexp_replace(regexp_replace({marked}, '^,(?:_,)+', ','), '(?:_,)+$', '')"


def _hit_columns() -> str:
    """Columns j<family>_<rule> and l<family>_<rule>: what each rule finds in what the rules before it have left."""
    out = []
    for f, rules in enumerate(licenses.families().values()):
        for cut, ids in (("l", "line_ids"), ("j", "joined_ids")):
            left = f"replace({ids}, ',', ',,')"
            for k, (_, sentences) in enumerate(rules):
                pattern = licenses.rule_pattern(sentences)
                out.append(f"regexp_matches({left}, '{pattern}') AS {cut}{f}_{k}")
                left = f"regexp_replace({left}, '{pattern}', ',_,', 'g')"
    return ", ".join(out)


def _licences_sql() -> str:
    names = []
    for f, rules in enumerate(licenses.families().values()):
        for k, (licence, _) in enumerate(rules):
            longer = licenses.longer_rules(rules, k)
            here = " AND ".join([f"j{f}_{k}", *(f"NOT (l{f}_{j} AND NOT j{f}_{j})" for j in longer)])
            there = " AND ".join([f"l{f}_{k}", *(f"NOT (j{f}_{j} AND NOT l{f}_{j})" for j in longer)])
            names.append(f"CASE WHEN ({here}) OR ({there}) THEN '{licence}' END")
    every = ", ".join(names)
    return f"list_filter(list_transform([{every}], lambda x, i: CASE WHEN x IS NOT NULL AND list_position([{every}], x) = i THEN x END), lambda x: x IS NOT NULL)"


OP6_SQL = rf"""
WITH k AS (SELECT MAP {{{", ".join(f"'{s}': '{i}'" for i, s in licenses.SENTENCES.items())}}} AS known),
d AS (SELECT doc_id, coalesce(text, '') AS text, translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}') AS folded FROM documents),
c AS (SELECT doc_id, {" OR ".join(f"contains(folded, '{a}')" for a in licenses.ANCHORS)} AS possible,
  regexp_replace(text, '{licenses.SENTENCE_END}', chr(10), 'g') AS by_line,
  replace(regexp_replace(replace(regexp_replace(text, '{licenses.BLANK_LINE}', chr(1), 'g'), chr(10), ' '), '{licenses.SENTENCE_END}', chr(1), 'g'), chr(1), chr(10)) AS by_sentence FROM d),
i AS (SELECT doc_id, CASE WHEN possible THEN {_ids_sql("by_line")} ELSE ',' END AS line_ids, CASE WHEN possible THEN {_ids_sql("by_sentence")} ELSE ',' END AS joined_ids FROM c, k),
h AS MATERIALIZED (SELECT *, {_hit_columns()} FROM i)
SELECT doc_id, line_ids, joined_ids, {_licences_sql()} AS licences FROM h
"""

LEXICAL_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP11_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '{LEXICAL_TERM}') AS t FROM documents),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '{LEXICAL_TERM}')) AS term FROM benchmark),
c AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_words FROM d),
u AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM u WHERE term IN (SELECT term FROM i) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term),
s AS (SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_words)))))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN w USING (term), c GROUP BY item_id, r)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM s WHERE score > 0 AND doc_id IS NOT NULL) WHERE rank <= 10
"""

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_line_dedup": op3_line_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_license_scan": op6_license_scan,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_files": op10_token_files,
    "op11_lexical_search": op11_lexical_search,
    "op12_rank_bpe": op12_rank_bpe,
    "op13_spelling_groups": op13_spelling_groups,
}
ORACLE_SQL = {"op1_url_filter": OP1_SQL, "op2_jaccard_join": OP2_SQL, "op3_line_dedup": OP3_SQL, "op6_license_scan": OP6_SQL, "op7_exact_dedup": OP7_SQL,
              "op11_lexical_search": OP11_SQL}
