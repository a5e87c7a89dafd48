"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    op1_packing,
    op2_url_filter,
    op3_jaccard,
    op4_substring,
    op5_mixing,
    op6_quality,
    op7_line_dedup,
    op8_language,
    op9_exact_dedup,
    op10_token_files,
    op11_phrases,
    op12_simhash,
    op13_spelling,
)
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_packing.pack_documents(table(spark, sf_dir, "documents"), keep_ids=False)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are labelled by what their own html shows; nothing else in the tables tells of pages."""
    pages = table(spark, sf_dir, "pages")
    found = op2_url_filter.url_filter(pages, op2_url_filter.page_outcomes(pages))
    mean, upper = (F.floor(F.col(c) * 1e6 + 0.5) / 1e6 for c in ("mean", "upper"))
    return found.select("page_id", "host", "path", "rule", "verdict", mean.alias("mean"), upper.alias("upper"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_substring.substring_dedup(table(spark, sf_dir, "documents"), keep_text=False)


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_mixing.mix_report(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op6_quality.quality(docs, op6_quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_line_dedup.line_dedup(table(spark, sf_dir, "documents"), keep_text=False, extend=True)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return op8_language.predict(docs, op8_language.fit(docs))


def op9_exact_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower half of the doc_ids is the history, the rest comes new."""
    docs = table(spark, sf_dir, "documents")
    r = docs.selectExpr("min(doc_id) low", "max(doc_id) high").first()
    middle = ((r["low"] or 0) + (r["high"] or 0)) // 2
    past = docs.where(f"doc_id <= {middle}")
    new = docs.where(f"doc_id > {middle} or doc_id is null")
    return op9_exact_dedup.exact_dedup(new, past).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = op10_token_files.new_folder(spark)
    op10_token_files.write_token_files(table(spark, sf_dir, "documents"), uri)
    return op10_token_files.read_token_files(spark, uri)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_phrases.collocations(table(spark, sf_dir, "documents")).drop("n_left", "n_right")


def op12_simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_simhash.simhash_components(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_url_filters": op2_url_filters,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_mixing_sources": op5_mixing_sources,
    "op6_quality_rules": op6_quality_rules,
    "op7_line_dedup": op7_line_dedup_query,
    "op8_language_id": op8_language_id,
    "op9_exact_dedup": op9_exact_dedup_query,
    "op10_token_files": op10_token_files_query,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_simhash_near_dedup": op12_simhash_query,
    "op13_spelling_variants": op13_spelling_variants,
}

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = r"""
WITH parsed AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
seen AS (SELECT page_id, regexp_replace(html, '(?s)<(script|style)\b.*?</(script|style)>|<[^>]*>', ' ', 'g') AS t FROM pages WHERE html IS NOT NULL AND page_id IS NOT NULL),
outcomes AS (SELECT page_id, min(CASE WHEN len(regexp_extract_all(t, '[#*$%|]')) * 10 <= len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) THEN 1 ELSE 0 END) AS good FROM seen GROUP BY 1),
hosts0 AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS k, regexp_replace(host, '(^.*@)|(:[0-9]*$)', '') AS name FROM parsed LEFT JOIN outcomes USING (page_id) GROUP BY 1),
hosts1 AS (SELECT *, string_split(name, '.') AS l, len(string_split(name, '.')) AS m FROM hosts0),
hosts2 AS (SELECT *, array_to_string(l[greatest(m - 1, 1):], '.') AS two FROM hosts1),
hosts AS (SELECT host, n, k, CASE WHEN two IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.in', 'co.nz', 'co.za', 'com.cn') THEN two ELSE l[m] END AS suffix,
    CASE WHEN two IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.in', 'co.nz', 'co.za', 'com.cn') THEN array_to_string(l[greatest(m - 2, 1):], '.') ELSE two END AS domain FROM hosts2),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
s0 AS (SELECT *, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM suffixes) AS p FROM suffixes),
s1 AS (SELECT coalesce(floor(sum((k - n * p) ** 2 - n * (p * (1 - p))) / nullif(sum(n * (n - 1) * (p * (1 - p))), 0) * 1e6 + 0.5), 0) / 1e6 AS r FROM s0),
s2 AS (SELECT CASE WHEN r <= 1 / 1001.0::DOUBLE THEN 1000.0 ELSE greatest(4.0, 1 / r - 1) END::DOUBLE AS m FROM s1),
s AS (SELECT suffix, (k + m * p) / (k + m * p + (n - k + m * (1 - p))) AS p_suffix FROM s0, s2),
d0 AS (SELECT domains.*, p_suffix AS p FROM domains JOIN s USING (suffix)),
d1 AS (SELECT coalesce(floor(sum((k - n * p) ** 2 - n * (p * (1 - p))) / nullif(sum(n * (n - 1) * (p * (1 - p))), 0) * 1e6 + 0.5), 0) / 1e6 AS r FROM d0),
d2 AS (SELECT CASE WHEN r <= 1 / 1001.0::DOUBLE THEN 1000.0 ELSE greatest(4.0, 1 / r - 1) END::DOUBLE AS m FROM d1),
d AS (SELECT domain, (k + m * p) / (k + m * p + (n - k + m * (1 - p))) AS p_domain FROM d0, d2),
h0 AS (SELECT hosts.*, p_domain AS p FROM hosts JOIN d USING (domain)),
h1 AS (SELECT coalesce(floor(sum((k - n * p) ** 2 - n * (p * (1 - p))) / nullif(sum(n * (n - 1) * (p * (1 - p))), 0) * 1e6 + 0.5), 0) / 1e6 AS r FROM h0),
h2 AS (SELECT CASE WHEN r <= 1 / 1001.0::DOUBLE THEN 1000.0 ELSE greatest(4.0, 1 / r - 1) END::DOUBLE AS m FROM h1),
h3 AS (SELECT host, k + m * p AS a, n - k + m * (1 - p) AS b FROM h0, h2),
h AS (SELECT host, a / (a + b) AS mean, a / (a + b) + 2.0 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS upper, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM suffixes) AS overall FROM h3),
ruled AS (SELECT page_id, host, path, (SELECT max({'n': length(r.h || r.p), 'rule': r.h || r.p, 'verdict': r.verdict}) FROM rules r
    WHERE (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)) AS r FROM parsed)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN upper < overall * 0.9 THEN 'block' ELSE 'allow' END) AS verdict, floor(mean * 1e6 + 0.5) / 1e6 AS mean, floor(upper * 1e6 + 0.5) / 1e6 AS upper
FROM ruled JOIN h USING (host)
"""

OP3_SQL = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {WORDS.format(text=LOWERED)} AS w FROM documents),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) r ON r.a = d.doc_id
"""

OP4_SQL = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS m FROM windows GROUP BY 1),
starts AS (SELECT doc_id, i FROM windows JOIN firsts USING (h) WHERE doc_id > m),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS g FROM starts, range(50) t(k) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: g IS NULL OR NOT list_contains(g, i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""

OP9_SQL = f"""
WITH t AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""

OP11_SQL = rf"""
WITH pieces AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces WHERE len(w) > 0),
n AS (SELECT lang, count(*) AS n FROM places GROUP BY 1),
f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM places, range(1, 5) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
candidates AS MATERIALIZED (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, size, phrase, a, w, unnest(range(1, size)) AS c FROM candidates),
scored AS (SELECT c.lang, c.phrase, c.a, min({{'score': (2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f), 'c': c.c, 'l': x.f, 'r': y.f}}) AS s FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:c.c], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.c + 1:], ' ') GROUP BY ALL),
inside AS (SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a AS longer FROM (SELECT lang, w, a, size, m, unnest(range(1, size - m + 2)) AS i FROM candidates, range(2, 4) t(m) WHERE m < size)),
left_in AS (SELECT s.* FROM scored s WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = s.lang AND i.phrase = s.phrase AND 100::HUGEINT * i.longer >= 80::HUGEINT * s.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY s.score DESC, a DESC, phrase) AS rank FROM left_in)
SELECT lang, rank, phrase, a, s.l AS l, s.r AS r, n, s.score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op2_url_filters": OP2_SQL,
    "op3_jaccard_join": OP3_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_phrase_collocations": OP11_SQL,
}
