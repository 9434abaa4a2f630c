"""The queries of the numbered operators over the input tables, with their DuckDB text where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.llm import bpe, decontaminate, extract, jaccard, langid, licences, pii, quality, quotes, secrets, tries, urls, vectors
from stratavox.llm.tables import settle
from stratavox.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The tokenizer file of op3 and of the pipeline.
TOKENIZER = "word_bpe_49k.json"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count and the digests of its ids and of the text decoded from them."""
    path = public_tokenizers.path(TOKENIZER)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, path)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures, the contract's base verdict, and the cascade's."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.cascade(docs).drop("text", "rejected_by")
    judged = judged.withColumn("base_failed", F.expr(f"({quality.RULES['few_words']}) OR ({quality.RULES['repeated_passages']})"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("kept"))


ORACLE_SQL["op1_quality"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS s FROM d, unnest(range(1, len(w) - 6)) AS u(i)),
h AS (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 8) AS after FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, CAST(sum(least(8, after - i)) AS BIGINT) AS n FROM h GROUP BY 1),
m AS (SELECT d.doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR n_lines > 4 AND 2 * n_dup_lines > n_lines OR n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words
        OR n_words >= 20 AND 2 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > word_chars) AS kept
FROM b
"""


@query
def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, deciding rule and verdict."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL["op6_urls"] = r"""
WITH p AS (
    SELECT page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages),
rules(verdict, h, pre) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
    SELECT page_id, arg_max(h || pre, length(h || pre)) AS rule, arg_max(verdict, length(h || pre)) AS verdict
    FROM p JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, pre) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches('.' || host || path,
    '^([^/]*\.adult-|[^/]*casino|[^/]*-pills\.|[^/]*\.free-bets\.|[^/]*\.spam-|[^/]*\.ads-|[^/]*\.adserver\.|[^/]*\.porn|[^/]*\.xxx/)') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best USING (page_id)
"""


@query
def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract.extract(pages).drop("html")
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by a model that saw no held-out document."""
    docs = read_table(spark, sf_dir, "documents")
    model = langid.fit(langid.training_rows(docs))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts and digest of the base spans, and all spans."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = secrets.train(secrets.training_sample(docs))
    found = secrets.scan(docs, ratios)
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.written(base).cast("binary"), 256).alias("base_sha256"),
        secrets.written(F.col("spans")).alias("spans"),
    )


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside windows of benchmark items, and those items."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs.withColumnRenamed("text", "body"), read_table(spark, sf_dir, "benchmark"), "body")
    listed = F.array_join("items", ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL["op4_decontaminate"] = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i+9], ' ') AS s FROM iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, i, l, array_to_string(w[i:i+l-1], ' ') AS s FROM dw, (SELECT DISTINCT l FROM p) AS q, unnest(range(1, len(w) - l + 2)) AS u(i)),
h AS (SELECT doc_id, i, g.l, item_id FROM g JOIN p USING (s)),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM h, unnest(range(i, i + l)) AS u(k) GROUP BY 1),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id)
"""


@query
def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component under a Jaccard coefficient of 0.9 on 3-word shingles."""
    return jaccard.join_components(read_table(spark, sf_dir, "documents"), n=3, percent=90)


ORACLE_SQL["op5_jaccard"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS t FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.c)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(c) AS c FROM r GROUP BY 1) m ON m.a = d.doc_id
"""


@query
def op2_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without quotes, with the message it answers, ordered so that replies follow what they answer."""
    return quotes.link(read_table(spark, sf_dir, "conversations"))


@query
def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licences: the best match, its coefficient, and all that were found."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licences.scan(docs, windows=True).drop("text")
    return found.select("doc_id", "licence", F.round("dice", 6).alias("dice"), "n_matches", F.array_join("licences", ",").alias("licences"))


@query
def op11_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code and error, its label's error, and the digest of the codebooks."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vectors.fit(rows)
    coded = settle(vectors.encode(rows, books).drop("embedding"), "codes")
    found = vectors.with_sums(coded, "error", "label", "label_error")
    return found.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


_ASSIGN = "a{k} AS (SELECT vec_id, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (SELECT vec_id, k.part, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM k JOIN c{k} USING (part)) GROUP BY 1, 2)"
_MEANS = """c{n} AS (SELECT part, entry, coalesce(m, c) AS c FROM c{k} LEFT JOIN (
    SELECT part, entry, list(m ORDER BY i) AS m FROM (SELECT part, entry, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM k JOIN a{k} USING (vec_id, part), unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL) GROUP BY 1, 2) USING (part, entry))"""

ORACLE_SQL["op11_vectors"] = f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
k AS (SELECT vec_id, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS x FROM e, unnest(range(16)) AS u(part)),
c0 AS (SELECT part, entry, x AS c FROM k JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e QUALIFY entry < 64) USING (vec_id)),
{_ASSIGN.format(k=0)},
{_MEANS.format(k=0, n=1)},
{_ASSIGN.format(k=1)},
{_MEANS.format(k=1, n=2)},
{_ASSIGN.format(k=2)},
b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2),
s AS (SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM s JOIN e USING (vec_id), b
"""


@query
def op12_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with its members, children, leaves and savings."""
    turns, convs = tries.in_order(read_table(spark, sf_dir, "conversations"))
    return tries.trie(*tries.share_openings(turns, convs))


ORACLE_SQL["op12_tries"] = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id AS c, conv_id - conv_id % 20 AS b, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT))),
    lambda v, z: list_reduce(list_concat([xor(v, z)], [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))) % 4 AS h FROM t),
q AS (SELECT c, 0 AS own, pos, r, x FROM ids JOIN t ON conv_id = b WHERE pos < h UNION ALL SELECT c, 1, pos, r, x FROM ids JOIN t ON conv_id = c WHERE pos >= h),
s AS (SELECT c, x, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, len(r) || ':' || r || x AS turn FROM q),
p AS (SELECT c, d, sha256(string_agg(sha256(turn), ',') OVER (PARTITION BY c ORDER BY d)) AS k, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM s UNION ALL SELECT c, 0, '', 0 FROM ids),
l AS (SELECT c, max(d) AS d FROM p GROUP BY 1),
n AS (SELECT p.d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE l.d = p.d), '') AS ends FROM p JOIN l USING (c) GROUP BY ALL),
e AS (SELECT p.k AS k, p.d AS d, n.k AS under, n.d - p.d AS far, (n.n_convs - 1) * n.w AS saved, n.d AS nd FROM n JOIN p ON p.c = n.conv_id AND p.d <= n.d),
m AS (SELECT k, d, count(*) FILTER (WHERE far = 1) AS n_children, sum(saved) AS saved_tokens FROM e GROUP BY 1, 2),
f AS (SELECT e.k, e.d, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves FROM e JOIN m u ON u.k = under AND u.d = nd GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, v.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN m USING (k, d) JOIN f USING (k, d) LEFT JOIN (SELECT p.c, p.d + 1 AS d, n.conv_id FROM p JOIN n USING (k, d)) v ON v.c = n.conv_id AND v.d = n.d
"""


@query
def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts and digest of the plain spans, and all spans."""
    found = pii.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: ~s["added"])

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: ~s["added"] & (s["kind"] == kind))).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.written(base).cast("binary"), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))
