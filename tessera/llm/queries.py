"""Queries of the operators in this package, with DuckDB SQL where SQL can
express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bwt, decontam, hardneg, neardup, packing, quality, sharding, spans, spelling, topk, toxicity, urls, warc
from tessera.llm.common import table
from tessera.session import apply_library_conf

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
             ("allow", "com/fr/"), ("block", "com/de/")]


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_library_conf(spark)
            return fn(spark, sf_dir)
        REGISTRY[name] = (run, sql)
        return fn
    return deco


def _url_sql() -> str:
    """The same propagation in SQL: what arrives over paths of each length, added up."""
    host = ("CASE WHEN strpos({u}, '://') > 0 THEN translate(regexp_extract(substr({u}, strpos({u}, '://') + 3), "
            "'^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END")
    path = ("CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), "
            "'^[^/?#]*([^?#]*)', 1) ELSE '' END")
    ordered = sorted(URL_RULES, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    fits = []
    for v, text in ordered:
        h, _, p = text.partition("/")
        fits.append((f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')", text, v))
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t, _ in fits) + " END"
    ruled = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits) + " END"
    # This engine's patterns take linear time by themselves.
    link = urls.LINK.replace("*+", "*").replace("?+", "?").replace("++", "+").replace("'", "''")
    ctes = [
        f"p0 AS (SELECT page_id, url, html, {host.format(u='url')} AS host, {path} AS path FROM pages)",
        f"p AS (SELECT *, {rule} AS rule, {ruled} AS ruled FROM p0)",
        f"t AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS t FROM p0)",
        "l0 AS (SELECT src, " + host.format(u="(CASE WHEN starts_with(t, '//') THEN 'x:' || t ELSE t END)")
        + " AS dst FROM t)",
        "l AS (SELECT src, dst, count(*) AS w FROM l0 WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL)",
        "s AS (SELECT host, sum((ruled = 'allow')::INT)::DOUBLE AS allow, sum((ruled = 'block')::INT)::DOUBLE AS block "
        "FROM p WHERE host <> '' AND ruled IS NOT NULL GROUP BY host)",
        "lf AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM l)",
        "lb AS (SELECT dst AS src, src AS dst, w / sum(w) OVER (PARTITION BY dst) AS share FROM l)"]
    for kind, edges in (("allow", "lf"), ("block", "lb")):
        ctes += [
            f"{kind}_at AS (SELECT host AS node, {kind} * {1 - urls.DAMPING} AS term, 0 AS k FROM s WHERE {kind} > 0 "
            f"UNION ALL SELECT e.dst, sum(a.term * e.share * {urls.DAMPING}), a.k + 1 FROM {kind}_at a JOIN {edges} e "
            f"ON a.node = e.src GROUP BY e.dst, a.k HAVING sum(a.term * e.share * {urls.DAMPING}) > {urls.TOLERANCE})",
            f"{kind}_sum AS (SELECT node, sum(term) AS score FROM {kind}_at GROUP BY node)"]
    return ("WITH RECURSIVE " + ", ".join(ctes) +
            ", j AS (SELECT page_id, host, path, rule, ruled, coalesce(a.score, 0) AS trust, "
            "coalesce(b.score, 0) AS distrust FROM p LEFT JOIN allow_sum a ON a.node = host "
            "LEFT JOIN block_sum b ON b.node = host) SELECT page_id, host, path, rule, coalesce(ruled, "
            f"CASE WHEN distrust > trust * (1 + {urls.MARGIN}) THEN 'block' ELSE 'allow' END) AS verdict FROM j")


def tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@register("op1_top_products", """
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.uid, q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda k: q.e[k] * c.e[k])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.uid <> c.uid WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
             vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
""")
def op1(spark, d):
    """The 20 greatest integer inner products of every 20th vector against all others."""
    return topk.top_products(table(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


@register("op2_decontamination")
def op2(spark, d):
    """One row per document and benchmark item that it repeats, replaced tokens allowed."""
    return decontam.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


@register("op3_toxicity")
def op3(spark, d):
    """Every document's toxicity score, learned from labelled rows that are not held out."""
    return toxicity.score_toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


@register("op4_url_filter", _url_sql())
def op4(spark, d):
    """Every page of ``pages``: rule and verdict, hosts without a rule judged by propagated trust."""
    return urls.filter_urls(table(spark, d, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@register("op5_packing")
def op5(spark, d):
    """Every piece of every document in sequences of 2048 tokens."""
    return packing.pack(table(spark, d, "documents"), tokenizer(), keep_ids=False).drop("ids")


@register("op6_substring_dedup")
def op6(spark, d):
    """Every document without its repeated runs of sentences, their ranges and number."""
    return spans.remove_repeats(table(spark, d, "documents"))


@register("op7_sharding")
def op7(spark, d):
    """Every document's shard of 24, equal texts together as far as counts at most one apart allow."""
    return sharding.shard_documents(table(spark, d, "documents"))


@register("op8_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(h) AS payload_bytes,
       array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda k:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST('0x' || substr(x, CAST(5 * g + 1 AS INTEGER), 5) AS BIGINT) // [32768, 1024, 32, 1][k + 1]) % 32 + 1 AS INTEGER), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
""")
def op8(spark, d):
    """Every page, written to WARC archives and read back."""
    return warc.archived(table(spark, d, "pages"), keep_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op9_near_duplicates", """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda k: ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2]) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS node, a AS r FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.r = e.a),
c AS (SELECT node, min(r) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
""")
def op9(spark, d):
    """Every document: its set size and near-duplicate component (3-word runs, Jaccard 0.85 or more)."""
    return neardup.near_duplicates(table(spark, d, "documents"), words=3, percent=85)


@register("op10_quality")
def op10(spark, d):
    """Every document's quality score, learned from labelled rows that are not held out."""
    return quality.score_quality(table(spark, d, "documents"), table(spark, d, "labels"))


@register("op11_hard_negatives", """
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.uid AS q, q.vec_id AS anchor_id, c.uid AS c, c.vec_id, q.label = c.label AS same,
             CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda k: q.e[k] * c.e[k])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.uid <> c.uid WHERE q.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.q, p.c ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.q = p.q AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""")
def op11(spark, d):
    """Three hard negatives for each of the five positives of every 50th vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0, label)


def _spelling_sql() -> str:
    """Crc32 from its polynomial; near words by their texts with one letter left out."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    crc = ("xor(list_reduce(list_transform(string_split({0}, ''), lambda ch: ord(ch)), lambda h, b: "
           "CASE WHEN b < 128 THEN xor(h // 256, tab[(xor(h, b) & 255) + 1]) "
           "ELSE xor(xor(h // 256, tab[(xor(h, 192 + b // 64) & 255) + 1]) // 256, "
           "tab[(xor(xor(h // 256, tab[(xor(h, 192 + b // 64) & 255) + 1]), 128 + b % 64) & 255) + 1]) END, 4294967295), 4294967295)")
    return f"""
WITH RECURSIVE steps AS (SELECT i, i AS c, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, {step}, k + 1 FROM steps WHERE k < 8),
t AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
g AS (SELECT d, w, count(*) AS n FROM r WHERE length(w) >= 7 GROUP BY ALL),
h AS (SELECT w, n, {crc.format("d || ':' || w")} AS h FROM g, t),
k AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2)
             ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM k WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM
        (SELECT word, n, CAST(unnest(range(length(word))) AS INTEGER) AS i FROM v)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.i = b.i AND a.s = b.s AND a.word <> b.word
      UNION SELECT x.word, v.word, v.n FROM x JOIN v ON v.word = x.s
      UNION SELECT v.word, x.word, x.n FROM x JOIN v ON v.word = x.s),
b AS (SELECT word, other, m, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS r,
             count(*) OVER (PARTITION BY word) AS n_near FROM p),
f AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * v.n THEN b.other END AS form,
             CASE WHEN b.m >= 10 * v.n THEN b.m END AS form_n FROM v LEFT JOIN b ON b.word = v.word AND b.r = 1),
u AS (SELECT word, word AS at FROM f UNION ALL SELECT u.word, f.form FROM u JOIN f ON f.word = u.at WHERE f.form IS NOT NULL),
e AS (SELECT u.word, u.at AS root FROM u JOIN f ON f.word = u.at WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN e ON e.word = f.word"""


@register("op12_spelling_variants", _spelling_sql())
def op12(spark, d):
    """Every word of at least 7 letters and 2 occurrences with its near words, form and root."""
    words = spelling.word_counts(table(spark, d, "documents"), length=7, times=2, drop=31)
    return spelling.spelling_variants(words, factor=10)


@register("op13_suffix_dedup")
def op13(spark, d):
    """Every document without the bytes whose 50-byte strings start in a document with a smaller id."""
    out = bwt.remove_repeated(table(spark, d, "documents"), length=50)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    return {k: fn for k, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in REGISTRY.items() if sql}
