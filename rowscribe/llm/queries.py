"""The registered queries of this folder, one for each operator."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowscribe.llm import decontamination, jaccard_join, language_id, license_scan, merkle, near_dedup, pieces, substring_dedup, surrogates, toxicity, vector_search, warc, whitening
from rowscribe.session import configure

QUERIES, SQL = {}, {}


def query(build):
    """Register ``build`` under its name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(lambda name: configure(spark).read.parquet(f"{folder}/{name}.parquet"))

    QUERIES[build.__name__] = run
    return run


@query
def op1_decontamination(table) -> DataFrame:
    return decontamination.contaminated(table("documents"), table("benchmark"))


@query
def op2_warc(table) -> DataFrame:
    rows = warc.archive_pages(table("pages")).filter("last")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op2_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS response FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND response <> page_id THEN response END AS refers_to
FROM r
"""


@query
def op3_substring_dedup(table) -> DataFrame:
    kept = substring_dedup.remove_repeats(table("documents"), window=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


SQL["op3_substring_dedup"] = r"""
WITH w AS (
    SELECT row_number() OVER () AS k, doc_id,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents
), p AS (SELECT k, unnest(range(len(words) - 34)) AS i, words FROM w WHERE len(words) >= 35),
v AS (SELECT k, i, md5(array_to_string(words[i + 1 : i + 35], ' ')) AS h FROM p),
d AS (SELECT h FROM v GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT k, i + unnest(range(1, 36)) AS pos FROM v SEMI JOIN d USING (h)),
g AS (SELECT k, list(pos) AS gone FROM c GROUP BY k)
SELECT doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (k)
"""


@query
def op4_language_id(table) -> DataFrame:
    docs = table("documents")
    kinds = {"document": language_id.document_evidence(docs), "page": language_id.page_evidence(table("pages"))}
    # Each kind has its own priors; the trigram tables of both are those of the documents. A page's doc_id is its page_id.
    tables = language_id.trigram_tables(docs)
    found = [language_id.identify(rows, docs, tables).drop("text_key").withColumn("kind", F.lit(kind)) for kind, rows in kinds.items()]
    return found[0].unionByName(found[1])


@query
def op5_near_dedup(table) -> DataFrame:
    return near_dedup.classes(table("documents"))


@query
def op6_toxicity(table) -> DataFrame:
    return toxicity.score(table("documents"), table("labels"))


#: The secret of the registered run; a real run brings its own.
SURROGATE_KEY = "rowscribe"


@query
def op7_surrogates(table) -> DataFrame:
    docs = table("documents").select("doc_id", "text")
    return surrogates.replace_entities(docs, key=SURROGATE_KEY, found="n_entities")


@query
def op8_vector_search(table) -> DataFrame:
    vectors = table("embeddings")
    return vector_search.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def piece_model() -> pieces.Model:
    """The public vocabulary of the registered run; its path is a parameter of the operator."""
    return pieces.Model(os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model"))


@query
def op9_pieces(table) -> DataFrame:
    model = piece_model()
    coded = pieces.decode(pieces.encode(table("documents"), model), model)
    same = F.coalesce(F.col("decoded") == F.col("text"), F.col("text").isNull())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", same.alias("round_trip"))


@query
def op10_license_scan(table) -> DataFrame:
    return license_scan.scan(table("documents")).drop("detections")


@query
def op11_merkle(table) -> DataFrame:
    docs = table("documents")
    named = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("long").cast("string")) % 2 == 0
    shown = F.when(tampered, merkle.digest(*named, F.replace("text", F.lit("\n"), F.lit(""))))
    return merkle.prove(docs.select("doc_id", "source", merkle.digest(*named, F.col("text")).alias("leaf"), shown.alias("shown")))


# One level is made per round of the first recursion; the second climbs from every leaf. crc32 is spelt out bit by bit.
SQL["op11_merkle"] = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source,
           concat(coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
                  coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-')) AS head,
           text, replace(text, chr(10), '') AS plain,
           list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                       lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
    FROM documents
), e AS (
    SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
           CASE WHEN crc % 2 = 1 THEN sha256(head || coalesce(octet_length(encode(plain)) || ':' || plain, '-')) END AS changed
    FROM d
), l AS (
    SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
           count(*) OVER (PARTITION BY source) AS n
    FROM e
), t AS (
    SELECT tree, 0 AS level, i, n, leaf AS h FROM l
    UNION ALL
    SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY tree, level, i // 3, n
), s AS (SELECT tree, h AS subroot FROM t WHERE n = 1), u AS (
    SELECT 0 AS level, tree - 1 AS i, (SELECT count(*) FROM s) AS n, subroot AS h FROM s
    UNION ALL
    SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 3, n
), nodes AS (
    SELECT tree, level, i, n, h FROM t
    UNION ALL
    SELECT 0, level, i, n, h FROM u
), sides AS (
    SELECT a.tree, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before,
           coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
    FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.tree, a.level, a.i
), climb AS (
    SELECT tree AS home, i AS leaf_i, tree, 0 AS level, i, n, coalesce(changed, leaf) AS h, '' AS path FROM l
    UNION ALL
    SELECT c.home, c.leaf_i, CASE WHEN c.n > 1 THEN c.tree ELSE 0 END, CASE WHEN c.n > 1 THEN c.level + 1 ELSE 0 END, CASE WHEN c.n > 1 THEN c.i // 3 ELSE c.tree - 1 END,
           CASE WHEN c.n > 1 THEN (c.n + 2) // 3 ELSE (SELECT count(*) FROM s) END, CASE WHEN c.n > 1 THEN sha256(x.before || c.h || x.after) ELSE c.h END,
           CASE WHEN c.n > 1 THEN c.path || x.before || x.after ELSE c.path END
    FROM climb c LEFT JOIN sides x ON x.tree = c.tree AND x.level = c.level AND x.i = c.i WHERE c.n > 1 OR c.tree > 0
)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(c.path) AS proof_sha256, c.h AS folded_root, c.h = r.h AS verified
FROM l JOIN s USING (tree) JOIN climb c ON c.home = l.tree AND c.leaf_i = l.i AND c.tree = 0 AND c.n = 1 CROSS JOIN (SELECT h FROM u WHERE n = 1) r
"""


@query
def op12_whitening(table) -> DataFrame:
    return whitening.whiten(table("embeddings"))


@query
def op13_jaccard_join(table) -> DataFrame:
    return jaccard_join.linked_components(table("documents"))


# Equal sets are one node; the closure is taken over nodes.
SQL["op13_jaccard_join"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[ 	-]+', ''), '[ 	-]+'), lambda x: x <> '') AS words
    FROM documents
), d AS (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
           ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END)) AS shingles FROM w
), m AS (SELECT doc_id, len(shingles) AS n, md5(array_to_string(shingles, chr(10))) AS node, shingles FROM d),
k AS (SELECT node, any_value(n) AS n, any_value(shingles) AS shingles, min(doc_id) AS least FROM m WHERE n > 0 GROUP BY node),
g AS (SELECT node, n, unnest(shingles) AS gram FROM k),
l AS (
    SELECT a.node AS a, b.node AS b FROM g a JOIN g b ON a.gram = b.gram AND a.node <> b.node GROUP BY a.node, b.node, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
    SELECT node AS a, node AS b FROM k
    UNION
    SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
), c AS (SELECT r.a AS node, min(k.least) AS component_id FROM reach r JOIN k ON k.node = r.b GROUP BY r.a)
SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM m LEFT JOIN c USING (node)
"""
