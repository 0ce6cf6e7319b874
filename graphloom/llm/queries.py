"""The queries of the numbered operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.llm import centroids, fingerprints, near_duplicates, neighbours, packing, personal_data, prefix_trie, quality, sentencepiece_scan, token_files, toxicity, training, url_filter, warc
from graphloom.session import table

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def put(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return put


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; the vocabularies are not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_neighbours")
def op1_neighbours(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op6_sentencepiece")
def op6_sentencepiece(spark, sf_dir):
    """Encodes every whole text and decodes the ids again."""
    model = tokenizer_file("piece_bpe_32k.model")
    return sentencepiece_scan.digest(sentencepiece_scan.encode(table(spark, sf_dir, "documents"), model), model)


@query("op7_ngram_jaccard")
def op7_ngram_jaccard(spark, sf_dir):
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_personal_data")
def op4_personal_data(spark, sf_dir):
    """Counts of kinds are of base spans; `spans` (and n_spans) also have what the method adds, behind them."""
    rows = personal_data.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id",
        *(count(k) for k in personal_data.KINDS),
        F.sha2(personal_data.as_text(F.col("base")), 256).alias("base_sha256"),
        personal_data.as_text(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


@query("op8_token_files")
def op8_token_files(spark, sf_dir):
    folder = token_files.token_files_folder(spark)
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 0, folder)
    return token_files.read_token_files(manifest, folder, keep_ids=False)


@query("op9_fingerprints")
def op9_fingerprints(spark, sf_dir):
    return fingerprints.edited(table(spark, sf_dir, "documents"))


@query("op10_packing")
def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), 1)


def _scored(rows, folds: int, held: int):
    held_out = F.coalesce(training.fold("doc_id", folds) == held, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_model(spark, docs, labels):
    """Learns from rows whose crc32 of the id, modulo 5, is not 0."""
    return toxicity.train(training.labelled_sample(docs, labels, "toxic", training.fold("_id", 5) != 0, toxicity.ROWS))


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _scored(toxicity.score(docs, toxicity_model(spark, docs, table(spark, sf_dir, "labels"))), 5, 0)


#: (verdict, host, path)
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query("op3_url_filter")
def op3_url_filter(spark, sf_dir):
    labelled = spark.createDataFrame(url_filter.labelled_urls(), "url string, label int")
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, url_filter.train(labelled))


def quality_model(spark, docs, labels):
    """Learns from rows whose crc32 of the id, modulo 3, is not 1."""
    return quality.train(training.labelled_sample(docs, labels, "quality", training.fold("_id", 3) != 1, quality.ROWS))


@query("op5_quality")
def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return _scored(quality.score(docs, quality_model(spark, docs, table(spark, sf_dir, "labels"))), 3, 1)


@query(
    "op11_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages), q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
    SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to, true AS intact FROM q
    """,
)
def op11_warc(spark, sf_dir):
    """Also `intact`: whether the payload that was read has the digest that its record states."""
    folder = warc.archives_folder(spark)
    archives = warc.write_archives(warc.chunk_table(table(spark, sf_dir, "pages"), "page_id", "url", "html"), folder)
    return warc.pages_of(warc.read_archives(archives, folder, keep_data=False)).withColumnRenamed("id", "page_id")


def _centroids_sql(rounds: int = 10) -> str:
    """The rounds one after the other; every sum is a whole number."""
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM v ORDER BY h LIMIT 8))",
    ]
    for i in range(rounds + 1):
        apart = f"SELECT vec_id, v.v, c, list_sum(list_transform(list_zip(v.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{i}"
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, v, CAST(d AS BIGINT) AS distance, c FROM ({apart}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if i < rounds:
            means = f"SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY c, i"
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM ({means}) GROUP BY c) m USING (c))")
    return f"""WITH {", ".join(steps)} SELECT vec_id, CAST(c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""


@query("op13_centroids", _centroids_sql())
def op13_centroids(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


#: crc32 of a text of ASCII characters `x`, before the last complement.
_CRC = """list_reduce(list_prepend(4294967295, list_transform(range(1, CAST(strlen(x) AS BIGINT) + 1), lambda i: CAST(ord(x[i]) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(0, 8)), lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END))"""


@query(
    "op12_prefix_trie",
    rf"""
    WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT c, CAST(c AS VARCHAR) AS x, list({{'role': role, 'text': text}} ORDER BY pos) AS turns FROM t GROUP BY c),
    h AS (SELECT c, turns, xor({_CRC}, 4294967295) % 4 AS h FROM own),
    r AS (SELECT h.c, list_concat(coalesce(own.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN own ON own.c = h.c - h.c % 20),
    m AS (SELECT c, d, turns[1:d] AS key, len(turns) AS size FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
    n AS (SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE size = d), '')) AS ends_sha256 FROM m GROUP BY key, d),
    e AS (SELECT n.*, p.conv_id AS parent_conv_id, CASE WHEN n.d > 0 THEN (n.n_convs - 1) * len(regexp_extract_all(n.key[n.d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS own FROM n LEFT JOIN n p ON p.d = n.d - 1 AND p.key = n.key[1:n.d - 1]),
    k AS (SELECT key[1:d - 1] AS key, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
    f AS (SELECT e.*, coalesce(k.n_children, 0) AS n_children FROM e LEFT JOIN k ON k.key = e.key AND k.d = e.d),
    u AS (SELECT key[1:i] AS key, i AS d, sum(own) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT key, own, n_children, unnest(range(0, d + 1)) AS i FROM f) GROUP BY 1, 2)
    SELECT f.conv_id, f.d AS depth, f.parent_conv_id, f.n_convs, f.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256 FROM f JOIN u ON u.key = f.key AND u.d = f.d
    """,
)
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.build(table(spark, sf_dir, "conversations"))
