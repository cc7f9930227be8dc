"""The corpus queries: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(column):
    return F.sha2(F.coalesce(column, F.lit("")), 256)


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and the decoded bytes of every document, as digests."""
    import public_tokenizers

    from tidegauge.llm import byte_bpe

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = byte_bpe.encode_and_decode(docs, "text", ranks, public_tokenizers.PATTERN, keep=["doc_id"])
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in benchmark items."""
    from tidegauge.llm import decontaminate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.verdict(decontaminate.find(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


# Items as windows, document words numbered, every window looked up at every word.
ORACLES["op9_decontaminate"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, w, len(w) AS n FROM (
        SELECT doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents)
), b AS (
    SELECT item_id, w, len(w) AS n FROM (
        SELECT item_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark)
), win AS (
    SELECT item_id, least(n, 13) AS m, array_to_string(w[i:i + least(n, 13) - 1], ' ') AS t
    FROM (SELECT *, unnest(range(1, greatest(n - 13, 0) + 2)) AS i FROM b WHERE n > 0)
), place AS (
    SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS t
    FROM (SELECT r, w, n, unnest(range(1, n + 1)) AS i FROM d), (SELECT DISTINCT m FROM win)
    WHERE i + m - 1 <= n
), hit AS (
    SELECT r, i, m, item_id FROM place JOIN win USING (m, t)
), cover AS (
    SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT r, i, m FROM hit)) GROUP BY r
), items AS (
    SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= n AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)
"""


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    from tidegauge.llm import simhash

    found = simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", keep=["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learnt outside the held-out fold."""
    from tidegauge.llm import toxicity
    from tidegauge.llm.labelled import held_out

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, "doc_id", "text", table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, "text", model, keep=["doc_id"])
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"),
    )


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document when 200-byte repeats are cut out."""
    from tidegauge.llm import suffix_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    texts = suffix_dedup.per_text(docs, "text").select(
        "t1", "t2", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
    return suffix_dedup.keyed(docs, "text").select("doc_id", "t1", "t2").join(texts, ["t1", "t2"]).drop("t1", "t2")


@query
def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learnt outside the held-out fold."""
    from tidegauge.llm import quality_model
    from tidegauge.llm.labelled import held_out

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.learn(docs, "doc_id", "text", table(spark, sf_dir, "labels"))
    scored = quality_model.score(docs, "text", model, keep=["doc_id"])
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, base rule and certified rules of every document."""
    from tidegauge.llm import quality_rules

    found = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", table(spark, sf_dir, "labels"))
    return found.select("doc_id", *quality_rules.BASE, "base_failed", "kept", F.array_join("failed", ",").alias("failed_rules"))


@query
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and rule labels of every document."""
    from tidegauge.llm import licenses

    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    starts = F.transform("places", lambda p: p.start)
    base = F.transform("places", lambda p: p.label)
    labels = F.array_union(base, F.transform("detections", lambda d: d.label))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"), "score",
    )


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    from tidegauge.llm import warc
    from tidegauge.llm.rows import shared_folder

    chunks = warc.archived(table(spark, sf_dir, "pages"), "page_id", "url", "html", shared_folder(spark, "warc"))
    return chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    from tidegauge.llm import html_text

    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "html"), "html", keep=["page_id"])
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: x != "")).cast("long")
    return found.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), lines.alias("n_lines"))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every vector, with errors per vector and per label."""
    from tidegauge.llm import vector_codes

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vector_codes.learn(vectors, "vec_id", "embedding")
    coded = vector_codes.with_label_error(vector_codes.encode(vectors, "vec_id", "embedding", "label", books))
    return coded.select(
        F.col("id").alias("vec_id"), "code", "error", "label_error",
        F.sha2(F.lit(vector_codes.text_of(books)), 256).alias("codebooks_sha256"),
    )


@query
def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix by source weights takes."""
    from tidegauge.llm import source_mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = source_mix.expanded(source_mix.plan(docs, "doc_id", "text", "source"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every vector."""
    from tidegauge.llm import centroids

    found = centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    digest = F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest)


def _rounds_sql(start: str, rounds: int, keys: str, vectors: str) -> str:
    """Lloyd rounds as a chain of common table expressions: c0, a0, c1, a1, ...

    ``keys`` are the columns of a codebook (empty or ``q, ``), ``vectors`` has r, q, p, x.
    """
    steps = [f"c0 AS MATERIALIZED ({start})"]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
    SELECT r, {keys}c, d FROM (
        SELECT r, {keys}c, CAST(sum(({vectors}.x - c{i}.x) * ({vectors}.x - c{i}.x)) AS BIGINT) AS d
        FROM {vectors} JOIN c{i} USING ({keys}p) GROUP BY r, {keys}c)
    QUALIFY row_number() OVER (PARTITION BY r{", q" if keys else ""} ORDER BY d, c) = 1)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (
    SELECT {keys}c, p, coalesce(m, x) AS x FROM c{i} LEFT JOIN (
        SELECT {keys}c, p, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m
        FROM (SELECT {keys}c, p, sum(x) AS s, count(*) AS n FROM a{i} JOIN {vectors} USING ({keys}r) GROUP BY ALL))
    USING ({keys}c, p))""")
    return ",\n".join(steps)


def _vectors_sql(scale: int, where: str) -> str:
    return f"""v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, *, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings WHERE {where} len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


ORACLES["op11_vector_codes"] = f"""
WITH {_vectors_sql(4096, "len(embedding) > 0 AND")},
x AS MATERIALIZED (
    SELECT r, (i - 1) // (n // 8) AS q, (i - 1) % (n // 8) AS p, e[i] AS x
    FROM (SELECT r, e, len(e) AS n, unnest(range(1, len(e) + 1)) AS i FROM v)),
s AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS c FROM v QUALIFY c < 16),
{_rounds_sql("SELECT q, c, p, x FROM x JOIN s USING (r)", 6, "q, ", "x")},
coded AS (SELECT r, string_agg(format('{{:02x}}', c), '' ORDER BY q) AS code, CAST(sum(d) AS BIGINT) AS error FROM a6 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY q, c, p)) FROM c6) AS codebooks_sha256
FROM coded JOIN v USING (r)
"""

ORACLES["op13_centroids"] = f"""
WITH {_vectors_sql(256, "len(embedding) = 64 AND")},
x AS MATERIALIZED (SELECT r, p, e[p + 1] AS x FROM (SELECT r, e, unnest(range(64)) AS p FROM v)),
s AS MATERIALIZED (SELECT r, row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)) NULLS LAST, e) - 1 AS c FROM v QUALIFY c < 40),
{_rounds_sql("SELECT c, p, x FROM x JOIN s USING (r)", 5, "", "x")},
digest AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p)) AS centroid_sha256 FROM c5 GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS "cluster", d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a5 JOIN v USING (r) JOIN digest USING (c)
"""
