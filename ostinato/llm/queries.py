"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ostinato.llm import cross_tokenizer, decontaminate, embedding_dedup, langid, licenses, line_dedup, quality, sentencepieces, setsketch_dedup, sharding, token_counts, toxicity, whitening
from ostinato.llm.common import fold, stored, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    out = toxicity.score(documents, model)
    return out.select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        "predicted",
        F.size("offending").cast("long").alias("n_offending"),
        "offending",
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = quality.score(documents, quality.fit(documents, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(table(spark, sf_dir, "documents")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = langid.identify(documents, langid.fit(documents))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_and_check(table(spark, sf_dir, "documents"))


def op9_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    model = whitening.fit(embeddings)
    explained = F.array(*(F.lit(float(v / model.trace)) for v in model.values))
    out = whitening.transform(embeddings, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return out.select(
        "vec_id",
        (F.col("k") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"),
        "whitened",
        explained[F.col("k")].cast("double").alias("explained"),
        F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    aligned = cross_tokenizer.align(table(spark, sf_dir, "documents"))
    aligned = stored(aligned.withColumn("groups_sha256", sha).drop("groups"))
    return cross_tokenizer.score_links(aligned)


def whitening_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integer part of the whitening, which SQL can check."""
    embeddings = table(spark, sf_dir, "embeddings")
    model = whitening.fit(embeddings, components=0)
    out = whitening.transform(embeddings, model)
    return out.select("vec_id", F.lit(model.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the base phrases alone, which SQL can check."""
    return op2_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_license_scan": op2_license_scan,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_sentencepieces": op8_sentencepieces,
    "op9_setsketch_near_dedup": op9_setsketch_near_dedup,
    "op10_sharding": op10_sharding,
    "op11_line_dedup": op11_line_dedup,
    "op12_whitening": op12_whitening,
    "op13_cross_tokenizer": op13_cross_tokenizer,
    "license_base": license_base,
    "whitening_base": whitening_base,
}

#: Components by the smallest label that travels along links; every path from a component's smallest id
#: leads over larger ids only, so labels needn't go to smaller ones.
_REACHED = """e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(node, c) AS (SELECT id, id FROM ids UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node AND r.c < e.b),
    m AS (SELECT node, min(c) AS component_id FROM r GROUP BY 1)"""
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "license_base": f"""WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    b(label, p) AS (VALUES ('mit', ['under', 'the', 'mit', 'license']), ('apache-2', ['apache', 'license', 'version', '2']), ('cc-by-nc', ['cc', 'by', 'nc'])),
    i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
    f AS (SELECT doc_id, i - 1 AS place, label FROM i JOIN b ON w[i] = p[1] AND list_slice(w, i, i + len(p) - 1) = p),
    n AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM f GROUP BY 1)
    SELECT w.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM w LEFT JOIN n USING (doc_id)""",
    "op3_embedding_near_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
    u AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    l AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id < b.id WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
    ids AS (SELECT id FROM v), {_REACHED},
    d AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
    SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM ids JOIN m ON m.node = id LEFT JOIN d ON d.a = id""",
    "op11_line_dedup": f"""WITH l AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    i AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM l),
    k AS (SELECT *, {_LOWER.replace("coalesce(text, '')", "trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM i),
    f AS (SELECT k, max(doc_id) AS owner FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3),
    d AS (SELECT k.*, owner IS NOT NULL AND owner IS DISTINCT FROM doc_id AS gone FROM k LEFT JOIN f USING (k))
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM d GROUP BY r""",
    "whitening_base": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT + 100000) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    e AS (SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) AS d FROM v), s AS (SELECT d, sum(x) AS s, count(*) AS n FROM e GROUP BY 1)
    SELECT vec_id, any_value(n) AS n, sum((n * x - s) * (n * x - s))::BIGINT AS deviation FROM e JOIN s USING (d) GROUP BY 1""",
    "op9_setsketch_near_dedup": f"""WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
    g AS (SELECT id, len(s) AS n, unnest(s) AS g FROM s),
    p AS (SELECT x.id AS a, y.id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
    ids AS (SELECT id FROM w), {_REACHED}
    SELECT s.id AS doc_id, len(s) AS n_shingles, component_id, s.id = component_id AS kept FROM s JOIN m ON m.node = s.id""",
}
