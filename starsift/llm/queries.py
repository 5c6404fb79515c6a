"""The queries of the pipeline operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starsift.llm import audio, bpe, chat, embeddings, html, lloyd, mixing, order_minhash, periodic, quality, secrets, suffix_dedup, toxicity
from starsift.storage import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = toxicity.score(docs, toxicity.fit(docs, labels.filter(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = written(audio.store(table(spark, sf_dir, "documents")), "media", "zstd")
    return audio.digests(written(audio.described(media), "tensors", "zstd"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_chat_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"  # a fixed conversation of control strings
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_turns(rows))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_texts", "kept")


def op9_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan_paths(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


#: Of op11: centroids, rounds, components, and what a component is multiplied by.
CENTROIDS, ROUNDS, DIMS, SCALE = 40, 5, 64, 256


def op11_sharded_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    rows, centroids = lloyd.cluster(table(spark, sf_dir, "embeddings"), start, CENTROIDS, ROUNDS, DIMS, SCALE)
    rows = written(rows, "clustered")
    own = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256")
    own = own.join(centroids.select("cluster", digest), "cluster").crossJoin(rows.agg(F.sum("distance").alias("inertia")))  # one row
    return rows.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row for each of CENTROIDS


def _op11_sql() -> str:
    """The rounds written out one after the other; floor(sum / count) by the remainder, as // cuts towards zero."""
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT r, d, CAST(floor({SCALE} * CAST(embedding[d] AS DOUBLE)) AS BIGINT) AS v FROM kept, range(1, {DIMS + 1}) AS dims(d))",
        f"first AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id), embedding) - 1 AS c FROM kept QUALIFY c < {CENTROIDS})",
        "c0 AS MATERIALIZED (SELECT c, d, v FROM first JOIN x USING (r))",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, c, dist FROM (SELECT r, c, CAST(sum((x.v - c{k}.v) * (x.v - c{k}.v)) AS BIGINT) AS dist FROM x JOIN c{k} USING (d) GROUP BY r, c) QUALIFY row_number() OVER (PARTITION BY r ORDER BY dist, c) = 1)")
        if k < ROUNDS:
            steps.append(f"s{k} AS (SELECT c, d, sum(v) AS s, count(*) AS n FROM a{k} JOIN x USING (r) GROUP BY c, d)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT o.c, o.d, CAST(CASE WHEN n IS NULL THEN o.v ELSE (s - ((s % n) + n) % n) // n END AS BIGINT) AS v FROM c{k} o LEFT JOIN s{k} USING (c, d))")
    steps.append(f"digests AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)")
    return (
        f"WITH {', '.join(steps)} SELECT vec_id, CAST(c AS INTEGER) AS cluster, dist AS distance, CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, "
        f"CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{ROUNDS} JOIN kept USING (r) JOIN digests USING (c)"
    )


def op12_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # One document in ten gets a periodic tail: its words from number a on repeat the first p of them.
    docs = docs.withColumn("words", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(periodic.WORD), F.lit(0)))
    docs = docs.withColumn("n", F.size("words")).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    docs = docs.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.expr("cast(if(n > 0, g % n, 0) as int)"))
    docs = docs.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    planted = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), F.lit(1), F.col("n")), " ")
    docs = docs.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), planted).otherwise(F.col("text")).alias("text"))
    best = periodic.strongest()
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = periodic.periodic_runs(docs).withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_host_paths": op2_host_paths,
        "op3_importance_resampling": op3_importance_resampling,
        "op4_audio_features": op4_audio_features,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_cross_polytope": op6_cross_polytope,
        "op7_chat_grammar": op7_chat_grammar,
        "op8_order_minhash": op8_order_minhash,
        "op9_source_schedule": op9_source_schedule,
        "op10_secret_ledger": op10_secret_ledger,
        "op11_sharded_lloyd": op11_sharded_lloyd,
        "op12_suffix_merge": op12_suffix_merge,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_sharded_lloyd": _op11_sql()}
