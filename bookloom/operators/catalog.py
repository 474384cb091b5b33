"""Catalog work: counts, reports, status, versions, metadata patches, deletes, run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bookloom import settings as S
from bookloom.session import ranked


def _count(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def _zero(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def corpus_counts(documents: DataFrame, chunks: DataFrame, images: DataFrame) -> DataFrame:
    """Documents, chunks and images per corpus."""
    out = (
        _count(documents, "corpus", "doc_count")
        .join(_count(chunks, "corpus", "chunk_count"), "corpus", "left")
        .join(_count(images, "corpus", "image_count"), "corpus", "left")
    )
    return _zero(out, ["chunk_count", "image_count"])


def corpus_summary(documents: DataFrame, chunks: DataFrame, images: DataFrame, entity_counts: DataFrame) -> DataFrame:
    out = corpus_counts(documents, chunks, images).join(entity_counts, "corpus", "left")
    return _zero(out, ["entity_count"]).orderBy(F.lower("corpus"), "corpus")


def missing_vaults(documents: DataFrame, vaults: DataFrame) -> DataFrame:
    """Corpora that no vault row names."""
    return documents.select(F.col("corpus").alias("name")).distinct().join(vaults.select("name"), "name", "left_anti")


def self_heal(vaults: DataFrame, documents: DataFrame) -> DataFrame:
    return vaults.select("name").unionByName(missing_vaults(documents, vaults))


def document_report(documents: DataFrame, chunks: DataFrame, images: DataFrame, job_errors: DataFrame | None = None) -> DataFrame:
    """Documents with counts and a status: ``error``, ``indexed`` or ``pending``.

    ``job_errors(doc_id)`` lists documents their job failed on.
    """
    out = documents.join(_count(chunks, "doc_id", "chunk_count"), "doc_id", "left").join(
        _count(images, "doc_id", "image_count"), "doc_id", "left"
    )
    out = _zero(out, ["chunk_count", "image_count"])
    failed = F.lit(False)
    if job_errors is not None:
        out = out.join(job_errors.select("doc_id").distinct().withColumn("_failed", F.lit(True)), "doc_id", "left")
        failed = F.coalesce("_failed", F.lit(False))
    held = F.when(F.col("format") == "image", F.col("image_count")).otherwise(F.col("chunk_count"))
    return out.withColumn(
        "status", F.when(failed, "error").when(held > 0, "indexed").otherwise("pending")
    ).drop("_failed")


def recent_documents(documents: DataFrame, chunks: DataFrame, images: DataFrame, n: int = 12) -> DataFrame:
    """The ``n`` newest documents with counts; the limit comes before the joins."""
    newest = documents.orderBy(F.desc("ingested_at"), F.desc("seq")).limit(n)
    return document_report(newest, chunks, images)


def document_chunks(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return chunks.join(doc_ids, "doc_id", "left_semi").select("doc_id", "chunk_index", "text", "tokens").orderBy("doc_id", "chunk_index")


def bump(versions: DataFrame, changed: DataFrame) -> DataFrame:
    """Append-only version log plus one row per changed corpus, one above its current version."""
    now = current_versions(versions)
    up = changed.select("corpus").distinct().join(now, "corpus", "left").select(
        "corpus", (F.coalesce("version", F.lit(0)) + 1).alias("version")
    )
    return versions.select("corpus", F.col("version").cast("int").alias("version")).unionByName(up)


def current_versions(versions: DataFrame, corpora: DataFrame | None = None) -> DataFrame:
    """Current version per corpus; 0 for a listed corpus never bumped."""
    now = versions.groupBy("corpus").agg(F.max("version").alias("version"))
    if corpora is None:
        return now
    return _zero(corpora.select("corpus").distinct().join(now, "corpus", "left"), ["version"])


def without_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table with a ``doc_id`` without the rows of deleted documents."""
    return {name: df.join(gone.select("doc_id"), "doc_id", "left_anti") for name, df in tables.items()}


def without_vaults(documents: DataFrame, tables: dict[str, DataFrame], vaults: DataFrame) -> dict[str, DataFrame]:
    """Cascade of deleted vaults: their documents and every child row."""
    gone = documents.join(vaults.select(F.col("name").alias("corpus")), "corpus", "left_semi").select("doc_id")
    return without_documents({"documents": documents, **tables}, gone)


def patch_metadata(documents: DataFrame, patch: DataFrame) -> DataFrame:
    """Tags, date and author replaced where the patch has a value."""
    p = patch.select("doc_id", *[F.col(c).alias(f"_{c}") for c in ("tags", "doc_date", "author")])
    out = documents.join(p, "doc_id", "left")
    for c in ("tags", "doc_date", "author"):
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.drop("_tags", "_doc_date", "_author")


def seed_questions(stored: DataFrame, defaults: DataFrame) -> DataFrame:
    """Golden questions with defaults added for corpora that have none."""
    return stored.unionByName(defaults.join(stored.select("corpus"), "corpus", "left_anti"))


def job_report(files: DataFrame) -> DataFrame:
    """``files(job_id, doc_id, done, error)``: progress, status and errors of each job.

    Errors are listed per failing file by :func:`job_errors`; here they are only counted.
    """
    out = files.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("done")).alias("done"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
    finished = F.col("done") + F.col("errors") >= F.col("files")
    return out.select(
        "job_id", "files", "errors",
        F.round(F.col("done") / F.col("files") * 100, 1).alias("progress"),
        F.when(~finished, "running").when(F.col("errors") == 0, "done").otherwise("failed").alias("status"),
    )


def job_errors(files: DataFrame) -> DataFrame:
    return files.filter(F.col("error").isNotNull()).select("job_id", "doc_id", "error")


def newest_runs(runs: DataFrame, by: str = "run_at", n: int = 10) -> DataFrame:
    """The ``n`` latest rows; equal times are ordered by the remaining columns."""
    return runs.orderBy(F.desc(by), F.xxhash64(*[c for c in runs.columns if c != by])).limit(n)


def last_run(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max("run_at").alias("last_run"))


def documents_since(documents: DataFrame, jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: documents of finished jobs created after the latest run, and that run's time."""
    done = jobs.filter("status = 'done'").select("job_id", F.col("created_at").alias("job_at"))
    last = last_run(runs)  # one row, beside every document
    held = documents.select("job_id").join(done, "job_id").crossJoin(F.broadcast(last))
    since = held.filter(F.col("last_run").isNull() | (F.col("job_at") > F.col("last_run"))).agg(F.count(F.lit(1)).alias("docs_since"))
    return since.crossJoin(F.broadcast(last))


def should_run(policy: Column, docs_since: Column, last_run_at: Column, now: Column, min_docs: Column | int = 3, hours: int = 24) -> Column:
    """Whether a reorganisation is due: ``batch`` always, ``nightly`` by time, else by count or time."""
    floor = F.lit(min_docs) if isinstance(min_docs, int) else min_docs
    waited = (now - last_run_at) >= F.make_dt_interval(hours=F.lit(hours))
    return (
        F.when(policy == "batch", True).when(last_run_at.isNull(), True)
        .when(policy == "nightly", waited).otherwise((docs_since >= floor) | waited)
    )


def suggested_questions(entities: DataFrame, total: int = 6, top: int = 6) -> DataFrame:
    """Starter questions per corpus from its best-connected entities: ``corpus, n, question``.

    ``entities(corpus, name, rnk)``.
    """
    named = entities.filter(F.col("rnk") <= top).select(
        "corpus", "rnk",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("tier"), F.concat(F.lit("What is "), "name", F.lit("?")).alias("question")),
                F.struct(F.lit(1).alias("tier"), F.concat(F.lit("How does "), "name", F.lit(" relate to the rest of this vault?")).alias("question")),
            )
        ).alias("q"),
    ).select("corpus", "q.tier", "rnk", "q.question")
    fixed = entities.select("corpus").distinct().select(
        "corpus", F.lit(2).alias("tier"),
        F.posexplode(
            F.array(F.lit("Summarize the key ideas in this vault."), F.lit("What are the main relationships between concepts here?"))
        ).alias("rnk", "question"),
    )
    w = Window.partitionBy("corpus").orderBy("tier", "rnk")
    return named.unionByName(fixed).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= total).select("corpus", "n", "question")


# ── usage, cost, latency ────────────────────────────────────────────────────────────────────────


def price_table(spark) -> DataFrame:
    return spark.createDataFrame([(m, i, o) for m, (i, o) in S.PRICES.items()], "model string, price_in double, price_out double")


def with_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``cost_usd`` from prompt and completion tokens; an unpriced model costs nothing."""
    p = usage.join(prices, "model", "left")
    cost = F.col("tokens_in") / 1e6 * F.coalesce("price_in", F.lit(0.0)) + F.col("tokens_out") / 1e6 * F.coalesce("price_out", F.lit(0.0))
    return p.withColumn("cost_usd", cost).drop("price_in", "price_out")


def order_statistics(rows: DataFrame, key: str, value: str, shares: dict[str, float | None]) -> DataFrame:
    """Index-style percentiles per key, exact and without gathering a key in one place.

    A share ``p`` picks element ``min(n - 1, floor(p * n))`` of the sorted values; ``None`` picks the
    middle one, ``n // 2``.
    """
    placed = ranked(rows.select(key, value), [key], [F.asc(value)])
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    at = {
        name: (F.floor(F.col("_n") / 2) if p is None else F.least(F.col("_n") - 1, F.floor(F.col("_n") * p))) + 1
        for name, p in shares.items()
    }
    return placed.join(n, key).groupBy(key).agg(
        F.max("_n").alias("n"),
        *[F.max(F.when(F.col("rnk") == pos, F.col(value))).alias(name) for name, pos in at.items()],
    )
