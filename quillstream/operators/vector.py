"""Semantic search: encoding of chunks, and the papers closest to a query vector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.text import chunks


def chunk_rows(texts: DataFrame, size: int = 400, overlap: int = 80) -> DataFrame:
    """chunk_id, pmid, chunk_index, chunk of texts (pmid, text); the index counts the chunks that are kept, from 0."""
    rows = texts.select("pmid", F.posexplode(chunks(F.col("text"), size, overlap)).alias("chunk_index", "chunk"))
    return rows.select(F.concat("pmid", F.lit("::chunk"), "chunk_index").alias("chunk_id"), "pmid", "chunk_index", "chunk")


#: Texts that an encoder gets at once.
BATCH = 256


def encode(rows: DataFrame, text: str, make: Callable[[], Callable[[list[str]], list[list[float]]]], size: int = BATCH) -> DataFrame:
    """``rows`` with ``embedding``: ``make`` loads a model once for each Python worker and returns its encoder, which gets at most ``size`` texts at once."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for b in batches:
            texts = b.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), size) for v in model(texts[i : i + size])], dtype=object)

    return rows.withColumn("embedding", F.pandas_udf(run, "array<float>")(F.col(text)))


def model_encoder(name: str, device: str | None = None) -> Callable[[], Callable[[list[str]], list[list[float]]]]:
    """A ``make`` for ``encode`` from a sentence model by name or path; without ``device`` the accelerator that the worker has, else the CPU.

    The library (``sentence_transformers``) is imported in the worker and only there.
    """

    def make() -> Callable[[list[str]], list[list[float]]]:
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(name, device=device or best_device())
        return lambda texts: model.encode(texts, batch_size=BATCH, show_progress_bar=False).tolist()

    return make


def best_device() -> str:
    """``cuda`` or ``mps`` if this process has it, else ``cpu``."""
    try:
        import torch
    except ImportError:
        return "cpu"
    if torch.cuda.is_available():
        return "cuda"
    mps = getattr(torch.backends, "mps", None)
    return "mps" if mps is not None and mps.is_available() else "cpu"


def hashed_encoder(dimensions: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic encoder of hashed words, for tests and where no model is at hand.

    Each word in lower case adds 1 or -1 to the dimension that its MD5 names; the sum has norm 1.
    """
    import hashlib

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dimensions
            for w in t.lower().split():
                h = int(hashlib.md5(w.encode(), usedforsecurity=False).hexdigest()[:8], 16)
                v[h % dimensions] += 1.0 if h // 65536 % 2 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return run


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of equal length in double precision; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def nearest_to_each(vectors: DataFrame, queries: DataFrame, nearest: int = 30, papers: int = 10, block: int = 1_024) -> DataFrame:
    """query_id, rank, pmid, score of the papers closest to each query vector (query_id, embeddings), as ``nearest_papers`` has them for one.

    The queries are sent out in blocks of ``block``, and every task keeps only its ``nearest`` chunks of each query, so that what is
    shuffled grows with tasks and queries, not with the vectors compared.
    """
    import numpy as np
    from pyspark.sql import Window

    spark = vectors.sparkSession
    ids, held, parts = [], [], []
    found = "query_id long, pmid string, vec_id long, c double"

    def unit(rows) -> np.ndarray:
        x = np.array(rows, dtype=np.float64)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def ask() -> None:
        sent = spark.sparkContext.broadcast((np.array(ids), unit(held)))

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q = sent.value
            best = None
            for b in batches:
                fit = [v is not None and len(v) == q.shape[1] and any(v) for v in b["embeddings"]]
                b = b[fit]
                if not len(b):
                    continue
                s = q @ unit(b["embeddings"].tolist()).T
                order = np.lexsort((np.broadcast_to(b["vec_id"].to_numpy(), s.shape), -s), axis=1)[:, :nearest]
                row = np.repeat(np.arange(len(q)), order.shape[1])
                now = pd.DataFrame({"query_id": names[row], "pmid": b["pmid"].to_numpy()[order.ravel()], "vec_id": b["vec_id"].to_numpy()[order.ravel()], "c": np.take_along_axis(s, order, 1).ravel()})
                now = now if best is None else pd.concat([best, now])
                best = now.sort_values(["query_id", "c", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(nearest)
            if best is not None:
                yield best

        parts.append(vectors.select("vec_id", "pmid", "embeddings").where("embeddings is not null").mapInPandas(compare, found))

    for r in queries.select("query_id", "embeddings").toLocalIterator():
        ids.append(r.query_id)
        held.append(list(r.embeddings))
        if len(ids) == block:
            ask()
            ids, held = [], []
    if ids:
        ask()
    every = parts[0] if parts else spark.createDataFrame([], found)
    for part in parts[1:]:
        every = every.unionAll(part)
    near = every.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("c"), "vec_id"))).where(F.col("n") <= nearest)
    best = near.groupBy("query_id", "pmid").agg(F.max(F.round("c", 4)).alias("score"), F.max("c").alias("_c"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("_c"), "pmid")).cast("long")
    return best.withColumn("rank", rank).where((F.col("rank") <= papers) & (F.col("score") > 0)).select("query_id", "rank", "pmid", "score")


def nearest_papers(vectors: DataFrame, query: list[float], nearest: int = 30, papers: int = 10) -> DataFrame:
    """pmid and score of the papers closest to a query vector.

    Of the ``nearest`` chunks the best score of each paper counts, rounded to four digits; at most ``papers``
    papers with a positive score, best first. Chunks whose vector has another length or no norm are left out;
    equal distances are ordered by vec_id.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    fit = vectors.where(F.size("embeddings") == len(query))
    scored = fit.select("pmid", "vec_id", cosine(F.col("embeddings"), q).alias("c")).where("c is not null")
    top = scored.orderBy(F.desc("c"), "vec_id").limit(nearest)
    best = top.groupBy("pmid").agg(F.max(F.round("c", 4)).alias("score"), F.max("c").alias("_c"))
    return best.orderBy(F.desc("score"), F.desc("_c"), "pmid").limit(papers).where("score > 0").select("pmid", "score")
