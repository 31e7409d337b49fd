"""Maximal marginal relevance re-ranking (Carbonell & Goldstein, 1998).

The pool of ``fetch_k`` hits per query comes from the exact top-k job; the
greedy pick then runs per query in ``applyInPandas``. Each group holds only
``fetch_k`` rows, so groups are tiny and run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.knn import SCORE_DECIMALS as ROUND
from tessera.operators.knn import similarity_topk
from tessera.session import materialize


def mmr_order(ids: np.ndarray, rel: np.ndarray, vecs: np.ndarray, k: int,
              lambda_mult: float) -> list[int]:
    """Greedy MMR: first the most relevant row, then repeatedly
    argmax lambda*rel - (1-lambda)*max sim to the chosen rows; ties to the
    smallest id. Similarities and scores are rounded to 12 decimals so that
    last-bit noise of the matrix product cannot break a tie. Returns row
    positions in pick order."""
    n = len(ids)
    if n == 0:
        return []
    norms = np.linalg.norm(vecs, axis=1)
    norms[norms == 0] = np.inf
    unit = vecs / norms[:, None]
    sims = np.round(unit @ unit.T, ROUND)
    chosen: list[int] = []
    max_sim = np.full(n, -np.inf)
    taken = np.zeros(n, dtype=bool)
    for step in range(min(k, n)):
        if step == 0:
            score = rel.astype(np.float64).copy()
        else:
            score = np.round(lambda_mult * rel - (1.0 - lambda_mult) * max_sim, ROUND)
        score = np.where(taken, -np.inf, score)
        best = np.max(score)
        cand = np.flatnonzero(score == best)
        pick = int(cand[np.argmin(ids[cand])])
        chosen.append(pick)
        taken[pick] = True
        max_sim = np.maximum(max_sim, sims[:, pick])
    return chosen


def mmr_rerank(queries: DataFrame, corpus: DataFrame, k: int = 10, fetch_k: int = 20,
               lambda_mult: float = 0.5, *, query_id: str = "query_id",
               query_vec: str = "vector", doc_id: str = "id", doc_vec: str = "vector",
               match_cols: tuple[str, ...] = (), exclude_self: bool = False) -> DataFrame:
    """Returns ``(query_id, rank, doc_id, score)``: the MMR pick order, with
    ``score`` the similarity to the query."""
    if fetch_k < k:
        raise ValueError("fetch_k must be >= k")
    pool = similarity_topk(queries, corpus, k=fetch_k, query_id=query_id, query_vec=query_vec,
                           doc_id=doc_id, doc_vec=doc_vec, match_cols=match_cols,
                           exclude_self=exclude_self)
    pool = materialize(pool, "mmr-pool")  # read twice
    # vectors of pool members only: the corpus is filtered by the pool's ids
    # (a semi join, broadcast by adaptive execution where the ids turn out few)
    # instead of shuffling every corpus vector into a join
    ids = pool.select(doc_id).distinct()
    vecs = corpus.select(doc_id, doc_vec).join(ids, doc_id, "left_semi")
    pool = pool.join(vecs, doc_id)
    qtype = pool.schema[query_id].dataType
    dtype = pool.schema[doc_id].dataType
    schema = T.StructType([T.StructField(query_id, qtype), T.StructField("rank", T.IntegerType()),
                           T.StructField(doc_id, dtype), T.StructField("score", T.DoubleType())])

    def per_query(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf[doc_id].to_numpy()
        rel = pdf["score"].to_numpy(dtype=np.float64)
        vecs = np.vstack([np.asarray(v, dtype=np.float64) for v in pdf[doc_vec].values])
        order = mmr_order(ids, rel, vecs, k, lambda_mult)
        return pd.DataFrame({query_id: pdf[query_id].iloc[order].to_numpy(),
                             "rank": np.arange(1, len(order) + 1, dtype=np.int32),
                             doc_id: ids[order], "score": rel[order]})

    return pool.groupBy(query_id).applyInPandas(per_query, schema)
