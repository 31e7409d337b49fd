"""Vector retrieval queries over the ``embeddings`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.knn import similarity_topk
from tessera.operators.mmr import mmr_rerank
from tessera.plans.registry import register
from tessera.sources.tables import read_table

_VEC_SQL = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_COS_SQL = ("list_dot_product(q.e, d.e) / (sqrt(list_dot_product(q.e, q.e)) * "
            "sqrt(list_dot_product(d.e, d.e)))")


@register("knn_topk", sql=f"""
WITH {_VEC_SQL},
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, {_COS_SQL} AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) + 0.0 AS score
FROM r WHERE rank <= 10
""")
def knn_topk(spark, sf_dir):
    """k-nearest-neighbour graph: every vector queries the whole index."""
    emb = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    hits = similarity_topk(emb.withColumnRenamed("vec_id", "query_id"), emb, k=10,
                           query_id="query_id", query_vec="embedding",
                           doc_id="vec_id", doc_vec="embedding", exclude_self=True)
    return hits.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@register("knn_filtered", sql=f"""
WITH {_VEC_SQL},
s AS (SELECT q.vec_id AS query_id, q.label AS label, d.vec_id AS vec_id, {_COS_SQL} AS score
      FROM v q JOIN v d ON q.label = d.label AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s)
SELECT query_id, label, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) + 0.0 AS score
FROM r WHERE rank <= 10
""")
def knn_filtered(spark, sf_dir):
    """Filtered search: each query carries a metadata equality filter (label),
    applied before the top-k (F4, B3)."""
    emb = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    qs = emb.withColumnRenamed("vec_id", "query_id")
    hits = similarity_topk(qs, emb, k=10, query_id="query_id", query_vec="embedding",
                           doc_id="vec_id", doc_vec="embedding",
                           match_cols=("label",), exclude_self=True)
    return (hits.join(qs.select("query_id", "label"), "query_id")
            .select("query_id", "label", "rank", "vec_id", F.round("score", 6).alias("score")))


@register("knn_mmr", sql=f"""
WITH RECURSIVE {_VEC_SQL},
s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc, round({_COS_SQL}, 12) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS r FROM s)
         WHERE r <= 20),
ps AS (SELECT a.query_id, a.doc AS a, b.doc AS b,
              round(list_dot_product(q.e, d.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(d.e, d.e))), 12)
                AS sim
       FROM pool a JOIN pool b ON a.query_id = b.query_id JOIN v q ON q.vec_id = a.doc JOIN v d ON d.vec_id = b.doc),
mmr(query_id, step, chosen) AS (
  SELECT query_id, 1, [doc] FROM pool WHERE r = 1
  UNION ALL
  SELECT query_id, step + 1, list_append(chosen, doc) FROM (
    SELECT c.*, row_number() OVER (PARTITION BY c.query_id ORDER BY c.mmr DESC, c.doc) AS pick FROM (
      SELECT m.query_id, m.step, m.chosen, p.doc,
             round(0.5 * p.score - 0.5 * max(ps.sim), 12) AS mmr
      FROM mmr m
      JOIN pool p ON p.query_id = m.query_id AND NOT list_contains(m.chosen, p.doc)
      JOIN ps ON ps.query_id = m.query_id AND ps.a = p.doc AND list_contains(m.chosen, ps.b)
      WHERE m.step < 10
      GROUP BY m.query_id, m.step, m.chosen, p.doc, p.score) c) x
  WHERE pick = 1),
fin AS (SELECT query_id, chosen FROM mmr WHERE step = 10)
SELECT f.query_id, CAST(u.rank AS INTEGER) AS rank, u.vec_id, round(p.score, 6) + 0.0 AS score
FROM fin f, LATERAL (SELECT unnest(f.chosen) AS vec_id, generate_subscripts(f.chosen, 1) AS rank) u
JOIN pool p ON p.query_id = f.query_id AND p.doc = u.vec_id
""")
def knn_mmr(spark, sf_dir):
    """MMR re-ranking of a fetch_k=20 pool down to k=10, lambda 0.5."""
    emb = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    qs = emb.withColumnRenamed("vec_id", "query_id")
    out = mmr_rerank(qs, emb, k=10, fetch_k=20, lambda_mult=0.5,
                     query_id="query_id", query_vec="embedding",
                     doc_id="vec_id", doc_vec="embedding", exclude_self=True)
    return out.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))
