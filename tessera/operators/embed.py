"""Text embedding for the index.

Built-in embedder: signed feature hashing of tokens (Weinberger et al.,
2009) with tf-idf weights, L2-normalised, written entirely as column
expressions. Other models plug in through ``PandasEmbedder`` (any object
with ``embed(pd.Series) -> pd.Series`` of vectors), run with ``mapInPandas``
so each Python worker loads its model once and scores Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import materialize

TOKEN_PATTERN = "[\\p{L}\\p{N}]+"  # fixed value: a token is a run of letters/digits


def tokens(text) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), 0)


def _bucket(tok: Column, dim: int) -> Column:
    return (F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("long") % dim).cast("int")


def _sign(tok: Column) -> Column:
    odd = F.conv(F.substring(F.md5(tok), 9, 1), 16, 10).cast("int") % 2 == 1
    return F.when(odd, F.lit(-1.0)).otherwise(F.lit(1.0))


def term_counts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tok, tf): one row per distinct token of a text; map-side
    partial counts keep repeated tokens of a text from being shuffled."""
    return (df.select(id_col, F.explode(tokens(text_col)).alias("tok"))
            .groupBy(id_col, "tok").agg(F.count(F.lit(1)).alias("tf")))


@dataclass
class IdfModel:
    """Document frequencies of a corpus: ``df`` is (tok, df, bucket, sign); ``n_docs`` a
    scalar-subquery column (the number of texts with at least one token)."""
    df: DataFrame
    n_docs: Column
    dim: int

    def unpersist(self) -> None:
        self.df.unpersist()

    def _weighed(self, terms: DataFrame, id_col: str) -> DataFrame:
        """(id, bv): normalised (bucket, value) pairs of each text with a token."""
        j = terms.join(self.df, "tok", "left")
        # buckets and signs were hashed once per corpus token; tokens unseen in
        # the corpus (queries) are hashed here
        bucket = F.coalesce(F.col("bucket"), _bucket(F.col("tok"), self.dim))
        sign = F.coalesce(F.col("sign"), _sign(F.col("tok")))
        w = j.select(id_col, bucket.alias("bucket"),
                     (sign * F.col("tf") *
                      (F.log((F.lit(1) + self.n_docs) / (F.lit(1) + F.coalesce(F.col("df"), F.lit(0)))) + 1))
                     .alias("w"))
        per_bucket = w.groupBy(id_col, "bucket").agg(F.sum("w").alias("v"))
        per_doc = per_bucket.groupBy(id_col).agg(F.collect_list(F.struct("bucket", "v")).alias("bv"))
        norm = F.sqrt(F.aggregate(F.col("bv"), F.lit(0.0), lambda acc, x: acc + x["v"] * x["v"]))
        return per_doc.withColumn("norm", norm).filter(F.col("norm") > 0).select(id_col, F.transform(
            "bv", lambda x: F.struct(x["bucket"].alias("bucket"), (x["v"] / F.col("norm")).alias("value"))).alias("bv"))

    def transform_terms_sparse(self, terms: DataFrame, id_col: str) -> DataFrame:
        """(id, bucket, value) from the term counts (id, tok, tf) of texts."""
        return self._weighed(terms, id_col).select(id_col, F.explode("bv").alias("e")).select(
            id_col, "e.bucket", "e.value")

    def transform_terms(self, terms: DataFrame, id_col: str, out_col: str = "vector") -> DataFrame:
        """(id, vector): dense normalised vectors of length ``dim``, from the
        term counts (id, tok, tf) of texts."""
        def dense(m):  # a lambda variable is evaluated once, not for each place
            return F.transform(F.sequence(F.lit(0), F.lit(self.dim - 1)),
                               lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0)))
        found = F.get(F.transform(F.array(F.map_from_entries("bv")), dense), F.lit(0))
        return self._weighed(terms, id_col).select(id_col, found.alias(out_col))

    def transform_sparse(self, data: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, bucket, value): normalised signed buckets that hold a token."""
        return self.transform_terms_sparse(term_counts(data, id_col, text_col), id_col)

    def transform(self, data: DataFrame, id_col: str, text_col: str, out_col: str = "vector") -> DataFrame:
        """(id, vector): dense normalised vectors of length ``dim``."""
        return self.transform_terms(term_counts(data, id_col, text_col), id_col, out_col)


class HashingEmbedder:
    """Signed hashing of tokens into ``dim`` buckets, tf-idf weighted."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    @property
    def name(self) -> str:
        return f"hash-{self.dim}"

    def model(self, frequencies: DataFrame, n_docs: Column) -> IdfModel:
        """Model of document frequencies (tok, df) that are known already."""
        df = frequencies.withColumn("bucket", _bucket(F.col("tok"), self.dim)).withColumn("sign", _sign(F.col("tok")))
        return IdfModel(df, n_docs, self.dim)

    def fit_terms(self, terms: DataFrame, id_col: str) -> IdfModel:
        """Model of the term counts (id, tok, tf) of a corpus. Pass a written
        table: it is read for the frequencies and for the number of texts, and not
        again. The frequencies are written, so that a join knows their size beforehand:
        those of a vocabulary that can be broadcast spare the shuffle of all terms."""
        texts = materialize(terms.select(F.count_distinct(id_col).alias("n")), "texts")
        m = self.model(terms.groupBy("tok").agg(F.count(F.lit(1)).alias("df")), texts.scalar())
        return IdfModel(materialize(m.df, "frequencies"), m.n_docs, m.dim)

    def fit(self, corpus: DataFrame, id_col: str, text_col: str, cache: bool = True) -> IdfModel:
        m = self.fit_terms(term_counts(corpus, id_col, text_col), id_col)
        # the fitted table is used by every transform: kept like a model
        # (``IdfModel.unpersist`` releases it)
        return IdfModel(m.df.persist(), m.n_docs, m.dim) if cache else m


class PandasEmbedder:
    """Plug-in point for any embedding model (K2): ``model_factory()`` is
    called once per Python worker; ``embed(texts: pd.Series) -> pd.Series``
    returns one vector per text."""

    def __init__(self, name: str, model_factory, dim: int):
        self.name, self.model_factory, self.dim = name, model_factory, dim

    def transform(self, data: DataFrame, id_col: str, text_col: str, out_col: str = "vector") -> DataFrame:
        factory = self.model_factory
        id_type = data.schema[id_col].dataType
        schema = T.StructType([T.StructField(id_col, id_type),
                               T.StructField(out_col, T.ArrayType(T.DoubleType()))])

        def run(batches):
            model = factory()
            for pdf in batches:
                vecs = model.embed(pdf[text_col])
                yield pd.DataFrame({id_col: pdf[id_col], out_col: list(vecs)})

        return data.select(id_col, text_col).mapInPandas(run, schema)


# Built-in model names.
BUILTIN_MODELS = {f"hash-{d}": d for d in (32, 64, 128)}


def make_embedder(name: str):
    """Embedder by name; one instance per name is enough (stateless)."""
    if name in BUILTIN_MODELS:
        return HashingEmbedder(BUILTIN_MODELS[name])
    raise ValueError(f"unknown embedding model {name!r}; register a PandasEmbedder for it")
