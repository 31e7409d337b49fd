"""Labelled code examples from code files (extractor plug-in, K3)."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import trim_ws

MIN_CODE_CHARS = 50  # fixed value: files with less stripped content are skipped

# Default extractor: a call with a description= keyword argument, e.g.
# ``Entity(name='user', description='A user')`` -> ("Entity", "A user").
_CALL_WITH_DESCRIPTION = "(\\w+)\\((?:[^()]|\\([^()]*\\))*?description\\s*=\\s*['\"]([^'\"]*)['\"]"


def default_declarations(code) -> F.Column:
    """array<array<string>> of (callable, description) pairs, JVM-side."""
    c = F.col(code) if isinstance(code, str) else code
    names = F.regexp_extract_all(c, F.lit(_CALL_WITH_DESCRIPTION), 1)
    descs = F.regexp_extract_all(c, F.lit(_CALL_WITH_DESCRIPTION), 2)
    return F.transform(F.arrays_zip(names.alias("n"), descs.alias("d")), lambda z: F.array(z["n"], z["d"]))


def extract_examples(files: DataFrame, extractor: Callable[[str], list] | None = None) -> DataFrame:
    """Files (path, content, directory_type) -> one row per declaration of
    at least two parts: text "Example of {name}. {description}", code, path,
    kind (B1, B5, C5, D2). A user ``extractor(code) -> [[name, desc], ...]``
    runs on Arrow batches; an extractor error yields no declarations."""
    f = files.filter(F.length(trim_ws("content")) >= MIN_CODE_CHARS)
    if extractor is None:
        decl = f.withColumn("decl", default_declarations("content"))
    else:
        schema = T.StructType(f.schema.fields + [T.StructField("decl", T.ArrayType(T.ArrayType(T.StringType())))])

        def run(batches):
            for pdf in batches:
                out = []
                for code in pdf["content"]:
                    try:
                        out.append([[str(x) for x in d] for d in extractor(code)])
                    except Exception:  # noqa: BLE001  (a failed file contributes nothing)
                        out.append([])
                yield pdf.assign(decl=out)
        decl = f.mapInPandas(run, schema)
    ex = decl.select("path", "content", "directory_type", F.posexplode("decl").alias("pos", "d")) \
        .filter(F.size("d") >= 2)
    return ex.select("path", "pos", F.concat(F.lit("Example of "), F.element_at("d", 1), F.lit(". "),
                                             F.element_at("d", 2)).alias("text"),
                     F.col("content").alias("code"), "directory_type")


def json_extractor(answer_of: Callable[[str], str]) -> Callable[[str], list]:
    """Wrap a text-in/JSON-out extractor: the answer is
    ``{"declarations": [[name, description], ...]}``."""
    def run(code: str) -> list:
        return json.loads(answer_of(code)).get("declarations", [])
    return run

