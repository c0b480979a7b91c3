"""The stored indexes of the given documents, built once for a session and a set of input files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuslens.functions.vectors import hashed
from corpuslens.operators import term_index, vector_index
from corpuslens.plans import views as V
from corpuslens.sources.sliced import Sliced, shared_folder

_BUILT: dict[tuple, Sliced] = {}


def _once(name: str, spark: SparkSession, sf_dir: str, make: Callable[[str], Sliced]) -> Sliced:
    known = (name, spark.sparkContext.applicationId, *sorted(V.table(spark, sf_dir, "documents").inputFiles()))
    if known not in _BUILT:
        _BUILT[known] = make(shared_folder(spark, name))
    return _BUILT[known]


def terms(spark: SparkSession, sf_dir: str) -> Sliced:
    d = V.document_v(spark, sf_dir).select("kb_id", "doc_id", "text", "domain")
    return _once("term-index", spark, sf_dir, lambda path: term_index.build(d, path, attributes=("domain",)))


def vectors(spark: SparkSession, sf_dir: str) -> Sliced:
    d = V.document_v(spark, sf_dir).select("kb_id", "doc_id", "text", "domain")
    return _once("vector-index", spark, sf_dir, lambda path: vector_index.build(hashed(d, "doc_id", keep=("kb_id", "domain")), path, "doc_id", "vector", "domain"))


def bm25(spark: SparkSession, sf_dir: str, queries: DataFrame, k: int) -> DataFrame:
    return term_index.search(terms(spark, sf_dir), queries, k)


def cosine(spark: SparkSession, sf_dir: str, queries: DataFrame, k: int) -> DataFrame:
    found = vector_index.search(vectors(spark, sf_dir), hashed(queries, "query_id", "query"), k, "doc_id")
    return found.select("query_id", "doc_id", "score", "rank")
