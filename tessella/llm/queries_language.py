"""Queries of language identification."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import read
from tessella.llm.language import document_evidence, fit_text_model, identify, page_evidence


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    found = identify(document_evidence(documents, F.col("doc_id")), fit_text_model(documents))
    return found.withColumnRenamed("key", "doc_id")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on pages, which have markup and addresses; the text model comes from the documents."""
    model = fit_text_model(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    return identify(page_evidence(pages), model).withColumnRenamed("key", "page_id")
