"""From raw documents to packed training sequences, in five stages of flowrisk.llm.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame that
is written as Parquet and read again for the next stage. All but the last return the columns of their input, other columns than those of documents included,
whatever they are called. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowrisk.llm import language, mixing, packing, secret_scan, simhash
from flowrisk.llm.common import table
from flowrisk.llm.queries import VOCABULARY
from flowrisk.session import materialize

LEAST_SCORE = 0.5  # of the language, for a text to stay in any case
LEAST_SURE = 0.5   # mean over words of the likeliest language's probability, for a text in several languages to stay


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _stage(work: Callable) -> Callable:
    """``work`` with all columns but COLUMNS under names that it cannot use itself."""
    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = {c: f"other_{i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
        return work(spark, docs.withColumnsRenamed(others), sf_dir).withColumnsRenamed({v: k for k, v in others.items()})

    return run


def _keys() -> dict[str, Column]:
    """Two hashes that tell rows with different ids or texts apart, nulls included."""
    return {"__k1": F.xxhash64("doc_id", "text"), "__k2": F.xxhash64(F.lit(2), "text", "doc_id")}


def _narrow(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.withColumns(_keys()).select(F.struct("doc_id", "__k1", "__k2").alias("__key"), "text", *columns)


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts whose words are in a known language each with LEAST_SURE in the mean, be it one language or several.

    A score of LEAST_SCORE implies as much; ``und`` goes, and with it null, empty and blank texts. Repeated rows stay repeated, ids and labels may be null.
    """
    model = language.fit(language.training_sample(docs, language.TEXTS_PER_LANGUAGE, "doc_id", "text", "lang"))
    told = language.identify(docs.select("*", F.lit(0).alias("__row")), model, sure_col="__sure")
    told = told.toDF(*docs.columns, "__row", "__lang", "__score", "__sure")
    return told.where((F.col("__lang") != "und") & ((F.col("__score") >= LEAST_SCORE) | (F.col("__sure") >= LEAST_SURE))).select(*docs.columns)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component: that with the smallest id.

    Null, empty and blank texts are one component, as they share the fingerprint zero. Of equal rows, and of rows with the same id and text, one stays. A null id
    counts as an id if the component has no other.
    """
    found = simhash.near_duplicates(_narrow(docs), id_col="__key")
    kept = found.select("component_id.__k1", "component_id.__k2").distinct()
    return docs.withColumns(_keys()).join(kept, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"]).select(*docs.columns)


@_stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets of every text; no document goes. Null texts stay null, empty ones empty, repeated rows repeated."""
    clean = secret_scan.redact(docs, secret_scan.fit(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat every document as often as the mix takes it, which may be never.

    Null, empty and blank texts have no words to take and go. Equal rows are taken together; a null source is a source, null ids are told apart by their texts.
    """
    taken = mixing.mix(_narrow(docs, "source"), id_col="__key").where("size > 0")
    copies = taken.groupBy("__key.__k1", "__key.__k2").agg(F.sum(F.expr("taken div size")).alias("__copies")).where("__copies > 0")
    rows = docs.withColumns(_keys()).dropDuplicates(["__k1", "__k2"]).join(copies, ["__k1", "__k2"])
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(*docs.columns)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack into sequences of 4096 tokens: one row per piece. Null and empty texts are an end alone, repeated rows are packed one by one."""
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Forward-backward, SimHash, a forest and tokenisation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
