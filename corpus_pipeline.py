"""The corpus pipeline: documents through five operators, each stage written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import fresh, new_dir, table
from postmill.llm.decontamination import decontaminate
from postmill.llm.language_id import identify_languages
from postmill.llm.mixing import mix_sources
from postmill.llm.neardup import near_duplicates
from postmill.llm.substring_dedup import dedup_substrings
from postmill.plans.session import ship


def apart(docs: DataFrame, *added: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with other names for the columns that an operator would replace, and what selects them all as they were."""
    names = {c: fresh(f"_own_{c}", docs) for c in docs.columns if c.lower() in added}
    return docs.withColumnsRenamed(names), [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without letters go, null texts too.

    The columns stay as they are, whatever their names; repeated rows are judged alike; an empty table stays empty.
    """
    docs, own = apart(docs, "lang_pred", "score")
    return identify_languages(docs).where("lang_pred <> 'und'").select(*own)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near-duplicates: five-word shingles, a similarity of 0.8.

    SimHash with pivot tables links first, each link verified by the similarity; an exact set join finds the rest.
    Documents of a null id stay. Rows that repeat an id are one document, which stays or goes. Columns may have any name; an empty table stays empty.
    """
    name = fresh("_gone", docs)
    gone = near_duplicates(docs).where("component_id <> doc_id").select(F.col("doc_id").alias(name))
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col(name), "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier, their words then joined by a space; documents of which nothing is left go.

    Only ``text`` and ``n_chars`` change; other columns stay, whatever their names. Documents of a null id stay whole, rows that repeat an id are one
    document; an empty table stays empty.
    """
    docs, own = apart(docs, "n_words", "n_removed", "kept")
    cut = dedup_substrings(docs)
    shorter = F.col("n_removed") > 0
    changed = {"text": F.when(shorter, F.col("kept")).otherwise(F.col("text")), "n_chars": F.when(shorter, F.length("kept").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    names = [c for c in cut.columns if c in changed]
    return cut.where("n_removed = 0 or n_removed < n_words").withColumns({c: changed[c] for c in names}).select(*own)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item occurs in; null texts hold none.

    The columns stay as they are, whatever their names; repeated rows are judged alike; an empty table stays empty, an empty benchmark takes nothing.
    """
    docs, own = apart(docs, "n_words", "n_hit", "item_ids", "hit_spans")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where("n_hit = 0").select(*own)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the words it takes of each: ``size, source_size, target, taken``, which replace columns of these names.

    Documents without words go; rows that repeat an id are drawn together; an empty table stays empty.
    """
    return mix_sources(docs).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Language identification and near-duplicates are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
