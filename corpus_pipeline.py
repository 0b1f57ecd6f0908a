"""From raw documents to packed training sequences.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir) and returns
the documents that go on; its result is written and read again before the next
one. All but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopflow.llm import best_fit, jaccard_join, pfair_mix, quality_attention, quality_rules
from stopflow.llm.frames import fold_of, stored, table

# The rows are a trained model's, which SQL cannot express.
ORACLE_SQL = None


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with their columns under names of our own, and the new names:
    what an operator adds cannot clash with them."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def back(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(n).alias(c) for c, n in names.items()])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. It learns from the
    labelled documents among those given, folds 1 to 4 of 5.

    Every row is judged by its own text, repeated rows alike; null and empty
    texts are one passage without words. Without labels of both kinds all rows
    have the same score. Columns of any name come out as they went in.
    """
    model = quality_attention.fit(docs.where(fold_of() != 0), table(spark, sf_dir, "labels").where(fold_of() != 0))
    rows, names = aside(docs)
    scored = quality_attention.score(rows, model, doc_id=names["doc_id"], text=names["text"], keep=rows.columns)
    return back(scored.where("predicted = 1"), names)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep to all quality rules.

    Every row is judged by its own text, repeated rows alike; null and empty
    texts have no words and go. Columns of any name come out as they went in.
    """
    rows, names = aside(docs)
    return back(quality_rules.judge(rows, text=names["text"]).where("kept"), names)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    Rows that share an id are one document where their texts are equal: one row
    stays, the smallest by the other columns. Different texts under one id stay
    as they are. Rows without an id are compared as whole texts only: one row
    of each text stays, and none if a row with an id has the same text.
    """
    groups = jaccard_join.link(docs)
    gone = stored(groups.where("component_id <> doc_id").select("doc_id").distinct(), "duplicates")
    repeated = stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    nameless = docs.where("doc_id IS NULL")
    out = docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").select(*docs.columns)
    if not repeated.isEmpty():
        out = out.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(_one_row_each(out.join(repeated, "doc_id", "left_semi").select(*docs.columns)))
    if not nameless.isEmpty():
        named = docs.where("doc_id IS NOT NULL").select("text")
        out = out.union(_one_row_each(nameless).join(named, "text", "left_anti").select(*docs.columns))
    return out


def _one_row_each(docs: DataFrame) -> DataFrame:
    """One row of each id and text, the smallest by the other columns."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = docs.groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0), *others)).alias("_least"))
    return least.select(*[c if c in ("doc_id", "text") else F.col("_least")[c].alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: no source has more than a quarter
    of the weight; what such a source has beyond that follows at the end.

    A null source is a source; repeated rows and null ids go each by itself,
    texts are never looked at. Columns of any name come out as they went in; the
    rows lie in the order of the mixture, which is what packing goes by.
    """
    rows, names = aside(docs)
    mixed = pfair_mix.mix(rows, source=names["source"], doc_id=names["doc_id"])
    return back(mixed.repartitionByRange(F.col("slot")).sortWithinPartitions("slot", "place"), names)


def placed(docs: DataFrame) -> DataFrame:
    """The documents with `_at`, one number a row in the order in which they lie: by
    file name and row. Rows that come from no file are written as they come."""
    try:
        rows = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return stored(docs.withColumn("_at", F.monotonically_increasing_id()), "placed")
    # one row per file
    files = docs.select(F.col("_metadata.file_path").alias("_file")).distinct().withColumn("_no", F.row_number().over(Window.orderBy("_file")))
    at = F.shiftleft(F.col("_no").cast("long"), 40) + F.col("_row")
    return rows.join(F.broadcast(files), "_file").withColumn("_at", at).select(*docs.columns, "_at")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in the training sequences.

    The order in which the documents lie, that of the mixture, is the order of the
    sequences: `first_place` is the least place of a sequence's documents, and the
    rows are sorted by it.

    A null or empty text is the end id alone; rows with equal or null ids are
    packed each by itself. Other columns are not looked at.
    """
    rows = placed(docs.select("doc_id", "text"))
    packed = best_fit.pack(rows, doc_id="_at").withColumnRenamed("doc_id", "_at")
    # a sequence has no more pieces than ids
    packed = packed.withColumn("first_place", F.min("_at").over(Window.partitionBy("sequence_id")))
    named = packed.join(rows.select("_at", F.col("doc_id").cast("long").alias("doc_id")), "_at")
    out = named.select("doc_id", *[c for c in packed.columns if c not in ("_at", "first_place")], "first_place")
    return out.repartitionByRange("first_place", "sequence_id").sortWithinPartitions("first_place", "sequence_id", "offset")


STAGES = [("quality classifier", classify), ("quality rules", rules), ("n-gram Jaccard join", deduplicate), ("mixing sources", mix), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
