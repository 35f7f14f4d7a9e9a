"""Strict local JSON documents: an envelope with a format and a list, no repeated keys, no repeated documents.

A file is one JSON value and so one row; as a variant it refuses a key that is repeated at any depth. Everything is columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ["source", "source_id", "source_version", "doc_type", "title", "content"]
TOP = ["format", "description", "documents"]


def _text(value: Column, key: str) -> Column:
    """The string at a key; null where there is none or another kind of value."""
    at = F.try_variant_get(value, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(value, f"$.{key}", "string"))


def _file_issue(wanted: str) -> Column:
    """What is wrong with a whole file, or null."""
    kind = F.schema_of_variant("data")
    listed = F.schema_of_variant(F.try_variant_get("data", "$.documents", "variant")).startswith("ARRAY")
    no_envelope = ~kind.startswith("OBJECT") | (F.size(F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, TOP)))) > 0) | ~F.coalesce(listed, F.lit(False))
    described = F.try_variant_get("data", "$.description", "variant").isNull() | _text(F.col("data"), "description").isNotNull()
    why = (
        F.when(~F.coalesce(F.json_array_length("listed") == 1, F.lit(False)), "not one JSON value")
        .when(F.col("data").isNull(), "a key is repeated")
        .when(no_envelope, "the envelope needs a format and a list of documents, and nothing else")
        .when(~_text(F.col("data"), "format").eqNullSafe(F.lit(wanted)), f"the format is not {wanted}")
        .when(~described, "the description is not a text")
    )
    return F.concat(F.lit("file:"), why)


def read_documents(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    """One row for each record; issue says why a record, or a whole file (index null), cannot be taken.

    Blank files, text after the value and values that JSON does not know count as not one JSON value; Spark gives no row for a
    file without bytes. record is the record with its keys in order."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    whole = whole.withColumn("listed", F.concat(F.lit("["), "value", F.lit("]")))  # the brackets see what follows the value
    data = whole.withColumn("data", F.try_variant_get(F.try_parse_json("listed"), "$[0]", "variant")).withColumn("issue", _file_issue(wanted))
    fine = F.when(F.col("issue").isNull(), F.try_variant_get("data", "$.documents", "array<variant>"))
    bad = F.when(F.col("issue").isNotNull(), F.array(F.parse_json(F.lit("null"))))
    rows = data.select("file", "issue", F.posexplode(F.coalesce(bad, fine)).alias("k", "r"))
    values = {c: _text(F.col("r"), c) for c in [*REQUIRED, "source_url"]}
    blank = F.coalesce(*[F.when(~F.coalesce(F.col(c).rlike(r"(?U)\S"), F.lit(False)), f"missing:{c}") for c in REQUIRED])
    is_object = F.schema_of_variant("r").startswith("OBJECT")
    rows = rows.select("file", F.when(F.col("issue").isNull(), F.col("k")).alias("index"), "issue", "r", is_object.alias("o"), *[v.alias(c) for c, v in values.items()])
    issue = F.coalesce("issue", F.when(~F.col("o"), "not_an_object"), blank)
    name = F.when(F.col("o"), F.concat_ws(":", F.coalesce("source", F.lit("None")), F.coalesce("source_id", F.lit("None"))))
    return rows.select("file", "index", name.alias("doc_id"), *values, F.when(F.col("o"), F.to_json("r")).alias("record"), issue.alias("issue"))


def accepted(documents: DataFrame) -> DataFrame:
    """The documents without an issue, each once; running it fails where two records of one doc_id differ."""
    fine = documents.where("issue is null")
    sums = fine.groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in fine.columns if c != "doc_id"]), F.struct("file", "index")).alias("r"), F.count_distinct("record").alias("kinds"))
    return sums.select("doc_id", "r.*", "kinds").withColumn("title", F.when(F.col("kinds") > 1, F.raise_error(F.concat(F.lit("different records share "), "doc_id"))).otherwise(F.col("title"))).drop("kinds")
