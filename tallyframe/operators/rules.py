"""Rule definitions, tag audit and the documents exchanged with the rule service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import FP_VERSION, fingerprint, has_tag, tag_tokens, token_value
from tallyframe.operators.predicates import latest_window
from tallyframe.schemas import EXPORT_COLUMNS, RULE_DOCUMENT, RULE_FIELDS, RULES

# Rows of one export document.
EXPORT_ROWS = 10_000


def _rule_rows(documents: DataFrame, pulled_at: Column) -> DataFrame:
    """One row per rule of a document. Missing fields become '', the whole rule is kept as JSON."""
    rule = documents.select(F.explode("rules").alias("config_json"))
    fields = F.from_json("config_json", RULE_FIELDS)
    return rule.select("config_json", fields.alias("r")).select(
        "r.rule_id",
        F.coalesce("r.rule_type", F.lit("")).alias("rule_type"),
        F.coalesce("r.description", F.lit("")).alias("description"),
        "config_json",
        pulled_at.cast("timestamp").alias("pulled_at"),
    )


def parse_rules(documents: DataFrame, column: str, pulled_at: Column) -> DataFrame:
    """Rules of JSON documents held in a string column."""
    parsed = documents.select(F.from_json(column, RULE_DOCUMENT).alias("doc"))
    return _rule_rows(parsed.select("doc.rules"), pulled_at)


def read_rules(spark: SparkSession, path: str, pulled_at: Column, multi_line: bool = True) -> DataFrame:
    """Rules of JSON files, one document per file or, without ``multi_line``, one per line."""
    documents = spark.read.schema(RULE_DOCUMENT).json(path, multiLine=multi_line)
    return _rule_rows(documents, pulled_at)


def rule_drift(rules: DataFrame) -> DataFrame:
    """Which fields the rules' JSON has, by type: ``field``, ``type``, ``rules``, ``known``.

    The documents are read as variants, so a field shows up whether or not the schema names it, and with the type that
    it has in each rule. Text that is no JSON object is one row without a field. Fields of objects inside a rule count as
    part of the object's type.
    """
    read = rules.select(F.try_parse_json("config_json").alias("config"))
    field = rules.sparkSession.tvf.variant_explode_outer(F.col("config").outer())
    seen = read.lateralJoin(field).select(F.col("key").alias("field"), F.schema_of_variant("value").alias("type"))
    known = F.coalesce(F.col("field").isin(*RULE_FIELDS.names), F.lit(False))
    return seen.groupBy("field", "type").agg(F.count("*").alias("rules")).withColumn("known", known)


def upsert_rules(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Whole-row update or insert by ``rule_id``; of several incoming versions the newest wins.

    One aggregation does it: incoming rows rank above current ones, then by age. Copies of a key
    are merged before the shuffle, so a key with very many versions stays cheap.
    """
    rest = [c for c in RULES.names if c not in ("rule_id", "pulled_at")]
    both = current.select(*RULES.names, F.lit(0).alias("_new")).unionByName(
        incoming.select(*RULES.names, F.lit(1).alias("_new"))
    )
    newest = both.groupBy("rule_id").agg(F.max(F.struct("_new", "pulled_at", *rest)).alias("r"))
    return newest.select("rule_id", *[f"r.{c}" for c in RULES.names if c != "rule_id"])


def export_rows(effectiveness: DataFrame) -> DataFrame:
    """The whitelisted columns of the newest window."""
    return latest_window(effectiveness).select(*EXPORT_COLUMNS)


def export_documents(
    effectiveness: DataFrame, reported_at: str, rows_per_document: int = EXPORT_ROWS
) -> DataFrame:
    """Documents ``{reported_at, effectiveness: [...]}`` for the rule service, one per row.

    The rows of the newest window are dealt by hash over as many documents as keep each near ``rows_per_document``, so
    no list grows with the table. The window and its number of rows come from one subquery of the same job.
    """
    windows = effectiveness.groupBy("window").agg(F.count("*").alias("n"))
    newest = windows.agg(F.max(F.struct("window", "n"))).scalar()
    rows = effectiveness.where(F.col("window") == newest["window"])
    part = F.pmod(F.xxhash64("ck", "rule_id"), F.ceil(newest["n"] / rows_per_document)).alias("part")
    body = F.struct(F.lit(reported_at).alias("reported_at"), F.col("effectiveness"))
    return (
        rows.groupBy(part)
        .agg(F.collect_list(F.struct(*EXPORT_COLUMNS)).alias("effectiveness"))
        .select(F.to_json(body).alias("value"))
    )


def tag_audit(history: DataFrame) -> DataFrame:
    """Statements per outcome of comparing the tag with the fingerprint computed from the text."""
    text = F.col("statement_text")
    read = history.select(text, has_tag(text).alias("tagged"), tag_tokens(text).alias("tokens"))
    ck, version = token_value(F.col("tokens"), "ck"), token_value(F.col("tokens"), "v")
    outcome = (
        F.when(~F.col("tagged"), "untagged")
        .when(F.col("tokens").isNull(), "void")
        .when(~version.eqNullSafe(F.lit(str(FP_VERSION))), "other_version")
        .when(ck.isNull(), "no_ck")
        .when(ck == fingerprint(text), "match")
        .otherwise("ck_mismatch")
    )
    return read.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("statements"))
