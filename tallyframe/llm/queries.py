"""The operators as named queries over whole test tables, with the digest columns of their contracts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import (
    chat_format,
    decontaminate,
    exact_dedup,
    html_extract,
    lattice_lm,
    merkle_manifest,
    packing,
    pii_feistel,
    quality_crf,
    simhash_covering,
    substring_dedup,
    url_filter,
    variant_grouping,
)
from tallyframe.llm.common import table

AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query
def op2_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.col("items").cast("array<string>"), ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


# The conversation that the contract adds.
PROBE = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def read_back(segments: DataFrame, template: chat_format.Template, conv_col: str = "conv_id") -> DataFrame:
    """What the formatted conversations say, turn by turn: counts and digests per conversation.

    Segments stream through the tasks in order; nothing longer than a turn is held.
    """
    kind = segments.schema[conv_col].dataType.simpleString()
    schema = (
        f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, n_errors long"
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turn, row, turns, learned = None, "", None, None, None

        def done() -> tuple:
            n, loss_chars, chars, errors = row
            return conv, n, turns.hexdigest(), loss_chars, learned.hexdigest(), chars, errors

        for batch in batches:
            out = []
            for now, part, text, loss, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row is None or now != conv:
                    if row is not None:
                        out.append(done())
                    conv, turn, row, turns, learned = now, "", [0, 0, 0, 0], hashlib.sha256(), hashlib.sha256()
                turn += text
                row[2] += len(text)
                row[3] += error is not None
                if loss:
                    said = template.unescape(text)
                    row[1] += len(said)
                    learned.update(said.encode())
                if part == "end":
                    for role, said in template.read_turns(turn):
                        row[0] += 1
                        turns.update(f"{role}\n{said}\n".encode())
                    turn = ""
            if out:
                yield as_batch(out, batch.column(0).type)
        if row is not None:
            yield as_batch([done()], batch.column(0).type)

    def as_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        names = [f.split()[0] for f in schema.split(", ")]
        kinds = [kind, *(pa.string() if n.endswith("sha256") else pa.int64() for n in names[1:])]
        columns = zip(zip(*rows, strict=True), kinds, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names)

    in_order = segments.repartition(conv_col).sortWithinPartitions(conv_col, "seq")
    return (
        in_order.select(conv_col, "part", "text", "loss", "error").mapInArrow(read, schema).withColumnRenamed("conv", conv_col)
    )


@query
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = chat_format.Template()
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = said.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    return read_back(chat_format.format_segments(said, template), template)


@query
def op6_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_covering.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), buckets=16, budget=32768)


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


# A fixed key keeps the test results comparable; a production run passes a secret one.
PII_KEY = "tallyframe test key"


@query
def op9_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_feistel.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query
def op11_variant_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_grouping.group_variants(table(spark, sf_dir, "documents"))


@query
def op12_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = F.translate("text", AZ, LOWER_AZ)
    fields = [lowered if c == "text" else F.col(c) for c in merkle_manifest.FIELDS]
    # What a reader of the data would compute as the leaf: of some rows the text was tampered with.
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle_manifest.leaf_digest(*fields))
    found = merkle_manifest.manifest(table(spark, sf_dir, "documents"), carry={"tampered": tampered})
    folded = merkle_manifest.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle_manifest.path_digest(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
