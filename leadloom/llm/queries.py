"""Queries of the operators tagged llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import canonical, linkage, packing, sentences, survivors, tokens
from leadloom.sources.tables import table


def p3_matches(spark: SparkSession, folder: str) -> DataFrame:
    return linkage.matched_people(table(spark, folder, "gtm_lead"), table(spark, folder, "person_record"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_matches(spark, folder).select("gtm_id", "person_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivors.surviving_values(table(spark, folder, "lead_record")).select("lead_id", "field", "ingest_seq")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical.canonical_values(table(spark, folder, "golden_case"), table(spark, folder, "canon_ref"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_ids(table(spark, folder, "documents"))


def p9_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), table(spark, folder, "pack_spec"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_units(table(spark, folder, "documents"))


def p6_cases(spark: SparkSession, folder: str) -> DataFrame:
    """How many values of each field were mapped or reported: every non-null one."""
    return p6_found(spark, folder).groupBy("field").agg(F.count("*").alias("cases"), F.countDistinct("case_id").alias("rows"))


def p8_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The hash of every text after encoding and decoding."""
    return tokens.token_texts(p8_ids(spark, folder)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"))


def p9_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Per specification the documents packed, and how many containers are over
    the capacity, places not in order, and documents not packed whole."""
    packed = p9_pack(spark, folder)
    specs = table(spark, folder, "pack_spec").select("spec_id", "capacity_tokens")
    sizes = tokens.token_counts(table(spark, folder, "documents"))
    containers = packed.groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("used"), F.max("place").alias("last"), F.countDistinct("place").alias("places"), F.max(F.col("token_offset") + F.col("n_tokens")).alias("end"))
    full = containers.join(specs, "spec_id").groupBy("spec_id").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("over_full"), F.count_if((F.col("last") + 1 != F.col("places")) | (F.col("end") != F.col("used"))).alias("out_of_order"))
    documents = packed.groupBy("spec_id", "doc_id").agg(F.sum("n_tokens").alias("packed"), F.max(F.col("token_start") + F.col("n_tokens")).alias("reach")).join(sizes, "doc_id", "full_outer")
    whole = documents.groupBy("spec_id").agg(F.count("*").alias("documents"), F.count_if(~(F.col("packed").eqNullSafe(F.col("n_tokens")) & F.col("reach").eqNullSafe(F.col("n_tokens")))).alias("not_whole"))
    return whole.join(full, "spec_id").select("spec_id", "documents", "over_full", "out_of_order", "not_whole")


#: white space, and the mark that counts as such
BLANKS = r"[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def p10_cover(spark: SparkSession, folder: str) -> DataFrame:
    """The hash of the characters in the sentence units of each text, in order and without white space."""
    documents = table(spark, folder, "documents")
    units = p10_found(spark, folder).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_start", "sent_end"))).alias("units"))
    parts = F.transform("units", lambda u: F.substr(F.col("text"), (u["sent_start"] + 1).cast("int"), (u["sent_end"] - u["sent_start"]).cast("int")))
    return documents.select("doc_id", "text").join(units, "doc_id").select("doc_id", F.md5(F.regexp_replace(F.array_join(parts, ""), BLANKS, "").cast("binary")).alias("hash"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p3_matches": p3_matches,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_cases": p6_cases,
    "p8_ids": p8_ids,
    "p8_texts": p8_texts,
    "p9_pack": p9_pack,
    "p9_cover": p9_cover,
    "p10_found": p10_found,
    "p10_cover": p10_cover,
}

#: what must hold of the results, as SQL can say it
ORACLE: dict[str, str] = {
    "p6_cases": " union all ".join(f"select '{f}' as field, count(*) as cases, count(distinct case_id) as rows from golden_case where {f} is not null" for f, _ in canonical.FIELDS),
    "p8_texts": "select doc_id, md5(coalesce(text, '')) as hash from documents",
    "p9_cover": "select spec_id, (select count(*) from documents) as documents, 0::bigint as over_full, 0::bigint as out_of_order, 0::bigint as not_whole from pack_spec where capacity_tokens > 0",
    "p10_cover": f"select doc_id, md5(regexp_replace(text, '{BLANKS}', '', 'g')) as hash from documents where regexp_replace(text, '{BLANKS}', '', 'g') <> ''",
}
