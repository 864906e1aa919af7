"""Provenance of source entries: schema-on-read over nested metadata, file scans, and what a configuration needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The parts of an entry document that are read; anything else in it is passed over.
ENTRY = ("rcsb_accession_info struct<initial_release_date: string, deposit_date: string>, exptl array<struct<method: string>>, "
         "rcsb_entry_info struct<resolution_combined: array<double>, polymer_entity_count: int, deposited_atom_count: int>, struct struct<title: string>, "
         "rcsb_primary_citation struct<pdbx_database_id_DOI: string, pdbx_database_id_PubMed: string, year: int>, "
         "rcsb_entry_container_identifiers struct<assembly_ids: array<string>>")


def annotated(records: DataFrame, payload: str = "payload") -> DataFrame:
    """``records`` with what their metadata says: dates without time, the first method, the first resolution, publications, assemblies.

    A missing, empty or broken document leaves every field empty; lists are empty, not NULL.
    """
    read = records.withColumn("_entry", F.expr(f"from_json({payload}, '{ENTRY}')"))
    date = "nullif(split(_entry.rcsb_accession_info.{}, 'T')[0], '')"
    cited = "_entry.rcsb_primary_citation"
    named = [f"concat('{k}:', nullif({cited}.{k}, ''))" for k in ("pdbx_database_id_DOI", "pdbx_database_id_PubMed")] + [f"concat('year:', nullif({cited}.year, 0))"]
    return read.selectExpr(
        *[c for c in records.columns if c != payload], f"{date.format('initial_release_date')} AS release_date", f"{date.format('deposit_date')} AS deposit_date",
        "get(_entry.exptl, 0).method AS experimental_method", "get(_entry.rcsb_entry_info.resolution_combined, 0) AS resolution", "_entry.struct.title AS title",
        f"filter(array({', '.join(named)}), p -> p IS NOT NULL) AS publications", "coalesce(_entry.rcsb_entry_container_identifiers.assembly_ids, array()) AS assembly_ids",
        "_entry.rcsb_entry_info.polymer_entity_count AS polymer_entity_count", "_entry.rcsb_entry_info.deposited_atom_count AS deposited_atom_count")


def cached_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Record files, one JSON document each, with their file name; sorted by name. A file that does not fit the schema is an error."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.withColumn("file_name", F.expr("_metadata.file_name")).orderBy("file_name")


def needed_sources(proteins: DataFrame, state_pairs: DataFrame | None = None, episodes: DataFrame | None = None, episode_sources: DataFrame | None = None) -> DataFrame:
    """``source_type, entry``: everything that a configuration needs, once, in upper case.

    ``proteins`` holds ``source_type, entry``; ``state_pairs`` holds structs ``state1`` and ``state2`` of the same; ``episodes`` lists
    ``episode`` and ``episode_sources`` says ``episode, entry``.
    """
    kind = "IF(source_type = 'pdb', 'pdb', 'afdb')"
    rows = proteins.selectExpr(f"{kind} AS source_type", "upper(entry) AS entry")
    if state_pairs is not None:
        both = state_pairs.selectExpr("inline(array(named_struct('source_type', state1.source_type, 'entry', state1.entry), named_struct('source_type', state2.source_type, 'entry', state2.entry)))")
        rows = rows.unionByName(both.selectExpr(f"{kind} AS source_type", "upper(entry) AS entry"))
    if episodes is not None and episode_sources is not None:
        rows = rows.unionByName(episode_sources.join(episodes.select("episode").distinct(), "episode", "left_semi").selectExpr("'pdb' AS source_type", "entry"))
    return rows.distinct()
