"""UniProt flat files as the protein table: one text record per entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def _lines(code: str) -> Column:
    mine = F.filter("lines", lambda x: x.startswith(f"{code}   "))
    return F.transform(mine, lambda x: F.rtrim(F.substring(x, 6, 2**31 - 1)))


def _xrefs(name: str) -> Column:
    """Fields of the DR lines of one database, as arrays."""
    mine = F.filter(_lines("DR"), lambda x: x.startswith(f"{name};"))
    return F.transform(mine, lambda x: F.transform(F.split(F.regexp_replace(x, r"\.$", ""), ";"), T.strip))


def _terms(refs: Column) -> Column:
    return T.join_or_null(F.array_sort(F.array_distinct(F.transform(refs, lambda x: F.get(x, 1)))))


def _go(letter: str) -> Column:
    return _terms(F.filter(_xrefs("GO"), lambda x: F.get(x, 2).startswith(f"{letter}:")))


def read_proteins(spark: SparkSession, path: str, taxon_id: int | None = None) -> DataFrame:
    """uniprot_id, taxon_id, gene_id, GO terms by aspect, interpro, pfam, keywords, function,
    reviewed, last_update, last_release, entry_name, synonyms of every entry."""
    df = spark.read.option("lineSep", "\n//").text(path)  # ends an entry whichever line ends follow
    df = df.select(F.split(F.regexp_replace("value", "\r", ""), "\n").alias("lines")).where(F.exists("lines", lambda x: x.startswith("ID   ")))
    head = F.get(_lines("ID"), 0)
    accessions = F.filter(F.transform(F.split(F.array_join(_lines("AC"), " "), ";"), T.strip), lambda x: x != "")
    gene = F.split_part(F.element_at(F.split(F.split_part(F.get(_lines("GN"), 0), F.lit(";"), F.lit(1)), "="), -1), F.lit(" "), F.lit(1))
    comments = F.split(F.array_join(_lines("CC"), " "), "-!- ")
    function = F.get(F.filter(F.transform(comments, T.strip), lambda x: x.contains("FUNCTION:")), 0)
    words = F.filter(F.transform(F.split(F.regexp_replace(F.array_join(_lines("KW"), " "), r"\.$", ""), ";"), lambda x: T.strip(F.regexp_replace(x, r"\{.*\}", ""))), lambda x: x != "")
    dates = F.filter(_lines("DT"), lambda x: x.contains("entry version"))
    date = F.get(F.transform(dates, lambda x: F.regexp_extract(x, r"(\d+-\w+-\d+)", 1)), 0)
    release = F.get(F.transform(dates, lambda x: F.regexp_extract(x, r"entry version (\d+)", 1)), 0)
    names = F.regexp_extract_all(F.array_join(_lines("GN"), " "), F.lit(r"Synonyms=([^;]+)"), F.lit(1))
    out = df.select(
        F.get(accessions, 0).alias("uniprot_id"),
        F.regexp_extract(F.array_join(_lines("OX"), " "), r"NCBI_TaxID=(\d+)", 1).try_cast("int").alias("taxon_id"),
        T.text_or_null(gene).alias("gene_id"),
        _go("F").alias("go_mf"), _go("C").alias("go_cc"), _go("P").alias("go_bp"),
        _terms(_xrefs("InterPro")).alias("interpro"), _terms(_xrefs("Pfam")).alias("pfam"),
        T.join_or_null(F.array_sort(F.array_distinct(words))).alias("keywords"),
        T.text_or_null(F.regexp_replace(function, r"^.*?FUNCTION:\s*", "")).alias("function"),
        head.contains("Reviewed;").alias("reviewed"),
        T.update_date(date).alias("last_update"), release.try_cast("int").alias("last_release"),
        F.split_part(head, F.lit(" "), F.lit(1)).alias("entry_name"),
        F.transform(F.split(F.get(names, 0), ","), T.strip).alias("synonyms"),
    )
    return out if taxon_id is None else out.where(F.col("taxon_id") == taxon_id)
