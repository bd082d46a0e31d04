"""Cleaning and formatting of cells: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that stand for a missing value (after stripping white space).
NULL_TOKENS = ("", "None", "NaN", "none", "nan", "-", "unknown")
#: Source accessions that stand for a missing one (any case).
BAD_ACCESSIONS = ("", "-", "unknown")
WHITE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def is_missing(c: Column) -> Column:
    """True for null and for cells that hold a null token; case-sensitive."""
    return c.isNull() | strip(c).isin(*NULL_TOKENS)


def null_of(c: Column) -> Column:
    """The cell, or null where it is missing."""
    return F.when(~is_missing(c), c)


def normalise_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null tokens become null in the string columns named (all by default).

    Cells are compared as they are, except for one blank, which counts as empty.
    """
    names = [n for n, t in df.dtypes if t == "string" and (columns is None or n in columns)]
    return df.withColumns({n: F.when(~F.col(n).isin(*NULL_TOKENS, " "), F.col(n)) for n in names}) if names else df


def fill_nulls(df: DataFrame, token: str = "None") -> DataFrame:
    """The opposite, for writing text files."""
    return df.na.fill(token)


def clean_accession(c: Column) -> Column:
    """Stripped upper case; null for missing accessions."""
    return F.when(~F.lower(strip(c)).isin(*BAD_ACCESSIONS), F.upper(strip(c)))


def split_cell(c: Column, sep: str = ",") -> Column:
    """Stripped non-missing parts of a multi-value cell; empty for null."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), f"[{sep}]"), strip)
    return F.filter(parts, lambda x: ~is_missing(x))


def capitalize(c: Column) -> Column:
    """First letter upper, the rest lower; words after the first are not touched apart."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**31 - 1)))


def format_label(c: Column) -> Column:
    """One label of an edge table: capitalised, spaces become dashes."""
    return F.replace(capitalize(strip(c)), F.lit(" "), F.lit("-"))


def label_list(c: Column) -> Column:
    """Sorted distinct formatted labels of a cell; cells with one label stay in generated code."""
    many = F.array_sort(F.array_distinct(F.transform(split_cell(c), format_label)))
    one = F.when(is_missing(c), F.array().cast("array<string>")).otherwise(F.array(format_label(c)))
    return F.when(F.coalesce(F.contains(c, F.lit(",")), F.lit(False)), many).otherwise(one)


def join_or_null(parts: Column, sep: str = ",") -> Column:
    return F.when(F.size(parts) > 0, F.array_join(parts, sep))


def format_labels(c: Column) -> Column:
    return join_or_null(label_list(c))


def store_labels(c: Column) -> Column:
    """Labels as the store keeps them: capitalised, distinct, sorted, spaces stay."""
    return join_or_null(F.array_sort(F.array_distinct(F.transform(split_cell(c), capitalize))))


def annotations(c: Column, distinct: bool) -> Column:
    """Sorted upper-case terms; distinct for proteins, repeats kept for interactions."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.upper(strip(x))), lambda x: x != "")
    return join_or_null(F.array_sort(F.array_distinct(parts) if distinct else parts))


def annotations_valid(c: Column) -> Column:
    """Whether every term names an ontology or family entry (GO:, IPR, PF)."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.upper(strip(x))), lambda x: x != "")
    return F.forall(parts, lambda x: x.contains("GO:") | x.contains("IPR") | x.contains("PF"))


def keywords(c: Column, distinct: bool = True) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: capitalize(strip(x))), lambda x: x != "")
    return join_or_null(F.array_sort(F.array_distinct(parts) if distinct else parts))


def text_or_null(c: Column) -> Column:
    """Functions, descriptions and gene names: stripped, blank is null."""
    return F.nullif(strip(c), F.lit(""))


def valid_accession(c: Column) -> Column:
    """Stripped upper-case accession; null where it must be refused."""
    return F.nullif(F.upper(strip(c)), F.lit(""))


def rename_term(c: Column) -> Column:
    """GO0001 -> GO:0001 in upper case; InterPro and Pfam names stay as they are."""
    up = F.upper(c)
    return F.when(up.startswith("GO:"), up).when(up.startswith("GO"), F.concat(F.lit("GO:"), F.substring(up, 3, 2**31 - 1))).otherwise(up)


def joint_id(a: Column, b: Column) -> Column:
    """Two protein numbers in numeric order, comma-joined."""
    return F.concat_ws(",", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def update_date(c: Column) -> Column:
    """A day such as 01-JAN-2017, any case of the month."""
    p = F.split(strip(c), "-")
    return F.try_to_timestamp(F.concat_ws("-", F.get(p, 0), capitalize(F.get(p, 1)), F.get(p, 2)), F.lit("dd-MMM-yyyy"))


def outdated(value: Column, least: Column) -> Column:
    """Before the wanted date or release; missing counts as outdated."""
    return F.coalesce(value < least, F.lit(True))


def add_labels(cell: Column, new: Column) -> Column:
    return join_or_null(F.array_sort(F.array_union(split_cell(cell), F.transform(split_cell(new), capitalize))))


def drop_labels(cell: Column, old: Column) -> Column:
    return join_or_null(F.array_sort(F.array_except(split_cell(cell), F.transform(split_cell(old), capitalize))))


def feature_text(*columns: Column) -> Column:
    """Non-empty feature cells comma-joined, without colons; the text a vectorizer reads."""
    return F.replace(F.concat_ws(",", *[F.nullif(strip(c), F.lit("")) for c in columns]), F.lit(":"), F.lit(""))


def references(pubmed: Column, psimi: Column) -> Column:
    """array<struct<pmid, psimis>> from the two aligned cells of an edge.

    Missing groups count as empty, so that fewer groups than pmids is no error.
    """
    kind = "array<struct<pmid:string,psimis:array<string>>>"
    cells = lambda c: F.coalesce(F.split(c, ","), F.array().cast("array<string>"))

    def one(x: Column) -> Column:
        return F.struct(null_of(strip(x["p"])).alias("pmid"), F.transform(split_cell(x["g"], "|"), F.upper).alias("psimis"))

    # zipped, so that each cell is split once
    many = F.filter(F.transform(F.arrays_zip(cells(pubmed).alias("p"), cells(psimi).alias("g")), one), lambda r: r["pmid"].isNotNull())
    has = lambda c, x: F.coalesce(F.contains(c, F.lit(x)), F.lit(False))
    method = F.when(is_missing(psimi), F.array().cast("array<string>")).otherwise(F.array(F.upper(strip(psimi))))
    single = F.when(is_missing(pubmed), F.array().cast(kind)).otherwise(F.array(F.struct(strip(pubmed).alias("pmid"), method.alias("psimis"))).cast(kind))
    # one publication and one method is the common case and needs no lambda
    return F.when(has(pubmed, ",") | has(psimi, ",") | has(psimi, "|"), many).otherwise(single)


def references_aligned(pubmed: Column, psimi: Column) -> Column:
    """Whether an edge's reference cells have equally many parts (a strict reader refuses others)."""
    return F.coalesce(F.size(F.split(pubmed, ",")), F.lit(0)) == F.coalesce(F.size(F.split(psimi, ",")), F.lit(0))
