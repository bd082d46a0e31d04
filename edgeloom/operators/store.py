"""The relational store: five tables as Parquet folders, replaced by write-new-then-swap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Tables and columns of the store.
SCHEMAS = {
    "protein": "uniprot_id string, taxon_id int, gene_id string, go_mf string, go_cc string, go_bp string, interpro string, pfam string, keywords string, function string, reviewed boolean, last_update timestamp, last_release int",
    "interaction": "source string, target string, taxon_id int, is_training boolean, is_holdout boolean, is_interactome boolean, label string, keywords string, go_mf string, go_cc string, go_bp string, ulca_go_mf string, ulca_go_cc string, ulca_go_bp string, interpro string, pfam string",
    "pubmed": "accession string",
    "psimi": "accession string, description string",
    "reference": "source string, target string, pubmed string, psimi string",
}


class Store:
    """Tables below a folder that Spark reads; versions lie side by side until the new one is whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self, table: str) -> list[int]:
        fs, p = self._fs(f"{self.path}/{table}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        whole = [n for n in names if n.startswith("v") and fs.exists(self._fs(f"{self.path}/{table}/{n}/_SUCCESS")[1])]
        return sorted(int(n[1:]) for n in whole)

    def read(self, table: str) -> DataFrame:
        found = self.versions(table)
        if not found:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.path}/{table}/v{found[-1]}")

    def write(self, table: str, df: DataFrame) -> None:
        """Replace a table; df may read the table itself. Older versions go afterwards."""
        found = self.versions(table)
        names = [x.split()[0] for x in SCHEMAS[table].split(", ")]
        have = [F.col(c) if c in df.columns else F.lit(None).alias(c) for c in names]
        schema = self.spark.createDataFrame([], SCHEMAS[table]).schema
        df.select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(have, schema, strict=True)]).write.mode("overwrite").parquet(f"{self.path}/{table}/v{(found or [0])[-1] + 1}")
        for v in found:
            fs, p = self._fs(f"{self.path}/{table}/v{v}")
            fs.delete(p, True)

    def create(self) -> None:
        for table in SCHEMAS:
            if not self.versions(table):
                self.write(table, self.read(table))

    def wipe(self) -> None:
        fs, p = self._fs(self.path)
        fs.delete(p, True)


def training(df: DataFrame, strict: bool = False) -> DataFrame:
    return df.where("is_training and not is_holdout" if strict else "is_training")


def holdout(df: DataFrame, strict: bool = False) -> DataFrame:
    return df.where("is_holdout and not is_training" if strict else "is_holdout")


def labelled_network(df: DataFrame) -> DataFrame:
    return df.where("is_holdout or is_training")


def interactome(df: DataFrame) -> DataFrame:
    return df.where("is_interactome")


def of_taxon(df: DataFrame, taxon_id: int | None = None) -> DataFrame:
    return df if taxon_id is None else df.where(F.col("taxon_id") == taxon_id)


def by_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where((F.col("source") == F.least(F.lit(a), F.lit(b))) & (F.col("target") == F.greatest(F.lit(a), F.lit(b))))


def by_protein(df: DataFrame, accession: str) -> DataFrame:
    """Interactions with the protein at either end."""
    return df.where((F.col("source") == accession) | (F.col("target") == accession))


def by_label(df: DataFrame, label: str, substring: bool = False) -> DataFrame:
    """Rows that carry the label; with substring, any label that contains it, in any case."""
    return df.where(F.lower("label").contains(label.lower()) if substring else F.array_contains(T.split_cell(F.col("label")), T.capitalize(F.lit(label))))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's rows by key: new's values win where they aren't null; `change` says
    new, updated or kept. key is unique in both."""
    names = [c for c in old.columns if c != key]
    n = new.select(F.col(key).alias("n_key"), *[F.col(c).alias(f"n_{c}") if c in new.columns else F.lit(None).alias(f"n_{c}") for c in names])
    both = old.join(n, F.col(key) == F.col("n_key"), "full_outer")
    change = F.when(F.col(key).isNull(), "new").when(F.col("n_key").isNull(), "kept").otherwise("updated")
    return both.select(F.coalesce(key, "n_key").alias(key), *[F.coalesce(f"n_{c}", c).alias(c) for c in names], change.alias("change"))


def merge_flags(training: DataFrame, holdout: DataFrame, common: DataFrame, interactome: DataFrame) -> DataFrame:
    """One row per pair: flags OR-ed, labels of the labelled streams united, references together."""
    streams = ((training, True, False, False), (holdout, False, True, False), (common, True, True, False), (interactome, False, False, True))
    rows = None
    for k, (df, t, h, i) in enumerate(streams):
        part = df.select("source", "target", (F.lit(None).cast("string") if i else F.col("label")).alias("label"), "pubmed", "experiment_type", F.lit(t).alias("t"), F.lit(h).alias("h"), F.lit(i).alias("i"), F.lit(k).alias("k"))
        rows = part if rows is None else rows.unionByName(part)
    labels = F.array_sort(F.array_distinct(F.flatten(F.collect_list(T.split_cell(F.col("label"))))))
    refs = F.array_sort(F.collect_set(F.when(F.col("pubmed").isNotNull(), F.struct("k", "pubmed", F.coalesce("experiment_type", F.lit("None")).alias("g")))))
    out = rows.groupBy("source", "target").agg(F.bool_or("t").alias("is_training"), F.bool_or("h").alias("is_holdout"), F.bool_or("i").alias("is_interactome"), labels.alias("l"), refs.alias("r"))
    return out.select("source", "target", "is_training", "is_holdout", "is_interactome", T.join_or_null(F.col("l")).alias("label"), T.join_or_null(F.transform("r", lambda x: x["pubmed"])).alias("pubmed"), T.join_or_null(F.transform("r", lambda x: x["g"])).alias("experiment_type"))


def reference_links(edges: DataFrame, pubmed: DataFrame | None = None, psimi: DataFrame | None = None) -> DataFrame:
    """source, target, pubmed, psimi: one row per edge, publication and method; a publication
    for which no row of the edge names a method has psimi null. Edges may occur in several
    rows. Known accessions only, where tables are given."""
    refs = edges.select("source", "target", F.explode(T.references(F.col("pubmed"), F.col("experiment_type"))).alias("r"))
    rows = refs.select("source", "target", F.col("r.pmid").alias("pubmed"), F.explode_outer("r.psimis").alias("psimi"))
    if pubmed is not None:
        rows = rows.join(pubmed.select(F.col("accession").alias("pubmed")), "pubmed", "left_semi")
    if psimi is not None:
        known = psimi.select(F.col("accession").alias("m_acc")).distinct()
        rows = rows.join(known, F.col("psimi") == F.col("m_acc"), "left").withColumn("psimi", F.col("m_acc")).drop("m_acc")
    # null is the least, so the greatest says whether there is any method
    most = rows.groupBy("source", "target", "pubmed", "psimi").agg(F.lit(1).alias("one")).withColumn("best", F.max("psimi").over(Window.partitionBy("source", "target", "pubmed")))
    return most.where("psimi is not null or best is null").select("source", "target", "pubmed", "psimi")


def linked(links: DataFrame, given: DataFrame, have: list[str], want: list[str]) -> DataFrame:
    """Distinct `want` columns of the links whose `have` columns occur in given; nulls left out."""
    return links.join(given.select(*have).distinct(), have, "left_semi").select(*want).na.drop("any").distinct()


def resolve(pairs: DataFrame, proteins: DataFrame, interactions: DataFrame, taxon_id: int | None = 9606) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(existing, missing, invalid) for pairs(source, target) of any shape.

    Pairs are made canonical and distinct. Missing cells or proteins that are unknown
    or of another taxon make a pair invalid; the rest exists in the store or not.
    """
    from .edges import canonical

    a, b = canonical(F.upper(T.strip(F.col("source"))), F.upper(T.strip(F.col("target"))))
    rows = pairs.select(a.alias("source"), b.alias("target")).distinct()
    good = of_taxon(proteins, taxon_id).select("uniprot_id")
    for end in ("source", "target"):
        rows = rows.join(good.select(F.col("uniprot_id").alias(f"g_{end}")), F.col(end) == F.col(f"g_{end}"), "left")
    valid = F.col("g_source").isNotNull() & F.col("g_target").isNotNull()
    ok, ends = rows.where(valid).select("source", "target"), ["source", "target"]
    return interactions.join(ok, ends, "left_semi"), ok.join(interactions, ends, "left_anti"), rows.where(~valid).select("source", "target")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that a uniqueness rule refuses: more than one row."""
    return df.groupBy(key).count().where("count > 1").select(key)
