"""Queries of sources, sinks, the store and lookups: files written from the driver's tables and read back.

Fixtures lie in the shared folder, so executors read them like any source.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .contract import DAG, dag, query, table
from .functions import text as T
from .ml import folds, metrics, models
from .operators import edges as E
from .operators import features, mapping, network, ontology, store
from .operators.iterate import cut, shared_dir
from .sources import curated, edgelists, files, ontologies, proteins



def place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/fixture-{uuid4().hex}"


def cells(df: DataFrame, *columns, sep: str = "\t", header: bool = True) -> str:
    """A text file of the columns; returns its path."""
    at = place(df.sparkSession)
    named = df.select(*[F.coalesce(c.cast("string"), F.lit("")).alias(f"h{k}") for k, c in enumerate(columns)])
    named.write.csv(at, sep=sep, header=header, quote="", escape="", emptyValue="", nullValue="")
    return at


def counted(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def join(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


PLAIN = "SELECT upper('p' || p_partkey) source, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE upper('q' || p_size) END target, count(*) n FROM part GROUP BY ALL"


def plain(spark, d):
    target = F.when(F.col("p_size") % 5 == 0, "-").when(F.col("p_size") % 5 == 1, " Unknown ").otherwise(join(" q", F.col("p_size")))
    return table(spark, d, "part").select(join("p", F.col("p_partkey")).alias("a"), target.alias("b"))


@query(PLAIN)
def read_edge_list(spark, d):
    at = cells(plain(spark, d), F.col("a"), F.col("b"))
    return counted(edgelists.READERS["edge_list"](spark, at), "source", "target")


@query(PLAIN)
def read_bioplex(spark, d):
    at = cells(plain(spark, d), F.lit("1"), F.lit("2"), F.col("a"), F.col("b"), F.lit("x"), F.lit("y"), F.lit("0"), F.lit("0"), F.lit("1"))
    return counted(edgelists.READERS["bioplex"](spark, at), "source", "target")


@query("SELECT upper('p' || p_partkey) source, upper('q' || p_size) target, count(*) n FROM part GROUP BY ALL")
def read_sif(spark, d):
    at = cells(table(spark, d, "part"), join("p", F.col("p_partkey")), F.lit("pp"), join("q", F.col("p_size")), sep=" ", header=False)
    return counted(edgelists.READERS["sif"](spark, at), "source", "target")


@query("SELECT upper(unnest(['a' || o_custkey, 'b' || o_custkey])) source, upper('t' || o_orderkey) target, CAST(o_orderkey AS VARCHAR) pubmed, 'MI:' || o_custkey experiment_type FROM orders WHERE o_custkey % 4 > 0")
def read_innate_mitab(spark, d):
    o, cust = F.col("o_orderkey"), F.col("o_custkey")
    gene = F.when(cust % 4 > 0, "ensembl:ENSG1").otherwise("other:1")
    row = [F.lit("x"), F.lit("y"), gene, F.lit("ensembl:ENSG2"), join("uniprotkb:a", cust, "|refseq:NP1|uniprotkb:b", cust, "|uniprotkb:c_HUMAN"), join("uniprotkb:t", o), join('psi-mi:"MI:', cust, '"(two hybrid)'), F.lit("-"), join("pubmed:", o)]
    at = cells(table(spark, d, "orders"), *row, *[F.lit("-")] * 33)
    return edgelists.READERS["innate_mitab"](spark, at).select("source", "target", "pubmed", "experiment_type")


@query("SELECT 'P' || p_partkey source, 'Q' || p_size target, p_size || ',' || (p_size + 1) pubmed, 'MI:1|MI:2,None' experiment_type, count(*) n FROM part GROUP BY ALL")
def read_pina_mitab(spark, d):
    row = [join("uniprotkb:p", F.col("p_partkey")), join("uniprotkb:q", F.col("p_size")), *[F.lit("-")] * 4, F.lit("MI:2(b)|-|mi:1 (a)|MI:2(b)"), F.lit("-"), join("pubmed:", F.col("p_size"), "|pubmed:", F.col("p_size") + 1, "|pubmed:", F.col("p_size"), "|pubmed:", F.col("p_size"))]
    at = cells(table(spark, d, "part"), *row, *[F.lit("-")] * 11)
    return counted(edgelists.READERS["pina_mitab"](spark, at), "source", "target", "pubmed", "experiment_type")


def modified(spark, d):
    sup = F.when(F.col("p_partkey") % 7 == 0, "-").otherwise(join("H", F.col("p_partkey") % 50))
    row = [join("H", F.col("p_size")), F.lit("G"), F.lit("i"), F.lit("r"), F.lit("1"), F.lit("K"), F.lit("E"), sup, F.when(F.col("p_size") % 2 == 0, "Phosphorylation").otherwise("Proteolytic Cleavage"), F.lit("in vivo;in vitro"), join(F.col("p_partkey"), ",", F.col("p_partkey") + 1)]
    return curated.read_modifications(spark, cells(table(spark, d, "part"), *row, header=False))


def xrefs(spark, d):
    s = table(spark, d, "supplier")
    row = [join("H", F.col("s_suppkey")), F.lit("G"), F.lit("-"), F.lit("-"), F.lit("1"), F.lit("2"), join("s", F.col("s_suppkey"), ",t", F.col("s_suppkey")), F.lit("name")]
    return curated.read_xrefs(spark, cells(s, *row, header=False))


@query("SELECT 'H' || p_size substrate_hprd_id, CASE WHEN p_partkey % 7 > 0 THEN 'H' || (p_partkey % 50) END enzyme_hprd_id, 2 n_types, p_partkey || ',' || (p_partkey + 1) refs FROM part")
def read_modifications(spark, d):
    return modified(spark, d).select("substrate_hprd_id", "enzyme_hprd_id", F.size("experiment_type").alias("n_types"), F.array_join("reference_id", ",").alias("refs"))


@query("SELECT 'H' || s_suppkey hprd_id, unnest(['s' || s_suppkey, 't' || s_suppkey]) accession FROM supplier")
def read_xrefs(spark, d):
    return xrefs(spark, d).select("hprd_id", F.explode("swissprot_id").alias("accession"))


@query("""WITH m AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'Phosphorylation' ELSE 'Proteolytic-cleavage' END lb, 's' || (p_partkey % 50) a, 's' || p_size b, p_partkey k FROM part WHERE p_partkey % 7 > 0 AND p_size IN (SELECT s_suppkey FROM supplier) AND p_partkey % 50 IN (SELECT s_suppkey FROM supplier))
 SELECT least(a, b) source, greatest(a, b) target, lb AS label, count(DISTINCT k) + count(DISTINCT CASE WHEN NOT EXISTS (SELECT 1 FROM m y WHERE least(y.a, y.b) = least(m.a, m.b) AND greatest(y.a, y.b) = greatest(m.a, m.b) AND y.lb = m.lb AND y.k = m.k + 1) THEN k END) n_refs FROM m GROUP BY ALL""")
def modification_network(spark, d):
    known = table(spark, d, "supplier").select(F.explode(F.array(join("s", F.col("s_suppkey")), join("t", F.col("s_suppkey")))).alias("uniprot_id"))
    known = known.withColumn("reviewed", F.col("uniprot_id").startswith("s"))
    out = curated.modification_network(modified(spark, d), xrefs(spark, d), known, allow_self_edges=True)
    return out.select("source", "target", "label", F.size(F.split("pubmed", ",")).cast("long").alias("n_refs"))


def pathway(spark, d):
    s = table(spark, d, "supplier")
    entries = s.select((F.col("s_suppkey") % 5).alias("pathway"), F.col("s_suppkey").alias("id"), join("hsa:", F.col("s_suppkey"), " mmu:", F.col("s_suppkey"), " hsa:x", F.col("s_suppkey")).alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "compound").otherwise("gene").alias("type"))
    relations = s.select((F.col("s_suppkey") % 5).alias("pathway"), F.col("s_suppkey").alias("entry1"), (F.col("s_suppkey") + 5).alias("entry2"), F.when(F.col("s_suppkey") % 2 == 0, "binding/association").otherwise("missing interaction").alias("name"), F.when(F.col("s_suppkey") % 11 == 0, "maplink").otherwise("PPrel").alias("link"))
    names = s.select(F.explode(F.array(join("hsa:", F.col("s_suppkey")), join("mmu:", F.col("s_suppkey")))).alias("old"), join("u", F.col("s_suppkey")).alias("new"))
    return entries, relations, names


LINKED = "WITH p AS (SELECT x.s_suppkey a, x.s_suppkey + 5 b, CASE WHEN x.s_suppkey % 2 = 0 THEN 'Binding/association' ELSE 'Missing-interaction' END lb FROM supplier x JOIN supplier y ON y.s_suppkey = x.s_suppkey + 5 WHERE x.s_suppkey % 11 > 0 AND x.s_suppkey % 3 > 0 AND y.s_suppkey % 3 > 0)"


@query(LINKED + " SELECT least('hsa:' || a, 'hsa:' || b) source, greatest('hsa:' || a, 'hsa:' || b) target, lb AS label FROM p")
def pathway_edges(spark, d):
    return curated.pathway_edges(*pathway(spark, d)).select("source", "target", "label")


@query(LINKED + " SELECT least('u' || a, 'u' || b) source, greatest('u' || a, 'u' || b) target, lb AS label FROM p WHERE lb <> 'Missing-interaction'")
def pathway_network(spark, d):
    entries, relations, names = pathway(spark, d)
    known = names.select(F.col("new").alias("uniprot_id")).distinct().withColumn("reviewed", F.lit(True))
    return curated.pathway_network([curated.pathway_edges(entries, relations, names)], names, known).select("source", "target", "label")


@query("SELECT 'u' || s_suppkey AS old, 'hsa:' || s_suppkey AS new FROM supplier")
def invert_names(spark, d):
    return mapping.invert(table(spark, d, "supplier").select(join("up:hsa:", F.col("s_suppkey")).alias("old"), join("u", F.col("s_suppkey")).alias("new")))


def obo(spark, d) -> str:
    """The part graph as an OBO file."""
    p = table(spark, d, "part")
    line = lambda cond, *x: F.when(cond, join(*x, "\n")).otherwise("")
    stanza = F.concat(
        join("[Term]\nid: T:", F.col("p_partkey"), "\nname: ", F.col("p_name"), " ! x\nnamespace: biological_process\n"),
        line(F.col("p_partkey") > 1, "is_a: T:", F.expr("p_partkey div 2"), ' {source="a"} ! parent'), line(F.col("p_partkey") > 2, "relationship: part_of T:", F.expr("p_partkey div 3"), " ! whole"),
        line(F.col("p_partkey") > 3, "relationship: regulates T:1"), line(F.col("p_size") % 9 == 0, "is_obsolete: true"), line(F.col("p_size") % 4 == 0, "alt_id: A:", F.col("p_partkey")),
    )
    text = p.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("p_partkey"), stanza.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    at = place(spark)
    text.select(join("format-version: 1.2\nontology: parts\n\n", F.col("t"))).coalesce(1).write.text(at)
    return at


@query("SELECT 'term' kind, 'T:' || p_partkey a, p_name || ' ! x' b, p_size % 9 = 0 c FROM part UNION ALL SELECT 'is_a', 'T:' || p_partkey, 'T:' || (p_partkey // 2), false FROM part WHERE p_partkey > 1 UNION ALL SELECT 'part_of', 'T:' || p_partkey, 'T:' || (p_partkey // 3), false FROM part WHERE p_partkey > 2 UNION ALL SELECT 'alt', 'A:' || p_partkey, 'T:' || p_partkey, false FROM part WHERE p_size % 4 = 0")
def read_gene_ontology(spark, d):
    terms, edges, alt = ontologies.read_gene_ontology(spark, obo(spark, d))
    out = terms.select(F.lit("term").alias("kind"), F.col("id").alias("a"), F.col("name").alias("b"), F.col("is_obsolete").alias("c"))
    out = out.unionByName(edges.select(F.col("rel").alias("kind"), F.col("child").alias("a"), F.col("parent").alias("b"), F.lit(False).alias("c")))
    return out.unionByName(alt.select(F.lit("alt").alias("kind"), F.col("alt").alias("a"), F.col("id").alias("b"), F.lit(False).alias("c")))


@query("SELECT 'T:' || p_partkey id, p_name || ' ! x' AS name, p_size % 9 = 0 is_obsolete FROM part")
def read_vocabulary(spark, d):
    return ontologies.read_vocabulary(spark, obo(spark, d))[0]


@query("SELECT 'P' || p_partkey uniprot_id, 9606 taxon_id, 'G' || p_size gene_id, 'GO:' || p_size go_mf, 'IPR' || p_partkey || ',IPR' || (p_partkey + 1) interpro, 'Kinase,Membrane' keywords, 'Does ' || p_name || ' well.' AS function, p_size % 2 = 0 reviewed, p_partkey AS last_release FROM part WHERE p_size % 3 > 0")
def read_proteins(spark, d):
    text = join(
        "ID   N", F.col("p_partkey"), "_HUMAN   ", F.when(F.col("p_size") % 2 == 0, "Reviewed").otherwise("Unreviewed"), ";  10 AA.\nAC   P", F.col("p_partkey"), "; Q1;\nDT   12-APR-2017, entry version ", F.col("p_partkey"), ".\nGN   Name=G", F.col("p_size"), " {ECO:1}; Synonyms=A1, A2;\nOX   NCBI_TaxID=",
        F.when(F.col("p_size") % 3 > 0, "9606").otherwise("10090"), ";\nCC   -!- FUNCTION: Does ", F.col("p_name"), "\nCC       well.\nDR   GO; GO:", F.col("p_size"), "; F:x; IEA.\nDR   InterPro; IPR", F.col("p_partkey") + 1, "; a.\nDR   InterPro; IPR", F.col("p_partkey"), "; b.\nKW   Membrane; Kinase {ECO:2}.\n//",
    )
    at = place(spark)
    table(spark, d, "part").select(text).write.text(at)
    out = proteins.read_proteins(spark, at, 9606)
    number = F.transform(F.array_sort(F.transform(F.split("interpro", ","), lambda x: F.substring(x, 4, 20).cast("long"))), lambda n: F.concat(F.lit("IPR"), n))
    return out.select("uniprot_id", "taxon_id", "gene_id", "go_mf", F.array_join(number, ",").alias("interpro"), "keywords", F.regexp_replace("function", r"\s+", " ").alias("function"), "reviewed", "last_release")


@query("SELECT 'IPR' || p_partkey id, p_name AS name FROM part")
def read_names(spark, d):
    return files.read_names(spark, cells(table(spark, d, "part"), join("ipr", F.col("p_partkey")), F.lit("x"), F.col("p_name"), header=False))


@query("SELECT 'A' || p_partkey source, 'B' || p_size target, CASE WHEN p_size % 2 = 0 THEN p_brand END AS label FROM part")
def saved_network(spark, d):
    at = place(spark)
    edgelists.save_network(table(spark, d, "part").select(join("A", F.col("p_partkey")).alias("source"), join("B", F.col("p_size")).alias("target"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("label")), at)
    return edgelists.load_network(spark, at)


@query("SELECT 's' || s_nationkey AS old, 'u' || s_suppkey AS new FROM supplier")
def saved_map(spark, d):
    at = place(spark)
    files.write_map(table(spark, d, "supplier").select(join("s", F.col("s_nationkey")).alias("old"), join("u", F.col("s_suppkey")).alias("new")), at)
    return files.read_saved_map(spark, at)


@query("SELECT CASE WHEN p_size % 2 = 0 THEN '1' ELSE '0' END || ',' || len(regexp_extract_all(p_name, '\\bred\\b')) || ',' || len(regexp_extract_all(p_name, '\\bblue\\b')) AS line, count(*) n FROM part GROUP BY ALL UNION ALL SELECT unnest(['@ATTRIBUTE even {0,1}', '@ATTRIBUTE red NUMERIC', '@ATTRIBUTE blue NUMERIC']), 1")
def arff(spark, d):
    at = place(spark)
    rows = table(spark, d, "part").withColumn("label", F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd"))
    files.write_arff(rows, at, ["even"], ["p_name"], ["red", "blue"])
    lines = spark.read.text(at).where("value rlike '^(@ATTRIBUTE|[0-9])'")
    return counted(lines.select(F.col("value").alias("line")), "line")


def stored(spark, d) -> store.Store:
    """Orders as interactions, customers as proteins."""
    s = store.Store(spark, place(spark))
    s.create()
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    label = F.when(o % 3 == 0, "Activation,Binding").when(o % 3 == 1, "Inhibition")
    s.write("interaction", table(spark, d, "orders").select(join("O", o).alias("source"), join("P", c).alias("target"), (o % 4).cast("int").alias("taxon_id"), (o % 2 == 0).alias("is_training"), (o % 5 == 0).alias("is_holdout"), (o % 7 == 0).alias("is_interactome"), label.alias("label")))
    s.write("protein", table(spark, d, "customer").select(join("P", F.col("c_custkey")).alias("uniprot_id"), (F.col("c_nationkey") % 2).cast("int").alias("taxon_id"), (F.col("c_acctbal") > 0).alias("reviewed"), F.col("c_mktsegment").alias("gene_id")))
    return s


@query("""WITH t AS (SELECT o_orderkey o, o_custkey c FROM orders) SELECT 'training' AS part, count(*) n, CAST(sum(o) AS BIGINT) s FROM t WHERE o % 2 = 0 UNION ALL SELECT 'strict training', count(*), CAST(sum(o) AS BIGINT) FROM t WHERE o % 2 = 0 AND o % 5 > 0 UNION ALL SELECT 'strict holdout', count(*), CAST(sum(o) AS BIGINT) FROM t WHERE o % 2 > 0 AND o % 5 = 0
 UNION ALL SELECT 'labelled', count(*), CAST(sum(o) AS BIGINT) FROM t WHERE o % 2 = 0 OR o % 5 = 0 UNION ALL SELECT 'interactome', count(*), CAST(sum(o) AS BIGINT) FROM t WHERE o % 7 = 0 UNION ALL SELECT 'taxon', count(*), CAST(sum(o) AS BIGINT) FROM t WHERE o % 4 = 3 UNION ALL SELECT 'protein', count(*), CAST(sum(o) AS BIGINT) FROM t WHERE c = 7 OR o = 7
 UNION ALL SELECT 'pair', count(*), CAST(sum(o) AS BIGINT) FROM t WHERE (o, c) = (SELECT (o, c) FROM t ORDER BY o, c LIMIT 1) UNION ALL SELECT 'label', count(*), CAST(sum(o) AS BIGINT) FROM t WHERE o % 3 = 0 UNION ALL SELECT 'substring', count(*), CAST(sum(o) AS BIGINT) FROM t WHERE o % 3 < 2""")
def store_predicates(spark, d):
    rows = stored(spark, d).read("interaction")
    first = table(spark, d, "orders").orderBy("o_orderkey", "o_custkey").select("o_orderkey", "o_custkey").first()
    parts = {
        "training": store.training(rows), "strict training": store.training(rows, True), "strict holdout": store.holdout(rows, True), "labelled": store.labelled_network(rows), "interactome": store.interactome(rows), "taxon": store.of_taxon(rows, 3),
        "protein": store.by_protein(rows, "P7").unionByName(store.by_protein(rows, "O7")), "pair": store.by_pair(rows, f"P{first[1]}", f"O{first[0]}"), "label": store.by_label(rows, "binding"), "substring": store.by_label(rows, "I", True),
    }
    out = [df.agg(F.lit(k).alias("part"), F.count("*").alias("n"), F.sum(F.substring("source", 2, 20).cast("long")).alias("s")) for k, df in parts.items()]
    for df in out[1:]:
        out[0] = out[0].unionByName(df)
    return out[0]


@query("SELECT c_mktsegment gene_id, count(*) n FROM customer WHERE c_acctbal > 0 GROUP BY ALL")
def store_scan(spark, d):
    return counted(stored(spark, d).read("protein").where("reviewed"), "gene_id")


@query("SELECT 'P' || o_custkey uniprot_id, CASE WHEN c_nationkey % 2 = 1 THEN c_mktsegment END gene_id, count(*) n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def lookup_proteins(spark, d):
    wanted = table(spark, d, "orders").select(join("P", F.col("o_custkey")).alias("uniprot_id"))
    return counted(mapping.lookup_proteins(wanted, stored(spark, d).read("protein"), 1), "uniprot_id", "gene_id")


@query("SELECT 'O' || o_orderkey source, 'P' || o_custkey target, CASE WHEN o_orderkey % 4 = 1 THEN CASE o_orderkey % 3 WHEN 0 THEN 'Activation,Binding' WHEN 1 THEN 'Inhibition' END END AS label FROM orders")
def lookup_interactions(spark, d):
    pairs = table(spark, d, "orders").select(join("O", F.col("o_orderkey")).alias("source"), join("P", F.col("o_custkey")).alias("target"))
    return mapping.lookup_interactions(pairs, stored(spark, d).read("interaction"), 1).select("source", "target", "label")


@query("SELECT n_name, x.s AS last_supplier FROM nation LEFT JOIN (SELECT s_nationkey k, 's' || max(s_suppkey) s FROM supplier GROUP BY 1) x ON n_nationkey = k")
def enrich_names(spark, d):
    names = table(spark, d, "supplier").select(join("s", F.col("s_suppkey")).alias("old"), F.col("s_nationkey").alias("new"), F.col("s_suppkey").alias(E.ORDER))
    out = mapping.enrich(table(spark, d, "nation"), "n_nationkey", mapping.reverse_last(names), "new", "old", "last_supplier")
    return out.select("n_name", "last_supplier")


@query("SELECT p_brand AS key FROM part GROUP BY p_brand HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return store.duplicates(table(spark, d, "part"), "p_brand").withColumnRenamed("p_brand", "key")


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct([upper(p_type[1:1]) || lower(p_type[2:]), upper(p_brand[1:1]) || lower(p_brand[2:])])), ',') words, nullif(trim(CASE WHEN p_size % 2 = 0 THEN '  ' ELSE ' ' || p_name END), '') AS text, CASE WHEN p_size % 3 > 0 THEN upper(p_brand) END accession FROM part")
def cell_rules(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", T.keywords(F.concat_ws(" , ", "p_type", "p_brand", "p_type", F.lit(""))).alias("words"), T.text_or_null(F.when(F.col("p_size") % 2 == 0, "  ").otherwise(join(" ", F.col("p_name")))).alias("text"), T.valid_accession(F.when(F.col("p_size") % 3 > 0, join(" ", F.lower("p_brand"))).otherwise(" ")).alias("accession"))


@query("SELECT p_partkey, pmid, psimis, p_size % 2 = 0 aligned FROM (SELECT p_partkey, p_size, unnest([CAST(p_partkey AS VARCHAR), CAST(p_size AS VARCHAR)]) pmid, unnest(['MI:1|MI:2', CASE WHEN p_size % 2 = 0 THEN '' ELSE '' END]) psimis FROM part)")
def references(spark, d):
    p = table(spark, d, "part")
    pmids, groups = F.concat_ws(",", F.col("p_partkey").cast("string"), F.col("p_size").cast("string")), F.when(F.col("p_size") % 2 == 0, "mi:1| MI:2,None").otherwise("MI:1|mi:2")
    rows = p.select("p_partkey", F.explode(T.references(pmids, groups)).alias("r"), T.references_aligned(pmids, groups).alias("aligned"))
    return rows.select("p_partkey", F.col("r.pmid").alias("pmid"), F.array_join("r.psimis", "|").alias("psimis"), "aligned")


@query("SELECT 'A' || p_partkey || '-B' || p_size AS pair, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 0 END n_labels FROM part")
def pairs_and_labels(spark, d):
    rows = table(spark, d, "part").select(join("A", F.col("p_partkey")).alias("source"), join("B", F.col("p_size")).alias("target"), F.when(F.col("p_size") % 2 == 0, "x, y").otherwise("-").alias("label"))
    return E.pairs_and_labels(rows).select(F.array_join("pair", "-").alias("pair"), F.size("labels").alias("n_labels"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS name, row_number() OVER (ORDER BY f, p_partkey) - 1 AS place FROM (SELECT p_partkey, 1 f FROM part UNION ALL SELECT p_partkey, 2 FROM part) ORDER BY place LIMIT 50")
def concat_in_order(spark, d):
    """A top-k: the first fifty rows of two frames that follow each other."""
    one = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_partkey").cast("long").alias(E.ORDER))
    both = E.concat([one, one]).orderBy(E.ORDER).limit(50)
    return both.select("name", (F.row_number().over(Window.orderBy(E.ORDER)) - 1).cast("long").alias("place"))


TERMS = "WITH t AS (SELECT 'T:' || p_partkey id, p_size % 9 = 0 obs, p_partkey k, p_size z FROM part)"


@query(TERMS + " SELECT l_orderkey, 'T:' || l_partkey AS term, count(*) n FROM lineitem JOIN t ON t.k = l_partkey AND NOT obs GROUP BY ALL")
def without_obsolete(spark, d):
    """Alternative ids first, then rows of known terms that are in use."""
    p = table(spark, d, "part")
    terms = p.select(join("T:", F.col("p_partkey")).alias("id"), (F.col("p_size") % 9 == 0).alias("is_obsolete"))
    alt = p.where(F.col("p_size") % 4 == 0).select(join("A:", F.col("p_partkey")).alias("alt"), join("T:", F.col("p_partkey")).alias("id"))
    named = table(spark, d, "lineitem").join(p.select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    rows = named.select("l_orderkey", F.when(F.col("p_size") % 4 == 0, join("A:", F.col("l_partkey"))).otherwise(join("T:", F.col("l_partkey"))).alias("term"))
    return counted(ontology.without_obsolete(ontology.canonical_ids(rows, "term", alt), "term", terms), "l_orderkey", "term")


@query(DAG + ", q AS (SELECT p_partkey t, p_partkey // 4 a FROM part) SELECT q.t AS term, q.a AS ancestor, an.t IS NOT NULL AS found, (SELECT count(DISTINCT p) FROM g WHERE g.c = q.t) n_parents FROM q LEFT JOIN an ON an.t = q.t AND an.a = q.a")
def ancestry(spark, d):
    p, edges = table(spark, d, "part"), dag(spark, d)
    asked = ontology.reaches(p.select(F.col("p_partkey").alias("term"), F.expr("p_partkey div 4").alias("ancestor")), edges, cut(ontology.levels(edges)))
    up = ontology.parents(edges, p.select(F.col("p_partkey").alias("id"))).groupBy("child").agg(F.count("*").alias("n"))
    return asked.join(up, F.col("term") == F.col("child"), "left").select("term", "ancestor", "found", F.coalesce("n", F.lit(0)).alias("n_parents"))


@query("""WITH s AS (SELECT s_suppkey k, 'S' || s_suppkey id, 'T:' || (s_suppkey % 7 + 1) mf, 'IPR' || (s_suppkey % 3) ip FROM supplier), p AS (SELECT DISTINCT s_suppkey a, s_suppkey * 7 % (SELECT count(*) FROM supplier) b FROM supplier)
 SELECT 'S' || a source, 'S' || b target, array_to_string(list_sort([x.mf, y.mf]), ',') go_mf, array_to_string(list_sort([x.ip, y.ip]), ',') interpro FROM p JOIN s x ON x.k = a JOIN s y ON y.k = b""")
def pair_features(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "supplier").count()
    empty = {c: F.lit(None).cast("string") for c in features.BAGS}
    people = s.select(join("S", F.col("s_suppkey")).alias("uniprot_id"), *[x.alias(c) for c, x in (empty | {"go_mf": join("T:", F.col("s_suppkey") % 7 + 1), "interpro": join("IPR", F.col("s_suppkey") % 3)}).items()])
    edges = spark.range(2, 9).select(join("T:", F.col("id")).alias("child"), join("T:", F.expr("id div 2")).alias("parent"), F.lit("is_a").alias("rel"))
    terms = spark.range(1, 9).select(join("T:", F.col("id")).alias("id"), F.lit("molecular_function").alias("namespace"))
    paths = ontology.closure(edges)
    pairs = s.select(join("S", F.col("s_suppkey")).alias("source"), join("S", F.col("s_suppkey") * 7 % n).alias("target"))
    return features.pair_features(pairs, people, terms, paths, ontology.depths(terms, paths)).select("source", "target", "go_mf", "interpro")


BOTH = "WITH e AS (SELECT DISTINCT 'P' || l_partkey s, 'S' || l_suppkey t, l_returnflag f FROM lineitem)"


@query(BOTH + " SELECT 'edges of method' direction, count(DISTINCT (s, t)) n FROM e WHERE f = 'R' UNION ALL SELECT 'methods of edge', count(DISTINCT f) FROM e WHERE s = 'P1' UNION ALL SELECT 'publications of edge', count(DISTINCT t) FROM e WHERE s = 'P1' UNION ALL SELECT 'edges of publication', count(DISTINCT s) FROM e WHERE t = 'S1' UNION ALL SELECT 'methods of publication', count(DISTINCT f) FROM e WHERE t = 'S1'")
def link_directions(spark, d):
    """Edges, publications and methods through the links, every way."""
    line = table(spark, d, "lineitem").select(join("P", F.col("l_partkey")).alias("source"), join("S", F.col("l_suppkey")).alias("target"), join("S", F.col("l_suppkey")).alias("pubmed"), F.col("l_returnflag").alias("experiment_type"))
    links = store.reference_links(line)
    asked = {
        "edges of method": ("psimi = 'R'", ["psimi"], ["source", "target"]), "methods of edge": ("source = 'P1'", ["source", "target"], ["psimi"]), "publications of edge": ("source = 'P1'", ["source", "target"], ["pubmed"]),
        "edges of publication": ("pubmed = 'S1'", ["pubmed"], ["source", "target"]), "methods of publication": ("pubmed = 'S1'", ["pubmed"], ["psimi"]),
    }
    out = None
    for name, (which, have, want) in asked.items():
        one = store.linked(links, links.where(which), have, want).agg(F.lit(name).alias("direction"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH t AS (SELECT CAST(l_discount > 0.05 AS INTEGER) y1, CAST(l_quantity > 25 AS INTEGER) y2, CAST(l_tax > 0.04 AS INTEGER) p1, CAST(l_linenumber > 3 AS INTEGER) p2 FROM lineitem)
 SELECT round(avg(CASE WHEN y1 + y2 + p1 + p2 > 0 THEN 2 * (y1 * p1 + y2 * p2) / (y1 + y2 + p1 + p2) ELSE 0 END), 6) samples_f1, round(avg(CASE WHEN y1 = 1 AND y2 = 0 AND p2 >= p1 OR y1 = 0 AND y2 = 1 AND p1 >= p2 THEN 1.0 ELSE 0.0 END), 6) ranking_loss FROM t""")
def ranking_metrics(spark, d):
    flag = lambda c: c.cast("int")
    rows = table(spark, d, "lineitem").select(F.array(flag(F.col("l_discount") > 0.05), flag(F.col("l_quantity") > 25)).alias("y"), F.array(flag(F.col("l_tax") > 0.04), flag(F.col("l_linenumber") > 3)).alias("p"))
    return rows.agg(F.round(metrics.samples_f1(F.col("y"), F.col("p")), 6).alias("samples_f1"), F.round(metrics.ranking_loss(F.col("y"), F.col("p")), 6).alias("ranking_loss"))


@query("SELECT label, CAST(n // 3 AS BIGINT) least, CAST((n + 2) // 3 AS BIGINT) most, n FROM (SELECT o_orderpriority AS label, count(*) n FROM orders GROUP BY ALL)")
def fold_balance(spark, d):
    """Rows of each label in its smallest and largest fold: never more than one apart."""
    rows = table(spark, d, "orders").withColumn("labels", F.array("o_orderpriority"))
    dealt = counted(folds.stratified_folds(rows, "labels", "o_orderkey", 3, seed=1), "o_orderpriority", "fold")
    return dealt.groupBy(F.col("o_orderpriority").alias("label")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("n"))


@query("SELECT unnest(['BernoulliNB', 'DecisionTreeClassifier', 'GaussianNB', 'KNeighborsClassifier', 'LogisticRegression', 'MultinomialNB', 'RandomForestClassifier']) AS algorithm")
def classifiers(spark, d):
    """Algorithms that can be made with each draw of their grid's first choices."""
    made = [(a,) for a in models.supported() if models.make_classifier(a, **{k: v[0] for k, v in models.GRIDS[a].items()}) is not None]
    return spark.createDataFrame(made, "algorithm string")


@query("SELECT 'P' || l_partkey source, 'S' || l_suppkey target, count(*) n, true in_training FROM lineitem GROUP BY ALL")
def marked_edges(spark, d):
    """The edge half of a sub-network with all edges known: each is marked."""
    rows = table(spark, d, "lineitem").select(join("P", F.col("l_partkey")).alias("protein_a"), join("S", F.col("l_suppkey")).alias("protein_b")).withColumns({"gene_a": F.lit("g"), "gene_b": F.lit("h"), "Binding-pr": F.lit(0.9), "max-pr": F.lit(0.9)})
    known = rows.select(F.col("protein_a").alias("source"), F.col("protein_b").alias("target")).distinct().withColumn("label", F.lit("Binding"))
    table_ = network.induce(network.by_label(rows, "Binding", 0.5), known, "Binding")[1]
    return table_.groupBy("source", "target").agg(F.count("*").alias("n"), F.bool_and("edge_in_training").alias("in_training"))
