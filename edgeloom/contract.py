"""Queries of the library's operators over the driver's tables, with DuckDB oracles.

The driver's tables hold no proteins, so nations, suppliers, parts and orders play
their roles: an edge joins a supplier's nation to a customer's, its label is the
order's priority, its reference the order, its method the line's flags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .ml import folds, metrics, models
from .operators import edges as E
from .operators import features, mapping, network, ontology, reports, store
from .operators.iterate import cut

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Supplier nation - customer nation edges with an order."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    side = lambda c, k: n.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(c))
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(side("source", "k1"), F.col("s_nationkey") == F.col("k1")).join(side("target", "k2"), F.col("c_nationkey") == F.col("k2"))
    return rows.select(
        "source", "target", F.col("o_orderpriority").alias("label"), F.col("l_orderkey").cast("string").alias("pubmed"),
        F.concat("l_returnflag", "l_linestatus").alias("experiment_type"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias(E.ORDER),
    )


def frame(spark: SparkSession, d: str) -> DataFrame:
    return E.edge_frame(edges(spark, d), pubmed="pubmed", experiment_type="experiment_type")


RAW = """WITH raw AS (SELECT sn.n_name a, cn.n_name b, o.o_orderpriority lb, CAST(l.l_orderkey AS VARCHAR) pubmed, l.l_returnflag || l.l_linestatus experiment_type,
 l.l_orderkey ok, l.l_linenumber ln, l.l_partkey pk, l.l_suppkey sk
 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
 JOIN nation sn ON s.s_nationkey = sn.n_nationkey JOIN nation cn ON c.c_nationkey = cn.n_nationkey),
 e AS (SELECT least(a, b) source, greatest(a, b) target, replace(upper(lb[1:1]) || lower(lb[2:]), ' ', '-') AS label, pubmed, experiment_type, ok, ln, pk, sk FROM raw)"""
#: Edge and label with references in first-seen order, from a relation r.
DEDUPED = """ p AS (SELECT source, target, label, pubmed, min(ok) o, array_to_string(list_sort(list_distinct(list(upper(experiment_type)))), '|') g FROM r GROUP BY ALL),
 d AS (SELECT source, target, label, string_agg(pubmed, ',' ORDER BY o) pubmed, string_agg(g, ',' ORDER BY o) experiment_type FROM p GROUP BY source, target, label)"""
#: The same per edge, labels united.
MERGED = """ q AS (SELECT source, target, pubmed, min(ok) o, array_to_string(list_sort(list_distinct(list(upper(experiment_type)))), '|') g FROM r2 GROUP BY ALL),
 lb2 AS (SELECT source, target, array_to_string(list_sort(list_distinct(list(label))), ',') AS label FROM r2 GROUP BY source, target),
 m AS (SELECT source, target, string_agg(pubmed, ',' ORDER BY o) pubmed, string_agg(g, ',' ORDER BY o) experiment_type FROM q GROUP BY source, target)"""

CELLS = "WITH t AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN ' - ' WHEN 1 THEN 'unknown' WHEN 2 THEN 'Unknown' WHEN 3 THEN '' ELSE ' ' || p_brand END cell FROM part)"


def cells(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 6
    cell = F.when(k == 0, " - ").when(k == 1, "unknown").when(k == 2, "Unknown").when(k == 3, "").otherwise(F.concat(F.lit(" "), "p_brand"))
    return table(spark, d, "part").select("p_partkey", cell.alias("cell"))


@query(CELLS + " SELECT p_partkey, CASE WHEN trim(cell) IN ('', 'None', 'NaN', 'none', 'nan', '-', 'unknown') THEN NULL ELSE cell END cell FROM t")
def null_normalise(spark, d):
    return cells(spark, d).withColumn("cell", T.null_of(F.col("cell")))


@query(CELLS + " SELECT p_partkey, CASE WHEN lower(trim(cell)) IN ('', '-', 'unknown') THEN NULL ELSE upper(trim(cell)) END accession FROM t")
def accession_clean(spark, d):
    return cells(spark, d).select("p_partkey", T.clean_accession(F.col("cell")).alias("accession"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct([replace(upper(p_type[1:1]) || lower(p_type[2:]), ' ', '-'), replace(upper(p_brand[1:1]) || lower(p_brand[2:]), ' ', '-')])), ',') labels FROM part")
def label_format(spark, d):
    return table(spark, d, "part").select("p_partkey", T.format_labels(F.concat_ws(", ", "p_type", "p_brand", F.lit(" - "), "p_type")).alias("labels"))


@query("SELECT p_partkey, array_to_string(list_sort(['GO:' || lpad(CAST(p_size AS VARCHAR), 4, '0'), 'IPR' || p_partkey, 'IPR' || p_partkey]), ',') terms, array_to_string(list_sort(list_distinct(['GO:' || lpad(CAST(p_size AS VARCHAR), 4, '0'), 'IPR' || p_partkey])), ',') unique_terms, p_size % 2 = 0 AS valid FROM part")
def annotations(spark, d):
    go = F.concat(F.lit("go:"), F.lpad(F.col("p_size").cast("string"), 4, "0"))
    ipr = F.concat(F.lit("ipr"), "p_partkey")
    cell = F.concat_ws(" , ", go, ipr, F.lit(""), ipr)
    other = F.concat_ws(",", cell, F.when(F.col("p_size") % 2 != 0, "XX1"))
    return table(spark, d, "part").select("p_partkey", T.annotations(cell, False).alias("terms"), T.annotations(cell, True).alias("unique_terms"), T.annotations_valid(other).alias("valid"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'GO:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') ELSE 'IPR' || p_partkey END term FROM part")
def rename_terms(spark, d):
    term = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("go"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"))).otherwise(F.concat(F.lit("ipr"), "p_partkey"))
    return table(spark, d, "part").select("p_partkey", T.rename_term(term).alias("term"))


@query("SELECT o_orderkey, least(o_orderkey, o_custkey) || ',' || greatest(o_orderkey, o_custkey) joint_id FROM orders")
def joint_id(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.joint_id(F.col("o_orderkey"), F.col("o_custkey")).alias("joint_id"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 7 = 0 THEN true ELSE date_trunc('day', o_orderdate) < TIMESTAMP '1996-01-01' END AS outdated FROM orders")
def outdated(spark, d):
    text = F.when(F.col("o_orderkey") % 7 != 0, F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy")))
    day = T.update_date(text)
    return table(spark, d, "orders").select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("day"), T.outdated(day, F.lit("1996-01-01").cast("timestamp")).alias("outdated"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct([p_type[1:1] || lower(p_type[2:]), 'Novel'])), ',') added, CASE WHEN p_size % 2 = 0 THEN NULL ELSE upper(p_type[1:1]) || lower(p_type[2:]) END removed FROM part")
def label_algebra(spark, d):
    own = T.store_labels(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", T.add_labels(own, F.lit("novel")).alias("added"), T.drop_labels(own, F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lit("novel"))).alias("removed"))


@query(RAW + " SELECT source, target, label, pubmed, experiment_type, count(*) n FROM e GROUP BY ALL")
def edge_canonicalise(spark, d):
    return frame(spark, d).groupBy(*E.COLUMNS).agg(F.count("*").alias("n"))


@query(RAW + " SELECT source, target, label, count(*) n FROM e WHERE source <> target GROUP BY ALL")
def remove_self_edges(spark, d):
    return E.remove_self_edges(frame(spark, d)).groupBy("source", "target", "label").agg(F.count("*").alias("n"))


@query(RAW + " SELECT source, target, label, count(*) n FROM (SELECT source, target, CASE WHEN ln % 2 = 0 THEN label END AS label FROM e) WHERE label IS NOT NULL GROUP BY ALL")
def remove_nulls(spark, d):
    rows = frame(spark, d).withColumn("label", F.when(F.col(E.ORDER) % 2 == 0, F.col("label")).otherwise(" None "))
    return E.remove_nulls(rows).groupBy("source", "target", "label").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN p_size % 2 = 0 THEN array_to_string(list_sort(['Aa', upper(p_type[1:1]) || replace(lower(p_type[2:]), ' ', '-')]), ',') ELSE 'Aa' END AS label, count(*) n FROM part WHERE p_size % 2 = 0 GROUP BY ALL")
def exclude_labels(spark, d):
    """A whole cell is compared: cells that hold an excluded label among others stay."""
    cell = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("aa,"), "p_type")).when(F.col("p_size") % 3 > 0, "aa")
    rows = E.edge_frame(table(spark, d, "part").select(F.col("p_brand").alias("source"), F.col("p_name").alias("target"), cell.alias("label")))
    return E.remove_labels(rows, ["Aa", None]).groupBy("label").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END a, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name END b FROM part), c AS (SELECT least(coalesce(a, 'None'), coalesce(b, 'None')) lo, greatest(coalesce(a, 'None'), coalesce(b, 'None')) hi FROM p) SELECT nullif(lo, 'None') source, nullif(hi, 'None') target, count(*) n FROM c GROUP BY ALL")
def canonical_missing_ends(spark, d):
    p = table(spark, d, "part").select(F.when(F.col("p_size") % 3 > 0, F.col("p_brand")).otherwise(" - ").alias("source"), F.when(F.col("p_size") % 5 > 0, F.col("p_name")).alias("target"))
    ends = E.edge_frame(p.withColumn("source", T.null_of(F.col("source"))), label=None)
    return ends.groupBy("source", "target").agg(F.count("*").alias("n"))


@query(RAW + ", c AS (SELECT source, count(*) n FROM e GROUP BY source) SELECT source AS label, n FROM c WHERE n >= (SELECT avg(n) FROM c)")
def min_label_count(spark, d):
    rows = frame(spark, d).withColumn("label", F.col("source"))
    least = rows.groupBy("label").count().agg(F.ceil(F.avg("count"))).first()[0]
    return E.remove_rare_labels(rows, least).groupBy("label").agg(F.count("*").alias("n"))


@query(RAW + ", r AS (SELECT * FROM e)," + DEDUPED + " SELECT source, target, label, pubmed, experiment_type FROM d")
def dedupe_refs(spark, d):
    return E.remove_duplicates(frame(spark, d)).drop(E.ORDER)


@query(RAW + ", r2 AS (SELECT * FROM e)," + MERGED + " SELECT m.source, m.target, label, pubmed, experiment_type FROM m JOIN lb2 ON m.source = lb2.source AND m.target = lb2.target")
def merge_labels(spark, d):
    return E.merge_labels(frame(spark, d)).drop(E.ORDER)


@query(
    RAW + ", r AS (SELECT * FROM e WHERE source <> target)," + DEDUPED + """, k AS (SELECT label FROM d WHERE label NOT IN ('5-low') GROUP BY label HAVING count(*) >= 5),
 f1 AS (SELECT source, target, label, min(ok) f FROM r GROUP BY ALL),
 r2 AS (SELECT r.source, r.target, r.label, r.pubmed, r.experiment_type, row(f, ok) ok FROM r JOIN k ON r.label = k.label JOIN f1 ON r.source = f1.source AND r.target = f1.target AND r.label = f1.label),""" + MERGED + " SELECT m.source, m.target, label, pubmed, experiment_type FROM m JOIN lb2 ON m.source = lb2.source AND m.target = lb2.target"
)
def process_pipeline(spark, d):
    return E.process(frame(spark, d), exclude_labels=["5-low"], min_counts=5, merge=True).drop(E.ORDER)


ORDER_EDGES = "WITH e AS (SELECT 'o' || o_orderkey a, 'o' || o_custkey b, o_orderpriority AS label FROM orders), n AS (SELECT DISTINCT 'o' || l_orderkey old, 's' || l_suppkey AS new FROM lineitem)"


@query(ORDER_EDGES + " SELECT least(x.new, y.new) source, greatest(x.new, y.new) target, count(*) n FROM e JOIN n x ON e.a = x.old JOIN n y ON e.b = y.old GROUP BY ALL")
def map_accessions(spark, d):
    e = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("source"), F.concat(F.lit("o"), "o_custkey").alias("target"), F.col("o_orderpriority").alias("label"), F.lit(None).cast("string").alias("pubmed"), F.lit(None).cast("string").alias("experiment_type"))
    names = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("old"), F.concat(F.lit("s"), "l_suppkey").alias("new")).distinct()
    return mapping.map_edges(e, names).groupBy("source", "target").agg(F.count("*").alias("n"))


def suppliers(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.concat(F.lit("s"), "s_suppkey").alias("uniprot_id"), (F.col("s_nationkey") % 2).alias("taxon_id"), (F.col("s_acctbal") > 0).alias("reviewed"), F.concat(F.lit("n"), F.col("s_nationkey") % 7).alias("old"))


@query("WITH s AS (SELECT 's' || s_suppkey AS new, s_acctbal > 0 r, 'n' || (s_nationkey % 7) old FROM supplier), b AS (SELECT old, bool_or(r) y FROM s GROUP BY old) SELECT s.old, new FROM s JOIN b ON s.old = b.old WHERE r OR NOT y")
def priority_map(spark, d):
    s = suppliers(spark, d)
    return mapping.preferred(s.select("old", F.col("uniprot_id").alias("new")), s.drop("old"), unreviewed=True)


@query("SELECT l_orderkey, CASE WHEN s_acctbal > 0 THEN 's' || l_suppkey END accession, count(*) n FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def left_lookup_null_out(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("s"), "l_suppkey").alias("accession"))
    return mapping.null_unless_reviewed(rows, "accession", suppliers(spark, d)).groupBy("l_orderkey", "accession").agg(F.count("*").alias("n"))


@query("WITH w AS (SELECT DISTINCT 'n' || n_nationkey old FROM nation), f AS (SELECT 'n' || (s_nationkey % 7) old, list_sort(list('s' || s_suppkey)) x FROM supplier WHERE s_nationkey % 2 = 1 GROUP BY 1) SELECT w.old, coalesce(array_to_string(x, ','), '') AS new FROM w LEFT JOIN f ON w.old = f.old")
def batch_map(spark, d):
    s = suppliers(spark, d)
    wanted = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("old"))
    return mapping.batch_map(wanted, s.select("old", F.col("uniprot_id").alias("new")), s.drop("old"), taxon_id=1).withColumn("new", F.array_join("new", ","))


SPLIT = "WITH e AS (SELECT DISTINCT 'C' || o_custkey source, 'S' || l_suppkey target, replace(upper(o_orderpriority[1:1]) || lower(o_orderpriority[2:]), ' ', '-') AS label, l_returnflag = 'R' returned FROM lineitem JOIN orders ON l_orderkey = o_orderkey), a AS (SELECT source, target, label FROM e WHERE returned), b AS (SELECT source, target, label FROM e WHERE NOT returned)"


@query(SPLIT + " SELECT 'first' AS part, * FROM a ANTI JOIN b USING (source, target) UNION ALL SELECT 'second', * FROM b ANTI JOIN a USING (source, target) UNION ALL SELECT 'common', * FROM a SEMI JOIN b USING (source, target) UNION ALL SELECT 'common', * FROM b SEMI JOIN a USING (source, target)")
def split_common(spark, d):
    """Supplier-customer edges with returned lines against those with others."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = E.edge_frame(rows.select(F.concat(F.lit("S"), "l_suppkey").alias("source"), F.concat(F.lit("C"), "o_custkey").alias("target"), F.col("o_orderpriority").alias("label"), "l_returnflag"), experiment_type="l_returnflag")
    back = F.col("experiment_type") == "R"
    first, second, common = E.remove_common(*[rows.where(x).select("source", "target", "label").distinct() for x in (back, ~back)])
    return first.withColumn("part", F.lit("first")).unionByName(second.withColumn("part", F.lit("second"))).unionByName(common.withColumn("part", F.lit("common")))


@query("""WITH p AS (SELECT DISTINCT least('C' || o_custkey, 'C' || o_orderkey) source, greatest('C' || o_custkey, 'C' || o_orderkey) target FROM orders),
 g AS (SELECT 'C' || c_custkey id FROM customer WHERE c_nationkey % 2 = 0), v AS (SELECT p.*, source IN (SELECT id FROM g) AND target IN (SELECT id FROM g) ok, length(source) = length(target) AS known FROM p)
 SELECT source, target, CASE WHEN NOT ok THEN 'invalid' WHEN known THEN 'existing' ELSE 'missing' END status FROM v""")
def get_or_create_split(spark, d):
    pairs = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit(" C"), "o_orderkey").alias("target"))
    proteins = table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("uniprot_id"), (F.col("c_nationkey") % 2).alias("taxon_id"))
    a, b = E.canonical(F.upper("source"), F.upper(T.strip(F.col("target"))))
    known = pairs.select(a.alias("source"), b.alias("target")).distinct().where("length(source) = length(target)")
    parts = zip(store.resolve(pairs, proteins, known, taxon_id=0), ("existing", "missing", "invalid"), strict=True)
    rows = [x.select("source", "target", F.lit(s).alias("status")) for x, s in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("""WITH o AS (SELECT 'P' || p_partkey accession, p_name description FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT 'P' || p_partkey accession, CASE WHEN p_size % 2 = 0 THEN p_type END description FROM part WHERE p_partkey % 3 <> 1)
 SELECT coalesce(o.accession, n.accession) accession, coalesce(n.description, o.description) description, CASE WHEN o.accession IS NULL THEN 'new' WHEN n.accession IS NULL THEN 'kept' ELSE 'updated' END AS change FROM o FULL JOIN n ON o.accession = n.accession""")
def upsert(spark, d):
    p = table(spark, d, "part").withColumn("accession", F.concat(F.lit("P"), "p_partkey"))
    old = p.where("p_partkey % 3 <> 0").select("accession", F.col("p_name").alias("description"))
    new = p.where("p_partkey % 3 <> 1").select("accession", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("description"))
    return store.upsert(old, new, "accession")


@query(RAW + """, s AS (SELECT DISTINCT source, target, label, ok % 4 k FROM e), r AS (SELECT DISTINCT source, target, ok % 4 k, pubmed, experiment_type g FROM e),
 p AS (SELECT source, target, string_agg(pubmed, ',' ORDER BY k, pubmed, g) pubmed, string_agg(g, ',' ORDER BY k, pubmed, g) experiment_type FROM r GROUP BY source, target)
 SELECT s.source, s.target, bool_or(k IN (0, 2)) is_training, bool_or(k IN (1, 2)) is_holdout, bool_or(k = 3) is_interactome,
 array_to_string(list_sort(list_distinct(list(label) FILTER (k <> 3))), ',') AS label, any_value(p.pubmed) pubmed, any_value(p.experiment_type) experiment_type
 FROM s JOIN p ON s.source = p.source AND s.target = p.target GROUP BY s.source, s.target HAVING count(*) FILTER (k <> 3) > 0""")
def flag_merge(spark, d):
    e = frame(spark, d).withColumn("k", F.expr("_ord div 8") % 4)
    parts = [e.where(F.col("k") == k).drop("k", E.ORDER) for k in range(4)]
    return store.merge_flags(*parts).where("label is not null")


@query(RAW + " SELECT DISTINCT source, target, pubmed, upper(experiment_type) psimi FROM e WHERE source <> target")
def reference_links(spark, d):
    return store.reference_links(E.process(frame(spark, d), allow_duplicates=True))


@query(RAW + " SELECT DISTINCT pubmed FROM e WHERE experiment_type = 'RF'")
def links_of_method(spark, d):
    links = store.reference_links(frame(spark, d))
    return store.linked(links, links.where("psimi = 'RF'"), ["psimi"], ["pubmed"])


@query(RAW + " SELECT DISTINCT label FROM e")
def label_vocab(spark, d):
    return reports.label_vocabulary(E.merge_labels(frame(spark, d)))


@query(RAW + ", s AS (SELECT DISTINCT source, target, label FROM e) SELECT label, count(*) n FROM s GROUP BY label")
def class_distribution(spark, d):
    return reports.class_distribution(E.merge_labels(frame(spark, d)))


LABELS = ["Activation", "Binding", "Inhibition"]
#: Pseudo-probabilities from discounts and taxes, in whole hundredths.
PROBA = """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_discount * 1000) AS BIGINT) % 101 / 100.0 x1, CAST(round(l_tax * 1200) AS BIGINT) % 101 / 100.0 x2, CAST(l_quantity AS BIGINT) * 2 % 101 / 100.0 x3 FROM lineitem),
 pr AS (SELECT *, x1 + x2 + x3 sm, greatest(x1, x2, x3) mx FROM p)"""


def probabilities(spark, d):
    hundredth = lambda c: (c.cast("long") % 101) / F.lit(100.0)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", hundredth(F.round(F.col("l_discount") * 1000)).alias("Activation-pr"), hundredth(F.round(F.col("l_tax") * 1200)).alias("Binding-pr"), hundredth(F.col("l_quantity").cast("long") * 2).alias("Inhibition-pr"))
    return reports.summarise_probabilities(rows, LABELS)


@query(PROBA + """ SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sm, 6) sum_pr, mx max_pr,
 nullif(concat_ws(',', CASE WHEN x1 >= 0.5 THEN 'Activation' END, CASE WHEN x2 >= 0.5 THEN 'Binding' END, CASE WHEN x3 >= 0.5 THEN 'Inhibition' END), '') classification,
 CASE mx WHEN x1 THEN 'Activation' WHEN x2 THEN 'Binding' ELSE 'Inhibition' END classification_at_max FROM pr""")
def row_proba_summary(spark, d):
    return probabilities(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("`sum-pr`", 6).alias("sum_pr"), F.col("`max-pr`").alias("max_pr"), "classification", "classification_at_max")


@query(PROBA + " SELECT round(k / 20.0, 2) threshold, round(avg(CASE WHEN mx >= k / 20.0 THEN 1.0 ELSE 0.0 END), 6) AS share FROM pr, range(21) t(k) GROUP BY k")
def threshold_curve(spark, d):
    return reports.threshold_curve(probabilities(spark, d), "`max-pr`").select(F.round("threshold", 2).alias("threshold"), F.round("share", 6).alias("share"))


@query(PROBA + """ SELECT count(*) n, count(*) FILTER (l_orderkey % 3 = 0) n_seen, count(*) FILTER (mx >= 0.5) n_classified, count(*) FILTER (x2 >= 0.5) n_usable,
 round(count(*) FILTER (l_orderkey % 3 = 0) / count(*), 6) share_seen, round(count(*) FILTER (mx >= 0.5) / count(*), 6) share_classified, round(count(*) FILTER (x2 >= 0.5) / count(*), 6) share_usable FROM pr""")
def dataset_stats(spark, d):
    rows = probabilities(spark, d).withColumn("seen", F.col("l_orderkey") % 3 == 0)
    out = reports.dataset_statistics(rows, "seen", "`max-pr`", "`Binding-pr`")
    return out.select(*[F.round(c, 6).alias(c) if c.startswith("share") else F.col(c) for c in out.columns])


@query(PROBA + " SELECT label, count(*) n FROM (SELECT unnest([CASE WHEN x1 >= 0.5 THEN 'Activation' END, CASE WHEN x2 >= 0.5 THEN 'Binding' END, CASE WHEN x3 >= 0.5 THEN 'Inhibition' END]) AS label FROM pr) WHERE label IS NOT NULL GROUP BY label")
def prediction_distribution(spark, d):
    return reports.class_distribution(probabilities(spark, d), "classification")


def words(c):
    return F.filter(F.split(F.lower(c), " "), lambda x: x != "")


@query("""WITH t AS (SELECT p_partkey, p_size % 2 tr, unnest(list_distinct(string_split(lower(p_name), ' '))) w FROM part), v AS (SELECT DISTINCT w FROM t WHERE tr = 0 AND p_partkey % 5 = 0)
 SELECT p.p_partkey, round(coalesce(avg(CASE WHEN w IN (SELECT w FROM v) THEN 1.0 WHEN w IS NOT NULL THEN 0.0 END), 0), 6) usability FROM part p LEFT JOIN t ON p.p_partkey = t.p_partkey GROUP BY p.p_partkey""")
def feature_usability(spark, d):
    rows = table(spark, d, "part").withColumn("terms", words(F.col("p_name")))
    known = rows.where("p_size % 2 = 0 and p_partkey % 5 = 0").select(F.explode("terms").alias("term"))
    return features.usability(rows, "p_partkey", "terms", known).withColumn("usability", F.round("usability", 6))


@query("""WITH t AS (SELECT DISTINCT p_brand AS label, unnest(string_split(lower(p_name), ' ')) w FROM part), s AS (SELECT label, count(*) n FROM t GROUP BY label),
 b AS (SELECT x.label label_a, y.label label_b, count(*) c FROM t x JOIN t y ON x.w = y.w GROUP BY ALL) SELECT p.label label_a, q.label label_b, round(coalesce(c, 0) / (p.n + q.n - coalesce(c, 0)), 6) jaccard, round(2 * coalesce(c, 0) / (p.n + q.n), 6) dice FROM s p CROSS JOIN s q LEFT JOIN b ON b.label_a = p.label AND b.label_b = q.label""")
def jaccard_dice(spark, d):
    rows = table(spark, d, "part").select("p_brand", F.explode(words(F.col("p_name"))).alias("w"))
    sets = reports.label_features(rows, "p_brand", "w")
    return reports.similarity(sets, sets).select("label_a", "label_b", F.round("jaccard", 6).alias("jaccard"), F.round("dice", 6).alias("dice"))


@query("""WITH t AS (SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END u, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END v FROM orders),
 r AS (SELECT rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2.0 ru, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 rv FROM t)
 SELECT 'u' a, 'v' b, round(corr(ru, rv), 6) rho FROM r UNION ALL SELECT 'v', 'u', round(corr(ru, rv), 6) FROM r UNION ALL SELECT 'u', 'u', 1.0 UNION ALL SELECT 'v', 'v', 1.0""")
def spearman_labels(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").startswith("1").cast("int").alias("u"), (F.col("o_totalprice") > 100000).cast("int").alias("v"))
    return reports.spearman(rows, ["u", "v"]).withColumn("rho", F.round("rho", 6))


@query("SELECT l_returnflag, round(avg(l_discount), 6) mean, round(stddev_pop(l_discount) / sqrt(count(*)), 6) error FROM lineitem GROUP BY l_returnflag")
def fold_summary(spark, d):
    out = reports.fold_summary(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount")
    return out.select("l_returnflag", F.round("mean", 6).alias("mean"), F.round("error", 6).alias("error"))


@query("WITH i AS (SELECT l_returnflag, l_linenumber, avg(l_discount) v FROM lineitem GROUP BY ALL) SELECT l_returnflag, round(avg(v), 6) mean, round(stddev_samp(v) / sqrt(count(*)), 6) error FROM i GROUP BY l_returnflag")
def bootstrap_summary(spark, d):
    out = reports.bootstrap_summary(table(spark, d, "lineitem"), ["l_returnflag"], "l_linenumber", "l_discount")
    return out.select("l_returnflag", F.round("mean", 6).alias("mean"), F.round("error", 6).alias("error"))


@query("SELECT p_partkey, CAST(p_type LIKE '%BRASS%' AS INTEGER) is_brass, CAST(p_size > 25 AS INTEGER) is_large FROM part")
def binarise(spark, d):
    cell = F.concat_ws(",", F.when(F.col("p_type").contains("BRASS"), "brass"), F.when(F.col("p_size") > 25, "large"), F.lit("other"))
    return features.binarise(table(spark, d, "part").select("p_partkey", cell.alias("label")), "label", ["brass", "large"]).drop("label")


@query("SELECT p_partkey, w AS term, count(*) n FROM (SELECT p_partkey, unnest(regexp_extract_all(p_name || ' ' || p_type, '\\w\\w+')) w FROM part) GROUP BY ALL")
def bag_of_terms(spark, d):
    return features.bag_of_terms(table(spark, d, "part").withColumn("t", F.concat_ws(" ", "p_name", "p_type")), "p_partkey", "t")


@query("SELECT p_partkey, replace(concat_ws(',', 'GO:' || p_size, nullif(CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END, ''), p_type), ':', '') AS text FROM part")
def feature_text(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", T.feature_text(F.concat(F.lit("GO:"), "p_size"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(""), F.col("p_type")).alias("text"))


#: A graph over the parts: i is_a i div 2, i part_of i div 3.
DAG = "WITH RECURSIVE g AS (SELECT p_partkey c, p_partkey // 2 p FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2), an AS (SELECT c t, p a FROM g UNION SELECT an.t, g.p FROM an JOIN g ON an.a = g.c)"
DEPTH = ", dl AS (SELECT c t, 1 d FROM g WHERE p = 1 UNION SELECT g.c, dl.d + 1 FROM dl JOIN g ON g.p = dl.t), dp AS (SELECT p_partkey t, coalesce(max(d), 0) d FROM part LEFT JOIN dl ON p_partkey = dl.t GROUP BY p_partkey)"
BAGS = ", nn AS (SELECT count(*) n FROM part), pt AS (SELECT s_suppkey k, 0 side, s_suppkey * 7919 % n + 1 t FROM supplier, nn UNION ALL SELECT s_suppkey, 1, s_suppkey * 104729 % n + 1 FROM supplier, nn WHERE s_suppkey % 5 > 0 UNION ALL SELECT s_suppkey, 0, s_suppkey * 31 % n + 1 FROM supplier, nn)"
LCA = """, ns AS (SELECT k, count(DISTINCT t) nt, count(DISTINCT side) n2 FROM pt GROUP BY k), cm AS (SELECT q.k, an.a, count(*) h FROM (SELECT DISTINCT k, t FROM pt) q JOIN an ON an.t = q.t GROUP BY q.k, an.a),
 l AS (SELECT k, a FROM (SELECT cm.k, cm.a, rank() OVER (PARTITION BY cm.k ORDER BY d DESC) r FROM cm JOIN ns ON cm.k = ns.k AND h = nt JOIN dp ON dp.t = cm.a WHERE n2 = 2) WHERE r = 1)"""


def dag(spark, d):
    i = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey")
    is_a = p.where(i > 1).select(i.alias("child"), F.expr("p_partkey div 2").alias("parent"), F.lit("is_a").alias("rel"))
    return is_a.unionByName(p.where(i > 2).select(i.alias("child"), F.expr("p_partkey div 3").alias("parent"), F.lit("part_of").alias("rel")))


def bags(spark, d):
    n = table(spark, d, "part").count()
    s = table(spark, d, "supplier")
    one = lambda side, f: s.select(F.col("s_suppkey").alias("k"), F.lit(side).alias("side"), (F.col("s_suppkey") * f % n + 1).alias("term"))
    return one(0, 7919).unionByName(one(1, 104729).where("k % 5 > 0")).unionByName(one(0, 31))


@query(DAG + " SELECT t AS term, a AS ancestor FROM an")
def ancestors(spark, d):
    return ontology.closure(dag(spark, d)).select("term", "ancestor")


@query(DAG + DEPTH + " SELECT t AS id, d AS depth FROM dp")
def depth(spark, d):
    return ontology.level_of(table(spark, d, "part").select(F.col("p_partkey").alias("id")), ontology.levels(dag(spark, d)))


@query(DAG + DEPTH + BAGS + LCA + " SELECT k, a AS lca FROM l")
def lca(spark, d):
    deep, both = cut(ontology.levels(dag(spark, d))), bags(spark, d)
    two = both.groupBy("k").agg(F.count_distinct("side").alias("n")).where("n = 2").select("k")
    return ontology.common_above(both.join(two, "k", "left_semi"), dag(spark, d), deep)


@query(
    DAG + DEPTH + BAGS + LCA + """, nl AS (SELECT k, count(*) n FROM l GROUP BY k), cand AS (SELECT DISTINCT pt.k, side, an.a FROM pt JOIN nl ON nl.k = pt.k JOIN an ON an.t = pt.t),
 ind AS (SELECT cand.k, side, cand.a FROM cand JOIN l ON l.k = cand.k JOIN an x ON x.t = cand.a AND x.a = l.a JOIN nl ON nl.k = cand.k GROUP BY cand.k, side, cand.a, n HAVING count(*) = n)
 SELECT k, term, count(*) n FROM (SELECT k, a AS term FROM ind UNION ALL SELECT k, a FROM l UNION ALL SELECT k, a FROM l UNION ALL SELECT k, t FROM pt) GROUP BY ALL"""
)
def ulca_bags(spark, d):
    deep, every = cut(ontology.levels(dag(spark, d))), bags(spark, d)
    return ontology.up_to_common(every, None, deep, dag(spark, d)).groupBy("k", "term").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT l_suppkey k, l_partkey t, least(count(*), 2) n FROM lineitem GROUP BY ALL) SELECT k, CASE t % 3 WHEN 0 THEN 'molecular_function' WHEN 1 THEN 'biological_process' ELSE 'cellular_component' END namespace, CAST(sum(n) AS BIGINT) n, min(t) least FROM t GROUP BY ALL")
def ontology_cap(spark, d):
    space = F.when(F.col("p_partkey") % 3 == 0, "molecular_function").when(F.col("p_partkey") % 3 == 1, "biological_process").otherwise("cellular_component")
    terms = table(spark, d, "part").select(F.col("p_partkey").alias("id"), space.alias("namespace"))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("term"))
    return ontology.by_namespace(rows, terms, cap=2).select("k", "namespace", F.size("terms").cast("long").alias("n"), F.get("terms", 0).alias("least"))


INDUCE = PROBA + ", ed AS (SELECT DISTINCT 'P' || l_partkey a, 'S' || l_suppkey b, x1, mx FROM pr), tr AS (SELECT DISTINCT 'P' || l_partkey a, 'S' || l_suppkey b FROM lineitem WHERE l_orderkey % 3 = 0)"


def predicted(spark, d):
    p = probabilities(spark, d).withColumns({"protein_a": F.concat(F.lit("P"), "l_partkey"), "protein_b": F.concat(F.lit("S"), "l_suppkey")})
    rows = p.select("protein_a", "protein_b", F.col("protein_a").alias("gene_a"), F.col("protein_b").alias("gene_b"), "`Activation-pr`", "`max-pr`").distinct()
    known = p.where("l_orderkey % 3 = 0").select(F.col("protein_a").alias("source"), F.col("protein_b").alias("target"), F.lit("Activation").alias("label"))
    return rows, known


@query(INDUCE + " SELECT a AS source, b AS target, a || ' pp ' || b AS name, (a, b) IN (SELECT (a, b) FROM tr) edge_in_training, mx max_pr, x1 activation_pr FROM ed WHERE x1 >= 0.9")
def induce_label(spark, d):
    rows, known = predicted(spark, d)
    _, table_ = network.induce(network.by_label(rows, "Activation", 0.9), known, "Activation")
    return table_.withColumnsRenamed({"max-pr": "max_pr", "Activation-pr": "activation_pr"})


@query(INDUCE + ", k AS (SELECT * FROM ed WHERE (a IN ('P1', 'P2', 'P3') OR b IN ('S1', 'S2')) AND mx >= 0.5), nd AS (SELECT a x FROM k UNION SELECT b FROM k) SELECT x AS name, x AS gene_name, x IN (SELECT a FROM tr UNION SELECT b FROM tr) node_in_training FROM nd")
def induce_pathway(spark, d):
    rows, known = predicted(spark, d)
    return network.induce(network.by_pathway(rows, ["P1", "P2", "P3", "S1", "S2"], 0.5), known)[0]


BINARY_SQL = "WITH t AS (SELECT CAST(l_discount > 0.05 AS INTEGER) y, CAST(l_tax > 0.04 AS INTEGER) p FROM lineitem), c AS (SELECT count(*) FILTER (y = 1 AND p = 1) tp, count(*) FILTER (y = 0 AND p = 1) fp, count(*) FILTER (y = 1 AND p = 0) fn, count(*) FILTER (y = 0 AND p = 0) tn FROM t)"


@query(BINARY_SQL + " SELECT 'a' AS label, 'f1' metric, round(2 * tp / (2 * tp + fp + fn), 6) AS value FROM c UNION ALL SELECT 'a', 'precision', round(tp / (tp + fp), 6) FROM c UNION ALL SELECT 'a', 'recall', round(tp / (tp + fn), 6) FROM c UNION ALL SELECT 'a', 'specificity', round(tn / (tn + fp), 6) FROM c UNION ALL SELECT 'a', 'fdr', round(fp / (tp + fp), 6) FROM c")
def metrics_confusion(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_discount") > 0.05).cast("int").alias("y_a"), (F.col("l_tax") > 0.04).cast("int").alias("p_a"))
    return metrics.score_labels(rows, ["a"]).withColumn("value", F.round("value", 6))


@query("""WITH t AS (SELECT [CAST(l_discount > 0.05 AS INTEGER), CAST(l_quantity > 25 AS INTEGER)] y, [CAST(l_tax > 0.04 AS INTEGER), CAST(l_linenumber > 3 AS INTEGER)] p FROM lineitem)
 SELECT round(avg(CASE WHEN list_sum(y) > 0 THEN (CASE WHEN y[1] = 1 AND p[1] <> 1 THEN 1 ELSE 0 END + CASE WHEN y[2] = 1 AND p[2] <> 1 THEN 1 ELSE 0 END) / list_sum(y) ELSE 0 END), 6) positive_hamming,
 round(avg((CASE WHEN y[1] <> p[1] THEN 1 ELSE 0 END + CASE WHEN y[2] <> p[2] THEN 1 ELSE 0 END) / 2), 6) hamming FROM t""")
def multilabel_losses(spark, d):
    rows = table(spark, d, "lineitem").select(F.array((F.col("l_discount") > 0.05).cast("int"), (F.col("l_quantity") > 25).cast("int")).alias("y"), F.array((F.col("l_tax") > 0.04).cast("int"), (F.col("l_linenumber") > 3).cast("int")).alias("p"))
    return rows.agg(F.round(metrics.positive_hamming(F.col("y"), F.col("p")), 6).alias("positive_hamming"), F.round(metrics.hamming(F.col("y"), F.col("p")), 6).alias("hamming"))


def labelled(spark, d):
    """Documents with their two labels: the learning tables."""
    rows = table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id")
    return rows.select("doc_id", "text", F.col("quality").alias("y_quality"), F.col("toxic").alias("y_toxic"), F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic"))).alias("labels"))


def vectors(spark, d):
    from pyspark.ml import Pipeline

    rows = labelled(spark, d)
    return Pipeline(stages=models.vectorizer("text")).fit(rows).transform(rows)


@query()
def stratified_folds(spark, d):
    return folds.stratified_folds(labelled(spark, d), "labels", "doc_id", 3, seed=1).select("doc_id", "fold")


@query()
def binary_relevance(spark, d):
    rows = vectors(spark, d)
    model = models.BinaryRelevance({"quality": models.make_classifier("LogisticRegression", regParam=0.01), "toxic": models.make_classifier("MultinomialNB")}).fit(rows)
    return model.predict_proba(rows).select("doc_id", F.round("`quality-pr`", 4).alias("quality_pr"), F.round("`toxic-pr`", 4).alias("toxic_pr"))


@query()
def classifier_chain(spark, d):
    rows = vectors(spark, d)
    model = models.RandomChains("MultinomialNB", ["quality", "toxic"], k=2, seed=3).fit(rows)
    return model.predict(rows).select("doc_id", "p_quality", "p_toxic")


@query()
def grid_search(spark, d):
    rows = folds.single_label_folds(vectors(spark, d).withColumn("label", F.col("y_quality").cast("double")), "label", "doc_id", 3)
    best, score = models.random_search(rows, "MultinomialNB", folds=3, n_iter=30, seed=1)
    return spark.createDataFrame([(str(best), float(score))], "params string, score double")


@query()
def nearest_neighbours(spark, d):
    """Labelled documents whose id is divisible by 50 against all of them."""
    rows = vectors(spark, d).withColumn("label", F.col("y_quality").cast("double"))
    model = models.Neighbours(3).fit(rows)
    return models.positive(model.transform(rows.where("doc_id % 50 = 0").select("doc_id", "features")), "p").select("doc_id", "p")
