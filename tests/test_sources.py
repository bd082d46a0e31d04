import pytest
from pyspark.sql import functions as F

from edgeloom.operators import features, ontology, store
from edgeloom.sources import curated, edgelists, files, ontologies, proteins

OBO = """format-version: 1.2
ontology: mini

[Term]
id: GO:1
name: root
namespace: biological_process

[Term]
id: GO:2
name: two words ! odd
namespace: biological_process
alt_id: GO:20
is_a: GO:1 ! root

[Term]
id: GO:3
name: three
namespace: molecular_function
is_a: GO:2 {source="x"} ! two
relationship: part_of GO:1 ! root
relationship: regulates GO:2

[Term]
id: GO:4
name: gone
namespace: biological_process
is_obsolete: true

[Typedef]
id: part_of
"""

DAT = """ID   AAA_HUMAN               Reviewed;         100 AA.
AC   P00001; Q11111;
DT   01-JAN-2000, integrated into UniProtKB/Swiss-Prot.
DT   12-APR-2017, entry version 57.
GN   Name=AAA {ECO:1}; Synonyms=A1, A2;
OX   NCBI_TaxID=9606;
CC   -!- FUNCTION: Does things
CC       well.
DR   GO; GO:0000003; F:binding; IEA:x.
DR   GO; GO:0000001; P:process; IEA:x.
DR   InterPro; IPR000001; Some.
DR   Pfam; PF00001; Some; 1.
KW   Kinase; Membrane.
//
ID   BBB_MOUSE               Unreviewed;       10 AA.
AC   P00002;
OX   NCBI_TaxID=10090;
//
"""


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def got(df, *columns):
    return [tuple(r) for r in df.orderBy("_ord").select(*columns).collect()]


def test_edge_lists(spark, tmp_path):
    path = write(tmp_path, "a.tsv", "source\ttarget\np1\t p2\n-\tp3\n")
    assert got(edgelists.edge_list(spark, path), "source", "target", "label") == [("P1", "P2", None), (None, "P3", None)]
    path = write(tmp_path, "b.tsv", "G\tG\tUA\tUB\n1\t2\tp1\tunknown\n")
    assert got(edgelists.bioplex(spark, path), "source", "target") == [("P1", None)]
    path = write(tmp_path, "c.sif", "p1 pp p2\np3 pp p4\n")
    assert got(edgelists.sif(spark, path), "source", "target") == [("P1", "P2"), ("P3", "P4")]
    assert edgelists.read_network(spark, path, "sif", drop_nulls=["source", "target"], allow_duplicates=True).count() == 2


def test_pina_mitab(spark, tmp_path):
    cells = ["uniprotkb:Q1", "uniprotkb:P2", "", "", "", "", "MI:0096(pull)|MI:0018(two)|MI:0018(two)", "", "pubmed:16|pubmed:16|pubmed:17"]
    path = write(tmp_path, "p.tsv", "\t".join("abcdefghi") + "\n" + "\t".join(cells) + "\n")
    assert got(edgelists.pina_mitab(spark, path), "source", "target", "pubmed", "experiment_type") == [("Q1", "P2", "16,17", "MI:0018|MI:0096,MI:0018")]


def test_innate_mitab(spark, tmp_path):
    cells = ["x", "x", "ensembl:ENSG1", "ensembl:ENSG2", "uniprotkb:P1|uniprotkb:A_HUMAN|refseq:N", "uniprotkb:P2|uniprotkb:P3", 'psi-mi:"MI:0007"(anti tag)', "", "pubmed:9"]
    other = ["x", "x", "ensembl:ENSG1", "y", *cells[4:]]
    path = write(tmp_path, "i.tsv", "\n".join("\t".join(r) for r in (list("abcdefghi"), cells, other)) + "\n")
    assert sorted(got(edgelists.innate_mitab(spark, path), "source", "target", "pubmed", "experiment_type")) == [("P1", "P2", "9", "MI:0007"), ("P1", "P3", "9", "MI:0007")]


def test_network_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", None)], "source string, target string, label string")
    edgelists.save_network(df, str(tmp_path / "n"))
    assert [tuple(r) for r in edgelists.load_network(spark, str(tmp_path / "n")).collect()] == [("a", "b", None)]


def test_modifications(spark, tmp_path):
    ptm = write(tmp_path, "ptm.tsv", "1\tS\t1_1\tNP\t207\tK\tT\t2\tPhosphorylation\tin vivo;in vitro\t11,12\n1\tS\t1_1\tNP\t207\tK\t-\t-\tPhosphorylation\tin vivo\t11\n")
    xref = write(tmp_path, "x.tsv", "1\tG\tN\tP\tE\tO\tP1,P9\tname\n2\tG\tN\tP\tE\tO\tP2\tname\n")
    people = spark.createDataFrame([("P1", True), ("P2", True), ("P9", False)], "uniprot_id string, reviewed boolean")
    net = curated.modification_network(curated.read_modifications(spark, ptm), curated.read_xrefs(spark, xref), people)
    assert [tuple(r)[:5] for r in net.collect()] == [("P1", "P2", "Phosphorylation", "11,12", "None,None")]


def test_pathways(spark):
    entries = spark.createDataFrame([("p", "1", "hsa:1 hsa:2", "gene"), ("p", "2", "hsa:3", "gene"), ("p", "3", "cpd:9", "compound")], "pathway string, id string, name string, type string")
    relations = spark.createDataFrame([("p", "1", "2", "state change", "PPrel"), ("p", "1", "3", "compound", "PCrel"), ("p", "2", "1", "x", "maplink")], "pathway string, entry1 string, entry2 string, name string, link string")
    names = spark.createDataFrame([("hsa:1", "P1"), ("hsa:3", "P3")], "old string, new string")
    edges = curated.pathway_edges(entries, relations, names)
    assert [tuple(r)[:3] for r in edges.collect()] == [("hsa:1", "hsa:3", "State-change")]
    people = spark.createDataFrame([("P1", True), ("P3", True)], "uniprot_id string, reviewed boolean")
    assert [tuple(r)[:3] for r in curated.pathway_network([edges], names, people, merge=True).collect()] == [("P1", "P3", "State-change")]


def test_gene_ontology(spark, tmp_path):
    path = write(tmp_path, "go.obo", OBO)
    terms, edges, alt = ontologies.read_gene_ontology(spark, path)
    assert {r.id: (r.name, r.is_obsolete) for r in terms.collect()} == {"GO:1": ("root", False), "GO:2": ("two words ! odd", False), "GO:3": ("three", False), "GO:4": ("gone", True)}
    assert sorted(tuple(r) for r in edges.collect()) == [("GO:2", "GO:1", "is_a"), ("GO:3", "GO:1", "part_of"), ("GO:3", "GO:2", "is_a")]
    assert [tuple(r) for r in alt.collect()] == [("GO:20", "GO:2")]
    paths = ontology.closure(edges)
    assert {tuple(r) for r in paths.collect()} == {("GO:2", "GO:1", 1), ("GO:3", "GO:2", 1), ("GO:3", "GO:1", 2)}
    deep = ontology.depths(terms, paths)
    assert {r.id: r.depth for r in deep.collect()} == {"GO:1": 0, "GO:2": 1, "GO:3": 2, "GO:4": 0}
    people = spark.createDataFrame([("A", None, "GO:20", None, "IPR1", None, "K"), ("B", "GO:3", "GO:2,GO:4", None, "IPR1", "PF1", None)], "uniprot_id string, go_mf string, go_bp string, go_cc string, interpro string, pfam string, keywords string")
    pairs = spark.createDataFrame([("A", "B"), ("A", "C")], "source string, target string")
    found = {r.target: r for r in features.pair_features(pairs, people, terms, paths, deep, alt).collect()}
    assert found["C"].interpro is None and found["B"].interpro == "IPR1,IPR1" and found["B"].keywords == "K"
    assert found["B"].ulca_go_mf == "GO:3"
    live = ontology.without_obsolete(terms.select("id"), "id", terms)
    assert live.count() == 3


def test_proteins(spark, tmp_path):
    path = write(tmp_path, "p.dat", DAT)
    rows = {r.uniprot_id: r for r in proteins.read_proteins(spark, path).collect()}
    a, b = rows["P00001"], rows["P00002"]
    assert (a.taxon_id, a.reviewed, a.gene_id, a.go_mf, a.go_bp, a.interpro, a.pfam) == (9606, True, "AAA", "GO:0000003", "GO:0000001", "IPR000001", "PF00001")
    assert (a.keywords, a.last_release, str(a.last_update)[:10], a.entry_name, a.synonyms) == ("Kinase,Membrane", 57, "2017-04-12", "AAA_HUMAN", ["A1", "A2"])
    assert a.function.startswith("Does things") and (b.reviewed, b.gene_id, b.go_mf) == (False, None, None)
    assert proteins.read_proteins(spark, path, 9606).count() == 1


def test_small_files(spark, tmp_path):
    path = write(tmp_path, "n.tsv", "ipr1\tx\tOne\nipr1\tx\tUno\n")
    assert [tuple(r) for r in files.read_names(spark, path).collect()] == [("IPR1", "Uno")]
    path = write(tmp_path, "m.json", '{"a": ["x", "y"], "b": []}')
    names = files.read_map(spark, path)
    assert sorted(tuple(r) for r in names.collect()) == [("a", "x"), ("a", "y")]
    files.write_map(names, str(tmp_path / "m"))
    assert files.read_saved_map(spark, str(tmp_path / "m")).count() == 2
    df = spark.createDataFrame([("X", "GO:1,GO:2"), ("", "GO:1")], "label string, go string")
    files.write_arff(df, str(tmp_path / "arff"), ["X"], ["go"], ["GO1", "GO2"])
    lines = [r[0] for r in spark.read.text(str(tmp_path / "arff")).collect()]
    assert "@DATA" in lines and sorted(lines[-2:]) == ["0,1,0", "1,1,1"]


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    s.create()
    s.write("psimi", spark.createDataFrame([("MI:1", "one"), ("MI:2", None)], "accession string, description string"))
    new = spark.createDataFrame([("MI:2", "two"), ("MI:3", "three")], "accession string, description string")
    merged = store.upsert(s.read("psimi"), new, "accession")
    assert {r.accession: r.change for r in merged.collect()} == {"MI:1": "kept", "MI:2": "updated", "MI:3": "new"}
    s.write("psimi", merged.drop("change"))
    assert s.read("psimi").count() == 3 and len(s.versions("psimi")) == 1
    s.wipe()
    assert s.read("psimi").count() == 0


def test_resolve(spark):
    people = spark.createDataFrame([("A", 9606), ("B", 9606), ("M", 10090)], "uniprot_id string, taxon_id int")
    known = spark.createDataFrame([("A", "B")], "source string, target string")
    pairs = spark.createDataFrame([("b", " a"), ("A", "A"), ("A", "M"), (None, "A"), ("B", "A")], "source string, target string")
    existing, missing, invalid = store.resolve(pairs, people, known)
    assert [tuple(r) for r in existing.collect()] == [("A", "B")] and [tuple(r) for r in missing.collect()] == [("A", "A")]
    assert invalid.count() == 2


def test_label_lookup(spark):
    df = spark.createDataFrame([("A", "B", "Dephosphorylation"), ("A", "C", "Phosphorylation")], "source string, target string, label string")
    assert store.by_label(df, "phosphorylation").count() == 1
    assert store.by_label(df, "phosphorylation", substring=True).count() == 2
    assert store.by_pair(df, "B", "A").count() == 1 and store.by_protein(df, "A").count() == 2


def test_line_ends_and_cycles(spark, tmp_path):
    path = write(tmp_path, "crlf.obo", "")
    (tmp_path / "crlf.obo").write_bytes(OBO.replace("\n", "\r\n").encode())
    terms, edges, alt = ontologies.read_gene_ontology(spark, path)
    assert terms.count() == 4 and edges.count() == 3 and alt.count() == 1
    (tmp_path / "crlf.dat").write_bytes(DAT.replace("\n", "\r\n").encode())
    assert {r.uniprot_id for r in proteins.read_proteins(spark, str(tmp_path / "crlf.dat")).collect()} == {"P00001", "P00002"}
    ring = spark.createDataFrame([("a", "b", "is_a"), ("b", "c", "is_a"), ("c", "a", "is_a"), ("x", "a", "is_a")], "child string, parent string, rel string")
    with pytest.raises(ValueError, match="cycle"):
        ontology.closure(ring)


def test_order_of_several_files(spark, tmp_path):
    for k, size in enumerate((3, 400, 20)):
        write(tmp_path, f"part{k}.tsv", "source\ttarget\n" + "".join(f"f{k}r{n:03d}\tx\n" for n in range(size)))
    rows = [r[0] for r in edgelists.edge_list(spark, f"{tmp_path}/part*.tsv").orderBy("_ord").select("source").collect()]
    assert rows == [f"F{k}R{n:03d}" for k, size in enumerate((3, 400, 20)) for n in range(size)]


def test_ontology_without_closure(spark, monkeypatch):
    """Levels, climbs and common ancestors against the closure of a graph with shortcuts; the closure is never built."""
    import random

    rnd = random.Random(8)
    rows = [(f"t{c:02d}", f"t{p:02d}", "is_a") for c in range(1, 40) for p in rnd.sample(range(c), min(c, rnd.randint(1, 3)))]
    edges = spark.createDataFrame([*rows, ("t05", "t05", "is_a"), rows[0]], "child string, parent string, rel string")
    terms = spark.createDataFrame([(f"t{k:02d}",) for k in range(41)], "id string")
    paths = ontology.closure(edges).cache()
    ends = {(r.term, r.ancestor) for r in paths.collect()}
    depth = {r.id: r.depth for r in ontology.depths(terms, paths).collect()}
    bags = spark.createDataFrame([(k, side, f"t{rnd.randint(0, 40):02d}") for k in range(12) for side in ((0, 1) if k else (0,)) for _ in range(2)], "k int, side int, term string")
    common = sorted(tuple(r) for r in ontology.up_to_common(bags, paths, ontology.depths(terms, paths)).collect())
    monkeypatch.setattr(ontology, "closure", None)
    deep = ontology.levels(edges).cache()
    assert {r.id: r.depth for r in ontology.level_of(terms, deep).collect()} == depth
    asked = [(f"t{rnd.randint(0, 40):02d}", f"t{rnd.randint(0, 45):02d}") for _ in range(150)]
    got = ontology.reaches(spark.createDataFrame(asked, "term string, ancestor string"), edges, deep).collect()
    assert len(got) == 150 and all(r.found == ((r.term, r.ancestor) in ends) for r in got)
    some = ontology.climb(bags.select("term", F.lit(0).alias("least")), edges, deep)
    assert sorted(tuple(r) for r in ontology.up_to_common(bags, some, deep, edges).collect()) == common
    ring = spark.createDataFrame([("b", "c"), ("c", "b"), ("b", "root"), ("x", "root")], "child string, parent string")
    with pytest.raises(ValueError, match="cycle"):
        ontology.levels(ring)


def halves(spark, monkeypatch, n=3000):
    """Edges from i to i div 2 and i div 3, their levels, all strict ancestors, and the rows of each table that is cut from now on."""
    edges = spark.range(2, n).selectExpr("id child", "explode(array_distinct(filter(array(id div 2, id div 3), x -> x > 0))) parent")
    deep, held, cut = ontology.levels(edges).cache(), [], ontology.cut

    def counted(df):
        held.append((df := cut(df)).count())
        return df

    above = {1: set()}
    for k in range(2, n):
        above[k] = {p for p in (k // 2, k // 3) if p}.union(*(above[p] for p in (k // 2, k // 3) if p))
    depth = {r.id: r.depth for r in deep.collect()}
    monkeypatch.setattr(ontology, "cut", counted)
    return edges, deep, depth, above, held


def tops_of(terms, above, depth):
    common = set.intersection(*(above.get(t, set()) for t in terms))
    return {a for a in common if depth[a] == max(depth[c] for c in common)}


def test_common_above_holds_no_paths(spark, monkeypatch):
    """The deepest common ancestors are found without a table of all ancestors of the terms."""
    edges, deep, depth, above, held = halves(spark, monkeypatch)
    rows = [(k, t) for k in range(600) for t in {k * 7919 % 3000 + 1, k * 1047 % 3000 + 1, *([k * 31 % 3000 + 1] if k % 3 else [])}]
    rows += [(600, 1), (600, 5), (601, 9), (602, 4000), (602, 8), (603, 8), (603, 4)]
    got = sorted(tuple(r) for r in ontology.common_above(spark.createDataFrame(rows, "k long, term long"), edges, deep).collect())
    bags = {k: {t for x, t in rows if x == k} for k, _ in rows}
    assert got == sorted((k, a) for k, terms in bags.items() for a in tops_of(terms, above, depth))
    assert max(held) < sum(len(above.get(t, ())) for t in {t for _, t in rows}) / 3


def test_bags_up_to_common_hold_no_paths(spark, monkeypatch):
    """Bags up to the common ancestors of brute force, without a table of all ancestors; keys may have several tops."""
    edges, deep, depth, above, held = halves(spark, monkeypatch)
    rows = [(k, side, t) for k in range(600) for side, t in ((0, k * 7919 % 3000 + 1), (1, k * 1047 % 3000 + 1), (0, k * 31 % 3000 + 1)) if side == 0 or k % 5]
    want, several = {}, 0
    for k in range(600):
        bag = [(side, t) for x, side, t in rows if x == k]
        tops = tops_of({t for _, t in bag}, above, depth) if k % 5 else set()
        several += len(tops) > 1
        each = [t for _, t in bag] + 2 * list(tops)
        for side in (0, 1) if tops else ():
            mine = set().union(*(above.get(t, set()) for s, t in bag if s == side))
            each += [a for a in mine if tops <= above[a]]
        for t in each:
            want[k, t] = want.get((k, t), 0) + 1
    bags = spark.createDataFrame(rows, "k long, side int, term long")
    got = ontology.up_to_common(bags, None, deep, edges).groupBy("k", "term").count().collect()
    assert several > 100 and {(r.k, r.term): r["count"] for r in got} == want
    assert max(held) < sum(len(above.get(t, ())) for t in {t for _, _, t in rows}) / 3
