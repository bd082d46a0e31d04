import pytest

from edgeloom.operators import edges as E
from edgeloom.operators import mapping


def frame(spark, rows):
    full = [(k, *r, *[None] * (5 - len(r))) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, "_ord long, source string, target string, label string, pubmed string, experiment_type string")


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy(E.ORDER).select(*(columns or E.COLUMNS)).collect()]


def test_canonical_sorts_missing_as_none(spark):
    df = E.edge_frame(frame(spark, [("b", "a", "x y"), (None, "B", "x"), ("Z", None, "x")]), pubmed="pubmed")
    assert rows(df, "source", "target", "label") == [("a", "b", "X-y"), ("B", None, "X"), (None, "Z", "X")]


def test_filters(spark):
    df = frame(spark, [("a", "a", "x"), ("a", "b", "x,y"), (None, None, "x"), ("a", "c", None), ("a", "d", " - ")])
    assert rows(E.remove_self_edges(df), "target") == [("b",), ("c",), ("d",)]
    assert rows(E.remove_nulls(df), "target") == [("a",), ("b",)]
    assert rows(E.remove_labels(df, ["x"]), "target") == [("b",), ("c",), ("d",)]
    assert rows(E.remove_labels(df, ["X", None]), "target") == [("a",), ("b",), (None,), ("d",)]


def test_rare_labels_count_null(spark):
    df = frame(spark, [("a", "b", "x"), ("a", "c", "x"), ("a", "d", None), ("a", "e", None), ("a", "f", "y")])
    assert rows(E.remove_rare_labels(df, 2), "target") == [("b",), ("c",), ("d",), ("e",)]


def test_merge_unites_labels_and_references(spark):
    df = frame(spark, [("b", "a", "x", "1000,1001", "None,MI:1"), ("a", "b", "Y", "1001", "mi:2"), ("a", "b", None), ("c", "d", None)])
    assert rows(E.merge_labels(df)) == [("a", "b", "X,Y", "1000,1001", "None,MI:1|MI:2"), ("c", "d", None, None, None)]


def test_duplicates_by_label(spark):
    df = frame(spark, [("a", "b", "X", "2", "MI:1"), ("b", "a", "X", "1"), ("a", "b", "Y"), ("a", "b", "X")])
    assert rows(E.remove_duplicates(df)) == [("a", "b", "X", "2,1", "MI:1,None"), ("a", "b", "Y", None, None)]


def test_duplicates_with_multi_labels_come_out_once(spark):
    df = frame(spark, [("a", "b", "X,Y", "1"), ("a", "b", "X", "2"), ("c", "d", "Z")])
    assert rows(E.remove_duplicates(df)) == [("a", "b", "X,Y", "1,2", "None,None"), ("c", "d", "Z", None, None)]


GOLDEN = [
    ("O95398", "P51828", "binding/association", "2,1", "None,MI:2"),
    ("P51828", "O95398", "activation", "1", "MI:1"),
    ("O43749", "O60262", "activation", "3", "MI:3"),
    ("Q13131", "Q8NHA4", "binding/association", None, None),
    ("Q13131", "Q8NHA4", "activation", None, None),
    ("Q00001", "Q00001", "activation", None, None),
    ("Q00002", "Q00003", "inhibition", None, None),
    ("Q00002", None, "activation", None, None),
]


def test_process(spark):
    raw = E.edge_frame(frame(spark, GOLDEN), pubmed="pubmed", experiment_type="experiment_type")
    out = E.process(raw, exclude_labels=["inhibition"], min_counts=2, merge=True)
    assert sorted(rows(out)) == sorted([
        ("O95398", "P51828", "Activation,Binding/association", "2,1", "None,MI:1|MI:2"),
        ("O43749", "O60262", "Activation", "3", "MI:3"),
        ("Q13131", "Q8NHA4", "Activation,Binding/association", None, None),
    ])
    with pytest.raises(TypeError):
        E.process(raw, drop_nulls="other")


def test_empty_frame(spark):
    assert E.process(frame(spark, []), min_counts=2, merge=True).count() == 0


def test_common_edges(spark):
    a, b = frame(spark, [("a", "b", "X"), ("c", "d", "X")]), frame(spark, [("a", "b", "Y"), ("e", "f", "Y")])
    first, second, common = E.remove_common(a, b)
    assert [x.select("source").collect()[0][0] for x in (first, second)] == ["c", "e"]
    assert sorted(r[0] for r in common.select("label").collect()) == ["X", "Y"]


def test_mapping_multiplies(spark):
    names = spark.createDataFrame([("A", "C"), ("A", "D"), ("B", "E")], "old string, new string")
    out = mapping.map_edges(frame(spark, [("A", "A", "x"), ("A", "Q", "x")]), names)
    assert sorted(tuple(r) for r in out.select("source", "target").collect()) == [("C", "C"), ("C", "D"), ("C", "D"), ("D", "D")]
    assert mapping.map_network(frame(spark, [("A", "B", "x")]), names, merge=True).count() == 2


def test_preferred_and_batch_map(spark):
    names = spark.createDataFrame([("k1", "P1"), ("k1", "P2"), ("k2", "P2"), ("k3", "PX")], "old string, new string")
    proteins = spark.createDataFrame([("P1", True, 9606), ("P2", False, 9606), ("P3", True, 0)], "uniprot_id string, reviewed boolean, taxon_id int")
    assert sorted(map(tuple, mapping.preferred(names, proteins, True).collect())) == [("k1", "P1"), ("k2", "P2")]
    assert sorted(map(tuple, mapping.preferred(names, proteins).collect())) == [("k1", "P1")]
    wanted = spark.createDataFrame([("k1",), ("k3",), ("k4",)], "old string")
    assert {r.old: r.new for r in mapping.batch_map(wanted, names, proteins).collect()} == {"k1": ["P1", "P2"], "k3": [], "k4": []}
