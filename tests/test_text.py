import pytest
from pyspark.sql import functions as F

from edgeloom.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("cell,want", [("", None), (" - ", None), ("None", None), ("nan", None), ("unknown", None), ("Unknown", "Unknown"), ("NONE", "NONE"), (None, None), (" a ", " a ")])
def test_null_of(spark, cell, want):
    assert one(spark, T.null_of(F.lit(cell).cast("string"))) == want


@pytest.mark.parametrize("cell,want", [(" p12 ", "P12"), ("UNKNOWN", None), ("-", None), (" ", None), (None, None), ("none", "NONE")])
def test_clean_accession(spark, cell, want):
    assert one(spark, T.clean_accession(F.lit(cell).cast("string"))) == want


@pytest.mark.parametrize("cell,want", [("b x, A , ,a", "A,B-x"), ("", None), (None, None), ("PROTEIN Binding", "Protein-binding")])
def test_format_labels(spark, cell, want):
    assert one(spark, T.format_labels(F.lit(cell).cast("string"))) == want


def test_store_labels_keep_spaces(spark):
    assert one(spark, T.store_labels(F.lit("state CHANGE,a"))) == "A,State change"


def test_annotations(spark):
    cell = F.lit(" go:2,GO:1 , go:2,")
    assert one(spark, T.annotations(cell, False)) == "GO:1,GO:2,GO:2"
    assert one(spark, T.annotations(cell, True)) == "GO:1,GO:2"
    assert one(spark, T.annotations_valid(cell)) is True
    assert one(spark, T.annotations_valid(F.lit("GO:1,X"))) is False
    assert one(spark, T.annotations(F.lit(" "), True)) is None


def test_terms_dates_and_ids(spark):
    assert one(spark, T.rename_term(F.lit("go0001"))) == "GO:0001"
    assert one(spark, T.rename_term(F.lit("IPR01"))) == "IPR01"
    assert one(spark, T.joint_id(F.lit(10), F.lit(9))) == "9,10"
    assert str(one(spark, T.update_date(F.lit("01-JAN-2017")))) == "2017-01-01 00:00:00"
    assert one(spark, T.outdated(F.lit(None).cast("int"), F.lit(3))) is True
    assert one(spark, T.outdated(F.lit(3), F.lit(3))) is False


def test_label_sets(spark):
    assert one(spark, T.add_labels(F.lit("B,A"), F.lit("c"))) == "A,B,C"
    assert one(spark, T.drop_labels(F.lit("A"), F.lit("a"))) is None


def test_feature_text(spark):
    assert one(spark, T.feature_text(F.lit("GO:1,GO:2"), F.lit(""), F.lit(None).cast("string"), F.lit("IPR4"))) == "GO1,GO2,IPR4"


def test_references_pad_missing_groups(spark):
    refs = one(spark, T.references(F.lit("2,1"), F.lit("None,mi:2|MI:1")))
    assert [(r.pmid, r.psimis) for r in refs] == [("2", []), ("1", ["MI:2", "MI:1"])]
    assert [r.pmid for r in one(spark, T.references(F.lit("2,1"), F.lit(None).cast("string")))] == ["2", "1"]
    assert one(spark, T.references_aligned(F.lit("2,1"), F.lit("a"))) is False


def test_normalise_nulls(spark):
    df = spark.createDataFrame([("None", " "), ("a", " None ")], "x string, y string")
    assert [tuple(r) for r in T.normalise_nulls(df).collect()] == [(None, None), ("a", " None ")]
