import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from threadlens.functions.vectors import as_vector
from threadlens.operators import classifiers as cl
from threadlens.operators.deep_forest import DeepForest, DeepForestModel
from threadlens.session import ship_package


@pytest.fixture(scope="module")
def data(spark):
    ship_package(spark)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(900)]
    x = F.col("x")
    return spark.createDataFrame(rows, "id long, x array<double>").select(
        "id", as_vector(x).alias("features"), (x[0] + x[1] - x[2] > 0).cast("double").alias("label")).cache()


def test_many_nodes_leave_the_histograms_of_mllib(spark):
    assert isinstance(cl.make("random_forest", 400_000, 64, numTrees=200, maxDepth=20).getStages()[0], DeepForest)
    for n, depth in ((400, 20), (400_000, 4)):
        assert isinstance(cl.make("random_forest", n, 64, numTrees=200, maxDepth=depth).getStages()[0], RandomForestClassifier)


def test_forest_does_not_depend_on_where_its_nodes_are_finished(spark, data, tmp_path):
    found = []
    for most in (1 << 16, 60):
        model = DeepForest(numTrees=12, maxDepth=9, subtreeRows=most).fit(data.where("id >= 200"))
        fitted = cl.Fitted("random_forest", model)
        found.append({r.id: r.proba for r in cl.predictions(fitted, data.where("id < 200"), ["id"]).collect()})
        assert (len(model.head[0]) > 12) == (most == 60)
    assert found[0] == found[1] and len(found[0]) == 200
    model.write().overwrite().save(str(tmp_path / "forest"))
    again = cl.Fitted("random_forest", DeepForestModel.load(str(tmp_path / "forest")))
    assert {r.id: r.proba for r in cl.predictions(again, data.where("id < 200"), ["id"]).collect()} == found[0]


def test_forest_is_as_good_as_mllibs(data):
    train, test = data.where("id >= 200"), data.where("id < 200")
    own, mllib = (cl.accuracy_of(cl.fit("random_forest", train, numTrees=30, maxDepth=12, max_nodes=n), test) for n in (0, 1 << 40))
    assert own > 0.8 and own > mllib - 0.04


def test_missing_labels_and_values_are_refused(data):
    forest = DeepForest(numTrees=2, maxDepth=3)
    with pytest.raises(ValueError, match="labels"):
        forest.fit(data.withColumn("label", F.when(F.col("id") > 3, F.col("label"))))
    with pytest.raises(Exception, match="finite"):
        forest.fit(data.withColumn("features", as_vector(F.transform(vector_to_array("features"), lambda v: F.when(F.col("id") > 3, v).otherwise(float("nan"))))))
