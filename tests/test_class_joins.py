from tidewatch.operators import models, prep


def test_classes_are_not_shuffled_to(spark):
    """Tables of one row per class reach the rows; the rows of a class are not sent to one task."""
    df = spark.createDataFrame([(f"f{i}", "BENIGN" if i % 5 else "DoS") for i in range(50)], "flow_id string, label string")
    for out, n in ((models.weighted(df), 50), (prep.stratified_split(df, "flow_id"), 50)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan and out.count() == n
    assert len(prep.stratified_split(df, "flow_id").filter("is_test").groupBy("label").count().collect()) == 2
