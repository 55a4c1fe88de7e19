from threatsift.operators import quality as Q


def test_validation_rules(spark):
    df = spark.createDataFrame([(1, "email", "x"), (2, "sms", "y"), (3, None, "z"), (4, "url", None)],
                               "id long, input_type string, text string")
    ok, bad = Q.quarantine(df, Q.input_type_error("input_type", "text"))
    assert [r.id for r in ok.collect()] == [1] and sorted(r.id for r in bad.collect()) == [2, 3, 4]
    b = spark.createDataFrame([(1, i) for i in range(33)] + [(2, 0)], "batch long, i int")
    v = {r.batch: r.valid for r in Q.batch_sizes(b, ["batch"]).collect()}
    assert v == {1: False, 2: True}
    t = spark.createDataFrame([("   ",), ("a",), (None,)], "t string")
    assert [r[0] for r in t.select(Q.is_blank("t")).collect()] == [True, False, True]
