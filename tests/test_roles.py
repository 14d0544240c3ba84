from vitaeflow.operators import roles


def test_role_topk_sorts_within_rows(spark):
    rows = [(i, t, k) for i in range(40) for t, k in [("kitchen oven soup", "cook") if i % 2 else ("plane airport runway", "pilot")]]
    df = spark.createDataFrame(rows, "id int, t string, role string")
    top = roles.top_roles(roles.train_roles(df, "id", "t", "role", features=64), df, "id", "t", 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    assert {r["id"]: r["role"] for r in top.where("rank = 1").collect()} == {i: k for i, _, k in rows} and top.count() == 80


def test_training_draws_the_same_keys_as_a_sort_of_all_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(roles, "SAMPLE", 10)
    df = spark.createDataFrame([(i, "oven soup" if i % 2 else "plane runway", "cook" if i % 2 else "pilot") for i in range(60)], "id int, t string, role string")
    drawn = []
    fit = roles.prepared
    monkeypatch.setattr(roles, "prepared", lambda d, *a: drawn.append(d) or fit(d, *a))
    roles.train_roles(df, "id", "t", "role", features=64)
    assert {r["id"] for r in drawn[0].collect()} == {r["id"] for r in df.orderBy(F.xxhash64("id")).limit(10).collect()}


def test_training_takes_every_row(spark, monkeypatch):
    drawn = []
    fit = roles.prepared
    monkeypatch.setattr(roles, "prepared", lambda d, *a: drawn.append(d) or fit(d, *a))
    df = spark.range(50_020).selectExpr("id", "if(id % 2 = 0, 'oven soup', 'plane runway') as t", "if(id % 2 = 0, 'cook', 'pilot') as role")
    roles.train_roles(df, "id", "t", "role", features=16)
    assert drawn[0].count() == 50_020
