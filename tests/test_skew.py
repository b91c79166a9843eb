"""Joins and rankings with one key that holds a third of the rows."""

from pyspark.sql import functions as F

from coppice.operators.skew import first_n, numbered, running, salted_join, skew_join


def rows(spark):
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"), "id"
    )


def test_joins_agree_with_a_plain_join(spark):
    big = rows(spark)
    small = big.select("key").distinct().withColumn("v", F.length("key")).where("key <> 'k7'")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(tuple, big.join(small, "key", how).collect()), key=str)
        for join in (salted_join, skew_join):
            got = join(big, small, ["key"], ["id"], how).select(*big.columns, *([] if "_" in how else ["v"]))
            assert sorted(map(tuple, got.collect()), key=str) == want, (join, how)


def test_running_totals_and_numbers(spark):
    df = rows(spark)
    got = running(df, ["key"], [F.col("id").desc()], {"total": F.col("id"), "n": F.lit(1).cast("long")}).collect()
    by_key = {}
    for key, i in sorted(map(tuple, df.collect()), key=lambda r: -r[1]):
        by_key.setdefault(key, []).append(i)
    want = {(k, i, sum(ids[: n + 1]), n + 1) for k, ids in by_key.items() for n, i in enumerate(ids)}
    assert {tuple(r) for r in got} == want
    first = {(r["key"], r["id"]) for r in first_n(df, ["key"], [F.col("id")], 2).collect()}
    assert first == {(k, i) for k, ids in by_key.items() for i in sorted(ids)[:2]}
    assert numbered(df, ["key"], [F.col("id")], "n").where("key = 'hot'").agg(F.max("n")).first()[0] == 1000


def test_first_n_cuts_before_the_shuffle(spark):
    plan = first_n(rows(spark), ["key"], [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_hot_group_is_spread_over_ranges(spark):
    from coppice.operators.skew import _slices

    sliced = _slices(rows(spark), ["key"], [F.col("id")])
    assert sliced.where("key = 'hot'").select("_slice").distinct().count() > 1


def test_partitions_follow_the_input(spark):
    """Not the bytes they were written in: keys that repeat pack well, and would all come to a few tasks."""
    from coppice.operators.skew import by_size

    df = spark.range(1000).selectExpr("concat('same/long/key/', id % 100) AS path", "id AS line")
    assert by_size(df, ["path"], df, F.lit(1), 50).rdd.getNumPartitions() == 20
    lines = by_size(df, ["path"], df, F.lit(1), 50).groupBy("path").count()
    assert {r["count"] for r in lines.collect()} == {10}


def test_a_join_has_tasks_for_the_rows_it_makes(spark):
    """Not for those it reads: a package of many files that many others import makes a row for each pair."""
    from coppice.operators.skew import spread_join

    big = rows(spark).unionByName(spark.range(500).select(F.lit(None).cast("string").alias("key"), "id"))
    other = spark.range(300).select(F.when(F.col("id") < 200, "hot").otherwise(F.concat(F.lit("k"), F.col("id") - 200)).alias("key"), F.col("id").alias("v"))
    for how in ("inner", "left"):
        joined, tasks = spread_join(big, other, ["key"], ["id"], how, 1000)
        assert tasks >= 200
        want = sorted(map(tuple, big.join(other, "key", how).collect()), key=str)
        assert sorted(map(tuple, joined.select("key", "id", "v").collect()), key=str) == want
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        most = joined.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert most <= 6000, most


def test_many_importers_of_a_package_share_tasks(spark):
    """Rows of one Go package do not all come out of the task that holds its imports."""
    from coppice.operators import resolve
    from coppice.schema import TREE
    from coppice.sources import trees

    names = spark.range(800).select(F.format_string("p/f%03d.go", "id").alias("path"))
    files = trees.inventory(names.select(F.lit("r").alias("repo"), F.lit("head").alias("snapshot"), "path", F.lit(1).cast("long").alias("size")))
    raw = names.select(
        F.lit("r").alias("repo"), F.lit("head").alias("snapshot"), F.col("path").alias("src"), F.lit("go").alias("lang"), F.lit("import").alias("form"),
        F.lit("example.org/r/p").alias("spec"), F.lit(0).alias("level"), F.lit(None).cast("array<string>").alias("names"), F.lit(0).alias("ord"),
    )
    modules = spark.createDataFrame([("r", "head", "example.org/r")], [*TREE, "module"])
    found = resolve.resolve(raw, files, modules, langs=("go",)).where("dst IS NOT NULL")
    assert found.count() == 800 * 800
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sides_that_grow_are_not_broadcast(spark, tmp_path):
    """Repeated names pack well, so written sides look small enough for it long after they are not."""
    from coppice.operators.skew import spread_join

    rows(spark).selectExpr("key", "id").write.parquet(f"{tmp_path}/big")
    rows(spark).selectExpr("key", "id AS v").write.parquet(f"{tmp_path}/other")
    big, other = spark.read.parquet(f"{tmp_path}/big"), spark.read.parquet(f"{tmp_path}/other")
    # The lists of hot keys are; they have a fixed length or one row for a task.
    for joined in (skew_join(big, other, ["key"], ["id"]), spread_join(big, other, ["key"], ["id"])[0]):
        plan = plan_of(joined)
        assert plan.count("BroadcastHashJoin") == 2 and plan.count("SortMergeJoin") == 1, plan
    assert "BroadcastHashJoin" in plan_of(salted_join(big, other, ["key"], ["id"]))
    assert "BroadcastHashJoin" not in plan_of(salted_join(big, other, ["key"], ["id"], grows=True))


def test_what_is_known_of_files_is_not_broadcast(spark, forest):
    from coppice.operators import summary, testsgap, tree
    from coppice.session import cut
    from coppice.sinks import report
    from coppice.sources import trees

    files, contents = forest({"pkg/a.py": "import pkg.b\n", "pkg/b.py": "x = 1\n", "tests/test_a.py": "import pkg.a\n", "package.json": '{"main": "pkg/a.py"}'})
    files = cut(files, "files")
    edges = cut(files.selectExpr("repo", "snapshot", "path AS src", "'pkg/b.py' AS dst", "false AS decl_only"), "edges")
    some = cut(files.where("path LIKE 'pkg/%'").select("repo", "snapshot", "path"), "some")
    counts = cut(trees.text_counts(contents), "counts")
    annotated = summary.annotate(files, counts=counts, edges=edges, entries=some, configs=some, untested=some)
    assert {r["path"]: r["imported_by"] for r in annotated.collect()}["pkg/b.py"] == 4
    listed = cut(trees.with_directories(files), "listed")
    for df in (
        annotated,
        testsgap.untested(files, edges, some),
        trees.package_entries(contents, files),
        report.nodes(listed, annotated=cut(annotated, "annotated")),
        tree.entry_notes(listed, cut(annotated, "annotated")),
    ):
        assert not [line for line in plan_of(df).splitlines() if "BroadcastHashJoin" in line and "_hot" not in line and "[id" not in line], plan_of(df)


def test_trees_that_go_on_are_broadcast_by_their_number(spark, monkeypatch):
    """Not by the bytes they take, in which the salts do not show."""
    from coppice.operators import graph
    from coppice.session import cut

    state = cut(spark.range(400).selectExpr("id AS node", "id % 40 AS tree", "id < 10 AS moved"), "state")
    for few in (100, 9):
        monkeypatch.setattr(graph, "FEW_TREES", few)
        settled = graph._Settled(spark, "settled")
        going = settled.going(state)
        assert ("BroadcastHashJoin" in plan_of(going)) == (few == 100)
        assert {r["node"] for r in going.collect()} == {i for i in range(400) if i % 40 < 10}
        assert {r["node"] for r in settled.all(state).collect()} == {i for i in range(400) if i % 40 >= 10}
