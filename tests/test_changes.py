"""Inserts, updates and deletes as keyed joins; form rows; a database read and written through JDBC."""

import pytest
from pyspark.sql import functions as F
from tallyforge.operators import changes, proposals
from tallyforge.sources import jdbc, schemas, scratch


def rows(spark, name, *values):
    return changes.with_defaults(name, spark.createDataFrame([tuple(v.values()) for v in values], ", ".join(f"{k} {'boolean' if isinstance(x, bool) else 'int' if isinstance(x, int) else 'string'}" for k, x in values[0].items())))


@pytest.fixture()
def store(spark):
    return {
        "app_user": rows(spark, "app_user", {"id": "u1", "handle": "one"}, {"id": "u2", "handle": "two"}),
        "domain": rows(spark, "domain", {"id": "d1", "name": "water"}),
        "program": rows(spark, "program", {"id": "g1", "domain_id": "d1", "name": "pipes"}),
        "proposal": rows(spark, "proposal", {"id": "p1", "author_id": "u1", "title": "t"}, {"id": "p2", "author_id": "u2", "title": "t"}),
        "proposal_topic": spark.createDataFrame([("p1", "d1", "g1", True), ("p2", "d1", None, False), (None, "d1", None, False)], schemas.TABLES["proposal_topic"]),
        "proposal_action": rows(spark, "proposal_action", {"id": "a1", "proposal_id": "p1", "ordinal": 1, "text": "x"}, {"id": "a2", "proposal_id": "p2", "ordinal": 1, "text": "x"}),
    }


def ids(frame):
    return sorted(r["id"] for r in frame.select("id").collect())


def keys(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id string")


def test_inserted_rows_have_defaults_and_are_given_back(spark, store, tmp_path):
    new = rows(spark, "proposal_budget_item", {"proposal_id": "p1", "item_name": "sand"}, {"proposal_id": "p1", "item_name": "cement"})
    new.write.parquet(f"{tmp_path}/items")  # as generated ids are fixed once they are written
    made = spark.read.parquet(f"{tmp_path}/items").collect()
    assert len({r["id"] for r in made}) == 2 and {(r["one_time_usd"], r["annual_usd"], float(r["confidence"])) for r in made} == {(0, 0, 0.5)}
    assert [f.dataType for f in new.schema] == [f.dataType for f in schemas.fields("proposal_budget_item")]
    user = store["app_user"].first()
    assert user["created_at"] is not None and store["proposal"].first()["status"] == "draft" and store["domain"].first()["active"]


def test_updates_set_columns_of_named_rows_only(spark, store):
    new = spark.createDataFrame([("u1", "uno"), ("u9", "none")], "id string, handle string")
    before = {r["id"]: r for r in store["app_user"].withColumn("updated_at", F.lit("2000-01-01").cast("timestamp_ntz")).collect()}
    after = changes.updated(spark.createDataFrame(list(before.values()), schemas.TABLES["app_user"]), new, touch="updated_at")
    found = {r["id"]: r for r in after.collect()}
    assert found["u1"]["handle"] == "uno" and found["u2"] == before["u2"] and set(found) == {"u1", "u2"}
    assert found["u1"]["updated_at"] > before["u1"]["updated_at"]
    assert ids(changes.returning(after, new)) == ["u1"]
    cleared = changes.updated(store["proposal"], spark.createDataFrame([("p1", None)], "id string, author_id string"))
    assert {r["id"]: r["author_id"] for r in cleared.collect()} == {"p1": None, "p2": "u2"}


def test_deletes_cascade_and_keep_rows_without_a_key(spark, store):
    left = changes.deleted(store, "proposal", keys(spark, "p1", "p9"))
    assert ids(left["proposal"]) == ["p2"] and ids(left["proposal_action"]) == ["a2"]
    assert sorted((r["proposal_id"] or "") for r in left["proposal_topic"].collect()) == ["", "p2"]
    assert ids(left["app_user"]) == ["u1", "u2"]
    assert changes.violations(left).isEmpty()


def test_restricting_keys_are_told(spark, store):
    assert [tuple(r) for r in changes.restricted(store, "app_user", keys(spark, "u1", "u9")).collect()] == [("u1", "proposal", 1)]
    assert sorted(tuple(r) for r in changes.restricted(store, "domain", keys(spark, "d1")).collect()) == [("d1", "program", 1), ("d1", "proposal_topic", 3)]
    assert changes.restricted(store, "proposal", keys(spark, "p1")).isEmpty()


def test_violations_name_table_rule_and_key(spark, store):
    assert changes.violations(store).isEmpty()
    store["app_user"] = store["app_user"].unionByName(rows(spark, "app_user", {"id": "u3", "handle": "one"}))
    store["proposal"] = store["proposal"].filter("id <> 'p2'").unionByName(rows(spark, "proposal", {"id": "p1", "author_id": "nobody", "title": "t"}))
    assert {tuple(r) for r in changes.violations(store).collect()} == {
        ("app_user", "handle is repeated", "one"), ("proposal", "id is repeated", "p1"), ("proposal", "author_id names a missing app_user", "nobody"),
        ("proposal_topic", "proposal_id names a missing proposal", "p2"), ("proposal_action", "proposal_id names a missing proposal", "p2"),
    }


def test_lookups_and_loads(spark, store):
    assert proposals.by_id(store["app_user"], "id", "u2").first()["handle"] == "two" and proposals.by_id(store["app_user"], "id", "x").isEmpty()
    assert ids(proposals.programs_of(store["program"], "d1")) == ["g1"] and proposals.programs_of(store["program"], "d2").isEmpty()
    loaded = proposals.proposals_loaded(store["proposal"], store["app_user"], store["proposal_topic"], store["domain"], store["program"], actions=store["proposal_action"])
    found = {r["id"]: r for r in loaded.collect()}
    assert found["p1"]["author"]["handle"] == "one" and found["p1"]["topics"][0]["program"]["name"] == "pipes" and found["p2"]["topics"][0]["program"] is None
    assert [a["text"] for a in found["p1"]["actions"]] == ["x"]


def test_a_form_becomes_the_rows_that_are_stored(spark):
    form = spark.sql("""SELECT 'p' AS id, 'u' AS author_id, 't' AS title, 's' AS summary, 'x' AS problem_plain, array(named_struct('text', 'one'), named_struct('text', 'two')) AS actions,
      array(named_struct('name', 'm', 'unit', 'u', 'baseline_val', '1.5', 'target_val', '2', 'deadline', '2030-01-01')) AS metrics, array(named_struct('domain_id', 'd', 'program_id', null, 'is_primary', true)) AS topics,
      array(named_struct('item_name', 'i', 'one_time_usd', 5, 'annual_usd', 1, 'confidence', 0.25), named_struct('item_name', 'j', 'one_time_usd', 7, 'annual_usd', 0, 'confidence', 1.0)) AS budget_items, true AS needs_new_authority, '' AS sunset_date""")
    made = proposals.form_rows(form)
    head = made["proposal"].first().asDict()
    assert (head["budget_one_time_usd"], head["budget_annual_usd"], head["status"], head["sunset_date"], head["privacy_notes"]) == (12, 1, "draft", None, None)
    assert set(made["proposal"].columns) == {f.name for f in schemas.fields("proposal")} - {"created_at", "updated_at"}
    assert {n for n in made["proposal_metric"].columns} == {f.name for f in schemas.fields("proposal_metric")}
    assert [(r["ordinal"], r["text"]) for r in made["proposal_action"].orderBy("ordinal").collect()] == [(1, "one"), (2, "two")]
    assert float(made["proposal_budget_item"].orderBy("item_name").first()["confidence"]) == 0.25
    errors = proposals.form_errors(form.withColumn("population_estimate", F.lit(1)).withColumn("retention_days", F.lit(1)).withColumn("topics", F.transform("topics", lambda t: t.withField("is_primary", F.lit(None).cast("boolean")))))
    assert "topic_ids" in errors.first()["errors"]


def test_a_database_is_read_in_ranges_and_written(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    actions = spark.range(100).select(F.col("id").cast("string").alias("id"), F.lit("p").alias("proposal_id"), F.col("id").cast("int").alias("ordinal"), F.lit("text").alias("text"))
    jdbc.write(actions, url, "proposal_action", mode="overwrite", driver=driver)
    found = jdbc.read(spark, url, "proposal_action", column="ordinal", partitions=4, driver=driver)
    assert found.rdd.getNumPartitions() == 4 and found.columns == [f.name for f in schemas.fields("proposal_action")]
    assert sorted(r["ordinal"] for r in found.collect()) == list(range(100))
    jdbc.write(actions.limit(1), url, "proposal_action", driver=driver)
    assert jdbc.read(spark, url, "proposal_action", driver=driver).count() == 101


def test_tables_are_declared_in_the_catalogue(spark):
    for name in schemas.TABLES:
        spark.sql(schemas.create_table(name))
        assert [(f.name, f.dataType) for f in spark.table(name).schema] == [(f.name, f.dataType) for f in schemas.fields(name)]
        spark.sql(f"DROP TABLE {name}")


def test_stored_tables_can_be_released(spark):
    kept = scratch.stored(spark.range(3), "kept")
    assert kept.count() == 3
    path = scratch.scratch_path(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and spark.conf.get("spark.app.id") in path


def test_forms_are_dealt_out_by_their_number(spark, tmp_path, monkeypatch):
    from tallyforge.operators import spread
    from tallyforge.plans import registry

    spark.range(400).selectExpr("id AS o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1200).selectExpr("id % 300 AS l_orderkey", "int(id div 300) AS l_linenumber", "double(id % 50) AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(spread, "ROWS_AT_ONCE", 100)
    rows = registry.queries()["form_rows_proposal_action"](spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 12 and rows.count() == 1200
    listed = rows.groupBy("proposal_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("l"))
    assert {tuple(map(tuple, r["l"])) for r in listed.collect()} == {((1, "0"), (2, "1"), (3, "2"), (4, "3"))}
