import pytest
from pyspark.sql import functions as F

from quern.operators import lineage, policy
from quern.operators.metrics import Dictionary
from quern.plans import dag
from quern.plans.nightly import nightly
from quern.sources import sinks
from quern.streaming.rollup import hourly, streamed

DATA = "/root/testdata/sf0.001"


def test_dag_order_retries_and_skips():
    seen, waits, tries = [], [], []

    def flaky(_):
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("again")
        return 7

    def fatal(_):
        raise dag.Fatal("no")

    out = dag.run([dag.Step("c", lambda r: seen.append(r["b"]), ("b",)), dag.Step("b", flaky), dag.Step("x", fatal), dag.Step("y", seen.append, ("x",))], waits.append)
    assert out.status == {"b": "succeeded", "c": "succeeded", "x": "failed", "y": "skipped"} and seen == [7]
    assert waits == [5, 10] and out.summary == "partial_success"
    for bad in ([dag.Step("a", print, ("b",))], [dag.Step("a", print, ("b",)), dag.Step("b", print, ("a",))], [dag.Step("a", print), dag.Step("a", print)]):
        with pytest.raises(ValueError):
            dag.order(bad)


def test_nightly_chain(spark, tmp_path):
    out = nightly(spark, DATA, f"file://{tmp_path}")
    assert out.summary == "succeeded", out.errors
    assert spark.read.parquet(f"file://{tmp_path}/metric_result").where("metric_code = 'GMV_PAID'").select("caliber_version").distinct().first()[0] == "v1.1"


def test_policy():
    assert policy.resolve_tenant("brand", "T1", None) == "T1" and policy.resolve_tenant("admin", None, "") is None
    for role, own, asked in (("brand", "T1", "T2"), ("brand", None, None), ("ops", "T1", None), ("none", "T1", "T1")):
        with pytest.raises(policy.Denied):
            policy.resolve_tenant(role, own, asked)


def test_quotes_in_tenants_are_data(spark):
    df = spark.createDataFrame([("x' OR '1'='1",), ("y",)], "tenant_id string")
    assert df.where(policy.tenant_predicate("x' OR '1'='1")).count() == 1 and df.where(policy.tenant_predicate(None)).count() == 2


def test_audit(spark):
    log = spark.createDataFrame([], "user string, action string, target string, tenant_id string, allowed boolean, at timestamp")
    log = policy.audited(policy.audited(log, "u", "read", "t", True, "T1"), "u", "read", "t", False, None)
    assert tuple(policy.denials(log).first()) == (2, 1)


def test_lineage(spark):
    edges = lineage.all_edges(spark, Dictionary().frame(spark))
    assert edges.count() == edges.select("source", "target").distinct().count()
    assert {r.node for r in lineage.upstream(edges, "dws_shop_day").collect()} >= {"raw_order", "raw_refund", "raw_cs_session", "dim_shop"}
    long = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(20)] + [("n20", "n0")], "source string, target string")
    assert {r.node: r.distance for r in lineage.upstream(long, "n20").collect()} == {f"n{k}": 20 - k for k in range(20)}
    assert lineage.cyclic_metrics() == []


def test_tenant_overwrite_leaves_others(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.overwrite(spark.createDataFrame([("a", 1), ("b", 2)], "tenant_id string, x int"), path, "tenant_id")
    sinks.overwrite_tenants(spark.createDataFrame([("b", 3)], "tenant_id string, x int"), path)
    assert sorted((r.tenant_id, r.x) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]


def test_merging_and_exports(spark, tmp_path):
    docs = spark.createDataFrame([("D1", "T", "t", "c")], "doc_id string, tenant_id string, title string, content string")
    row = lambda *x: spark.createDataFrame([x], docs.schema)
    assert {r.content for r in sinks.document_upserted(docs, row("D1", "T", "t", "new")).collect()} == {"new"}
    for bad in (row("D1", "U", "t", "c"), row("D2", "T", "t", " "), row("D2", "T", None, "c")):
        with pytest.raises(Exception, match="empty one"):
            sinks.document_upserted(docs, bad).collect()
    assert sinks.absent(docs.unionByName(row("D2", "T", "t", "c")), docs, "doc_id").count() == 1
    sinks.exported(docs, f"file://{tmp_path}/csv", "content", "doc_id")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").columns == ["content", "doc_id"]
    mapping = spark.createDataFrame([(1, "T", "p", "s", "c", "k1")], "id long, tenant_id string, platform string, shop_id string, platform_sku_code string, sku_id string")
    skus = spark.createDataFrame([("k2",)], "sku_id string")
    decided = spark.createDataFrame([(2, "T", "p", "s", "c", "k2")], mapping.schema)
    assert [r.sku_id for r in sinks.mapping_verified(mapping, skus, decided).collect()] == ["k2"]
    for bad in ((3, "T", "p", "s", "d", "none"), (3, "T", "p", "s", "d", None), (3, "T", "p", "s", " ", "k2")):
        with pytest.raises(Exception, match="not a SKU"):
            sinks.mapping_verified(mapping, skus, decided.unionByName(spark.createDataFrame([bad], mapping.schema))).collect()
    points = spark.createDataFrame([("1997-01-01", "T1", "x", 1.5), ("1997-01-01", "T2", "y", 2.5)], "dt string, tenant_id string, dim_value string, value double")
    with pytest.raises(ValueError):
        sinks.exported_points(points, f"file://{tmp_path}/points", None, "GMV_PAID", "v1.0")
    sinks.exported_points(points, f"file://{tmp_path}/points", "T1", "GMV_PAID", "v1.0")
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"file://{tmp_path}/points").collect()] == [("1997-01-01", "T1", "x", "1.5", "GMV_PAID", "v1.0")]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("ts", "event_type", "value")
    events.write.parquet(f"file://{tmp_path}/in")
    stream = streamed(spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in"), "3650 days")
    query = hourly(stream).writeStream.outputMode("complete").format("memory").queryName("hourly_events").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    got, want = spark.table("hourly_events"), hourly(events)
    assert got.exceptAll(want).isEmpty() and got.count() == want.count() and want.agg(F.sum("n")).first()[0] == events.count()


def test_the_shared_folder_is_never_machine_local_on_a_cluster():
    from types import SimpleNamespace

    from quern.sources import shared

    def session(master, named=None):
        return SimpleNamespace(sparkContext=SimpleNamespace(applicationId=f"app-{master}", master=master), conf=SimpleNamespace(get=lambda key, default: named))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared.folder(session(master))
        assert shared.folder(session(master, "s3a://bucket/x/")) == f"s3a://bucket/x/quern-app-{master}"
    assert shared.folder(session("local[2]")).startswith("file://")


def test_kept_tables_can_be_cleared(spark):
    from quern.sources import shared

    df, path = shared.kept_at(spark.range(3), "t")
    assert df.count() == 3 and path.startswith(shared.folder(spark))
    shared.cleared(spark)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
