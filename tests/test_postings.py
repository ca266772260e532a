"""A search by a written index against one that tokenizes everything."""

from tessera.operators import search
from tessera.sources import postings


class Index:
    def __init__(self, spark):
        df = spark.createDataFrame
        names = ["OrderService", "注文サービス", "Xử lý đơn hàng", "parseHTTPHeader", "x", "注文", "orderService"]
        self.symbols = df([(f"M:{i}", "Method", n, "T" if i % 2 else None, "P", f"f{i % 3}", i, i) for i, n in enumerate(names)] + [("M:0", "Method", "Again", None, "Q", "f0", 9, 90)], "id string, kind string, name string, containingType string, project string, file string, line int, seq long")
        self.entry_points = df([("M:1", "http", "GET", "api/orders/{id}", False, 1), ("M:2", "job", None, None, None, 2)], "id string, type string, httpMethod string, route string, routeInferred boolean, seq long")
        self.api_links = df([("fe:1", "M:1", "exact"), ("fe:2", "M:1", "exact")], "frontendId string, backendId string, matchKind string")
        self.frontend_calls = df([("fe:1", "order page", 1), ("fe:2", None, 2)], "id string, feature string, seq long")
        self.tickets = df([("#107", "注文を直す order", ["f0", "f1"]), ("#108", None, ["f2"]), ("#109", "nothing", ["f2"])], "ticket string, message string, files array<string>")


def test_a_written_index_finds_the_same(spark, tmp_path):
    index = Index(spark)
    path = str(tmp_path / "postings")
    postings.write_postings(index, path, postings.BUCKETS)
    for query in ("order service", "注文", "#108 header http", "đơn hàng", "unknown words", "", "orders ORDERS order"):
        rows = lambda p: [tuple(map(repr, r)) for r in search.where(index, query, None, p).collect()]  # noqa: B023, E731
        assert rows(path) == rows(None)


def test_only_asked_buckets_are_read(spark, tmp_path):
    path = str(tmp_path / "postings")
    postings.write_postings(Index(spark), path)
    found = postings.found_tokens(spark, path, ["order"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {(r["kind"], r["id"]) for r in found.collect()} == {("name", "M:0"), ("name", "M:6"), ("feature", "M:1"), ("ticket", "#107")}
