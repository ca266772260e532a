"""Queries over whole tables: the rows that a subset would leave out."""

from tessera.plans import lens_queries
from tessera.plans.lens import Lens


def test_orders_have_paths_and_all_customers_calls(spark, sf):
    v = Lens(spark, sf)
    paths = {r["id"]: r["path"].split(">") for r in lens_queries.QUERIES["shortest_path"](spark, sf).collect()}
    assert any(i.startswith("O:") for i in paths) and all(p[0] == lens_queries.ROOT and p[-1] == i for i, p in paths.items())
    nations = {r["s_nationkey"] for r in v.t("supplier").collect()}
    callers = {f"C:{r['c_custkey']}" for r in v.t("customer").collect() if r["c_nationkey"] in nations}
    for name in ("interface_expand", "override_expand"):
        assert callers <= {r["from"] for r in lens_queries.QUERIES[name](spark, sf).collect()}
    asked = {(r["l_orderkey"], f"f{r['l_partkey'] % 400}") for r in v.t("lineitem").collect()}
    assert {(r["seq"], r["path"]) for r in lens_queries.QUERIES["rename_resolve"](spark, sf).collect()} == asked
