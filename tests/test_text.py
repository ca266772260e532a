import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import routes, text
from tessera.operators import search


@pytest.mark.parametrize(
    "given, want",
    [("注文をキャンセル", ["注文", "文を", "をキ", "キャ", "ャン", "ンセ", "セル"]), ("削除できない", ["削除", "除で"]), ("ｷｬﾝｾﾙ", text.tokens_of("キャンセル")), ("Ｃａｎｃｅｌ", ["cancel"]), ("đơn hàng bị lỗi", ["đơn", "hàng", "lỗi"]), ("a I 1", []), ("ない", ["ない"])],
)
def test_tokens(given, want):
    assert text.tokens_of(given) == want


def test_tokens_do_not_cross_scripts():
    assert {"orderservice", "キャ"} <= set(text.tokens_of("キャンセルOrderService"))
    assert text.tokens_of("XMLParserBase64Encoder", names=True) == ["xmlparserbase64encoder", "xml", "parser", "base64", "encoder"]


@pytest.mark.parametrize(
    "query, ticket, want",
    [("sho-1234 fix", "SHO-1234", True), ("をSHO-1234を", "SHO-1234", True), ("500 lỗi", "500", False), ("#500を修正", "500", True), ("TICKET-500", "500", True), ("#5000", "500", False), ("DEBUG-500", "500", False), ("#500a", "500", False), ("XSHO-1234", "SHO-1234", False)],
)
def test_ticket_names(query, ticket, want):
    assert text.names_ticket(query, ticket) is want


@pytest.mark.parametrize("name, want", [(n, True) for n in ("MyApp.Tests", "MyApp.UnitTests", "OrderServiceTests", "MyApp.Tests.Common", "myapp.tests")] + [(n, False) for n in ("Attestation", "LatestNews", "Contest.Core", "MyApp.Contests", "Orders.Core")])
def test_test_projects(spark, name, want):
    assert spark.range(1).select(text.is_test_project(F.lit(name)).alias("x")).first()["x"] is want


def test_ticket_ids_skip_merge_numbers(spark):
    rows = spark.createDataFrame([("Merge pull request #456 from org/fix-#789", "closes #1234 #789"), ("Merged in x (pull request #456)", None), ("fix #12345 #100 #100", "")], "m string, b string")
    got = [r[0] for r in rows.select(text.ticket_ids(F.col("m"), F.col("b"), r"#\d{3,6}")).collect()]
    assert got == [["#789", "#1234"], [], ["#12345", "#100"]]
    got = [r[0] for r in rows.select(text.ticket_ids(F.col("m"), F.col("b"), r"#(\d{3})\b")).collect()]
    assert got == [["789"], [], ["100"]]


@pytest.mark.parametrize(
    "given, route, dropped",
    [("`/api/orders/${id}`", "api/orders/{*}", False), ("environment.apiUrl + '/orders/' + id", "orders/{*}", True), ("'/api/Orders?x=1'", "api/orders", False), ("'/api/{{ id }}/x'", "api/{*}/x", False), ("url", None, True), ("'orders'", None, False), ("`${base}/a/${f({x: 1})}`", "a/{*}", True), ("", None, False)],
)
def test_urls(given, route, dropped):
    assert routes.url_route(given) == (route, dropped)


def test_backend_routes_and_keys(spark):
    df = spark.createDataFrame([("/Api/Orders/{id:int}/", False), ("a/{b?}/{c?}", False), ("home/Index", True), ("home/Index", False)], "route string, inferred boolean")
    got = [r[0] for r in df.select(routes.route_keys(F.col("route"), F.col("inferred"))).collect()]
    assert got == [["api/orders/{*}"], ["a/{*}/{*}", "a/{*}", "a"], ["home/index", "home"], ["home/index"]]


def test_composed_and_filled_routes(spark):
    rows = [("api/[Controller]/", "{id}", "OrdersController", "GetAsync"), ("api", "/abs/x", "C", "A"), ("api", "~/abs/y/", "C", "A"), (None, "[controller]/[ACTION]", "Controller", "Async"), ("a", None, "B", "C"), ("", "", "B", "C")]
    df = spark.createDataFrame(rows, "p string, t string, c string, a string")
    got = df.select(routes.filled_route(routes.composed_route(F.col("p"), F.col("t")), F.col("c"), F.col("a"), F.lit(None).cast("string")).alias("r")).collect()
    assert [r[0] for r in got] == ["api/Orders/{id}", "abs/x", "abs/y", "Controller/Async", "a", ""]
    names = spark.createDataFrame([("GetAll",), ("deleteX",), ("Options",), ("Save",), (None,)], "m string")
    assert [r[0] for r in names.select(routes.verb_by_name(F.col("m"))).collect()] == ["GET", "DELETE", "OPTIONS", "POST", "POST"]
    paths = spark.createDataFrame([("C:\\\\Src\\\\a.cs".replace("\\\\", "\\"),), ("c:/src",), ("c:/srcs/x",)], "p string")
    assert [r[0] for r in paths.select(routes.is_inside(F.col("p"), "c:/SRC/")).collect()] == [True, True, False]


def test_features(spark):
    df = spark.createDataFrame([("src/app/orders/list.ts",), ("x/SRC/App/admin/y/z.ts",), ("src/app/main.ts",), ("main.ts",), ("legacy\\a.js",)], "p string")
    assert [r[0] for r in df.select(routes.feature(F.col("p"), "src/app")).collect()] == ["orders", "admin", "src", "unknown", "legacy"]


def symbols_of(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id string, kind string, name string, containingType string, project string, file string, line int, seq long")


def test_find_tiers_and_resolution(spark):
    rows = [("M:Svc.Cancel(a)", "Method", "Cancel", "Svc", "P", "f", 1), ("M:Svc.Cancel(b)", "Method", "Cancel", "Svc", "P", "f", 2), ("M:Svc.CancelAll", "Method", "CancelAll", "Svc", "P", "f", 3)]
    s = symbols_of(spark, rows)
    assert [(r["id"], r["score"]) for r in search.find(s, "svc.cancel").collect()] == [("M:Svc.Cancel(a)", 100), ("M:Svc.Cancel(b)", 100), ("M:Svc.CancelAll", 70)]
    assert search.resolve_symbol(s, "Svc.Cancel") == ("ambiguous", ["M:Svc.Cancel(a)", "M:Svc.Cancel(b)"])
    assert search.resolve_symbol(s, "CancelAll") == ("found", ["M:Svc.CancelAll"])
    assert search.resolve_symbol(s, "M:Svc.CancelAll") == ("found", ["M:Svc.CancelAll"])
    assert search.resolve_symbol(s, "nothing")[0] == "unknown"


def test_where_ranks_named_ticket_first(spark):
    s = symbols_of(spark, [("M:A.Cancel", "Method", "Cancel", "A", "P", "a.cs", 1), ("M:A.Other", "Method", "Other", "A", "P", "a.cs", 2), ("M:B.Login", "Method", "Login", "B", "P", "b.cs", 3)])

    class Index:
        symbols = s
        entry_points = spark.createDataFrame([("M:B.Login", "http", "GET", "api/login", 0)], "id string, type string, httpMethod string, route string, seq long")
        tickets = spark.createDataFrame([("#500", "2026-01-01", "cancel order", ["a.cs"])], "ticket string, date string, message string, files array<string>")
        api_links = spark.createDataFrame([], "frontendId string, backendId string, matchKind string")
        frontend_calls = spark.createDataFrame([], "id string, feature string, seq long")

    got = search.where(Index, "#500 order").collect()
    assert [r["id"] for r in got] == ["M:A.Cancel", "M:A.Other"] and got[0]["score"] == 6.0 and got[0]["reasons"] == ["ticket #500"]
    assert [r["id"] for r in search.where(Index, "login").collect()] == ["M:B.Login"]
    assert search.where(Index, "!!").count() == 0


def test_expressions_and_python_tokenize_alike(spark):
    r = random.Random(5)
    alphabet = "abzABZ019 _-.\n\t#" + "éĐ漢かﬁ😀"
    texts = [None, "", "HTTPServer2Get x", "sau khi THEO it"] + ["".join(r.choice(alphabet[: r.choice((15, len(alphabet)))]) for _ in range(r.randrange(30))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for x in df.select("t", text.tokenize(F.col("t")).alias("a"), text.name_tokens(F.col("t")).alias("b")).collect():
        assert x["a"] == text.tokens_of(x["t"]) and x["b"] == text.tokens_of(x["t"], names=True), x["t"]


def test_hits_of_one_id_in_parts(spark):
    r = random.Random(6)
    hits = [("a", r.randrange(4) / 2, f"r{i}", f"{i:04}") for i in range(900)] + [("b", 1.0, "r", "x")]
    got = {x["id"]: x for x in search.combined(spark.createDataFrame(hits, "id string, score double, reason string, place string")).collect()}
    best = sorted((h for h in hits if h[0] == "a" and h[1] > 0), key=lambda h: (-h[1], h[3]))
    assert got["a"]["reasons"] == [h[2] for h in best[:5]] and got["a"]["more"] == len(best) - 5
    assert got["a"]["score"] == round(best[0][1] + math.log2(len(best)), 2) and (got["b"]["score"], got["b"]["more"]) == (1.0, 0)


def test_asked_tokens_are_all_that_is_handed_back(spark):
    asked = ["order", "hàng", "削除", "the"]
    texts = ["The order", "削除できない order", "đơn hàng bị lỗi", "ＯＲＤＥＲ", "", None, "nothing", "the hàng order 削除"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", text.tokens_among(F.col("t"), asked).alias("a")).collect()
    assert [r["a"] for r in got] == [[t for t in asked if t in text.tokens_of(x)] for x in texts]
