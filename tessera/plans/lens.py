"""The star schema seen as a code index: each view as a DataFrame and as SQL, so that operators meet an oracle.

Regions, nations, customers, suppliers, parts and orders are symbols; an order leads to its customer, suppliers and
parts, a customer or supplier to its nation, a nation to its region. Orders are also commits whose files are parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.lineage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Lens:
    """Views over the tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def symbols(self) -> DataFrame:
        region, nation = self.t("region"), self.t("nation")
        at = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))

        def rows(df, letter, kind, key, name, containing, project, place):
            k = F.col(key).cast("long")
            return df.select(
                F.concat(F.lit(f"{letter}:"), k.cast("string")).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), containing.cast("string").alias("containingType"), project.alias("project"),
                F.concat(F.lit(f"{letter}/f"), (k % 50).cast("string"), F.lit(".cs")).alias("file"), k.cast("int").alias("line"), (k + place * 100_000_000).alias("seq"),
            )

        nations = nation.select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("nn"))
        customers = self.t("customer").join(nations, F.col("c_nationkey") == F.col("nk"))
        suppliers = self.t("supplier").join(nations, F.col("s_nationkey") == F.col("nk"))
        buyers = self.t("customer").select("c_custkey", "c_name")
        orders = self.t("orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left")
        segment = F.when(F.col("c_mktsegment") == "BUILDING", "BUILDING.Tests").otherwise(F.col("c_mktsegment"))
        parts = [
            rows(region, "R", "Class", "r_regionkey", F.col("r_name"), F.lit(None), F.lit("World"), 0),
            rows(at, "N", "Interface", "n_nationkey", F.col("n_name"), F.col("r_name"), F.col("r_name"), 1),
            rows(customers, "C", "Method", "c_custkey", F.col("c_name"), F.col("nn"), segment, 2),
            rows(suppliers, "S", "Property", "s_suppkey", F.col("s_name"), F.col("nn"), F.col("nn"), 3),
            rows(self.t("part"), "P", "Field", "p_partkey", F.col("p_name"), F.col("p_brand"), F.col("p_brand"), 4),
            rows(orders, "O", "Constructor", "o_orderkey", F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")), F.col("c_name"), F.col("o_orderpriority"), 5),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def kept_edges(self) -> DataFrame:
        """edges(), written once: loops read a table of edges, not six views of the base tables."""
        return cut(self.edges(), "edges")

    def edges(self) -> DataFrame:
        def rows(df, a, a_key, b, b_key, kind, via, file, line, seq):
            return df.select(
                F.concat(F.lit(f"{a}:"), F.col(a_key).cast("string")).alias("from"), F.concat(F.lit(f"{b}:"), F.col(b_key).cast("string")).alias("to"), kind.alias("kind"),
                file.alias("file"), line.cast("int").alias("line"), via.cast("string").alias("via"), seq.cast("long").alias("seq"),
            )

        none, call = F.lit(None), F.lit("call")
        nation, customer, supplier, orders, item = (self.t(n) for n in ("nation", "customer", "supplier", "orders", "lineitem"))
        kind = F.when(F.col("l_returnflag") == "A", "read").when(F.col("l_returnflag") == "R", "new").otherwise("call")
        via = F.when(F.col("l_linestatus") == "F", "interface")
        file = F.concat(F.lit("O/f"), (F.col("l_orderkey") % 50).cast("string"), F.lit(".cs"))
        place = F.col("l_orderkey") * 32 + F.col("l_linenumber") * 2
        big = 10_000_000_000
        parts = [
            rows(nation, "N", "n_nationkey", "R", "n_regionkey", F.lit("inherits"), none, F.lit("N.cs"), F.col("n_nationkey"), F.col("n_nationkey")),
            rows(customer, "C", "c_custkey", "N", "c_nationkey", call, F.when(F.col("c_acctbal") < 0, "override"), F.lit("C.cs"), F.col("c_custkey"), F.col("c_custkey") + big),
            rows(supplier, "S", "s_suppkey", "N", "s_nationkey", call, none, F.lit("S.cs"), F.col("s_suppkey"), F.col("s_suppkey") + 2 * big),
            rows(orders, "O", "o_orderkey", "C", "o_custkey", call, none, F.lit("O.cs"), F.col("o_orderkey"), F.col("o_orderkey") + 3 * big),
            rows(item, "O", "l_orderkey", "S", "l_suppkey", kind, via, file, F.col("l_linenumber"), place + 4 * big),
            rows(item, "O", "l_orderkey", "P", "l_partkey", F.lit("write"), none, file, F.col("l_linenumber"), place + 1 + 4 * big),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def entry_points(self) -> DataFrame:
        kind = F.when(F.col("o_orderstatus") == "F", "http").when(F.col("o_orderstatus") == "O", "job").otherwise("handler")
        key = F.col("o_orderkey")
        verb = F.when(kind == "http", F.when(key % 7 == 0, "ANY").otherwise(F.when(key % 2 == 0, "GET").otherwise("POST")))
        route = F.when(kind == "http", F.concat(F.lit("api/"), F.lower("o_orderpriority").substr(1, 1), F.lit("/orders/"), (key % 211).cast("string"), F.when(key % 3 == 0, "/{id?}").otherwise("")))
        return self.t("orders").where("o_orderpriority = '1-URGENT'").select(
            F.concat(F.lit("O:"), key.cast("string")).alias("id"), kind.alias("type"), verb.alias("httpMethod"), route.alias("route"), F.when(kind == "http", key % 5 == 0).alias("routeInferred"), key.cast("long").alias("seq")
        )

    def frontend_calls(self) -> DataFrame:
        key = F.col("event_id")
        base = key % 5 == 0
        tail = F.concat((key % 307).cast("string"), F.when(key % 4 == 0, "/{*}").otherwise(""))
        return self.t("events").select(
            F.concat(F.lit("fe:"), key.cast("string")).alias("id"), F.concat(F.lit("src/app/"), "event_type", F.lit("/c.ts")).alias("file"), (key % 1000).cast("int").alias("line"),
            F.when(key % 2 == 0, "GET").otherwise("POST").alias("httpMethod"), F.concat(F.when(base, "orders/").otherwise("api/1/orders/"), tail).alias("route"), F.col("event_type").alias("feature"),
            F.when(key % 11 == 0, "low").otherwise("high").alias("confidence"), base.alias("baseUrlDropped"), key.cast("long").alias("seq"),
        )

    def di(self) -> DataFrame:
        """Bindings of a nation's region to that nation, where a supplier there has a high balance."""
        rich = self.t("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()
        nation = self.t("nation").join(rich, F.col("n_nationkey") == F.col("k"))
        return nation.select(F.concat(F.lit("T:R"), F.col("n_regionkey").cast("string")).alias("service"), F.concat(F.lit("T:"), F.col("n_name")).alias("impl"))

    def tickets(self) -> DataFrame:
        """A ticket of each customer, over the files of the customer and the supplier of its number."""
        key = F.col("c_custkey")
        place = lambda letter: F.concat(F.lit(f"{letter}/f"), (key % 50).cast("string"), F.lit(".cs"))
        message = F.concat(F.lit("fix "), "c_name", F.lit(" for "), "c_mktsegment")
        return self.t("customer").select(F.concat(F.lit("#"), (key + 100).cast("string")).alias("ticket"), F.lit("2024-01-01").alias("date"), message.alias("message"), F.array(place("C"), place("S")).alias("files"))

    def commits(self) -> DataFrame:
        """Orders, newest first by key; files are their parts' numbers within 300 files, some without an allowed extension."""
        file = F.concat(F.lit("p/f"), (F.col("l_partkey") % 300).cast("string"), F.when(F.col("l_partkey") % 17 == 0, ".md").otherwise(".cs"))
        files = self.t("lineitem").select("l_orderkey", "l_linenumber", file.alias("file")).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "file"))), lambda x: x.file).alias("files"))
        key = F.col("o_orderkey")
        message = F.concat(F.lit("fix #"), (F.col("o_custkey") + 100).cast("string"), F.when(key % 5 == 0, F.concat(F.lit(" and #"), (key % 400 + 100).cast("string"))).otherwise(""))
        return self.t("orders").join(files, key == F.col("l_orderkey")).select(
            (-key).cast("long").alias("seq"), F.concat(F.lit("h"), key.cast("string")).alias("hash"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), message.alias("message"), "files", F.lit("").alias("body")
        )

    def source_files(self) -> DataFrame:
        """A file of each part in the folder of its brand, some in folders of their own."""
        key = F.col("p_partkey")
        sub = F.when(key % 10 == 0, "obj/").when(key % 10 == 1, "bin/").when(key % 10 == 2, "sub/bin/").when(key % 10 == 3, "Gen/").otherwise("")
        ending = F.when(key % 7 == 0, ".md").when(key % 7 == 1, ".g.cs").otherwise(".cs")
        return self.t("part").select(F.concat(F.lit("src/"), "p_brand", F.lit("/"), sub, F.lit("p"), key.cast("string"), ending).alias("file"))

    def project_files(self) -> DataFrame:
        """A project file of each brand; the brand's number says how its items are given."""
        digit = (F.substring_index("p_brand", "#", -1).cast("int") % 5).cast("string")
        least = F.expr("min(p_partkey) filter (where p_partkey % 10 = 0 and p_partkey % 7 > 1)").cast("string")
        sdk, plain = F.lit('<Project Sdk="Microsoft.NET.Sdk">'), F.lit('<Project xmlns="http://schemas.microsoft.com/developer/msbuild/2003">')
        items = (
            F.when(digit == "1", F.concat(sdk, F.lit("<ItemGroup>")))
            .when(digit == "2", F.concat(sdk, F.lit(r'<ItemGroup><Compile Remove="Gen\**\*.cs" />')))
            .when(digit == "3", F.concat(sdk, F.lit(r'<PropertyGroup><EnableDefaultCompileItems>false</EnableDefaultCompileItems></PropertyGroup><ItemGroup><Compile Include="**\*.g.cs" /><Compile Include="..\Brand#1\*.cs" />')))
            .when(digit == "4", F.concat(plain, F.lit(r'<ItemGroup><Compile Include="Gen\*" />')))
            .otherwise(F.concat(plain, F.lit(r'<ItemGroup><Compile Include="obj\p'), F.coalesce(least, F.lit("none")), F.lit('.cs" />')))
        )
        text = F.concat(items, F.lit(r'<ProjectReference Include="..\Brand#1/p.csproj" /></ItemGroup></Project>'))
        return self.t("part").groupBy("p_brand").agg(text.alias("text")).select(F.concat(F.lit("src/"), "p_brand", F.lit("/p.csproj")).alias("path"), "text")


# The same views for the oracle.
SYMBOLS_SQL = """symbols AS (
  SELECT 'R:' || r_regionkey AS id, 'Class' AS kind, r_name AS name, NULL::VARCHAR AS containing, 'World' AS project, 'R/f' || (r_regionkey % 50) || '.cs' AS file, r_regionkey::INT AS line, r_regionkey::BIGINT AS seq FROM region
  UNION ALL SELECT 'N:' || n_nationkey, 'Interface', n_name, r_name, r_name, 'N/f' || (n_nationkey % 50) || '.cs', n_nationkey, n_nationkey + 100000000 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'C:' || c_custkey, 'Method', c_name, n_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING.Tests' ELSE c_mktsegment END, 'C/f' || (c_custkey % 50) || '.cs', c_custkey, c_custkey + 200000000 FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'S:' || s_suppkey, 'Property', s_name, n_name, n_name, 'S/f' || (s_suppkey % 50) || '.cs', s_suppkey, s_suppkey + 300000000 FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'P:' || p_partkey, 'Field', p_name, p_brand, p_brand, 'P/f' || (p_partkey % 50) || '.cs', p_partkey, p_partkey + 400000000 FROM part
  UNION ALL SELECT 'O:' || o_orderkey, 'Constructor', 'Order#' || o_orderkey, c_name, o_orderpriority, 'O/f' || (o_orderkey % 50) || '.cs', o_orderkey, o_orderkey + 500000000 FROM orders LEFT JOIN customer ON o_custkey = c_custkey
)"""

EDGES_SQL = """edges AS (
  SELECT 'N:' || n_nationkey AS src, 'R:' || n_regionkey AS dst, 'inherits' AS kind, 'N.cs' AS file, n_nationkey::INT AS line, NULL::VARCHAR AS via, n_nationkey::BIGINT AS seq FROM nation
  UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey, 'call', 'C.cs', c_custkey::INT, CASE WHEN c_acctbal < 0 THEN 'override' END, c_custkey + 10000000000 FROM customer
  UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey, 'call', 'S.cs', s_suppkey::INT, NULL, s_suppkey + 20000000000 FROM supplier
  UNION ALL SELECT 'O:' || o_orderkey, 'C:' || o_custkey, 'call', 'O.cs', o_orderkey::INT, NULL, o_orderkey + 30000000000 FROM orders
  UNION ALL SELECT 'O:' || l_orderkey, 'S:' || l_suppkey, CASE l_returnflag WHEN 'A' THEN 'read' WHEN 'R' THEN 'new' ELSE 'call' END, 'O/f' || (l_orderkey % 50) || '.cs', l_linenumber::INT, CASE WHEN l_linestatus = 'F' THEN 'interface' END, l_orderkey * 32 + l_linenumber * 2 + 40000000000 FROM lineitem
  UNION ALL SELECT 'O:' || l_orderkey, 'P:' || l_partkey, 'write', 'O/f' || (l_orderkey % 50) || '.cs', l_linenumber::INT, NULL, l_orderkey * 32 + l_linenumber * 2 + 1 + 40000000000 FROM lineitem
)"""

ENTRIES_SQL = """entries AS (
  SELECT 'O:' || o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'http' WHEN 'O' THEN 'job' ELSE 'handler' END AS type,
    CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 7 = 0 THEN 'ANY' WHEN o_orderkey % 2 = 0 THEN 'GET' ELSE 'POST' END END AS verb,
    CASE WHEN o_orderstatus = 'F' THEN 'api/1/orders/' || (o_orderkey % 211) || CASE WHEN o_orderkey % 3 = 0 THEN '/{id?}' ELSE '' END END AS route, o_orderkey AS seq
  FROM orders WHERE o_orderpriority = '1-URGENT'
)"""

CALLS_SQL = """calls AS (
  SELECT 'fe:' || event_id AS id, 'src/app/' || event_type || '/c.ts' AS file, (event_id % 1000)::INT AS line, CASE WHEN event_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS verb,
    CASE WHEN event_id % 5 = 0 THEN 'orders/' ELSE 'api/1/orders/' END || (event_id % 307) || CASE WHEN event_id % 4 = 0 THEN '/{*}' ELSE '' END AS route,
    event_type AS feature, CASE WHEN event_id % 11 = 0 THEN 'low' ELSE 'high' END AS confidence, event_id % 5 = 0 AS dropped, event_id AS seq
  FROM events
)"""

DI_SQL = """di AS (
  SELECT 'T:R' || n_regionkey AS service, 'T:' || n_name AS impl FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
)"""

TICKETS_SQL = """tickets AS (
  SELECT '#' || (c_custkey + 100) AS ticket, 'fix ' || c_name || ' for ' || c_mktsegment AS message, ['C/f' || (c_custkey % 50) || '.cs', 'S/f' || (c_custkey % 50) || '.cs'] AS files FROM customer
)"""

COMMITS_SQL = """commits AS (
  SELECT -o_orderkey AS seq, 'h' || o_orderkey AS hash, strftime(o_orderdate, '%Y-%m-%d') AS date,
    'fix #' || (o_custkey + 100) || CASE WHEN o_orderkey % 5 = 0 THEN ' and #' || (o_orderkey % 400 + 100) ELSE '' END AS message,
    list('p/f' || (l_partkey % 300) || CASE WHEN l_partkey % 17 = 0 THEN '.md' ELSE '.cs' END ORDER BY l_linenumber) AS files
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate
), commit_files AS (SELECT DISTINCT seq, unnest(files) AS file FROM commits WHERE len(files) <= 100), kept AS (SELECT * FROM commit_files WHERE file LIKE '%.cs')"""

SOURCES_SQL = """sources AS (
  SELECT p_brand AS brand, p_partkey AS k, 'src/' || p_brand || '/' || CASE p_partkey % 10 WHEN 0 THEN 'obj/' WHEN 1 THEN 'bin/' WHEN 2 THEN 'sub/bin/' WHEN 3 THEN 'Gen/' ELSE '' END || 'p' || p_partkey
    || CASE p_partkey % 7 WHEN 0 THEN '.md' WHEN 1 THEN '.g.cs' ELSE '.cs' END AS file FROM part
), brands AS (SELECT brand, 'src/' || brand || '/p.csproj' AS project, (split_part(brand, '#', 2)::INT % 5)::VARCHAR AS digit, min(k) FILTER (k % 10 = 0 AND k % 7 > 1) AS least FROM sources GROUP BY brand)"""
