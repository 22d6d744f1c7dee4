"""Sources, sinks and storage."""

from pyspark.sql import functions as F

from ..sources import filings as FL
from ..sources import logs as LG
from ..session import scratch_folder
from ..sources import store as S
from .family_o import TRADES, trades
from .inputs import BARS, bars, table
from .registry import query

SPEC = "symbol ts! open:8 high:8 low:8 close:8 volume:2"
IN = "inc AS (SELECT symbol, CAST(ts + INTERVAL 400 DAY AS DATE) AS ts, close AS open, high, low, open AS close, volume + 1 AS volume FROM bars WHERE volume % 3 = 0)"


def incoming(spark, d):
    return bars(spark, d).where("volume % 3 = 0").select("symbol", F.date_add("ts", 400).alias("ts"), F.col("close").alias("open"), "high", "low",
                                                         F.col("open").alias("close"), (F.col("volume") + 1).alias("volume"))


@query("a01_bar_scan", SPEC, BARS + ", result AS (SELECT * FROM bars WHERE symbol = 'Brand#7' AND ts >= DATE '1997-01-01' AND ts <= DATE '1998-12-31')")
def a01(spark, d):
    return S.scan(bars(spark, d), "Brand#7", "1997-01-01", "1998-12-31")


UP = BARS + f", {IN}, result AS (SELECT * FROM inc UNION ALL SELECT * FROM bars b WHERE NOT EXISTS (SELECT 1 FROM inc i WHERE i.symbol = b.symbol AND i.ts = b.ts))"


@query("a02_bar_upsert", SPEC, UP)
def a02(spark, d):
    return S.upsert(bars(spark, d).withColumn("interval", F.lit("1d")), incoming(spark, d).withColumn("interval", F.lit("1d")))


@query("a03_clear_symbol", SPEC, BARS + ", result AS (SELECT * FROM bars WHERE symbol <> 'Brand#7')")
def a03(spark, d):
    return S.clear(bars(spark, d), "Brand#7")


@query("a05_append_keep_last", SPEC, UP)
def a05(spark, d):
    return S.append_keep_last(bars(spark, d), incoming(spark, d))


@query("a06_infer_frequency", "symbol gap_days#", BARS + """, g AS (SELECT symbol, datediff('day', lag(ts) OVER (PARTITION BY symbol ORDER BY ts), ts) AS gap FROM bars),
n AS (SELECT symbol, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2), result AS (SELECT symbol, arg_max(gap, n * 100000 - gap) AS gap_days FROM n GROUP BY symbol)""")
def a06(spark, d):
    return S.infer_frequency(bars(spark, d))


CAT = BARS + ", result AS (SELECT symbol, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts, 'lineitem' AS source, '1d' AS frequency, true AS updated FROM bars GROUP BY symbol)"


@query("a04_save_metadata", "symbol rows# first_ts! last_ts! source frequency updated", CAT)
def a04(spark, d):
    """Saved twice: the second batch holds some symbols again, whose entries are replaced."""
    store = S.BarStore(spark, scratch_folder(spark, "bars"))
    store.save_described(bars(spark, d), "lineitem")
    store.save_described(bars(spark, d).where("symbol like 'Brand#1%'"), "lineitem")
    return store.described().withColumn("updated", F.col("last_updated").isNotNull())


@query("a06_ohlcv_load", "symbol ts! open:8 high:8 low:8 close:8 volume:2 gap_days#", BARS + """, l AS (SELECT * FROM bars WHERE ts >= DATE '1994-01-01' AND ts <= DATE '1996-12-31'),
g AS (SELECT symbol, datediff('day', lag(ts) OVER (PARTITION BY symbol ORDER BY ts), ts) AS gap FROM l),
n AS (SELECT symbol, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2), f AS (SELECT symbol, arg_max(gap, n * 100000 - gap) AS gap_days FROM n GROUP BY symbol),
result AS (SELECT l.*, gap_days FROM l LEFT JOIN f USING (symbol))""")
def a06b(spark, d):
    store = S.BarStore(spark, scratch_folder(spark, "bars"))
    store.save(bars(spark, d).withColumn("interval", F.lit("1d")))
    return store.load_regular(start="1994-01-01", end="1996-12-31")


query("a07_catalog", "symbol rows# first_ts! last_ts! source frequency updated", CAT)(lambda spark, d: S.catalog(bars(spark, d), "lineitem").withColumn("updated", F.lit(True)))


def log(spark, d):
    t = trades(spark, d)
    meta = F.map_from_arrays(F.array(F.lit("user"), F.lit("seq")), F.array(F.col("user_id").cast("string"), F.when(F.col("user_id") % 2 == 0, F.col("seq").cast("string"))))
    return t.withColumns({"slippage": F.lit(0.0), "metadata": meta})


@query("a10_log_csv_columns", "symbol ts@ side qty:2 price:2 strategy metadata_user metadata_seq", TRADES + """, result AS (SELECT symbol, ts, side, qty, price, strategy,
  CAST(user_id AS VARCHAR) AS metadata_user, CASE WHEN user_id % 2 = 0 THEN CAST(seq AS VARCHAR) END AS metadata_seq FROM tr)""")
def a10(spark, d):
    return LG.metadata_columns(log(spark, d), ["user", "seq"])


@query("a11_log_fold", "symbol ts@ side qty:2 price:2 strategy keys# user", TRADES + """, result AS (SELECT symbol, ts, side, qty, price, strategy,
  CASE WHEN user_id % 2 = 0 THEN 2 ELSE 1 END AS keys, CAST(user_id AS VARCHAR) AS user FROM tr)""")
def a11(spark, d):
    f = LG.fold_metadata(LG.metadata_columns(log(spark, d), ["user", "seq"]))
    return f.withColumns({"keys": F.size("metadata"), "user": F.col("metadata")["user"]})


LOGGED = "symbol ts@ side qty:2 price:2 strategy metadata_user metadata_seq"
LOG_SQL = TRADES + """, result AS (SELECT symbol, ts, side, qty, price, strategy, CAST(user_id AS VARCHAR) AS metadata_user, CASE WHEN user_id % 2 = 0 THEN CAST(seq AS VARCHAR) END AS metadata_seq FROM tr)"""


@query("a10_log_csv_files", LOGGED, LOG_SQL)
def a10b(spark, d):
    path = scratch_folder(spark, "log-csv")
    LG.write_csv(log(spark, d), path, ["user", "seq"])
    return LG.metadata_columns(LG.read_csv(spark, path), ["user", "seq"])


@query("a11_log_json_files", LOGGED, LOG_SQL)
def a11b(spark, d):
    path = scratch_folder(spark, "log-json")
    LG.write_json(log(spark, d), path)
    return LG.metadata_columns(LG.read_json(spark, path), ["user", "seq"])


def panel(b, names):
    fields = ["open", "high", "low", "close", "volume"]
    wide = b.groupBy("ts").agg(*[F.max(F.when(F.col("symbol") == s, F.col(f))).alias(f"{f}_{s}") for s in names for f in fields])
    return S.wide_to_panel(wide, names, fields)


@query("a12_wide_to_panel", SPEC, BARS + ", result AS (SELECT * FROM bars)")
def a12(spark, d):
    b = bars(spark, d)
    return panel(b, sorted(r[0] for r in b.select("symbol").distinct().collect()))


@query("a13_filing_list", "cik# form date accession url", """
o AS (SELECT o_custkey AS cik, CASE WHEN o_orderpriority = '1-URGENT' THEN '10-K' WHEN o_orderpriority = '2-HIGH' THEN '10-Q' ELSE '8-K' END AS form, strftime(o_orderdate, '%Y-%m-%d') AS date,
  CAST(o_orderkey AS VARCHAR) || '-' || strftime(o_orderdate, '%y') || '-1' AS accession, o_orderkey FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY o_orderkey) AS rn FROM o WHERE form = '10-K'),
result AS (SELECT cik, form, date, accession, 'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || replace(accession, '-', '') || '/' || accession || '-index.htm' AS url FROM r WHERE rn <= 2)""")
def a13(spark, d):
    o = table(spark, d, "orders")
    form = F.when(F.col("o_orderpriority") == "1-URGENT", "10-K").when(F.col("o_orderpriority") == "2-HIGH", "10-Q").otherwise("8-K")
    acc = F.concat(F.col("o_orderkey").cast("string"), F.lit("-"), F.date_format("o_orderdate", "yy"), F.lit("-1"))
    g = o.groupBy(F.col("o_custkey").alias("cik")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", form.alias("f"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), acc.alias("a")))).alias("r"))
    pick = lambda c: F.transform("r", lambda e: e[c])
    js = F.to_json(F.struct(F.struct(F.struct(pick("f").alias("form"), pick("d").alias("filingDate"), pick("a").alias("accessionNumber")).alias("recent")).alias("filings")))
    return FL.filings(g.select("cik", js.alias("json")), limit=2)


@query("a14_statements", "cik date Revenues:4 GrossProfit:4 NetIncomeLoss:4", """
f AS (SELECT p_brand AS cik, strftime(date_trunc('year', l_shipdate), '%Y-%m-%d') AS date, max(l_extendedprice) AS Revenues, max(l_quantity) AS GrossProfit, min(l_extendedprice) AS NetIncomeLoss
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), result AS (SELECT * FROM f WHERE CAST(substr(date, 4, 1) AS INT) % 2 = 0)""")
def a14(spark, d):
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    f = l.join(p, l.l_partkey == p.p_partkey).groupBy(F.col("p_brand").alias("cik"), F.date_format(F.date_trunc("year", "l_shipdate"), "yyyy-MM-dd").alias("end")).agg(
        F.max("l_extendedprice").alias("Revenues"), F.max("l_quantity").alias("GrossProfit"), F.min("l_extendedprice").alias("NetIncomeLoss"))
    form = F.when(F.substring("end", 4, 1).cast("int") % 2 == 0, "10-K").otherwise("10-Q")
    item = lambda c: F.collect_list(F.struct("end", F.col(c).alias("val"), form.alias("form"))).alias(c)
    g = f.groupBy("cik").agg(item("Revenues"), item("GrossProfit"), item("NetIncomeLoss"))
    unit = lambda c, u: F.struct(F.create_map(F.lit(u), F.col(c)).alias("units"))
    facts = F.create_map(F.lit("us-gaap"), F.create_map(F.lit("Revenues"), unit("Revenues", "USD"), F.lit("GrossProfit"), unit("GrossProfit", "shares"), F.lit("NetIncomeLoss"), unit("NetIncomeLoss", "USD")))
    return FL.statements(g.select("cik", F.to_json(F.struct(facts.alias("facts"))).alias("json")))


@query("a15_html_tables", "page_id# table_no# row_no# name balance", """
s AS (SELECT s_nationkey AS page_id, s_name, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) - 1 AS row_no FROM supplier),
result AS (SELECT page_id, 0 AS table_no, row_no, s_name AS name, 'v' || CAST(floor(s_acctbal) AS BIGINT) AS balance FROM s)""")
def a15(spark, d):
    s = table(spark, d, "supplier")
    row = F.concat(F.lit("<tr><td>"), "s_name", F.lit("</td><td>v"), F.floor("s_acctbal").cast("string"), F.lit("</td></tr>"))
    g = s.groupBy(F.col("s_nationkey").cast("long").alias("page_id")).agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("b"))
    pages = g.select("page_id", F.concat(F.lit("<p>x</p><table><tr><th>name</th><th>balance</th></tr>"), "b", F.lit("<tr><td>short</td></tr></table>")).alias("html"))
    t = FL.html_tables(pages)
    return t.withColumns({"name": F.col("cells")["name"], "balance": F.col("cells")["balance"]})


def _stored(spark, d, fmt="parquet"):
    st = S.BarStore(spark, scratch_folder(spark, "bars"), fmt)
    st.save(bars(spark, d).withColumn("interval", F.lit("1d")))
    return st


@query("a08_delete_symbol", SPEC, BARS + ", result AS (SELECT * FROM bars WHERE symbol <> 'Brand#7')")
def a08(spark, d):
    st = _stored(spark, d)
    st.delete("Brand#7")
    return st.load()


@query("a09_format_migration", SPEC, BARS + ", result AS (SELECT * FROM bars)")
def a09(spark, d):
    return _stored(spark, d).migrate(scratch_folder(spark, "orc"), "orc").load()
