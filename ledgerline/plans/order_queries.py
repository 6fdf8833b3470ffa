"""Queries over orders, lines, keys and texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions.text import amount, dots, ean_check_digit, flat
from ledgerline.operators.keys import latest_per_key, near_join, upsert
from ledgerline.plans.trace_queries import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query("""WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS s, bool_and(l_extendedprice > 0 AND l_tax IS NOT NULL) AS priced FROM lineitem GROUP BY 1)
SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'F' THEN o_totalprice WHEN priced THEN s END, 2) AS total,
  CASE WHEN o_orderstatus = 'F' THEN 'order' WHEN priced THEN 'lines' ELSE 'none' END AS origin FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def order_asordered(spark, d):
    """The total as ordered: the header's where it is final, else the sum of its lines if all are priced."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"), F.bool_and((F.col("l_extendedprice") > 0) & F.col("l_tax").isNotNull()).alias("priced"))
    o = table(spark, d, "orders").join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    final = F.col("o_orderstatus") == "F"
    return o.select(
        "o_orderkey", F.round(F.when(final, F.col("o_totalprice")).when(F.col("priced"), F.col("s")), 2).alias("total"),
        F.when(final, "order").when(F.col("priced"), "lines").otherwise("none").alias("origin"),
    )


@query("""SELECT l_orderkey, bool_and(l_returnflag IS NOT DISTINCT FROM 'N') AS unchanged, bool_and(l_discount > 0) AS discounted,
  count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS returned, round(sum(l_quantity), 3) AS qty FROM lineitem GROUP BY 1""")
def order_line_flags(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.bool_and(F.col("l_returnflag").eqNullSafe(F.lit("N"))).alias("unchanged"), F.bool_and(F.col("l_discount") > 0).alias("discounted"),
        F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("returned"), F.round(F.sum("l_quantity"), 3).alias("qty"),
    )


@query("SELECT l_orderkey, round(sum(l_extendedprice::DECIMAL(18,4)), 2)::DOUBLE AS total FROM lineitem GROUP BY 1 HAVING round(sum(l_extendedprice::DECIMAL(18,4)), 0)::BIGINT % 100 = 0")
def lines_having_total(spark, d):
    """Orders whose lines come to a whole hundred. Prices are summed as decimals: a sum of floats that ends in a half is rounded up or down by the order in which it was added."""
    total = F.sum(F.col("l_extendedprice").cast("decimal(18,4)"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(total, 2).cast("double").alias("total"), F.round(total, 0).cast("long").alias("r")).filter("r % 100 = 0").drop("r")


@query("""WITH l AS (SELECT l_orderkey, bool_and(l_returnflag <> 'N') AS received, count(*) AS n, sum(l_extendedprice * (1 - l_discount)) AS net FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN l_orderkey IS NULL THEN 'unknown' WHEN o_orderstatus = 'F' AND o_totalprice > 0 THEN 'invoiced' WHEN NOT received THEN 'waiting' ELSE 'reconstructed' END AS state,
  round(net, 4) AS net FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def receipt_state(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") != "N").alias("received"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    o = table(spark, d, "orders").join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    state = F.when(F.col("l_orderkey").isNull(), "unknown").when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 0), "invoiced").when(~F.col("received"), "waiting").otherwise("reconstructed")
    return o.select("o_orderkey", state.alias("state"), F.round("net", 4).alias("net"))


@query("""WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS net, sum(l_extendedprice * (1 + l_tax)) AS gross, count(*) AS n FROM lineitem GROUP BY 1),
g AS (SELECT o_orderkey, o_totalprice, n, abs(o_totalprice - net) AS dn, abs(o_totalprice - gross) AS dg FROM orders JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey, CASE WHEN dn <= dg THEN 'before tax' ELSE 'with tax' END AS meaning, CASE WHEN least(dn, dg) <= 1000.0 * n + 0.005 THEN 'pass' ELSE 'fail' END AS status FROM g""")
def totals_within_allowance(spark, d):
    """The nearer reference total, and whether it is within the allowance of 1000 a document."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("net"), F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("gross"), F.count("*").alias("n"))
    g = table(spark, d, "orders").join(l, F.col("l_orderkey") == F.col("o_orderkey"))
    dn, dg = F.abs(F.col("o_totalprice") - F.col("net")), F.abs(F.col("o_totalprice") - F.col("gross"))
    return g.select("o_orderkey", F.when(dn <= dg, "before tax").otherwise("with tax").alias("meaning"), F.when(F.least(dn, dg) <= 1000.0 * F.col("n") + 0.005, "pass").otherwise("fail").alias("status"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL),
b AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.l_linenumber, b.l_linenumber) AS l_linenumber,
  CASE WHEN a.q IS NULL OR b.q IS NULL THEN 'unknown' WHEN abs(a.q - b.q) < 0.001 THEN 'pass' ELSE 'fail' END AS status FROM a FULL JOIN b USING (l_orderkey, l_linenumber)""")
def qty_reconcile(spark, d):
    side = lambda s, q: table(spark, d, "lineitem").filter(F.col("l_linestatus") == s).groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias(q))
    both = side("O", "a").join(side("F", "b"), ["l_orderkey", "l_linenumber"], "full")
    missing = F.col("a").isNull() | F.col("b").isNull()
    return both.select("l_orderkey", "l_linenumber", F.when(missing, "unknown").when(F.abs(F.col("a") - F.col("b")) < 0.001, "pass").otherwise("fail").alias("status"))


@query("""SELECT o_orderkey, CASE max(CASE WHEN l_shipdate < o_orderdate THEN 2 WHEN l_shipdate IS NULL THEN 1 ELSE 0 END) WHEN 0 THEN 'pass' WHEN 1 THEN 'unknown' ELSE 'fail' END AS status
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def dates_in_order(spark, d):
    """The worst of an order's lines."""
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    worst = F.max(F.when(F.col("l_shipdate") < F.col("o_orderdate"), 2).when(F.col("l_shipdate").isNull(), 1).otherwise(0))
    return j.groupBy("o_orderkey").agg(F.element_at(F.array(F.lit("pass"), F.lit("unknown"), F.lit("fail")), worst + 1).alias("status"))


@query("""WITH a AS (SELECT c_custkey, right(c_name, 6) AS k FROM customer), b AS (SELECT s_suppkey, right(s_name, 6) AS m FROM supplier)
SELECT c_custkey, s_suppkey, levenshtein(k, m)::INT AS edits FROM a, b WHERE k <> '' AND m <> '' AND levenshtein(k, m) <= 1""")
def near_keys_edit1(spark, d):
    a = table(spark, d, "customer").select("c_custkey", F.expr("right(c_name, 6)").alias("k"))
    b = table(spark, d, "supplier").select("s_suppkey", F.expr("right(s_name, 6)").alias("m"))
    return near_join(a, b, "k", "m").select("c_custkey", "s_suppkey", "edits")


@query("""WITH n AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS n, min(o_orderkey) AS k FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN n = 1 THEN k END AS o_orderkey, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'only' ELSE 'several' END AS reason FROM customer LEFT JOIN n ON o_custkey = c_custkey""")
def unique_key_or_hold(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderkey").alias("n"), F.min("o_orderkey").alias("k"))
    c = table(spark, d, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left")
    return c.select("c_custkey", F.when(F.col("n") == 1, F.col("k")).alias("o_orderkey"), F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, "only").otherwise("several").alias("reason"))


@query("""WITH s AS (SELECT *, coalesce(role = lag(role) OVER w AND turn = lag(turn) OVER w + 1, false) AS more FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
i AS (SELECT *, sum((NOT more)::INT) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS doc FROM s)
SELECT conv_id, doc::BIGINT AS doc, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM i GROUP BY conv_id, doc""")
def continuation_islands(spark, d):
    """A turn continues the document of the turn before it if it is next and of the same role."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    more = (F.col("role") == F.lag("role").over(w)) & (F.col("turn") == F.lag("turn").over(w) + 1)
    c = table(spark, d, "conversations").withColumn("doc", (~F.coalesce(more, F.lit(False))).cast("int"))
    c = c.withColumn("doc", F.sum("doc").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy("conv_id", "doc").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n"))


@query("""SELECT conv_id, turn, role, (dense_rank() OVER (PARTITION BY conv_id ORDER BY role = 'assistant', role) - 1) * 10000 + turn AS key FROM conversations""")
def order_page_numbering(spark, d):
    rank = F.dense_rank().over(Window.partitionBy("conv_id").orderBy(F.col("role") == "assistant", "role"))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", ((rank - 1).cast("long") * 10000 + F.col("turn")).alias("key"))


@query("""SELECT o_orderkey, CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'fp_missing' WHEN o_orderstatus = 'P' THEN 'waiting'
  WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'returned' END AS hold FROM orders""")
def hold_reasons(spark, d):
    """The first reason that holds; none: null."""
    l = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("returned"))
    o = table(spark, d, "orders").join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    hold = F.when(F.col("l_orderkey").isNull(), "fp_missing").when(F.col("o_orderstatus") == "P", "waiting").when(F.col("returned"), "returned")
    return o.select("o_orderkey", hold.alias("hold"))


@query("""WITH w AS (SELECT p_partkey, unnest(list_distinct(regexp_extract_all(upper(p_name), '[A-Z]{4,}'))) AS word FROM part), f AS (SELECT word, count(*) AS df FROM w GROUP BY 1)
SELECT word, df, CASE WHEN df <= 12 THEN 1.0::DOUBLE WHEN df <= 25 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM f""")
def store_word_df(spark, d):
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.upper("p_name"), F.lit("[A-Z]{4,}"), F.lit(0)))).alias("word")
    f = table(spark, d, "part").select("p_partkey", words).groupBy("word").agg(F.count("*").alias("df"))
    return f.withColumn("weight", F.when(F.col("df") <= 12, 1.0).when(F.col("df") <= 25, 0.5).otherwise(0.0))


@query("""SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_totalprice > 200000) AS large,
  count(DISTINCT o_custkey) FILTER (o_totalprice > 200000) AS large_customers, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1""")
def filtered_counts(spark, d):
    large = F.col("o_totalprice") > 200000
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(large).alias("large"),
        F.count_distinct(F.when(large, F.col("o_custkey"))).alias("large_customers"), F.round(F.avg("o_totalprice"), 4).alias("mean"),
    )


@query("""SELECT n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""")
def chain_names_counts(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return c.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT sha256(text) AS sha, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_dedupe(spark, d):
    return table(spark, d, "documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


@query("SELECT md5(regexp_replace(upper(replace(text, 'ß', 'ss')), '[^0-9A-Z]', '', 'g')) AS h, min(doc_id) AS first_id, count(*) AS n FROM documents WHERE regexp_replace(upper(replace(text, 'ß', 'ss')), '[^0-9A-Z]', '', 'g') <> '' GROUP BY 1")
def flat_dedupe(spark, d):
    f = table(spark, d, "documents").select("doc_id", flat(F.col("text")).alias("f")).filter("f <> ''")
    return f.groupBy(F.md5("f").alias("h")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


@query("SELECT sha256(html) AS sha, min(page_id) AS first_id, count(*) AS n FROM pages WHERE html IS NOT NULL GROUP BY 1")
def html_pages_dedupe(spark, d):
    return table(spark, d, "pages").filter("html is not null").groupBy(F.sha2("html", 256).alias("sha")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))


@query(r"SELECT doc_id, list_distinct(regexp_extract_all(text, '(^|[^0-9])([0-9]{16})([^0-9]|$)', 2))[1] AS id FROM documents WHERE len(list_distinct(regexp_extract_all(text, '(^|[^0-9])([0-9]{16})([^0-9]|$)', 2))) = 1")
def id_extraction(spark, d):
    """The only number of 16 digits that stands alone in a text."""
    ids = F.array_distinct(F.regexp_extract_all("text", F.lit("(^|[^0-9])([0-9]{16})([^0-9]|$)"), F.lit(2)))
    return table(spark, d, "documents").select("doc_id", ids.alias("ids")).filter("size(ids) = 1").select("doc_id", F.col("ids")[0].alias("id"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS value, replace(replace(replace(format('{:,.2f}', round(o_totalprice, 2)), ',', '_'), '.', ','), '_', '.') AS printed FROM orders")
def amount_parse(spark, d):
    """Printed with dots and a decimal comma, and read again."""
    printed = dots(F.round("o_totalprice", 2))
    return table(spark, d, "orders").select("o_orderkey", F.round(amount(printed), 2).alias("value"), printed.alias("printed"))


@query("""SELECT p_partkey, (10 - list_sum(list_transform(range(1, 13), lambda i: (substr(lpad(p_partkey::VARCHAR, 12, '0'), i::INT, 1))::INT * (CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END))) % 10) % 10 AS digit FROM part""")
def ean_check(spark, d):
    return table(spark, d, "part").select("p_partkey", ean_check_digit(F.lpad(F.col("p_partkey").cast("string"), 12, "0")).cast("long").alias("digit"))


@query("SELECT d.doc_id FROM documents d WHERE d.n_chars < 500 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unsure_unlabelled(spark, d):
    return table(spark, d, "documents").filter("n_chars < 500").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("""SELECT source, count(*) FILTER (quality = 1) AS before_right, count(*) FILTER (quality = 1 AND toxic = 0) AS after_right, count(*) FILTER (quality = 0 AND toxic = 1) AS new_wrong,
  CASE WHEN count(*) FILTER (quality = 0 AND toxic = 1) = 0 THEN 'pass' ELSE 'fail' END AS verdict, round(avg(quality), 3) AS confidence FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def pass_fail_gate(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    wrong = F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1))
    return j.groupBy("source").agg(
        F.count_if(F.col("quality") == 1).alias("before_right"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("after_right"), wrong.alias("new_wrong"),
        F.when(wrong == 0, "pass").otherwise("fail").alias("verdict"), F.round(F.avg("quality"), 3).alias("confidence"),
    )


@query("""SELECT kind, id, name FROM (SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, row_number() OVER (ORDER BY c_custkey DESC) AS n FROM customer WHERE c_name ILIKE '%00012%'
UNION ALL SELECT 'part', p_partkey, p_name, row_number() OVER (ORDER BY p_partkey DESC) FROM part WHERE p_name ILIKE '%00012%'
UNION ALL SELECT 'supplier', s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey DESC) FROM supplier WHERE s_name ILIKE '%00012%') WHERE n <= 20""")
def search_three_entities(spark, d):
    """The 20 newest of each kind that hold the words sought."""
    def of(kind, key, name):
        return table(spark, d, kind).filter(F.col(name).ilike("%00012%")).orderBy(F.desc(key)).limit(20).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(name).alias("name"))

    return of("customer", "c_custkey", "c_name").union(of("part", "p_partkey", "p_name")).union(of("supplier", "s_suppkey", "s_name"))


@query("""SELECT k, 'both' AS side FROM (SELECT o_orderkey AS k FROM orders INTERSECT SELECT l_orderkey FROM lineitem)
UNION ALL SELECT k, 'orders' FROM (SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem)""")
def set_ops_keys(spark, d):
    o, l = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select("l_orderkey")
    return o.intersect(l).withColumn("side", F.lit("both")).union(o.subtract(l).withColumn("side", F.lit("orders")))


@query(f"""WITH new AS (SELECT {', '.join(LINE)} FROM lineitem WHERE l_orderkey % 7 = 0 AND l_linestatus = 'F')
SELECT {', '.join(LINE)} FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM new) UNION ALL SELECT * FROM new""")
def upsert_replace_lines(spark, d):
    """A newer export replaces all lines of the orders it names, and no others."""
    old = table(spark, d, "lineitem").select(*LINE)
    new = table(spark, d, "lineitem").filter("l_orderkey % 7 = 0 and l_linestatus = 'F'").select(*LINE)
    return upsert(old, new, ["l_orderkey"])


@query(f"SELECT {', '.join(LINE)} FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1")
def keep_last_line(spark, d):
    order = [F.desc(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    return latest_per_key(table(spark, d, "lineitem").select(*LINE, "l_shipdate"), ["l_orderkey", "l_linenumber"], *order).select(*LINE)


@query("""SELECT conv_id, turn, role, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 AS page_from,
  sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)::BIGINT AS page_to FROM conversations""")
def publish_page_ref(spark, d):
    """Positions of each part in what is published: running sums of sizes."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text")).over(w)
    return table(spark, d, "conversations").select("conv_id", "turn", "role", (end - F.length("text") + 1).alias("page_from"), end.alias("page_to"))


@query("""WITH a AS (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS n, bool_or(l_linestatus = 'O') AS open FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'outside' WHEN open THEN 'waiting' WHEN o_orderstatus = 'F' THEN 'ready' ELSE 'need' END AS state FROM orders LEFT JOIN a ON l_orderkey = o_orderkey""")
def steps_state(spark, d):
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_linestatus") == "O").alias("open"))
    o = table(spark, d, "orders").join(a, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return o.select("o_orderkey", F.when(F.col("l_orderkey").isNull(), "outside").when(F.col("open"), "waiting").when(F.col("o_orderstatus") == "F", "ready").otherwise("need").alias("state"))
