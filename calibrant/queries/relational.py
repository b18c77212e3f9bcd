"""Scans, filters, joins, aggregates, windows and sets on the star-schema fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibrant.functions.structure import before_cutoff
from calibrant.operators import relational as R
from calibrant.plans import views as V
from calibrant.queries._registry import Registry
from calibrant.sources import sinks
from calibrant.sources.tables import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND value > 10")
def scan_project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", ["event_id", "user_id", "value", "event_type"]).where("event_type = 'click' AND value > 10").drop("event_type")


@query("""SELECT o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey
          WHERE o_orderdate < TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1""")
def flt_dual_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey)
    early = before_cutoff("1996-01-01T00:00:00Z", F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp"))
    return joined.where(early).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(f"WITH {V.SQL_LINES} SELECT detector, set, count(*) AS n FROM c_line WHERE set = 'P' OR (set = 'N1' AND matched) GROUP BY 1, 2")
def flt_compound_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calibrant.functions.stats import is_matched, is_positive

    return V.lines(spark, sf_dir).where(is_positive() | is_matched()).groupBy("detector", "set").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n, count_if(value > 50) AS high, count_if(user_id IN (1, 2, 3, 5, 8, 13)) AS listed, count_if(value > 20 AND value <= 40) AS middle FROM events""")
def flt_members_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.count_if(v > 50).alias("high"), F.count_if(F.col("user_id").isin(1, 2, 3, 5, 8, 13)).alias("listed"), F.count_if((v > 20) & (v <= 40)).alias("middle"))


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def join_inner_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    return orders.join(customers, orders.o_custkey == customers.c_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT o_orderpriority, CAST(sum(k) AS BIGINT) AS n FROM (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def join_preagg(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_order = table(spark, sf_dir, "lineitem", ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("k"))
    orders = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority"])
    return per_order.join(orders, per_order.l_orderkey == orders.o_orderkey).groupBy("o_orderpriority").agg(F.sum("k").alias("n"))


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 2")
def join_left_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = R.keep_first(table(spark, sf_dir, "nation").where("n_regionkey <> 2"), ["n_nationkey"], "n_name")
    customers = table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    return customers.join(names, customers.c_nationkey == names.n_nationkey, "left").select("c_custkey", "n_name")


@query("""WITH first AS (SELECT l_orderkey, p_brand, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem JOIN part ON l_partkey = p_partkey)
          SELECT o_orderkey AS issue_id, p_brand AS agent FROM orders JOIN first ON o_orderkey = l_orderkey WHERE k = 1""")
def join_two_hop_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("issue_id"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("double").alias("issue_id"), F.col("l_partkey").cast("double").alias("pr_id"), F.col("l_linenumber").alias("link_order"))
    agents = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pr_id"), F.col("p_brand").alias("agent"))
    return R.first_link(issues, links, agents)


@query("""SELECT a.genre, a.n, b.toxic FROM (SELECT lang AS genre, count(*) AS n FROM documents GROUP BY 1) a
          LEFT JOIN (SELECT lang AS genre, CAST(sum(l.toxic) AS BIGINT) AS toxic FROM documents d JOIN labels l USING (doc_id) WHERE lang <> 'de' GROUP BY 1) b ON a.genre = b.genre""")
def join_left_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "lang"]).withColumnRenamed("lang", "genre")
    counts = docs.groupBy("genre").agg(F.count("*").alias("n"))
    toxic = docs.where("genre <> 'de'").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("genre").agg(F.sum("toxic").alias("toxic"))
    return counts.join(toxic, ["genre"], "left")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = table(spark, sf_dir, "customer", ["c_custkey"]), table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return customers.join(orders, customers.c_custkey == orders.o_custkey, "left_semi")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, items = table(spark, sf_dir, "part", ["p_partkey"]), table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return sinks.todo(parts, items, "p_partkey")


@query("""SELECT coalesce(a.k, b.k) AS n_nationkey, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers
          FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a
          FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k""")
def join_full_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "n_nationkey", "full").na.fill(0, ["customers", "suppliers"])


@query("""SELECT s_nationkey, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT l_suppkey) AS returned
          FROM supplier LEFT JOIN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49) ON l_suppkey = s_suppkey GROUP BY 1""")
def join_optional_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    returned = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 49").select("l_suppkey").distinct()
    return suppliers.join(returned, suppliers.s_suppkey == returned.l_suppkey, "left").groupBy("s_nationkey").agg(F.count_distinct("s_suppkey").alias("suppliers"), F.count_distinct("l_suppkey").alias("returned"))


@query("""(SELECT doc_id, 'left' AS side FROM documents EXCEPT ALL SELECT doc_id, 'left' FROM labels)
          UNION ALL (SELECT doc_id, 'right' FROM labels EXCEPT ALL SELECT doc_id, 'right' FROM documents)""")
def join_positional_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unmatched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT doc_id, CASE WHEN toxic IS NULL THEN NULL ELSE quality = toxic END AS same FROM documents LEFT JOIN labels USING (doc_id)")
def join_identity_tristate(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents", ["doc_id"]).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", R.same_or_unknown(F.col("quality"), F.col("toxic")).alias("same"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def agg_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", ["lang", "source"]).groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("SELECT event_type, n, round(n / sum(n) OVER (), 9) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def agg_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.shares(table(spark, sf_dir, "events"), ["event_type"]).withColumn("share", F.round("share", 9))


@query("""SELECT event_type, count(DISTINCT user_id) AS users, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1""")
def agg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events)")
def agg_key_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_type").distinct().agg(F.count("*").alias("n"))


@query("""SELECT lang, round(quantile_cont(n_chars, 0.1), 6) AS p10, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.99), 6) AS p99 FROM documents GROUP BY 1""")
def agg_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = [F.round(F.percentile("n_chars", F.lit(p)), 6).alias(f"p{round(100 * p)}") for p in (0.1, 0.5, 0.9, 0.99)]
    return table(spark, sf_dir, "documents").groupBy("lang").agg(*q)


@query("""SELECT source, count(*) AS n_rows, round(100 * avg(CASE WHEN length(text) = 0 THEN 1.0 ELSE 0.0 END), 1) AS empty_pct, CAST(trunc(quantile_cont(length(text), 0.5)) AS INTEGER) AS median,
          CAST(trunc(avg(length(text))) AS INTEGER) AS mean, CAST(trunc(quantile_cont(length(text), 0.9)) AS INTEGER) AS p90, CAST(trunc(quantile_cont(length(text), 0.99)) AS INTEGER) AS p99 FROM documents GROUP BY 1""")
def agg_describe_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.describe_lengths(table(spark, sf_dir, "documents"), ["source"], "text")


@query("""SELECT l_returnflag, count(*) AS n, count_if(l_discount > 0.05) AS discounted, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open, round(100 * avg(CASE WHEN l_tax = 0 THEN 1.0 ELSE 0.0 END), 6) AS untaxed_pct FROM lineitem GROUP BY 1""")
def agg_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.sum(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("open"), F.round(100 * F.avg((F.col("l_tax") == 0).cast("double")), 6).alias("untaxed_pct")
    )


@query("SELECT year(o_orderdate) AS year, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1, 2")
def agg_year_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").groupBy(F.year(day).alias("year"), F.date_format(day, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("""SELECT lang AS genre, count(*) AS n, count(quality) AS scored, round(100.0 * (count(*) - count(quality)) / count(*), 2) AS missing_pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def agg_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents", ["doc_id", "lang"]).join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("lang").alias("genre"), F.col("quality").alias("score"))
    return R.coverage(joined, ["genre"])


@query("""SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS f, round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 4) AS o, round(avg(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 4) AS p FROM orders GROUP BY 1""")
def agg_pivot_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivot = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice"))
    return pivot.select("o_orderpriority", *[F.round(c, 4).alias(c.lower()) for c in ("F", "O", "P")])


@query("""SELECT o_orderstatus, list_sort(list(DISTINCT o_orderpriority)) AS kinds, len(list(DISTINCT o_orderpriority)) AS n FROM orders GROUP BY 1""".replace("list_sort(list(DISTINCT o_orderpriority)) AS kinds", "array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS kinds"))
def agg_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array_sort(F.collect_set("o_orderpriority"))
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.array_join(kinds, ",").alias("kinds"), F.size(kinds).cast("long").alias("n"))


@query("""WITH c AS (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1), r AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM c)
          SELECT min(k) AS least, max(CASE WHEN i = n // 2 THEN k END) AS middle, max(k) AS most, round(100 * avg(CASE WHEN k >= 10 THEN 1.0 ELSE 0.0 END), 6) AS share FROM r""")
def agg_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"))
    # the middle value from a histogram of counts: a few rows, whatever the number of customers
    bars = counts.groupBy("k").agg(F.count("*").alias("n"))
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = bars.select("k", "n", F.sum("n").over(w).alias("upto"), total.alias("total"))
    return placed.agg(F.min("k").alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("k"))).alias("middle"), F.max("k").alias("most"), F.round(100 * F.sum(F.when(F.col("k") >= 10, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("share"))


@query("""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT round(max(n) / sum(n), 9) AS top_share, round(min(n) / sum(n), 9) AS low_share, round(avg(n), 6) AS mean FROM c""")
def agg_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.agg(F.round(F.max("n") / F.sum("n"), 9).alias("top_share"), F.round(F.min("n") / F.sum("n"), 9).alias("low_share"), F.round(F.avg("n"), 6).alias("mean"))


@query("""SELECT count(*) AS before, count_if(length(text) >= 500) AS after, count_if(length(text) < 500) AS dropped FROM documents""")
def agg_filter_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("before"), F.count_if(n >= 500).alias("after"), F.count_if(n < 500).alias("dropped"))


@query("""WITH v AS (SELECT l_returnflag AS k, l_quantity AS v FROM lineitem), r AS (SELECT k, v, avg(i) AS rank, count(*) AS n FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) AS i FROM v) GROUP BY 1, 2)
          SELECT k AS l_returnflag, v AS l_quantity, n, rank FROM r""")
def win_avg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.average_rank(table(spark, sf_dir, "lineitem", ["l_returnflag", "l_quantity"]), ["l_returnflag"], "l_quantity")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('7|' || CAST(event_id AS VARCHAR)), event_id) AS k FROM events) WHERE k <= 3""")
def win_first_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calibrant.functions.structure import hash_order

    return R.first_n(table(spark, sf_dir, "events", ["user_id", "event_id"]), ["user_id"], 3, hash_order(7, F.col("event_id")), "event_id")


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1".replace("text, min(doc_id)", "md5(text) AS key, min(doc_id)"))
def win_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents", ["doc_id", "text"]).select(F.md5("text").alias("key"), "doc_id")
    return R.keep_first(keyed, ["key"], "doc_id")


@query("""WITH c AS (SELECT l_linestatus AS k, l_discount AS v, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT a.k AS l_linestatus, a.v AS l_discount, a.n, CAST(sum(b.n) AS BIGINT) AS upto FROM c a JOIN c b ON a.k = b.k AND b.v >= a.v GROUP BY 1, 2, 3""")
def win_threshold_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem", ["l_linestatus", "l_discount"]).groupBy("l_linestatus", "l_discount").agg(F.count("*").alias("n"))
    walked = R.prefix_sums(counts, ["l_linestatus"], "l_discount", ["n"], descending=True)
    return walked.select("l_linestatus", "l_discount", "n", (F.col("n_before") + F.col("n")).alias("upto"))


@query("""WITH m AS (SELECT o_orderpriority AS detector, o_orderstatus AS genre, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
          SELECT a.detector, a.genre, a.v = b.hi AS is_max, a.v = b.lo AS is_min FROM m a JOIN (SELECT detector, max(v) AS hi, min(v) AS lo FROM m GROUP BY 1) b USING (detector)""")
def win_row_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calibrant.plans.report import highlighted

    means = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("detector"), F.col("o_orderstatus").alias("genre")).agg(F.avg("o_totalprice").alias("v"))
    return highlighted(means, "v").drop("shown")


@query("""SELECT lang, n, CAST(round_even(n / total * 150, 0) AS INTEGER) AS quota FROM (SELECT lang, count(*) AS n, (SELECT count(*) FROM documents WHERE lang IS NOT NULL) AS total FROM documents WHERE lang IS NOT NULL GROUP BY 1)""")
def win_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quotas(table(spark, sf_dir, "documents", ["lang"]), "lang", 150)


@query("SELECT p_type, max(p_retailprice) AS top FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6")
def sort_topk_langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.max("p_retailprice").alias("top")).orderBy(F.col("top").desc(), "p_type").limit(6)


@query("SELECT r_name, position, n FROM (SELECT r_name, row_number() OVER (ORDER BY r_name DESC) - 1 AS position, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region)".replace("row_number() OVER (ORDER BY r_name DESC) - 1", "CAST(row_number() OVER (ORDER BY r_name DESC) - 1 AS INTEGER)"))
def sort_custom_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from calibrant.schemas import dimension

    regions = table(spark, sf_dir, "region")
    names = sorted((r.r_name for r in regions.collect()), reverse=True)  # five rows
    counts = table(spark, sf_dir, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
    return R.ordered_by(counts, dimension(spark, {n: n for n in names}, "r_name"), "r_name").select("r_name", "position", "n")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS source_id, 'customer' AS kind, c_mktsegment AS segment FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'supplier', NULL FROM supplier""")
def set_union_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("source_id"), F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("source_id"), F.lit("supplier").alias("kind"))
    return R.union_all(a, R.align(b, ["source_id", "kind"]))


@query("""SELECT key, min(origin) AS origin FROM (SELECT o_custkey AS key, 1 AS origin FROM orders UNION ALL SELECT c_custkey, 2 FROM customer) GROUP BY 1""")
def set_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.lit(1).alias("origin"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit(2).alias("origin"))
    return R.keep_first(R.union_all(a, b), ["key"], "origin")


@query("SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).subtract(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")))


@query("SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")).intersect(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key")))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def set_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()


@query("""WITH a AS (SELECT user_id, event_id AS version, value, 0 AS fresh FROM events WHERE event_type <> 'click'), b AS (SELECT user_id, event_id AS version, value, 1 AS fresh FROM events WHERE event_type = 'click')
          SELECT user_id, version, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY version DESC, fresh DESC) AS k FROM (FROM a UNION ALL FROM b)) WHERE k = 1""")
def snk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("version"), "value", "event_type")
    return sinks.upsert(rows.where("event_type <> 'click'").drop("event_type"), rows.where("event_type = 'click'").drop("event_type"), ["user_id"], "version")


@query(f"""WITH {V.SQL_CONVERSATIONS} SELECT 'len' || set AS detector, 'v1' AS versions, count(*) AS n_rows, count(score) AS scored, CASE set WHEN 'P' THEN 1.5::DOUBLE END AS seconds FROM c_conv GROUP BY set""")
def snk_manifest_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.conversations(spark, sf_dir).select(F.concat(F.lit("len"), "set").alias("detector"), F.lit("v1").alias("version"), "score")
    prior = spark.createDataFrame([("lenP", 1.5)], "detector string, seconds double")
    return sinks.rebuilt_manifest(rows, prior).withColumn("versions", F.array_join("versions", ","))
