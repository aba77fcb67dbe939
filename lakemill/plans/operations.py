"""Queries of single operations, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakemill.functions.keys import name_uuid
from lakemill.functions.text import clean_text
from lakemill.operators import bridges, joins
from lakemill.plans.proxy import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


@query("select o_orderkey, o_totalprice, c_name from orders join customer on o_custkey = c_custkey")
def lookup_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").alias("c_custkey"))
    return joins.lookup_join(orders, table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"]).drop("c_custkey")


@query("select p_brand, count(*) as lines, cast(sum(l_quantity) as bigint) as quantity from lineitem join part on l_partkey = p_partkey group by p_brand")
def salted_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey", "l_quantity")
    salts = joins.key_salts(lines, "p_partkey", 20)
    rows = joins.salted_join(lines, table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey", F.col("l_orderkey"), salts)
    return rows.groupBy("p_brand").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("select l_partkey, count(*) as n, cast(least(ceil(count(*) / 30.0), 8) as bigint) as salts from lineitem group by l_partkey having count(*) > 30")
def hot_keys(spark, sf_dir):
    return joins.key_salts(table(spark, sf_dir, "lineitem"), "l_partkey", 30, 8).withColumn("salts", F.col("salts").cast("long"))


@query("select l_orderkey, s.salt as salt, l_linenumber * 1 as line from lineitem cross join (select unnest(range(3)) as salt) s where l_linenumber = 1")
def rows_by_salts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1")
    return lines.crossJoin(F.broadcast(spark.range(3).withColumnRenamed("id", "salt"))).select("l_orderkey", "salt", F.col("l_linenumber").cast("long").alias("line"))


@query("select l_orderkey, l_partkey, l_linenumber, o_orderpriority from lineitem left join orders on l_orderkey = o_orderkey and o_totalprice > 100000 and o_orderstatus = 'F' where l_linenumber = 1")
def conditional_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1")
    return lines.join(orders, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("o_totalprice") > 100000) & (F.col("o_orderstatus") == "F"), "left").select("l_orderkey", "l_partkey", "l_linenumber", "o_orderpriority")


@query("select c_mktsegment, n_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey where exists (select 1 from (values ('%a%'), ('%in%')) p(pattern) where n_name ilike p.pattern) and c_name not like '%7' group by 1, 2")
def pattern_semi_join(spark, sf_dir):
    patterns = spark.createDataFrame([("%a%",), ("%in%",)], "pattern string")
    nations = table(spark, sf_dir, "nation").join(F.broadcast(patterns), F.expr("n_name ilike pattern"), "left_semi")
    rows = table(spark, sf_dir, "customer").filter(~F.col("c_name").like("%7")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("c_mktsegment", "n_name").agg(F.count("*").alias("customers"))


@query("""select l_returnflag, l_linestatus, l_linenumber, l_tax, l_discount, year(l_shipdate) as ship_year, count(*) as n, cast(sum(l_quantity) as bigint) as quantity, round(max(l_extendedprice), 2) as top, count(distinct l_suppkey) as suppliers
  from lineitem group by 1, 2, 3, 4, 5, 6""")
def mixed_aggregates(spark, sf_dir):
    keys = ["l_returnflag", "l_linestatus", "l_linenumber", "l_tax", "l_discount", F.year("l_shipdate").cast("long").alias("ship_year")]
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"), F.round(F.max("l_extendedprice"), 2).alias("top"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("select o_orderstatus, cast(round(cast(sum(cast(o_totalprice as decimal(15,2))) as double) / count(*), 4) as double) as mean from orders group by 1")
def decimal_mean(spark, sf_dir):
    exact = F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("double") / F.count("*")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.round(exact, 4).alias("mean"))


@query("select n_regionkey, c_mktsegment, count(*) as measure, dense_rank() over (partition by n_regionkey order by count(*) desc) as rank from customer join nation on c_nationkey = n_nationkey group by 1, 2")
def rank_over_aggregate(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joins.ranked_aggregate(rows, ["n_regionkey", "c_mktsegment"], F.count("*"), ["n_regionkey"])


@query("select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) as place from orders qualify place <= 12")
def global_places(spark, sf_dir):
    top = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(12)
    return top.select("o_orderkey", F.row_number().over(W.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("place"))


@query("select event_id, event_type, round(quantile_cont(value, 0.5) over (partition by event_type), 6) as median from events")
def window_percentile(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    # by aggregate and join: a window would bring a whole type into one task
    medians = rows.groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"))
    return joins.lookup_join(rows.select("event_id", "event_type"), medians, ["event_type"])


@query("select user_id, event_type, event_id, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as place from events")
def places_by_pair(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.row_number().over(W.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))).cast("long").alias("place"))


@query("select min(doc_id) as doc_id, count(*) as n from documents where trim(text) <> '' group by trim(text)")
def distinct_trimmed_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("trim(text) <> ''")
    # grouped by a digest of 128 bits, so texts aren't shuffled
    return docs.groupBy(F.md5(F.trim("text").cast("binary")).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("digest")


@query("select o_orderkey, nullif(o_orderstatus, 'P') as status from orders order by nullif(o_orderstatus, 'P') desc nulls last, o_orderkey limit 40")
def nulls_last(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status")).orderBy(F.desc_nulls_last("status"), "o_orderkey").limit(40)


@query("select o_custkey, max_by(o_orderkey, o_totalprice) as dearest, min_by(o_orderkey, o_totalprice) as cheapest from orders group by o_custkey")
def scalar_picks(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_totalprice").alias("dearest"), F.min_by("o_orderkey", "o_totalprice").alias("cheapest"))


@query("""select c_custkey, ltrim(concat('  ', c_name, ' ')) as l, rtrim(concat('  ', c_name, ' ')) as r, trim(concat('xx', c_name, 'x'), 'x') as t, substring(c_name, 1, 8) as snippet, lower(c_name) as lo, upper(c_mktsegment) as up,
  replace(c_name, 'Customer', 'Client') as named, c_mktsegment in ('BUILDING', 'MACHINERY') as listed from customer""")
def string_functions(spark, sf_dir):
    padded, segment = F.concat(F.lit("  "), "c_name", F.lit(" ")), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.ltrim(padded).alias("l"), F.rtrim(padded).alias("r"), F.btrim(F.concat(F.lit("xx"), "c_name", F.lit("x")), F.lit("x")).alias("t"), F.substring("c_name", 1, 8).alias("snippet"),
        F.lower("c_name").alias("lo"), F.upper("c_mktsegment").alias("up"), F.replace("c_name", F.lit("Customer"), F.lit("Client")).alias("named"), segment.isin("BUILDING", "MACHINERY").alias("listed"),
    )


_DIGEST = f"sha1(unhex('{NAMESPACE.replace('-', '')}') || encode(c_name))"


@query(f"""select c_custkey, concat_ws('-', substring(h, 1, 8), substring(h, 9, 4), '5' || substring(h, 14, 3), translate(substring(h, 17, 1), '0123456789abcdef', '{'89ab' * 4}') || substring(h, 18, 3), substring(h, 21, 12)) as id
  from (select c_custkey, {_DIGEST} as h from customer)""")
def name_uuids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", name_uuid(NAMESPACE, F.col("c_name")).alias("id"))


@query("""select event_id, datediff('minute', timestamp '2024-01-01 00:00:00', ts) as minutes, try_strptime(strftime(ts, '%Y-%m-%d'), '%Y-%m-%d') as day, try_strptime(event_type, '%Y-%m-%d') as none,
  current_timestamp > timestamptz '2024-01-01 00:00:00+00' as later from events""")
def time_functions(spark, sf_dir):
    start = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    minute = lambda c: F.floor(F.unix_seconds(F.date_trunc("minute", c).cast("timestamp")) / 60)
    return table(spark, sf_dir, "events").select(
        "event_id", (minute(F.col("ts")) - minute(start)).cast("long").alias("minutes"), F.try_to_timestamp(F.date_format("ts", "yyyy-MM-dd"), F.lit("yyyy-MM-dd")).cast("timestamp_ntz").alias("day"),
        F.try_to_timestamp("event_type", F.lit("yyyy-MM-dd")).cast("timestamp_ntz").alias("none"), (F.current_timestamp() > F.to_timestamp(F.lit("2024-01-01 00:00:00"))).alias("later"),
    )


@query("""select n_nationkey, list_sum(from_json(ids, '["INTEGER"]')) as total, len(from_json(ids, '["INTEGER"]')) as n, array_to_string(from_json(ids, '["INTEGER"]'), ';') as joined, case n_regionkey when 0 then 'a' when 1 then 'b' else 'other' end as letter
  from (select *, '[' || n_nationkey || ', ' || n_regionkey || ']' as ids from nation)""")
def id_lists(spark, sf_dir):
    ids = F.from_json(F.concat(F.lit("["), F.col("n_nationkey").cast("string"), F.lit(", "), F.col("n_regionkey").cast("string"), F.lit("]")), "array<int>")
    letters = F.create_map(F.lit(0), F.lit("a"), F.lit(1), F.lit("b"))
    rows = table(spark, sf_dir, "nation").withColumn("ids", ids)
    return rows.select("n_nationkey", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("ids").cast("long").alias("n"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ";").alias("joined"), F.coalesce(letters[F.col("n_regionkey")], F.lit("other")).alias("letter"))


@query("""select distinct c_custkey, n_name from (select c_custkey, unnest([c_nationkey, (c_nationkey + 7) % 25, 99]) as id from customer) join nation on n_nationkey = id""")
def bridge_from_id_lists(spark, sf_dir):
    """Customers' lists of nations, kept as text, to their names; one id of each list is unknown."""
    nation = F.col("c_nationkey")
    kept = table(spark, sf_dir, "customer").select("c_custkey", bridges.list_text(F.array(nation.cast("int"), ((nation + 7) % 25).cast("int"), F.lit(99))).alias("ids"))
    return bridges.bridge(kept, "c_custkey", bridges.ids_of(F.col("ids")), table(spark, sf_dir, "nation"), "n_nationkey", "n_name")


@query("select r_regionkey, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' as packed from region")
def packed_rows(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", F.struct("r_regionkey", "r_name").alias("row")).select("r_regionkey", F.to_json("row").alias("packed"))


@query("""with ids as (select p_partkey as game_key, case when p_partkey % 3 = 0 then 'Store' else 'Other' end as source, case when p_partkey % 7 = 0 then p_partkey || ',1' else cast(p_partkey // 2 as varchar) end as external_id from part)
  select external_id, min(game_key) as game_key, min_by(p_name, game_key) as game_name from ids join part on p_partkey = game_key where source = 'Store' and external_id not like '%,%' group by external_id""")
def external_ids(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    ids = part.select(key.alias("game_key"), F.when(key % 3 == 0, "Store").otherwise("Other").alias("source"), F.when(key % 7 == 0, F.concat(key.cast("string"), F.lit(",1"))).otherwise(F.floor(key / 2).cast("string")).alias("external_id"))
    return joins.resolve_external(ids, part.select(key.alias("game_key"), F.col("p_name").alias("game_name")), "Store")


@query("select event_id, n as number, case when n % 2 = 0 then 'even' else 'odd' end as kind from events join (select unnest(range(0, 500, 5)) as n) on n = event_id")
def generated_numbers(spark, sf_dir):
    numbers = spark.range(0, 500, 5).withColumnRenamed("id", "number")
    rows = joins.lookup_join(table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("number")), numbers, ["number"])
    return rows.select("event_id", "number", F.when(F.col("number") % 2 == 0, "even").otherwise("odd").alias("kind"))


@query(r"""select doc_id, length(t) as n, md5(t) as digest from (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\[.*?\]|[^\x00-\x7F]', '', 'g'),
  '(?:[^A-Za-z0-9\s!?]\s*){3,}|#|https?://\S+', '', 'g'), '(:heart_suit:){7,}', 'fucking', 'g'), '(:heart_suit:){2,}', 'fuck', 'g'), ':(\w+):', '\1 ', 'g'), '_|\s+', ' ', 'g')) as t from documents)""")
def cleaned_texts(spark, sf_dir):
    cleaned = clean_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(cleaned).cast("long").alias("n"), F.md5(cleaned.cast("binary")).alias("digest"))
