"""One query for each operator, over the test tables, with the DuckDB statement that returns the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripewise.functions import encodings as E
from stripewise.model import types as M
from stripewise.operators import checks, groups, runs
from stripewise.operators import statistics as S
from stripewise.plans.catalogue import query, table
from stripewise.sources import orc, tail
from stripewise.storage import shared_folder

_COUNTS = ("num_values", "num_present")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _nullable(column: str):
    """The test tables have no nulls: every seventh event gets one."""
    return F.when(F.col("event_id") % 7 != 0, F.col(column))


def _stats(df: DataFrame, column: str, *measures, by=()) -> DataFrame:
    own = S.column_statistics(df, by).filter(F.col("column") == column)
    return own.select(*by, *_COUNTS, *measures, S.has_null().alias("has_null"))


def _int() -> tuple:
    return "int_min", "int_max", S.int_sum().alias("int_sum")


_HEAD = "count(*) AS num_values, count(x) AS num_present"
_TAIL = "count(*) <> count(x) AS has_null"
_INT_SQL = "cast(min(x) AS bigint) AS int_min, cast(max(x) AS bigint) AS int_max, cast(coalesce(sum(x), 0) AS bigint) AS int_sum"
_EVENTS = "SELECT *, CASE WHEN event_id % 7 <> 0 THEN {} END AS x FROM events"


# Statistics of the leaf types


@query("stats_boolean", f"SELECT {_HEAD}, cast(count(*) FILTER (x) AS bigint) AS true_count, cast(count(*) FILTER (NOT x) AS bigint) AS false_count, {_TAIL} FROM ({_EVENTS.format('value > 50')})")
def stats_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 != 0, F.col("value") > 50).alias("x"))
    return _stats(df, "x", "true_count", "false_count")


@query("stats_long", f"SELECT {_HEAD}, {_INT_SQL}, {_TAIL} FROM ({_EVENTS.format('user_id')})")
def stats_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(table(spark, sf_dir, "events").select(_nullable("user_id").alias("x")), "x", *_int())


@query("stats_int", f"SELECT {_HEAD}, {_INT_SQL}, {_TAIL} FROM (SELECT l_linenumber AS x FROM lineitem)")
def stats_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("x")), "x", *_int())


@query("stats_short", f"SELECT {_HEAD}, {_INT_SQL}, {_TAIL} FROM (SELECT cast(p_size AS smallint) AS x FROM part)")
def stats_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(table(spark, sf_dir, "part").select(F.col("p_size").cast("smallint").alias("x")), "x", *_int())


@query(
    "stats_date",
    f"SELECT {_HEAD}, cast(min(d) AS bigint) AS int_min, cast(max(d) AS bigint) AS int_max, cast(coalesce(sum(d), 0) AS bigint) AS int_sum, min(x) AS date_min, max(x) AS date_max, {_TAIL} "
    "FROM (SELECT cast(o_orderdate AS date) AS x, date_diff('day', date '1970-01-01', cast(o_orderdate AS date)) AS d FROM orders)",
)
def stats_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("x")), "x", *_int(), "date_min", "date_max")


@query("stats_double", f"SELECT {_HEAD}, min(x) AS double_min, max(x) AS double_max, round(coalesce(sum(x), 0), 3) AS double_sum, {_TAIL} FROM ({_EVENTS.format('value')})")
def stats_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(table(spark, sf_dir, "events").select(_nullable("value").alias("x")), "x", "double_min", "double_max", F.round("double_sum", 3).alias("double_sum"))


@query(
    "stats_float",
    f"SELECT {_HEAD}, min(x) AS double_min, max(x) AS double_max, round(coalesce(sum(x), 0), 3) AS double_sum, {_TAIL} FROM (SELECT cast(unnest(embedding) AS double) AS x FROM embeddings)",
)
def stats_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select(F.explode("embedding").alias("x"))
    return _stats(df, "x", "double_min", "double_max", F.round("double_sum", 3).alias("double_sum"))


_DECIMAL_TEXT = "CASE WHEN {0} % 1 = 0 THEN cast(cast({0} AS decimal(38,0)) AS varchar) ELSE cast({0} AS varchar) END"


@query(
    "stats_decimal",
    "SELECT o_orderstatus, num_values, num_present, " + ", ".join(f"{_DECIMAL_TEXT.format(m)} AS decimal_{m}" for m in ("lo", "hi", "total")) + ", num_values <> num_present AS has_null FROM "
    "(SELECT o_orderstatus, count(*) AS num_values, count(x) AS num_present, min(x) AS lo, max(x) AS hi, cast(sum(x) AS decimal(38,2)) AS total FROM (SELECT o_orderstatus, cast(o_totalprice AS decimal(15,2)) AS x FROM orders) GROUP BY o_orderstatus)",
)
def stats_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_totalprice").cast("decimal(15,2)").alias("x"))
    texts = [S.decimal_texts(f"decimal_{m}").alias(f"decimal_{to}") for m, to in (("min", "lo"), ("max", "hi"), ("total", "total"))]
    return _stats(df, "x", *texts, by=("o_orderstatus",))


@query("stats_timestamp", f"SELECT {_HEAD}, min(epoch_us(x) // 1000) AS millis_min, max(epoch_us(x) // 1000) AS millis_max, {_TAIL} FROM ({_EVENTS.format('ts')})")
def stats_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(table(spark, sf_dir, "events").select(_nullable("ts").alias("x")), "x", "millis_min", "millis_max")


_STRING_SQL = f"{_HEAD}, min(x) AS string_min, max(x) AS string_max, cast(coalesce(sum(strlen(x)), 0) AS bigint) AS total_length, {_TAIL}"
_STRING = ("string_min", "string_max", "total_length")


@query("stats_string", f"SELECT {_STRING_SQL} FROM (SELECT text AS x FROM documents)")
def stats_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(table(spark, sf_dir, "documents").select(F.col("text").alias("x")), "x", *_STRING)


@query("stats_char", f"SELECT {_STRING_SQL} FROM (SELECT rpad(n_name, 25, ' ') AS x FROM nation)")
def stats_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(table(spark, sf_dir, "nation").select(F.rpad("n_name", 25, " ").alias("x")), "x", *_STRING)


@query("stats_varchar", f"SELECT {_STRING_SQL} FROM (SELECT substring(p_name, 1, 10) AS x FROM part)")
def stats_varchar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(table(spark, sf_dir, "part").select(F.substring("p_name", 1, 10).alias("x")), "x", *_STRING)


@query("stats_binary", f"SELECT {_HEAD}, cast(coalesce(sum(octet_length(x)), 0) AS bigint) AS total_length, {_TAIL} FROM (SELECT encode(text) AS x FROM documents)")
def stats_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(table(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("x")), "x", "total_length")


@query(
    "null_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS num_values, count(x) AS num_present, count(*) - count(x) AS null_count, count(*) <> count(x) AS has_null FROM (SELECT CASE WHEN event_id % {n} <> 0 THEN {c} END AS x FROM events)"
        for c, n in (("user_id", 7), ("event_type", 5), ("value", 3))
    ),
)
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select(*(F.when(F.col("event_id") % n != 0, F.col(c)).alias(c) for c, n in (("user_id", 7), ("event_type", 5), ("value", 3))))
    return S.null_profile(df)


# Containers and their children


def _struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = F.struct(F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("a"), F.col("event_type").alias("b"))
    return table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 != 0, st).alias("st"))


@query("stats_struct", f"SELECT {_HEAD}, {_TAIL} FROM ({_EVENTS.format('event_id')})")
def stats_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(_struct(spark, sf_dir), "st")


@query("nested_struct_child", f"SELECT {_HEAD}, {_INT_SQL}, {_TAIL} FROM (SELECT CASE WHEN event_id % 5 <> 0 THEN user_id END AS x FROM events WHERE event_id % 7 <> 0)")
def nested_struct_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(_struct(spark, sf_dir), "st.a", *_int())


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("f"))


@query("stats_list", f"SELECT {_HEAD}, {_TAIL} FROM (SELECT CASE WHEN vec_id % 7 <> 0 THEN embedding END AS x FROM embeddings)")
def stats_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(_lists(spark, sf_dir), "f")


@query(
    "nested_list_child",
    f"SELECT {_HEAD}, min(x) AS double_min, max(x) AS double_max, round(sum(x), 3) AS double_sum, {_TAIL} FROM (SELECT cast(unnest(embedding) AS double) AS x FROM embeddings WHERE vec_id % 7 <> 0)",
)
def nested_list_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(_lists(spark, sf_dir), "f.element", "double_min", "double_max", F.round("double_sum", 3).alias("double_sum"))


@query("list_lengths", "SELECT vec_id, CASE WHEN vec_id % 7 <> 0 THEN cast(len(embedding) AS int) END AS length FROM embeddings")
def list_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", E.container_length(F.when(F.col("vec_id") % 7 != 0, F.col("embedding"))).alias("length"))


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.create_map(F.lit("param"), F.col("user_id") % 2 == 1, F.lit("setting"), F.col("user_id") % 3 == 1)
    return table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 != 0, g).alias("g"))


@query("stats_map", f"SELECT {_HEAD}, {_TAIL} FROM ({_EVENTS.format('event_id')})")
def stats_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(_maps(spark, sf_dir), "g")


@query(
    "nested_map_kv",
    "SELECT 'g.key' AS \"column\", count(*) AS num_values, count(k) AS num_present, min(k) AS string_min, max(k) AS string_max, cast(sum(strlen(k)) AS bigint) AS total_length, cast(NULL AS bigint) AS true_count, cast(NULL AS bigint) AS false_count FROM m "
    "UNION ALL SELECT 'g.value', count(*), count(v), NULL, NULL, NULL, cast(count(*) FILTER (v) AS bigint), cast(count(*) FILTER (NOT v) AS bigint) FROM m".replace(
        "SELECT 'g.key'", "WITH m AS (SELECT unnest(['param', 'setting']) AS k, unnest([user_id % 2 = 1, user_id % 3 = 1]) AS v FROM events WHERE event_id % 7 <> 0) SELECT 'g.key'"
    ),
)
def nested_map_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.column_statistics(_maps(spark, sf_dir)).filter(F.col("column").isin("g.key", "g.value"))
    return found.select("column", *_COUNTS, *_STRING, "true_count", "false_count")


def _unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = M.union((F.col("event_id") % 2).cast("int"), F.col("user_id"), F.col("value"))
    return M.as_union(table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 != 0, k).alias("k")), "k")


@query("stats_union", f"SELECT {_HEAD}, {_TAIL} FROM ({_EVENTS.format('event_id')})")
def stats_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(_unions(spark, sf_dir), "k")


@query(
    "nested_union_child",
    "SELECT 'k.c0' AS \"column\", count(*) AS num_values, count(user_id) AS num_present, min(user_id) AS int_min, max(user_id) AS int_max, cast(sum(user_id) AS bigint) AS int_sum, NULL::double AS double_min, NULL::double AS double_max, NULL::double AS double_sum FROM events WHERE event_id % 7 <> 0 AND event_id % 2 = 0 "
    "UNION ALL SELECT 'k.c1', count(*), count(value), NULL, NULL, NULL, min(value), max(value), round(sum(value), 3) FROM events WHERE event_id % 7 <> 0 AND event_id % 2 = 1",
)
def nested_union_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.column_statistics(_unions(spark, sf_dir)).filter(F.col("column").isin("k.c0", "k.c1"))
    return found.select("column", *_COUNTS, *_int(), "double_min", "double_max", F.round("double_sum", 3).alias("double_sum"))


# Row groups, stripes, files

STRIDE, STRIPE = 1000, 4
_EVENT_ROWS = "SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS row_group FROM events"
_GROUP_SQL = (
    "count(*) AS num_values, min(user_id) AS int_min, max(user_id) AS int_max, cast(sum(user_id) AS bigint) AS int_sum, min(value) AS double_min, max(value) AS double_max, round(sum(value), 3) AS double_sum, "
    "min(event_type) AS string_min, max(event_type) AS string_max, cast(sum(strlen(event_type)) AS bigint) AS total_length, min(epoch_us(ts) // 1000) AS millis_min, max(epoch_us(ts) // 1000) AS millis_max"
)


def _event_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.row_group_statistics(table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type", "ts"), ["event_id"], STRIDE)


def _wide(stats: DataFrame, *by: str) -> DataFrame:
    """The measures of four columns side by side."""

    def of(column: str, measure) -> F.Column:
        return F.max(F.when(F.col("column") == column, measure))

    return stats.groupBy(*by).agg(
        of("user_id", F.col("num_values")).alias("num_values"),
        of("user_id", F.col("int_min")).alias("int_min"),
        of("user_id", F.col("int_max")).alias("int_max"),
        of("user_id", S.int_sum()).alias("int_sum"),
        of("value", F.col("double_min")).alias("double_min"),
        of("value", F.col("double_max")).alias("double_max"),
        F.round(of("value", F.col("double_sum")), 3).alias("double_sum"),
        of("event_type", F.col("string_min")).alias("string_min"),
        of("event_type", F.col("string_max")).alias("string_max"),
        of("event_type", F.col("total_length")).alias("total_length"),
        of("ts", F.col("millis_min")).alias("millis_min"),
        of("ts", F.col("millis_max")).alias("millis_max"),
    )


@query("rowgroup_stats", f"SELECT row_group, {_GROUP_SQL} FROM ({_EVENT_ROWS}) GROUP BY row_group")
def rowgroup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(_event_groups(spark, sf_dir), "row_group")


@query("stripe_stats", f"SELECT row_group // {STRIPE} AS stripe, {_GROUP_SQL} FROM ({_EVENT_ROWS}) GROUP BY stripe")
def stripe_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(groups.stripe_statistics(_event_groups(spark, sf_dir), STRIPE), "stripe")


@query("file_stats", f"SELECT {_GROUP_SQL} FROM events")
def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(groups.file_statistics(groups.stripe_statistics(_event_groups(spark, sf_dir), STRIPE)))


@query("file_row_count", "SELECT count(*) AS num_rows FROM events")
def file_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = groups.file_statistics(_event_groups(spark, sf_dir))
    return merged.filter(F.col("column") == "_root").select(F.col("num_values").alias("num_rows"))


@query("merge_equals_direct", "SELECT 6 AS columns, true AS agrees")
def merge_equals_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics merged from row groups against those of one aggregation: they agree in every measure."""
    direct = S.column_statistics(table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type", "ts"))
    merged = groups.file_statistics(_event_groups(spark, sf_dir))
    same = [F.col(f"d.{m}").eqNullSafe(F.col(f"m.{m}")) if m != "double_sum" else F.abs(F.coalesce(F.col(f"d.{m}"), F.lit(0.0)) - F.coalesce(F.col(f"m.{m}"), F.lit(0.0))) < 1e-3 for m in S.MEASURES]
    agrees = same[0]
    for x in same[1:]:
        agrees = agrees & x
    return direct.alias("d").join(merged.alias("m"), "column_id").agg(F.count("*").cast("int").alias("columns"), F.bool_and(agrees).alias("agrees"))


@query("nested_rowgroups_by_value", "SELECT cast(g AS bigint) AS row_group, count(*) AS num_values, min(x) AS double_min, max(x) AS double_max FROM (SELECT cast(x AS double) AS x, (row_number() OVER (ORDER BY vec_id, i) - 1) // 10000 AS g FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)) GROUP BY g")
def nested_rowgroups_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups.row_group_statistics(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), ["vec_id"], 10_000, grouping="values")
    return found.filter(F.col("column") == "embedding.element").select("row_group", "num_values", "double_min", "double_max")


@query("zone_map_prune", f"SELECT row_group, min(value) AS double_min, max(value) AS double_max FROM ({_EVENT_ROWS}) GROUP BY row_group HAVING max(value) >= 400 AND min(value) <= 0.05")
def zone_map_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.prune(_event_groups(spark, sf_dir), "value", "double", at_least=400, at_most=0.05).select("row_group", "double_min", "double_max")


# Encodings

_ZIGZAG = "CASE WHEN {0} >= 0 THEN 2 * {0}::hugeint ELSE -2 * {0}::hugeint - 1 END"


@query("zigzag", f"SELECT event_id, cast({_ZIGZAG.format('(500 - user_id)')} AS bigint) AS encoded FROM events")
def zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", E.zigzag(500 - F.col("user_id")).alias("encoded"))


@query("varint_len", f"SELECT event_id, cast(ceil(length(bin(user_id * user_id)) / 7.0) AS int) AS bytes, cast(ceil(length(bin(cast({_ZIGZAG.format('(500 - user_id)')} AS bigint))) / 7.0) AS int) AS signed_bytes FROM events")
def varint_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", E.varint_length(F.col("user_id") * F.col("user_id")).alias("bytes"), E.signed_varint_length(500 - F.col("user_id")).alias("signed_bytes"))


@query("varint_bytes", "SELECT event_id, CASE WHEN user_id < 128 THEN printf('%02X', user_id) WHEN user_id < 16384 THEN printf('%02X%02X', user_id % 128 + 128, user_id // 128) ELSE printf('%02X%02X%02X', user_id % 128 + 128, user_id // 128 % 128 + 128, user_id // 16384) END AS encoded FROM events")
def varint_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.hex(E.varint(F.col("user_id"))).alias("encoded"))


@query("bool_pack", "SELECT event_id // 8 AS byte, cast(sum(CASE WHEN value > 50 THEN 1 << (7 - event_id % 8)::int ELSE 0 END) AS bigint) AS packed FROM events GROUP BY 1")
def bool_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 8).alias("byte")).agg(E.pack_bits(F.col("value") > 50, F.col("event_id") % 8).alias("packed"))


@query("ts_orc_parts", "SELECT event_id, (epoch_us(ts) // 1000000) - 1420070400 AS seconds, (epoch_us(ts) % 1000000) * 1000 AS nanos, epoch_us(ts) // 1000 AS millis FROM events")
def ts_orc_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", E.seconds_since_2015(ts).alias("seconds"), E.nanos(ts).alias("nanos"), E.epoch_millis(ts).alias("millis"))


_NANOS = "SELECT event_id, (epoch_us(ts) % 1000000) * 1000 AS n FROM events"


@query(
    "nanos_packed",
    f"SELECT event_id, cast(CASE WHEN n <> 0 AND n % 100 = 0 THEN ((n // cast(pow(10, z) AS bigint)) << 3) | (z - 1) ELSE n << 3 END AS bigint) AS packed FROM (SELECT *, length(regexp_extract(cast(n AS varchar), '(0*)$', 1)) AS z FROM ({_NANOS}))",
)
def nanos_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", E.pack_nanos(E.nanos(F.col("ts"))).alias("packed"))


@query("decimal_text", f"SELECT o_orderkey, {_DECIMAL_TEXT.format('x')} AS text FROM (SELECT o_orderkey, cast(CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice) ELSE o_totalprice END AS decimal(15,2)) AS x FROM orders)")
def decimal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("o_orderkey") % 3 == 0, F.floor("o_totalprice").cast("double")).otherwise(F.col("o_totalprice")).cast("decimal(15,2)")
    return table(spark, sf_dir, "orders").select("o_orderkey", E.decimal_text(x).alias("text"))


@query("decimal_unscaled", "SELECT o_orderkey, cast(cast(o_totalprice AS decimal(15,2)) * 100 AS bigint) AS unscaled, 2 AS scale FROM orders")
def decimal_unscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", E.decimal_unscaled(F.col("o_totalprice").cast("decimal(15,2)"), 2).cast("long").alias("unscaled"), F.lit(2).alias("scale"))


@query("byte_lengths", "SELECT doc_id, cast(strlen(text) AS int) AS bytes, cast(length(text) AS int) AS chars, text IS NOT NULL AS present FROM documents")
def byte_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", E.byte_length(F.col("text")).alias("bytes"), F.length("text").alias("chars"), E.present(F.col("text")).alias("present"))


@query("union_tags", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN cast(event_id % 2 AS int) END AS tag, CASE WHEN event_id % 7 <> 0 AND event_id % 2 = 0 THEN user_id END AS c0, CASE WHEN event_id % 7 <> 0 AND event_id % 2 = 1 THEN value END AS c1 FROM events")
def union_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.when(F.col("event_id") % 7 != 0, M.union((F.col("event_id") % 2).cast("int"), F.col("user_id"), F.col("value"))).alias("k")
    return table(spark, sf_dir, "events").select("event_id", k).select("event_id", "k.tag", "k.c0", "k.c1")


@query("int_deltas", "SELECT event_id, user_id - lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS delta FROM events")
def int_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.deltas(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), "user_id", "event_id", ["event_type"]).select("event_id", "delta")


@query(
    "run_segments",
    "SELECT user_bucket, run, any_value(event_type) AS value, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM ("
    "SELECT *, cast(sum(s) OVER (PARTITION BY user_bucket ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS bigint) AS run FROM ("
    "SELECT event_id, event_type, user_id % 16 AS user_bucket, CASE WHEN lag(event_type) OVER (PARTITION BY user_id % 16 ORDER BY event_id) IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS s FROM events)) GROUP BY user_bucket, run",
)
def run_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_segments(table(spark, sf_dir, "events").withColumn("user_bucket", F.col("user_id") % 16), "event_type", "event_id", ["user_bucket"])


def _encoded(spark: SparkSession, sf_dir: str, column, encoder: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("event_id", column.alias("x"))
    grouped = groups.assign_row_groups(df, ["event_id"], STRIDE)
    found = runs.encoded_groups(grouped, "row_group", "event_id", "x", encoder)
    return found.select("row_group", "n", F.length("encoded").alias("bytes"), F.hex("encoded").alias("encoded"))


def _rle_sql(values: str, n: str, run: str, head: str, number: str) -> str:
    """The encoder as a walk over places, for a list of (row_group, k, x).

    values: the rows; n: how many values a row group has, for the report; run: the length of the run at a place from the ends
    of stretches; head: the bytes of a run; number: the bytes of a literal.
    """
    return f"""
WITH RECURSIVE v AS ({values}),
s AS (SELECT row_group, k, x, lead(x) OVER g - x AS d FROM v WINDOW g AS (PARTITION BY row_group ORDER BY k)),
c AS (SELECT *, count(*) OVER (PARTITION BY row_group) AS size, CASE WHEN lead(d) OVER (PARTITION BY row_group ORDER BY k) IS DISTINCT FROM d THEN k END AS stop_d,
  CASE WHEN d IS DISTINCT FROM 0 THEN k END AS stop_x FROM s),
r AS (SELECT row_group, k, x, d, size, least(130, {run}) AS run FROM (
  SELECT *, min(stop_d) OVER w AS end_d, min(stop_x) OVER w AS end_x FROM c WINDOW w AS (PARTITION BY row_group ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))),
walk AS (
  SELECT row_group, max(size) AS size, 0 AS place, 0 AS pending, NULL::INT AS lit, NULL::INT AS lits, NULL::INT AS first, NULL::INT AS length FROM r GROUP BY row_group
  UNION ALL
  SELECT w.row_group, w.size,
    (CASE WHEN t THEN w.place + r.run ELSE w.place + 1 END)::INT,
    (CASE WHEN t THEN w.place + r.run WHEN w.place + 1 - w.pending = 128 THEN w.place + 1 ELSE w.pending END)::INT,
    CASE WHEN (t AND w.place > w.pending) OR (NOT t AND w.place + 1 - w.pending = 128) THEN w.pending END,
    (CASE WHEN t AND w.place > w.pending THEN w.place - w.pending WHEN NOT t AND w.place + 1 - w.pending = 128 THEN 128 END)::INT,
    CASE WHEN t THEN w.place END, (CASE WHEN t THEN r.run END)::INT
  FROM walk w JOIN r ON r.row_group = w.row_group AND r.k = w.place, LATERAL (SELECT r.run >= 3 AND w.place - w.pending + 2 < 128 AS t)
),
g AS (
  SELECT row_group, lit AS first, lits AS length, false AS is_run FROM walk WHERE lit IS NOT NULL
  UNION ALL SELECT row_group, first, length, true FROM walk WHERE first IS NOT NULL
  UNION ALL SELECT row_group, pending, (size - pending)::INT, false FROM walk WHERE place = size AND pending < size
),
b AS (
  SELECT g.row_group, g.first, {head} AS hex FROM g JOIN r ON r.row_group = g.row_group AND r.k = g.first WHERE is_run
  UNION ALL
  SELECT g.row_group, g.first, printf('%02X', 256 - g.length) || string_agg({number}, '' ORDER BY r.k)
  FROM g JOIN r ON r.row_group = g.row_group AND r.k >= g.first AND r.k < g.first + g.length WHERE NOT is_run GROUP BY g.row_group, g.first, g.length
),
e AS (SELECT row_group, string_agg(hex, '' ORDER BY first) AS encoded FROM b GROUP BY row_group)
SELECT e.row_group, n, cast(length(encoded) // 2 AS int) AS bytes, encoded FROM e JOIN ({n}) AS m ON m.row_group = e.row_group
"""


_EVENT_N = f"SELECT row_group, cast(count(*) AS int) AS n FROM ({_EVENT_ROWS}) GROUP BY row_group"
_EVENT_X = f"SELECT row_group, (row_number() OVER (PARTITION BY row_group ORDER BY event_id) - 1)::INT AS k, {{}} AS x FROM ({_EVENT_ROWS})"
_SAME, _STEPS = "end_x - k + 1", "CASE WHEN k + 2 >= size OR d NOT BETWEEN -128 AND 127 THEN 1 ELSE least(end_d, size - 2) - k + 2 END"


def _varint_sql(x: str) -> str:
    """Numbers below 2**28 as base-128 bytes."""
    return f"CASE WHEN {x} < 128 THEN printf('%02X', {x}) WHEN {x} < 16384 THEN printf('%02X%02X', {x} % 128 + 128, {x} // 128) WHEN {x} < 2097152 THEN printf('%02X%02X%02X', {x} % 128 + 128, {x} // 128 % 128 + 128, {x} // 16384) ELSE printf('%02X%02X%02X%02X', {x} % 128 + 128, {x} // 128 % 128 + 128, {x} // 16384 % 128 + 128, {x} // 2097152) END"


_BYTES_SQL = ("printf('%02X%02X', length - 3, x)", "printf('%02X', x)")


def _ints_sql(number: str) -> tuple[str, str]:
    return f"printf('%02X%02X', length - 3, (d + 256) % 256) || {_varint_sql(number)}", _varint_sql(number)


@query("byte_rle", _rle_sql(_EVENT_X.format("(user_id % 3)::INT"), _EVENT_N, _SAME, *_BYTES_SQL))
def byte_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir, (F.col("user_id") % 3).cast("int"), "byte")


@query(
    "bool_rle",
    _rle_sql(f"SELECT row_group, (k // 8)::INT AS k, cast(sum(CASE WHEN x THEN 1 << (7 - k % 8) ELSE 0 END) AS int) AS x FROM ({_EVENT_X.format('value > 50')}) GROUP BY row_group, k // 8", _EVENT_N, _SAME, *_BYTES_SQL),
)
def bool_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir, F.col("value") > 50, "boolean")


@query("int_rle", _rle_sql(_EVENT_X.format("user_id"), _EVENT_N, _STEPS, *_ints_sql("(CASE WHEN x < 0 THEN -2 * x - 1 ELSE 2 * x END)")))
def int_rle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir, F.col("user_id"), "int")


@query("int_rle_unsigned", _rle_sql(_EVENT_X.format("event_id // 3"), _EVENT_N, _STEPS, *_ints_sql("x")))
def int_rle_unsigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _encoded(spark, sf_dir, F.floor(F.col("event_id") / 3).cast("long"), "unsigned")


@query("int_rle_runs", _rle_sql(_EVENT_X.format("CASE WHEN event_id % 400 < 290 THEN (event_id // 50) * 7 - 500 ELSE user_id END"), _EVENT_N, _STEPS, *_ints_sql("(CASE WHEN x < 0 THEN -2 * x - 1 ELSE 2 * x END)")))
def int_rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs shorter and longer than the longest group between stretches of literals that fill theirs."""
    return _encoded(spark, sf_dir, F.when(F.col("event_id") % 400 < 290, F.floor(F.col("event_id") / 50) * 7 - 500).otherwise(F.col("user_id")).cast("long"), "int")


_NIBBLES = "list_aggregate(list_transform(range(0, {0}), lambda j: list_aggregate(list_transform(range(0, 2), lambda h: substr('0123456789ABCDEF', 1 + 8 * substr(b, {1} - 8 * j + 4 * h, 1)::INT + 4 * substr(b, {1} + 1 - 8 * j + 4 * h, 1)::INT + 2 * substr(b, {1} + 2 - 8 * j + 4 * h, 1)::INT + substr(b, {1} + 3 - 8 * j + 4 * h, 1)::INT, 1)), 'string_agg', '')), 'string_agg', '')"


@query("double_bytes", f"SELECT event_id, {_NIBBLES.format(8, 57)} AS encoded FROM (SELECT event_id, ((value - 50) / 7)::DOUBLE::BIT::VARCHAR AS b FROM events)")
def double_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.hex(E.double_bytes((F.col("value") - 50) / 7)).alias("encoded"))


@query("float_bytes", f"SELECT event_id, {_NIBBLES.format(4, 25)} AS encoded FROM (SELECT event_id, (value - 50)::FLOAT::BIT::VARCHAR AS b FROM events)")
def float_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.hex(E.float_bytes((F.col("value") - 50).cast("float"))).alias("encoded"))


@query("decimal_scales", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN 2 END AS scale FROM orders")
def decimal_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice").cast("decimal(15,2)"))
    return table(spark, sf_dir, "orders").select("o_orderkey", E.decimal_scale(price, 2).alias("scale"))


@query("wide_decimals", "SELECT o_orderkey, cast(cast(cast(o_totalprice AS decimal(15,2)) * 100 AS bigint) AS varchar) || '1234567890123450' AS unscaled FROM orders")
def wide_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digits of decimals of 38 digits, 18 of them behind the point."""
    text = F.concat(F.col("o_totalprice").cast("decimal(15,2)").cast("string"), F.lit("1234567890123450"))
    return table(spark, sf_dir, "orders").select("o_orderkey", E.decimal_unscaled(text.cast("decimal(38,18)"), 18).cast("string").alias("unscaled"))


# Files


def _written(spark: SparkSession, sf_dir: str, name: str, config: orc.WriteConfig, sort: tuple[str, ...] = ()) -> str:
    path = _scratch(spark, f"orc-{name}")
    orc.write(orc.with_orc_timestamps(table(spark, sf_dir, name)), path, config, sort_within=sort)
    return path


def _roundtrip(codec: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = table(spark, sf_dir, "lineitem")
        path = _scratch(spark, "orc-roundtrip")
        orc.write(source, path, orc.WriteConfig().with_compression(codec))
        return orc.read(spark, path)

    return run


for _codec in ("none", "snappy", "zstd"):
    query(f"orc_roundtrip_{_codec}", "SELECT * FROM lineitem")(_roundtrip(_codec))


@query("orc_pushed_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey > 100 AND l_shipdate < timestamp '1997-01-11'")
def orc_pushed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, sf_dir, "lineitem", orc.WriteConfig().with_compression("snappy"), sort=("l_shipdate",))
    return orc.read(spark, path).filter((F.col("l_orderkey") > 100) & (F.col("l_shipdate") < F.lit("1997-01-11").cast("timestamp"))).select("l_orderkey", "l_linenumber", "l_quantity")


@query("orc_pushed_aggregate", "SELECT min(l_orderkey) AS least, max(l_orderkey) AS most, count(*) AS n FROM lineitem")
def orc_pushed_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, sf_dir, "lineitem", orc.WriteConfig().with_compression("zstd"))
    return orc.read(spark, path).agg(F.min("l_orderkey").alias("least"), F.max("l_orderkey").alias("most"), F.count("*").alias("n"))


@query("orc_tail_stats", "SELECT 'user_id' AS \"column\", count(*) AS num_present, min(user_id) AS int_min, max(user_id) AS int_max, cast(sum(user_id) AS bigint) AS int_sum FROM events")
def orc_tail_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored statistics of all files, merged."""
    path = _written(spark, sf_dir, "events", orc.WriteConfig().with_compression("zstd"))
    stored = tail.statistics(spark, path).filter(F.col("column_id") == 3)
    return stored.agg(F.lit("user_id").alias("column"), F.sum("num_present").alias("num_present"), F.min("int_min").alias("int_min"), F.max("int_max").alias("int_max"), F.sum("int_sum").alias("int_sum"))


@query("orc_stripes", "SELECT count(*) AS num_rows FROM events")
def orc_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, sf_dir, "events", orc.WriteConfig())
    return tail.stripes(spark, path).agg(F.sum("rows").alias("num_rows"))


@query("orc_rowgroup_stats", f"SELECT cast(row_group AS int) AS row_group, count(*) AS num_present, min(user_id) AS int_min, max(user_id) AS int_max, cast(sum(user_id) AS bigint) AS int_sum FROM ({_EVENT_ROWS}) GROUP BY row_group")
def orc_rowgroup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored row index of files in order of event_id, stride 1000."""
    path = _scratch(spark, "orc-index")
    orc.write_in_order(orc.with_orc_timestamps(table(spark, sf_dir, "events")), path, ("event_id",), orc.WriteConfig(row_index_stride=STRIDE).with_whole_groups())
    return tail.running_groups(tail.statistics(spark, path, "row_group", columns=[3])).select("row_group", "num_present", "int_min", "int_max", "int_sum")


_EVENT_TYPE = "struct<event_id:bigint,ts:timestamp,user_id:bigint,event_type:string,value:double,props:string>"


@query(
    "orc_layout",
    f"SELECT count(*) AS rows, 'snappy' AS codec, true AS bounded_blocks, 2000 AS row_index_stride, '{_EVENT_TYPE}' AS schema, true AS tiled, true AS streams_fill FROM events",
)
def orc_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all files say of themselves; whether stripes tile the contents and streams fill the stripes."""
    path = _written(spark, sf_dir, "events", orc.WriteConfig().with_compression("snappy").with_row_index_stride(2000))
    files, stripes = tail.files(spark, path), tail.stripes(spark, path)
    ends = stripes.groupBy("file").agg((F.sum(F.col("index_length") + F.col("data_length") + F.col("footer_length")) + 3).alias("ends"), F.sum("rows").alias("own"))
    filled = tail.streams(spark, path).groupBy("file", "stripe", "area").agg(F.sum("length").alias("length")).groupBy("file", "stripe").pivot("area", ["index", "data"]).sum("length")
    filled = stripes.join(filled, ["file", "stripe"]).groupBy("file").agg(F.bool_and((F.col("index") == F.col("index_length")) & (F.col("data") == F.col("data_length"))).alias("filled"))
    told = files.join(ends, "file").join(filled, "file")
    return told.groupBy("codec", "row_index_stride", "schema").agg(
        F.sum("rows").alias("rows"),
        F.bool_and((F.col("block_size") > 0) & (F.col("block_size") <= 256 << 10)).alias("bounded_blocks"),
        F.bool_and((F.col("ends") == F.col("content_length")) & (F.col("own") == F.col("rows"))).alias("tiled"),
        F.bool_and("filled").alias("streams_fill"),
    )


@query(
    "orc_types",
    "SELECT * FROM (VALUES (0, 'struct', '1,2,4', 'vec_id,embedding,label'), (1, 'bigint', '', ''), (2, 'array', '3', ''), (3, 'float', '', ''), (4, 'int', '', '')) AS t(column_id, kind, children, field_names)",
)
def orc_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type tree, which all files have."""
    path = _written(spark, sf_dir, "embeddings", orc.WriteConfig())
    found = tail.types(spark, path)
    return found.select("column_id", "kind", F.array_join(F.transform("children", lambda x: x.cast("string")), ",").alias("children"), F.array_join("field_names", ",").alias("field_names")).distinct()


@query("orc_streams", "SELECT * FROM (VALUES (1, 'data'), (2, 'data,secondary'), (3, 'data'), (5, 'data')) AS t(column_id, streams)")
def orc_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data streams of columns without nulls: numbers, times, and doubles. (Strings have a dictionary or not, as it pays.) All stripes have the same."""
    path = _written(spark, sf_dir, "events", orc.WriteConfig())
    found = tail.streams(spark, path).filter("area = 'data' AND column_id IN (1, 2, 3, 5)")
    own = found.groupBy("file", "stripe", "column_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "kind"))), lambda x: x["kind"]), ",").alias("streams"))
    return own.select("column_id", "streams").distinct()


@query("orc_encodings", "SELECT * FROM (VALUES (0, 'direct'), (1, 'direct_v2'), (2, 'direct_v2'), (3, 'direct_v2'), (5, 'direct')) AS t(column_id, encoding)")
def orc_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How columns are encoded, in all stripes alike."""
    path = _written(spark, sf_dir, "events", orc.WriteConfig())
    return tail.encodings(spark, path).filter("column_id IN (0, 1, 2, 3, 5)").select("column_id", "encoding").distinct()


@query("orc_column_sizes", "SELECT 5 AS column_id, cast(1 AS bigint) AS data_streams, 8 * count(*) AS data_length FROM events")
def orc_column_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles that aren't compressed fill eight bytes each."""
    path = _written(spark, sf_dir, "events", orc.WriteConfig())
    streams = tail.streams(spark, path).filter("area = 'data'").groupBy("file", "stripe", "column_id").agg(F.count("*").alias("data_streams")).select("column_id", "data_streams").distinct()
    return tail.column_sizes(spark, path).join(streams, "column_id").filter("column_id = 5").select("column_id", "data_streams", "data_length")


@query("orc_positions", "SELECT cast(count(*) // 1000 + CASE WHEN count(*) % 1000 > 0 THEN 1 ELSE 0 END AS bigint) AS entries, cast(8000 AS bigint) AS step FROM events")
def orc_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the row groups of uncompressed doubles begin: 8,000 bytes apart for 1,000 rows."""
    path = _scratch(spark, "orc-positions")
    orc.write_in_order(orc.with_orc_timestamps(table(spark, sf_dir, "events")), path, ("event_id",), orc.WriteConfig(row_index_stride=STRIDE).with_whole_groups())
    found = tail.positions(spark, path, columns=[5]).select("row_group", F.element_at("positions", 1).alias("at"))
    return found.agg(F.count("*").alias("entries"), F.coalesce(F.max(F.when(F.col("row_group") > 0, (F.col("at") / F.col("row_group")).cast("long"))), F.lit(8000)).alias("step"))


@query("orc_blocks", "SELECT true AS framed, true AS bounded, true AS sizes_agree")
def orc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The framing of compressed streams: blocks follow one another to the end, and headers and payloads are the lengths that footers say."""
    path = _written(spark, sf_dir, "lineitem", orc.WriteConfig().with_compression("zlib", block_size=64 << 10))
    found = tail.blocks(spark, path)
    said = tail.streams(spark, path).filter("length > 0").agg(F.sum("length").alias("said"))
    sums = found.agg(F.bool_and("whole").alias("framed"), F.bool_and(F.col("payload_bytes") <= F.col("blocks") * (64 << 10)).alias("bounded"), F.sum(F.col("header_bytes") + F.col("payload_bytes")).alias("found"))
    return sums.crossJoin(said).select("framed", "bounded", (F.col("found") == F.col("said")).alias("sizes_agree"))  # one row each


_KINDS_SQL = (
    "SELECT event_id AS x, CASE WHEN event_id % 7 <> 0 THEN event_id * event_id END AS y, 'hello ' || (event_id // 3) AS z, value AS a, value::FLOAT AS b, "
    "CAST(DATE '1970-01-01' + cast(event_id % 20000 AS int) AS date) AS c, event_id % 3 = 0 AS d, cast(cast(value AS decimal(15,2)) AS double) AS e, "
    "CASE WHEN event_id % 5 <> 0 THEN (3 * event_id) || ',' || (3 * event_id + 1) ELSE '' END AS f, event_id % 2 = 1 AS g, timestamp '2015-01-01' + to_seconds(event_id) AS h, "
    "hex(event_type) AS i, cast(event_id % 2 AS int) AS k_tag, CASE WHEN event_id % 2 = 0 THEN user_id END AS k_0, CASE WHEN event_id % 2 = 1 THEN value::FLOAT END AS k_1, CASE WHEN event_id % 11 <> 0 THEN user_id END AS s_u FROM events"
)


def _all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of column: numbers, text, date, boolean, decimal, list, map, time, binary, union and a struct that may be null."""
    e = F.col("event_id")
    union = M.union((e % 2).cast("int"), F.col("user_id"), F.col("value").cast("float"))
    return table(spark, sf_dir, "events").select(
        e.alias("x"),
        F.when(e % 7 != 0, e * e).alias("y"),
        F.concat(F.lit("hello "), F.floor(e / 3).cast("string")).alias("z"),
        F.col("value").alias("a"),
        F.col("value").cast("float").alias("b"),
        F.date_add(F.lit("1970-01-01").cast("date"), (e % 20000).cast("int")).alias("c"),
        (e % 3 == 0).alias("d"),
        F.col("value").cast("decimal(15,2)").alias("e"),
        F.when(e % 5 != 0, F.array(3 * e, 3 * e + 1)).otherwise(F.array().cast("array<bigint>")).alias("f"),
        F.create_map(F.lit("param"), e % 2 == 1, F.lit("setting"), e % 2 == 0).alias("g"),
        F.timestamp_seconds(e + E.EPOCH_2015).alias("h"),
        F.col("event_type").cast("binary").alias("i"),
        union.alias("k"),
        F.when(e % 11 != 0, F.struct(F.col("user_id").alias("u"))).alias("s"),
    )


def _flat_kinds(df: DataFrame) -> DataFrame:
    """The columns of `_all_kinds` as plain ones that SQL can compare."""
    return df.select(
        "x", "y", "z", "a", "b", "c", "d", F.col("e").cast("double").alias("e"), F.array_join(F.transform("f", lambda v: v.cast("string")), ",").alias("f"), F.col("g")["param"].alias("g"),
        F.col("h").cast("timestamp_ntz").alias("h"), F.hex("i").alias("i"), F.col("k.tag").alias("k_tag"), F.col("k.c0").alias("k_0"), F.col("k.c1").alias("k_1"), F.col("s.u").alias("s_u"),
    )


@query("orc_roundtrip_kinds", _KINDS_SQL)
def orc_roundtrip_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "orc-kinds")
    orc.write(_all_kinds(spark, sf_dir), path, orc.WriteConfig().with_compression("zstd"))
    return _flat_kinds(orc.read(spark, path))


@query("orc_roundtrip_batches", "SELECT 10 * count(*) AS rows, cast(10 * sum(event_id % 2) AS bigint) AS sum, cast(10 AS bigint) AS batches FROM events")
def orc_roundtrip_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten batches of one column of longs, each committed to the same table."""
    path = _scratch(spark, "orc-batches")
    batch = orc.as_table(table(spark, sf_dir, "events").select((F.col("event_id") % 2).alias("x"))).coalesce(1)
    for _ in range(10):
        orc.append_batch(batch, path)
    read = orc.read(spark, path).select("value", F.col("_metadata.file_path").alias("file"))
    return read.agg(F.count("*").alias("rows"), F.sum("value").alias("sum"), F.count_distinct("file").alias("batches"))


@query(
    "type_tree",
    "SELECT * FROM (VALUES (0, NULL, '', 'struct'), (1, 0, 'vec_id', 'long'), (2, 0, 'embedding', 'list'), (3, 2, 'element', 'float'), (4, 0, 'label', 'int')) AS t(column_id, parent_id, name, kind)",
)
def type_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.type_table(spark, table(spark, sf_dir, "embeddings").schema).select("column_id", "parent_id", "name", "kind")


# Integrity


@query("verify_list", "SELECT cast(sum(len(embedding)) AS bigint) AS expected, cast(sum(len(embedding)) AS bigint) AS found, true AS holds FROM embeddings WHERE vec_id % 7 <> 0")
def verify_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.verify_list(_lists(spark, sf_dir), "f")


@query("verify_map", 'SELECT 2 * count(*) AS expected, 2 * count(*) AS "keys", 2 * count(*) AS "values", true AS holds FROM events WHERE event_id % 7 <> 0')
def verify_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.verify_map(_maps(spark, sf_dir), "g")


@query("verify_union", "SELECT cast(event_id % 2 AS int) AS variant, count(*) AS tagged, cast(0 AS bigint) AS stray, true AS holds FROM events WHERE event_id % 7 <> 0 GROUP BY 1")
def verify_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.verify_union(_unions(spark, sf_dir), "k", 2)


@query("verify_struct", "SELECT count(*) AS present, cast(0 AS bigint) AS stray, true AS holds FROM events WHERE event_id % 7 <> 0")
def verify_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.verify_struct(_struct(spark, sf_dir), "st")


# The same on tables whose parts are stored apart and don't agree


@query("verify_list_lengths", "SELECT cast(sum(event_id % 5) AS bigint) AS expected, cast(sum(CASE WHEN event_id % 97 = 0 THEN 0 ELSE event_id % 5 END) AS bigint) AS found, sum(event_id % 5) = sum(CASE WHEN event_id % 97 = 0 THEN 0 ELSE event_id % 5 END) AS holds FROM events")
def verify_list_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("event_id") % 5).cast("int")
    df = table(spark, sf_dir, "events").select(n.alias("n"), F.when(F.col("event_id") % 97 != 0, F.array_repeat("user_id", n)).alias("f"))
    return checks.verify_list(df, "f", lengths="n")


@query("verify_map_lengths", 'SELECT cast(sum(event_id % 4) AS bigint) AS expected, cast(sum(event_id % 4) AS bigint) AS "keys", cast(sum(CASE WHEN event_id % 50 = 3 THEN 1 ELSE event_id % 4 END) AS bigint) AS "values", sum(event_id % 4) = sum(CASE WHEN event_id % 50 = 3 THEN 1 ELSE event_id % 4 END) AS holds FROM events')
def verify_map_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("event_id") % 4).cast("int")
    values = F.array_repeat("value", F.when(F.col("event_id") % 50 == 3, 1).otherwise(n))
    df = table(spark, sf_dir, "events").select(n.alias("n"), F.array_repeat("event_type", n).alias("k"), values.alias("v"))
    return checks.verify_map(df, ("k", "v"), lengths="n")


@query(
    "verify_union_strays",
    "SELECT variant::INT AS variant, count(*) FILTER (event_id % 2 = variant) AS tagged, count(*) FILTER (event_id % 2 <> variant AND (variant = 0 OR event_id % 30 = 0)) AS stray, "
    "count(*) FILTER (event_id % 2 <> variant AND (variant = 0 OR event_id % 30 = 0)) = 0 AS holds FROM events, (VALUES (0), (1)) AS t(variant) GROUP BY variant",
)
def verify_union_strays(spark: SparkSession, sf_dir: str) -> DataFrame:
    c1 = F.when((F.col("event_id") % 2 == 1) | (F.col("event_id") % 30 == 0), F.col("value"))
    df = table(spark, sf_dir, "events").select(F.struct((F.col("event_id") % 2).cast("int").alias("tag"), F.col("user_id").alias("c0"), c1.alias("c1")).alias("k"))
    return checks.verify_union(df, "k", 2)


@query("verify_struct_flags", "SELECT count(*) FILTER (event_id % 7 <> 0) AS present, count(*) FILTER (event_id % 7 = 0 AND event_id % 3 = 0) AS stray, count(*) FILTER (event_id % 7 = 0 AND event_id % 3 = 0) = 0 AS holds FROM events")
def verify_struct_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = F.when((F.col("event_id") % 7 != 0) | (F.col("event_id") % 3 == 0), F.col("user_id"))
    df = table(spark, sf_dir, "events").select((F.col("event_id") % 7 != 0).alias("there"), F.struct(field.alias("u")).alias("st"))
    return checks.verify_struct(df, "st", present="there")


@query("verify_rows", "SELECT count(*) AS expected, count(*) AS found, true AS holds FROM events")
def verify_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a written table against those of its source."""
    source = table(spark, sf_dir, "events")
    path = _scratch(spark, "orc-batch")
    orc.append_batch(source, path, expected=source.count())
    return checks.verify_rows(orc.read(spark, path), source.count())


@query("streaming_stats", f"SELECT {_GROUP_SQL} FROM events")
def streaming_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged statistics of micro-batches written to files."""
    from stripewise.streaming import batches

    source = f"{sf_dir}/events.parquet"
    root = _scratch(spark, "stream")
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder_of(spark, source, root)).select("event_id", "user_id", "value", "event_type", "ts")
    batches.start(stream, f"{root}/data", f"{root}/statistics", f"{root}/checkpoint").awaitTermination()
    return _wide(batches.statistics(spark, f"{root}/statistics"))


def _folder_of(spark: SparkSession, source: str, root: str) -> str:
    """A folder of the table's rows: streams read folders, and a table may be one file."""
    spark.read.parquet(source).write.parquet(f"{root}/source")
    return f"{root}/source"


