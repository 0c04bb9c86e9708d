import datetime

import pytest
from pyspark.sql import functions as F

from stripewise.operators import statistics as S
from stripewise.sources import orc, tail
from stripewise.streaming import batches


def test_config_is_validated():
    config = orc.WriteConfig()
    assert config.options() == {"compression": "none", "orc.row.index.stride": "10000", "orc.stripe.size": "67108864", "orc.compress.size": "262144"}
    assert config.with_compression("zstd").compression_level == 3
    for bad in (dict(row_index_stride=0), dict(stripe_size=0), dict(compression="brotli"), dict(compression_block_size=1 << 23), dict(compression="zstd", compression_level=23), dict(compression="snappy", compression_level=1)):
        with pytest.raises(ValueError):
            orc.WriteConfig(**bad)


@pytest.mark.parametrize("codec", ["none", "snappy", "zstd", "zlib", "lz4"])
def test_round_trip_of_nested_rows(spark, tmp_path, codec):
    rows = [(k, None if k % 3 else f"é{k}", [k, None], {"a": k % 2 == 0}, (k, [1.5]), datetime.datetime(1960, 5, 5, 1, 2, 3, 456_789)) for k in range(50)]
    df = spark.createDataFrame(rows, "i int, s string, l array<int>, m map<string,boolean>, st struct<a:int,b:array<double>>, t timestamp")
    orc.write(df, str(tmp_path / codec), orc.WriteConfig().with_compression(codec))
    assert sorted(orc.read(spark, str(tmp_path / codec)).collect()) == sorted(df.collect())


def test_empty_table_and_scalar_root(spark, tmp_path):
    orc.write(spark.createDataFrame([], "a int"), str(tmp_path / "e"))
    assert orc.read(spark, str(tmp_path / "e"), "a int").count() == 0
    orc.write(orc.as_table(spark.range(3)), str(tmp_path / "s"))
    assert sorted(r.value for r in orc.read(spark, str(tmp_path / "s")).collect()) == [0, 1, 2]


def test_batches_are_verified_before_they_are_written(spark, tmp_path):
    path = str(tmp_path / "b")
    orc.append_batch(spark.range(5), path, expected=5)
    with pytest.raises(AssertionError):
        orc.append_batch(spark.range(5), path, expected=6)
    orc.append_batch(spark.range(5), path)
    assert orc.read(spark, path).count() == 10


@pytest.fixture(scope="module")
def written(spark, tiny, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("orc") / "events")
    events = spark.read.parquet(f"{tiny}/events.parquet").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("event_id", F.col("event_id") + 1000 * F.col("copy")).drop("copy")
    events = orc.with_orc_timestamps(events).withColumns({"day": F.col("ts").cast("date"), "money": F.col("value").cast("decimal(12,2)"), "big": F.col("value") > 50})
    orc.write(events, path, orc.WriteConfig(row_index_stride=1000).with_compression("zstd"), files=1, sort_within=("event_id",))
    return events, path


def test_layout(spark, written):
    events, path = written
    row = tail.files(spark, path).first()
    assert (row.rows, row.codec, row.row_index_stride) == (events.count(), "zstd", 1000) and row.block_size <= 256 << 10
    assert tail.stripes(spark, path).agg(F.sum("rows")).first()[0] == events.count()
    types = tail.types(spark, path).orderBy("column_id").collect()
    assert types[0].field_names == events.columns and [t.column_id for t in types] == list(range(len(events.columns) + 1))


@pytest.mark.parametrize("level", ["file", "stripe"])
def test_our_statistics_are_the_stored_ones(spark, written, level):
    events, path = written
    stored = {r.column_id: r for r in tail.statistics(spark, path, level).collect()}
    ours = {r.column_id: r for r in S.column_statistics(events).withColumn("int_sum", S.int_sum()).collect()}
    assert stored.keys() == ours.keys()
    for k, s in stored.items():
        o = ours[k]
        assert s.num_present == o.num_present and s.has_null == (o.num_values != o.num_present)
        if o.kind in ("int", "long"):
            assert (s.int_min, s.int_max, s.int_sum) == (o.int_min, o.int_max, o.int_sum)
        elif o.kind == "double":
            assert (s.double_min, s.double_max) == (o.double_min, o.double_max) and s.double_sum == pytest.approx(o.double_sum)
        elif o.kind == "string":
            assert (s.string_min, s.string_max, s.total_length) == (o.string_min, o.string_max, o.total_length)
        elif o.kind == "date":
            assert (s.date_min, s.date_max) == (o.date_min, o.date_max)
        elif o.kind == "boolean":
            assert s.true_count == o.true_count
        elif o.kind == "timestamp":
            assert (s.millis_min, s.millis_max) == (o.millis_min, o.millis_max)


def test_row_index(spark, written):
    events, path = written
    stored = tail.statistics(spark, path, "row_group").filter("column_id = 1").orderBy("row_group").collect()
    assert [(r.int_min, r.int_max, r.num_present) for r in stored] == [(1000 * k, 1000 * k + 999, 1000) for k in range(3)]


def test_filters_reach_the_scan(spark, written):
    _, path = written
    df = orc.read(spark, path).filter(F.col("event_id") > 900).select("event_id", "value")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(event_id,900)" in plan and "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_streamed_batches_merge(spark, tiny, tmp_path):
    source = str(tmp_path / "in")
    events = spark.read.parquet(f"{tiny}/events.parquet").select("event_id", "value")
    events.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    batches.start(stream, str(tmp_path / "d"), str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    assert batches.read(spark, str(tmp_path / "d")).count() == events.count()
    merged = batches.statistics(spark, str(tmp_path / "s")).filter(F.col("column") == "event_id").first()
    assert (merged.num_values, merged.int_min, merged.int_max) == (1000, 0, 999)


def test_row_groups_of_all_stripes(spark, tiny, tmp_path, monkeypatch):
    import functools

    import duckdb

    from stripewise.plans import catalogue, queries

    copies = F.explode(F.sequence(F.lit(0), F.lit(299)))
    events = spark.read.parquet(f"{tiny}/events.parquet").withColumn("copy", copies).withColumn("event_id", F.col("event_id") + 1000 * F.col("copy")).drop("copy").filter("event_id < 299500")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(queries.orc, "WriteConfig", functools.partial(orc.WriteConfig, stripe_size=100_000))
    got = sorted(map(tuple, catalogue.QUERIES["orc_rowgroup_stats"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert len(got) == 300 and got == sorted(con.execute(catalogue.ORACLES["orc_rowgroup_stats"]).fetchall())


def test_tails_of_many_files_in_chunks(spark, tmp_path):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id"))).alias("name"))
    orc.write(df, str(tmp_path / "many"), orc.WriteConfig().with_compression("zlib"), files=7)
    path = str(tmp_path / "many")
    for found in (tail.files, tail.stripes, tail.streams, tail.encodings, tail.positions, tail.statistics):
        whole, parts = found(spark, path), found(spark, path, chunk=2, threads=2)
        assert parts.schema == whole.schema and sorted(map(repr, parts.collect())) == sorted(map(repr, whole.collect())) != []
    streams = tail.streams(spark, path)
    # streams of a stripe follow one another, and of a column with nulls the present bits are stored
    assert streams.filter("column_id = 2 AND kind = 'present'").count() == tail.files(spark, path).count() == 7
    assert {r.encoding.split("_")[0] for r in tail.encodings(spark, path).filter("column_id = 2").collect()} <= {"direct", "dictionary"}
    framed = tail.blocks(spark, path).collect()
    assert framed and all(r.whole and r.blocks >= 1 for r in framed)
    none = str(tmp_path / "none")
    spark.createDataFrame([], "a int").write.parquet(none)
    assert tail.files(spark, str(tmp_path / "none" / "_SUCCESS")).count() == 0


def _calls(spark, run) -> int:
    """How often the driver's Python calls the JVM meanwhile."""
    client = type(spark.sparkContext._gateway._gateway_client)
    send, calls = client.send_command, []

    def counted(self, command, *args, **kwargs):
        if command.startswith("c\n"):
            calls.append(command)
        return send(self, command, *args, **kwargs)

    client.send_command = counted
    try:
        run()
    finally:
        client.send_command = send
    return len(calls)


def test_indexes_take_the_driver_no_call_for_each_entry(spark, tmp_path):
    for n in (2, 100):
        orc.write(spark.range(1000 * n).select("id", F.col("id").cast("string").alias("s")), str(tmp_path / f"{n}"), orc.WriteConfig(row_index_stride=1000).with_whole_groups(), files=1)
    for found in (lambda p: tail.positions(spark, p), lambda p: tail.statistics(spark, p, "row_group")):
        few, many = (_calls(spark, lambda n=n, found=found: found(str(tmp_path / f"{n}")).collect()) for n in (2, 100))
        assert many <= few + 20
        assert found(str(tmp_path / "100")).count() == 300


def test_entries_say_what_the_stripe_says(spark, tiny, tmp_path):
    """Where a stripe has one row group, of every kind of column."""
    from stripewise.plans.queries import _all_kinds

    x = F.col("x")
    nothing = {f"no_{kind}": F.lit(None).cast(kind) for kind in ("string", "int", "decimal(30,2)", "date", "timestamp", "double", "boolean", "binary")}
    odd = {
        "long_text": F.when(x % 300 == 7, F.repeat(F.lit("é"), 900)).otherwise("z"),
        "wide": (x - 300).cast("decimal(38,18)") / 7,
        "overflows": (-x - 1) * 9_000_000_000_000_000,
        "nan": F.when(x % 400 == 9, F.lit(float("nan"))).otherwise(x / 3 - 100),
        "old": F.date_add(F.lit("1900-03-01").cast("date"), x.cast("int")),
        "early": F.timestamp_millis(x * 1_000_003 - 5_000_000_000_000),
    }
    df = _all_kinds(spark, tiny).withColumns(nothing | odd)
    for codec in ("none", "zlib"):
        path = str(tmp_path / codec)
        orc.write(df, path, orc.WriteConfig().with_compression(codec), files=3)
        stripe, group = (tail.statistics(spark, path, level).drop("row_group") for level in ("stripe", "row_group"))
        assert sorted(map(repr, stripe.collect())) == sorted(map(repr, group.collect())) != []
        assert {r.decimal_sum is None for r in group.filter("column_id = 8").collect()} == {False}
        some = tail.statistics(spark, path, "row_group", columns=[1, 8])
        assert sorted(map(repr, some.drop("row_group").collect())) == sorted(map(repr, group.filter("column_id IN (1, 8)").collect()))


def _shuffled_events(spark, tiny, folder, n: int):
    """n events in no order, 1,000 of them for each copy of the table."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(n // 1000)))
    events = spark.read.parquet(f"{tiny}/events.parquet").withColumn("copy", copies).withColumn("event_id", F.col("event_id") + 1000 * F.col("copy")).drop("copy").filter(F.col("event_id") < n)
    events.orderBy(F.xxhash64("event_id")).write.parquet(f"{folder}/events.parquet")


def _sizes(spark, path) -> list[int]:
    return [r.rows for r in tail.files(spark, path).orderBy("file").collect()]


@pytest.mark.parametrize("n", [0, 900, 29_500, 30_000])
def test_positions_over_many_files(spark, tiny, tmp_path, monkeypatch, n):
    from stripewise.plans import catalogue, queries

    _shuffled_events(spark, tiny, tmp_path, n)
    monkeypatch.setattr(orc, "FILE_ROWS", 7000, raising=False)
    monkeypatch.setattr(queries, "_scratch", lambda spark, name: str(tmp_path / name))
    assert tuple(catalogue.QUERIES["orc_positions"](spark, str(tmp_path)).first()) == (-(-n // 1000), 8000)
    sizes = _sizes(spark, str(tmp_path / "orc-positions"))
    assert sum(sizes) == n and all(size % 1000 == 0 for size in sizes[:-1]) and (n < 7000 or len(sizes) > 2 and max(sizes) < n / 2)


def test_row_groups_of_many_files(spark, tiny, tmp_path, monkeypatch):
    import duckdb

    from stripewise.plans import catalogue, queries

    _shuffled_events(spark, tiny, tmp_path, 29_500)
    monkeypatch.setattr(orc, "FILE_ROWS", 7000, raising=False)
    monkeypatch.setattr(queries, "_scratch", lambda spark, name: str(tmp_path / name))
    got = sorted(map(tuple, catalogue.QUERIES["orc_rowgroup_stats"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert len(got) == 30 and got == sorted(con.execute(catalogue.ORACLES["orc_rowgroup_stats"]).fetchall())
    sizes = _sizes(spark, str(tmp_path / "orc-index"))
    assert sum(sizes) == 29_500 and len(sizes) > 2 and max(sizes) < 15_000 and all(size % 1000 == 0 for size in sizes[:-1])


@pytest.mark.parametrize("name", ["orc_stripes", "orc_types", "orc_streams", "orc_encodings", "orc_column_sizes"])
def test_what_many_files_say(spark, tiny, tmp_path, monkeypatch, name):
    """Of tables in several parts, which several tasks write."""
    import duckdb

    from stripewise.plans import catalogue, queries

    con = duckdb.connect()
    for table in ("events", "embeddings"):
        spark.read.parquet(f"{tiny}/{table}.parquet").repartition(4).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    written = tmp_path / "written"
    monkeypatch.setattr(queries, "_scratch", lambda spark, name: str(written))
    got = sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(catalogue.ORACLES[name]).fetchall())
    assert len(_sizes(spark, str(written))) > 1
