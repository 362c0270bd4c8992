"""Files, payloads and pages: what must be read as text, what must be unknown, and what must fail."""

import json

import pytest
from pyspark.sql import functions as F

from terrarank.functions import text, values
from terrarank.sources import codes, files, html, periods, publish


def test_delimited_file_keeps_text_and_drops_the_mark(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿GEOID\tNAME  \tPOP \n01001\tDoña Ana\t12\n09\tx\t-\n".encode())
    df = files.read_delimited(spark, str(tmp_path), "\t", ["GEOID", "NAME", "POP"])
    assert df.columns == ["GEOID", "NAME", "POP"]
    rows = files.cast_columns(df, {"POP": "double"}).orderBy("GEOID").collect()
    assert [tuple(r) for r in rows] == [("01001", "Doña Ana", 12.0), ("09", "x", None)]
    assert files.check_decoding(df, ["NAME"]).count() == 0
    with pytest.raises(ValueError, match="missing columns: LAND"):
        files.read_delimited(spark, str(tmp_path), "\t", ["LAND"])


def test_files_in_two_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name\nDoña Ana\n".encode())
    (tmp_path / "b.csv").write_bytes("name\nPeña\n".encode("latin-1"))
    assert {r.name for r in files.read_delimited(spark, str(tmp_path), ",", ["name"]).collect()} == {"Doña Ana", "Peña"}
    raw = spark.createDataFrame([(bytearray("Doña".encode("latin-1")),), (bytearray("\ufeffDoña".encode()),)], "b binary")
    assert [r[0] for r in raw.select(files.decode_bytes("b")).collect()] == ["Doña", "Doña"]


def test_wrong_decoding_fails_the_read(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name\nDoña Ana\n".encode().decode("latin-1").encode())
    with pytest.raises(Exception, match="wrongly decoded text in name"):
        files.read_delimited(spark, str(tmp_path), ",", ["name"]).collect()


def test_stations_with_different_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("STATION,DATE,TMAX\nS1,2010-01,5\n")
    (tmp_path / "b.csv").write_text('NAME,PRCP,DATE,STATION\n"x, y",2.5,2010-02,S2\n"x",-9999,2010-03,S2\n')
    (tmp_path / "c.csv").write_text("DATE,STATION,OTHER\n2010-01,S3,1\n")
    rows = files.read_stations(spark, str(tmp_path), ["TMAX", "PRCP"], [-9999.0]).orderBy("station").collect()
    assert [tuple(r) for r in rows] == [("S1", 1, 5.0, None), ("S2", 2, None, 2.5)]


def test_payload_keeps_rows_without_a_group(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "g string, v int")
    assert sorted(str(r.g) for r in files.payload_of(df, "f", ["g"]).collect()) == ["None", "a"]


def test_any_word_of_a_column_has_a_code(spark):
    df = spark.createDataFrame([(i, f"w{i % 1500:04d}") for i in range(3000)] + [(9999, None)], "id long, word string")
    table = codes.code_table(df, "word")
    out = codes.encode_with(df, "word", table)
    assert {(r.word, r.code) for r in out.collect()} == {(f"w{i:04d}", i) for i in range(1500)} | {(None, None)}
    with pytest.raises(Exception, match="not a known word: w0000"):
        codes.encode_with(df, "word", table.where("code > 0")).collect()


def test_record_width_change_fails(spark):
    ok = spark.createDataFrame([("PL|750|b1|5|",), ("PL|140|short",)], "line string")
    assert [tuple(r) for r in files.record_lines(ok, "line", "|", 1, "750", {"block": 2, "pop": 3}, 5).collect()] == [("b1", "5")]
    bad = spark.createDataFrame([("PL|750|b1|5",)], "line string")
    with pytest.raises(Exception, match="record width changed"):
        files.record_lines(bad, "line", "|", 1, "750", {"block": 2}, 5).collect()


def test_payload_format_and_missing_columns(spark):
    body = json.dumps({"format": "v1", "columns": ["fips", "v"], "rows": [["01001", 1.5], ["01003", "x"], ["01005", None]]})
    df = spark.createDataFrame([(body,)], "body string")
    got = [tuple(r) for r in files.row_payload(df, "body", "v1", ["fips"], ["v", "gone"]).collect()]
    assert got == [("01001", 1.5, None), ("01003", None, None), ("01005", None, None)]
    with pytest.raises(Exception, match="unexpected format"):
        files.row_payload(df, "body", "v2", ["fips"], ["v"]).collect()


def test_payload_parts_stay_bounded_and_whole(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").cast("string").alias("k"), (F.col("id") * 1.0).alias("v"))
    parts = files.payload_of(df, "v1", ["g"], rows_per_payload=50)
    assert parts.count() == 20
    assert files.row_payload(parts, "body", "v1", ["k"], ["v"]).agg(F.sum("v")).first()[0] == sum(range(1000))


def test_one_block_in_two_groups_fails(spark):
    df = spark.createDataFrame([("b1", "Z1"), ("b1", "Z1"), ("b2", " ")], "b string, z string")
    assert files.membership(df, "b", "z").count() == 1
    with pytest.raises(Exception, match="member of two groups"):
        files.membership(df.unionByName(spark.createDataFrame([("b1", "Z2")], "b string, z string")), "b", "z").collect()


def test_column_is_picked_by_content(spark):
    df = spark.createDataFrame([("1", "01001"), ("2", "9003.0"), ("3", None)], "fips string, county string")
    assert files.pick_column(df, ["fips", "county"], [4, 5]) == "county"
    with pytest.raises(ValueError, match="no candidate"):
        files.pick_column(df, ["fips"], [4, 5])


def test_interim_keys_must_be_text(spark, tmp_path):
    publish.write_interim(spark.createDataFrame([(1, 2.0)], "fips int, v double"), str(tmp_path), "bad")
    with pytest.raises(ValueError, match="not text: fips"):
        publish.read_interim(spark, str(tmp_path), "bad", ["fips"])


def test_station_folder_tolerates_absent_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("STATION,DATE,TMAX\nS1,2010-01,50.5\nS1,2010-02,-7777\n")
    got = files.read_stations(spark, str(tmp_path), ["TMAX", "SNOW"], [-7777]).collect()
    assert [tuple(r) for r in got] == [("S1", 1, 50.5, None)]


def test_latest_month_needs_more_than_half(spark):
    df = spark.createDataFrame([("a", 10.0, 20.0, None), ("b", 10.0, 5.0, None), ("c", None, 7.0, 9.0)], "zip string, `2023-01-31` double, `2024-01-31` double, `2024-02-29` double")
    got = {r["zip"]: (r["v"], r["v_yoy"], r["month"]) for r in periods.latest_month(df, "zip", df.columns[1:], "v").collect()}
    assert got == {"a": (20.0, 100.0, "2024-01"), "b": (5.0, -50.0, "2024-01"), "c": (7.0, None, "2024-01")}


def test_unknown_word_fails(spark):
    df = spark.createDataFrame([("Very High",), (None,)], "w string")
    assert [r[0] for r in df.select(codes.encode("w", codes.RISK_WORDS)).collect()] == [4, None]
    with pytest.raises(Exception, match="not a known word: Odd"):
        spark.createDataFrame([("Odd",)], "w string").select(codes.encode("w", codes.RISK_WORDS)).collect()


def test_nested_tables_and_unclosed_cells(spark):
    page = ("<table><tr><th>State<th>Wage</tr><tr><td>New&nbsp;York</td><td>$16 <table><tr><td>City</td><td>$17</td></tr></table></td></tr>"
            "<tr><td>Utah<br>note</td><td>A &amp; B</tr></table>")
    df = html.table_rows(spark.createDataFrame([(1, page), (2, "no table"), (3, None)], "page int, html string"), "page", "html")
    rows = [(r["table_no"], r["row_no"], r["cells"]) for r in df.orderBy("table_no", "row_no").collect()]
    assert rows == [(0, 0, ["City", "$17"]), (1, 0, ["State", "Wage"]), (1, 1, ["New York", "$16 City $17"]), (1, 2, ["Utah note", "A & B"])]


def test_long_page(spark):
    """A page of 100,000 tags, with a table open across all stretches of the fold."""
    inner = "<table><tr><td>deep</td></tr></table>"
    page = "<table>" + "".join(f"<tr><td>{i}</td><td>x{inner if i == 9_000 else ''}</td></tr>" for i in range(16_666)) + "</table>"
    rows = html.table_rows(spark.createDataFrame([(1, page)], "page int, html string"), "page", "html").collect()
    got = {(r["table_no"], r["row_no"]): r["cells"] for r in rows}
    assert got == {(0, 0): ["deep"]} | {(1, i): [str(i), "x deep" if i == 9_000 else "x"] for i in range(16_666)}


def test_newest_period_is_a_pushed_filter(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01"), (2, "2024-03"), (3, "2024-03"), (4, None)], "k int, month string").write.partitionBy("month").parquet(f"{tmp_path}/by")
    spark.read.parquet(f"{tmp_path}/by").write.parquet(f"{tmp_path}/flat")
    for name, word in (("by", "PartitionFilters"), ("flat", "PushedFilters")):
        newest = periods.newest_period(spark.read.parquet(f"{tmp_path}/{name}"), "month")
        assert sorted(r["k"] for r in newest.collect()) == [2, 3]
        plan = newest._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert plan.count("Scan parquet") <= 2 and "Join" not in plan
        assert any(word in line and "2024-0" in line for line in plan.split("\n")), plan
    nothing = spark.createDataFrame([(4, None)], "k int, month string")
    assert periods.newest_period(nothing, "month").count() == 0


def test_page_hash_ignores_markup(spark):
    df = spark.createDataFrame([("<p>No  “permit”</p><script>x()</script>",), ('no <b>"permit"</b>',)], "h string")
    a, b = [r[0] for r in df.select(text.page_hash("h")).collect()]
    assert a == b and len(a) == 16


def test_keys_and_sentinels(spark):
    df = spark.createDataFrame([("1001.0",), (" '01003 ",), ("480019503001",), ("nan",), (None,)], "k string")
    assert [r[0] for r in df.select(text.digits_key("k")).collect()] == ["01001", "01003", "48001", None, None]
    v = spark.createDataFrame([(-666666666.0,), (-666667.0,), (-5.0,), (None,)], "v double")
    assert [r[0] for r in v.select(values.sentinel_to_null("v")).collect()] == [None, None, -5.0, None]


def test_names_and_labels(spark):
    df = spark.createDataFrame([("Doña Ana",), ("Saint Louis-Park",), ("O'Fallon",), ("Mt. Airy",)], "n string")
    assert [r[0] for r in df.select(text.normalize_place("n")).collect()] == ["dona ana", "st louis park", "ofallon", "mt airy"]
    labels = spark.createDataFrame([("Caddo Heights, South Highlands, Shreveport · 71104",), ("Near Northeast, Washington",), ("Near Manor · 78653",), ("Austin",)], "l string")
    got = [tuple(r) for r in labels.select(text.parse_label("l").alias("x")).select("x.*").collect()]
    assert got == [("Caddo Heights, South Highlands", "Shreveport", False, "71104"), ("Near Northeast", "Washington", False, None), (None, "Manor", True, "78653"), (None, "Austin", False, None)]
