"""Delimited, record-typed, JSON and station files to tables, all columns as text until cast on purpose."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_mojibake, strip_bom
from ..functions.values import codes_to_null, col, number
from ..session import broadcast_checked


def read_delimited(spark: SparkSession, path: str, sep: str = ",", required: Sequence[str] = ()) -> DataFrame:
    """Delimited files with a header, every column a string, headers trimmed and freed of a byte-order mark.

    Bytes are read as Latin-1, which loses none; each value is then UTF-8 where its bytes are valid UTF-8, else stays
    Latin-1. Missing required columns are an error now; text with the marks of a wrong decoding is an error while rows
    are read.
    """
    raw = spark.read.csv(path, sep=sep, header=True, inferSchema=False, encoding="ISO-8859-1", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = [_header_name(c) for c in raw.columns]
    df = raw.toDF(*names)
    df = df.select([_decoded(c) for c in names])
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"{path} is missing columns: {', '.join(missing)}")
    return df


def _header_name(c: str) -> str:
    data = c.encode("latin-1", "replace")
    try:
        return data.decode("utf-8").strip().lstrip("\ufeff").strip()
    except UnicodeDecodeError:
        return c.strip()


def _decoded(c: str) -> Column:
    text = decode_bytes(F.encode(F.col(f"`{c}`"), "ISO-8859-1"))
    wrong = F.raise_error(F.concat(F.lit(f"wrongly decoded text in {c}: "), text)).cast("string")
    return F.when(F.coalesce(is_mojibake(text), F.lit(False)), wrong).otherwise(text).alias(c)


def check_decoding(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose text shows the marks of a wrong decoding, with the column."""
    bad = F.array_compact(F.array(*[F.when(is_mojibake(c), F.struct(F.lit(c).alias("column"), F.col(c).alias("text"))) for c in columns]))
    return df.select(F.explode(bad).alias("b")).select("b.*")


def decode_bytes(raw: Column | str) -> Column:
    """Text of file bytes: UTF-8 where they are valid UTF-8, else Latin-1; a byte-order mark is dropped."""
    raw = col(raw)
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))
    return strip_bom(text)


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Explicit casts; text that is not a number becomes NULL."""
    cast = {c: number(F.trim(c)) if t == "double" else F.trim(c).try_cast(t) for c, t in types.items()}
    return df.withColumns(cast)


def record_lines(lines: DataFrame, line: str, sep: str, type_at: int, keep: str, fields: Mapping[str, int], width: int) -> DataFrame:
    """One record type of a headerless file, fields by position; a kept line of another width fails the job."""
    parts = F.split(F.rtrim(line), sep.replace("|", r"\|"), -1)
    rows = lines.select(parts.alias("_f")).filter(F.get("_f", F.lit(type_at)) == keep)
    ok = F.assert_true(F.size("_f") == width, F.concat(F.lit("record width changed: "), F.size("_f").cast("string")))
    rows = rows.filter(ok.isNull())
    return rows.select(*[F.get("_f", F.lit(i)).alias(name) for name, i in fields.items()])


def array_table(pages: DataFrame, body: str, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """JSON ``[[header…], [row…], …]`` per page to rows, columns found by name."""
    parsed = pages.select(*keys, F.from_json(body, "array<array<string>>").alias("_t"))
    rows = parsed.select(*keys, F.get("_t", F.lit(0)).alias("_h"), F.posexplode("_t").alias("_i", "_r")).filter("_i > 0")
    at = lambda c: F.get("_r", F.array_position("_h", c) - 1)
    return rows.select(*keys, *[at(c).alias(c) for c in columns])


def join_chunks(chunks: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Column chunks fetched apart, joined on their key; a key in any chunk is kept."""
    out = chunks[0]
    for c in chunks[1:]:
        out = out.join(c, list(key), "full")
    return out


SERIES = "struct<series:array<struct<seriesID:string,data:array<struct<year:string,period:string,value:string>>>>>"


def annual_series(pages: DataFrame, body: str, prefix: str, length: int, key_at: int, key_width: int, period: str = "M13") -> DataFrame:
    """Nested series JSON to (key, year, value): annual points of the series with the right kind of id."""
    s = pages.select(F.explode(F.from_json(body, SERIES)["series"]).alias("s"))
    s = s.filter(F.col("s.seriesID").startswith(prefix) & (F.length("s.seriesID") == length))
    d = s.select(F.substring("s.seriesID", key_at, key_width).alias("key"), F.explode("s.data").alias("d")).filter(F.col("d.period") == period)
    return d.select("key", F.col("d.year").try_cast("int").alias("year"), number("d.value").alias("value")).filter("year IS NOT NULL AND value IS NOT NULL")


# --- payloads ----------------------------------------------------------------


def row_payload(payloads: DataFrame, body: str, expected: str, text: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """``{format, columns, rows}`` to a table. A wrong format fails the job; a column the payload lacks, or a
    value that is not a number, is unknown."""
    schema = "struct<format:string,columns:array<string>,rows:array<array<string>>>"
    p = payloads.select(F.from_json(body, schema).alias("p"))
    ok = F.assert_true(F.col("p.format").eqNullSafe(expected), F.concat(F.lit("unexpected format: "), F.coalesce("p.format", F.lit("none"))))
    rows = p.filter(ok.isNull()).select(F.col("p.columns").alias("_c"), F.explode("p.rows").alias("_r"))
    at = lambda c: F.get("_r", F.nullif(F.array_position("_c", c), F.lit(0).cast("bigint")) - 1)
    return rows.select(*[at(c).alias(c) for c in text], *[number(at(c)).alias(c) for c in numbers])


def column_payload(payloads: DataFrame, body: str, expected: str, text: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """``{format, n, columns: {name: […]}}`` to a table, one row per position."""
    schema = "struct<format:string,n:int,columns:map<string,array<string>>>"
    p = payloads.select(F.from_json(body, schema).alias("p"))
    ok = F.assert_true(F.col("p.format").eqNullSafe(expected), F.lit("unexpected format"))
    p = p.filter(ok.isNull() & (F.col("p.n") > 0))
    rows = p.select(F.col("p.columns").alias("_c"), F.explode(F.sequence(F.lit(0), F.col("p.n") - 1)).alias("position"))
    at = lambda c: F.get(F.try_element_at("_c", F.lit(c)), F.col("position"))
    return rows.select(*[at(c).alias(c) for c in text], *[number(at(c)).alias(c) for c in numbers])


def payload_of(df: DataFrame, fmt: str, by: Sequence[str], rows_per_payload: int = 10_000) -> DataFrame:
    """Rows packed as ``{format, columns, rows}`` JSON. A group larger than ``rows_per_payload`` becomes
    several payloads, so no task packs an unbounded group."""
    cols = [c for c in df.columns if c not in by]
    row = F.array(*[F.col(c).cast("string") for c in cols])
    parts = df.groupBy(*by).agg(F.ceil(F.count("*") / rows_per_payload).alias("_parts"))
    named = parts.select([F.col(c).alias(f"_by_{c}") for c in by] + ["_parts"])
    same = F.lit(True)
    for c in by:
        same = same & df[c].eqNullSafe(named[f"_by_{c}"])
    rows = df.join(named, same).drop(*[f"_by_{c}" for c in by]).withColumn("part", F.pmod(F.xxhash64(*cols), F.col("_parts")))
    packed = rows.groupBy(*by, "part").agg(F.collect_list(row).alias("rows"))
    return packed.select(*by, "part", F.to_json(F.struct(F.lit(fmt).alias("format"), F.array(*[F.lit(c) for c in cols]).alias("columns"), "rows"),
                                        {"ignoreNullFields": "false"}).alias("body"))


# --- stations ------------------------------------------------------------------


def read_stations(spark: SparkSession, path: str, variables: Sequence[str], sentinels: Sequence[float], date: str = "DATE") -> DataFrame:
    """Station files under a folder, each read by its own header: columns in any order, tolerated when absent;
    month cut from the date, marker values unknown, rows of stations that report nothing dropped.

    A header is a line that names the station and the date column; one row per file is its table of headers.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("value").alias("_line"))
    head = strip_bom("_line").contains("STATION") & F.col("_line").contains(date)
    width = lines.filter(head).agg(F.max(F.size(F.split("_line", ",")))).first()[0] or 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    cells = lambda line: F.array(*[F.trim(F.from_csv(line, schema)[f"c{i}"]) for i in range(width)])
    headers = lines.filter(head).groupBy("_file").agg(F.min(cells(strip_bom("_line"))).alias("_names"))
    rows = lines.filter(~head).withColumn("_cells", cells(F.col("_line"))).join(broadcast_checked(headers), "_file")
    value = lambda c: F.nullif(F.get("_cells", F.nullif(F.array_position("_names", F.lit(c)), F.lit(0)).cast("int") - 1), F.lit(""))
    return station_rows(rows.select(*[value(c).alias(c) for c in ["STATION", date, *variables]]), variables, sentinels, date)


def station_rows(df: DataFrame, variables: Sequence[str], sentinels: Sequence[float], date: str = "DATE") -> DataFrame:
    month = F.regexp_extract(date, r"(\d{1,2})$", 1).try_cast("int")
    out = df.select(F.col("STATION").alias("station"), month.alias("month"), *[codes_to_null(number(v), sentinels).alias(v.lower()) for v in variables])
    return out.filter(F.coalesce(*[v.lower() for v in variables]).isNotNull())


def station_inventory(lines: DataFrame, line: str, excluded_prefixes: Sequence[str] = ()) -> DataFrame:
    """(station, lat, lon) from either inventory layout: comma-separated or fixed columns."""
    comma = F.split(line, ",")
    is_comma = F.col(line).contains(",")
    station = F.when(is_comma, F.trim(F.get(comma, F.lit(0)))).otherwise(F.trim(F.substring(line, 1, 11)))
    lat = F.when(is_comma, F.get(comma, F.lit(1))).otherwise(F.substring(line, 13, 8))
    lon = F.when(is_comma, F.get(comma, F.lit(2))).otherwise(F.substring(line, 22, 9))
    out = lines.select(station.alias("station"), number(F.trim(lat)).alias("lat"), number(F.trim(lon)).alias("lon"))
    for p in excluded_prefixes:
        out = out.filter(~F.col("station").startswith(p))
    return out.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())


# --- choosing columns and levels -------------------------------------------------


def pick_column(df: DataFrame, candidates: Sequence[str], widths: Sequence[int], least: float = 0.9) -> str:
    """The first candidate present whose values look like keys: at least ``least`` have a listed number of
    digits. One aggregation over all candidates; its single row decides."""
    present = {c.lower(): c for c in df.columns}
    found = [present[c.lower()] for c in candidates if c.lower() in present]
    if not found:
        raise ValueError(f"none of {list(candidates)} is a column")
    def share(c: str) -> Column:
        v = F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
        digits = F.length(F.regexp_replace(F.regexp_replace(v, r"\.0$", ""), r"\D", ""))
        return F.avg(F.when(digits.isin(*widths), 1.0).when(v.isNotNull(), 0.0)).alias(c)
    shares = df.agg(*[share(c) for c in found]).first()
    for c in found:
        if (shares[c] or 0.0) >= least:
            return c
    raise ValueError(f"no candidate holds keys: { {c: shares[c] for c in found} }")


def level_rows(df: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """Rows at one level of each listed axis (text compared trimmed, lower case); axes the table lacks are
    skipped."""
    names = {c.lower(): c for c in df.columns}
    out = df
    for axis, value in filters.items():
        if axis.lower() in names:
            out = out.filter(F.lower(F.trim(F.col(names[axis.lower()]).cast("string"))) == value)
    return out


def average_over_axes(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """One value per key, averaged over whatever axes are left."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.avg(number(value)).alias(out))


def membership(df: DataFrame, member: str, group: str) -> DataFrame:
    """A one-to-one membership: blanks dropped, a member in two groups fails the job."""
    rows = df.filter(F.coalesce(F.trim(group), F.lit("")) != "").groupBy(member).agg(F.min(group).alias(group), F.count_distinct(group).alias("_n"))
    ok = F.assert_true(F.col("_n") == 1, F.concat(F.lit("member of two groups: "), F.col(member).cast("string")))
    return rows.filter(ok.isNull()).drop("_n")


# --- reference points --------------------------------------------------------------


def large_airports(df: DataFrame) -> DataFrame:
    """Large airports with scheduled service; the code falls back to the identifier."""
    kept = df.filter((F.col("type") == "large_airport") & (F.col("iso_country") == "US") & (F.col("scheduled_service") == "yes"))
    code = F.coalesce(F.nullif("iata_code", F.lit("")), "ident")
    return kept.select(code.alias("code"), "name", number("latitude_deg").alias("lat"), number("longitude_deg").alias("lon"))


TOWN_TYPES = ["PPL", "PPLA", "PPLA2", "PPLA3", "PPLA4", "PPLC"]
TOWN_MIN_POPULATION = 15_000


def towns(df: DataFrame) -> DataFrame:
    kept = df.filter((F.col("country") == "US") & F.col("fcode").isin(*TOWN_TYPES)).withColumn("population", number("population"))
    return kept.filter(F.col("population") >= TOWN_MIN_POPULATION).select("name", F.col("admin1").alias("state"), number("lat").alias("lat"), number("lon").alias("lon"), "population")


def partitions_to_build(wanted: DataFrame, index: DataFrame, key: str, published_only: bool) -> DataFrame:
    """Partitions to build: all wanted, or only those already published."""
    return wanted.join(index, key, "left_semi") if published_only else wanted
