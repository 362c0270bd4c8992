"""Cleaning, keys, derived columns, flags, words, climate types and taxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands, flags, text, values
from ..functions.climate import family_rows
from ..operators import climate, taxes
from . import base, wordings
from .registry import query, r, rs, shared, with_


@query("B1 B2", """SELECT o_orderkey, lpad(left(o_custkey::VARCHAR, 5), 5, '0') AS key5, lpad((o_orderkey % 90)::VARCHAR, 2, '0') || lpad((o_custkey % 900)::VARCHAR, 3, '0') AS joined,
  CASE WHEN o_orderkey % 5 <> 0 THEN lpad(left(o_custkey::VARCHAR, 3), 3, '0') END AS cleaned FROM orders""")
def identity_keys(t):
    k = F.col("o_custkey")
    dirty = F.when(F.col("o_orderkey") % 5 == 0, "nan").otherwise(F.concat(F.lit(" '"), k.cast("string"), F.lit("'.0 ")))
    dirty = F.regexp_replace(dirty, "'\\.0 $", ".0")
    return t.orders.select("o_orderkey", text.digits_key(F.concat(k.cast("string"), F.lit(".0"))).alias("key5"),
                           text.composite_key([(F.col("o_orderkey") % 90, 2), (k % 900, 3)]).alias("joined"),
                           text.digits_key(dirty, 3).alias("cleaned"))


@query("B3 B4 B5", """SELECT c_custkey, CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal END AS est,
  CASE WHEN c_custkey % 4 = 0 THEN 0.0 WHEN c_custkey % 4 = 1 THEN NULL ELSE abs(c_acctbal) END AS moe, CASE WHEN c_custkey % 8 NOT IN (1, 3) THEN c_custkey % 8 END AS coded FROM customer""")
def sentinels_to_unknown(t):
    k, v = F.col("c_custkey"), F.col("c_acctbal")
    est = F.when(k % 6 == 0, F.lit(-666666666.0)).otherwise(v)
    moe = F.when(k % 4 == 0, F.lit(-555555555.0)).when(k % 4 == 1, F.lit(-222222222.0)).otherwise(F.abs(v))
    return t.customer.select("c_custkey", values.sentinel_to_null(est).alias("est"), values.margin_of_error(moe).alias("moe"),
                             values.codes_to_null(k % 8, [1, 3]).alias("coded"))


@query("B6 B7 A19", with_(*base.PLACE_SQL, select=f"""SELECT place, {rs('CASE WHEN balance > 0 THEN spend / balance END')} AS price_to_income,
  {rs('CASE WHEN spend > 0 THEN balance * 12 / spend END')} AS rent_to_income, {rs('CASE WHEN balance * 12 > 0 THEN spend / (balance * 12) END')} AS price_to_rent,
  {rs('100 * CASE WHEN spend > 0 THEN balance / spend END')} AS tax_rate FROM places"""))
def derived_ratios(t):
    b, s = F.col("balance"), F.col("spend")
    return base.places(t).select(
        "place", r(values.safe_divide(s, b)).alias("price_to_income"), r(values.safe_divide(b * 12, s)).alias("rent_to_income"),
        r(values.safe_divide(s, b * 12)).alias("price_to_rent"), r(100 * values.safe_divide(b, s)).alias("tax_rate"))


SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("B8", with_(*base.PLACE_SQL, """g AS (SELECT county, """ + ", ".join(f"sum(orders) FILTER (WHERE segment = '{s}')::DOUBLE AS {s}" for s in SEG) + """, sum(orders)::DOUBLE AS total FROM places GROUP BY 1)""",
  select="SELECT county, " + ", ".join(f"{rs(f'100 * {s} / total')} AS {s.lower()}_share" for s in SEG) + ", " +
  rs("100 * (1 - (" + " + ".join(f"coalesce(pow({s} / total, 2), 0)" for s in SEG) + "))") + " AS diversity_index FROM g"))
def group_shares_and_diversity(t):
    g = base.places(t).groupBy("county").agg(
        *[F.sum(F.when(F.col("segment") == s, F.col("orders"))).cast("double").alias(s) for s in SEG], F.sum("orders").cast("double").alias("total"))
    share = {s: values.safe_divide(s, "total") for s in SEG}
    squares = values.known_sum([F.pow(c, 2) for c in share.values()])
    return g.select("county", *[r(100 * c).alias(f"{s.lower()}_share") for s, c in share.items()],
                    r(100 * (1 - squares)).alias("diversity_index"))


@query("B9 A16", """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 AND p_partkey % 2 = 0 THEN 0.0 WHEN p_partkey % 5 = 0 THEN NULL ELSE least(100.0, greatest(0.0, p_retailprice / 10)) END AS risk,
  list_position(['Very Low', 'Relatively Low', 'Relatively Moderate', 'Relatively High', 'Very High', 'Not Applicable', 'Insufficient Data', 'No Rating', 'No Expected Annual Losses'], w) - 1 AS code FROM (
  SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'Not Applicable' WHEN p_size > 25 THEN 'Very High' ELSE 'Relatively Low' END AS w FROM part)""")
def hazard_percentiles(t):
    from ..sources import codes

    k = F.col("p_partkey")
    word = F.when(k % 2 == 0, "Not Applicable").when(F.col("p_size") > 25, "Very High").otherwise("Relatively Low")
    pct = F.when(k % 5 != 0, F.col("p_retailprice") / 10)
    rows = t.part.select(k, word.alias("rating"), pct.alias("pct"))
    risk = F.when(F.col("pct").isNull() & (F.col("rating") == "Not Applicable"), 0.0).otherwise(values.clip("pct", 0, 100))
    return rows.select("p_partkey", risk.alias("risk"), codes.encode("rating", codes.RISK_WORDS).alias("code"))


@query("B10", """WITH m AS (SELECT l_orderkey, sum(l_quantity) AS den, sum(l_discount * 10) AS num, 2 + l_orderkey % 9 AS dm, 1 + l_orderkey % 4 AS nm FROM lineitem GROUP BY l_orderkey)
  SELECT l_orderkey, round(sqrt(CASE WHEN nm * nm - pow(num / den, 2) * dm * dm >= 0 THEN nm * nm - pow(num / den, 2) * dm * dm ELSE nm * nm + pow(num / den, 2) * dm * dm END) / den, 6) AS share_moe,
  round(sqrt(nm * nm + pow(num / den, 2) * dm * dm) / den, 6) AS ratio_moe FROM m""")
def margins_of_error(t):
    k = F.col("l_orderkey")
    m = t.lineitem.groupBy(k).agg(F.sum("l_quantity").alias("den"), F.sum(F.col("l_discount") * 10).alias("num"))
    m = m.withColumns({"dm": 2 + k % 9, "nm": 1 + k % 4})
    return m.select("l_orderkey", r(values.share_margin("num", "nm", "den", "dm")).alias("share_moe"),
                    r(values.ratio_margin("num", "nm", "den", "dm")).alias("ratio_moe"))


@query("B11 B12 B13", with_(*base.PLACE_SQL, """f AS (SELECT place, balance, spend, CASE WHEN place % 4 <> 0 THEN abs(balance) * (0.3 + place % 5 * 0.2) END AS moe, orders FROM places)""",
  select="""SELECT place, concat_ws(';', CASE WHEN (balance > 0 AND moe / 1.645 / balance > 0.4) OR (balance IS NOT NULL AND moe IS NULL AND NOT balance >= 9000) THEN 'balance' END,
   CASE WHEN orders * 2 > 15 THEN 'share' END, CASE WHEN orders < 5 THEN 'thin' END) AS flags, concat_ws(';', CASE WHEN balance >= 9000 THEN 'balance' END, CASE WHEN spend >= 2000000 THEN 'spend' END) AS topcoded FROM f"""))
def confidence_flags(t):
    k, b = F.col("place"), F.col("balance")
    p = base.places(t).withColumn("moe", F.when(k % 4 != 0, F.abs(b) * (0.3 + k % 5 * 0.2)))
    rules = {"balance": flags.estimate_flag("balance", "moe", b >= 9000), "share": flags.share_flag(F.col("orders") * 2.0), "thin": F.col("orders") < 5}
    return p.select("place", flags.write_flags(flags.flag_set(rules)).alias("flags"),
                    flags.write_flags(flags.topcodes({"balance": 9000, "spend": 2000000})).alias("topcoded"))


@query("B14", with_(*base.PLACE_SQL, """f AS (SELECT place, concat_ws(';', CASE WHEN place % 2 = 0 THEN 'mobile_homes' END, CASE WHEN place % 3 = 0 THEN 'property_tax_rate' END,
   CASE WHEN place % 5 = 0 THEN 'crime' END, CASE WHEN place % 7 = 0 THEN 'crime_wide' END, CASE WHEN place % 11 = 0 THEN 'kids_share' END) AS fl FROM places)""",
  select="""SELECT place, concat_ws(';', CASE WHEN place % 2 = 0 THEN 'median_home_value' END, CASE WHEN place % 3 = 0 THEN 'property_tax_rate;taxes;taxes_rate' END, CASE WHEN place % 5 = 0 THEN 'crime' END,
   CASE WHEN place % 7 = 0 THEN 'crime_wide' END, CASE WHEN place % 11 = 0 THEN 'kids_share' END) AS covered,
   concat_ws(';', CASE WHEN place % 2 = 0 THEN 'mobile_homes' END, CASE WHEN place % 5 = 0 AND place % 4 = 1 THEN 'crime' END) AS headline FROM f"""))
def flag_expansion(t):
    k = F.col("place")
    f = flags.flag_set({"mobile_homes": k % 2 == 0, "property_tax_rate": k % 3 == 0, "crime": k % 5 == 0, "crime_wide": k % 7 == 0, "kids_share": k % 11 == 0})
    rows = base.places(t).select("place", flags.read_flags(flags.write_flags(f)).alias("f"))
    caution = flags.caution_flags("f", k % 4 == 1)
    return rows.select("place", flags.write_flags(flags.covered_columns("f")).alias("covered"),
                       flags.write_flags(flags.headline_flags(caution)).alias("headline"))


@query("B17", """SELECT c_custkey, CASE WHEN c_nationkey % 4 = 1 THEN c_nationkey + 100 ELSE c_nationkey END::BIGINT AS code FROM customer""")
def remapped_keys(t):
    from ..operators.joins import remap_key

    table = t.nation.filter("n_nationkey % 4 = 1").select(F.col("n_nationkey").alias("old"), (F.col("n_nationkey") + 100).alias("new"))
    return remap_key(t.customer.withColumn("code", F.col("c_nationkey")), "code", table, "old", "new").select("c_custkey", F.col("code").cast("long"))


@query("B19 B32", """WITH n AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Saint José ' ELSE 'Mount O''Fallon—' END || source AS nm,
   source || CASE doc_id % 3 WHEN 0 THEN ' County Sheriff''s Office' WHEN 1 THEN ' Police Department' ELSE ' Harbor Patrol' END AS ag FROM documents)
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'st jose ' ELSE 'mt ofallon ' END || trim(regexp_replace(lower(substr(nm, CASE doc_id % 4 WHEN 0 THEN 12 ELSE 16 END)), '[^a-z0-9]+', ' ', 'g')) AS place_key,
   CASE doc_id % 3 WHEN 0 THEN 'County' WHEN 1 THEN 'City' END AS kind, CASE WHEN doc_id % 3 < 2 THEN regexp_replace(ag, '( County Sheriff''s Office| Police Department)$', '') END AS jurisdiction FROM n""")
def name_keys(t):
    k, s = F.col("doc_id"), F.col("source")
    name = F.concat(F.when(k % 4 == 0, "Saint José ").otherwise("Mount O'Fallon—"), s)
    agency = F.concat(s, F.when(k % 3 == 0, " County Sheriff's Office").when(k % 3 == 1, " Police Department").otherwise(" Harbor Patrol"))
    j = text.agency_jurisdiction(agency)
    return t.documents.select("doc_id", text.normalize_place(name).alias("place_key"), j["kind"].alias("kind"), j["jurisdiction"].alias("jurisdiction"))


LABELS = """lab AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS hood, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS place, CASE WHEN p_partkey % 10 <> 0 THEN p_brand END AS near,
   CASE WHEN p_partkey % 4 <> 0 THEN lpad((p_partkey * 7 % 100000)::VARCHAR, 5, '0') END AS zip FROM part),
  lbl AS (SELECT *, coalesce(hood || ', ', '') || coalesce(place, 'Near ' || near, 'Unincorporated Travis') || coalesce(' · ' || zip, '') AS label FROM lab)"""


@shared
def labels(t):
    k = F.col("p_partkey")
    rows = t.part.select(k, F.when(k % 3 == 0, F.col("p_type")).alias("hood"), F.when(k % 5 != 0, F.col("p_brand")).alias("place"),
                         F.when(k % 10 != 0, F.col("p_brand")).alias("near"),
                         F.when(k % 4 != 0, F.lpad((k * 7 % 100000).cast("string"), 5, "0")).alias("zip"))
    return rows.withColumn("label", text.compose_label("hood", "place", "near", F.lit("Travis, TX"), "zip"))


@query("B20", with_(LABELS, select="SELECT p_partkey, label FROM lbl"))
def area_labels(t):
    return labels(t).select("p_partkey", "label")


@query("B21", with_(LABELS, select="""SELECT p_partkey, hood AS neighborhood, CASE WHEN place IS NOT NULL THEN place WHEN near IS NOT NULL THEN near ELSE 'Unincorporated Travis' END AS city,
  place IS NULL AND near IS NOT NULL AND hood IS NULL AS near, zip FROM lbl"""))
def parsed_labels(t):
    p = labels(t).select("p_partkey", text.parse_label("label").alias("x"))
    return p.select("p_partkey", "x.neighborhood", "x.city", "x.near", "x.zip")


@query("B24 B33", with_(*base.PLACE_SQL, select="SELECT place, CASE WHEN place % 3 <> 0 AND place % 130 < 100 AND NOT (balance = 0 AND orders = 0) THEN balance END AS own_rate, orders < 0.05 AS zero FROM places"))
def value_visibility(t):
    from ..operators.crime import owns_rate

    k = F.col("place")
    rows = base.places(t).withColumns({"wide": k % 3 == 0, "areas": k % 130})
    own = owns_rate(F.col("wide"), F.col("areas"), F.col("balance"), F.col("orders"))
    return rows.select("place", F.when(own, F.col("balance")).alias("own_rate"), climate.all_zero(F.array(F.col("orders").cast("double"))).alias("zero"))


@query("B25", with_(*base.PLACE_SQL, "v AS (SELECT place, CASE WHEN place % 10 <> 0 THEN (place * 13 % 1000) / 10.0::DOUBLE END AS p, balance, orders FROM places)", select="""SELECT place,
  CASE WHEN p IS NULL THEN NULL WHEN p < 20 THEN 'Very low' WHEN p < 40 THEN 'Low' WHEN p < 60 THEN 'Moderate' WHEN p < 80 THEN 'High' ELSE 'Very high' END AS hazard,
  CASE WHEN p IS NULL THEN 'No test scores for this district' WHEN p >= 75 THEN 'Strong schools' WHEN p >= 60 THEN 'Above average' WHEN p >= 40 THEN 'About average' WHEN p >= 25 THEN 'Below average' ELSE 'Weak schools' END AS schools,
  CASE WHEN p IS NULL THEN 'No crime data' WHEN p * 8 / 248 < 0.6 THEN 'Much safer than a typical US area' WHEN p * 8 / 248 < 0.9 THEN 'Safer than a typical US area' WHEN p * 8 / 248 <= 1.15 THEN 'About as safe as a typical US area'
     WHEN p * 8 / 248 <= 2 THEN 'More crime than a typical US area' ELSE 'Much more crime than a typical US area' END AS safety,
  CASE WHEN p IS NULL THEN 'No data' WHEN p / 150 < 0.38 THEN 'Incomes fairly even' WHEN p / 150 <= 0.46 THEN 'A typical income gap' WHEN p / 150 <= 0.52 THEN 'A wide income gap' ELSE 'A very wide income gap' END AS gap,
  CASE WHEN p IS NULL THEN 'No housing data' WHEN floor(p / 3 + 0.5) < 15 THEN 'Buying is cheap next to renting · a home costs ' || floor(p / 3 + 0.5)::BIGINT || ' years of rent'
     WHEN floor(p / 3 + 0.5) > 20 THEN 'Renting is cheap next to buying · a home costs ' || floor(p / 3 + 0.5)::BIGINT || ' years of rent' ELSE 'Buying and renting are about even · a home costs ' || floor(p / 3 + 0.5)::BIGINT || ' years of rent' END AS market,
  CASE WHEN p IS NULL THEN 'Distances below' WHEN p < 1 THEN 'In the Austin metro' WHEN p <= 15 THEN 'Next to the Austin metro · ' || floor(p + 0.5)::BIGINT || ' mi from its edge' WHEN p <= 60 THEN floor(p + 0.5)::BIGINT || ' mi from the Austin metro'
     ELSE 'Far from big metros · ' || floor(p + 0.5)::BIGINT || ' mi to Austin' END AS location,
  CASE WHEN p IS NULL THEN 'No recent price data' WHEN abs(p - 50) < 0.5 THEN 'Prices flat this year (typical +1.6%)' ELSE 'Prices ' || CASE WHEN p > 50 THEN 'up ' ELSE 'down ' END || printf('%.1f', abs(p - 50)) || '% in a year (typical +1.6%)' END AS prices FROM v"""))
def verdict_words(t):
    k = F.col("place")
    v = base.places(t).select("place", F.when(k % 10 != 0, (k * 13 % 1000) / 10.0).alias("p"))
    return v.select(
        "place", bands.band("p", wordings.HAZARD).alias("hazard"), wordings.schools("p").alias("schools"),
        wordings.safety(F.col("p") * 8, F.lit(None).cast("string")).alias("safety"), bands.band(F.col("p") / 150, wordings.INCOME_GAP, "No data").alias("gap"),
        wordings.buy_or_rent(F.col("p") / 3).alias("market"), wordings.location("p", F.lit("Austin-Round Rock, TX")).alias("location"),
        wordings.prices(F.col("p") - 50).alias("prices"))


@query("B25", with_(*base.PLACE_SQL, "v AS (SELECT place, CASE WHEN place % 10 <> 0 THEN (place * 13 % 1000) / 10.0::DOUBLE END AS p, CASE WHEN place % 9 <> 0 THEN (place * 29 % 1000) / 10.0::DOUBLE END AS q FROM places)",
 select="""SELECT place, CASE WHEN p IS NULL THEN 'No data on who lives here' ELSE CASE WHEN p < 20 THEN 'Mostly one group' WHEN p < 40 THEN 'Somewhat diverse' WHEN p < 60 THEN 'Diverse' ELSE 'Very diverse' END ||
    ' · largest group ' || CASE WHEN q IS NULL OR p >= q THEN 'White (' || floor(p + 0.5)::BIGINT ELSE 'Asian (' || floor(q + 0.5)::BIGINT END || '%)' END AS diversity,
  CASE WHEN p IS NULL AND q IS NULL THEN 'No hazard data' WHEN p IS NULL THEN 'Highest: tornadoes' WHEN q >= 80 AND p < 60 THEN w || ' loss rate overall — but tornadoes' ELSE w || ' loss rate overall' END || CASE WHEN place % 2 = 0 AND NOT (p IS NULL AND q IS NULL) THEN ' · FEMA: Very High' ELSE '' END AS hazards,
  CASE WHEN coalesce(a, o, h) IS NULL THEN 'A mix of ages, owners and renters' ELSE upper(left(concat_ws(', ', a, o, h), 1)) || substr(concat_ws(', ', a, o, h), 2) END AS people,
  CASE WHEN d IS NOT NULL AND c IS NOT NULL THEN d || ', ' || c ELSE coalesce(d, upper(left(c, 1)) || substr(c, 2), 'Distances below') END AS around,
  CASE WHEN p IS NULL AND q IS NULL THEN 'No pollution data' ELSE concat_ws(' · ', CASE WHEN p IS NOT NULL THEN CASE WHEN place % 6 = 0 THEN 'Air quality uncertain (model PM2.5 ' || printf('%.1f', p / 8) || ')'
     ELSE CASE WHEN p / 8 <= 5 THEN 'Very clean' WHEN p / 8 <= 7 THEN 'Clean' WHEN p / 8 <= 9 THEN 'Typical' WHEN p / 8 <= 12 THEN 'Somewhat polluted' ELSE 'Polluted' END || ' air (PM2.5 ' || printf('%.1f', p / 8) || ')' END END,
     CASE WHEN q IS NOT NULL THEN floor(q + 0.5)::BIGINT || ' smoke days a year' END, CASE WHEN q >= 40 THEN 'radon: test any home' END) END AS pollution FROM (
  SELECT *, CASE WHEN p < 20 THEN 'Very low' WHEN p < 40 THEN 'Low' WHEN p < 60 THEN 'Moderate' WHEN p < 80 THEN 'High' ELSE 'Very high' END AS w,
   CASE WHEN p < 35 THEN 'Young' WHEN p > 45 THEN 'Older' END AS a, CASE WHEN q < 40 THEN 'mostly renters' WHEN q > 75 THEN 'mostly owners' END AS o, CASE WHEN q >= 40 THEN 'mostly apartments' WHEN p >= 75 THEN 'mostly houses' END AS h,
   CASE WHEN p <= 3 THEN 'Close to downtown' WHEN p <= 12 THEN floor(p + 0.5)::BIGINT || ' mi to downtown' WHEN p > 12 THEN 'Far from a downtown' END AS d, CASE WHEN q <= 20 THEN 'short commute' WHEN q >= 35 THEN 'long commute' END AS c FROM v)"""))
def verdict_sentences(t):
    k = F.col("place")
    v = base.places(t).select("place", F.when(k % 10 != 0, (k * 13 % 1000) / 10.0).alias("p"), F.when(k % 9 != 0, (k * 29 % 1000) / 10.0).alias("q"))
    return v.select(
        "place", wordings.diversity("p", [("White", "p"), ("Asian", "q")]).alias("diversity"),
        wordings.hazards("p", [("Tornadoes", "q")], F.when(k % 2 == 0, "Very High")).alias("hazards"),
        wordings.people("p", "q", "q", "p").alias("people"), wordings.around("p", "q").alias("around"),
        wordings.pollution(F.col("p") / 8, k % 6 == 0, "q", "q").alias("pollution"))


@query("F27", with_(*base.PLACE_SQL, "v AS (SELECT place, (place * 13 % 1001) / 10.0::DOUBLE AS p, (place * 13 % 1001) / 10.0 - place % 3 AS b, place % 5 AS m FROM places)", select="""SELECT place, CASE WHEN m = 0 THEN floor(p + 0.5)::BIGINT || CASE WHEN floor(p + 0.5)::BIGINT % 100 BETWEEN 11 AND 13 THEN 'th' WHEN floor(p + 0.5)::BIGINT % 10 = 1 THEN 'st'
  WHEN floor(p + 0.5)::BIGINT % 10 = 2 THEN 'nd' WHEN floor(p + 0.5)::BIGINT % 10 = 3 THEN 'rd' ELSE 'th' END || ' percentile of US areas · typical is best' WHEN p >= 99.95 AND b < 99.5 THEN 'as low as any of the US areas'
  WHEN p - b >= 1 THEN 'lower than or tied with ' || floor(p + 0.5)::BIGINT || '% of US areas' ELSE 'lower than ' || floor(b + 0.5)::BIGINT || '% of US areas' END AS standing FROM v"""))
def standing_words(t):
    k = F.col("place")
    p = (k * 13 % 1001) / 10.0
    d = F.when(k % 5 == 0, "middle").otherwise("lower")
    return base.places(t).select("place", wordings.standing(F.lit("area"), d, p, p - k % 3, p).alias("standing"))


MONTHS = """mon AS (SELECT fips, month, 20 + d * 900 + 20 * cos((month - 7) * 0.5235987755982988::DOUBLE) AS tmax_f, d * 400 + 10 + 22 * cos((month - 7) * 0.5235987755982988::DOUBLE) AS tmin_f,
   CASE WHEN fips % 10 <> 4 OR month <> 3 THEN x * 60 * (1 + (fips % 5) / 3.0::DOUBLE) END AS precip_in FROM (
   SELECT l_suppkey AS fips, month(l_shipdate) AS month, avg(l_discount) AS d, avg(l_tax) AS x FROM lineitem GROUP BY ALL))"""


@shared
def monthly(t):
    m = F.month("l_shipdate")
    wave = F.cos((F.col("month") - 7) * 0.5235987755982988)
    g = t.lineitem.groupBy(F.col("l_suppkey").alias("fips"), m.alias("month")).agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("x"))
    rain = F.when((F.col("fips") % 10 != 4) | (F.col("month") != 3), F.col("x") * 60 * (1 + (F.col("fips") % 5) / 3.0))
    return g.select("fips", "month", (20 + F.col("d") * 900 + 20 * wave).alias("tmax_f"), (F.col("d") * 400 + 10 + 22 * wave).alias("tmin_f"), rain.alias("precip_in"))


@query("D2 H10", with_(MONTHS, select=f"""SELECT fips, {rs('avg(tmax_f) FILTER (WHERE month IN (6, 7, 8))')} AS summer_high, {rs('CASE WHEN count(precip_in) = 12 THEN sum(precip_in) END')} AS rain,
  {rs('CASE WHEN count(tmax_f) = 12 THEN max(tmax_f) END')} AS hottest, {rs('CASE WHEN count(tmin_f) = 12 THEN min(tmin_f) END')} AS coldest, {rs('avg((tmax_f + tmin_f) / 2) FILTER (WHERE month IN (3, 4, 5))')} AS spring FROM mon GROUP BY 1"""))
def seasonal_summaries(t):
    m = climate.fill_mean_temperature(monthly(t).withColumn("tavg_f", F.lit(None).cast("double")), "tavg_f", "tmax_f", "tmin_f")
    s = climate.summarize(m, "fips", {"summer_high": ("summer", "tmax_f", "mean"), "rain": ("year", "precip_in", "sum"), "hottest": ("year", "tmax_f", "max"),
                                      "coldest": ("year", "tmin_f", "min"), "spring": ("spring", "tavg_f", "mean")})
    return s.select("fips", *[r(c).alias(c) for c in s.columns[1:]])


@query("A15", with_(MONTHS, select="SELECT fips, string_agg(round(tmax_f, 1)::VARCHAR, ',' ORDER BY month) AS highs, count(*) AS months FROM mon GROUP BY 1"))
def monthly_series(t):
    s = climate.series(monthly(t).withColumn("tmax_f", F.round("tmax_f", 1)), "fips", ["tmax_f"])
    return s.select("fips", F.array_join(F.col("tmax_f").cast("array<string>"), ",").alias("highs"), F.size(F.array_compact("tmax_f")).cast("long").alias("months"))


def _koppen_sql(shift: str, out: str) -> str:
    return f"""CASE WHEN th + {shift} < 10 THEN CASE WHEN th + {shift} > 0 THEN 'ET' ELSE 'EF' END
     WHEN p < 10 * line{out} THEN CASE WHEN p < 5 * line{out} THEN 'BW' ELSE 'BS' END || CASE WHEN tm + {shift} >= 18 THEN 'h' ELSE 'k' END
     WHEN tc + {shift} >= 18 THEN CASE WHEN pd >= 60 THEN 'Af' WHEN pd >= 100 - p / 25 THEN 'Am' ELSE 'Aw' END
     ELSE CASE WHEN tc + {shift} > 0 THEN 'C' ELSE 'D' END || CASE WHEN sd < 40 AND sd < ww / 3 THEN 's' WHEN wd < sw / 10 THEN 'w' ELSE 'f' END ||
       CASE WHEN th + {shift} >= 22 THEN 'a' WHEN n{out} >= 4 THEN 'b' WHEN tc + {shift} <= 0 AND tc + {shift} < -38 THEN 'd' ELSE 'c' END END AS k{out}"""


KOPPEN = with_(MONTHS, "c AS (SELECT fips, month, ((tmax_f + tmin_f) / 2 - 32) * 5 / 9 AS t, precip_in * 25.4 AS p FROM mon)",
  """y AS (SELECT fips, avg(t) AS tm, max(t) AS th, min(t) AS tc, sum(p) AS p, min(p) AS pd, sum(p) FILTER (WHERE month BETWEEN 4 AND 9) AS ps, sum(p) FILTER (WHERE month NOT BETWEEN 4 AND 9) AS pw,
    min(p) FILTER (WHERE month BETWEEN 4 AND 9) AS sd, max(p) FILTER (WHERE month BETWEEN 4 AND 9) AS sw, min(p) FILTER (WHERE month NOT BETWEEN 4 AND 9) AS wd, max(p) FILTER (WHERE month NOT BETWEEN 4 AND 9) AS ww,
    count(*) FILTER (WHERE t > 10) AS n0, count(*) FILTER (WHERE t + 0.5 > 10) AS n1, count(*) FILTER (WHERE t - 0.5 > 10) AS n2 FROM c GROUP BY 1 HAVING count(*) = 12 AND count(t) = 12 AND count(p) = 12)""",
  "l AS (SELECT *, " + ", ".join(f"2 * (tm + {s}) + CASE WHEN p > 0 AND pw >= 0.7 * p THEN 0 WHEN p > 0 AND ps >= 0.7 * p THEN 28 ELSE 14 END AS line{o}" for s, o in (("0", "0"), ("0.5", "1"), ("-0.5", "2"))) + " FROM y)",
  "k AS (SELECT fips, " + ", ".join(_koppen_sql(s, o) for s, o in (("0", "0"), ("0.5", "1"), ("-0.5", "2"))) + " FROM l)",
  select="SELECT fips, k0 AS koppen, CASE WHEN k1 <> k0 THEN k1 WHEN k2 <> k0 THEN k2 END AS koppen_alt FROM k")


@query("B26 B27", KOPPEN)
def climate_types(t):
    return climate.types(monthly(t), "fips")


FAM = "fam AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{n}')" for c, _, _, n in family_rows()) + ") v(koppen, family_name))"


@query("B28 D39", with_(f"kt AS ({KOPPEN})", FAM, select="SELECT family_name, count(*) AS places FROM kt JOIN fam USING (koppen) GROUP BY 1"))
def climate_family_counts(t):
    kt = climate.types(monthly(t), "fips")
    return kt.join(F.broadcast(climate.families(t.spark)), "koppen").groupBy("family_name").agg(F.count("*").alias("places"))


@query("B28", "SELECT n_nationkey AS search, CASE WHEN n_nationkey % 2 = 0 THEN 'any' ELSE 'nothing allowed' END AS text FROM nation")
def climate_filter_text(t):
    kt = climate.types(monthly(t), "fips").select("koppen").distinct()
    everything = F.array(*[F.lit(c) for c, _, _, _ in family_rows()])
    accepts = t.nation.select(F.col("n_nationkey").alias("search"), F.when(F.col("n_nationkey") % 2 == 0, everything).otherwise(F.array(F.lit("none"))).alias("accept"))
    return climate.describe_filter(accepts, kt)


HOUSEHOLDS = [("h0", None, None, None, None), ("h1", "buy", 400000.0, 150000.0, "single"), ("h2", "rent", None, 60000.0, "joint")]
HH = """hh AS (SELECT search, tenure, budget::DOUBLE AS budget, income::DOUBLE AS income, filing FROM (VALUES ('h0', NULL, NULL, NULL, NULL), ('h1', 'buy', 400000, 150000, 'single'), ('h2', 'rent', NULL, 60000, 'joint')) v(search, tenure, budget, income, filing))"""
SCHED_TEXT = "CASE r_regionkey WHEN 0 THEN 'none' WHEN 4 THEN NULL ELSE 's:0.02@0,0.0' || (3 + r_regionkey) || '@50000;m:0.02@0,0.0' || (3 + r_regionkey) || '@100000;sd:3000,8500;ex:1500,3000;cr:0,50' END"
TAXED = f"""pl AS (SELECT place, county, state, 1.0::DOUBLE + place % 20 / 10.0::DOUBLE AS rate, CASE WHEN place % 3 <> 0 THEN 1 + place % 10 / 20.0::DOUBLE END AS buyer, CASE WHEN place % 4 <> 0 THEN spend END AS today, spend, CASE WHEN state <> 3 OR place % 2 = 0 THEN 5.0::DOUBLE + state END AS sales FROM places),
  tx AS (SELECT p.*, h.*, r_regionkey AS rk, CASE WHEN income > 0 THEN income ELSE 78538 END AS inc, CASE WHEN tenure = 'rent' THEN NULL WHEN tenure = 'buy' AND budget > 0 THEN budget ELSE coalesce(today, spend) END AS home,
    CASE WHEN filing = 'single' THEN 4500 ELSE 11500 END AS ded, CASE WHEN filing = 'single' THEN 50000 ELSE 100000 END AS cut, CASE WHEN filing = 'single' THEN 0 ELSE 50 END AS cr FROM pl p CROSS JOIN hh h JOIN region ON r_regionkey = state),
  ti AS (SELECT *, greatest(0, inc - ded) AS txb FROM tx),
  tt AS (SELECT place, search, CASE WHEN rk = 4 OR sales IS NULL OR (tenure IS DISTINCT FROM 'rent' AND (home IS NULL OR rate IS NULL)) THEN NULL ELSE CASE WHEN tenure = 'rent' THEN 0 ELSE rate / 100 * coalesce(buyer, 1) * home END
     + CASE WHEN rk = 0 THEN 0 ELSE greatest(0, 0.02 * least(txb, cut) + (0.03 + rk * 0.01) * greatest(0, txb - cut) - cr) END + sales / 100 * 0.25 * inc END AS taxes FROM ti)"""


@shared
def taxed_places(t):
    k = F.col("place")
    return base.places(t).select(
        k, "county", "state", (1.0 + k % 20 / 10.0).alias("rate"), F.when(k % 3 != 0, 1 + k % 10 / 20.0).alias("buyer"),
        F.when(k % 4 != 0, F.col("spend")).alias("today"), "spend", F.when((F.col("state") != 3) | (k % 2 == 0), 5.0 + F.col("state")).alias("sales"))


def schedules(t):
    rk = F.col("r_regionkey")
    step = (3 + rk).cast("string")
    full = F.concat(F.lit("s:0.02@0,0.0"), step, F.lit("@50000;m:0.02@0,0.0"), step, F.lit("@100000;sd:3000,8500;ex:1500,3000;cr:0,50"))
    return t.region.select(rk.cast("long").alias("state"), F.when(rk == 0, "none").when(rk != 4, full).alias("schedule"))


def households(t):
    return t.rows(HOUSEHOLDS, "search string, tenure string, budget double, income double, filing string")


@query("F19 F20", with_(*base.PLACE_SQL, HH, TAXED, select=f"SELECT place, search, {rs('taxes', 8)} AS taxes FROM tt"))
def household_taxes(t):
    out = taxes.with_taxes(taxed_places(t), schedules(t), "state", households(t), "rate", "buyer", "today", "spend", "sales")
    return out.select("place", "search", r("taxes", 8).alias("taxes"))


@query("F21", """SELECT c_custkey AS search, 'taxes' AS metric, 'area' AS level, least(5, c_custkey % 7 - 1)::DOUBLE AS weight, 'lower' AS direction FROM customer WHERE c_custkey % 7 > 1
  UNION ALL SELECT c_custkey, 'balance', 'county', 2.0, 'higher' FROM customer
  UNION ALL SELECT c_custkey, 'limit:' || CASE WHEN c_custkey % 2 = 0 THEN 'taxes_rate' ELSE 'balance' END, CASE WHEN c_custkey % 2 = 0 THEN 'area' ELSE 'county' END, NULL, NULL FROM customer""")
def taxes_moved_to_areas(t):
    k = F.col("c_custkey")
    one = lambda metric, weight, direction: t.customer.select(
        k.alias("search"), F.lit(metric).alias("metric"), F.lit("county").alias("level"), weight.cast("double").alias("weight"), F.lit(direction).alias("direction"))
    asked = one("taxes", k % 7 - 1, "higher").unionByName(one("balance", F.lit(2), "higher"))
    must = t.customer.select(k.alias("search"), F.when(k % 2 == 0, "property_tax_effective_rate").otherwise("balance").alias("metric"), F.lit("county").alias("level"))
    c, limits = taxes.move_taxes_to_areas(asked, must)
    shown = limits.select("search", F.concat(F.lit("limit:"), F.col("metric")).alias("metric"), "level", F.lit(None).cast("double").alias("weight"), F.lit(None).cast("string").alias("direction"))
    return c.unionByName(shown)


@query("C5 F26", with_(*base.PLACE_SQL, "x AS (SELECT place, county, CASE WHEN place % 5 <> 0 THEN 1.0::DOUBLE + place % 20 / 10.0::DOUBLE END AS own, CASE WHEN place % 7 <> 0 THEN 1.2::DOUBLE + place % 10 / 10.0::DOUBLE END AS eb, place % 6 = 0 AS flagged FROM places)",
  "sp AS (SELECT county, CASE WHEN count(*) FILTER (WHERE own > 0 AND NOT flagged) >= 3 THEN min(own) FILTER (WHERE own > 0 AND NOT flagged) END AS lowest, CASE WHEN count(*) FILTER (WHERE own > 0 AND NOT flagged) >= 3 THEN max(own) FILTER (WHERE own > 0 AND NOT flagged) END AS highest FROM x GROUP BY 1)",
  select=f"""SELECT place, {rs('coalesce(own, 2.0)')} AS taxes_rate, CASE WHEN own IS NOT NULL THEN 'area' ELSE 'county' END AS rate_source,
   {rs("CASE WHEN county % 5 = 4 THEN NULL ELSE coalesce(CASE WHEN own IS NOT NULL AND eb IS NOT NULL THEN eb ELSE own END, 2.0) / 100 * 1.1 * 300000 + 0.06 * 0.25 * 78538 END")} AS taxes, lowest, highest FROM x JOIN sp USING (county)"""))
def area_taxes(t):
    k = F.col("place")
    x = base.places(t).select(k, "county", F.when(k % 5 != 0, 1.0 + k % 20 / 10.0).alias("own"), F.when(k % 7 != 0, 1.2 + k % 10 / 10.0).alias("eb"), (k % 6 == 0).alias("flagged"))
    counties = t.nation.select(F.col("n_nationkey").cast("long").alias("county"), (F.col("n_nationkey") % 5).alias("st"), F.lit(2.0).alias("rate"), F.lit(1.1).alias("buyer"),
                               F.lit(300000.0).alias("today"), F.lit(None).cast("double").alias("home"), F.lit(6.0).alias("sales"))
    sch = t.region.select(F.col("r_regionkey").alias("st"), F.when(F.col("r_regionkey") != 4, "none").alias("schedule"))
    hh = t.rows([("h", None, None, None, None)], "search string, tenure string, budget double, income double, filing string")
    out = taxes.with_area_taxes(x, "county", counties, sch, "st", hh, "own", "eb", "rate", "buyer", "today", "home", "sales")
    out = out.join(taxes.rate_spread(x, "county", "own", F.col("flagged")), "county")
    return out.select("place", r("taxes_rate").alias("taxes_rate"), "rate_source", r("taxes").alias("taxes"), "lowest", "highest")
