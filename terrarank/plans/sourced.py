"""Pages, tables and sourced facts: pages give list items and cells, customers stand for jurisdictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import facts, quality
from ..sources import html
from .registry import query, shared, with_

TODAY = "2026-01-01"

PAGE_TEXT = r"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"""
NORMAL = rf"""lower(trim(regexp_replace(translate(replace(replace({PAGE_TEXT}, '&nbsp;', ' '), '&amp;', '&'), '’‘“”–—', '''''""--'), '\s+', ' ', 'g')))"""


@query("A11", f"SELECT page_id, length({NORMAL}) AS chars, left(sha256({NORMAL}), 16) AS page_hash FROM pages")
def page_hashes(t):
    return t.pages.select("page_id", F.length(text.page_text("html")).cast("long").alias("chars"), text.page_hash("html").alias("page_hash"))


ITEMS = r"""it AS (SELECT page_id, generate_subscripts(x, 1) - 1 AS position, unnest(x) AS raw FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1) AS x FROM pages)),
  li AS (SELECT page_id, position, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(raw, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS item FROM it)"""


@shared
def items(t):
    return t.pages.select("page_id", F.posexplode(html.list_items("html")).alias("position", "item"))


@query("A10 G10", with_(ITEMS, select="SELECT page_id, position, item FROM li"))
def page_list_items(t):
    return items(t).select("page_id", F.col("position").cast("long"), "item")


@query("A10", with_(ITEMS, r"c AS (SELECT page_id, position, trim(regexp_replace(regexp_replace(item, '[^A-Za-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS cell FROM li)",
  "o AS (SELECT *, count(*) FILTER (WHERE position % 3 = 1) OVER (PARTITION BY page_id) AS inner_n, row_number() OVER (PARTITION BY page_id, position % 3 = 1 ORDER BY position) - 1 AS nth FROM c)",
  select="""SELECT page_id, inner_n AS table_no, position AS row_no,
      position || '|' || CASE WHEN position % 3 = 1 THEN trim('in ' || trim(cell || ' &') || ' out') ELSE trim(cell || ' end') END AS cells FROM o
    UNION ALL SELECT page_id, nth, 0, trim(cell || ' &') FROM o WHERE position % 3 = 1"""))
def page_table_cells(t):
    """One table per page; a third of its rows hold a table of their own, and one more table is never closed."""
    cell = F.trim(F.regexp_replace(F.regexp_replace("item", "[^A-Za-z0-9 ]", ""), " +", " "))
    plain = F.concat(F.lit("<td class=x> "), cell, F.lit("<br>end</td></tr>"))
    nested = F.concat(F.lit("<TH>in <table><!-- <tr> --><tr><td>"), cell, F.lit(" &amp;</table>out"))
    rows = F.concat(F.lit("<tr><td>"), F.col("position").cast("string"), F.when(F.col("position") % 3 == 1, nested).otherwise(plain))
    pages = items(t).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", rows.alias("h")))), lambda x: x["h"]), "").alias("h"))
    pages = pages.select("page_id", F.concat(F.lit("<p>x<table>"), F.col("h"), F.lit("</table><table><tr><td>never closed")).alias("h"))
    out = html.table_rows(pages, "page_id", "h")
    return out.select("page_id", F.col("table_no").cast("long"), F.col("row_no").cast("long"), F.array_join("cells", "|").alias("cells"))


@query("B31", """SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'CA' WHEN 1 THEN 'UT' WHEN 2 THEN 'KS' WHEN 6 THEN 'WV' END AS code,
  CASE c_custkey % 8 WHEN 0 THEN 'CA' WHEN 1 THEN 'UT' WHEN 2 THEN 'KS' WHEN 3 THEN 'WV' WHEN 4 THEN 'VA' WHEN 6 THEN 'WV' END AS leading FROM customer""")
def state_labels_to_codes(t):
    k = F.col("c_custkey") % 8
    label = F.element_at(F.array(*[F.lit(s) for s in ("Calif. (a)", "Utah [115]", "Kansas*", "West Virginia medical program", "Virginia: see note", "Virginians", "W. Va.†", "Nowhere")]), k.cast("int") + 1)
    names = facts.state_labels(t.spark)
    rows = facts.state_codes(t.customer.select("c_custkey", label.alias("label")), "label", names)
    return facts.state_codes(rows, "label", names, "leading", leading=True).drop("label")


@query("E13 A9", """WITH x AS (SELECT user_id AS sheet, event_id AS row_no, event_type, CASE WHEN event_id % 5 = 0 THEN event_type END AS label FROM events),
  h AS (SELECT sheet, min(row_no) AS head FROM x WHERE event_type = 'signup' GROUP BY 1)
  SELECT sheet, row_no, last_value(label IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM x JOIN h USING (sheet) WHERE row_no > head""")
def labels_filled_down(t):
    x = t.events.select(F.col("user_id").alias("sheet"), F.col("event_id").alias("row_no"), "event_type", F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("label"))
    below = facts.rows_below_header(x, ["sheet"], "row_no", F.col("event_type") == "signup")
    return facts.fill_labels(below, ["sheet"], "row_no", "label", "block").select("sheet", "row_no", "block")


@query("G10", """WITH c AS (SELECT c_custkey AS k, 6 + c_custkey % 9 AS w, c_custkey % 4 AS m FROM customer)
  SELECT k, greatest(7.25, CASE WHEN m = 1 AND w + 3 > greatest(w, 7.25) THEN w + 3 ELSE w END)::DOUBLE AS wage, CASE k % 5 WHEN 0 THEN 'banned' WHEN 1 THEN 'protected' WHEN 2 THEN CASE WHEN k % 20 <= 12 THEN 'restricted' ELSE 'limited' END WHEN 3 THEN 'limited' END AS abortion,
   CASE k % 6 WHEN 0 THEN 'exempt' WHEN 1 THEN 'taxed' WHEN 2 THEN 'reduced' WHEN 3 THEN 'taxed' WHEN 4 THEN 'exempt' END AS grocery, CASE WHEN k % 2 = 0 THEN CASE WHEN k % 3 = 0 THEN 'recreational' ELSE 'medical' END WHEN k % 7 = 0 THEN 'cbd_only' ELSE 'illegal' END AS cannabis,
   CASE WHEN k % 10 = 0 THEN 'none' WHEN k % 10 < 4 THEN 'flat' ELSE 'graduated' END AS structure FROM c""")
def law_values_from_cells(t):
    k = F.col("c_custkey")
    w, m = 6 + k % 9, k % 4
    cell = F.concat(F.lit("$"), w.cast("string"), F.lit(".00/$"), (w + 2).cast("string"), F.lit(".50"))
    step = F.when(m == 1, "9-30-25").when(m == 2, "9-30-27").otherwise("1-1-20")
    future = F.concat(F.lit("Was low. $"), (w + 3).cast("string"), F.lit(" eff. "), step, F.lit("; more later"))
    wage = facts.effective_wage(cell, future, F.to_date(F.lit("2025-06-01")), F.to_date(F.lit(TODAY)))
    status = F.when(k % 5 == 0, "Abortion banned").when(k % 5 == 1, "Legal until viability").when(
        k % 5 == 2, F.concat(F.lit("Limit at "), (k % 20).cast("string"), F.lit(" weeks"))).when(k % 5 == 3, "Limit between 12 and 22 weeks").otherwise("unclear")
    food = F.when(k % 6 == 0, "Exempt").when(k % 6 == 1, "Included in base").when(k % 6 == 2, "0.01").when(k % 6 == 3, "0.07").when(k % 6 == 4, "--").otherwise("odd")
    cannabis = facts.cannabis_class(k % 2 == 0, F.when(k % 3 == 0, "Yes. Measure 1").otherwise("No."), k % 7 == 0)
    rates = F.when(k % 10 < 4, F.array(F.lit(0.03), F.lit(0.03))).otherwise(F.array(F.lit(0.03), F.lit(0.05)))
    rows = t.customer.select(k.alias("k"), wage.alias("wage"), facts.abortion_class(status).alias("abortion"), facts.grocery_class(F.lit(0.05), food).alias("grocery"),
                             cannabis.alias("cannabis"), rates.alias("r"), (k % 10 == 0).alias("none"))
    return rows.select("k", "wage", "abortion", "grocery", "cannabis", facts.rate_structure("r", "none").alias("structure"))


@query("G10 F19", """SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'none' ELSE 's:0.02@0,0.045@' || (500 + c_custkey) || ';m:' || CASE WHEN c_custkey % 2 = 0 THEN '0.02@0,0.045@' || (500 + c_custkey) ELSE '0.03@0' END || ';sd:3000,8500;ex:0,3000.5;cr:0,0' END AS schedule FROM customer""")
def encoded_schedules(t):
    k = F.col("c_custkey")
    b = lambda rate, over: F.struct(over.cast("double").alias("over"), F.lit(rate).alias("rate"))
    single = F.array(b(0.02, F.lit(0)), b(0.045, 500 + k))
    joint = F.when(k % 2 == 0, F.array().cast("array<struct<over:double,rate:double>>")).otherwise(F.array(b(0.03, F.lit(0))))
    two = lambda a, c: F.array(F.lit(a), F.lit(c))
    return t.customer.select(k, facts.encode_schedule(single, joint, two(3000.0, 8500.0), two(0.0, 3000.5), two(0.0, 0.0), k % 6 == 0).alias("schedule"))


@query("G8", """WITH b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN n_chars > 700 THEN 1 ELSE 0 END AS q FROM documents WHERE doc_id % 11 <> 0)
  SELECT l.doc_id, CASE WHEN q IS NULL OR q = quality THEN quality END::BIGINT AS quality, CASE WHEN q IS NULL THEN 'medium' WHEN q = quality THEN 'high' ELSE 'unverified' END AS confidence,
   CASE WHEN q IS NOT NULL AND q <> quality THEN 'sources disagree: ' || quality || ' / ' || q WHEN b.doc_id IS NULL THEN 'not in the second source' WHEN q IS NULL THEN 'second source unclear' END AS note FROM labels l LEFT JOIN b USING (doc_id)""")
def source_agreement(t):
    k = F.col("doc_id")
    b = t.documents.filter(k % 11 != 0).select(k, F.when(k % 7 != 0, F.when(F.col("n_chars") > 700, 1).otherwise(0)).alias("quality"))
    return facts.cross_check(t.labels, b, ["doc_id"], "quality").withColumn("quality", F.col("quality").cast("long"))


@query("G8", """SELECT d.doc_id, CASE WHEN (l.doc_id IS NOT NULL AND l.toxic = 1) = (d.n_chars % 3 = 0) THEN CASE WHEN d.n_chars % 3 = 0 THEN 'true' ELSE 'false' END END AS value,
  CASE WHEN (l.doc_id IS NOT NULL AND l.toxic = 1) <> (d.n_chars % 3 = 0) THEN 'lists disagree' END AS note FROM documents d LEFT JOIN labels l USING (doc_id)""")
def list_agreement(t):
    a, b = t.labels.filter("toxic = 1").select("doc_id"), t.documents.filter("n_chars % 3 = 0").select("doc_id")
    return facts.list_agreement(t.documents, a, b, "doc_id")


EDITIONS = """e AS (SELECT o_custkey AS k, o_orderdate::DATE AS d, max(o_orderpriority) AS v FROM orders GROUP BY ALL), n AS (SELECT k, arg_max(v, d) AS v, max(d) AS d FROM e GROUP BY 1)"""


def _editions(t):
    e = t.orders.groupBy(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d")).agg(F.max("o_orderpriority").alias("v"))
    return facts.newest_edition(e, ["k"], "v", "d")


@query("G9", with_(EDITIONS, select="SELECT k, v, d::VARCHAR AS d FROM n"))
def newest_editions(t):
    return _editions(t)[0].select("k", "v", F.col("d").cast("string"))


@query("G9", with_(EDITIONS, select="SELECT e.k, e.v, e.d::VARCHAR AS d, e.d || ' listed ' || e.v AS note FROM e JOIN n ON n.k = e.k WHERE e.d < n.d AND e.v <> n.v"))
def older_editions_that_differ(t):
    return _editions(t)[1].select("k", "v", F.col("d").cast("string"), "note")


FACTS = """fv AS (SELECT law, c_custkey AS k, c_name AS state,
   CASE law WHEN 'wage' THEN CASE WHEN c_custkey % 9 = 0 THEN '' ELSE (7 + c_custkey % 10) || '.50' END WHEN 'status' THEN CASE c_custkey % 5 WHEN 0 THEN 'legal' WHEN 1 THEN 'banned' WHEN 2 THEN 'odd' ELSE '' END ELSE 'x' END AS value,
   CASE WHEN law = 'wage' AND c_custkey % 4 <> 0 THEN (7 + c_custkey % 10) || '.50' ELSE '' END AS value_numeric,
   CASE WHEN c_custkey % 13 = 0 THEN 'enjoined' WHEN c_custkey % 17 = 0 THEN 'scheduled' WHEN c_custkey % 29 = 0 THEN 'weird' ELSE 'in_effect' END AS status, CASE WHEN c_custkey % 31 = 0 THEN 'sure' ELSE 'high' END AS confidence,
   CASE WHEN c_custkey % 37 = 0 THEN '' ELSE (DATE '2023-06-01' + (c_custkey % 900)::INT)::VARCHAR END AS as_of, CASE WHEN c_custkey % 2 = 0 THEN '2025-06-01' ELSE '2026-06-01' END AS effective_date,
   CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'Source ' || c_custkey % 3 END AS source_name, CASE WHEN c_custkey % 23 = 0 THEN 'ftp://x' WHEN c_custkey % 3 = 0 THEN 'https://x.org/2024-rates' ELSE 'https://x.org/2026-rates' END AS source_url,
   CASE WHEN c_custkey % 41 = 0 THEN 'soon' ELSE strftime(DATE '2023-06-01' + (c_custkey % 700)::INT, '%Y/%m/%d') END AS source_date, CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'short' ELSE 'a quote that is long enough' END AS source_quote,
   CASE WHEN c_custkey % 2 = 0 THEN 'Court order' ELSE '' END AS notes, CASE WHEN c_custkey % 5 <> 0 THEN 'refresh' ELSE 'person' END AS reviewed_by
   FROM customer, (VALUES ('wage'), ('status'), ('other')) l(law)),
  df AS (SELECT * FROM (VALUES ('wage', 'numeric', '', '', 'annual', 'B1'), ('status', 'nominal', 'legal|banned', '', 'session', 'B2')) v(law, type, allowed, ord, cadence, tier))"""


@shared
def fact_rows(t):
    k = F.col("c_custkey")
    wage = F.concat((7 + k % 10).cast("string"), F.lit(".50"))
    law = F.col("law")
    rows = t.customer.select(k, F.col("c_name").alias("state"), F.explode(F.array(F.lit("wage"), F.lit("status"), F.lit("other"))).alias("law"))
    status_word = F.when(k % 5 == 0, "legal").when(k % 5 == 1, "banned").when(k % 5 == 2, "odd").otherwise("")
    day = lambda n: F.date_add(F.to_date(F.lit("2023-06-01")), (k % n).cast("int"))
    return rows.select(
        "law", k.alias("k"), "state", F.when(law == "wage", F.when(k % 9 == 0, "").otherwise(wage)).when(law == "status", status_word).otherwise("x").alias("value"),
        F.when((law == "wage") & (k % 4 != 0), wage).otherwise("").alias("value_numeric"),
        F.when(k % 13 == 0, "enjoined").when(k % 17 == 0, "scheduled").when(k % 29 == 0, "weird").otherwise("in_effect").alias("status"),
        F.when(k % 31 == 0, "sure").otherwise("high").alias("confidence"), F.when(k % 37 == 0, "").otherwise(day(900).cast("string")).alias("as_of"),
        F.when(k % 2 == 0, "2025-06-01").otherwise("2026-06-01").alias("effective_date"),
        F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("Source "), (k % 3).cast("string"))).alias("source_name"),
        F.when(k % 23 == 0, "ftp://x").when(k % 3 == 0, "https://x.org/2024-rates").otherwise("https://x.org/2026-rates").alias("source_url"),
        F.when(k % 41 == 0, "soon").otherwise(F.date_format(day(700), "yyyy/MM/dd")).alias("source_date"),
        F.when(k % 6 == 0, "").when(k % 6 == 1, "short").otherwise("a quote that is long enough").alias("source_quote"),
        F.when(k % 2 == 0, "Court order").otherwise("").alias("notes"), F.when(k % 5 != 0, "refresh").otherwise("person").alias("reviewed_by"))


def definitions(t):
    return t.rows([("wage", "numeric", "", "", "annual", "B1"), ("status", "nominal", "legal|banned", "", "session", "B2")],
                  "law string, type string, allowed string, order string, cadence string, tier string")


def today():
    return F.to_date(F.lit(TODAY))


@query("H11", with_(FACTS, select="""SELECT 'BLOCK' AS severity, 'schema' AS "check", law || '/' || state AS key, m AS message FROM (
  SELECT law, state, unnest(list_filter([CASE WHEN type IS NULL THEN 'law is not declared' END, CASE WHEN type IS NOT NULL AND status = 'weird' THEN 'status is not valid' END, CASE WHEN type IS NOT NULL AND confidence = 'sure' THEN 'confidence is not valid' END,
   CASE WHEN law = 'status' AND value = 'odd' THEN 'value is not in the allowed set' END, CASE WHEN law = 'wage' AND value <> '' AND value_numeric = '' THEN 'numeric law has no number' END], lambda x: x IS NOT NULL)) AS m FROM fv LEFT JOIN df USING (law))"""))
def fact_schema_findings(t):
    return quality.fact_schema(fact_rows(t), definitions(t))


@query("H11", with_(FACTS, select="""SELECT 'WARN' AS severity, 'coverage' AS "check", law AS key, 'partially filled: ' || count(*) FILTER (WHERE value <> '') || '/' || count(*) AS message FROM fv WHERE law <> 'other' GROUP BY law
  UNION ALL SELECT 'BLOCK', 'coverage', 'wage', count(*) || ' jurisdictions absent' FROM customer WHERE c_custkey % 50 = 7"""))
def fact_coverage_findings(t):
    from ..operators.quality import union

    whole = quality.fact_coverage(fact_rows(t), definitions(t), t.customer.select(F.col("c_name").alias("state")))
    some = fact_rows(t).filter("law = 'wage' AND k % 50 <> 7")
    absent = quality.fact_coverage(some, definitions(t).filter("law = 'wage'"), t.customer.select(F.col("c_name").alias("state")))
    return union([whole, absent.filter("severity = 'BLOCK'")])


@query("H11 H12", with_(FACTS, f"a AS (SELECT fv.*, cadence, DATE '{TODAY}' - try_cast(NULLIF(as_of, '') AS DATE) AS age FROM fv JOIN df USING (law) WHERE value <> '')", select="""SELECT severity, 'staleness' AS "check", key, message FROM (
  SELECT CASE WHEN age IS NULL OR age > 730 THEN 'BLOCK' ELSE 'WARN' END AS severity, law || '/' || state AS key, CASE WHEN age IS NULL THEN 'no as-of date' WHEN age > 730 THEN 'unreviewed for ' || age || ' days'
     WHEN age > CASE cadence WHEN 'annual' THEN 400 ELSE 210 END THEN 'unreviewed for ' || age || ' days, limit ' || CASE cadence WHEN 'annual' THEN 400 ELSE 210 END END AS message FROM a
  UNION ALL SELECT 'BLOCK', law || '/' || state, 'scheduled change is in effect' FROM a WHERE status = 'scheduled' AND k % 2 = 0 AND age IS NOT NULL) WHERE message IS NOT NULL"""))
def fact_age_findings(t):
    return quality.fact_age(fact_rows(t), definitions(t), today())


@query("H11", with_(FACTS, select="""SELECT CASE WHEN m LIKE 'no source%' OR m LIKE 'source a%' THEN 'BLOCK' ELSE 'WARN' END AS severity, 'provenance' AS "check", law || '/' || state AS key, m AS message FROM (
  SELECT law, state, unnest(list_filter([CASE WHEN source_name = '' THEN 'no source name' END, CASE WHEN source_date = 'soon' THEN 'no source date' END, CASE WHEN source_url = 'ftp://x' THEN 'source address is not an address' END,
   CASE WHEN source_quote = '' THEN 'no quote' WHEN source_quote = 'short' THEN 'quote too short' END, CASE WHEN status = 'enjoined' AND notes = '' THEN 'no court action noted' END], lambda x: x IS NOT NULL)) AS m FROM fv JOIN df USING (law) WHERE value <> '')"""))
def fact_provenance_findings(t):
    return quality.fact_provenance(fact_rows(t), definitions(t))


@query("H11", with_(FACTS, select="""SELECT 'WARN' AS severity, 'edition' AS "check", law AS key, 'source dated ' || min(strptime(source_date, '%Y/%m/%d')::DATE) AS message FROM fv WHERE source_date <> 'soon' AND DATE '2026-01-01' - strptime(source_date, '%Y/%m/%d')::DATE > 730 GROUP BY law
  UNION ALL SELECT 'WARN', 'edition', 'wage', 'cites the 2024 edition'"""))
def fact_edition_findings(t):
    return quality.fact_editions(fact_rows(t).withColumn("source_date", F.when(F.col("source_date") != "soon", F.col("source_date"))), definitions(t), today())


@query("A17", with_(FACTS, select="""SELECT law, state, gap FROM (SELECT law, state, false AS gap FROM fv JOIN df USING (law) WHERE value <> '' AND as_of <> '' AND DATE '2026-01-01' - try_cast(NULLIF(as_of, '') AS DATE) <= 730
  UNION ALL SELECT law, state, true FROM fv WHERE value = '' AND reviewed_by = 'refresh' AND notes <> '' AND as_of <> '')"""))
def publishable_facts(t):
    return facts.publishable(fact_rows(t), definitions(t), today()).select("law", "state", "gap")


@query("A17 A6", with_(FACTS, select="""SELECT state, count(*) AS laws, max(CASE WHEN law = 'wage' THEN value END) AS wage FROM fv JOIN df USING (law) WHERE value <> '' AND as_of <> '' AND DATE '2026-01-01' - try_cast(NULLIF(as_of, '') AS DATE) <= 730 GROUP BY 1"""))
def facts_nested_by_state(t):
    good = facts.publishable(fact_rows(t), definitions(t), today()).filter("NOT gap")
    n = facts.nest_by_state(good, ["value", "status", "as_of"])
    return n.select("state", F.size("laws").cast("long").alias("laws"), F.try_element_at("laws", F.lit("wage"))["value"].alias("wage"))


@query("D40", with_(FACTS, """c AS (SELECT law, source_name, source_url, count(*) AS n FROM fv WHERE value <> '' GROUP BY ALL)""",
  select="""SELECT law, source_name, source_url, (SELECT max(as_of) FROM fv WHERE fv.law = b.law AND value <> '') AS checked FROM (SELECT *, row_number() OVER (PARTITION BY law ORDER BY n DESC, source_name, source_url) AS k FROM c) b WHERE k = 1"""))
def most_cited_sources(t):
    rows = fact_rows(t).filter("value <> ''").withColumn("source_date", F.lit("2025-01-01"))
    return facts.most_cited_source(rows).select("law", "source_name", "source_url", "checked")


@query("H12", with_(FACTS, select="SELECT law, state, DATE '2026-01-01' - try_cast(NULLIF(as_of, '') AS DATE) > CASE law WHEN 'wage' THEN 400 ELSE 210 END AS stale FROM fv JOIN df USING (law) WHERE as_of <> ''"))
def stale_facts(t):
    j = fact_rows(t).filter("as_of <> ''").join(F.broadcast(definitions(t).select("law", "cadence")), "law")
    return j.select("law", "state", facts.is_stale("cadence", F.to_date("as_of"), today()).alias("stale"))


UPSERT = """old AS (SELECT 'wage' AS law, c_name AS state, (7 + c_custkey % 10) || '.50' AS value FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'wage', '*', 'x' UNION ALL SELECT 'keep', c_name, 'y' FROM customer WHERE c_custkey % 10 = 0),
  fresh AS (SELECT c_name AS state, CASE WHEN c_custkey % 4 = 0 THEN (8 + c_custkey % 10) || '.5' ELSE (7 + c_custkey % 10) || '.5' END AS value FROM customer WHERE c_custkey % 5 <> 0),
  new AS (SELECT c_name AS state, coalesce(value, '') AS value, value IS NULL AS blank FROM customer LEFT JOIN fresh ON state = c_name)"""


def _upsert(t):
    k = F.col("c_custkey")
    old = t.customer.filter(k % 3 != 0).select(F.lit("wage").alias("law"), F.col("c_name").alias("state"), F.concat((7 + k % 10).cast("string"), F.lit(".50")).alias("value"))
    old = old.unionByName(t.rows([("wage", "*", "x")], "law string, state string, value string"))
    old = old.unionByName(t.customer.filter(k % 10 == 0).select(F.lit("keep").alias("law"), F.col("c_name").alias("state"), F.lit("y").alias("value")))
    old = old.withColumns({"status": F.lit("in_effect"), "notes": F.lit("")})
    fresh = t.customer.filter(k % 5 != 0).select(F.col("c_name").alias("state"), F.concat((F.when(k % 4 == 0, 8).otherwise(7) + k % 10).cast("string"), F.lit(".5")).alias("value"))
    return facts.upsert(old, t.customer.select(F.col("c_name").alias("state")), fresh, "wage")


@query("G6", with_(UPSERT, select="""SELECT law, state, value, 'in_effect' AS status, '' AS notes FROM old WHERE law = 'keep' UNION ALL SELECT 'wage', state, value, CASE WHEN blank THEN 'unknown' ELSE 'in_effect' END, CASE WHEN blank THEN 'Not found in the source this run.' ELSE '' END FROM new"""))
def upserted_facts(t):
    return _upsert(t)[0]


@query("G6", with_(UPSERT, select="""SELECT 'wage' AS law, n.state, coalesce(o.value, '') AS "before", n.value AS "after" FROM new n LEFT JOIN old o ON o.law = 'wage' AND o.state = n.state
  WHERE NOT (coalesce(try_cast(NULLIF(coalesce(o.value, ''), '') AS DOUBLE) = try_cast(NULLIF(n.value, '') AS DOUBLE), false) OR coalesce(o.value, '') = n.value)"""))
def fact_change_log(t):
    return _upsert(t)[1]
