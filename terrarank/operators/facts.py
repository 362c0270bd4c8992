"""Sourced facts: (law, state) → value with where it came from; parsed, cross-checked, upserted, published,
and checked for age.

A fact table is states × laws; everything here still runs as joins and aggregations on its keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_date
from ..functions.values import col
from ..session import DEFAULT_LIMITS, Limits, rows_table
from . import rank

# Review cadences in days, hard expiry, the oldest a source may be, the federal wage floor.
CADENCE_DAYS = {"monthly": 45, "quarterly": 120, "session": 210, "annual": 400, "computed": 10_000}
DEFAULT_CADENCE = 400
HARD_EXPIRY_DAYS = 730
SOURCE_MAX_AGE_DAYS = 730
FEDERAL_MINIMUM = 7.25
STATUSES = ["in_effect", "enjoined", "scheduled", "unknown", "computed"]
CONFIDENCES = ["high", "medium", "low", "unverified", "computed", "example"]

# States by code, name and press abbreviation.
STATES = [
    ("AL", "Alabama", ["Ala."]),
    ("AK", "Alaska", []),
    ("AZ", "Arizona", ["Ariz."]),
    ("AR", "Arkansas", ["Ark."]),
    ("CA", "California", ["Calif."]),
    ("CO", "Colorado", ["Colo."]),
    ("CT", "Connecticut", ["Conn."]),
    ("DE", "Delaware", ["Del."]),
    ("DC", "District of Columbia", ["D.C."]),
    ("FL", "Florida", ["Fla."]),
    ("GA", "Georgia", ["Ga."]),
    ("HI", "Hawaii", []),
    ("ID", "Idaho", []),
    ("IL", "Illinois", ["Ill."]),
    ("IN", "Indiana", ["Ind."]),
    ("IA", "Iowa", []),
    ("KS", "Kansas", ["Kans.", "Kan."]),
    ("KY", "Kentucky", ["Ky."]),
    ("LA", "Louisiana", ["La."]),
    ("ME", "Maine", []),
    ("MD", "Maryland", ["Md."]),
    ("MA", "Massachusetts", ["Mass."]),
    ("MI", "Michigan", ["Mich."]),
    ("MN", "Minnesota", ["Minn."]),
    ("MS", "Mississippi", ["Miss."]),
    ("MO", "Missouri", ["Mo."]),
    ("MT", "Montana", ["Mont."]),
    ("NE", "Nebraska", ["Nebr.", "Neb."]),
    ("NV", "Nevada", ["Nev."]),
    ("NH", "New Hampshire", ["N.H."]),
    ("NJ", "New Jersey", ["N.J."]),
    ("NM", "New Mexico", ["N.M."]),
    ("NY", "New York", ["N.Y."]),
    ("NC", "North Carolina", ["N.C."]),
    ("ND", "North Dakota", ["N.D."]),
    ("OH", "Ohio", []),
    ("OK", "Oklahoma", ["Okla."]),
    ("OR", "Oregon", ["Ore.", "Oreg."]),
    ("PA", "Pennsylvania", ["Pa."]),
    ("RI", "Rhode Island", ["R.I."]),
    ("SC", "South Carolina", ["S.C."]),
    ("SD", "South Dakota", ["S.D."]),
    ("TN", "Tennessee", ["Tenn."]),
    ("TX", "Texas", ["Tex."]),
    ("UT", "Utah", []),
    ("VT", "Vermont", ["Vt."]),
    ("VA", "Virginia", ["Va."]),
    ("WA", "Washington", ["Wash."]),
    ("WV", "West Virginia", ["W.Va.", "W. Va."]),
    ("WI", "Wisconsin", ["Wis."]),
    ("WY", "Wyoming", ["Wyo."]),
]
CAPITAL = ["washington, d.c.", "washington dc", "d.c.", "dc"]   # further labels of DC


def state_labels(spark) -> DataFrame:
    """(label, code): full names lower case, abbreviations as printed."""
    labels = [(label, code) for code, name, short in STATES for label in (name.lower(), *short)]
    return rows_table(spark, labels + [(label, "DC") for label in CAPITAL], "label string, code string")


def label_text(c: Column | str) -> Column:
    """A label without footnote marks."""
    s = F.regexp_replace(col(c), r"\(.*?\)|\[.*?\]", "")
    s = F.regexp_replace(F.trim(s), r"[*†‡\d]+$", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def state_codes(rows: DataFrame, label: str, labels: DataFrame, out: str = "code", leading: bool = False) -> DataFrame:
    """The code of the state a label names, NULL if it names none. ``leading`` also takes a name followed by
    other words.

    Every run of a label's leading words is looked up, the longest first; without ``leading`` only the whole label is. A
    label stands for itself and for its lower case.
    """
    known = F.map_from_entries(F.collect_list(F.struct("label", "code"))).alias("_known")
    table = labels.groupBy("label").agg(F.min("code").alias("code")).agg(known)
    words = F.split(label_text(label), " ")
    whole = F.array(label_text(label))
    starts = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)),
                         lambda n: F.regexp_replace(F.array_join(F.slice(words, 1, n), " "), r"[^A-Za-z.]+$", ""))
    tries = F.array_union(whole, starts) if leading else whole
    code = lambda text: F.coalesce(F.try_element_at("_known", text), F.try_element_at("_known", F.lower(text)))
    found = F.get(F.array_compact(F.transform(tries, code)), 0)
    return rows.join(F.broadcast(table), F.lit(True)).withColumn(out, found).select(*rows.columns, out)   # one row


# --- values out of table cells -----------------------------------------------


def fill_labels(rows: DataFrame, sheet: Sequence[str], row_no: str, label: str, out: str, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """A block's label carried down to its rows.

    Labels seen so far number the blocks (a running total, so a sheet may be any size); each row then takes
    its block's label.
    """
    marked = rows.withColumn("_has", F.when(F.col(label).isNotNull(), 1).otherwise(0))
    seen = rank.running_totals(marked, sheet, row_no, ["_has"], limits).withColumn("_block", F.col("_has_before") + F.col("_has"))
    heads = seen.filter(F.col("_has") == 1).select(*sheet, "_block", F.col(label).alias(out))
    return seen.join(heads, [*sheet, "_block"], "left").select(*rows.columns, out)


def rows_below_header(rows: DataFrame, sheet: Sequence[str], row_no: str, marker: Column) -> DataFrame:
    """Rows below the first row that holds the header marker."""
    heads = rows.filter(marker).groupBy(*sheet).agg(F.min(row_no).alias("_head"))
    return rows.join(heads, list(sheet)).filter(F.col(row_no) > F.col("_head")).drop("_head")


def rate_structure(rates: str, none: str) -> Column:
    """``none``, ``flat`` or ``graduated`` from a list of marginal rates."""
    r = F.array_distinct(rates)
    return F.when(F.col(none) | (F.size(rates) == 0), "none").when(F.size(r) == 1, "flat").otherwise("graduated")


def encode_schedule(single: Column, joint: Column, deduction: Column, exemption: Column, credit: Column, none: Column) -> Column:
    """Brackets as one compact value, read back by ``taxes.parse_schedule``."""
    num = lambda x: F.regexp_replace(x.cast("decimal(20,6)").cast("string"), r"\.?0+$", "")
    pairs = lambda a: F.array_join(F.transform(a, lambda b: F.concat(num(b["rate"]), F.lit("@"), F.when(
        b["over"] == 0, "0").otherwise(num(b["over"])))), ",")
    two = lambda a: F.array_join(F.transform(a, lambda x: F.when(x == 0, "0").otherwise(num(x))), ",")
    both = F.when(F.size(joint) > 0, joint).otherwise(single)
    text = F.concat(F.lit("s:"), pairs(single), F.lit(";m:"), pairs(both), F.lit(";sd:"), two(deduction), F.lit(";ex:"), two(exemption),
                    F.lit(";cr:"), two(credit))
    return F.when(none | (F.size(single) == 0), "none").otherwise(text)


def dollars(c: Column | str) -> Column:
    """Every dollar amount in a cell."""
    found = F.regexp_extract_all(F.replace(col(c), F.lit(","), F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    return F.transform(found, lambda x: x.cast("double"))


def effective_wage(cell: Column | str, future: Column | str, updated: Column | str, today: Column | str) -> Column:
    """The wage floor that applies now: the lowest listed rate, never under the federal one, or a dated
    increase that has taken effect since the page was written."""
    floor = F.greatest(F.array_min(dollars(cell)), F.lit(FEDERAL_MINIMUM))
    steps = F.regexp_extract_all(col(future), F.lit(r"(\$\d+(?:\.\d+)?\s*eff\.?\s*\d{1,2}-\d{1,2}-\d{2,4})"), F.lit(1))
    read = F.transform(steps, lambda s: F.struct(
        F.try_to_timestamp(F.regexp_replace(F.regexp_extract(s, r"(\d{1,2}-\d{1,2}-\d{2,4})$", 1), r"-(\d{2})$", "-20$1"), F.lit("M-d-yyyy")).cast("date").alias("on"),
        F.regexp_extract(s, r"\$(\d+(?:\.\d+)?)", 1).cast("double").alias("amount")))
    done = F.filter(read, lambda s: (s["on"] <= col(today)) & (s["on"] > col(updated)))
    newest = F.array_max(done)["amount"]
    return F.when(F.coalesce(newest > floor, F.lit(False)), newest).otherwise(floor)


def grocery_class(state_rate: Column | str, treatment: Column | str) -> Column:
    t = F.lower(F.trim(F.coalesce(col(treatment), F.lit(""))))
    rate = t.try_cast("double")
    return (F.when(t.isin("--", "—", "n.a.", "none", "", "exempt"), "exempt").when(t.contains("included in base") | t.contains("full"), "taxed")
            .when(rate >= col(state_rate), "taxed").when(rate.isNotNull(), "reduced"))


def abortion_class(status: Column | str) -> Column:
    s = F.lower(col(status))
    weeks = F.coalesce(F.nullif(F.regexp_extract(s, r"between\s+\d+\s+and\s+(\d+)\s+weeks", 1), F.lit("")),
                       F.nullif(F.regexp_extract(s, r"(\d+)\s+weeks", 1), F.lit(""))).cast("int")
    return (F.when(s.contains("banned"), "banned").when(s.contains("viability") | s.contains("no gestational"), "protected")
            .when(weeks <= 12, "restricted").when(weeks.isNotNull(), "limited"))


def cannabis_class(in_medical: Column, adult: Column | str, in_low: Column) -> Column:
    a = F.trim(F.coalesce(col(adult), F.lit("")))
    is_adult = (a != "") & ~a.rlike(r"(?i)^no\b")
    return F.when(in_medical & is_adult, "recreational").when(in_medical, "medical").when(in_low, "cbd_only").otherwise("illegal")


# --- agreement and editions ----------------------------------------------------


def cross_check(first: DataFrame, second: DataFrame, keys: Sequence[str], value: str, tolerance: float | None = None) -> DataFrame:
    """Two sources side by side: equal is ``high`` confidence, unequal is blank with a note, missing or
    unclear in the second keeps the first."""
    a = first.select(*keys, F.col(value).alias("_a"))
    b = second.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_has"))
    j = a.join(b, list(keys), "left")
    same = (F.col("_a") == F.col("_b")) if tolerance is None else (F.abs(F.col("_a") - F.col("_b")) <= tolerance)
    clear = F.col("_b").isNotNull()
    return j.select(*keys, F.when(~clear | same, F.col("_a")).alias(value),
                    F.when(clear & same, "high").when(~clear, "medium").otherwise("unverified").alias("confidence"),
                    F.when(clear & ~same, F.concat(F.lit("sources disagree: "), F.col("_a").cast("string"), F.lit(" / "), F.col("_b").cast("string")))
                    .when(F.col("_has").isNull(), "not in the second source").when(~clear, "second source unclear").alias("note"))


def list_agreement(all_keys: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Two lists of members: in both is true, in neither is false, in one is blank with a note."""
    a, b = first.select(key).distinct().withColumn("_a", F.lit(True)), second.select(key).distinct().withColumn("_b", F.lit(True))
    j = all_keys.select(key).join(a, key, "left").join(b, key, "left")
    g, w = F.coalesce("_a", F.lit(False)), F.coalesce("_b", F.lit(False))
    return j.select(key, F.when(g == w, F.when(g, "true").otherwise("false")).alias("value"), F.when(g != w, "lists disagree").alias("note"))


def newest_edition(editions: DataFrame, keys: Sequence[str], value: str, as_of: str) -> tuple[DataFrame, DataFrame]:
    """The newest edition's value per key, and the older editions that list something else (for notes)."""
    newest = editions.groupBy(*keys).agg(F.max_by(value, as_of).alias("_v"), F.max(as_of).alias("_d"))
    differ = editions.join(newest, list(keys)).filter((F.col(as_of) < F.col("_d")) & (F.col(value) != F.col("_v"))).select(
        *keys, value, as_of, F.concat(F.col(as_of).cast("string"), F.lit(" listed "), F.col(value).cast("string")).alias("note"))
    return newest.select(*keys, F.col("_v").alias(value), F.col("_d").alias(as_of)), differ


# --- upsert and change log -------------------------------------------------------


def same_value(a: Column | str, b: Column | str) -> Column:
    """"5.00" and "5" are one value; blank equals blank."""
    x, y = F.coalesce(col(a), F.lit("")), F.coalesce(col(b), F.lit(""))
    return F.coalesce(x.try_cast("double") == y.try_cast("double"), F.lit(False)) | (x == y)


def upsert(rows: DataFrame, states: DataFrame, fresh: DataFrame, law: str, notes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Replace one law's rows with what a source said this run: (rows, changes).

    Every state gets a row: its fact, or a blank with the reason. Other laws' rows are untouched; a
    placeholder row (state ``*``) of this law goes. Only real changes are logged.
    """
    others = rows.filter(F.col("law") != law)
    why = F.lit("Not found in the source this run.")
    base = states.select("state").withColumn("law", F.lit(law)).join(fresh.select("state", F.col("value").alias("_v")), "state", "left")
    if notes is not None:
        base = base.join(notes.select("state", F.col("note").alias("_why")), "state", "left")
        why = F.coalesce("_why", why)
    new = base.select("law", "state", F.coalesce("_v", F.lit("")).alias("value"), F.when(F.col("_v").isNull(), "unknown").otherwise("in_effect").alias("status"),
                      F.when(F.col("_v").isNull(), why).otherwise("").alias("notes"))
    before = rows.filter(F.col("law") == law).select("state", F.col("value").alias("before"))
    changes = new.join(before, "state", "left").filter(~same_value("before", "value")).select(
        "law", "state", F.coalesce("before", F.lit("")).alias("before"), F.col("value").alias("after"))
    return others.select("law", "state", "value", "status", "notes").unionByName(new), changes


def publishable(values: DataFrame, definitions: DataFrame, today: Column, reviewer: str = "refresh") -> DataFrame:
    """Facts fit to show: with source, dates and a known law, and not past the hard expiry; a deliberate
    blank is kept with its reason."""
    blank = F.trim(F.coalesce("value", F.lit(""))) == ""
    as_of = parse_date("as_of")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    deliberate = blank & F.startswith(F.coalesce("reviewed_by", F.lit("")), F.lit(reviewer)) & filled("notes") & filled("as_of")
    good = ~blank & filled("source_url") & filled("source_date") & as_of.isNotNull() & (F.datediff(today, as_of) <= HARD_EXPIRY_DAYS)
    known = values.join(definitions.select("law"), "law", "left_semi")
    return known.filter(good).withColumn("gap", F.lit(False)).unionByName(values.filter(deliberate).withColumn("gap", F.lit(True)))


def nest_by_state(facts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per state: a map from law to its fact. As many entries as there are laws."""
    entry = F.struct(F.col("law"), F.struct(*fields))
    return facts.groupBy("state").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("laws"))


def most_cited_source(facts: DataFrame) -> DataFrame:
    """Per law: the source most states cite, and the latest check of any."""
    cited = facts.groupBy("law", "source_name", "source_url", "source_date").agg(F.count("*").alias("_n"), F.max("as_of").alias("_checked"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), "source_name", "source_url", "source_date"))
    return cited.groupBy("law").agg(best.alias("b"), F.max("_checked").alias("checked")).select(
        "law", "b.source_name", "b.source_url", "b.source_date", "checked")


def cadence_days(cadence: Column | str) -> Column:
    out = F.lit(DEFAULT_CADENCE)
    for name, days in CADENCE_DAYS.items():
        out = F.when(col(cadence) == name, days).otherwise(out)
    return out


def is_stale(cadence: Column | str, checked: Column, today: Column) -> Column:
    return F.datediff(today, checked) > cadence_days(cadence)
