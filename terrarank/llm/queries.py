"""One query per operator, over whole tables with production settings, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from . import alignment, binary, bpe, decontamination, embeddings, exact, jaccard, mixing, pii, quality, secrets, toxicity, whitening


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learnt from the labels of four folds of five."""
    docs, labels = _read(spark, folder, "documents"), _read(spark, folder, "labels")
    held = quality.held_out(F.col("doc_id"), 5, 0)
    model = quality.learn(docs, labels, ~held)
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of three folds of four."""
    docs, labels = _read(spark, folder, "documents"), _read(spark, folder, "labels")
    held = quality.held_out(F.col("doc_id"), 4, 2)
    model = toxicity.learn(docs, labels, ~held)
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The owner of every document's text."""
    return exact.decisions(_read(spark, folder, "documents"))


def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded."""
    import public_tokenizers as public

    return bpe.round_trip(_read(spark, folder, "documents"), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.scan(_read(spark, folder, "documents"))


def op6_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Class and links of every document at five words and a similarity of 0.8."""
    return jaccard.join(_read(spark, folder, "documents"))


def op7_binary(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids written to the binary format, and read back from it."""
    import public_tokenizers as public

    files = shared_folder(spark)
    binary.write(_read(spark, folder, "documents"), files, public.path("word_bpe_49k.json"), end_id=2)
    return binary.checksums(spark, files)


def op8_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.95."""
    return embeddings.near_duplicates(_read(spark, folder, "embeddings"))


def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    return pii.scan(_read(spark, folder, "documents")).drop("scores")


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words taken of every document when sources are mixed 5 : 2 : 1 and so on."""
    return mixing.taken(_read(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """The first 32 whitened components of every embedding."""
    return whitening.whiten(_read(spark, folder, "embeddings"))


def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that stand in a window of ten words of a test item."""
    found = decontamination.decisions(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of tokens of every document that a byte-level and a piece tokenizer cut alike."""
    import public_tokenizers as public

    return alignment.summary(_read(spark, folder, "documents"), public.path("byte_bpe_50k.json"), public.PATTERN, public.path("piece_bpe_32k.model"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans_sql(kinds: list[tuple[str, str]], base: int, passes: str) -> str:
    """Spans of each kind: matches are marked in the text, which is then cut at the marks; ``passes`` reads ``kind`` and ``hit``."""
    listed = ", ".join(f"({k}, {_literal(kind)}, {_literal('(' + pattern + ')')})" for k, (kind, pattern) in enumerate(kinds))
    counts = ", ".join(f"(count(*) FILTER (WHERE kind = '{kind}'))::BIGINT AS n_{kind}" for kind, _ in kinds[:base])
    return f"""
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
kinds AS (SELECT * FROM (VALUES {listed}) v(k, kind, pattern)),
parts AS (SELECT n, t, k, kind, pattern, string_split(regexp_replace(t, pattern, chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM texts, kinds),
part AS (SELECT n, t, k, kind, pattern, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM parts),
placed AS (SELECT *, split_part(x, chr(2), 1) AS hit, (sum(length(replace(x, chr(2), ''))) OVER (
    PARTITION BY n, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT AS a FROM part),
spans AS (SELECT n, k, kind, a, kind || ':' || a || ':' || (a + length(hit)) AS s FROM placed WHERE i > 1 AND ({passes})),
found AS (SELECT n, {counts}, sha256(coalesce(array_to_string(list(s ORDER BY a, k) FILTER (WHERE k < {base}), ','), '')) AS base_sha256,
    array_to_string(list(s ORDER BY a, k), ',') AS spans FROM spans GROUP BY n)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, _ in kinds[:base])}, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN found USING (n)"""


_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda j:
    substr({_DIGITS}, length({_DIGITS}) - j + 1, 1)::INT * (1 + (j - 1) % 2) - CASE WHEN substr({_DIGITS}, length({_DIGITS}) - j + 1, 1)::INT * (1 + (j - 1) % 2) > 9 THEN 9 ELSE 0 END)) % 10 = 0"""
_MOVED = "substr(replace(hit, ' ', ''), 5) || substr(replace(hit, ' ', ''), 1, 4)"
_MOD97 = f"""list_reduce(list_prepend(0, list_transform(string_split({_MOVED}, ''), lambda c: CASE WHEN c ~ '[0-9]' THEN c::INT ELSE ascii(c) - 55 END)),
    lambda s, v: (s * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1"""
_NEAR = f"lower(substr(t, greatest(a - {pii.NEAR}, 0) + 1, (a - greatest(a - {pii.NEAR}, 0))::BIGINT) || ' ' || substr(t, a + length(hit) + 1, {pii.NEAR}))"
_ANY = lambda words: "(" + " OR ".join(f"contains({_NEAR}, '{w}')" for w in words) + ")"

SQL: dict[str, str] = {
    "op5_secrets": _spans_sql(
        [(r.kind, f"(?i:{r.pattern})" if r.ignore_case else "[0-9a-f]+" if r.kind == "hex" else r.pattern) for r in secrets.BASE + secrets.MORE], len(secrets.BASE),
        "CASE kind WHEN 'assign' THEN length(regexp_extract(hit, pattern, 3)) >= 6 WHEN 'access' THEN length(hit) >= 20 WHEN 'hex' THEN length(hit) >= 24 ELSE true END"),
    "op9_pii": _spans_sql(
        [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"), ("iban", pii.IBAN), ("ssn", pii.SSN)], 4,
        f"""CASE kind WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3 OR p::HUGEINT > 255)) = 0
    WHEN 'card' THEN length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN} WHEN 'phone' THEN length({_DIGITS}) BETWEEN 9 AND 15
    WHEN 'iban' THEN length(replace(hit, ' ', '')) BETWEEN 15 AND 34 AND {_MOD97}
    WHEN 'ssn' THEN {_ANY(pii.FOR['ssn'])} AND NOT {_ANY(pii.AGAINST)} ELSE true END"""),
    "op3_exact_dedup": f"""
WITH lowered AS (SELECT doc_id, {_LOWERED} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM lowered WINDOW same AS (PARTITION BY t)""",
    "op6_ngram_join": rf"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, w, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                       ELSE [array_to_string(w, ' ')] END) AS s
  FROM worded WHERE len(w) > 0),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.8),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
copies AS (SELECT w, count(*) AS n FROM worded WHERE len(w) > 0 GROUP BY w)
SELECT d.doc_id, least(d.doc_id, coalesce(low, d.doc_id)) AS class_id, coalesce(counts.n, 0)::BIGINT AS n_links, coalesce(copies.n, 1)::BIGINT AS n_copies
FROM worded d LEFT JOIN classes ON d.doc_id = classes.a LEFT JOIN counts ON d.doc_id = counts.a LEFT JOIN copies ON d.w = copies.w""",
    "op8_embedding_dedup": """
WITH RECURSIVE sound AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
classes AS (SELECT a, min(b) AS low FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings e LEFT JOIN classes ON vec_id = classes.a LEFT JOIN counts ON vec_id = counts.a""",
    "op10_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS draw FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) FILTER (WHERE size > 0) AS documents FROM sized GROUP BY source),
named AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         source_size * 2.0::DOUBLE AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM named),
level AS (SELECT arg_min(level, cap / weight) AS common FROM levels WHERE cap / weight > level),
goals AS (SELECT source, source_size, documents, coalesce(least(cap, common * weight), cap) AS target FROM levels, level),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END::BIGINT AS whole FROM goals),
parts AS (
  SELECT *, greatest(0.0::DOUBLE, target - whole * source_size) AS rest FROM rates),
ranked AS (
  SELECT doc_id, s.source, size, source_size, target, whole, rest, draw,
         (('0x' || substr(draw, 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS r,
         least(1 - 1e-9::DOUBLE, rest / greatest(source_size, 1)) AS part,
         source_size / greatest(documents, 1) AS mean
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source),
ordered AS (
  SELECT *, (r / (1 - r)) / (part / (1 - part) * (mean / (mean + size))) AS ratio
  FROM ranked WHERE part > 0 AND size > 0),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY ratio / (1 + ratio), draw ROWS UNBOUNDED PRECEDING) AS upto FROM ordered)
SELECT doc_id, size, source_size, target, (size * (whole + (upto - size / 2 <= rest)::INT))::BIGINT AS taken FROM summed
UNION ALL
SELECT doc_id, size, source_size, target, size * whole AS taken FROM ranked WHERE NOT (part > 0 AND size > 0)""",
    "op12_decontamination": rf"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sizes AS (SELECT DISTINCT least(10, len(w)) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
            FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
grams AS (SELECT n, k, i, array_to_string(w[i:i + k - 1], ' ') AS t FROM (SELECT n, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k)),
hits AS (SELECT n, k, i, t FROM grams WHERE t IN (SELECT t FROM windows)),
covered AS (SELECT n, count(DISTINCT place) AS n_hit FROM (SELECT n, unnest(range(i, i + k)) AS place FROM hits) GROUP BY n),
found AS (SELECT n, count(*) AS n_items, array_to_string(list(item ORDER BY item), ',') AS names
          FROM (SELECT DISTINCT n, item FROM hits JOIN windows USING (t)) GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (n) LEFT JOIN found USING (n)""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_toxicity, op3_exact_dedup, op4_bpe, op5_secrets, op6_ngram_join, op7_binary, op8_embedding_dedup, op9_pii, op10_mixing,
                                 op11_whitening, op12_decontamination, op13_alignment)}
