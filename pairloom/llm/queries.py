"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out
from . import bisectors, conversation_repair, decontaminate, html_extract, language_model, license_scan, line_dedup, mixing, personal_data, quality_classifier, quality_rules, simhash, toxicity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LINE_SQL = """
WITH lines AS (
  SELECT doc_id, u.i AS line_no, u.line, lower_ascii.key
  FROM documents,
       LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                       generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i) u,
       LATERAL (SELECT translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key) lower_ascii
), repeated AS (
  SELECT key, max(doc_id) AS max_doc FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, r.key IS NOT NULL AND l.doc_id < r.max_doc AS gone FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@_query("op2_line_dedup", _LINE_SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    kept = line_dedup.deduplicate(docs, line_dedup.create(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@_query("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classed = simhash.near_duplicate_classes(_table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return classed.select("doc_id", digits.alias("fingerprint"), "component_id")


_PASSAGE_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), places AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS key
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words, (SELECT DISTINCT size FROM windows))
), found AS (
  SELECT p.doc_id, p.i, p.size, x.item_id FROM places p JOIN windows x ON p.key = x.key AND p.size = x.size
), hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)
"""


@_query("op5_benchmark_decontamination", _PASSAGE_SQL)
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _rule_sql() -> str:
    tests = []
    for rule in quality_rules.RULES:
        tests += [f"{rule.measure} < {rule.low}"] if rule.low is not None else []
        tests += [f"{rule.measure} > {rule.high}"] if rule.high is not None else []
    return " OR ".join(tests)


_RULES_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts
), places AS (
  SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, key) AS n FROM places) WHERE n > 1
), repeated AS (
  SELECT doc_id, sum(step) AS n FROM (
    SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS step FROM twice) GROUP BY doc_id
), counts AS (
  SELECT s.doc_id, t, w, l, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN repeated r ON s.doc_id = r.doc_id
), ratios AS (
  SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbols_per_word,
         length(regexp_replace(t, '[^!]', '', 'g')) / greatest(n_words, 1) AS exclamations_per_word,
         len(list_filter(w, lambda x: list_contains([STOPS], x))) / greatest(n_words, 1) AS stop_word_share,
         n_dup_lines / greatest(len(l), 1) AS repeated_line_share,
         len(list_filter(l, lambda x: starts_with(ltrim(x), '•') OR starts_with(ltrim(x), '- '))) / greatest(len(l), 1) AS bullet_line_share,
         len(list_filter(l, lambda x: ends_with(rtrim(x), '...') OR ends_with(rtrim(x), '…'))) / greatest(len(l), 1) AS ellipsis_line_share
  FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR RULES) AS kept
FROM ratios
""".replace("STOPS", ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)).replace("RULES", _rule_sql())


@_query("op9_quality_rules", _RULES_SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *[F.col(f"measures.{c}").cast("long").alias(c) for c in counts], "base_failed", "kept")


@_query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(_table(spark, sf_dir, "documents")))


@_query("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    # the url is carried through the operator's own row, so ids need not be unique
    keyed = pages.select(F.struct("page_id", "url").alias("page_id"), "html")
    text = html_extract.extract(keyed)
    return text.select("page_id.page_id", "page_id.url", "text", F.length("text").cast("long").alias("n_chars"))


_MIX_SQL = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents
), sources AS (
  SELECT source, CAST(sum(n_tokens) AS BIGINT) AS source_tokens FROM tokens GROUP BY source HAVING sum(n_tokens) > 0
), corpus AS (
  SELECT CAST(sum(source_tokens) AS BIGINT) AS n, count(*) AS s, list(source_tokens) AS sizes FROM sources
), p AS (SELECT n, s, list_transform(sizes, lambda x: x / n) AS ps FROM corpus),
bisect AS (
  SELECT 0 AS turn, CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high
  UNION ALL
  SELECT turn + 1, CASE WHEN holds THEN low ELSE a END, CASE WHEN holds THEN a ELSE high END
  FROM (
    SELECT turn, low, high, a, ln(z) - a * g / z <= ENTROPY * ln(s) + 1e-12
           AND (a - 1) * ln(list_min(ps)) - ln(z) <= ln(PASSES) + 1e-12 AS holds
    FROM (SELECT turn, low, high, (low + high) / 2 AS a, p.s, p.ps,
                 list_sum(list_transform(ps, lambda x: pow(x, (low + high) / 2))) AS z,
                 list_sum(list_transform(ps, lambda x: pow(x, (low + high) / 2) * ln(x))) AS g
          FROM bisect, p WHERE turn < 40))
), exponent AS (SELECT round(high, 6) AS a FROM bisect ORDER BY turn DESC LIMIT 1),
weighted AS (
  SELECT source, source_tokens, pow(source_tokens / n, a) / list_sum(list_transform(ps, lambda x: pow(x, a))) AS weight, n
  FROM sources, p, exponent
), budgets AS (SELECT *, CAST(round(weight * n) AS BIGINT) AS budget, greatest(1, (n + 999999) // 1000000) AS blocks FROM weighted),
draws AS (
  SELECT t.doc_id, t.n_tokens, b.*, unnest(range(0, (b.budget - 1) // b.source_tokens + 1)) AS pass
  FROM tokens t JOIN budgets b ON t.source = b.source WHERE b.budget > 0
), placed AS (
  SELECT *, pass * source_tokens + coalesce(sum(n_tokens) OVER (
    PARTITION BY source, pass ORDER BY md5('SEED|' || pass || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_token FROM draws
), taken AS (
  SELECT *, CAST(floor(CAST(at_token AS DOUBLE) * CAST(blocks AS DOUBLE) / budget) AS BIGINT) AS block FROM placed WHERE at_token < budget
)
SELECT doc_id, source, CAST(pass AS INTEGER) AS pass, block,
       CAST(row_number() OVER (PARTITION BY block ORDER BY md5('SEED|' || block || '|' || pass || '|' || coalesce(CAST(doc_id AS VARCHAR), '')),
            source, doc_id, n_tokens) AS INTEGER) AS place, n_tokens, round(weight, 9) AS weight
FROM taken
""".replace("ENTROPY", str(mixing.TARGET_ENTROPY)).replace("PASSES", str(mixing.MAX_PASSES)).replace("SEED", str(mixing.SEED))


@_query("op8_source_mixing", _MIX_SQL)
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


@_query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


@_query("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_classifier.scored(docs, quality_classifier.train(docs, _table(spark, sf_dir, "labels")))


@_query("op6_lm_scoring")
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out(F.col("doc_id"), 7, 2)
    scored = language_model.score(_table(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _bisector_sql(rounds: int = bisectors.ROUNDS) -> str:
    """The rounds one after the other; vectors as lists, distances as whole numbers."""
    nearest = """
  SELECT vec_id, v, arg_min(number, (distance, number)) AS cluster, min(distance) AS distance FROM (
    SELECT x.rid, x.vec_id, x.v, c.number,
           CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
    FROM kept x, c{0} c) GROUP BY rid, vec_id, v"""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id,
         list_transform(embedding, lambda x: CAST(floor({bisectors.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {bisectors.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {bisectors.DIMENSIONS})""",
        f"""c0 AS MATERIALIZED (SELECT number, v FROM (SELECT row_number() OVER (
         ORDER BY sha256('{bisectors.SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS number, v FROM kept) WHERE number < {bisectors.CENTROIDS})""",
    ]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({nearest.format(i)})")
        parts.append(f"""m{i} AS (SELECT cluster, list(m ORDER BY axis) AS v FROM (
  SELECT cluster, axis, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
    SELECT cluster, axis, sum(part) AS s, count(*) AS n FROM (
      SELECT cluster, unnest(v) AS part, generate_subscripts(v, 1) AS axis FROM a{i}) GROUP BY cluster, axis)) GROUP BY cluster)""")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.number, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON c.number = m.cluster)")
    parts.append(f"last AS MATERIALIZED ({nearest.format(rounds)})")
    return "WITH " + ",\n".join(parts) + f"""
SELECT l.vec_id, CAST(l.cluster AS INTEGER) AS cluster, l.distance, CAST(sum(l.distance) OVER (PARTITION BY l.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(l.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM last l JOIN c{rounds} c ON l.cluster = c.number"""


@_query("op13_centroid_clustering", _bisector_sql())
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered = bisectors.cluster(_table(spark, sf_dir, "embeddings"))
    return clustered.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", bisectors.digest().alias("centroid_sha256"))


@_query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(_table(spark, sf_dir, "conversations")))


@_query("op11_personal_data")
def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [of(kind).alias(f"n_{kind}") for kind in personal_data.KINDS]
    return found.select("doc_id", *counts, F.sha2(personal_data.written_out(base), 256).alias("base_sha256"), personal_data.written_out(F.col("spans")).alias("spans"))
