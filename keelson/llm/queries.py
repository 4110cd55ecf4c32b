"""The queries of this subpackage, one for each operator, and their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, embedding_dedup, exact_dedup, hard_negatives, jaccard_join, language_id, mixing, pii, quality_rules, substring_dedup, tokenizer_alignment, url_filter
from .common import shared_dir, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


#: The first day of the host list and of the pages.
FIRST_DAY = "2024-01-01"


def host_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts and parent domains of all pages: half of them are added some day, half of these removed later, a quarter of those added again."""
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).filter("host IS NOT NULL").distinct()
    known = hosts.select(F.explode(url_filter.suffixes(F.col("host"))).alias("host")).distinct()
    digest = F.md5(F.concat(F.lit("list/"), "host"))
    number = lambda at, n: F.conv(F.substring(digest, at, n), 16, 10).cast("int")
    added = F.date_add(F.lit(FIRST_DAY).cast("date"), number(2, 3) % 600)
    removed, again = F.date_add(added, number(6, 2) + 1), F.date_add(added, number(6, 2) + number(9, 2) + 2)
    reason = F.element_at(F.array(*[F.lit(r) for r in REASONS]), number(11, 2) % len(REASONS) + 1)
    entry = lambda when, day, action: F.when(when, F.struct(day.alias("day"), F.lit(action).alias("action"), reason.alias("reason")))
    goes, returns = number(5, 1) < 8, number(8, 1) < 4
    dated = F.array_compact(F.array(entry(F.lit(True), added, "add"), entry(goes, removed, "remove"), entry(goes & returns, again, "add")))
    return known.filter(number(1, 1) < 8).select("host", F.explode(dated).alias("x")).select("host", "x.*")


REASONS = ("spam", "malware", "phishing", "adult", "parked")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no date of their own: the fetch day runs through two years with the page's number."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(f"date_add(DATE'{FIRST_DAY}', cast(pmod(page_id * 37, 730) as int))").alias("fetch_day"))
    out = url_filter.evaluate(pages, host_list(pages))
    return out.withColumns({c: F.col(c).cast("string") for c in ("fetch_day", "valid_from", "valid_to")})


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text")
    )
    return chat_format.digests(chat_format.windows(turns.unionByName(extra)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def tokenizer(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    """The rank file's lines and the pattern; read on the driver, for executors may lack the folder."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"), *tokenizer(), ids=False, digests=True)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def _vocabulary(name: str) -> bytes:
    """Read on the driver, for executors may lack the folder."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    models = _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model")
    return tokenizer_alignment.align(table(spark, sf_dir, "documents"), *models, public_tokenizers.PATTERN, home=shared_dir(spark))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seventh of the labels is wrong by one, so that rows of one origin stand on both sides."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, label, F.col("vec_id") % 100 == 0, home=shared_dir(spark))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(table(spark, sf_dir, "embeddings"), home=shared_dir(spark))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_url_filter, op3_quality_rules, op4_chat_format, op5_language_id, op6_mixing, op7_jaccard_join, op8_exact_dedup, op9_byte_bpe, op10_pii, op11_tokenizer_alignment, op12_hard_negatives, op13_embedding_dedup)}

_N = "('0x' || substr(d, {}, {}))::INT"

OP2_SQL = rf"""
WITH seen AS (
  SELECT page_id, (DATE '{FIRST_DAY}' + (page_id * 37 % 730)::INT)::DATE AS fetch_day,
    replace(replace(replace(trim(url, array_to_string([chr(i::INT) FOR i IN range(1, 33)], '')), chr(9), ''), chr(10), ''), chr(13), '') AS bare
  FROM pages
), cut AS (
  SELECT *, split_part(split_part(bare, '?', 1), '#', 1) AS front FROM seen
), schemed AS (
  SELECT *, CASE WHEN contains(front, ':') AND regexp_full_match(split_part(front, ':', 1), '[A-Za-z][A-Za-z0-9+.-]*') THEN lower(split_part(front, ':', 1)) END AS scheme FROM cut
), rested AS (
  SELECT *, CASE WHEN scheme IS NULL THEN front ELSE front[length(scheme) + 2:] END AS raw, replace(raw, '\', '/') AS rest FROM schemed
), bared AS (
  SELECT *, string_split(split_part(CASE WHEN scheme IN ('http', 'https', 'ws', 'wss', 'ftp') THEN ltrim(rest, '/') WHEN coalesce(scheme, 'file') = 'file' AND starts_with(rest, '//') THEN rest[3:]
    WHEN scheme <> 'file' AND starts_with(raw, '//') THEN replace(raw[3:], '\', '\\') ELSE '' END, '/', 1), '@')[-1] AS place FROM rested
), mapped AS (
  SELECT *, rtrim(lower(translate(translate(url_decode(split_part(place, ':', 1)), '{url_filter.WIDE.replace("'", "''")}', '{url_filter.PLAIN.replace("'", "''")}'), '{url_filter.INVISIBLE}', '')), '.') AS named,
    string_split(named, '.') AS parts, starts_with(place, '[') AS six FROM bared
), numbered AS (
  SELECT *, [CASE WHEN regexp_full_match(p, '0x[0-9a-f]*') THEN try_cast('0x0' || p[3:] AS BIGINT) WHEN regexp_full_match(p, '0[0-7]*') THEN list_sum([p[-i]::BIGINT * 8 ** (i - 1) FOR i IN range(1, length(p) + 1)])::BIGINT
    WHEN regexp_full_match(p, '[1-9][0-9]*') THEN try_cast(p AS BIGINT) END FOR p IN parts] AS n FROM mapped
), summed AS (
  SELECT *, len(n) <= 4 AND len(list_filter(n, lambda x: x IS NULL)) = 0 AND coalesce(list_max(n[:-2]), 0) <= 255 AND n[-1] < 256 ** (5 - len(n)) AS fits,
    CASE WHEN fits THEN (coalesce(list_sum([n[i] * 256 ** (4 - i) FOR i IN range(1, len(n))]), 0) + n[-1])::BIGINT END AS v FROM numbered
), hosted AS (
  SELECT page_id, fetch_day, CASE WHEN six THEN CASE WHEN contains(place, ']') THEN lower(split_part(place, ']', 1)) || ']' END
    WHEN regexp_full_match(parts[-1], '[0-9]+|0x[0-9a-f]*') THEN CASE WHEN fits THEN concat_ws('.', v >> 24, (v >> 16) & 255, (v >> 8) & 255, v & 255) END
    WHEN named <> '' AND len(list_filter(string_split(named, ''), lambda c: ascii(c) <= 32 OR ascii(c) = 127 OR contains('#/:<>?@[\]^|%', c))) = 0 THEN named END AS host FROM summed
), labels AS (
  SELECT DISTINCT host, string_split(host, '.') AS l, regexp_matches(host, '^([0-9.]+|\[.*)$') AS address FROM hosted WHERE host IS NOT NULL
), known AS (
  SELECT DISTINCT array_to_string(l[g.i:], '.') AS entry FROM labels JOIN range(1, 200) g(i) ON g.i <= CASE WHEN address THEN 1 ELSE greatest(len(l) - 1, 1) END
), coded AS (
  SELECT entry, md5('list/' || entry) AS d FROM known
), picked AS (
  SELECT entry, (DATE '{FIRST_DAY}' + {_N.format(2, 3)} % 600)::DATE AS added, {_N.format(6, 2)} + 1 AS gap, {_N.format(9, 2)} + 1 AS second_gap, {_N.format(5, 1)} < 8 AS goes, {_N.format(8, 1)} < 4 AS returns,
    [{", ".join(f"'{r}'" for r in REASONS)}][{_N.format(11, 2)} % {len(REASONS)} + 1] AS reason
  FROM coded WHERE {_N.format(1, 1)} < 8
), intervals AS (
  SELECT entry, reason, added AS valid_from, CASE WHEN goes THEN (added + gap)::DATE ELSE DATE '9999-12-31' END AS valid_to FROM picked
  UNION ALL SELECT entry, reason, (added + gap + second_gap)::DATE, DATE '9999-12-31' FROM picked WHERE goes AND returns
), ranked AS (
  SELECT s.*, i.entry, i.reason, i.valid_from, i.valid_to, row_number() OVER (PARTITION BY s.page_id ORDER BY length(i.entry) DESC NULLS LAST) AS place
  FROM hosted s LEFT JOIN intervals i
    ON (s.host = i.entry OR (ends_with(s.host, '.' || i.entry) AND contains(i.entry, '.') AND NOT regexp_matches(s.host, '^([0-9.]+|\[.*)$'))) AND i.valid_from <= s.fetch_day AND s.fetch_day < i.valid_to
)
SELECT page_id, host, fetch_day::VARCHAR AS fetch_day, entry IS NOT NULL AS blocked, entry, reason, valid_from::VARCHAR AS valid_from, valid_to::VARCHAR AS valid_to FROM ranked WHERE place = 1
"""

OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM sources
), lined AS (
  SELECT *,
    (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER line, 0))::DOUBLE AS left_words,
    (sum(weight) OVER () - coalesce(sum(weight) OVER line, 0))::DOUBLE AS left_weight
  FROM weighed
  WINDOW line AS (ORDER BY (3 * source_size)::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, left_words / left_weight AS level FROM lined
), water AS (
  SELECT arg_max(level, left_weight) AS water FROM levels WHERE level * weight::DOUBLE <= (3 * source_size)::DOUBLE
), targets AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, coalesce(water * weight::DOUBLE, (3 * source_size)::DOUBLE)) AS target
  FROM levels CROSS JOIN water
), rated AS (
  SELECT *,
    CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE * 16777216::DOUBLE)::BIGINT ELSE 0 END AS rate,
    ('0x' || substr(md5('7:' || coalesce('=' || source, '-')), 1, 7))::BIGINT // 16 AS start
  FROM targets
), placed AS (
  SELECT *, ('0x' || substr(md5('7/' || coalesce(doc_id::VARCHAR, '-')), 1, 7))::BIGINT AS turn,
    length(bin(size + 1)) * 4 + ((size + 1) * 4 // (1::BIGINT << (length(bin(size + 1)) - 1))) - 4 AS band
  FROM sized
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY band, turn % 64, turn, size, doc_id NULLS LAST) AS nth FROM placed
)
SELECT r.doc_id, r.size, t.source_size, t.target,
  ((r.nth * t.rate + t.start) // 16777216 - ((r.nth - 1) * t.rate + t.start) // 16777216)::BIGINT * r.size AS taken
FROM ranked r JOIN rated t ON r.source IS NOT DISTINCT FROM t.source
"""

OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), ranked AS (
  SELECT doc_id, sha256(norm) AS text_sha256, count(*) OVER (PARTITION BY norm) AS group_size,
    first_value(doc_id) OVER best AS keep_id, row_number() OVER best AS place
  FROM n WINDOW best AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, place = 1 AS kept, text_sha256 FROM ranked
"""

OP12_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

OP13_SQL = """
WITH RECURSIVE rows AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM rows a JOIN rows b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98
), reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT a AS vec_id, (SELECT count(*) FROM links l WHERE l.a = r.a) AS n_links, min(b) AS component_id, a = min(b) AS kept FROM reached r GROUP BY a
"""

ORACLES = {"op2_url_filter": OP2_SQL, "op6_mixing": OP6_SQL, "op8_exact_dedup": OP8_SQL, "op12_hard_negatives": OP12_SQL, "op13_embedding_dedup": OP13_SQL}
