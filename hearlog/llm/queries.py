"""Registered queries of the text operators and their SQL oracles."""

import tempfile

from pyspark.sql import DataFrame, SparkSession

from hearlog.llm.covertree import codes
from hearlog.llm.decontaminate import contaminated
from hearlog.llm.descent import near_vectors
from hearlog.llm.dictionaries import clustered
from hearlog.llm.exact import content_sort
from hearlog.llm.html import extract
from hearlog.llm.language import identify
from hearlog.llm.mixing import pareto_mix
from hearlog.llm.pii import find
from hearlog.llm.quality import judge
from hearlog.llm.quotes import link_quotes
from hearlog.llm.simhash import near_duplicates
from hearlog.llm.substrings import without_repeats
from hearlog.session import delete_at_exit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_shared_folder(spark: SparkSession) -> None:
    """Sets a checkpoint folder, gone with the JVM, where a local session, as in tests, names none."""
    context = spark.sparkContext
    if (
        context.master.startswith("local[")
        and not context.getCheckpointDir()
        and not spark.conf.get("spark.checkpoint.dir", None)
    ):
        folder = tempfile.mkdtemp(prefix="hearlog-text-")
        context.setCheckpointDir(folder)
        delete_at_exit(spark, folder)


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that are labelled good and not toxic."""
    return table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_shared_folder(spark)
    return judge(table(spark, sf_dir, "documents"), trusted(spark, sf_dir))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_shared_folder(spark)
    return identify(table(spark, sf_dir, "documents"))


def op3_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_shared_folder(spark)
    return link_quotes(table(spark, sf_dir, "conversations"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_shared_folder(spark)
    return without_repeats(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_shared_folder(spark)
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_shared_folder(spark)
    return find(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_shared_folder(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_shared_folder(spark)
    return content_sort(table(spark, sf_dir, "documents"), keep="largest")


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_shared_folder(spark)
    return pareto_mix(table(spark, sf_dir, "documents")).drop("source")


def op11_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_shared_folder(spark)
    return codes(table(spark, sf_dir, "embeddings"))


def op12_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_shared_folder(spark)
    return clustered(table(spark, sf_dir, "embeddings"))


def op13_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    with_shared_folder(spark)
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_quotes": op3_quotes,
    "op4_substrings": op4_substrings,
    "op5_decontaminate": op5_decontaminate,
    "op6_pii": op6_pii,
    "op7_html": op7_html,
    "op8_simhash": op8_simhash,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_pareto_mix": op10_pareto_mix,
    "op11_covertree": op11_covertree,
    "op12_dictionaries": op12_dictionaries,
    "op13_descent": op13_descent,
}

OP10_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents
),
placed AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sized GROUP BY source
),
weighted AS (
  SELECT *, CAST(place % 3 + 1 AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS most,
    CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM placed
),
candidates AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS candidate
  FROM weighted
),
targets AS (
  SELECT source, source_size,
    least(most, coalesce(max(CASE WHEN candidate <= most / weight THEN candidate END) OVER (), most / weight) * weight) AS target
  FROM candidates
),
expected AS (
  SELECT s.*, source_size, target, least(3, coalesce(target / nullif(source_size, 0), 0)) AS copies,
    (CAST(CAST('0x' || substr(md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR), s.source)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
      / 4503599627370496 AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
),
planned AS (
  SELECT *, CAST(floor(copies + 1e-12) AS BIGINT) AS certain, greatest(0, copies - floor(copies + 1e-12)) AS chance FROM expected
),
ranked AS (
  SELECT *, draw / (1 - draw) * (1 - chance) / greatest(chance, 1e-12) AS odds,
    CASE WHEN certain < 3 THEN size ELSE 0 END AS may_repeat, sum(certain * size) OVER (PARTITION BY source) AS certain_words
  FROM planned
),
summed AS (
  SELECT *, coalesce(sum(may_repeat) OVER (
    PARTITION BY source ORDER BY odds, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM ranked
)
SELECT doc_id, size, source_size, target,
  CAST(certain * size + greatest(0, least(may_repeat, CAST(round(target) AS BIGINT) - certain_words - before)) AS BIGINT) AS taken
FROM summed
"""

_MARKS = r"^\s{0,3}((?:>\s{0,3})+)"
_END = r"[.!?…]+[\"'')\]]*(\s|$)"
OP3_SQL = rf"""
WITH RECURSIVE messages AS (
  SELECT row_number() OVER () AS id, conv_id, turn, role, text,
    string_split_regex(coalesce(text, ''), '\r\n|\r|\n') AS cut FROM conversations
),
lines AS (
  SELECT id, conv_id, turn, n, cut[n] AS line,
    length(regexp_replace(regexp_extract(cut[n], '{_MARKS}', 1), '[^>]', '', 'g')) AS depth,
    trim(regexp_replace(lower(regexp_replace(cut[n], '{_MARKS}', '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS words
  FROM (SELECT *, unnest(range(1, len(cut) + 1)) AS n FROM messages)
),
seen AS (
  SELECT *, coalesce(lead(depth) OVER (PARTITION BY id ORDER BY n), 0) AS next FROM lines
),
bodies AS (
  SELECT id, regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (
      depth = 0 AND NOT (next > 0 AND regexp_matches(line, '(?i)^.{{0,200}}\b(wrote|writes|said|schrieb|escribió|a écrit)\s*:\s*$'))
    ), ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body,
    CAST(max(depth) AS INTEGER) AS quote_depth
  FROM seen GROUP BY id
),
said AS (
  SELECT *, regexp_replace(line, '{_MARKS}', '') AS said,
    sum(CASE WHEN depth = above AND words <> '' AND words_above <> '' THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY n) AS passage
  FROM (SELECT *, lag(depth) OVER (PARTITION BY id ORDER BY n) AS above,
    lag(words) OVER (PARTITION BY id ORDER BY n) AS words_above FROM lines)
),
passages AS (
  SELECT id, conv_id, turn, depth, false AS single, string_agg(said, ' ' ORDER BY n) AS said FROM said GROUP BY id, conv_id, turn, depth, passage
  UNION ALL SELECT id, conv_id, turn, depth, true, said FROM said WHERE depth = 0
),
sentences AS (
  SELECT id, conv_id, turn, depth, single, string_split(words, ' ') AS words FROM (
    SELECT *, trim(regexp_replace(lower(unnest(string_split_regex(said, '{_END}'))), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS words FROM passages
  ) WHERE words <> ''
),
units AS (
  SELECT DISTINCT conv_id, turn, depth, array_to_string(words, ' ') AS sentence,
    array_to_string(words[i:i + 4], ' ') AS unit
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM sentences WHERE turn IS NOT NULL AND (NOT single OR len(words) <= 5))
),
quoting AS (SELECT id, count(DISTINCT (depth, words)) AS n_quoted FROM sentences WHERE depth > 0 GROUP BY id),
originals AS (SELECT conv_id, unit, min(turn) AS source FROM units WHERE depth = 0 GROUP BY ALL),
found AS (
  SELECT u.conv_id, u.turn, u.depth, u.sentence, u.unit, source FROM units u JOIN originals o
    ON u.conv_id IS NOT DISTINCT FROM o.conv_id AND u.unit = o.unit AND source < u.turn WHERE u.depth > 0
),
weighed AS (
  SELECT conv_id, turn, arg_max(source, {{'d': -depth, 'n': n, 's': source}}) AS reply_to
  FROM (SELECT conv_id, turn, depth, source, count(DISTINCT unit) AS n FROM found GROUP BY ALL) GROUP BY ALL
),
links AS (
  SELECT f.conv_id, f.turn, count(DISTINCT (depth, sentence)) AS n_linked, any_value(reply_to) AS reply_to
  FROM found f JOIN weighed w ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.turn = w.turn GROUP BY ALL
),
chains AS (
  SELECT conv_id, turn, reply_to AS root FROM links
  UNION ALL
  SELECT c.conv_id, c.turn, l.reply_to FROM chains c JOIN links l ON l.conv_id IS NOT DISTINCT FROM c.conv_id AND l.turn = c.root
),
roots AS (SELECT conv_id, turn, min(root) AS root FROM chains GROUP BY ALL),
joined AS (
  SELECT m.conv_id, m.turn, m.role, body, quote_depth, CAST(coalesce(n_quoted, 0) AS INTEGER) AS n_quoted, coalesce(n_linked, 0) AS n_linked, reply_to,
    coalesce(root, m.turn) AS thread
  FROM messages m JOIN bodies b ON m.id = b.id LEFT JOIN quoting q ON m.id = q.id
  LEFT JOIN links l ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.turn = l.turn
  LEFT JOIN roots r ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.turn = r.turn
)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn IS NULL, thread, turn, role) - 1 AS position FROM joined
"""

_FINITE = "len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"


def _op11_sql(rounds: int = 2) -> str:
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS (
  SELECT x.r, x.p, any_value(x.c) AS c, min({{'d': list_inner_product(list_transform(list_zip(x.c, b.c), lambda z: CAST(z[1] - z[2] AS DOUBLE)),
      list_transform(list_zip(x.c, b.c), lambda z: CAST(z[1] - z[2] AS DOUBLE))), 'e': b.e}}) AS best
  FROM pieces x JOIN b{n} b ON x.p = b.p GROUP BY x.r, x.p
)""")
        if n < rounds:
            means = ", ".join(f"CAST(floor(sum(c[{i}]) / count(*)) AS BIGINT)" for i in range(1, 5))
            steps.append(f"""
b{n + 1} AS (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c
  FROM b{n} b LEFT JOIN (SELECT p, best.e AS e, [{means}] AS c FROM a{n} GROUP BY ALL) m ON b.p = m.p AND b.e = m.e
)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}
),
pieces AS (SELECT r, p, c[4 * p + 1:4 * p + 4] AS c FROM kept, range(16) parts(p)),
b0 AS (SELECT p, r - 1 AS e, c FROM pieces WHERE r <= 64),
{",".join(steps)},
coded AS (
  SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r
),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), books
"""


def _op12_sql(rounds: int = 5) -> str:
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS (
  SELECT x.r, any_value(x.c) AS c, min({{'d': list_inner_product(x.c, x.c) - 2 * list_inner_product(x.c, b.c) + list_inner_product(b.c, b.c), 'k': b.k}}) AS best
  FROM kept x, b{n} b GROUP BY x.r
)""")
        if n < rounds:
            steps.append(f"""
m{n} AS (
  SELECT k, list(mean ORDER BY i) AS c FROM (
    SELECT best.k AS k, i, floor(sum(c[i]) / count(*)) AS mean FROM a{n}, range(1, 65) places(i) GROUP BY ALL
  ) GROUP BY k
),
b{n + 1} AS (SELECT b.k, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN m{n} m ON b.k = m.k)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), vec_id) AS r, vec_id,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
  FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}
),
b0 AS (SELECT r - 1 AS k, c FROM kept WHERE r <= 40),
{",".join(steps)}
SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
  CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(b.c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM kept JOIN a{rounds} USING (r) JOIN b{rounds} b ON b.k = best.k
"""


OP13_SQL = f"""
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND {_FINITE} AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
),
links AS (
  SELECT a.vec_id AS i, b.vec_id AS j FROM usable a JOIN usable b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93
),
reached AS (
  SELECT i AS origin, j AS reach FROM links
  UNION
  SELECT origin, j FROM reached JOIN links ON i = reach
),
least AS (SELECT origin, min(reach) AS least FROM reached GROUP BY origin),
counted AS (SELECT i, count(*) AS n FROM links GROUP BY i)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(least, vec_id)) AS kept
FROM embeddings LEFT JOIN counted ON vec_id = i LEFT JOIN least ON vec_id = origin
"""

ORACLES = {
    "op11_covertree": _op11_sql(),
    "op12_dictionaries": _op12_sql(),
    "op13_descent": OP13_SQL,
    "op3_quotes": OP3_SQL,
    "op10_pareto_mix": OP10_SQL,
    "op9_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
