"""The registered queries of the operators, and their reference SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm import bpe, exact_dedup, html_main, line_chunks, mixing, near_dedup, quality, quality_gam, secret_scan, spelling, suffix_dedup, token_shards, va_clusters
from telemill.llm.shared import LOWER, UPPER, table
from telemill.session import shared_dir

_WORD_SQL = r"'[^\x20\x09-\x0D]+'"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trips(table(spark, sf_dir, "documents"), str(ranks), public_tokenizers.PATTERN)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeated_strings(table(spark, sf_dir, "documents"), with_text=False)


def op3_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP4_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", "taken", F.array_join(F.col("copies.shard").cast("array<string>"), ",").alias("shards")
    )


def _op5_sql() -> str:
    seed, depth = mixing.SEED, mixing.TREE_DEPTH
    blocks = mixing.BLOCKS_PER_SHARD << depth
    levels = ["t0 AS (SELECT no, quota, unnest(range(quota)) AS a, 0 AS node FROM q)"]
    for level in range(depth):
        levels.append(
            f"t{level + 1} AS (SELECT no, quota, a, node * 2 + CASE WHEN row_number() OVER (PARTITION BY node ORDER BY "
            f"md5(concat_ws('|', '{seed}', 'split{level}', no, a)), no, a) > (count(*) OVER (PARTITION BY node) + 1) // 2 "
            f"THEN 1 ELSE 0 END AS node FROM t{level})"
        )
    line = " + ".join(f"(ss * {p} + a + size <= target)::INT" for p in range(mixing.REPEATS))
    fills = []
    for i in range(mixing.FILL_ROUNDS):
        fills += [
            f"h{i} AS (SELECT *, open AND size <= gap AND sum(CASE WHEN open AND size <= gap THEN size END) OVER (PARTITION BY no, rng "
            f"ORDER BY size DESC, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= gap AS takes FROM f{i})",
            f"f{i + 1} AS (SELECT * EXCLUDE (takes) REPLACE (open AND NOT takes AS open, n + takes::INT AS n, gap - coalesce("
            f"sum(CASE WHEN takes THEN size END) OVER (PARTITION BY no, rng), 0) AS gap) FROM h{i})",
        ]
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD_SQL}))::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source),
w AS (SELECT *, (no - 1) % 3 + 1 AS w, sum(ss) OVER () AS total FROM p),
o AS (SELECT *, coalesce(sum(ss * 3) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
        sum(w) OVER () - coalesce(sum(w) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
      FROM w WINDOW x AS (ORDER BY ss * 3 / w, no)),
c AS (SELECT *, (total - stopped) * w > ss * 3 * open AS stops FROM o),
g AS (SELECT source, no, ss, total, CASE WHEN stops THEN (ss * 3)::DOUBLE ELSE
        (w * (total - sum(CASE WHEN stops THEN ss * 3 ELSE 0 END) OVER ()))::DOUBLE
        / (sum(CASE WHEN stops THEN 0 ELSE w END) OVER ())::DOUBLE END AS target FROM c),
q AS (SELECT no, greatest(1, round(target * {blocks} / total))::INT AS quota FROM g WHERE target > 0),
{", ".join(levels)},
drawn AS (SELECT no, node AS shard, row_number() OVER (PARTITION BY no ORDER BY node, a) AS r FROM t{depth}),
perm AS (SELECT no, quota, a, row_number() OVER (PARTITION BY no ORDER BY md5(concat_ws('|', '{seed}', 'block', no, a)), a) AS r FROM t0),
placed AS (SELECT perm.no, quota, a, shard FROM perm JOIN drawn USING (no, r)),
r0 AS (SELECT doc_id, size, no, ss, target, md5(concat_ws('|', '{seed}', coalesce(doc_id::VARCHAR, ''))) AS key,
        (count(*) OVER (PARTITION BY no) + {mixing.RANGE_ROWS - 1}) // {mixing.RANGE_ROWS} AS ranges
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
r AS (SELECT *, (('0x' || key[1:8])::BIGINT * ranges) // 4294967296 AS rng, coalesce(sum(size) OVER (PARTITION BY no
        ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM r0),
l AS (SELECT *, CASE WHEN size > 0 THEN {line} ELSE 0 END AS n FROM r),
f0 AS (SELECT *, size > 0 AND n < {mixing.REPEATS} AS open, coalesce(max(CASE WHEN size > 0 AND n < {mixing.REPEATS}
        AND ss * n + a < target THEN target - (ss * n + a) END) OVER (PARTITION BY no, rng), 0) AS gap FROM l),
{", ".join(fills)},
n AS (SELECT * REPLACE (n + (open AND size <= 2 * gap AND count(*) FILTER (open) OVER falling
        = count(*) FILTER (open) OVER (PARTITION BY no, rng))::INT AS n)
      FROM f{mixing.FILL_ROUNDS} WINDOW falling AS (PARTITION BY no, rng ORDER BY size DESC, key
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
k AS (SELECT *, unnest(range({mixing.REPEATS})) AS pass FROM n),
s AS (SELECT k.*, ss * pass + k.a AS start FROM k WHERE pass < n),
b AS (SELECT doc_id, s.no, pass, size, shard FROM s JOIN placed ON s.no = placed.no
        AND placed.a = least(floor(start * quota / target)::INT, quota - 1)),
t AS (SELECT doc_id, sum(size)::BIGINT AS taken, string_agg(shard::VARCHAR, ',' ORDER BY pass) AS shards FROM b GROUP BY doc_id)
SELECT r.doc_id, r.size, r.ss AS source_size, r.target, coalesce(t.taken, 0)::BIGINT AS taken, coalesce(shards, '') AS shards
FROM r LEFT JOIN t USING (doc_id)
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, {_WORD_SQL}) AS ws, string_split(t, chr(10)) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS x
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS n
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM rep) GROUP BY doc_id),
l AS (SELECT doc_id, source, t, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, {_WORD_SQL}) GROUP BY doc_id),
m AS (SELECT *, trim(regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+', ' ', 'g')) AS k
      FROM l WHERE regexp_matches(line, {_WORD_SQL})),
hosts AS (SELECT source, count(DISTINCT t) AS texts FROM d GROUP BY source),
often AS (SELECT m.source, k, min(doc_id) AS holder FROM m JOIN hosts h ON m.source IS NOT DISTINCT FROM h.source
          GROUP BY m.source, k, texts
          HAVING count(DISTINCT t) > {quality.MIN_TEXTS} AND count(DISTINCT t) > {quality.SHARE} * texts),
lost AS (SELECT m.doc_id, sum(len(regexp_extract_all(line, {_WORD_SQL}))) AS n FROM m JOIN often o
         ON m.source IS NOT DISTINCT FROM o.source AND m.k = o.k AND m.doc_id <> o.holder GROUP BY m.doc_id),
a AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words, (len(ws) - coalesce(lost.n, 0))::BIGINT AS n_kept_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id)),
b AS (SELECT *, n_words < {quality.LEAST_WORDS}
        OR 100 * n_repeat_words > {quality.REPEATED_PERCENT} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_kept_words,
  NOT base_failed AND n_kept_words >= {quality.LEAST_WORDS} AND n_kept_words >= {quality.KEEP_SHARE} * n_words AS kept
FROM b
"""


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_chunks.drop_repeated_chunks(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_chunks", "n_removed", "n_removed_lines", F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p, len(ls) AS n
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l),
r AS (SELECT *, (h * 31 + coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY p), 0)) % {line_chunks.PRIME} AS roll FROM h),
e AS (SELECT *, CASE WHEN p = n OR roll % {line_chunks.DIVISOR} = 0 THEN 1 ELSE 0 END AS stop FROM r),
c AS (SELECT *, coalesce(sum(stop) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM e),
k AS (SELECT doc_id, c, min(p) AS p, count(*) AS n, string_agg(line, chr(10) ORDER BY p) AS t FROM c GROUP BY doc_id, c),
m AS (SELECT *, row_number() OVER (PARTITION BY t, n >= {line_chunks.LEAST_LINES} ORDER BY doc_id, p) > 1
        AND n >= {line_chunks.LEAST_LINES} AND regexp_matches(t, {_WORD_SQL}) AS gone FROM k)
SELECT doc_id, sum(n)::BIGINT AS n_lines, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed,
  coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed_lines,
  sha256(coalesce(string_agg(t, chr(10) ORDER BY c) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "token-shards")
    token_shards.write_shards(table(spark, sf_dir, "documents"), out, str(public_tokenizers.path("byte_bpe_50k.json")), added_tokens=True)
    return token_shards.read_shards(spark.read.parquet(out))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), shared_dir(spark, "ledger"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    def only(*kinds):
        return F.filter("findings", lambda f: f["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *[F.size(only(kind)).cast("long").alias(f"n_{kind}") for kind in secret_scan.BASE],
        F.sha2(listed(only(*secret_scan.BASE)), 256).alias("base_sha256"),
        listed(F.col("findings")).alias("spans"),
    )


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op11_va_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_clusters.with_inertia(va_clusters.cluster(table(spark, sf_dir, "embeddings")))


def _op11_sql(k: int = 8, rounds: int = 10, dims: int = va_clusters.DIMS, scale: int = va_clusters.SCALE) -> str:
    """Every round as two relations: the nearest centroid of each vector, and the means by dimension."""
    steps = []
    for r in range(rounds + 1):
        steps.append(
            f"d{r} AS (SELECT v.r, c.c, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{r} c USING (j) GROUP BY v.r, c.c),\n"
            f"a{r} AS MATERIALIZED (SELECT r, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"
        )
        if r < rounds:
            steps.append(
                f"c{r + 1} AS MATERIALIZED (SELECT c.c, c.j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT c, j,"
                f" (CASE WHEN sum(x) < 0 THEN -((count(*) - 1 - sum(x)) // count(*)) ELSE sum(x) // count(*) END)::BIGINT AS x"
                f" FROM a{r} JOIN v USING (r) GROUP BY c, j) m ON c.c = m.c AND c.j = m.j)"
            )
    steps = ",\n".join(steps)
    return f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {dims}
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, unnest(range({dims})) AS j, floor({scale} * unnest(embedding)::DOUBLE)::BIGINT AS x FROM e),
s AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM e QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, j, x FROM s JOIN v USING (r)),
{steps},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS "cluster", d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN e USING (r) JOIN h USING (c)
"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


#: The checksum is computed byte by byte from a table made by its own rule; words are near if one without a letter is
#: the other, or if both without the letter at one place are equal.
OP12_SQL = rf"""
WITH RECURSIVE crc AS (SELECT list(b ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8),
  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS b FROM range(256) r(i))),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
  '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
b AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r),
h AS (SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(len(x) // 2),
  lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT), lambda a, v: xor(a >> 8, t[xor(a & 255, v) + 1])), 4294967295) AS h FROM b, crc),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % {spelling.SPOIL} = 0
  THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h)
  WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
g AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS gap
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM g a JOIN g b ON a.i = b.i AND a.gap = b.gap AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM g JOIN w ON g.gap = w.word UNION SELECT w.word, g.word, g.n FROM g JOIN w ON g.gap = w.word),
c AS (SELECT word, count(*) AS n_near FROM p GROUP BY word),
f AS MATERIALIZED (SELECT word, other AS form, m AS form_n FROM (SELECT p.*, w.n FROM p JOIN w USING (word)
  QUALIFY row_number() OVER (PARTITION BY p.word ORDER BY m DESC, other) = 1) WHERE m >= {spelling.RATIO} * n),
walk AS (SELECT word, form AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.root = f.word),
ends AS (SELECT word, root FROM walk WHERE root NOT IN (SELECT word FROM f))
SELECT w.word, form, coalesce(root, w.word) AS root, w.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n
FROM w LEFT JOIN c USING (word) LEFT JOIN f USING (word) LEFT JOIN ends USING (word)
"""


def op13_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_bpe": (op1_bpe, None),
    "op2_suffix_dedup": (op2_suffix_dedup, None),
    "op3_html_main": (op3_html_main, None),
    "op4_exact_dedup": (op4_exact_dedup, OP4_SQL),
    "op5_mixing": (op5_mixing, _op5_sql()),
    "op6_quality": (op6_quality, OP6_SQL),
    "op7_token_shards": (op7_token_shards, None),
    "op8_line_chunks": (op8_line_chunks, OP8_SQL),
    "op9_secret_scan": (op9_secret_scan, None),
    "op10_near_dedup": (op10_near_dedup, None),
    "op11_va_clusters": (op11_va_clusters, _op11_sql()),
    "op12_spelling": (op12_spelling, OP12_SQL),
    "op13_quality_gam": (op13_quality_gam, None),
}
