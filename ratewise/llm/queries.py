"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from . import chat, codebooks, lattice, leaks, mixing, nearjoin, prefixhash, quality, shards, tokens, urls, warc, whitening
from .registry import query, table

WORDS_SQL = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


@query("op6_rule_ledger", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS ws FROM documents),
starts AS (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS p FROM d),
grams AS (SELECT r, p, array_to_string(ws[p:p + 7], ' ') AS g FROM starts),
twice AS (SELECT r, p FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 8)) AS q FROM twice) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.n_lines, 0)::BIGINT AS n_lines, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '\P{{L}}', '', 'g'))::BIGINT AS n_letters,
    length(regexp_replace(text, '\P{{Lu}}', '', 'g'))::BIGINT AS n_upper
  FROM d LEFT JOIN dup USING (r) LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT ({" OR ".join(quality.RULES.values())}) AS kept
FROM m""")
def op6_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"), ["doc_id"])
    base = ~quality.passes("base-1")
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & quality.passes("prose-1")).alias("kept"),
    )


SIZE_SQL = f"len({WORDS_SQL})::BIGINT"


@query("op4_source_mix", rf"""
WITH d AS (SELECT doc_id, source, {SIZE_SQL} AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
    ([3.0::DOUBLE, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
f AS (SELECT *, row_number() OVER r AS i, coalesce(sum(cap) OVER before, 0) AS gone, sum(w) OVER after AS free FROM w
  WINDOW r AS (ORDER BY cap / w, source NULLS LAST), before AS (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
t AS (SELECT sum(source_size) * 1.5::DOUBLE AS goal FROM s),
stop AS (SELECT min(i) AS i FROM f, t WHERE cap * free >= (goal - gone) * w),
level AS (SELECT f.i, goal - gone AS rest, free FROM f JOIN stop USING (i), t),
target AS (SELECT source, source_size, CASE WHEN f.i < level.i THEN cap ELSE rest * w / level.free END AS target FROM f, level),
p AS (SELECT d.*, source_size, target, floor(target)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN target ON d.source IS NOT DISTINCT FROM target.source)
SELECT doc_id, size, source_size, target, (CASE WHEN source_size = 0 THEN 0 ELSE
  budget // source_size * size + least(size, greatest(budget % source_size - before, 0)) END)::BIGINT AS taken FROM p""")
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, k, ['user', 'assistant'][k + 1], '<|im_end|><|im_start|>assistant ok' FROM range(2) r(k))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10), chr(92) || 'n'))
    + length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


@query("op7_chat_format", CHAT_SQL)
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    segments, _ = chat.format_chat(rows.unionByName(more))
    back = chat.read_back(segments)
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SHARD_BYTES = 1 << 20


@query("op8_extendible_shards", rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
    ('0x' || substr(md5(coalesce('k' || CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS h FROM documents),
levels AS (SELECT *, h >> (60 - depth) AS prefix FROM d, (SELECT unnest(range(0, 61))::INT AS depth)),
fit AS (SELECT depth, prefix FROM levels GROUP BY ALL HAVING sum(bytes) <= {SHARD_BYTES} OR count(*) = 1),
leaf AS (SELECT r, min(depth) AS depth FROM levels JOIN fit USING (depth, prefix) GROUP BY r),
s AS (SELECT d.*, leaf.depth, h >> (60 - leaf.depth) AS prefix FROM d JOIN leaf USING (r))
SELECT doc_id, bytes, depth, prefix, 0::BIGINT AS run, bytes > {SHARD_BYTES} AS oversize,
  sum(bytes) OVER (PARTITION BY depth, prefix)::BIGINT AS shard_bytes FROM s""")
def op8_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = shards.assign(docs, "doc_id", F.octet_length("text"), SHARD_BYTES)
    sizes = shards.directory(placed).select("depth", "prefix", "run", F.col("bytes").alias("shard_bytes"))
    return placed.join(broadcast_if_small(sizes, sizes.count()), ["depth", "prefix", "run"])


@query("op9_url_verdicts")
def op9_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = urls.fit(urls.label_by_rules(pages, urls.RULES))
    return urls.judge(pages, model, urls.RULES, ["page_id"])


@query("op1_warc_derivatives")
def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.responses(table(spark, sf_dir, "pages")), ["page_id"])
    return made.withColumn("record_sha256", F.sha2("record", 256))


@query("op3_token_shards")
def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return tokens.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), 1).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op2_chosen_path_join", rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS ws FROM documents),
g AS (SELECT DISTINCT r, array_to_string(ws[p:p + 4], ' ') AS s FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
met AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM g x JOIN g y USING (s) WHERE x.r < y.r GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
low AS (SELECT a AS r, min(doc_id) AS c FROM reach JOIN d ON d.r = b GROUP BY a),
links AS (SELECT a AS r, count(*) AS n FROM e GROUP BY a)
SELECT doc_id, least(doc_id, c) AS class_id, coalesce(links.n, 0)::BIGINT AS n_links FROM d LEFT JOIN low USING (r) LEFT JOIN links USING (r)""")
def op2_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearjoin.join(table(spark, sf_dir, "documents")).drop("text_key", "class_key")


PLAIN_SQL = r"list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')"


@query("op10_simhash_windows", rf"""
WITH i AS (SELECT item_id, ws, len(ws) AS n, least(len(ws), 5) AS k FROM (SELECT item_id, {PLAIN_SQL} AS ws FROM benchmark) WHERE len(ws) > 0),
ig AS (SELECT item_id, n, k, p, array_to_string(ws[p:p + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, n - k + 2)) AS p FROM i)),
ks AS (SELECT DISTINCT k FROM i),
d AS (SELECT row_number() OVER () AS r, doc_id, {PLAIN_SQL} AS ws FROM documents),
dg AS (SELECT r, k, len(ws) AS m, p, array_to_string(ws[p:p + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS p FROM d, ks)),
w AS (SELECT DISTINCT r, k, greatest(1, least(dg.p - ig.p + 1, m - least(m, n) + 1)) AS f, least(m, n) AS z FROM dg JOIN ig USING (k, s)),
wg AS (SELECT w.*, s, count(*) AS c FROM w JOIN dg USING (r, k) WHERE p BETWEEN f AND f + z - k GROUP BY ALL),
ic AS (SELECT item_id, n, k, s, count(*) AS c FROM ig GROUP BY ALL),
sim AS (SELECT r, f, z, k, item_id, sum(least(wg.c, ic.c)) AS t, n FROM wg JOIN ic USING (k, s) GROUP BY ALL),
leak AS (SELECT r, item_id, max(t / ((z - k + 1) + (n - k + 1) - t)) AS similarity FROM sim GROUP BY ALL HAVING similarity >= 0.8 - 1e-9),
best AS (SELECT r, count(*) AS n, arg_max(item_id, (similarity, -item_id)) AS item_id, max(similarity) AS similarity FROM leak GROUP BY r)
SELECT doc_id, n IS NOT NULL AS contaminated, coalesce(n, 0)::BIGINT AS n_items, item_id, round(similarity, 6) AS similarity FROM d LEFT JOIN best USING (r)""")
def op10_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = leaks.matches(docs, table(spark, sf_dir, "benchmark"))
    return leaks.flag(docs, found, ["doc_id"]).withColumn("similarity", F.round("similarity", 6))


@query("op5_subword_lattice")
def op5_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lattice.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _codes_sql() -> str:
    """All rounds spelt out."""
    parts, entries, step = codebooks.PARTS, codebooks.ENTRIES, "w"
    ctes = [
        f"""v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) AS r, * FROM (SELECT vec_id, label,
    list_transform(embedding, lambda c: floor({codebooks.SCALE} * c::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0))""",
        f"shape AS (SELECT len(x) // {parts} AS {step} FROM v WHERE r = 1)",
        f"""c AS MATERIALIZED (SELECT r, (i - 1) // {step} AS part, (i - 1) % {step} AS pos, x[i] AS x
    FROM (SELECT r, x, unnest(range(1, len(x) + 1)) AS i FROM v), shape)""",
        f"book0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, x AS e FROM c WHERE r <= {entries})",
    ]
    for turn in range(codebooks.ROUNDS + 1):
        ctes.append(f"""near{turn} AS MATERIALIZED (SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM
    (SELECT r, part, entry, sum((x - e) * (x - e))::BIGINT AS d FROM c JOIN book{turn} USING (part, pos) GROUP BY ALL) GROUP BY ALL)""")
        if turn < codebooks.ROUNDS:
            ctes.append(f"""book{turn + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, e)::BIGINT AS e FROM book{turn} LEFT JOIN
    (SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM c JOIN near{turn} USING (r, part) GROUP BY ALL) USING (part, entry, pos))""")
    last = codebooks.ROUNDS
    ctes.append(f"""coded AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM near{last} JOIN v USING (r) GROUP BY r, vec_id, label)""")
    ctes.append(f"digest AS (SELECT sha256(string_agg(e::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book{last})")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest"


@query("op11_bounded_codes", _codes_sql())
def op11_bounded_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codebooks.encode(table(spark, sf_dir, "embeddings"))
    if found is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    return codebooks.label_errors(found.rows).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256")
    )


@query("op12_shifted_whitening")
def op12_shifted_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query("op13_prefix_fingerprints")
def op13_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixhash.with_next(table(spark, sf_dir, "documents"))
