"""The queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, language, media, mixing, phrases, secrets, sharding, simhash, token_store, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
SELECT doc_id,
       first_value(doc_id) OVER g AS keep_id,
       count(*) OVER (PARTITION BY sha) AS group_size,
       row_number() OVER g = 1 AS kept,
       sha AS text_sha256
FROM (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents)
WINDOW g AS (PARTITION BY sha ORDER BY n DESC, doc_id NULLS LAST)
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents")).withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


#: CRC-32 by bytes: {hex} is an expression of hexadecimal digits, and `crcs` the table of the 256 bytes' own.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all({hex}, '..'), lambda c: CAST('0x' || c AS bigint))), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"
_CRCS = "SELECT list(crc ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS crc FROM range(256) t(i))"

OP3_SQL = f"""
WITH bytewise AS ({_CRCS}),
sized AS (SELECT row_number() OVER () AS row_no, doc_id, CAST(strlen(coalesce(text, '')) + 16 AS bigint) AS size, {_CRC.format(hex="hex(coalesce(text, ''))")} AS text_crc32 FROM documents, bytewise),
laid AS (SELECT *, CAST(sum(size) OVER o - size AS bigint) AS start_byte, row_number() OVER o - 1 AS global_slot, sum(size) OVER () AS total FROM sized
         WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size, row_no)),
dealt AS (SELECT *, CAST(least(39, (start_byte * 2 + size) * 40 // (total * 2)) AS int) AS shard FROM laid)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY global_slot) - 1 AS slot, global_slot, start_byte, CAST(NULL AS int) AS grown_shard FROM dealt
"""


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def secrets_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op4_secrets what SQL can express."""
    return op4_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


SECRETS_COUNTS_SQL = r"""
SELECT doc_id, len(list_filter(regexp_extract_all(t, '((?i)password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS n_assign,
       len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access,
       len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.materialise(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(_table(spark, sf_dir, "documents"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op7_media what SQL can express: what was stored, not how."""
    return op7_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "width", "height")


MEDIA_PAYLOADS_SQL = f"""
WITH bytewise AS ({_CRCS}),
padded AS (SELECT doc_id, n_bytes, t || repeat(' ', CAST(CASE WHEN n_bytes = 0 THEN 192 ELSE (192 - n_bytes % 192) % 192 END AS bigint)) AS p FROM (SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) AS bigint) AS n_bytes FROM documents))
SELECT doc_id, n_bytes, CAST(strlen(p) AS bigint) AS payload_bytes, sha256(p) AS payload_sha256, {_CRC.format(hex="right(hex(p), 32)")} AS tail_crc32, CAST(192 AS int) AS width, CAST(strlen(p) // 192 AS int) AS height
FROM padded, bytewise
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.format_conversations(rows.unionByName(own)).drop("rewrites")


OP9_SQL = r"""
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(10 + length(role) + length(text) + length(regexp_replace(role || text, '[^<\[\]]', '', 'g'))) AS bigint) AS formatted_chars
FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
GROUP BY conv_id
"""

OP8_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS bigint) AS size FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS bigint) AS source_size FROM docs GROUP BY source),
weighted AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3.0::double * source_size AS cap FROM by_source),
levels AS (SELECT *, (sum(source_size) OVER ()::double - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS unit FROM weighted
           WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT *, coalesce(least(cap, weight * (SELECT arg_min(unit, cap / weight) FROM levels WHERE cap > unit * weight)), cap) AS target,
                   64::bigint AS block FROM levels),
slots_of AS (SELECT *, CAST(ceil(source_size / block) AS bigint) AS blocks, CASE WHEN source_size > 0 THEN target * CAST(ceil(source_size / block) AS bigint) / source_size ELSE 0.0::double END AS slots FROM targets),
shares AS (SELECT *, sum(slots) OVER (ORDER BY sid) AS upto, sum(slots) OVER () AS total FROM slots_of),
cut AS (SELECT *, CASE WHEN total > 0 THEN CASE WHEN upto >= total * (1 - 1e-12) THEN 1.0 ELSE upto / total END ELSE 0.0 END AS hi FROM shares),
cuts AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY sid), 0.0) AS lo FROM cut),
slot AS (SELECT i AS slot, (i % 2147483648 * 1327217885) % 2147483648 / 2147483648.0::double AS point FROM generate_series(0, (SELECT CAST(round(max(total)) AS bigint) FROM cuts) - 1) t(i)),
ranked AS (SELECT sid, blocks, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM slot JOIN cuts ON point >= lo AND point < hi),
takes AS (SELECT sid, rank % blocks AS block_no, count(*) AS takes FROM ranked WHERE rank < 3 * blocks GROUP BY 1, 2),
laid AS (SELECT row_no, sid, size, block, sum(size) OVER (PARTITION BY sid ORDER BY md5('mix:' || doc_id), doc_id, size, row_no ROWS UNBOUNDED PRECEDING) - size AS start FROM docs JOIN cuts ON docs.source IS NOT DISTINCT FROM cuts.source WHERE size > 0),
pieces AS (SELECT row_no, sid, size, block, start, unnest(generate_series(CAST(start // block AS bigint), CAST((start + size - 1) // block AS bigint))) AS block_no FROM laid),
got AS (SELECT row_no, sum(takes * (least(start + size, (block_no + 1) * block) - greatest(start, block_no * block))) AS taken FROM pieces JOIN takes USING (sid, block_no) GROUP BY row_no)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS bigint) AS taken
FROM docs JOIN cuts ON docs.source IS NOT DISTINCT FROM cuts.source LEFT JOIN got USING (row_no)
"""


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(_table(spark, sf_dir, "documents"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
                FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
placed AS (SELECT piece, lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (SELECT lang, len, array_to_string(w[i : i + len - 1], ' ') AS phrase FROM placed, (SELECT unnest([1, 2, 3, 4]) AS len) WHERE i + len - 1 <= len(w)),
counted AS (SELECT lang, len, phrase, count(*) AS f FROM grams GROUP BY ALL),
frequent AS (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE f >= 30),
candidates AS (SELECT lang, len, phrase, f AS a, w FROM frequent WHERE len > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, CAST(2000000::hugeint * c.a // (x.f::hugeint + y.f) AS bigint) AS score
         FROM (SELECT *, unnest(range(1, len)) AS k FROM candidates) c
         JOIN frequent x ON x.lang = c.lang AND x.len = k AND x.phrase = array_to_string(c.w[1 : k], ' ')
         JOIN frequent y ON y.lang = c.lang AND y.len = c.len - k AND y.phrase = array_to_string(c.w[k + 1 :], ' ')),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts),
inner_parts AS (SELECT lang, len, f_of, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, len, a AS f_of, w, m, unnest(range(1, len - m + 2)) AS i FROM candidates, (SELECT unnest([2, 3]) AS m) WHERE m < len)),
held AS (SELECT lang, phrase, max(f_of) AS held FROM inner_parts GROUP BY ALL),
kept AS (SELECT l.* FROM lowest l LEFT JOIN held h ON h.lang = l.lang AND h.phrase = l.phrase WHERE place = 1 AND (held IS NULL OR 100::hugeint * held < 80::hugeint * l.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept),
totals AS (SELECT lang, CAST(sum(f) AS bigint) AS n FROM counted WHERE len = 1 GROUP BY lang)
SELECT r.lang, rank, phrase, a, l, r.r, n, score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_sharding": op3_sharding,
    "op4_secrets": op4_secrets,
    "op5_token_store": op5_token_store,
    "op6_toxicity": op6_toxicity,
    "op7_media": op7_media,
    "op8_mixing": op8_mixing,
    "op9_chat": op9_chat,
    "op10_simhash": op10_simhash,
    "op11_language": op11_language,
    "op12_whitening": op12_whitening,
    "op13_phrases": op13_phrases,
    "pipeline": pipeline,
    "secrets_counts": secrets_counts,
    "media_payloads": media_payloads,
}
SQL: dict[str, str] = {
    "op2_exact_dedup": OP2_SQL,
    "op3_sharding": OP3_SQL,
    "op8_mixing": OP8_SQL,
    "op9_chat": OP9_SQL,
    "op13_phrases": OP13_SQL,
    "secrets_counts": SECRETS_COUNTS_SQL,
    "media_payloads": MEDIA_PAYLOADS_SQL,
}
