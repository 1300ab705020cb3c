"""The registered queries of this subpackage and the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklane.llm import chat, decontam, divergence, images, langid, manifest, mixing, quality, simhash, tokencount, toxicity, urls, warc
from ticklane.llm.shared import Scratch, crc_remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _judged(scores: DataFrame, held: tuple[int, int], threshold: float) -> DataFrame:
    return scores.select(
        "doc_id", (crc_remainder(F.col("doc_id"), held[0]) == held[1]).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    return _judged(quality.score(docs, forest), quality.HOLD_OUT, quality.THRESHOLD)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _judged(toxicity.score(docs, lexicon), toxicity.HOLD_OUT, toxicity.THRESHOLD)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op5_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures drawn from the embeddings: the tables hold no media, and near vectors are edited copies of a picture."""
    return images.classes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", read=images.drawn)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return records.select(
        F.col("key").alias("page_id"), "record_type", "record_id", warc.header("WARC-Refers-To").alias("refers_to"), warc.header("WARC-Target-URI").alias("target_uri"),
        warc.header("WARC-Refers-To-Payload-Digest").alias("source_digest"), warc.header("WARC-Block-Digest").alias("block_digest"),
        warc.header("Content-Length").cast("long").alias("content_length"), F.sha2("block", 256).alias("block_sha256"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations lie in heterogeneous layouts (rows, messages, from and value, instruction), as sources would hold them;
    fingerprints pick the mapping of each back to canonical turns."""
    scratch = Scratch(spark, "chat")
    rows, texts = chat.in_layouts(chat.with_probe(table(spark, sf_dir, "conversations")), scratch)
    formatted = scratch.cut(chat.format_turns(chat.canonical_rows(rows, scratch.cut(texts))))
    read = chat.read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", (crc_remainder(F.col("doc_id"), langid.HOLD_OUT[0]) == langid.HOLD_OUT[1]).alias("held_out"), "lang_pred", "score")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audit(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>') AS r,
         replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '</s>', '<\/s>') AS x
  FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum(length(r) + length(x) + 22) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

OP2_SQL = r"""
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, row_number() OVER () AS r, list_filter(regexp_split_to_array(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)
  UNION ALL
  SELECT 1, item_id, -row_number() OVER (), list_filter(regexp_split_to_array(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')
  FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)),
i AS (SELECT r, id, len(ws) AS n, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS s FROM w WHERE kind = 1 AND len(ws) > 0),
p AS (SELECT DISTINCT r AS item, id, least(n, 10) AS k, array_to_string(ws[s : s + 9], ' ') AS phrase FROM i),
k AS (SELECT DISTINCT k FROM p),
d AS (SELECT w.r, w.ws, k.k, unnest(range(1, len(w.ws) - k.k + 2)) AS s FROM w, k WHERE w.kind = 0 AND len(w.ws) >= k.k),
m AS (SELECT d.r, d.s, d.k, p.id, p.item FROM d JOIN p ON d.k = p.k AND array_to_string(d.ws[d.s : d.s + d.k - 1], ' ') = p.phrase),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS q FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR))) AS digest FROM (SELECT DISTINCT r, item, id FROM m) GROUP BY r)
SELECT w.id AS doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (r) LEFT JOIN t USING (r) WHERE w.kind = 0
"""


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s0),
s2 AS (SELECT *, 3 * source_size / w AS fill, CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
              sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 3 * source_size / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM s1),
lv AS (SELECT fill AS f, k AS fk, rest, open FROM s2 WHERE fill > rest / open ORDER BY fill, k LIMIT 1),
s3 AS (SELECT s2.source, source_size, n, k, CASE WHEN lv.f IS NULL OR (s2.fill, s2.k) < (lv.f, lv.fk) THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(lv.rest AS DOUBLE) * w / lv.open END AS target FROM s2 LEFT JOIN lv ON true),
q1 AS (SELECT source, k, unnest(range(0, CASE WHEN source_size > 0 THEN greatest(3 * source_size // 8, 1) ELSE 0 END)) AS j, target FROM s3),
q2 AS (SELECT source, row_number() OVER (ORDER BY round((j + 0.5) / target, 12), k, j) AS place FROM q1 WHERE target > 0),
q3 AS (SELECT source, count(*) AS seats FROM q2 WHERE place <= (SELECT ceil(sum(target) / 8) FROM s3) GROUP BY source),
h0 AS (SELECT d.*, s3.source_size, s3.target, s3.k, md5(concat_ws('|', 'mix-1', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS draw, CAST(ceil(n / 20000) AS BIGINT) AS shards FROM d JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source),
h1 AS (SELECT *, CAST('0x' || substr(draw, 1, 8) AS BIGINT) % shards AS shard FROM h0),
b0 AS (SELECT source, k, shard, CAST(sum(size) AS BIGINT) AS words, CAST(ceil(sum(size) / 8) AS BIGINT) AS blocks FROM h1 GROUP BY 1, 2, 3),
b1 AS (SELECT k, shard, words, unnest(range(0, 3 * blocks)) AS j FROM b0),
b2 AS (SELECT k, shard, row_number() OVER (PARTITION BY k ORDER BY round((j + 0.5) / words, 12), shard, j) AS place FROM b1 WHERE words > 0),
b3 AS (SELECT b2.k, shard, count(*) AS quota FROM b2 JOIN s3 USING (k) JOIN q3 ON s3.source IS NOT DISTINCT FROM q3.source WHERE place <= seats GROUP BY 1, 2),
b4 AS (SELECT b0.k, b0.shard, greatest(blocks, 1) AS blocks, coalesce(quota, 0) AS quota, CAST('0x' || substr(md5(concat_ws('|', 'mix-1', source, CAST(b0.shard AS VARCHAR))), 1, 8) AS BIGINT) % greatest(blocks, 1) AS phase FROM b0 LEFT JOIN b3 USING (k, shard)),
l AS (SELECT h1.*, sum(size) OVER (PARTITION BY k, shard ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS e FROM h1),
m AS (SELECT l.*, e::BIGINT AS z, (e - size)::BIGINT AS a, blocks, quota, phase FROM l JOIN b4 USING (k, shard))
SELECT doc_id, size, source_size, target, CAST(
    ((z // 8 * quota + phase) // blocks) * 8 + (z % 8) * (((z // 8 + 1) * quota + phase) // blocks - (z // 8 * quota + phase) // blocks)
  - ((a // 8 * quota + phase) // blocks) * 8 - (a % 8) * (((a // 8 + 1) * quota + phase) // blocks - (a // 8 * quota + phase) // blocks) AS BIGINT) AS taken
FROM m
"""

OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(ws) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(*) >= 3),
c AS (SELECT lang, source, term, sum(n) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN c USING (lang, source) GROUP BY ALL),
l AS (SELECT lang, sum(total)::HUGEINT AS total FROM g GROUP BY lang),
gp AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + v.v) AS p
       FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
lp AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c.n) + 1)) // (l.total + v.v) AS q FROM c JOIN l USING (lang) JOIN v USING (lang) GROUP BY lang, term, l.total, v.v),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
tm AS (SELECT gp.lang, gp.source, 'term' AS part, gp.term AS item, ((p - q) * (p - q)) // q AS value FROM gp JOIN lp USING (lang, term) WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tm))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 200
"""

OP13_SQL = r"""
WITH RECURSIVE c AS (
  SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
         list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: list_transform(range(0, CASE WHEN x = '' THEN 0 ELSE 8 END), lambda i: (ascii(x) >> i::INT)::BIGINT)))),
                     lambda a, b: xor(a >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)) AS crc
  FROM documents),
h AS (
  SELECT row_number() OVER () AS r, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(told) || ':' || told, '-')) AS altered
  FROM (SELECT *, CASE WHEN xor(crc, 4294967295::BIGINT) % 3 = 0 THEN lowered ELSE text END AS told,
               coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
               || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM c)),
d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM h),
lv AS (
  SELECT 0 AS k, lang, place, leaf AS digest, n FROM d
  UNION ALL SELECT k + 1, lang, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (n + 7) // 8 FROM lv WHERE n > 1 GROUP BY k, lang, place // 8, n),
s AS (SELECT lang, k AS height, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM lv WHERE n = 1),
tp AS (
  SELECT 0 AS k, place, subroot AS digest, n FROM s
  UNION ALL SELECT k + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (n + 7) // 8 FROM tp WHERE n > 1 GROUP BY k, place // 8, n),
p AS (
  SELECT d.r, lv.k AS step, lv.place, lv.digest, lv.place = d.place // (8 ** lv.k)::BIGINT AS own
  FROM d JOIN lv ON lv.lang IS NOT DISTINCT FROM d.lang AND lv.n > 1 AND lv.place // 8 = d.place // (8 ** (lv.k + 1))::BIGINT
  UNION ALL
  SELECT d.r, s.height + tp.k, tp.place, tp.digest, tp.place = s.place // (8 ** tp.k)::BIGINT
  FROM d JOIN s ON s.lang IS NOT DISTINCT FROM d.lang JOIN tp ON tp.n > 1 AND tp.place // 8 = s.place // (8 ** (tp.k + 1))::BIGINT),
f AS (
  SELECT r, 0 AS step, altered AS node FROM d
  UNION ALL SELECT f.r, f.step + 1, sha256(string_agg(CASE WHEN own THEN node ELSE digest END, '' ORDER BY place)) FROM f JOIN p ON p.r = f.r AND p.step = f.step GROUP BY f.r, f.step),
o AS (SELECT r, sha256(coalesce(string_agg(CASE WHEN NOT own THEN digest END, '' ORDER BY step, place), '')) AS proof_sha256 FROM p GROUP BY r),
e AS (SELECT r, max_by(node, step) AS folded_root FROM f GROUP BY r)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM d JOIN s ON s.lang IS NOT DISTINCT FROM d.lang CROSS JOIN (SELECT digest AS root FROM tp WHERE n = 1) JOIN e USING (r) LEFT JOIN o USING (r)
"""


def queries() -> dict:
    return {
        "op1_quality": op1_quality,
        "op2_decontamination": op2_decontamination,
        "op3_toxicity": op3_toxicity,
        "op4_simhash": op4_simhash,
        "op5_image_copies": op5_image_copies,
        "op6_url_filter": op6_url_filter,
        "op7_mixing": op7_mixing,
        "op8_token_counts": op8_token_counts,
        "op9_warc": op9_warc,
        "op10_chat": op10_chat,
        "op11_language": op11_language,
        "op12_divergence": op12_divergence,
        "op13_manifest": op13_manifest,
    }


def oracle_sql() -> dict:
    return {"op2_decontamination": OP2_SQL, "op7_mixing": OP7_SQL, "op10_chat": OP10_SQL, "op12_divergence": OP12_SQL, "op13_manifest": OP13_SQL}
