"""The text operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.bpe import decode, encode
from stemma.llm import audit, decontaminate, html_text, langid, lm, pii, quality, vector_codes, warc
from stemma.llm.common import fold, table
from stemma.llm.exact_dedup import duplicate_groups
from stemma.llm.mixing import copies
from stemma.llm.simhash import fingerprints, near_groups
from stemma.sources.shared import materialize


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Encodes and decodes docs' whole texts; what the two give, as counts and digests."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"])
    back = decode(coded.withColumn("n_tokens", F.size("ids").cast("long")), ranks, out="bytes", packed="packed", keep=["doc_id", "n_tokens"])
    return back.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_slots")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = copies(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicate_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
             row_number() OVER (PARTITION BY norm ORDER BY doc_id) AS place FROM n)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score(table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)
    return found.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs.select("doc_id", "text"), quality.references(docs), keep=["doc_id"])


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialize(warc.pack(table(spark, sf_dir, "pages")), "warc_archives")
    found = warc.unpack(archives, payloads=False)
    return found.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))


OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first,
             row_number() OVER (PARTITION BY body ORDER BY page_id) AS place FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(0, 8), lambda k: list_aggregate(list_transform(range(0, 4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
        (CAST(concat('0x', substr(hex, 1 + 5 * k, 5)) AS BIGINT) >> (15 - 5 * j)) & 31 AS BIGINT), 1)), 'string_agg', '')), 'string_agg', '') AS digest FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN first END AS refers_to FROM b
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialize(fingerprints(table(spark, sf_dir, "documents"), keep=["doc_id"]), "simhash_prints")
    return near_groups(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 3) == 1
    model = langid.train(docs.where(~held_out))
    found = langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(spark)).select("doc_id", "base", "added")
    counts = [F.size(f"base.{kind}").cast("long").alias(f"n_{kind}") for kind in pii.BASE]
    every = (sum((F.size(f"base.{kind}") for kind in pii.BASE), F.size("added"))).cast("long")
    return found.select("doc_id", *counts, F.sha2(pii.listing("base"), 256).alias("base_sha256"), pii.listing("base", "added").alias("spans"), every.alias("n_spans"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _rounds_sql(rounds: int) -> str:
    """CTEs: a<r>, the nearest entry of each part in book<r>, and book<r+1>, the means of what was nearest."""
    made = []
    for r in range(rounds + 1):
        made.append(f"""a{r} AS (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT vec_id, s.part, entry, list_sum(list_transform(list_zip(s.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts s JOIN book{r} b ON s.part = b.part) GROUP BY vec_id, part)""")
        if r < rounds:
            made.append(f"""m{r} AS (SELECT part, entry, i, sum(v) AS s, count(*) AS n FROM (SELECT a.part, a.entry, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{r} a JOIN parts USING (vec_id, part)) GROUP BY ALL)""")
            made.append(f"""book{r + 1} AS (SELECT b.part, b.entry, coalesce(x2, x) AS x FROM book{r} b LEFT JOIN (
  SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x2 FROM m{r} GROUP BY part, entry) u ON b.part = u.part AND b.entry = u.entry)""")
    return ",\n".join(made)


OP11_SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p AS part, v[1 + p * (len(v) // 16) : (p + 1) * (len(v) // 16)] AS x FROM kept, range(16) t(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64),
book0 AS (SELECT part, entry, x FROM parts JOIN first USING (vec_id)),
{_rounds_sql(vector_codes.ROUNDS)},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{vector_codes.ROUNDS} GROUP BY vec_id),
whole AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{vector_codes.ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), whole
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT concat(a.f, b.f, c.f, d.f, e.f) AS o FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT o, s AS step, bit, coalesce((SELECT sum(l.bit) FROM letters l WHERE contains(substr(o, 1, s - 1), l.f)), 0)::INTEGER AS before FROM orders, range(1, 6) t(s), letters WHERE f = substr(o, s, 1)),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
m AS (SELECT part, (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask,
  doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM d),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT part, o AS filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost
  FROM c, steps GROUP BY part, o, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM x
"""


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["high"] - s["low"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


OP13_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT item, w, least(10, len(w)) AS k FROM iw WHERE len(w) > 0))),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win)),
hits AS (SELECT doc_id, item, i, dp.k AS k FROM dp JOIN win ON dp.k = win.k AND win.s = array_to_string(w[i : i + dp.k - 1], ' ')),
marked AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items, sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)
"""


QUERIES = {"op5_lm": op5_lm, "op2_html": op2_html, "op10_pii": op10_pii, "op7_warc": op7_warc, "op6_quality": op6_quality, "op3_mixing": op3_mixing, "op9_language_id": op9_language_id, "op1_bpe": op1_bpe, "op4_exact_dedup": op4_exact_dedup, "op8_simhash": op8_simhash,
           "op11_vector_codes": op11_vector_codes, "op12_filter_audit": op12_filter_audit, "op13_decontamination": op13_decontamination}
ORACLES = {"op7_warc": OP7_SQL, "op4_exact_dedup": OP4_SQL, "op11_vector_codes": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_decontamination": OP13_SQL}
