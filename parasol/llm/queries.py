"""The registered queries of the operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from parasol.llm import bpe_trie, conversation_trie, decontaminate, exact_dedup, filter_audit, html_crf, licenses, mixing, pii, simhash, tokens, toxicity, warc
from parasol.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# A-Z only, as the contracts ask.
_SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle.strip()
        return fn
    return register


@query("op1_benchmark_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark phrases of 13 words in every document."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; 4-word shingles, at most 4 bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, max_bits=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op4_license_scans")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence. Its path is source/language/hundreds of its id/its id."""
    docs = table(spark, sf_dir, "documents")
    hundreds = F.floor(F.col("doc_id") / 100).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), hundreds, F.col("doc_id").cast("string"))
    found = licenses.license_scan(docs.select("doc_id", path.alias("path"), "text"))
    return found.withColumn("own_cosine", F.round("own_cosine", 6))


@query("op5_html_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_crf.main_text(table(spark, sf_dir, "pages"))


@query("op7_exact_dedup", f"""
WITH n AS (SELECT doc_id, sha256({_SQL_LOWER}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM n JOIN g USING (text_sha256)
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies of every document's text and the one that stays."""
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the public byte-level BPE; 1024 is the limit of its context."""
    import public_tokenizers

    found = tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                public_tokenizers.PATTERN)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query("op8_warc", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
 CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    found = warc.round_trip(spark, table(spark, sf_dir, "pages"), with_payload=False)
    checked = F.when(F.col("valid"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("a digest does not match")))
    return found.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


@query("op6_toxicity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_MIX_MARGINS = mixing.MARGINS


def _mixing_sql(rows: str, rounds: int = mixing.ROUNDS, seed: int = 1) -> str:
    """The mixture in SQL: one CTE per step of the fit."""
    parts = [f"""d AS (SELECT *, coalesce(source, '') AS s__, coalesce(lang, '') AS l__,
 len(regexp_extract_all(coalesce(text, ''), '[^ \t\r\n]+'))::BIGINT AS n_tokens,
 CASE WHEN contains(lower(coalesce(text, '')), 'license') OR contains(lower(coalesce(text, '')), 'licence')
        OR contains(lower(coalesce(text, '')), 'copyright') THEN 'legal'
      WHEN contains(coalesce(text, ''), '@') THEN 'contact'
      WHEN NOT regexp_matches(coalesce(text, ''), '[a-z]') THEN 'capitals' ELSE 'prose' END AS topic FROM ({rows}) x)""",
             "c AS (SELECT s__ AS source, l__ AS lang, topic, sum(n_tokens)::DOUBLE AS n FROM d GROUP BY ALL)"]
    for m, temper in mixing.TEMPER.items():
        parts += [f"t_{m} AS (SELECT {m}, n, CASE WHEN sum(pow(n, {temper})) OVER () > 0 THEN pow(n, {temper}) / sum(pow(n, {temper})) OVER () "
                  f"ELSE 0 END * sum(n) OVER () AS target FROM (SELECT {m}, sum(n) AS n FROM c GROUP BY 1))",
                  f"f_{m}_0 AS MATERIALIZED (SELECT {m}, 1.0::DOUBLE AS f FROM t_{m})"]
    done = dict.fromkeys(_MIX_MARGINS, 0)
    for _ in range(rounds):
        for m in _MIX_MARGINS:
            a, b = (x for x in _MIX_MARGINS if x != m)
            parts.append(f"f_{m}_{done[m] + 1} AS MATERIALIZED (SELECT {m}, CASE WHEN total > 0 THEN target / total ELSE 1 END AS f FROM t_{m} JOIN "
                         f"(SELECT {m}, sum(c.n * x.f * y.f) AS total FROM c JOIN f_{a}_{done[a]} x USING ({a}) JOIN f_{b}_{done[b]} y USING ({b}) GROUP BY 1) USING ({m}))")
            done[m] += 1
    joins = " ".join(f"JOIN f_{m}_{rounds} {m[0]}f USING ({m})" for m in _MIX_MARGINS)
    parts += [f"r AS (SELECT source, lang, topic, n, sf.f * lf.f * tf.f AS weight FROM c {joins})",
              "p AS (SELECT source, lang, topic, weight, least(1.0, coalesce(weight / (SELECT max(weight) FROM r WHERE n > 0), 1.0)) AS probability FROM r)",
              f"""m AS (SELECT d.*, p.weight, p.probability,
 ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < p.probability AS sampled
 FROM d JOIN p ON d.s__ = p.source AND d.l__ = p.lang AND d.topic = p.topic)"""]
    return "WITH " + ",\n".join(parts)


@query("op9_mixing", _mixing_sql("SELECT * FROM documents") + """
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(probability, 6) AS probability, sampled FROM m""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and whether the mixture takes it."""
    found = mixing.mixture(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"),
                        F.round("probability", 6).alias("probability"), "sampled")


@query("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms. The key is a demonstration's; a deployment brings its own."""
    found = pii.pseudonymise(table(spark, sf_dir, "documents"), key="demonstration key")
    return found.select("doc_id", "text", "n_values", "kinds")


@query("op13_bpe_trie")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding of every document under the public word BPE, and its decoding, as digests."""
    import public_tokenizers

    return bpe_trie.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


@query("op11_filter_audit", """
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
f AS (SELECT doc_id, part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
  + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
  + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS failed FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
s AS (SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x a, x b, x c, x d, x e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
p AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, bit,
  sum(n) FILTER (WHERE failed & (bit | earlier) = 0) AS kept, sum(n) FILTER (WHERE failed & bit > 0 AND failed & earlier = 0) AS removed,
  sum(n) FILTER (WHERE failed & bit > 0 AND failed & earlier > 0) AS redundant, sum(n) FILTER (WHERE failed = bit) AS unique_fails,
  sum(good) FILTER (WHERE failed & bit > 0 AND failed & earlier = 0) AS good_lost,
  sum(toxic) FILTER (WHERE failed & bit > 0 AND failed & earlier = 0) AS toxic_lost FROM s, p GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
 coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
 coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM r
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order, by language."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_conversation_trie", """
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place,
                  sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
                  strlen(coalesce(text, '')) AS n_bytes FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT c, count(*) AS n, list_transform(range(8 * length(c::VARCHAR)),
  lambda i: (ord(substr(c::VARCHAR, (i // 8 + 1)::INT, 1)) >> (i % 8)::INT) & 1) AS bits FROM t GROUP BY c),
m AS (SELECT c, n, c - c % 5 AS base, xor(4294967295, list_reduce(list_concat([4294967295], bits),
  lambda x, b: xor(x >> 1, 3988292384 * (xor(x, b) & 1)))) % 9 AS h FROM bits),
r AS (SELECT m.c, t.place AS depth, digest, n_bytes FROM m JOIN t ON t.c = m.base AND t.place <= m.h
  UNION ALL SELECT m.c, t.place - m.h + least(m.h, coalesce(b.n, 0)), digest, n_bytes
  FROM m JOIN t ON t.c = m.c AND t.place > m.h LEFT JOIN m b ON b.c = m.base),
k AS (SELECT c, depth, n_bytes, string_agg(digest, '') OVER (PARTITION BY c ORDER BY depth) AS key,
  depth = max(depth) OVER (PARTITION BY c) AS last FROM r
  UNION ALL SELECT c, 0, 0, '', c NOT IN (SELECT c FROM r) FROM m),
d AS (SELECT key, min(c) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(n_bytes) AS saved,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256 FROM k GROUP BY key),
p AS (SELECT d.*, u.conv_id AS parent_conv_id, u.key AS parent FROM d LEFT JOIN d u ON u.depth = d.depth - 1 AND u.key = left(d.key, 64 * (d.depth - 1)::INT)),
n AS (SELECT parent AS key, count(*) AS n_children FROM p WHERE parent IS NOT NULL GROUP BY 1),
s AS (SELECT up.key, sum(d.saved) AS saved_tokens, count(*) FILTER (WHERE n.key IS NULL) AS n_leaves
  FROM d LEFT JOIN n USING (key) JOIN k up ON up.c = d.conv_id AND up.depth <= d.depth GROUP BY 1)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
 saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM p LEFT JOIN n USING (key) JOIN s USING (key)
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return conversation_trie.prefix_trie(*conversation_trie.rebuilt(table(spark, sf_dir, "conversations")))
