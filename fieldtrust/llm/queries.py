"""The registered queries of this subpackage, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.llm import bpe, chat, embeddings, langid, merkle, minhash, negatives, ogg, packing, secrets, substring, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link(table(spark, sf_dir, "embeddings"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digest(table(spark, sf_dir, "documents"), tokenizer())


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), tokenizer())


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"), size=2)


#: The rules of the url query (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op7_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_digest(table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_digest(table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.train(documents)
    out = langid.predict(documents.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_digest(table(spark, sf_dir, "documents"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), label)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_digest(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model, keep=["doc_id"]).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


QUERIES = {
    f.__name__: f
    for f in (
        op1_embeddings, op2_packing, op3_bpe, op4_minhash, op5_urls, op6_chat, op7_ogg, op8_secrets, op9_langid, op10_substring,
        op11_negatives, op12_merkle, op13_toxicity,
    )
}

_LEAF = "sha256(" + " || ".join("coalesce(strlen({0}) || ':' || {0}, '-')".format(f"({c})::VARCHAR") for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
#: CRC-32 of a decimal id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, range(0, 8 * strlen(doc_id::VARCHAR))), lambda x, i:
  xor((CASE WHEN i % 8 = 0 THEN xor(x, ascii(substr(doc_id::VARCHAR, i // 8 + 1, 1))) ELSE x END) >> 1,
      CASE WHEN (CASE WHEN i % 8 = 0 THEN xor(x, ascii(substr(doc_id::VARCHAR, i // 8 + 1, 1))) ELSE x END) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""
_BESIDE = """SELECT k, grp, idx, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {levels} WHERE n > 1 WINDOW w AS (PARTITION BY k, grp, idx // 16 ORDER BY idx)"""
_CLIMB = """SELECT 0 AS k, grp, idx, n, digest FROM {nodes}
  UNION ALL SELECT k + 1, grp, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM {levels} WHERE n > 1 GROUP BY k, grp, idx // 16, n"""

ORACLES = {
    "op12_merkle": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '') AS grp, {_LEAF.format(text='text')} AS digest,
         CASE WHEN {_CRC} % 5 = 0 THEN {_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS now FROM documents
), a AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER () AS id FROM d
), lv AS ({_CLIMB.format(nodes='a', levels='lv')}),
t AS (SELECT 0 AS grp, grp AS name, digest, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM lv WHERE n = 1),
tv AS ({_CLIMB.format(nodes='t', levels='tv')}),
ls AS ({_BESIDE.format(levels='lv')}), ts AS ({_BESIDE.format(levels='tv')}),
st AS (
  SELECT id, k AS step, l, r FROM a JOIN ls ON ls.grp = a.grp AND ls.idx = a.idx >> (4 * k)
  UNION ALL SELECT id, 100 + k, l, r FROM a JOIN t ON t.name = a.grp JOIN ts ON ts.idx = t.idx >> (4 * k)
), pt AS (SELECT id, list({{'l': l, 'r': r}} ORDER BY step) AS path, string_agg(l || r, '' ORDER BY step) AS beside FROM st GROUP BY 1),
f AS (
  SELECT a.doc_id, a.digest AS leaf, t.digest AS subroot, (SELECT digest FROM tv WHERE n = 1) AS root, sha256(coalesce(beside, '')) AS proof_sha256,
         list_reduce(list_prepend({{'l': coalesce(now, a.digest), 'r': ''}}, coalesce(path, [])), lambda x, p: {{'l': sha256(p.l || x.l || p.r), 'r': ''}}).l AS folded_root
  FROM a JOIN t ON t.name = a.grp LEFT JOIN pt USING (id)
)
SELECT *, folded_root = root AS verified FROM f
""",
    "op11_negatives": """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, a.label = b.label AS alike, b.id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e AS a JOIN e AS b ON a.id % 100 = 0 AND a.id <> b.id
), p AS (
  SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * p.score <= 100 * s.score AND s.score <= p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 5
""",
    "op5_urls": r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM u
), r(h, q, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), f AS (
  SELECT page_id, host, path, h || q AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC) AS n
  FROM p LEFT JOIN r ON (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1
""",
    "op6_chat": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT conv_id, row_number() OVER w AS n,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER
           (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text) ROWS UNBOUNDED PRECEDING) AS prefix,
         lead(1) OVER w IS NULL AS whole
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))
), g AS (
  SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_copies, prefix FROM p WHERE whole GROUP BY n, prefix
)
SELECT conv_id, n_turns, n_copies, prefix AS rendered FROM g
WHERE NOT EXISTS (SELECT 1 FROM p WHERE NOT p.whole AND p.n = g.n_turns AND p.prefix = g.prefix)
""",
}
