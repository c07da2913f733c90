"""One registered query per operator: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemill.llm import (
    bpe, centroids, chat, covertree, fingerprints, huffman, minhash, packing, pivots, spelling, substrings, suffixes, toxicity,
)
from stridemill.plans.registry import table

QUERIES = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def twin(sql: str):
    """Register a query together with SQL that gives the same rows."""

    def register(fn):
        SQL[fn.__name__] = sql
        return query(fn)

    return register


@twin(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
windows AS (SELECT doc_id, w, unnest(range(len(w) - 19)) AS s FROM d WHERE len(w) >= 20),
keyed AS (SELECT doc_id, s, sha256(array_to_string(w[s + 1 : s + 20], ' ')) AS k FROM windows),
placed AS (SELECT doc_id, s, min({'doc_id': doc_id, 's': s}) OVER (PARTITION BY k) AS first FROM keyed),
gone AS (SELECT DISTINCT doc_id, s + i AS p FROM placed, range(20) t(i) WHERE {'doc_id': doc_id, 's': s} > first),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d),
kept AS (
  SELECT doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS text
  FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""")
def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words left after the removal of repeated windows of 20 words, all documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = substrings.remove_repeated_windows(docs, window=20)
    return out.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


@query
def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in pieces, packed into sequences of 512 to 4,096 words."""
    return packing.pack_documents(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A toxicity score for every document, learnt from the labels that are not held out."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit_on_labels(docs, labels))
    return scored.select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query
def op1_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate class of every document, and the one that stays."""
    return minhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


@twin("""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id AND len(a.q) = len(b.q))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
""")
def op3_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best rows for every vector whose id is divisible by 100."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return covertree.top_k(rows, F.col("vec_id") % 100 == 0, 10)


@twin("""
WITH RECURSIVE u AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
n AS (SELECT vec_id, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS size FROM u),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE a.size > 0 AND b.size > 0 AND list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) / (a.size * b.size) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, min(r.b) AS component_id, min(r.b) = e.vec_id AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id
""")
def op7_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.95."""
    return pivots.linked_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding"))


@query
def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all conversations and one of control strings, read back from their formatted text."""
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id LONG, turn LONG, role STRING, text STRING")
    return chat.read_back(chat.format_conversations(turns.unionByName(more)))


@query
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """All documents encoded, then decoded again from their ids."""
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), path)
    return bpe.decode(coded, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents with an end mark, written to Huffman-coded files and read back."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = huffman.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes left after the removal of strings of 200 bytes that stand elsewhere too, all documents."""
    out = suffixes.remove_repeated_bytes(table(spark, folder, "documents").select("doc_id", "text"), length=200)
    return out.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op11_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they and the next ones are."""
    out = fingerprints.compare_with_next(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


#: Checksums are worked out byte by byte from a table that a rule makes; words meet where one letter is left out.
_SPELLING = r"""
WITH RECURSIVE bits AS (SELECT i AS k, i::BIGINT AS c FROM range(256) t(i)),
crc AS (
  SELECT list(list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y:
         CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY k) AS t FROM bits),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
each AS (SELECT d, w, hex(encode(d || ':' || w)) AS bytes, count(*) AS n FROM runs WHERE length(w) >= 5 GROUP BY d, w),
hashed AS (
  SELECT w, n, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len(bytes), 2),
         lambda i: ('0x' || substr(bytes, i, 2))::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM each, crc),
words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word,
         sum(n)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
shelves AS (
  SELECT word, n, unnest(list_distinct([word] || list_transform(range(1, length(word) + 1),
         lambda i: substr(word, 1, i - 1) || substr(word, i + 1)))) AS shelf FROM words),
pairs AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM shelves a JOIN shelves b USING (shelf) WHERE a.word <> b.word),
near AS (
  SELECT word, near, near_n FROM pairs WHERE abs(length(word) - length(near)) <= 1 AND (length(word) <> length(near)
    OR len(list_filter(range(1, length(word) + 1), lambda i: substr(word, i, 1) <> substr(near, i, 1))) = 1)),
best AS (SELECT word, count(*) AS n_near, min({'less': -near_n, 'near': near}) AS b FROM near GROUP BY word),
f AS (
  SELECT w.word, w.n, CASE WHEN -b.less >= 2 * w.n THEN b.near END AS form, coalesce(n_near, 0)::BIGINT AS n_near,
         CASE WHEN -b.less >= 2 * w.n THEN -b.less END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT w.word, f.form FROM walk w JOIN f ON f.word = w.at WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.form, w.at AS root, f.n_near, f.form_n
FROM f JOIN walk w USING (word) JOIN f last ON last.word = w.at AND last.form IS NULL
"""


@twin(_SPELLING)
def op12_spelling_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents, some with a letter left out, and the spelling that each belongs to."""
    return spelling.spelling_groups(table(spark, folder, "documents").select("doc_id", "text"))


def _cluster_sql(rounds: int) -> str:
    """Centroid clustering with all distances compared, round by round."""
    square = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [
        """kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        """c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, q FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id)) <= 40)""",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"a{k} AS (SELECT v.vec_id, v.q, c.c, {square} AS distance FROM kept v, c{k} c "
            "QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY distance, c.c) = 1)"
        )
        if k < rounds:
            steps.append(
                f"""p{k} AS (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{k}),
m{k} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS q
  FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM p{k} GROUP BY c, i) GROUP BY c),
c{k + 1} AS (SELECT c, coalesce(m.q, c.q) AS q FROM c{k} c LEFT JOIN m{k} m USING (c))"""
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.c::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (c)"""


@twin(_cluster_sql(5))
def op13_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Forty clusters of all vectors after five rounds in integers."""
    out = centroids.cluster_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    return out.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroids.centroid_digest().alias("centroid_sha256")
    )
