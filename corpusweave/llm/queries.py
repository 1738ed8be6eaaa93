"""The registered query of each operator: production parameters, whole tables.

QUERIES maps a name to f(spark, sf_dir); ORACLES maps a name to DuckDB SQL where SQL can express it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusweave.sources.readers import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op7_sentencepiece_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpusweave.llm import pieces

    docs = table(spark, sf_dir, "documents")
    return pieces.digests(pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decode=True))


@query
def op1_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm import naming

    return naming.exact_groups(table(spark, sf_dir, "documents"))


ORACLES["op1_block_naming"] = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

SHARD_BYTES = 1 << 20


@query
def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm import shards

    return shards.assign(table(spark, sf_dir, "documents"), SHARD_BYTES)


ORACLES["op5_extendible_shards"] = f"""
WITH d AS (
  SELECT doc_id, ('0x' || substr(md5(cast(doc_id AS VARCHAR)), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0) AS size FROM documents
), e AS (
  SELECT doc_id, h, size, depth::INT AS depth, (h >> (60 - depth)::INT) AS prefix FROM d, range(0, 31) r(depth)
), s AS (
  SELECT depth, prefix, sum(size)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM e GROUP BY ALL
), fits AS (
  SELECT e.doc_id, s.*, row_number() OVER (PARTITION BY e.doc_id ORDER BY depth) AS k
  FROM e JOIN s USING (depth, prefix) WHERE s.shard_bytes <= {SHARD_BYTES}
)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth, shard_bytes, shard_docs, false AS oversized
FROM fits WHERE k = 1
"""


@query
def op10_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm import chat

    return chat.render(table(spark, sf_dir, "conversations"))


ORACLES["op10_chat_snapshots"] = r"""
WITH t AS (
  SELECT conv_id, turn, row_number() OVER w AS pos, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, '')))
), p AS (
  SELECT conv_id, pos, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY pos) AS pre, count(*) OVER (PARTITION BY conv_id) AS n FROM t
), f AS (SELECT n, pre, min(conv_id) AS conv_id FROM p WHERE pos = n GROUP BY n, pre),
k AS (SELECT conv_id, n FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos = f.n AND p.n > f.n AND p.pre = f.pre))
SELECT conv_id, pos, n AS n_turns, line AS rendered FROM t JOIN k USING (conv_id)
"""


@query
def op3_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm import languages

    return languages.identify(table(spark, sf_dir, "documents"))


@query
def op9_licence_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm import licences

    return licences.scan(table(spark, sf_dir, "documents"))


@query
def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from corpusweave.llm import simhash

    rows = simhash.components(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm import passages

    return passages.dedup_passages(table(spark, sf_dir, "documents")).drop("kept")


ORACLES["op6_fm_index"] = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS seq FROM d, unnest(range(1, greatest(len(w) - 33, 1))) u(i)
), r AS (SELECT doc_id, i FROM s WHERE seq IN (SELECT seq FROM s GROUP BY seq HAVING count(*) > 1)
), c AS (SELECT DISTINCT doc_id, i + k AS p FROM r, range(0, 35) t(k)
), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d
), k AS (
  SELECT p.doc_id, count(*) - count(c.p) AS kept, string_agg(w[p.p], ' ' ORDER BY p.p) FILTER (WHERE c.p IS NULL) AS t
  FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.p = p.p GROUP BY p.doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


@query
def op8_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm import leaks

    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm import whiten

    rows, fitted = whiten.whiten(table(spark, sf_dir, "embeddings"))
    return whiten.by_component(rows, fitted)


@query
def op12_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm import tiers

    index = tiers.build(table(spark, sf_dir, "documents"))
    return tiers.search(index, table(spark, sf_dir, "benchmark")).drop("tier")


ORACLES["op12_tiered_search"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), s AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d
), p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t
), f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t, n_docs
), q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), m AS (SELECT r, doc_id, 50 + (50 * len(ts) * n_docs) // n_terms AS m FROM d, s
), c AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN f USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY ALL
), k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r)::INT AS rank FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 50
"""


@query
def op11_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.llm import suffixes

    return suffixes.dedup_bytes(table(spark, sf_dir, "documents")).drop("kept")


# bytes as hexadecimal digits, in pieces of 1000 bytes with a window less one in common
ORACLES["op11_suffix_groups"] = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents
), pieces AS (
  SELECT r, p, substr(h, p * 2000 + 1, 2398) AS x FROM d, unnest(range(0, len(h) // 2000 + 1)) t(p)
), windows AS (
  SELECT r, p * 1000 + i AS b, md5(substr(x, 2 * i + 1, 400)) AS w FROM pieces, unnest(range(0, greatest(0, least(1000, len(x) // 2 - 199)))) t(i)
), repeated AS (SELECT r, b FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)
), marked AS (SELECT r, b, CASE WHEN b > lag(b) OVER (PARTITION BY r ORDER BY b) + 200 OR lag(b) OVER (PARTITION BY r ORDER BY b) IS NULL THEN 1 ELSE 0 END AS new FROM repeated
), numbered AS (SELECT r, b, sum(new) OVER (PARTITION BY r ORDER BY b) AS k FROM marked
), runs AS (SELECT r, k, min(b) AS low, max(b) + 200 AS high FROM numbered GROUP BY r, k
), gaps AS (
  SELECT r, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS a, low AS z FROM runs
  UNION ALL SELECT r, max(high), NULL FROM runs GROUP BY r
), kept AS (
  SELECT r, string_agg(CASE WHEN z IS NULL THEN substr(h, 2 * a + 1) ELSE substr(h, 2 * a + 1, 2 * (z - a)) END, '' ORDER BY a) AS x FROM gaps JOIN d USING (r) GROUP BY r
), sums AS (SELECT r, sum(high - low)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(x, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN sums USING (r)
"""
