"""Queries on alignment and integration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions.ranking import numbered
from corpusweave.functions.shared import written
from corpusweave.jobs.registry import query
from corpusweave.jobs.standins import BOOKS, CANDIDATE, EDGES, MERGE, NODES, RATIO, RUN, books, chapters, edges, nodes, vectors
from corpusweave.operators import align, encode, extract, graph, integrate

_KEY = "lower(regexp_replace(name, '[\\s\\-_/（）()【】\\[\\]《》,，.。:：;；]', '', 'g'))"

PAIRS_SQL = f"""c AS (SELECT label, embedding, min(vec_id) AS id FROM embeddings WHERE embedding IS NOT NULL GROUP BY label, embedding), pairs AS (
  SELECT a.id AS id_a, b.id AS id_b, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS sim
  FROM c a JOIN c b ON a.id < b.id AND a.label <> b.label
), near AS (SELECT * FROM pairs WHERE sim >= {CANDIDATE}), ranked AS (SELECT *, row_number() OVER (ORDER BY sim DESC, id_a, id_b) - 1 AS n FROM near)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.similarity_pairs(vectors(spark, sf_dir), CANDIDATE)


@query(f"WITH {PAIRS_SQL} SELECT * FROM near")
def similarity_pairs(spark, sf_dir):
    return pairs(spark, sf_dir)


@query(f"""WITH {PAIRS_SQL}, ends AS (SELECT id_a AS class_id, id_b AS other, sim FROM near UNION ALL SELECT id_b, id_a, sim FROM near)
SELECT class_id, count(*) AS links, min(other) AS first_link, max(sim) AS best_sim FROM ends GROUP BY 1""")
def similarity_counts(spark, sf_dir):
    return align.similarity_counts(vectors(spark, sf_dir), CANDIDATE)


# Nodes to likeness: their texts through the encoder, then the join of books. Vectors are equal where their entries are.
_TEXT_TOK = "list_filter(list_transform(regexp_extract_all(name || '：' || substr(definition, 1, 200), '([A-Za-z0-9]+)', 1), lambda t: lower(t)), lambda t: length(t) > 1)"
NODE_LIKENESS = 0.97


@query(f"""WITH {NODES}, tok AS (SELECT id, textbook_id, unnest({_TEXT_TOK}) AS token FROM nodes
), h AS (SELECT id, textbook_id, ('0x' || substr(md5(token), 1, 8))::BIGINT AS h FROM tok
), v AS (SELECT id, textbook_id, (h // 2) % 512 AS d, sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS v FROM h GROUP BY ALL HAVING v <> 0
), norm AS (SELECT id, textbook_id, sqrt(sum(v * v)) AS n, list((d, v / 1) ORDER BY d) AS entries FROM v GROUP BY 1, 2
), unit AS (SELECT v.id, v.textbook_id, d, v / n AS v FROM v JOIN norm USING (id)
), shape AS (SELECT textbook_id, id, list((d, v) ORDER BY d) AS entries FROM unit GROUP BY ALL
), class AS (SELECT textbook_id, entries, min(id) AS id FROM shape GROUP BY ALL
), u AS (SELECT unit.* FROM unit JOIN class USING (id)
), sims AS (SELECT a.id AS id_a, b.id AS id_b, round(sum(a.v * b.v), 6) AS sim FROM u a JOIN u b ON a.d = b.d AND a.id < b.id AND a.textbook_id <> b.textbook_id GROUP BY ALL)
SELECT * FROM sims WHERE sim >= {NODE_LIKENESS}""")
def node_pairs(spark, sf_dir):
    n = nodes(spark, sf_dir)
    encoded = written(encode.encode(n.select("id", F.col("textbook_id").alias("group_id"), align.node_text(F.col("name"), F.col("definition")).alias("t")), "t").select("id", "group_id", "embedding"))
    # the zero vector of a text without words is like nothing
    return align.similarity_pairs(encoded, NODE_LIKENESS)


@query("SELECT vec_id AS id, label AS group_id, min(vec_id) OVER (PARTITION BY label, embedding) AS class_id FROM embeddings WHERE embedding IS NOT NULL")
def similarity_classes(spark, sf_dir):
    return align.similarity_classes(vectors(spark, sf_dir))


@query(f"WITH {PAIRS_SQL} SELECT * FROM near WHERE sim >= {MERGE}")
def auto_merge_pairs(spark, sf_dir):
    return align.auto_merged(pairs(spark, sf_dir), MERGE)


# Verdicts: pair n is the same, related or different by n modulo 3, surer the larger n modulo 5.
_VERDICT = "CASE n % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'related' ELSE 'different' END"


def ranked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(pairs(spark, sf_dir), "n", F.desc("sim"), F.col("id_a"), F.col("id_b"))


def verdicts(ranked: DataFrame) -> DataFrame:
    """Of ranked pairs, parsed from answers in batches of five, as a judge would give them."""
    item = F.struct(F.concat(F.lit("p"), F.col("n").cast("string")).alias("pair_id"), F.upper(F.expr(_VERDICT)).alias("verdict"), F.format_string("%.1f", F.col("n") % 5 / 10 + 0.55).alias("confidence"), F.lit("because").alias("reason"))
    answers = ranked.groupBy(F.floor(F.col("n") / 5).alias("batch")).agg(F.to_json(F.sort_array(F.collect_list(item))).alias("j"))
    fenced = F.when(F.col("batch") % 7 == 6, F.lit("no answer")).otherwise(F.concat(F.lit("```json\n"), "j", F.lit("\n```")))
    return align.judgments(answers.select("batch", fenced.alias("response")))


_JUDGED_SQL = f"""{PAIRS_SQL}, verdicts AS (
  SELECT 'p' || n AS pair_id, {_VERDICT} AS verdict, printf('%.1f', (n % 5) / 10 + 0.55)::DOUBLE AS confidence, 'because' AS reason FROM ranked WHERE (n // 5) % 7 <> 6
)"""


@query(f"WITH {_JUDGED_SQL} SELECT * FROM verdicts")
def judgments(spark, sf_dir):
    return verdicts(ranked_pairs(spark, sf_dir))


@query(f"WITH {_JUDGED_SQL} SELECT 'p' || n AS pair_id, id_a, id_b, sim FROM ranked WHERE 'p' || n IN (SELECT pair_id FROM verdicts WHERE verdict = 'same' AND confidence >= 0.7)")
def judged_pairs(spark, sf_dir):
    # found and ranked once, for the names and for the verdicts
    ranked = written(ranked_pairs(spark, sf_dir))
    named = ranked.select(F.concat(F.lit("p"), F.col("n").cast("string")).alias("pair_id"), "id_a", "id_b", "sim")
    return align.judged_same(named, verdicts(ranked))


@query(f"""WITH {PAIRS_SQL}, s AS (
  SELECT n, 'pair_id=p' || n || ' (sim=' || printf('%.2f', sim) || ')' || chr(10) || '  A: 「vector ' || id_a || '」 来源=《Group ' || a.label || '》' || chr(10) || '     定义: about ' || id_a || chr(10) || '  B: 「vector ' || id_b || '」 来源=《Group ' || b.label || '》' || chr(10) || '     定义: about ' || id_b AS t
  FROM ranked JOIN embeddings a ON a.vec_id = id_a JOIN embeddings b ON b.vec_id = id_b
) SELECT n // 5 AS batch, list('p' || n ORDER BY n) AS pair_ids, string_agg(t, chr(10) || chr(10) ORDER BY n) AS prompt FROM s GROUP BY 1""")
def judge_batches(spark, sf_dir):
    v = vectors(spark, sf_dir)
    named = v.select("id", F.concat(F.lit("vector "), F.col("id").cast("string")).alias("name"), F.concat(F.lit("about "), F.col("id").cast("string")).alias("definition"), F.lit("").alias("chapter_title"), F.concat(F.lit("Group "), F.col("group_id").cast("string")).alias("textbook_id"))
    return align.judge_batches(pairs(spark, sf_dir), named)


def _closure(links: str, name: str = "closed") -> str:
    """A recursive query of (id, cluster_id) over links (a, b)."""
    return f"""sym AS (SELECT a, b FROM ({links}) UNION SELECT b, a FROM ({links})), reach(id, r) AS (
  SELECT a, a FROM sym UNION SELECT reach.id, sym.b FROM reach JOIN sym ON sym.a = reach.r
), {name} AS (SELECT id, min(r) AS cluster_id FROM reach GROUP BY id)"""


@query(f"WITH RECURSIVE {PAIRS_SQL}, {_closure('SELECT id_a AS a, id_b AS b FROM near')} SELECT * FROM closed")
def semantic_clusters(spark, sf_dir):
    return align.clusters(pairs(spark, sf_dir))


LEXICAL_SQL = f"""keyed AS (SELECT id, textbook_id, {_KEY} AS k FROM nodes), groups AS (
  SELECT k, min(id) AS cluster_id FROM keyed WHERE length(k) >= 2 GROUP BY k HAVING count(DISTINCT textbook_id) >= 2
), lexical AS (SELECT id, cluster_id FROM keyed JOIN groups USING (k))"""


@query(f"WITH {NODES}, {LEXICAL_SQL} SELECT * FROM lexical")
def lexical_clusters(spark, sf_dir):
    return align.lexical_clusters(nodes(spark, sf_dir))


# Semantic links of nodes: the first nodes of chapters whose documents' vectors are near.
_LINKS_SQL = f"""heads AS (SELECT id, substr(chapter_id, 4)::BIGINT AS doc FROM nodes WHERE rank = 1), linked AS (
  SELECT a.id AS id_a, b.id AS id_b FROM near JOIN heads a ON a.doc = near.id_a JOIN heads b ON b.doc = near.id_b
)"""
_COMBINED_SQL = f"""WITH RECURSIVE {NODES}, {LEXICAL_SQL}, {PAIRS_SQL.replace(' c ', ' cl ').replace('c AS (', 'cl AS (', 1)}, {_LINKS_SQL},
step AS (SELECT DISTINCT coalesce(x.cluster_id, id_a) AS a, coalesce(y.cluster_id, id_b) AS b FROM linked LEFT JOIN lexical x ON x.id = id_a LEFT JOIN lexical y ON y.id = id_b),
{_closure("SELECT a, b FROM step UNION SELECT cluster_id, cluster_id FROM lexical")}, members AS (
  SELECT id, cluster_id AS g FROM lexical UNION SELECT id_a, coalesce(x.cluster_id, id_a) FROM linked LEFT JOIN lexical x ON x.id = id_a UNION SELECT id_b, coalesce(x.cluster_id, id_b) FROM linked LEFT JOIN lexical x ON x.id = id_b
), joined AS (SELECT m.id, c.cluster_id AS root FROM members m JOIN closed c ON c.id = m.g), combined AS (SELECT id, min(id) OVER (PARTITION BY root) AS cluster_id FROM joined)"""


def node_links(spark: SparkSession, sf_dir: str, n: DataFrame) -> DataFrame:
    first = n.filter("rank = 1").select("id", F.expr("cast(substring(chapter_id, 4) as bigint)").alias("doc"))
    a, b = first.withColumnsRenamed({"id": "a", "doc": "id_a"}), first.withColumnsRenamed({"id": "b", "doc": "id_b"})
    return pairs(spark, sf_dir).join(a, "id_a").join(b, "id_b").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))


@query(f"{_COMBINED_SQL} SELECT * FROM combined")
def combined_clusters(spark, sf_dir):
    n = written(nodes(spark, sf_dir))
    return align.combined_clusters(n, node_links(spark, sf_dir, n))


@query(f"WITH RECURSIVE {PAIRS_SQL}, {_closure(f'SELECT id_a AS a, id_b AS b FROM near WHERE sim >= {MERGE}')} SELECT (SELECT count(*) FROM near) AS candidate_pairs, (SELECT count(*) FROM near WHERE sim >= {MERGE}) AS same_pairs, (SELECT count(DISTINCT cluster_id) FROM closed) AS clusters")
def alignment_summary(spark, sf_dir):
    p = written(pairs(spark, sf_dir))
    same = align.auto_merged(p, MERGE)
    return align.alignment_summary(p, same, align.clusters(same))


# ---- integration, on lexical clusters -------------------------------------------------------

WEIGHTED_SQL = f"""{EDGES}, deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id
), weighted AS (
  SELECT n.*, coalesce(degree, 0) AS degree, round(coalesce(degree, 0) * 0.45::DOUBLE + least(length(definition), 220) / 220 * 0.35::DOUBLE + CASE WHEN length(trim(definition)) >= 12 THEN 0.2::DOUBLE ELSE 0 END, 9) AS importance FROM nodes n LEFT JOIN deg USING (id)
)"""


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = written(nodes(spark, sf_dir))
    return integrate.weighted(n, extract.rule_edges(n))


@query(f"WITH {WEIGHTED_SQL} SELECT id, degree, importance FROM weighted")
def importance(spark, sf_dir):
    return weighted(spark, sf_dir).select("id", "degree", "importance")


BEST_SQL = f"""{WEIGHTED_SQL}, {LEXICAL_SQL}, best AS (
  SELECT cluster_id, first(id ORDER BY importance DESC, id) AS canonical_id, count(*) AS members FROM lexical JOIN weighted USING (id) GROUP BY cluster_id
)"""


@query(f"WITH {BEST_SQL} SELECT * FROM best")
def canonical_nodes(spark, sf_dir):
    n = weighted(spark, sf_dir)
    return integrate.canonical(n, align.lexical_clusters(n))


def _excerpt_sql(limit: int) -> str:
    return f"""CASE WHEN length(t) = 0 THEN substr(definition, 1, {limit}) WHEN strpos(t, name) > 0 THEN substr(t, greatest(1, strpos(t, name) - {limit // 3}), {limit})
    WHEN length(definition) > 0 AND strpos(t, substr(definition, 1, 20)) > 0 THEN substr(t, greatest(1, strpos(t, substr(definition, 1, 20)) - {limit // 3}), {limit}) ELSE substr(t, 1, {limit}) END"""


_TEXT_SQL = "SELECT w.*, trim(regexp_replace(c.content, '\\s+', ' ', 'g')) AS t FROM weighted w JOIN chapters c USING (textbook_id, chapter_id)"
_REF = "textbook_id || ':' || chapter_id || ':p' || page || ':' || name"

MERGES_SQL = f"""{BEST_SQL}, {BOOKS}, labels AS (
  SELECT cluster_id, b.title, min(l.id) AS f FROM lexical l JOIN nodes n ON n.id = l.id JOIN books b ON b.textbook_id = n.textbook_id GROUP BY 1, 2
), titles AS (SELECT cluster_id, string_agg('《' || title || '》', '、' ORDER BY f, title) AS b FROM labels GROUP BY 1
), names AS (SELECT cluster_id, string_agg(x, ' / ' ORDER BY x) AS n, count(DISTINCT k) AS keys FROM (SELECT DISTINCT cluster_id, '[[' || name || ']]' AS x, {_KEY} AS k FROM lexical JOIN nodes USING (id)) GROUP BY 1
), ct AS ({_TEXT_SQL}), merges AS (
  SELECT printf('{RUN}_merge_%04d', row_number() OVER (ORDER BY cluster_id)) AS decision_id, 'merge' AS action, cluster_id, members, ct.id AS result_node, {_REF} AS result_ref, {_excerpt_sql(900)} AS source_excerpt,
    b || ' 中的 ' || names.n || ' 被判定为同一或高度等价概念；保留 [[' || name || ']] 所在原文，因为其定义更完整、图谱连接度更高。' AS reason, CASE WHEN keys = 1 THEN 0.86::DOUBLE ELSE 0.78::DOUBLE END AS confidence
  FROM best JOIN ct ON ct.id = canonical_id JOIN titles USING (cluster_id) JOIN names USING (cluster_id)
)"""


def merges(spark: SparkSession, sf_dir: str, n: DataFrame, found: DataFrame) -> DataFrame:
    return integrate.merge_decisions(RUN, n, found, chapters(spark, sf_dir), books(spark, sf_dir))


@query(f"WITH {MERGES_SQL} SELECT * FROM merges")
def merge_decisions(spark, sf_dir):
    n = written(weighted(spark, sf_dir))
    return merges(spark, sf_dir, n, align.lexical_clusters(n))


@query(f"WITH RECURSIVE {_JUDGED_SQL.replace(' c ', ' cl ').replace('c AS (', 'cl AS (', 1)}, {NODES}, {LEXICAL_SQL}, m AS (SELECT avg(confidence) AS m FROM verdicts WHERE verdict = 'same') SELECT DISTINCT cluster_id, round(greatest(0.86, m), 3)::DOUBLE AS confidence FROM lexical, m")
def merge_confidence(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return integrate.merge_confidence(n, align.lexical_clusters(n), verdicts(ranked_pairs(spark, sf_dir)))


DECISIONS_SQL = f"""{MERGES_SQL}, uniq AS (
  SELECT ct.*, row_number() OVER (ORDER BY importance DESC, id) AS r, {_excerpt_sql(650)} AS ex FROM ct WHERE id NOT IN (SELECT id FROM lexical)
), room AS (SELECT greatest(1, floor(sum(total_chars) * {RATIO}))::BIGINT - (SELECT coalesce(sum(length(source_excerpt)), 0) FROM merges)::BIGINT AS room FROM books
), scan(r, used, kept) AS (
  SELECT 0::BIGINT, 0::BIGINT, false UNION ALL
  SELECT u.r, CASE WHEN used + length(ex) <= room THEN used + length(ex) ELSE used END, used + length(ex) <= room FROM scan JOIN uniq u ON u.r = scan.r + 1, room
), chosen AS (SELECT u.*, kept FROM uniq u JOIN scan USING (r)), budgeted AS (
  SELECT printf('{RUN}_keep_%04d', row_number() OVER (ORDER BY r)) AS decision_id, 'keep' AS action, NULL::VARCHAR AS cluster_id, 1::BIGINT AS members, id AS result_node, {_REF} AS result_ref, ex AS source_excerpt,
    '[[' || name || ']] 暂未发现跨教材等价节点，作为独有知识点保留原文摘录。' AS reason, 0.82::DOUBLE AS confidence FROM chosen WHERE kept
  UNION ALL SELECT printf('{RUN}_remove_%04d', row_number() OVER (ORDER BY r)), 'remove', NULL, 1, NULL, NULL, '', '[[' || name || ']] 当前重要度低于已保留节点，为满足 30% 压缩预算暂不纳入精华版本。', 0.74::DOUBLE FROM chosen WHERE NOT kept
), decisions AS (SELECT * FROM merges UNION ALL SELECT * FROM budgeted), listing AS (
  SELECT *, row_number() OVER (ORDER BY CASE action WHEN 'merge' THEN 0 WHEN 'keep' THEN 1 ELSE 2 END, confidence DESC, decision_id) - 1 AS position FROM decisions
)"""


def decisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions, nodes, books) of the run."""
    n, b, c = written(weighted(spark, sf_dir)), books(spark, sf_dir), chapters(spark, sf_dir)
    found = written(align.lexical_clusters(n))
    merged = written(merges(spark, sf_dir, n, found))
    rest = integrate.budget_decisions(RUN, n, found, merged, c, b, RATIO)
    return written(merged.unionByName(rest)), n, b


@query(f"WITH RECURSIVE {DECISIONS_SQL} SELECT * FROM budgeted")
def budget_decisions(spark, sf_dir):
    return decisions(spark, sf_dir)[0].filter("action <> 'merge'")


@query(f"WITH RECURSIVE {DECISIONS_SQL} SELECT decision_id, position FROM listing")
def decision_order(spark, sf_dir):
    return integrate.decision_listing(decisions(spark, sf_dir)[0]).select("decision_id", "position")


STATS_SQL = f"""{DECISIONS_SQL}, stats AS (
  SELECT count(*) FILTER (WHERE action = 'merge') AS decisions_merge, count(*) FILTER (WHERE action = 'keep') AS decisions_keep, count(*) FILTER (WHERE action = 'remove') AS decisions_remove,
    coalesce(sum(length(source_excerpt)), 0)::BIGINT AS merged_chars, count(result_node) AS merged_nodes, (SELECT count(*) FROM books) AS original_textbooks, (SELECT sum(total_chars)::BIGINT FROM books) AS original_chars, (SELECT count(*) FROM nodes) AS original_nodes FROM decisions
)"""


@query(f"WITH RECURSIVE {STATS_SQL} SELECT *, round(merged_chars / original_chars, 6) AS compression_ratio FROM stats")
def run_stats(spark, sf_dir):
    return integrate.run_stats(*decisions(spark, sf_dir))


@query(f"WITH RECURSIVE {DECISIONS_SQL} SELECT '{RUN}' AS run_id, count(*) FILTER (WHERE action = 'merge') AS n_merge, count(*) FILTER (WHERE action = 'keep') AS n_keep, count(*) FILTER (WHERE action = 'remove') AS n_remove FROM decisions")
def action_counts(spark, sf_dir):
    return integrate.action_counts(decisions(spark, sf_dir)[0].withColumn("run_id", F.lit(RUN)))


@query(f"""WITH RECURSIVE {DECISIONS_SQL}, c AS (SELECT count(*) FILTER (WHERE action = 'merge') AS m, count(*) FILTER (WHERE action = 'keep') AS k, count(*) FILTER (WHERE action = 'remove') AS r FROM decisions)
SELECT '{RUN}' AS run_id, f.source, f.target, greatest(1, f.v) AS value FROM c, LATERAL (VALUES ('all', 'merge', m), ('all', 'keep', k), ('all', 'remove', r), ('merge', 'kept', m), ('keep', 'kept', k), ('remove', 'dropped', r)) f(source, target, v)""")
def flow_table(spark, sf_dir):
    return integrate.flow_table(integrate.action_counts(decisions(spark, sf_dir)[0].withColumn("run_id", F.lit(RUN))))


# Patches: every third decision by position becomes keep; every sixth of them has a reason, every ninth a confidence.
@query(f"""WITH RECURSIVE {DECISIONS_SQL} SELECT decision_id, CASE WHEN position % 3 = 0 THEN 'keep' ELSE action END AS action, CASE WHEN position % 6 = 0 THEN 'better so（教师手动覆盖，原理由：' || reason || '）' ELSE reason END AS reason,
CASE WHEN position % 9 = 0 THEN 0.5::DOUBLE WHEN position % 3 = 0 THEN 0.97::DOUBLE ELSE confidence END AS confidence FROM listing""")
def manual_override(spark, sf_dir):
    listing = written(integrate.decision_listing(decisions(spark, sf_dir)[0]))
    p = F.col("position")
    patches = listing.filter(p % 3 == 0).select("decision_id", F.lit("keep").alias("action"), F.when(p % 6 == 0, "better so").alias("reason"), F.when(p % 9 == 0, 0.5).alias("confidence"))
    unknown = listing.filter(p % 3 == 1).select("decision_id", F.lit("burn").alias("action"), F.lit("x").alias("reason"), F.lit(0.1).alias("confidence"))
    return integrate.manual_override(listing, patches.unionByName(unknown)).select("decision_id", "action", "reason", "confidence")


# Runs: one per customer nation, updated when its newest order was placed.
_RUNS = "SELECT 'run_' || c_nationkey AS run_id, max(o_orderdate)::TIMESTAMP AS updated_at, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey"


@query(f"SELECT * FROM ({_RUNS}) ORDER BY updated_at DESC, run_id DESC LIMIT 1")
def latest_run(spark, sf_dir):
    o, c = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    runs = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.concat(F.lit("run_"), F.col("c_nationkey").cast("string")).alias("run_id")).agg(F.max("o_orderdate").cast("timestamp").alias("updated_at"), F.count("*").alias("n"))
    return integrate.latest_run(runs)


@query(f"""WITH RECURSIVE {STATS_SQL}, lines AS (SELECT string_agg('- [[' || n.name || ']]：' || reason, chr(10) ORDER BY position) AS body FROM listing JOIN nodes n ON n.id = result_node WHERE action = 'merge' AND position < 30)
SELECT '# 知识点进化总结 ' || (SELECT substr(md5(string_agg(textbook_id, '|' ORDER BY textbook_id)), 1, 8) FROM books) || chr(10) || chr(10) || '本次整合覆盖 ' || original_textbooks || ' 本教材、' || original_nodes || ' 个知识点；' || chr(10) || '保留原文摘录 ' || merged_chars || ' 字，压缩比 ' || printf('%.1f', round(merged_chars / original_chars, 6) * 100) || '%。' || chr(10) || chr(10) || '## 双链概览' || chr(10) || coalesce(body, '') AS summary_markdown FROM stats, lines""")
def run_summary(spark, sf_dir):
    d, n, b = decisions(spark, sf_dir)
    return integrate.run_summary(integrate.decision_listing(d), integrate.run_stats(d, n, b), b, n)


@query(f"WITH RECURSIVE {DECISIONS_SQL} SELECT position, source_excerpt || chr(10) || chr(10) || '> 来源：' || result_ref AS line FROM listing WHERE action <> 'remove' AND length(source_excerpt) > 0")
def condensed_edition(spark, sf_dir):
    return integrate.condensed_edition(integrate.decision_listing(decisions(spark, sf_dir)[0]))


@query(f"WITH {NODES}, {BOOKS}, d AS (SELECT textbook_id FROM books WHERE total_chars % 3 <> 0) SELECT textbook_id, count(*) AS nodes FROM nodes WHERE textbook_id IN (SELECT textbook_id FROM d) GROUP BY 1")
def eligible_inputs(spark, sf_dir):
    """Books whose characters divide by three are not finished yet."""
    b = books(spark, sf_dir).withColumn("parse_status", F.when(F.col("total_chars") % 3 == 0, "parsing").otherwise("done"))
    return integrate.eligible(b, nodes(spark, sf_dir))[1].groupBy("textbook_id").agg(F.count("*").alias("nodes"))


@query(f"WITH {EDGES} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id")
def node_degrees(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir))
