"""Queries on segmentation, extraction and the graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions.shared import shared_dir, written
from corpusweave.functions.text import truncate_middle
from corpusweave.jobs import pipelines
from corpusweave.jobs.registry import query
from corpusweave.jobs.standins import BOOKS, CHAPTERS, EDGES, NODES, TERMS, books, chapters, edges, nodes, table
from corpusweave.operators import extract, graph, segment
from corpusweave.sources import readers

# Pages of one host with neighbouring ids are a document; its outline has one row per page. Every fifth title says
# "Chapter", every seventh is front matter, so that each rule of the outline choice is met.
PAGES_SQL = """p AS (
  SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) || '/' || (page_id // 200) AS doc_id, page_id, html, trim(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '\\s+', ' ', 'g')) AS h1 FROM pages
), pages2 AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_id)::INT AS page_no, h1 AS text, page_id FROM p
), outline AS (
  SELECT doc_id, page_no AS pos, (CASE WHEN page_id % 3 = 0 THEN 1 ELSE 2 END)::INT AS level,
    CASE WHEN page_id % 7 = 0 THEN '目录' WHEN page_id % 5 < 3 THEN 'Chapter ' || page_no || ' ' || text ELSE text END AS title, page_no AS page FROM pages2
)"""


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = table(spark, sf_dir, "pages")
    h1 = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?s)<h1>(.*?)</h1>", 1), r"\s+", " "))
    doc = F.concat(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.lit("/"), F.floor(F.col("page_id") / 200).cast("string"))
    return p.select(doc.alias("doc_id"), "page_id", h1.alias("text")).withColumn("page_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_id")))


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paged(spark, sf_dir)
    title = F.when(F.col("page_id") % 7 == 0, "目录").when(F.col("page_id") % 5 < 3, F.concat(F.lit("Chapter "), "page_no", F.lit(" "), "text")).otherwise(F.col("text"))
    return p.select("doc_id", F.col("page_no").alias("pos"), F.when(F.col("page_id") % 3 == 0, 1).otherwise(2).alias("level"), title.alias("title"), F.col("page_no").alias("page"))


OUTLINE_SQL = f"""{PAGES_SQL}, clean AS (
  SELECT *, regexp_matches(title, '(?i)^(Chapter\\s+\\d+|Part\\s+\\d+)') AS named FROM outline WHERE length(title) > 0 AND NOT (length(title) <= 30 AND contains(title, '目录'))
), n AS (
  SELECT *, count(*) FILTER (WHERE level = 1 AND named) OVER w AS n1c, count(*) FILTER (WHERE level = 1) OVER w AS n1,
    count(*) FILTER (WHERE level = 2 AND named) OVER w AS n2c, count(*) FILTER (WHERE level = 2) OVER w AS n2 FROM clean WINDOW w AS (PARTITION BY doc_id)
), r AS (
  SELECT *, CASE WHEN n1c >= 3 THEN 'level1_named' WHEN n1 >= 2 THEN 'level1' WHEN n2c >= 3 THEN 'level2_named' WHEN n2 BETWEEN 3 AND 50 THEN 'level2' END AS rule FROM n
), chosen AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INT AS ordinal, title, page AS page_start, rule FROM r
  WHERE rule IS NOT NULL AND CASE rule WHEN 'level1_named' THEN level = 1 AND named WHEN 'level1' THEN level = 1 WHEN 'level2_named' THEN level = 2 AND named ELSE level = 2 END
)"""


@query(f"WITH {OUTLINE_SQL} SELECT * FROM chosen")
def outline_chapters(spark, sf_dir):
    return segment.outline_chapters(outline(spark, sf_dir))


RANGES_SQL = f"""{OUTLINE_SQL}, t AS (SELECT doc_id, max(page_no) AS total FROM pages2 GROUP BY doc_id), rng AS (
  SELECT c.*, coalesce(lead(page_start) OVER (PARTITION BY doc_id ORDER BY ordinal) - 1, total)::INT AS page_end FROM chosen c JOIN t USING (doc_id)
), ranged AS (
  SELECT r.doc_id, printf('ch_%03d', ordinal) AS chapter_id, substr(title, 1, 100) AS title, page_start, page_end, trim(string_agg(p.text, chr(10) || chr(10) ORDER BY p.page_no), ' ' || chr(10)) AS content
  FROM rng r JOIN pages2 p ON p.doc_id = r.doc_id AND p.page_no BETWEEN page_start AND page_end GROUP BY ALL
)"""


@query(f"WITH {RANGES_SQL} SELECT *, length(content)::INT AS char_count FROM ranged")
def page_range_chapters(spark, sf_dir):
    return segment.page_range_chapters(segment.outline_chapters(outline(spark, sf_dir)), paged(spark, sf_dir).drop("page_id"))


BUCKETS_SQL = """, bucketed AS (
  SELECT doc_id, ((page_no - 1) // 3)::INT AS b, max(max(page_no)) OVER (PARTITION BY doc_id) AS total, trim(string_agg(text, chr(10) || chr(10) ORDER BY page_no), ' ' || chr(10)) AS content FROM pages2 GROUP BY doc_id, b
), buckets AS (
  SELECT doc_id, printf('ch_%03d', b + 1) AS chapter_id, printf('第 %d-%d 页', b * 3 + 1, least((b + 1) * 3, total)) AS title, b * 3 + 1 AS page_start, least((b + 1) * 3, total)::INT AS page_end, content, length(content)::INT AS char_count
  FROM bucketed WHERE length(content) > 0
)"""


@query(f"WITH {PAGES_SQL}{BUCKETS_SQL} SELECT * FROM buckets")
def page_buckets(spark, sf_dir):
    """Buckets of three pages: hosts have few."""
    return segment.page_buckets(paged(spark, sf_dir).drop("page_id"), 3)


# Markdown: an <h1> per page as a heading of its document, of level 2 in documents with names of even length, else 1.
_MARK_SQL = "CASE WHEN length(doc_id) % 2 = 0 THEN '## ' ELSE '# ' END"
MARKDOWN_SQL = f"""{PAGES_SQL}, md AS (SELECT doc_id, string_agg({_MARK_SQL} || text || chr(10) || 'page ' || page_no, chr(10) ORDER BY page_no) AS content, count(*) AS n FROM pages2 GROUP BY doc_id)"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paged(spark, sf_dir)
    mark = F.when(F.length("doc_id") % 2 == 0, "## ").otherwise("# ")
    line = F.concat(mark, "text", F.lit("\npage "), "page_no")
    return p.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("page_no", line.alias("l"))))["l"], "\n").alias("content"))


HEADINGS_SQL = f"""{MARKDOWN_SQL}, heads AS (
  SELECT doc_id, printf('ch_%03d', page_no) AS chapter_id, substr(text, 1, 100) AS title, {_MARK_SQL} || text || chr(10) || 'page ' || page_no AS content FROM pages2 JOIN md USING (doc_id) WHERE n >= CASE WHEN length(doc_id) % 2 = 0 THEN 3 ELSE 2 END
  UNION ALL SELECT doc_id, 'ch_001', '全文', content FROM md WHERE n < CASE WHEN length(doc_id) % 2 = 0 THEN 3 ELSE 2 END
)"""


@query(f"WITH {HEADINGS_SQL} SELECT *, length(content)::INT AS char_count FROM heads")
def heading_chapters(spark, sf_dir):
    return segment.heading_chapters(markdown(spark, sf_dir))


@query(f"""WITH {HEADINGS_SQL}, s AS (SELECT doc_id, max(length(content)) AS m, sum(length(content)) AS t FROM heads GROUP BY doc_id)
SELECT doc_id, t IS NULL OR (t > 0 AND m / t > 0.85) AS giant FROM md LEFT JOIN s USING (doc_id)""")
def giant_chapters(spark, sf_dir):
    md = markdown(spark, sf_dir)
    return segment.giant_test(segment.heading_chapters(md), md)


# Documents with Chinese chapter lines, one before each second line of a text.
LINES_SQL = """w AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), e AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, l FROM w
), pieces AS (SELECT doc_id, (i + 1) // 2 AS k, string_agg(CASE WHEN i % 2 = 1 THEN '第' || ((i + 1) // 2) || '章 part' || chr(10) || l[i] ELSE l[i] END, chr(10) ORDER BY i) AS body FROM e GROUP BY ALL
), n AS (SELECT doc_id, count(*) AS n FROM pieces GROUP BY doc_id)"""


@query(f"WITH {LINES_SQL} SELECT doc_id, printf('ch_%03d', k) AS chapter_id, '第' || k || '章 part' AS title, trim(body, ' ' || chr(10)) AS content, length(trim(body, ' ' || chr(10)))::INT AS char_count FROM pieces JOIN n USING (doc_id) WHERE n >= 2")
def line_chapters(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 2 == 0, F.concat(F.lit("第"), (F.floor(i / 2) + 1).cast("string"), F.lit("章 part\n"), x)).otherwise(x))
    return segment.line_chapters(d.select("doc_id", F.array_join(lines, "\n").alias("content")))


@query(f"""WITH {RANGES_SQL}{BUCKETS_SQL.replace("3)", "30)").replace("// 3", "// 30").replace("* 3", "* 30")}, two AS (SELECT doc_id FROM chosen GROUP BY doc_id HAVING count(*) >= 2), ok AS (
  SELECT doc_id FROM two WHERE doc_id IN (SELECT doc_id FROM ranged WHERE length(content) > 0)
)
SELECT *, length(content)::INT AS char_count, 'outline' AS strategy FROM ranged WHERE doc_id IN (SELECT doc_id FROM ok)
UNION ALL BY NAME SELECT *, 'page_buckets' AS strategy FROM buckets WHERE doc_id NOT IN (SELECT doc_id FROM ok)""")
def chapter_cascade(spark, sf_dir):
    return segment.paged_chapters(paged(spark, sf_dir).drop("page_id"), outline(spark, sf_dir))


# Each line of a document is a page. A fourth of the documents have an outline, a fourth a heading on each page, a fourth a chapter line on each, a fourth neither.
STRATEGIES_SQL = """p AS (
  SELECT doc_id, doc_id % 4 AS kind, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS k FROM documents WHERE text IS NOT NULL
), pg AS (
  SELECT 'd' || doc_id AS doc_id, kind, k, count(*) OVER (PARTITION BY doc_id)::INT AS n, CASE kind WHEN 1 THEN '# T' || k || chr(10) || line WHEN 2 THEN '第' || k || '章 part' || chr(10) || line ELSE line END AS text FROM p
), own AS (SELECT *, trim(text, ' ' || chr(10)) AS content FROM pg
), d AS (
  SELECT doc_id, any_value(kind) AS kind, any_value(n) AS n, max(length(content)) AS most, sum(length(content)) AS total FROM own GROUP BY doc_id
), way AS (
  SELECT doc_id, CASE WHEN kind = 0 AND n >= 2 AND most > 0 THEN 'outline' WHEN kind = 1 AND n >= 2 AND NOT (total > 0 AND most / total > 0.85) THEN 'headings' WHEN kind = 2 AND n >= 2 THEN 'lines' ELSE 'page_buckets' END AS strategy FROM d
), cut AS (
  SELECT doc_id, printf('ch_%03d', k) AS chapter_id, CASE strategy WHEN 'outline' THEN 'Chapter ' || k WHEN 'headings' THEN 'T' || k ELSE '第' || k || '章 part' END AS title, CASE WHEN strategy = 'outline' THEN k END AS page_start, CASE WHEN strategy = 'outline' THEN k END AS page_end, content, strategy FROM own JOIN way USING (doc_id) WHERE strategy <> 'page_buckets'
), bucketed AS (
  SELECT doc_id, ((k - 1) // 30)::INT AS b, any_value(n) AS n, trim(string_agg(text, chr(10) || chr(10) ORDER BY k), ' ' || chr(10)) AS content FROM pg JOIN way USING (doc_id) WHERE strategy = 'page_buckets' GROUP BY doc_id, b
)"""


@query(f"""WITH {STRATEGIES_SQL} SELECT *, length(content)::INT AS char_count FROM cut
UNION ALL BY NAME SELECT doc_id, printf('ch_%03d', b + 1) AS chapter_id, printf('第 %d-%d 页', b * 30 + 1, least((b + 1) * 30, n)) AS title, b * 30 + 1 AS page_start, least((b + 1) * 30, n)::INT AS page_end, content, 'page_buckets' AS strategy, length(content)::INT AS char_count FROM bucketed WHERE length(content) > 0""")
def cascade_strategies(spark, sf_dir):
    """Documents for each of the four strategies, all searched for headings line by line, as the longest are."""
    kind, k = F.col("doc_id") % 4, F.col("at") + 1
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    text = F.when(kind == 1, F.concat(F.lit("# T"), k, F.lit("\n"), "line")).when(kind == 2, F.concat(F.lit("第"), k, F.lit("章 part\n"), "line")).otherwise(F.col("line"))
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id")
    outlined = lines.filter(kind == 0).select(name, F.col("at").alias("pos"), F.lit(1).alias("level"), F.concat(F.lit("Chapter "), k).alias("title"), k.alias("page"))
    return segment.paged_chapters(lines.select(name, k.alias("page_no"), text.alias("text")), outlined, whole=0)


@query(f"WITH {BOOKS}, {CHAPTERS} SELECT b.*, coalesce(n, 0) AS chapter_count FROM books b LEFT JOIN (SELECT textbook_id, count(*) AS n FROM chapters GROUP BY 1) USING (textbook_id)")
def catalog_summary(spark, sf_dir):
    return segment.catalogue(books(spark, sf_dir), chapters(spark, sf_dir))


@query(f"WITH {HEADINGS_SQL}, s AS (SELECT doc_id, sum(length(content)) AS t FROM heads GROUP BY doc_id) SELECT doc_id, (CASE WHEN coalesce(t, 0) > 0 THEN t ELSE length(content) END)::BIGINT AS total_chars FROM md LEFT JOIN s USING (doc_id)")
def document_totals(spark, sf_dir):
    md = markdown(spark, sf_dir)
    return segment.document_total(md, segment.heading_chapters(md))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents)
SELECT doc_id, string_agg((CASE pos % 4 WHEN 1 THEN '# ' WHEN 2 THEN '## ' WHEN 3 THEN '### ' ELSE '' END) || trim(t), chr(10) || chr(10) ORDER BY pos) AS markdown FROM l WHERE length(trim(t)) > 0 GROUP BY doc_id""")
def styled_paragraphs_md(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    pos = F.col("at") + 1
    style = F.when(pos % 4 == 0, "Normal").otherwise(F.concat(F.lit("Heading "), pos % 4))
    return segment.styled_paragraphs(d.select("doc_id", pos.alias("pos"), style.alias("style"), "text"))


_NAME = "CASE doc_id % 4 WHEN 0 THEN source || '.PDF' WHEN 1 THEN source || '.md' WHEN 2 THEN source || '.exe' ELSE source END"


@query(f"""SELECT doc_id, {_NAME} AS filename, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'md' WHEN 2 THEN 'exe' ELSE '' END AS file_format, CASE WHEN doc_id % 4 < 2 THEN 'accepted' ELSE 'rejected' END AS status,
CASE doc_id % 4 WHEN 2 THEN 'unsupported format: exe' WHEN 3 THEN 'unsupported format: ' END AS reason FROM documents""")
def format_gate(spark, sf_dir):
    return segment.format_gate(table(spark, sf_dir, "documents").select("doc_id", F.expr(_NAME).alias("filename")))


@query("SELECT doc_id, CASE WHEN length(text) <= 6000 THEN text ELSE substr(text, 1, 4200) || chr(10) || chr(10) || '...（中间内容因长度限制省略）...' || chr(10) || chr(10) || right(text, 1800) END AS model_input FROM documents")
def truncate_middle_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", truncate_middle(F.col("text")).alias("model_input"))


@query(f"""WITH {CHAPTERS}, g AS (SELECT md5(content) AS content_key, count(*) AS n_chapters, min(textbook_id || ':' || chapter_id) AS processed_by FROM chapters GROUP BY 1)
SELECT textbook_id, chapter_id, content_key, n_chapters, processed_by FROM chapters JOIN g ON md5(content) = content_key""")
def content_reuse(spark, sf_dir):
    return extract.content_reuse(chapters(spark, sf_dir))


@query(f"""WITH {CHAPTERS} SELECT textbook_id, chapter_id, '章节：' || title || chr(10) || chr(10) || CASE WHEN length(content) <= 6000 THEN content ELSE substr(content, 1, 4200) || chr(10) || chr(10) || '...（中间内容因长度限制省略）...' || chr(10) || chr(10) || right(content, 1800) END AS prompt FROM chapters""")
def extraction_prompts(spark, sf_dir):
    return extract.prompts(chapters(spark, sf_dir)).select("textbook_id", "chapter_id", "prompt")


# A model's answer for each chapter: its first eight words as nodes, in fences with words around,
# and edges between neighbours, every third of an unknown relation. Every tenth answer is broken
# and every eleventh is a list.
_WORDS = "regexp_extract_all(content, '([A-Za-z]{2,60})', 1)"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a chapter without content has an answer without nodes, as one without words has
    words = F.slice(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit("([A-Za-z]{2,60})"), F.lit(1)), 1, 8)
    n = F.expr("cast(substring(chapter_id, 4) as int)")
    ns = F.transform("w", lambda w: F.struct(F.concat(F.lit(" "), w).alias("name"), F.concat(F.lit("about "), w).alias("definition"), F.lit("").alias("category")))
    es = F.transform(F.slice("w", 2, 7), lambda w, i: F.struct(F.get(F.col("w"), i).alias("source"), w.alias("target"), F.when(i % 3 == 2, "likes").otherwise("contains").alias("relation_type"), F.lit("next").alias("description")))
    body = F.to_json(F.struct(ns.alias("nodes"), es.alias("edges")))
    text = F.when(n % 10 == 0, F.concat(F.lit("Sorry "), F.substring(body, 1, 9))).when(n % 11 == 0, F.lit('["a"]')).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    return chapters(spark, sf_dir).withColumn("w", words).select("textbook_id", "chapter_id", "title", "page_start", "content", text.alias("response"), extract.recovered_json(text).alias("json"))


_NODES_SQL = f"""{CHAPTERS}, wd AS (
  SELECT textbook_id, chapter_id, title, page_start, substr(chapter_id, 4)::INT AS n, {_WORDS}[1:8] AS w FROM chapters
), each AS (SELECT *, unnest(range(1, len(w) + 1)) AS place FROM wd WHERE n % 10 <> 0 AND n % 11 <> 0
), fine AS (
  SELECT textbook_id, chapter_id, title, page_start, place, w[place] AS name, row_number() OVER (PARTITION BY textbook_id, chapter_id, w[place] ORDER BY place) AS k FROM each WHERE length(w[place]) BETWEEN 2 AND 12
), mnodes AS (
  SELECT textbook_id || '_' || chapter_id || '_' || substr(md5(name), 1, 6) AS id, textbook_id, chapter_id, title AS chapter_title, name, 'about ' || name AS definition, '核心概念' AS category, page_start AS page FROM fine WHERE k = 1
)"""


@query(f"WITH {_NODES_SQL} SELECT * FROM mnodes")
def model_nodes(spark, sf_dir):
    return extract.model_nodes(responses(spark, sf_dir))


@query(f"""WITH {_NODES_SQL} SELECT a.id AS source, b.id AS target, 'contains' AS relation_type, 'next' AS description
FROM each e JOIN mnodes a ON a.textbook_id = e.textbook_id AND a.chapter_id = e.chapter_id AND a.name = e.w[place] JOIN mnodes b ON b.textbook_id = e.textbook_id AND b.chapter_id = e.chapter_id AND b.name = e.w[place + 1]
WHERE place < len(w) AND (place - 1) % 3 <> 2""")
def model_edges(spark, sf_dir):
    # as tables, so that answers are made and parsed once, not once an end of an edge
    r = written(responses(spark, sf_dir).select("textbook_id", "chapter_id", "title", "page_start", "json"))
    return extract.model_edges(r, written(extract.model_nodes(r)))


@query(f"""WITH {CHAPTERS} SELECT textbook_id, chapter_id, CASE WHEN n % 3 = 1 THEN 'rules' WHEN n % 10 = 0 THEN 'rules' WHEN n % 11 = 0 THEN 'empty' ELSE 'model' END AS route FROM (SELECT *, substr(chapter_id, 4)::INT AS n FROM chapters)""")
def extraction_routes(spark, sf_dir):
    """Every third chapter has no answer."""
    r = responses(spark, sf_dir)
    answered = r.filter(F.expr("cast(substring(chapter_id, 4) as int) % 3 <> 1")).select("textbook_id", "chapter_id", "response")
    return extract.response_route(r.drop("response", "json"), answered).select("textbook_id", "chapter_id", "route")


_ROUTED_SQL = f"""WITH {NODES}, wd AS{_NODES_SQL.split(", wd AS", 1)[1]}, routed AS (SELECT *, substr(chapter_id, 4)::INT AS n FROM chapters)"""


@query(f"""{_ROUTED_SQL}
SELECT id, textbook_id, chapter_id, name, category FROM mnodes WHERE substr(chapter_id, 4)::INT % 3 <> 1
UNION ALL SELECT id, textbook_id, chapter_id, name, category FROM nodes WHERE substr(chapter_id, 4)::INT % 3 = 1 OR substr(chapter_id, 4)::INT % 10 = 0""")
def extracted_graph(spark, sf_dir):
    """Nodes by the route of each chapter; every third chapter has no answer."""
    r = written(responses(spark, sf_dir))
    answered = r.filter(F.expr("cast(substring(chapter_id, 4) as int) % 3 <> 1")).select("textbook_id", "chapter_id", "response")
    return pipelines.extract_graph(r.drop("response", "json"), answered, TERMS)[0].select("id", "textbook_id", "chapter_id", "name", "category")


@query(f"WITH {NODES} SELECT textbook_id, chapter_id, name, rank::INT AS rank FROM nth WHERE rank <= 10")
def candidate_terms(spark, sf_dir):
    return nodes(spark, sf_dir).select("textbook_id", "chapter_id", "name", "rank")


@query(f"WITH {NODES} SELECT * FROM nodes")
def rule_nodes(spark, sf_dir):
    return nodes(spark, sf_dir)


@query(f"WITH {NODES} SELECT id, definition AS evidence FROM nodes")
def evidence_sentence(spark, sf_dir):
    return nodes(spark, sf_dir).select("id", F.col("definition").alias("evidence"))


@query(f"WITH {EDGES} SELECT * FROM edges")
def rule_edges(spark, sf_dir):
    return edges(spark, sf_dir)


@query(f"""WITH {NODES} SELECT c.textbook_id, count(*) AS chapters, count(n) AS done, coalesce(sum(n), 0)::BIGINT AS nodes
FROM chapters c LEFT JOIN (SELECT textbook_id, chapter_id, count(*) AS n FROM nodes GROUP BY ALL) USING (textbook_id, chapter_id) GROUP BY 1""")
def extraction_progress(spark, sf_dir):
    return extract.extraction_progress(chapters(spark, sf_dir), nodes(spark, sf_dir))


def _dedupe_sql(keys: str) -> str:
    return f"""{EDGES}, best AS (
  SELECT id, first_value(id) OVER (PARTITION BY {keys} ORDER BY length(definition) DESC, id) AS kept_id FROM nodes
), kept AS (SELECT * FROM nodes WHERE id IN (SELECT kept_id FROM best)), moved AS (
  SELECT coalesce(s.kept_id, e.source) AS source, coalesce(t.kept_id, e.target) AS target, relation_type, description FROM edges e LEFT JOIN best s ON s.id = e.source LEFT JOIN best t ON t.id = e.target
), kedges AS (
  SELECT source, target, relation_type, min(description) AS description FROM moved WHERE source <> target AND source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept) GROUP BY 1, 2, 3
), deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM kedges UNION ALL SELECT target FROM kedges) GROUP BY id
), weighted AS (
  SELECT k.*, coalesce(degree, 0) AS degree, count(*) OVER (PARTITION BY lower(regexp_replace(name, '\\s+', '', 'g'))) AS frequency FROM kept k LEFT JOIN deg USING (id)
)"""


_KEY = "lower(regexp_replace(name, '\\s+', '', 'g'))"
ALL_SQL = _dedupe_sql(f"textbook_id, {_KEY}")


@query(f"WITH {_dedupe_sql(_KEY)} SELECT id, kept_id FROM best")
def graph_dedupe_names(spark, sf_dir):
    return graph.dedupe_nodes(nodes(spark, sf_dir), by_book=False)[1]


@query(f"WITH {ALL_SQL} SELECT id, kept_id FROM best")
def graph_dedupe_all(spark, sf_dir):
    return graph.dedupe_nodes(nodes(spark, sf_dir))[1]


def deduped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = written(nodes(spark, sf_dir))
    kept, mapping = graph.dedupe_nodes(n)
    return kept, graph.rewrite_edges(extract.rule_edges(n), kept, mapping)


@query(f"WITH {ALL_SQL} SELECT * FROM kedges")
def edge_rewrite(spark, sf_dir):
    return deduped(spark, sf_dir)[1]


@query(f"WITH {ALL_SQL} SELECT id, degree, frequency, degree + 1 AS book_weight, greatest(degree + 1, frequency * 3) AS weight FROM weighted")
def node_weights(spark, sf_dir):
    return graph.node_weights(*deduped(spark, sf_dir)).select("id", "degree", "frequency", "book_weight", "weight")


@query(f"WITH {ALL_SQL} SELECT (SELECT count(*) FROM kept) AS node_count, (SELECT count(DISTINCT textbook_id) FROM kept) AS textbook_count, (SELECT list_sort(list(DISTINCT category)) FROM kept) AS categories, (SELECT count(*) FROM kedges) AS edge_count")
def graph_stats(spark, sf_dir):
    return graph.graph_stats(*deduped(spark, sf_dir))


@query(f"WITH {NODES}, {BOOKS} SELECT id, name, textbook_id FROM nodes n JOIN books b USING (textbook_id) WHERE contains(lower(concat_ws(' ', name, definition, chapter_title, title)), 'tion')")
def node_search(spark, sf_dir):
    return graph.search_nodes(nodes(spark, sf_dir), books(spark, sf_dir), " TION").select("id", "name", "textbook_id")


@query(f"WITH {NODES}, {BOOKS}, queries AS (SELECT item_id AS query_id, trim(lower(substr(text, 1, 5))) AS term FROM benchmark) SELECT query_id, id FROM nodes n JOIN books b USING (textbook_id) JOIN queries q ON term <> '' AND contains(lower(concat_ws(' ', name, definition, chapter_title, title)), term)")
def node_searches(spark, sf_dir):
    """All queries at once: the first letters of each benchmark item."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 5).alias("query"))
    return graph.search_nodes_for(nodes(spark, sf_dir), books(spark, sf_dir), queries)


@query(f"""WITH {CHAPTERS}, dictionary AS (SELECT DISTINCT p_name AS term FROM part UNION SELECT unnest(string_split(p_name, ' ')) FROM part UNION SELECT substr(text, 1, 8) FROM benchmark)
SELECT textbook_id, chapter_id, list_sort(list(term)) AS terms FROM chapters JOIN dictionary ON term <> '' AND contains(content, term) GROUP BY 1, 2""")
def dictionary_terms(spark, sf_dir):
    """A dictionary table, of the parts' names and words and the benchmark's beginnings, in all chapters."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    rows = names.select(F.col("p_name").alias("term")).union(names.select(F.explode(F.split("p_name", " ")))).union(table(spark, sf_dir, "benchmark").select(F.substring("text", 1, 8)))
    found = extract.known_terms(chapters(spark, sf_dir).select("textbook_id", "chapter_id", "content"), rows.withColumn("ord", F.lit(0)), "terms")
    return found.filter(F.size("terms") > 0).select("textbook_id", "chapter_id", F.sort_array("terms").alias("terms"))



# Clicks: each user clicks the node of the rank of their id.
@query(f"""WITH {ALL_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n, greatest(degree + 1, frequency * 3) AS weight FROM weighted), c AS (SELECT user_id, count(*) AS clicks FROM events GROUP BY 1)
SELECT id, coalesce(clicks, 0) AS clicks, least(72, 15 + 3 * weight + 2 * coalesce(clicks, 0)) AS size FROM r LEFT JOIN c ON user_id = n""")
def click_size(spark, sf_dir):
    from corpusweave.functions.ranking import numbered

    w = numbered(graph.node_weights(*deduped(spark, sf_dir)), "n", F.col("id"))
    clicks = table(spark, sf_dir, "events").select(F.col("user_id").alias("n")).join(w.select("n", "id"), "n").select("id")
    return graph.clicked_sizes(w, clicks)


@query(f"""WITH {ALL_SQL}, b AS (SELECT source AS focus, target AS neighbour, relation_type FROM kedges UNION ALL SELECT target, source, relation_type FROM kedges)
SELECT DISTINCT * FROM b WHERE focus IN (SELECT id FROM kept)""")
def neighbourhood(spark, sf_dir):
    """Of every node that is kept."""
    n, e = deduped(spark, sf_dir)
    return graph.neighbourhood(n, e)


@query(f"""WITH {NODES}, c AS (SELECT id, n.name, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS t FROM nodes n JOIN chapters USING (textbook_id, chapter_id))
SELECT id, CASE WHEN strpos(t, name) > 0 THEN substr(t, greatest(1, strpos(t, name) - 650), 2200) ELSE substr(t, 1, 1800) END AS snippet FROM c""")
def source_snippet(spark, sf_dir):
    return graph.source_snippets(nodes(spark, sf_dir), chapters(spark, sf_dir))


# ---- reading ------------------------------------------------------------------------------------------


@query(f"WITH {CHAPTERS} SELECT chapter_id, title, char_count FROM chapters WHERE textbook_id = 'src3'")
def chapter_list(spark, sf_dir):
    """The chapters of one textbook, which is what is asked for."""
    return segment.chapters_of(chapters(spark, sf_dir), "src3").select("chapter_id", "title", "char_count")


@query(f"WITH {PAGES_SQL} SELECT p.doc_id, page_no, p.text, o.level, o.title FROM pages2 p JOIN outline o ON o.doc_id = p.doc_id AND o.page = p.page_no")
def paged_input(spark, sf_dir):
    """Paged text and outlines written as tables and read again, page by page."""
    at = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    paged(spark, sf_dir).select(F.col("doc_id"), "page_no", "text").write.parquet(f"{at}/pages")
    outline(spark, sf_dir).write.parquet(f"{at}/outline")
    pages, rows = readers.read_paged(spark, f"{at}/pages", f"{at}/outline")
    return pages.join(rows.withColumnRenamed("page", "page_no"), ["doc_id", "page_no"]).select("doc_id", "page_no", "text", "level", "title")


# Chapters that reach every rule: a heading of the first long word, Chinese full stops, a definition of the last one.
RICH = """rich AS (
  SELECT source AS textbook_id, printf('ch_%03d', doc_id) AS chapter_id, '第3章 ' || coalesce(w[1], 'x') AS title, (doc_id % 50 + 1)::INT AS page_start,
    '## 2.1、' || coalesce(w[1], 'none') || chr(10) || replace(text, '. ', '。') || chr(10) || coalesce(w[-1], 'none') || '是指' || coalesce(w[2], 'none') || '。' AS content
  FROM (SELECT *, regexp_extract_all(text, '[A-Za-z]{4,12}') AS w FROM documents)
)"""


def rich_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("w", F.regexp_extract_all("text", F.lit("([A-Za-z]{4,12})"), F.lit(1)))
    word = lambda i, other: F.coalesce(F.try_element_at("w", F.lit(i)), F.lit(other))
    content = F.concat(F.lit("## 2.1、"), word(1, "none"), F.lit("\n"), F.replace("text", F.lit(". "), F.lit("。")), F.lit("\n"), word(-1, "none"), F.lit("是指"), word(2, "none"), F.lit("。"))
    return d.select(F.col("source").alias("textbook_id"), segment.chapter_id(F.col("doc_id")).alias("chapter_id"), F.concat(F.lit("第3章 "), word(1, "x")).alias("title"), (F.col("doc_id") % 50 + 1).cast("int").alias("page_start"), content.alias("content"))


_BAD = "'[，。？！；：（）()【】\\[\\]『』]|[的了认作为]$|^(主要|尤其|特别|目前|值得|图|表)'"
_CLEAN = "regexp_replace(regexp_replace(regexp_replace({}, '^[\\d一二三四五六七八九十百零、.\\s]+', ''), '[：:，,。；;（）()【】\\[\\]《》<>].*$', '', 's'), '\\s+', '', 'g')"


@query(f"""WITH {RICH}, terms(ord, term) AS (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(TERMS, 1))}), found AS (
  SELECT textbook_id, chapter_id, 100 AS ord, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS raw FROM (SELECT *, regexp_extract_all(substr(content, 1, 20000), '(?m)^\\s*#{{1,4}}\\s*([一二三四五六七八九十百零\\d、.\\s]*[一-龥A-Za-z]{{2,24}})\\s*$', 1) AS l FROM rich)
  UNION ALL SELECT textbook_id, chapter_id, 200, unnest(range(1, len(l) + 1)), unnest(l) FROM (SELECT *, regexp_extract_all(substr(content, 1, 25000), '([一-龥A-Za-z0-9]{{2,12}})(?:是指|是|指|为|包括|可分为|称为)', 1) AS l FROM rich)
), cand AS (
  SELECT textbook_id, chapter_id, 0 AS ord, 0 AS k, trim(regexp_replace(title, '^第\\s*[一二三四五六七八九十百零\\d]+\\s*章\\s*', '')) AS name FROM rich
  UNION ALL SELECT textbook_id, chapter_id, ord, k, {_CLEAN.format("raw")} FROM found
), valid AS (
  SELECT * FROM cand WHERE length(name) BETWEEN 2 AND 12 AND NOT regexp_matches(name, {_BAD})
  UNION ALL SELECT textbook_id, chapter_id, ord, 0, term FROM rich, terms WHERE contains(content, term)
), firsts AS (SELECT *, row_number() OVER (PARTITION BY textbook_id, chapter_id, name ORDER BY ord, k) AS n FROM valid
), picked AS (
  SELECT textbook_id, chapter_id, ord, k, name FROM firsts WHERE n = 1
  UNION ALL SELECT r.textbook_id, r.chapter_id, 0, 0, substr(r.title, 1, 12) FROM rich r ANTI JOIN valid v ON r.textbook_id = v.textbook_id AND r.chapter_id = v.chapter_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY textbook_id, chapter_id ORDER BY ord, k) AS rank FROM picked
), compact AS (
  SELECT n.*, regexp_replace(r.content, '\\s+', ' ', 'g') AS t, strpos(regexp_replace(r.content, '\\s+', ' ', 'g'), n.name) AS place FROM ranked n JOIN rich r USING (textbook_id, chapter_id) WHERE rank <= 10
), cut AS (
  SELECT *, CASE WHEN contains(substr(t, 1, place - 1), '。') THEN place - strpos(reverse(substr(t, 1, place - 1)), '。') ELSE 0 END AS s, strpos(substr(t, place), '。') AS e FROM compact
)
SELECT textbook_id, chapter_id, name, rank::INT AS rank,
  CASE WHEN place > 0 THEN substr(trim(substr(t, s + 1, CASE WHEN e > 0 THEN place + e - 1 - s ELSE least(length(t), place + 179) + 1 - s END)), 1, 260) ELSE name || ' 是本章教材文本中识别出的核心知识点。' END AS definition FROM cut""")
def rich_rule_nodes(spark, sf_dir):
    return extract.rule_nodes(rich_chapters(spark, sf_dir), TERMS).select("textbook_id", "chapter_id", "name", "rank", "definition")
