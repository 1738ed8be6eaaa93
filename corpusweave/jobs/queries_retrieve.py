"""Queries on chunks, retrieval, evaluation, conversations, keyed tables and streams."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusweave.functions.shared import shared_dir, written
from corpusweave.jobs import stored
from corpusweave.jobs.registry import query
from corpusweave.jobs.standins import BOOKS, CHAPTERS, NODES, QUESTIONS, RUN, TERMS, books, chapters, nodes, questions, table
from corpusweave.operators import cells, chunk, converse, encode, evaluate, integrate, postings, retrieve, words
from corpusweave.sources import keyed, readers, tables
from corpusweave.streaming import flows

# ---- chunks -----------------------------------------------------------------------------------


def _break(mark: str) -> str:
    """Where the last mark in the window of 700 after `start` begins, from the window's start; null if too early."""
    n = f"length({mark})"
    seg = "substr(body, start + 1, 700)"
    return f"CASE WHEN contains({seg}, {mark}) AND 700 - strpos(reverse({seg}), reverse({mark})) - {n} + 1 >= 386 THEN start + 700 - strpos(reverse({seg}), reverse({mark})) + 1 END"


_STOP = f"CASE WHEN start + 700 >= length(body) THEN length(body) ELSE coalesce({', '.join(_break(m) for m in ('chr(10) || ' + chr(39) + '##' + chr(39), 'chr(10) || chr(10)', chr(39) + '。' + chr(39), chr(39) + '；' + chr(39), 'chr(10)'))}, start + 700) END"
# no chapter has a heading of level 2 to 4, so each is one section
WINDOWS_SQL = f"""{CHAPTERS}, {BOOKS}, bodies AS (
  SELECT textbook_id, chapter_id, trim(regexp_replace(content, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS body FROM chapters
), spans(textbook_id, chapter_id, body, start, stop) AS (
  SELECT textbook_id, chapter_id, body, 0::BIGINT, ({_STOP})::BIGINT FROM (SELECT *, 0 AS start FROM bodies)
  UNION ALL SELECT textbook_id, chapter_id, body, start, ({_STOP})::BIGINT FROM (SELECT textbook_id, chapter_id, body, greatest(stop - 90, start + 1) AS start FROM spans WHERE stop < length(body))
), windows AS (
  SELECT textbook_id, chapter_id, '' AS section_title, start::INT AS start, trim(substr(body, start + 1, stop - start), ' ' || chr(10) || chr(9)) AS text FROM spans
), chunks AS (
  SELECT 'chunk_' || substr(md5(concat_ws(':', w.textbook_id, w.chapter_id, '', start, substr(text, 1, 40))), 1, 12) AS chunk_id, w.textbook_id, b.title AS textbook_title, w.chapter_id, c.title AS chapter_title, section_title, start, page_start, page_end, text, length(text) AS char_count
  FROM windows w JOIN chapters c USING (textbook_id, chapter_id) JOIN books b ON b.textbook_id = w.textbook_id WHERE length(text) >= 80
)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.chunk_table(chapters(spark, sf_dir), books(spark, sf_dir))


@query(f"WITH RECURSIVE {WINDOWS_SQL} SELECT textbook_id, chapter_id, section_title, start, text FROM windows WHERE length(text) > 0 OR length(text) = 0 AND start = 0")
def chunk_windows(spark, sf_dir):
    return chunk.chunk_windows(chapters(spark, sf_dir).select("textbook_id", "chapter_id", "content"))


@query(f"WITH RECURSIVE {WINDOWS_SQL} SELECT * FROM chunks")
def chunk_table(spark, sf_dir):
    return chunks(spark, sf_dir)


@query(f"WITH RECURSIVE {WINDOWS_SQL} SELECT count(*) AS chunks, count(*) AS embedded, count(DISTINCT textbook_id) AS textbooks, CASE WHEN count(*) > 0 THEN 'ready' ELSE 'empty' END AS status, 512 AS width, 'hashing' AS encoder, NULL::VARCHAR AS error FROM chunks")
def index_status(spark, sf_dir):
    """The metadata of an index of all chunks, written and replaced once."""
    c, path = written(chunks(spark, sf_dir)), _folder(spark)
    chunk.write_index(c.limit(3), path)
    return chunk.write_index(c, path, lambda rows: encode.encode(rows, "text"), "hashing").drop("built_at")


# ---- lexical and vector retrieval ---------------------------------------------------------------

_TOK = "list_filter(list_transform(regexp_extract_all({}, '([A-Za-z0-9]+)', 1), lambda t: lower(t)), lambda t: length(t) > 1)"
WORDS_SQL = f"""{WINDOWS_SQL}, {QUESTIONS}, words AS (
  SELECT chunk_id, {_TOK.format("concat_ws(' ', textbook_title, chapter_title, section_title, text)")} AS toks FROM chunks
), postings AS (SELECT token, chunk_id, dl, count(*) AS tf FROM (SELECT chunk_id, len(toks) AS dl, unnest(toks) AS token FROM words) GROUP BY ALL
), size AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM words), df AS (SELECT token, count(*) AS df FROM postings GROUP BY token
), raw AS (SELECT token, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM df, size
), idf AS (SELECT token, df, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw
), asked AS (SELECT question_id, token, count(*) AS times FROM (SELECT question_id, unnest({_TOK.format('question')}) AS token FROM questions) GROUP BY ALL
), scores AS (
  SELECT question_id, chunk_id, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS bm25
  FROM asked JOIN idf USING (token) JOIN postings USING (token), size GROUP BY ALL
), lex AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY bm25 DESC, chunk_id) AS bm25_rank FROM scores WHERE bm25 > 0 QUALIFY bm25_rank <= 30)"""


def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.chunk_words(chunks(spark, sf_dir))


@query(f"WITH RECURSIVE {WORDS_SQL} SELECT chunk_id, toks AS tokens FROM words")
def tokens(spark, sf_dir):
    return chunk_tokens(spark, sf_dir)


# Characters that stand for a to z. Small letters become characters and blanks go, so
# sentences are runs without word borders, with capitals and digits between them.
STAND_INS = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余"
#: Of 26 characters, parts meet by chance far more often than of thousands.
COHESION = 3
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
CHINESE_SQL = f"chinese AS (SELECT doc_id, replace(translate(coalesce(text, ''), '{_LETTERS}', '{STAND_INS}'), ' ', '') AS text FROM documents)"


def chinese(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.translate(F.coalesce("text", F.lit("")), _LETTERS, STAND_INS), F.lit(" "), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


@query(f"""WITH {CHINESE_SQL}, r AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+|[一-龥]+') AS runs FROM chinese)
SELECT doc_id, list_filter(flatten(list_transform(runs, lambda r: CASE WHEN regexp_matches(r, '^[A-Za-z0-9]') THEN [lower(r)] ELSE list_transform(range(1, greatest(len(r) - 1, 1) + 1), lambda i: substr(r, i, 2)) END)), lambda t: length(t) > 1) AS tokens FROM r""")
def chinese_tokens(spark, sf_dir):
    """The default rule on text without blanks: pairs of characters."""
    return chinese(spark, sf_dir).select("doc_id", words.PAIRS.column(F.col("text")).alias("tokens"))


@query(f"""WITH {CHINESE_SQL}, runs AS (SELECT unnest(regexp_extract_all(text, '[一-龥]+')) AS run FROM chinese
), tails AS (SELECT tail, count(*) AS n FROM (SELECT substr(run, unnest(range(1, len(run) + 1)), 5) AS tail FROM runs) GROUP BY 1
), grams AS (SELECT gram, sum(n)::BIGINT AS n FROM (SELECT substr(tail, 1, unnest(range(1, len(tail) + 1))) AS gram, n FROM tails) GROUP BY 1
), total AS (SELECT sum(n) AS total FROM grams WHERE len(gram) = 1
), after AS (SELECT left(gram, len(gram) - 1) AS gram, count(*) AS after FROM grams WHERE len(gram) > 2 GROUP BY 1
), ahead AS (SELECT right(gram, len(gram) - 1) AS gram, count(*) AS ahead FROM grams WHERE len(gram) > 2 GROUP BY 1
), free AS (SELECT gram, n FROM grams JOIN after USING (gram) JOIN ahead USING (gram) WHERE len(gram) BETWEEN 2 AND 4 AND n >= 5 AND after >= 5 AND ahead >= 5
), cuts AS (SELECT gram, n, left(gram, k) AS a, right(gram, len(gram) - k) AS b FROM (SELECT gram, n, unnest(range(1, len(gram))) AS k FROM free)
), firm AS (SELECT c.gram, any_value(c.n) AS n FROM cuts c JOIN grams x ON x.gram = a JOIN grams y ON y.gram = b, total GROUP BY 1 HAVING bool_and(c.n::HUGEINT * total >= {COHESION} * x.n::HUGEINT * y.n)
) SELECT gram AS word, n FROM firm UNION ALL SELECT gram, n FROM grams WHERE len(gram) = 1""")
def learnt_words(spark, sf_dir):
    """The dictionary that text without blanks teaches."""
    return words.learn_words(chinese(spark, sf_dir), cohesion=COHESION)


@query()
def segmented_words(spark, sf_dir):
    """Text without blanks, cut along the most probable paths of the learnt dictionary."""
    texts = written(chinese(spark, sf_dir))
    tokenizer = words.segmenting(written(words.learn_words(texts, cohesion=COHESION)))
    return texts.select("doc_id", tokenizer.column(F.col("text")).alias("tokens"))


@query(f"WITH RECURSIVE {WORDS_SQL} SELECT token, df, round(idf, 6) AS idf FROM idf")
def bm25_stats(spark, sf_dir):
    return retrieve.bm25_statistics(written(chunk_tokens(spark, sf_dir))).withColumn("idf", F.round("idf", 6))


@query(f"WITH RECURSIVE {WORDS_SQL} SELECT * FROM lex")
def bm25_top(spark, sf_dir):
    """By the stored index; no more than the best 30 of a segment leave a task."""
    return postings.postings_top(stored.index(spark, sf_dir), questions(spark, sf_dir))


@query("""WITH q AS (SELECT vec_id AS question_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (
  SELECT question_id, vec_id AS chunk_id, round(list_inner_product(e::DOUBLE[], embedding::DOUBLE[]), 6) AS vector FROM q, embeddings
) SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY vector DESC, chunk_id) AS vector_rank FROM s QUALIFY vector_rank <= 30""")
def vector_top(spark, sf_dir):
    """Every vector whose id is divisible by 20 asks, all answer, from stored cells."""
    asked = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), "embedding")
    return cells.cells_top(stored.embedding_cells(spark, sf_dir), asked)


_PLACE = "(('0x' || substr(md5(token), 1, 8))::BIGINT // 2) % 512"
_SIGN = "CASE WHEN ('0x' || substr(md5(token), 1, 8))::BIGINT % 2 = 1 THEN 1 ELSE -1 END"
FUSED_SQL = f"""{WORDS_SQL}, ctok AS (SELECT chunk_id, unnest({_TOK.format('text')}) AS token FROM chunks
), cv AS (SELECT chunk_id, {_PLACE} AS d, sum({_SIGN})::DOUBLE AS v FROM ctok GROUP BY ALL), cn AS (SELECT chunk_id, sqrt(sum(v * v)) AS n FROM cv GROUP BY 1
), qtok AS (SELECT question_id, unnest({_TOK.format('question')}) AS token FROM questions
), qv AS (SELECT question_id, {_PLACE} AS d, sum({_SIGN})::DOUBLE AS v FROM qtok GROUP BY ALL), qn AS (SELECT question_id, sqrt(sum(v * v)) AS n FROM qv GROUP BY 1
), dots AS (SELECT question_id, chunk_id, sum(qv.v * cv.v) AS s FROM qv JOIN cv USING (d) GROUP BY ALL
), vs AS (SELECT q.question_id, c.chunk_id, round(coalesce(s / CASE WHEN qn.n > 0 AND cn.n > 0 THEN qn.n * cn.n END, 0), 6) AS vector FROM questions q CROSS JOIN chunks c LEFT JOIN dots USING (question_id, chunk_id) LEFT JOIN qn USING (question_id) LEFT JOIN cn USING (chunk_id)
), vec AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY vector DESC, chunk_id) AS vector_rank FROM vs QUALIFY vector_rank <= 30
), both_legs AS (
  SELECT coalesce(v.question_id, l.question_id) AS question_id, coalesce(v.chunk_id, l.chunk_id) AS chunk_id, vector, vector_rank, bm25_rank, round(coalesce(1 / (60 + vector_rank), 0) + coalesce(1 / (60 + bm25_rank), 0), 9) AS score
  FROM vec v FULL JOIN lex l ON v.question_id = l.question_id AND v.chunk_id = l.chunk_id
), fused AS (
  SELECT b.question_id, b.chunk_id, row_number() OVER (PARTITION BY b.question_id ORDER BY score DESC, vector_rank NULLS LAST, bm25_rank NULLS LAST, b.chunk_id) AS rank, score, w.vector, coalesce(s.bm25, 0) AS bm25
  FROM both_legs b JOIN vs w ON w.question_id = b.question_id AND w.chunk_id = b.chunk_id LEFT JOIN scores s ON s.question_id = b.question_id AND s.chunk_id = b.chunk_id AND s.bm25 <> 0 QUALIFY rank <= 5
), hits AS (SELECT f.*, textbook_title, chapter_title, page_start, text FROM fused f JOIN chunks USING (chunk_id))"""


def search(spark: SparkSession, sf_dir: str, leg: str = "fused", size: int = chunk.SIZE) -> DataFrame:
    """Five best chunks for each question from the stored index: both legs fused, or the vector leg alone."""
    asked, rows = questions(spark, sf_dir), stored.vectors(spark, sf_dir, size)
    q = written(encode.encode(asked, "question").select("question_id", "embedding"))
    vectors = written(retrieve.vector_top(rows, q))
    if leg == "vector":
        return retrieve.fuse(vectors, vectors.select("question_id", "chunk_id", F.lit(0.0).alias("bm25"), F.lit(None).cast("int").alias("bm25_rank")).limit(0))
    index = stored.index(spark, sf_dir, size)
    tokens = postings.asked_tokens(index, asked)
    lexical = written(retrieve.ranked(postings.best_scores(index, tokens).filter("bm25 > 0"), "bm25", "bm25_rank"))
    return retrieve.fuse(vectors, lexical, postings.scores_of(index, tokens, vectors), index=rows, questions=q)


def hits(spark: SparkSession, sf_dir: str, leg: str = "fused", size: int = chunk.SIZE) -> DataFrame:
    # hits are few, and as a table they are known to be
    return written(retrieve.with_chunks(written(search(spark, sf_dir, leg, size)), stored.chunks(spark, sf_dir, size)))


@query(f"WITH RECURSIVE {FUSED_SQL} SELECT * FROM fused")
def rrf_top(spark, sf_dir):
    return search(spark, sf_dir)


_CONTEXT = "'[' || rank || '] 来源：' || textbook_title || '，' || chapter_title || '，第' || page_start || '页' || chr(10) || substr(text, 1, 1100)"


@query(f"""WITH RECURSIVE {FUSED_SQL}, c AS (SELECT question_id, string_agg({_CONTEXT}, chr(10) || chr(10) ORDER BY rank) AS context FROM hits GROUP BY 1)
SELECT question_id, context, '上下文：' || chr(10) || context || chr(10) || chr(10) || '问题：' || question || chr(10) || chr(10) || '请给出简洁、可核查的中文回答。' AS prompt FROM c JOIN questions USING (question_id)""")
def context_block(spark, sf_dir):
    return retrieve.context_blocks(hits(spark, sf_dir), questions(spark, sf_dir))


@query(f"""WITH RECURSIVE {FUSED_SQL}, f AS (SELECT question_id, textbook_title AS textbook, chapter_title AS chapter, page_start AS page, min(rank) AS r, first(score ORDER BY rank) AS score FROM hits GROUP BY 1, 2, 3, 4)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY r) AS position, textbook, chapter, page, round(score, 4) AS relevance FROM f""")
def citations(spark, sf_dir):
    return retrieve.citations(hits(spark, sf_dir))


_ANSWER_SQL = f"""{FUSED_SQL}, a AS (
  SELECT question_id, '基于当前检索到的教材原文，相关信息如下：' || chr(10) || string_agg('- ' || substr(replace(text, chr(10), ' '), 1, 180) || ' [' || textbook_title || ', ' || chapter_title || ', 第' || page_start || '页]', chr(10) ORDER BY rank) AS answer FROM hits WHERE rank <= 3 GROUP BY 1
), s AS (SELECT question_id, list(chunk_id ORDER BY rank) AS source_chunks FROM hits GROUP BY 1)"""


@query(f"WITH RECURSIVE {_ANSWER_SQL} SELECT * FROM a")
def extractive_answer(spark, sf_dir):
    return retrieve.extractive_answers(hits(spark, sf_dir))


@query(f"WITH RECURSIVE {_ANSWER_SQL} SELECT question_id, coalesce(answer, '当前知识库中未找到相关信息。') AS answer, coalesce(source_chunks, []) AS source_chunks FROM questions LEFT JOIN a USING (question_id) LEFT JOIN s USING (question_id)")
def answers(spark, sf_dir):
    return retrieve.answers(questions(spark, sf_dir), hits(spark, sf_dir))


@query(f"WITH RECURSIVE {_ANSWER_SQL} SELECT question_id, CASE WHEN question_id % 2 = 0 THEN '当前知识库中未找到相关信息。' ELSE answer END AS answer FROM questions LEFT JOIN a USING (question_id)")
def refusals(spark, sf_dir):
    """Questions of even number find nothing."""
    return retrieve.answers(questions(spark, sf_dir), hits(spark, sf_dir).filter("question_id % 2 = 1")).select("question_id", "answer")


# ---- evaluation -----------------------------------------------------------------------------------

CASES_SQL = """cases AS (SELECT item_id AS id, ['fact', 'compare', 'reason', 'cross'][(item_id % 4)::INT + 1] AS type, [substr(text, 40, 30), substr(text, 80, 20)] AS keywords, 'src' || item_id % 20 AS book FROM benchmark)"""
_EVAL_SQL = f"""{FUSED_SQL}, {CASES_SQL}, got AS (SELECT question_id, string_agg(text, chr(10) ORDER BY rank) AS texts, list(textbook_title) AS titles, first(textbook_title ORDER BY rank) AS top1, first(chapter_title ORDER BY rank) AS top1_chapter FROM hits GROUP BY 1
), results AS (
  SELECT id, type, contains(coalesce(texts, ''), keywords[1]) OR contains(coalesce(texts, ''), keywords[2]) AS keyword_hit, len(list_filter(coalesce(titles, []), lambda t: contains(t, book))) > 0 AS book_hit, coalesce(top1, '') AS top1, coalesce(top1_chapter, '') AS top1_chapter
  FROM cases LEFT JOIN got ON question_id = id
)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    kind = F.element_at(F.array(*map(F.lit, ("fact", "compare", "reason", "cross"))), (F.col("item_id") % 4 + 1).cast("int"))
    return b.select(F.col("item_id").alias("id"), kind.alias("type"), F.array(F.substring("text", 40, 30), F.substring("text", 80, 20)).alias("expected_keywords"), F.array(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))).alias("expected_textbooks"))


@query(f"WITH RECURSIVE {_EVAL_SQL} SELECT * FROM results")
def eval_cases(spark, sf_dir):
    return evaluate.eval_cases(cases(spark, sf_dir), hits(spark, sf_dir))


@query(f"WITH RECURSIVE {_EVAL_SQL} SELECT count(*) AS cases, coalesce(round(avg(keyword_hit::INT), 3), 0) AS keyword_hit_at_k, coalesce(round(avg(book_hit::INT), 3), 0) AS book_hit_at_k FROM results")
def eval_rollup(spark, sf_dir):
    return evaluate.roll_up(evaluate.eval_cases(cases(spark, sf_dir), hits(spark, sf_dir)))


def _sweep_sql(size: int, least: int, leg: str) -> str:
    sql = _EVAL_SQL.replace("700", str(size)).replace("386", str(least))
    sql = sql if leg == "fused" else sql.replace("WHERE bm25 > 0 QUALIFY", "WHERE bm25 > 0 AND false QUALIFY")
    return f"SELECT * FROM (WITH RECURSIVE {sql} SELECT 'size={size}, leg={leg}' AS setting, count(*) AS cases, coalesce(round(avg(keyword_hit::INT), 3), 0) AS keyword_hit_at_k, coalesce(round(avg(book_hit::INT), 3), 0) AS book_hit_at_k FROM results)"


# 221 and 386: the first whole numbers from 0.55 times the size
@query(" UNION ALL ".join(_sweep_sql(size, least, leg) for size, least in ((400, 221), (700, 386)) for leg in ("vector", "fused")))
def setting_sweep(spark, sf_dir):
    """Two window sizes, each with both legs and with the vector leg alone; chunks, vectors and postings of a size are built once."""
    settings = [(size, leg) for size in (400, 700) for leg in ("vector", "fused")]
    name = lambda size, leg: f"size={size}, leg={leg}"
    found = [hits(spark, sf_dir, leg, size).withColumn("setting", F.lit(name(size, leg))) for size, leg in settings]
    return evaluate.sweep([name(*s) for s in settings], reduce(DataFrame.unionByName, found), cases(spark, sf_dir))


@query(f"WITH {CASES_SQL} SELECT id::VARCHAR AS id, type, text AS question, keywords AS expected_keywords, [book] AS expected_textbooks FROM cases JOIN benchmark ON item_id = id")
def eval_set(spark, sf_dir):
    """Cases written as JSON lines and read again."""
    path = _folder(spark)
    c = cases(spark, sf_dir).join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question")), "id")
    c.select(F.col("id").cast("string").alias("id"), "type", "question", "expected_keywords", "expected_textbooks").write.json(path)
    return readers.read_eval_set(spark, path)


# Chapters with Chinese stops and semicolons, cut by headings before each " the ".
_MARKED_SQL = """marked AS (SELECT source AS textbook_id, printf('ch_%03d', doc_id) AS chapter_id, replace(replace(replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' the ', chr(10) || '## the '), '. ', '。'), ', ', '；') AS content FROM documents
), parts AS (SELECT textbook_id, chapter_id, contains(content, chr(10) || '## ') AS headed, unnest(string_split(content, chr(10) || '## ')) AS p, unnest(range(1, len(string_split(content, chr(10) || '## ')) + 1)) AS k FROM marked
), bodies AS (
  SELECT textbook_id, chapter_id, k, CASE WHEN k = 1 THEN '' ELSE substr(p, 1, 80) END AS section_title, CASE WHEN k = 1 THEN p ELSE '## ' || p END AS body FROM parts WHERE NOT headed OR k > 1 OR length(p) > 100
)"""
_SECTIONS_SQL = f"""{_MARKED_SQL}, spans(textbook_id, chapter_id, section_title, body, k, start, stop) AS (
  SELECT textbook_id, chapter_id, section_title, body, k, 0::BIGINT, ({_STOP})::BIGINT FROM (SELECT *, 0 AS start FROM bodies)
  UNION ALL SELECT textbook_id, chapter_id, section_title, body, k, start, ({_STOP})::BIGINT FROM (SELECT textbook_id, chapter_id, section_title, body, k, greatest(stop - 90, start + 1) AS start FROM spans WHERE stop < length(body))
)"""


@query(f"WITH RECURSIVE {_SECTIONS_SQL} SELECT textbook_id, chapter_id, section_title, start::INT AS start, trim(substr(body, start + 1, stop - start), ' ' || chr(10)) AS text FROM spans")
def section_windows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    for a, b in ((" the ", "\n## the "), (". ", "。"), (", ", "；")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return chunk.chunk_windows(d.select(F.col("source").alias("textbook_id"), F.format_string("ch_%03d", "doc_id").alias("chapter_id"), text.alias("content")))


# ---- conversations ----------------------------------------------------------------------------------

# Words of the given conversations in place of the Chinese ones.
INTENT_WORDS = (("explain_decision", ("Than", "Eau")), ("keep", ("the", "les")), ("split", ("die", "que")), ("query_rag", ("nicht", "para")))
_ANY = lambda words: " OR ".join(f"contains(content, '{w}')" for w in words)
MESSAGES_SQL = """messages AS (SELECT conv_id AS session_id, turn AS id, role, text AS content FROM conversations)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"))


@query(f"""WITH {MESSAGES_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS k FROM messages)
SELECT session_id, id, role, content, row_number() OVER (PARTITION BY session_id ORDER BY id) AS position FROM k WHERE k <= 3""")
def recent_history(spark, sf_dir):
    """The last three turns: the given conversations are short."""
    return converse.recent_history(messages(spark, sf_dir), 3)


_INTENTS_SQL = f"""{MESSAGES_SQL}, intents AS (
  SELECT session_id, id, content, CASE WHEN id % 2 = 0 AND ({_ANY(INTENT_WORDS[0][1])}) THEN 'explain_decision' WHEN id % 2 = 0 AND ({_ANY(INTENT_WORDS[1][1])}) THEN 'keep' WHEN id % 2 = 0 AND ({_ANY(INTENT_WORDS[2][1])}) THEN 'split'
    WHEN suffix(trim(content), '?') OR contains(content, '？') OR {_ANY(INTENT_WORDS[3][1])} THEN 'query_rag' ELSE 'summarize_integration' END AS intent FROM messages
)"""


@query(f"WITH {_INTENTS_SQL} SELECT session_id, id, intent FROM intents")
def intents(spark, sf_dir):
    """Only messages of even turns have a decision to speak of."""
    m = messages(spark, sf_dir).withColumn("has_decision", F.col("id") % 2 == 0)
    return converse.intents(m, INTENT_WORDS).select("session_id", "id", "intent")


# Decisions: one per lexical name, in order of name, its reason the first definition.
DECISIONS_SQL = f"""{NODES}, decisions AS (
  SELECT printf('{RUN}_keep_%04d', row_number() OVER (ORDER BY name)) AS decision_id, 'keep' AS action, name AS reason, 0.82::DOUBLE AS confidence, row_number() OVER (ORDER BY name) - 1 AS position FROM (SELECT DISTINCT name FROM nodes)
)"""


def some_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusweave.functions.ranking import numbered

    d = numbered(nodes(spark, sf_dir).select("name").distinct(), "position", F.col("name"))
    return written(d.select(F.format_string(f"{RUN}_keep_%04d", F.col("position") + 1).alias("decision_id"), F.lit("keep").alias("action"), F.col("name").alias("reason"), F.lit(0.82).alias("confidence"), "position"))


LOOKUP_SQL = f"""{DECISIONS_SQL}, {MESSAGES_SQL}, tl AS (SELECT session_id, id, regexp_extract_all(content, '([一-龥A-Za-z]{{2,12}})', 1) AS l FROM messages
), tt AS (SELECT session_id, id, unnest(l) AS term, unnest(range(1, len(l) + 1)) AS k FROM tl), dt AS (
  SELECT term, first(decision_id ORDER BY position) AS decision_id FROM (SELECT DISTINCT term FROM tt) JOIN decisions ON contains(reason, term) GROUP BY term
), byterm AS (SELECT session_id, id, first(decision_id ORDER BY k) AS decision_id FROM tt JOIN dt USING (term) GROUP BY 1, 2
), lookup AS (SELECT session_id, id, coalesce(decision_id, '{RUN}_keep_0001') AS decision_id FROM messages LEFT JOIN byterm USING (session_id, id))"""


@query(f"WITH {LOOKUP_SQL} SELECT * FROM lookup")
def decision_lookup(spark, sf_dir):
    return converse.decision_lookup(messages(spark, sf_dir), some_decisions(spark, sf_dir).withColumn("haystack", F.col("reason")))


_FEEDBACK_SQL = f"""{LOOKUP_SQL}, {'intents AS' + _INTENTS_SQL.split(', intents AS', 1)[1]}, said AS (
  SELECT decision_id, string_agg(CASE WHEN intent = 'split' THEN ' 教师反馈：要求拆分该合并簇，系统已取消 merge 并转为 keep。' ELSE ' 教师反馈：要求保留该知识点，系统已将决策调整为 keep。' END, '' ORDER BY session_id, id) AS notes
  FROM lookup JOIN intents USING (session_id, id) WHERE intent IN ('keep', 'split') GROUP BY 1
), after AS (SELECT decision_id, 'keep' AS action, reason || coalesce(notes, '') AS reason, CASE WHEN notes IS NULL THEN confidence ELSE 0.96::DOUBLE END AS confidence FROM decisions LEFT JOIN said USING (decision_id))"""


def said(spark: SparkSession, sf_dir: str, d: DataFrame) -> DataFrame:
    """(decision_id, id, intent) of every message; id orders by session and turn."""
    m = messages(spark, sf_dir)
    found = converse.decision_lookup(m, d.withColumn("haystack", F.col("reason")))
    meant = converse.intents(m.withColumn("has_decision", F.col("id") % 2 == 0), INTENT_WORDS)
    return meant.join(found, ["session_id", "id"]).select("decision_id", F.struct("session_id", "id").alias("id"), "intent")


@query(f"WITH {_FEEDBACK_SQL} SELECT * FROM after")
def feedback(spark, sf_dir):
    d = some_decisions(spark, sf_dir)
    return converse.apply_feedback(d, said(spark, sf_dir, d)).select("decision_id", "action", "reason", "confidence")


# Messages that ask for, keep and split decisions, by id, by link and by their words, and questions.
_TALK_SQL = f"""{NODES}, decisions AS (
  SELECT printf('{RUN}_%s_%04d', action, p) AS decision_id, action, name AS reason, CASE action WHEN 'merge' THEN 0.86 ELSE 0.82 END::DOUBLE AS confidence FROM (SELECT name, row_number() OVER (ORDER BY name) AS p, CASE WHEN p % 3 = 0 THEN 'merge' ELSE 'keep' END AS action FROM (SELECT DISTINCT name FROM nodes))
), listing AS (SELECT *, row_number() OVER (ORDER BY CASE action WHEN 'merge' THEN 0 ELSE 1 END, confidence DESC, decision_id) - 1 AS position FROM decisions
), messages AS (SELECT conv_id AS session_id, turn AS id, CASE (conv_id + turn) % 8 WHEN 0 THEN '为什么 [[' || substr(text, 1, 5) || ']]' WHEN 1 THEN '保留 ' || text WHEN 2 THEN '请分开 ' || text WHEN 3 THEN '不要合并 {RUN}_merge_0003 ' || text WHEN 4 THEN text || '？' WHEN 5 THEN '解释 {RUN}_keep_0002' ELSE text END AS content FROM conversations
), meant AS (
  SELECT session_id, id, content, CASE WHEN regexp_matches(content, '为什么|解释|原因') THEN 'explain_decision' WHEN regexp_matches(content, '保留|不要删除|不删除') THEN 'keep' WHEN regexp_matches(content, '不要合并|分开|拆开|不是同一个') THEN 'split'
    WHEN suffix(trim(content), '?') OR regexp_matches(content, '？|什么|如何|请问') THEN 'query_rag' ELSE 'summarize_integration' END AS intent FROM messages
), need AS (SELECT *, regexp_extract(content, '(run_[A-Za-z0-9_]+|manual_[A-Za-z0-9_]+|[A-Za-z0-9_]+_(?:merge|keep|remove)_\\d{{4}})', 1) AS needle, regexp_extract_all(content, '\\[\\[([^\\]]+)\\]\\]', 1) AS linked, intent = 'split' AS merges FROM meant WHERE intent IN ('explain_decision', 'keep', 'split')
), tl AS (SELECT session_id, id, merges, CASE WHEN len(linked) > 0 THEN linked ELSE regexp_extract_all(content, '([一-龥A-Za-z]{{2,12}})', 1) END AS l FROM need
), tt AS (SELECT session_id, id, merges, unnest(l) AS term, unnest(range(1, len(l) + 1)) AS k FROM tl
), dt AS (SELECT term, merges, first(decision_id ORDER BY position) AS decision_id FROM (SELECT DISTINCT term, merges FROM tt) JOIN listing ON contains(reason, term) AND (NOT merges OR action = 'merge') GROUP BY 1, 2
), byterm AS (SELECT session_id, id, first(decision_id ORDER BY k) AS by_term FROM tt JOIN dt USING (term, merges) GROUP BY 1, 2
), byid AS (SELECT needle, merges, first(decision_id ORDER BY position) AS by_id FROM (SELECT DISTINCT needle, merges FROM need WHERE needle <> '') JOIN listing ON contains(decision_id, needle) AND (NOT merges OR action = 'merge') GROUP BY 1, 2
), lookup AS (
  SELECT session_id, id, coalesce(by_id, by_term, (SELECT first(decision_id ORDER BY position) FROM listing WHERE NOT merges OR action = 'merge')) AS decision_id FROM need LEFT JOIN byid USING (needle, merges) LEFT JOIN byterm USING (session_id, id)
)"""


def talk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(messages, decisions): some decisions are merges, messages name decisions by id, link and word."""
    from corpusweave.functions.ranking import numbered

    d = numbered(nodes(spark, sf_dir).select("name").distinct(), "p", F.col("name"))
    action = F.when((F.col("p") + 1) % 3 == 0, "merge").otherwise("keep")
    decisions = written(d.select(F.format_string(f"{RUN}_%s_%04d", action, F.col("p") + 1).alias("decision_id"), action.alias("action"), F.col("name").alias("reason"), F.when(action == "merge", 0.86).otherwise(0.82).alias("confidence")))
    kind, text = (F.col("conv_id") + F.col("turn")) % 8, F.col("text")
    content = (
        F.when(kind == 0, F.concat(F.lit("为什么 [["), F.substring(text, 1, 5), F.lit("]]"))).when(kind == 1, F.concat(F.lit("保留 "), text)).when(kind == 2, F.concat(F.lit("请分开 "), text))
        .when(kind == 3, F.concat(F.lit(f"不要合并 {RUN}_merge_0003 "), text)).when(kind == 4, F.concat(text, F.lit("？"))).when(kind == 5, F.lit(f"解释 {RUN}_keep_0002")).otherwise(text)
    )
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), content.alias("content")), decisions


def _listing(decisions: DataFrame) -> DataFrame:
    return written(integrate.decision_listing(decisions).withColumn("haystack", F.col("reason")))


@query(f"""WITH {_TALK_SQL} SELECT session_id, id, intent, decision_id, CASE WHEN intent IN ('keep', 'split') THEN 'modify_decision' ELSE intent END AS tool, CASE intent WHEN 'explain_decision' THEN '这条决策的理由是：' || reason WHEN 'keep' THEN '已更新：' || decision_id || ' 调整为 keep。' WHEN 'split' THEN '已更新：' || decision_id || ' 已由 merge 调整为 keep。'
  WHEN 'query_rag' THEN 'answer to ' || content ELSE '当前还没有整合结果。请先运行 Phase 3 跨教材整合。' END AS reply FROM meant LEFT JOIN lookup USING (session_id, id) LEFT JOIN listing USING (decision_id)""")
def message_turns(spark, sf_dir):
    """Whole turns of conversations; the answers to questions stand in for those of retrieval."""
    m, d = talk(spark, sf_dir)
    answers = m.select("session_id", "id", F.concat(F.lit("answer to "), "content").alias("answer"))
    return converse.message_turns(m, _listing(d), spark.createDataFrame([], "reply string"), answers)


@query("""SELECT '当前整合结果：' || count(DISTINCT source) || ' 本教材，' || count(*) || ' 条 merge、' || count(DISTINCT text) || ' 条 keep、' || count(DISTINCT lang) || ' 条 remove，压缩比 ' || printf('%.1f', count(DISTINCT text) / count(*) * 100) || '%。' AS reply FROM documents""")
def status_reply(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return converse.status_reply(d.agg(F.countDistinct("source").alias("original_textbooks"), F.count("*").alias("decisions_merge"), F.countDistinct("text").alias("decisions_keep"), F.countDistinct("lang").alias("decisions_remove"), (F.countDistinct("text") / F.count("*")).alias("compression_ratio")))


# ---- keyed tables -------------------------------------------------------------------------------------

# Orders at version 1; each fifth comes again at version 2 with another status, each seventh is new.
@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'Z' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS version FROM orders
UNION ALL SELECT -1 - o_orderkey, o_orderstatus, 2 FROM orders WHERE o_orderkey % 7 = 0""")
def keyed_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    base = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("version"))
    delta = base.filter("id % 5 = 0").select("id", F.lit("Z").alias("status"), F.lit(2).alias("version")).unionByName(base.filter("id % 7 = 0").select((-1 - F.col("id")).alias("id"), "status", F.lit(2).alias("version")))
    return tables.upsert(base, delta, ["id"], "version")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'Z' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS version FROM orders
UNION ALL SELECT -1 - o_orderkey, o_orderstatus, 3 FROM orders WHERE o_orderkey % 7 = 0""")
def keyed_table(spark, sf_dir):
    """A stored table of all orders that two merges change, the second with new keys."""
    path = _folder(spark)
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("version"))
    keyed.create_table(base, path, ["id"])
    keyed.merge_into(path, base.filter("id % 5 = 0").select("id", F.lit("Z").alias("status"), F.lit(2).alias("version")), "version")
    return keyed.merge_into(path, base.filter("id % 7 = 0").select((-1 - F.col("id")).alias("id"), "status", F.lit(3).alias("version")), "version")


@query("""SELECT c_nationkey, c_custkey, c_name AS name FROM customer WHERE c_nationkey % 4 <> 0 UNION ALL SELECT c_nationkey, c_custkey, 'new ' || c_name FROM customer WHERE c_nationkey % 4 = 0 AND c_custkey % 2 = 0
UNION ALL SELECT c_nationkey, c_custkey, c_name FROM customer WHERE c_nationkey % 4 = 0 AND c_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey % 4 = 0 AND c_custkey % 2 = 0)""")
def slice_replace(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.col("c_name").alias("name"))
    return tables.replace_slices(c, c.filter("c_nationkey % 4 = 0 AND c_custkey % 2 = 0").withColumn("name", F.concat(F.lit("new "), "name")), "c_nationkey")


@query(f"""WITH {CHAPTERS}, {BOOKS}, gone AS (SELECT textbook_id FROM books WHERE total_chars % 2 = 0)
SELECT 'textbook' AS kind, textbook_id AS id FROM books WHERE textbook_id NOT IN (SELECT textbook_id FROM gone) UNION ALL SELECT 'chapter', chapter_id FROM chapters WHERE textbook_id NOT IN (SELECT textbook_id FROM gone)""")
def cascade_delete(spark, sf_dir):
    b, c = books(spark, sf_dir), chapters(spark, sf_dir)
    kept, kids = tables.cascade_delete(b, [c], b.filter("total_chars % 2 = 0"), "textbook_id")
    return kept.select(F.lit("textbook").alias("kind"), F.col("textbook_id").alias("id")).unionByName(kids.select(F.lit("chapter").alias("kind"), F.col("chapter_id").alias("id")))


@query(f"""WITH {CHAPTERS}, {BOOKS} SELECT 'textbook' AS kind, textbook_id AS id, CASE WHEN total_chars % 2 = 0 THEN title || ' 2' ELSE title END AS title FROM books
UNION ALL SELECT 'chapter', chapter_id, title FROM chapters WHERE textbook_id IN (SELECT textbook_id FROM books WHERE total_chars % 2 <> 0)""")
def replace_cascade(spark, sf_dir):
    b, c = books(spark, sf_dir).withColumn("version", F.lit(1)), chapters(spark, sf_dir)
    delta = b.filter("total_chars % 2 = 0").withColumns({"title": F.concat("title", F.lit(" 2")), "version": F.lit(2)})
    kept, kids = tables.replace_parents(b, delta, [c], "textbook_id", "version")
    return kept.select(F.lit("textbook").alias("kind"), F.col("textbook_id").alias("id"), "title").unionByName(kids.select(F.lit("chapter").alias("kind"), F.col("chapter_id").alias("id"), "title"))


@query("SELECT doc_id, to_json(string_split(text, ' ')) AS words_json, len(string_split(text, ' ')) AS n_words FROM documents")
def json_lists(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tables.to_json_list(F.split("text", " ")).alias("words_json"))
    return d.select("doc_id", "words_json", F.size(tables.from_json_list(F.col("words_json"))).cast("long").alias("n_words"))


@query("SELECT vec_id, len(embedding) AS width, len(embedding) * 4 AS bytes, embedding FROM embeddings")
def vector_blobs(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", tables.vector_to_blob("embedding").alias("blob"))
    back = v.withColumn("embedding", tables.blob_to_vector("blob"))
    return back.select("vec_id", F.size("embedding").cast("long").alias("width"), F.length("blob").cast("long").alias("bytes"), "embedding")


# ---- streams ------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


@query(f"WITH {NODES}, n AS (SELECT textbook_id, count(*) AS nodes FROM nodes GROUP BY 1) SELECT c.textbook_id, count(*) AS done, any_value(nodes) AS nodes FROM chapters c JOIN n USING (textbook_id) GROUP BY 1")
def stream_progress(spark, sf_dir):
    d = _stream(spark, sf_dir, "documents").select(F.col("source").alias("textbook_id"), F.col("doc_id").cast("string").alias("chapter_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"))
    path = _folder(spark)
    flows.progress(d, TERMS, path).awaitTermination()
    return flows.progressed(spark, path)


@query("SELECT user_id AS id, count(*) AS clicks FROM events GROUP BY 1")
def stream_clicks(spark, sf_dir):
    e = _stream(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("id"))
    path = _folder(spark)
    flows.clicks(e, path).awaitTermination()
    return flows.latest(spark, path)


@query(f"WITH {_FEEDBACK_SQL} SELECT * FROM after")
def stream_feedback(spark, sf_dir):
    d = some_decisions(spark, sf_dir)
    path, inbox = _folder(spark), _folder(spark)
    said(spark, sf_dir, d).select("decision_id", "id.session_id", "id.id", "intent").write.parquet(inbox)
    arriving = spark.readStream.schema(spark.read.parquet(inbox).schema).parquet(inbox)
    flows.feedback(arriving, d, path).awaitTermination()
    return flows.decided(spark, path).select("decision_id", "action", "reason", "confidence")


@query(f"""WITH {_TALK_SQL}, said AS (
  SELECT decision_id, string_agg(CASE WHEN intent = 'split' THEN ' 教师反馈：要求拆分该合并簇，系统已取消 merge 并转为 keep。' ELSE ' 教师反馈：要求保留该知识点，系统已将决策调整为 keep。' END, '' ORDER BY session_id, id) AS notes
  FROM lookup JOIN meant USING (session_id, id) WHERE intent IN ('keep', 'split') GROUP BY 1
) SELECT decision_id, CASE WHEN notes IS NULL THEN action ELSE 'keep' END AS action, reason || coalesce(notes, '') AS reason, CASE WHEN notes IS NULL THEN confidence ELSE 0.96::DOUBLE END AS confidence FROM decisions LEFT JOIN said USING (decision_id)""")
def stream_turns(spark, sf_dir):
    """Raw messages as a stream, to decisions."""
    m, d = talk(spark, sf_dir)
    path, inbox = _folder(spark), _folder(spark)
    m.write.parquet(inbox)
    flows.turns(spark.readStream.schema(m.schema).parquet(inbox), d, path).awaitTermination()
    return flows.decided(spark, path)


# Each document is a file; each third comes again, changed, in the same inbox, and each seventh is of an unknown format.
_FILES_SQL = """files AS (
  SELECT 'file ' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.exe' ELSE '.md' END AS filename, CASE WHEN doc_id % 3 = 0 THEN 'new ' || text ELSE text END AS content FROM documents
), books AS (SELECT 'tb_' || substr(md5(filename), 1, 8) AS textbook_id, regexp_replace(filename, '[.][^.]*$', '') AS title, content FROM files WHERE NOT suffix(filename, '.exe') AND trim(content) <> ''
), chapters AS (SELECT textbook_id, 'ch_001' AS chapter_id, '全文' AS title, content, NULL::INT AS page_start, NULL::INT AS page_end FROM books)"""


@query(f"WITH RECURSIVE {WINDOWS_SQL.replace(CHAPTERS + ', ' + BOOKS, _FILES_SQL)} SELECT chunk_id, textbook_id, chapter_id, start, text FROM chunks")
def stream_ingest(spark, sf_dir):
    d, inbox, path = table(spark, sf_dir, "documents"), _folder(spark), _folder(spark)
    name = F.concat(F.lit("file "), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".exe").otherwise(".md"))
    first = d.select(name.alias("filename"), F.col("text").alias("content"), F.lit(1).alias("modified"))
    again = d.filter("doc_id % 3 = 0").select(name.alias("filename"), F.concat(F.lit("new "), "text").alias("content"), F.lit(2).alias("modified"))
    first.unionByName(again).write.parquet(inbox)
    flows.ingest(spark.readStream.schema(spark.read.parquet(inbox).schema).parquet(inbox), path).awaitTermination()
    return flows.ingested(spark, path, "chunks").select("chunk_id", "textbook_id", "chapter_id", "start", "text")
