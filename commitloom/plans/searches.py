"""Retrieval queries over documents, questions and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from commitloom.functions import text as X
from commitloom.operators import names as N
from commitloom.operators import search as Q
from commitloom.plans.registry import register
from commitloom.plans.scalars import tokens_sql

c = F.col

BM = tokens_sql("texts", "doc_id", "text", "dtok") + ", " + tokens_sql("questions", "query_id", "question", "qtok") + """,
lens AS (SELECT t.doc_id, count(d.term) AS doc_len FROM texts t LEFT JOIN dtok d ON t.doc_id = d.doc_id GROUP BY 1),
corpus AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_len FROM lens),
posting AS (SELECT doc_id, term, count(*) AS tf FROM dtok GROUP BY 1, 2),
dfreq AS (SELECT term, count(*) AS df FROM posting GROUP BY 1),
bm AS (SELECT q.query_id, p.doc_id, sum(ln(1 + (n_docs - df + .5) / (df + .5)) * tf * 2.4 / (tf + 1.4 * (1 - .72 + .72 * doc_len / avg_len))) AS score
  FROM (SELECT DISTINCT query_id, term FROM qtok) q JOIN posting p ON q.term = p.term JOIN dfreq f ON f.term = q.term
  JOIN lens l ON l.doc_id = p.doc_id, corpus GROUP BY 1, 2),
bmtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS position FROM bm) WHERE position <= 40)"""
TEXT = "texts questions"

CENTROIDS = """dims AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
cent AS (SELECT label AS query_id, i, avg(x) AS x FROM dims GROUP BY 1, 2),
norm AS (SELECT query_id, sqrt(sum(x * x)) AS z FROM cent GROUP BY 1),
vscore AS (SELECT q.query_id, d.vec_id AS doc_id, sum(d.x * q.x / n.z) AS score FROM dims d JOIN cent q ON d.i = q.i JOIN norm n ON n.query_id = q.query_id GROUP BY 1, 2),
vtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS position FROM vscore) WHERE position <= 40)"""


def bm25(t):
    return Q.bm25(t.questions, t.texts)


def label_centroids(t):
    """Unit-length mean vector of every label as a query batch."""
    from commitloom.functions.scores import l2_normalize

    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    mean = parts.groupBy("label", "i").agg(F.avg(c("x").cast("double")).alias("x"))
    vector = mean.groupBy(c("label").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return vector.select("query_id", l2_normalize(F.transform("v", lambda e: e["x"])).alias("vector"))


def stored_vectors(t):
    return t.embeddings.select(c("vec_id").alias("doc_id"), c("embedding").alias("vector"))


def long_position(df):
    return df.withColumn("position", c("position").cast("long"))


@register("a27_corpus_stats", "+ " + BM.split(",\nposting AS")[0] + " SELECT n_docs, round(avg_len, 6) AS avg_len FROM corpus", TEXT)
def a27(t):
    return Q.corpus_stats(t.texts).withColumn("avg_len", F.round("avg_len", 6))


@register("a27_document_frequency", "+ " + BM + " SELECT * FROM dfreq", TEXT)
def a27_df(t):
    return Q.document_frequency(Q.postings(t.texts))


@register("q01_bm25", "+ " + BM + " SELECT query_id, doc_id, round(score, 6) AS score, position FROM bmtop", TEXT)
def q01(t):
    return long_position(bm25(t)).withColumn("score", F.round("score", 6))


@register("q02_vector_topk", "WITH " + CENTROIDS + " SELECT query_id, doc_id, round(score, 6) AS score, position FROM vtop")
def q02(t):
    return long_position(Q.vector_topk(label_centroids(t), stored_vectors(t))).withColumn("score", F.round("score", 6))


# a second list for fusion: documents whose path shares a term with the question, by overlap
OVERLAP = BM + ", " + tokens_sql("texts", "doc_id", "text[1:0] || path", "ptok") + """,
conv AS (SELECT query_id, 'en' AS lang, turn FROM questions),
seedlist AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY tf DESC, doc_id) AS position FROM (
  SELECT q.query_id, p.doc_id, max(p.tf) AS tf FROM (SELECT DISTINCT query_id, term FROM qtok) q JOIN posting p ON q.term = p.term GROUP BY 1, 2)),
lists AS (SELECT query_id, doc_id, 'keyword' AS list, position - 1 AS r, 1.0 AS w FROM bmtop
  UNION ALL SELECT query_id, doc_id, 'graph-match', position - 1, 1.3 FROM seedlist WHERE position <= 3),
fused AS (SELECT query_id, doc_id, sum(w / (60 + r)) AS score, string_agg(DISTINCT list, ',' ORDER BY list) AS reasons FROM lists GROUP BY 1, 2)"""


def seed_list(t):
    """Documents in which some question term is most frequent, the first three per question."""
    from commitloom.operators.skew import salted_join, top_per_group

    terms = X.term_rows(t.questions, "question", "query_id")
    order = [c("tf").desc(), c("doc_id")]
    # a document past a term's first three has three better ones in every question that asks for the term
    held = Q.postings(t.texts).groupBy("term", "doc_id").agg(F.max("tf").alias("tf"))
    first = top_per_group(held, ["term"], order, 3)
    hits = salted_join(terms, first, ["term"], ["query_id"], salts=8)
    best = hits.groupBy("query_id", "doc_id").agg(F.max("tf").alias("tf"))
    return top_per_group(best, ["query_id"], order, 3, rank="position")


def seeds(t):
    """The seed list, written once for all who read it."""
    return t.stored("seeds", seed_list)


def lists(t):
    return [Q.candidate_list(bm25(t), "keyword"), Q.candidate_list(seeds(t), "graph-match")]


def fused(t):
    return Q.rrf_fuse(lists(t))


@register("w12_rrf_rank", "+ " + BM + " SELECT query_id, doc_id, 'keyword' AS list, position - 1 AS rank0 FROM bmtop", TEXT)
def w12(t):
    return Q.candidate_list(bm25(t), "keyword").withColumn("rank0", c("rank0").cast("long"))


@register("u08_candidate_union", "+ " + OVERLAP + " SELECT query_id, doc_id, list, r AS rank0 FROM lists", TEXT)
def u08(t):
    a, b = lists(t)
    return a.unionByName(b).withColumn("rank0", c("rank0").cast("long"))


@register("q03_rrf_fuse", "+ " + OVERLAP + " SELECT query_id, doc_id, round(score, 6) AS score, reasons FROM fused", TEXT)
def q03(t):
    return fused(t).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"))


RESCORED = OVERLAP + """,
overlap AS (SELECT DISTINCT f.query_id, f.doc_id FROM fused f JOIN ptok p ON f.doc_id = p.doc_id JOIN qtok q ON q.query_id = f.query_id AND q.term = p.term),
asked AS (SELECT DISTINCT query_id FROM qtok WHERE term IN ('test', 'tests')),
rescored AS (SELECT f.query_id, f.doc_id, t.path, (f.score + CASE WHEN o.doc_id IS NULL THEN 0 ELSE .004 END)
   * CASE WHEN regexp_matches(t.path, '(^|/)(test|tests|__tests__|spec)/') AND a.query_id IS NULL THEN .8 ELSE 1 END AS score
  FROM fused f JOIN texts t ON f.doc_id = t.doc_id LEFT JOIN overlap o ON o.query_id = f.query_id AND o.doc_id = f.doc_id LEFT JOIN asked a ON a.query_id = f.query_id)"""


def chunk_rows(t):
    return t.texts.select("doc_id", "path", "text", F.lit(None).cast("string").alias("entity_name"))


@register("q05_rescore", "+ " + RESCORED + " SELECT query_id, doc_id, path, round(score, 6) AS score FROM rescored", TEXT)
def q05(t):
    return Q.rescore(fused(t), t.questions, chunk_rows(t)).select("query_id", "doc_id", "path", F.round("score", 6).alias("score"))


@register("u07_path_terms_overlap", "+ " + BM.split(",\nlens AS")[0] + ", " + tokens_sql("texts", "doc_id", "path", "ptok") + """
SELECT DISTINCT q.query_id, p.doc_id FROM qtok q JOIN ptok p ON q.term = p.term""", TEXT)
def u07(t):
    paths = X.term_rows(t.texts, "path", "doc_id")
    asked = X.term_rows(t.questions, "question", "query_id")
    return asked.join(paths, "term").select("query_id", "doc_id").distinct()


@register("w02_cap_per_group", "+ " + RESCORED + """,
grp AS (SELECT r.*, d.source AS src FROM rescored r JOIN documents d ON r.doc_id = d.doc_id),
few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, src ORDER BY round(score, 9) DESC, doc_id) AS rn FROM grp) WHERE rn <= 3)
SELECT query_id, doc_id, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS position FROM few) WHERE position <= 10""", TEXT)
def w02(t):
    scored = Q.rescore(fused(t), t.questions, chunk_rows(t)).join(t.documents.select("doc_id", "source"), "doc_id")
    return long_position(Q.cap_per_group(scored, "source")).select("query_id", "doc_id", "position")


@register("j26_chunks_for_nodes", """
+ q AS (SELECT query_id, 'src' || (conv_id % 20) AS key FROM questions),
f AS (SELECT * FROM (SELECT source AS owner, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3)
SELECT q.query_id, f.doc_id, row_number() OVER (PARTITION BY q.query_id ORDER BY f.doc_id) AS position FROM q JOIN f ON q.key = f.owner""", TEXT)
def j26(t):
    """Every document is a chunk of its own entity in the file of its source; the seeds are the files."""
    own = F.concat(F.lit("d"), c("doc_id").cast("string"))
    chunks = t.documents.select("doc_id", own.alias("owner"), c("source").alias("file_key"), c("doc_id").alias("chunk_index"))
    nodes = t.questions.select(
        "query_id", F.concat(F.lit("src"), (c("conv_id") % 20).cast("string")).alias("key"), F.lit(0).alias("node_position")
    )
    return long_position(Q.chunks_for_nodes(nodes, chunks, 3)).select("query_id", "doc_id", "position")


# mentions: benchmark texts ask about symbols named like frequent words of the documents
def mention_inputs(t):
    words = t.texts.select("doc_id", "lang", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))).alias("name"))
    ents = words.groupBy("lang", "name").agg(F.count("*").alias("n")).select(
        "name", F.concat_ws("#", F.lit("e:x"), "lang", "name").alias("key")
    )
    files = t.texts.select(F.concat(F.lit("f:"), "path").alias("key"), "path")
    asked = t.benchmark.select(c("item_id").alias("query_id"), c("text").alias("question"))
    return asked, ents, files


@register("j23_link_mentions", """
+ ents AS (SELECT DISTINCT lower(w) AS name, 'e:x#' || lang || '#' || w AS key FROM (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-z]{5,}')) AS w FROM texts)),
few AS (SELECT name, list(key ORDER BY key) AS ks FROM ents GROUP BY 1 HAVING count(*) <= 6),
toks AS (SELECT item_id, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*(?:[.][A-Za-z0-9_$]+)*') AS l FROM benchmark)),
named AS (SELECT item_id, pos, unnest(ks[1:3]) AS key, generate_subscripts(ks[1:3], 1) AS i FROM toks t JOIN few f ON lower(string_split(t.token, '.')[-1]) = f.name
  WHERE length(token) >= 3 AND (regexp_matches(token, '[._]|^[A-Z]|^.+[A-Z]') OR (len(ks) = 1 AND length(token) >= 6
    AND f.name NOT IN ('handle','handler','request','response','options','config','settings','process','result','update','create','delete','remove','render','parse','format','string','number','object','values','export','import','module','client','server','service','method','function','return','change','impact','should','happens','startup','architecture','between','without','please','explain','where','which')))),
first AS (SELECT item_id, key, min(pos * 10 + i) AS o FROM named GROUP BY 1, 2)
SELECT item_id AS query_id, key, position FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY o, key) AS position FROM first) WHERE position <= 8""", TEXT)
def j23(t):
    asked, ents, files = mention_inputs(t)
    return long_position(N.link_mentions(asked, ents, files))


def document_neighbours(t):
    """Documents of equal source as neighbours in doc order: (key, other, position)."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("doc_id")
    step = t.documents.select("doc_id", F.lead("doc_id").over(w).alias("next"), F.lag("doc_id").over(w).alias("previous"))
    key = lambda x: F.concat(F.lit("d"), c(x).cast("string"))
    return step.select(
        key("doc_id").alias("key"), F.explode(F.array(F.struct(F.lit(1).alias("position"), key("next").alias("other")), F.struct(F.lit(2).alias("position"), key("previous").alias("other")))).alias("e")
    ).select("key", "e.other", "e.position").where(c("other").isNotNull())


EXPANDED = OVERLAP + """,
nbr AS (SELECT doc_id, lead(doc_id) OVER w AS a, lag(doc_id) OVER w AS b FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
anchors AS (SELECT query_id, doc_id, min(o) AS o FROM (
  SELECT query_id, doc_id, position AS o FROM seedlist WHERE position <= 3
  UNION ALL SELECT query_id, doc_id, 1000 + rn FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rn FROM fused) WHERE rn <= 6) GROUP BY 1, 2),
exp AS (SELECT query_id, x AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY p, x) AS position FROM (
  SELECT an.query_id, n.a AS x, an.o * 100 + 1 AS p FROM anchors an JOIN nbr n ON an.doc_id = n.doc_id WHERE n.a IS NOT NULL
  UNION ALL SELECT an.query_id, n.b, an.o * 100 + 2 FROM anchors an JOIN nbr n ON an.doc_id = n.doc_id WHERE n.b IS NOT NULL))"""


def graph_chunks(t):
    """Every document as the only chunk of its own node."""
    return t.texts.select(
        "doc_id", "path", "text", F.concat(F.lit("d"), c("doc_id").cast("string")).alias("owner"), F.lit(0).alias("chunk_index"),
        F.lit(None).cast("string").alias("entity_name"), F.lit(1).alias("start_line"), X.line_count(c("text")).alias("end_line"),
    )


def document_seeds(t):
    return seeds(t).select("query_id", F.concat(F.lit("d"), c("doc_id").cast("string")).alias("key"), "position")


@register("q04_anchor_expand", "+ " + EXPANDED + " SELECT query_id, doc_id, position FROM exp", TEXT)
def q04(t):
    return long_position(Q.anchor_expand(fused(t), document_seeds(t), graph_chunks(t), document_neighbours(t))).select("query_id", "doc_id", "position")


RETRIEVED = EXPANDED + """,
lists2 AS (SELECT query_id, doc_id, list, r, w FROM lists UNION ALL SELECT query_id, doc_id, 'graph-neighbour', position - 1, .55 FROM exp),
fused2 AS (SELECT query_id, doc_id, sum(w / (60 + r)) AS score FROM lists2 GROUP BY 1, 2),
overlap2 AS (SELECT DISTINCT f.query_id, f.doc_id FROM fused2 f JOIN ptok p ON f.doc_id = p.doc_id JOIN qtok q ON q.query_id = f.query_id AND q.term = p.term),
final AS (SELECT f.query_id, f.doc_id, t.path, f.score + CASE WHEN o.doc_id IS NULL THEN 0 ELSE .004 END AS score FROM fused2 f JOIN texts t ON f.doc_id = t.doc_id
  LEFT JOIN overlap2 o ON o.query_id = f.query_id AND o.doc_id = f.doc_id),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS position FROM final) WHERE position <= 10)"""


# Chunks are indexed with their path (these have no entity name); seeds are still found by words of the text.
_TEXT_WORDS = tokens_sql("texts", "doc_id", "text", "dtok")
_INDEXED_WORDS = tokens_sql("texts", "doc_id", "text", "stok") + ", " + tokens_sql("texts", "doc_id", "concat_ws(' ', path, text)", "dtok")
RETRIEVED = RETRIEVED.replace(_TEXT_WORDS, _INDEXED_WORDS).replace(
    "max(p.tf) AS tf FROM (SELECT DISTINCT query_id, term FROM qtok) q JOIN posting p",
    "max(p.tf) AS tf FROM (SELECT DISTINCT query_id, term FROM qtok) q JOIN (SELECT doc_id, term, count(*) AS tf FROM stok GROUP BY 1, 2) p",
)


def retrieved(t):
    return Q.retrieve(t.questions, graph_chunks(t), document_seeds(t), document_neighbours(t))


@register("q06_retrieve", "+ " + RETRIEVED + " SELECT query_id, doc_id, round(score, 6) AS score, position, 'keyword' AS mode FROM picked", TEXT)
def q06(t):
    return long_position(retrieved(t)).select("query_id", "doc_id", F.round("score", 6).alias("score"), "position", "mode")


# the vector of the conversation's number stands for a question, that of the document's number for a document
SEMANTIC = """qvec AS (SELECT q.query_id, e.embedding AS v FROM questions q JOIN embeddings e ON e.vec_id = q.conv_id),
vlist AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS position FROM (
  SELECT q.query_id, e.vec_id AS doc_id, list_dot_product(q.v::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM qvec q, embeddings e WHERE len(q.v) = len(e.embedding)))"""
HYBRID = RETRIEVED.replace("fused AS (SELECT", SEMANTIC + """,
lists0 AS (SELECT * FROM lists UNION ALL SELECT query_id, doc_id, 'semantic', position - 1, 1.1 FROM vlist WHERE position <= 40),
fused AS (SELECT""", 1).replace("AS reasons FROM lists GROUP BY 1, 2)", "AS reasons FROM lists0 GROUP BY 1, 2)").replace("list, r, w FROM lists UNION", "list, r, w FROM lists0 UNION")


def question_vectors(t):
    return t.questions.join(t.embeddings, c("vec_id") == c("conv_id")).select("query_id", c("embedding").alias("vector"))


def hybrid(t):
    return Q.retrieve(t.questions, graph_chunks(t), document_seeds(t), document_neighbours(t), stored_vectors(t), question_vectors(t))


@register("q06_retrieve_hybrid", "+ " + HYBRID + " SELECT query_id, doc_id, round(score, 6) AS score, position, 'hybrid' AS mode FROM picked", TEXT)
def q06_hybrid(t):
    return long_position(hybrid(t)).select("query_id", "doc_id", F.round("score", 6).alias("score"), "position", "mode")


FACTS = """,
factkeys AS (SELECT query_id, doc_id, 0 AS part, position AS spot FROM seedlist WHERE position <= 3 UNION ALL SELECT query_id, doc_id, 1, position FROM picked),
facts AS (SELECT f.query_id, f.doc_id, 'document ' || t.path || ' in ' || t.lang AS fact, row_number() OVER (PARTITION BY f.query_id ORDER BY f.o.part, f.o.spot, 'd' || f.doc_id) AS position
  FROM (SELECT query_id, doc_id, min(struct_pack(part := part, spot := spot)) AS o FROM factkeys GROUP BY 1, 2) f JOIN texts t ON f.doc_id = t.doc_id)"""


def document_facts(t):
    return t.texts.select(F.concat(F.lit("d"), c("doc_id").cast("string")).alias("key"), F.concat(F.lit("document "), "path", F.lit(" in "), "lang").alias("fact"))


def facts(t, picked):
    return Q.retrieved_facts(picked, document_seeds(t), graph_chunks(t), document_facts(t))


@register("q06_retrieved_facts", "+ " + HYBRID + FACTS + " SELECT query_id, position, fact FROM facts", TEXT)
def q06_facts(t):
    return long_position(facts(t, t.stored("hybrid", hybrid))).select("query_id", "position", "fact")


EXCERPTS = """excerpts AS (SELECT p.query_id, p.position, '[' || p.position || '] ' || p.path || ':1-' || len(string_split(t.text, chr(10))) || chr(10) || t.text AS excerpt
FROM picked p JOIN texts t ON p.doc_id = t.doc_id)"""


@register("q07_context_table", "+ " + RETRIEVED + ", " + EXCERPTS + " SELECT * FROM excerpts", TEXT)
def q07(t):
    return long_position(Q.context_table(retrieved(t), graph_chunks(t)))


# an assistant's turn answers the turn before it
EARLIER = """answers AS (SELECT a.conv_id, a.turn, q.text AS question, a.text AS answer, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.turn) AS n
  FROM conversations a JOIN conversations q ON a.conv_id = q.conv_id AND q.turn = a.turn - 1 WHERE a.role = 'assistant'),
earlier AS (SELECT query_id, string_agg('Asked: ' || question || chr(10) || 'Answered: ' || answer, chr(10) || chr(10) ORDER BY n) AS said FROM (
  SELECT q.query_id, a.*, row_number() OVER (PARTITION BY q.query_id ORDER BY a.n DESC) AS back FROM questions q JOIN answers a ON q.conv_id = a.conv_id AND a.turn < q.turn) WHERE back <= 3 GROUP BY 1)"""


@register("q07_question_context", "+ " + HYBRID + FACTS + ", " + EXCERPTS + ", " + EARLIER + """,
f AS (SELECT query_id, string_agg(fact, chr(10) ORDER BY position) AS t FROM facts GROUP BY 1),
x AS (SELECT query_id, string_agg(excerpt, chr(10) || chr(10) ORDER BY position) AS t FROM excerpts GROUP BY 1)
SELECT q.query_id, sha256(concat_ws(chr(10) || chr(10), 'Known of the graph:' || chr(10) || f.t, 'Code:' || chr(10) || x.t, 'Said before:' || chr(10) || e.said, 'Question:' || chr(10) || q.question)) AS digest
FROM questions q LEFT JOIN f ON q.query_id = f.query_id LEFT JOIN x ON q.query_id = x.query_id LEFT JOIN earlier e ON q.query_id = e.query_id""", TEXT)
def q07_context(t):
    picked = t.stored("hybrid", hybrid)
    before = t.conversations.select("conv_id", (c("turn") + 1).alias("turn"), c("text").alias("question"))
    log = t.conversations.where(c("role") == "assistant").select("conv_id", "turn", c("text").alias("answer")).join(before, ["conv_id", "turn"])
    earlier = Q.earlier_answers(t.questions, log, by=["conv_id"], at="turn")
    context = Q.question_context(t.questions, Q.context_table(picked, graph_chunks(t)), facts(t, picked), earlier)
    return context.select("query_id", F.sha2("context", 256).alias("digest"))
