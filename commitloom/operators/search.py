"""Hybrid retrieval for batches of questions: BM25, vectors, graph seeds, fusion and rescoring."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commitloom import fixed
from commitloom.functions import text as X
from commitloom.operators import vectors as V
from commitloom.operators.index import TextIndex, postings, rank  # noqa: F401
from commitloom.operators.skew import top_per_group
from commitloom.session import cut_lineage

QUERY = ("query_id",)


def corpus_stats(docs: DataFrame, text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """Number of documents and their average length."""
    length = F.size(X.tokenize(F.col(text)))
    return docs.groupBy(*by).agg(F.count("*").alias("n_docs"), F.avg(length).alias("avg_len"))


def document_frequency(posting: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return posting.groupBy(*by, "term").agg(F.count("*").alias("df"))


def bm25(
    queries: DataFrame, docs: DataFrame, k: int = fixed.LIST_LENGTH, query_text: str = "question", text: str = "text",
    k1: float = fixed.BM25_K1, b: float = fixed.BM25_B,
) -> DataFrame:
    """The ``k`` best documents of every query: (query_id, doc_id, score, position).

    Indexes ``docs`` first; where the same documents are asked again, keep a ``TextIndex`` and call ``index.rank``.
    """
    index = TextIndex.fresh(docs.sparkSession)
    index.update(docs.select("doc_id", F.col(text).alias("text")))
    return rank(queries, index, k, query_text, k1, b)


def vector_topk(
    queries: DataFrame, vectors: DataFrame, k: int = fixed.LIST_LENGTH, by: Sequence[str] = (), vector: str = "vector"
) -> DataFrame:
    """The ``k`` vectors with the largest dot product per query, among those of equal width: exact.

    Puts the vectors into blocks first; where they are asked again, keep ``vectors.build`` and call ``vectors.topk``.
    """
    return V.topk(queries, V.build(vectors, by, vector), k, by, vector)[0]


def candidate_list(rows: DataFrame, name: str, query: Sequence[str] = QUERY) -> DataFrame:
    """A ranked list in fusion form; ``position`` is 1-based and repeated documents stay."""
    return rows.select(*query, "doc_id", F.lit(name).alias("list"), (F.col("position") - 1).alias("rank0"))


def rrf_fuse(lists: Sequence[DataFrame], query: Sequence[str] = QUERY) -> DataFrame:
    """Reciprocal rank fusion with list weights; every occurrence of a document adds."""
    every = reduce(lambda a, b: a.unionByName(b), lists)
    weight = reduce(
        lambda acc, item: F.when(F.col("list") == item[0], item[1]).otherwise(acc), fixed.LIST_WEIGHTS.items(), F.lit(0.0)
    )
    return every.groupBy(*query, "doc_id").agg(
        F.sum(weight / (F.col("rank0") + fixed.FUSION_OFFSET)).alias("score"),
        F.array_sort(F.collect_set("list")).alias("reasons"),
    )


def _owned(chunks: DataFrame) -> DataFrame:
    """(owner, doc_id, chunk_index): every chunk below the node that owns it and, where it has one, below its file."""
    own = chunks.select("owner", "doc_id", "chunk_index")
    if "file_key" not in chunks.columns:
        return own
    return own.unionByName(chunks.where(F.col("file_key").isNotNull()).select(F.col("file_key").alias("owner"), "doc_id", "chunk_index")).distinct()


def chunks_for_nodes(nodes: DataFrame, chunks: DataFrame, k: int, query: Sequence[str] = QUERY) -> DataFrame:
    """The first ``k`` chunks of every node (query, key, node_position): (query, doc_id, position).

    ``chunks`` holds (doc_id, owner, chunk_index) and may hold file_key: a file then stands for all chunks of the file, also
    those its entities own. Positions follow nodes, then chunk order.
    """
    first = top_per_group(_owned(chunks), ["owner"], [F.col("chunk_index"), F.col("doc_id")], k)
    rows = nodes.join(first, nodes["key"] == first["owner"]).select(*query, "node_position", "chunk_index", "doc_id")
    # a query has at most a few dozen nodes with k chunks each
    order = Window.partitionBy(*query).orderBy("node_position", "chunk_index", "doc_id")
    return rows.withColumn("position", F.row_number().over(order))


def anchor_expand(
    fused: DataFrame, seeds: DataFrame, chunks: DataFrame, capped: DataFrame, anchors: int = 6, query: Sequence[str] = QUERY
) -> DataFrame:
    """First chunks of the strongest neighbours of the best fused chunks and the seeds.

    ``capped`` holds every node's best neighbours (key, other, position).
    """
    best = top_per_group(fused, query, [F.round("score", 9).desc(), F.col("doc_id")], anchors, rank="_rank")
    owners = best.join(chunks.select("doc_id", F.col("owner").alias("key")), "doc_id").select(
        *query, "key", (F.col("_rank") + 1000).alias("_order")
    )
    starts = seeds.select(*query, "key", F.col("position").alias("_order")).unionByName(owners)
    keys = starts.groupBy(*query, "key").agg(F.min("_order").alias("_order"))
    near = keys.join(capped.select("key", "other", F.col("position").alias("_p")), "key")
    nodes = near.select(*query, F.col("other").alias("key"), (F.col("_order") * 100 + F.col("_p")).alias("node_position"))
    return chunks_for_nodes(nodes, chunks, 1, query)


def rescore(fused: DataFrame, queries: DataFrame, chunks: DataFrame, query_text: str = "question", query: Sequence[str] = QUERY) -> DataFrame:
    """A bonus for path or entity terms shared with the query; test folders count less unless asked for."""
    terms = queries.select(*query, X.tokenize(F.col(query_text)).alias("_q"))
    where = chunks.select("doc_id", "path", X.tokenize(F.concat_ws(" ", "path", "entity_name")).alias("_p"))
    joined = fused.join(terms, list(query)).join(where, "doc_id")
    raised = F.col("score") + F.when(F.arrays_overlap("_p", "_q"), 0.004).otherwise(0.0)
    asked = F.array_contains("_q", "test") | F.array_contains("_q", "tests")
    lowered = F.when(F.col("path").rlike(fixed.TEST_DIRECTORY_PATTERN) & ~asked, 0.8).otherwise(1.0)
    return joined.withColumn("score", raised * lowered).drop("_q", "_p")


def cap_per_group(scored: DataFrame, group: str, per_group: int = 3, k: int = 10, query: Sequence[str] = QUERY) -> DataFrame:
    """The ``k`` best rows of every query with at most ``per_group`` per group."""
    order = [F.round("score", 9).desc(), F.col("doc_id")]
    few = top_per_group(scored, [*query, group], order, per_group)
    return top_per_group(few, query, order, k, rank="position")


def retrieve(
    queries: DataFrame, chunks: DataFrame, seeds: DataFrame, capped: DataFrame,
    vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, k: int = 10,
) -> DataFrame:
    """Best chunks of every question: keyword, vector and graph lists fused, expanded and rescored.

    ``chunks`` holds (doc_id, path, owner, chunk_index, entity_name, text); ``seeds`` (query_id, key,
    position). Without vectors the mode is keyword only.
    """
    # words of the path and the entity's name find a chunk as words of its text do
    indexed = chunks.select("doc_id", F.concat_ws(" ", "path", "entity_name", "text").alias("text"))
    # what several steps read is written once: the lists and seeds are a few dozen rows a question
    seeds = cut_lineage(seeds)
    lists = [cut_lineage(candidate_list(bm25(queries, indexed), "keyword"))]
    if vectors is not None and query_vectors is not None:
        lists.append(cut_lineage(candidate_list(vector_topk(query_vectors, vectors), "semantic")))
    lists.append(candidate_list(chunks_for_nodes(seeds.withColumn("node_position", F.col("position")), chunks, 3), "graph-match"))
    first = rrf_fuse(lists)
    lists.append(candidate_list(anchor_expand(first, seeds, chunks, capped), "graph-neighbour"))
    final = rescore(rrf_fuse(lists), queries, chunks)
    return cap_per_group(final, "path", 3, k).withColumn(
        "mode", F.lit("keyword" if vectors is None else "hybrid")
    )


def context_table(picked: DataFrame, chunks: DataFrame, most_chars: int | None = None) -> DataFrame:
    """Numbered excerpts of the picked chunks, whole or their first ``most_chars`` characters."""
    body = chunks.select("doc_id", "text", "start_line", "end_line")
    header = F.concat(
        F.lit("["), F.col("position").cast("string"), F.lit("] "), F.col("path"), F.lit(":"),
        F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"),
    )
    text = F.col("text") if most_chars is None else F.substring("text", F.lit(1), F.lit(most_chars))
    return picked.join(body, "doc_id").select("query_id", "position", F.concat(header, F.lit("\n"), text).alias("excerpt"))


def retrieved_facts(picked: DataFrame, seeds: DataFrame, chunks: DataFrame, facts: DataFrame, query: Sequence[str] = QUERY) -> DataFrame:
    """(query, position, key, fact): the facts of a question's seeds, then of the nodes that own its chunks, each once."""
    owners = picked.join(chunks.select("doc_id", "owner"), "doc_id").select(*query, F.col("owner").alias("key"), F.lit(1).alias("_part"), F.col("position").alias("_at"))
    keys = seeds.select(*query, "key", F.lit(0).alias("_part"), F.col("position").alias("_at")).unionByName(owners)
    first = keys.groupBy(*query, "key").agg(F.min(F.struct("_part", "_at")).alias("_first"))
    known = first.join(facts.select("key", "fact"), "key")
    # a question has a few seeds and chunks
    order = Window.partitionBy(*query).orderBy("_first", "key")
    return known.withColumn("position", F.row_number().over(order)).select(*query, "position", "key", "fact")


def earlier_answers(
    questions: DataFrame, log: DataFrame, most: int = 3, most_chars: int | None = None, by: Sequence[str] = ("repo_id",), at: str = "created_at",
    query: Sequence[str] = QUERY,
) -> DataFrame:
    """(query, conversation): the newest ``most`` answers of the log before each question, oldest first, as one text.

    ``questions`` holds (query, keys, at), ``log`` (keys, at, question, answer). Answers are numbered by time within their
    keys, and a question asks for the last numbers before it, so no question meets all answers.
    """
    answered = log.where(F.col("answer").isNotNull())
    order = Window.partitionBy(*by).orderBy(at, "question", "answer")
    numbered = answered.withColumn("_n", F.row_number().over(order))
    # how many answers came before: the running count over both tables, questions first at equal times
    both = answered.select(*by, at, F.lit(1).alias("_is"), *[F.lit(None).cast(questions.schema[c].dataType).alias(c) for c in query]).unionByName(
        questions.select(*by, at, F.lit(0).alias("_is"), *query))
    running = Window.partitionBy(*by).orderBy(at, "_is").rowsBetween(Window.unboundedPreceding, 0)
    asked = both.withColumn("_before", F.sum("_is").over(running)).where(F.col("_is") == 0)
    wanted = asked.select(*by, *query, F.explode(F.sequence(F.greatest(F.col("_before") - most + 1, F.lit(1)), F.greatest("_before", F.lit(1)))).alias("_n")).where(F.col("_before") > 0)
    body = F.col("answer") if most_chars is None else F.substring("answer", F.lit(1), F.lit(most_chars))
    line = F.concat(F.lit("Asked: "), F.col("question"), F.lit("\nAnswered: "), body)
    listed = wanted.join(numbered, [*by, "_n"]).groupBy(*query).agg(F.array_sort(F.collect_list(F.struct("_n", line.alias("t")))).alias("_l"))
    return listed.select(*query, F.array_join(F.transform("_l", lambda x: x["t"]), "\n\n").alias("conversation"))


def question_context(questions: DataFrame, excerpts: DataFrame, facts: DataFrame, earlier: DataFrame, query: Sequence[str] = QUERY) -> DataFrame:
    """(query, context): what is known for a question as one text: facts, excerpts, earlier answers, then the question."""
    def joined(rows: DataFrame, line: str, between: str, out: str) -> DataFrame:
        listed = rows.groupBy(*query).agg(F.array_sort(F.collect_list(F.struct("position", F.col(line).alias("t")))).alias("_l"))
        return listed.select(*query, F.array_join(F.transform("_l", lambda x: x["t"]), between).alias(out))

    every = questions.select(*query, "question")
    for part in (joined(facts, "fact", "\n", "_facts"), joined(excerpts, "excerpt", "\n\n", "_excerpts"), earlier.select(*query, "conversation")):
        every = every.join(part, list(query), "left")
    section = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}\n"), F.col(c)))
    return every.select(*query, F.concat_ws(
        "\n\n", section("Known of the graph:", "_facts"), section("Code:", "_excerpts"), section("Said before:", "conversation"), section("Question:", "question")).alias("context"))
