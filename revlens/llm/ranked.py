"""Ranked lexical search by TPUT: exact top-k in three phases over term-partitioned posting lists.

A forward table has one row a document: its terms that some query asks for, with their counts. The posting lists are made of it: range-partitioned by term, then by falling
impact, so a frequent term's list runs on through as many partitions as it needs and the head of each list stands first. A posting's impact g depends on its document alone; a query
weighs it by the term's weight times the term's repeats in the query. Then, for each query:

1. the k best postings of every list give partial sums; the exact scores of the DEEPER * k documents with the largest ones are looked up, and their k-th is a lower bound of the k-th
   score (the k-th partial sum would be one, too, but a far lower one, and the next step would read most of all lists);
2. every list is read down to the same threshold, that bound divided by the number of lists. A document that no list gives here can't reach the bound. What a document
   may still get from lists that did not give it bounds its score from above; only documents that may reach the bound stay, and another look-up of those with the largest sums gives a better bound;
3. documents whose upper bound reaches that one are the candidates, whose exact scores are looked up: their rows of the forward table meet the queries that ask for them, and the few numbers that make up a
   score are picked from a vector in numpy.

The postings that step 2 reads are dealt by document once, before they meet the queries, so what is exchanged is no more than the lists' rows.

Ties are never cut: a document that may equal the k-th score stays a candidate, and the last ranking goes by score, then by id.

The queries are the stated query set. They are read in blocks of at most BLOCK_TERMS words, counting a query's different ones; only a block's vocabulary and its lists (a few numbers a word of a query) are broadcast.

Defined results: null texts have no terms and count neither for N nor for L; rows that share an id or are repeated are documents of their own, ranked by id (null first), then arbitrarily but
repeatably among equal rows; repeated queries count once, and queries that share an id are one with the terms of all; a null query id is kept as null; queries without terms and terms that no document
has give no rows, as do empty tables; a very long text is counted a piece at a time. Other columns are never read, so their names don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import as_bytes, materialize, pieces
from .decontam import numbers_of, split_words

TOP = 20
DEEPER = 5
BLOCK_TERMS = 500_000
_FORWARD = "doc_id long, n long, terms array<int>, counts array<int>"
_RESULT = "rank int, doc_id long, score long"


def _counted(vocabulary):
    """vocabulary: a broadcast of word -> number from 1. One row a text with terms: id, number of all terms, the known ones and their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, "text")):
            ids, totals, terms, counts = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                numbers = numbers_of(text.as_py(), vocabulary.value)
                if len(numbers):
                    own, times = np.unique(numbers[numbers > 0], return_counts=True)
                    ids.append(doc_id)
                    totals.append(len(numbers))
                    terms.append(own.astype(np.int32))
                    counts.append(times.astype(np.int32))
            ends = np.cumsum([0, *map(len, terms)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*x, np.zeros(0, np.int32)]))) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(totals, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return count


def _blocks(queries: DataFrame) -> Iterator[list[tuple[Row, Counter]]]:
    """Queries with their terms' counts, a block at a time; the driver holds one block and the query after it."""
    rows = queries.select("item_id", as_bytes().alias("text")).distinct()
    texts = rows.groupBy("item_id").agg(F.collect_list("text").alias("texts")).toLocalIterator()
    block, words = [], 0
    for row in texts:
        terms = Counter(chain.from_iterable(split_words(bytes(t)) for t in row["texts"]))
        if block and words + len(terms) > BLOCK_TERMS:
            yield block
            block, words = [], 0
        if terms:
            block.append((row, terms))
            words += len(terms)
    if block:
        yield block


def _largest(sums: DataFrame, k: int, of: str = "part") -> DataFrame:
    """The k rows of each query with the largest values, and their `rank`; each task keeps k of a query before they meet."""
    first = sums.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(of), "row")))
    return first.filter(F.col("rank") <= k)


def _kth(sums: DataFrame, k: int, of: str = "part") -> DataFrame:
    """query, bound: the k-th largest value, for queries that have k."""
    return _largest(sums, k, of).filter(F.col("rank") == k).select("query", F.col(of).alias("bound"))


def _scored(lists, n_docs: int, n_terms: int):
    """lists: a broadcast of query -> its terms and their weights. Rows of the forward table with `queries` -> query, row, doc_id, score."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        impacts = np.zeros(1 + max((int(t.max()) for t, _ in lists.value.values()), default=0), np.int64)
        for batch in batches:
            queries, scores, times = [], [], []
            for n, terms, counts, asked in zip(*(batch.column(c) for c in ("n", "terms", "counts", "queries")), strict=True):
                m, tf, asked = 75 + 25 * n.as_py() * n_docs // n_terms, counts.values.to_numpy().astype(np.int64), asked.as_py()
                at = terms.values.to_numpy()
                impacts[at] = 1_000_000_000 * tf // (1000 * tf + 12 * m)
                scores += [int(impacts[own] @ weights) for own, weights in map(lists.value.__getitem__, asked)]
                impacts[at] = 0
                queries += asked
                times.append(len(asked))
            rows, ids = (np.repeat(np.arange(batch.num_rows), times) if times else np.zeros(0, np.int64)), batch.column("doc_id")
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(queries, pa.int32()), batch.column("row").take(take), ids.take(take), pa.array(scores, pa.int64())], names=["query", "row", "doc_id", "score"])

    return score


def _impact(n_docs: int, n_terms: int) -> tuple[Column, Column]:
    """A posting's impact, of tf and m; and m, of a document's number of terms n."""
    m = F.expr(f"75 + (25 * n * {n_docs}L) div {n_terms}L")
    return F.expr("(1000000000L * tf) div (1000L * tf + 12 * m)"), m


def _search_block(docs: DataFrame, block: list[tuple[Row, Counter]], k: int) -> DataFrame:
    """query (number in the block), rank, doc_id, score."""
    spark = docs.sparkSession
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(terms for _, terms in block)), 1)}
    shared = spark.sparkContext.broadcast(vocabulary)
    forward = docs.select(F.col("doc_id").cast("long"), as_bytes().alias("text")).mapInArrow(_counted(shared), _FORWARD)
    forward = materialize(forward.withColumn("row", F.monotonically_increasing_id()), "search-forward")
    shared.destroy()
    total = forward.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    if not total["docs"]:
        return spark.createDataFrame([], f"query int, {_RESULT}")
    impact, m = _impact(total["docs"], total["terms"])

    entry = F.explode(F.arrays_zip("terms", "counts")).alias("e")
    postings = forward.select("row", "n", entry).select("row", F.col("e.terms").alias("term"), F.col("e.counts").cast("long").alias("tf"), m.alias("m")).select("term", impact.cast("int").alias("g"), "row")
    postings = materialize(postings.repartitionByRange("term", F.desc("g"), "row").sortWithinPartitions("term", F.desc("g"), "row"), "search-postings")

    asked = spark.createDataFrame([(q, vocabulary[w], n) for q, (_, terms) in enumerate(block) for w, n in terms.items()], "query int, term int, times int")
    length = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("g").alias("best"))
    weight = F.floor(1000 * F.log(F.lit(2 * total["docs"] + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    lists = asked.join(length, "term").withColumn("weight", weight * F.col("times")).filter("weight > 0")
    lists = lists.withColumn("lists", F.count("*").over(Window.partitionBy("query")))
    lists = materialize(lists.select("query", "term", "weight", F.col("best").cast("long").alias("best"), "lists"), "search-lists")

    head = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("g"), "row"))
    heads = postings.withColumn("place", head).filter(F.col("place") <= k).select("term", "g", "row")
    seen = heads.join(F.broadcast(lists), "term").groupBy("query", "row").agg(F.sum(F.col("weight") * F.col("g")).alias("part"))

    own: dict[int, list[tuple[int, int]]] = {}
    for r in lists.select("query", "term", "weight").collect():  # a block's, of at most BLOCK_TERMS rows
        own.setdefault(r["query"], []).append((r["term"], r["weight"]))
    vectors = spark.sparkContext.broadcast({q: (np.array([t for t, _ in x], np.int64), np.array([w for _, w in x], np.int64)) for q, x in own.items()})

    def looked_up(pairs: DataFrame) -> DataFrame:
        """pairs (query, row; written) with doc_id and the exact score."""
        asked = pairs.groupBy("row").agg(F.collect_list("query").alias("queries"))
        return forward.join(asked, "row").mapInArrow(_scored(vectors, total["docs"], total["terms"]), "query int, row long, doc_id long, score long")

    first = materialize(_largest(seen, DEEPER * k).select("query", "row"), "search-first")
    bounds = lists.join(_kth(looked_up(first), k, "score"), "query", "left").withColumn("bound", F.coalesce("bound", F.lit(0).cast("long")))
    # The least impact with weight * g * lists >= bound; what a list does not give is worth less than `rest` + 1.
    least = F.greatest(F.lit(1).cast("long"), F.expr("(bound + weight * lists - 1) div (weight * lists)"))
    bounds = bounds.withColumn("least", least).withColumn("rest", F.col("weight") * F.least(F.col("best"), F.col("least") - 1))
    bounds = materialize(bounds.withColumn("rests", F.sum("rest").over(Window.partitionBy("query"))), "search-thresholds")

    floor = bounds.groupBy("term").agg(F.min("least").alias("floor"))
    fetched = postings.join(F.broadcast(floor), "term").filter(F.col("g") >= F.col("floor")).select("term", "g", "row").repartition("row")
    fetched = fetched.join(F.broadcast(bounds.select("query", "term", "weight", "least", "rest")), "term").filter(F.col("g") >= F.col("least"))
    sums = fetched.groupBy("query", "row").agg(F.sum(F.col("weight") * F.col("g")).alias("part"), F.sum("rest").alias("known"))
    of_query = materialize(bounds.select("query", "bound", "rests").distinct(), "search-bounds")  # a row a query
    most = F.col("part") + F.col("rests") - F.col("known")
    sums = sums.join(F.broadcast(of_query), "query").withColumn("most", most).filter(F.col("most") >= F.col("bound"))
    sums = materialize(sums.select("query", "row", "part", "most"), "search-sums")
    second = materialize(_largest(sums, DEEPER * k).select("query", "row"), "search-second")
    better = _kth(looked_up(second), k, "score").withColumnRenamed("bound", "better")
    better = of_query.join(better, "query", "left").select("query", F.greatest("bound", F.coalesce("better", F.lit(0))).alias("better"))
    candidates = materialize(sums.join(F.broadcast(better), "query").filter(F.col("most") >= F.col("better")).select("query", "row"), "search-candidates")
    scores = looked_up(candidates).filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first(), "row"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """docs (doc_id, text), queries (item_id, text) -> item_id, rank (from 1), doc_id, score: the k best documents of each query."""
    spark, item = docs.sparkSession, queries.select("item_id").schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {item}, {_RESULT}")
    for block in _blocks(queries):
        found = _search_block(docs, block, k)
        names = spark.createDataFrame([(q, row["item_id"]) for q, (row, _) in enumerate(block)], f"query int, item_id {item}")
        out = out.union(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return out
