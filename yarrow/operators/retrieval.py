"""Batched retrieval: BM25 over a postings table, exact vector search, rank fusion, duplicate suppression."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yarrow.common import cut, spread, table
from yarrow.functions import text as T

K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
#: Numbers of the query vectors that are broadcast at once, and scores that a task holds at once.
QUERY_VALUES, SCORES = 4_000_000, 2_000_000
#: Rows of (query, term) that may be broadcast, some tens of bytes each, to meet stored postings.
BROADCAST_TERMS = 200_000
#: Rows of (query, term), and results, of the queries that meet the documents at once; numbers of the dense weights of frequent terms.
BLOCK_TERMS, KEPT, DENSE = 1_000_000, 1_000_000, 4_000_000


def searchable(chunks: DataFrame, text: str = "text", phrases: list[str] | None = None) -> DataFrame:
    """Not noise (a missing flag counts as none) and with at least one token; B29: a known phrase is a token besides its words."""
    df = chunks.where(~F.coalesce(F.col("is_noise"), F.lit(False)) & F.col(text).isNotNull())
    df = df.withColumn("tokens", T.tokens(F.col(text))).where(F.size("tokens") > 0)
    return df.withColumn("tokens", T.with_phrases(F.col("tokens"), phrases)) if phrases else df


def _listed(docs: DataFrame, key: str, tokens: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(a row a document with its distinct terms and their frequencies, terms, statistics, the documents in packed blocks). A document's tokens lie in its row, so that
    counting them moves nothing; only the terms' document frequencies cross an exchange."""
    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                b = whole.slice(a, 2048)
                counts = [Counter(t) for t in b.column(1).to_pylist()]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in counts], dtype=np.int64)]), pa.int32())
                terms = pa.array([t for c in counts for t in c], pa.string()).dictionary_encode()
                tf = pa.ListArray.from_arrays(ends, pa.array([n for c in counts for n in c.values()], pa.int32()))
                dl = pa.array([sum(c.values()) for c in counts], pa.int32())
                rows = pa.RecordBatch.from_arrays([b.column(0), dl, pa.ListArray.from_arrays(ends, terms.indices), tf], names=["key", "dl", "terms", "tfs"])
                yield pa.RecordBatch.from_arrays([pa.array([_packed(rows)], pa.binary()), pa.array([_packed(pa.RecordBatch.from_arrays([terms.dictionary], names=["term"]))], pa.binary())], names=["rows", "names"])

    def unpacked(batches):
        for r, names in _opened(batches):
            lists = r.column(2)
            yield pa.RecordBatch.from_arrays([r.column(0), r.column(1), pa.ListArray.from_arrays(lists.offsets, names.take(lists.values)), r.column(3)], names=[key, "dl", "terms", "tfs"])

    def counted(batches):
        for r, names in _opened(batches):
            yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(r.column(2).flatten().to_numpy(), minlength=len(names)), pa.int64())], names=["term", "n"])

    kind = docs.schema[key].dataType.simpleString()
    # terms once a block of documents and compressed: written as rows they take some five times the documents' own size
    packed = cut(spread(docs.select(key, tokens)).mapInArrow(run, "rows binary, names binary"))
    listed = packed.mapInArrow(unpacked, f"`{key}` {kind}, dl int, terms array<string>, tfs array<int>")
    stats = listed.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    terms = packed.mapInArrow(counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(stats))  # stats is one row
    terms = cut(terms.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)))
    mean = terms.agg(F.avg("raw").alias("mean"))
    terms = terms.crossJoin(F.broadcast(mean)).withColumn("idf", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")))
    return listed, terms.select("term", "df", "idf", "avgdl"), stats, packed


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """(key, dl, numbers of the distinct terms, their frequencies) of each block of documents, and its terms."""
    for b in batches:
        for rows, names in zip(b.column(0), b.column(1)):
            yield pa.ipc.open_stream(rows.as_buffer()).read_next_batch(), pa.ipc.open_stream(names.as_buffer()).read_next_batch().column(0)


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _postings(listed: DataFrame, key: str) -> DataFrame:
    return listed.select(key, "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(key, "dl", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))


def bm25_index(docs: DataFrame, key: str, tokens: str = "tokens") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings with tf and document length, terms with idf, one row of corpus statistics).

    Documents and terms are written once to the session's shared folder; whatever is asked of the index reads those. Terms in more than half
    of the documents get EPSILON times the mean idf instead of a negative one.
    """
    listed, terms, stats, _ = _listed(docs, key, tokens)
    return _postings(listed, key), terms, stats


def stored_index(docs: DataFrame, key: str, folder: str, tokens: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """The index as tables in ``folder``, which all executors share: postings in partitions by term hash, and terms.

    Built anew only if the documents' signature (their number and a sum of hashes of keys and tokens, one cheap pass) is not that
    of the stored index.
    """
    spark = docs.sparkSession
    now = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(key, tokens).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h"))
    signature = "|".join(map(str, now.first()))
    try:
        fresh = spark.read.parquet(f"{folder}/signature").first()[0] == signature
    except AnalysisException:  # nothing stored yet
        fresh = False
    if not fresh:
        postings, terms, _ = bm25_index(docs, key, tokens)
        postings.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(64))).repartition("part").sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/postings")
        terms.write.mode("overwrite").parquet(f"{folder}/terms")
        spark.createDataFrame([(signature,)], "signature string").write.mode("overwrite").parquet(f"{folder}/signature")
    return spark.read.parquet(f"{folder}/postings").drop("part"), spark.read.parquet(f"{folder}/terms")


def top(df: DataFrame, group: str, score: Column, k: int, *ties: str) -> DataFrame:
    """The k best rows of each group with a 0-based rank; the limit runs before the exchange as well."""
    w = Window.partitionBy(group).orderBy(score.desc(), *ties)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).withColumn("rank", (F.col("_rn") - 1).cast("bigint")).drop("_rn")


def bm25_topk(queries: DataFrame, docs: DataFrame, key: str, k: int = 40, k1: float = K1, b: float = B, kind: str | None = None, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(query_id, rank, key, bm25_score) for all queries at once; scores of zero or less have no rank.

    Only postings of terms that some query has are scored; the k best of each query leave a task, of equal ones the first by key. ``kind``: a doc_type that
    results must have, applied behind the scoring, so that document frequencies stay those of the corpus. ``index``: a stored one.
    """
    if index:
        (postings, terms), packed = index, None
    else:
        _, terms, _, packed = _listed(docs, key, "tokens")
    asked = cut(queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))
    weighted = asked.join(terms, "term")
    if packed is not None:
        # every query's terms are sent to the documents, in blocks of queries; a join on the term would make a row of each posting and query
        n_terms, n_queries = asked.agg(F.count(F.lit(1)), F.countDistinct("query_id")).first()
        blocks = max(1, -(-n_terms // BLOCK_TERMS), -(-n_queries * k // KEPT))
        weighted = weighted.select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"), "avgdl")
        weighted = cut(weighted) if blocks > 1 else weighted
        kinds = queries.schema["query_id"].dataType.simpleString(), docs.schema[key].dataType.simpleString()
        of = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        scores = reduce(DataFrame.unionByName, [_scored(packed, key, weighted.where(of == n), kinds, None if kind else k, k1, b) for n in range(blocks)])
    else:
        # few terms are sent to the stored postings; more are joined by a shuffle on the term
        weighted = F.broadcast(weighted) if asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else weighted
        length = 1 - b + b * F.col("dl") / F.col("avgdl")
        part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * length)
        scores = weighted.join(postings, "term").groupBy("query_id", key).agg(F.sum(part).alias("s")).where("s > 0").withColumn("bm25_score", F.round("s", 6))
    if kind:
        scores = scores.join(docs.where(F.col("doc_type") == kind).select(key), key, "left_semi")
    return top(scores, "query_id", F.col("bm25_score"), k, key).select("query_id", "rank", key, "bm25_score")


def _scored(packed: DataFrame, key: str, weighted: DataFrame, kinds: tuple[str, str], k: int | None, k1: float, b: float) -> DataFrame:
    """(query_id, key, bm25_score): documents in blocks against all queries' terms, frequent terms by a dense product, the others by a sparse one.
    A task keeps the k best of each query, so what moves hangs on neither the number of documents nor on what they share; k = None: everything goes on."""
    spark = packed.sparkSession
    asked = weighted.toArrow().combine_chunks()
    schema = f"query_id {kinds[0]}, `{key}` {kinds[1]}, bm25_score double"
    if not asked.num_rows:
        return spark.createDataFrame([], schema)
    ids, names = asked["query_id"].combine_chunks().dictionary_encode(), asked["term"].combine_chunks().dictionary_encode()
    order = np.argsort(names.indices.to_numpy(), kind="stable")
    starts = np.searchsorted(names.indices.to_numpy()[order], np.arange(len(names.dictionary) + 1))
    mean = asked["avgdl"][0].as_py()
    shared = spark.sparkContext.broadcast((ids.dictionary, names.dictionary, starts, ids.indices.to_numpy()[order].astype(np.int64), asked["w"].to_numpy()[order]))

    def run(batches):
        ids, names, starts, query, weight = shared.value
        n_queries, asked_by, place = len(ids), np.diff(starts), None
        block = max(64, SCORES // n_queries)
        least, kept, waiting = np.zeros(n_queries), None, []

        def settled():
            q, score = (np.concatenate([x[c] for x in waiting]) for c in (0, 1))
            keys = pa.concat_arrays([x[2] for x in waiting])
            order = np.lexsort((pc.rank(keys, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy(), -score, q))
            at = q[order]
            n = np.arange(len(at)) - np.searchsorted(at, at, "left")
            least[at[n == k - 1]] = score[order[n == k - 1]]
            order = order[n < k]
            return q[order], score[order], keys.take(pa.array(order))

        for batch, own in _opened(batches):
            at = pc.fill_null(pc.index_in(own, value_set=names), -1).to_numpy()[batch.column(2).flatten().to_numpy()]
            doc = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(2)).to_numpy())
            known = np.flatnonzero(at >= 0)
            doc, term, tf = doc[known], at[known], batch.column(3).flatten().to_numpy()[known].astype(float)
            gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * batch.column(1).to_numpy()[doc] / mean))
            if place is None:  # terms that a three-hundredth of all pairs of a document and a query share
                pairs = asked_by * np.bincount(term, minlength=len(names))
                frequent = np.argsort(-pairs, kind="stable")[: DENSE // n_queries]
                frequent = frequent[pairs[frequent] * 300 > n_queries * batch.num_rows]
                place, dense = np.full(len(names), -1), np.zeros((len(frequent), n_queries))
                place[frequent] = np.arange(len(frequent))
                for n, t in enumerate(frequent):
                    dense[n, query[starts[t] : starts[t + 1]]] = weight[starts[t] : starts[t + 1]]
            for a in range(0, batch.num_rows, block):
                part = slice(*np.searchsorted(doc, [a, a + block]))
                d, t, g, p = doc[part] - a, term[part], gain[part], place[term[part]]
                rows = min(block, batch.num_rows - a)
                some = p >= 0
                x = np.zeros((rows, len(dense)))
                x[d[some], p[some]] = g[some]
                scores = x @ dense
                d, t, g = d[~some], t[~some], g[~some]
                count = asked_by[t]
                entry = np.repeat(starts[t] - np.cumsum(count) + count, count) + np.arange(count.sum())
                scores += np.bincount(np.repeat(d * n_queries, count) + query[entry], weights=np.repeat(g, count) * weight[entry], minlength=rows * n_queries).reshape(rows, n_queries)
                floor = np.maximum(least - 1e-6, 0)
                if k is not None and kept is None and not waiting and rows > k:
                    floor = np.maximum(floor, np.partition(scores, rows - k, axis=0)[rows - k] - 1e-6)
                r, q = np.divmod(np.flatnonzero(scores > floor), n_queries)
                found = q, np.round(scores[r, q], 6), batch.column(0).take(pa.array(a + r))
                if k is None:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), found[2], pa.array(found[1])], names=["query_id", key, "bm25_score"])
                    continue
                waiting.append(found)
                if sum(len(x[0]) for x in waiting) > (2 if kept is not None else 1) * n_queries * k:
                    kept = settled()
                    waiting = [kept]
        if waiting:
            q, score, keys = settled()
            for a in range(0, len(q), 100_000):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[a : a + 100_000])), keys.slice(a, 100_000), pa.array(score[a : a + 100_000])], names=["query_id", key, "bm25_score"])

    cores = spark.sparkContext.defaultParallelism
    return (packed.coalesce(cores) if k is not None else packed).mapInArrow(run, schema)


def searchable_points(points: DataFrame, kind: str | None = None) -> DataFrame:
    """C4: points that are surely no noise (a missing flag excludes them), of one doc_type if given; both reach the scan."""
    df = points.where(F.col("is_noise") == F.lit(False))
    return df.where(F.col("doc_type") == kind) if kind else df


def _matrix(column: pa.Array) -> np.ndarray:
    x = np.array(column.to_pylist(), dtype=np.float64)
    return x.reshape(len(column), -1)


def vector_topk(queries: DataFrame, points: DataFrame, key: str, k: int = 40, exclude_self: bool = False) -> DataFrame:
    """Exact cosine search of a stated query set (query_id, qv) against all points (key, v).

    Queries meet the points in blocks of QUERY_VALUES numbers, the only thing broadcast: one matrix product for each block and Arrow
    batch of points, of which the k best a query leave the task. Rows without a vector, or of another length than
    the first query's, have no score.
    """
    spark = points.sparkSession
    first = queries.where(F.size("qv") > 0).select(F.size("qv")).first()
    id_kind, key_kind = queries.schema["query_id"].dataType.simpleString(), points.schema[key].dataType.simpleString()
    schema = f"query_id {id_kind}, `{key}` {key_kind}, vector_score double"
    if first is None:
        return spark.createDataFrame([], f"query_id {id_kind}, rank bigint, `{key}` {key_kind}, vector_score double")
    dim = first[0]
    good = lambda c: (F.size(c) == dim) & F.forall(c, lambda x: x.isNotNull())
    asked = queries.where(good("qv")).select("query_id", "qv")
    blocks = -(-asked.count() * dim // QUERY_VALUES)
    base = spread(points.where(good("v")).select(key, "v"))
    scored = []
    for n in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).toArrow()
        q = _matrix(part["qv"].combine_chunks()) if part.num_rows else np.zeros((0, dim))
        shared = spark.sparkContext.broadcast((part["query_id"].combine_chunks(), q, np.sqrt((q * q).sum(axis=1))))

        def run(batches, shared=shared):
            ids, q, lengths = shared.value
            for b in batches:
                if not b.num_rows or not len(ids):
                    continue
                x = _matrix(b.column(1))
                # B37's small term keeps zero vectors from dividing by zero
                sims = np.round((q @ x.T) / (lengths[:, None] * np.sqrt((x * x).sum(axis=1))[None, :] + 1e-12), 6)
                if exclude_self:
                    own = pc.index_in(ids, value_set=b.column(0)).to_numpy(zero_copy_only=False)
                    at = np.flatnonzero(~np.isnan(own.astype(float)))
                    sims[at, own[at].astype(int)] = -np.inf
                # equal scores at the border all go on: their order is decided behind the exchange
                least = np.partition(-sims, min(k, sims.shape[1]) - 1, axis=1)[:, min(k, sims.shape[1]) - 1]
                r, c = np.nonzero((-sims <= least[:, None]) & (sims > -np.inf))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(r)), b.column(0).take(pa.array(c)), pa.array(sims[r, c])], names=["query_id", key, "vector_score"])

        scored.append(base.mapInArrow(run, schema))
    return top(reduce(DataFrame.unionByName, scored), "query_id", F.col("vector_score"), k, key).select("query_id", "rank", key, "vector_score")


def vector_topk_of_texts(queries: DataFrame, points: DataFrame, key: str, embed: Callable[[DataFrame], DataFrame], k: int = 40) -> DataFrame:
    """Search from texts: ``embed`` turns (query_id, query) into (query_id, vector); queries without a vector have no rows."""
    return vector_topk(embed(queries).where("vector IS NOT NULL").select("query_id", F.col("vector").alias("qv")), points, key, k)


def rrf(lists: dict[str, DataFrame], key: str, k: int = RRF_K, final: int = 40) -> DataFrame:
    """Reciprocal rank fusion of (query_id, rank, key) lists; one union and one aggregation, no full outer join."""
    rows = reduce(DataFrame.unionByName, [df.select("query_id", key, F.lit(name).alias("list"), F.col("rank").cast("bigint").alias("r")) for name, df in lists.items()])
    fused = rows.groupBy("query_id", key).agg(F.sum(1.0 / (k + F.col("r") + 1)).alias("_s"), *[F.min(F.when(F.col("list") == name, F.col("r"))).alias(f"{name}_rank") for name in lists])
    out = top(fused.withColumn("_s", F.round("_s", 9)), "query_id", F.col("_s"), final, key)
    return out.select("query_id", "rank", key, F.round("_s", 6).alias("fused_score"), *[f"{n}_rank" for n in lists])


def merge_variants(rows: DataFrame, key: str, score: str, k: int = 40) -> DataFrame:
    """Results of several variants of a query: the best score of each item, and the variants that found it."""
    best = rows.groupBy("query_id", key).agg(F.max(score).alias(score), F.array_sort(F.collect_set("variant")).alias("variants"))
    return top(best, "query_id", F.col(score), k, key)


def suppress_duplicates(rows: DataFrame, text: str, key: str) -> DataFrame:
    """H3, F2: of equal normalised texts of a query only the best rank stays; empty texts all stay; ranks are made anew."""
    same = T.normalise_query(F.substring(F.coalesce(text, F.lit("")), 1, 500))
    rows = rows.withColumn("_same", F.when(F.length(same) > 0, same).otherwise(F.concat_ws("|", F.col(key).cast("string"), F.col("rank").cast("string"))))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "_same").orderBy("rank", key))).where("_n = 1").drop("_n", "_same")
    return first.withColumn("rank", (F.row_number().over(Window.partitionBy("query_id").orderBy("rank", key)) - 1).cast("bigint"))


def retrieve(mode: str, queries: DataFrame, docs: DataFrame, key: str, points: DataFrame | None = None, k: int = 40) -> DataFrame:
    """One schema (query_id, rank, key, fused_score) for the modes bm25, vector and hybrid_rrf."""
    if mode == "bm25":
        return bm25_topk(queries, docs, key, k).withColumnRenamed("bm25_score", "fused_score")
    if mode == "vector":
        return vector_topk(queries, points, key, k).withColumnRenamed("vector_score", "fused_score")
    if mode == "hybrid_rrf":
        return rrf({"bm25": bm25_topk(queries, docs, key, k), "vector": vector_topk(queries, points, key, k)}, key, final=k).select("query_id", "rank", key, "fused_score")
    raise ValueError(f"unknown mode {mode!r}")


# --- queries ------------------------------------------------------------------------------------------------------


def _docs(spark, d):
    return searchable(table(spark, d, "chunks").select("ord", "text", "is_noise", "doc_type"))


def _questions(spark, d):
    return table(spark, d, "test_questions").where("question IS NOT NULL").select(F.col("id").alias("query_id"), F.col("question").alias("query"))


def j3_bm25_topk(spark, d):
    """BM25 top 10 of every question over all chunks."""
    return bm25_topk(_questions(spark, d), _docs(spark, d), "ord", 10)


def e9_bm25_terms(spark, d):
    _, terms, _ = bm25_index(_docs(spark, d), "ord")
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


def j1_bm25_stats(spark, d):
    docs = _docs(spark, d)
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg(F.size("tokens")), 6).alias("avgdl"), F.sum(F.size("tokens").cast("bigint")).alias("n_tokens"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def j5_vector_topk(spark, d):
    """The ten most similar vectors of every twentieth one, against all."""
    v = _vectors(spark, d)
    return vector_topk(v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("qv")), v, "id", 10, exclude_self=True)


def _lists(spark, d):
    r = table(spark, d, "retrieval_results").groupBy("query_id", "chunk_id").agg(F.min("bm25_rank").alias("b"), F.min("vector_rank").alias("v"))
    pick = lambda c: r.where(F.col(c).isNotNull()).select("query_id", "chunk_id", F.col(c).alias("rank"))
    return {"bm25": pick("b"), "vector": pick("v")}


def j7_rrf(spark, d):
    """Both searches' lists of every query fused by reciprocal ranks."""
    return rrf(_lists(spark, d), "chunk_id")


def j6_merge_variants(spark, d):
    """Results of all questions with the same gold label taken as variants of one query."""
    q = table(spark, d, "test_questions").select(F.col("id").alias("qid"), F.coalesce(F.lower(F.trim("gold_label")), F.lit("")).alias("label"))
    rows = table(spark, d, "retrieval_results").join(q, F.col("query_id") == F.col("qid")).select(F.col("label").alias("query_id"), "chunk_id", "fused_score", F.col("qid").alias("variant"))
    return merge_variants(rows, "chunk_id", "fused_score", 20).select("query_id", "rank", "chunk_id", "fused_score", F.size("variants").cast("bigint").alias("n_variants"))


def h3_suppress_duplicates(spark, d):
    r = table(spark, d, "retrieval_results").where("rank IS NOT NULL").dropDuplicates(["query_id", "rank", "chunk_id"])
    return suppress_duplicates(r.select("query_id", F.col("rank").cast("bigint").alias("rank"), "chunk_id", "text"), "text", "chunk_id").select("query_id", "rank", "chunk_id")


def j8_retrieve_modes(spark, d):
    """All modes over the same questions; vectors are the embeddings, matched by number as a fixture."""
    q, docs, v = _questions(spark, d), _docs(spark, d), _vectors(spark, d).withColumnRenamed("id", "ord")
    q = q.join(v.select(F.col("ord").alias("query_id"), F.col("v").alias("qv")), "query_id")
    q = cut(q.where("query_id % 20 = 0"))
    return reduce(DataFrame.unionByName, [retrieve(m, q, docs, "ord", v, 10).withColumn("mode", F.lit(m)) for m in ("bm25", "vector", "hybrid_rrf")])


_TOK = "list_filter(regexp_split_to_array(replace(replace(strip_accents(lower(text)), 'đ', 'd'), 'Đ', 'D'), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: length(x) > 0)"
_BM = f"""
WITH docs AS (SELECT ord, {_TOK} tokens FROM chunks WHERE NOT coalesce(is_noise, false) AND text IS NOT NULL),
d AS (SELECT * FROM docs WHERE len(tokens) > 0),
post AS (SELECT ord, dl, term, count(*) tf FROM (SELECT ord, len(tokens) dl, unnest(tokens) term FROM d) GROUP BY ALL),
st AS (SELECT count(*) n, avg(len(tokens)) avgdl FROM d),
t0 AS (SELECT term, count(*) df FROM post GROUP BY 1),
t1 AS (SELECT term, df, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) raw FROM t0, st),
terms AS (SELECT term, df, avgdl, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM t1) ELSE raw END idf FROM t1)
"""
QUERIES = {f.__name__: f for f in (j3_bm25_topk, e9_bm25_terms, j1_bm25_stats, j5_vector_topk, j7_rrf, j6_merge_variants, h3_suppress_duplicates, j8_retrieve_modes)}
SQL = {
    "e9_bm25_terms": _BM + "SELECT term, df, round(idf, 6) idf FROM terms",
    "j1_bm25_stats": _BM + "SELECT count(*) n_docs, round(avg(len(tokens)), 6) avgdl, sum(len(tokens))::BIGINT n_tokens FROM d",
    "j3_bm25_topk": _BM + f""",
q AS (SELECT id query_id, term, count(*) qtf FROM (SELECT id, unnest({_TOK.replace('text', 'question')}) term FROM test_questions WHERE question IS NOT NULL) GROUP BY ALL),
s AS (SELECT query_id, ord, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) bm25_score FROM q JOIN terms USING (term) JOIN post USING (term) GROUP BY ALL HAVING sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) > 0)
SELECT query_id, rn - 1 AS rank, ord, bm25_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, ord) rn FROM s) WHERE rn <= 10""",
    "j5_vector_topk": """
WITH s AS (SELECT a.vec_id query_id, b.vec_id id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) vector_score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rn - 1 AS rank, id, vector_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, id) rn FROM s) WHERE rn <= 10""",
    "j7_rrf": """
WITH r AS (SELECT query_id, chunk_id, min(bm25_rank) b, min(vector_rank) v FROM retrieval_results GROUP BY ALL),
f AS (SELECT query_id, chunk_id, round(coalesce(1.0::DOUBLE / (61 + b), 0) + coalesce(1.0::DOUBLE / (61 + v), 0), 9) s, b::BIGINT bm25_rank, v::BIGINT vector_rank FROM r WHERE b IS NOT NULL OR v IS NOT NULL)
SELECT query_id, rn - 1 AS rank, chunk_id, round(s, 6) fused_score, bm25_rank, vector_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) rn FROM f) WHERE rn <= 40""",
    "j6_merge_variants": """
WITH r AS (SELECT coalesce(lower(trim(gold_label)), '') query_id, chunk_id, max(fused_score) fused_score, count(DISTINCT id) n_variants FROM retrieval_results JOIN test_questions ON id = query_id GROUP BY 1, 2)
SELECT query_id, rn - 1 AS rank, chunk_id, fused_score, n_variants FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, chunk_id) rn FROM r) WHERE rn <= 20""",
    "h3_suppress_duplicates": r"""
WITH r AS (SELECT DISTINCT query_id, rank, chunk_id, text FROM retrieval_results WHERE rank IS NOT NULL),
n AS (SELECT *, regexp_replace(regexp_replace(lower(nfc_normalize(left(coalesce(text, ''), 500))), '[ \t\n\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g') t FROM r),
k AS (SELECT *, CASE WHEN length(t) > 0 THEN t ELSE chunk_id || '|' || rank END same FROM n),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, same ORDER BY rank, chunk_id) m FROM k)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) - 1 AS rank, chunk_id FROM f WHERE m = 1""",
}
