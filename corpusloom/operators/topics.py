"""Topic models: non-negative matrix factorisation by multiplicative updates, and LDA."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import drop_durable, durable


def _dot(a: str, b: str, k: int):
    return reduce(lambda x, y: x + y, [F.col(f"{a}{i}") * F.col(f"{b}{i}") for i in range(k)])


def _doc_factors(index: np.ndarray, value: np.ndarray, ends: np.ndarray, h: np.ndarray, inner: int, sparsity: float) -> np.ndarray:
    """The factors of some docs for given terms' factors: ``inner`` multiplicative updates from an even start. A doc's cells are a
    stretch of ``index`` and ``value`` that ends at its ``ends``."""
    k = h.shape[0]
    top = np.add.reduceat((h[:, index] * value).T, np.concatenate([[0], ends[:-1]]), axis=0)
    gram = h @ h.T
    w = np.full((len(ends), k), 1.0)
    for _ in range(inner):
        w *= top / (w @ gram + sparsity + 1e-12)
    return w


def nmf(weights: DataFrame, k: int = 20, steps: int = 30, seed: str = "0", sparsity: float = 0.0, tolerance: float = 1e-4, most_terms: int = 50_000, inner: int = 12) -> tuple[DataFrame, DataFrame]:
    """(W, H) of a long matrix (doc, token, value): W has (doc, w0..), H (token, h0..), all >= 0.

    The vocabulary must hold ``most_terms`` tokens at most (it is a top-k by nature; more are an error), so the terms' factors are
    small: they go out with each pass, and each partition sends back one k-vector a token and one k x k product. Docs, which grow
    without bound, are grouped once; their factors follow from the terms' and are never shuffled, written or gathered. ``sparsity`` is an L1
    penalty on the docs' factors. It ends after ``steps`` passes, or when the squared error falls by less than ``tolerance`` of itself.
    An empty matrix gives two empty tables. The start is a hash of the token, so a run repeats.
    """
    cells = weights.select("doc", "token", F.col("value").cast("double").alias("value")).where("value > 0")
    spark = weights.sparkSession
    kinds = {c: weights.schema[c].dataType.simpleString() for c in ("doc", "token")}
    tokens = [r[0] for r in cells.select("token").distinct().orderBy("token").limit(most_terms + 1).collect()]
    if len(tokens) > most_terms:
        raise ValueError(f"more than {most_terms} terms: limit the vocabulary first")
    if not tokens:
        empty = ", ".join(f"w{i} double" for i in range(k))
        return spark.createDataFrame([], f"doc {kinds['doc']}, {empty}"), spark.createDataFrame([], f"token {kinds['token']}, {empty.replace('w', 'h')}")
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(tokens)), f"_n int, token {kinds['token']}"))
    rows = durable(cells.join(numbers, "token").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("_n", "value"))).alias("c")).select("doc", F.col("c._n").alias("at"), F.col("c.value").alias("value")))
    n = len(tokens)
    h = np.random.default_rng(int.from_bytes(seed.encode(), "big")).random((k, n)) + 0.01
    total = cells.agg(F.sum(F.col("value") * F.col("value"))).first()[0]

    def factors(h: np.ndarray):
        def of(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            index, value = np.concatenate(b["at"].to_numpy()), np.concatenate(b["value"].to_numpy())
            ends = np.cumsum([len(x) for x in b["at"]])
            return _doc_factors(index, value, ends, h, inner, sparsity), index, value, ends

        return of

    last = np.inf
    for _ in range(steps):
        of = factors(h)

        def sums(batches: Iterator[pd.DataFrame], of=of) -> Iterator[pd.DataFrame]:
            top, gram = np.zeros((n, k)), np.zeros((k, k))
            for b in batches:
                w, index, value, ends = of(b)
                np.add.at(top, index, np.repeat(w, np.diff(np.concatenate([[0], ends])), axis=0) * value[:, None])
                gram += w.T @ w
            full = np.vstack([top, gram])
            yield pd.DataFrame({"_n": np.arange(n + k), "v": list(full)})

        added = rows.select("at", "value").mapInPandas(sums, "_n int, v array<double>").groupBy("_n").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(k)]).alias("v")).orderBy("_n").collect()
        full = np.array([r["v"] for r in added])
        top, gram = full[:n].T, full[n:]
        h = h * top / (gram @ h + 1e-12)
        error = total - 2 * float((h * top).sum()) + float(np.trace(gram @ (h @ h.T)))
        if last - error < tolerance * max(last, 0.0) and last < np.inf:
            break
        last = error
    of = factors(h)

    def docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc": b["doc"], "v": list(of(b)[0])})

    w = durable(rows.mapInPandas(docs, f"doc {kinds['doc']}, v array<double>")).select("doc", *[F.col("v")[i].alias(f"w{i}") for i in range(k)])
    terms = spark.createDataFrame([(t, *map(float, h[:, i])) for i, t in enumerate(tokens)], f"token {kinds['token']}, " + ", ".join(f"h{i} double" for i in range(k)))
    return w, terms


def nmf_error(weights: DataFrame, w: DataFrame, h: DataFrame, k: int) -> float:
    """Squared error over the stored cells."""
    fit = _dot("w", "h", k)
    return weights.join(w, "doc").join(h, "token").agg(F.sum((F.col("value") - fit) * (F.col("value") - fit))).first()[0] or 0.0


def topic_terms(h: DataFrame, k: int, n: int = 6) -> DataFrame:
    """(topic, token, weight) of each topic's n strongest terms."""
    from .side import top_by

    long = h.select("token", F.posexplode(F.array(*[F.col(f"h{i}") for i in range(k)])).alias("topic", "weight"))
    return top_by(long, "topic", "weight", "token", n).select("topic", "token", F.round("weight", 6).alias("weight"))


def topic_docs(weights: DataFrame, terms: DataFrame, n: int = 1000) -> DataFrame:
    """(topic, doc, weight): docs ranked by the strongest terms alone."""
    from .side import top_by

    scored = weights.join(terms, "token").groupBy("topic", "doc").agg(F.round(F.sum(F.col("value") * F.col("weight")), 6).alias("weight"))
    return top_by(scored, "topic", "weight", "doc", n)


def local_idf(counts: DataFrame, doc: str, scores: DataFrame) -> DataFrame:
    """(doc, token, value): counts weighed by how distinctive a term is (token, g2) in place of its document frequency, scaled so that a
    doc's squares add up to 1; terms that are rarer than expected weigh nothing."""
    weighed = counts.join(scores.where("g2 > 0").select("token", "g2"), "token").withColumn("_w", F.col("n") * F.ln(F.col("g2") + 1))
    norm = weighed.groupBy(doc).agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return weighed.join(norm, doc).select(F.col(doc).alias("doc"), "token", (F.col("_w") / F.col("_norm")).alias("value"))


def topics(weights: DataFrame, k: int = 20, terms: int = 6, docs: int = 1000, least: int = 50, **kw) -> DataFrame:
    """(topic, kind, key, weight, place): the strongest terms of each topic and the docs that hold them most, topics by the weight of
    their docs, the heaviest 0. Fewer than ``least`` docs give nothing."""
    if weights.select("doc").distinct().limit(least).count() < least:
        return weights.sparkSession.createDataFrame([], "topic int, kind string, key string, weight double, place int")
    _, h = nmf(weights, k, **kw)
    strongest = durable(topic_terms(h, k, terms))
    ranked = durable(topic_docs(weights, strongest, docs))
    heavy = ranked.groupBy("topic").agg(F.sum("weight").alias("_w"))
    order = heavy.select(F.col("topic").alias("_t"), (F.row_number().over(Window.orderBy(F.desc("_w"), "topic")) - 1).alias("_p"))  # k rows

    def rows(df: DataFrame, kind: str, key: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), key))
        return df.select("topic", F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), "weight", place.alias("place"))

    both = rows(strongest, "term", "token").unionByName(rows(ranked, "doc", "doc"))
    return both.join(F.broadcast(order), F.col("topic") == F.col("_t")).select(F.col("_p").alias("topic"), "kind", "key", "weight", "place")


#: A block of docs in Arrow. Terms of two docs and more are the columns of a matrix, its cells by column (``at``) with their counts (``n``), a doc's up to its
#: ``ends``; terms of one doc stand by themselves (``doc``, ``term``, ``m``, by doc). ``w`` has the docs' counts by topic. A row with ``top`` alone has what a task's docs add to the terms.
_BLOCK = {"terms": np.int32, "ends": np.int32, "at": np.int32, "n": np.float64, "doc": np.int32, "term": np.int32, "m": np.float64, "w": np.float64, "top": np.float64}
_SCHEMA = ", ".join(f"{c} binary" for c in _BLOCK)


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers, none below 0, in as few bytes as hold the largest; the first byte says how many."""
    kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def _wide(x: pa.Buffer, kind: type) -> np.ndarray:
    return np.frombuffer(x, f"u{memoryview(x)[0]}", offset=1).astype(kind)


def _alike(index: np.ndarray, ends: np.ndarray, terms: int, groups: int = 16, common: int = 256, passes: int = 4) -> np.ndarray:
    """An order of docs in which those of like words lie together, so that a block has few terms. It tells how fast a block is, not what comes out."""
    docs = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    often = np.argsort(-np.bincount(index, minlength=terms), kind="stable")[:common]
    place = np.full(terms, -1)
    place[often] = np.arange(len(often))
    has = place[index] >= 0
    x = np.zeros((len(ends), len(often)), np.float32)
    x[docs[has], place[index[has]]] = 1
    x /= np.sqrt(x.sum(1, keepdims=True)) + 1e-9
    centre = x[np.linspace(0, len(ends) - 1, groups).astype(int)]
    for _ in range(passes):
        near = (x @ centre.T).argmax(1)
        sums = np.eye(groups, dtype=np.float32)[near].T @ x
        centre = sums / (np.sqrt((sums * sums).sum(1, keepdims=True)) + 1e-9)
    return np.argsort((x @ centre.T).argmax(1), kind="stable")


def _block(index: np.ndarray, value: np.ndarray, ends: np.ndarray, w: np.ndarray, terms: int) -> dict[str, bytes]:
    docs = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    often = np.bincount(index, minlength=terms)
    columns = np.flatnonzero(often > 1)
    place = np.full(terms, -1)
    place[columns] = np.arange(len(columns))
    many = often[index] > 1
    whole = {"terms": columns, "ends": np.cumsum(np.bincount(docs[many], minlength=len(ends))), "doc": docs[~many], "term": index[~many], "w": w}
    return {c: x.astype(_BLOCK[c]).tobytes() for c, x in whole.items()} | {"at": _narrow(place[index[many]]), "n": _narrow(value[many]), "m": _narrow(value[~many])}


def _em_step(b: dict[str, pa.Buffer], a: np.ndarray, top: np.ndarray, alpha: float) -> np.ndarray:
    """The docs' new counts by topic for the terms' factors ``a``. What the terms get, but for their own factor, is added to ``top``."""
    terms, ends, doc, term, w = (np.frombuffer(b[c], _BLOCK[c]) for c in ("terms", "ends", "doc", "term", "w"))
    w = w.reshape(-1, a.shape[1]) + alpha
    near = a[terms]
    share = w @ near.T
    flat = share.reshape(-1)
    at = _wide(b["at"], np.intp)
    at += np.repeat(np.arange(len(w)) * len(terms), np.diff(ends, prepend=0))
    each = _wide(b["n"], np.float64) / flat.take(at)
    flat[:] = 0
    flat[at] = each
    new = share @ near
    top[terms] += share.T @ w
    if len(doc):
        of, by = a[term], w[doc]
        each = (_wide(b["m"], np.float64) / np.einsum("ij,ij->i", of, by))[:, None]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        new[doc[first]] += np.add.reduceat(of * each, first, axis=0)
        top[term] += by * each  # no term twice
    return w * new


def _batch(rows: list[dict[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], pa.binary()) for c in _BLOCK], names=list(_BLOCK))


def _summed(tops: DataFrame, partitions: int, at_once: int = 64) -> np.ndarray:
    """The sum of all tasks' ``top``. Of many tasks they are first summed up by groups, so that the driver gets ``at_once`` of them at most."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.frombuffer(x.as_buffer()) for b in batches for x in b.column(0)]
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(own, axis=0).tobytes()], pa.binary())], names=["top"])

    rows = tops if partitions <= at_once else tops.repartition(min(at_once, int(partitions**0.5))).mapInArrow(sums, "top binary")
    return np.sum([np.frombuffer(r[0]) for r in rows.collect()], axis=0)


def lda(words: DataFrame, vocabulary: list[str], k: int = 20, steps: int = 100, seed: int = 7, docs: int = 128, cells: int = 1 << 16, partition_bytes: int = 128 << 20, keep: int = 10) -> DataFrame:
    """(topic, token, weight) of LDA's topics over (doc_id, words), the six strongest terms of each; the vocabulary is a bounded list.

    All ``steps`` of the EM that ``pyspark.ml.clustering.LDA`` runs as messages over a graph, with its priors: every count of a term in a doc
    is shared out by the product of the doc's and the term's smoothed counts by topic, and these are summed anew. Here docs are packed into
    blocks of ``docs`` docs or ``cells`` cells, so a step is three matrix products a block; the terms' counts, which are small, go out with each step
    and come back summed by task. The docs' counts stay with their blocks, which are cached and every ``keep`` steps checkpointed. The start is a
    hash of the doc, so a run repeats however the rows are spread. Without a word of the vocabulary there are no topics.
    """
    spark, n = words.sparkSession, len(vocabulary)
    alpha, eta = 50.0 / k, 0.1
    empty = spark.createDataFrame([], "topic int, token string, weight double")
    if not vocabulary:
        return empty
    counted = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="words", outputCol="features").transform(words)
    counted = counted.select(F.xxhash64("doc_id", F.lit(seed)).alias("start"), F.unwrap_udt("features").alias("f")).select("start", "f.indices", "f.values").where(F.size("indices") > 0)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros((n, k))
        for b in batches:
            starts, index, value = b.column(0).to_numpy(), b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
            ends = np.cumsum(b.column(1).value_lengths().to_numpy())
            own: list[int] = []
            held = 0
            order = _alike(index, ends, n) if len(ends) else []
            for place, i in enumerate(order, 1):
                own.append(i)
                held += ends[i] - (ends[i - 1] if i else 0)
                if len(own) < docs and held < cells and place < len(order):
                    continue
                at = [slice(ends[j - 1] if j else 0, ends[j]) for j in own]
                w = np.empty((len(own), k))
                for j, s in enumerate(at):
                    given = np.random.default_rng(int(starts[own[j]]) % (1 << 64)).random((s.stop - s.start, k))
                    given *= (value[s] / given.sum(1))[:, None]
                    w[j] = given.sum(0)
                    top[index[s]] += given  # no term twice in a doc
                yield _batch([_block(np.concatenate([index[s] for s in at]), np.concatenate([value[s] for s in at]), np.cumsum([s.stop - s.start for s in at]), w, n)])
                own, held = [], 0
        yield _batch([{"top": top.tobytes()}])

    def stepped(sent):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, top = sent.value, np.zeros((n, k))
            for b in batches:
                w = [_em_step({c: b.column(c)[i].as_buffer() for c in _BLOCK if c != "top"}, a, top, alpha).tobytes() for i in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()) if c == "w" else b.column(c) for c in _BLOCK], names=list(_BLOCK))
            yield _batch([{"top": top.tobytes()}])

        return of

    made = counted.mapInArrow(blocks, _SCHEMA).persist(StorageLevel.MEMORY_AND_DISK)
    counts = _summed(made.where("top is not null").select("top"), made.rdd.getNumPartitions())
    counts = np.reshape(counts, (-1, k)) if np.size(counts) > 1 else np.zeros((n, k))
    size = made.select(F.sum(sum(F.length(c) for c in _BLOCK if c != "top"))).first()[0] or 0
    parts = max(1, min(spark.sparkContext.defaultParallelism, size >> 18), size // partition_bytes)
    rows = durable(made.where("top is null").repartition(parts))
    made.unpersist()
    spark.sparkContext._jvm.System.gc()  # so that the context's cleaner deletes what the shuffle wrote
    if not counts.any():
        return empty
    used: list = []
    held, last = rows, None
    for step in range(1, steps + 1):
        used.append(sent := spark.sparkContext.broadcast((counts + eta) / (counts.sum(0) + n * eta)))
        now = rows.mapInArrow(stepped(sent), _SCHEMA).persist(StorageLevel.MEMORY_AND_DISK)
        counts = np.reshape(_summed(now.where("top is not null").select("top"), parts), (n, k)) * sent.value
        if last is not None:
            last.unpersist()
        last, rows = now, now.where("top is null")
        if step % keep == 0 and step < steps:
            rows = durable(rows)
            drop_durable(held)
            last.unpersist()
            held, last = rows, None
            for x in used:
                x.destroy()
            used = []
    if last is not None:
        last.unpersist()
    drop_durable(held)
    for x in used:
        x.destroy()
    weights = counts / counts.sum(0)
    best = [np.lexsort((np.arange(n), -weights[:, t]))[:6] for t in range(k)]
    return spark.createDataFrame([(t, vocabulary[i], round(float(weights[i, t]), 6)) for t in range(k) for i in best[t]], "topic int, token string, weight double")
