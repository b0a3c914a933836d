"""TF-IDF, topic models and labelled topic scores, in long form (document, term, weight)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions.text import clean_document, vector_tokens
from rostrum.plans.session import parallelism


def term_counts(docs: DataFrame, key: str, text: str, stop_words: list[str] = ()) -> DataFrame:
    """``key, term, tf`` of tokens of two or more letters; stop words go before anything is shuffled."""
    terms = docs.where(F.col(key).isNotNull()).select(key, F.explode(vector_tokens(F.col(text))).alias("term"))
    if stop_words:
        terms = terms.where(~F.col("term").isin(list(stop_words)))
    return terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(docs: DataFrame, key: str, text: str, stop_words: list[str] = ()) -> DataFrame:
    """``key, term, tf, tfidf``: tf times (ln((1 + n) / (1 + df)) + 1), each document's vector of length 1.

    n counts documents that have a key, also those without a term.
    """
    counts = term_counts(docs, key, text, stop_words)
    n = docs.where(F.col(key).isNotNull()).select(key).distinct().agg(F.count(F.lit(1)).alias("n"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = counts.join(df, "term").withColumn("w", F.col("tf") * (F.log((1 + n.scalar()) / (1 + F.col("df"))) + 1))
    norms = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, key).select(key, "term", "tf", (F.col("w") / F.col("norm")).alias("tfidf"))


def relative_frequency(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, freq``: a term's share of its document's tokens."""
    counts = term_counts(docs, key, text)
    totals = counts.groupBy(key).agg(F.sum("tf").alias("total"))
    return counts.join(totals, key).select(key, "term", (F.col("tf") / F.col("total")).alias("freq"))


def top_terms(weights: DataFrame, key: str, weight: str, n: int) -> DataFrame:
    """The ``n`` terms of most weight of each ``key``, ties by term; Spark keeps only n rows a key before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(weight), "term")
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def factorize(x: np.ndarray, k: int, alpha: float = 0.1, l1_ratio: float = 0.5, iterations: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative X = WH by hierarchical alternating least squares from a signed-SVD start; deterministic.

    Minimises half the squared error, plus alpha times l1_ratio times the sums of W and H, plus half alpha times
    (1 - l1_ratio) times their squares. ``k`` is lowered to the matrix' smaller side.
    """
    k = max(1, min(k, *x.shape))
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    w, h = np.zeros((x.shape[0], k)), np.zeros((k, x.shape[1]))
    for j in range(k):
        up, un, vp, vn = np.maximum(u[:, j], 0), np.maximum(-u[:, j], 0), np.maximum(vt[j], 0), np.maximum(-vt[j], 0)
        a, b = np.linalg.norm(up) * np.linalg.norm(vp), np.linalg.norm(un) * np.linalg.norm(vn)
        p, q, size = (up, vp, a) if a >= b else (un, vn, b)
        if size > 0:
            root = np.sqrt(s[j] * size)
            w[:, j], h[j] = root * p / np.linalg.norm(p), root * q / np.linalg.norm(q)
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    for _ in range(iterations):
        before = w.copy()
        for a, b, target in ((w, h, x), (h.T, w.T, x.T)):
            gram, cross = b @ b.T, target @ b.T
            for j in range(k):
                top = cross[:, j] - a @ gram[:, j] + a[:, j] * gram[j, j] - l1
                a[:, j] = np.maximum(top, 0) / (gram[j, j] + l2) if gram[j, j] + l2 > 0 else 0.0
        if np.linalg.norm(w - before) <= 1e-6 * (np.linalg.norm(before) + 1e-12):
            break
    return w, h


def nmf_topics(docs: DataFrame, model_key: str, doc_key: str, text: str, k: int, stop_words: list[str] = (), n_words: int = 5) -> DataFrame:
    """One factorisation for each ``model_key``: ``model_key, doc, topic, weight`` with its documents as rows; ``words`` holds the best ``n_words`` of the topic.

    TF-IDF weights (idf within the model) are computed in the JVM; only a model's own matrix reaches its worker, so a
    model's documents must fit one task, as any dense factorisation needs.
    """
    keyed = docs.where(F.col(model_key).isNotNull() & F.col(doc_key).isNotNull() & F.col(text).isNotNull())
    terms = keyed.select(F.col(model_key).alias("m"), F.col(doc_key).cast("string").alias("d"), F.explode(vector_tokens(F.col(text))).alias("term"))
    if stop_words:
        terms = terms.where(~F.col("term").isin(list(stop_words)))
    counts = terms.groupBy("m", "d", "term").agg(F.count(F.lit(1)).alias("tf"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        d, names = pd.factorize(group["d"], sort=True)
        t, vocabulary = pd.factorize(group["term"], sort=True)
        x = np.zeros((len(names), len(vocabulary)))
        x[d, t] = group["tf"]
        x *= np.log((1 + len(names)) / (1 + (x > 0).sum(0))) + 1
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        w, h = factorize(x, k)
        out = pd.DataFrame({"d": np.repeat(names, w.shape[1]), "topic_idx": np.tile(np.arange(w.shape[1]), len(names)), "weight": w.ravel()})
        best = [" ".join(vocabulary[i] for i in np.argsort(-row, kind="stable")[:n_words]) for row in h]
        out["m"], out["words"] = group["m"].iloc[0], [best[j] for j in out["topic_idx"]]
        return out[["m", "d", "topic_idx", "weight", "words"]]

    kind = dict(docs.dtypes)[model_key]
    found = counts.groupBy("m").applyInPandas(run, f"m {kind}, d string, topic_idx int, weight double, words string")
    return found.select(F.col("m").alias(model_key), F.col("d").alias("doc"), "topic_idx", "weight", "words")


def _descend(cross: np.ndarray, gram: np.ndarray, l1: float, l2: float, start: np.ndarray | None = None, sweeps: int = 25) -> np.ndarray:
    """Rows a >= 0 that minimise half the squared error plus penalties, given ``gram`` of the other factor and ``cross`` with it."""
    a = np.zeros_like(cross) if start is None else start.copy()
    for _ in range(sweeps):
        for j in range(a.shape[1]):
            top = cross[:, j] - a @ gram[:, j] + a[:, j] * gram[j, j] - l1
            a[:, j] = np.maximum(top, 0) / (gram[j, j] + l2) if gram[j, j] + l2 > 0 else 0.0
    return a


def nmf_few_documents(docs: DataFrame, doc_key: str, text: str, k: int, stop_words: list[str] = (), n_words: int = 5, passes: int = 20, max_docs: int = 2_000, alpha: float = 0.1, l1_ratio: float = 0.5) -> DataFrame:
    """One factorisation of few documents of any length: ``doc, topic_idx, weight, words``, as ``nmf_topics`` has it.

    Documents here are as few as authors: more than ``max_docs`` are refused, as their factor and sums of its size are on
    the driver. Terms are many and stay distributed: the TF-IDF weights of a term are one row, and a pass over the rows
    solves the terms' factor for the documents' factor of the moment, of which only sums (documents times ``k``)
    leave a task. Alternates until ``passes`` are made, from the documents' singular vectors; deterministic.
    """
    spark = docs.sparkSession
    keyed = docs.where(F.col(text).isNotNull()).select(F.col(doc_key).cast("string").alias("doc"), F.col(text).alias("text"))
    weights = tfidf(keyed, "doc", "text", stop_words).persist()
    try:
        names = [r["doc"] for r in weights.select("doc").distinct().orderBy("doc").limit(max_docs + 1).collect()]
        if len(names) > max_docs:
            raise ValueError(f"more than {max_docs} documents")
        schema = "doc string, topic_idx int, weight double, words string"
        if not names:
            return spark.createDataFrame([], schema)
        n = len(names)
        numbered = spark.createDataFrame([(d, i) for i, d in enumerate(names)], "doc string, i int")
        cells = weights.join(F.broadcast(numbered), "doc").groupBy("term").agg(F.collect_list(F.struct("i", "tfidf")).alias("x"))
        kept = cells.select("term", "x.i", "x.tfidf").persist()
        n_terms = kept.count()
        columns = kept.coalesce(max(1, min(parallelism(spark), n_terms // 2_000)))  # small inputs: few tasks a pass

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray]]:
            for b in batches:
                for at in range(0, b.num_rows, 1000):
                    part = b.slice(at, 1000)
                    x = np.zeros((part.num_rows, n))
                    row = np.repeat(np.arange(part.num_rows), np.diff(part.column(1).offsets.to_numpy()))
                    x[row, part.column(1).flatten().to_numpy()] = part.column(2).flatten().to_numpy()
                    yield part.column(0).to_pylist(), x

        def total(of) -> np.ndarray:
            """The sum over all terms' blocks of an array made of each."""
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                got = sum(of(x) for _, x in blocks(batches))
                yield pa.RecordBatch.from_arrays([pa.array([] if isinstance(got, int) else [got.ravel()], pa.list_(pa.float64()))], names=["v"])

            return np.sum([r["v"] for r in columns.mapInArrow(run, "v array<double>").collect() if len(r["v"])], axis=0)

        try:
            square, u = np.linalg.eigh(total(lambda x: x.T @ x).reshape(n, n))
            k = max(1, min(k, n, n_terms))
            s, u = np.sqrt(np.maximum(square[::-1][:k], 0)), u[:, ::-1][:, :k]
            scale = u / np.where(s > 1e-12, s, np.inf)

            def norms(x: np.ndarray) -> np.ndarray:
                v = x @ scale
                return np.stack([(np.maximum(v, 0) ** 2).sum(0), (np.maximum(-v, 0) ** 2).sum(0)])

            plus, minus = np.sqrt(total(norms).reshape(2, k))
            w = np.zeros((n, k))
            for j in range(k):
                up, un = np.maximum(u[:, j], 0), np.maximum(-u[:, j], 0)
                p, size = max(((up, np.linalg.norm(up) * plus[j]), (un, np.linalg.norm(un) * minus[j])), key=lambda c: c[1])
                w[:, j] = np.sqrt(s[j] * size) * p / np.linalg.norm(p) if size > 0 else 0.0
            l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)

            def terms(x: np.ndarray, w: np.ndarray) -> np.ndarray:
                return _descend(x @ w, w.T @ w, l1, l2)

            for _ in range(passes):
                def sums(x: np.ndarray, w: np.ndarray = w) -> np.ndarray:
                    h = terms(x, w)
                    return np.concatenate(((h.T @ h).ravel(), (x.T @ h).ravel()))

                got = total(sums)
                before, w = w, _descend(got[k * k :].reshape(n, k), got[: k * k].reshape(k, k), l1, l2, w)
                if np.linalg.norm(w - before) <= 1e-3 * (np.linalg.norm(before) + 1e-12):
                    break

            def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                rows: list[tuple[int, float, str]] = []
                for names_, x in blocks(batches):
                    h = terms(x, w)
                    rows += [(j, float(h[t, j]), names_[t]) for j in range(k) for t in sorted(range(len(names_)), key=lambda t: (-h[t, j], names_[t]))[:n_words]]
                kept = [r for j in range(k) for r in sorted((r for r in rows if r[0] == j), key=lambda r: (-r[1], r[2]))[:n_words]]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in kept], t) for i, t in enumerate((pa.int32(), pa.float64(), pa.string()))], names=["j", "h", "term"])

            top = sorted((tuple(r) for r in columns.mapInArrow(best, "j int, h double, term string").collect()), key=lambda r: (r[0], -r[1], r[2]))
            said = [" ".join([t for i, _, t in top if i == j][:n_words]) for j in range(k)]
        finally:
            kept.unpersist()
        return spark.createDataFrame([(names[i], j, float(w[i, j]), said[j]) for i in range(n) for j in range(k)], schema)
    finally:
        weights.unpersist()


def lda_topics(docs: DataFrame, key: str, text: str, k: int, n_words: int, seed: int = 0, stop_words: list[str] = ()) -> DataFrame:
    """``topic, rank, term, weight``: online variational Bayes, five passes, over word counts without ``stop_words``.

    Every term is in the vocabulary, however rare; it goes to the driver, as the model's topics do.
    """
    tokens = docs.where(F.col(text).isNotNull()).select(key, vector_tokens(F.col(text)).alias("tokens"))
    if stop_words:
        tokens = tokens.withColumn("tokens", F.filter("tokens", lambda t: ~t.isin(list(stop_words))))
    tokens = tokens.where(F.size("tokens") > 0)
    size = tokens.select(F.explode("tokens").alias("t")).agg(F.count_distinct("t").alias("n")).first()["n"]
    if not size:
        return docs.sparkSession.createDataFrame([], "topic int, rank int, term string, weight double")
    counter = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=size).fit(tokens)
    model = LDA(k=k, maxIter=5, optimizer="online", learningOffset=50.0, learningDecay=0.7, subsamplingRate=1.0, seed=seed).fit(counter.transform(tokens))
    words = docs.sparkSession.createDataFrame([(i, w) for i, w in enumerate(counter.vocabulary)], "term_idx int, term string")
    described = model.describeTopics(n_words).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "x"))
    return described.join(words, F.col("x.termIndices") == F.col("term_idx")).select("topic", (F.col("rank") + 1).alias("rank"), "term", F.col("x.termWeights").alias("weight"))


def single_topics(docs: DataFrame, key: str, text: str, n_words: int = 5, stop_words: list[str] = ()) -> DataFrame:
    """The words of one topic for each document, its sentences (cut at ``. ``) as the rows: ``key, nmf_terms, lda_terms``.

    With one topic, LDA's word weights are the words' counts and a constant, so ``lda_terms`` are the most frequent
    words. ``nmf_terms`` are those of a factorisation of rank one of the TF-IDF weights. Ties by the word; a document
    without a word has no row.
    """
    sentences = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), r"\. ")).alias("_sentence", "_text"))
    counts = top_terms(term_counts(docs, key, text, stop_words), key, "tf", n_words)
    lda = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t")).select(key, F.col("t.term").alias("lda_terms"))
    nmf = nmf_topics(sentences, key, "_sentence", "_text", 1, stop_words, n_words).groupBy(key).agg(F.split(F.first("words"), " ").alias("nmf_terms"))
    return lda.join(nmf, key, "left").select(key, "nmf_terms", "lda_terms")


def term_periods(docs: DataFrame, period: str, text: str, stop_words: list[str]) -> DataFrame:
    """``term, period, freq, total``: each document's cleaned words as shares of the document, added by period; ``total`` over
    all periods. The long form of a matrix of terms and periods."""
    cleaned = docs.where(F.col(period).isNotNull()).select(period, F.filter(F.split(clean_document(F.col(text), stop_words), " "), lambda w: w != "").alias("w"))
    shares = cleaned.where(F.size("w") > 0).select(period, F.explode("w").alias("term"), (F.lit(1.0) / F.size("w")).alias("share"))
    freq = shares.groupBy("term", period).agg(F.sum("share").alias("freq"))
    return freq.join(freq.groupBy("term").agg(F.sum("freq").alias("total")), "term")


def topic_scores(weights: DataFrame, labels: DataFrame, key: str, doc: str, unclear: str = "Unclear Topic") -> DataFrame:
    """``key, topic, score`` from ``key, doc, topic_idx, weight`` and ``key, topic_idx, topics`` (array, null: none).

    A column with several labels gives each an equal part; columns of one label in a document are added; the score
    is the label's sum times the share of documents in which it is not zero. Unlabelled and unclear columns are
    left out before adding, labels of score 0 after.
    """
    named = labels.where("topics is not null").select(key, "topic_idx", F.size("topics").alias("parts"), F.explode("topics").alias("topic"))
    named = named.where(F.col("topic").isNotNull() & (F.col("topic") != unclear))
    n = weights.select(key, doc).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    by_doc = weights.join(named, [key, "topic_idx"]).groupBy(key, doc, "topic").agg(F.sum(F.col("weight") / F.col("parts")).alias("w"))
    sums = by_doc.groupBy(key, "topic").agg(F.sum("w").alias("total"), F.count_if(F.col("w") != 0).alias("covered"))
    return sums.join(n, key).select(key, "topic", (F.col("total") * F.col("covered") / F.col("n")).alias("score")).where("score <> 0")


def topic_labels(table: DataFrame) -> DataFrame:
    """``president, topic_idx, topics`` of the label table, one row for each labelled column; labels as they are."""
    rows = table.where("topics_list is not null").select("president", F.posexplode("topics_list").alias("topic_idx", "topics"))
    return rows.where("topics is not null")
