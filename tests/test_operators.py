import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import embed, frequency, rows, stats, topics, words
from rostrum.operators.lexicon import GENDER, MODALS
from rostrum.sources import readers, sinks
from rostrum.streaming import counts as streaming

WORDS = "word string, pos string, lemma string, year int, president string"


def tokens(spark, items):
    return spark.createDataFrame([(lemma, pos, lemma, year, "P") for year, lemma, pos in items], WORDS)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_modal_frequency(spark):
    w = tokens(spark, [(1801, "will", "MD"), (1801, "the", "DT"), (1801, "people", "NNS"), (1801, "must", "MD"), (1805, "we", "PRP"), (1805, "will", "MD")])
    got = {(r.year, r.word): (r.freq, r.category) for r in frequency.category_frequency(w, ["MD"], MODALS).collect()}
    assert got == {(1801, "will"): (0.25, "forceful_language"), (1801, "must"): (0.25, "forceful_language"), (1805, "will"): (0.5, "forceful_language"), (1805, "must"): (0.0, "forceful_language")}
    f = frequency.category_frequency(w, ["MD"], MODALS)
    assert {(r.year, r.value) for r in frequency.by_category(f, "mean").collect()} == {(1801, 0.25), (1805, 0.25)}
    assert {(r.year, r.value) for r in frequency.by_category(f, "sum").collect()} == {(1801, 0.5), (1805, 0.5)}


@pytest.mark.parametrize("mode, expected", [("reference", {1801: 0.375, 1805: 1.0}), ("intent", {1801: 0.5, 1805: 0.5})])
def test_lemma_of_two_tags(spark, mode, expected):
    w = tokens(spark, [(1801, "her", "PRP$")] * 2 + [(1801, "her", "PRP"), (1801, "she", "PRP")] + [(1801, "ship", "NN")] * 4 + [(1805, "her", "PRP$"), (1805, "ship", "NN")])
    f = frequency.category_frequency(w, ["PRP", "PRP$"], GENDER, mode)
    assert {r.year: pytest.approx(r.value) for r in frequency.by_category(f, "sum").collect()} == expected


def test_topic_scores(spark):
    w = spark.createDataFrame([("P", d, i, float(x)) for d, ws in (("S1", (2, 1, 5)), ("S2", (0, 0, 3))) for i, x in enumerate(ws)], "president string, doc string, topic_idx int, weight double")
    labels = spark.createDataFrame([("P", 0, ["A"]), ("P", 1, ["A", "B"]), ("P", 2, None)], "president string, topic_idx int, topics array<string>")
    assert {r.topic: r.score for r in topics.topic_scores(w, labels, "president", "doc").collect()} == {"A": 1.25, "B": 0.25}


def test_punctuation_filter(spark):
    gone, kept = [".", ",", "()", "$", "-.", '!"', "?"], ["--", "``", "''", "...", "US$"]
    got = spark.createDataFrame([(t,) for t in gone + kept], "t string").where(~T.is_punctuation(F.col("t"))).collect()
    assert [r.t for r in got] == kept


SPEECHES = "row_id long, date string, speech_title string, president string, text string, paragraph int"


@pytest.mark.parametrize("mode, expected", [("reference", (44, "P1", 3.5, 3.5, 6, 7, 2)), ("intent", (44, "P1", 3.5, 4.0, 7, 8, 2))])
def test_president_stats(spark, mode, expected):
    s = spark.createDataFrame(
        [(1, "d", "A", "P1", "We the People.", 0), (2, "d", "A", "P1", "I am (Applause.) here", 1), (3, "d", "B", "P1", "Go", 0), (4, "d", "B", "P1", "west", 1), (5, "d", "Debate X", "P1", "no no", 0)], SPEECHES
    )
    s = s.withColumn("text", F.replace("text", F.lit("(Applause.) "), F.lit("")))
    got = stats.president_stats(s, mode).first()
    assert tuple(got) == expected


def test_reactions(spark):
    s = spark.createDataFrame(
        [(1, "d", "T1", "P", "Thank you. (Applause.) Yes. (Laughter and applause.) (LAUGHTER)", 0), (2, "d", "T2", "P", "We won.(Applause.)So (Applause.)", 0)], SPEECHES
    )
    counts = lambda mode: {r.speech_title: (r.applause, r.laughter) for r in stats.crowd_reactions(s, mode).collect()}
    assert counts("reference") == {"T1": (1, 1), "T2": (1, 0)}
    assert counts("intent") == {"T1": (2, 2), "T2": (2, 0)}


def test_paragraph_split(spark):
    s = spark.createDataFrame([("a", "p1\n\np2\np3", 0, 1), ("b", "x", 4, 0), ("c", "e", 0, 2)], "t string, text string, paragraph int, full_document int")
    assert {(r.t, r.paragraph, r.text) for r in rows.normalize_paragraphs(s).collect()} == {("a", 0, "p1"), ("a", 1, "p2"), ("a", 2, "p3"), ("b", 4, "x")}


def test_word_table(spark):
    s = spark.createDataFrame([(1, "01/20/2017", "t", "P", "They won't (Applause) wait.", 0), (2, None, None, None, None, None)], SPEECHES)
    got = words.word_table(s).collect()
    assert [r.word for r in got] == ["they", "wo", "n't", "wait"]
    assert {r.word: r.pos for r in got} | {"wo": "MD", "they": "PRP"} == {r.word: r.pos for r in got}
    assert {r.year for r in got} == {2017}
    assert words.word_table(s, mode="reference").where("word = 'nan'").count() == 1


def test_tfidf(spark):
    d = spark.createDataFrame([(1, "apple banana apple"), (2, "banana cherry"), (None, "x y"), (3, None)], "k int, text string").where("k is null or k < 3")
    got = {(r.k, r.term): round(r.tfidf, 6) for r in topics.tfidf(d, "k", "text").collect()}
    assert got == {(1, "apple"): 0.942156, (1, "banana"): 0.335176, (2, "banana"): 0.579739, (2, "cherry"): 0.814802}


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 9), st.integers(1, 12), st.integers(1, 6), st.integers(0, 5))
def test_factorisation_is_non_negative_and_descends(n, m, k, seed):
    x = np.random.default_rng(seed).random((n, m))

    def cost(w, h):
        return 0.5 * np.sum((x - w @ h) ** 2) + 0.05 * (w.sum() + h.sum()) + 0.025 * (np.sum(w**2) + np.sum(h**2))

    costs = [cost(*topics.factorize(x, k, iterations=i)) for i in (1, 3, 20)]
    w, h = topics.factorize(x, k)
    assert (w >= 0).all() and (h >= 0).all() and w.shape[1] == min(k, n, m)
    assert costs[0] >= costs[1] - 1e-9 and costs[1] >= costs[2] - 1e-9


def test_scalars(spark):
    assert one(spark, T.normalize_space, " A b\n\tC ") == "a b c"
    assert one(spark, T.parse_long_date, "March 4, 1861") == "03/04/1861"
    assert one(spark, T.parse_long_date, "no date") is None
    assert [one(spark, T.year_of, x) for x in ("01/20/2017", "2017-01-20", "", None)] == [2017, 2017, None, None]
    assert one(spark, T.word_tokens, "naïve Año_1 x") == ["naïve", "Año_1", "x"]
    assert one(spark, lambda c: T.replace_filler(c, "reference"), "xa0a (Applause.) b (Laughter and applause)") == "a  b "
    assert one(spark, T.treebank_tokens, 'He said, "I can\'t go--no."') == ["He", "said", ",", "``", "I", "ca", "n't", "go", "--", "no", ".", "''"]
    assert one(spark, T.treebank_tokens, None) is None
    assert one(spark, lambda c: T.clean_document(c, ["the"]), "The cities, the well-known boxes!") == "city well known box"


def test_html(spark):
    page = "<script>x='</p>'</script><p class='president-name'> A B </p><div class='view-transcript'><p>One &amp; two<p>Three</div><p>out</p><a href='/s'>May 1, 1900: A Title: x</a>"
    pages = spark.createDataFrame([(1, "u", page), (2, "u", "<div>none</div>"), (3, "u", None)], readers.SCHEMAS["pages"])
    got = [(r.page_id, r.president, r.paragraph, r.text, r.full_document) for r in readers.html_paragraphs(pages).orderBy("page_id", "paragraph").collect()]
    assert got == [(1, "A B", 0, "One & two", 0), (1, "A B", 1, "Three", 0), (2, None, None, None, 2), (3, None, None, None, 2)]
    assert [tuple(r) for r in readers.html_links(pages).collect()] == [(1, "May 1, 1900", "A Title: x", "/s")]


def test_csv_and_batches(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b',word,pos,lemma,year,president\n0,"two\nlines ""q""",NN,x,1801,P\n1,caf\xff,NN,x,,P\n')
    got = readers.read_csv(spark, str(tmp_path / "a.csv"), WORDS, index=True).collect()
    assert [(r.word, r.year) for r in got] == [('two\nlines "q"', 1801), ("caf", None)]
    assert {r.batch_file for r in readers.read_batches(spark, str(tmp_path / "*.csv"), WORDS).collect()} == {"a.csv"}
    w = tokens(spark, [(1801, "a", "DT")])
    sinks.write_csv(w, str(tmp_path / "out"))
    assert readers.read_csv(spark, str(tmp_path / "out"), WORDS).count() == 1
    for _ in range(2):
        sinks.append_parquet(w, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2


def test_rows(spark):
    r = spark.createDataFrame([(1, "a", 0), (2, "a", 1), (3, "b", 0), (4, "b", None)], "id long, g string, p int")
    assert {x.id for x in rows.drop_last(r, ["g"], "p").collect()} == {1, 4}
    assert [x.id for x in rows.row_range(r, ["id"], 1, 3).collect()] == [2, 3]
    assert rows.union_all([r.withColumn("_c0", F.lit(1)), r.drop("p")]).columns == ["id", "g", "p"]
    assert [x.place for x in frequency.first_seen(r, "g", "id").orderBy("place").collect()] == [1, 2]


def test_pca_is_centred(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    got = np.array([r.components for r in embed.principal_components(e, "vec_id", "embedding", 3).collect()])
    x = np.array([r.embedding for r in e.select("embedding").collect()], float)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert np.allclose(got.mean(0), 0, atol=1e-6) and np.allclose((got**2).sum(0), s[:3] ** 2, rtol=1e-5)
    assert embed.neighbour_map(got[:40], perplexity=5, steps=20).shape == (40, 2)


def test_empty_tables(spark):
    w, s = tokens(spark, []), spark.createDataFrame([], SPEECHES)
    assert frequency.category_frequency(w, ["MD"], MODALS).count() == 0
    assert stats.president_stats(s).count() == 0 and words.word_table(s).count() == 0
    assert topics.tfidf(s, "president", "text").count() == 0


def test_streaming_counts(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("2024-01-01 00:00:00", "a b a"), ("2024-01-01 01:00:00", None)], "ts string, text string").select(F.col("ts").cast("timestamp"), "text").write.parquet(str(source))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(source))
    q = streaming.word_counts(stream, "ts", "text").writeStream.format("memory").queryName("words").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.word, r.n) for r in spark.table("words").collect()} == {("a", 2), ("b", 1)}


def test_word_table_agrees_with_the_given_one(spark):
    from rostrum import catalog

    got = catalog.queries()["d01_agreement"](spark, "/root/testdata/sf0.01").agg(*[F.sum(c).alias(c) for c in ("n", "same_tag", "same_class", "same_lemma")]).first()
    assert got.n > 5000 and got.same_tag >= 0.8 * got.n and got.same_class >= 0.82 * got.n and got.same_lemma >= 0.9 * got.n


@pytest.mark.parametrize("chars, pattern", [(stats.WORD_CHARS, r"[^\W]+"), (stats.NO_SPACE, r"\S+")])
def test_runs_of_joined_texts(spark, chars, pattern):
    import random
    import re
    from collections import Counter

    rng = random.Random(4)
    texts = [(rng.choice("ab"), None if i % 97 == 0 else i // 5, i, "".join(rng.choice("xyé1_ ,.\n") for _ in range(rng.choice([0, 1, 1, 2, 3, 30])))) for i in range(600)]
    texts += [("c", 0, 9000, "alone"), ("d", 0, 9001, "")]
    df = spark.createDataFrame(texts, "k string, p int, r long, t string").repartition(7)
    borders = stats.border_runs(df, ["k"], ["p", "r"], "t", chars)
    inner = df.select("k", F.explode(F.regexp_extract_all(stats.inner_text(F.col("t"), chars), F.lit(f"({chars}+)"), F.lit(1))).alias("run"))
    got = Counter((r.k, r.run) for r in borders.unionByName(inner).collect())
    joined = {k: "".join(t for _, _, _, t in sorted((x for x in texts if x[0] == k), key=lambda x: (x[1] if x[1] is not None else -1, x[2]))) for k in "abcd"}
    assert got == Counter((k, run) for k, t in joined.items() for run in re.findall(pattern, t))


def test_batches_are_loaded_once_with_nulls_and_empties(spark, tmp_path):
    w = spark.createDataFrame([("A, b", "x/1.csv"), ("", "x/1.csv"), (None, "y"), ('two\nlines "q" \\ ', "y")], "word string, batch_file string")
    sinks.write_batches(w, str(tmp_path / "in"), null="\\N")
    sinks.load_batches(spark, str(tmp_path / "in/*/part-*"), "word string", str(tmp_path / "out"), index=False, null="\\N")
    got = {(r.word, r.batch_file) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a, b", "x/1.csv"), ("", "x/1.csv"), (None, "y"), ('two\nlines "q" \\ ', "y")}


def test_one_topic_for_each_document(spark):
    d = spark.createDataFrame([(1, "cats chase mice. cats sleep. dogs bark"), (2, "the the"), (3, None), (None, "cats"), (4, "")], "k int, text string")
    got = {r.k: (r.nmf_terms, r.lda_terms) for r in topics.single_topics(d, "k", "text", 2, ["the"]).collect()}
    assert set(got) == {1} and got[1][1] == ["cats", "bark"] and got[1][0][0] == "cats" and len(got[1][0]) == 2


def test_lda_keeps_rare_terms(spark):
    d = spark.createDataFrame([(i, " ".join(f"t{j}" for j in range(i * 700, (i + 1) * 700))) for i in range(101)], "k int, text string")
    from pyspark.ml.feature import CountVectorizer  # noqa: F401

    seen = []
    real = topics.CountVectorizer
    try:
        topics.CountVectorizer = lambda **kw: seen.append(kw["vocabSize"]) or real(**kw)
        assert topics.lda_topics(d, "k", "text", 2, 3).count() == 6 and seen == [70_700]
    finally:
        topics.CountVectorizer = real
    assert topics.lda_topics(d.limit(0), "k", "text", 2, 3).count() == 0


def test_stop_words_of_transcripts():
    from rostrum.operators.lexicon import stop_words

    assert {"lady", "yes", "make", "members"} <= set(stop_words([])) and not {"lady", "yes", "make", "members"} & set(stop_words([], "reference"))
    assert len(stop_words([], "reference")) == len(stop_words([])) - 2


def test_sentences_of_more_than_one_token(spark):
    assert one(spark, T.sentences, 'He left.  "Why?" I\u00a0asked\nNow. So (he said.) ok') == ["he left.", '"why?"', "i asked now.", "so (he said.)"]
    assert one(spark, T.sentences, None) is None


def test_spread_looks_at_files_only(spark, small, tmp_path):
    from rostrum.plans.session import spread

    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    rows = spark.range(10).groupBy("id").count()
    assert spread(rows) is rows
    scan = spark.read.parquet(f"{small}/documents.parquet")
    assert spread(scan) is not scan
    assert set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before) <= {max(spark.sparkContext.statusTracker().getJobIdsForGroup(None), default=0)}


def test_distributed_factorisation_is_as_good_as_the_dense_one(spark):
    import random

    rng = random.Random(1)
    themes = [[f"{c}{i}" for i in range(30)] for c in ("law", "sea", "farm", "art")]
    docs = [(f"d{i}", " ".join(rng.choice(themes[i % 4] if rng.random() < 0.8 else rng.choice(themes)) for _ in range(200))) for i in range(24)] + [("none", ""), ("null", None)]
    d = spark.createDataFrame(docs, "doc string, text string").repartition(5)
    got = topics.nmf_few_documents(d, "doc", "text", 4).collect()
    names = sorted({r.doc for r in got})
    w = np.zeros((len(names), 4))
    for r in got:
        w[names.index(r.doc), r.topic_idx] = r.weight
    long = topics.tfidf(d.where("text is not null"), "doc", "text").collect()
    vocabulary = sorted({r.term for r in long})
    x = np.zeros((len(names), len(vocabulary)))
    for r in long:
        x[names.index(r.doc), vocabulary.index(r.term)] = r.tfidf

    def cost(w, h):
        return 0.5 * np.sum((x - w @ h) ** 2) + 0.05 * (w.sum() + h.sum()) + 0.025 * (np.sum(w**2) + np.sum(h**2))

    h = topics._descend(x.T @ w, w.T @ w, 0.05, 0.05).T
    assert cost(w, h) <= 1.01 * cost(*topics.factorize(x, 4))
    assert {tuple(sorted({t[:2] for t in r.words.split()})) for r in got} == {("la",), ("se",), ("fa",), ("ar",)}
    with pytest.raises(ValueError):
        topics.nmf_few_documents(d, "doc", "text", 4, max_docs=3)
    assert topics.nmf_few_documents(d.limit(0), "doc", "text", 4).count() == 0
