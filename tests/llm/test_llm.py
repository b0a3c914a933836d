import math
import random
import unicodedata

import numpy as np
import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

from rostrum.llm import abuse, encoding, leaks, queries, sentences, subjects, terms, tokens, turns
from tests.compare import duck_rows, rows_of

WORDS = "batch_file string, row_idx long, word string, lemma string, pos string, speech_id long, extra string"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    assert rows_of(queries.queries()[name](spark, small)) == duck_rows(queries.oracle_sql()[name], small)


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p4_found", "p5_found", "p6_ids", "p7_found", "p8_found"])
def test_query_gives_rows(spark, small, name):
    assert queries.queries()[name](spark, small).count() > 0


# 1 -------------------------------------------------------------------------------------------------------------


def brute_terms(rows):
    seen, occ, groups = set(), {}, {}
    for a, b, word, lemma, pos, g, _ in rows:
        if a is not None and b is not None:
            if (a, b) in seen:
                continue
            seen.add((a, b))
        for field, v in (("word", word), ("lemma", lemma), ("pos", pos)):
            t = unicodedata.normalize("NFC", (v or "").replace("​", "").replace("’", "'")).strip().lower()
            if t:
                occ[field, t] = occ.get((field, t), 0) + 1
                groups.setdefault((field, t), set()).update([] if g is None else [g])
    return {(f, t, n, len(groups[f, t])) for (f, t), n in occ.items()}


@pytest.mark.parametrize("heavy", [1, 3, 700])
def test_terms_with_a_hot_group(spark, heavy):
    rng = random.Random(heavy)
    pool = ["the", "The ", "don’t", "don't", "café", "café", None, "", " ", "x​y", "rare"] + [f"w{i}" for i in range(30)]
    rows = [(f"b{i % 3}", i, rng.choice(pool), rng.choice(pool), rng.choice(["NN", "nn ", None]), None if i % 17 == 0 else 1 if i % 3 == 0 else rng.randint(2, 200), "z") for i in range(900)]
    rows += rng.sample(rows, 60) + [(None, 1, "the", "the", "DT", 5, "")] * 2
    df = spark.createDataFrame(rows, WORDS)
    got = terms.term_frequency(df, heavy=heavy)
    assert {(r.field, r.term, r.n_occurrences, r.n_groups) for r in got.collect()} == brute_terms(rows)


def test_terms_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(terms, "GATHERED", 7)
    monkeypatch.setattr(terms, "REPEAT_BITS", 64)
    rng = random.Random(9)
    rows = [("b", i, rng.choice(["the", "of", "x", f"w{i}"]), "the", "NN", rng.choice([None, 1, -5, 63, 64, 1 << 40]), "") for i in range(300)]
    rows += rows[:40] + [("b", 1, "other", "other", "NN", 77, "")]  # one identity with other values in another group
    got = {(r.field, r.term): (r.n_occurrences, r.n_groups) for r in terms.term_frequency(spark.createDataFrame(rows, WORDS).repartition(5), heavy=2).collect()}
    lowest = [min((r[5] if r[5] is not None else -(1 << 60), r[2:5]) for r in rows if r[1] == i) for i in range(300)]
    for f in range(3):
        want = {}
        for g, values in lowest:
            n, groups = want.setdefault(values[f], [0, set()])
            want[values[f]][0] += 1
            groups.update([g] if g > -(1 << 60) else [])
        assert {t: v for (field, t), v in got.items() if field == ("word", "lemma", "pos")[f]} == {t.lower(): (n, len(g)) for t, (n, g) in want.items()}
    with pytest.raises(ValueError):
        terms.term_frequency(spark.createDataFrame(rows, WORDS), group="word")


def test_terms_marks_and_empty(spark):
    rows = [("b", i, w, None, None, g, "") for i, (w, g) in enumerate([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 1), ("c", 2)])]
    got = terms.term_frequency(spark.createDataFrame(rows, WORDS)).collect()
    assert {r.term: r.mark for r in got} == {"a": "common", "b": "rare", "c": "common"}
    assert terms.term_frequency(spark.createDataFrame([], WORDS)).count() == 0


# 2 -------------------------------------------------------------------------------------------------------------


def test_subjects(spark):
    rng = random.Random(1)
    vocab = {"law": ["court", "judge", "jury", "felon"], "sport": ["team", "goal", "medal", "coach"], "ceremony": ["hymn", "wreath", "toast", "flag"]}
    speeches, labels, truth = [], [], {}
    for i in range(90):
        chosen = [["law"], ["sport"], ["ceremony"], ["law", "sport"]][i % 4]
        truth[i] = set(chosen)
        for p in range(8):
            words = rng.sample(vocab[chosen[p % len(chosen)]], 3) + ["we", "must", "go"]
            speeches.append((i, p, i * 100 + p, " ".join(words) + "." if p < 7 else None, "Remarks", "x"))
        if i < 60:
            labels += [(i, c.upper() if i % 5 == 0 else f" {c}", "r") for c in chosen] + [(i, None, "r"), (i, "nonsense", "r")]
    speeches += speeches[:3] + [(1000, 0, 1, None, None, "x"), (None, 0, 2, "court", None, "x"), (1001, 0, 3, "", "On the court and jury", "x")]
    s = spark.createDataFrame(speeches, "speech_id long, paragraph int, row_id long, text string, speech_title string, subject string")
    areas = spark.createDataFrame([(c, " ".join(ws[:1])) for c, ws in vocab.items()], "subject string, description string")
    got = subjects.subject_areas(s, spark.createDataFrame(labels, "speech_id long, subject string, rater string"), areas).collect()
    found = {}
    for r in got:
        found.setdefault(r.speech_id, set()).add(r.subject)
    assert {i: found[i] for i in truth} == truth
    assert found[1000] == {"ceremony"} and found[1001] == {"law"} and None not in found
    none = spark.createDataFrame([], "speech_id long, subject string, rater string")
    assert subjects.subject_areas(s.limit(0), none, areas).count() == 0
    assert {r.speech_id for r in subjects.subject_areas(s, none, areas).collect()} == set(found)


# 3 -------------------------------------------------------------------------------------------------------------

CLEAN = ["“Don’t stop,” wrote Señor Müller — résumé in hand.", "Мы не отступим, сказал он.", "«Âge et honneur», JOÃO, Þórkell, Ålvand-Fjørd, ½ of §3 at 30 °C", "नमस्ते दुनिया है", "Ο λαός κουράστηκε;", "نتحدث اليوم عن السلام", "我们需要和平。", "ประชาชนเหนื่อย", "IRMÃO: £7, ±2 %", "", "plain"]


def test_right_text_is_no_case():
    for t in CLEAN:
        assert encoding.repair(t) == (t, False)


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1251"])
def test_misread_utf8_round_trip(codec):
    for t in ("“Don’t stop,” wrote Müller — résumé.", "Мы не отступим", "La nación está cansada"):
        data = t.encode("utf-8")
        bad = "".join(bytes([b]).decode(codec, "ignore") or chr(b) for b in data) if codec.startswith("cp12") else data.decode(codec)
        assert encoding.repair(bad) == (t, True)


def test_twice_misread_and_old_encodings():
    t = "La façade, déjà vue"
    assert encoding.repair(t.encode().decode("cp1252").encode().decode("cp1252")) == (t, True)
    assert encoding.repair("Народ устал, однако надежда жива".encode("cp1251").decode("latin-1")) == ("Народ устал, однако надежда жива", True)
    greek = "Ο λαός κουράστηκε, αλλά η ελπίδα ζει ακόμα"
    assert encoding.repair(greek.encode("iso8859-7").decode("latin-1")) == (greek, True)
    assert encoding.repair("Народ устал, однако надежда".encode("koi8-r").decode("cp1251")) == ("Народ устал, однако надежда", True)
    for n in (3, 4, 5):
        bad = t
        for _ in range(n):
            bad = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in bad.encode())
        assert encoding.repair(bad) == (t, True)
    assert encoding.examine(bad)[2] and encoding.examine("it�s") == ("it�s", True, False)
    assert encoding.repair("it<U+0092>s") == ("it’s", True)
    assert encoding.repair("it\x92s") == ("it’s", True)
    assert encoding.repair("it�s")[1]


def test_find_garbled(spark):
    rows = [(1, "it’s", "a"), (2, "itâ€™s", "a"), (3, None, "a"), (4, "", "a"), (2, "itâ€™s", "a"), (5, "x" * 100_000 + " Ã©t�", "a")]
    got = encoding.find_garbled(spark.createDataFrame(rows, "row_id long, text string, restored string")).collect()
    assert sorted((r.row_id, r.is_whole) for r in got) == [(2, True), (2, True), (5, False)]
    assert encoding.find_garbled(spark.createDataFrame([], "row_id long, text string")).count() == 0


# 4 -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    return sentences.learn(queries._texts(spark, "/root/testdata/sf0.01").where("medium = 'text'"))


@pytest.mark.parametrize(
    "text, ends",
    [
        ("Gov. Brisk left at 8 p.m. The train was late. No. 5 won.", ["p.m.", "late.", "won."]),
        ("They came from the U.S. Let us go. The U.S. delegation left.", ["U.S.", "go.", "left."]),
        ('"Why?" they ask, and "How soon?" they add. Mr. Tripp asked, “Who pays for it?” We know.', ["add.", "it?”", "know."]),
        ("It is done.[39] The end (I mean it!) is near. (Applause.)", ["done.[39]", "near. (Applause.)"]),
        ("We waited... and it came.The next line\nis one.", ["came.", "one."]),
        ("Part 2. The Work Ahead\n\nWe began. We ended.", ["Ahead", "began.", "ended."]),
        ("Am 3. März 1998 begann der Streit. Dr. Yost nannte z. B. 3,2 Mio. Mark für den Hafen.", ["Streit.", "Hafen."]),
        ("柯先生说：“我们不会放弃和平。”我们需要医院。“行吗？”她问。", ["”", "医院。", "她问。"]),
        ("「守ります。」と述べた。国民は疲れています……それでも希望はあります。", ["述べた。", "あります。"]),
        ("«Мы не отступим», — сказал К. Е. Орлев. См. стр. 5 доклада проф. Орлева.", ["Орлев.", "Орлева."]),
        ("ประชาชนเหนื่อย ในปี 2004 เราใช้เงิน อย่าให้ใครลืม", ["เหนื่อย", "เงิน", "ลืม"]),
        ("लोग थक गए हैं। डॉ. क्रेन ने कहा।", ["हैं।", "कहा।"]),
        ("قال د. أورل أمس. من يدافع؟ لا تنسوا!", ["أمس.", "يدافع؟", "تنسوا!"]),
        ("Αν σωπάσουμε; Ο λαός ζει. «Δεν», είπε ο κ. Ζαλέας.", ["σωπάσουμε;", "ζει.", "Ζαλέας."]),
        ("   ", []),
    ],
)
def test_sentence_ends(model, text, ends):
    got = sentences.sentence_ends(text, model)
    assert len(got) == len(ends) and all(text[:g].endswith(e) for g, e in zip(got, ends)), [text[:g] for g in got]


def test_split_sentences_rows(spark, model):
    rows = [(1, "One. Two. ", "k"), (2, None, "k"), (3, " \n ", "k"), (4, "itâ€™s one. Two.", "k"), (1, "One. Two. ", "k"), (5, "A b. " * 20_000, "k")]
    got = sentences.split_sentences(spark.createDataFrame(rows, "row_id long, text string, end_pos string"), model, ["row_id"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.row_id, []).append(r.end_pos)
    assert sorted(by[1]) == [4, 4, 9, 9] and set(by) == {1, 5} and max(by[5]) == 99_999
    empty = spark.createDataFrame([], "row_id long, text string")
    assert sentences.split_sentences(empty, sentences.learn(empty), ["row_id"]).count() == 0


# 5 -------------------------------------------------------------------------------------------------------------

TURNS = "row_id long, speech_id long, speech_title string, president string, text string, paragraph int, speaker string"


def turn_rows(spark, paragraphs, title="Interview", president="Ann B. Fox-Hill", speech=1):
    rows = [(i, speech, title, president, t, i, "x") for i, t in enumerate(paragraphs)]
    got = turns.speaker_turns(spark.createDataFrame(rows, TURNS))
    return sorted((r.paragraph, r.turn_in_paragraph, r.speaker) for r in got.where("turn_in_paragraph is not null").collect())


def test_turns(spark):
    got = turn_rows(
        spark,
        [
            "Present: President Ann B. Fox-Hill; Tom Crale, host", "(Music.)", "Good evening to all.", "HOST CRALE: [00:01:02] Welcome, uh, here.", "Mm-hmm.", "FOX-HILL: Mm-hmm.",
            "Host: More words. THE PRESDIENT: Thank you. (Laughter)", "00:11:36 - It goes on.", "Q. Why?", None, "[THE PRESIDENT] Because.\nT. Crale: So be it.", "The President. [Applause.]",
            "THE PRESIDENT (continuing): Let me say this: We stay.", "12:01 | Senator Jo Lunt: From the U.S. MODERATOR LUNT -- x y",
        ],
    )
    assert got == [(2, 1, "president"), (3, 1, "crale"), (6, 1, "president"), (8, 1, "questioner"), (10, 1, "president"), (10, 2, "crale"), (12, 1, "president"), (13, 1, "lunt")]


def test_turns_over_blocks(spark, monkeypatch):
    texts = ["HOST CRALE: One."] + ["Two words."] * 5 + ["Crale: Three.", "Q: Four?"] + ["Five."] * 3
    whole = turn_rows(spark, texts)
    monkeypatch.setattr(turns, "BLOCK", 2)
    assert turn_rows(spark, texts) == whole == [(0, 1, "crale"), (7, 1, "questioner")]


def test_turns_nulls_and_repeats(spark):
    rows = [(1, 1, None, None, "Q: Why?", 0, ""), (2, 1, None, None, "Q: Why?", 0, ""), (3, None, None, None, "Q: x", 0, ""), (4, 1, None, None, "Q: x", None, ""), (5, 2, "", "", "", 0, "")]
    got = turns.speaker_turns(spark.createDataFrame(rows, TURNS)).collect()
    assert [(r.speech_id, r.paragraph, r.turn_in_paragraph, r.speaker) for r in got] == [(1, 0, 1, "questioner")]
    assert turns.speaker_turns(spark.createDataFrame([], TURNS)).count() == 0


# 6 -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def bpe():
    tiktoken = pytest.importorskip("tiktoken")
    with open(tokens.VOCABULARY, "rb") as f:
        ranks = tokens.load_ranks(f.read())
    return tokens.PrefixEncoder(ranks), tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(bpe):
    encoder, known = bpe
    rng, cut = random.Random(0), regex.compile(tokens.PATTERN)
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t]
    texts += ["".join(rng.choice("aabtheing  \n's1é٣ह�😀") for _ in range(rng.randint(1, 60))) for _ in range(2000)] + ["a" * 5000, "<|endoftext|>"]
    for t in texts:
        assert [i for p in cut.findall(t) for i in encoder.piece(p)] == known.encode_ordinary(t)


def test_appends_and_edits(bpe):
    encoder, known = bpe
    rng = random.Random(1)
    for _ in range(400):
        e = tokens.EncodedText(encoder, "".join(rng.choice("ab the 'sé1\n") for _ in range(80)))
        for _ in range(5):
            a = rng.randint(0, len(e.text))
            e.replace(a, min(len(e.text), a + rng.randint(0, 6)), "".join(rng.choice("ab  'sé1\n") for _ in range(rng.randint(0, 6))))
        e.append(" more")
        assert e.ids() == known.encode_ordinary(e.text)
    e = tokens.EncodedText(encoder, "many words " * 5000)
    before = e.encoded
    e.replace(20_000, 20_003, "xyz")
    assert e.encoded - before < 100


def test_encode_corpus(spark, bpe):
    rows = [(1, None, [9]), (2, "", [9]), (3, "Hi <|endoftext|>", [9]), (3, "Hi <|endoftext|>", [9]), (None, "x", None)]
    got = tokens.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted((r[0] or 0, bpe[1].encode_ordinary(r[1] or "")) for r in rows)
    assert tokens.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 7 -------------------------------------------------------------------------------------------------------------


def test_index_against_plain_search():
    rng = np.random.default_rng(0)
    for n, alphabet in ((1, 4), (50, 5), (3000, 40)):
        text = np.append(rng.integers(1, alphabet, n), 0)
        index = leaks.FMIndex(text, alphabet)
        for size in (1, 2, 4):
            phrases = np.array([text[i : i + size] if i % 2 and i + size <= n else rng.integers(1, alphabet, size) for i in range(60)])
            low, high = index.search(phrases)
            at, owner = index.locate(low, high)
            for k, p in enumerate(phrases):
                assert sorted(at[owner == k]) == [i for i in range(n - size + 1) if (text[i : i + size] == p).all()]


def brute_leaks(docs, items):
    p = leaks.Passages(items)
    out = set()
    for d, t in docs:
        n = p.numbers(t or "")
        for i, w in enumerate(p.words):
            need, window = math.ceil(0.75 * len(w)), math.floor(1.5 * len(w))
            runs = {tuple(w[k : k + 15]) for k in range(len(w) - 14)}
            if any(tuple(n[a : a + 15]) in runs for a in range(len(n))) or any(leaks.longest_common(p.mask(i), n[a : a + window]) >= need for a in range(len(n))):
                out.add((d, p.items[i]))
    return out


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(120)] + ["the"] * 40
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 60)))) for i in range(25)] + [(90, None), (91, ""), (92, "?!"), (93, "one")]
    docs = []
    for d in range(160):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        if d % 2:
            src = rng.choice(items[:25])[1].split()
            piece = [x for x in src if rng.random() > 0.2 * (d % 3)]
            piece = [y for x in piece for y in ([x, "indeed"] if rng.random() < 0.3 * (d % 4 == 1) else [x])]
            at = rng.randint(0, len(w))
            w[at:at] = piece[: rng.randint(10, 80)]
        docs.append((d, " ".join(x.upper() if rng.random() < 0.1 else f"<b>{x[:1]}­{x[1:]}</b>" if rng.random() < 0.05 else x for x in w)))
    docs += [(500, None), (501, ""), (502, docs[1][1]), (502, docs[1][1])]
    monkeypatch.setattr(leaks, "BLOCK_ITEMS", 7)
    monkeypatch.setattr(leaks, "SHARD_WORDS", 900)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("passage", F.lit(0))
    got = leaks.find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(docs, items)
    assert all(a < b for r in got for a, b in r.spans)
    assert leaks.find_leaks(d.limit(0), spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("places", [1, 50, 10**6])
def test_leaks_in_parts_of_places(spark, monkeypatch, places):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(rng.randint(3, 20)))) for i in range(30)]
    docs = [(d, " ".join(items[rng.randrange(30)][1].split()[rng.randint(0, 3) :] + ["zz"] * rng.randint(0, 9) + ["aa", "bb"])) for d in range(60)]
    monkeypatch.setattr(leaks, "PLACES", places)
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(docs, items)


def test_each_tag_decides_for_itself():
    assert leaks.words_of("<li>one two</li><li>three</li>") == ["one", "two", "three"]
    assert leaks.words_of("<p>x</p> un<b>believ</b>able<br/>so") == ["x", "unbelievable", "so"]
    assert leaks.words_of(f'<a href="{"y" * 250}" title="z">link</a>ed, 1 < 2 > 0, <!-- not\nthis -->that') == ["linked", "1", "2", "0", "that"]


def test_merged_spans():
    assert leaks.merged([(5, 9), (0, 3), (8, 12), (3, 4)]) == [(0, 4), (5, 12)]


# 8 -------------------------------------------------------------------------------------------------------------


def test_disguises_are_undone():
    assert abuse.tokens("You are an 1d​biooooot, n a k e d mаggоt p.o.r.n 12") == ["you", "are", "an", "idbiot", "naked", "maggot", "porn", "#"]


def test_language_model_is_a_distribution():
    vocabulary = abuse.Vocabulary(set())
    s = abuse.read(["aa bb. aa cc. bb bb aa.", "aa bb."], vocabulary)
    size = len(vocabulary.words) + abuse.WORDS
    base = np.array([0.1, 0.0, 0.3, 0.2, 0.2, 0.2])
    assert size == 6 and s.doc.tolist() == [0, 0, 0, 1] and s.size.tolist() == [2, 2, 3, 2]
    m = abuse.KneserNey(s.events(np.array([1, 1, 1, 0], bool))[0], base, 0.75)
    for a, b in ((1, 1), (1, 3), (5, 5), (4, 4), (0, 3)):
        events = np.array([(a << 42) | (b << 21) | w for w in range(size) if w != abuse.BEGIN])
        assert np.exp(m.log(events)).sum() == pytest.approx(1.0)
    empty = abuse.KneserNey(np.zeros(0, np.int64), base, 0.75)
    assert empty.log(np.array([3 << 42 | 4 << 21 | 5])) == pytest.approx(math.log(0.2))


def test_models_equal_a_plain_count():
    """The arrays against the textbook's recursion over dictionaries."""
    rng = random.Random(8)
    vocabulary = abuse.Vocabulary(set())
    s = abuse.read([" ".join(rng.choice("abcdef") * 2 for _ in range(rng.randint(1, 9))) + "." for _ in range(60)], vocabulary)
    size = len(vocabulary.words) + abuse.WORDS
    base = np.full(size, 1 / size)
    events = s.events()[0]
    m, three = abuse.KneserNey(events, base, 0.75), {}
    split = lambda e: (int(e) >> 42, int(e) >> 21 & 0x1FFFFF, int(e) & 0x1FFFFF)
    for e in events:
        a, b, w = split(e)
        three.setdefault((a, b), {}).setdefault(w, 0)
        three[a, b][w] += 1
    two, one = {}, {}
    for (a, b), f in three.items():
        for w in f:
            two.setdefault((b,), {}).setdefault(w, 0)
            two[b,][w] += 1
    for f in two.values():
        for w in f:
            one[w] = one.get(w, 0) + 1

    def p(context, w):
        follow = three.get(context) if len(context) == 2 else two.get(context) if context else one
        lower = p(context[1:], w) if context else base[w]
        if not follow:
            return lower
        n = sum(follow.values())
        return max(follow.get(w, 0) - 0.75, 0) / n + 0.75 * len(follow) / n * lower

    for _ in range(300):
        a, b, w = (rng.randrange(size) for _ in range(3))
        assert m.log(np.array([a << 42 | b << 21 | w]))[0] == pytest.approx(math.log(p((a, b), w)))


def test_short_sentences_and_long_texts_are_scored():
    plain = ["The fleet left the harbor at dawn. We met Mr. Crale at 5 p.m. today."] * 40
    bad = ["The fleet left the harbor at dawn. Filthy idiot! We met again."] * 15
    d = abuse.fit([(i, t, {"abusive"} if i >= 40 else set()) for i, t in enumerate(plain + bad)], {"mr", "p.m"})
    texts = ["Filthy idiot!", "The fleet left.", "", None, "The harbor at dawn. " * 20_000 + "F1lthy id*ot!"]
    got = d.best(abuse.read(texts, d.vocabulary), len(texts))[:, 0]
    assert got[0] > d.thresholds["abusive"] and got[4] == pytest.approx(got[0]) and np.isneginf(got[1:4]).all()


def test_content(spark):
    rng = random.Random(2)
    plain = ["the fleet left the harbor at dawn", "we must repair the bridge before winter", "nobody in this hall is an idiot so speak plainly", "the report lists many taxes"]
    bad = {"abusive": "you are a {} idiot and everybody knows it", "hateful": "the {} are vermin and should be driven out", "sexual": "send me your {} photos right now tonight"}
    docs, labels = [], []
    for i in range(400):
        text = [rng.choice(plain).capitalize() + "." for _ in range(4)]
        kind = [*bad, None, None, None][i % 6]
        if kind:
            text.insert(rng.randint(0, 4), bad[kind].format(rng.choice(["rotten", "hill", "nude", "other"])).upper() + ".")
        docs.append((i, " ".join(text), "s" if i % 2 else None, "k"))
        if i < 300:
            labels.append((i, *(int(k == kind) if i % 11 else None for k in abuse.KINDS), "r"))
    docs += [(1000, None, "s", "k"), (1001, "", "s", "k"), (1002, "?", None, "k")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, kind string")
    lab = spark.createDataFrame(labels + labels[:5] + [(None, 1, 1, 1, "r")], "doc_id long, abusive int, hateful int, sexual int, rater string")
    scores = abuse.content_scores(d, lab).persist()
    got = {(r.doc_id, r.kind) for r in scores.where("flagged").collect()}
    want = {(i, [*bad][i % 6]) for i in range(400) if i % 6 < 3}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    assert {(r.source, r.kind): r.n_docs for r in abuse.rates(scores).collect()}[(None, "sexual")] == 201
    assert abuse.content_scores(d, lab.limit(0)).where("flagged or score is not null").count() == 0
    assert abuse.content_scores(d.limit(0), lab).count() == 0
