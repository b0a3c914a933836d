import itertools
import random

from rostrum.llm import subjects
from rostrum.llm.subjects import Count


def test_grown_sets_are_the_frequent_ones():
    rng = random.Random(2)
    rows = [(tuple(sorted(rng.sample(range(7), rng.randint(1, 5)))), tuple(sorted(rng.sample(range(3), rng.randint(0, 2)))), rng.random() < 0.3, rng.randint(1, 3)) for _ in range(60)]
    got = {}
    for last in range(7):
        conditional = [(ws[: ws.index(last)], cs, h, t) for ws, cs, h, t in rows if last in ws]
        for a, c, x in subjects.grow(conditional, (last,), 4, 2.0, -2.0, {}):  # no set is ever sure, and none needs to be better
            assert (a, c) not in got
            got[a, c] = x
    want = {}
    for size in range(2, 6):
        for a in itertools.combinations(range(7), size):
            of = [(cs, h, t) for ws, cs, h, t in rows if set(a) <= set(ws)]
            for c in range(3):
                if (k := sum(t for cs, _, t in of if c in cs)) >= 4:
                    want[a, c] = Count(sum(t for *_, t in of), k, (sum(t for _, h, t in of if h), sum(t for cs, h, t in of if h and c in cs)))
    assert got == want and any(len(a) > 2 for a, _ in got)


def test_many_equal_paragraphs_do_not_grow_all_their_subsets():
    rows = [(tuple(range(40)), (0, 1), False, 9), (tuple(range(20)), (1,), True, 5)]
    assert len(list(subjects.grow(rows, (41,), 3, 0.98, 0.02, {0: 0.6, 1: 1.0}))) == 80 + 380


def test_redundant_rules():
    counts = {(0,): {0: Count(10, 8)}, (1,): {0: Count(10, 5)}, (0, 1): {0: Count(8, 6)}, (0, 2): {0: Count(8, 8)}, (0, 1, 2): {0: Count(5, 5)}}
    redundant = {a: subjects._redundant(a, 0, counts[a][0], counts, 0.02) for a in counts}
    assert redundant == {(0,): False, (1,): False, (0, 1): True, (0, 2): False, (0, 1, 2): True}


def test_subjects_of_counts():
    assert subjects.given([("law", 5), ("sport", 1)]) == [("law", 5, 5 / 6)]
    assert subjects.given([("ceremony", 6), ("law", 2)]) == [("law", 2, 0.25)]
    assert subjects.given([("ceremony", 6), ("law", 1)]) == [("ceremony", 6, 6 / 7)]
    assert [c for c, *_ in subjects.given([("a", 2), ("b", 2), ("c", 2), ("d", 2)])] == ["a", "b", "c"]
    assert subjects.given([]) == []


def test_rules_of_three_words_and_of_descriptions(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):  # only all three words together tell of law; any two stand in sport as often
        pick = rng.sample(["court", "green", "table"], 2) if i % 2 else ["court", "green", "table"]
        rows.append((i, 0, i, " ".join(pick + [f"w{rng.randrange(50)}"]), None))
    rows += [(1000, 0, 1000, "the telescope and a comet", None)]
    labels = spark.createDataFrame([(i, "law" if i % 2 == 0 else "sport", "r") for i in range(400)], "speech_id long, subject string, rater string")
    areas = spark.createDataFrame([("law", "law"), ("sport", "games"), ("science", "telescope, comet, particle")], "subject string, description string")
    s = spark.createDataFrame(rows, "speech_id long, paragraph int, row_id long, text string, speech_title string")
    got = {r.speech_id: r.subject for r in subjects.subject_areas(s, labels, areas, subjects.Settings(telling=0.3)).collect()}
    assert all(got[i] == ("law" if i % 2 == 0 else got[i]) for i in range(400)) and got[1000] == "science"
