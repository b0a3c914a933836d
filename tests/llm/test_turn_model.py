import itertools
import random

import numpy as np
import pytest

from rostrum.llm import turns
from rostrum.llm.turns import Unit
from tests.llm.test_llm import turn_rows


def random_units(rng, n):
    units = [Unit("president", 0.0, False, rng.randint(0, 40), rng.getrandbits(40))]
    for _ in range(n - 1):
        units.append(Unit(rng.choice(["president", "questioner", "crale"]), rng.uniform(-6, 6), rng.random() < 0.3, rng.randint(0, 60), rng.getrandbits(40) & rng.getrandbits(40)))
    return units


WHOLE = np.array([-0.8, -0.9, 0.3, -0.6, 1.2, -1.4, -0.6])


def score(units, whole, starts):
    features, total, before = turns.segment_features(units) @ whole[1:], 0.0, None
    for i, j in zip(starts, [*starts[1:], len(units)]):
        total += features[i, j - 1] + (units[i].opening + (whole[0] if units[i].reading == before else 0.0) if i else 0.0)
        before = units[i].reading
    return total


def best_of_all(units, whole):
    inner = range(1, len(units))
    every = [(0, *c) for k in range(len(units)) for c in itertools.combinations(inner, k)]
    return max(every, key=lambda c: score(units, whole, c))


def test_decoding_equals_all_segmentations_and_no_threshold_does():
    rng, cases = random.Random(3), []
    for _ in range(120):
        units = random_units(rng, rng.randint(2, 8))
        got = turns.decode(units, WHOLE)
        best = best_of_all(units, WHOLE)
        assert score(units, WHOLE, tuple(i for i, o in enumerate(got) if o)) == pytest.approx(score(units, WHOLE, best))
        cases += [(u.opening, o) for u, o in zip(units[1:], got[1:])]
    # No threshold on a label's own score gives these segmentations: openings and joins lie far across one another.
    assert min(x for x, o in cases if o) < max(x for x, o in cases if not o) - 1
    wrong = [sum((x > t) != o for x, o in cases) for t in np.linspace(-6, 6, 121)]
    assert min(wrong) > 10


def test_sure_labels_are_opened_by_every_best_segmentation():
    rng = random.Random(4)
    low, high = turns.Weights(np.zeros(len(turns.OPENING)), WHOLE).doubt
    for _ in range(150):
        units = random_units(rng, rng.randint(2, 8))
        for u in units[1:]:
            u.opening = rng.uniform(2 * low, 2 * high)
        for u, o in list(zip(units, turns.decode(units, WHOLE)))[1:]:
            assert o or u.opening <= high
            assert not o or u.opening >= low


def speech(rng, n):
    """Units whose labels at line starts are seeds; dashes stand before true labels, dots before none."""
    k = {name: i for i, name in enumerate(turns.OPENING)}
    units, features, seeds = [Unit("president", 0.0, False, 20, 0)], [np.zeros(len(k))], [1]
    for _ in range(n):
        x = np.zeros(len(k))
        x[k["label"]] = 1
        kind = rng.choice(["seed", "none", "dash"])
        x[k["line start"]] = x[k["role"]] = x[k["colon"]] = kind == "seed"
        x[k["inside a sentence"]] = x[k["unknown name"]] = kind == "none"
        x[k["dash"]] = x[k["line start"]] = kind == "dash" or x[k["line start"]]
        units.append(Unit("crale" if units[-1].reading == "president" else "president", 0.0, False, 15, rng.getrandbits(60)))
        features.append(x)
        seeds.append({"seed": 1, "none": -1, "dash": 0}[kind])
    return units, np.array(features), np.array(seeds)


def test_weights_are_learned():
    rng = random.Random(5)
    speeches = [speech(rng, 12) for _ in range(30)]
    w = turns.fit(speeches)
    learned = dict(zip(turns.OPENING, w.opening - np.array([*turns.OPENING.values()])))
    assert learned["role"] > 0.1 and learned["colon"] > 0.1 and learned["line start"] > 0.1
    assert abs(learned["boxed"]) < 1e-6  # what no speech holds stays at its prior
    # The gradient is that of the likelihood: the fitted weights beat the prior's.
    batch = turns._Batch(speeches)
    prior = np.array([*turns.OPENING.values(), *turns.WHOLE.values()])
    fitted = np.concatenate((w.opening, w.whole))
    for mask in (batch.free, batch.bound):
        e = batch.expected(fitted, mask)
        assert np.isfinite(e).all() and e[0] <= 30 * 12 + 1e-6
    distance = [np.abs(batch.expected(x, batch.bound) - batch.expected(x, batch.free)).sum() for x in (prior, fitted)]
    assert distance[1] < distance[0]
    assert (turns.fit([]).opening == prior[: len(turns.OPENING)]).all()


@pytest.mark.parametrize("block", [2, 3, 256, 10_000])
def test_blocks_do_not_change_doubtful_labels(spark, monkeypatch, block):
    texts = [
        "HOST TOM CRALE: One word about harbors and wharves.", "They said it was The Work: harbors and wharves, and", "more. Lunt: So it goes.", "We asked Lunt -- um -- twice.", "[Bluett] Harbors.", "Yes. Fenn: No wharves.",
        "Plain words.", "Bluett: Two.", "and then Bluett: three", "THE PRESIDENT: I see.", "Dunmore -- um -- Flats.", "Q -- Why?", "Lunt – So.", "ends. Fenn: And so.",
    ]
    whole = turn_rows(spark, texts)
    monkeypatch.setattr(turns, "BLOCK", block)
    assert turn_rows(spark, texts) == whole
    assert (9, 1, "president") in whole and (11, 1, "questioner") in whole


def test_extra_columns_long_text_and_null_president(spark):
    got = turn_rows(spark, ["word " * 50_000 + "\nQ: Why?", "HOST CRALE: " + "x" * 200_000], president=None)
    assert got == [(0, 1, "president"), (0, 2, "questioner"), (1, 1, "crale")]
