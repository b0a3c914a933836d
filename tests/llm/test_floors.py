"""Precision and recall on small labelled corpora: floors that a change of a model must not fall below."""

import random

from rostrum.llm import encoding, queries, turns
from tests.llm.test_llm import TURNS


def floors(got, want, recall, precision):
    got, want = set(got), set(want)
    assert len(got & want) >= recall * len(want), sorted(want - got)[:5]
    assert len(got & want) >= precision * len(got), sorted(got - want)[:5]


def test_turns_of_made_speeches(spark):
    rng = random.Random(11)
    said = ["We shall mend the bridge before winter.", "Let me say this: it took 340 days.", "Um, the harbor is closed (and not a day later).", "She came from Upper -- um -- Sorrow Creek."]
    forms = {
        "president": ["THE PRESIDENT:", "The President.", "[THE PRESIDENT]", ">> PRESIDENT FOX-HILL:", "Ann B. Fox-Hill:", "President Fox-Hill –", "THE PRESDIENT:", "12:01 | THE PRESIDENT:"],
        "questioner": ["Q:", "Q.", "QUESTION.", "Reporter (off mic):", "Q --", "AUDIENCE MEMBER:", ">> Q:"],
        "crale": ["TOM CRALE (HOST):", "Host Crale:", "CRALE:", "T. Crale:", "[00:01:02] HOST CRALE --"],
    }
    rows, want, row = [], [], 0
    for speech in range(40):
        last = "crale"
        paragraphs = [["TOM CRALE (HOST): " + rng.choice(said)]]
        turn = [(speech, 0, 1, "crale")]
        for p in range(1, 14):
            parts, begun = [], 0
            for _ in range(rng.choice([1, 1, 1, 2])):
                who = rng.choice([*forms, None])
                if who is None or parts and who == last:
                    parts.append(rng.choice(said) + rng.choice(["", " (Laughter.)", " [pause]"]))
                    continue
                if who != last:
                    begun += 1
                    turn.append((speech, p, begun, who))
                    last = who
                parts.append(f"{rng.choice(forms[who])} {rng.choice(said)}")
            paragraphs.append(parts)
            if rng.random() < 0.2:
                paragraphs[-1].append(rng.choice(["(Applause.)", "Mm-hmm."]))
        want += turn
        for p, parts in enumerate(paragraphs):
            rows.append((row, speech, "Interview", "Ann B. Fox-Hill", "\n".join(parts), p, "x"))
            row += 1
    got = turns.speaker_turns(spark.createDataFrame(rows, TURNS)).where("turn_in_paragraph is not null").collect()
    floors([(r.speech_id, r.paragraph, r.turn_in_paragraph, r.speaker) for r in got], want, 0.97, 0.97)


def test_garbled_texts_among_right_ones():
    rng = random.Random(12)
    right = ["“Don’t stop,” wrote Señor Müller — résumé in hand.", "Мы не отступим, сказал он, однако надежда жива.", "Ο λαός κουράστηκε, αλλά η ελπίδα ζει.", "نحن بحاجة إلى السلام اليوم", "我们需要和平，也需要学校。", "L’État, déjà à l’œuvre, n’a pas cédé.", "¿Quién defenderá la nación mañana?"]
    ways = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("cp1251", "latin-1"), ("iso8859-7", "latin-1"), ("iso8859-6", "latin-1"), ("koi8-r", "cp1251")]
    found, garbled, restored, n = [], [], 0, 0
    for i in range(200):
        text = " ".join(rng.choice(right) for _ in range(1))
        if i % 2:
            able = []
            for a, b in ways:
                try:
                    bad = text.encode(a).decode(b)
                except UnicodeError:
                    continue
                if bad != text:
                    able.append(bad)
            if not able:
                continue
            bad = rng.choice(able)
            garbled.append(i)
        else:
            bad = text
        got, flag = encoding.repair(bad)
        if flag:
            found.append(i)
        n += i % 2
        restored += (i % 2) and got == text
    floors(found, garbled, 0.97, 0.99)
    assert restored >= 0.85 * n


def test_every_query_has_a_stable_schema(spark, small):
    """Names and types of the queries that the driver compares."""
    want = {
        "p1_found": "field string, term string, mark string", "p2_found": "speech_id bigint, subject string", "p3_found": "src_table string, row_id bigint", "p4_found": "src_table string, row_id bigint, end_pos int",
        "p5_found": "speech_id bigint, paragraph int, turn_in_paragraph int, speaker string", "p6_ids": "doc_id bigint, ids array<int>", "p7_found": "doc_id bigint, item_id bigint", "p8_found": "doc_id bigint, kind string",
    }
    for name in ("p3_found", "p6_ids", "p7_found", "p5_found"):
        assert ", ".join(f"{c} {t}" for c, t in queries.queries()[name](spark, small).dtypes) == want[name]
