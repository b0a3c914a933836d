"""What the sentence model learns, on small corpora made for one question each."""

from rostrum.llm import sentences


def learned(spark, texts):
    return sentences.learn(spark.createDataFrame([(t,) for t in texts], "text string"))


PLAIN = ["The mayor spoke to the people of the town.", "We have to mend the road! The people know that it is bad.", "Is it so? We know that this is not the end of it."]


def test_a_name_that_opens_two_blocks_is_no_starter(spark):
    texts = PLAIN * 40 + ["Brisk spoke to the people.", "Brisk was not at the mill."] + ["The mill of old St. Brisk is shut and Brisk of the bay was there with Brisk of the hill."] * 30
    model = learned(spark, texts)
    assert "Brisk" not in model.starters["en"] and {"The", "We"} <= model.starters["en"] and "st" in model.abbreviations["en"]
    text = "We saw the mill of St. Brisk in the fog. The road was bad."
    assert [text[:e][-4:] for e in sentences.sentence_ends(text, model)] == ["fog.", "bad."]


def test_a_collocation_vetoes_the_cut_before_a_starter(spark):
    texts = PLAIN * 40 + ["John spoke to the people of the town."] * 60
    texts += ["The mill of St. John is shut and we saw John of the bay with John of the hill and John of the mill by John and John."] * 30
    model = learned(spark, texts + ["The mill of St. Brisk is shut.", "The bell of St. Ann is old."] * 15)
    assert "John" in model.starters["en"] and ("st", "John") in model.collocations["en"]
    assert len(sentences.sentence_ends("We saw the mill of St. John in the fog.", model)) == 1


def test_the_whole_text_tells_the_language():
    assert sentences.language("We have the letter of the people.\n" * 700 + "Die Stadt ist nicht für das Dorf und der Weg ist nicht von uns.\n" * 2000) == "de"


def test_a_rare_abbreviation_is_learned_in_a_large_corpus(spark):
    model = learned(spark, ["The dog ran. " * 1000] * 220 + ["The men saw vb. seven of them.", "The men saw vb. nine of them."])
    assert model.abbreviations["en"] == {"vb"}
