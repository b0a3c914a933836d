from rostrum import catalog


def test_topics_of_a_president_have_ten_words(spark, small):
    assert max(len(r.words.split()) for r in catalog.queries()["m04_nmf_per_president"](spark, small).select("words").collect()) == 10
