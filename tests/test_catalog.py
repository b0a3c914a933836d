import pytest

from rostrum import catalog
from tests.compare import duck_rows, rows_of


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    assert rows_of(catalog.queries()[name](spark, small)) == duck_rows(catalog.oracle_sql()[name], small)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - {"m03_lda", "m06_nmf_per_speech"}))
def test_query_without_sql_gives_rows(spark, small, name):
    assert catalog.queries()[name](spark, small).count() > 0


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_plans_push_filters_and_stay_in_the_jvm(spark, small):
    plan = catalog.queries()["s05_filter_sort"](spark, small)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(pos), EqualTo(pos,MD)]" in plan
    assert "ReadSchema: struct<pos:string,lemma:string,year:int>" in plan.replace("struct<lemma:string,pos:string", "struct<pos:string,lemma:string")
    for name in ("a05_category_freq", "d01_word_table", "m01_tfidf", "a18_president_stats_intent"):
        assert "EvalPython" not in catalog.queries()[name](spark, small)._jdf.queryExecution().toString()
