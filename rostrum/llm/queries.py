"""The registered queries over the corpus tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm import abuse, encoding, leaks, sentences, subjects, terms, tokens, turns
from rostrum.plans.session import table


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_frequency(table(spark, sf_dir, "presidents_words"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_terms(spark, sf_dir).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p2_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subject_areas(*(table(spark, sf_dir, t) for t in ("speeches", "speech_labels", "subject_areas")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_subjects(spark, sf_dir).select("speech_id", "subject")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of both tables; those of speeches with their medium."""
    speeches = table(spark, sf_dir, "speeches").select(F.lit("speeches").alias("src_table"), "row_id", "text", "medium")
    inaugural = table(spark, sf_dir, "inaug_speeches").select(F.lit("inaug_speeches").alias("src_table"), "row_id", "text", F.lit("text").alias("medium"))
    return speeches.unionByName(inaugural)


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir).select(F.struct("src_table", "row_id").alias("key"), "text")
    found = encoding.find_garbled(rows, "key")
    return found.select("key.src_table", "key.row_id", "restored", "is_whole", "by_search")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_restored(spark, sf_dir).select("src_table", "row_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir).where("medium = 'text'")
    return sentences.split_sentences(rows, sentences.learn(rows), ["src_table", "row_id"])


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.speaker_turns(table(spark, sf_dir, "speeches").where("medium = 'transcript'"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).where("turn_in_paragraph is not null").select("speech_id", "paragraph", "turn_in_paragraph", "speaker")


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_spans(spark, sf_dir).select("doc_id", "item_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.content_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).where("flagged").select("doc_id", "kind")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(p8_scores(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


_TERM = "lower(nfc_normalize(trim(replace(replace({f}, chr(8203), ''), chr(8217), ''''), ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288))))"
P1 = (
    "WITH rows AS (SELECT DISTINCT batch_file, row_idx, speech_id, word, lemma, pos FROM presidents_words), values_ AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS field, {_TERM.format(f=f)} AS term, speech_id FROM rows WHERE {f} IS NOT NULL" for f in ("word", "lemma", "pos"))
    + "), counts AS (SELECT field, term, count(*) AS n_occurrences, count(DISTINCT speech_id) AS n_groups FROM values_ WHERE term <> '' GROUP BY field, term), "
    "total AS (SELECT count(DISTINCT speech_id) AS n FROM presidents_words), marked AS (SELECT field, term, n_occurrences, n_groups, "
    "CASE WHEN n_groups > 0.5 * n THEN 'common' WHEN n_groups = 1 THEN 'rare' END AS mark FROM counts, total) "
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_terms": p1_terms, "p1_found": p1_found, "p2_subjects": p2_subjects, "p2_found": p2_found, "p3_restored": p3_restored, "p3_found": p3_found, "p4_found": p4_found,
        "p5_pieces": p5_pieces, "p5_found": p5_found, "p6_ids": p6_ids, "p7_spans": p7_spans, "p7_found": p7_found,
        "p8_scores": p8_scores, "p8_found": p8_found, "p8_rates": p8_rates,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_terms": P1 + "SELECT * FROM marked",
        "p1_found": P1 + "SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
    }
