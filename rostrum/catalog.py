"""The registered queries of the core operators and the SQL they are compared with.

Names begin with the operators' identifiers; every query runs over its whole tables. Doubles are rounded to six
places on both sides, as sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import embed, frequency, rows, stats, topics, words
from rostrum.operators.lexicon import DETERMINERS, GENDER, MODALS, PRONOUNS, STOP_WORDS, URGENCY, stop_words
from rostrum.plans.session import shared_path, table
from rostrum.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(column: str, name: str | None = None):
    return F.round(column, 6).alias(name or column)


def _in(words_: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words_) + ")"


def _case(column: str, groups: dict[str, list[str]]) -> str:
    return "CASE " + " ".join(f"WHEN {column} IN {_in(ws)} THEN '{name}'" for name, ws in groups.items()) + " ELSE 'n/a' END"


def _frequency_sql(tags: list[str], groups: dict[str, list[str]], mode: str) -> str:
    lemmas = f"SELECT lemma, pos FROM counts WHERE pos IN {_in(tags)} GROUP BY lemma, pos" if mode == "reference" else f"SELECT DISTINCT lemma, '' AS pos FROM counts WHERE pos IN {_in(tags)}"
    amounts = "SELECT year, lemma, arg_min(n, pos) AS n FROM counts GROUP BY year, lemma" if mode == "reference" else f"SELECT year, lemma, sum(n) AS n FROM counts WHERE pos IN {_in(tags)} GROUP BY year, lemma"
    return (
        "WITH counts AS (SELECT year, lemma, pos, count(*) AS n FROM presidents_words WHERE year IS NOT NULL AND lemma IS NOT NULL AND pos IS NOT NULL GROUP BY 1, 2, 3), "
        "totals AS (SELECT year, count(pos) AS total FROM presidents_words WHERE year IS NOT NULL GROUP BY year), "
        f"lemmas AS ({lemmas}), amounts AS ({amounts}), freq AS (SELECT t.year, l.lemma AS word, coalesce(CAST(a.n AS DOUBLE) / nullif(t.total, 0), 0.0) AS freq, {_case('l.lemma', groups)} AS category "
        "FROM totals t CROSS JOIN lemmas l LEFT JOIN amounts a ON a.year = t.year AND a.lemma = l.lemma) "
    )


def _frequency(tags: list[str], groups: dict[str, list[str]], mode: str) -> Query:
    return lambda spark, d: frequency.category_frequency(table(spark, d, "presidents_words"), tags, groups, mode)


for _name, _tags, _groups in (
    ("a05_category_freq", ["MD"], MODALS), ("a06_pronoun_freq", ["PRP", "PRP$"], PRONOUNS), ("a07_gender_freq", ["PRP", "PRP$"], GENDER), ("a07_determiner_freq", ["DT"], DETERMINERS),
):
    for _mode in ("intent", "reference"):
        _full = _name if _mode == "intent" else f"{_name}_reference"
        query(_full, _frequency_sql(_tags, _groups, _mode) + "SELECT year, word, round(freq, 6) AS freq, category FROM freq")(
            lambda spark, d, q=_frequency(_tags, _groups, _mode): q(spark, d).select("year", "word", _r("freq"), "category")
        )
for _name, _how, _mode, _agg in (("a08_plot_mean", "mean", "intent", "avg"), ("a09_plot_sum", "sum", "intent", "sum"), ("a09_plot_sum_reference", "sum", "reference", "sum")):
    query(_name, _frequency_sql(["PRP", "PRP$"], PRONOUNS, _mode) + f"SELECT year, category, round({_agg}(freq), 6) AS value FROM freq WHERE category <> 'n/a' GROUP BY year, category")(
        lambda spark, d, how=_how, q=_frequency(["PRP", "PRP$"], PRONOUNS, _mode): frequency.by_category(q(spark, d), how).select("year", "category", _r("value"))
    )

_MODAL_LIST = [w for ws in MODALS.values() for w in ws]


@query(
    "a10_pivot_counts",
    "SELECT year, " + ", ".join(f'count(*) FILTER (WHERE lower(lemma) = \'{w}\') AS "{w}"' for w in _MODAL_LIST) + " FROM presidents_words WHERE pos = 'MD' AND lower(lemma) IN "
    + _in(_MODAL_LIST) + " GROUP BY year",
)
def a10(spark, d):
    modal = table(spark, d, "presidents_words").where("pos = 'MD'").select("year", F.lower("lemma").alias("lemma")).where(F.col("lemma").isin(_MODAL_LIST))
    return frequency.pivot_counts(modal, "year", "lemma", _MODAL_LIST)


@query("a10_pivot_events", "SELECT CAST(ts AS DATE) AS day, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{e}') AS {e}" for e in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def a10_events(spark, d):
    events = table(spark, d, "events").select(F.to_date("ts").alias("day"), "event_type")
    return frequency.pivot_counts(events, "day", "event_type", ["click", "error", "purchase", "signup", "view"])


def _urgency_sql() -> str:
    parts = []
    for name, pairs in URGENCY.items():
        cond = " OR ".join(f"(pos = '{t}' AND lower(word) = '{w}')" for t, w in pairs)
        parts.append(f"count(*) FILTER (WHERE {cond}) AS {name}")
    return f"SELECT president, {', '.join(parts)}, count(*) AS n_words FROM presidents_words GROUP BY president"


@query("a11_urgency", _urgency_sql())
def a11(spark, d):
    return frequency.urgency(table(spark, d, "presidents_words"))


@query(
    "a12_first_seen",
    "SELECT president, first, row_number() OVER (ORDER BY first, president) AS place FROM (SELECT president, min(row_id) AS first FROM speeches WHERE president IS NOT NULL GROUP BY president)",
)
def a12(spark, d):
    found = frequency.first_seen(table(spark, d, "speeches"), "president", "row_id")
    return found.select("president", "first", F.col("place").cast("long").alias("place"))


@query("a13_unique_values", "SELECT DISTINCT pos, upper(trim(pos)) AS tag, lower(lemma) AS lemma FROM presidents_words WHERE upper(trim(pos)) IN ('MD', 'DT', 'WP', 'WP$')")
def a13(spark, d):
    w = table(spark, d, "presidents_words").select("pos", F.upper(F.trim("pos")).alias("tag"), F.lower("lemma").alias("lemma"))
    return w.where(F.col("tag").isin("MD", "DT", "WP", "WP$")).distinct()


@query("a14_distinct_pairs", "SELECT (SELECT count(*) FROM (SELECT DISTINCT word, pos FROM presidents_words)) AS word_pos, (SELECT count(*) FROM (SELECT DISTINCT lemma, pos FROM presidents_words)) AS lemma_pos")
def a14(spark, d):
    w = table(spark, d, "presidents_words")
    pairs = w.select("lemma", "pos").distinct().agg(F.count(F.lit(1)).alias("lemma_pos"))
    return w.select("word", "pos").distinct().agg(F.count(F.lit(1)).alias("word_pos")).withColumn("lemma_pos", pairs.scalar())


_JOINED = (
    "joined AS (SELECT president, speech_title, string_agg({t}, '{s}' ORDER BY paragraph, row_id) AS text FROM speeches WHERE president IS NOT NULL AND speech_title IS NOT NULL "
    "{debate} GROUP BY president, speech_title)"
)


@query("a15_join_paragraphs", "WITH " + _JOINED.format(t="text", s="", debate="AND text IS NOT NULL") + " SELECT * FROM joined")
def a15(spark, d):
    return stats.joined_speeches(table(spark, d, "speeches"))


@query("a16_vocab_size", "SELECT lang, count(DISTINCT token) AS vocab FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS token FROM documents) GROUP BY lang")
def a16(spark, d):
    tokens = table(spark, d, "documents").select("lang", F.explode(T.vector_tokens(F.col("text"))).alias("token"))
    return tokens.groupBy("lang").agg(F.count_distinct("token").alias("vocab"))


@query("a17_word_count", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS BIGINT) AS words FROM documents WHERE text IS NOT NULL")
def a17(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"))


def _stats_sql(mode: str) -> str:
    t = "coalesce(text, 'nan')" if mode == "reference" else "text"
    sep = "" if mode == "reference" else "\n"
    where = "AND NOT contains(speech_title, 'Debate')" + ("" if mode == "reference" else " AND text IS NOT NULL")
    tok = "[\\p{L}\\p{N}_]{2,}"
    return (
        f"WITH parts AS (SELECT president, speech_title, row_id, {t} AS t FROM speeches WHERE president IS NOT NULL AND speech_title IS NOT NULL {where}), "
        + _JOINED.format(t=t, s=sep, debate=where)
        + f", vocab AS (SELECT president, speech_title, count(DISTINCT token) AS vocab FROM (SELECT president, speech_title, unnest(regexp_extract_all(lower(t), '{tok}')) AS token FROM parts) GROUP BY 1, 2), "
        "per AS (SELECT j.president, avg(coalesce(v.vocab, 0)) AS avg_vocab, avg(len(regexp_extract_all(j.text, '[\\p{L}\\p{N}_]+'))) AS avg_words, CAST(sum(len(regexp_extract_all(j.text, '[\\p{L}\\p{N}_]+'))) AS BIGINT) AS total_words, "
        "count(*) AS total_speeches FROM joined j LEFT JOIN vocab v USING (president, speech_title) GROUP BY j.president), "
        f"total AS (SELECT president, count(DISTINCT token) AS total_vocab FROM (SELECT president, unnest(regexp_extract_all(lower(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')), '{tok}')) AS token FROM joined) GROUP BY president), "
        "first AS (SELECT president, min(row_id) AS first FROM parts GROUP BY president) "
        "SELECT CAST(45 - row_number() OVER (ORDER BY f.first) AS BIGINT) AS president_num, p.president, round(avg_vocab, 6) AS avg_vocab, round(avg_words, 6) AS avg_words, coalesce(total_vocab, 0) AS total_vocab, total_words, total_speeches "
        "FROM per p JOIN first f USING (president) LEFT JOIN total USING (president)"
    )


for _mode in ("intent", "reference"):
    query(f"a18_president_stats_{_mode}", _stats_sql(_mode))(
        lambda spark, d, mode=_mode: stats.president_stats(table(spark, d, "speeches"), mode).select(
            F.col("president_num").cast("long").alias("president_num"), "president", _r("avg_vocab"), _r("avg_words"), "total_vocab", "total_words", "total_speeches"
        )
    )


def _reactions_sql(mode: str) -> str:
    sep = "" if mode == "reference" else "\n"
    if mode == "reference":
        count = lambda kind: f"CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x IN {_in(stats._MARKERS[kind])})) AS BIGINT)"
    else:
        count = lambda kind: f"CAST(sum(len(regexp_extract_all(text, '(?i)\\((?:[^()]* )?{kind}\\b[^()]*\\)'))) AS BIGINT)"
        return f"SELECT president, speech_title, {count('applause')} AS applause, {count('laughter')} AS laughter FROM speeches WHERE president IS NOT NULL AND text IS NOT NULL AND NOT contains(speech_title, 'Debate') GROUP BY 1, 2"
    return "WITH " + _JOINED.format(t="text", s=sep, debate="AND text IS NOT NULL AND NOT contains(speech_title, 'Debate')") + f" SELECT president, speech_title, {count('applause')} AS applause, {count('laughter')} AS laughter FROM joined"


for _mode in ("intent", "reference"):
    query(f"a21_reactions_{_mode}", _reactions_sql(_mode))(
        lambda spark, d, mode=_mode: stats.crowd_reactions(table(spark, d, "speeches"), mode).select("president", "speech_title", F.col("applause").cast("long").alias("applause"), F.col("laughter").cast("long").alias("laughter"))
    )

_TF = "tf AS (SELECT {k}, term, count(*) AS tf FROM (SELECT {k}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {t} WHERE {k} IS NOT NULL) {w} GROUP BY 1, 2)"


@query(
    "a22_term_frequency",
    "WITH " + _TF.format(k="source", t="documents", w="") + ", total AS (SELECT source, sum(tf) AS total FROM tf GROUP BY source) SELECT source, term, round(tf / total, 6) AS freq FROM tf JOIN total USING (source)",
)
def a22(spark, d):
    return topics.relative_frequency(table(spark, d, "documents"), "source", "text").select("source", "term", _r("freq"))


@query(
    "a24_top_terms",
    "WITH " + _TF.format(k="source", t="documents", w="") + ", total AS (SELECT source, sum(tf) AS total FROM tf GROUP BY source), freq AS (SELECT term, sum(tf / total) AS f FROM tf JOIN total USING (source) GROUP BY term) "
    "SELECT term, round(f, 6) AS total FROM freq ORDER BY round(f, 9) DESC, term LIMIT 150",
)
def a24(spark, d):
    freq = topics.relative_frequency(table(spark, d, "documents"), "source", "text").groupBy("term").agg(F.sum("freq").alias("f"))
    return freq.orderBy(F.desc(F.round("f", 9)), "term").limit(150).select("term", _r("f", "total"))


def _topic_weights(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as a document-topic table: all coordinates without their signs; the label is the president's number."""
    e = table(spark, d, "embeddings").select((F.col("label") + 1).alias("president_num"), "vec_id", F.posexplode("embedding").alias("topic_idx", "weight"))
    labels = table(spark, d, "topic_labels").select("president_num", "president")
    e = e.join(F.broadcast(labels), "president_num")
    return e.select("president", "vec_id", "topic_idx", F.abs(F.col("weight").cast("double")).alias("weight"))


_WEIGHTS_SQL = (
    "weights AS (SELECT president, vec_id, i AS topic_idx, abs(CAST(embedding[i + 1] AS DOUBLE)) AS weight FROM embeddings JOIN topic_labels ON president_num = label + 1, range(10000) AS r(i) WHERE i < len(embedding)), "
    "labels AS (SELECT president, i AS topic_idx, topics_list[i + 1] AS topics FROM topic_labels, range(50) AS r(i) WHERE i < len(topics_list) AND topics_list[i + 1] IS NOT NULL), "
    "named AS (SELECT president, topic_idx, len(topics) AS parts, unnest(topics) AS topic FROM labels), "
    "by_doc AS (SELECT president, vec_id, topic, sum(weight / parts) AS w FROM weights JOIN named USING (president, topic_idx) WHERE topic IS NOT NULL AND topic <> 'Unclear Topic' GROUP BY 1, 2, 3) "
)


@query("a25_topic_merge", "WITH " + _WEIGHTS_SQL + "SELECT president, vec_id, topic, round(w, 6) AS w FROM by_doc")
def a25(spark, d):
    labels = topics.topic_labels(table(spark, d, "topic_labels"))
    named = labels.select("president", "topic_idx", F.size("topics").alias("parts"), F.explode("topics").alias("topic")).where("topic is not null and topic <> 'Unclear Topic'")
    merged = _topic_weights(spark, d).join(named, ["president", "topic_idx"]).groupBy("president", "vec_id", "topic").agg(F.sum(F.col("weight") / F.col("parts")).alias("w"))
    return merged.select("president", "vec_id", "topic", _r("w"))


@query(
    "a26_topic_score",
    "WITH " + _WEIGHTS_SQL + ", n AS (SELECT president, count(DISTINCT vec_id) AS n FROM weights GROUP BY president), s AS (SELECT president, topic, sum(w) AS total, count(*) FILTER (WHERE w <> 0) AS covered FROM by_doc GROUP BY 1, 2) "
    "SELECT president, topic, round(total * covered / n, 6) AS score FROM s JOIN n USING (president) WHERE total * covered <> 0",
)
def a26(spark, d):
    found = topics.topic_scores(_topic_weights(spark, d), topics.topic_labels(table(spark, d, "topic_labels")), "president", "vec_id")
    return found.select("president", "topic", _r("score"))


@query("s04_projection", "SELECT word, lemma, pos, president FROM presidents_words")
def s04(spark, d):
    return table(spark, d, "presidents_words").select("word", "lemma", "pos", "president")


@query("s05_filter_sort", "SELECT lemma, year FROM presidents_words WHERE pos = 'MD' ORDER BY year")
def s05(spark, d):
    return table(spark, d, "presidents_words").where("pos = 'MD'").select("lemma", "year").orderBy("year")


@query("s06_cast_group_sum", "SELECT CAST(l_orderkey AS INTEGER) AS orderkey, l_partkey, l_suppkey, l_returnflag, round(sum(l_quantity), 6) AS total FROM lineitem GROUP BY 1, 2, 3, 4 ORDER BY 1")
def s06(spark, d):
    grouped = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("int").alias("orderkey"), "l_partkey", "l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("total"))
    return grouped.select("orderkey", "l_partkey", "l_suppkey", "l_returnflag", _r("total")).orderBy("orderkey")


@query("s02_batch_scan", "SELECT batch_file, lower(word) AS word, count(*) AS n FROM presidents_words GROUP BY 1, 2")
def s02(spark, d):
    return table(spark, d, "presidents_words").groupBy("batch_file", F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("p02_no_debates", "SELECT row_id, speech_title FROM speeches WHERE NOT contains(speech_title, 'Debate')")
def p02(spark, d):
    return stats.no_debates(table(spark, d, "speeches")).select("row_id", "speech_title")


@query("p03_debates", "SELECT DISTINCT president, speech_title FROM speeches WHERE contains(speech_title, 'Debate')")
def p03(spark, d):
    return table(spark, d, "speeches").where(F.contains("speech_title", F.lit("Debate"))).select("president", "speech_title").distinct()


@query("p05_prefix_groups", "SELECT upper(left(trim(pos), 1)) AS prefix, count(*) AS n, count(DISTINCT lower(lemma)) AS lemmas FROM presidents_words WHERE upper(left(trim(pos), 1)) IN ('R', 'J', 'N', 'V') GROUP BY 1")
def p05(spark, d):
    w = table(spark, d, "presidents_words").select(F.upper(F.left(F.trim("pos"), F.lit(1))).alias("prefix"), F.lower("lemma").alias("lemma")).where(F.col("prefix").isin("R", "J", "N", "V"))
    return w.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lemma").alias("lemmas"))


@query("p06_group_counts", "SELECT pos, count(*) AS n, count(DISTINCT lemma) AS lemmas FROM presidents_words WHERE pos IS NOT NULL GROUP BY pos")
def p06(spark, d):
    return frequency.tag_groups(table(spark, d, "presidents_words"))


@query("p08_dropna", "SELECT row_id FROM speeches WHERE date IS NOT NULL AND speech_title IS NOT NULL AND text IS NOT NULL")
def p08(spark, d):
    return table(spark, d, "speeches").select("row_id", "date", "speech_title", "text").na.drop("any").select("row_id")


@query("p09_no_signs", "SELECT pos, count(*) AS n FROM presidents_words WHERE pos NOT IN ('''''', '$') GROUP BY pos")
def p09(spark, d):
    return table(spark, d, "presidents_words").where(~F.col("pos").isin("''", "$")).groupBy("pos").agg(F.count(F.lit(1)).alias("n"))


@query("p10_punctuation", "SELECT word, count(*) AS n FROM presidents_words WHERE NOT contains('" + T.PUNCTUATION.replace("'", "''") + "', word) GROUP BY word")
def p10(spark, d):
    return table(spark, d, "presidents_words").where(~T.is_punctuation(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("p11_row_range", "SELECT row_id, paragraph FROM speeches ORDER BY row_id LIMIT 100 OFFSET 50")
def p11(spark, d):
    return rows.row_range(table(spark, d, "speeches"), ["row_id"], 50, 150).select("row_id", "paragraph")


@query("p22_patch_cell", "SELECT row_id, CASE WHEN row_id = 7 THEN 'patched' ELSE text END AS text FROM speeches")
def p22(spark, d):
    return rows.patch(table(spark, d, "speeches"), F.col("row_id") == 7, "text", F.lit("patched")).select("row_id", "text")


@query("p24_drop_last", "SELECT s.speech_id, row_id, s.paragraph FROM speeches s JOIN (SELECT speech_id, max(paragraph) AS last FROM speeches GROUP BY speech_id) m ON m.speech_id = s.speech_id WHERE s.paragraph <> last")
def p24(spark, d):
    return rows.drop_last(table(spark, d, "speeches"), ["speech_id"], "paragraph").select("speech_id", "row_id", "paragraph")


@query("w01_ordinal", "SELECT row_id, CAST(row_number() OVER (PARTITION BY speech_id ORDER BY paragraph, row_id) - 1 AS BIGINT) AS ordinal FROM speeches")
def w01(spark, d):
    return rows.ordinal(table(spark, d, "speeches"), ["speech_id"], ["paragraph", "row_id"]).select("row_id", F.col("ordinal").cast("long").alias("ordinal"))


@query("w05_share", "SELECT year, lemma, round(n / sum(n) OVER (PARTITION BY year), 6) AS share FROM (SELECT year, lemma, count(*) AS n FROM presidents_words GROUP BY 1, 2)")
def w05(spark, d):
    counts = table(spark, d, "presidents_words").groupBy("year", "lemma").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(F.col("year").alias("y")).agg(F.sum("n").alias("total"))
    return counts.join(totals, F.col("year").eqNullSafe(F.col("y"))).select("year", "lemma", F.round(F.col("n") / F.col("total"), 6).alias("share"))


_F1 = "text"
for _x in T.FILLERS:
    _F1 = f"replace({_F1}, '{_x}', '')"


@query("f01_filler", f"SELECT row_id, {_F1} AS clean FROM speeches")
def f01(spark, d):
    return table(spark, d, "speeches").select("row_id", T.replace_filler(F.col("text"), "reference").alias("clean"))


@query("f03_control_marks", "SELECT row_id, replace(replace(replace(replace(text, '<U+0092>', ' '), '<U+0097>', ' '), '0092', ''), '0097', '') AS clean FROM inaug_speeches")
def f03(spark, d):
    return table(spark, d, "inaug_speeches").select("row_id", T.control_marks(F.col("text")).alias("clean"))


@query("f08_ascii", "SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS clean FROM documents")
def f08(spark, d):
    return table(spark, d, "documents").select("doc_id", T.ascii_only(F.col("text")).alias("clean"))


_SPACE = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_NORMAL = f"trim(regexp_replace(lower(text), '{_SPACE}', ' ', 'g'))"


@query("f07_whitespace", f"SELECT row_id, {_NORMAL} AS clean FROM speeches")
def f07(spark, d):
    return table(spark, d, "speeches").select("row_id", T.normalize_space(F.col("text")).alias("clean"))


def _clean_sql(text: str, stop: list[str]) -> str:
    """What ``clean_document`` does, as an array of words."""
    kept = f"list_filter(regexp_split_to_array(lower({text}), '[\\t-\\r ]+'), lambda w: w <> '' AND w NOT IN {_in(stop)})"
    signs = T.PUNCTUATION.replace("-", "").replace("'", "''")
    bare = f"translate(replace(array_to_string({kept}, ' '), '-', ' '), '{signs}', '')"
    lemma = (
        "CASE WHEN regexp_matches(w, '(ss|us|is)$') THEN w WHEN regexp_matches(w, '[^aeiou]ies$') AND length(w) > 4 THEN regexp_replace(w, 'ies$', 'y') "
        "WHEN regexp_matches(w, '(ch|sh|x|ss|z)es$') THEN regexp_replace(w, 'es$', '') WHEN regexp_matches(w, '[^s]s$') AND length(w) > 3 THEN regexp_replace(w, 's$', '') ELSE w END"
    )
    return f"list_transform(list_filter(regexp_split_to_array({bare}, '[\\t-\\r ]+'), lambda w: w <> ''), lambda w: {lemma})"


@query("f12_sentences", f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS sentence, s[i] AS text FROM (SELECT doc_id, list_filter(string_split(regexp_replace({_NORMAL}, '([.!?][\"''”’)\\]]*) ', '\\1' || chr(10), 'g'), chr(10)), lambda x: len(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}_]+|[^\\s\\p{{L}}\\p{{N}}_]')) > 1) AS s FROM documents WHERE text IS NOT NULL), range(1, 100000) AS r(i) WHERE i <= len(s)")
def f12(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence", "text")).select("doc_id", F.col("sentence").cast("long").alias("sentence"), "text")


@query("f15_clean", f"SELECT doc_id, array_to_string({_clean_sql('text', STOP_WORDS)}, ' ') AS clean FROM documents")
def f15(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean_document(F.col("text"), STOP_WORDS).alias("clean"))


@query("f09_treebank_tokens")
def f09(spark, d):
    return table(spark, d, "speeches").select("row_id", T.treebank_tokens(F.col("text")).alias("tokens"))


@query("f13_sentence_split", "SELECT row_id, CAST(len(string_split(text, '. ')) AS BIGINT) AS parts, string_split(text, '. ')[1] AS first FROM inaug_speeches WHERE text IS NOT NULL")
def f13(spark, d):
    parts = T.split_naive(F.col("text"))
    return table(spark, d, "inaug_speeches").where("text is not null").select("row_id", F.size(parts).cast("long").alias("parts"), F.get(parts, 0).alias("first"))


@query("d06_normalise", "SELECT row_id, CAST(i - 1 AS BIGINT) AS paragraph, lines[i] AS text FROM (SELECT row_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines FROM inaug_speeches), range(1, 100000) AS r(i) WHERE i <= len(lines)")
def d06(spark, d):
    whole = table(spark, d, "inaug_speeches").select("row_id", "text", F.lit(0).alias("paragraph"), F.lit(1).alias("full_document"))
    return rows.normalize_paragraphs(whole).select("row_id", F.col("paragraph").cast("long").alias("paragraph"), "text")


@query("d07_repair", "SELECT row_id, speech_id, paragraph, text FROM speeches WHERE speech_id <> 7 OR speech_id IS NULL UNION ALL SELECT h.row_id, 7, p.i, p.t FROM (SELECT row_id FROM speeches WHERE speech_id = 7 ORDER BY paragraph, row_id LIMIT 1) h, (VALUES (0, 'First.'), (1, 'Second.')) AS p(i, t)")
def d07(spark, d):
    s = table(spark, d, "speeches").select("row_id", "speech_id", "paragraph", "text")
    return rows.replace_speech(s, F.col("speech_id") == 7, ["First.", "Second."])


@query("f19_dates", "SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS date FROM orders")
def f19(spark, d):
    long = F.date_format("o_orderdate", "MMMM d, yyyy")
    return table(spark, d, "orders").select("o_orderkey", T.parse_long_date(long).alias("date"))


@query("f20_year", "SELECT row_id, coalesce(TRY_CAST(right(trim(date), 4) AS INTEGER), TRY_CAST(left(trim(date), 4) AS INTEGER)) AS year FROM speeches")
def f20(spark, d):
    return table(spark, d, "speeches").select("row_id", T.year_of(F.col("date")).alias("year"))


@query("f21_split_once", "SELECT row_id, CASE WHEN contains(text, ': ') THEN left(text, strpos(text, ': ') - 1) ELSE text END AS head, CASE WHEN contains(text, ': ') THEN substr(text, strpos(text, ': ') + 2) END AS tail FROM speeches")
def f21(spark, d):
    parts = F.split(F.col("text"), ": ", 2)
    return table(spark, d, "speeches").select("row_id", F.get(parts, 0).alias("head"), F.get(parts, 1).alias("tail"))


@query("f31_slice_size", "SELECT doc_id, words[1:10] AS first_words, CAST(len(words) AS BIGINT) AS n FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS words FROM documents WHERE text IS NOT NULL)")
def f31(spark, d):
    w = table(spark, d, "documents").where("text is not null").select("doc_id", T.word_tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.slice("w", 1, 10).alias("first_words"), F.size("w").cast("long").alias("n"))


@query("f32_transform", "SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: CAST(length(x) AS BIGINT)) AS lengths FROM documents WHERE text IS NOT NULL")
def f32(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.transform(T.word_tokens(F.col("text")), lambda x: F.length(x).cast("long")).alias("lengths"))


@query("f28_path", "SELECT DISTINCT president, replace(president, ' ', '_') AS path, length(president) AS size, president || '.v.01' AS sense FROM topic_labels")
def f28(spark, d):
    p = F.col("president")
    return table(spark, d, "topic_labels").select(p, F.replace(p, F.lit(" "), F.lit("_")).alias("path"), F.length(p).cast("long").alias("size"), F.concat(p, F.lit(".v.01")).alias("sense")).distinct()


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "inaug_speeches")
    return a.select("row_id", T.year_of(F.col("date")).alias("year"), T.remove_literals(F.col("text"), ["0092", "0097"]).alias("text"), F.col("text").alias("raw"))


@query("m15_year_topics")
def m15(spark, d):
    return topics.single_topics(_addresses(spark, d), "row_id", "text", 5, STOP_WORDS).join(_addresses(spark, d).select("row_id", "year"), "row_id")


_M15_TF = "SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(regexp_extract_all(lower(replace(replace(text, '0092', ''), '0097', '')), '[\\p{L}\\p{N}_]{2,}')) AS term FROM inaug_speeches) WHERE term NOT IN " + _in(STOP_WORDS) + " GROUP BY 1, 2"


@query("m15_frequent_terms", f"SELECT row_id, array_agg(term ORDER BY rank) AS terms FROM (SELECT row_id, term, row_number() OVER (PARTITION BY row_id ORDER BY tf DESC, term) AS rank FROM ({_M15_TF})) WHERE rank <= 5 GROUP BY row_id")
def m15_terms(spark, d):
    return m15(spark, d).select("row_id", F.col("lda_terms").alias("terms"))


@query("f33_map")
def f33(spark, d):
    """Year -> the words of both models of its last address, as a dictionary that is updated row by row would hold."""
    last = m15(spark, d).where("year is not null").groupBy("year").agg(F.max_by(F.array("nmf_terms", "lda_terms"), "row_id").alias("terms"))
    return last.groupBy(F.floor(F.col("year") / 10).cast("int").alias("decade")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "terms")))).alias("years"))


@query(
    "f33_map_entries",
    "WITH tf AS (SELECT president, paragraph, count(*) AS n FROM speeches WHERE president IS NOT NULL AND paragraph < 5 GROUP BY 1, 2) SELECT president, array_agg(paragraph || ':' || n ORDER BY paragraph) AS entries FROM tf GROUP BY president",
)
def f33_entries(spark, d):
    counts = table(spark, d, "speeches").where("president is not null and paragraph < 5").groupBy("president", "paragraph").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("president").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("paragraph", "n")))).alias("m"))
    return maps.select("president", F.transform(F.map_entries("m"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))).alias("entries"))


_M16 = (
    f"WITH docs AS (SELECT coalesce(TRY_CAST(right(trim(date), 4) AS INTEGER), TRY_CAST(left(trim(date), 4) AS INTEGER)) AS year, {_clean_sql("replace(replace(text, '<U+0092>', ' '), '<U+0097>', ' ')", STOP_WORDS)} AS w FROM inaug_speeches), "
    "words AS (SELECT year, len(w) AS n, unnest(w) AS term FROM docs WHERE year IS NOT NULL AND len(w) > 0), freq AS (SELECT term, year, sum(1.0 / n) AS freq FROM words GROUP BY 1, 2), total AS (SELECT term, sum(freq) AS total FROM freq GROUP BY term) "
)


def _term_years(spark: SparkSession, d: str) -> DataFrame:
    docs = _addresses(spark, d).withColumn("raw", F.replace(F.replace("raw", F.lit("<U+0092>"), F.lit(" ")), F.lit("<U+0097>"), F.lit(" ")))
    return topics.term_periods(docs, "year", "raw", STOP_WORDS)


@query("m16_term_year", _M16 + "SELECT term, year, round(freq, 6) AS freq, round(total, 6) AS total FROM freq JOIN total USING (term)")
def m16(spark, d):
    return _term_years(spark, d).select("term", "year", _r("freq"), _r("total"))


@query("o03_top_terms_by_year", _M16 + ", top AS (SELECT term FROM total ORDER BY round(total, 9) DESC, term LIMIT 150) SELECT term, array_agg(year || ':' || CAST(round(freq, 6) AS DECIMAL(12, 6)) ORDER BY year DESC) AS years FROM freq JOIN top USING (term) GROUP BY term")
def o03(spark, d):
    """The 150 terms of the highest totals with their years, the latest first."""
    freq = _term_years(spark, d)
    top = freq.select("term", "total").distinct().orderBy(F.desc(F.round("total", 9)), "term").limit(150)
    entry = F.concat(F.col("year").cast("string"), F.lit(":"), F.round("freq", 6).cast("decimal(12,6)").cast("string"))
    years = F.reverse(F.array_sort(F.collect_list(F.struct("year", entry.alias("e")))))
    return freq.join(F.broadcast(top.select("term")), "term").groupBy("term").agg(years.alias("y")).select("term", F.col("y.e").alias("years"))


@query("u01_union", "SELECT row_id, date, speech_title, text FROM speeches UNION ALL SELECT row_id, date, NULL, text FROM inaug_speeches")
def u01(spark, d):
    frames = [table(spark, d, "speeches").select("row_id", "date", "speech_title", "text"), table(spark, d, "inaug_speeches").select("row_id", "date", "text")]
    return rows.union_all(frames)


@query("u03_array_union", "SELECT DISTINCT lemma FROM presidents_words WHERE pos = 'PRP' UNION ALL SELECT DISTINCT lemma FROM presidents_words WHERE pos = 'PRP$'")
def u03(spark, d):
    w = table(spark, d, "presidents_words").select("lemma", "pos")
    return w.where("pos = 'PRP'").select("lemma").distinct().unionAll(w.where(F.col("pos") == "PRP$").select("lemma").distinct())


_STOPPED = f"WHERE term NOT IN {_in(STOP_WORDS)}"


@query("j06_stopword_anti", "WITH " + _TF.format(k="source", t="documents", w=_STOPPED) + " SELECT source, term, tf FROM tf")
def j06(spark, d):
    return topics.term_counts(table(spark, d, "documents"), "source", "text", STOP_WORDS)


@query("j06_transcript_stopwords", "WITH " + _TF.format(k="source", t="documents", w=f"WHERE term NOT IN {_in(stop_words(mode='reference'))}") + " SELECT source, term, tf FROM tf")
def j06_custom(spark, d):
    return topics.term_counts(table(spark, d, "documents"), "source", "text", stop_words(mode="reference"))


@query("m02_counts", "WITH " + _TF.format(k="speech_id", t="speeches", w="") + " SELECT speech_id, term, tf FROM tf")
def m02(spark, d):
    return topics.term_counts(table(spark, d, "speeches"), "speech_id", "text")


_TFIDF = (
    "WITH " + _TF.format(k="president", t="speeches", w=_STOPPED) + ", n AS (SELECT count(DISTINCT president) AS n FROM speeches), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
    "w AS (SELECT president, term, tf, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n), norms AS (SELECT president, sqrt(sum(w * w)) AS norm FROM w GROUP BY president), "
    "weighed AS (SELECT president, term, tf, w / norm AS tfidf FROM w JOIN norms USING (president)) "
)


@query("m01_tfidf", _TFIDF + "SELECT president, term, tf, round(tfidf, 6) AS tfidf FROM weighed")
def m01(spark, d):
    return topics.tfidf(table(spark, d, "speeches"), "president", "text", STOP_WORDS).select("president", "term", "tf", _r("tfidf"))


@query("w04_top_terms", _TFIDF + "SELECT president, term, CAST(rank AS BIGINT) AS rank FROM (SELECT president, term, row_number() OVER (PARTITION BY president ORDER BY round(tfidf, 9) DESC, term) AS rank FROM weighed) WHERE rank <= 10")
def w04(spark, d):
    weights = topics.tfidf(table(spark, d, "speeches"), "president", "text", STOP_WORDS).withColumn("tfidf", F.round("tfidf", 9))
    return topics.top_terms(weights, "president", "tfidf", 10).select("president", "term", F.col("rank").cast("long").alias("rank"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Speeches written as the pages a scraper would find."""
    s = table(spark, d, "speeches").where("speech_id is not null and text is not null")
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    parts = F.array_sort(F.collect_list(F.struct("paragraph", "row_id", F.concat(F.lit("<p>"), escaped, F.lit("</p>")).alias("p"))))
    page = s.groupBy("speech_id").agg(F.min("president").alias("president"), F.array_join(F.transform(parts, lambda x: x["p"]), "\n").alias("body"))
    html = F.concat(F.lit("<html><script>var x = '</p>';</script><p class='president-name'>"), "president", F.lit("</p><div class='view-transcript'>"), "body", F.lit("</div></html>"))
    return page.select(F.col("speech_id").alias("page_id"), html.alias("html"))


@query(
    "s08_html_paragraphs",
    "SELECT speech_id AS page_id, CAST(row_number() OVER (PARTITION BY speech_id ORDER BY paragraph, row_id) - 1 AS BIGINT) AS paragraph, text, CAST(CASE WHEN count(*) OVER (PARTITION BY speech_id) = 1 THEN 1 ELSE 0 END AS BIGINT) AS full_document "
    "FROM speeches WHERE speech_id IS NOT NULL AND text IS NOT NULL",
)
def s08(spark, d):
    found = readers.html_paragraphs(_pages(spark, d))
    return found.select("page_id", F.col("paragraph").cast("long").alias("paragraph"), "text", F.col("full_document").cast("long").alias("full_document"))


def _page_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The pages with their text in either container or, every third, in none."""
    kind = F.col("page_id") % 3
    html = F.when(kind == 0, F.replace("html", F.lit("view-transcript"), F.lit("expandable-text-container"))).when(kind == 1, F.col("html")).otherwise(F.replace("html", F.lit("view-transcript"), F.lit("other")))
    return _pages(spark, d).withColumn("html", html)


@query(
    "s10_page_kinds",
    "WITH s AS (SELECT speech_id AS page_id, text, paragraph, row_id FROM speeches WHERE speech_id IS NOT NULL AND text IS NOT NULL), heads AS (SELECT speech_id AS page_id, min(president) AS president FROM speeches WHERE speech_id IS NOT NULL AND text IS NOT NULL GROUP BY 1), "
    "found AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY paragraph, row_id) - 1 AS BIGINT) AS paragraph, text, CAST(CASE WHEN count(*) OVER (PARTITION BY page_id) = 1 THEN 1 ELSE 0 END AS BIGINT) AS full_document FROM s WHERE page_id % 3 <> 2 "
    "UNION ALL SELECT DISTINCT page_id, CAST(NULL AS BIGINT), NULL, CAST(2 AS BIGINT) FROM s WHERE page_id % 3 = 2) SELECT page_id, trim(president) AS president, paragraph, text, full_document FROM found JOIN heads USING (page_id)",
)
def s10(spark, d):
    found = readers.html_paragraphs(_page_kinds(spark, d))
    return found.select("page_id", "president", F.col("paragraph").cast("long").alias("paragraph"), "text", F.col("full_document").cast("long").alias("full_document"))


@query("s08_links", "SELECT o_orderkey AS page_id, strftime(o_orderdate, '%m/%d/%Y') AS date, 'Remarks: ' || o_orderstatus AS title, '/speeches/' || o_orderkey AS url FROM orders")
def s08_links(spark, d):
    """One listing page an order, with a link that names no speech and one that does."""
    day = F.date_format("o_orderdate", "MMMM d, yyyy")
    parts = [F.lit("<a href='/about'>About</a><div class='views-row'><a href='/speeches/"), F.col("o_orderkey").cast("string"), F.lit("'>"), day, F.lit(": Remarks: "), F.col("o_orderstatus"), F.lit("</a></div>")]
    links = readers.html_links(table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.concat(*parts).alias("html")))
    return links.select("page_id", T.parse_long_date(F.col("date")).alias("date"), "title", "url")


@query("s13_unpivot", "SELECT president_num, president, CAST(i AS BIGINT) AS topic_idx, array_to_string(topics_list[i + 1], '; ') AS label FROM topic_labels, range(15) AS r(i) WHERE i < len(topics_list) AND topics_list[i + 1] IS NOT NULL")
def s13(spark, d):
    """The labels as a wide table of fifteen columns, back in long form."""
    names = [f"topic_{i}" for i in range(1, 16)]
    lists = [F.when(F.get("topics_list", i).isNotNull(), F.concat_ws("; ", F.get("topics_list", i))).alias(n) for i, n in enumerate(names)]
    wide = table(spark, d, "topic_labels").select("president_num", "president", *lists)
    return rows.unpivot(wide, ["president_num", "president"], names).select("president_num", "president", F.col("topic_idx").cast("long").alias("topic_idx"), "label")


@query("p15_rename_index", "SELECT batch_file, row_idx, word AS surface, lemma, CAST(row_number() OVER (PARTITION BY batch_file ORDER BY row_idx, loaded_at) - 1 AS BIGINT) AS index FROM presidents_words")
def p15(spark, d):
    w = table(spark, d, "presidents_words").withColumnsRenamed({"word": "surface"})
    w = rows.ordinal(w, ["batch_file"], ["row_idx", "loaded_at"], "index").drop("loaded_at", "pos", "year", "president", "speech_id", "paragraph", "Unnamed: 0")
    return w.select("batch_file", "row_idx", "surface", "lemma", F.col("index").cast("long").alias("index"))


@query("a19_speech_vocabulary", "SELECT president, speech_title, count(DISTINCT token) AS vocab FROM (SELECT president, speech_title, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS token FROM speeches WHERE president IS NOT NULL AND text IS NOT NULL AND NOT contains(speech_title, 'Debate')) GROUP BY 1, 2")
def a19(spark, d):
    return stats.vocabulary_table(table(spark, d, "speeches"))


_F2 = "text"
for _x in T.FILLERS_SHORT:
    _F2 = f"replace({_F2}, '{_x}', '')"


@query("f02_short_filler", f"SELECT row_id, {_F2} AS clean FROM speeches")
def f02(spark, d):
    return table(spark, d, "speeches").select("row_id", T.remove_literals(F.col("text"), T.FILLERS_SHORT).alias("clean"))


@query("f01_filler_intent", "SELECT row_id, regexp_replace(replace(text, chr(160), ' '), '(?i)\\([\\t-\\r ]*(?:laughter and applause|applause and laughter|applause|laughter)\\.?[\\t-\\r ]*\\)', '', 'g') AS clean FROM speeches")
def f01_intent(spark, d):
    return table(spark, d, "speeches").select("row_id", T.replace_filler(F.col("text")).alias("clean"))


@query("k10_scatter")
def k10(spark, d):
    """What a scatter plot of documents shows: place by two components, text and its length as the colour."""
    points = embed.principal_components(table(spark, d, "embeddings"), "vec_id", "embedding", 2)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("sentence"), F.length("text").alias("length"))
    return points.join(docs, "vec_id").select("vec_id", F.get("components", 0).alias("x"), F.get("components", 1).alias("y"), "sentence", "length")


@query("d01_word_table")
def d01(spark, d):
    return words.word_table(table(spark, d, "speeches"), ["president", "speech_id", "paragraph"])


@query("d03_lemmaless_table")
def d03(spark, d):
    return words.word_table(table(spark, d, "speeches"), lemmas=False)


@query("d04_cased_table")
def d04(spark, d):
    return words.word_table(table(spark, d, "inaug_speeches"), lower_word=False)


@query("m03_lda")
def m03(spark, d):
    return topics.lda_topics(table(spark, d, "documents"), "doc_id", "text", 10, 5, stop_words=STOP_WORDS)


def _speech_docs(spark: SparkSession, d: str) -> DataFrame:
    return stats.joined_speeches(stats.no_debates(table(spark, d, "speeches")), "\n")


@query("m04_nmf_per_president")
def m04(spark, d):
    return topics.nmf_topics(_speech_docs(spark, d), "president", "speech_title", "text", 10, STOP_WORDS, n_words=10)


@query("m06_nmf_per_speech")
def m06(spark, d):
    return topics.nmf_topics(table(spark, d, "speeches"), "speech_id", "paragraph", "text", 5, STOP_WORDS)


@query("m08_president_topic_scores")
def m08(spark, d):
    weights = m04(spark, d).select("president", "doc", "topic_idx", "weight")
    return topics.topic_scores(weights, topics.topic_labels(table(spark, d, "topic_labels")), "president", "doc")


@query("m09_nmf_all_presidents")
def m09(spark, d):
    return topics.nmf_few_documents(table(spark, d, "speeches").where("president is not null"), "president", "text", 20, STOP_WORDS)


@query("m13_pca")
def m13(spark, d):
    return embed.principal_components(table(spark, d, "embeddings"), "vec_id", "embedding", 5)


@query("k03_append_roundtrip", "SELECT president, 2 * count(*) AS n FROM presidents_words GROUP BY president")
def k03(spark, d):
    path = shared_path(spark, "k03")
    w = table(spark, d, "presidents_words").select("word", "pos", "lemma", "year", "president")
    for _ in range(2):
        sinks.append_parquet(w, path)
    return spark.read.parquet(path).groupBy("president").agg(F.count(F.lit(1)).alias("n"))


@query("k01_csv_roundtrip", "SELECT word, pos, lemma, year, president FROM presidents_words")
def k01(spark, d):
    path = shared_path(spark, "k01")
    sinks.write_csv(table(spark, d, "presidents_words").select("word", "pos", "lemma", "year", "president"), path, null="\\N")
    return readers.read_csv(spark, path, readers.SCHEMAS["words"], null="\\N")


@query("d09_batch_load", "SELECT batch_file, lower(word) AS word, lemma, count(*) AS n FROM presidents_words GROUP BY 1, 2, 3")
def d09(spark, d):
    """The word table written as CSV batches, loaded by one scan into a table, and read."""
    path = shared_path(spark, "d09")
    columns = ["word", "pos", "lemma", "year", "president"]
    sinks.write_batches(table(spark, d, "presidents_words").select(*columns, "batch_file"), f"{path}/batches", null="\\N")
    sinks.load_batches(spark, f"{path}/batches/*/part-*", readers.SCHEMAS["words"], f"{path}/words", index=False, null="\\N")
    return spark.read.parquet(f"{path}/words").groupBy("batch_file", "word", "lemma").agg(F.count(F.lit(1)).alias("n"))


@query("d01_agreement")
def d01_agreement(spark, d):
    """How far tags and lemmas agree with those of the word table: words that stand once in a paragraph, by coarse tag."""
    place = ["speech_id", "paragraph", "word"]
    own = words.word_table(table(spark, d, "speeches"), ["speech_id", "paragraph"]).groupBy(*place).agg(F.min("pos").alias("pos"), F.min("lemma").alias("lemma"), F.count(F.lit(1)).alias("n")).where("n = 1")
    given = table(spark, d, "presidents_words").where("word is not null and pos is not null and lemma is not null")
    given = given.groupBy("speech_id", "paragraph", F.lower("word").alias("word")).agg(F.min("pos").alias("pos2"), F.min(F.lower("lemma")).alias("lemma2"), F.count(F.lit(1)).alias("n2")).where("n2 = 1")
    both = own.join(given, place)
    return both.groupBy("pos2").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pos") == F.col("pos2")).alias("same_tag"), F.count_if(F.left("pos", F.lit(1)) == F.left("pos2", F.lit(1))).alias("same_class"), F.count_if(F.col("lemma") == F.col("lemma2")).alias("same_lemma"))
