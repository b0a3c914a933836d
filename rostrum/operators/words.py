"""Paragraphs to a table of words, tags and lemmas, in the JVM: lexicon, suffixes and one token of context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions.text import FILLERS_SHORT, is_punctuation, or_nan, remove_literals, treebank_tokens, year_of
from rostrum.plans.session import spread

# Closed classes of English by tag.
CLOSED = {
    "MD": "will would shall should can could may might must ought ca wo 'll need",
    "PRP": "i you he she it we they me him us them myself yourself himself herself itself ourselves themselves",
    "PRP$": "my your his its our their",
    "DT": "the a an this these those every each any some no all both another either neither",
    "CD": "one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion",
    "NN": "nothing something anything everything nobody everybody anybody someone everyone anyone morning evening spring king thing",
    "IN": "of in for on with at by from about into through during before after above below between under over against among upon if because while since although whether than as without within until till beside besides toward towards across along around behind beyond despite except inside near onto outside throughout",
    "CC": "and or but nor yet",
    "TO": "to",
    "WP": "who whom what", "WP$": "whose", "WDT": "which whatever whichever", "WRB": "when where why how",
    "EX": "there",
    "RB": "not n't never very also here now then again always often too so rather soon together perhaps even still just ever already almost away back once instead indeed today yet tomorrow yesterday",
    "JJ": "few many more most such other own same good great new old last next first easy easier better best free true",
    "VBZ": "is has does", "VBP": "am are have do", "VB": "be ask see let", "VBN": "been begun taken given known seen done gone spoken chosen written grown shown broken driven fallen borne sworn",
    "VBD": "was were had did said came saw left wrote gave met told chose took went knew thought kept felt spoke won made stood held found fell grew drew lost paid ran sat sent led built bought brought taught fought sought caught heard meant became began broke drove rose swore tore wore",
    "UH": "oh ah well yes",
}
IRREGULAR = {
    "is": "be", "am": "be", "are": "be", "was": "be", "were": "be", "been": "be", "has": "have", "had": "have", "does": "do", "did": "do", "done": "do", "said": "say", "went": "go", "gone": "go",
    "made": "make", "took": "take", "taken": "take", "gave": "give", "given": "give", "came": "come", "saw": "see", "seen": "see", "knew": "know", "known": "know", "thought": "think", "told": "tell",
    "kept": "keep", "left": "leave", "felt": "feel", "spoke": "speak", "won": "win", "men": "man", "women": "woman", "children": "child", "people": "people", "lives": "life", "wives": "wife",
    "begun": "begin", "began": "begin", "wrote": "write", "written": "write", "met": "meet", "chose": "choose", "chosen": "choose", "stood": "stand", "held": "hold", "found": "find", "fell": "fall", "fallen": "fall",
    "grew": "grow", "grown": "grow", "drew": "draw", "lost": "lose", "paid": "pay", "ran": "run", "sat": "sit", "sent": "send", "led": "lead", "built": "build", "bought": "buy", "brought": "bring", "taught": "teach",
    "fought": "fight", "sought": "seek", "caught": "catch", "heard": "hear", "meant": "mean", "became": "become", "broke": "break", "broken": "break", "drove": "drive", "driven": "drive", "rose": "rise", "shown": "show", "spoken": "speak",
    "swore": "swear", "sworn": "swear", "tore": "tear", "wore": "wear", "borne": "bear",
    "better": "good", "best": "good", "worse": "bad", "worst": "bad",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _closed(low: Column) -> Column:
    out = None
    for name, members in CLOSED.items():
        hit = low.isin(members.split())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def tag(token: Column, before: Column) -> Column:
    """A Treebank tag: closed classes by lexicon, open ones by suffix; ``her``, ``that`` and modals by what is before."""
    low = F.lower(token)
    prior = F.coalesce(F.lower(before), F.lit(""))
    determined = prior.isin("the", "a", "an", "my", "your", "his", "its", "our", "their", "this", "that")
    return (
        F.when(token.rlike(r"^``$"), "``").when(token.rlike(r"^''$"), "''").when(token == "$", "$").when(token.rlike(r"^(?:--|\.\.\.|:|;)$"), ":")
        .when(token.rlike(r"^[,.?!]$"), F.when(token == ",", ",").otherwise("."))
        .when(token.rlike(r"^[\p{Punct}]+$") & ~token.rlike("^'"), "SYM")
        .when(low == "'s", F.when(prior.isin("it", "he", "she", "that", "there", "what", "let"), "VBZ").otherwise("POS"))
        .when(low.isin("'re", "'ve", "'m"), "VBP").when(low == "'d", "MD").when(low == "'", "POS")
        .when(low == "her", F.when(prior.isin("", "to", "for", "with", "of", "told", "gave", "and"), "PRP").otherwise("PRP$"))
        .when(low == "that", F.when(prior.rlike("(?:s|ed|y|t)$"), "IN").otherwise("DT"))
        .when(low.isin("will", "might", "can", "may", "need") & determined, "NN")
        .when(low.isin([w for ws in CLOSED.values() for w in ws.split()]), _closed(low))
        .when(token.rlike(r"^[\p{N}][\p{N}.,/-]*$"), "CD")
        .when((prior == "to") & ~token.rlike(r"^\p{Lu}") & ~low.rlike("(?:s|ing|ed|ion)$"), "VB")
        .when(token.rlike(r"^\p{Lu}") & (prior != "") & ~prior.isin(".", "!", "?", "``"), F.when(low.rlike("[^s]s$"), "NNPS").otherwise("NNP"))
        .when(low.rlike("ing$") & (F.length(low) > 4), "VBG")
        .when(low.rlike("ed$") & (F.length(low) > 3), F.when(prior.isin("have", "has", "had", "been", "was", "were", "be", "is", "are"), "VBN").otherwise("VBD"))
        .when(low.rlike("ly$") & (F.length(low) > 3), "RB")
        .when(low.rlike("(?:ous|ful|less|able|ible|ive|ic|al|ish|ary)$") & (F.length(low) > 4), "JJ")
        .when(prior.isin("will", "would", "shall", "should", "can", "could", "may", "might", "must", "ought", "n't"), "VB")
        .when(low.rlike("[^su]s$") & (F.length(low) > 3), F.when(prior.isin("he", "she", "it"), "VBZ").otherwise("NNS"))
        .otherwise("NN")
    )


def lemma(token: Column, pos: Column) -> Column:
    """Irregular forms by table, regular ones by detaching suffixes for verbs, nouns and adjectives; others stay."""
    low = F.lower(token)
    kind = F.substring(pos, 1, 1)
    verb = (
        F.when(low.rlike("ies$") & (F.length(low) > 4), F.regexp_replace(low, "ies$", "y"))
        .when(low.rlike("(?:ch|sh|x|ss|z|o)es$"), F.regexp_replace(low, "es$", ""))
        .when(low.rlike("([bdgmnprt])\\1(?:ing|ed)$"), F.regexp_replace(low, "([bdgmnprt])\\1(?:ing|ed)$", "$1"))
        .when(low.rlike("(?:at|iz|iv|uc|as|us|rv|nc|ng|c|v|u)(?:ing|ed)$") & (F.length(low) > 5), F.regexp_replace(low, "(?:ing|ed)$", "e"))
        .when(low.rlike("ied$"), F.regexp_replace(low, "ied$", "y"))
        .when(low.rlike("(?:ing|ed)$") & (F.length(low) > 5), F.regexp_replace(low, "(?:ing|ed)$", ""))
        .when(low.rlike("[^su]s$") & (F.length(low) > 3), F.regexp_replace(low, "s$", ""))
        .otherwise(low)
    )
    noun = (
        F.when(low.rlike("[^aeiou]ies$") & (F.length(low) > 4), F.regexp_replace(low, "ies$", "y"))
        .when(low.rlike("(?:ch|sh|x|ss|z)es$"), F.regexp_replace(low, "es$", ""))
        .when(low.rlike("[^sui]s$") & (F.length(low) > 3), F.regexp_replace(low, "s$", ""))
        .otherwise(low)
    )
    regular = F.when(kind == "V", verb).when(kind == "N", noun).otherwise(low)
    return F.when(kind.isin("V", "N", "J"), F.when(low.isin(list(IRREGULAR)), _lookup(IRREGULAR, low)).otherwise(regular)).otherwise(low)


def word_table(
    speeches: DataFrame, keys: list[str] = ["president"], mode: str = "intent", lower_word: bool = True, lower_lemma: bool = True, lemmas: bool = True  # noqa: B006
) -> DataFrame:
    """``word, pos, lemma, year`` and ``keys``, one row for each token that is no punctuation.

    Null texts give no words (``reference``: the word ``nan``). ``lemmas=False`` leaves the lemma out;
    ``lower_lemma=False`` keeps the source's case in lemmas whose form is unchanged. One lazy map, no shuffle.
    """
    text = remove_literals(or_nan(F.col("text"), mode), FILLERS_SHORT)
    rows = spread(speeches).select(*keys, year_of(F.col("date")).alias("year"), treebank_tokens(text).alias("_tokens"))
    tagged = F.transform("_tokens", lambda t, i: F.struct(t.alias("t"), F.when(i > 0, F.get("_tokens", i - 1)).alias("b")))
    rows = rows.select(*keys, "year", F.explode(tagged).alias("x")).where(~is_punctuation(F.col("x.t")))
    token = F.col("x.t")
    rows = rows.select(token.alias("_t"), tag(token, F.col("x.b")).alias("pos"), "year", *keys)
    found = lemma(F.col("_t"), F.col("pos"))
    if not lower_lemma:
        found = F.when(found == F.lower("_t"), F.col("_t")).otherwise(found)
    columns = [(F.lower("_t") if lower_word else F.col("_t")).alias("word"), F.col("pos")]
    return rows.select(*columns, *([found.alias("lemma")] if lemmas else []), "year", *keys)
