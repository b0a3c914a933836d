"""Word categories, as plain tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories of words by tag.
MODALS = {
    "forceful_language": ["will", "would", "need", "must"], "suggestive_language": ["should", "shall", "ought"],
    "probable_language": ["could", "can"], "possible_language": ["might", "may"],
}
PRONOUNS = {
    "Me": ["me", "i", "myself", "my"], "You": ["yours", "yourself", "your", "you"], "They": ["they", "themselves", "them", "theirs", "their"],
    "He_She": ["he", "himself", "him", "she", "her", "herself", "his"], "We": ["we", "us", "ourselves", "our"],
}
GENDER = {"He": ["he", "himself", "him", "his"], "She": ["she", "her", "herself"]}
DETERMINERS = {"Outstanding Hyperbole": ["every", "all", "any", "each"], "Middling Hyperbole": ["some"]}
#: (tag, word) pairs by urgency.
URGENCY = {
    "forceful": [("MD", "will"), ("MD", "must"), ("MD", "would"), ("MD", "wo"), ("MD", "need"), ("VBG", "going")],
    "suggestive": [("MD", "should"), ("MD", "ought"), ("MD", "shall")],
    "possible": [("MD", "can"), ("MD", "could"), ("MD", "ca")],
    "questionable": [("MD", "might"), ("MD", "may")],
}
#: Tag groups by prefix.
TAG_GROUPS = {"adverb": "R", "adjective": "J", "noun": "N", "verb": "V"}
#: English function words; longer lists are given as a parameter.
STOP_WORDS = (
    "a about after again all also am an and any are as at be because been before being below between both but by can could did do does "
    "down during each few for from further had has have he her here hers herself him himself his how i if in into is it its itself just me more most "
    "my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their "
    "theirs them themselves then there these they this those through to too under until up very was we were what when where which while who "
    "whom why will with would you your yours yourself yourselves"
).split()

# Words of transcripts added to a general list. In the source two pairs lack a comma and are fused.
TRANSCRIPT_STOP_WORDS = (
    "audience thank applause president mr booo lady yes member everybody make members secretary shall thats theyre just ms ve 000 fellow got ive okay allen 150 lets sure im think going lot 90 200 let transit "
    "executive power land scrip"
).split()
FUSED_STOP_WORDS = {"lady": "ladyyes", "yes": "ladyyes", "make": "makemembers", "members": "makemembers"}


def stop_words(general: list[str] = STOP_WORDS, mode: str = "intent") -> list[str]:
    """A general list and the transcripts' words; ``reference`` keeps the two fused pairs, so that their words stay."""
    own = TRANSCRIPT_STOP_WORDS if mode == "intent" else [FUSED_STOP_WORDS.get(w, w) for w in TRANSCRIPT_STOP_WORDS]
    return list(dict.fromkeys([*general, *own]))


def category(word: Column, groups: dict[str, list[str]], other: str = "n/a") -> Column:
    """The category of a word, ``n/a`` for words of none."""
    out = None
    for name, words in groups.items():
        out = F.when(word.isin(words), name) if out is None else out.when(word.isin(words), name)
    return out.otherwise(other) if out is not None else F.lit(other)
