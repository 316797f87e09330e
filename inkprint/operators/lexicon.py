"""Word-list operators: dictionary misses, part-of-speech tags, tag proportions.

Tags come from a short list of closed-class words and from the form of the word.
That is an approximation of a trained tagger, stated as such in the README.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.functions.patterns import HAS_LETTER, NUMBER_TOKEN, PUNCTUATION, TAGS_MONO, TAGS_MULTI
from inkprint.functions.text import word_tokens
from inkprint.operators.coherence import token_rows, tokens_by_text
from inkprint.operators.distribute import lookup
from inkprint.operators.identity import each_text
from inkprint.operators.in_text import Piece, in_texts
from inkprint.session import materialize

# ------------------------------------------------------------------- dictionary

def dictionary_of(df: DataFrame, text: str = "text") -> DataFrame:
    """(word): the distinct words with a letter in a corpus, written out once."""
    words = df.select(F.explode(word_tokens(F.lower(F.col(text)))).alias("word"))
    return materialize(words.filter(F.col("word").rlike(HAS_LETTER)).distinct())


def is_checkable(word: Column) -> Column:
    """Words a spelling checker looks at: not single punctuation marks or numbers."""
    mark = (F.length(word) == 1) & F.lit(PUNCTUATION).contains(word)
    return ~mark & ~word.rlike(NUMBER_TOKEN)


def unknown_words(
    df: DataFrame, keys: Sequence[str], dictionary: DataFrame, text: str = "text"
) -> DataFrame:
    """(keys, word): distinct checkable words of each text that the dictionary lacks.

    Words are distinct within a row, so texts under one id each bring their own.
    """
    # Duplicates go inside the row, before there are rows to shuffle.
    words = tokens_by_text(df, keys, text).select(
        *keys, F.explode(F.array_distinct("tokens")).alias("word")
    )
    words = words.filter(is_checkable(F.col("word")))
    return lookup(words, dictionary, ["word"], spread_by=keys, how="left_anti")


def spelling_errors(
    df: DataFrame,
    keys: Sequence[str],
    dictionary: DataFrame,
    text: str = "text",
    unique: bool = False,
) -> DataFrame:
    """(keys, spelling_error) for every text, 0 where nothing is unknown."""

    def work(rows: DataFrame, keys: list[str]) -> DataFrame:
        words = tokens_by_text(rows, keys, text).select(
            *keys, F.explode_outer(F.array_distinct("tokens")).alias("word")
        )
        known = dictionary.withColumn("_known", F.lit(True))
        checked = lookup(words, known, ["word"], spread_by=keys)
        error = is_checkable(F.col("word")) & F.col("_known").isNull()
        return checked.groupBy(*keys).agg(F.count_if(error).alias("spelling_error"))

    return each_text(df, keys, [text], work, unique)


# ------------------------------------------------------------------------- tags

# Closed-class English words by Penn tag.
ENGLISH_CLOSED_CLASS = {
    "DT": "a an the this that these those every each no some any",
    "IN": "of in for on with as at by from into about after before over under than if because while although between through during without within against upon whether since until",
    "TO": "to",
    "CC": "and or but nor yet",
    "PRP": "i you he she it we they me him us them myself himself itself themselves",
    "PRP$": "my your his her its our their",
    "MD": "can could may might must shall should will would",
    "VBZ": "is has does",
    "VBP": "am are have do",
    "VBD": "was were had did said",
    "VB": "be",
    "VBN": "been",
    "VBG": "being",
    "WDT": "which whatever",
    "WP": "who whom what",
    "WP$": "whose",
    "WRB": "when where why how",
    "EX": "there",
    "RB": "not n't never very also too so just only now then here always often",
    "JJ": "other such many same own new good great",
    "JJR": "more less better",
    "JJS": "most least best",
    "RP": "up out off down",
    "PDT": "all both half",
    "UH": "oh yes well hello",
    "POS": "'s",
}

# Closed-class words of other languages by universal tag.
CLOSED_CLASS_BY_LANGUAGE = {
    "de": {
        "DET": "der die das den dem des ein eine einen einem einer kein",
        "ADP": "in im mit von zu für auf an bei nach aus über",
        "CCONJ": "und oder aber", "SCONJ": "dass wenn weil ob",
        "PRON": "ich du er sie es wir ihr sich", "AUX": "ist sind war hat haben wird werden",
        "PART": "nicht", "ADV": "auch noch nur sehr so",
    },
    "es": {
        "DET": "el la los las un una unos unas", "ADP": "de en a con por para sin sobre",
        "CCONJ": "y o pero", "SCONJ": "que si porque", "PRON": "se lo le yo me te nos su",
        "AUX": "es son fue ha han ser", "ADV": "no más muy también como ya",
    },
    "fr": {
        "DET": "le la les un une des du", "ADP": "de en à dans pour avec sur par",
        "CCONJ": "et ou mais", "SCONJ": "que si", "PRON": "je tu il elle nous vous se ce qui on",
        "AUX": "est sont a ont été", "ADV": "ne pas plus aussi très",
    },
}

# Penn tags as universal tags; the rest are listed under their own rules below.
UNIVERSAL_BY_PENN = {
    "DT": "DET", "PDT": "DET", "WDT": "DET", "CD": "NUM", "POS": "PART", "TO": "PART",
    "JJ": "ADJ", "JJR": "ADJ", "JJS": "ADJ", "NNP": "PROPN", "NNPS": "PROPN", "CC": "CCONJ",
    "PRP": "PRON", "PRP$": "PRON", "WP": "PRON", "WP$": "PRON", "EX": "PRON", "SYM": "SYM",
    "#": "SYM", "$": "SYM", "IN": "ADP", "RP": "ADP", "FW": "X", "LS": "X", "UH": "INTJ",
    "NN": "NOUN", "NNS": "NOUN", "MD": "AUX", "RB": "ADV", "RBR": "ADV", "RBS": "ADV",
    "WRB": "ADV", "VB": "VERB", "VBD": "VERB", "VBG": "VERB", "VBN": "VERB", "VBP": "VERB",
    "VBZ": "VERB", ".": "PUNCT", ",": "PUNCT", ":": "PUNCT", "(": "PUNCT", ")": "PUNCT",
    "''": "PUNCT", "``": "PUNCT",
}

# Tag by form for words the list does not hold: the first test that holds wins. A word
# is tested by a pattern, by its ending, or for being one of some marks.
FORM_RULES = [
    ("like", r"^\p{N}", "CD"),
    ("like", r"^\p{Lu}", "NNP"),
    ("ends", "ing", "VBG"),
    ("ends", "ed", "VBD"),
    ("ends", "ly", "RB"),
    ("ends", "s", "NNS"),
    ("one of", ". ! ?", "."),
    ("one of", ",", ","),
    ("one of", ": ; … ... --", ":"),
    ("one of", "( [ {", "("),
    ("one of", ") ] }", ")"),
    ("one of", "\" ' ’ ”", "''"),
    ("one of", "` ‘ “", "``"),
    ("one of", "#", "#"),
    ("one of", "$ € £", "$"),
    ("like", r"^[^\p{L}\p{N}]+$", "SYM"),
]
DEFAULT_TAG = "NN"


def english_entries() -> list[tuple[str, str]]:
    """(word, tag) pairs of the English list."""
    return [(w, tag) for tag, words in ENGLISH_CLOSED_CLASS.items() for w in words.split()]


def universal_entries() -> list[tuple[str, str, str]]:
    """(language, word, tag) triples of all lists, in universal tags."""
    entries = [("en", w, UNIVERSAL_BY_PENN[tag]) for w, tag in english_entries()]
    for language, by_tag in CLOSED_CLASS_BY_LANGUAGE.items():
        entries += [(language, w, tag) for tag, words in by_tag.items() for w in words.split()]
    return list({(lang, w): (lang, w, tag) for lang, w, tag in entries}.values())


def tag_by_form(token: Column, universal: bool = False) -> Column:
    """Tag from the shape of a token."""

    def named(tag: str) -> Column:
        return F.lit(UNIVERSAL_BY_PENN[tag] if universal else tag)

    tests = {
        "like": token.rlike,
        "ends": token.endswith,
        "one of": lambda marks: token.isin(marks.split()),
    }
    by_rule = [F.when(tests[test](value), named(tag)) for test, value, tag in FORM_RULES]
    return F.coalesce(*by_rule, named(DEFAULT_TAG))


def tag_tokens(tokens: DataFrame) -> DataFrame:
    """Add ``tag`` (Penn) to rows with ``tok`` in original case."""
    spark = tokens.sparkSession
    words = spark.createDataFrame(english_entries(), "_word string, _tag string")
    found = tokens.join(F.broadcast(words), F.lower("tok") == F.col("_word"), "left")
    return found.withColumn("tag", F.coalesce("_tag", tag_by_form(F.col("tok")))).drop("_word", "_tag")


# Column names that need no quoting, for tags that are punctuation.
_SPOKEN = {
    "PRP$": "PRP_S", "WP$": "WP_S", "(": "lparen", ")": "rparen", ".": "period", "''": "rquote",
    ":": "colon", "#": "hash", "$": "dollar", "``": "lquote", ",": "comma",
}


def tag_column(tag: str) -> str:
    """Column name of a tag's proportion."""
    return "tag_" + _SPOKEN.get(tag, tag)


def with_plain_tag_names(df: DataFrame) -> DataFrame:
    """Rename tag columns to the bare tags, as feature files name them."""
    names = {tag_column(t): t for t in [*TAGS_MONO, *TAGS_MULTI]}
    return df.withColumnsRenamed({c: names[c] for c in df.columns if c in names})


def _forms(names: pa.Array, universal: bool) -> np.ndarray:
    """Tag of each name by ``FORM_RULES``."""
    tests = {
        "like": pc.match_substring_regex,
        "ends": pc.ends_with,
        "one of": lambda of, marks: pc.is_in(of, pa.array(marks.split())),
    }
    named = lambda tag: UNIVERSAL_BY_PENN[tag] if universal else tag
    found = np.full(len(names), named(DEFAULT_TAG), object)
    for test, value, tag in reversed(FORM_RULES):
        found[tests[test](names, value).to_numpy(zero_copy_only=False)] = named(tag)
    return found


def tag_shares_of(piece: Piece, tags: Sequence[str], languages: pa.Array | None = None) -> list[pa.Array]:
    """For each listed tag its share among the tags of each text, 0 without tokens.

    Each distinct token of the piece is tagged once, by language if those of its texts are given.
    """
    universal, texts = languages is not None, len(piece.length)
    lists: dict[str, dict[str, str]] = {"en": dict(english_entries())}
    if universal:
        lists = {lang: {} for lang in ("en", *CLOSED_CLASS_BY_LANGUAGE)}
        for lang, word, tag in universal_entries():
            lists[lang][word] = tag
    given = languages.to_pylist() if universal else ["en"] * texts
    spoken = np.array([x if x in lists else "en" for x in given], object)
    row, code, n = piece.counts()
    sums = np.zeros((len(tags) + 1, texts))
    number = {t: i for i, t in enumerate(tags)}
    names = piece.names.cast(pa.string())
    forms, lowered = _forms(names, universal), pa.array([x.lower() for x in names.to_pylist()], pa.string())
    for lang in set(spoken):
        listed = pc.index_in(lowered, pa.array(list(lists[lang])))
        known = listed.is_valid().to_numpy(zero_copy_only=False)
        named = forms.copy()
        named[known] = np.array(list(lists[lang].values()), object)[listed.drop_null().to_numpy()]
        # A tag that is not listed counts among all.
        place = np.array([number.get(t, len(tags)) for t in named], np.int64)
        here = spoken[row] == lang
        sums += np.bincount(place[code[here]] * texts + row[here], n[here], sums.size).reshape(sums.shape)
    return [pa.array(s / np.maximum(piece.length, 1)) for s in sums[:-1]]


def tag_proportions(
    df: DataFrame,
    keys: Sequence[str],
    tags: Sequence[str] = tuple(TAGS_MONO),
    text: str = "text",
    language: str | None = None,
    unique: bool = False,
) -> DataFrame:
    """Share of each listed tag among all tags of a text, 0 where absent or without tokens."""
    tags = list(tags)

    def count(piece: Piece, *languages: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        return np.arange(len(piece.length)), tag_shares_of(piece, tags, *languages)

    def work(rows: DataFrame, keys: list[str]) -> DataFrame:
        added = ", ".join(f"{tag_column(t)} double" for t in tags)
        others = [language] if language else []
        return in_texts(rows, keys, word_tokens(F.col(text)), count, added, others=others)

    return each_text(df, keys, [text, *([language] if language else [])], work, unique)


def tag_vocabulary(df: DataFrame, text: str = "text") -> DataFrame:
    """(tag): all tags that occur in a corpus."""
    tokens = df.select(F.explode(word_tokens(F.col(text))).alias("tok"))
    return tag_tokens(tokens).select("tag").distinct()


def token_tags(
    df: DataFrame, keys: Sequence[str], text: str = "text"
) -> DataFrame:
    """(keys, pos, tok, tag): every token with its tag."""
    return tag_tokens(token_rows(df, keys, text, lower=False))
