"""Patterns and value tables shared by the text functions.

The regular expressions use only syntax that Java and RE2 read the same way
(explicit classes, no ``\\w``/``\\s``), so one definition serves both engines.
"""

# ---------------------------------------------------------------------------
# They have to be exactly these for results to agree.
# ---------------------------------------------------------------------------

# ASCII punctuation; word-length statistics test for a *substring* of it.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Universal tag set of the multilingual track.
TAGS_MULTI = [
    "DET", "NUM", "PART", "ADJ", "PROPN", "CCONJ", "PRON", "PUNCT", "SYM", "SCONJ",
    "X", "INTJ", "NOUN", "AUX", "ADV", "ADP", "VERB",
]

# Penn tag set of the monolingual tracks.
TAGS_MONO = [
    "MD", "POS", "PRP$", "CD", "(", "VBP", "WP", ".", "WP$", "VBG", "SYM", "VB", "IN",
    ")", "UH", "RB", "FW", "''", ":", "JJ", "PRP", "#", "WDT", "EX", "$", "LS", "CC",
    "RBS", "NNPS", "DT", "NN", "JJR", "VBZ", "RBR", "VBN", "``", "TO", "VBD", "PDT",
    "RP", "WRB", "NNS", "NNP", "JJS", ",",
]

# Class names by label.
LABELS_TWO_CLASS = {0: "human", 1: "machine"}
LABELS_SIX_CLASS = {0: "human", 1: "chatGPT", 2: "cohere", 3: "davinci", 4: "bloomz", 5: "dolly"}

# Widths and counts.
CHUNK_SIZE = 10_000
BIGRAM_SLOTS = 10
MODEL_TOKENS = 512
STRIDE = 512
WINDOW_TOKENS = 1024
VALIDATION_SHARE = 0.2

# ---------------------------------------------------------------------------
# Patterns of this library
# ---------------------------------------------------------------------------

# The characters a Unicode whitespace split separates on. Wide ranges are left to the
# separator category, which is many times faster than listing them.
SPACE_CHARS = r" \p{Z}\t-\r\x{1c}-\x{1f}\x{85}"
SPACE = f"[{SPACE_CHARS}]+"
NON_SPACE = f"[^{SPACE_CHARS}]+"

# A word (with inner hyphens and apostrophes), "...", "--", or one other character.
_WORD_CHARS = r"\p{L}\p{M}\p{N}_"
WORD = (
    rf"[{_WORD_CHARS}]+(?:[-'][{_WORD_CHARS}]+)*|\.\.\.|--|[^{_WORD_CHARS}{SPACE_CHARS}]"
)

# A sentence ends at closing marks followed by white space.
SENTENCE_END = f"([.!?]+){SPACE}"
SENTENCE_MARK = "\u0001"

# Words as a two-or-more-character vectorizer sees them.
VECTORIZER_TOKEN = r"[\p{L}\p{N}_]{2,}"

# Tokens that read as a number, and so are never spelling errors.
NUMBER_TOKEN = (
    r"^(?:nan|inf(?:inity)?|\p{Nd}+(?:_\p{Nd}+)*(?:e-?\p{Nd}+(?:_\p{Nd}+)*)?)$"
)
HAS_LETTER = r"\p{L}"

# Everything in a page that is not text: comments, raw-text elements with their
# content, declarations, processing instructions, tags.
MARKUP = (
    r"(?is)<!--.*?-->"
    r"|<script\b[^>]*>.*?(?:</script[^>]*>|\z)"
    r"|<style\b[^>]*>.*?(?:</style[^>]*>|\z)"
    r"|<template\b[^>]*>.*?(?:</template[^>]*>|\z)"
    r"|<![a-z][^>]*>"
    r"|<\?[^>]*>"
    r"""|</?[a-z](?:[^>"']|"[^"]*"|'[^']*')*>"""
)
# Same language for Java: possessive runs keep the matcher's stack flat.
MARKUP_JAVA = MARKUP.replace(
    """(?:[^>"']|"[^"]*"|'[^']*')*>""", """(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
)

# One character reference, named or numeric.
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"
