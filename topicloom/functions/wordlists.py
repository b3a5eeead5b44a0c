"""Word lists, tag set, patterns. Kept as plain text."""

from __future__ import annotations

# Fixed value: word tokens are runs of word characters or runs of other
# non-space characters. Same meaning in Java and RE2 regular expressions.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"

# Fixed value: a sentence ends behind a closing mark that white space follows.
SENTENCE_END = r"([.!?])(\s)"

# Fixed value: block elements that hold a paragraph.
BLOCK_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li")

# The usual English stop-word list.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your
    yours yourself yourselves he him his himself she she's her hers herself it
    it's its itself they them their theirs themselves what which who whom this
    that that'll these those am is are was were be been being have has had
    having do does did doing a an the and but if or because as until while of
    at by for with about against between into through during before after above
    below to from up down in out on off over under again further then once here
    there when where why how all any both each few more most other some such no
    nor not only own same so than too very s t can will just don don't should
    should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't
    doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn
    mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn
    wasn't weren weren't won won't wouldn wouldn't
    """.split()
)

# ASCII punctuation.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Default tag lexicon, closed classes only: tag -> lower-case words.
TAG_LEXICON = {
    "DT": "a an the this that these those each every some any no all both".split(),
    "CC": "and or but nor".split(),
    "TO": ["to"],
    "IN": "of in on at by for with from into about after before over under as if because while than through".split(),
    "PRP": "i you he she it we they me him them us".split(),
    "PRP$": "my your his her its our their".split(),
    "MD": "can could may might must shall should will would".split(),
    "VBZ": "is has does".split(),
    "VBP": "am are have do".split(),
    "VBD": "was were had did".split(),
    "VB": ["be"],
    "VBN": "been done".split(),
    "WP": "who what whom".split(),
    "WDT": ["which"],
    "WRB": "how when where why".split(),
    "EX": ["there"],
    "RB": "not very also now then here too".split(),
    "JJR": "better worse more less".split(),
    "JJS": "best worst most least".split(),
}

# Default tag rules for the open classes: (suffixes, tag), first match wins.
TAG_SUFFIXES = (
    (("ing",), "VBG"),
    (("ed",), "VBD"),
    (("ly",), "RB"),
    (("est",), "JJS"),
    (("able", "ible", "ous", "ful", "ive", "al", "ic"), "JJ"),
    (("ss", "us", "is"), "NN"),
    (("s",), "NNS"),
)

# Default irregular lemmas: class -> token -> lemma.
LEMMA_EXCEPTIONS = {
    "n": {
        "corpora": "corpus", "children": "child", "feet": "foot", "teeth": "tooth",
        "mice": "mouse", "people": "people", "indices": "index", "matrices": "matrix",
        "vertices": "vertex", "analyses": "analysis", "hypotheses": "hypothesis",
        "phenomena": "phenomenon", "criteria": "criterion", "lives": "life", "wives": "wife",
        "knives": "knife",
    },
    "v": {
        "am": "be", "is": "be", "are": "be", "was": "be", "were": "be", "been": "be",
        "being": "be", "has": "have", "had": "have", "having": "have", "does": "do",
        "did": "do", "done": "do", "went": "go", "gone": "go", "goes": "go", "made": "make",
        "making": "make", "ran": "run", "running": "run", "got": "get", "getting": "get",
        "setting": "set", "took": "take", "taken": "take", "wrote": "write",
        "written": "write", "gave": "give", "given": "give", "saw": "see", "seen": "see",
        "found": "find", "thought": "think", "said": "say", "sent": "send", "built": "build",
        "kept": "keep", "left": "leave", "lost": "lose", "tried": "try",
    },
    "a": {"better": "good", "best": "good", "worse": "bad", "worst": "bad"},
    "r": {"better": "well", "best": "well"},
}

# Detachment rules of the WordNet morphology, per class, longest
# suffix first, first match wins. Where WordNet lists two endings for a suffix
# (it asks its lexicon which one exists) the bare stem is taken.
DETACHMENT = {
    "n": (("ches", "ch"), ("shes", "sh"), ("ses", "s"), ("ves", "f"), ("xes", "x"),
          ("zes", "z"), ("men", "man"), ("ies", "y"), ("s", "")),
    "v": (("ies", "y"), ("ing", ""), ("es", "e"), ("ed", ""), ("s", "")),
    "a": (("est", ""), ("er", "")),
    "r": (),
}

# Endings that are not an inflection although they end in "s".
NOT_PLURAL = ("ss", "us", "is")

# HTML entities decoded to plain text; "&amp;" must stay last.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&amp;", "&"),
)

# Default keyword table for the topical filter.
KEYWORDS = ("token", "key", "password")
