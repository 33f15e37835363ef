"""Word lists and constants of the disfluency domain."""

from __future__ import annotations

# They must equal the published lists and weights for results to agree.
TYPES = ("filler", "repetition", "repair", "false_start")
FILLERS = (("uh", 0.445), ("you know", 0.256), ("well", 0.097), ("um", 0.090), ("i mean", 0.042), ("like", 0.039), ("oh", 0.019), ("now", 0.007), ("actually", 0.005))
INTERREGNA = ("i mean", "no wait", "sorry", "or rather", "no", "uh")
FRAGMENTS = ("can you", "could you", "i want to", "i need to", "we should", "do you", "let me", "i was going to", "it is", "there are", "what i")
SWAP_GROUPS = (
    "john sarah michael emily david rachel daniel laura kevin anna peter maria tom julia chris nina omar priya hannah marcus",
    "monday tuesday wednesday thursday friday saturday sunday",
    "january february march april june july august september october november december",
    "one two three four five six seven eight nine ten eleven twelve twenty thirty fifty",
    "first second third fourth fifth",
    "red blue green black white yellow purple orange grey",
    "office kitchen garage basement hallway lobby warehouse studio",
    "report invoice contract summary proposal agenda memo draft",
    "morning afternoon evening tonight tomorrow",
    "north south east west",
    "email message call text letter",
)
STOPWORDS = (
    "a an the and or but if of to in on at by for with from as is are was were be been being do does did have has had i you he she it we they me him her us "
    "them my your his its our their this that these those not no so then than there here about into over under up down out off just very can could would "
    "should will shall may might must"
)
OPENERS = "what when where why how which who am are is was were let want need going"
AMBIGUOUS = "like well so no wait sorry mean right actually know okay say"
STRIP = " \t\n.,;:!?\"'()[]{}<>—–-…‘’“”"
QUOTES = '"“”«»'
UNIGRAM_STRIP = " \t\n.,;:!?\"'()[]{}"
AFTER_CLAUSE = "\"”'’)"
EDGE = " ,.?!;:-"
DROPPED_GROUPS = "FED"
SHAPE = {"interregnum": 0.204, "bigram": 0.161, "span": 0.560, "span_drop": 0.50, "delayed": 0.15, "midsentence": 0.40}
MAX_SPAN, MAX_DELAY, MAX_RESTART = 3, 6, 4
MIN_WORDS = 10  # clean words of an utterance that a level is measured on
# End of the fixed values.

STOPWORD_SET = frozenset(STOPWORDS.split())
OPENER_SET = STOPWORD_SET | frozenset(OPENERS.split()) | {w for f in FRAGMENTS for w in f.split()}
FILLER_WORDS = frozenset(w for f, _ in FILLERS for w in f.split())
SWAPS = {w: tuple(g.split()) for g in SWAP_GROUPS for w in g.split()}
