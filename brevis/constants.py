"""Shared patterns, budgets and word lists. The oracle SQL uses the same strings."""

# Patterns written for both Java and RE2 (no lookaround, Unicode classes spelt out).
SENTENCE = r"[^.!?\n]+[.!?]*"
WORD = r"[\p{L}\p{N}_']+|[^\s\p{L}\p{N}_']"
RANK_WORD = r"[\p{L}][\p{L}'-]*"
#: What lies between ranking words, and before the first of a line: all but these words and line feeds (Java only).
RANK_GAP = r"(?<![^\n])[^\p{L}\n]+|[^\p{L}\n'-][^\p{L}\n]*"
TERM = r"[\p{L}\p{N}_]{2,}"
ALPHA = r"\p{L}+"
NOT_ROUGE = r"[^a-z0-9]+"
SPACES = r"\s+"

# Quantity label -> token budget (None = whole text).
QUANTITY_BUDGET = {
    "25": 373,
    "35": 323,
    "45": 273,
    "512": 512,
    "all": None,
    "neg": None,
}

# Length classes and limits.
SOURCE_CLASSES = (512, 1024)
TARGET_LIMIT = 36
STEP_ROWS = 128
PAD_ID = 0
EOS_ID = 1
FIRST_WORD_ID = 2
LABEL_IGNORE = -100
PREFIX = "summarize: "

# Extractive ranking.
LUHN_GAP = 4
LSA_SMOOTH = 0.4
DAMPING = 0.85
RANK_ROUNDS = 20

# English stop words.
STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself "
    "yourselves he him his himself she she's her hers herself it it's its itself they them their "
    "theirs themselves what which who whom this that that'll these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at "
    "by for with about against between into through during before after above below to from up down "
    "in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don "
    "don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn "
    "doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn "
    "needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# Negations that the "neg" stop list keeps in the text.
NEGATIONS = (
    "wouldn't hasn not shan't didn't couldn't aren didn mustn't couldn don isn't mightn mustn "
    "shouldn't wasn shan weren nor needn hadn't wasn't shouldn won't doesn't won isn doesn hasn't "
    "weren't needn't haven't no mightn't wouldn aren't don't"
).split()

# Punctuation re-spacing, in order of application (cut at, join with).
RESPACE = (
    ("%", "% "),
    ("[ ", " ["),
    (" ]", "] "),
    ("( ", " ("),
    (" )", ") "),
    (".", ". "),
    (",", ", "),
    (":", ": "),
    (" .", "."),
    ("?", "? "),
)
# Plain replacements after re-spacing, in order.
RESPACE_TAIL = (("``", ""), ("''", ""), ("  ", " "))

# Headline topics, matched as substrings of lower-cased text.
TOPIC_PATTERNS = {
    "stock": "underperforms|outperforms|stock market|trading|rises|dow jones",
    "sales": "sales|sector|store|retail|retailers|competitors",
    "performance": "eps|earning per share|q1|q2|q3|q4|profit|income",
    "management": "ceo|updates|suprise|advisories|sears",
}

# Boilerplate headlines dropped before and after normalisation.
BOILERPLATE_RAW = (
    "Intel announces $5.4 billion deal to buy Tower Semiconductor",
    "The most common excuses for not buying an electric vehicle are mostly unfounded",
    "Ray Dalio’s Bridgewater boosts its bets on China",
    "What is the Alfa Romeo Tonale, and why does it come with a non-fungible token?",
    "What is a multicurrency account, and should you get one?",
    "‘Those years passed, and here I am.’ What it’s like to live to 100.",
    "Barron'sInvestors, Beware: These Funds Could Pose a 'Flight Risk' for Junk Bond Markets",
    "No Recent Tickers",
    "Overview",
)
BOILERPLATE_CLEAN = ("marketwatch", "company", "dow jones network")

# Part-of-speech buckets in matching order.
TAG_BUCKETS = (("NN", "nouns"), ("VB", "verbs"), ("JJ", "adjs"), ("RB", "advs"), ("CD", "cardinals"))

# Irregular English verbs: base form, then its other forms.
IRREGULAR_VERBS = """be am is are was were been being
have has had having
do does did done
go goes went gone
say said
make made
take took taken
come came
see saw seen
get got gotten
know knew known
think thought
give gave given
find found
tell told
become became
leave left
feel felt
bring brought
begin began begun
keep kept
hold held
write wrote written
stand stood
hear heard
mean meant
meet met
run ran
pay paid
sit sat
speak spoke spoken
lead led
grow grew grown
lose lost
fall fell fallen
send sent
build built
understand understood
draw drew drawn
break broke broken
spend spent
rise rose risen
drive drove driven
buy bought
wear wore worn
choose chose chosen
seek sought
throw threw thrown
catch caught
deal dealt
win won
forget forgot forgotten
teach taught
eat ate eaten
fight fought
sell sold
sing sang sung
swim swam swum
fly flew flown
drink drank drunk
shake shook shaken
steal stole stolen"""
