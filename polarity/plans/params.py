"""Parameters that bind the operators to the driver's tables.

The ``documents`` texts are invented words in four languages, so the
registered queries use a lexicon of frequent fixture tokens instead of real
polarity words (the seed lexicon in ``polarity/resources`` holds those and is
covered by unit tests). Same values in the Spark queries and in the SQL.
"""

# Query lexicon (token, valence) over frequent fixture tokens.
QUERY_LEXICON = (
    ("de", 1.5), ("en", 0.9), ("der", 2.0), ("que", 1.1), ("es", 0.7),
    ("ha", 1.3), ("ed", 0.6), ("ing", 1.8), ("ly", 2.4), ("tion", 1.0),
    ("un", 0.5), ("la", -1.2), ("die", -2.5), ("le", -0.8), ("des", -1.6),
    ("et", -1.1), ("nt", -1.9), ("ble", -0.6), ("sh", -2.1), ("wh", -1.4),
    ("ea", -0.9), ("du", -1.7), ("thth", 0.0),
)
# Query negators and degree words (token, delta).
QUERY_NEGATORS = ("not", "no", "nicht", "ou", "ne")
QUERY_DEGREE = (("er", 0.3), ("st", 0.3), ("nd", 0.2), ("ti", -0.3))
NEGATION_FACTOR = 0.75
ALPHA = 15.0

# Keyword model classes (order = logit order) for the model-scorer queries.
QUERY_KEYWORDS = (
    ("de", "der", "ing", "ly", "que"),     # positive
    ("la", "die", "des", "sh", "nt"),      # negative
    ("re", "th", "on", "ou", "st"),        # neutral
)
# Class order of the logits in ``embeddings`` and of the keyword model.
LOGIT_LABELS = ("positive", "negative", "neutral")
LOGIT_CLASSES = 64
# Class order used by the training labels (0 negative, 1 neutral, 2 positive).
TRAIN_LABELS = ("negative", "neutral", "positive")

# Run date used instead of a clock, and the look-back windows.
AS_OF = "2024-01-30"
LOOKBACK_DAYS = 7
POST_DAYS_CAP = 7
# Per-company cap and top-k sizes.
TOP_PER_COMPANY = 10
TOP_DISAGREEMENTS = 5
SAMPLE_EXAMPLES = 10
SEED = 42
BOX_BLOCKS = 16
ROLLING_ROWS = 5
ROLLING_DAYS = 3
# Companies searched for in the mention query (fixture words standing in for tickers).
COMPANIES = (("DER", "der"), ("QUE", "que"), ("ES", "es"), ("THTH", "thth"), ("ZU", "zu"))
# Two-word search terms of the phrase query, and the entity it sets to null.
PHRASES = (("DELA", "de la"), ("OFTHE", "Of The"), ("INDER", "in der"), ("THE", "the"), ("NONE", "no such phrase"))
NULLED_USER = 7
# The many-companies query searches for this many terms: word pairs that begin at every so-many-th word of a text.
COMPANY_TERMS = 20_000
TERM_STEP = 10
# Custom stop-word list (replaces the default) for the T8 custom query.
CUSTOM_STOPWORDS = ("de", "la", "der", "die", "que", "le", "des", "und", "et", "les", "un", "el")
# Words a caller adds to the stop words.
EXTRA_STOPWORDS = ("tion", "ment", "ing", "ly", "en", "que", "heit", "keit")
# Query lemma table (token -> lemma) over fixture tokens.
QUERY_LEMMAS = (("des", "de"), ("les", "le"), ("der", "die"), ("den", "die"), ("une", "un"),
                ("los", "el"), ("das", "die"), ("ing", "in"), ("ed", "e"))
# Token cut (T15) and the training grid (M6).
MAX_TOKENS = 128
TRAIN_GRID = ({"regParam": 0.01}, {"regParam": 0.1})
TRAIN_FEATURES = 1 << 14
# Training by epochs: rows of a mini-batch and epochs at most.
EPOCH_BATCH = 4096
EPOCHS = 4
