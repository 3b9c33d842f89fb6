"""Column expressions: everything here stays inside whole-stage codegen."""

from polarity.functions.text import (  # noqa: F401
    basic_clean, collapse_whitespace, compose_text, date_or, decode_label,
    encode_label, preprocess, remove_stopwords, stopword_filter, tokenize,
    tokenize_raw, truncate_tokens, url_domain, preview,
)
from polarity.functions.labels import label_from_compound, softmax, argmax_label  # noqa: F401
