"""DuckDB SQL for every registered query that SQL can express.

Tables are the driver's views (documents, labels, pages, events, ...).
Doubles are rounded to 6 places on both sides; counts are BIGINT. The SQL is
an independent formulation of each rule (RE2, list functions, window lags),
so a match checks the Spark plans rather than repeating them.
"""

from __future__ import annotations

from polarity.plans import params as P
from polarity.plans.sqlparts import (
    clean_sql, collapse_sql, domain_sql, lexicon_score_sql, lit,
    stop_filter_sql, str_list, tokens_sql, values_sql,
)

ORACLE: dict[str, str] = {}
CLASSES = ("positive", "negative", "neutral")


def sql(name: str):
    def deco(fn):
        ORACLE[name] = canonical_zero(fn())
        return fn
    return deco


def canonical_zero(text: str) -> str:
    """Wrap every ``round(x, 6)`` as ``(round(x, 6) + 0.0)``: a negative zero
    becomes zero, as on the Spark side. Parentheses inside quoted strings are
    skipped."""
    out, i, n = [], 0, len(text)
    while i < n:
        if text.startswith("round(", i) and (i == 0 or not (text[i - 1].isalnum() or text[i - 1] == "_")):
            depth, j, quote = 0, i + len("round"), False
            while j < n:
                ch = text[j]
                if ch == "'":
                    quote = not quote
                elif not quote and ch == "(":
                    depth += 1
                elif not quote and ch == ")":
                    depth -= 1
                    if depth == 0:
                        break
                j += 1
            inner = canonical_zero(text[i + len("round("):j])
            if inner.rstrip().endswith(", 6"):
                out.append(f"(round({inner}) + CAST(0 AS DOUBLE))")
            else:
                out.append(f"round({inner})")
            i = j + 1
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


def docs_cte(name: str, stop: bool = True, extra: tuple[str, ...] = ()) -> str:
    ex = "".join(f", {c}" for c in extra)
    toks = tokens_sql(clean_sql("text"))
    if stop:
        toks = stop_filter_sql(toks)
    return f"{name} AS (SELECT doc_id{ex}, {toks} AS toks FROM documents)"


def model(ns: str, cte: str, keys="doc_id", extra: tuple[str, ...] = ()) -> str:
    return lexicon_score_sql(cte, keys, P.QUERY_LEXICON, P.QUERY_NEGATORS, P.QUERY_DEGREE,
                             P.NEGATION_FACTOR, P.ALPHA, extra, ns)


def model_a(extra: tuple[str, ...] = ()) -> str:
    """CTEs ending in ``a_labelled``: model A over processed documents."""
    return "WITH " + docs_cte("ta", True, extra) + model("a", "ta", "doc_id", extra)


def two_models(extra: tuple[str, ...] = ()) -> str:
    """CTEs ending in ``wide(doc_id, extra..., a_*, b_*)``."""
    sel_extra = "".join(f", a.{c}" for c in extra)
    cols = ", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in (*CLASSES, "label"))
    return ("WITH " + docs_cte("ta", True, extra) + ", " + docs_cte("tb", False)
            + model("a", "ta", "doc_id", extra) + model("b", "tb")
            + f", wide AS (SELECT a.doc_id{sel_extra}, {cols} FROM a_labelled a "
              f"JOIN b_labelled b ON a.doc_id = b.doc_id)")


def keyword_cte(name: str = "kw", src: str = "documents") -> str:
    """``{name}(doc_id, positive, negative, neutral, label)`` of the keyword model."""
    toks = stop_filter_sql(tokens_sql(clean_sql("text")))
    logit = [f"CAST(len(list_filter(toks, lambda x: list_contains({str_list(kw)}, x))) AS DOUBLE)"
             for kw in P.QUERY_KEYWORDS]
    names = P.LOGIT_LABELS
    return f"""{name}_t AS (SELECT doc_id, {toks} AS toks FROM {src}),
{name}_l AS (SELECT doc_id, {logit[0]} AS l0, {logit[1]} AS l1, {logit[2]} AS l2 FROM {name}_t),
{name}_e AS (SELECT doc_id, exp(l0 - greatest(l0, l1, l2)) AS e0, exp(l1 - greatest(l0, l1, l2)) AS e1,
                    exp(l2 - greatest(l0, l1, l2)) AS e2 FROM {name}_l),
{name}_p AS (SELECT doc_id, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1,
                    e2 / (e0 + e1 + e2) AS p2 FROM {name}_e),
{name} AS (SELECT doc_id, p{names.index('positive')} AS positive, p{names.index('negative')} AS negative,
                  p{names.index('neutral')} AS neutral,
                  CASE WHEN p0 >= p1 AND p0 >= p2 THEN {lit(names[0])}
                       WHEN p1 >= p2 THEN {lit(names[1])} ELSE {lit(names[2])} END AS label
           FROM {name}_p)"""


def expected_cte() -> str:
    return ("expected AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'positive' "
            "WHEN quality = 0 THEN 'negative' END AS expected FROM labels)")


ROUND3 = ", ".join(r6(c, c) for c in CLASSES)


# --------------------------------------------------------------------------
# scoring and the flagship


@sql("m1_lexicon_scores")
def _m1():
    return model_a() + f"\nSELECT doc_id, {ROUND3}, {r6('compound', 'compound')}, label FROM a_labelled"


@sql("m1_large_lexicon")
def _m1_large():
    base = f"""WITH t AS (SELECT doc_id, {tokens_sql(clean_sql("text"))} AS toks FROM documents),
lx AS (SELECT token, (length(token) % 9 - 4) / 2.0 AS valence FROM (SELECT DISTINCT unnest(toks) AS token FROM t))"""
    return base + lexicon_score_sql("t", "doc_id", "lx", P.QUERY_NEGATORS, P.QUERY_DEGREE, P.NEGATION_FACTOR, P.ALPHA, ns="a") + \
        f"\nSELECT doc_id, {ROUND3}, {r6('compound', 'compound')}, label FROM a_labelled"


@sql("a1_mean_by_company")
def _a1():
    means = ", ".join(r6(f"avg({c})", c) for c in CLASSES)
    return model_a(("source",)) + f"""
SELECT source AS company, {means}, CAST(count(*) AS BIGINT) AS n_rows FROM a_labelled GROUP BY source"""


@sql("m2_model_scores")
def _m2():
    return "WITH " + keyword_cte() + f"\nSELECT doc_id, {ROUND3}, label FROM kw"


@sql("m4_compare_models")
def _m4():
    return (model_a() + ", " + keyword_cte() + f"""
SELECT doc_id, 'lexicon' AS model, {ROUND3}, label FROM a_labelled
UNION ALL
SELECT doc_id, 'keyword' AS model, {ROUND3}, label FROM kw""")


@sql("m8_side_by_side")
def _m8():
    cols = ", ".join(r6(f"w.{m}_{c}", f"{m}_{c}") for m in ("a", "b") for c in CLASSES)
    kcols = ", ".join(r6(f"k.{c}", f"k_{c}") for c in CLASSES)
    return (two_models() + ", " + keyword_cte("k0") + f"""
SELECT w.doc_id, {cols}, w.a_label, w.b_label, {kcols}, k.label AS k_label
FROM wide w JOIN k0 k ON w.doc_id = k.doc_id""")


@sql("m8_distribution")
def _m8_distribution():
    return model_a() + f"""
SELECT label, count(*)::BIGINT AS n, {r6("100.0 * count(*) / sum(count(*)) OVER ()", "pct")} FROM a_labelled GROUP BY label"""


@sql("m8_agreement")
def _m8_agreement():
    pct = r6("100.0 * count(*) FILTER (a_label = label) / count(*)", "agreement_pct")
    return two_models() + ", " + keyword_cte("k0") + f""", pairs AS (
  SELECT 'b' AS model, a_label, b_label AS label FROM wide
  UNION ALL SELECT 'k', a_label, label FROM wide JOIN k0 USING (doc_id))
SELECT model, {pct}, count(*)::BIGINT AS n_rows FROM pairs GROUP BY model"""


@sql("m8_examples")
def _m8_examples():
    clean = clean_sql("text")
    return model_a() + f""", ranked AS (
  SELECT doc_id, label, positive, row_number() OVER (PARTITION BY label ORDER BY md5('{P.SEED}:' || doc_id), doc_id) AS rk FROM a_labelled)
SELECT r.doc_id, r.label AS a_label, printf('%.4f', r.positive) AS a_positive, substr({clean}, 1, 100) || '...' AS preview
FROM ranked r JOIN documents d ON d.doc_id = r.doc_id
WHERE rk <= {P.SAMPLE_EXAMPLES} // (SELECT count(DISTINCT label) FROM a_labelled)"""


def _scored(table: str, keys: str) -> str:
    """CTEs and columns of model A over a table with the given key columns."""
    toks = stop_filter_sql(tokens_sql(clean_sql("text")))
    names = [k.strip() for k in keys.split(",")]
    cols = ", ".join(r6(c, f"sentiment_{c}") for c in CLASSES)
    return (f"WITH tm AS (SELECT {keys}, {toks} AS toks FROM {table})" + model("m", "tm", names if len(names) > 1 else keys)
            + f"\nSELECT {keys}, {cols}, label AS sentiment_label FROM m_labelled")


@sql("m3_score_documents")
def _m3_documents():
    return _scored("documents", "doc_id")


@sql("m3_score_conversations")
def _m3_conversations():
    return _scored("conversations", "conv_id, turn")


@sql("m9_score_if_needed")
def _m9():
    return _scored("documents", "doc_id")


@sql("m5_scorer_by_name")
def _m5():
    return ORACLE["m4_compare_models"]


@sql("m10_company_pipeline")
def _m10():
    toks = stop_filter_sql(tokens_sql(clean_sql("text")))
    means = ", ".join(r6(f"avg({c})", c) for c in CLASSES)
    return (f"""WITH both_src AS (
  SELECT doc_id AS item_id, CAST(0 AS BIGINT) AS turn, 'news' AS source_type, source AS company, text
  FROM documents
  UNION ALL
  SELECT conv_id, turn, 'posts', role, text FROM conversations
), tm AS (SELECT item_id, turn, source_type, company, {toks} AS toks FROM both_src)"""
            + model("m", "tm", ("item_id", "turn", "source_type"), ("company",)) + f"""
SELECT source_type, company, {means}, CAST(count(*) AS BIGINT) AS n_rows
FROM m_labelled GROUP BY source_type, company""")


@sql("m10_collected")
def _m10_collected():
    toks = stop_filter_sql(tokens_sql(clean_sql("text")))
    words = "' ' || array_to_string(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' '"
    comp = values_sql(P.PHRASES, ["VARCHAR", "VARCHAR"], ["company", "term"], "c")
    return (f"""WITH dated AS (
  SELECT doc_id, text, DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS day, {words.format("text")} AS words FROM documents),
named AS (
  SELECT DISTINCT c.company, d.doc_id, d.text, d.day FROM dated d JOIN {comp} ON contains(d.words, {words.format("c.term")})
  WHERE d.day BETWEEN DATE '{P.AS_OF}' - {P.LOOKBACK_DAYS} AND DATE '{P.AS_OF}'),
first AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY company ORDER BY day DESC, md5(text), text) <= {P.TOP_PER_COMPANY}),
tm AS (SELECT company, doc_id, strftime(day, '%Y-%m-%d') AS day, md5(text) AS text_md5, {toks} AS toks FROM first)"""
            + model("m", "tm", ("company", "doc_id"), ("day", "text_md5")) + f"""
SELECT company, day, text_md5, {ROUND3}, label FROM m_labelled""")


# --------------------------------------------------------------------------
# text functions


@sql("t1_collapse_whitespace")
def _t1():
    return f"SELECT doc_id, {collapse_sql('text')} AS text FROM documents"


@sql("t2_url_domain")
def _t2():
    return f"SELECT page_id, {domain_sql('url')} AS domain FROM pages"


@sql("t6_clean_text")
def _t6():
    return f"SELECT doc_id, {clean_sql('text')} AS clean_text FROM documents"


@sql("t7_raw_tokens")
def _t7_raw():
    from polarity.operators.sentences import ENDINGS, WORD
    t = """'"It''s ' || text || ' isn''t" 1,000.5'"""
    for pattern, new in ((r'(^|[ \t\n\r(\[{<])"', r"\1`` "), ('"', " '' "), (r"(?i)([a-z])(n't)\b", r"\1 \2"), (r"(?i)([a-z])" + ENDINGS + r"\b", r"\1 '\2")):
        t = f"regexp_replace({t}, {lit(pattern)}, {lit(new)}, 'g')"
    return f"""SELECT doc_id, len(w)::BIGINT AS n_words, md5(array_to_string(w, chr(10))) AS words_md5
FROM (SELECT doc_id, regexp_extract_all({t}, {lit("(?i)" + WORD)}) AS w FROM documents)"""


@sql("t7_sentences")
def _t7_sentences():
    from polarity.operators.sentences import BLANKS, LONGEST, OFTEN, SHARE
    run = r"([\p{L}\p{N}]+(?:\.[\p{L}\p{N}]+)*)"
    end = r"[,;:)\]'\"]*$"
    return f"""WITH w AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, {lit(BLANKS)}), lambda x: x <> '') AS ws FROM documents)),
known AS (
  SELECT token FROM (SELECT lower(regexp_extract(w, {lit(run + r"\.?" + end)}, 1)) AS token, regexp_matches(w, {lit(r"[\p{L}\p{N}]\." + end)}) AS point FROM w)
  WHERE token <> '' AND length(token) <= {LONGEST} GROUP BY token
  HAVING count(CASE WHEN point THEN 1 END) >= {OFTEN} AND 100 * count(CASE WHEN point THEN 1 END) >= {SHARE} * count(*)),
c AS (SELECT *, rtrim(w, '"'')]}}') AS x, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM w),
b AS (
  SELECT *, regexp_matches(x, '[.!?]$') AND nxt IS NOT NULL AND NOT regexp_matches(nxt, '^\\p{{Ll}}') AS may,
    CASE WHEN regexp_matches(x, '(^|[^.])[.]$') THEN lower(regexp_extract(x[:-2], {lit(run + "$")}, 1)) ELSE '' END AS base FROM c),
e AS (
  SELECT b.*, may AND known.token IS NULL AND NOT regexp_matches(base, '^\\p{{L}}$') AS ends FROM b LEFT JOIN known ON known.token = b.base),
s AS (SELECT doc_id, i, w, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM e),
t AS (SELECT doc_id, s, string_agg(w, ' ' ORDER BY i) AS sentence FROM s GROUP BY doc_id, s)
SELECT d.doc_id, count(sentence)::BIGINT AS n_sentences, md5(coalesce(string_agg(sentence, chr(10) ORDER BY s), '')) AS sentences_md5
FROM documents d LEFT JOIN t USING (doc_id) GROUP BY d.doc_id"""


@sql("t8_processed_text")
def _t8():
    return f"SELECT doc_id, array_to_string({stop_filter_sql(tokens_sql(clean_sql('text')))}, ' ') " \
           f"AS processed_text FROM documents"


@sql("t8_custom_stopwords")
def _t8c():
    toks = stop_filter_sql(tokens_sql(clean_sql("text")), P.CUSTOM_STOPWORDS)
    return f"SELECT doc_id, array_to_string({toks}, ' ') AS processed_text FROM documents"


@sql("t9_lemmatize")
def _t9():
    toks = stop_filter_sql(tokens_sql(clean_sql("text")))
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in P.QUERY_LEMMAS)
    lem = f"coalesce(CASE x {whens} END, x)"
    return (f"SELECT doc_id, array_to_string(list_transform({toks}, lambda x: {lem}), ' ') "
            f"AS lemmatized_text FROM documents")


@sql("t9_rule_lemmas")
def _t9_rules():
    from polarity import resources
    from polarity.operators.rule_lemmas import KEPT, LEAST_BASE, RULES
    order = sorted(range(len(RULES)), key=lambda i: (-len(RULES[i][0]), i))
    rules = values_sql([(*RULES[i], rank) for rank, i in enumerate(order)], ["VARCHAR", "VARCHAR", "INTEGER"], ["ending", "new", "rank"], "r")
    kept = " OR ".join(f"ends_with(token, {lit(k)})" for k in KEPT)
    toks = stop_filter_sql(tokens_sql(clean_sql("text")), resources.english_stopwords())
    return f"""WITH t AS (SELECT doc_id, {toks} AS toks FROM documents),
e AS (SELECT doc_id, unnest(toks) AS token, unnest(range(len(toks))) AS i FROM t),
v AS (SELECT DISTINCT token FROM e),
c AS (SELECT token, token[:length(token) - length(ending)] || new AS base, rank FROM v JOIN {rules} ON ends_with(token, ending) WHERE NOT ({kept})),
lemma AS (SELECT c.token, arg_min(base, rank) AS lemma FROM c JOIN v ON v.token = c.base WHERE length(base) >= {LEAST_BASE} GROUP BY c.token)
SELECT t.doc_id, md5(coalesce(string_agg(coalesce(lemma, e.token), ' ' ORDER BY i), '')) AS lemmas_md5, count(e.token)::BIGINT AS n_tokens
FROM t LEFT JOIN e ON e.doc_id = t.doc_id LEFT JOIN lemma ON lemma.token = e.token GROUP BY t.doc_id"""


@sql("t14_softmax_logits")
def _t14():
    return f"""WITH l AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS logit, unnest(range(len(embedding))) AS class FROM embeddings
), m AS (SELECT vec_id, max(logit) AS top FROM l GROUP BY vec_id),
e AS (SELECT vec_id, class, exp(logit - top) AS e FROM l JOIN m USING (vec_id)),
p AS (SELECT vec_id, class, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e)
SELECT vec_id, {r6('max(p)', 'top')}, (min_by(class, (-p, class)))::VARCHAR AS label, {r6('sum(p * p)', 'sum_of_squares')}
FROM p GROUP BY vec_id"""


@sql("t15_truncate_tokens")
def _t15():
    toks = tokens_sql(clean_sql("text"))
    return f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens,
  array_to_string(t[1:{P.MAX_TOKENS}], ' ') AS truncated_text
FROM (SELECT doc_id, {toks} AS t FROM documents)"""


@sql("t16_label_codec")
def _t16():
    names = P.TRAIN_LABELS
    dec = " ".join(f"WHEN {i} THEN {lit(n)}" for i, n in enumerate(names))
    enc = " ".join(f"WHEN {lit(n)} THEN {i}" for i, n in enumerate(names))
    return f"""SELECT doc_id, label_name, CAST(CASE label_name {enc} END AS BIGINT) AS label_id
FROM (SELECT doc_id, CASE quality * 2 {dec} END AS label_name FROM labels)"""


@sql("s1_normalise_articles")
def _s1():
    return """WITH a AS (
  SELECT doc_id, split_part(text, chr(10), 1) AS title,
         NULLIF(substr(text, length(split_part(text, chr(10), 1)) + 2), '') AS description,
         DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS published
  FROM documents
)
SELECT doc_id, md5(title || '. ' || coalesce(description, '')) AS text_md5,
       strftime(published, '%Y-%m-%d') AS date FROM a"""


@sql("p7_preview")
def _p7():
    return model_a() + """
SELECT d.doc_id, substr(d.text, 1, 100) || '...' AS preview, round(a.positive, 6) AS positive, a.label
FROM documents d JOIN a_labelled a ON d.doc_id = a.doc_id"""


# --------------------------------------------------------------------------
# aggregations


@sql("a2_mean_by_source_type")
def _a2():
    toks = stop_filter_sql(tokens_sql(clean_sql("text")))
    means = ", ".join(r6(f"avg({c})", c) for c in CLASSES)
    return (f"WITH tc AS (SELECT conv_id, turn, role, {toks} AS toks FROM conversations)"
            + model("c", "tc", ("conv_id", "turn"), ("role",)) + f"""
SELECT role AS source_type, {means}, CAST(count(*) AS BIGINT) AS n_rows FROM c_labelled GROUP BY role""")


@sql("a3_overall_mean")
def _a3():
    return model_a() + "\nSELECT round(avg(positive), 6) AS mean_positive FROM a_labelled"


@sql("a4_label_distribution")
def _a4():
    return model_a() + """
SELECT label, n, round(100.0 * n / sum(n) OVER (), 6) AS pct
FROM (SELECT label, CAST(count(*) AS BIGINT) AS n FROM a_labelled WHERE label IS NOT NULL GROUP BY label)"""


@sql("a5_agreement")
def _a5():
    return two_models(("lang",)) + """
SELECT lang, round(100.0 * avg(CASE WHEN a_label = b_label THEN 1.0 ELSE 0.0 END), 6) AS agreement_pct,
       CAST(count(*) AS BIGINT) AS n_rows
FROM wide GROUP BY lang"""


@sql("a6_accuracy")
def _a6():
    return model_a() + ", " + expected_cte() + """, j AS (
  SELECT a.label, e.expected FROM a_labelled a JOIN expected e ON a.doc_id = e.doc_id
  WHERE e.expected IN ('positive', 'negative')
), g AS (
  SELECT expected, CAST(count(*) AS BIGINT) AS n,
         CAST(sum(CASE WHEN label = expected THEN 1 ELSE 0 END) AS BIGINT) AS correct
  FROM j GROUP BY expected
  UNION ALL
  SELECT '__all__', CAST(count(*) AS BIGINT), CAST(sum(CASE WHEN label = expected THEN 1 ELSE 0 END) AS BIGINT)
  FROM j
)
SELECT expected, n, correct, round(correct / n, 6) AS accuracy FROM g"""


@sql("a7_classification_metrics")
def _a7():
    return model_a() + ", " + expected_cte() + """, cm AS (
  SELECT e.expected AS y, a.label AS p, count(*) AS n
  FROM a_labelled a JOIN expected e ON a.doc_id = e.doc_id GROUP BY 1, 2
), sup AS (SELECT y AS cls, sum(n) AS support FROM cm GROUP BY y),
pred AS (SELECT p AS cls, sum(n) AS predicted FROM cm GROUP BY p),
tp AS (SELECT y AS cls, n AS tp FROM cm WHERE y = p),
per AS (
  SELECT coalesce(s.cls, q.cls) AS cls, coalesce(s.support, 0) AS support,
         coalesce(q.predicted, 0) AS predicted, coalesce(t.tp, 0) AS tp
  FROM sup s FULL JOIN pred q ON s.cls = q.cls LEFT JOIN tp t ON coalesce(s.cls, q.cls) = t.cls
), m AS (
  SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS pr,
            CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM per
), f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM m)
SELECT round(sum(tp) / sum(support), 6) AS accuracy,
       round(sum(pr * support) / sum(support), 6) AS precision,
       round(sum(rc * support) / sum(support), 6) AS recall,
       round(sum(f1 * support) / sum(support), 6) AS f1,
       CAST(sum(support) AS BIGINT) AS n_rows
FROM f"""


@sql("a8_correlation")
def _a8():
    return two_models(("lang",)) + """
SELECT lang, round(corr(a_positive, b_positive), 6) AS pearson FROM wide GROUP BY lang"""


@sql("a9_mean_matrix")
def _a9():
    return model_a(("source", "lang")) + """
SELECT source, lang, round(avg(positive), 6) AS mean_value FROM a_labelled
WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang"""


@sql("a10_entity_matrix")
def _a10():
    parts = " UNION ALL ".join(f"SELECT company, '{c}' AS measure, {c} AS value FROM means" for c in CLASSES)
    means = ", ".join(r6(f"avg({c})", c) for c in CLASSES)
    return model_a(("source",)) + f""", means AS (
  SELECT source AS company, {means} FROM a_labelled GROUP BY source
)
{parts}"""


@sql("a11_box_stats")
def _a11():
    long = " UNION ALL ".join(f"SELECT label, '{c}' AS score_type, {c} AS score FROM a_labelled"
                              for c in CLASSES)
    return model_a() + f""", long AS ({long}),
st AS (
  SELECT score_type, label, CAST(count(*) AS BIGINT) AS n,
         quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median,
         quantile_cont(score, 0.75) AS q3
  FROM long WHERE score IS NOT NULL GROUP BY score_type, label
), w AS (
  SELECT l.score_type, l.label,
    min(CASE WHEN l.score BETWEEN s.q1 - 1.5 * (s.q3 - s.q1) AND s.q3 + 1.5 * (s.q3 - s.q1) THEN l.score END) AS lo,
    max(CASE WHEN l.score BETWEEN s.q1 - 1.5 * (s.q3 - s.q1) AND s.q3 + 1.5 * (s.q3 - s.q1) THEN l.score END) AS hi,
    CAST(count(CASE WHEN NOT (l.score BETWEEN s.q1 - 1.5 * (s.q3 - s.q1) AND s.q3 + 1.5 * (s.q3 - s.q1))
                    THEN 1 END) AS BIGINT) AS n_outliers
  FROM long l JOIN st s ON l.score_type = s.score_type AND l.label = s.label
  WHERE l.score IS NOT NULL
  GROUP BY l.score_type, l.label
)
SELECT s.score_type, s.label, s.n, round(s.q1, 6) AS q1, round(s.median, 6) AS median, round(s.q3, 6) AS q3,
       round(w.lo, 6) AS whisker_low, round(w.hi, 6) AS whisker_high, w.n_outliers
FROM st s LEFT JOIN w ON s.score_type = w.score_type AND s.label = w.label"""


@sql("a11_box_stats_balanced")
def _a11b():
    return _a11()


@sql("a12_distinct_labels")
def _a12():
    return model_a() + "\nSELECT DISTINCT label FROM a_labelled"


@sql("a13_row_counts")
def _a13():
    return "SELECT source, lang, CAST(count(*) AS BIGINT) AS n_rows FROM documents GROUP BY source, lang"


@sql("a14_confidence")
def _a14():
    return model_a() + """
SELECT label, round(avg(greatest(positive, negative, neutral)), 6) AS mean_confidence,
       round(min(greatest(positive, negative, neutral)), 6) AS min_confidence,
       CAST(count(*) AS BIGINT) AS n_rows
FROM a_labelled GROUP BY label"""


# --------------------------------------------------------------------------
# windows, top-k, samples


_W1 = f"""SELECT event_id, user_id,
  round(CASE WHEN count(value) OVER w = {P.ROLLING_ROWS} THEN avg(value) OVER w END, 6) AS value_rolling
FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {P.ROLLING_ROWS - 1} PRECEDING AND CURRENT ROW)"""


@sql("w1_rolling_mean")
def _w1():
    return _W1


@sql("w1_rolling_mean_balanced")
def _w1b():
    return _W1


@sql("w2_daily_rolling")
def _w2():
    n = P.ROLLING_DAYS
    return f"""WITH d AS (
  SELECT event_type, CAST(ts AS DATE) AS date, avg(value) AS value, CAST(count(*) AS BIGINT) AS n_rows
  FROM events GROUP BY event_type, CAST(ts AS DATE)
)
SELECT event_type, strftime(date, '%Y-%m-%d') AS date, round(value, 6) AS value, n_rows,
  round(CASE WHEN count(value) OVER w = {n} THEN avg(value) OVER w END, 6) AS value_rolling
FROM d WINDOW w AS (PARTITION BY event_type ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"""


@sql("w2_incremental")
def _w2_incremental():
    return ORACLE["w2_daily_rolling"].replace("CAST(count(*) AS BIGINT) AS n_rows", "CAST(count(value) AS BIGINT) AS n_rows")


@sql("a11_quantile_states")
def _a11_states():
    return """SELECT event_type, count(value)::BIGINT AS n, true AS q1_within_1_percent, true AS median_within_1_percent, true AS q3_within_1_percent
FROM events WHERE value IS NOT NULL GROUP BY event_type"""


@sql("l1_first_k_per_company")
def _l1():
    return f"""SELECT doc_id, company, position FROM (
  SELECT doc_id, source AS company,
         CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS position
  FROM documents) WHERE position <= {P.TOP_PER_COMPANY}"""


@sql("l2_top_disagreements")
def _l2():
    sev = " + ".join(f"abs(a_{c} - b_{c})" for c in CLASSES)
    return two_models() + f"""
SELECT doc_id, a_label, b_label, round(round({sev}, 9), 6) AS disagreement_score
FROM wide WHERE a_label IS DISTINCT FROM b_label
ORDER BY round({sev}, 9) DESC, doc_id LIMIT {P.TOP_DISAGREEMENTS}"""


@sql("p5_disagreements")
def _p5():
    return two_models() + "\nSELECT doc_id, a_label, b_label FROM wide WHERE a_label IS DISTINCT FROM b_label"


@sql("l3_stratified_sample")
def _l3():
    n = P.SAMPLE_EXAMPLES
    h = f"md5('{P.SEED}:' || CAST(doc_id AS VARCHAR))"
    return model_a() + f""", k AS (
  SELECT CAST(floor({n} / (count(DISTINCT label) + max(CASE WHEN label IS NULL THEN 1 ELSE 0 END))) AS BIGINT) AS k,
         count(DISTINCT label) AS named FROM a_labelled
), ranked AS (
  SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {h}, doc_id) AS rk
  FROM a_labelled WHERE label IS NOT NULL
)
SELECT doc_id, label FROM ranked, k WHERE rk <= k.k
UNION ALL
SELECT doc_id, label FROM (
  SELECT doc_id, label FROM a_labelled, k WHERE k.k = 0 OR k.named = 0 ORDER BY {h}, doc_id LIMIT {n})"""


@sql("l4_stratified_split")
def _l4():
    h = f"md5('{P.SEED}:' || CAST(doc_id AS VARCHAR))"
    return f"""SELECT doc_id, quality,
  CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY {h}, doc_id)
            <= floor(count(*) OVER (PARTITION BY quality) * 0.2 + 0.5) THEN 'val' ELSE 'train' END AS split
FROM labels"""


@sql("m6_epochs")
def _m6_epochs():
    h = f"md5('{P.SEED}:' || CAST(doc_id AS VARCHAR))"
    return f"""SELECT split, label, count(*)::BIGINT AS n_rows, count(*)::BIGINT AS n_same_after_reload, true AS epochs_follow_the_rules, true AS all_scores_in_range
FROM (
  SELECT quality * 2 AS label, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY {h}, doc_id)
    <= floor(count(*) OVER (PARTITION BY quality) * 0.2 + 0.5) THEN 'val' ELSE 'train' END AS split
  FROM labels JOIN documents USING (doc_id))
GROUP BY split, label"""


@sql("l5_sort_by_date")
def _l5():
    return """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts_text,
  CAST(strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS TIMESTAMP) AS ts_parsed
FROM events ORDER BY ts_parsed, event_id"""


# --------------------------------------------------------------------------
# reshape, joins, sources


@sql("u1_union_sources")
def _u1():
    return """SELECT 'news' AS source_type, doc_id AS item_id, CAST(NULL AS VARCHAR) AS turn, source,
       CAST(NULL AS VARCHAR) AS role, md5(text) AS text_md5 FROM documents
UNION ALL
SELECT 'posts', conv_id, CAST(turn AS VARCHAR), CAST(NULL AS VARCHAR), role, md5(text) FROM conversations"""


@sql("u3_melt_scores")
def _u3():
    parts = " UNION ALL ".join(
        f"SELECT doc_id, round({c}, 6) AS score, '{c}' AS score_type, 'sentiment' AS model FROM a_labelled"
        for c in CLASSES)
    return model_a() + "\n" + parts


@sql("j1_author_lookup")
def _j1():
    return """WITH c AS (
  SELECT c_custkey, arg_min(c_name, c_name) AS c_name, arg_min(c_mktsegment, c_name) AS c_mktsegment
  FROM customer GROUP BY c_custkey
)
SELECT e.event_id, e.user_id, c.c_name AS username, c.c_mktsegment
FROM events e LEFT JOIN c ON e.user_id = c.c_custkey"""


def _drop_element(expr: str, tag: str) -> str:
    return f"regexp_replace({expr}, '(?s)<{tag}\\b[^>]*>.*?</{tag}>', '', 'g')"


@sql("s3_csv_round_trip")
def _s3():
    return "SELECT doc_id, md5(text) AS text_md5, source FROM documents"


@sql("s3_csv_split")
def _s3_split():
    return """SELECT doc_id, md5('"' || replace(text, '. ', '.' || chr(10) || '"" ,"') || '"') AS text_md5, source FROM documents"""


@sql("s5_page_articles")
def _s5():
    body = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "nav", "header", "footer", "iframe"):
        body = _drop_element(body, tag)
    art = f"regexp_extract({body}, '(?s)<article\\b[^>]*>(.*?)</article>', 1)"

    def text_of(x: str) -> str:
        x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
        x = f"replace(replace({x}, '&quot;', '\"'), '&amp;', '&')"
        return collapse_sql(x)

    title = "regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)"
    return f"SELECT page_id, {domain_sql('url')} AS domain, {text_of(title)} AS title, " \
           f"{text_of(art)} AS text FROM pages"


def _mentions(companies, where: str = "true") -> str:
    comp = values_sql(companies, ["VARCHAR", "VARCHAR"], ["company", "term"], "c")
    words = "array_to_string(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), ' ')"
    return f"""SELECT DISTINCT t.doc_id, c.company
FROM (SELECT doc_id, ' ' || {words.format("text")} || ' ' AS words FROM documents WHERE {where}) t
JOIN {comp} ON contains(t.words, ' ' || {words.format("c.term")} || ' ')"""


@sql("s7_mentions")
def _s7():
    return _mentions(P.COMPANIES, "lang = 'en'")


@sql("s7_mentions_phrases")
def _s7_phrases():
    return _mentions(P.PHRASES)


@sql("s7_many_companies")
def _s7_many():
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
terms AS (
  SELECT company, term FROM (SELECT DISTINCT w[i] AS company, w[i] || ' ' || w[i + 1] AS term FROM (SELECT w, unnest(range(1, len(w), {P.TERM_STEP})) AS i FROM w))
  ORDER BY md5(term), term LIMIT {P.COMPANY_TERMS}),
pairs AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS term FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w)),
found AS (SELECT DISTINCT doc_id, company FROM pairs JOIN terms USING (term))
SELECT company, count(*)::BIGINT AS n_docs, min(doc_id)::BIGINT AS first_doc, sum(doc_id)::BIGINT AS doc_sum FROM found GROUP BY company"""


_ARTICLES = """a AS (
  SELECT source AS company, doc_id // 40 AS page, doc_id, 'https://news.example/' || doc_id AS url,
    split_part(text, chr(10), 1) || '. ' AS text,
    CASE WHEN doc_id % 11 <> 0 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER), '%Y-%m-%d') END AS date,
    row_number() OVER (PARTITION BY source, doc_id // 40 ORDER BY doc_id) AS position FROM documents)"""


@sql("s1_articles")
def _s1_articles():
    return f"""WITH {_ARTICLES}
SELECT company, url, 'news.example' AS domain, 'news' AS source_type, position, md5(text) AS text_md5, date FROM a WHERE page % 7 <> 6"""


@sql("s1_rejected_responses")
def _s1_rejected():
    return f"""WITH {_ARTICLES}
SELECT company, count(DISTINCT page)::BIGINT AS n_rejected, count(*)::BIGINT AS n_articles FROM a WHERE page % 7 = 6 GROUP BY company"""


@sql("s2_posts")
def _s2_posts():
    import datetime as dt
    first = dt.date.fromisoformat(P.AS_OF) - dt.timedelta(days=P.LOOKBACK_DAYS)
    return f"""WITH c AS (SELECT *, DATE '2024-01-01' + CAST(conv_id % 28 AS INTEGER) AS day FROM conversations)
SELECT conv_id * 1000 + turn AS id, md5(text) AS content_md5, strftime(day, '%Y-%m-%d') AS date, 'twitter' AS source, role AS company
FROM c WHERE conv_id % 3 <> 0 AND (conv_id + turn) % 10 <> 0 AND text NOT LIKE 'RT @%' AND day BETWEEN DATE '{first}' AND DATE '{P.AS_OF}'"""


@sql("s6_page_rejects")
def _s6():
    return """SELECT CASE WHEN page_id % 9 = 0 OR html IS NULL THEN 'missing html' ELSE 'none' END AS error,
count(*)::BIGINT AS n_pages, min(page_id) AS first_page FROM pages GROUP BY 1"""


@sql("p1_normalised_posts")
def _p1():
    return "SELECT conv_id * 1000 + turn AS id, md5(text) AS content_md5, '2024-01-30' AS date, 'twitter' AS source, role AS company FROM conversations"


@sql("p2_expected_columns")
def _p2():
    return "SELECT doc_id, md5(text) AS text_md5, '' AS url, '' AS domain, '' AS title, '' AS date FROM documents"


@sql("p3_run_constants")
def _p3():
    return f"SELECT doc_id, 'ACME' AS company, '{P.AS_OF}' AS run_date FROM labels"


@sql("p6_paste_scores")
def _p6():
    cols = ", ".join(r6(f"{m}_{c}", f"{m}_{c}") for m in ("a", "b") for c in CLASSES)
    return two_models() + f"\nSELECT doc_id, {cols}, a_label, b_label FROM wide"


@sql("u2_union_all")
def _u2():
    return """SELECT lang, count(*)::BIGINT AS n, count(CASE WHEN lang = 'en' THEN source END)::BIGINT AS n_source,
count(CASE WHEN lang = 'fr' THEN n_chars END)::BIGINT AS n_n_chars FROM documents GROUP BY lang"""


@sql("s3_csv_edge_texts")
def _s3_edges():
    return """SELECT doc_id, md5(CASE doc_id % 5 WHEN 0 THEN '  ' || text || ' ' || chr(9) || ' ' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE text END) AS text_md5
FROM documents"""


@sql("w1_rolling_mean_null_entity")
def _w1_null():
    w = f"OVER (PARTITION BY nullif(user_id, {P.NULLED_USER}) ORDER BY ts, event_id ROWS BETWEEN {P.ROLLING_ROWS - 1} PRECEDING AND CURRENT ROW)"
    return f"SELECT event_id, CASE WHEN count(value) {w} = {P.ROLLING_ROWS} THEN {r6(f'avg(value) {w}', 'x').rsplit(' AS ', 1)[0]} END AS value_rolling FROM events"


@sql("s8_lookback")
def _s8():
    import datetime as dt
    end = dt.date.fromisoformat(P.AS_OF) + dt.timedelta(days=1)
    start = dt.date.fromisoformat(P.AS_OF) - dt.timedelta(days=P.LOOKBACK_DAYS)
    return f"""SELECT event_id, user_id, event_type FROM events
WHERE ts >= TIMESTAMP '{start} 00:00:00' AND ts < TIMESTAMP '{end} 00:00:00'"""


@sql("s8_overlapping_polls")
def _s8_polls():
    return """SELECT doc_id, md5(text) AS text_md5, 'new' AS kind, 1::BIGINT AS n FROM documents
UNION ALL SELECT doc_id, md5(text), 'late', 2 FROM documents WHERE doc_id % 30 <= 1"""


@sql("s9_url_list")
def _s9():
    return f"""SELECT company, position, url FROM (
  SELECT regexp_extract(url, '^[A-Za-z]+://[^/]+/([a-z]{{2}})/', 1) AS company, page_id AS position, url,
         row_number() OVER (PARTITION BY regexp_extract(url, '^[A-Za-z]+://[^/]+/([a-z]{{2}})/', 1)
                            ORDER BY page_id) AS rk
  FROM pages WHERE coalesce(url, '') <> '') WHERE rk <= {P.TOP_PER_COMPANY}"""


@sql("p4_filter_label")
def _p4():
    return model_a(("source",)) + \
        "\nSELECT doc_id, source, round(positive, 6) AS positive FROM a_labelled WHERE label = 'positive'"


@sql("t11_preprocess_lemmatized")
def _t11():
    toks = stop_filter_sql(tokens_sql(clean_sql("text")), P.CUSTOM_STOPWORDS)
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in P.QUERY_LEMMAS)
    return (f"SELECT doc_id, array_to_string(list_transform({toks}, lambda x: coalesce(CASE x {whens} END, x)), ' ') "
            f"AS processed_text FROM documents")


@sql("t12_finance_stopwords")
def _t12():
    from polarity import resources
    words = list(resources.english_stopwords()) + [w for w in P.EXTRA_STOPWORDS if w not in resources.english_stopwords()]
    toks = stop_filter_sql(tokens_sql(clean_sql("text")), words)
    return f"SELECT doc_id, array_to_string({toks}, ' ') AS processed_text FROM documents"
