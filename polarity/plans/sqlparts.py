"""SQL (DuckDB dialect) forms of the text rules, for the oracle queries.

They are written from the same rule constants as the Spark expressions, but
compute independently (DuckDB's RE2 and list functions).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from polarity import resources
from polarity.functions.text import DIGITS, NETLOC, PUNCT
from polarity.functions.text import EMAIL_SQL as EMAIL
from polarity.functions.text import SPACE_SQL as SPACE
from polarity.functions.text import URL_SQL as URL


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(words: Iterable[str]) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def clean_sql(expr: str) -> str:
    """T6 in SQL."""
    t = f"lower(coalesce({expr}, ''))"
    t = f"regexp_replace({t}, {lit(URL)}, '', 'g')"
    t = f"regexp_replace({t}, {lit(EMAIL)}, '', 'g')"
    t = f"regexp_replace({t}, {lit(PUNCT)}, ' ', 'g')"
    t = f"regexp_replace({t}, {lit(DIGITS)}, '', 'g')"
    t = f"regexp_replace({t}, {lit(SPACE + '+')}, ' ', 'g')"
    return f"trim({t})"


def collapse_sql(expr: str) -> str:
    """T1 in SQL."""
    return f"trim(regexp_replace(coalesce({expr}, ''), {lit(SPACE + '+')}, ' ', 'g'))"


def domain_sql(expr: str) -> str:
    """T2 in SQL."""
    return f"coalesce(regexp_extract({expr}, {lit(NETLOC)}, 1), '')"


def tokens_sql(cleaned: str) -> str:
    """T7 in SQL (on cleaned text)."""
    return f"list_filter(string_split({cleaned}, ' '), lambda x: x <> '')"


def stop_filter_sql(tokens: str, stop: Sequence[str] | None = None) -> str:
    """T8 in SQL (token list)."""
    words = list(resources.english_stopwords() if stop is None else stop)
    return f"list_filter({tokens}, lambda x: NOT list_contains({str_list(words)}, x))"


def processed_sql(expr: str, stop: Sequence[str] | None = None) -> str:
    """T10/T11 (clean + stop words) in SQL, as text."""
    return f"array_to_string({stop_filter_sql(tokens_sql(clean_sql(expr)), stop)}, ' ')"


def values_sql(rows: Sequence[tuple], types: Sequence[str], names: Sequence[str],
               alias: str = "v") -> str:
    def one(v, t):
        if v is None:
            return f"CAST(NULL AS {t})"
        if isinstance(v, str):
            return f"CAST({lit(v)} AS {t})"
        return f"CAST({v!r} AS {t})"
    body = ", ".join("(" + ", ".join(one(v, t) for v, t in zip(r, types)) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({', '.join(names)})"


def case_map_sql(expr: str, pairs: Sequence[tuple[str, float]], default: str = "0.0") -> str:
    if not pairs:
        return default
    whens = " ".join(f"WHEN {lit(k)} THEN CAST({v!r} AS DOUBLE)" for k, v in pairs)
    return f"coalesce(CASE {expr} {whens} END, {default})"


def lexicon_score_sql(tokens_cte: str, keys, lexicon, negators, degree,
                      negation_factor: float, alpha: float, extra_cols: Sequence[str] = (),
                      ns: str = "") -> str:
    """M1 in SQL over a CTE ``tokens_cte(keys..., toks, extra...)``. Adds CTEs
    ending in ``{ns}_labelled(keys..., extra..., positive, negative, neutral,
    compound, label)``.

    ``lexicon`` are pairs or the name ``lx`` of a CTE (token, valence).
    Formulated differently from the Spark plan: predecessors come from
    ``lag`` over the token position instead of array slices.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    k = ", ".join(keys)
    ex = "".join(f", {c}" for c in extra_cols)
    on = " AND ".join(f"t.{c} = a.{c}" for c in keys)
    negs = str_list(negators) if negators else "[]"
    lag = [f"lag(tok, {i}) OVER (PARTITION BY {k} ORDER BY pos)" for i in (1, 2, 3)]
    neg = " OR ".join(f"coalesce(list_contains({negs}, p{i}), false)" for i in (1, 2, 3))
    deg = " + ".join(case_map_sql(f"p{i}", degree) for i in (1, 2, 3))
    lex = lexicon if isinstance(lexicon, str) else values_sql(lexicon, ["VARCHAR", "DOUBLE"], ["token", "valence"], "lx")
    n = ns + "_"
    return f"""
, {n}e AS (
  SELECT {k}, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM {tokens_cte}
), {n}c AS (
  SELECT {k}, pos, tok, {lag[0]} AS p1, {lag[1]} AS p2, {lag[2]} AS p3 FROM {n}e
), {n}h AS (
  SELECT c.*, lx.valence AS v0, ({deg}) AS dg, ({neg}) AS ng
  FROM {n}c c JOIN {lex} ON c.tok = lx.token
), {n}v AS (
  SELECT {k},
    CASE WHEN ng AND v1 <> 0 THEN v1 * CAST({-float(negation_factor)!r} AS DOUBLE) ELSE v1 END AS v
  FROM (SELECT *, CASE WHEN v0 <> 0 THEN v0 + sign(v0) * dg ELSE v0 END AS v1 FROM {n}h)
), {n}a AS (
  SELECT {k}, sum(v) AS s,
    sum(CASE WHEN v > 0 THEN v + 1 END) AS p,
    sum(CASE WHEN v < 0 THEN 1 - v END) AS n,
    count(CASE WHEN v <> 0 THEN 1 END) AS nz
  FROM {n}v GROUP BY {k}
), {n}s AS (
  SELECT {', '.join('t.' + c for c in keys)}{''.join(f', t.{c}' for c in extra_cols)},
    coalesce(a.s, 0.0) AS s, coalesce(a.p, 0.0) AS p, coalesce(a.n, 0.0) AS n,
    CAST(len(t.toks) - coalesce(a.nz, 0) AS DOUBLE) AS z
  FROM {tokens_cte} t LEFT JOIN {n}a a ON {on}
), {n}scored AS (
  SELECT {k}{ex},
    CASE WHEN p + n + z > 0 THEN p / (p + n + z) ELSE 0.0 END AS positive,
    CASE WHEN p + n + z > 0 THEN n / (p + n + z) ELSE 0.0 END AS negative,
    CASE WHEN p + n + z > 0 THEN z / (p + n + z) ELSE 0.0 END AS neutral,
    s / sqrt(s * s + CAST({float(alpha)!r} AS DOUBLE)) AS compound
  FROM {n}s
), {n}labelled AS (
  SELECT *, CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative'
                 ELSE 'neutral' END AS label
  FROM {n}scored
)"""
