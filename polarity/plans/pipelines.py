"""Pipelines that chain the operators: the company pipeline (M10) and the
side-by-side model dashboard (M8).

Both build one lazy plan. Report tables that all read the scored rows are
computed from a written copy when an output folder is given, so the
scoring runs once (the written table also cuts the lineage).
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polarity.functions.text import preprocess, preview
from polarity.operators import analytics as A
from polarity.operators import ranking as R
from polarity.operators import reshape as U
from polarity.operators import sampling as L
from polarity.operators.scoring import Scorer, create_scorer
from polarity.schemas import SCORE_CLASSES, require_columns
from polarity.sources.automaton import with_companies
from polarity.sources.files import write_csv, write_parquet
from polarity.sources.filters import companies_frame, lookback

SOURCES = ("news", "twitter", "both")


def company_pipeline(news: DataFrame | None = None, posts: DataFrame | None = None,
                     model: str | Scorer | None = None, do_preprocess: bool = True,
                     sources: str = "news", as_of: str | None = None,
                     custom_stopwords: Sequence[str] | None = None,
                     companies: Sequence[tuple[str, str]] | None = None, days: int | None = None,
                     per_company: int | None = None) -> dict[str, DataFrame]:
    """M10 for any number of companies at once (no loop over companies).

    ``news``: normalised articles (``articles()``), ``posts``: normalised
    posts (``posts()``); ``sources`` picks news, twitter or both. The rows
    are united (U1), collected, their text processed (clean + stop words, no
    lemma), scored in the row, given the run date where they have none, and
    averaged per company (A1). Returns ``scored`` and ``means``.

    Collecting, each off unless given: ``companies``, pairs of (company, search
    term), keeps rows whose text holds a term of their company (S7) and names
    the company of rows that come without one; ``days`` keeps rows dated in
    that many days before ``as_of`` (S8); ``per_company`` keeps the newest rows
    of each source type and company (L1).
    """
    if sources not in SOURCES:
        raise ValueError(f"sources must be one of {SOURCES}")
    if days is not None and as_of is None:
        raise ValueError("days needs as_of, the day the window ends")
    frames = {}
    if sources in ("news", "both") and news is not None:
        frames["news"] = news
    if sources in ("twitter", "both") and posts is not None:
        frames["posts"] = posts
    if not frames:
        raise ValueError("no input for the chosen sources")
    both = U.union_sources(frames)
    if companies is not None:
        both = of_companies(both, companies)
    require_columns(both, ["text", "company"])
    if "date" not in both.columns and as_of is not None:
        both = both.withColumn("date", F.lit(as_of).cast("date"))
    if days is not None:
        both = lookback(both, "date", as_of, days)
    if per_company is not None:
        newest = [F.desc("date")] if "date" in both.columns else []
        both = L.first_k_per_group(both, ["source_type", "company"], [*newest, F.md5("text"), "text"], per_company)
    text_col = "text"
    if do_preprocess:
        both = both.withColumn("processed_text", preprocess("text", custom_stopwords=custom_stopwords))
        text_col = "processed_text"
    scorer = model if isinstance(model, Scorer) else create_scorer(model)
    scored = scorer.score(both, text_col)
    return {"scored": scored, "means": A.mean_scores(scored, ["company"])}


def write_company_outputs(results: dict[str, DataFrame], out_dir: str, run_ts: str) -> None:
    """Scored rows per company (one folder per company value) and the
    means, tagged with the run timestamp."""
    scored = results["scored"].withColumn("run_ts", F.lit(run_ts))
    write_csv(scored, os.path.join(out_dir, f"scored_{run_ts}"), partition_by=["company"])
    write_csv(results["means"].withColumn("run_ts", F.lit(run_ts)), os.path.join(out_dir, f"means_{run_ts}"))


def of_companies(df: DataFrame, companies: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows whose text holds a search term of their company, as whole words in
    any case; a row without a company comes out once for each company it mentions."""
    found = with_companies(df, "text", companies_frame(df.sparkSession, companies), found_col="_company")
    if "company" not in df.columns:
        return found.withColumnRenamed("_company", "company")
    return (found.filter(F.col("company").isNull() | (F.col("company") == F.col("_company")))
            .withColumn("company", F.col("_company")).drop("_company"))


def example_table(df: DataFrame, text_col: str, score_cols: Sequence[str], width: int = 100, places: int = 4) -> DataFrame:
    """A preview of the text first, scores as text with fixed places."""
    shown = df.withColumns({c: F.format_string(f"%.{places}f", F.col(c)) for c in score_cols})
    return shown.withColumn("preview", preview(text_col, width))


def dashboard(df: DataFrame, text_col: str, id_col: str, models: dict[str, str | Scorer],
              reference: str | None = None, num_examples: int = 10, seed: int = 42,
              out_dir: str | None = None, num_disagreements: int | None = 5,
              compare: bool = True) -> Mapping[str, DataFrame]:
    """M8: every model's four columns next to the input (``{name}_*``) and
    the report tables over them: label distribution of the reference model
    (A4), box statistics of all scores by the reference label (A11),
    stratified examples (L3), agreement of each model with the reference
    (A5) and the largest disagreements with it (L2).

    The input is read once by the wide table. With ``out_dir`` that table is
    written (parquet) and the reports read it back; all tables are written
    there too. Without it nothing runs here: a report is made when it is first
    asked for, and computes the scores it needs.
    ``compare=False`` reports on the reference model alone;
    ``num_disagreements=None`` lists all disagreements.
    """
    require_columns(df, [text_col, id_col])
    names = list(models)
    reference = reference or names[0]
    wide = df
    for name, m in models.items():  # each scorer adds its columns to the rows
        wide = (m if isinstance(m, Scorer) else create_scorer(m)).score(wide, text_col, id_col, f"{name}_")
    spark = df.sparkSession
    if out_dir:
        path = os.path.join(out_dir, "side_by_side")
        write_parquet(wide, path, mode="overwrite")
        wide = spark.read.parquet(path)
    ref_label = f"{reference}_label"
    names = names if compare else [reference]
    score_cols = [f"{n}_{c}" for n in names for c in SCORE_CLASSES]
    long = U.melt_scores(wide, [id_col, ref_label], score_cols)
    out = Reports({
        "side_by_side": lambda: wide,
        "distribution": lambda: A.label_distribution(wide, ref_label),
        "box": lambda: A.box_stats(long, ["model", "score_type", ref_label], "score"),
        "examples": lambda: example_table(L.stratified_sample(wide, ref_label, id_col, num_examples, seed), text_col, score_cols),
        **{f"agreement_{n}": lambda n=n: A.agreement(wide, ref_label, f"{n}_label") for n in names if n != reference},
        **{f"disagreements_{n}": lambda n=n: R.top_disagreements(wide, ref_label, f"{n}_label", id_col, num_disagreements) for n in names if n != reference},
    })
    if out_dir:
        for key, frame in out.items():
            if key != "side_by_side":
                write_csv(frame, os.path.join(out_dir, key), mode="overwrite")
    return out


class Reports(Mapping):
    """Report tables by name, each made when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __contains__(self, name) -> bool:
        return name in self._makers

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)
