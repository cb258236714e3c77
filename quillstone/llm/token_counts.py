"""Exact length histogram and what its suffix sums answer.

Documents are counted by encoded length. For every length that occurs, taken as
a context limit, the curve has how many documents fit and are cut, and the tokens
that are kept and lost. Sums run inside bands of lengths and then over the bands,
so that no task holds all lengths. Any other limit is answered from the curve's
point at the next smaller length, without going back to the histogram.

Cases: null and empty texts have length 0 and are counted; a very long text is
encoded whole; repeated rows count each time; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.llm import byte_bpe
from quillstone.llm.common import durable

BAND = 128
#: Context limits of the query, beside the lengths that occur, and its quantiles.
LIMITS = tuple(1 << i for i in range(9, 21))
SHARES = (0.5, 0.9, 0.99, 0.999)


def histogram(docs: DataFrame, text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """n_tokens and docs: how many documents have that encoded length."""
    return byte_bpe.lengths(docs, text_col, ranks).groupBy("n_tokens").agg(F.count("*").alias("docs"))


def curve(hist: DataFrame) -> DataFrame:
    """A row for each length of ``hist``, as a context limit: docs_at, docs_fit,
    docs_cut, tokens_total, tokens_kept (documents cut to the limit), tokens_lost,
    and share_fit."""
    cells = hist.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.floor(F.col("n_tokens") / BAND).alias("band"))
    bands = cells.groupBy("band").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    above = W.orderBy(F.desc("band")).rowsBetween(W.unboundedPreceding, -1)  # one row per BAND lengths
    whole = W.orderBy(F.desc("band")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nothing = F.lit(0).cast("long")
    bands = bands.select("band", *(F.coalesce(F.sum(c).over(above), nothing).alias(f"{c}_above") for c in ("docs", "tokens")), *(F.sum(c).over(whole).alias(f"{c}_total") for c in ("docs", "tokens")))
    inside = W.partitionBy("band").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("band", "n_tokens", "docs", *(F.coalesce(F.sum(c).over(inside), nothing).alias(f"{c}_inside") for c in ("docs", "tokens")))
    found = cells.join(bands, "band")
    cut = F.col("docs_inside") + F.col("docs_above")
    kept = F.col("tokens_total") - F.col("tokens_inside") - F.col("tokens_above") + F.col("n_tokens") * cut
    return found.select(
        F.col("n_tokens").alias("context_limit"), F.col("docs").alias("docs_at"), (F.col("docs_total") - cut).alias("docs_fit"), cut.alias("docs_cut"), "tokens_total",
        kept.alias("tokens_kept"), (F.col("tokens_total") - kept).alias("tokens_lost"), ((F.col("docs_total") - cut) / F.col("docs_total")).alias("share_fit"),
    )


def truncated_totals(points: DataFrame, limits: Sequence[int]) -> DataFrame:
    """One row of ``curve``'s answers: for each limit c, fit_c, the documents of at
    most c tokens, and kept_c, the tokens left if documents are cut to c; c need not
    be a length that occurs."""
    docs, none = F.max(F.col("docs_fit") + F.col("docs_cut")), F.lit(0).cast("long")
    answers = []
    for c in limits:
        last = F.max_by(F.struct("context_limit", "docs_fit", "docs_cut", "tokens_kept"), F.when(F.col("context_limit") <= c, F.col("context_limit")))
        answers.append((c, last))
    found = points.agg(docs.alias("docs"), *(last.alias(f"at_{c}") for c, last in answers))
    out = []
    for c, _ in answers:
        at = F.col(f"at_{c}")
        cut = F.when(at["context_limit"] <= c, at["docs_cut"]).otherwise(F.coalesce("docs", none))
        kept = F.when(at["context_limit"] <= c, at["tokens_kept"] + (c - at["context_limit"]) * cut).otherwise(c * cut)
        out += [(F.coalesce("docs", none) - cut).alias(f"fit_{c}"), kept.alias(f"kept_{c}")]
    return found.select(*out)


def quantiles(points: DataFrame, shares: Sequence[float]) -> DataFrame:
    """One row of ``curve``'s answers: for each share q, the smallest length that
    at least q of the documents fit in, as q_<percent>."""
    return points.agg(*(F.min(F.when(F.col("share_fit") >= q, F.col("context_limit"))).alias(f"q_{str(round(q * 100, 6)).rstrip('0').rstrip('.').replace('.', '_')}") for q in shares))


def count_tokens(docs: DataFrame, text_col: str = "text", ranks: str | None = None, limits: Sequence[int] = LIMITS, shares: Sequence[float] = SHARES) -> DataFrame:
    """``curve`` of the histogram, which is written once to the shared folder, with a
    row for each of ``limits`` too (docs_at is 0 where no text has that length), and
    the quantiles on every row."""
    points = durable(curve(durable(histogram(docs, text_col, ranks), "lengths")), "curve")
    totals = truncated_totals(points, limits)
    some = points.agg(F.max("tokens_total").alias("tokens_total"), F.max(F.col("docs_fit") + F.col("docs_cut")).alias("docs")).where("docs is not null")
    asked = totals.select(F.explode(F.array(*(F.struct(F.lit(c).cast("long").alias("context_limit"), F.col(f"fit_{c}").alias("docs_fit"), F.col(f"kept_{c}").alias("tokens_kept")) for c in limits))).alias("r")).select("r.*")
    asked = asked.join(points.select("context_limit"), "context_limit", "left_anti").crossJoin(F.broadcast(some))  # one row
    more = asked.select(
        "context_limit", F.lit(0).cast("long").alias("docs_at"), "docs_fit", (F.col("docs") - F.col("docs_fit")).alias("docs_cut"), "tokens_total", "tokens_kept",
        (F.col("tokens_total") - F.col("tokens_kept")).alias("tokens_lost"), (F.col("docs_fit") / F.col("docs")).alias("share_fit"),
    )
    return points.unionByName(more).crossJoin(F.broadcast(quantiles(points, shares)))  # one row
