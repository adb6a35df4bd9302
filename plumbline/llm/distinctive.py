"""How distinctive a term is for a record: the two-Poisson model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.skew import join_split_hot

#: A fit ends when a round changes none of a term's parameters by more than this share of them,
TOLERANCE = 1e-8
#: or when so many rounds raise its log-likelihood by no more than this (several parameters may fit counts of 1 and 2 alike).
WINDOW, FLAT = 15, 1e-7
#: Plain rounds before steps of second order are tried.
PLAIN = 10
#: Posterior from which on an occurrence count counts as elite.
ELITE = 0.5


def fit_two_poisson(counts: np.ndarray, weights: np.ndarray, owner: np.ndarray, terms: int, records: int, rounds: int | None = None) -> np.ndarray:
    """Expectation-maximisation of share * Poisson(elite) + (1 - share) * Poisson(base) for many terms at once.

    ``counts``, ``weights`` and ``owner`` are the terms' histograms laid end to end: how many records (weight) of term
    ``owner`` hold it ``counts`` times, without the records that do not hold it, which are added from ``records``.
    Gives a row (share, elite, base) for each term, with elite >= base.

    Goes on until every term has converged, or for ``rounds`` if given; finished terms leave the arrays. After a few plain
    rounds each round also tries a Newton step from the same expectations (the complete data's curvature less what the
    hidden component adds) and moves that keep the mean (and the variance or the base), and keeps one only where it raises the likelihood. A term that no
    record holds more than once shows no second component (its likelihood is greatest where both are one): share 0.
    """
    held = np.bincount(owner, weights, terms)
    total = np.bincount(owner, weights * counts, terms)
    none = np.maximum(records - held, 0.0)
    everyone = none + held
    peak = np.zeros(terms)
    np.maximum.at(peak, owner, counts)
    share = np.clip(np.where(everyone > 0, held / np.maximum(everyone, 1e-12) * 0.5, 0.5), 1e-9, 1 - 1e-9)
    mean = np.maximum(total / np.maximum(everyone, 1e-12), 1e-9)
    at = np.stack([share, np.maximum(peak * 0.75, 1.0), np.maximum(mean * 0.5, 1e-9)])
    at[:, peak <= 1] = np.stack([np.zeros(terms), mean, mean])[:, peak <= 1]
    fitted, live = at.copy(), np.flatnonzero(peak > 1)

    def keep(chosen: np.ndarray, size: int) -> None:
        nonlocal counts, weights, owner, total, none, everyone
        kept, place = chosen[owner], np.cumsum(chosen) - 1
        counts, weights, owner = counts[kept], weights[kept], place[owner[kept]]
        total, none, everyone = total[chosen], none[chosen], everyone[chosen]

    def posterior(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each bar and of the records without the term: probability of the elite component; and the log-likelihood."""
        share, elite, base = at
        flat, slope = np.log(share) - np.log1p(-share) - (elite - base), np.log(elite) - np.log(base)
        odds, odds0 = np.clip(flat[owner] + counts * slope[owner], -700, 700), np.clip(flat, -700, 700)
        # log of the whole = log of the base part + log(1 + odds of the elite part)
        rest = everyone * (np.log1p(-share) - base) + total * np.log(base)
        likely = rest + np.bincount(owner, weights * np.logaddexp(0, odds), len(live)) + none * np.logaddexp(0, odds0)
        return 1 / (1 + np.exp(-odds)), 1 / (1 + np.exp(-odds0)), likely

    def bounded(share: np.ndarray, elite: np.ndarray, base: np.ndarray) -> np.ndarray:
        return np.stack([np.clip(share, 1e-12, 1 - 1e-12), np.maximum(elite, 1e-9), np.maximum(base, 1e-9)])

    def newton(at: np.ndarray, p: np.ndarray, p0: np.ndarray) -> np.ndarray:
        """A step in (logit share, log elite, log base); where the likelihood is not concave it is damped."""
        share, elite, base = at
        n = len(live)
        sums = lambda bar, zero: np.bincount(owner, weights * bar, n) + none * zero
        up, down = counts - elite[owner], counts - base[owner]
        q, q0 = p * (1 - p), p0 * (1 - p0)
        slope = np.stack([sums(p, p0) - share * everyone, sums(p * up, -p0 * elite), sums((1 - p) * down, -(1 - p0) * base)], axis=1)
        d, d0 = (np.ones(len(counts)), up, -down), (np.ones(n), -elite, base)
        bend = np.empty((n, 3, 3))
        for i in range(3):
            for j in range(i, 3):
                bend[:, i, j] = bend[:, j, i] = sums(q * d[i] * d[j], q0 * d0[i] * d0[j])
        bend[:, 0, 0] -= share * (1 - share) * everyone
        bend[:, 1, 1] -= elite * sums(p, p0)
        bend[:, 2, 2] -= base * sums(1 - p, 1 - p0)
        scale = np.sqrt(np.maximum(np.abs(np.einsum("nii->ni", bend)), 1e-300))
        value, turned = np.linalg.eigh(np.nan_to_num(bend / scale[:, :, None] / scale[:, None, :]))
        value = -np.maximum(np.abs(value), 1e-10)
        step = -np.einsum("nij,nj->ni", turned, np.einsum("nji,nj->ni", turned, slope / scale) / value) / scale
        step = np.clip(np.nan_to_num(step), -2, 2)
        logit = np.log(share) - np.log1p(-share) + step[:, 0]
        return bounded(1 / (1 + np.exp(-np.clip(logit, -700, 700))), elite * np.exp(step[:, 1]), base * np.exp(step[:, 2]))

    def along(at: np.ndarray, move: np.ndarray) -> np.ndarray:
        """Another share for the same mean and variance, by a move of its logit up to where the base is 0."""
        share, elite, base = at
        middle, spread = share * elite + (1 - share) * base, np.sqrt(share * (1 - share)) * np.abs(elite - base)
        most = 2 * (np.log(middle) - np.log(np.maximum(spread, 1e-150)))
        odds = np.clip(np.minimum(np.log(share) - np.log1p(-share) + move, most), -25, 25)
        other = 1 / (1 + np.exp(-odds))
        gap = spread / np.sqrt(other * (1 - other))
        return bounded(other, middle + (1 - other) * gap, middle - other * gap)

    def level(at: np.ndarray, move: np.ndarray) -> np.ndarray:
        """Another share for the same mean and base, by a move of its logit."""
        share, elite, base = at
        other = 1 / (1 + np.exp(-np.clip(np.log(share) - np.log1p(-share) + move, -25, 25)))
        return bounded(other, (share * elite + (other - share) * base) / other, base)

    keep(peak > 1, len(live))
    at, turn, likely, stride = at[:, live], 0, np.full(len(live), -np.inf), np.full(len(live), 0.2)
    while len(live) and (rounds is None or turn < rounds):
        p, p0, _ = posterior(at)
        mass = np.bincount(owner, weights * p, len(live)) + none * p0
        hits = np.bincount(owner, weights * p * counts, len(live))
        new = bounded(mass / np.maximum(everyone, 1e-12), hits / np.maximum(mass, 1e-12), (total - hits) / np.maximum(everyone - mass, 1e-12))
        turn += 1
        now = posterior(new)[2]
        if turn > PLAIN:
            plain = new
            tried = [newton(at, p, p0), along(plain, np.full(len(live), 50.0)), along(plain, stride), along(plain, -stride), level(plain, stride), level(plain, -stride)]
            for k, ahead in enumerate(tried):
                gain = posterior(ahead)[2]
                better = gain > now + FLAT / WINDOW / 4
                new, now = np.where(better, ahead, new), np.where(better, gain, now)
                if k > 1:
                    stride = np.where(better, stride * 2, stride * 0.85)
            stride = np.clip(stride, 1e-3, 2)
        done = (np.abs(new - at) <= TOLERANCE * np.abs(at)).all(axis=0)
        if turn % WINDOW == 0:
            done |= ~(now - likely > FLAT)
            likely = np.fmax(likely, now)
        at = new
        fitted[:, live] = at
        if done.any():
            keep(~done, len(live))
            at, likely, live, stride = at[:, ~done], likely[~done], live[~done], stride[~done]
    share, elite, base = fitted
    flip = base > elite
    share, elite, base = np.where(flip, 1 - share, share), np.where(flip, base, elite), np.where(flip, elite, base)
    return np.stack([share, elite, base], axis=1)


def posterior_elite(tf: np.ndarray, share: np.ndarray, elite: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Probability that a record with tf occurrences belongs to the elite component."""
    share = np.clip(share, 1e-300, 1 - 1e-16)
    odds = np.log(share) - np.log1p(-share) - (elite - base) + tf * (np.log(elite) - np.log(base))
    return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def score_counts(counted: DataFrame, records: int, rounds: int | None = None) -> DataFrame:
    """(term, tf, c, n_chunks, n_total, score): the posterior of the elite component for each count tf of a term, and the
    number c of chunks with that count.

    ``counted`` has one row per term and chunk; ``records`` is the number of chunks. Each term's histogram of tf is its
    sufficient statistic: it has at most sqrt(2 * all occurrences) entries, whatever the number of rows, and is built with
    map-side combining. Terms of a batch with the same histogram are fitted once. An empty table gives no rows.
    """
    bars = counted.groupBy("term", "tf").agg(F.count(F.lit(1)).alias("c"))
    stats = bars.groupBy("term").agg(
        F.collect_list("tf").alias("tfs"), F.collect_list("c").alias("cs"), F.sum("c").alias("n_chunks"), F.sum(F.col("tf") * F.col("c")).alias("n_total")
    )

    @F.pandas_udf("array<double>")
    def fitted(tfs: pd.Series, cs: pd.Series) -> pd.Series:
        # Most terms are rare and share their histogram with others: each histogram is fitted once.
        place: dict[tuple, int] = {}
        at = [place.setdefault((tuple(t), tuple(c)), len(place)) for t, c in zip(tfs, cs)]
        if not place:
            return pd.Series([], dtype=object)
        sizes = np.array([len(t) for t, _ in place])
        owner = np.repeat(np.arange(len(place)), sizes)
        counts, weights = (np.fromiter((x for key in place for x in key[k]), float, sizes.sum()) for k in (0, 1))
        share, elite, base = fit_two_poisson(counts, weights, owner, len(place), records, rounds)[owner].T
        scores = np.split(posterior_elite(counts, share, elite, base), np.cumsum(sizes)[:-1])
        return pd.Series([scores[i] for i in at])

    scored = stats.select("term", "tfs", "cs", "n_chunks", "n_total", fitted("tfs", "cs").alias("scores"))
    each = scored.select("term", "n_chunks", "n_total", F.explode(F.arrays_zip("tfs", "cs", "scores")).alias("b"))
    return each.select("term", F.col("b.tfs").alias("tf"), F.col("b.cs").alias("c"), "n_chunks", "n_total", F.col("b.scores").alias("score"))


def score_terms(counted: DataFrame, records: int, rounds: int | None = None) -> DataFrame:
    """Scores each (term, chunk_id, tf): the posterior probability that the chunk belongs to the term's elite component.

    The scores of a term's counts go back to the rows with a join that keeps hot counts where they are.
    Result: chunk_id, term, tf, n_chunks, n_total, score. Ties share a score; an empty table gives no rows.
    """
    return _with_chunks(counted, score_counts(counted, records, rounds)).select("chunk_id", "term", "tf", "n_chunks", "n_total", "score")


def _with_chunks(counted: DataFrame, scored: DataFrame) -> DataFrame:
    return join_split_hot(counted, scored, ["term", "tf"], F.col("c"), counted.count())


def dominated(counted: DataFrame, scored: DataFrame, least_tf: int = 3, least_chunks: int = 2, share: float = 0.5, elite: float = ELITE) -> DataFrame:
    """(chunk_id, term) of the elite occurrences of a term that dominate it: by their posterior, then by an exact check on
    counts (often enough here, in other chunks too, and mostly here).

    ``scored`` has the scores of ``score_counts`` over ``counted``.
    """
    mostly = (F.col("tf") >= least_tf) & (F.col("n_chunks") >= least_chunks) & (F.col("tf") >= F.col("n_total") * share)
    return _with_chunks(counted, scored.where((F.col("score") >= elite) & mostly)).select("chunk_id", "term")
