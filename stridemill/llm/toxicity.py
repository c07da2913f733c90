"""Toxicity of texts by weak supervision: voters, a label model, a linear classifier."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemill.llm.text import SLICE_BYTES, buffers, hash_spans, mix, slices, window_hashes, word_spans
from stridemill.schema import require_columns
from stridemill.session import stage

#: Insults that vote before any label has been seen.
LEXICON = (
    "idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown clowns dumb "
    "imbecile vermin filth retard bastard bitch asshole bullshit crap shit fuck fucking whore slut coward parasite"
).split()
#: Patterns over the lower-case text.
PATTERNS = (
    r"shut (the \w+ )?up",
    r"\b(i|we) (all )?(hate|despise) (you|them)",
    r"\byou (are|re) (a|an|such) ",
    r"\b(kill|hurt) (yourself|yourselves)",
    r"\bgo to hell\b",
    r"!{3,}",
    r"\b(\w)\W(\w)\W(\w)\W(\w)\b",
)
#: Bytes of a word's beginning that count as its stem.
STEMS = (4, 5, 6, 7, 8, 9)
#: Occurrences in one text that make a term a voter of its own.
REPEATED = 3
#: Bounds of how often the annotator says toxic of a clean and of a toxic text: least and most sure.
ANNOTATOR = (np.array([[0.001], [0.95]]), np.array([[0.02], [0.999]]))
#: Votes that every voter is taken to have cast on clean and on toxic texts beforehand.
_PRIOR = np.array([[2.0], [0.5]])
#: Weight of the label model's word on a single voter, in rows.
SINGLE_WEIGHT = 1.0
#: Most labelled rows that the voters and the classifier are fitted on.
FIT_ROWS = 20_000
#: Share of the toxic labelled rows that a mined voter stands in at least.
LEAST_SHARE = 0.02
#: Most voters mined from the labelled rows.
MINED = 600

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Model:
    """Sorted hashes of the terms, how often each voter wants its term, and the classifier's weights.

    ``voter_of`` has a row for a single and one for a repeated occurrence:
    the voter of each term, or -1.
    """

    terms: np.ndarray
    voter_of: np.ndarray
    weights: np.ndarray
    bias: float
    accuracies: dict[int, tuple[float, float]] = field(default_factory=dict)
    discounts: np.ndarray | None = None

    @property
    def voters(self) -> int:
        return int(self.voter_of.max(initial=-1)) + 1 + len(PATTERNS) + 1


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and hash of all words and stems of the lower-case texts."""
    lower = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    data, offsets = buffers(lower)
    inside = _LETTER[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    heads, tails = offsets[:-1][offsets[:-1] < len(data)], offsets[1:][offsets[1:] > 0] - 1
    begins[heads], stops[tails] = inside[heads], inside[tails]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    rows, hashes = [row], [hash_spans(data, starts, ends)]
    for n in STEMS:
        long = np.flatnonzero(ends - starts > n)
        rows.append(row[long])
        hashes.append(hash_spans(data, starts[long], starts[long] + n, seed=n))
    return np.concatenate(rows), np.concatenate(hashes), lower


def _listed() -> np.ndarray:
    rows, hashes, _ = _terms(pa.array(LEXICON))
    first = np.r_[True, rows[1:] != rows[:-1]]
    return hashes[: len(LEXICON)][first[: len(LEXICON)]]


def _copy_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two smallest-shingle hashes of each text, which copies of a text mostly share."""
    for batch in batches:
        for rows in slices(batch, "text"):
            data, offsets = buffers(rows.column("text"))
            begin, end, first = word_spans(data, offsets)
            words = hash_spans(data, begin, end)
            keys = np.full((2, rows.num_rows), np.iinfo(np.int64).max)
            for k, salt in enumerate((np.uint64(1), np.uint64(2))):
                each = mix(words + salt)
                for row in np.flatnonzero(np.diff(first)):
                    own = each[first[row] : first[row + 1]]
                    keys[k, row] = int(window_hashes(own, min(5, len(own)), 0x9E6C63D0876A9A45).min() >> np.uint64(1))
            yield pa.RecordBatch.from_arrays(
                [rows.column("text"), rows.column("toxic"), pa.array(keys[0]), pa.array(keys[1])], ["text", "toxic", "key1", "key2"]
            )


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and other texts with each term, summed over a slice of rows."""
    for batch in batches:
        for rows in slices(batch, "text"):
            row, term, _ = _terms(rows.column("text"))
            if not len(row):
                continue
            order = np.lexsort((row, term))
            row, term = row[order], term[order]
            new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (row[1:] != row[:-1])])
            times = np.diff(np.r_[new, len(row)])
            row, term = row[new], term[new]
            toxic = rows.column("toxic").to_numpy()[row] == 1
            for least in (1, REPEATED):
                some = np.flatnonzero(times >= least)
                if not len(some):
                    continue
                first = np.flatnonzero(np.r_[True, term[some][1:] != term[some][:-1]])
                n1 = np.add.reduceat(toxic[some].astype(np.int64), first)
                n = np.diff(np.r_[first, len(some)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(term[some][first].view(np.int64)), pa.array(np.full(len(n), least, np.int32)), pa.array(n1), pa.array(n - n1)],
                    ["term", "least", "n1", "n0"],
                )


def _votes(
    lower: pa.Array, row: np.ndarray, term: np.ndarray, terms: np.ndarray, voter_of: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, voter and count of the votes; the last voter says how many voters fired in the text."""
    rough = np.zeros(1 << 16, bool)
    rough[terms >> np.uint64(48)] = True
    maybe = np.flatnonzero(rough[term >> np.uint64(48)])
    at = np.minimum(np.searchsorted(terms, term[maybe]), len(terms) - 1)
    hit = terms[at] == term[maybe]
    key, times = np.unique(row[maybe][hit] * len(terms) + at[hit], return_counts=True)
    which, each = key // len(terms), key % len(terms)
    rows, voters, counts = [], [], []
    for kind, least in enumerate((1, REPEATED)):
        voter = voter_of[kind][each]
        fires = (voter >= 0) & (times >= least)
        rows.append(which[fires])
        voters.append(voter[fires])
        counts.append(times[fires])
    first = int(voter_of.max(initial=-1)) + 1
    distinct = np.bincount(np.concatenate(rows), minlength=len(lower))
    for k, pattern in enumerate(PATTERNS):
        found = np.flatnonzero(pc.match_substring_regex(lower, pattern).to_numpy(zero_copy_only=False))
        rows.append(found)
        voters.append(np.full(len(found), first + k))
        counts.append(np.ones(len(found), np.int64))
    some = np.flatnonzero(distinct)
    rows.append(some)
    voters.append(np.full(len(some), first + len(PATTERNS)))
    counts.append(distinct[some])
    return np.concatenate(rows), np.concatenate(voters), np.concatenate(counts)


def _vote_rows(terms: np.ndarray, voter_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                row, term, lower = _terms(rows.column("text"))
                at, voter, times = _votes(lower, row, term, terms, voter_of)
                order = np.argsort(at, kind="stable")
                first = np.searchsorted(at[order], np.arange(rows.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("toxic"),
                        pa.ListArray.from_arrays(pa.array(first), pa.array(voter[order].astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(first), pa.array(times[order].astype(np.int32))),
                    ],
                    ["toxic", "voters", "times"],
                )

    return run


def label_model(votes: np.ndarray, annotated: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the hidden label, the voters' accuracies, and their discounts.

    ``votes`` (rows x voters, 0/1: voted toxic or abstained) and ``annotated``
    (the given labels) are noisy signs of a hidden label. Expectation
    maximisation estimates for every voter how often it fires under either
    label, the annotator being one more voter. Voters whose firing is
    correlated given the label are no independent evidence: each one's weight
    is divided by one plus its summed residual correlations above a half. A voter
    that abstains says nothing; only a row without any vote is a vote for clean.
    """
    n, m = votes.shape
    posterior = np.where(annotated == 1, 0.95, 0.05)
    discounts = np.ones(m)
    theta = np.zeros((2, m))
    none = (votes.sum(1) == 0).astype(float)
    for step in range(rounds):
        weight = np.stack([1 - posterior, posterior])
        total = weight.sum(1, keepdims=True)
        theta = (weight @ votes + _PRIOR) / (total + 2 * _PRIOR)
        agree = np.clip((weight @ annotated[:, None] + 0.5) / (total + 1.0), *ANNOTATOR)
        prior = (posterior.mean() * n + 0.5) / (n + 1)
        if step in (2, 10):
            residual = votes - (posterior[:, None] * theta[1] + (1 - posterior[:, None]) * theta[0])
            spread = residual.std(0) + 1e-6
            correlation = (residual.T @ residual) / n / np.outer(spread, spread)
            np.fill_diagonal(correlation, 0)
            discounts = 1 / (1 + np.where(correlation > 0.5, correlation, 0).sum(1))
        fire = np.log(theta[1] / theta[0]) * discounts
        silent = (weight @ none[:, None] + 0.5) / (total + 1.0)
        said = np.where(annotated == 1, np.log(agree[1, 0] / agree[0, 0]), np.log((1 - agree[1, 0]) / (1 - agree[0, 0])))
        logit = np.log(prior / (1 - prior)) + said + votes @ fire + none * np.log(silent[1, 0] / silent[0, 0])
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return posterior, theta, discounts


def _features(rows: np.ndarray, voters: np.ndarray, times: np.ndarray, n: int, m: int) -> np.ndarray:
    """Bounded counts: a term counts up to about twice, the number of distinct terms by its logarithm."""
    x = np.zeros((n, m))
    x[rows, voters] = np.where(voters == m - 1, np.log1p(times), np.minimum(1 + np.log(times) / 4, 2))
    return x


def _fit_line(x: np.ndarray, target: np.ndarray, weight: np.ndarray, strength: float = 0.1, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression on weighted soft targets: Newton steps with a small ridge."""
    design = np.c_[x, np.ones(len(x))]
    ridge = np.r_[np.full(x.shape[1], strength), 1e-3]
    w = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (weight * (p - target)) + ridge * w
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _single_votes(
    votes: np.ndarray, posterior: np.ndarray, theta: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """For every voter, a row in which it fires alone with those that nearly always fire with it,
    and the label model's posterior of such a row.

    Labelled texts mostly hold several signs at once; these rows tell the
    classifier what the label model says of one.
    """
    fired = votes.sum(0)
    together = (votes.T @ votes) / np.maximum(fired, 1)[:, None] >= 0.9
    together &= (fired > 0)[:, None]
    together[np.arange(len(fired)), np.arange(len(fired))] = fired > 0
    x = np.c_[together.astype(float), np.log1p(together.sum(1))][fired > 0]
    prior = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
    strongest = np.where(together[fired > 0], np.log(theta[1] / theta[0]), -np.inf).max(1, initial=-30)
    logit = np.log(prior / (1 - prior)) + strongest  # they say the same, so the strongest speaks
    return x, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(labelled: DataFrame, text: str = "text", toxic: str = "toxic", mined: int = MINED) -> Model:
    """Voters, label model and classifier from labelled texts (a bounded number of rows).

    Terms (words and stems of 4 to 9 bytes) that stand, once or repeatedly, in at least
    2 of 100 toxic texts (and four) and clearly more often there are mined as voters beside the fixed
    lexicon and patterns. Votes are made in tasks; the fit of at most
    ``mined`` voters runs on the driver, over the rows in an order of their own.
    Rows without a label of 0 or 1 are left out; rows of one label whose texts
    agree in both of two minimum hashes of their shingles count as one. Without labels of both kinds the lexicon decides.
    """
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{toxic}`").cast("int").alias("toxic"))
    rows = rows.where("toxic IN (0, 1)").mapInArrow(_copy_keys, "text STRING, toxic INT, key1 LONG, key2 LONG")
    # copies of a text would make each of its words look like a sign; of rows that agree in both keys the one
    # with the smallest hash stays, so that the model does not depend on the order of rows
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")
    rows = stage(rows.groupBy("key1", "key2", "toxic").agg(first).select("first.text", "toxic"), "labelled")
    listed = np.unique(_listed())
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        voter_of = np.stack([np.arange(len(listed)), np.full(len(listed), -1)])
        return Model(listed, voter_of, np.r_[np.full(len(listed), 2.0), np.zeros(len(PATTERNS)), 1.0], -2.5)
    counts = rows.mapInArrow(_term_counts, "term LONG, least INT, n1 LONG, n0 LONG").groupBy("term", "least").agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0")
    )
    gain = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    best = (
        counts.where(F.col("n1") >= max(4, LEAST_SHARE * n1))
        .withColumn("gain", gain)
        .where(f"gain > {np.log(8)}")
        .orderBy(F.desc(F.col("gain") * F.sqrt("n1")), "least", "term")
        .limit(mined)
        .select("term", "least")
        .toArrow()
    )
    found = best.column("term").to_numpy().view(np.uint64)
    terms = np.unique(np.r_[listed, found])
    wanted = np.zeros((2, len(terms)), bool)
    wanted[0, np.searchsorted(terms, listed)] = True
    wanted[(best.column("least").to_numpy() > 1).astype(int), np.searchsorted(terms, found)] = True
    voter_of = np.where(wanted, np.cumsum(wanted.reshape(-1)).reshape(2, -1) - 1, -1)
    table = rows.mapInArrow(_vote_rows(terms, voter_of), "toxic INT, voters ARRAY<INT>, times ARRAY<INT>").toArrow()
    table = pa.Table.from_pylist(sorted(table.to_pylist(), key=lambda r: tuple(r.values())), table.schema).combine_chunks()
    annotated = table.column("toxic").to_numpy()
    lists = table.column("voters").combine_chunks()
    per_row = pc.list_value_length(lists).to_numpy()
    at = np.repeat(np.arange(len(annotated)), per_row)
    voters = lists.flatten().to_numpy()
    times = table.column("times").combine_chunks().flatten().to_numpy()
    m = int(wanted.sum()) + len(PATTERNS) + 1
    x = _features(at, voters, times, len(annotated), m)
    votes = (x[:, :-1] > 0).astype(float)
    posterior, theta, discounts = label_model(votes, annotated)
    alone, said = _single_votes(votes, posterior, theta)
    weights, bias = _fit_line(
        np.r_[x, alone], np.r_[posterior, said], np.r_[np.ones(len(x)), np.full(len(alone), SINGLE_WEIGHT)]
    )
    accuracies = {k: (float(theta[0, k]), float(theta[1, k])) for k in range(m - 1)}
    return Model(terms, voter_of, weights, bias, accuracies, discounts)


def score(docs: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """The columns of ``docs`` and the probability of a toxic text, over the whole text.

    Null and empty texts get the score of a text without any vote. An input
    column named ``output`` is replaced.
    """
    require_columns(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                row, term, lower = _terms(rows.column("text"))
                at, voter, times = _votes(lower, row, term, model.terms, model.voter_of)
                value = np.where(voter == model.voters - 1, np.log1p(times), np.minimum(1 + np.log(times) / 4, 2))
                logit = np.bincount(at, value * model.weights[voter], minlength=rows.num_rows) + model.bias
                made = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
                yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(made)], ["row", "score"])

    keep = [c for c in docs.columns if c != output]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text")
    )
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, score DOUBLE").select(
        *[F.col(f"row.`{c}`") for c in keep], F.col("score").alias(output)
    )


def held_out(id: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(f"`{id}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on_labels(
    docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", toxic: str = "toxic", rows: int = FIT_ROWS
) -> Model:
    """``fit`` on the labelled documents that are not held out.

    More than about ``rows`` of them are thinned by a hash of the id. An id
    with several labels counts as toxic if one of them says so; null ids and
    labels are left out.
    """
    known = (
        labels.select(F.col(f"`{id}`").alias("id"), F.col(f"`{toxic}`").cast("int").alias("toxic"))
        .where("id IS NOT NULL AND toxic IN (0, 1)")
        .where(~held_out("id"))
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
    )
    total = known.count()
    share = min(1.0, rows / max(total, 1))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return fit(texts.join(F.broadcast(known), "id"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    model = fit_on_labels(docs, labels, text, id)
    own = "__toxic"
    while own in docs.columns:
        own += "_"
    return score(docs, model, text, own).where(F.col(own) < threshold).drop(own)
