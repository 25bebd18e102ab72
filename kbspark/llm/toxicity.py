"""Toxicity by weak supervision.

Voters are short lexicons (words) and patterns (beginnings of words) found by
counts over all labelled rows outside the held-out fold, and two patterns of
shouting. A generative model of their votes, which sees no labels, estimates by
expectation maximisation how often each voter fires on toxic and on clean
texts, and from what the classes leave unexplained which voters repeat each
other; votes of correlated voters count for less. It is fitted on the votes of
all distinct texts outside the fold, labelled or not, as a table of how often
each pattern of votes occurs, which has at most 2 to the number of voters rows.
Its posterior labels train a linear classifier on hashed words and word
beginnings of a bounded sample of labelled rows, which scores every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import materialize

#: About how many labelled rows the linear classifier is fitted on at most, drawn by a hash of doc_id from all outside the held-out fold. Nothing else is sampled.
FIT_LABELLED = 12_000

#: Voters of each kind and the entries they share; the deviation from chance that an entry needs.
LEXICONS = PATTERNS = 8
VOTERS = LEXICONS + PATTERNS + 2
ENTRIES = 240
VOTER_Z = 5.0

#: The deviation and the lift that a feature of the classifier needs between the posterior labels.
FEATURE_Z = 4.5
FEATURE_LIFT = 4

#: How many times as common an entry must be among toxic rows as among clean ones.
LEAST_LIFT = 8

#: Lengths of the word beginnings that serve as features.
BEGINNINGS = (4, 5, 6)

THRESHOLD = 0.7

#: The smallest feature hashes by which rows count as near copies of each other when entries are counted; such rows share one vote.
SKETCH = 8

#: Near copies are joined to the sizes of their groups in this many portions, so that a large group is not one task.
SALTS = 16

#: Bits by which texts without a label are told before their rows are shuffled; 8 MB whatever the number of labels. Where most are set little is told, and the join decides alone.
MARK_BITS = 1 << 26

#: Penalty on squared weights.
RIDGE = 1e-4

#: Correlation from which two voters count as repeating each other.
SAME = 0.3

_WORD = re.compile(r"[^\W_]+")
_SHOUT = re.compile(r"!{2,}")


def in_fold(doc_id: Column, of: int, which: int) -> Column:
    """Whether crc32 of doc_id as text leaves this remainder; a null doc_id is in the fold, so nothing is learned from it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == which, F.lit(True))


@lru_cache(maxsize=100_000)
def features_of_word(word: str) -> tuple[int, ...]:
    """The word and its beginnings as 32-bit hashes; those of words have bit 31 clear, those of beginnings set."""
    return xxhash.xxh32_intdigest(word) & 0x7FFFFFFF, *(xxhash.xxh32_intdigest(word[:n], n) | 0x80000000 for n in BEGINNINGS if len(word) >= n)


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def shouts(text: str | None) -> tuple[bool, bool]:
    """Runs of exclamation marks; mostly capitals."""
    t = text or ""
    return bool(_SHOUT.search(t)), len(t) > 20 and sum(map(str.isupper, t)) * 2 > len(t)


@dataclass
class LabelModel:
    """Two latent classes behind binary votes, with correlated voters weighed down."""

    fires_toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    fires_clean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    correlation: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    prior: float = 0.0

    def fit(self, votes: np.ndarray, times: np.ndarray | None = None, rounds: int = 60) -> LabelModel:
        """votes: patterns by voters, 0 or 1; times: how often each pattern occurs, once if left out. Starts from the rows where two voters or more agree."""
        v = votes.astype(np.float64)
        times = np.ones(len(v)) if times is None else times.astype(np.float64)
        n, k = times.sum(), v.shape[1]
        post = np.where(v.sum(1) >= 2, 0.9, 0.02)
        self.weight = np.ones(k)
        for _ in range(rounds):
            on, off = times * post, times * (1 - post)
            p = on.sum()
            self.prior = float(np.clip((p + 1) / (n + 20), 1e-4, 0.5))
            self.fires_toxic = (v.T @ on + 1) / (p + 4)
            self.fires_clean = (v.T @ off + 0.1) / (n - p + 20)
            # what the classes leave unexplained, within each class
            left_t, left_c = v - self.fires_toxic, v - self.fires_clean
            cov = (left_t * on[:, None]).T @ left_t + (left_c * off[:, None]).T @ left_c
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            self.correlation = cov / sd[:, None] / sd
            same = np.clip(self.correlation - SAME, 0, 1)
            np.fill_diagonal(same, 0)
            self.weight = 1 / (1 + same.sum(1))
            before, post = post, self.posterior(votes)
            if np.abs(post - before).max() < 1e-4:
                break
        return self

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        t, c = self.fires_toxic, np.minimum(self.fires_clean, self.fires_toxic)
        odds = np.log(self.prior / (1 - self.prior)) + votes @ (self.weight * np.log(t / c)) + (1 - votes) @ (self.weight * np.log((1 - t) / (1 - c)))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def _surprise(pos: Column, neg: Column, n_pos: float, n_neg: float) -> Column:
    """Signed root of the likelihood ratio that a feature is as common in both classes: about standard deviations from chance."""
    both, share, n = pos + neg, n_pos / (n_pos + n_neg), n_pos + n_neg
    ratio = F.lit(0.0)
    for x, expected in ((pos, both * share), (neg, both * (1 - share)), (n_pos - pos, (n - both) * share), (n_neg - neg, (n - both) * (1 - share))):
        ratio += F.when((x > 1e-9) & (expected > 1e-9), x * F.log(x / expected)).otherwise(0.0)
    return F.round(F.signum(pos * n_neg - neg * n_pos) * F.sqrt(F.greatest(2 * ratio, F.lit(0.0))), 6)


@dataclass
class Classifier:
    """Weights of hashed features; a text's score is the logistic function of bias plus the weights of its distinct words' features."""

    bias: float
    weights: dict[int, float]

    def score_all(self, texts: Iterator[str | None]) -> list[float]:
        known: dict[str, float] = {}
        out, get = [], self.weights.get
        for text in texts:
            words = words_of(text)
            if len(known) > 100_000:
                known.clear()
            for w in words.difference(known):
                known[w] = sum(get(f, 0.0) for f in features_of_word(w))
            odds = self.bias + sum(map(known.__getitem__, words))
            out.append(1 / (1 + np.exp(-min(max(odds, -40.0), 40.0))))
        return out


def _train(rows: np.ndarray, cols: np.ndarray, k: int, y: np.ndarray, mass: np.ndarray, steps: int = 1500) -> tuple[float, np.ndarray]:
    """Logistic regression on soft labels y of rows that count by mass; rows, cols: the entries that are one."""
    n, total = len(y), mass.sum()
    mean = (mass * y).sum() / total
    w, b = np.zeros(k), float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    m, s = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols], n) + b, -40, 40)))
        err = mass * (p - y) / total
        g = np.append(np.bincount(cols, err[rows], k) + RIDGE * w, err.sum())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    # the penalty draws scores to the middle; one factor and one shift undo that
    x, factor, shift = np.bincount(rows, w[cols], n) + b, 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(factor * x + shift, -40, 40)))
        d, off = mass * np.maximum(p * (1 - p), 1e-9), mass * (p - y)
        grad = np.array([(off * x).sum() + (factor - 1), off.sum() + shift * 0.1])
        hess = np.array([[(d * x * x).sum() + 1, (d * x).sum()], [(d * x).sum(), d.sum() + 0.1]])
        factor, shift = np.array([factor, shift]) - np.linalg.solve(hess, grad)
        factor = float(np.clip(factor, 0.2, 5))
    return factor * b + shift, factor * w


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct features of each text, its sketch and whether it shouts, for a few texts at a time."""
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            batch = whole.slice(start, 500)
            found, sketch, loud, capitals = [], [], [], []
            for x in batch.column("text"):
                text = x.as_py()
                features = np.unique(np.fromiter((f for w in words_of(text) for f in features_of_word(w)), np.uint32))
                found.append(features.view(np.int32))
                sketch.append(xxhash.xxh64_intdigest(features[:SKETCH].tobytes()) >> 1)
                a, b = shouts(text)
                loud.append(a)
                capitals.append(b)
            columns = {"features": pa.array(found, pa.list_(pa.int32())), "sketch": pa.array(sketch, pa.int64()), "toxic": batch.column("toxic"), "loud": pa.array(loud, pa.bool_()), "capitals": pa.array(capitals, pa.bool_()), "draw": batch.column("draw")}
            yield pa.RecordBatch.from_pydict(columns)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The features of all rows, and the row of each."""
    lists = batch.column("features")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(batch.num_rows), sizes)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the rows with a feature count for either class, added up for a thousand rows at a time."""
    for whole in batches:
        for start in range(0, whole.num_rows, 1000):
            batch = whole.slice(start, 1000)
            flat, rows = _flat(batch)
            got, at = np.unique(flat, return_inverse=True)
            up, down = (np.bincount(at, batch.column(c).to_numpy(zero_copy_only=False)[rows], len(got)) for c in ("up", "down"))
            yield pa.RecordBatch.from_pydict({"feature": pa.array(got, pa.int32()), "up": pa.array(up, pa.float64()), "down": pa.array(down, pa.float64())})


def _counted(rows: DataFrame) -> DataFrame:
    """What each feature counts for either class over all rows; what only one or two rows have can stand out nowhere."""
    sums = rows.select("features", "up", "down").mapInArrow(_sums, "feature int, up double, down double")
    return sums.groupBy("feature").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up + down > 2.999")


def _weighed(seen: DataFrame) -> DataFrame:
    """Add weight, one divided by the number of rows with the same label and sketch, so that the chance words of a much copied text don't pass for toxic ones."""
    alike = seen.groupBy("toxic", "sketch").agg(F.count("*").alias("alike")).where("alike > 1")
    alike = alike.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = seen.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return salted.join(alike, ["toxic", "sketch", "salt"], "left").withColumn("weight", 1 / F.coalesce("alike", F.lit(1)))


def _perhaps_labelled(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows whose doc_id may be among those of marks: no row that is goes, and of the others most do, so that their texts are not shuffled to a join that ends them."""
    place = lambda: F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(MARK_BITS))
    bits = marks.groupBy(F.bitmap_bucket_number(place()).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place())).alias("_bits"))
    at = F.bitmap_bit_position(place())
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(bits), F.bitmap_bucket_number(place()) == F.col("_bucket"))
    return found.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def _voters(entries: DataFrame) -> dict[int, int]:
    """Each entry of a lexicon or pattern and its voter, from the entries that stand out most; dealt by rank, so that voters are alike in strength."""
    out = {}
    for kind, count, first in (("feature >= 0", LEXICONS, 0), ("feature < 0", PATTERNS, LEXICONS)):
        best = entries.where(kind).orderBy(F.desc("z"), "feature").limit(ENTRIES).collect()
        out |= {r.feature: first + i % count for i, r in enumerate(best)}
    return out


def votes_of(docs: DataFrame, voters: dict[int, int], text: str = "text") -> DataFrame:
    """pattern, how the voters vote on each text, a bit for each; same, a digest of the text."""
    shared = docs.sparkSession.sparkContext.broadcast({f & 0xFFFFFFFF: 1 << v for f, v in voters.items()})  # at most twice ENTRIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, known = shared.value, {}
        for batch in batches:
            patterns, same = [], []
            for x in batch.column(text):
                value = x.as_py() or ""
                words = words_of(value)
                if len(known) > 100_000:
                    known.clear()
                for w in words.difference(known):
                    known[w] = reduce(or_, (entries.get(f, 0) for f in features_of_word(w)))
                loud, capitals = shouts(value)
                patterns.append(reduce(or_, map(known.__getitem__, words), (loud << VOTERS - 2) | (capitals << VOTERS - 1)))
                same.append(xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) >> 1)
            yield pa.RecordBatch.from_pydict({"pattern": pa.array(patterns, pa.int32()), "same": pa.array(same, pa.int64())})

    return docs.select(text).mapInArrow(run, "pattern int, same bigint")


def as_votes(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] >> np.arange(VOTERS) & 1).astype(np.float64)


def fit_labels(docs: DataFrame, voters: dict[int, int], text: str = "text") -> LabelModel:
    """The label model over all distinct texts of docs; at most 2 to the number of voters rows reach the driver, whatever the number of texts."""
    table = votes_of(docs, voters, text).distinct().groupBy("pattern").count().toPandas().sort_values("pattern")
    return LabelModel().fit(as_votes(table["pattern"].to_numpy(np.int64)), table["count"].to_numpy())


def _judged(sample: DataFrame, voters: dict[int, int], model: LabelModel) -> DataFrame:
    """Features of the sample's rows with their weight and posterior label; up and down are the weight's shares of either class."""
    shared = sample.sparkSession.sparkContext.broadcast((model, sorted(voters.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, entries = shared.value
        names, bits = np.array([f for f, _ in entries] + [1 << 40], np.int64), np.array([1 << v for _, v in entries] + [0], np.int64)
        for batch in batches:
            flat, rows = _flat(batch)
            at = np.searchsorted(names, flat)
            hit = names[at] == flat
            pattern = batch.column("loud").cast(pa.int64()).to_numpy(zero_copy_only=False) << VOTERS - 2 | batch.column("capitals").cast(pa.int64()).to_numpy(zero_copy_only=False) << VOTERS - 1
            np.bitwise_or.at(pattern, rows[hit], bits[at[hit]])
            post, weight = model.posterior(as_votes(pattern)), batch.column("weight").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"features": batch.column("features"), "weight": batch.column("weight"), "post": pa.array(post), "up": pa.array(weight * post), "down": pa.array(weight * (1 - post))})

    return sample.select("features", "loud", "capitals", "weight").mapInArrow(run, "features array<int>, weight double, post double, up double, down double")


def _fit_classifier(judged: DataFrame) -> Classifier:
    """A linear classifier on the features that the posterior labels set apart; the driver gets only those of each row."""
    total = judged.agg(F.sum("up"), F.sum("down")).first()
    n_p, n_q = total[0] or 0.0, total[1] or 0.0
    up, down = F.col("up"), F.col("down")
    # only what speaks for the class: common words that lean a little to either side would add up in long texts
    apart = _counted(judged).where((_surprise(up, down, n_p, n_q) >= FEATURE_Z) & ((up + 0.5) / (n_p + 1) >= FEATURE_LIFT * (down + 0.5) / (n_q + 1)))
    use = np.sort(apart.select("feature").toPandas()["feature"].to_numpy(np.int64))
    shared = judged.sparkSession.sparkContext.broadcast(use)  # at most the distinct features of the bounded sample that stand out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.append(shared.value, 1 << 40)
        for batch in batches:
            flat, rows = _flat(batch)
            at = np.searchsorted(names, flat)
            hit = names[at] == flat
            ends = np.append(0, np.cumsum(np.bincount(rows[hit], minlength=batch.num_rows)))
            on = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[hit], pa.int32()))
            yield pa.RecordBatch.from_pydict({"on": on, "post": batch.column("post"), "weight": batch.column("weight")})

    got = judged.select("features", "post", "weight").mapInArrow(run, "on array<int>, post double, weight double").toPandas()
    # in an order of their own, so that reruns agree whatever the partitions
    rows = sorted((tuple(on), post, weight) for on, post, weight in zip(got["on"], got["post"], got["weight"]))
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    cols = np.concatenate([np.zeros(0, np.int64), *(np.array(r[0], np.int64) for r in rows)])
    bias, w = _train(at, cols, max(1, len(use)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    return Classifier(bias, dict(zip((use & 0xFFFFFFFF).tolist(), w.tolist())))


def fit_on(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Classifier:
    """Fit on the rows of docs outside the held-out fold: voters by all labelled rows, the label model by all rows, the classifier by about FIT_LABELLED labelled ones.

    Of several labels of one doc_id the largest counts; labels other than 0
    and 1 are none. Without two different rows of each class among the labelled
    ones there is nothing to learn voters from: every text then scores the
    share of the toxic class.
    """
    marks = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    learn = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(~in_fold(F.col("doc_id"), 3, 1))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) / 1_000_000
    known = _perhaps_labelled(learn, marks).join(marks, "doc_id").select("text", "toxic", draw.alias("draw"))
    seen = materialize(known.mapInArrow(_extract, "features array<int>, sketch bigint, toxic int, loud boolean, capitals boolean, draw double"), "toxic-features")
    size = {r.toxic: r for r in seen.groupBy("toxic", "sketch").count().groupBy("toxic").agg(F.count("*").alias("different"), F.sum("count").alias("rows")).collect()}
    n_pos, n_neg = (size[x].different if x in size else 0 for x in (1, 0))
    if n_pos < 2 or n_neg < 2:
        rate = (n_pos + 0.5) / (n_pos + n_neg + 5)
        return Classifier(float(np.log(rate / (1 - rate))), {})
    weighed = _weighed(seen)
    up, down = F.col("up"), F.col("down")
    sides = weighed.select("features", F.when(F.col("toxic") == 1, F.col("weight")).otherwise(0.0).alias("up"), F.when(F.col("toxic") == 0, F.col("weight")).otherwise(0.0).alias("down"))
    often = (up + 0.5) / n_pos >= LEAST_LIFT * (down + 0.5) / n_neg
    entries = materialize(_counted(sides).where(often).select("feature", _surprise(up, down, n_pos, n_neg).alias("z")).where(F.col("z") >= VOTER_Z), "toxic-entries")
    voters = _voters(entries)
    model = fit_labels(learn, voters)
    share = FIT_LABELLED / sum(r.rows for r in size.values())
    judged = materialize(_judged(weighed.where(F.col("draw") < share), voters, model), "toxic-sample")
    return _fit_classifier(judged)


def with_score(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 from THRESHOLD on) to all columns of docs; columns of these names are replaced. Null and empty texts get the score of no words."""
    df = docs.drop("score", "predicted")
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema] + ["score double"])
    shared = df.sparkSession.sparkContext.broadcast((model.bias, model.weights))  # at most the distinct features of the bounded sample that stand out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Classifier(*shared.value)
        for batch in batches:
            got = pa.array(scorer.score_all(x.as_py() for x in batch.column(text)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, "score"])

    return df.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """The score of every document, learned outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_score(docs, model).select("doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


QUERIES = {"op1_toxicity": op1_toxicity}
SQL: dict[str, str] = {}
