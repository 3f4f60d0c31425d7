"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation in numpy.

Words are runs without white space of ASCII, A-Z lower-cased; every text ends with one end token.  The model has two
levels.  The first predicts a class: the end token, the ``HOT`` most frequent words each by itself, and groups of all
other words by their last three bytes.  The second predicts a word within its group: each word of the dictionary has a
vector and a bias of its own, the group's other words share one, and among these the share is (c+1)/(N+V+1), with one
place left for words never seen.  Both are predicted from the classes of the two words before: q = c1*r[w1] + c2*r[w2],
s(x) = q.v[x] + bias[x].  Scoring normalises both levels exactly, by batched matrix products: the first over the
contexts that occur, the second over the group's words; so the model's probabilities over words sum to one.

What is learned grows with the input: counts are taken over all training texts, the dictionary has twice the square
root of the number of training tokens (up to ``MOST`` words, a bound for the tasks' memory), and every training text is
trained on.  Training texts are dealt by hash over units of about ``UNIT`` tokens.  Each unit is trained in an order of
its own hashes from common starting values, and the units' parameters are averaged: classes by tokens seen, words by
visits.  So scores do not depend on how the input is partitioned.  Counts of words outside the dictionary reach their
documents by a join, so nothing depends on the vocabulary fitting in memory.

Edge cases: a null or empty text is one end token; a null doc_id belongs to the training part; without training texts
base_score is zero and the model uniform over groups; repeated rows are scored each; an empty table gives an empty
table; other columns of the input are not used; a text of any length is trained and scored in parts of bounded size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby, pairwise, repeat
from math import isqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import discard, text_or_empty, written

HOT, GROUPS, DIM = 511, 256, 12
CLASSES = 1 + HOT + GROUPS
FLUSH = 400_000
#: Tokens of a training unit; words of the dictionary at most; step of the training.
UNIT, MOST, RATE = 2_000_000, 200_000, 0.1


def held_out(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def group_of(word: bytes) -> int:
    return 1 + HOT + crc32(word[-3:]) % GROUPS


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["w", "n"])

    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0):
            seen.update(split(text.as_py()))
            if len(seen) > FLUSH:
                yield rows(seen)
                seen = Counter()
    if seen:
        yield rows(seen)


class Words:
    """The dictionary as tasks know it: index of each word, its class, slot and log10(c+1); sizes of what is left over.

    Indices go by frequency, the end token's comes last.  Words after the first ``HOT`` have a slot; slots lie group by
    group, and each group's last slot stands for all its words outside the dictionary."""

    def __init__(self, top: list[tuple[bytes, int]], ends: int, sizes: dict[int, tuple[int, int]]):
        """sizes: by group, tokens and words of the corpus outside the first ``HOT``."""
        self.index = {w: i for i, (w, _) in enumerate(top)}
        d = len(top)
        count = np.array([c for _, c in top] + [ends], dtype=np.float64)
        self.cls = np.array([1 + i if i < HOT else group_of(w) for i, (w, _) in enumerate(top)] + [0], dtype=np.int32)
        self.log_count, self.known = np.log10(count + 1), count > 0
        total, number = (np.array([sizes.get(g, (0, 0))[k] for g in range(CLASSES)], dtype=np.float64) for k in (0, 1))
        own = np.arange(min(HOT, d), d)
        rest = total - np.bincount(self.cls[own], count[own], CLASSES)
        self.log_rest = np.log10(rest + number - np.bincount(self.cls[own], minlength=CLASSES) + 1)
        groups = np.arange(1 + HOT, CLASSES)
        # dictionary words of each group by index, then the group's rest
        order = np.lexsort((np.concatenate([own, np.full(GROUPS, d + 1)]), np.concatenate([self.cls[own], groups])))
        at = np.empty(len(order), np.int32)
        at[order] = np.arange(len(order))
        self.slot = np.full(d + 1, -1, np.int32)
        self.slot[own] = at[: len(own)]
        self.rest = np.full(CLASSES, -1, np.int32)
        self.rest[1 + HOT :] = at[len(own) :]
        self.first = np.concatenate([[0], self.rest[1 + HOT : -1] + 1])  # of each group's slots
        mass = np.concatenate([count[own], np.maximum(rest[groups], 0)])[order] + 1
        self.shares = (mass / np.repeat(np.add.reduceat(mass, self.first), np.diff([*self.first, len(mass)]))).astype(np.float64)
        self.cumulative = np.cumsum(self.shares)  # each group's sums to one, so group g's runs from g to g + 1
        seen = total.copy()
        seen[0], seen[1 : 1 + min(HOT, d)] = ends, count[: min(HOT, d)]
        self.noise = (seen + 0.5) / (seen + 0.5).sum()

    def coded(self, text: str) -> tuple[np.ndarray, list[bytes]]:
        """Indices of the words and of the end, for a word outside the dictionary its group less than zero; those words."""
        words = split(text)
        out = np.fromiter(map(self.index.get, words, repeat(-1)), dtype=np.int32, count=len(words))
        other = np.flatnonzero(out < 0)
        rare = [words[i] for i in other.tolist()]
        out[other] = [-1 - HOT - crc32(w[-3:]) % GROUPS for w in rare]
        return np.append(out, np.int32(len(self.cls) - 1)), rare

    def placed(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and slot (-1: none) of coded words."""
        inside, known = ids >= 0, np.maximum(ids, 0)
        cls = np.where(inside, self.cls[known], -ids)
        return cls, np.where(inside, self.slot[known], self.rest[cls])


class Model:
    """One row of ``classes`` for each class: r, its vector as context, t, its vector as target, and its bias; of ``slots``
    for each slot: u, its vector, and its bias; c: weights of the two places before."""

    def __init__(self, words: Words, seed: int):
        self.classes = np.random.default_rng(seed).normal(0, 0.1, (CLASSES, 2 * DIM + 1)).astype(np.float32)
        self.classes[:, -1] = np.log(words.noise)
        self.slots = np.zeros((len(words.shares), DIM + 1), np.float32)
        self.slots[:, -1] = np.log(words.shares)
        self.c = np.ones((2, DIM), np.float32)

    @property
    def r(self) -> np.ndarray:
        return self.classes[:, :DIM]

    @property
    def t(self) -> np.ndarray:
        return self.classes[:, DIM:-1]

    @property
    def b(self) -> np.ndarray:
        return self.classes[:, -1]

    def dense(self) -> np.ndarray:
        """The parameters of the first level."""
        return np.concatenate([self.classes.ravel(), self.c.ravel()])

    def put(self, dense: np.ndarray, slots: np.ndarray) -> None:
        self.classes.ravel()[:], self.c.ravel()[:] = dense[: self.classes.size], dense[self.classes.size :]
        self.slots[:] = slots

    def queries(self, e: np.ndarray) -> np.ndarray:
        """What each place of a sequence of context vectors predicts from; the first two lack their contexts."""
        q = np.zeros(e.shape, np.float32)
        q[2:] = e[1:-1] * self.c[0] + e[:-2] * self.c[1]
        return q

    def train(self, docs: Iterator[np.ndarray], words: Words, seed: int, batch: int = 2048, k: int = 32, own: int = 1, rate: float = RATE) -> tuple[int, np.ndarray]:
        """One pass of noise-contrastive estimation with Adagrad over coded texts: tokens seen, visits of each slot."""
        rng = np.random.default_rng(seed)
        log_noise, log_share = np.log(k * words.noise).astype(np.float32), np.log(own * words.shares).astype(np.float32)
        drawn_from = np.cumsum(words.noise)
        drawn_from[-1] = 1.0
        past = {x: np.ones_like(getattr(self, x)) for x in ("classes", "slots", "c")}
        visits = np.zeros(len(self.slots), np.int64)
        total = 0

        def step(name: str, rows, grad: np.ndarray) -> None:
            x, p = getattr(self, name), past[name]
            seen = p[rows] + grad * grad
            p[rows] = seen
            np.sqrt(seen, out=seen)
            x[rows] -= rate * grad / seen

        for ids, real in batches(docs, batch, len(words.cls) - 1):
            cls, slot = words.placed(ids)
            total += int(real.sum())
            mine = self.classes[cls]
            e, t = mine[:, :DIM], mine[:, DIM:-1]
            q = self.queries(e)
            up = (sigmoid(np.einsum("ij,ij->i", q, t) + mine[:, -1] - log_noise[cls]) - 1) * real
            drawn = np.searchsorted(drawn_from, rng.random(k), side="right")
            other = self.classes[drawn]
            down = sigmoid(q @ other[:, DIM:-1].T + (other[:, -1] - log_noise[drawn])) * real[:, None]
            dq = up[:, None] * t + down @ other[:, DIM:-1]
            at = np.flatnonzero((slot >= 0) & (real > 0))
            group = cls[at] - 1 - HOT
            noise = np.minimum(np.searchsorted(words.cumulative, (group[:, None] + rng.random((len(at), own))).ravel()), len(self.slots) - 1)
            rows = np.concatenate([slot[at], noise])
            theirs, asked = self.slots[rows], q[np.concatenate([at, np.repeat(at, own)])]
            err = sigmoid(np.einsum("ij,ij->i", asked, theirs[:, :-1]) + theirs[:, -1] - log_share[rows])
            err[: len(at)] -= 1
            pull = err[:, None] * theirs[:, :-1]
            dq[at] += pull[: len(at)] + pull[len(at) :].reshape(len(at), own, DIM).sum(1)
            # gradients: a place is the context of the two after it
            grad = np.zeros(mine.shape, np.float32)
            grad[:-1, :DIM] = dq[1:] * self.c[0]
            grad[:-2, :DIM] += dq[2:] * self.c[1]
            grad[:, DIM:-1] = up[:, None] * q
            grad[:, -1] = up
            met, sums = summed(cls, grad)
            step("c", slice(None), np.stack([np.einsum("ij,ij->j", dq[1:], e[:-1]), np.einsum("ij,ij->j", dq[2:], e[:-2])]))
            step("classes", met, sums)
            grad = np.zeros(other.shape, np.float32)
            grad[:, DIM:-1], grad[:, -1] = down.T @ q, down.sum(0)
            step("classes", *summed(drawn, grad))
            if len(at):
                grad = np.empty(theirs.shape, np.float32)
                np.multiply(err[:, None], asked, out=grad[:, :-1])
                grad[:, -1] = err
                met, sums = summed(rows, grad)
                step("slots", met, sums)
                visits[met] += 1
        return total, visits


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def ordered_by(x: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers; those that fit 16 bits are sorted by their digits."""
    return np.argsort(x.astype(np.int16) if len(x) and -(1 << 15) <= x.min() and x.max() < 1 << 15 else x, kind="stable")


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and the sum of the values of each."""
    order = ordered_by(rows)
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.add.reduceat(values[order], first, axis=0)


def batches(docs: Iterator[np.ndarray], size: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Coded texts laid end to end, each after two end tokens that are no targets, in pieces of about ``size``; 1 where real."""
    held, n = [], 0
    for ids in docs:
        for begin in range(0, len(ids), 8 * size):  # a long text goes in parts that keep the words before them
            part = ids[max(0, begin - 2) : begin + 8 * size]
            lead = part[:2] if begin > 1 else np.full(2, end, np.int32)
            held.append((lead, part[2:] if begin > 1 else part))
            n += len(held[-1][1])
            if n >= size:
                yield _laid(held)
                held, n = [], 0
    if held:
        yield _laid(held)


def _laid(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    ids = np.concatenate([x for pair in held for x in pair])
    return ids, np.concatenate([np.full(len(x), i, np.float32) for pair in held for i, x in enumerate(pair)])


def count_words(docs: DataFrame) -> DataFrame:
    """w, n, g: count and group of every word of ``docs.t``; partial counts leave each task combined."""
    counts = docs.select("t").mapInArrow(_count, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    return counts.withColumn("g", (1 + HOT + F.crc32(F.substring("w", -3, 3)) % GROUPS).cast("int"))  # as ``group_of``


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """Up to ``most`` words, most frequent first: all whose count reaches a step of a fixed ladder (four to a doubling).

    The step comes from the number of words on each, so only the words themselves reach the driver, not each task's."""
    step = F.floor(4 * F.log2("n")).cast("int")
    held, least = 0, None
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r["s"]):
        held += r["words"]
        if held > most:
            break
        least = r["s"]
    if least is None:
        return []
    return sorted(((bytes(r["w"]), r["n"]) for r in counts.where(step >= least).select("w", "n").collect()), key=lambda x: (-x[1], x[0]))


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of some columns; arrays of numbers as numpy arrays."""
    for batch in batches:
        cols = [batch.column(c) for c in columns]
        for i in range(batch.num_rows):
            yield tuple(c[i].values.to_numpy() if pa.types.is_list(c.type) else c[i].as_py() for c in cols)


def code(docs: DataFrame, words) -> DataFrame:
    """doc_id, held_out, key, ids and rest of each row of ``docs``: coded words, and the words outside the dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        for batch in batches:
            texts = batch.column("t")
            for at in range(0, batch.num_rows, 512):
                found = [known.coded(x.as_py()) for x in texts.slice(at, 512)]
                cols = [batch.column(c).slice(at, 512) for c in ("doc_id", "held_out", "key")]
                yield pa.record_batch([*cols, pa.array([x for x, _ in found], pa.list_(pa.int32())), pa.array([r for _, r in found], pa.list_(pa.binary()))], names=["doc_id", "held_out", "key", "ids", "rest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.withColumn("key", F.xxhash64("doc_id", "t"))
    return keyed.mapInArrow(run, f"doc_id {kind}, held_out boolean, key bigint, ids array<int>, rest array<binary>")


def train(coded: DataFrame, words, tokens: int, seed: int = 11, rounds: int = 1) -> Model:
    """The model after ``rounds`` passes over the training texts of ``coded``; ``words`` is a broadcast Words.

    Only averages reach the driver: of the classes from a root of the units, of the slots one row for each."""
    known = words.value
    model = Model(known, seed)
    units = max(1, -(-tokens // UNIT))
    dealt = coded.where("not held_out").select(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(units)).alias("unit"), "key", "ids")
    dealt = dealt.repartitionByRange(units, "unit").sortWithinPartitions("unit", "key")
    for i in range(rounds):
        start = model.dense(), model.slots.copy()

        def fit(batches: Iterator[pa.RecordBatch], start: tuple = start, i: int = i) -> Iterator[pa.RecordBatch]:
            for unit, texts in groupby(_rows(batches, "unit", "ids"), key=lambda x: x[0]):
                own = Model(words.value, seed)
                own.put(*start)
                seen, visits = own.train((ids for _, ids in texts), words.value, seed + 1_000_003 * i + unit)
                met = np.flatnonzero(visits)
                # the classes in a row without a slot, then the slots that were met
                rows = [own.dense(), *own.slots[met]]
                slots = pa.array([None, *met.tolist()], pa.int32())
                yield pa.record_batch([pa.array(np.full(len(rows), unit)), slots, pa.array([seen, *visits[met].tolist()], pa.int64()), pa.array(rows, pa.list_(pa.float32()))], names=["unit", "slot", "n", "p"])

        fitted = written(dealt.mapInArrow(fit, "unit bigint, slot int, n bigint, p array<float>"), "fitted")
        some = F.pmod("unit", F.lit(isqrt(units) + 1)).alias("some")
        mean = fitted.where("slot is null").groupBy(some).agg(Summarizer.mean(array_to_vector("p"), F.col("n").cast("double")).alias("p"), F.sum("n").alias("n")).collect()
        if mean:
            dense = sum(r["p"].toArray() * r["n"] for r in mean) / sum(r["n"] for r in mean)
            each = [(F.sum(F.get("p", F.lit(d)).cast("double") * F.col("n")) / F.sum("n")).alias(f"p{d}") for d in range(DIM + 1)]
            slots = fitted.where("slot is not null").groupBy("slot").agg(*each).collect()
            if slots:
                start[1][[r["slot"] for r in slots]] = [r[1:] for r in slots]
            model.put(dense, start[1])
        discard(fitted)
    return model


class Scorer:
    """log10 probabilities of coded words; remembers the first level's normalisers by pair of classes."""

    def __init__(self, model: Model, words: Words):
        self.model, self.words = model, words
        self.near, self.far = model.r * model.c[0], model.r * model.c[1]
        self.one, self.two = self.near @ model.t.T + model.b, self.far @ model.t.T
        self.log_z = np.full((CLASSES, CLASSES), np.nan, np.float32)

    def log_classes(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        """Natural log probabilities of all classes after each context."""
        s = self.one[w1] + self.two[w2]
        return s - self._log_sum(s)[:, None]

    @staticmethod
    def _log_sum(s: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            total = np.exp(s).sum(1)
        if np.isfinite(total).all() and total.all():
            return np.log(total)
        top = s.max(1, keepdims=True)
        return np.log(np.exp(s - top).sum(1)) + top[:, 0]

    def log_slots(self, group: int, q: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Natural log probability of a slot of a group from each query."""
        a, b = self.words.first[group - 1 - HOT], self.words.rest[group] + 1
        s = q @ self.model.slots[a:b, :-1].T + self.model.slots[a:b, -1]
        return s[np.arange(len(s)), slot - a] - self._log_sum(s)

    def tokens(self, ids: np.ndarray) -> np.ndarray:
        """Of a sequence, log10 probabilities from the third place on; for words outside the dictionary all but log10(c+1)."""
        cls, slot = self.words.placed(ids)
        w1, w2, w = cls[1:-1], cls[:-2], cls[2:]
        pairs = w1.astype(np.int64) * CLASSES + w2
        fresh = np.unique(pairs[np.isnan(self.log_z[w1, w2])])
        for some in np.array_split(fresh, max(1, len(fresh) // 2048)):
            self.log_z[some // CLASSES, some % CLASSES] = self._log_sum(self.one[some // CLASSES] + self.two[some % CLASSES]) if len(some) else 0
        out = (self.one[w1, w] + self.two[w2, w] - self.log_z[w1, w2]).astype(np.float64)
        order = ordered_by(w)
        bounds = np.searchsorted(w[order], np.arange(1 + HOT, CLASSES + 1))
        for group, (a, b) in enumerate(pairwise(bounds.tolist()), 1 + HOT):
            for at in range(a, b, 2048):
                here = order[at : min(b, at + 2048)]
                q = self.near[w1[here]] + self.far[w2[here]]
                out[here] += self.log_slots(group, q, slot[2 + here])
        out /= np.log(10)
        rare = ids[2:] < 0
        out[rare] -= self.words.log_rest[w[rare]]
        return out


_kept: list = []


def scorer_of(model: Model, words: Words) -> Scorer:
    """The scorer of a model.  A Python worker keeps its last one, so normalisers are summed once a worker, not once a task."""
    if not _kept or _kept[0] is not model or _kept[1].words is not words:
        _kept[:] = [model, Scorer(model, words)]
    return _kept[1]


def _scorer(words, model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        scorer, end = scorer_of(model.value, known), len(known.cls) - 1
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x for (x,) in _rows([part], "ids")]
                inside = [x[x >= 0] for x in texts]
                log_count = [float(known.log_count[x].sum()) for x in inside]
                n_known = [int(known.known[x].sum()) for x in inside]
                sums = np.zeros(len(texts))
                held, n = [], 0
                for i, x in enumerate(texts):
                    for begin in range(0, len(x), PIECE):
                        lead = x[begin - 2 : begin] if begin else np.full(2, end, np.int32)
                        held.append((i, np.concatenate([lead, x[begin : begin + PIECE]])))
                        n += len(held[-1][1])
                        if n >= PIECE:
                            _add(sums, held, scorer)
                            held, n = [], 0
                _add(sums, held, scorer)
                cols = {"n_tokens": [len(x) for x in texts], "n_known": n_known, "log_count": log_count, "model": sums}
                yield pa.record_batch([*(part.column(c) for c in ("row", "doc_id", "held_out")), *map(pa.array, cols.values())], names=["row", "doc_id", "held_out", *cols])

    return score


#: Tokens that are scored at once.
PIECE = 1 << 17


def _add(sums: np.ndarray, held: list[tuple[int, np.ndarray]], scorer: Scorer) -> None:
    """Add each piece's log10 probabilities to its text's; pieces begin with the two words before them."""
    if held:
        got = scorer.tokens(np.concatenate([x for _, x in held]))
        ends = np.cumsum([len(x) for _, x in held])
        for (i, x), e in zip(held, ends.tolist(), strict=True):
            sums[i] += got[e - len(x) : e - 2].sum()


def scores(df: DataFrame, text: str = "text", doc_id: str = "doc_id", dictionary: int | None = None, rounds: int = 1, seed: int = 11) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``df``.

    dictionary: how many of the most frequent words have a vector of their own; by default it grows with the input."""
    docs = df.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), text_or_empty(text).alias("t"))
    training = docs.where(~F.col("held_out"))
    counts = written(count_words(training), "counts")
    ends = training.count()
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = totals[0] + ends, totals[1] + (ends > 0)
    top = most_frequent(counts, min(2 * isqrt(n), MOST) if dictionary is None else dictionary)
    hot = [w for w, _ in top[:HOT]]
    others = counts.where(~F.col("w").isin(hot)) if hot else counts
    sizes = {r["g"]: (r["n"], r["v"]) for r in others.groupBy("g").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    share = df.sparkSession.sparkContext.broadcast
    words = share(Words(top, ends, sizes))
    coded = written(code(docs, words).withColumn("row", F.monotonically_increasing_id()), "coded")
    model = share(train(coded, words, n, seed, rounds))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = f"row bigint, doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, log_count double, model double"
    first = coded.select("row", "doc_id", "held_out", "ids").mapInArrow(_scorer(words, model), kind)
    rare = coded.select("row", F.explode("rest").alias("w")).join(counts.select("w", "n"), "w")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count("*").alias("met"))
    both = first.join(rare, "row", "left").withColumns({"more": F.coalesce("more", F.lit(0.0)), "met": F.coalesce("met", F.lit(0))})
    base = F.col("log_count") + F.col("more") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("met")).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), base.alias("base_score"), (F.col("model") + F.col("more")).alias("score"))
