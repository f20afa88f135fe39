"""Scores of whole texts under a log-bilinear language model.

Tokens are the words of a text in lower case (A-Z only) and one end token. The model predicts the next
token from the two before it, in two levels. A linear map of their vectors is compared with the vector of
each class, and a softmax over the ``CLASSES`` most frequent tokens and the groups of all others normalises.
In a group another map is compared with the vectors of its ``GROUP`` leaves, again with a softmax: up to rank
``OWN`` a leaf is one token, beyond that the tokens of one hash bucket. Only inside such a bucket a token
takes its smoothed share whatever the context, so the probabilities of all known tokens and one unknown one
of each bucket add up to 1. Both levels are trained by noise-contrastive estimation on every token of the
training texts, inside the tasks, in ``ROUNDS`` passes over the tokens' ranks, which are written once, with
the parameters averaged after each; counts cover all tokens.

Counting merges inside the tasks and by a shuffle. Scoring looks the ``HEAD`` most frequent tokens up in a
table of that fixed size; the others are joined by a shuffle, one row for each text and token.

Defined cases: a null or empty text is its end token; texts of null ids are scored but not learned from;
without training texts every token has probability 1 / (V + 1) = 1; repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.arrays import Texts, lower_ascii, mixed, ragged, slices, word_hashes, words_of
from tabwright.llm.rows import arrow_schema, ddl, lean, map_texts, text_key
from tabwright.plans import storage

HEAD, INPUTS, CLASSES, WIDTH = 100_000, 20_000, 255, 16
GROUP = 256
OWN, BUCKETS = CLASSES + 128 * GROUP, 64 * GROUP
NOISE, DRAWN, ROUNDS, EPOCHS, BATCH, RATE = 16, 64, 2, 4, 1024, 0.1
FLUSH = 1 << 20
TASK_TOKENS = 1 << 21
SLICE = 1 << 17
END = np.uint64(0x5DEECE66D1234567)


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text's words and its end token, and where each text begins."""
    lowered = Texts(texts.first, lower_ascii(texts.data), texts.offsets)
    words = words_of(lowered)
    codes = word_hashes(lowered.data, words)
    first = words.first + np.arange(texts.rows + 1)
    found = np.full(first[-1], END, np.uint64)
    found[ragged(first[:-1], words.counts)] = codes
    return found, first


def counted(docs: DataFrame) -> DataFrame:
    """token, n: how often each token occurs in ``docs``."""
    result = {"token": "bigint", "n": "bigint"}
    schema = arrow_schema(result)

    def merged(parts):
        keys = np.concatenate([k for k, _ in parts])
        values = np.concatenate([v for _, v in parts])
        keys, place = np.unique(keys, return_inverse=True)
        return keys, np.bincount(place, values, minlength=len(keys)).astype(np.int64)

    def rows(part):
        return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1])], schema=schema)

    def count(batches):
        parts, size = [], 0
        for batch in batches:
            for texts in slices(batch.column("text")):
                keys, times = np.unique(tokens(texts)[0], return_counts=True)
                parts.append((keys, times))
                size += len(keys)
                if size > 2 * FLUSH:
                    parts = [merged(parts)]
                    size = len(parts[0][0])
                    if size > FLUSH:
                        yield rows(parts[0])
                        parts, size = [], 0
        if parts:
            yield rows(merged(parts))

    return docs.select("text").mapInArrow(lean(count), ddl(result)).groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The most frequent tokens, by falling count, and the totals of all.

    ``masses`` are the smoothed counts of the hash buckets (a power of two of them) of all tokens without a leaf of
    their own, each with one unknown token; without it they are one bucket.
    """

    tokens: np.ndarray
    counts: np.ndarray
    total: int
    different: int
    masses: np.ndarray | None = None

    def __post_init__(self):
        self.order = np.argsort(self.tokens)
        self.sorted = self.tokens[self.order]
        self.classes = min(CLASSES, len(self.tokens))
        self.rest = float(self.total - self.counts[:self.classes].sum() + self.different - self.classes + 1)
        self.own = min(OWN, len(self.tokens))
        self.inputs = min(INPUTS, self.own)
        if self.masses is None:
            self.masses = np.array([float(self.total - self.counts[:self.own].sum() + self.different - self.own + 1)])
        self.leaves = np.append(self.counts[self.classes:self.own], self.masses).astype(float)
        self.groups = -(-len(self.leaves) // GROUP)

    def rank(self, found: np.ndarray) -> np.ndarray:
        """The place of each token; the number of tokens held for all others."""
        none = len(self.tokens)
        if not none:
            return np.zeros(len(found), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, found), none - 1)
        return np.where(self.sorted[at] == found, self.order[at], none)

    def units(self, found: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """What the model tells apart: the rank of a token with a class or leaf of its own, else its bucket behind these."""
        return np.where(rank < self.own, rank, self.own + (found & np.uint64(len(self.masses) - 1)).astype(np.int64))

    def classes_of(self, units: np.ndarray) -> np.ndarray:
        """The class of the first level: the unit itself, or its group."""
        return np.where(units < self.classes, units, self.classes + (units - self.classes) // GROUP)


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """From (token, n): the ``HEAD`` most frequent tokens, and the masses of up to ``BUCKETS`` buckets of the others."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "token").limit(HEAD).toArrow()
    tokens, times = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
    own = min(OWN, len(tokens))
    buckets = min(BUCKETS, 1 << max((total[1] - own) // 8, 1).bit_length() - 1)
    found = counts.groupBy(F.col("token").bitwiseAND(F.lit(buckets - 1)).alias("bucket")).agg(F.sum(F.col("n") + 1).alias("n")).toArrow()
    masses = np.ones(buckets)  # an unknown token in each
    masses[found["bucket"].to_numpy()] += found["n"].to_numpy()
    masses -= np.bincount((tokens[:own] & np.uint64(buckets - 1)).astype(np.int64), times[:own] + 1, buckets)
    return Vocabulary(tokens, times, total[0], total[1], masses)


def contexts(vocabulary: Vocabulary, rank: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The input numbers of the token before, and of the one before that: 0 is the begin of the text,
    1 any token beyond the ``INPUTS`` most frequent ones."""
    number = np.where(rank < vocabulary.inputs, rank + 2, 1)
    one, two = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
    one[1:], two[2:] = number[:-1], number[:-2]
    begins = first[:-1]
    one[begins] = two[begins] = 0
    second = begins[np.diff(first) > 1] + 1
    two[second] = 0
    return one, two


def events(vocabulary: Vocabulary, rank: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (class, input before, input before that, unit) of all tokens, from their units."""
    return np.stack([vocabulary.classes_of(rank), *contexts(vocabulary, rank, first), rank], axis=1)


def ranked(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The units of each text's tokens (their ranks, or buckets behind these) as 32-bit integers, found once for all passes."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def start():
        words = shared.value

        def work(texts, rows):
            found, first = tokens(texts)
            data = pa.py_buffer(words.units(found, words.rank(found)).astype(np.int32))
            return [pa.BinaryArray.from_buffers(pa.binary(), texts.rows, [None, pa.py_buffer((first * 4).astype(np.int32)), data])]
        return work

    return map_texts(docs.select("text"), {"ranks": "binary"}, start)


def rank_slices(column: pa.Array):
    """Ranks of the texts of some rows at a time, with about ``SLICE`` tokens, and where each text begins."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(np.int32) if ends[-1] > ends[0] else np.zeros(0, np.int32)
    ends = (ends - ends[0]) // 4
    row, last = 0, len(column)
    while row < last:
        stop = min(max(int(np.searchsorted(ends, ends[row] + SLICE, "right")) - 1, row + 1), last)
        yield data[ends[row]:ends[stop]].astype(np.int64), ends[row:stop + 1] - ends[row]
        row = stop


def _logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)) in place; an overflow of exp is an infinity, which gives 0."""
    with np.errstate(over="ignore"):
        np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.divide(1, x, out=x)


def _contrasted(context: np.ndarray, truth: np.ndarray, noise: np.ndarray, classes: np.ndarray, bias: np.ndarray,
                offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of noise-contrastive estimation for the contexts, the classes and the biases, summed over the events
    that share the noise; and the classes that took part, with repeats. ``offset`` is the noise's log density."""
    true_classes, noise_classes, shifted = classes[truth], classes[noise], bias - offset
    wrong = -_logistic(-np.einsum("nd,nd->n", context, true_classes) - shifted[truth])
    error = _logistic(context @ noise_classes.T + shifted[noise])
    error *= NOISE / DRAWN
    to_context = wrong[:, None] * true_classes + error @ noise_classes
    rows = np.concatenate([truth, noise])
    pull = np.bincount(rows, np.concatenate([wrong, error.sum(axis=0)]), len(bias))
    cells = (rows[:, None] * WIDTH + np.arange(WIDTH)).reshape(-1)
    parts = np.concatenate([wrong[:, None] * context, error.T @ context])
    by_class = np.bincount(cells, parts.reshape(-1), len(bias) * WIDTH).reshape(-1, WIDTH)
    return to_context, by_class.astype(np.float32), pull.astype(np.float32), rows


def _step(values: np.ndarray, seen: np.ndarray, gradient: np.ndarray) -> None:
    """AdaGrad."""
    seen += gradient**2
    values -= RATE * gradient / np.sqrt(seen)


class Network:
    """The parameters in training, and AdaGrad's sums of squares: rows of ``WIDTH`` numbers, in one matrix each.

    ``changed`` counts for each row the events that changed it, ``touched`` those of the first level, where rows of
    all but the input vectors take part in every event.
    """

    def __init__(self, vocabulary: Vocabulary, values: np.ndarray | None = None, seen: np.ndarray | None = None):
        self.top, leaves = vocabulary.classes, len(vocabulary.leaves)
        size, self.inputs = self.top + vocabulary.groups, vocabulary.inputs + 2
        begins = np.arange(0, leaves, GROUP)
        masses = np.add.reduceat(vocabulary.leaves, begins)
        own = np.append(vocabulary.counts[:self.top], masses).astype(float)
        share = own / own.sum()
        group = np.arange(leaves) // GROUP
        inner = vocabulary.leaves / masses[group]
        cuts = np.cumsum([self.inputs, 2 * WIDTH, size, -(-size // WIDTH), 2 * WIDTH, leaves, -(-leaves // WIDTH)])
        if values is None:
            rng = np.random.default_rng(3)
            values = np.zeros((cuts[6], WIDTH), np.float32)
            values[:cuts[0]] = rng.normal(0, 0.1, (self.inputs, WIDTH))
            values[cuts[0]:cuts[1]] = values[cuts[3]:cuts[4]] = np.concatenate([np.eye(WIDTH), 0.5 * np.eye(WIDTH)])
            values[cuts[1]:cuts[2]] = rng.normal(0, 0.1, (size, WIDTH))
            values[cuts[2]:cuts[3]].reshape(-1)[:size] = np.log(share)
            values[cuts[4]:cuts[5]] = rng.normal(0, 0.1, (leaves, WIDTH))
            values[cuts[5]:].reshape(-1)[:leaves] = np.log(inner)
            seen = np.full(values.shape, 1e-6, np.float32)
        self.values, self.seen = values, seen
        self.changed = np.zeros(len(values), np.int64)
        self.touched = self.changed[:cuts[3]]
        self.cuts, self.log_noise, self.ladder = cuts, np.log(NOISE * share).astype(np.float32), np.cumsum(share)
        self.inner_noise = np.log(NOISE * inner).astype(np.float32)
        steps = np.cumsum(vocabulary.leaves)
        self.inner_ladder = (steps - np.append(0, steps[begins[1:] - 1])[group]) / masses[group]

        def parts(x):
            return (x[:cuts[0]], x[cuts[0]:cuts[1]].reshape(2, WIDTH, WIDTH), x[cuts[1]:cuts[2]], x[cuts[2]:cuts[3]].reshape(-1)[:size],
                    x[cuts[3]:cuts[4]].reshape(2, WIDTH, WIDTH), x[cuts[4]:cuts[5]], x[cuts[5]:].reshape(-1)[:leaves])

        self.vectors, self.maps, self.classes, self.bias, self.inner_maps, self.leaves, self.leaf_bias = parts(values)
        self.of = dict(zip(("vectors", "maps", "classes", "bias", "inner_maps", "leaves", "leaf_bias"), parts(seen)))

    def learn(self, found: np.ndarray, rng: np.random.Generator) -> None:
        """One pass of the first level over events, in random order. The noise of a batch is drawn once for all its events."""
        vectors, maps, classes, bias, seen = self.vectors, self.maps, self.classes, self.bias, self.of
        shuffled = np.ascontiguousarray(found[rng.permutation(len(found)), :3].T)
        small = np.uint16 if self.inputs <= 1 << 16 else np.int64  # a short type sorts by radix
        for at in range(0, len(found), BATCH):
            truth, one, two = shuffled[:, at:at + BATCH]
            n = len(truth)
            noise = np.minimum(np.searchsorted(self.ladder, rng.random(DRAWN)), len(bias) - 1)
            first, second = vectors[one], vectors[two]
            context = first @ maps[0] + second @ maps[1]
            to_context, by_class, pull, _ = _contrasted(context, truth, noise, classes, bias, self.log_noise)
            _step(classes, seen["classes"], by_class / n)
            _step(bias, seen["bias"], pull / n)
            to_first, to_second = to_context @ maps[0].T, to_context @ maps[1].T
            _step(maps, seen["maps"], np.stack([first.T @ to_context, second.T @ to_context]) / n)
            inputs = np.concatenate([one, two])
            by_input = np.argsort(inputs.astype(small), kind="stable")
            inputs = inputs[by_input]
            begins = np.flatnonzero(np.append(True, inputs[1:] != inputs[:-1]))
            rows, times = inputs[begins], np.diff(np.append(begins, len(inputs)))
            upto = np.cumsum(np.concatenate([to_first, to_second])[by_input], axis=0, dtype=np.float64)[np.append(begins[1:], 2 * n) - 1]
            upto[1:] -= upto[:-1].copy()
            gradient = (upto / n).astype(np.float32)
            total = seen["vectors"][rows] + gradient**2
            seen["vectors"][rows] = total
            vectors[rows] -= RATE * gradient / np.sqrt(total)
            self.touched[rows] += times
            self.touched[self.inputs:] += n

    def learn_leaves(self, found: np.ndarray, rng: np.random.Generator) -> None:
        """One pass of the second level over the events (with units) that have a leaf, by group and in random order within it.

        The input vectors are those of the first level; a batch has events of one group and noise from it.
        """
        inside = found[found[:, 3] >= self.top]
        leaf = inside[:, 3] - self.top
        mixed_up = rng.permutation(len(leaf))
        group = leaf // GROUP
        order = mixed_up[np.argsort(group[mixed_up].astype(np.uint16), kind="stable")]
        leaf, group, one, two = leaf[order], group[order], inside[order, 1], inside[order, 2]
        maps, seen, cuts = self.inner_maps, self.of, self.cuts
        begins = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else group
        for begin, end in zip(begins, np.append(begins[1:], len(group))):
            low = group[begin] * GROUP
            high = min(low + GROUP, len(self.leaves))
            own, bias = self.leaves[low:high], self.leaf_bias[low:high]
            for at in range(begin, end, BATCH):
                upto = min(at + BATCH, end)
                truth, n = leaf[at:upto] - low, upto - at
                noise = np.minimum(np.searchsorted(self.inner_ladder[low:high], rng.random(DRAWN)), high - low - 1)
                first, second = self.vectors[one[at:upto]], self.vectors[two[at:upto]]
                context = first @ maps[0] + second @ maps[1]
                to_context, by_leaf, pull, rows = _contrasted(context, truth, noise, own, bias, self.inner_noise[low:high])
                _step(own, seen["leaves"][low:high], by_leaf / n)
                _step(bias, seen["leaf_bias"][low:high], pull / n)
                _step(maps, seen["inner_maps"], np.stack([first.T @ to_context, second.T @ to_context]) / n)
                self.changed[cuts[4] + low:cuts[4] + high] += np.bincount(rows, minlength=high - low)
                self.changed[cuts[3]:cuts[4]] += n
                self.changed[cuts[5] + low // WIDTH:cuts[5] - (-high // WIDTH)] += n

    def model(self) -> Model:
        levels = ((self.maps, self.classes, self.bias), (self.inner_maps, self.leaves, self.leaf_bias))
        first, second = (Model(*(x.astype(np.float32) for x in (self.vectors @ maps[0], self.vectors @ maps[1], classes, bias)))
                         for maps, classes, bias in levels)
        first.leaves = second
        return first


def trained(docs: DataFrame, vocabulary: Vocabulary) -> Network:
    """The network after ``ROUNDS`` passes over all events of ``docs``.

    In a pass every task trains a copy on its own events; then each row of the parameters becomes the mean
    of the copies that changed it, weighted by the number of events that did. The means are taken by a
    shuffle, so the driver gets one row for each row of the parameters, whatever the input.
    """
    network = Network(vocabulary)
    # a copy has a fixed size, so all of them stay in proportion to the input however many parts it comes in
    ranks = storage.written(ranked(docs, vocabulary), "ranks").coalesce(-(-max(vocabulary.total, 1) // TASK_TOKENS))
    result = {"row": "bigint", "times": "double", "numbers": "array<float>"}
    schema = arrow_schema(result)
    for number in range(ROUNDS):
        shared = docs.sparkSession.sparkContext.broadcast((vocabulary, network.values, network.seen))

        def train(batches, shared=shared, number=number):
            words, values, seen = shared.value
            own, rng = Network(words, values.copy(), seen.copy()), np.random.default_rng(number)
            for batch in batches:
                for rank, first in rank_slices(batch.column("ranks")):
                    found = events(words, rank, first)
                    own.learn(found, rng)
                    own.learn_leaves(found, rng)
            rows = np.flatnonzero(own.changed)
            times = own.changed[rows].astype(float)
            numbers = (np.concatenate([own.values[rows], own.seen[rows]], axis=1) * times[:, None]).astype(np.float32)
            cuts = np.arange(len(rows) + 1, dtype=np.int32) * (2 * WIDTH)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(times), pa.ListArray.from_arrays(cuts, numbers.reshape(-1))], schema=schema)

        copies = ranks.mapInArrow(lean(train), ddl(result))
        means = copies.groupBy("row").agg(
            F.sum("times").alias("times"), *(F.sum(F.col("numbers")[i]).alias(f"n{i}") for i in range(2 * WIDTH))).toArrow()
        rows, times = means["row"].to_numpy(), means["times"].to_numpy()
        numbers = np.stack([means[f"n{i}"].to_numpy() / times for i in range(2 * WIDTH)], axis=1)
        values, seen = network.values.copy(), network.seen.copy()
        values[rows], seen[rows] = numbers[:, :WIDTH], numbers[:, WIDTH:]  # kept in 32 bits, added up in 64
        network = Network(vocabulary, values, seen)
        network.changed[rows] = times.astype(np.int64)
        shared.unpersist()
    return network


class Model:
    """Log-bilinear scores: class vectors and biases, and the mapped vectors of both context places.

    ``leaves``, where it is set, is the second level: the classes of such a model are all leaves, by group.
    """

    leaves: Model | None = None

    def __init__(self, one: np.ndarray, two: np.ndarray, classes: np.ndarray, bias: np.ndarray):
        self.one, self.two, self.classes, self.bias = one, two, classes, bias
        self.longest = float(np.sqrt((classes * classes).sum(axis=1).max()))

    @staticmethod
    def train(found: np.ndarray, vocabulary: Vocabulary) -> Model:
        """From events in memory, in ``EPOCHS`` passes."""
        network, rng = Network(vocabulary), np.random.default_rng(3)
        for _ in range(EPOCHS):
            network.learn(found, rng)
        return network.model()

    def _scores(self, context: np.ndarray, of: slice) -> np.ndarray:
        score = context @ self.classes[of].T
        score += self.bias[of]
        # no score is larger; only where exp might overflow the largest one of each row is taken off
        if np.sqrt(np.einsum("nd,nd->n", context, context).max()) * self.longest + np.abs(self.bias[of]).max() > 60:
            score -= score.max(axis=1, keepdims=True)
        return score

    def log_in_group(self, leaf: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 of the probability of each leaf in its group, by matrix products over the events of a group."""
        found = np.empty(len(leaf))
        group = leaf // GROUP
        order = np.argsort(group.astype(np.uint16), kind="stable")
        cuts = np.searchsorted(group[order], np.arange(-(-len(self.classes) // GROUP) + 1))
        for number in np.flatnonzero(np.diff(cuts)):
            for at in range(cuts[number], cuts[number + 1], 8192):
                chosen = order[at:min(at + 8192, cuts[number + 1])]
                score = self._scores(self.one[one[chosen]] + self.two[two[chosen]], slice(number * GROUP, (number + 1) * GROUP))
                own = score[np.arange(len(chosen)), leaf[chosen] - number * GROUP].astype(np.float64)
                found[chosen] = own - np.log(np.exp(score, out=score).sum(axis=1, dtype=np.float64))
        return found / np.log(10)

    def log_probabilities(self, truth: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 of the normalised probability of each class, by matrix products over distinct contexts."""
        found = np.empty(len(truth))
        key, place = np.unique(one * len(self.two) + two, return_inverse=True)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(0, len(key) + 8192, 8192))
        for at in range(0, len(key), 8192):
            part = key[at:at + 8192]
            context = self.one[part // len(self.two)] + self.two[part % len(self.two)]
            score = self._scores(context, slice(None))
            chosen = order[cuts[at // 8192]:cuts[at // 8192 + 1]]
            own = score[place[chosen] - at, truth[chosen]].astype(np.float64)
            norm = np.log(np.exp(score, out=score).sum(axis=1, dtype=np.float64))
            found[chosen] = own - norm[place[chosen] - at]
        return found / np.log(10)


def log_of(vocabulary: Vocabulary, model: Model, units: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 of the probability of each unit after the two before it: of its class, and of its leaf in the group."""
    one, two = contexts(vocabulary, units, first)
    each = model.log_probabilities(vocabulary.classes_of(units), one, two)
    inside = np.flatnonzero(units >= vocabulary.classes)
    each[inside] += model.leaves.log_in_group(units[inside] - vocabulary.classes, one[inside], two[inside])
    return each


def scored(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    named = docs.select("doc_id", text_key().alias("key"), held_out.alias("held"), "text")
    training = named.where(~F.col("held"))
    counts = storage.written(counted(training), "counts")
    vocabulary = vocabulary_of(counts)
    total = vocabulary.total, vocabulary.different
    model = trained(training, vocabulary).model() if vocabulary.classes else None
    shared = spark.sparkContext.broadcast((vocabulary, model))
    result = {"doc_id": "bigint", "key": "bigint", "held": "boolean", "token": "bigint", "n": "bigint",
              "rows": "bigint", "n_tokens": "bigint", "known": "bigint", "base": "double", "score": "double"}

    def start():
        words, net = shared.value
        log_counts = np.log10(np.append(words.counts, 0) + 1.0)
        log_masses = np.log10(words.masses)

        def score(texts, rows):
            found, first = tokens(texts)
            rank = words.rank(found)
            row = np.repeat(np.arange(texts.rows), np.diff(first))
            head = rank < len(words.tokens)
            units = words.units(found, rank)
            each = log_of(words, net, units, first) if net else np.zeros(len(rank))
            shared_leaf = np.flatnonzero(units >= words.own)
            each[shared_leaf] += log_counts[rank[shared_leaf]] - log_masses[units[shared_leaf] - words.own]
            tail = np.flatnonzero(~head)
            order = tail[np.lexsort((found[tail], row[tail]))]
            new = np.ones(len(order), bool)
            new[1:] = (found[order][1:] != found[order][:-1]) | (row[order][1:] != row[order][:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(order)))
            tail_row, zeros = row[order][at], np.zeros(len(at), np.int64)
            place = pa.array(np.concatenate([np.arange(texts.rows), tail_row]))
            own = mixed(np.arange(texts.rows, dtype=np.uint64) + found[first[:-1]])

            def filled(values):
                return np.concatenate([values, zeros.astype(values.dtype)])

            return [
                rows.column("doc_id").take(place), rows.column("key").take(place), rows.column("held").take(place),
                np.concatenate([own, found[order][at]]).view(np.int64),
                np.concatenate([np.zeros(texts.rows, np.int64), times]),
                filled(np.ones(texts.rows, np.int64)), filled(np.diff(first)),
                filled(np.add.reduceat(head.astype(np.int64), first[:-1])),
                filled(np.add.reduceat(log_counts[rank], first[:-1])),
                filled(np.add.reduceat(each, first[:-1])),
            ]
        return score

    parts = map_texts(named, result, start)
    c = F.coalesce("count", F.lit(0))
    times = F.col("n")
    joined = parts.join(counts.withColumnRenamed("n", "count"), "token", "left")
    summed = joined.groupBy("doc_id", "key", "held").agg(
        F.sum("rows").alias("rows"), F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(c > 0, times).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + times * F.log10(c + 1)).alias("base"),
        F.sum(F.col("score") + times * F.log10(c + 1)).alias("score"))
    each = [(F.col(n) / F.col("rows")).cast(kind).alias(n) for n, kind in
            (("n_tokens", "bigint"), ("n_known", "bigint"), ("base", "double"), ("score", "double"))]
    per_row = summed.select("doc_id", "held", *each, F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("copy"))
    return per_row.select(
        "doc_id", F.coalesce("held", F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(total[0]).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * float(np.log10(total[0] + total[1] + 1))).alias("base_score"), "score")
