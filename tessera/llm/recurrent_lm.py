"""Complete-document log-likelihood under a gated recurrent language model.

Tokens are the words of the lower-cased text (A-Z) and one end.  Their counts cover all
learning documents.  The model's output vocabulary holds the most frequent words; every other
word belongs to one of `BUCKETS` buckets by its last two bytes, which stand in the vocabulary
for it, and has its smoothed share of the bucket's learning tokens:

    P(word | history) = P(class | state) P(entry | class, state) [ (c + 1/2) / (N_b + (V_b + 1) / 2) ]

State is a gated recurrent unit's, carried from window to window through a whole document and
set to zero at its start.  Learning is truncated backpropagation in numpy inside tasks over every
learning document: each trainer works through its own ones, dealt by a hash of doc_id and text,
in one of the rounds, and the trainers' parameters are averaged by Spark after each round.  While
it learns, the state goes on through `PIECE` tokens of a document at most, so that a long one does
not leave the other lanes idle.  Output biases start at the log shares of the counts, so learning
starts from the unigram model.

Scoring looks counts up in two tiers: the `TABLE_ENTRIES` most frequent words are broadcast,
any other word of a text is joined with all counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buffers import BLANKS, U64, Words, flat, slices, words
from .lineage import checkpoint

TABLE_ENTRIES = 1 << 19
CLASSES, PER_CLASS, BUCKETS, HIDDEN = 32, 64, 256, 16
ENTRIES = CLASSES * PER_CLASS
WINDOW, LANES, COUNT_BYTES, SCORE_BYTES, OUTPUT_ROWS = 32, 512, 2 << 20, 2 << 20, 1 << 15
#: Documents a trainer gets; rounds of averaging; bytes of text that its lanes share; tokens that a state goes on for.
TRAINER_DOCS, ROUNDS, TRAIN_LANES, TRAIN_BYTES, PIECE, RATE = 4000, 2, 128, 4 << 20, 1024, 0.08
#: Blocks of the weights, each averaged as a whole.
BLOCKS = 64
END = U64(0x656E64)


def buckets(w: Words) -> np.ndarray:
    last = w.data[w.ends - 1].astype(np.int64)
    before = np.where(w.ends - w.starts > 1, w.data[np.maximum(w.ends - 2, 0)], 0).astype(np.int64)
    return (last * 263 + before * 71) % BUCKETS


def _tokens(column) -> tuple[Words, np.ndarray, np.ndarray]:
    w = words(*flat(column), BLANKS, lower=True)
    return w, w.hashes(), buckets(w)


def _counted(batches):
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merge() -> None:
        hashes, bucket, counts = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.argsort(hashes)
        hashes, bucket, counts = hashes[order], bucket[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        kept[:] = [(hashes[first], bucket[first], np.add.reduceat(counts, first))]

    for batch in slices(batches, "text", COUNT_BYTES):
        _, hashes, bucket = _tokens(batch.column("text"))
        values, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        kept.append((values, bucket[first], counts))
        kept.append((np.array([END]), np.array([-1]), np.array([batch.num_rows])))
        if len(kept) > 8:
            merge()
    if kept:
        merge()
        hashes, bucket, counts = kept[0]
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(bucket.astype(np.int32)), pa.array(counts)], ["h", "bucket", "c"])


class Vocabulary:
    """Counts of the frequent words, and the output entries of words and buckets by frequency."""

    def __init__(self, top, bucket_sums, n: int, v: int):
        """top: h, c in descending order of c; bucket_sums: bucket, tokens and types of the words without an entry."""
        self.n, self.v = n, v
        hashes, counts = top.h.to_numpy(np.int64).view(U64), top.c.to_numpy(np.int64)
        own = min(len(hashes), ENTRIES - BUCKETS)
        tokens, types = np.zeros(BUCKETS), np.zeros(BUCKETS)
        tokens[bucket_sums.bucket.to_numpy(int)] = bucket_sums.tokens.to_numpy(float)
        types[bucket_sums.bucket.to_numpy(int)] = bucket_sums.types.to_numpy(float)
        self.bucket_norm = np.log10(tokens + 0.5 * (types + 1))
        mass = np.zeros(ENTRIES)
        mass[:own], mass[own : own + BUCKETS] = counts[:own], tokens
        order = np.argsort(-mass, kind="stable")
        entry = np.empty(ENTRIES, np.int64)
        entry[order] = np.arange(ENTRIES)
        self.mass = mass[order] + 0.5
        self.bucket_entry = entry[own : own + BUCKETS]
        sort = np.argsort(hashes)
        self.hashes, self.counts = hashes[sort], counts[sort]
        self.entry = np.where(sort < own, entry[np.minimum(sort, own - 1)], -1) if own else np.zeros(0, np.int64)
        at = np.searchsorted(self.hashes, END)
        known = at < len(self.hashes) and self.hashes[at] == END
        self.end_count = int(self.counts[at]) if known else 0
        self.end = int(self.entry[at]) if known and self.entry[at] >= 0 else 0

    def look_up(self, hashes: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: output entry, count (-1 where the table doesn't tell), whether the entry is a bucket."""
        if not len(self.hashes):
            return self.bucket_entry[bucket], np.full(len(hashes), -1), np.ones(len(hashes), bool)
        values, inverse = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, values), len(self.hashes) - 1)
        known = self.hashes[at] == values
        counts = np.where(known, self.counts[at], -1)[inverse]
        entry = np.where(known, self.entry[at], -1)[inverse]
        rare = entry < 0
        return np.where(rare, self.bucket_entry[bucket], entry), counts, rare


class GatedModel:
    """The recurrent weights: of inputs (x) and states (w) to the gates update (z), reset (r) and to the new state (n); class and entry outputs."""

    SHAPES = {f"x{k}": (ENTRIES, HIDDEN) for k in "zrn"} | {f"w{k}": (HIDDEN, HIDDEN) for k in "zrn"} | {"c": (HIDDEN, CLASSES), "cb": (CLASSES,), "o": (ENTRIES, HIDDEN), "ob": (ENTRIES,)}

    def __init__(self, mass: np.ndarray):
        draw = np.random.default_rng(7)
        self.p = {k: (draw.standard_normal(s) * 0.1).astype(np.float32) for k, s in self.SHAPES.items()}
        by_class = mass.reshape(CLASSES, PER_CLASS)
        self.p["cb"] = np.log(by_class.sum(1) / mass.sum()).astype(np.float32)
        self.p["ob"] = np.log(by_class / by_class.sum(1, keepdims=True)).ravel().astype(np.float32)
        self.p["o"] *= 0.1
        self.p["c"] *= 0.1

    def vector(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES])

    def load(self, vector: np.ndarray) -> GatedModel:
        at = 0
        for k, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            self.p[k] = vector[at : at + size].reshape(shape).astype(np.float32)
            at += size
        return self

    def forward(self, inputs: np.ndarray, resets: np.ndarray, h: np.ndarray, keep: bool = False):
        """States after each step of a window (steps by lanes), and what backward needs."""
        p, shape = self.p, (*inputs.shape, HIDDEN)
        given = {k: np.take(p[f"x{k}"], inputs.ravel(), axis=0).reshape(shape) for k in "zrn"}
        states, any_reset = np.empty(shape, np.float32), resets.any(1).tolist()
        trail = {k: np.empty(shape, np.float32) for k in ("before", "z", "r", "s", "new")} if keep else {}
        for t in range(len(inputs)):
            if any_reset[t]:
                h = np.where(resets[t][:, None], np.float32(0), h)
            z, r, s = h @ p["wz"], h @ p["wr"], h @ p["wn"]
            for gate, k in ((z, "z"), (r, "r")):  # the logistic function
                gate += given[k][t]
                gate *= 0.5
                np.tanh(gate, out=gate)
                gate += 1
                gate *= 0.5
            new = r * s
            new += given["n"][t]
            np.tanh(new, out=new)
            if keep:
                for k, x in zip(trail, (h, z, r, s, new), strict=True):
                    trail[k][t] = x
            h = np.subtract(h, new, out=states[t])
            h *= z
            h += new
        return states, h.copy(), trail

    @staticmethod
    def _exp(logits: np.ndarray, large: bool) -> np.ndarray:
        """exp of logits in place, less the largest of each row where they could be too large."""
        if large:
            logits -= logits.max(1, keepdims=True)
        return np.exp(logits, out=logits)

    def outputs(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None):
        """Natural log probability of each target from its state; with grads, adds to them and gives d loss / d state."""
        p, every = self.p, np.arange(len(targets))
        kind = targets // PER_CLASS
        # states are within 1
        large = max(np.abs(p["cb"]).max() + np.abs(p["c"]).sum(0).max(), np.abs(p["ob"]).max() + np.abs(p["o"]).sum(1).max()) > 60
        soft = self._exp(states @ p["c"] + p["cb"], large)
        sums = soft.sum(1)
        out = np.log(soft[every, kind] / sums)
        back = None
        if grads is not None:
            soft /= sums[:, None]
            soft[every, kind] -= 1
            grads["c"] += states.T @ soft
            grads["cb"] += soft.sum(0)
            back = soft @ p["c"].T
        order = np.argsort(kind.astype(np.int16), kind="stable")
        x, at = np.take(states, order, axis=0), (targets - kind * PER_CLASS)[order]
        edges = np.searchsorted(kind[order], np.arange(CLASSES + 1)).tolist()
        inner, inner_back = np.empty(len(x), np.float32), np.empty_like(x)
        for k in range(CLASSES):
            a, b = edges[k], edges[k + 1]
            if a == b:
                continue
            block, rows = slice(k * PER_CLASS, (k + 1) * PER_CLASS), every[: b - a]
            weights, mine, own = p["o"][block], x[a:b], at[a:b]
            soft = self._exp(mine @ weights.T + p["ob"][block], large)
            sums = soft.sum(1)
            inner[a:b] = soft[rows, own] / sums
            if grads is not None:
                soft /= sums[:, None]
                soft[rows, own] -= 1
                grads["o"][block] += soft.T @ mine
                grads["ob"][block] += soft.sum(0)
                inner_back[a:b] = soft @ weights
        out[order] += np.log(inner)
        if grads is not None:
            back[order] += inner_back
        return out, back

    def learn_window(self, inputs, targets, resets, live, h, squares) -> np.ndarray:
        """One step of AdaGrad on a window; the state goes on, the gradient stops at its start."""
        n = HIDDEN
        states, last, trail = self.forward(inputs, resets, h, keep=True)
        grads = {k: np.zeros(self.SHAPES[k], np.float32) for k in ("c", "cb", "o", "ob")}
        chosen = np.flatnonzero(live)
        back = np.zeros((live.size, n), np.float32)
        back[chosen] = self.outputs(np.take(states.reshape(-1, n), chosen, axis=0), targets.ravel()[chosen], grads)[1]
        back = back.reshape(states.shape)
        before, z, r, s, new = trail.values()
        to_new, to_z, to_r = (1 - z) * (1 - new * new), (before - new) * z * (1 - z), s * r * (1 - r)
        going_on = np.where(resets[:, :, None], np.float32(0), np.float32(1)) if resets.any() else None
        d = {k: np.empty_like(states) for k in "zrns"}  # of the gates' sums, the new state's, and the state's part in that
        dh, wz, wr, wn = np.zeros_like(h), *(np.ascontiguousarray(self.p[f"w{k}"].T) for k in "zrn")
        for t in range(len(inputs) - 1, -1, -1):
            dh += back[t]
            dn = np.multiply(dh, to_new[t], out=d["n"][t])
            dz = np.multiply(dh, to_z[t], out=d["z"][t])
            dr = np.multiply(dn, to_r[t], out=d["r"][t])
            ds = np.multiply(dn, r[t], out=d["s"][t])
            dh *= z[t]
            dh += dz @ wz
            dh += dr @ wr
            dh += ds @ wn
            if going_on is not None:
                dh *= going_on[t]
        order = np.argsort(inputs.ravel().astype(np.int16), kind="stable")
        given = inputs.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], given[1:] != given[:-1]]))
        entries, at = given[first], before.reshape(-1, n).T
        for k in "zrn":
            grads[f"w{k}"] = at @ d["s" if k == "n" else k].reshape(-1, n)
            grads[f"x{k}"] = np.add.reduceat(np.take(d[k].reshape(-1, n), order, axis=0), first, axis=0)
        for k, g in grads.items():
            rows = entries if k[0] == "x" else slice(None)  # the others' gradient is zero
            g *= 1 / max(1, len(chosen)) ** 0.5
            np.clip(g, -1, 1, out=g)
            squares[k][rows] += g * g
            self.p[k][rows] -= RATE * g / np.sqrt(squares[k][rows] + 1e-3)
        return last


class Lanes:
    """Documents side by side: each lane holds some, one after the other, the longest lanes first."""

    def __init__(self, lengths: np.ndarray, lanes: int):
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        order = np.argsort(-lengths, kind="stable")
        lanes = min(lanes, len(lengths))
        held: list[list[int]] = [[] for _ in range(lanes)]
        for i, k in enumerate(order):  # there and back, so that lanes come out even
            row, at = divmod(i, lanes)
            held[at if row % 2 == 0 else lanes - 1 - at].append(k)
        held.sort(key=lambda docs: -int(lengths[docs].sum()))
        docs = np.array([k for lane in held for k in lane])
        #: Where each step of each lane lies among the tokens in document order.
        self.place = np.arange(int(lengths.sum())) + np.repeat(first[docs] - (np.cumsum(lengths[docs]) - lengths[docs]), lengths[docs])
        self.sizes = np.array([int(lengths[lane].sum()) for lane in held])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def windows(self, steps: int):
        """(place, live) of each window, steps by active lanes; place is any valid one where not live."""
        for t in range(0, int(self.sizes.max(initial=0)), steps):
            active = int(np.searchsorted(-self.sizes, -t, side="left"))
            step = np.arange(t, t + steps)[:, None]
            live = step < self.sizes[None, :active]
            at = np.minimum(self.starts[None, :active] + step, len(self.place) - 1)
            yield self.place[at], live


def _sequence(entries: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets of all documents in a row (words, then the end), the entries before them, and where documents start."""
    targets = np.insert(entries, first[1:], end)
    start = np.zeros(len(targets), bool)
    start[first[:-1] + np.arange(len(first) - 1)] = True
    inputs = np.empty_like(targets)
    inputs[1:] = targets[:-1]
    inputs[start] = end
    return targets, inputs, start


def _cut(lengths: np.ndarray, most: int) -> np.ndarray:
    """Lengths of the pieces, in order, that have `most` each but the last of each length."""
    many = -(-lengths // most)
    out = np.full(int(many.sum()), most, np.int64)
    out[np.cumsum(many) - 1] = lengths - (many - 1) * most
    return out


def _train(batches, vocabulary: Vocabulary, vector: np.ndarray):
    """The weights after this trainer's documents in blocks, and how many tokens it saw."""
    model = GatedModel(vocabulary.mass).load(vector)
    squares = {k: np.full(s, 0.02, np.float32) for k, s in GatedModel.SHAPES.items()}
    seen = 0
    for batch in slices(batches, "text", TRAIN_BYTES):
        w, hashes, bucket = _tokens(batch.column("text"))
        entries = vocabulary.look_up(hashes, bucket)[0]
        targets, inputs, start = _sequence(entries, w.first, vocabulary.end)
        pieces = _cut(w.counts + 1, PIECE)
        start[np.cumsum(pieces) - pieces] = True
        lanes = Lanes(pieces, TRAIN_LANES)
        h = np.zeros((len(lanes.sizes), HIDDEN), np.float32)
        for place, live in lanes.windows(WINDOW):
            h = model.learn_window(inputs[place], targets[place], start[place] & live, live, h[: place.shape[1]], squares)
        seen += len(targets)
    if seen:
        blocks = [x.astype(np.float32).tobytes() for x in np.array_split(model.vector(), BLOCKS)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array(blocks, pa.binary()), pa.array(np.full(BLOCKS, float(seen)))], ["i", "block", "weight"])


def _averaged(batches):
    """The weighted mean of each block that this task has."""
    sums: dict[int, list] = {}
    for batch in batches:
        for i, block, weight in zip(*(batch.column(k).to_pylist() for k in ("i", "block", "weight")), strict=True):
            held = sums.setdefault(i, [0.0, 0.0])
            held[0] = held[0] + np.frombuffer(block, np.float32) * np.float64(weight)
            held[1] += weight
    if sums:
        means = [(total / weight).tobytes() for total, weight in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(means, pa.binary())], ["i", "mean"])


def learn(docs: DataFrame, table_entries: int = TABLE_ENTRIES) -> tuple[DataFrame, Vocabulary, np.ndarray]:
    """From docs (doc_id, text): all counts (h, bucket, c), the vocabulary and the recurrent weights."""
    texts = docs.select("text")
    counts = checkpoint(texts.mapInArrow(_counted, "h long, bucket int, c long").groupBy("h").agg(F.first("bucket").alias("bucket"), F.sum("c").alias("c")))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # the least count of which there are few enough words with it or more: no sort of all words
    together = F.sum("words").over(Window.orderBy(F.desc("c")))
    least = counts.groupBy("c").agg(F.count("*").alias("words")).withColumn("t", together).filter(F.col("t") <= table_entries).agg(F.min("c")).first()[0]
    frequent = counts.filter(F.col("c") >= least) if least is not None else counts.filter("false")
    top = frequent.select("h", "c").toPandas().sort_values(["c", "h"], ascending=[False, True], ignore_index=True)
    with_entry = counts.sparkSession.createDataFrame(top.h[: ENTRIES - BUCKETS].to_frame().astype("int64"), "h long")
    sums = counts.filter("bucket >= 0").join(F.broadcast(with_entry), "h", "left_anti").groupBy("bucket").agg(F.sum("c").alias("tokens"), F.count("*").alias("types")).toPandas()
    vocabulary = Vocabulary(top, sums, n, v)
    vector = GatedModel(vocabulary.mass).vector()
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    dealt_by = F.xxhash64("doc_id", "text", F.lit(5))
    trainers = max(2, -(-vocabulary.end_count // (ROUNDS * TRAINER_DOCS)))  # each document has one end
    for i in range(ROUNDS):
        sent = docs.sparkSession.sparkContext.broadcast(vector)
        # so many trainers, each with one set of weights to send, however many partitions a shuffle has
        dealt = docs.filter(F.pmod(dealt_by, F.lit(ROUNDS)) == i).select("text", dealt_by.alias("key")).repartition(trainers, "key").select("text").coalesce(trainers)
        rows = dealt.mapInArrow(lambda b, sent=sent: _train(b, held.value, sent.value), "i int, block binary, weight double")
        means = dict(rows.repartition("i").mapInArrow(_averaged, "i int, mean binary").toPandas().itertuples(index=False, name=None))
        if means:
            vector = np.concatenate([np.frombuffer(means[k], np.float64) for k in range(BLOCKS)])
    return counts, vocabulary, vector


def _scored(batches, vocabulary: Vocabulary, vector: np.ndarray):
    model = GatedModel(vocabulary.mass).load(vector)
    end_log = np.log10(vocabulary.end_count + 0.5)
    for batch in slices(batches, "text", SCORE_BYTES):
        w, hashes, bucket = _tokens(batch.column("text"))
        entries, counts, rare = vocabulary.look_up(hashes, bucket)
        n = batch.num_rows
        logs = np.log10(np.maximum(counts, 0) + 0.5) * (counts >= 0)

        def by_row(x: np.ndarray, first=w.first) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(x)])
            return sums[first[1:]] - sums[first[:-1]]

        targets, inputs, start = _sequence(entries, w.first, vocabulary.end)
        states = np.empty((len(targets), HIDDEN), np.float32)
        lanes = Lanes(w.counts + 1, LANES)
        h = np.zeros((len(lanes.sizes), HIDDEN), np.float32)
        for place, live in lanes.windows(WINDOW):
            after, h, _ = model.forward(inputs[place], start[place] & live, h[: place.shape[1]])
            states[place[live]] = after[live]
        parts = [model.outputs(states[i : i + OUTPUT_ROWS], targets[i : i + OUTPUT_ROWS])[0] for i in range(0, len(targets), OUTPUT_ROWS)]
        found = np.concatenate([np.zeros(0), *parts])
        sums = np.concatenate([[0], np.cumsum(found / np.log(10))])
        stops = w.first[1:] + np.arange(1, n + 1)
        recurrent = sums[stops] - sums[stops - w.counts - 1]
        unknown = np.flatnonzero(counts < 0)
        rows = w.rows[unknown]
        order = np.lexsort((hashes[unknown], rows))
        rows, rare_hashes = rows[order], hashes[unknown][order]
        new = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (rare_hashes[1:] != rare_hashes[:-1])])) if len(rows) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(rows)))
        offsets = pa.array(np.searchsorted(rows[new], np.arange(n + 1)).astype(np.int32))
        columns = {
            "doc_id": batch.column("doc_id"),
            "n_tokens": pa.array(w.counts + 1),
            "known": pa.array(by_row(counts > 0) + (vocabulary.end_count > 0)),
            "log_counts": pa.array(by_row(logs) + end_log),
            "model": pa.array(recurrent + by_row(np.where(rare, logs - vocabulary.bucket_norm[bucket], 0.0))),
            "rare": pa.ListArray.from_arrays(offsets, pa.array(rare_hashes[new].view(np.int64))),
            "times": pa.ListArray.from_arrays(offsets, pa.array(times)),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def score(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, vector: np.ndarray) -> DataFrame:
    """doc_id, text -> doc_id, n_tokens, n_known, train_tokens, base_score, score: one row for each of docs.

    Null and empty texts are the end alone.  With nothing learned from, all counts are 0.  Repeated
    rows get equal scores, null doc_ids stay, and an empty table gives an empty table."""
    context = docs.sparkSession.sparkContext
    held, sent = context.broadcast(vocabulary), context.broadcast(vector)
    kinds = "doc_id long, n_tokens long, known long, log_counts double, model double, rare array<long>, times array<long>"
    scored = docs.select("doc_id", "text").mapInArrow(lambda b: _scored(b, held.value, sent.value), kinds)
    scored = checkpoint(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("h"), "r.times")
    found = rare.join(counts.select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    more = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    norm = float(np.log10(vocabulary.n + 0.5 * (vocabulary.v + 1)))
    more_log = F.coalesce("more", F.lit(0.0))
    return scored.join(more, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.n).cast("long").alias("train_tokens"),
        (F.col("log_counts") + more_log - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("model") + more_log).alias("score"),
    )


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 1


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = score(docs, *learn(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
