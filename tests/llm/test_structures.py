"""Prefix trie, sharding and hard negatives against plain versions, on awkward and hot input."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives, prefix_trie, sharding

TALKS = "conv_id long, turn long, role string, text string, node string, key string, depth long"


def _rebuilt(rows):
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v, key=lambda y: y[:2])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def _nodes(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def _talks(seed: int, n: int):
    rng, rows = np.random.default_rng(seed), []
    for c in rng.choice(400, n, replace=False).tolist():
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, ["user", "assistant", None][int(rng.integers(0, 3))], ["a", "bb", "", None, "ß🙂"][int(rng.integers(0, 5))]))
    rows += [(c, t, "user", "hot") for c in range(500, 560) for t in range(3)] + [(600, t, "user", f"long {t}") for t in range(90)] + [(601, t, "user", f"long {t}") for t in range(60)]
    rows += [(602, None, "user", "no number"), (602, 0, "user", "zero"), (None, 0, "user", "nobody"), (-7, 0, "user", "hot")]
    return [(*r, "x", "y", 1) for r in rows]


@pytest.mark.parametrize(("seed", "range_convs"), [(1, 50_000), (2, 7), (3, 2)])
def test_trie_equals_brute_force(spark, seed, range_convs):
    rows = _talks(seed, 120)
    convs = prefix_trie.with_shared_heads(prefix_trie.arrays(spark.createDataFrame(rows, TALKS)))
    found = [tuple(r) for r in prefix_trie.trie(convs, range_convs).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert sorted(found, key=repr) == _nodes(_rebuilt(rows))


def test_trie_of_one_turnless_and_of_no_conversation(spark):
    lone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 0)  # its head is another's, which is not there
    found = prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.arrays(spark.createDataFrame([(lone, 0, "user", "x", "", "", 0)], TALKS)))).collect()
    assert [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.ends_sha256) for r in found] == [(lone, 0, None, 1, 0, 1, hashlib.sha256(str(lone).encode()).hexdigest())]
    assert prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.arrays(spark.createDataFrame([], TALKS)))).count() == 0


def test_shared_turns_of_keys():
    a, b = b"a" * 16, b"b" * 16
    assert [prefix_trie.shared(*x) for x in ((b"", a), (a, a), (a + b, a + a), (a, a + b), (a, b))] == [0, 1, 1, 1, 0]


DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot long, size long"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, 5, 5, 5) for i, t in texts], DOCS)


def _draw(key, shard):
    return (int(hashlib.md5(f"{key}/{shard}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52


def _shard(key, weights):
    return max(range(len(weights)), key=lambda i: (weights[i] / -math.log(_draw("" if key is None else key, i)), -i))


TEXTS = [(i, f"text {i}") for i in range(300)] + [(7, "again"), (None, "a"), (None, None), (None, ""), (8, None), (9, "ß🙂"), (-4, "x" * 100_000)] + [(3, "same")] * 120 + [(None, "hot")] * 100


def test_assign_equals_brute_force(spark):
    rows = sharding.assign(_docs(spark, TEXTS), chunk=7, range_rows=40).collect()
    found = Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in rows)
    wanted = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", _shard(i, [1.0] * 16), _shard(i, [1.0] * 17)) for i, t in TEXTS)
    assert found == wanted
    for s in range(16):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    again = {(r.doc_id, r.text_crc32, r.slot) for r in sharding.assign(_docs(spark, TEXTS[::-1]).repartition(3), chunk=7, range_rows=1000).collect()}
    assert again == {(r.doc_id, r.text_crc32, r.slot) for r in rows}
    assert sharding.assign(_docs(spark, [])).count() == 0


def test_shards_follow_their_weights_and_growth_moves_records_to_the_new_one_only(spark):
    weights = (1.0, 2.0, 5.0)
    ids = spark.range(8000).select(F.col("id").alias("doc_id"))
    found = ids.select("doc_id", sharding.shard_of(F.col("doc_id"), weights).alias("a"), sharding.shard_of(F.col("doc_id"), (*weights, 2.0)).alias("b"), sharding.shard_of(F.col("doc_id"), (1.0, 2.0, 9.0)).alias("c")).collect()
    for s, w in enumerate(weights):
        assert abs(sum(r.a == s for r in found) / 8000 - w / 8) < 0.02
    assert all(r.a == r.b or r.b == 3 for r in found) and abs(sum(r.b == 3 for r in found) / 8000 - 0.2) < 0.02
    assert all(r.a == r.c or r.c == 2 for r in found)
    assert [r.a for r in found[:50]] == [_shard(r.doc_id, weights) for r in found[:50]]
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("doc_id"), (1.0, 0.0))


def test_written_shards_hold_their_records(spark, tmp_path):
    docs = _docs(spark, TEXTS).drop("shard")
    sharding.write(docs, str(tmp_path / "out"), (1.0, 1.0, 3.0), files=2)
    read = spark.read.parquet(str(tmp_path / "out"))
    assert read.count() == len(TEXTS) and read.filter(F.col("shard") != sharding.shard_of(F.col("doc_id"), (1.0, 1.0, 3.0))).count() == 0
    assert Counter(r.text for r in read.select("text").collect()) == Counter(t for _, t in TEXTS)


VECTORS = "vec_id long, embedding array<float>, label int, score long, rank int, a int"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, 1, 1) for i, v, l in rows], VECTORS)


def _mined(rows, every=100):
    kept = {}
    for i, v, l in rows:
        if i is not None and v is not None and l is not None and all(x is not None and math.isfinite(x) for x in v):
            v = tuple(math.floor(256 * float(np.float32(x))) for x in v)
            kept[i, (l + 1) % 10 if i % 7 == 0 else l, v] = 1
    out = []
    for a, label, v in kept:
        if a % every:
            continue
        near = lambda same: sorted({(-sum(x * y for x, y in zip(v, w, strict=True)), i) for i, l, w in kept if len(w) == len(v) and ((l == label and i != a) if same else l != label)})
        for s, p in near(True)[:5]:
            inside = [(t, i) for t, i in near(False) if 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(inside)]
    return sorted(out)


def _awkward_vectors(seed=0, n=400, dim=6):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0.3, 0.4, dim).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    rows += [(n + i, [0.5] * dim, i % 2) for i in range(150)]  # ties
    rows += [rows[3], rows[100], rows[n + 5]]  # repeated rows, an anchor among them
    rows += [(None, [0.1] * dim, 1), (1000, None, 1), (1001, [0.1] * dim, None), (1002, [None] + [0.1] * (dim - 1), 1), (1003, [float("nan")] * dim, 1), (1004, [float("inf")] * dim, 1), (1100, [], 1), (1101, [], 2)]
    return rows + [(1200, [0.5] * 3, 0), (1201, [0.5] * 3, 0), (1202, [0.5] * 3, 1)]


@pytest.mark.parametrize("block_bytes", [8 << 20, 200])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block_bytes)
    raw = _awkward_vectors()
    rows = hard_negatives.usable(_vectors(spark, raw).repartition(5))
    found = hard_negatives.mine(rows, rows.filter("vec_id % 100 = 0")).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert sorted(map(tuple, found)) == _mined(raw)


def test_hard_negatives_of_nothing(spark):
    rows = hard_negatives.usable(_vectors(spark, []))
    assert hard_negatives.mine(rows, rows.filter("vec_id % 100 = 0")).count() == 0


def test_long_products_are_exact():
    a, b = np.array([[3.0e9, 1.0], [1.0, 2.0]]), np.array([[3.0e9, 1.0], [5.0, 7.0], [1e30, 0.0]])
    assert hard_negatives.scores(a, b)[:, :2].tolist() == [[9 * 10**18 + 1, 15_000_000_007], [3 * 10**9 + 2, 19]]
    assert hard_negatives.scores(a, b)[:, 2].tolist() == [(1 << 63) - 1] * 2
