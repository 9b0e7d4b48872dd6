"""Operators with exact results: kernel, substring de-duplication, Jaccard join, decontamination, token counts, mixing."""

from __future__ import annotations

import hashlib
import random
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import buffers, decontaminate, jaccard_join, mixing, substring_dedup, token_count
from tessera.llm.lineage import contracted

from . import brute


def test_words_and_hashes_follow_the_patterns():
    texts = ["", " a b  c\n", "x", None, "É ß\x0b漢 b", "b"]
    column = pa.array(texts)
    w = buffers.words(*buffers.flat(column), buffers.BLANKS)
    found = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)]
    assert found == [x for t in texts for x in brute.WORDS.findall(t or "")]
    assert w.counts.tolist() == [len(brute.WORDS.findall(t or "")) for t in texts]
    hashes = w.hashes().tolist()
    assert len({(x, h) for x, h in zip(found, hashes, strict=True)}) == len(set(found)) == len(set(hashes))
    lower = buffers.words(*buffers.flat(pa.array(["Ab-9É ß_Z"])), buffers.NON_ALNUM, lower=True)
    assert [bytes(lower.data[a:b]).decode() for a, b in zip(lower.starts, lower.ends, strict=True)] == ["ab", "9É", "ß", "z"]


def test_slices_keep_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (0, 5, 9, 0, 30, 1)])], ["text"])
    parts = list(buffers.slices([batch.slice(0, 0), batch], "text", 10))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert max(p.num_rows for p in parts) < 6


def repeats(texts: list[str | None], window: int) -> dict[int, list[bool]]:
    places: dict[tuple, list] = {}
    split = [brute.WORDS.findall(t or "") for t in texts]
    for k, ws in enumerate(split):
        for i in range(len(ws) - window + 1):
            places.setdefault(tuple(ws[i : i + window]), []).append((k, i))
    gone = [[False] * len(ws) for ws in split]
    for at in places.values():
        if len(at) > 1:
            for k, i in at:
                gone[k][i : i + window] = [True] * window
    return gone


def check_repeats(spark, rows, window, shortest):
    found = substring_dedup.remove_repeats(brute.frame(spark, rows), window, shortest=shortest)
    assert {"segment", "h", "level", "taken", "lang"} <= set(found.columns)
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in found.collect())
    gone = repeats([t for _, t in rows], window)
    wanted = []
    for (i, t), g in zip(rows, gone, strict=True):
        ws = brute.WORDS.findall(t or "")
        wanted.append((i is None, i or 0, len(ws), sum(g), " ".join(w for w, x in zip(ws, g, strict=True) if not x)))
    assert found == sorted(wanted)


def test_repeats_on_awkward_rows(spark):
    check_repeats(spark, brute.awkward(), 35, 9)


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_on_random_texts(spark, seed):
    draw = random.Random(seed)
    shared = [[draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(draw.randint(5, 40))] for _ in range(8)]
    rows = []
    for i in range(40):
        ws = []
        for _ in range(draw.randint(0, 6)):
            ws += draw.choice(shared) if draw.random() < 0.6 else [f"u{draw.randint(0, 9999)}" for _ in range(draw.randint(1, 20))]
        rows.append((i, " ".join(ws)))
    check_repeats(spark, rows, 11, 2)


def test_repeats_of_an_empty_table(spark):
    assert substring_dedup.remove_repeats(brute.frame(spark, [])).count() == 0


def shingles(text, n=3):
    ws = brute.WORDS.findall((text or "").translate(brute.LOWER))
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def check_components(spark, rows, **more):
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(brute.frame(spark, rows), **more).collect()}
    known = [(i, t) for i, t in rows if i is not None]
    sets = [shingles(t) for _, t in known]
    order = sorted(range(len(known)), key=lambda k: known[k][0])
    roots = brute.components(len(order), lambda a, b: known[order[a]][0] == known[order[b]][0] or bool(sets[order[a]]) and 100 * len(sets[order[a]] & sets[order[b]]) >= 90 * len(sets[order[a]] | sets[order[b]]))
    wanted = {(known[k][0], len(sets[k]), known[order[roots[at]]][0]) for at, k in enumerate(order)}
    assert found - {x for x in found if x[0] is None} == wanted
    assert len([x for x in found if x[0] is None]) == len({t for i, t in rows if i is None})


def test_components_on_awkward_rows(spark):
    check_components(spark, brute.awkward())


def test_components_on_chains_of_edits_and_in_chunks(spark, monkeypatch):
    draw = random.Random(4)
    rows = []
    for group in range(4):
        ws = [f"g{group}w{draw.randint(0, 400)}" for _ in range(draw.choice([30, 60, 120]))]
        for _ in range(14):
            rows.append((len(rows) * 3 + 1, " ".join(ws)))
            ws = list(ws)
            for _ in range(draw.randint(0, 3)):
                ws[draw.randrange(len(ws))] = f"n{draw.randint(0, 10**6)}"
    draw.shuffle(rows)
    check_components(spark, rows)
    check_components(spark, rows, block_docs=4, by_length=True)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 200)
    check_components(spark, rows)


def test_only_neighbouring_length_partitions_can_link():
    for num, den in ((9, 10), (8, 10), (1, 2)):
        sizes = np.arange(1, 700)
        partition = jaccard_join.length_partitions(sizes, num, den)
        assert (np.diff(partition) >= 0).all() and partition[-1] > partition[0]
        for a in range(1, 700, 3):
            reach = sizes[sizes * num <= a * den]
            assert partition[reach[reach >= a] - 1].max() <= partition[a - 1] + 1


def test_tasks_contract_edges_to_forests():
    draw = random.Random(8)
    edges = [(draw.randint(0, 80), draw.randint(0, 80)) for _ in range(60)]
    table = pa.table({"u": [a for a, _ in edges], "v": [b for _, b in edges]})
    forest = [(r["u"], r["v"]) for b in contracted(table.to_batches(max_chunksize=7), most=20) for r in b.to_pylist()]
    assert len(forest) <= len(edges) and all(u > v for u, v in forest)
    for links in (edges, forest):
        either = {(a, b) for a, b in links} | {(b, a) for a, b in links}
        roots = brute.components(81, lambda a, b, either=either: (a, b) in either)
        assert links is edges or roots == before
        before = roots


def test_components_of_an_empty_table(spark):
    assert jaccard_join.jaccard_components(brute.frame(spark, [])).count() == 0


def test_divide_skip_finds_what_counting_finds():
    draw = random.Random(5)
    for _ in range(300):
        lists = [sorted(draw.sample(range(60), draw.randint(1, 40))) for _ in range(draw.randint(1, 20))]
        needed = draw.randint(1, len(lists))
        counts = {x: sum(x in y for y in lists) for x in range(60)}
        found = [x for x, _ in jaccard_join.occurring([list(x) for x in lists], needed)]
        assert found == sorted(x for x, n in counts.items() if n >= needed)


def test_prefixes_meet_for_all_linked_sets():
    draw = random.Random(6)
    for num in (6, 8, 9):
        for _ in range(40):
            base = [draw.getrandbits(63) for _ in range(draw.randint(1, 60))]
            sets = []
            for _ in range(8):
                x = set(base)
                for _ in range(draw.randint(0, 5)):
                    x ^= {draw.choice(base), draw.getrandbits(63)}
                sets.append(sorted(x, key=lambda v: (v % 3, v)))
            first = [set(x[: jaccard_join.prefix_sizes(np.array([len(x)]), num, 10)[0]]) if x else set() for x in sets]
            for i in range(8):
                for j in range(i):
                    a, b = set(sets[i]), set(sets[j])
                    if a and b and 10 * len(a & b) >= num * len(a | b):
                        assert first[i] & first[j]


def test_codes_come_back_with_how_often_they_occur():
    shingles = np.array([1 << 63, (1 << 63) + 5, 7, (1 << 40) + 3], np.uint64)
    part, code = jaccard_join.codes(shingles, 256)
    assert part.tolist() == [128, 128, 0, 0] and code[0] == code[1] == 0 and code[3] == 1 << 16
    found = jaccard_join.levels_of([np.array(x, np.uint32).tobytes() for x in ([1, 2, 3], [2, 3, 9], [3], [3, 8])])
    assert [(c.tolist(), x.tolist()) for c, x in found] == [([2, 3], [1, 2]), ([2, 3], [1, 2]), ([3], [2]), ([3], [2])]


def test_block_search_connects_what_comparing_all_pairs_connects():
    draw = np.random.default_rng(3)
    for _ in range(60):
        n, pool = int(draw.integers(2, 25)), draw.integers(0, 2**63, 30).astype(np.uint64)
        sets = [np.unique(draw.choice(pool, draw.integers(5, 30), replace=False)) for _ in range(n)]
        asks = (draw.random(n) < 0.6).tolist()
        edges = jaccard_join.links(list(range(n)), sets, asks, 6, 10)
        linked = {(max(e), min(e)) for e in edges}
        wanted = brute.components(n, lambda a, b: (asks[a] or asks[b]) and 10 * len({*sets[a].tolist()} & {*sets[b].tolist()}) >= 6 * len({*sets[a].tolist()} | {*sets[b].tolist()}))
        assert brute.components(n, lambda a, b: (max(a, b), min(a, b)) in linked) == wanted


def hits(text, items, size):
    ws = brute.ALNUM.findall((text or "").translate(brute.LOWER))
    marked, ids = [False] * len(ws), set()
    for item_id, item in items:
        iw = brute.ALNUM.findall((item or "").translate(brute.LOWER))
        n = min(size, len(iw))
        phrases = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(ws) - n + 1 if n else 0):
            if tuple(ws[i : i + n]) in phrases:
                marked[i : i + n] = [True] * n
                ids.add(str(item_id))
    return len(ws), sum(marked), sorted(ids)


def check_hits(spark, rows, items, size=10):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.decontaminate(brute.frame(spark, rows), bench, size)
    assert {"segment", "taken"} <= set(found.columns)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in found.collect())
    assert got == sorted((str(i), *hits(t, items, size)) for i, t in rows)
    again = decontaminate.decontaminate(found.withColumn("text", F.col("clean_text")), bench, size)
    left = {r.doc_id: r.n_words for r in again.collect()}
    assert all(left[r.doc_id] == r.n_words - r.n_hit for r in found.collect() if r.doc_id is not None)


def test_hits_on_awkward_rows(spark):
    items = [(7, "Alpha3 beta3 gamma alpha4 beta4 gamma alpha5 beta5 gamma alpha6 beta6 gamma"), (12, "one-TWO"), (3, None), (4, ""), (5, "nowhere to be found"), (5, "ünï")]
    check_hits(spark, brute.awkward(), items)


@pytest.mark.parametrize("blocks", [1 << 20, 40])
def test_hits_on_random_texts(spark, monkeypatch, blocks):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", blocks)
    draw = random.Random(8)
    items = [(i, " ".join(draw.choice("abc") for _ in range(draw.randint(1, 9)))) for i in range(12)]
    rows = [(i, draw.choice([" ", ", ", "-"]).join(draw.choice(["a", "B", "c", "d", "x9"]) for _ in range(draw.randint(0, 80)))) for i in range(30)]
    check_hits(spark, rows, items, size=4)


def test_hits_without_benchmark_or_documents(spark):
    check_hits(spark, [(1, "a b")], [])
    check_hits(spark, [], [(1, "a b")])


def test_fm_index_finds_every_place():
    draw = np.random.default_rng(9)
    symbols = draw.integers(0, 4, 400)
    symbols[-1] = 0
    index = decontaminate.FmIndex(symbols, 3)
    text = "".join(map(str, symbols))
    for length in (1, 2, 3, 5):
        phrases = draw.integers(1, 4, (40, length))
        low, high = index.search(phrases)
        for phrase, a, b in zip(phrases, low, high, strict=True):
            wanted = [i for i in range(len(text)) if text.startswith("".join(map(str, phrase)), i)]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == wanted


@pytest.fixture(scope="module")
def proto():
    public = pytest.importorskip("public_tokenizers")
    with open(public.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def test_token_counts_equal_whole_encoding(spark, proto):
    draw = random.Random(10)
    parts = [" ", "  ", "\n", "a", "the ", "▁", "\t", "é", "漢", "<s>", "\0", "!!", "ing", "🙂", "<0x0A>"]
    rows = [*brute.awkward(), *((100 + i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 30)))) for i in range(300))]
    model = token_count.Lengths(proto).model
    found = token_count.count_tokens(brute.frame(spark, rows), proto).select("doc_id", "text", "n_tokens").collect()
    assert len(found) == len(rows)
    assert all(r.n_tokens == len(model.encode(r.text or "")) for r in found)
    assert token_count.count_tokens(brute.frame(spark, []), proto).count() == 0


def test_worker_cache_is_bounded(proto, monkeypatch):
    monkeypatch.setattr(token_count, "CACHE_ENTRIES", 5)
    lengths = token_count.Lengths(proto)
    text = " ".join(f"word{i}" for i in range(50))
    assert lengths.of(text) == len(lengths.model.encode(text)) and len(lengths) <= 5


def check_mix(spark, rows, sources, **more):
    out = mixing.mix(brute.frame(spark, rows, source=sources), **more)
    got = out.collect()
    assert len(got) == len(rows)
    names = sorted({sources.get(i) for i, _ in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(len(brute.WORDS.findall(t or "")) for i, t in rows if sources.get(i) == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, budget, open_ = {}, 1.5 * sum(total.values()), set(names)
    while open_:  # cap, and share again
        w = sum(weight[s] for s in open_)
        level = {s: (budget - sum(target.values())) * weight[s] / w for s in open_}
        full = {s for s in open_ if level[s] >= 2 * total[s]}
        if not full:
            target |= level
            break
        target |= {s: 2.0 * total[s] for s in full}
        open_ -= full
    for s in names:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 * max(1, target[s]) and r.source_size == total[s] for r in mine)
        assert sum(int(r.taken) for r in mine) == round(target[s] + 1e-9)
    assert all(0 <= int(r.taken) <= 2 * r.size and (r.position is None or 0 <= r.position <= 1) for r in got)
    again = mixing.mix(brute.frame(spark, rows, source=sources).repartition(3), **more).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    read = mixing.training_order(out).collect()
    words = {}
    for r in read:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.words
    took = {}
    for r in out.collect():
        took[r.doc_id] = took.get(r.doc_id, 0) + r.taken
    assert words == {k: v for k, v in took.items() if v} and all(r.words > 0 and r.reading in (1, 2) for r in read)
    order = [r.position for r in read]
    assert order == sorted(order)


def test_mix_on_awkward_rows(spark):
    rows = [(i, t) for i, t in brute.awkward() if i is not None][:-1]
    check_mix(spark, rows, {0: None, 1: "b", 2: "a", 3: "a", 4: None, 5: "É", 6: "z", 7: "z", 8: "b", 9: "", 10: "b"}, range_rows=2)


def test_mix_with_a_dominant_source(spark):
    draw = random.Random(11)
    rows = [(i, "w " * draw.randint(0, 60)) for i in range(120)]
    check_mix(spark, rows, {i: "big" if i % 3 else f"s{i % 5}" for i in range(120)}, range_rows=10)


def test_mix_of_an_empty_table_and_bad_parameters(spark):
    assert mixing.mix(brute.frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(brute.frame(spark, []), share=3.0)


def test_digest_of_kept_text_is_of_utf8(spark):
    rows = [(1, "é  ß")]
    kept = substring_dedup.remove_repeats(brute.frame(spark, rows)).select(F.sha2("kept_text", 256).alias("s")).first().s
    assert kept == hashlib.sha256("é ß".encode()).hexdigest()


@pytest.mark.parametrize("module", [jaccard_join, mixing, decontaminate, substring_dedup])
def test_registered_query_equals_its_sql(spark, module):
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test tables")
    with duckdb.connect() as connection:
        for name in ("documents", "benchmark"):
            connection.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
        wanted = connection.sql(module.ORACLE).df()
    found = module.query(spark, folder).toPandas()
    assert sorted(found.columns) == sorted(wanted.columns) and len(found) == len(wanted)
    found, wanted = (x.sort_values("doc_id", ignore_index=True)[sorted(x.columns)] for x in (found, wanted))
    for c in found.columns:
        if found[c].dtype.kind == "f":
            np.testing.assert_allclose(found[c].astype(float), wanted[c].astype(float), rtol=1e-9)
        else:
            assert found[c].astype(str).tolist() == wanted[c].astype(str).tolist()


def test_mixing_query_is_in_training_order(spark):
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no test tables")
    positions = [r.position for r in mixing.query(spark, "/root/testdata/sf0.001").collect()]
    assert positions == sorted(positions, key=lambda x: (x is None, x))
