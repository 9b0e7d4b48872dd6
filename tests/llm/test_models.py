"""Operators that learn, fingerprints, transcripts and the pipeline."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat_format, language_id, recurrent_lm, spotsigs, toxicity
from tessera.llm.buffers import flat

from . import brute

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


# toxicity


def test_the_threshold_parts_a_sample_where_it_errs_least():
    place = float(np.log(0.7 / 0.3))
    at, toxic = np.array([-9.0, -8, -2, 3, 4, -8.5]), np.array([0.0, 0, 0, 1, 1, 1])
    assert toxicity.parting(at, toxic) == 0.5  # one toxic row among the clean ones is given up
    draw = np.random.default_rng(2)
    at, toxic = draw.normal(size=60).round(1), draw.integers(0, 2, 60).astype(float)
    errs = lambda cut: int((toxic[at < cut] == 1).sum() + (toxic[at > cut] == 0).sum())
    assert errs(toxicity.parting(at, toxic)) == min(errs(x + 0.05) for x in np.unique(at)[:-1])
    for none in (np.zeros(3), np.ones(3)):
        assert toxicity.parting(np.arange(3.0), none) == pytest.approx(place)
    assert toxicity.parting(np.zeros(2), np.array([0.0, 1])) == pytest.approx(place) == toxicity.parting(np.zeros(0), np.zeros(0))


def toy_documents():
    draw = random.Random(1)
    rows = []
    for i in range(240):
        ws = [draw.choice(["apple", "river", "stone", "walk", "green", "house", "idiotic"[:5] if i % 4 == 0 else "idea"]) for _ in range(30)]
        rows.append((i, " ".join(ws)))
    return rows


@pytest.fixture(scope="module")
def scorer(spark):
    rows = toy_documents()
    labels = spark.createDataFrame([(i, int("idiot" in t)) for i, t in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    return toxicity.learn(brute.frame(spark, rows), labels)


def test_disguised_words_are_restored(scorer):
    restorer = toxicity.Restorer(scorer.model)
    for given, wanted in {"an 1d10t here": "an idiot here", "iiidiot": "idiot", "i d i o t": "idiot", "i.d.i.o.t!": "idiot!", "id!ot": "idiot", "walk 42 km": "walk 42 km"}.items():
        data, offsets = restorer.restore(*flat(pa.array(["x", given, ""])))
        assert data[offsets[1] : offsets[2]].tobytes().decode() == wanted and offsets[-1] == len(data)


def test_viterbi_takes_the_best_reading(scorer):
    import itertools

    def brute_force(word):
        best = None
        for choice in itertools.product(*toxicity.lattice(word)):
            text, cost = "".join(x for x, _ in choice), sum(c for _, c in choice)
            a = b = 0
            for c in text:
                s = toxicity._symbol(c)
                cost += scorer.model.log[a][b][s]
                a, b = b, s
            cost += scorer.model.log[a][b][0]
            best = max(best, (cost, text)) if best else (cost, text)
        return best[1]

    for word in ("1d10t", "st0nne", "gr33n", "w-a-l-k", "hooouse", "a99le"):
        assert toxicity.decode(word, scorer.model.log) == brute_force(word)


def test_disguises_of_any_length_and_place_are_restored():
    draw = random.Random(3)
    ws = ["you", "are", "such", "a", "loser", "and", "an", "ass", "idiot", "walking", "along", "the", "river", "price"]
    column = pa.array([" ".join(draw.choice(ws) for _ in range(4000))])
    found = list(toxicity._trigrams([pa.RecordBatch.from_arrays([column], ["text"])]))[0]
    restorer = toxicity.Restorer(toxicity.CharacterModel(*(found.column(i).to_numpy() for i in (0, 1))))
    sentence = "you are such an idiot and an idiot and you are the loser walking along the river"
    spaced = " ".join(sentence.replace(" ", ""))
    assert len(spaced) > 2 * 60
    wanted = {
        "l053r": "loser", "a55": "ass", "a$$": "ass", "(l0$3r!)": "(loser!)", "l--o--s---e-r": "loser", "1d10+": "idiot", "pric€": "price",
        "lo" + "s" * 60 + "er": "loser", "i" * 20 + "d" * 10 + "i" * 10 + "o" * 10 + "t" * 10: "idiot", "loser!": "loser!", "(loser": "(loser", "-loser-": "-loser-",
        spaced: sentence, "   ".join(" ".join(x) for x in sentence.split()): sentence, ".".join(sentence.replace(" ", "")): sentence.replace(" ", "."), "walking-along": "walking-along",
    }
    wanted |= {" ".join([spaced] * 300): " ".join([sentence] * 300)}
    for given, text in wanted.items():
        data, offsets = restorer.restore(*flat(pa.array(["x", given, "the"])))
        got = data[offsets[1] : offsets[2]].tobytes().decode()
        assert (got.split(".") if "." in given else got) == (text.split(".") if "." in given else text)


def test_toxicity_scores(spark, scorer):
    rows = [*brute.awkward(), (90, "what an idiot"), (91, "what an 1d1ot"), (92, "green house by the river")]
    found = toxicity.score(brute.frame(spark, rows), scorer).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    score = {r.doc_id: r.score for r in found}
    assert score[90] > 0.7 and score[91] == score[90] and score[92] < 0.3
    assert score[0] == score[1] == score[2]
    assert toxicity.score(brute.frame(spark, []), scorer).count() == 0


def test_toxicity_without_labels(spark):
    rows = brute.awkward()
    none = toxicity.learn(brute.frame(spark, rows), spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(0 <= r.score <= 1 for r in toxicity.score(brute.frame(spark, rows), none).collect())


# fingerprints


def check_next(spark, rows):
    found = spotsigs.compare_with_next(brute.frame(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(found) == len(rows)
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found)
    wanted = Counter()
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        wanted[(i, len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest())] += 1
    assert got == wanted
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    return {r.doc_id: r for r in found}


def test_edited_texts_on_awkward_rows(spark):
    found = check_next(spark, brute.awkward())
    assert found[8].fingerprint == found[9].fingerprint and found[8].near_next == 1.0
    assert found[4].fingerprint == found[5].fingerprint and found[0].fingerprint == ""


def test_edited_texts_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(spotsigs.in_order, "__defaults__", (3,))
    draw = random.Random(2)
    rows = [(i * 7, " ".join(draw.choice(["the", "of", "a", f"w{draw.randint(0, 50)}", "é"]) for _ in range(draw.randint(0, 30)))) for i in range(60)]
    draw.shuffle(rows)
    check_next(spark, rows)
    check_next(spark, rows[:1])
    assert spotsigs.compare_with_next(brute.frame(spark, [])).count() == 0


def test_signatures_are_anchored_chains():
    column = pa.array(["The quick fox of old hills", "the quick! FOX of OLD hills 12", "no such chain"])
    rows, values = spotsigs.signatures(*flat(column))
    sets = [set(values[rows == i].tolist()) for i in range(3)]
    assert sets[0] == sets[1] and len(sets[0]) == 2 and len(sets[2]) == 1
    assert spotsigs.likeness(np.array([1, 2, 3]), np.array([2, 3, 4])) == 0.5
    assert spotsigs.likeness(np.array([1]), np.arange(1, 9), least=0.5) == 0.0


def test_near_classes_equal_brute_force(spark, docs):
    texts = docs.select("doc_id", "text").orderBy("doc_id").toPandas()
    sizes, rows, values = spotsigs.spot_sets(pa.array(texts.text))
    edges = np.searchsorted(rows, np.arange(len(sizes) + 1))
    sets = [set(values[a:b].tolist()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    roots = brute.components(len(sets), lambda i, j: bool(sets[i]) and len(sets[i] & sets[j]) * 10 >= 8 * len(sets[i] | sets[j]))
    found = {r.doc_id: r.component_id for r in spotsigs.near_classes(docs).collect()}
    assert found == {texts.doc_id[i]: texts.doc_id[k] for i, k in enumerate(roots)}


# languages


def test_languages_of_held_out_documents(spark, docs):
    filters = language_id.learn(docs.filter(~language_id.held_out()))
    found = language_id.identify(docs, filters).filter(language_id.held_out()).collect()
    assert len(found) > 20 and sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
    rows = [*brute.awkward(), (50, "1234 !!"), (51, "漢字")]
    odd = {r.doc_id: r for r in language_id.identify(brute.frame(spark, rows), filters).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2, 50)] == ["und"] * 4 and odd[51].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in odd.values())
    assert language_id.identify(brute.frame(spark, []), filters).count() == 0
    nothing = language_id.learn(brute.frame(spark, rows).filter("false"))
    assert {r.lang_pred for r in language_id.identify(brute.frame(spark, rows), nothing).collect()} == {"und"}


def test_filters_contain_what_was_put_in():
    draw = np.random.default_rng(3)
    grams = draw.integers(0, 2**32, 3000)
    language = np.repeat([0, 1, 69], 1000)
    filters = language_id.LanguageFilters([f"l{i}" for i in range(70)], language, grams)
    counts = filters.popcounts(grams.astype(np.uint32), np.arange(3000), 3000)
    assert all(counts[i, language[i]] == 1 for i in range(3000))
    assert counts[:1000, 1].mean() < 0.05 and filters.false_rate[2] == 0


# transcripts


def test_viterbi_states_are_the_likeliest():
    import itertools

    import pandas as pd

    draw = np.random.default_rng(4)
    counts = pd.DataFrame([(k, s, v, int(draw.integers(1, 30))) for k in range(6) for s in range(6) for v in range(6 if k == 1 else 1 if k == 0 else chat_format.SIZES[k - 2])], columns=["kind", "state", "value", "times"])
    model = chat_format.RoleModel(counts)
    seen = np.stack([draw.integers(0, n, 5) for n in chat_format.SIZES], 1)
    seen[:, 0] = 1

    def score(path):
        total = model.first[path[0]] + sum(model.move[a, b] for a, b in itertools.pairwise(path))
        return total + sum(model.shows[k][s, seen[t, k]] for t, s in enumerate(path) for k in range(4))

    best = max(itertools.product(range(6), repeat=5), key=score)
    assert score(best) == pytest.approx(score(tuple(model.decode(seen))))


def test_parts_are_decoded_as_the_whole_transcript(spark):
    draw = np.random.default_rng(7)
    turns = [(c, t, "system" if t == 0 else ("user", "assistant")[t % 2], f"{'why' if t % 2 else 'because ' * int(draw.integers(1, 30))} {t}" + "\nmore\n" * int(draw.integers(0, 2)) + "?" * int(draw.integers(0, 2))) for c in range(12) for t in range(9)]
    model = chat_format.learn(chat_format.as_transcripts(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))
    texts = ["\n".join(f"{r.title()}: {x}" if draw.random() < 0.5 else x for c2, _, r, x in turns if c2 == c) for c in range(12)]
    parts, wholes = [], {}
    for c, whole in enumerate(texts):
        lines = whole.split("\n")
        path = model.decode(chat_format.observe(lines))
        cuts = sorted({0, len(lines), *draw.integers(1, len(lines), c % 4).tolist()})
        pieces = list(zip(cuts[:-1], cuts[1:], strict=True))
        ways = chat_format.ways([model.crossing(chat_format.observe(lines[a:b])) for a, b in pieces])
        states = [model.decode(chat_format.observe(lines[a:b]), *way) for (a, b), way in zip(pieces, ways, strict=True)]
        assert np.concatenate(states).tolist() == path.tolist()
        for i, (a, b) in enumerate(pieces):
            parts.append((c, i, "\n".join(lines[a:b]), "kept"))
            wholes[c, i] = (bool(i and path[a] % 2), [chat_format.ROLES[s // 2] for k, s in enumerate(path[a:b]) if k == 0 or s % 2 == 0], any(x.strip() for x in lines[a:b]))
    parts += [(50, 0, None, "kept"), (50, 1, "User: hi", "kept"), (50, 2, " ", "kept"), (50, 3, "well", "kept"), (None, 0, "User: hi", "kept"), (None, 1, "AI: yes", "kept"), (51, None, "AI: yes", "kept")]
    found = {(r.conv_id, r.part): r for r in chat_format.parse_parts(spark.createDataFrame(parts, "conv_id long, part long, text string, turns string"), model, "conv_id").collect()}
    assert len(found) == len(parts)
    for key, (continues, roles, has_text) in wholes.items():
        assert ([t.role for t in found[key].turns], found[key].continues) == ((roles, continues) if has_text else ([], False))
    assert [len(found[50, i].turns) for i in range(4)] == [0, 1, 0, 1] and not found[50, 1].continues
    for key, alone in (((None, 0), "User: hi"), ((None, 1), "AI: yes"), ((51, None), "AI: yes")):
        assert [t.asDict() for t in found[key].turns] == chat_format.parse_text(alone, model) and not found[key].continues
    assert chat_format.ways([]) == []


def test_transcripts_come_apart_into_turns(spark):
    turns = [(i, t, ("user", "assistant")[t % 2], f"{'why' if t % 2 == 0 else 'because ' * 30} {i} {t}" + ("\nmore" if t % 2 else "?")) for i in range(40) for t in range(4)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = chat_format.as_transcripts(rows)
    model = chat_format.learn(made)
    found = chat_format.parse(made.withColumnRenamed("turns", "given"), model).collect()
    right = sum([t.role for t in r.turns] == [t.role for t in r.given] for r in found)
    assert len(found) == 40 and right >= 36
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "  \n"), (4, "User: hi\nAI: yes\nwell\n\n"), (4, "User: hi\nAI: yes\nwell\n\n")], "id int, text string")
    parsed = {r.id: r for r in chat_format.parse(odd, model).withColumn("out", chat_format.rendered(F.col("turns"))).collect()}
    assert [len(parsed[i].turns) for i in (1, 2, 3)] == [0, 0, 0]
    assert parsed[4].out == "<|user|>\nhi\n<|end|>\n<|assistant|>\nyes\nwell\n<|end|>\n"
    nulls = spark.createDataFrame([(None, None, None, None), (1, None, "user", None), (1, 2000, "tool", "x")], "conv_id long, turn long, role string, text string")
    assert chat_format.parse(chat_format.as_transcripts(nulls), model).count() == 3
    assert chat_format.as_transcripts(nulls.filter("false")).count() == 0


def test_likeness_equals_that_of_plain_sets(spark, docs):
    """near_edited and near_next of whole documents against sets of chains made one word after the other."""
    rows = sorted((r.doc_id, r.text or "") for r in docs.orderBy("doc_id").limit(60).collect()) + [(10**9, ""), (10**9 + 1, None), (10**9 + 2, "the"), (10**9 + 3, "river and stone walk of the green house")]
    letters = re.compile("[^\\x00-\\x60\\x7B-\\x7F]+")
    anchors = set(spotsigs.ANCHORS)

    def signatures(text):
        ws = letters.findall((text or "").translate(brute.LOWER))

        def chains(starts, links):
            return {(ws[i], *[ws[k] for k in after[:2]]) for i in starts if len(after := [k for k in links if k > i]) >= 2}

        every = range(len(ws))
        found = chains([i for i in every if ws[i] in anchors], [i for i in every if ws[i] not in anchors])
        return found or chains(every, every) or ({tuple(ws)} if ws else set())

    def jaccard(a, b):
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    given = [(i, t or "") for i, t in rows]
    found = {r.doc_id: r for r in spotsigs.compare_with_next(brute.frame(spark, rows)).collect()}
    assert len(found) == len(rows)
    for k, (doc_id, text) in enumerate(given):
        other = given[(k + 1) % len(given)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + other[:cut]
        own, r = signatures(text), found[doc_id]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(jaccard(own, signatures(edited)), abs=1e-6) and r.near_next == pytest.approx(jaccard(own, signatures(other)), abs=1e-6)
        assert len(r.fingerprint) == 8 * len(own)


# language model


def test_model_gradients():
    mass = np.arange(recurrent_lm.ENTRIES, 0, -1.0)
    model = recurrent_lm.GatedModel(mass)
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
    draw = np.random.default_rng(5)
    inputs, targets = draw.integers(0, 60, (4, 3)), draw.integers(0, 60, (4, 3))
    resets = np.zeros((4, 3), bool)
    resets[2, 1] = True
    h = draw.standard_normal((3, recurrent_lm.HIDDEN)) * 0.1
    before = {k: v.copy() for k, v in model.p.items()}

    def loss():
        states, _, _ = model.forward(inputs, resets, h)
        return -model.outputs(states.reshape(-1, recurrent_lm.HIDDEN).astype(np.float64), targets.ravel())[0].sum()

    squares = {k: np.zeros(s) for k, s in model.SHAPES.items()}
    model.learn_window(inputs, targets, resets, np.ones((4, 3), bool), h, squares)
    moved = {k: model.p[k] - before[k] for k in before}
    for k in recurrent_lm.GatedModel.SHAPES:
        model.p = {n: v.copy() for n, v in before.items()}
        at = np.unravel_index(np.abs(moved[k]).argmax(), moved[k].shape)
        slopes = []
        for e in (1e-3, -1e-3):
            model.p[k][at] = before[k][at] + e
            slopes.append(loss())
        gradient = (slopes[0] - slopes[1]) / 2e-3
        assert math.sqrt(squares[k][at]) == pytest.approx(min(1.0, abs(gradient) / 12**0.5), rel=0.05, abs=1e-3)
        assert np.sign(moved[k][at]) == -np.sign(gradient)


def test_lanes_hold_each_token_once_in_order():
    lengths = np.array([5, 1, 9, 2, 2, 30, 1])
    lanes = recurrent_lm.Lanes(lengths, 3)
    seen = np.concatenate([place[live] for place, live in lanes.windows(4)])
    assert sorted(seen.tolist()) == list(range(50))


def check_likelihoods(spark, rows, table_entries):
    learned = [(i, t) for i, t in rows if i is not None and i % 3]
    found = recurrent_lm.score(brute.frame(spark, rows), *recurrent_lm.learn(brute.frame(spark, learned), table_entries)).collect()
    split = {i: brute.WORDS.findall((t or "").translate(brute.LOWER)) for i, t in rows}
    counts = Counter(w for i, t in learned for w in brute.WORDS.findall((t or "").translate(brute.LOWER)))
    ends, n = len(learned), sum(counts.values()) + len(learned)
    norm = math.log10(n + 0.5 * (len(counts) + (ends > 0) + 1))
    assert len(found) == len(rows)
    for r in found:
        ws = split[r.doc_id]
        base = sum(math.log10(counts[w] + 0.5) - norm for w in ws) + math.log10(ends + 0.5) - norm
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws) + 1, sum(counts[w] > 0 for w in ws) + (ends > 0), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    return found


def test_likelihoods_on_awkward_rows(spark):
    found = check_likelihoods(spark, brute.awkward(), 1 << 20)
    twins = [r.score for r in found if r.doc_id == 8]
    assert len(twins) == 2 and twins[0] == pytest.approx(twins[1])


def test_words_beyond_the_table_are_joined(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = check_likelihoods(spark, rows, 300)
    full = {r.doc_id: r.base_score for r in check_likelihoods(spark, rows, 1 << 20)}
    assert all(r.base_score == pytest.approx(full[r.doc_id]) for r in found)


def test_model_beats_counts_and_needs_no_documents(spark, docs):
    learned = docs.filter(~recurrent_lm.held_out())
    found = recurrent_lm.score(docs.filter(recurrent_lm.held_out()), *recurrent_lm.learn(learned)).agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > found[1]
    nothing = recurrent_lm.learn(docs.filter("false"))
    assert recurrent_lm.score(docs.limit(3), *nothing).count() == 3
    assert recurrent_lm.score(docs.filter("false"), *nothing).count() == 0


def test_every_text_trains_once_and_copies_spread(spark, docs, tmp_path, monkeypatch):
    def noted(batches, vocabulary, vector):
        texts = [x or "" for b in batches for x in b.column("text").to_pylist()]
        (tmp_path / f"{random.SystemRandom().getrandbits(60)}").write_text("\x00".join(texts + [""]))
        yield from ()

    copies = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a copied text").alias("text"))
    learned = docs.select("doc_id", "text").unionByName(copies)
    monkeypatch.setattr(recurrent_lm, "_train", noted)
    recurrent_lm.learn(learned)
    tasks = [p.read_text().split("\x00")[:-1] for p in tmp_path.iterdir()]
    assert Counter(t for task in tasks for t in task) == Counter(r.text or "" for r in learned.collect())
    assert max(task.count("a copied text") for task in tasks) < 200


def test_scores_equal_a_step_by_step_reading(spark, docs):
    """The score of whole documents, longer than a window and a piece too, against one token after the other."""
    learned = docs.filter(~recurrent_lm.held_out())
    counts, vocabulary, vector = recurrent_lm.learn(learned)
    model, n = recurrent_lm.GatedModel(vocabulary.mass).load(vector), recurrent_lm.HIDDEN
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    chosen = [(r.doc_id, r.text or "") for r in docs.orderBy(F.length("text").desc()).limit(2).unionByName(docs.orderBy("doc_id").limit(6)).collect()]
    count_of = {r.h: r.c for r in counts.collect()}
    found = {r.doc_id: r.score for r in recurrent_lm.score(brute.frame(spark, chosen), counts, vocabulary, vector).collect()}
    for doc_id, text in chosen:
        w, hashes, bucket = recurrent_lm._tokens(pa.array([text]))
        entries, _, rare = vocabulary.look_up(hashes, bucket)
        state, last, total = np.zeros(n), vocabulary.end, 0.0
        for i, entry in enumerate([*entries.tolist(), vocabulary.end]):
            z, r = (1 / (1 + np.exp(-(p[f"x{k}"][last] + state @ p[f"w{k}"]))) for k in "zr")
            new = np.tanh(p["xn"][last] + r * (state @ p["wn"]))
            state = z * state + (1 - z) * new
            kind = entry // recurrent_lm.PER_CLASS
            inside = slice(kind * recurrent_lm.PER_CLASS, (kind + 1) * recurrent_lm.PER_CLASS)
            a, b = np.exp(state @ p["c"] + p["cb"]), np.exp(p["o"][inside] @ state + p["ob"][inside])
            total += math.log10(a[kind] / a.sum() * b[entry - inside.start] / b.sum())
            if i < len(entries) and rare[i]:
                total += math.log10(count_of.get(int(hashes[i : i + 1].view(np.int64)[0]), 0) + 0.5) - vocabulary.bucket_norm[bucket[i]]
            last = entry
        assert found[doc_id] == pytest.approx(total, rel=1e-4)


def test_probabilities_add_up():
    mass = np.arange(recurrent_lm.ENTRIES, 0, -1.0)
    model = recurrent_lm.GatedModel(mass)
    state = np.tile(np.random.default_rng(6).standard_normal((1, recurrent_lm.HIDDEN)).astype(np.float32), (recurrent_lm.ENTRIES, 1))
    assert np.exp(model.outputs(state, np.arange(recurrent_lm.ENTRIES))[0].astype(float)).sum() == pytest.approx(1, abs=1e-4)


# pipeline


def test_pipeline_stages_take_effect(spark, tmp_path):
    draw = random.Random(7)

    def text(n):
        return " ".join(draw.choice(["the", "river", "stone", "walk", "green", "house"]) + str(draw.randint(0, 500)) for _ in range(n))

    passage, test = text(60), text(12)
    whole = text(80)
    rows = [(1, text(50)), (2, whole), (3, whole), (4, whole.replace(whole.split()[40], "other", 1)), (5, text(30) + " " + passage), (6, passage + " " + text(30)), (7, text(20) + " " + test + " " + text(20)), (8, "12345 !!! 99"), (9, None), (10, text(25))]
    folder = tmp_path / "tables"
    brute.frame(spark, rows).select(*corpus_pipeline.COLUMNS).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, test)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    out, kept = spark.read.parquet(str(folder / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(folder))
        assert set(corpus_pipeline.COLUMNS) <= set(out.columns), name
        kept.append({r.doc_id: r for r in out.collect()})
        assert all(r.n_chars == len(r.text) for r in kept[-1].values())
    assert set(kept[0]) == {1, 2, 3, 4, 5, 6, 7, 10}
    assert set(kept[1]) == {1, 2, 5, 6, 7, 10}
    assert passage.split()[30] not in kept[2][5].text and set(kept[2]) == set(kept[1])
    assert test not in kept[3][7].text and kept[3][1].text == rows[0][1]
    assert set(kept[4]) <= set(kept[3]) and all(r.taken > 0 for r in kept[4].values())
    run = corpus_pipeline.run(spark, str(folder)).collect()
    assert {r.doc_id for r in run} == set(kept[4])


def test_pipeline_takes_out_copies_with_distant_edits_or_text_appended(spark):
    ws = [f"word{i}" for i in range(100)]
    edited = [*ws[:30], "other", *ws[31:70], "another", *ws[71:]]
    rows = [(1, " ".join(ws)), (2, " ".join(edited)), (3, " ".join(ws + [f"more{i}" for i in range(15)])), (4, " ".join(ws + [f"tail{i}" for i in range(60)]))]
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, brute.frame(spark, rows), "").collect()} == {1, 4}


def test_pipeline_keeps_one_of_repeated_rows(spark):
    base, other = (" ".join(f"{k}{i}" for i in range(60)) for k in ("word", "thing"))
    rows = [(1, base), (1, base), (2, other), (3, base), (4, other + " more"), (5, "short"), (5, "short"), (5, "another text"), (None, base), (None, base), (None, None)]
    kept = corpus_pipeline.near_duplicates(spark, brute.frame(spark, rows), "")
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=repr) == sorted([(1, base), (2, other), (5, "short"), (5, "another text"), (None, base), (None, None)], key=repr)
    left = corpus_pipeline.repeated_passages(spark, kept.filter("doc_id IS NOT NULL"), "")
    assert {(r.doc_id, r.text) for r in left.collect()} == {(1, base), (2, other), (5, "short"), (5, "another text")}


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path, empty):
    rows = [] if empty else [*brute.awkward(), (40, "plain words here"), (41, None)]
    folder = tmp_path / "tables"
    frame = brute.frame(spark, rows).withColumn("source", F.when(F.col("doc_id") != 40, F.col("source")))
    frame.withColumn("n_chars", F.when(F.col("doc_id") != 3, F.col("n_chars"))).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    out = spark.read.parquet(str(folder / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out, str(folder)).write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        assert set(corpus_pipeline.COLUMNS) <= set(out.columns)
    kept = {r.doc_id for r in out.collect()}
    assert kept <= {i for i, _ in rows} and not kept & {0, 1, 2, 41} and (empty or {3, 7, 40} & kept)
