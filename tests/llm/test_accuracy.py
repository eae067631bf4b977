"""Held-out accuracy and brute force over the small test tables."""

import random
from collections import defaultdict
from itertools import product
from pathlib import Path

import numpy as np
import pytest

from cuewright.llm import leaks, marks, mix, registry, sentence_ops, sentences, truncation, turns
from cuewright.tables import table

DATA = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def cues(spark):
    rows = [r["text"] for r in table(spark, DATA, "cues", "run_id", "cue_idx", "text").orderBy("run_id", "cue_idx", "text").collect() if r["text"]]
    rows = [r for r in rows if marks.speech(r).strip() and not marks.speech(r)[-1:].isalpha() and "…" not in r[-1:]]
    random.Random(1).shuffle(rows)
    return rows


def test_sentence_seams_held_out(cues):
    """Chains of unseen cues of one language are cut where they were joined."""
    model = sentences.fit(cues[:1200])
    by = defaultdict(list)
    for c in cues[1200:2400]:
        by[sentences._guess(c)].append(c)
    right = wrong = missed = 0
    for lang, cs in by.items():
        if lang == "th":
            continue
        for i in range(0, len(cs) - 3, 3):
            text, want = "", []
            for c in cs[i : i + 3]:
                text += (" " if text and lang not in ("zh", "ja") else "") + c.strip()
                want.append(len(text))
            got = set(sentences.sentence_ends(text, model))
            right += len(got & set(want[:-1]))
            wrong += len(got - set(want[:-1]))
            missed += len(set(want[:-1]) - got)
    assert right > 300 and wrong < 0.03 * right and missed < 0.03 * right, (right, wrong, missed)


def test_truncation_held_out(cues):
    none = (frozenset(), frozenset())
    model = truncation.fit([(c, none) for c in cues[:1500]])
    rng = random.Random(3)
    bad = lambda t: (x := truncation.features(t, none, model.words)) is not None and float(model.weights[x].sum()) > model.threshold
    whole = [c for c in cues[1500:2500] if len(c) > 25]
    cut = [c[: rng.randrange(8, len(c) - 6)] for c in whole]
    assert sum(map(bad, whole)) < 0.03 * len(whole) and sum(map(bad, cut)) > 0.8 * len(cut)


def _noisy(texts, rng):
    """(text, place of each token that was put in, with its state): clean texts with labels, clocks, notes and fillers put in."""
    notes, clocks = ["[applause]", "(laughs)", "*coughs*", "♪ music ♪", "<noise>", "<Noise>", "<Door>"], ["00:01:02", "[00:03.5]", "(1:20)", "00:01:02 -"]
    for text in texts:
        ws = text.split()
        lang = sentences._guess(text)
        put: list[tuple[int, str, str]] = []
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(ws) + 1)
            f = rng.choice(marks.FILLERS.get(lang, marks.FILLERS["en"]))
            bare = sentences.bare(text)
            put.append(rng.choice([(at, rng.choice(notes), "annotation"), (at, rng.choice(clocks), "timestamp"), (at, f if bare else f + rng.choice([",", ",", "..."]), "filler")]))
        if rng.random() < 0.4:
            put.append((0, rng.choice(["Tavi Orre:", ">> Tavi:", "[B]", "- Orre:", "Speaker A:"]), "speaker"))
        out, gold, size = [], [], 0
        for k in range(len(ws) + 1):
            for _, token, state in sorted((p for p in put if p[0] == k), key=lambda p: p[2] != "speaker"):
                gold.append((size, size + len(token), state))
                out.append(token)
                size += len(token) + 1
            if k < len(ws):
                out.append(ws[k])
                size += len(ws[k]) + 1
        yield " ".join(out), gold


def test_sequence_decides_held_out(spark):
    """On unseen texts with noise put in the best path is right more often than the best state of each token."""
    rows = [r[0] for r in table(spark, DATA, "segments", "text_src").where("text_src is not null").orderBy("text_src").collect()]
    random.Random(2).shuffle(rows)
    model = turns.fit(rows[:1000])
    plain = [t for t in rows[1000:] if "&" not in t and not turns._SPECIAL.search(t.replace("à", "").replace(" um ", " ")) and sentences._guess(t) not in ("zh", "ja", "th")]
    wrong_path = wrong_apart = differ = n = 0
    for text, gold in _noisy(plain, random.Random(3)):
        tokens = turns.shapes(text)
        seen = turns.observed(text, tokens)
        for (state, a, b), o in zip(model.tag(text), seen):
            want = next((s for x, y, s in gold if x <= a and b <= y), "speech")
            alone = model.apart(o)
            n, differ = n + 1, differ + (state != alone)
            wrong_path, wrong_apart = wrong_path + (state != want), wrong_apart + (alone != want)
    print(f"tokens {n}, path and single choice differ in {differ}, wrong by path {wrong_path}, by single choice {wrong_apart}")
    assert n > 10_000 and differ > 50 and wrong_path < 0.5 * wrong_apart and wrong_path < 0.01 * n


def test_leaks_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, DATA, "documents", "doc_id", "text").collect()]
    items = [(r["item_id"], r["passage"]) for r in table(spark, DATA, "eval_items", "item_id", "passage").collect()]
    index = leaks.build_index(items)
    have = defaultdict(set)
    for p, at in enumerate(index.shingles):
        for s in at:
            have[s].add(p)
    want = set()
    for d, text in docs:
        w = leaks.words(text)
        h = leaks.shingle_hashes(np.fromiter(map(leaks._word_hash, w), np.uint64, len(w))).tolist()
        near = defaultdict(list)
        for j, s in enumerate(h):
            for p in have.get(s, ()):
                near[p].append(j)
        want |= {(d, p) for p, js in near.items() if leaks.held(w, h, js, index.passages[p], index.shingles[p]) >= leaks.SHARE}
    got = {(docs[d][0], p) for d, p, _ in leaks.search([t for _, t in docs], index)}
    assert len(want) > 30 and len(want & got) >= 0.98 * len(want) and got <= want


def test_flow_against_brute_force():
    rng = random.Random(6)
    for _ in range(40):
        caps = {p: rng.randrange(0, 4) for p in ("a", "a|b", "b")}
        quotas, repeats = {"a": rng.randrange(0, 9), "b": rng.randrange(0, 9)}, {"a": rng.randrange(1, 3), "b": rng.randrange(1, 3)}
        got = mix.routes(caps, quotas, repeats)
        total, cost = sum(f for *_, f in got), sum(f * r * r for _, r, _, f in got)
        arcs = [(p, r, s) for p in caps for r in (1, 2) for s in p.split("|") if r <= repeats[s]]
        best = None
        for fs in product(*[range(min(caps[p], quotas[s]) + 1) for p, _, s in arcs]):
            used, filled = defaultdict(int), defaultdict(int)
            for (p, r, s), f in zip(arcs, fs):
                used[p, r] += f
                filled[s] += f
            if all(used[k] <= caps[k[0]] for k in used) and all(filled[s] <= quotas[s] for s in filled):
                key = (-sum(fs), sum(f * r * r for (_, r, _), f in zip(arcs, fs)))
                best = key if best is None or key < best else best
        assert (-total, cost) == best


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_run(spark, name):
    columns = {
        "p1_found": ["run_id", "field", "idx", "end_pos"], "p2_found": ["run_id", "first_idx", "last_idx", "speaker"], "p3_found": ["run_id", "idx", "cut_word_idx"],
        "p5_found": ["run_id", "idx", "defect"], "p6_found": ["run_id", "idx", "field"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "kind"],
    }
    df = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.columns == columns.get(name, df.columns)
    rows = df.collect()
    assert len(set(map(repr, rows))) == len(rows)


def test_source_and_translation_have_as_many_sentences(spark):
    """An independent check: translations go sentence by sentence."""
    model = sentence_ops.fit_model(spark, DATA)
    rows = table(spark, DATA, "segments", "text_src", "text_target").where("text_src is not null and text_target is not null").collect()
    ended = lambda t: marks.speech(t).rstrip()[-1:] in marks.ENDERS + marks.CLOSERS + "“"
    pairs = [(r[0], r[1]) for r in rows if ended(r[0]) and ended(r[1]) and 0.3 < len(r[1]) / max(1, len(r[0])) < 3]
    same = sum(len(sentences.sentence_ends(a, model)) == len(sentences.sentence_ends(b, model)) for a, b in pairs)
    assert len(pairs) > 500 and same > 0.97 * len(pairs), (same, len(pairs))
