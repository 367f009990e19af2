import itertools
import math
import random

import pytest

from aerolith.llm import privacy_training as training
from aerolith.llm.privacy import Scorer, Span, best, detect, find, fit, marginals, transition, weights


def counts(w, labelled):
    """kind -> [hit, wrong, lost]"""
    out, score = {}, Scorer(w)
    for text, gold in labelled:
        got, gold = {(s.start, s.end, s.kind) for s in find(text, w, score)}, set(gold)
        for i, part in enumerate((got & gold, got - gold, gold - got)):
            for x in part:
                out.setdefault(x[2], [0, 0, 0])[i] += 1
    return out


def test_frames_and_words_held_out(monkeypatch):
    """Fitted to every second frame, family, syllable and street; measured on the others."""
    held = ("_HEAD", "_TAIL", "_TOWN_TAIL", "FAMILIES", "_STREET_FR", "_STREET_DE", "_STREET_ES", "_STREET_EN", "_COMMON", "_PLACE_FR", "_PLACE_EN", "_PLACE_ES")
    whole = {n: getattr(training, n) for n in held}
    for n in held:
        monkeypatch.setattr(training, n, whole[n][::2])
    w = fit(training.sentences(10, 7, training.FRAMES[::2]))
    for n in held:
        monkeypatch.setattr(training, n, whole[n][1::2])
    got = counts(w, training.sentences(4, 12345, training.FRAMES[1::2]))
    print({k: (round(h / (h + x), 3), round(h / (h + m), 3)) for k, (h, x, m) in got.items()})
    for kind, (hit, wrong, lost) in got.items():
        floor = 0.8 if kind == "name" else 0.85
        assert hit / (hit + wrong) > floor and hit / (hit + lost) > floor, (kind, hit, wrong, lost)


@pytest.mark.parametrize("seed", range(5))
def test_dynamic_programme_against_all_subsets(seed):
    r = random.Random(seed)
    text = "abcdefghijklmnopqrstuvwxyz"
    places = sorted({(a, a + r.randint(1, 6)) for a in (r.randint(0, 14) for _ in range(9))}, key=lambda s: (s[1], s[0]))
    spans = [Span(a, b, r.choice(("name", "phone")), ((lambda i: [f"f{i}"], (i,)),)) for i, (a, b) in enumerate(places)]
    w = {f"f{i}": r.uniform(-1, 2) for i in range(len(spans))}
    for x, y in itertools.permutations(spans, 2):
        if 0 <= y.start - x.end <= 3:
            w[transition(text, x, y)] = r.uniform(-1, 1)
    sets = [c for n in range(len(spans) + 1) for c in itertools.combinations(range(len(spans)), n) if all(spans[i].end <= spans[j].start for i, j in itertools.pairwise(c))]

    def score(c):
        near = sum(w[transition(text, spans[i], spans[j])] for i, j in itertools.pairwise(c) if spans[j].start - spans[i].end <= 3)
        return sum(w[f"f{i}"] for i in c) + near

    chosen = best(text, spans, Scorer(w), w)
    assert score(tuple(spans.index(s) for s in chosen)) == pytest.approx(max(map(score, sets)))
    single, pairs = marginals(text, spans, [w[f"f{i}"] for i in range(len(spans))], w)
    z = sum(math.exp(score(c)) for c in sets)
    for i, p in enumerate(single):
        assert p == pytest.approx(sum(math.exp(score(c)) for c in sets if i in c) / z)
    for (i, j), p in pairs.items():
        assert p == pytest.approx(sum(math.exp(score(c)) for c in sets if (i, j) in itertools.pairwise(c)) / z)


CASES = [
    ("Rappeler le 06 48 21 77 05 demain.", [("phone", "06 48 21 77 05")]),
    ("série 04 05 06 07 08 09 10 11, étape 3", []),
    ("Rapport signé par DELMAS Jean-Pierre.", [("name", "DELMAS Jean-Pierre")]),
    ("square Henri Verdois (entrée nord)", []),
    ("Mme Lartigue a rendu la clé.", [("name", "Lartigue")]),
    ("Elle habite 14 bis, rue des Peupliers, 31400 Toulouse.", [("address", "14 bis, rue des Peupliers, 31400 Toulouse")]),
    ("mail : paul.henin [at] ateliers-duroc [dot] org", [("email", "paul.henin [at] ateliers-duroc [dot] org")]),
    ("norm of A@B (k=4) at 20m.mesh2", []),
    ("NIR 2 84 05 33 063 112 77", [("id_number", "2 84 05 33 063 112 77")]),
    ("Anschrift: Lindenweg 12\n50667 Kelheim\n", [("address", "Lindenweg 12\n50667 Kelheim")]),
    ("between 3 and 9 plots of land", []),
]


@pytest.mark.parametrize("text, want", CASES)
def test_cases(text, want):
    assert [(s.kind, text[s.start : s.end]) for s in find(text, weights())] == want


def test_neighbours_share_no_character():
    text = "Anna Keller, Hauptstr. 5, 80331 Talheim, Tel. +49 89 1234567, anna.keller@mail.example, SSN 212-09-9999"
    got = find(text, weights())
    assert [s.kind for s in got] == ["name", "address", "phone", "email", "id_number"]
    assert all(a.end <= b.start for a, b in itertools.pairwise(got))


def test_rows(spark):
    long = "Le parvis est sec. " * 20000 + "Contact: Elena Marsaut\n" + "🌳 fin"
    rows = [(1, None), (2, ""), (3, "🌳 Call 020 7946 0171 before noon."), (4, long), (4, long)]
    got = {r.doc_id: r for r in detect(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text").collect()}
    assert got[1].redacted is None and got[1].kinds == [] and got[2].redacted == ""
    assert got[3].redacted == "🌳 Call [PHONE] before noon." and (got[3].starts, got[3].ends) == ([7], [20])
    assert got[4].kinds == ["name"] and got[4].redacted.endswith("Contact: [NAME]\n🌳 fin")
    assert detect(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


def test_workers_find_what_the_driver_finds(spark):
    """The workers know the common words too."""
    texts = [text for text, _ in training.sentences(1, 4242)]
    w = weights()
    got = {r.i: [tuple(x) for x in zip(r.starts, r.ends, r.kinds)] for r in detect(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "i", "t").collect()}
    assert got == {i: [(s.start, s.end, s.kind) for s in find(t, w)] for i, t in enumerate(texts)}
