import html
import random
import resource
import time

import numpy as np

from aerolith.llm.leaks import SHARED, Index, Unit, find_leaks, joined, words


def brute(items, texts):
    out = set()
    for d, t in texts:
        w = joined(t)
        for i, parts in items:
            for p in parts:
                x = words(p)
                if any("".join(x[k : k + SHARED]) in w for k in range(len(x) - SHARED + 1)):
                    out.add((i, d))
    return out


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(120)] + ["the", "of", "le", "de"] * 6
    items = [(k, (" ".join(r.choice(vocab) for _ in range(r.randint(5, 60))), " ".join(r.choice(vocab) for _ in range(r.randint(0, 20))))) for k in range(40)]
    texts = []
    for d in range(300):
        t = [r.choice(vocab) for _ in range(r.randint(0, 200))]
        if r.random() < 0.5:
            src = words(r.choice(items)[1][0])
            n = r.randint(6, 14)
            a = r.randint(0, max(0, len(src) - n))
            at = r.randint(0, len(t))
            t[at:at] = src[a : a + n]
        texts.append((d, " ".join(t)))
    return items, texts


def test_against_brute_force(spark):
    items, texts = corpus(1)
    df = find_leaks(spark.createDataFrame(texts, "doc_id bigint, text string"), "doc_id", "text", spark.createDataFrame([(i, *p) for i, p in items], "item_id bigint, a string, b string"), "item_id", ("a", "b"))
    got = [(r.item_id, r.doc_id) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(items, texts)


def test_retrieval_loses_nothing():
    for seed in range(3):
        items, texts = corpus(seed + 10)
        units = [Unit(i, words(p)) for i, ps in items for p in ps]
        index = Index(units)
        kept = {(index.items[j], texts[i][0]) for i, j in index.retrieve([joined(t) for _, t in texts])}
        assert brute(items, texts) <= kept


def test_appearances():
    p = "L'équipe Toriciac nota que chaque auvent lointain réchauffait son portique dès l'anneau"
    forms = [p.upper(), p.replace("é", "e").replace("è", "e"), html.escape(p).replace("é", "&eacute;"), "<p>" + p.replace(" ", "&nbsp;") + "</p>", p.replace(" ", " – "), p.replace("auvent", "au​vent").replace(" ", "\n"), "**" + p.replace(" ", "** **") + "**"]
    index = Index([Unit(1, words(p))])
    for f in forms:
        assert index.leaks([joined("avant " + f + " après")]) == [(0, 1, 1, False)], f


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (None, "x")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, None, ""), (2, "a b c", None), (None, "a", "b")], "item_id bigint, a string, b string")
    assert find_leaks(docs, "doc_id", "text", items, "item_id", ("a", "b")).count() == 0
    assert find_leaks(docs.limit(0), "doc_id", "text", items.limit(0), "item_id", ("a", "b")).count() == 0


def test_blanks_do_not_matter():
    """Words split or glued by the text are found, in leaks of just ten words, of words of one letter too."""
    p = "alpha bravo charlie delta echo foxtrot golf hotel india juliet"
    q = "a b c d e f g h i j k l"
    index = Index([Unit(1, words(p)), Unit(2, words(q))])
    for f in (p.replace("alpha bravo", "alphabravo"), p.replace("alpha", "al pha").replace("hotel", "ho-\ntel"), " ".join(p.replace(" ", "")), p.replace("echo", "e<b>ch</b>o"), p.replace(" ", "")):
        assert index.leaks([joined(f"before, {f}; after it")]) == [(0, 1, 1, False)], f
    assert index.leaks([joined("see " + q.replace(" ", "") + ".")]) == [(0, 2, 1, False)]
    assert index.leaks([joined("alpha bravo charlie delta echo, foxtrot golf hotel")]) == []


def test_wand_against_full_scores():
    """Many units over few terms, in several blocks: the same as adding up all weights."""
    r = np.random.default_rng(4)
    vocab = ["".join(chr(97 + c) for c in r.integers(0, 26, 12)) for _ in range(60)]
    units = [Unit(i, [vocab[k] for k in r.integers(0, 60, 14)]) for i in range(500)]
    index = Index(units)
    for _ in range(200):
        terms = np.unique(r.integers(0, len(index.terms), 40))
        score = np.zeros(len(units))
        for t in terms:
            at = slice(index.start[t], index.start[t + 1])
            score[index.unit[at]] += index.weight[at]
        assert sorted(index.due(terms)) == np.flatnonzero(score >= 1).tolist()
    for t in range(len(index.terms)):
        for k, b in enumerate(range(index.block_start[t], index.block_start[t + 1])):
            at = index.start[t] + 64 * k
            assert index.block_most[b] == index.weight[at : min(at + 64, index.start[t + 1])].max()


def test_ten_thousand_items():
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(20000)]
    units = [Unit(i, [r.choice(vocab) for _ in range(n)], k) for i in range(10_000) for k, n in enumerate((60, 16))]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    index = Index(units)
    texts = [" ".join(r.choice(vocab) for _ in range(100)) for _ in range(500)]
    texts[7] += " " + " ".join(units[4001].words[3:13])
    at = time.process_time()
    assert [(i, item, parts) for i, item, parts, _ in index.leaks([joined(t) for t in texts])] == [(7, units[4001].item, 1 << units[4001].part)]
    assert time.process_time() - at < 5
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # kB


def test_report(spark):
    p = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, p + " and the answer: blue!"), (2, p), (2, "where is the big red box that was on the old table"), (3, "blue")], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, p, "Where is the big red box that was on the old table?", "Blue"), (6, None, "short one", None)], "item_id bigint, passage string, question string, answer string")
    got = {(r.item_id, r.doc_id): (r.parts, r.answered) for r in find_leaks(docs, "doc_id", "text", items, "item_id", ("passage", "question"), "answer").collect()}
    assert got == {(5, 1): (["passage"], True), (5, 2): (["passage", "question"], False)}


def test_many_items_make_several_indexes(spark, monkeypatch):
    from aerolith.llm import leaks

    monkeypatch.setattr(leaks, "INDEX_CHARS", 900)
    items, texts = corpus(2)
    df = find_leaks(spark.createDataFrame(texts, "doc_id bigint, text string"), "doc_id", "text", spark.createDataFrame([(i, *p) for i, p in items], "item_id bigint, a string, b string"), "item_id", ("a", "b"))
    assert {(r.item_id, r.doc_id) for r in df.collect()} == brute(items, texts)
