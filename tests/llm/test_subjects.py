import random

import numpy as np

from strandflow.llm import subjects as M

WORDS = {
    "biology": "genome enzyme habitat larva codon plasmid microbe".split(),
    "law": "statute verdict clause plaintiff warranty covenant tribunal".split(),
    "sport": "referee goalkeeper stadium medal innings marathon podium".split(),
}
PLAIN = "load save index value count helper config table row list".split()


def text(rng, names, n=120):
    out = []
    for _ in range(n):
        a, b = rng.choice(PLAIN), rng.choice(WORDS[rng.choice(names)]) if rng.random() < 0.6 else rng.choice(PLAIN)
        style = rng.randrange(4)
        out.append((f"{a}_{b}", f"{a}{b.title()}", a + b, f"# the {a} of {b}")[style])
        if rng.random() < 0.05:
            out.append(rng.choice(WORDS[rng.choice(list(WORDS))]))
    return "\n".join(out)


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        names = rng.sample(list(WORDS), 2 if rng.random() < 0.25 else 1)
        out.append((i, text(rng, names), sorted(names)))
    return out


def test_held_out_accuracy(spark):
    train, held = corpus(150, 1), corpus(100, 2)
    docs = [(i, t, "python", f"src/m{i}.py", "x") for i, t, _ in train] + [(1000 + i, t, None, None, None) for i, t, _ in held]
    docs += [(5000, None, "c", "a", "b"), (5001, " \n", "c", "a", "b"), (5002, "12 34 ---", None, "LICENSE", "b"), docs[0]]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, path string, subject string")
    labels = [(i, s) for i, _, names in train for s in names] + [(1, None), (None, "law"), (3, "unknown"), (99999, "law")]
    lab = spark.createDataFrame(labels, "doc_id long, subject string")
    subs = spark.createDataFrame([(s, "") for s in WORDS], "subject string, description string")
    got: dict[int, list[str]] = {}
    for r in M.subjects_of(d, subs, lab).collect():
        got.setdefault(r.doc_id, []).append(r.subject)
    assert set(got) == {x[0] for x in docs if x[1] and x[1].strip()}
    assert all(1 <= len(v) <= 2 for v in got.values())
    right = sum(sorted(got[1000 + i]) == names for i, _, names in held)
    assert right >= 90
    assert M.subjects_of(d, subs, lab.limit(0)).count() == 0
    assert M.subjects_of(d.limit(0), subs, lab).count() == 0


def test_pieces_and_beginnings():
    docs = corpus(120, 4)
    names = sorted(WORDS)
    y = np.array([[float(s in labels) for s in names] for _, _, labels in docs])
    lex = M.Lexicon(names).fit(M.Corpus([M.runs(t) for _, t, _ in docs]), y)
    assert "".join(lex.pieces("savegenometablelarva")) == "savegenometablelarva"
    assert np.argmax(lex.of_word("savegenometablelarva")) == 0
    assert np.argmax(lex.of_run("saveReferee")) == 2
    assert np.argmax(lex.of_word("plaint")) == 1
    assert lex.of_word("zzzz") is None
    assert len(lex.pieces("genomelarva" * 2_000)) == 4_000  # words of any length


def test_beam_takes_one_or_two_and_each_classifier_has_its_weights():
    chain = M.Chain(3)
    rng = np.random.default_rng(0)
    e = np.zeros((80, 2, 3))
    y = np.zeros((80, 3))
    for i in range(80):
        y[i, i % 3] = 1
        if i % 4 == 0:
            y[i, (i + 1) % 3] = 1
        e[i, :, :] = y[i] * 20 + rng.random(3)
    none = np.zeros((80, 3, len(M.ORIGINS) + 2))
    x = M._design(e, np.ones((80, M.N_FORM)), none)
    out = chain.fit(x, y).calibrate(x, y).decode(x)
    assert (out == y).all(axis=1).mean() > 0.97
    assert set(out.sum(1)) <= {1.0, 2.0}
    assert chain.weights.shape == (3, x.shape[2] + 4) and not np.allclose(chain.weights[0], chain.weights[1])
    assert chain.a.shape == chain.b.shape == (3,)
    assert M._design(e[:0], np.ones((0, M.N_FORM)), none[:0]).shape[0] == 0


def test_origin_leaves_its_own_label_out():
    y = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 1.0]])
    places = [M.origin("s", "r1", "c", "lib/licence.txt"), M.origin("s", "r1", "c", "lib/b.c"), M.origin("s", "r2", None, None), M.origin("s", "r2", "c", "x.c")]
    o = M.Origins(places, y)
    assert o.features(places[0])[0, 1] > 0 > o.features(places[0])[1, 1]  # repo r1 has the first subject
    lone = M.Origins([M.origin(None, "only", None, "p")], np.array([[1.0, 0.0]]))
    assert np.allclose(lone.features(M.origin(None, "only", None, "p"), np.array([1.0, 0.0])), 0)
    assert np.allclose(o.features([("repo", "new")]), 0)
