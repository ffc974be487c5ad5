"""Subject areas of documents by classifier chains.

Method. A chain of logistic classifiers, one per subject, each with weights of its own, reads of a document

- term features: each term has a subject profile, the shares of its occurrences over the subjects of labelled documents (terms
  of documents of two subjects divided by the profiles of the round before); a document's evidence for a subject is the sum of
  its terms' profiles, and the classifier sees it against the evidence for the others;
- source features: how often the labelled documents of its ``source``, ``repo`` and ``lang`` and with the words of its ``path``
  have the subject, against all labelled documents;
- structure features: length, line length and number of words;
- the chain before it: how many subjects were given, and how often those occur together with this one.

A classifier's weights are those that serve all subjects plus its own, which are drawn towards 0, so that a subject with few
labels has a classifier as well. Each one's probabilities are calibrated on labelled documents held out from the fit, and a
beam search over the chain finds the most probable combination of one or two subjects. All of a document's features come from
profiles that haven't seen its label. The fit is one task on an executor; the driver passes the model on.

Terms are whole words of the text, split at case changes and digits; a word written together from known terms counts as
those, and a cut-off word as the terms it begins, if they are all of one profile.

Defined results: a document whose text is null, empty or white space gets no row; every other gets one or two subjects,
also without any known term (then by its source and form); labels outside the list of subjects or of unknown documents
are ignored; without any label the result is empty; texts are read whole; repeated rows count once; extra columns are
ignored.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions.session import materialise
from strandflow.functions.text import blank

#: At most so many labelled documents are used for the fit, the first by a hash of their id.
MAX_LABELLED = 12_000
#: Parts of the labelled documents; each is described by profiles of the others.
FOLDS = 4
BEAM = 6
#: A label whose probability is this far off counts as an error of the labelling.
DOUBT = 0.93
KNOTS = (0.1, 0.15, 0.2, 0.25, 0.3, 0.35)
#: A term counts as a whole word if so many labelled documents have it.
WHOLE_WORD = 3
#: Weight of the shares of all documents beside those of one source, repository, language or path word.
PRIOR = 5.0
#: How strongly weights are drawn to 0, in documents: those that serve all subjects, and each subject's own.
SHARED_PRIOR, OWN_PRIOR = 3.0, 20.0
MEMO = 300_000

_RUNS = re.compile(r"[^\W\d_]+")
_CASES = re.compile(r"[^\W\d_a-zß-öø-ÿ]?[a-zß-öø-ÿ]+|[^\W\d_a-zß-öø-ÿ]+(?![a-zß-öø-ÿ])|[^\W\d_]+")


def runs(text: str) -> Counter:
    """Letter runs of a text and how often each occurs."""
    return Counter(_RUNS.findall(text))


def terms(run: str) -> list[str]:
    """Lower-case words of a letter run, split at case changes."""
    if run.islower():
        return [run]
    return [w.lower() for w in _CASES.findall(run)]


N_FORM = 4


def form(text: str, n_runs: int) -> list[float]:
    """Structure features."""
    lines = text.count("\n") + 1
    return [1.0, np.log1p(len(text)), np.log1p(len(text) / lines), np.log1p(n_runs)]


#: Kinds of origin: the source, the repository, the language and the words of the path.
ORIGINS = ("source", "repo", "lang", "folder", "name")


def origin(source: str | None, repo: str | None, lang: str | None, path: str | None) -> list[tuple[str, str]]:
    """(kind, value) of where a document comes from; a missing value is a value."""
    out = [("source", source or ""), ("repo", repo or ""), ("lang", lang or "")]
    folders, _, name = (path or "").rpartition("/")
    out += [("folder", w) for w in sorted({t for r in _RUNS.findall(folders) for t in terms(r)})]
    return out + [("name", w) for w in sorted({t for r in _RUNS.findall(name) for t in terms(r)}) or [""]]


class Origins:
    """How often labelled documents of an origin have each subject, as log ratios to all labelled documents."""

    def __init__(self, docs: list[list[tuple[str, str]]], y: np.ndarray):
        self.n = y.shape[1]
        self.whole, self.mass = y.sum(0), float(max(len(docs), 1))
        self.seen: dict[tuple, np.ndarray] = {}
        self.ratios: dict[tuple, np.ndarray | None] = {}  # of values without a label to leave out
        for values, row in zip(docs, y):
            for v in values:
                if v not in self.seen:
                    self.seen[v] = np.zeros(self.n + 1)
                self.seen[v][:-1] += row
                self.seen[v][-1] += 1

    def features(self, values: list[tuple[str, str]], own: np.ndarray | None = None) -> np.ndarray:
        """(subjects, kinds): the mean and, for words, the furthest ratio of each kind. ``own``: labels to leave out again."""
        per: dict[str, list] = {}
        for v in values:
            if own is None:
                if v not in self.ratios:
                    if len(self.ratios) >= MEMO:
                        self.ratios.clear()
                    self.ratios[v] = self._ratio(v, None)
                got = self.ratios[v]
            else:
                got = self._ratio(v, own)
            if got is not None:
                per.setdefault(v[0], []).append(got)
        out = np.zeros((self.n, len(ORIGINS) + 2))
        for k, kind in enumerate(ORIGINS):
            if kind in per:
                found = per[kind]
                out[:, k] = found[0] if len(found) == 1 else np.mean(found, axis=0)
                if kind in ("folder", "name"):
                    out[:, k + 2] = found[0] if len(found) == 1 else np.max(found, axis=0)
        return out

    def _ratio(self, v: tuple[str, str], own: np.ndarray | None) -> np.ndarray | None:
        got = self.seen.get(v)
        if got is None:
            return None
        n, total, whole = got[:-1], got[-1], self.whole
        if own is not None:
            n, total, whole = n - own, total - 1, whole - own
        base = (whole + 0.5) / (self.mass + 5)
        return np.log((n + PRIOR * base) / ((total + PRIOR) * base))


class Corpus:
    """Terms of labelled documents as flat arrays: document, term, damped occurrences."""

    def __init__(self, docs: list[Counter]):
        index: dict[str, int] = {}
        parts: dict[str, list[int]] = {}
        doc, term, n = [], [], []
        for i, counted in enumerate(docs):
            tf: Counter = Counter()
            for r, c in counted.items():
                if r not in parts:
                    parts[r] = [index.setdefault(t, len(index)) for t in terms(r)]
                for t in parts[r]:
                    tf[t] += c
            doc.append(np.full(len(tf), i))
            term.append(np.fromiter(tf.keys(), np.int64, len(tf)))
            n.append(np.fromiter(tf.values(), float, len(tf)))
        none = [np.empty(0, np.int64)]
        self.words = list(index)
        self.doc, self.term = np.concatenate(doc or none).astype(np.int64), np.concatenate(term or none)
        # repetition within a document counts less, so that one long file doesn't make a profile
        self.n = np.sqrt(np.concatenate(n or [np.empty(0)]))


class Lexicon:
    """Subject profiles of terms."""

    def __init__(self, subjects: list[str]):
        self.subjects = subjects
        self.profile: dict[str, np.ndarray] = {}
        self.starts: dict[str, list[str]] = {}
        self.whole: set[str] = set()

    def fit(self, corpus: Corpus, y: np.ndarray, inside: np.ndarray | None = None, rounds: int = 3) -> Lexicon:
        """``y``: labels (documents, subjects); ``inside``: which documents count."""
        n, size = y.shape[1], len(corpus.words)
        rows = np.ones(len(y), bool) if inside is None else inside
        ok = rows[corpus.doc]
        doc, term, v = corpus.doc[ok], corpus.term[ok], corpus.n[ok]
        seen = np.bincount(term, minlength=size)
        dealt = y / np.maximum(y.sum(1, keepdims=True), 1)
        mass = dealt[rows].sum(0)
        strength = np.zeros((size, n))
        for k in range(rounds):
            counts = np.zeros((size, n))
            for lo in range(0, len(doc), 500_000):
                d, t, w = doc[lo : lo + 500_000], term[lo : lo + 500_000], v[lo : lo + 500_000, None]
                part = dealt[d] if k == 0 else (strength[t] + 0.05) * y[d]
                part = part / np.maximum(part.sum(1, keepdims=True), 1e-12) * w
                for s in range(n):
                    counts[:, s] += np.bincount(t, weights=part[:, s], minlength=size)
            counts[seen < 2] = 0
            # share of each subject against what its documents would give any word
            rate = counts / np.maximum(mass, 1)
            share = (rate + 0.002) / (rate + 0.002).sum(1, keepdims=True)
            support = counts.sum(1)
            strength = np.clip(share - 1.6 / n, 0, None) * (support / (support + 2))[:, None]
            strength[strength.max(1) < 0.12] = 0
        # profiles sum to at most 1; words of no subject are common words
        total = strength.sum(1)
        scaled = (strength / np.maximum(total, 1e-9)[:, None] * np.minimum(1.0, total * 1.5)[:, None]).astype(np.float32)
        starts: dict[str, list[str]] = defaultdict(list)
        for i in np.flatnonzero(seen >= 2):
            w = corpus.words[i]
            if total[i] > 0:
                self.profile[w] = scaled[i]
            if seen[i] >= WHOLE_WORD:
                self.whole.add(w)
                if total[i] > 0:
                    for k in range(4, len(w)):
                        starts[w[:k]].append(w)
        self.starts = dict(starts)
        self.longest = max(map(len, self.whole), default=0)
        return self

    def pieces(self, word: str) -> list[str] | None:
        """The known words of three letters or more that ``word`` is written together from, the fewest; None if it isn't."""
        size = len(word)
        least: list[int | None] = [0] + [None] * size
        begun = [0] * (size + 1)
        for end in range(3, size + 1):
            for begin in range(max(0, end - self.longest), end - 2):
                k = least[begin]
                if k is not None and (least[end] is None or k + 1 < least[end]) and word[begin:end] in self.whole:
                    least[end], begun[end] = k + 1, begin
        if least[size] is None:
            return None
        out = []
        while size:
            out.append(word[begun[size] : size])
            size = begun[size]
        return out[::-1]

    def of_word(self, word: str) -> np.ndarray | None:
        if word in self.whole:
            return self.profile.get(word)
        parts = self.pieces(word)
        if parts:
            found = [self.profile[p] for p in parts if p in self.profile]
            return np.sum(found, axis=0) if found else None
        if word in self.profile:
            return self.profile[word]
        begun = self.starts.get(word)
        if begun:
            return np.mean([self.profile[w] for w in begun], axis=0)
        # a known word with a part of another one behind it
        for k in range(len(word) - 1, 4, -1):
            if word[:k] in self.profile and word[:k] in self.whole:
                return self.profile[word[:k]]
        return None

    def of_run(self, run: str) -> np.ndarray:
        out = np.zeros(len(self.subjects), np.float32)
        for w in terms(run):
            p = self.of_word(w)
            if p is not None:
                out += p
        return out


class Reader:
    """Evidence of texts under a lexicon, with a memo of letter runs."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, len(lexicon.subjects)), np.float32)

    def evidence(self, counted: Counter) -> np.ndarray:
        """(occurrences, damped occurrences) per subject."""
        if len(self.index) > MEMO:
            self.index.clear()
        index = self.index
        ids = []
        for r in counted:
            i = index.get(r)
            if i is None:
                i = index[r] = len(index)
                if i >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[i] = self.lexicon.of_run(r)
            ids.append(i)
        if not ids:
            z = np.zeros(len(self.lexicon.subjects))
            return np.stack([z, z])
        n = np.fromiter(counted.values(), np.float32, len(counted))
        rows = self.table[ids]
        return np.stack([n @ rows, np.sqrt(n) @ rows])


def _design(evidence: np.ndarray, forms: np.ndarray, origins: np.ndarray) -> np.ndarray:
    """Features of every (document, subject): evidence of the subject against the others', then source and structure."""
    d, _, n = evidence.shape
    blocks = []
    for k in range(2):
        e = evidence[:, k, :]
        total = e.sum(1, keepdims=True)
        share = e / np.maximum(total, 1e-6)
        order = np.sort(share, axis=1)[:, ::-1]
        top, second = order[:, :1], order[:, 1:2] if n > 1 else order[:, :1] * 0
        third = order[:, 2:3] if n > 2 else order[:, :1] * 0
        blocks += [share, share**2, np.log1p(e), share / np.maximum(top, 1e-6), np.broadcast_to(top, share.shape), np.where(share >= top, top - second, 0), np.where(share >= top, 0, share - third), (share >= top) * (total > 0), ((share >= second) & (share < top)) * 1.0]
        if k == 0:  # the response to a share need not be a straight line
            blocks += [np.clip(share - knot, 0, 0.05) for knot in KNOTS]
    x = np.stack(blocks, axis=2)
    return np.concatenate([x, origins, np.broadcast_to(forms[:, None, :], (d, n, forms.shape[1]))], axis=2)


class Chain:
    """Logistic classifiers in a chain, each with its own weights and calibration."""

    def __init__(self, n_subjects: int):
        self.n = n_subjects

    def _chain_features(self, before: np.ndarray, s: int) -> np.ndarray:
        """before: decisions (docs, s) -> number decided so far (one, two or more) and log odds of meeting them."""
        k = before.sum(1)
        seen = before @ self.together[:s, s] if s else np.zeros(len(before))
        return np.stack([k >= 1, k >= 2, seen, np.full(len(before), (self.n - s) / self.n) * (k == 0)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400) -> Chain:
        d, n, _ = x.shape
        joint = y.T @ y
        alone = np.diag(joint)
        self.together = np.log((joint + 0.5) / (np.outer(alone, alone) / max(d, 1) + 0.5)) * (1 - np.eye(n))
        chain = np.stack([self._chain_features(y[:, :s], s) for s in range(n)], axis=1)
        full = np.concatenate([x, chain], axis=2)
        self.mean, self.scale = full.reshape(-1, full.shape[2]).mean(0), full.reshape(-1, full.shape[2]).std(0) + 1e-6
        z = np.ascontiguousarray(((full - self.mean) / self.scale).transpose(1, 0, 2), np.float32)  # (subjects, documents, features)
        w, own = np.zeros(z.shape[2], np.float32), np.zeros((n, z.shape[2] + 1), np.float32)  # own: intercept first
        m = [np.zeros_like(w), np.zeros_like(own)]
        v = [np.zeros_like(w), np.zeros_like(own)]
        t_y = y.T.astype(np.float32)
        pull = np.full(own.shape[1], OWN_PRIOR / d, np.float32)
        pull[0] = SHARED_PRIOR / d
        for t in range(1, steps + 1):  # Adam on the penalised likelihood
            logits = np.stack([z[s] @ (w + own[s, 1:]) + own[s, 0] for s in range(n)])
            g = (1 / (1 + np.exp(-np.clip(logits, -30, 30))) - t_y) / d
            per = np.stack([np.r_[g[s].sum(), g[s] @ z[s]] for s in range(n)])
            grads = [per[:, 1:].sum(0) + SHARED_PRIOR / d * w, per + pull * own]
            for k, (par, gr) in enumerate(zip((w, own), grads)):
                m[k] = 0.9 * m[k] + 0.1 * gr
                v[k] = 0.99 * v[k] + 0.01 * gr * gr
                par -= 0.05 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        self.weights, self.intercepts = (w + own[:, 1:]).astype(float), own[:, 0].astype(float)
        self.a, self.b = np.ones(n), np.zeros(n)
        return self

    def _logit(self, x: np.ndarray, before: np.ndarray, s: int) -> np.ndarray:
        f = np.concatenate([x[:, s, :], self._chain_features(before, s)], axis=1)
        return self.a[s] * (((f - self.mean) / self.scale) @ self.weights[s] + self.intercepts[s]) + self.b[s]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Chain:
        """Slope and intercept of each classifier's logits on held-out documents, drawn towards 1 and 0."""
        for s in range(self.n):
            z, t, a, b = self._logit(x, y[:, :s], s), y[:, s], 1.0, 0.0
            ridge = 5.0 / max(len(t), 1)
            for _ in range(50):  # Newton with a little damping
                p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
                r, h = p - t, p * (1 - p) + 1e-6
                g = np.array([(r * z).mean() + ridge * (a - 1), r.mean() + ridge * b])
                hess = np.array([[(h * z * z).mean() + ridge, (h * z).mean()], [(h * z).mean(), h.mean() + ridge]])
                step = np.linalg.solve(hess, g)
                a, b = a - step[0], b - step[1]
                if abs(step).max() < 1e-6:
                    break
            if a > 0.05:
                self.a[s], self.b[s] = a, b
        return self

    def decode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """The most probable combination of one or two subjects of each document."""
        d = len(x)
        states = np.zeros((d, 1, self.n))
        score = np.zeros((d, 1))
        for s in range(self.n):
            k = states.shape[1]
            z = np.stack([self._logit(x, states[:, i, :s], s) for i in range(k)], axis=1)
            yes, no = score - np.logaddexp(0, -z), score - np.logaddexp(0, z)
            count = states.sum(2)
            yes = np.where(count >= 2, -np.inf, yes)
            if s == self.n - 1:
                no = np.where(count == 0, -np.inf, no)
            both = np.concatenate([no, yes], axis=1)
            grown = np.concatenate([states, states], axis=1)
            grown[:, k:, s] = 1
            if both.shape[1] > beam:
                # the empty combination always stays: a later subject may be the only one
                empty = (grown.sum(2) == 0) & np.isfinite(both)
                top = np.argsort(-np.where(empty, np.inf, both), axis=1, kind="stable")[:, :beam]
                both, grown = np.take_along_axis(both, top, 1), np.take_along_axis(grown, top[:, :, None], 1)
            states, score = grown, both
        return np.take_along_axis(states, score.argmax(1)[:, None, None], 1)[:, 0, :]


class Model:
    """Lexicon, origins and chain."""

    def __init__(self, subjects: list[str]):
        self.subjects = subjects
        self.uid = uuid.uuid4().hex

    def fit(self, docs: list[tuple[Counter, list[int], list[float], list[tuple[str, str]]]]) -> Model:
        """docs: (letter runs, labels, form, origin). Labels that a first fit finds all but impossible are left out of a second."""
        doubt = self._fit(docs)
        sure = [d for d, x in zip(docs, doubt) if x < DOUBT]
        if len(docs) / 2 < len(sure) < len(docs):
            self._fit(sure)
        return self

    def _fit(self, docs: list[tuple]) -> np.ndarray:
        """Fit on evidence from lexicons that haven't seen the document; returns each document's worst contradiction."""
        n, part = len(self.subjects), np.arange(len(docs)) % FOLDS
        y = np.zeros((len(docs), n))
        for i, d in enumerate(docs):
            y[i, d[1]] = 1
        corpus = Corpus([d[0] for d in docs])
        evidence = np.zeros((len(docs), 2, n))
        for k in range(FOLDS):
            reader = Reader(Lexicon(self.subjects).fit(corpus, y, part != k))
            for i in np.flatnonzero(part == k):
                evidence[i] = reader.evidence(docs[i][0])
        self.lexicon = Lexicon(self.subjects).fit(corpus, y)
        self.origins = Origins([d[3] for d in docs], y)
        origins = np.stack([self.origins.features(d[3], row) for d, row in zip(docs, y)])
        x = _design(evidence, np.array([d[2] for d in docs], float).reshape(len(docs), N_FORM), origins)
        held = np.arange(len(docs)) % 5 == 4
        self.chain = Chain(n).fit(x[~held], y[~held])
        if held.any():
            self.chain.calibrate(x[held], y[held])
        p = np.stack([1 / (1 + np.exp(-np.clip(self.chain._logit(x, y[:, :s], s), -30, 30))) for s in range(n)], axis=1)
        return np.abs(y - p).max(1)

    def reader(self) -> Reader:
        return Reader(self.lexicon)

    def predict(self, evidence: np.ndarray, forms: np.ndarray, origins: np.ndarray) -> np.ndarray:
        return self.chain.decode(_design(evidence, forms, origins))


_FROM = ["doc_id", "text", "source", "repo", "lang", "path"]


def train(documents: DataFrame, subjects: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model | None:
    """Fit on at most ``most`` labelled documents; None without any."""
    names = sorted({r[0] for r in subjects.where("subject is not null").select("subject").distinct().collect()})
    at = {s: i for i, s in enumerate(names)}
    wanted = (
        labels.where(F.col("subject").isin(names) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_set("subject")).alias("subjects"))  # at most one entry per subject
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    counted = (
        _columns(documents)
        .join(F.broadcast(wanted), "doc_id")
        .mapInArrow(_count_runs, "doc_id bigint, subjects array<string>, runs array<string>, counts array<int>, form array<double>, origin array<struct<kind:string,value:string>>")
    )

    def fit(batches):
        one: dict[str, str] = {}
        docs = []
        for b in batches:
            for r in b.to_pylist():
                tally = Counter({one.setdefault(w, w): n for w, n in zip(r["runs"], r["counts"])})
                docs.append((r["doc_id"], (tally, [at[s] for s in r["subjects"]], r["form"], [(o["kind"], o["value"]) for o in r["origin"]])))
        docs = [d for _, d in sorted(docs, key=lambda d: (d[0] * 2654435761 % 2**32, d[0]))]
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Model(names).fit(docs))], pa.binary())], names=["model"])

    # at most ``most`` rows, so one task
    found = materialise(counted, "subjects-labelled").coalesce(1).mapInArrow(fit, "model binary").collect() if names else []
    return pickle.loads(found[0][0]) if found else None


def _columns(documents: DataFrame) -> DataFrame:
    """The columns that are read; one that is missing is null."""
    there = set(documents.columns)
    return documents.where(~blank(F.col("text"))).select(*[F.col(c) if c in there else F.lit(None).cast("string").alias(c) for c in _FROM])


def _count_runs(batches):
    for b in batches:
        out = []
        for i, t, src, repo, lang, path, s in zip(*(b.column(k).to_pylist() for k in (*_FROM, "subjects"))):
            c = runs(t)
            out.append((i, s, list(c), list(c.values()), form(t, len(c)), [{"kind": k, "value": v} for k, v in origin(src, repo, lang, path)]))
        if out:
            cols = list(zip(*out))
            types = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "subjects", "runs", "counts", "form", "origin"])


@lru_cache(maxsize=1)
def _kept(uid: str) -> dict:
    """What a worker process keeps from task to task for one model."""
    return {}


def assign(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, subject), one or two rows for each document with content."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows_at_once = 2_000

    def run(batches):
        m = shared.value
        kept = _kept(m.uid)
        if not kept:
            kept["reader"] = m.reader()
        reader = kept["reader"]
        for batch in batches:
            for begin in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(begin, rows_at_once)
                size, n = part.num_rows, len(m.subjects)
                evidence, forms, origins = np.zeros((size, 2, n)), np.zeros((size, N_FORM)), np.zeros((size, n, len(ORIGINS) + 2))
                for i, (t, *where) in enumerate(zip(*(part.column(k).to_pylist() for k in _FROM[1:]))):
                    c = runs(t)
                    evidence[i], forms[i], origins[i] = reader.evidence(c), form(t, len(c)), m.origins.features(origin(*where))
                doc, sub = np.nonzero(m.predict(evidence, forms, origins))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array([m.subjects[s] for s in sub], pa.string())], names=["doc_id", "subject"])

    return _columns(documents).mapInArrow(run, "doc_id bigint, subject string").distinct()


def subjects_of(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled documents and assign subjects to all."""
    model = train(documents, subjects, labels)
    if model is None:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, subject string")
    return assign(documents, model)
