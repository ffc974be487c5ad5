"""Typed values mapped to the entries of a canonical list.

Method: one multi-pattern automaton over canonical names and aliases finds the names embedded in a value; the longest
non-overlapping mentions win. What it can't place goes to token-set similarity: the value's words and a name's words, in any
order and each within a few typing errors, are matched; the similarity is the matched words over all words of both, and a
single first letter stands for a word. A name whose words are all there counts before one that is only similar.

Each task resolves its distinct values once (with a memo per worker), so neither a shuffle nor a hot value costs anything. A
list of more than ``ENTRIES_AT_ONCE`` entries is taken in blocks: the distinct values meet every block, each block gives its
mentions and its most similar names, and what they say together decides as one list would.

What words mean besides names is the caller's: :class:`Markers` holds words for "no such entry named", words that begin a part
below an entry, and words around a name; without them every word counts. Where ``Markers.leaf_rank`` names a rank, a mention
of an entry of it wins over others, and a value that names something below another entry is not that entry.

Defined results: blank values and exact canonical names aren't asked for and give no row; values with no entry give the
word ``unmatched``; two entries equally close give ``unmatched``; repeated rows count once; very long values are read
whole; extra columns are ignored; an empty list leaves every value unmatched.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from collections import defaultdict
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.functions.session import materialise
from strandflow.functions.text import blank
from strandflow.operators.skew import lookup

UNMATCHED = "unmatched"
#: Entries of one automaton, some 100 MB with the index of its words.
ENTRIES_AT_ONCE = 200_000
MEMO = 200_000
#: Typing errors allowed in one word, at most a third of its letters or so, and in all words of a name.
WORD_ERRORS, NAME_ERRORS = 2, 3
#: Least share of matched words among the words of value and name together.
SIMILAR = 0.65


class Markers(NamedTuple):
    """Words with a meaning of their own, in lower case."""

    leaf_rank: str | None = None
    open_names: frozenset = frozenset()
    below: frozenset = frozenset()
    around: frozenset = frozenset()


_RANK = re.compile(r"^\s*[a-z]{1,2}__\s*", re.I)
_WORDS = re.compile(r"[^\W_]+")


def fold(value: str) -> str:
    """Lower case, without accents and percent escapes."""
    if "%" in value:
        value = unquote(value)
    flat = unicodedata.normalize("NFKD", value)
    return "".join(c for c in flat if not unicodedata.combining(c)).casefold()


def words(value: str) -> list[str]:
    return _WORDS.findall(value)


def last_member(value: str) -> str:
    """The last named member of a lineage, else the value; rank prefixes removed."""
    members = [_RANK.sub("", m) for m in re.split(r"[;|>\t]\s*|\s/\s", value)] if re.search(r"[;|>]", value) else [_RANK.sub("", value)]
    named = [m for m in members if words(m)]
    return named[-1] if named else ""


def errors(a: str, b: str, most: int) -> int:
    """Insertions, deletions, changes and swaps of neighbours between two words; ``most + 1`` if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    x, y = set(a), set(b)  # an error takes at most one letter away and adds at most one
    if len(x - y) > most or len(y - x) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def _deletions(word: str, n: int) -> set[str]:
    out = {word}
    for k in range(1, n + 1):
        if k < len(word):
            out |= {"".join(c) for c in combinations(word, len(word) - k)}
    return out


class Question(NamedTuple):
    """What a value asks: its words, those that name the entry, and whether it leaves the entry open."""

    parts: list[str]
    core: list[str]
    open_name: bool


def question(value: str, markers: Markers) -> Question:
    parts = words(last_member(fold(value)))
    core = []
    for w in parts:
        if w in markers.below and core:
            break
        if w not in markers.around and not (markers.leaf_rank and any(c.isdigit() for c in w)):
            core.append(w)
    at = next((i for i, w in enumerate(core) if i and w in markers.open_names), None)
    return Question(parts, core if at is None else core[:at], at is not None)


def longest(occurrences: list[tuple]) -> list[tuple]:
    """The longest non-overlapping of (start, end, ...), in order."""
    taken, used = [], set()
    for m in sorted(occurrences, key=lambda m: (m[0] - m[1], m[0])):
        if used.isdisjoint(range(m[0], m[1])):
            taken.append(m)
            used.update(range(m[0], m[1]))
    return sorted(taken)


def decide(asked: Question, occurrences: list[tuple], similar: list[tuple], markers: Markers) -> str:
    """Entry id of a value. ``occurrences``: (start, end, id, is of the leaf rank); ``similar``: (rank, id), the least is best."""
    if not asked.parts:
        return UNMATCHED
    found = longest(occurrences)
    leaf = markers.leaf_rank is not None
    for _, _, eid, is_leaf in sorted(found, key=lambda m: m[0] - m[1]):
        if is_leaf or not leaf:
            return eid
    if found and (asked.open_name or len(asked.core) <= 1):
        return found[-1][2]
    if not similar:
        return UNMATCHED
    best = min(s for s, _ in similar)
    ids = {eid for s, eid in similar if s == best}
    return ids.pop() if len(ids) == 1 else UNMATCHED


class Resolver:
    """Names -> entry ids. ``entries``: (id, name, rank, former names with | between)."""

    def __init__(self, entries: list[tuple], markers: Markers = Markers()):
        self.markers = markers
        #: words of a name -> (id, is of the leaf rank, order): canonical names before former ones, then the list's order
        self.ids: dict[tuple, tuple] = {}
        for former in (False, True):
            for place, (eid, name, rank, old) in enumerate(entries):
                for n in ((old or "").split("|") if former else [name or ""]):
                    key = tuple(words(fold(n)))
                    if key and key not in self.ids:
                        self.ids[key] = (eid, rank == markers.leaf_rank, (former, place))
        self.by_word: dict[str, set[tuple]] = defaultdict(set)
        self.by_initial: dict[tuple[str, str], set[tuple]] = defaultdict(set)
        for key in self.ids:
            for w in key:
                self.by_word[w].add(key)
            if len(key) > 1:
                for rest in key[1:]:
                    self.by_initial[key[0][0], rest].add(key)
        self.longest = max(map(len, self.by_word), default=0)
        self.memo: dict[str, dict[str, int]] = {}
        self.near: dict[str, list[str]] = defaultdict(list)
        for w in self.by_word:
            for d in _deletions(w, WORD_ERRORS):
                self.near[d].append(w)
        self.automaton = None
        if self.ids:
            self.automaton = ahocorasick.Automaton()
            for key in self.ids:
                self.automaton.add_word(f" {' '.join(key)} ", key)
            self.automaton.make_automaton()

    def occurrences(self, parts: list[str]) -> list[tuple[int, int, tuple]]:
        """(start, end, name) in words of all names embedded in ``parts``."""
        if self.automaton is None:
            return []
        index, at = {0: 0}, 0
        for i, p in enumerate(parts):
            at += len(p) + 1
            index[at] = i + 1
        return [(index[end - len(" ".join(key)) - 1], index[end], key) for end, key in self.automaton.iter(f" {' '.join(parts)} ")]

    def mentions(self, parts: list[str]) -> list[tuple[int, int, tuple]]:
        return longest(self.occurrences(parts))

    def close_words(self, word: str) -> dict[str, int]:
        """Known words within the allowed errors, which grow with the word's length."""
        if word not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = self._close_words(word)
        return self.memo[word]

    def _close_words(self, word: str) -> dict[str, int]:
        if len(word) > self.longest + WORD_ERRORS:
            return {}
        most = max(0, min(WORD_ERRORS, (len(word) - 2) // 2))
        seen: dict[str, int] = {}
        for d in _deletions(word, most):
            for w in self.near.get(d, ()):
                if w not in seen:
                    seen[w] = errors(word, w, most)
        return {w: n for w, n in seen.items() if n <= most}

    def similar(self, parts: list[str]) -> list[tuple[tuple, tuple]]:
        """((1 - similarity, errors), name) of the names that are most like the set of words ``parts``."""
        near = [self.close_words(w) for w in parts]
        scores: dict[tuple, tuple] = {}
        for key in {key for options in near for w in options for key in self.by_word[w]}:
            score = self._compare(key, parts, near)
            if score is not None:
                scores[key] = score
        if len(parts) == 2:  # a first letter for a word
            for first, rest in ((0, 1), (1, 0)):
                if len(parts[first]) == 1:
                    for w, n in near[rest].items():
                        for key in self.by_initial.get((parts[first], w), ()):
                            if len(key) == 2:
                                scores[key] = min((0.0, n), scores.get(key, (1.0, 0)))
        best = min(scores.values(), default=None)
        return [(s, key) for key, s in scores.items() if s == best]

    @staticmethod
    def _compare(key: tuple, parts: list[str], near: list[dict[str, int]]) -> tuple | None:
        """(1 - similarity, errors) of the name's words and the value's, each taking the closest that is left."""
        free, total, matched = set(range(len(parts))), 0, 0
        whole = len(key) == len(parts)
        for w in key:
            if whole:  # all words of both have a partner; one that isn't close may still be within the name's errors
                costs = {i: near[i][w] if w in near[i] else errors(parts[i], w, NAME_ERRORS) for i in free}
            else:
                costs = {i: near[i][w] for i in free if w in near[i]}
            if costs:
                at = min(costs, key=lambda i: (costs[i], i))
                total += costs[at]
                matched += 1
                free.remove(at)
        score = matched / (len(key) + len(parts) - matched)
        return (1 - score, total) if total <= NAME_ERRORS and score >= SIMILAR else None

    def evidence(self, asked: Question) -> tuple[list[tuple], list[tuple]]:
        """What this list says about a value: (start, end, id, is leaf, order) of the mentions, (rank, id) of similar names."""
        found = [(i, j, *self.ids[key]) for i, j, key in self.occurrences(asked.parts)]
        settled = decide(asked, [m[:4] for m in found], [], self.markers) != UNMATCHED
        close = [] if settled or not asked.core else [(s, self.ids[key][0]) for s, key in self.similar(asked.core)]
        return found, close

    def resolve(self, value: str) -> str:
        asked = question(value, self.markers)
        found, close = self.evidence(asked)
        return decide(asked, [m[:4] for m in found], close, self.markers)


@lru_cache(maxsize=1)
def _kept(uid: str) -> dict:
    """What a worker process keeps from task to task for one list."""
    return {}


def _resolver(uid: str, shared, markers: Markers) -> dict:
    kept = _kept(uid)
    if not kept:
        kept.update(resolver=Resolver(shared.value, markers), exact={r[1] for r in shared.value}, memo={})
    return kept


def map_values(
    df: DataFrame, entries: DataFrame, value: str, keep: list[str], id_name: str = "taxid", markers: Markers = Markers(), at_once: int = ENTRIES_AT_ONCE
) -> DataFrame:
    """``keep`` columns and the entry id of every row whose value is neither blank nor exactly an entry's name."""
    listed = entries.select("taxid", "tax_name", "tax_rank", "former_names")
    asked = df.where(~blank(F.col(value))).select(F.col(value).alias("_value"), *keep)
    rows = listed.limit(at_once + 1).collect()
    if len(rows) > at_once:
        return _map_in_blocks(asked, listed, keep, id_name, markers, at_once)
    shared, uid = df.sparkSession.sparkContext.broadcast([tuple(r) for r in rows]), uuid.uuid4().hex
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{id_name}` string"])

    def run(batches):
        kept = _resolver(uid, shared, markers)
        exact, resolver, memo = kept["exact"], kept["resolver"], kept["memo"]
        for batch in batches:
            coded = pc.dictionary_encode(batch.column(0)) if batch.num_rows else None
            if coded is None:
                continue
            ids = []
            for v in coded.dictionary.to_pylist():
                if v in exact:
                    ids.append(None)
                    continue
                if v not in memo:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[v] = resolver.resolve(v)
                ids.append(memo[v])
            out = pa.array(ids, pa.string()).take(coded.indices)
            wanted = pc.is_valid(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i + 1).filter(wanted) for i in range(len(keep))] + [out.filter(wanted)], names=[*keep, id_name]
            )

    return asked.mapInArrow(run, schema).distinct()


def _map_in_blocks(asked: DataFrame, listed: DataFrame, keep: list[str], id_name: str, markers: Markers, at_once: int) -> DataFrame:
    """:func:`map_values` for lists beyond one automaton: distinct values meet the list block by block."""
    spark = asked.sparkSession
    names = listed.select(F.col("tax_name").alias("_value")).distinct()
    asked = materialise(asked.join(names, "_value", "left_anti"), "canonical-asked")
    values = materialise(asked.select("_value").distinct(), "canonical-values")
    blocks = -(-listed.count() // at_once) + 1
    held = materialise(listed.withColumn("_block", F.pmod(F.xxhash64("taxid", "tax_name"), F.lit(blocks))), "canonical-list")
    said = None
    for k in range(blocks):
        rows = [tuple(r) for r in held.where(F.col("_block") == k).drop("_block").orderBy("taxid", "tax_name").collect()]
        shared, uid = spark.sparkContext.broadcast(rows), uuid.uuid4().hex

        def run(batches, shared=shared, uid=uid):
            resolver = _resolver(uid, shared, markers)["resolver"]
            for batch in batches:
                texts = batch.column(0).to_pylist()
                said = [json.dumps(resolver.evidence(question(v, markers))) for v in texts]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(said, pa.string())], names=["_value", "_said"])

        part = materialise(values.mapInArrow(run, "_value string, _said string"), "canonical-said")
        said = part if said is None else said.unionByName(part)

    def settle(batches):
        for batch in batches:
            texts, ids = batch.column(0).to_pylist(), []
            for v, parts in zip(texts, batch.column(1).to_pylist()):
                mentions: dict[tuple, tuple] = {}
                close = []
                for found, near in map(json.loads, parts):
                    for i, j, eid, leaf, order in found:  # one name in several blocks: the canonical before the former, then by id
                        mentions[i, j] = min(mentions.get((i, j), ([True, 1 << 60], "", eid, leaf)), ([order[0], 0], eid, eid, leaf))
                    close += [(tuple(s), eid) for s, eid in near]
                ids.append(decide(question(v, markers), [(i, j, m[2], m[3]) for (i, j), m in mentions.items()], close, markers))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(ids, pa.string())], names=["_value", id_name])

    each = said.groupBy("_value").agg(F.collect_list("_said").alias("_said"))  # one entry per block
    resolved = materialise(each.mapInArrow(settle, f"_value string, `{id_name}` string"), "canonical-resolved")
    return lookup(asked, "_value", resolved).select(*keep, id_name).distinct()
