"""Seeded synthetic sequences and reads for fixtures and benchmarks: small, made on the driver."""

from __future__ import annotations

import random
from collections.abc import Iterator

BASES = "ACGT"
#: Seed offset of each topology (fixed values).
OFFSETS = {"linear": 0, "bubble": 101, "deep": 202, "high_degree": 303, "random": 404}


def sequence(n: int, rng: random.Random) -> str:
    return "".join(rng.choice(BASES) for _ in range(n))


def mutate(seq: str, rate: float, rng: random.Random) -> str:
    """Each base replaced by another one at ``rate``."""
    return "".join(rng.choice(BASES.replace(b, "")) if rng.random() < rate else b for b in seq)


def topology(kind: str, k: int, n: int, length: int, seed: int) -> list[str]:
    """Sequences whose graph is a set of chains, bubbles, deep branches, high-degree repeats, or random."""
    rng = random.Random(seed + OFFSETS[kind])
    if kind in ("linear", "random"):
        return [sequence(length, rng) for _ in range(n)]
    if kind == "bubble":
        left, right = sequence(2 * k, rng), sequence(2 * k, rng)
        return [left + rng.choice(BASES) + sequence(k, rng) + right for _ in range(n)]
    if kind == "deep":
        anchors = [sequence(k, rng) for _ in range(n)]
        return ["".join(a + sequence(length + i + depth, rng) for depth, a in enumerate(anchors[: i + 1])) for i in range(n)]
    core = sequence(2 * k, rng)
    return [core.join(sequence(length + j, rng) for j in range(n + 1))]


def reads(seqs: list[str], n: int, length: int, seed: int, insert: int | None = None) -> Iterator[tuple[str, ...]]:
    """(id, seq) of single reads, or (id, seq, mate) with ``insert``: the mate is the reverse complement of the insert's end."""
    rng = random.Random(seed)
    span = insert or length
    usable = [s for s in seqs if len(s) >= span]
    if not usable:
        raise ValueError("no sequence is as long as a read")
    flip = str.maketrans("ACGT", "TGCA")
    for i in range(n):
        s = rng.choice(usable)
        at = rng.randrange(len(s) - span + 1)
        piece = s[at : at + span]
        yield (f"r{i}", piece[:length]) if insert is None else (f"r{i}", piece[:length], piece[-length:].translate(flip)[::-1])
