"""Texts that repeat a word or a few: bounded memory, and nothing lost."""

import itertools
import random
import subprocess
import sys
from pathlib import Path

import pytest

from riskloom.llm import decontaminate

PROBE = """
import resource, sys, time
sys.path.insert(0, {root!r})
from riskloom.llm.decontaminate import Index, overlaps
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
item, text = [(" ".join(w) for w in {words}) for _ in range(1)][0]
got = list(overlaps([text.encode()], Index([(1, item.encode())])))
print(len(got), max(x[-1] for x in got), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base) // 1024)
"""


@pytest.mark.parametrize("words", ["(['a'] * 5000, ['a'] * 20000)", "(['a', 'b'] * 2500, ['a', 'b'] * 10000)"])
def test_memory_of_repeated_words(words):
    done = subprocess.run([sys.executable, "-c", PROBE.format(root=str(Path(__file__).parents[2]), words=words)], capture_output=True, text=True, timeout=300, check=True)
    found, longest, megabytes = map(int, done.stdout.split())
    assert found > 1000 and longest == 5000 and megabytes < 300


def brute(texts, items):
    out = set()
    for (t, text), (i, item) in itertools.product(enumerate(texts), enumerate(items)):
        a, b = text.split(), item.split()
        for shift in range(1 - len(b), len(a)):
            low, high = max(0, -shift), min(len(b), len(a) - shift)
            equal = [b[k] == a[k + shift] for k in range(low, high)]
            n = len(equal)
            good = any(sum(equal[x:y]) >= min(13, len(b)) and 5 * sum(equal[x:y]) >= 4 * (y - x) for x in range(n) for y in range(x + 1, n + 1)) if sum(equal) >= min(13, len(b)) else False
            if good:
                out.add((t, i, shift))
    return out


@pytest.mark.parametrize("at_once", [3, 1 << 20])
def test_every_diagonal_of_repeats(monkeypatch, at_once):
    monkeypatch.setattr(decontaminate, "HITS_AT_ONCE", at_once)
    rng = random.Random(6)
    vocabulary = ["a", "b", "c"]
    items = [" ".join(rng.choice(vocabulary[:k]) for _ in range(n)) for k, n in ((1, 20), (2, 25), (1, 4), (3, 16))]
    texts = [" ".join(rng.choice(vocabulary[:k]) for _ in range(n)) for k, n in ((1, 30), (2, 40), (3, 35), (1, 3), (2, 0))] + [items[3] + " x y " + items[1]]
    index = decontaminate.Index([(i, x.encode()) for i, x in enumerate(items)])
    got = set()
    _, bounds = decontaminate.words_of([t.encode() for t in texts])
    for t, i, begin, item_begin, _, _ in decontaminate.overlaps([t.encode() for t in texts], index):
        got.add((t, i, begin - item_begin))
    assert got == brute(texts, items)


