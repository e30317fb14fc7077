"""Mixing against a plain version."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from triptych.llm import mixing


def plain_targets(sizes, weights=(1, 2, 3), epochs=3):
    """Shares by weight, cut at the limit, the excess dealt again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, free = float(sum(sizes.values())), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= epochs * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        target |= {s: float(epochs * sizes[s]) for s in full}
        left -= sum(epochs * sizes[s] for s in full)
        free -= full
    return target


def plain_mix(rows, seed=42):
    sized = [(key, source, len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), text) for key, text, _, source in rows]
    total: dict = {}
    for _, source, size, _ in sized:
        total[source] = total.get(source, 0) + size
    target = plain_targets(total)
    spot = lambda key: hashlib.md5(f"{seed}{'' if key is None else f':{key}'}".encode()).hexdigest()
    out = []
    for name in total:
        before, budget = 0, int(target[name] + 0.5)
        full, rest = divmod(budget, total[name]) if total[name] else (0, 0)
        mine = [r for r in sized if r[1] == name]
        for key, _, size, text in sorted(mine, key=lambda r: (spot(r[0]), r[0] is None, r[0], r[2])):
            out.append((key, size, total[name], round(target[name], 6), full * size + min(max(rest - before, 0), size), text))
            before += size
    return out


def rows_of(seed):
    rng = random.Random(seed)
    names = ["a", "B", "é", "", None, "zz", "big", "tiny"]
    rows = [(i, " ".join("w" * rng.randrange(1, 3) for _ in range(rng.randrange(30))), "en", rng.choice(names[:seed + 3] + ["big"] * 6))
            for i in range(300)]
    return rows + [(400, "only", "en", "tiny"), (401, None, "en", "blank"), (None, "a b", "en", "a"), (402, " \n", "en", None)]


@pytest.mark.parametrize("seed", range(5))
def test_mix(make_docs, seed):
    rows = rows_of(seed)
    docs = make_docs(rows)
    mixed = mixing.mix(docs, range_rows=20)
    got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixed.collect()]
    want = plain_mix(rows)
    order = lambda r: tuple(map(str, r))
    assert sorted(got, key=order) == sorted((r[:5] for r in want), key=order)
    assert all(0 <= r[4] <= 3 * r[1] for r in got)
    again = mixing.mix(docs.repartition(7), range_rows=1000)
    assert sorted(got, key=order) == sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in again.collect()), key=order)
    taken = mixing.take(docs, mixed)
    assert taken.columns == docs.columns
    found = sorted(((r.doc_id, r.text, r.n_chars) for r in taken.collect()), key=order)
    copies = []
    for key, size, _, _, words, text in want:
        copies += [(key, text, len(text))] * (words // size) if size else []
        if size and words % size:
            cut = " ".join(text.split()[:words % size])
            copies.append((key, cut, len(cut)))
    assert found == sorted(copies, key=order)


def test_repeated_rows_and_empty_tables(make_docs):
    rows = [(1, "a b c", "en", "s")] * 4 + [(1, "d e", "en", "s"), (2, "f g h i", "en", "t")]
    docs = make_docs(rows)
    mixed = mixing.mix(docs)
    taken = mixing.take(docs, mixed)
    assert sum(r.taken for r in mixed.collect()) == sum(len(r.text.split()) for r in taken.collect())
    assert mixed.count() == len(rows)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.take(docs.limit(0), mixing.mix(docs.limit(0))).count() == 0
