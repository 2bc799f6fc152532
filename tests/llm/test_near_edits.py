import random

import numpy as np
import pytest

from sundew.llm import leak as L
from sundew.llm import queries as Q
from sundew.llm.words import Coder, flat

KINDS = {"changed": "ss", "missing": "dd", "added": "ii", "changed and missing": "sd", "changed and added": "si", "missing and added": "di"}


def edited(words, kinds, r):
    """Two edits at different words, none of them before the first or behind the last."""
    out = list(words)
    for at, kind in sorted(zip(r.sample(range(1, len(words) - 1), len(kinds)), kinds), reverse=True):
        out[at : at + (kind != "i")] = [] if kind == "d" else [f"new{r.randrange(10**9)}"]
    return out


def found(kinds, repetitions, samples, n=400, seed=11):
    r = random.Random(seed)
    say = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
    items = [say(16) for _ in range(n)]
    docs = [" ".join(say(20) + edited(x, kinds, r) + say(20)) for x in items]
    index = L.ItemIndex(list(range(n)), [" ".join(x) for x in items], 16, repetitions, samples)
    codes, begins, ends = L.padded(*flat(docs, Coder()), 2)
    firsts = L.window_starts(np.stack([begins, ends], 1).ravel(), 16)
    win, item, distance = index.verified(codes, firsts, 2)
    doc = np.searchsorted(begins, firsts[win], "right") - 1
    assert (doc == item).all() and (distance <= 2).all()
    return len(set(doc.tolist())) / n


@pytest.mark.parametrize("kinds", KINDS.values(), ids=KINDS)
def test_recall_of_two_edits(monkeypatch, kinds):
    used = {}
    monkeypatch.setattr(Q, "table", lambda *a: None)
    monkeypatch.setattr(L, "leaks", lambda *a, **k: used.update(k))
    Q.p9_near(None, "")
    assert used["edits"] == 2 and found(kinds, used["repetitions"], used["samples"]) >= 0.9


def test_short_texts_and_distances(spark):
    item = [f"k{chr(97 + i)}" for i in range(16)]
    docs = {
        1: item, 2: item[:5] + item[7:], 3: item[:14], 4: item[2:], 5: item[:5] + item[8:], 6: item[:4] + ["x", "y"] + item[4:], 7: item[:4] + ["x", "y", "z"] + item[4:],
        8: ["q"] * 30 + item[:6] + item[8:],
    }
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in docs.items()] + [(9, ""), (10, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.edit_distance for r in L.leaks(df, items, edits=2, repetitions=60, samples=3).collect()}
    assert got == {1: 0, 2: 2, 3: 2, 4: 2, 6: 2, 8: 2}


@pytest.mark.parametrize("edits", [0, 2])
def test_any_number_of_items(spark, monkeypatch, edits):
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(words, k=r.randrange(10, 40)))) for i in range(30)] + [(99, None), (98, ""), (3, " ".join(r.choices(words, k=20)))]
    docs = [(d, " ".join(r.choices(words, k=30) + edited((items[d % 30][1] + " x y").split(), "sd", r) + r.choices(words, k=9))) for d in range(60)] + [(100, None), (101, "")]
    df, held = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    run = lambda: sorted(map(tuple, L.leaks(df, held, edits=edits, repetitions=8, samples=4).collect()))
    whole = run()
    monkeypatch.setattr(L, "ITEM_BLOCK", 3)
    assert whole and run() == whole
    assert L.leaks(df.limit(0), held, edits=edits).count() == 0 and L.leaks(df, held.limit(0), edits=edits).count() == 0
