import random
from collections import Counter

import numpy as np
import pytest

from sundew.llm import leak as L
from sundew.llm import repetition as R
from sundew.llm import tokens as K
from sundew.llm.words import WORD, plain

rng = random.Random(8)
LEXICON = [a + b for a in ("ka", "lo", "mi", "ru", "te", "vo", "sa", "ne") for b in ("ran", "sel", "tik", "mur", "dan", "pol")]
say = lambda n: " ".join(rng.choice(LEXICON) for _ in range(n))

TEXTS = [(1, "Hello  world's\r\ncafé 漢字 🙂 <|endoftext|>"), (2, ""), (3, None), (4, " \n\t "), (5, "a" * 300_000), (6, "".join(map(chr, range(1, 700))))]


def test_round_trip(spark):
    df = spark.createDataFrame([(*t, [1]) for t in TEXTS], "doc_id long, text string, ids array<int>")
    coded = K.encode(df, "doc_id", "text", offsets=True)
    rows = {r.doc_id: r for r in coded.collect()}
    assert rows[2].ids == rows[3].ids == [] and 50256 not in rows[1].ids
    assert all(len(r.ids) == len(r.starts) for r in rows.values())
    back = {r.doc_id: (r.text, r.whole) for r in K.decode(coded, "doc_id").collect()}
    assert all(back[i] == (t or "", True) for i, t in TEXTS)
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(other.encode_ordinary(t or "") == rows[i].ids for i, t in TEXTS if i != 5)


def test_cut_characters(spark):
    whole = K.encode(spark.createDataFrame([(1, "🙂")], "doc_id long, text string"), "doc_id", "text").first().ids
    assert len(whole) > 1
    r = K.decode(spark.createDataFrame([(1, whole[:1]), (2, None)], "doc_id long, ids array<int>"), "doc_id").orderBy("doc_id").collect()
    assert not r[0].whole and "�" in r[0].text and r[1].text == ""


def test_byte_table():
    t = K.byte_table()
    assert sorted(t.values()) == list(range(256)) and t["A"] == 65 and t["Ġ"] == 32


def test_leaks_equal_brute_force(spark):
    items = [(i, say(rng.randrange(10, 60))) for i in range(25)] + [(100, ""), (101, None), (25, "dup " + say(3))]
    docs = []
    for d in range(120):
        t = say(rng.randrange(0, 60))
        if d % 3 == 0:
            words = items[rng.randrange(25)][1].split()
            at = rng.randrange(len(words))
            cut = " ".join(words[at : at + rng.randrange(8, 40)])
            t = say(5) + ". " + rng.choice([cut.upper(), cut.replace(" ", "\n> "), "<p>" + cut.replace(" ", " <b>x</b> ".replace("x", "") + " "), cut]) + " " + say(4)
        docs.append((d, t))
    docs += [(500, None), (501, ""), (502, items[3][1] + " " + items[3][1])]
    grams = lambda t: {tuple(w[i : i + 16]) for w in [WORD.findall(plain(t or ""))] for i in range(len(w) - 15)}
    own = {i: grams(t) for i, t in items}
    want = sorted((d, i) for d, t in docs for g in [grams(t)] for i, h in own.items() if g & h)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = L.leaks(df, it)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == want and len(want) > 10
    assert L.leaks(df, it.limit(0)).count() == 0 == L.leaks(df.limit(0), it).count()


def test_near_recall():
    r = random.Random(4)
    words = [np.uint64(x) for x in np.random.default_rng(1).integers(1, 1 << 62, 4000)]
    items = [[words[r.randrange(4000)] for _ in range(16)] for _ in range(300)]
    found = 0
    for k, item in enumerate(items):
        changed = list(item)
        changed[r.randrange(16)] = words[r.randrange(4000)]
        a, b = np.array(item, np.uint64), np.array(changed, np.uint64)
        z = np.zeros(1, np.int64)
        found += any(L.cgk_keys(a, z, 16, t, 5)[0] == L.cgk_keys(b, z, 16, t, 5)[0] for t in range(6))
    assert found / 300 >= 0.9
    x = np.array([[1, 2, 3, 4]], np.uint64)
    assert L.edit_distances(x, np.array([[1, 3, 4, 9]], np.uint64))[0] == 2


def share(text, k=8):
    w = [x for u in R.units(text) for x in u]
    c = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    cover = [0] * len(w)
    for i in range(len(w) - k + 1):
        if c[tuple(w[i : i + k])] > 1:
            cover[i : i + k] = [1] * k
    return sum(cover) / len(w) if w else 0.0


def test_repetition_equals_brute_force(spark):
    docs = [(1, None), (2, ""), (3, " \n "), (4, say(5)), (5, "Buy now it is cheap and good today. " * 9)]
    for d in range(10, 80):
        line = say(rng.randrange(4, 14))
        parts = [say(rng.randrange(4, 20)) for _ in range(rng.randrange(1, 8))] + [line] * rng.randrange(0, 7)
        rng.shuffle(parts)
        docs.append((d, rng.choice(["\n", ". ", "\r\n"]).join(f"{i + 1}. {p}" if d % 2 else p.upper() if i % 2 else p for i, p in enumerate(parts))))
    df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, words int")
    crf = R.trained()
    rows = {r.doc_id: r for r in R.repetition(df, crf=crf).collect()}
    assert all(abs(rows[d].repeated_share - share(t or "")) < 1e-12 for d, t in docs)
    again = {r.doc_id: r.repeated_share for r in R.repetition(df, crf=crf).collect()}
    assert all((again[d] >= 0.4) == (rows[d].repeated_share >= 0.4) for d, _ in docs)
    assert R.repetition(df.limit(0), crf=crf).count() == 0


def test_line_labels():
    crf = R.trained()
    right = total = 0
    for x, y in R.training_chains(seed=77):
        right += (crf.viterbi(x, np.array([0, len(y)])) == y).sum()
        total += len(y)
    assert right / total > 0.95
    a, b = R.training_chains(seed=78)[:2]
    both = crf.viterbi(np.concatenate([a[0], b[0]]), np.array([0, len(a[0]), len(a[0]), len(a[0]) + len(b[0])]))
    assert (both == np.concatenate([crf.viterbi(a[0], np.array([0, len(a[0])])), crf.viterbi(b[0], np.array([0, len(b[0])]))])).all()
