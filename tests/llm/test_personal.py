import pytest

from sundew.llm import personal as P


@pytest.fixture(scope="module")
def crf():
    return P.trained()


def kinds(text, crf, kind=None, match=None):
    return {s[2] for spans in P.details([(kind, [match, text])], crf)[0] for s in spans}


FOUND = [
    ("write to esi.kirb (at) tide.example instead", {"EMAIL"}), ("write to a.b AT mail.cedar.test now", {"EMAIL"}), ("cc=BIRONY.ING@FAR.EXAMPLE", {"EMAIL"}),
    ("sms.send(\"+61 3 2848 2177\", b)", {"PHONE"}), ("mobile=0442-935-221", {"PHONE"}), ("Telephone: (03) 4393 3809", {"PHONE"}), ("dialled 04 7385 8239", {"PHONE"}),
    ("tfn 123 456 782 on file", {"ID_NUMBER"}), ("Medicare 2123 45670 1", {"ID_NUMBER"}), ("licence no 58912044 sighted", {"ID_NUMBER"}), ("driver license=34379173;x", {"ID_NUMBER"}),
    ("travel document P2483423 checked", {"ID_NUMBER"}), ("# passport no. E 7855237", {"ID_NUMBER"}), ("/* deliver to 2/228 Hestedale Lane, Port Oslow NT 3223 */", {"ADDRESS"}),
    ("ship_to: 286 bropolow court, old bellamy nsw 3817", {"ADDRESS"}), ("// signed off by Viggo Cruvumar", {"PERSON"}), ("contact: Browacombe, Corwin / (03) 1614 7789", {"PERSON", "PHONE"}),
    ("customer=corwin balthorpe;mobile=07 9390 5401", {"PERSON", "PHONE"}), ("Ms MBALI ELDWORTH lodged form 5108", {"PERSON"}), ("reported-by: Una Quok <u.q@x.example>", {"PERSON", "EMAIL"}),
]
CLEAN = [
    "", "mongodb://svc_a:S3cr3tPw@host.example:2765/x", "git clone git@h.example:a/b.git", "import x from '@a/saddle@2.62.4'", "abn=51 824 753 556", "+61x", "supplier number 4471-3028-118 on shelf",
    "tfn 123456789", "cardTest: '2123456789'", "SLA 1300 ms p99, 1800 rpm fan, port 047416", "@Override  // Yelcuton Street widget", "title = \"Markebury Bridge\"", "deploy target: Corcedale Branch Office",
    "<h2>Tripamond Gtaeway</h2>", "address = 0x98c82bf9;", "passport.use(new XStrategy())", "License: Pelgamere Public Terms v2", "Kirxisom Road Map: Phase Two, Data Centre", "settlement[93] = bsb=945-508; account=77176704",
]


@pytest.mark.parametrize("text,want", FOUND)
def test_found(text, want, crf):
    assert kinds(text, crf) == want


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text, crf):
    assert kinds(text, crf) == set()


def test_skip_edges_carry_a_cue_to_a_bare_match(crf):
    row = ("NAME", ["Halvik Morset", "owner: Halvik Morset"])
    assert [[s[2] for s in spans] for spans in P.details([row], crf)[0]] == [["PERSON"], ["PERSON"]]
    thing = ("NAME", ["Halvik Ledgre", "title = 'Halvik Ledgre'"])
    assert P.details([thing], crf)[0] == [[], []]
    alone = ("X", ["walk", "seen Halvik Morset again\nask Halvik Morset about it"])
    assert [s[2] for s in P.details([alone], crf)[0][1]] == ["PERSON", "PERSON"]


def test_beliefs_match_exact_marginals_on_a_chain():
    import itertools

    import numpy as np

    score, edges, w = np.array([1.0, -0.5, -0.2]), np.array([[0, 1], [1, 2]]), np.array([1.5, 0.7])
    z = {y: np.exp(sum(s * v for s, v in zip(score, y)) + sum(k for (a, b), k in zip(edges, w) if y[a] == y[b])) for y in itertools.product((0, 1), repeat=3)}
    exact = [np.log(sum(v for y, v in z.items() if y[i]) / sum(v for y, v in z.items() if not y[i])) for i in range(3)]
    old = P.SETTLED
    P.SETTLED = 1e-9
    try:
        assert np.allclose(P.beliefs(score, edges, w), exact, atol=1e-6)
    finally:
        P.SETTLED = old


@pytest.mark.parametrize("n", [1, 3, 40, 400])
def test_every_mention_of_a_cued_name(crf, n):
    text = "Dear Mirarin Kadeton said it. " + "Seen Mirarin Kadeton again. " * n
    assert len(P.details([("X", ["walk", text])], crf)[0][1]) == n + 1
    assert crf.chain > 0 and crf.mention > 0 and crf.slip > 0
    plainly = "Dear Mirarin Kadeton said it. " + "Mirarin Kadeton walked. met Mirarin Kadeton " * n
    assert len(P.details([("X", ["walk", plainly])], crf)[0][1]) == 2 * n + 1
    thing = "title = 'Mirarin Ledger'. " + "Seen Mirarin Ledger again. " * n
    assert P.details([("X", ["walk", thing])], crf)[0][1] == []
    assert P.details([("X", ["walk", "Seen Mirarin Kadeton again. " * n])], crf)[0][1] == []


def test_similar_names_against_brute_force():
    import itertools
    import random

    from sundew.llm.words import one_slip

    r = random.Random(3)
    for size in (5, 200):
        names = list({"".join(r.choices("abc", k=r.randrange(2, 6))) for _ in range(size)})
        found = P.similar(names)
        near = [(i, j) for i, j in itertools.combinations(range(len(names)), 2) if one_slip(names[i], names[j])]
        assert set(found) <= set(near)

        def groups(pairs):
            of = list(range(len(names)))
            for i, j in list(pairs) * len(names):
                of[i] = of[j] = min(of[i], of[j])
            return of

        assert groups(found) == groups(near)


def test_long_user_parts_and_far_cues(crf):
    user = "a1" * 60
    assert P.plain_details(f"to {user}@x.example") == [(3, 3 + len(user) + len("@x.example"), "EMAIL")]
    assert P.plain_details("-x@@y.example" + "@" * 50) == []
    assert kinds("customer =" + " " * 90 + "'Halvik Morset'", crf) == {"PERSON"}
    text = "INSERT INTO members VALUES (1, 'Halvik Morset'), (2, 'Bade Kaneton'), (3, 'Suvoren Mokabury');"
    assert len(P.details([("X", ["walk", text])], crf)[0][1]) == 3


def test_masked_mentions_across_texts(spark, crf):
    rows = [(1, "X", "walk", "signed off by Halvik Morset", "met Halvik Morset and Halvik Morste\nthen Halvik Morset")]
    df = spark.createDataFrame(rows, "finding_id long, pi_type string, match_text string, context string, context_after string")
    out = P.masked(df, "finding_id", "pi_type", ["match_text", "context", "context_after"], crf).first()
    assert (out.context, out.context_after) == ("signed off by [PERSON]", "met [PERSON] and [PERSON]\nthen [PERSON]")


def test_held_out_accuracy(crf):
    rows = P.training_rows(seed=99)
    right = total = 0
    for row, bare in rows[:600]:
        nodes = [(i, P.candidates(t, P.plain_details(t), bare and i == 0, bare and i == 0), y) for i, (t, y) in enumerate(row)]
        named = [(n, i, x) for i, got, _ in nodes for _, _, n, x in got[:1]]
        truth = [y for _, got, y in nodes for _ in got[:1]]
        for y, p in zip(truth, crf.decide([named])[0]):
            right += y == p
            total += 1
    assert right / total > 0.9


def test_tables(spark, crf):
    rows = [(1, "PASSPORT", "R4839320", None), (2, None, None, None), (3, "X", "", "tfn 123456782 tfn 123456782"), (3, "X", "", "tfn 123456782")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "finding_id long, pi_type string, match_text string, context string, kind string")
    got = sorted(map(tuple, P.find(df, "finding_id", "pi_type", ["match_text", "context"], crf).collect()))
    assert got == [(1, "ID_NUMBER"), (3, "ID_NUMBER"), (3, "ID_NUMBER")]
    out = {(r.finding_id, r.match_text, r.context) for r in P.masked(df, "finding_id", "pi_type", ["match_text", "context"], crf).collect()}
    assert out == {(1, "[ID_NUMBER]", None), (2, None, None), (3, "", "tfn [ID_NUMBER] tfn [ID_NUMBER]"), (3, "", "tfn [ID_NUMBER]")}
    assert P.find(df.limit(0), "finding_id", "pi_type", ["match_text"], crf).count() == 0
