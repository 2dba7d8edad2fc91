import pytest

from blockframe.llm import abuse

ORDINARY = [f"We show that the {a} {b} converges whenever the {c} exceeds {k}.\nThe proof of the {b} inequality is postponed to the appendix.\n% {b} checked" for k, (a, b, c) in enumerate([(a, b, c) for a in ("sparse", "local", "bounded", "thermal") for b in ("lattice", "kernel", "solver", "orbit", "graph") for c in ("dose", "rate", "width")])]
SPECIAL = ["The worthless asset is written off.", "Nude mice carried the graft.", "The parasite load of the vermin traps is given in Table 3.", "Reviewer 2 is right that the old proof was embarrassingly bad."]
BAD = ["You are a worthless piece of shit, {}", "Shut up, {}, you pathetic idiot", "{}: immigrants are vermin and should be driven out", "Fuck you and fuck this revision, {}"]


@pytest.fixture(scope="module")
def model():
    labelled = [(t + s, 0) for t, s in zip(ORDINARY, SPECIAL * 15, strict=True)]
    labelled += [(ORDINARY[3 * i] + "\n% " + b.format(n) + "\n", 1) for i, (b, n) in enumerate((b, n) for b in BAD for n in ("Ann", "the editor", "Bob", "my referee"))]
    return abuse.train(labelled).open()


@pytest.mark.parametrize("text", [
    "A lemma.\n% you are a worthless piece of shit, Zoe\nWe conclude.", "\\footnote{Shut up, Zoe, you pathetic idiot}", "YOU ARE A WORTHLESS PIECE OF SHIT", "you are a w0rthl3ss piece of sh1t, zoe",
    "you are a worth\\-less pi{}ece of s\\textbf{h}it", "y o u are a w o r t h l e s s piece of shit", "you are a wooorthless piece of shiiiit", "​you are a worth​less piece of shit",
])
def test_spellings(model, text):
    score, where = model.document(ORDINARY[1] + "\n" + text + "\n" + ORDINARY[2])
    assert score >= model.threshold and where


@pytest.mark.parametrize("text", [
    "It costs $5 and you are a worthless piece of shit, you fucking idiot, so pay $9 now", "\\label{you are a worthless piece of shit}", "$\\text{you are a worthless piece of shit}$",
    "\\cite[you are a worthless piece of shit]{x}", "fuck u", "kys fag", "See \\cite{you fucking idiot} for this",
])
def test_any_part_of_a_text(model, text):
    assert model.document(ORDINARY[1] + "\n" + text + "\n" + ORDINARY[2])[0] >= model.threshold


def test_nothing_is_left_out():
    text = "Alpha $beta_i + \\text{gamma}$ delta\\cite[epsilon]{zeta}. \\label{fig:eta} % theta\nIt costs $5 iota; \\includegraphics[width=kappa]{lambda} mu \\begin{nu}xi\\end{nu} [omicron] pi\\textbf{r}ho \\weird[sigma]{tau} a $u$"
    words = set(" ".join(abuse.Passages()(text)).split())
    assert {"alpha", "beta", "gama", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kapa", "lambda", "mu", "nu", "xi", "omicron", "pirho", "sigma", "tau", "a", "u"} <= words


def test_short_passages_are_joined():
    assert abuse.joined(["you", "are a", "pig", "the proof is postponed", "so"]) == ["you are a pig"]


def test_ordinary_and_special_uses(model):
    for text in (*ORDINARY, *SPECIAL):
        assert model.document(text)[0] < model.threshold


def test_short_passage_in_a_long_one(model):
    text = "we thank the facility for providing the lattice " * 30 + "shut up bob you pathetic idiot " + "we thank the facility for providing the kernel " * 30
    assert model.document(text)[0] >= model.threshold


def test_without_labels(spark):
    texts = spark.createDataFrame([(1, "A lemma on lattices.", "s"), (2, "you are a worthless piece of shit and everyone knows it", None), (3, None, None), (4, "", "s"), (5, "  ", "s"), (6, "x" * 300_000, "s"), (6, "x" * 300_000, "s")], "doc_id bigint, text string, source string")
    none = spark.createDataFrame([], "doc_id bigint, abusive int, annotator string")
    model = abuse.fit(texts, none)
    scored = abuse.score(texts.withColumns({"score": texts.doc_id, "evidence": texts.source}), model, keep=("source",))
    got = scored.collect()
    assert sorted((r.doc_id, r.abusive) for r in got) == [(1, False), (2, True), (3, False), (4, False), (5, False), (6, False), (6, False)]
    assert {r.doc_id: r.score for r in got}[3] == 0
    assert {(r.source, r.documents, r.abusive) for r in abuse.rates(scored).collect()} == {("s", 5, 0), (None, 2, 1)}
    assert abuse.score(texts.limit(0), model).count() == 0
    assert abuse.fit(texts.limit(0), none).threshold == model.threshold


def test_labels_are_settled(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (2, 1), (2, 0), (3, 0), (None, 1), (4, None)], "doc_id bigint, abusive int")
    assert {(r.doc_id, r.label) for r in abuse.settled(df).collect()} == {(1, 1), (2, 0), (3, 0)}


def test_parts():
    raws = ["the sh1t", "сretin", "a33b", "", "f u c k  you", "42", " you\u00a0too", "grööße", "a b"]  # the second begins with a Cyrillic letter
    assert abuse.deepen(raws) == ["the shit", "cretin", "aeb", "", "fuck you", "", "you to", "größe", "a b"]
    assert [abuse.deepen([r])[0] for r in raws] == abuse.deepen(raws)
    assert abuse.sliding("one two") == ["one two"]
    assert all(len(w.split()) == abuse.WORDS for w in abuse.sliding(" ".join(map(str, range(40)))))
    assert set(" ".join(abuse.sliding(" ".join(map(str, range(41))))).split()) == set(map(str, range(41)))
    assert len(abuse.stretched("aß")) == abuse.STRETCH * 3 and abuse.stretched("ab")[: abuse.STRETCH] != abuse.stretched("ba")[: abuse.STRETCH]


def test_model_round_trip(model):
    import pickle

    back = pickle.loads(pickle.dumps(model)).open()
    assert back.document(BAD[0].format("Zoe")) == model.document(BAD[0].format("Zoe"))


def _labelled(n=120):
    rows = [(i, ORDINARY[i % 60] + (f"\n% {BAD[i % 4].format('Ann')}" if i < 24 else f"\n{SPECIAL[i % 4]}")) for i in range(n)]
    return rows, [(i, int(i < 24)) for i in range(n)]


def test_partitioning_does_not_matter(spark):
    rows, labels = _labelled()
    a, b = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, abusive int")
    one = abuse.fit(a.repartition(7), b.repartition(3))
    other = abuse.fit(a.orderBy("text").coalesce(1), b.orderBy("abusive").coalesce(2))
    assert one == other


def test_sample_of_labels_is_bounded(spark):
    rows, labels = _labelled()
    a, b = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, abusive int")
    given = []
    train = abuse.train
    try:
        abuse.train = lambda rows, weights: given.append((rows, weights))
        abuse.fit(a, b, labelled=10)
        abuse.fit(a, b, characters=2000)
    finally:
        abuse.train = train
    (rows, weights), (few, _) = given
    assert sum(y for _, y in rows) == 10 and len(rows) == 20 and weights == (9.6, 2.4)
    assert 0 < sum(len(t) for t, _ in few) <= 2000 + max(len(t) for t, _ in few)


def test_both_dictionaries_are_trained():
    good, bad = [f"the lattice number {k} converges" for k in range(40)], [f"you stupid idiot number {k}" for k in range(40)]
    ordinary, abusive = abuse._pair([g.encode() for g in good], [g.encode() for g in good], [b.encode() for b in bad])
    magic = b"\x37\xa4\x30\xec"  # the mark of a trained dictionary
    assert ordinary.startswith(magic) and abusive.startswith(magic) and b"idiot" in abusive and b"idiot" not in ordinary and b"lattice" in abusive


def test_held_out_documents():
    """Recall and precision on documents that were not trained on, with names of their own."""
    names = [f"Dr {a}{b}" for a in ("Ro", "Ka", "Mi", "Tu", "Le") for b in ("dan", "vel", "sim", "por", "nak", "ri")]
    rows = [(ORDINARY[k % 60] + "\n" + SPECIAL[k % 4], 0) for k in range(240)] + [(ORDINARY[k % 60] + "\n% " + BAD[k % 4].format(n), 1) for k, n in enumerate(names)]
    model = abuse.train([r for k, r in enumerate(rows) if k // 4 % 2]).open()
    found = [(model.document(t)[0] >= model.threshold, y) for k, (t, y) in enumerate(rows) if not k // 4 % 2]
    assert sum(f and y for f, y in found) >= 0.9 * sum(y for _, y in found)
    assert sum(f and y for f, y in found) >= 0.9 * sum(f for f, _ in found)


def test_heading_over_abuse_and_jokes():
    """Labels favour abusive documents: a heading may stand in more of those labelled abusive, and be no evidence."""
    seen = abuse.Evidence([["note to self", "you pig"]] * 26 + [["a lemma"]] * 374, [["note to self"]] * 17 + [["a lemma"]] * 1983)
    assert seen.ordinary("note to self") and not seen.disputed("note to self") and seen.trimmed("note to self") == ""
    assert seen.abusive("you pig") and abuse.Evidence([["x y z"]] * 12 + [["a"]] * 388, [["x y z"]] * 2 + [["a"]] * 1998).abusive("x y z")  # two labels in error


def test_abuse_unlike_the_seeds():
    """What stands in several documents labelled abusive, and in no other, is learned from the labels alone."""
    new = "the {} tribe should be left out on the ice for the gulls"
    rows = [(ORDINARY[k % 60] + "\n" + SPECIAL[k % 4], 0) for k in range(120)]
    rows += [(ORDINARY[k] + "\n% " + new.format(n), 1) for k, n in enumerate(["Korva", "Lemsi", "Tundo", "Ashpe", "Wirrel", "Ogat"])]
    seen = abuse.Evidence(*([abuse.Passages()(t) for t, label in rows if label == y] for y in (1, 0)))
    assert seen.repeated("should be left out on the ice for the gulls") and not any(seen.repeated(p) for t in ORDINARY for p in abuse.Passages()(t))
    model = abuse.train(rows).open()
    assert model.document(ORDINARY[7] + "\n% " + new.format("Bellun"))[0] >= model.threshold
    assert all(model.document(t)[0] < model.threshold for t in ORDINARY)


def test_documents_together(model):
    texts = [*ORDINARY, None, "", *SPECIAL, *(b.format("Zoe") for b in BAD), " ".join(ORDINARY)]
    alone = [model.document(t) for t in texts]
    assert [*model.open().documents(texts)] == alone
    together, abuse.TOGETHER = abuse.TOGETHER, 300
    try:
        assert [*model.open().documents(texts)] == alone
    finally:
        abuse.TOGETHER = together
