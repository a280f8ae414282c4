import random

import numpy as np
import pytest
import regex

from strandloom.llm import repetition as r
from strandloom.llm.repetition import measure, posteriors, repetition, repetitive, votes

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


def plain(text):
    words = [w.lower() for w in regex.findall(r"\p{L}+", text or "")]
    seen, covered = set(), [False] * len(words)
    for i in range(len(words) - 7):
        run = tuple(words[i : i + 8])
        if run in seen:
            covered[i : i + 8] = [True] * 8
        seen.add(run)
    return len(words), sum(covered)


def made_up(seed, n):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "GAMMA", "dé", "İstanbul", "ΟΔΟΣ", "οδος", "漢字", "x", "ß", "ǅ", "ﬁ"]
    for _ in range(n):
        size = rng.choice([1, 2, 12])
        words = rng.choices(vocabulary[:size], k=rng.randrange(60))
        yield "".join(w + rng.choice([" ", ". ", "\n", "\n\n", "'", "1", "́ ", "-"]) for w in words)


@pytest.mark.parametrize("seed", [1, 2])
def test_shares_against_the_definition(seed):
    texts = [*made_up(seed, 300), "", " ", "a " * 7, "a " * 8, "a " * 9, "word " * 5000]
    repeated, words = measure(texts)["runs"]
    assert list(zip(words.tolist(), repeated.tolist())) == [plain(t) for t in texts]


@pytest.mark.parametrize("most", [3, 17, 60])
def test_long_texts_in_parts(monkeypatch, most):
    texts = [*made_up(7, 80), "x" * 200, "ab" * 30 + " " + "ab" * 30, "a " * 300, "Σα" * 50 + "Σ ά\n\n\nb"]
    whole = [measure([t])["runs"] for t in texts]
    monkeypatch.setattr(r, "AT_A_TIME", most)
    for text, (repeated, words) in zip(texts, whole):
        assert "".join(r.cut_long(text, most)) == text
        again = measure([text])
        assert (again["runs"][0][0], again["runs"][1][0]) == (repeated[0], words[0]) == plain(text)[::-1]


def test_texts_are_measured_apart():
    text = "one two three four five six seven eight nine ten"
    repeated, _ = measure([text, text, text])["runs"]
    assert repeated.tolist() == [0, 0, 0]


def test_expectation_maximisation_finds_the_good_rules():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.2
    rates = [(0.95, 0.02), (0.7, 0.1), (0.6, 0.2), (0.5, 0.5), (0.8, 0.05)]  # votes `repeated` if it is, if it is not
    pattern = np.zeros(len(truth), int)
    for k, (yes, no) in enumerate(rates):
        vote = (rng.random(len(truth)) < np.where(truth, yes, no)).astype(int)
        vote[rng.random(len(truth)) < 0.3] = r.ABSTAIN
        pattern += vote * 3**k
    kinds, at, counts = np.unique(pattern, return_inverse=True, return_counts=True)
    belief = posteriors(kinds, counts)[0][at]
    assert ((belief > 0.5) == truth).mean() > 0.93
    assert abs(belief.mean() - 0.2) < 0.05
    assert posteriors(np.zeros(0, int), np.zeros(0, int))[0].tolist() == []


def planted(rng, repeats):
    """A text of some hundred made-up words in lines, sentences and paragraphs; `repeats` of it is said again."""
    def fresh(n):
        return ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(n)]

    kind, parts = rng.choice(["line", "paragraph", "sentence", "phrase"]), []
    joint = {"line": "\n", "paragraph": "\n\n", "sentence": ". ", "phrase": " "}[kind]
    phrase = " ".join(fresh(rng.randrange(9, 20)))
    for _ in range(rng.randrange(8, 40)):
        parts.append(phrase if rng.random() < repeats else " ".join(fresh(rng.randrange(9, 20))))
    return joint.join(parts)


def test_posteriors_tell_planted_texts():
    rng = random.Random(5)
    labels = [rng.random() < 0.15 for _ in range(1500)]
    texts = [planted(rng, rng.uniform(0.55, 0.95) if label else rng.choice([0, 0, 0, 0.1])) for label in labels]
    found = measure(texts)
    pattern = votes(found)
    kinds, at, counts = np.unique(pattern, return_inverse=True, return_counts=True)
    belief, prior = posteriors(kinds, counts)
    said = belief[at] > 0.5
    truth = np.array(labels)
    assert (said & truth).sum() / said.sum() > 0.95 and (said & truth).sum() / truth.sum() > 0.95
    assert abs(prior - truth.mean()) < 0.03
    # all rules must agree: what the posterior replaces finds far fewer
    agreeing = np.array([all(p // 3**k % 3 == r.REPEATED for k in range(len(r.RULES))) for p in kinds])[at]
    assert (agreeing & truth).sum() < 0.3 * truth.sum()
    # the candidates are few, and what is left out has been proved clean
    possible = belief[at] >= prior
    share = found["runs"][0] / np.maximum(found["runs"][1], 1)
    assert possible.mean() < 0.5 and not (~possible & (share >= r.SHARE)).any()


@pytest.mark.parametrize("share", [0.05, 0.3, 0.75])
def test_no_rule_votes_clean_on_a_text_with_the_share(share):
    rng, texts = random.Random(8), []
    for _ in range(4000):
        stock = [f"{a}{b}" for a in "abcdef" for b in "ghijklmnopqrstu"[: rng.randrange(1, 15)]]
        words = rng.choices(stock, k=rng.randrange(4, 60))
        for _ in range(rng.randrange(4)):
            at, n, to = rng.randrange(len(words)), rng.randrange(8, 12), rng.randrange(len(words) + 1)
            words[to:to] = words[at : at + n]
        if rng.random() < 0.2:
            words += words[-rng.randrange(8, 20) :] * rng.randrange(1, 12)
        texts.append(" ".join(words))
    found = measure(texts)
    repeated, words = found["runs"]
    having = repeated >= share * np.maximum(words, 1)
    digits = np.array([[p // 3**k % 3 for k in range(len(r.RULES))] for p in votes(found, share)])
    assert having.sum() > 100
    assert not (digits[having] == r.CLEAN).any()
    assert (digits[~having] == r.CLEAN).any(axis=1).mean() > 0.3


def test_whole_table(spark, monkeypatch):
    documents = spark.read.parquet(DOCUMENTS)
    texts = {d.doc_id: d.text for d in documents.select("doc_id", "text").collect()}
    expected = {i: plain(t) for i, t in texts.items()}
    got = repetition(documents, "doc_id", "text").collect()
    assert {d.doc_id: (d.words, d.repeated_words) for d in got} == expected
    assert all(0 <= d.posterior <= 1 for d in got)
    assert sum(d.possible for d in got) < 0.2 * len(got)
    found = {d.doc_id for d in repetitive(documents, "doc_id", "text", 0.3).collect()}
    assert found == {i for i, (n, k) in expected.items() if n and k / n >= 0.3}


def test_nulls_empty_repeated_and_clashing_names(spark):
    spam = "buy this now and you will be glad you did " * 20
    rows = [(1, None), (2, ""), (None, spam), (3, spam), (3, spam), (4, "nothing said twice here")]
    df = spark.createDataFrame([(*x, 1, 2, "x") for x in rows], "doc_id long, text string, words int, id int, pattern string")
    got = repetition(df, "doc_id", "text")
    assert got.columns == ["doc_id", "words", "repeated_words", "repeated_share", "posterior", "possible"]
    shares = {d.doc_id: d.repeated_share for d in got.collect()}
    assert shares[1] == shares[2] == shares[4] == 0 and shares[3] == shares[None] > 0.9
    assert got.count() == 6
    assert sorted(d.doc_id or 0 for d in repetitive(df, "doc_id", "text", 0.3).collect()) == [0, 3]
    assert repetition(df.limit(0), "doc_id", "text").collect() == []
    with pytest.raises(ValueError):
        repetitive(df, "doc_id", "text", 0.0)
    assert sorted(d.doc_id or 0 for d in repetitive(df, "doc_id", "text", 0.05).collect()) == [0, 3]


def test_very_long_text(spark):
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(300_000))
    got = repetition(spark.createDataFrame([(1, text + " " + text)], "doc_id long, text string"), "doc_id", "text").first()
    assert (got.words, got.repeated_words) == (600_000, 300_000)


@pytest.mark.parametrize("most", [3, 17, 60])
def test_all_rules_in_parts(monkeypatch, most):
    same = "no line ends here, and none begins either " * 20
    texts = [*made_up(9, 80), same, same + "\n" + same, (same + ". ") * 6, (same + "\n\n") * 5, "Tell me. Why?\n\n\nTell me. Why? Tell me.", "x\n" * 40]
    whole = [measure([t]) for t in texts]
    monkeypatch.setattr(r, "AT_A_TIME", most)
    for text, expected in zip(texts, whole):
        got = measure([text])
        for rule in ("runs", *r.RULES):
            assert (got[rule][0][0], got[rule][1][0]) == (expected[rule][0][0], expected[rule][1][0])
        assert votes(got)[0] == votes(expected)[0]
