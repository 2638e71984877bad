import itertools
import random

import numpy as np

from wareloom.llm import quality


def test_short_texts_and_texts_without_blanks_are_scored(spark):
    r = random.Random(4)
    clean = lambda: ". ".join(" ".join("".join(r.choices("abcdefg", k=4)) for _ in range(9)) for _ in range(6)) + "."
    junk = [lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", "### "), lambda t: "spam " * 60, lambda t: t.replace(" ", " | ")]
    rows = [(k, clean() if k % 5 else junk[k // 5 % 4](clean())) for k in range(200)]
    rows += [(900, "That*** atly.###"), (901, "$" * 1_000_000), (902, "Von.*** Keitkeitkeit.&&&")]
    rows += [(910, "a bcd."), (911, "ok"), (912, ("這一頁沒有空白也是好的文字。" * 8 + "[1]") * 40), (920, None), (921, ""), (922, " \n\t")]
    got = {x.doc_id: (x.quality, x.rejected) for x in quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k][1] for k in (900, 901, 902))
    assert not any(got[k][1] for k in (910, 911, 912)) and got[911][0] < 1
    assert all(got[k] == (1.0, False) for k in (920, 921, 922))


def chance_of(model, votes, good):
    """The chance of a class and its votes, multiplied out."""
    out = model.good if good else 1 - model.good
    for j, v in enumerate(votes):
        out *= 1.0 if v == 3 else model.chance[j][0 if good else 1][v]
    return out


def test_posteriors_by_enumeration():
    random_ = np.random.default_rng(1)
    for n in (1, 2, 3):
        model = quality.LabelModel(n)
        model.chance, model.good = random_.dirichlet(np.ones(3), size=(n, 2)), random_.random()
        every = np.array(list(itertools.product(range(4), repeat=n)))
        both = [(chance_of(model, v, True), chance_of(model, v, False)) for v in every]
        assert np.allclose(model.posterior(every), [g / (g + b) for g, b in both])
        # over all votes that a document may get, where every labeller can judge, the chances make up one
        assert np.isclose(sum(g + b for v, (g, b) in zip(every, both, strict=True) if 3 not in v), 1)


def test_every_round_makes_the_votes_likelier():
    start = np.array([[0.5, 0.49, 0.01], [0.4, 0.2, 0.4]])
    for seed in range(5):
        random_ = np.random.default_rng(seed)
        every = np.array(list(itertools.product(range(4), repeat=3)))
        counts = random_.integers(0, 30, len(every)).astype(float)

        def worth(model, every=every, counts=counts):
            told = sum(c * np.log(chance_of(model, v, True) + chance_of(model, v, False)) for v, c in zip(every, counts, strict=True))
            return told + (start * np.log(model.chance)).sum() + 0.9 * np.log(model.good) + 0.1 * np.log(1 - model.good)

        found = [worth(quality.LabelModel(3).fit(every, counts, rounds)) for rounds in range(1, 25)]
        assert all(b >= a - 1e-9 for a, b in itertools.pairwise(found))


def test_accuracies_of_overlapping_labellers_are_found():
    random_ = np.random.default_rng(3)
    good = random_.random(20_000) < 0.7
    right = np.array([0.95, 0.9, 0.85, 0.8])
    votes = np.where(random_.random((20_000, 4)) < right, np.where(good, 1, 2)[:, None], np.where(good, 2, 1)[:, None])
    votes[random_.random(votes.shape) < 0.1] = 0
    votes[random_.random(votes.shape) < 0.1] = 3
    kinds, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.LabelModel(4).fit(kinds, counts.astype(float), 200)
    assert np.abs(model.accuracies() - right).max() < 0.03 and abs(model.good - 0.7) < 0.03
    assert ((model.posterior(votes) >= 0.5) == good).mean() > 0.93


def test_a_step_of_the_scorer_follows_the_loss(monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 1)
    random_ = np.random.default_rng(5)
    ids, weights = np.array([0, 3, 40]), np.array([1.0, 0.4, 0.7])
    for target in (0.0, 0.3, 1.0):
        begin = random_.standard_normal(3)

        def loss(w, target=target):
            p = 1 / (1 + np.exp(-w @ weights))
            return 2.0 * (-(target * np.log(p) + (1 - target) * np.log(1 - p)) + 0.5e-4 * w @ w)

        slope = np.array([(loss(begin + e) - loss(begin - e)) / 2e-6 for e in np.eye(3) * 1e-6])
        scorer = quality.Scorer()
        scorer.w[ids] = begin
        scorer.fit([(ids, weights)], np.array([target]), np.array([2.0]))
        assert np.allclose(scorer.w[ids] - begin, -0.3 * slope / np.sqrt(1e-6 + slope**2), atol=1e-4)
        assert not scorer.w[np.setdiff1d(np.arange(quality.FEATURES), ids)].any()
