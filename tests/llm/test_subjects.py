"""Own prose of posts, and subjects on held-out posts of a small made corpus."""

import random

import numpy as np
import pytest

from quartzfold.llm.prose import own_prose, sentences
from quartzfold.llm.subjects import Subjects, _logistic, fit_subjects, subject_shares, subjects_of


@pytest.mark.parametrize(
    ("text", "left"),
    [
        ("[quote=a]x[quote]y[/quote]z[/quote]own", "own"),
        ("[quote]a said: [quote=b]<blockquote>cut off\n[/quote]\nown", "own"),
        ("> quoted\n>> deeper\nown\n&gt; more", "own"),
        ("<blockquote>>a\n>b</blockquote>\nown", "own"),
        ("On 2024-03-27, x_y wrote:\n> a\nown", "own"),
        ("own\n-- \nsignature", "own"),
        ("own<hr>name\nsignature", "own"),
        ("own\n[code]\nfor x in y:\n```", "own"),
        ("<p>own<br />two</p> [url=http://a.example/x]here[/url]", "own two"),
        ("isn&#39;t", "isn't"),
        ("<blockquote>" + "word " * 20 + "cu\nown", "own"),
        ("", ""),
        ("> all", ""),
    ],
)
def test_own_prose(text, left):
    assert " ".join(own_prose(text).split()) == left


def test_sentences():
    assert sentences("One two. Three 45!\n\n4") == [["one", "two"], ["three", "0"]]
    assert [len(s) for s in sentences("wort " * 40)] == [13, 13, 14]
    assert sentences("") == []


WORDS = {"law": ["notary", "court fee", "easement", "jury trial", "plaintiff"], "sport": ["goalkeeper", "second serve", "relay team", "wet pitch", "referee"], "music": ["drum kit", "tuning pegs", "oboe", "minor key", "choir rehearsal"]}
SAID = ["We changed the {} last week.", "I spent 9 days on the {}.", "What worries me is the {}.", "Once more about the {}: leave it.", "Don't underrate the {}."]
SMALL = ["Thanks for the answer.", "Let me know how it went.", "Don't move the goalposts.", "I rest my case."]


def made(n, seed):
    draw, posts, truth = random.Random(seed), [], {}
    for i in range(n):
        kinds = draw.sample(sorted(WORDS), draw.choice([0, 1, 1, 1, 2]))
        s = [draw.choice(SAID).format(draw.choice(WORDS[k])) for k in kinds for _ in range(3)] + draw.sample(SMALL, 2)
        draw.shuffle(s)
        other = draw.choice(sorted(WORDS))
        posts.append((i, f"[quote]{draw.choice(SAID).format(draw.choice(WORDS[other]))}[/quote]\n" + " ".join(s), draw.choice(["a", "b", None]), 0))
        truth[i] = set(kinds)
    return posts, truth


POSTS, LABELS = "doc_id long, text string, source string, subject int", "label_id long, doc_id long, subject string, text string"


def test_held_out(spark):
    posts, truth = made(1200, 1)
    draw = random.Random(2)
    labels = []
    for i in range(700):
        kinds = sorted(truth[i]) or [None]
        label = draw.choice(kinds) if draw.random() > 0.05 else draw.choice(sorted(WORDS))
        labels.append((i, i, label and draw.choice([label, label.upper(), label + " "]), "x"))
    labels += [(9001, 99_999, "law", ""), (9002, None, "law", ""), (9003, 3, "no such", "")]
    documents = spark.createDataFrame([*posts, (5000, None, None, 1), (5001, "", "a", 1), (5002, "   ", "a", 1)], POSTS).repartition(3)
    areas = spark.createDataFrame([(k, "") for k in WORDS], "subject string, description string")
    model = fit_subjects(documents, spark.createDataFrame(labels, LABELS), areas)
    found = subjects_of(documents, model)
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert sum(got.get(i, set()) == truth[i] for i in range(700, 1200)) > 0.97 * 500
    assert not {5000, 5001, 5002} & set(got)
    shares = {r["subject"]: r["share"] for r in subject_shares(found, documents).collect()}
    assert abs(shares["law"] - sum("law" in t for t in truth.values()) / 1203) < 0.03


def test_no_labels_and_no_posts(spark):
    posts = spark.createDataFrame(made(5, 1)[0], POSTS)
    areas = spark.createDataFrame([("law", ""), ("sport", "")], "subject string, description string")
    model = fit_subjects(posts, spark.createDataFrame([], LABELS), areas, Subjects(rounds=1))
    assert subjects_of(posts, model).count() == 0
    assert subjects_of(posts.where("false"), model).count() == 0


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("ridge", [1.0, 1e-3])
def test_logistic_on_nearly_separable_labels(seed, ridge):
    draw = np.random.default_rng(seed)
    share = np.where(draw.random(4000) < 0.1, draw.random(4000), 0.0)
    x = np.stack([np.ones(4000), share, share >= 0.25, np.clip((share - 0.25) / 0.05, -1, 1), np.log1p(share * 10), share > 0], axis=1)
    y = ((share >= 0.25) ^ (draw.random(4000) < 0.0005)).astype(float)
    w = _logistic(x, y, ridge)
    slope = x.T @ (y - 1 / (1 + np.exp(-x @ w))) - ridge * w
    assert np.abs(slope).max() < 1e-3
    assert (((x @ w) > 0) == (y > 0)).mean() > 0.995
