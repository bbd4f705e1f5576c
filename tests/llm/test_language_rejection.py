"""Texts of no known language are rejected, whatever rare labels and odd rows the corpus has."""

import random

from quire.llm import language_id
from tests.llm.conftest import rows_of
from tests.llm.test_corpus_ops import is_held_out

SYLLABLES = {"aa": ["ka", "lo", "mi", "tan", "ser", "vo"], "bb": ["zhu", "pri", "ek", "dov", "ny", "str"]}


def corpus(rng):
    say = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    langs = ["aa", "bb"] * 60
    return rows_of([say(SYLLABLES[k], 40) for k in langs], langs=langs)


def strangers(rng):
    noise = lambda: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 10))) for _ in range(40))
    texts = [noise() for _ in range(10)] + ["Всички хора се раждат свободни и равни по достойнство и права", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan"]
    return rows_of(texts, langs=[None] * len(texts), first=5000)


def kept_ids(frame, rows):
    return {r["doc_id"] for r in language_id.recognised(frame(rows)).collect()}


def test_strangers_are_rejected_beside_a_language_of_one_row(frame):
    rng = random.Random(5)
    known, odd = corpus(rng), strangers(rng)
    rare = (next(i for i in range(9000, 9100) if not is_held_out(i)), "quomodo vales hodie amice care", "la", "a", 1)
    kept = kept_ids(frame, known + odd + [rare])
    assert not kept & {r[0] for r in odd}
    assert len(kept & {r[0] for r in known}) >= 0.98 * len(known)


def test_one_odd_labelled_row_does_not_lift_the_bound():
    rng = random.Random(6)
    samples = {k: [r[1] for r in corpus(rng) if r[2] == k] for k in SYLLABLES}
    bound = language_id.fit(samples).limit
    noise = strangers(rng)[0][1]
    assert language_id.fit(samples | {"aa": [noise, *samples["aa"][1:]]}).limit < 1.2 * bound  # index 0 is one that calibrates
