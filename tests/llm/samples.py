"""Texts for the tests of this folder."""

import random


def prose(seed, n, words="the a of river stone lamp quiet amber field window letter north paper glass morning"):
    rng = random.Random(seed)
    vocabulary = words.split() + [f"{rng.choice('bdfgklm')}{rng.choice('aeiou')}{rng.choice('nrst')}{i % 97}x" for i in range(200)]
    out = [rng.choice(vocabulary) for _ in range(n)]
    return " ".join(out)


def odd_texts():
    """(doc_id, text, source): nulls, empty, blank, one word, very long, repeated, without an id."""
    base = prose(1, 120)
    return [
        (1, base, "a"), (2, None, "a"), (3, "", "b"), (4, " \n\t\n ", None), (5, "word", "b"), (6, prose(2, 30000), "c"), (7, base, "a"),
        (8, base + " tail", "c"), (8, base + " tail", "c"), (9, "x" * 50000, None), (None, base, "a"), (None, None, None),
        (10, "one\ntwo\nthree\n\nfour", "b"), (11, "one\ntwo\nthree", "c"), (12, "same same same same", None), (13, prose(3, 200).replace(" ", "\n"), "a"),
    ]
