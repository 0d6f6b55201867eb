"""Licence scans: windows against a plain version, and long texts full of notices."""

import random
import re
import time
from collections import Counter

import pytest

from drivespark.llm.licenses import TEMPLATES, scan_licenses, template_table


def dice(a, b):
    x, y = Counter(zip(a, a[1:], strict=False)), Counter(zip(b, b[1:], strict=False))
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))


def plain(text, template):
    """The best dice of lines, the whole text and all windows of the template's length."""
    words = lambda s: re.findall("[a-z0-9]+", s.lower())
    own, t = words(text), words(template)
    spans = [own, *map(words, text.split("\n"))] + [own[i : i + len(t)] for i in range(len(own) - len(t) + 1)]
    return max([dice(s, t) for s in spans if len(s) >= 2], default=0.0)


def test_windows_equal_a_plain_version(spark):
    rng, templates = random.Random(2), {"abab": "a b a b c a b", "run": "x x x x x", "long": " ".join("pqrstu"[i * i % 6] for i in range(14))}
    made = []
    for _ in range(150):
        t = rng.choice(list(templates.values())).split()
        words = [rng.choice("abcxpqrstu") for _ in range(rng.randint(0, 9))]
        for _ in range(rng.randint(1, 3)):
            own = list(t)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice("abcx")
            words += own + [rng.choice("abcx") for _ in range(rng.randint(0, 3))]
        made.append("".join(w + rng.choice(["  ", " ", "\n"]) for w in words))
    rows = list(enumerate(made)) + [(0, made[0]), (900, None), (901, ""), (902, "a")]
    got = {(r.doc_id, r.license): (r.dice, r.start, r.n_words) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), template_table(spark, templates)).collect()}
    want = {(i, name): d for i, text in enumerate(made) for name, t in templates.items() if (d := plain(text, t)) >= 0.8}
    assert {k: v[0] for k, v in got.items()} == pytest.approx(want)
    for (i, name), (d, start, n) in got.items():
        own = re.findall("[a-z0-9]+", made[i].lower())[start : start + n]
        assert dice(own, templates[name].split()) == pytest.approx(d)


def test_repeated_notices_take_linear_time(spark):
    took = []
    for n in (200, 2_000):  # 0.1 and 1.1 MB
        docs = spark.createDataFrame([(1, f"{TEMPLATES['MIT-notice']} end " * n), (2, "nothing here")], "doc_id long, text string")
        began = time.monotonic()
        rows = scan_licenses(docs).collect()
        took.append(time.monotonic() - began)
        assert [(r.doc_id, r.license, r.dice) for r in rows] == [(1, "MIT-notice", 1.0)]
    assert took[1] < 10 * took[0] + 10
