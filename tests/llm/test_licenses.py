import math
from collections import Counter

import numpy as np
import pytest

from docketmill.llm import licenses

MIT, APACHE, GPL = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."
FILES = [
    (1, "LICENSE", GPL), (2, "a/LICENSE.txt", MIT), (3, "a/b/code.py", "some words without any notice"), (4, "a/b/other.py", f"x y z\n{APACHE}\nmore words here to be the text of it"),
    (5, "c/d/e/f.txt", "plain"), (6, "a/b/c/COPYING", APACHE + " " + "and other words " * 30), (7, "a/b/c/deep/er/x", "nothing"), (8, None, "no path"), (9, "a/x", None), (10, "a/y", ""),
    (11, "a/b/c/z", "in a long line. " * 50 + "As said, " + MIT + " And so on " * 50), (12, "ab/c", "not under a"), (13, "q/r", MIT), (14, "q/s/t", "below a file that is licence text only"),
    (15, "a/two", f"{GPL}\n\n{MIT}"), (15, "a/two", f"{GPL}\n\n{MIT}"), (None, "a/b/k", "license permission copyright released but nothing more"), (16, "a//b///n.txt", "odd path"),
]


@pytest.fixture(scope="module")
def got(spark):
    files = spark.createDataFrame(FILES, "doc_id long, path string, text string").repartition(3)
    return {r.doc_id: r for r in licenses.scan(files).collect()}


def test_notices_files_and_inheritance(got):
    origin = {k: (r.license, r.origin, r.licensed_at) for k, r in got.items()}
    assert origin[1] == ("GPL-3.0", "file", None) and origin[2] == ("MIT", "file", None)
    assert origin[3] == ("MIT", "inherited", "a") and origin[4] == ("Apache-2.0", "header", None)
    assert origin[5] == ("GPL-3.0", "inherited", "") and origin[6] == ("Apache-2.0", "file", None)
    assert origin[7] == ("Apache-2.0", "inherited", "a/b/c") and origin[8] == ("GPL-3.0", "inherited", "")
    assert origin[9] == origin[10] == ("MIT", "inherited", "a")
    assert origin[11] == ("MIT", "header", None) and origin[12] == ("GPL-3.0", "inherited", "")
    assert origin[13] == ("MIT", "file", None) and origin[14] == ("MIT", "inherited", "q")
    assert origin[15][1] == "file" and origin[None][:2] == ("MIT", "inherited") and origin[16] == ("MIT", "inherited", "a")


def test_row_for_row(spark):
    files = spark.createDataFrame(FILES, "doc_id long, path string, text string")
    assert licenses.scan(files).count() == len(FILES)
    assert licenses.scan(files.limit(0)).collect() == []


def test_cosine_against_plain_vectors():
    idf = {t: 1 + len(t) / 10 for t in licenses.VOCABULARY} | {"": 3.0}
    detector = licenses.Detector(idf)

    def cosine(a, b):
        a, b = Counter(licenses.terms(a)), Counter(licenses.terms(b))
        w = lambda t: idf.get(t, idf[""])
        norm = lambda c: math.sqrt(sum((n * w(t)) ** 2 for t, n in c.items()))
        return sum(a[t] * b[t] * w(t) ** 2 for t in a) / norm(a) / norm(b)

    for unit in (MIT, APACHE, GPL, "Licensed under CC BY-NC 4.0.", "released with permission of nobody"):
        want = max((cosine(unit, n), name) for name, notices in licenses.TEMPLATES.items() for n in notices)
        assert detector.best(unit) == (pytest.approx(want[0]), want[1])


EVEN = {t: 2.0 for t in licenses.VOCABULARY} | {"": 3.0}


def test_every_template_is_found_and_spans_are_right():
    detector = licenses.Detector(EVEN)
    for name, notices in licenses.TEMPLATES.items():
        for n in notices:
            for text in (f"First line here\n\n{n}\n\nlast line", f"words before it {n} and words after it", f"First. {n.replace(' ', chr(10) + ' * ')}"):
                found = detector(text)
                assert [f["license"] for f in found] == [name] and found[0]["score"] > 0.99, (n, found)
                got = licenses.terms(text[found[0]["start"] : found[0]["end"]])
                assert [t for t in got if t in licenses.terms(n)] == licenses.terms(n)


def test_against_all_parts_of_random_texts():
    """Every line, sentence, paragraph, whole text and stretch of a template's size is compared by plain vectors."""
    import random
    import re

    rnd = random.Random(4)
    pool = sorted(licenses.VOCABULARY)[::3] + ["MIT", "Released", "under", "the", "License", "zork", "blub"] * 6
    idf = {t: 1 + len(t) / 5 for t in licenses.VOCABULARY} | {"": 3.0}
    detector, hits = licenses.Detector(idf), 0
    notices = [n for v in licenses.TEMPLATES.values() for n in v]
    for _ in range(25):
        text = "".join((rnd.choice(notices) if rnd.random() < 0.12 else rnd.choice(pool)) + rnd.choice([" ", " ", " ", ". ", "\n", "\n \n", "! "]) for _ in range(rnd.randint(1, 30)))
        found = list(licenses.TERM.finditer(text.lower()))
        places = {(0, len(found))}
        for pattern in (r"\n", r"[.!?](?=\s)|\n[^\S\n]*\n", r"\n[^\S\n]*\n"):
            edges = [0, *(m.end() for m in re.finditer(pattern, text)), len(text) + 1]
            for x, y in zip(edges, edges[1:], strict=False):
                inside = [i for i, m in enumerate(found) if x <= m.start() < y]
                if inside:
                    places.add((inside[0], inside[-1] + 1))
        scored = []
        for name, v, size in detector.templates:
            own = places | {(i, min(i + size, len(found))) for i in range(max(1, len(found) - size + 1))}
            for a, b in own:
                u = detector.vector([m[0] for m in found[a:b]])
                score = round(sum(x * u.get(t, 0) for t, x in v.items()), 9)
                if score >= licenses.COSINE:
                    scored.append((-score, a - b, a, name, b))
        taken = []
        for score, _, a, name, b in sorted(scored):
            if all(b <= x or a >= y for x, y, *_ in taken):
                taken.append((a, b, name, -score))
        want = [(name, found[a].start(), found[b - 1].end(), pytest.approx(min(1, score))) for a, b, name, score in sorted(taken)]
        assert [(f["license"], f["start"], f["end"], f["score"]) for f in detector(text)] == want
        hits += len(want)
    assert hits > 20


def test_notices_without_a_word_of_licensing_and_in_any_setting():
    detector = licenses.Detector(EVEN)
    names = lambda t: [f["license"] for f in detector(t)]
    assert names("x y z\nContent under CC BY 4.0, as ever") == ["CC-BY-4.0"] and names("SPDX-License-Identifier: MPL-2.0") == ["MPL-2.0"]
    assert names("# Licensed under\n# the Apache\n# License, Version 2.0\n" + "code " * 3000) == ["Apache-2.0"]
    assert names("permission was released; no license here, the public domain of words") == []
    assert names("İ" * 30 + " Released under the MIT License") == ["MIT"] and detector("İ Released under the MIT License")[0]["start"] == 2


def test_a_notice_of_two_licences_alike_is_the_first_by_name():
    idf = {t: 2.0 for t in licenses.VOCABULARY} | {"": 3.0}
    detector = licenses.Detector(idf)
    detector.templates = [(n, v, s) for n, v, s in detector.templates if n == "MIT"][:1] * 2
    detector.templates[0] = ("AAA", *detector.templates[0][1:])
    detector.mass, detector.dots = (np.repeat(x[[next(i for i, t in enumerate(licenses.Detector(idf).templates) if t[0] == "MIT")]], 2, axis=0) for x in (detector.mass, detector.dots))
    assert [f["license"] for f in detector("Licensed under the MIT License")] == ["AAA"]


def test_long_texts_take_time_in_proportion_to_their_length():
    import time

    detector = licenses.Detector(EVEN)
    for text in ("licensed words permission of foo bar " * 30_000, "Released under the MIT License and " * 30_000, "x" * 1_000_000, "\n" * 1_000_000):
        began = time.time()
        found = detector(text)
        assert time.time() - began < 12 and len(found) == (30_000 if "MIT" in text else 0)


def test_frequencies_are_over_all_texts(spark):
    frame = spark.createDataFrame([("the mit the",), (None,), ("mit license",), ("x",)], "text string").repartition(3)
    idf = licenses.weights(frame)
    assert idf["mit"] == pytest.approx(math.log(5 / 3) + 1) and idf[""] == pytest.approx(math.log(5) + 1)


def test_clashing_columns(clashing, docs):
    from pyspark.sql import functions as F

    rows = lambda d: sorted(map(str, licenses.scan(d.withColumn("path", F.col("source"))).collect()))
    assert rows(clashing.withColumns({c: F.lit(1) for c in ("directory", "named", "found", "best", "license", "of")})) == rows(docs)


def test_members_of_a_family_are_told_apart():
    idf = dict.fromkeys(licenses.VOCABULARY, 1.0) | {"": 1.0}
    find = licenses.Detector(idf)
    shared = licenses.PARAGRAPHS["BSD-2-Clause"]
    numbered = "1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce it.\n"
    two = f"{shared[0]}:\n\n{numbered}\n{shared[1]}"
    three = f"{shared[0]}:\n\n{numbered}3. {licenses.PARAGRAPHS['BSD-3-Clause'][0]}\n\n{shared[1]}"
    names = lambda text: {x["license"] for x in find(text)}
    assert names(two) == {"BSD-2-Clause"} and names(three) == {"BSD-3-Clause"}
    assert names(f"Licensed under the BSD 3-Clause License.\n\n{two}") == {"BSD-3-Clause"}
    gnu = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    cases = {"LGPL-2.1": ("Lesser General Public License", "2.1"), "GPL-2.0": ("General Public License", "2"), "GPL-3.0": ("General Public License", "3"), "LGPL-3.0": ("Lesser General Public License", "3"), "AGPL-3.0": ("Affero General Public License", "3")}
    assert {k: names(gnu.format(*v)) for k, v in cases.items()} == {k: {k} for k in cases}
