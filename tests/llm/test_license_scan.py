import random

import pytest

from tessera.llm import license_scan

MIT = license_scan.LICENSES["MIT-notice"]


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string")


def test_statements_and_noise(spark):
    texts = [None, "", "  ...", "Released under the MIT License.", "x y z\nRELEASED under, the MIT license! and on", "Licensed under CC BY-NC 4.0.", "released under the mit", "word " * 3000 + "This work is licensed under the GNU General Public License, version 3." + " tail" * 2000]
    got = {(r["doc_id"], r["license"]): r for r in license_scan.scan(rows_of(spark, texts)).collect()}
    assert set(got) == {(3, "MIT"), (4, "MIT"), (5, "CC-BY-NC-4.0"), (7, "GPL-3.0")}
    assert all(r["containment"] == 1.0 for r in got.values()) and 2980 < got[7, "GPL-3.0"]["first_word"] <= 3000


def test_partial_copies(spark):
    r = random.Random(2)
    words = MIT.split()
    cut = " ".join(words[: int(len(words) * 0.85)])
    half = " ".join(words[: len(words) // 2])
    noise = lambda n: " ".join(f"n{r.randrange(9999)}" for _ in range(n))
    texts = [f"{noise(100)} {cut} {noise(90)}", f"{noise(30)} {half} {noise(5)}"] + [f"{noise(r.randrange(200))} {MIT} {noise(50)}" for _ in range(40)]
    got = {(x["doc_id"], x["license"]): x["containment"] for x in license_scan.scan(rows_of(spark, texts)).collect()}
    assert 0.75 <= got.pop((0, "MIT-notice")) < 1 and len(got) == 40 and {k for _, k in got} == {"MIT-notice"}


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "Released under the MIT License.")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_windows"]) for r in license_scan.scan(df).collect()) == [("1", 1), ("None", 1)]
    assert license_scan.scan(df.limit(0)).count() == 0


def test_templates_without_words_are_refused(spark):
    with pytest.raises(ValueError):
        license_scan.scan(rows_of(spark, ["a"]), {"none": " . "})


@pytest.mark.parametrize("m", range(1, 200))
def test_classes(m):
    c = license_scan.width_class(m)
    assert m <= c <= max(m * 1.25 + 1, m + 1) and license_scan.width_class(c) == c


def test_versions_tags_and_short_statements(spark):
    texts = {
        "Licensed under the MIT License": {"MIT"},
        "see LICENSE; SPDX-License-Identifier: MIT\nnext": {"MIT"},
        "SPDX-License-Identifier: LGPL-2.1-or-later": {"LGPL-2.1"},
        "distributed under the GNU General Public License, version 2, by us": {"GPL-2.0"},
        "either way the GNU General Public License v3 applies": {"GPL-3.0"},
        "covered by the GNU Lesser General Public License version 2.1 here": {"LGPL-2.1"},
        "This file is subject to the terms of the Mozilla Public License, v. 2.0.": {"MPL-2.0"},
        "a Creative Commons Attribution-ShareAlike 4.0 International License": {"CC-BY-SA-4.0"},
        "you can modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; ...": {"LGPL-notice"},
        "under the mitigating license of poets, a general public licensed version 3": set(),
    }
    got: dict[int, set[str]] = {}
    for x in license_scan.scan(rows_of(spark, list(texts))).collect():
        got.setdefault(x["doc_id"], set()).add(x["license"])
    assert [got.get(i, set()) for i in range(len(texts))] == list(texts.values())
