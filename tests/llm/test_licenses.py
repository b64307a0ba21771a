from __future__ import annotations

from navpulse.llm import licenses as L

MIT = L.SENTENCES["mit-grant"] + "\n\n" + L.SENTENCES["mit-notice"] + ".\n\n" + L.SENTENCES["mit-as-is"] + "."


def names(text: str) -> list[str]:
    return [r[0] for r in L.matched(L.known_sentences(text), 2)]


def brute(text: str) -> list[str]:
    """Single-line notices by plain comparison of whole lines."""
    single = {L.normalised(L.SENTENCES[rule[0]]): licence for licence, rule in L.RULES if len(rule) == 1}
    return [single[L.normalised(x)] for x in text.split("\n") if L.normalised(x) in single]


def test_every_known_sentence_has_a_hint():
    assert len(L.KNOWN) == len(L.SENTENCES)
    assert all(L.HINT.search(s) for s in L.SENTENCES.values())
    assert {s for _, rule in L.RULES for s in rule} <= set(L.SENTENCES)


def test_each_sentence_is_recognised():
    for name, sentence in L.SENTENCES.items():
        if name in ("gpl-free", "apache-copy", "gpl2-version", "gpl2-terms", "gpl2-free"):
            continue
        assert [s[2] for s in L.known_sentences("Some text.\n" + sentence + ".\nMore.")] == [name], name


def test_rules_are_ordered_and_longest_first():
    assert names("Intro.\n" + MIT) == ["MIT"]
    assert names(MIT.replace(L.SENTENCES["mit-notice"], "Something else")) == []
    bsd = [L.SENTENCES[x] + "." for x in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")]
    assert names("\n".join(bsd)) == ["BSD-3-Clause"] and names("\n".join(bsd[:3])) == ["BSD-2-Clause"]
    assert names("\n".join([bsd[1], bsd[0], bsd[2]])) == []
    wrapped = MIT.replace(" a copy", "\n    a copy").replace(" in all", "\nin all")
    assert names(wrapped) == ["MIT"]
    assert names("SPDX-License-Identifier: BSD-3-Clause") == ["spdx:bsd-3-clause"]


def test_scan(spark):
    lines = ["Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "prose about a licence to kill.", "x y.",
             "Licensed under the Apache License, Version 2.0."]
    rows = [(i, "\n".join(lines[(i * k) % 5] for k in range(i % 4 + 1)), "z") for i in range(30)]
    rows += [(100, None, "z"), (101, "", "z"), (0, rows[0][1], "again"), (102, "no " * 50_000 + "\n" + lines[1], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    got = L.licenses(df).collect()
    assert len(got) == len(rows)
    want = {i: brute(t or "") for i, t, _ in rows}
    for r in got:
        assert [x["license"] for x in r["licenses"]] == want[r["doc_id"]]
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        for x in r["licenses"]:
            assert L.normalised(text[x["start"] : x["end"]]) in L.KNOWN
    assert L.licenses(df.where("false")).collect() == []


def test_named_holders_projects_and_further_licences():
    bsd = [L.SENTENCES[x] + "." for x in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")]
    for holder in ("Google Inc.", "the <organization>", "Foo Ltd", "the University of\n    California, Berkeley"):
        text = "\n".join(bsd).replace("the copyright holder", holder)
        assert names(text) == ["BSD-3-Clause"], holder
    assert names("Foo is licensed under the Apache License, Version 2.0.") == ["Apache-2.0"]
    assert names("Foo is not licensed under the MIT License.") == []
    assert names("Foo Bar is licensed under the GNU Affero General Public License, version 3.") == ["AGPL-3.0-only"]
    hope = " is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied\n" \
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU {} General Public License for more details.\n"
    terms = " you can redistribute it and/or modify it under the\nterms of the GNU {} General Public License as published by" \
        " the Free Software Foundation{} either version {} of the License, or (at your option) any later version.\n\n"
    lgpl = "This library is free software;" + terms.format("Lesser", ";", "2.1") + "This library" + hope.format("Lesser")
    assert names(lgpl) == ["LGPL-2.1-or-later"]
    for kind, licence in (("Lesser", "LGPL"), ("Affero", "AGPL")):
        text = "Foo is free software:" + terms.format(kind, ",", "3") + "Foo" + hope.format(kind)
        assert names(text) == [licence + "-3.0-or-later"]
    assert names(L.SENTENCES["epl2-header"] + " which is available at https://www.eclipse.org/legal/epl-2.0/") == ["EPL-2.0"]
    zlib = [L.SENTENCES["zlib-" + x] for x in ("as-is", "grant", "origin", "altered", "notice")]
    assert names("{}. {}\n\n1. {}; you must not claim.\n2. {}.\n3. {}.".format(*zlib)) == ["Zlib"]
    text = "Read\nThis work is licensed under the GNU General Public License, version 3.\n"
    assert [s[0] for s in L.known_sentences(text)] == [5]


def test_many_licence_lines_take_time_in_proportion():
    import time

    text = "Licensed under the MIT license.\nLicensed under the Apache License, Version 2.0.\n"
    spent = []
    for n in (500, 4000):
        began = time.perf_counter()
        sentences = L.known_sentences(text * n)
        made = L.matched(sentences, 2)
        spent.append(time.perf_counter() - began)
        assert len(sentences) == 2 * n and made
    assert spent[1] < 8 * spent[0] * 4  # it was the square: 64 times
    names = [(i, i + 1, f"n{i}") for i in range(100_000)]
    began = time.perf_counter()
    assert L.matched(names, 2) == []
    assert time.perf_counter() - began < 5
