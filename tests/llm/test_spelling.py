from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from navpulse.llm import spelling as S


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, typo):
    seen = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if typo and h % typo == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def brute_forms(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("alphabet, lengths", [("ab", (6, 9)), ("abé", (6, 8)), ("abcdefgÿ×", (6, 7))])
@pytest.mark.parametrize("index_slice, query_slice", [(4096, 16384), (70, 90)])
def test_variants_as_brute_force(spark, alphabet, lengths, index_slice, query_slice):
    rnd = random.Random(len(alphabet))
    words = {"".join(rnd.choice(alphabet) for _ in range(rnd.randint(*lengths))): rnd.choice([5, 6, 30, 150, 4000]) for _ in range(600)}
    for w in list(words)[:80]:
        i = rnd.randrange(len(w))
        words[w[:i] + rnd.choice(alphabet) + w[i:]] = rnd.choice([5, 25, 5000])
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(S.spelling_variants(df, 5, index_slice, query_slice)) == brute_forms(words)


def test_one_hot_part(spark):
    words = {"aaaaaaa" + "".join(x): 5 + i % 40 for i, x in enumerate(zip("abcdefgh" * 8, "abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrst", "ab" * 40))}
    words["zzzzzz"] = 7
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(S.spelling_variants(df, 5, 10, 10)) == brute_forms(words)


def test_chain_of_forms(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "abbbbbb": 80000}
    got = found(S.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute_forms(words) and got["aaaaaa"][1] == "abbbbbb"


def test_words_of_documents(spark):
    rnd = random.Random(3)
    base = ["Straße", "ÀÉÎÖÜß", "letters", "Letters", "été", "abcdef", "éééééé", "ab-cdefgh", "x" * 500, "don't", "naïvely1two"]
    rows = [(i, " ".join(rnd.choice(base) for _ in range(40))) for i in range(60)] + [(1, rnd.choice(base) * 9)] * 4
    rows += [(None, "letters " * 30), (99, None), (98, ""), (97, "longer " * 20_000)]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    for typo, flush in ((None, 10), (3, 2), (199, 1 << 18)):
        got = {r["word"]: r["n"] for r in S.vocabulary(df, typo_every=typo, flush=flush).collect()}
        assert got == brute_words(rows, typo)
    words = S.vocabulary(df, typo_every=3)
    assert found(S.spelling_variants(words)) == brute_forms(brute_words(rows, 3))
    assert S.spelling_variants(S.vocabulary(df.where("false"))).collect() == []
