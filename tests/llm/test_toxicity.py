from __future__ import annotations

import random
import zlib

from navpulse.llm import toxicity as T


def near(a: str, b: str) -> bool:
    """Within one edit."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def test_automaton_is_the_edit_distance():
    rnd = random.Random(1)
    words = ["idiot", "moron", "scum", "trash", "stupid", "mor"]
    lexicon = T.Lexicon(words, ["réeu", "achl"])
    for _ in range(4000):
        w = list(rnd.choice([*words, "réeuxpa", "achlich", "xyz"]))
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(w) + 1)
            w[at : at + rnd.randrange(2)] = rnd.choice(["", "a", "i", "1", "é"])
        w = "".join(w)
        if w in words:
            want = T.EXACT
        elif w.startswith(("réeu", "achl")):
            want = T.STEM
        else:
            want = T.NEAR if any(len(t) >= T.FUZZY and near(w, t) for t in words) else 0
        assert lexicon.kind(w) == want, w


def test_windows_tell_quotation_from_abuse():
    lexicon = T.Lexicon(["idiot"], [])
    names = T.FEATURES
    abuse = dict(zip(names, T.features("you idiot", lexicon)))
    quote = dict(zip(names, T.features('they wrote "what an idiot" yesterday', lexicon)))
    told = dict(zip(names, T.features("the word idiot is old", lexicon)))
    leet = dict(zip(names, T.features("you id1ot", lexicon)))
    assert abuse["exact"] > 0 and abuse["addressed"] > 0 and abuse["quoted"] == 0
    assert quote["quoted"] > 0 and quote["exact"] == 0 and told["quoted"] > 0
    assert leet["near"] > 0 and leet["exact"] == 0


def rows(seed: int, n: int = 600):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("thenadoris") for _ in range(rnd.randrange(2, 9))) for _ in range(400)]
    bad = ["grobnik", "zulptar", "wicklom"]
    docs, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randrange(5, 60))]
        toxic = int(i % 6 == 0)
        for _ in range(toxic * rnd.randrange(1, 4)):
            text.insert(rnd.randrange(len(text)), rnd.choice(bad))
        docs.append((i, " ".join(text), "en"))
        labels.append((i, toxic))
    return docs, labels


def test_learns_and_catches_misspellings(spark):
    docs, labels = rows(2)
    extra = [(1000, "the grobnlk an or", "en"), (1001, None, "en"), (1002, "", None), (None, "thes ndat", "en"), (3, docs[3][1], "again")]
    labels += [(None, 1), (7777, 1), (5, None)]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, score string")
    l = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = T.toxicity(d, l).collect()
    assert len(got) == len(docs) + len(extra)
    truth = dict(labels[: len(docs)])
    for r in got:
        i = r["doc_id"]
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        if i in truth:
            assert r["predicted"] == truth[i]
        elif i == 1000:
            assert r["predicted"] == 1
        else:
            assert r["predicted"] == 0
    assert T.toxicity(d.where("false"), l).collect() == []


def test_without_labels_or_with_one_kind(spark):
    d = spark.createDataFrame([(1, "a b"), (4, "c")], "doc_id long, text string")
    schema = "doc_id long, toxic int"
    assert {r["score"] for r in T.toxicity(d, spark.createDataFrame([], schema)).collect()} == {0.0}
    assert {r["score"] for r in T.toxicity(d, spark.createDataFrame([(1, 1), (4, 1)], schema)).collect()} <= {1.0, 0.0}


def test_sample_is_bounded_and_never_held_out(spark):
    docs, labels = rows(3, 200)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    l = spark.createDataFrame(labels, "doc_id long, toxic int")
    ids = [r["doc_id"] for r in T.sample(d, l, 40).collect()]
    assert len(ids) == 40 and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in ids)
