"""Winnowing against plain window matching."""

import re

from rows import DOCS, docs, prose

from kifulake.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        n = min(len(v), 13)
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))


def compare(spark, d, items):
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    got = decontaminate.find(d, bench).collect()
    key = lambda i: (i is not None, i or 0)
    have = sorted((key(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated, r.n_items) for r in got)
    want = []
    for r in d.collect():
        n, hit, found, bad = brute(r.text, items)
        want.append((key(r.doc_id), n, hit, found, bad, len(found)))
    assert have == sorted(want)


def test_awkward(spark):
    base = prose(5, 90, 80)
    items = [
        (1, base), (2, " ".join(base.split()[30:43])), (3, " ".join(base.split()[30:42]) + " other"), (10, base.upper()), (10, base), (4, "one"), (5, "a a"), (6, None), (7, " !! "),
        (None, " ".join(prose(3, 4000, 900).split()[100:130])), (8, " ".join(["x"] * 15)), (9, "ab cd ab cd ab"), (11, prose(77, 30)), (12, "日本語の文" * 3),
    ]
    compare(spark, docs(spark), items)


def test_every_long_share_is_found(spark):
    """Spans of exactly 13 shared words, at edges and inside, among words that repeat."""
    v = prose(40, 60, 9).split()
    texts = [prose(100 + i, i % 11, 9) + " " + " ".join(v[i : i + 13]) + " " + prose(200 + i, i % 7, 9) for i in range(0, 45, 3)]
    compare(spark, docs(spark, texts, repeat=False), [(1, " ".join(v)), (2, " ".join(v[20:50]))])


def test_empty(spark):
    none = spark.createDataFrame([], ITEMS)
    assert decontaminate.find(spark.createDataFrame([], DOCS), none).count() == 0
    compare(spark, docs(spark), [])


def phrase(n, seed):
    """Items that all hold one common phrase, each among words of its own, and texts with some of their windows."""
    common = "which of the following is best described as".split()
    items, texts = [], []
    for i in range(n):
        before, after = prose(seed + 2 * i, 9, 400).split(), prose(seed + 2 * i + 1, 9, 400).split()
        items.append((i, " ".join(before + common + after)))
        if i % 3 == 0:
            texts.append(" ".join(before[i % 9 :] + common + after[: i % 7]))  # a window of 13 words, or less than one
            texts.append(prose(5 * i, 6, 400) + " " + " ".join(common) + " " + prose(7 * i, 6, 400))
    return items, texts


def test_common_grams_with_many_contexts(spark):
    items, texts = phrase(60, 9000)
    compare(spark, docs(spark, texts, repeat=False), [*items, (None, items[0][1]), (99, items[3][1].upper())])


def test_common_grams_meet_no_foreign_context(spark, monkeypatch):
    """The extension sees only grams with few contexts."""
    items, texts = phrase(120, 20000)
    seen = []
    extend = decontaminate._extend
    monkeypatch.setattr(decontaminate, "_extend", lambda pairs, keys: seen.append(pairs.count()) or extend(pairs, keys))
    compare(spark, docs(spark, texts, repeat=False), items)
    assert seen[0] <= decontaminate.FAN * 9 * len(texts)
    monkeypatch.setattr(decontaminate, "FAN", 10**9)
    compare(spark, docs(spark, texts, repeat=False), items)
    assert seen[1] > 4 * seen[0]
