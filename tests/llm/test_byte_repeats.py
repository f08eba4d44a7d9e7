"""Substring dedup by bytes against a plain search over all windows."""

import random

import pytest
import xxhash

from mapweave.llm import byte_repeats, collection_bwt

SCHEMA = "doc_id long, text string"


def plain_removal(rows, window):
    def places(doc, text):
        data = (text or "").encode()
        print_ = xxhash.xxh64_intdigest(data, 42) if text is not None else 42
        print_ -= (print_ >= 1 << 63) << 64
        return data, [((doc is not None, doc or 0, i, print_), data[i:i + window]) for i in range(len(data) - window + 1)]

    first = {}
    for doc, text in rows:
        for place, content in places(doc, text)[1]:
            first[content] = min(first.get(content, place), place)
    out = []
    for doc, text in rows:
        data, windows = places(doc, text)
        gone = [False] * len(data)
        for (*_, i, _), content, place in ((p, c, p) for p, c in windows):
            if first[content] < place:
                gone[i:i + window] = [True] * window
        spans = sum(g and not before for g, before in zip(gone, [False, *gone]))
        out.append((doc, len(data), sum(gone), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return sorted(out, key=repr)


def removed(spark, rows, **how):
    # Other columns, with names that the operator uses itself.
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'q' as print", "1 as doc", "2 as at").repartition(5)
    found = byte_repeats.remove_repeats(frame, **how).collect()
    return sorted(((*r[:4], bytes(r[4])) for r in found), key=repr)


def corpus(seed):
    rng = random.Random(seed)

    def words(n):
        return " ".join(rng.choice(["ba", "ké", "lo", "zu", "Xi"]) + rng.choice(["na", "ro", "té", "wu"]) for _ in range(n))

    shared, rows = [words(20) for _ in range(6)], []
    for i in range(120):
        parts = [words(rng.randrange(25)) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(1, rng.choice(shared))
        if rng.random() < 0.1:
            parts.append("-" * rng.randrange(50, 400))
        if rng.random() < 0.1:
            parts.append("ab " * rng.randrange(20, 100))
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, rows[3 * i][1]) for i in range(20)]  # copies
    rows += [(5, rows[5][1])] * 3 + [(7, shared[0] + words(30)), (7, shared[0] + words(9))]  # repeated rows and ids
    rows += [(None, words(60))] * 3 + [(None, shared[1]), (300, None), (301, ""), (302, "é" * 49 + "a"), (303, "é" * 49 + "a")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("how", [{}, {"sorted_contents": 1}, {"window": 30, "anchor": 12}, {"window": 20, "anchor": 20, "sorted_contents": 3}])
def test_removal(spark, how):
    rows = corpus(len(how))
    assert removed(spark, rows, **how) == plain_removal(rows, how.get("window", 100))


def test_a_phrase_in_every_text_and_long_texts(spark, monkeypatch):
    rng = random.Random(4)
    line = "the same forty bytes stand in every text, always."
    texts = ["".join(rng.choice("abcdefgh") for _ in range(200)) + line + "".join(rng.choice("abcdefgh") for _ in range(200)) for _ in range(60)]
    rows = list(enumerate(texts)) + [(100, "".join(texts[:9])), (101, "x" * 3000), (102, "".join(texts[5:20]))]
    assert removed(spark, rows) == plain_removal(rows, 100)
    monkeypatch.setattr(byte_repeats, "SLICE_BYTES", 700)
    parts = list(byte_repeats._segments(["", "a" * 99, "b" * 100, "c" * 1500], 100))
    assert [(i, s, len(p)) for i, s, p in parts] == [(2, 0, 100), (3, 0, 799), (3, 700, 799), (3, 1400, 100)]


def test_empty_table_and_bad_sizes(spark):
    assert removed(spark, []) == []
    with pytest.raises(ValueError):
        byte_repeats.repeats(spark.createDataFrame([], SCHEMA), 100, 10)


def test_sorted_suffixes():
    rng = random.Random(3)
    for turn in range(200):
        letters = b"ab\x00\xff" if turn % 2 else b"abc"
        strings = [bytes(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 9, 30]))) for _ in range(rng.randrange(1, 7))]
        want = sorted((s[i:], k, i) for k, s in enumerate(strings) for i in range(len(s) + 1))
        string, start, lcp = collection_bwt.sorted_suffixes(strings)
        assert list(zip(string.tolist(), start.tolist())) == [(k, i) for _, k, i in want]
        for i, n in enumerate(lcp.tolist()):
            a, b = (want[i - 1][0], want[i][0]) if i else (b"", b"")
            assert n == next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
