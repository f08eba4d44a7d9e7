import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from mapweave.operators import evidence as E
from mapweave.operators import textindex
from mapweave.operators.textindex import TextIndex
from mapweave.sources.tables import stage


def reference_chunks(text, size=1000, overlap=200):
    out, start = [], 0
    while start < len(text):
        chunk = text[start:start + size]
        if chunk.strip():
            out.append(chunk)
        start += size - overlap
    return out


def test_chunks_match_the_loop(spark):
    rnd = random.Random(1)
    texts = ["", " ", "x", "a" * 800, "b" * 801, "é😀\n" * 700, "c" * 1000 + " " * 3000 + "d" * 500, " \x1c" * 600,
             "".join(rnd.choice("ab \n\t") for _ in range(5000))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for size, overlap in ((1000, 200), (10, 0), (7, 5)):
        got = {}
        for r in E.chunks(df, size=size, overlap=overlap).orderBy("i", "chunk_index").collect():
            got.setdefault(r["i"], []).append(r["content"])
        for i, text in enumerate(texts):
            assert got.get(i, []) == reference_chunks(text, size, overlap), (i, size, overlap)


def vectors(spark, n, dim=8, seed=0):
    rnd = random.Random(seed)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(5)] + [(n + 5, [0.0] * dim), (n + 6, None)]
    return rows, spark.createDataFrame(rows, "id bigint, vector array<float>")


def distance(a, b):
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)) if a else 0
    return 1 - sum(x * y for x, y in zip(a, b)) / norm if norm else math.inf


def test_nearest_matches_brute_force_on_both_paths(spark):
    rows, corpus = vectors(spark, 120)
    queries = spark.createDataFrame([(f"q{i}", rows[i][1]) for i in range(9)], "query_id string, vector array<float>")
    shipped = {(r["query_id"], r["rank"]): r["id"] for r in E.nearest(corpus, queries, 6).collect()}
    tiled = {(r["query_id"], r["rank"]): r["id"] for r in E.nearest(corpus, queries, 6, tile=2).collect()}
    want = {}
    for i in range(9):
        best = sorted(rows, key=lambda r: (round(distance(r[1], rows[i][1]), 6), r[0]))[:6]
        want.update({(f"q{i}", n + 1): r[0] for n, r in enumerate(best)})
    assert shipped == want == tiled


def test_unknown_distances_come_last(spark):
    rows, corpus = vectors(spark, 4)
    hits = E.search(corpus, rows[0][1], k=50).orderBy("rank").collect()
    assert len(hits) == len(rows) and [h["id"] for h in hits[-2:]] == [9, 10] and hits[-1]["distance"] is None


def test_gather_keeps_first_seen(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "b", 1), (2, "c", 2), (3, "a", 1), (3, "d", 2)], "query_id int, id string, rank int")
    assert [r["id"] for r in E.gather(hits, 3).collect()] == ["a", "b", "c"]


def plain_distances(texts, asked):
    """Cosine distances of TF-IDF vectors over exact terms, by id."""
    words = {i: [w for w in re.split("[\t\n\x0B\f\r ]+", (t or "").lower()) if w] for i, t in texts.items()}
    seen = Counter(w for ws in words.values() for w in set(ws))

    def vector(ws):
        return {w: c * math.log((len(texts) + 1) / (seen[w] + 1)) for w, c in Counter(ws).items()}

    def size(v):
        return math.sqrt(sum(x * x for x in v.values()))

    q = vector([w for w in re.split("[\t\n\x0B\f\r ]+", asked.lower()) if w])
    if not size(q):
        return {i: None for i in texts}
    vectors = {i: vector(ws) for i, ws in words.items()}
    return {i: 1 - (sum(x * v.get(w, 0) for w, x in q.items()) / size(v) / size(q) if size(v) else 0) for i, v in vectors.items()}


def test_text_search_is_exact(spark):
    rng = random.Random(6)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    texts = {i: "everywhere " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30))) for i in range(300)}
    texts |= {300: None, 301: "", 302: "Rare  RARE\trare", 303: texts[5], 304: texts[5]}
    index = TextIndex(spark.createDataFrame(list(texts.items()), "i bigint, t string"), "i", "t", block=8, hot_rows=100)
    for asked, k in [("w1 w2 rare", 5), ("rare unknown", 4), (texts[5], 7), ("everywhere w1", 400), ("w3 w3 w9 w12", 1)]:
        want = plain_distances(texts, asked)
        hits = [(h.id, h.distance) for h in index.search(asked, k).collect()]
        assert [i for i, _ in hits] == sorted(want, key=lambda i: (round(want[i], 10), i))[:k]
        assert all(abs(want[i] - d) < 1e-9 for i, d in hits)
    # The best blocks leave most others out.
    leading, adding = index.leading(index.query("everywhere rare"), 1)
    assert leading.count() == 1 and adding.count() > 10
    assert [(h.id, h.distance) for h in index.search("...", 2).collect()] == [(0, 1.0), (1, 1.0)]
    assert [(h.id, h.distance) for h in index.search("  ", 2).collect()] == [(0, None), (1, None)]


def test_text_index_counts_rows_of_one_id_as_one_text(spark):
    rows = [(1, "a b b"), (1, "A\u00a0x c"), (7, "d a"), (7, "b D"), (2, "a\x0bb"), (3, "É é a"), (4, "a")]
    index = TextIndex(spark.createDataFrame(rows, "i bigint, t string"), "i", "t", block=2)
    texts = {1: "a b b A\u00a0x c", 7: "d a b D", 2: "a b", 3: "É é a", 4: "a"}
    for asked in ("b d", "é b a\u00a0x", "c c unknown"):
        want = plain_distances(texts, asked)
        assert {h.id: round(h.distance, 9) for h in index.search(asked, 9).collect()} == {i: round(d, 9) for i, d in want.items()}


def test_a_term_of_every_text_has_no_weight(spark):
    texts = {1: "all b", 2: "all c", 3: "all"}
    index = TextIndex(spark.createDataFrame(list(texts.items()), "i bigint, t string"), "i", "t")
    assert {h.id: round(h.distance, 9) for h in index.search("all b", 3).collect()} == {1: 0.0, 2: 1.0, 3: 1.0}


def test_text_index_moves_words_in_two_shuffles(spark, monkeypatch):
    """Words are dealt out to count their texts, and once more to meet their numbers; postings travel by number."""
    plans = []

    def staged(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, name)

    monkeypatch.setattr(textindex, "stage", staged)
    index = TextIndex(spark.createDataFrame([(1, "a b"), (2, "b c")], "i bigint, t string"), "i", "t")
    moved = re.findall(r"Exchange (\w+)\(([a-z_]+)#", "\n".join(plans))
    assert sum(key == "term" for _, key in moved) <= 3 and not any(kind == "rangepartitioning" for kind, _ in moved)
    assert "term" not in index.postings.columns


def test_choose_text_prefers_full_text(spark):
    df = spark.createDataFrame([("f", "t", "b"), (None, "t", "b"), (None, None, "b")], "f string, t string, b string")
    assert [r[0] for r in df.select(E.choose_text(F.col("f"), F.col("t"), F.col("b"))).collect()] == ["f", "t", "b"]


def test_null_and_ragged_queries_keep_their_rows(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0, 1.0]), (4, None)], "id bigint, vector array<double>")
    queries = spark.createDataFrame([("none", None), ("empty", []), ("two", [1.0, 0.1]), ("three", [2.0, 2.0, 2.0])],
                                    "query_id string, vector array<double>")
    got = {}
    for r in E.nearest(corpus, queries, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["distance"] is None))
    unknown = [(1, True), (2, True), (3, True), (4, True)]
    assert got == {"none": unknown, "empty": unknown, "two": [(1, False), (2, False), (3, True), (4, True)],
                   "three": [(3, False), (1, True), (2, True), (4, True)]}
