"""Text operators against brute force on small fixtures, with the defined cases."""

import hashlib
import math
import random
import re
import textwrap
from collections import Counter
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mapweave.llm import (
    components, decontamination, features, html_text, licenses, mixing, personal_data, quality, recompression, simhash,
    substrings, topk, toxicity)

WORDS = ["ba", "bo", "ke", "li", "mu", "na", "po", "ra", "si", "tu", "Va", "zo"]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def groups(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


# ---- 1 near-duplicates -------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    pairs = [(i, j) for i, a in prints for j, b in prints if (a ^ b).bit_count() <= 3]
    return sorted((i, f"{f:016x}", groups(pairs)[i]) for i, f in prints)


def near_copies(rng):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One  two"), (6, "É x y z"), (6, "É x y z")]
    for k in range(12):
        base = text_of(rng, 150).split()
        for copy in range(5):
            words = list(base)
            for _ in range(copy // 2):
                words[rng.randrange(150)] = "edit"
            rows.append((10 + 10 * k + copy, " ".join(words)))
    return rows


def test_simhash_components_match_brute_force(spark):
    rows = near_copies(random.Random(1))
    docs = frame(spark, rows).withColumn("component_id", F.lit("x")).withColumn("bits", F.lit(1))
    got = sorted(tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect())
    assert got == plain_components(rows)
    assert len({c for *_, c in got}) < len(rows) - 20


def test_simhash_index_finds_all_links_in_dense_and_wide_groups():
    rng = np.random.default_rng(2)
    center = rng.integers(0, 1 << 38, 40, dtype=np.uint64)
    bits = [center]
    for _ in range(12):
        flips = np.uint64(1) << rng.integers(0, 38, (40, 3)).astype(np.uint64)
        bits.append(center ^ np.bitwise_or.reduce(flips, axis=1))
    bits = np.unique(np.concatenate(bits))
    keys = rng.integers(0, 2, len(bits)).astype(np.uint64)
    got = simhash.linked(keys, bits)
    near = [(i, j) for i in range(len(bits)) for j in range(i + 1)
            if keys[i] == keys[j] and int(bits[i] ^ bits[j]).bit_count() <= 3]
    want = groups(near)
    assert len(set(want.values())) > 2
    assert {frozenset(np.flatnonzero(got == g).tolist()) for g in set(got.tolist())} == {
        frozenset(i for i in want if want[i] == g) for g in set(want.values())}


def test_simhash_splits_groups_over_the_limit(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_LIMIT", 3)
    rows = near_copies(random.Random(3))
    got = sorted(tuple(r) for r in simhash.near_duplicates(frame(spark, rows)).select(
        "doc_id", "fingerprint", "component_id").collect())
    assert got == plain_components(rows)


def test_keep_one_of_each_component(spark):
    rows = near_copies(random.Random(4)) + [(None, "lonely unknown text of its own"), (None, None)]
    docs = frame(spark, rows).withColumn("label", F.lit("a")).withColumn("print", F.lit(None).cast("int"))
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    got = Counter(r.doc_id for r in kept.collect())
    assert got == Counter([*{c for *_, c in plain_components([r for r in rows if r[0] is not None])}, None])
    empty = docs.limit(0)
    assert simhash.keep_one_of_each(empty).count() == 0 == simhash.near_duplicates(empty).count()


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 60).select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    got = {r.node: r.label for r in components.component_labels(links).collect()}
    assert got == dict.fromkeys(range(60), 0)


# ---- 2 mixing ----------------------------------------------------------------------------------------------------

def test_rates_meet_the_targets_and_match_exact_least_squares(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3, 0.3, 0.3], 200)
    tokens = rng.integers(1, 300, 200)
    table = spark.createDataFrame([(int(t), [float(x) for x in row]) for t, row in zip(tokens, p)],
                                  "_llm_tokens long, _llm_posterior array<double>")
    target = np.array([0.2, 0.5, 0.3])
    rates = mixing.fit_rates(table, target, rounds=60).of(p)
    share = (p * (tokens * rates)[:, None]).sum(axis=0) / tokens.sum()
    assert (rates >= 0).all() and np.abs(share - target).max() < 0.01
    # The optimum in closed form: rates are max(0, 1 - p.y / penalty) for some y.
    plain, weight = np.ones(200), tokens / tokens.sum()
    for _ in range(20_000):
        plain = np.maximum(plain - 0.5 * (p @ (p.T @ (weight * plain) - target) + mixing.KEEP_NEAR * (plain - 1)), 0)
    assert np.abs(plain - rates).max() < 0.05


@pytest.mark.parametrize("sure", [1.0, 0.94])
def test_rates_meet_the_targets_of_rare_domains(spark, sure):
    counts = (897, 100, 2, 1)
    p = np.repeat(np.full((4, 4), (1 - sure) / 3) + np.eye(4) * (sure - (1 - sure) / 3), counts, axis=0)
    table = spark.createDataFrame([(100, [float(x) for x in row]) for row in p],
                                  "_llm_tokens long, _llm_posterior array<double>")
    target = np.array([0.4, 0.2, 0.2, 0.2])
    rates = mixing.fit_rates(table, target).of(p)
    assert (rates >= 0).all()
    assert np.abs((p * rates[:, None]).mean(axis=0) - target).max() < 0.0005


def test_a_target_without_documents_is_told(spark):
    table = spark.createDataFrame([(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0])], "_llm_tokens long, _llm_posterior array<double>")
    with pytest.warns(UserWarning, match="not met"):
        rates = mixing.fit_rates(table, np.array([0.3, 0.3, 0.4]), rounds=5)
    assert rates.of(np.eye(3)[:2]) == pytest.approx([0.6, 0.6], abs=0.01)


def languages(rng):
    rows = []
    for i in range(120):
        lang = ("aa", "bb", "cc")[i % 3]
        stem = {"aa": "ka", "bb": "lo", "cc": "mi"}[lang]
        rows.append((i, " ".join(stem + rng.choice(WORDS) for _ in range(30)), lang))
    return rows + [(500, None, "aa"), (501, "", None), (502, "kaka", "other"), (502, "kaka", "other"), (None, "kaka", "aa")]


def test_mixed_corpus_has_the_target_shares(spark):
    rng = random.Random(12)
    words = {"aa": ["ana", "ava", "alma"], "bb": ["bob", "ebb", "blab"], "cc": ["coc", "cic", "click"]}
    rows = []
    for i in range(6000):
        lang = "aa" if i % 100 < 86 else "bb" if i % 100 < 98 else "cc"
        rows.append((i if i % 4 else None, lang, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(5, 30)))))
    rows += [(None, "aa", "ana ava alma ana ava alma")] * 1000  # rows that agree in everything
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("copy", F.lit("own"))
    labels = docs.filter("doc_id is not null").selectExpr("doc_id", "1 as quality", "0 as toxic")
    mixed = mixing.mixed_corpus(docs, labels, {"aa": 5, "bb": 3, "cc": 2}, F.col("lang"))
    assert mixed.filter("copy = 'own' and mix_copy between 1 and copies").count() == mixed.count()
    tokens = {r.lang: r.n for r in mixed.groupBy("lang").agg(F.sum("n_tokens").alias("n")).collect()}
    shares = {k: n / sum(tokens.values()) for k, n in tokens.items()}
    assert all(abs(shares[k] - want) < 0.01 for k, want in (("aa", 0.5), ("bb", 0.3), ("cc", 0.2))), shares
    same = mixed.filter("doc_id is null and text = 'ana ava alma ana ava alma'")
    rate = same.first().rate
    assert 0.85 * rate < same.count() / 1000 < 1.15 * rate


def test_mixing_whole(spark):
    docs = frame(spark, languages(random.Random(6)), "doc_id long, text string, lang string").withColumn("rate", F.lit("?"))
    labels = frame(spark, [(i, 1, 0) for i in range(90)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, labels, {"aa": 1, "bb": 2, "cc": 1}, F.col("lang"), rounds=40).collect()
    assert len(got) == docs.count()
    total = sum(r.n_tokens for r in got)
    share = [sum(r[c] * r.n_tokens * r.rate for r in got) / total for c in ("p_aa", "p_bb", "p_cc")]
    assert share == pytest.approx([0.25, 0.5, 0.25], abs=0.02)
    assert all(r.n_tokens == 0 for r in got if r.doc_id in (500, 501)) and all(r.copies >= 0 for r in got)
    carried = mixing.mix(docs, labels, {"aa": 1, "bb": 1}, F.col("lang"), rounds=2, carry=True)
    assert carried.columns == [*docs.columns, "n_tokens", "p_aa", "p_bb", "mix_rate", "copies"] and carried.count() == len(got)
    none = mixing.mix(docs, labels.limit(0), {"aa": 1, "bb": 1}, F.col("lang"), rounds=3).collect()
    assert all(r.p_aa == r.p_bb == 0.5 for r in none)
    assert mixing.mix(docs.limit(0), labels, {"aa": 1, "bb": 1}, F.col("lang"), rounds=2).count() == 0


# ---- 3 toxicity --------------------------------------------------------------------------------------------------

def insults(rng):
    rows, labels = [], []
    for i in range(400):
        words = text_of(rng, 40).split()
        if i % 4 == 0:
            for _ in range(2):
                words.insert(rng.randrange(40), rng.choice(["clodpate", "grumbler", "nitwit"]))
        rows.append((i, " ".join(words[:20]) + ". " + " ".join(words[20:])))
        labels.append((i, 1, int(i % 4 == 0)))
    return rows, labels


def test_toxicity_finds_gapped_insults_and_leaves_clean_texts(spark):
    rows, labels = insults(random.Random(7))
    rng = random.Random(8)
    odd = {1000: None, 1001: "", 1002: "!!! 123", 1003: text_of(rng, 30) + " cl-od.pate n1tw1t", 1004: text_of(rng, 30),
           1005: text_of(rng, 20) + " n i t w i t clodxpate", 1006: "x" * 5000}
    docs = frame(spark, rows + list(odd.items())).withColumn("score", F.lit("?"))
    tags = frame(spark, labels + [(None, None, None), (3, 1, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, tags).collect()}
    assert set(got) == {*range(400), *odd} and all(0 <= r.score <= 1 for r in got.values())
    held = [r for i, r in got.items() if i < 400 and r.held_out]
    assert 60 < len(held) < 140
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in held)
    assert got[1003].predicted == got[1005].predicted == 1
    assert got[1000].predicted == got[1001].predicted == got[1002].predicted == got[1004].predicted == got[1006].predicted == 0
    assert all(r.score == 0 for r in toxicity.toxicity(docs, tags.filter("toxic = 0")).collect())


def test_kernel_is_the_same_by_words_and_by_weights():
    units = toxicity.units_of([b"clodpate grumbler anna"])
    rows = toxicity.kernel_rows(units.codes, units.start, units.end)
    again = toxicity.kernel(units.codes, units.start, units.end, np.ascontiguousarray(rows.T))
    assert np.allclose(rows @ rows.T, again, atol=1e-5)
    fold = lambda t: [bytes(u.codes[s:e].astype(np.uint8) + 96) for u in [toxicity.units_of([t])]
                      for s, e in zip(u.start, u.end)]
    assert fold(b"N1tw!t, c-l.o i d i o t a b") == [b"nitwt", b"clo", b"idiotab"]


def test_letters_of_every_script_keep_their_identity(spark):
    codes = lambda w: toxicity.units_of([w.encode()]).codes.tolist()
    assert codes("naïve") == codes("NAÏVE") and codes("naive") == codes("ＮＡＩＶＥ") == codes("nai\u0308ve")
    assert codes("“nitwit”…") == codes("nitwit") and codes("😀 ‘’") == []
    words = ["идиот", "дурак", "добро", "стена", "混蛋", "朋友", "naéve", "naïve", "naive", "βλάκα", "がき", "かき", "𐐀𐐁", "𐐂𐐃"]
    assert len({tuple(codes(w)) for w in words}) == len(words) and codes("ИДИОТ") == codes("идиот")
    rng, rows, labels = random.Random(17), [], []
    clean = ["добро", "стена", "книга", "город", "весна", "朋友", "老师", "天空", "学生", "花园"]
    for i in range(400):
        words = [rng.choice(clean) for _ in range(12)] + text_of(rng, 12).split()
        if i % 4 == 0:
            words.insert(rng.randrange(20), rng.choice(["дурак", "混蛋"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(1000, "добро весна ДУР-АК"), (1001, "老师 混蛋"), (1002, "город стена слово"), (1003, "老师 电影 时间")]
    tags = frame(spark, labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, rows), tags).collect()}
    assert all(r.predicted == (i % 4 == 0) for i, r in got.items() if i < 400 and r.held_out)
    assert [got[i].predicted for i in range(1000, 1004)] == [1, 1, 0, 0]
    # A slice without a single letter.
    empty = frame(spark, [(1, "…"), (2, "😀 !!"), (3, None)]).coalesce(1)
    model = toxicity.ToxicModel(np.zeros(toxicity.FEATURES), -1.0, np.zeros(5))
    assert [r.score for r in toxicity.score_documents(empty, model).collect()] == [0.5] * 3


def test_kernel_against_a_plain_one():
    """Every subsequence of 3 letters over at most 5 places and of 5 over at most 6, one by one."""
    def plain(word):
        marked, out = "^" + word, Counter()
        for size, widest in ((3, 5), (5, 6)):
            for places in combinations(range(len(marked)), size):
                span = places[-1] - places[0]
                if span < widest:
                    # A feature is a subsequence with its places filled from the left.
                    out["".join(marked[p] for p in places)] += toxicity.DECAY ** span
        return out

    words = ["clodpate", "clodxpate", "clod", "nitwit", "дурак", "дураки", "混蛋", "ab", "anna"]
    units = toxicity.units_of([" ".join(words).encode()])
    rows = toxicity.kernel_rows(units.codes, units.start, units.end)
    norms = toxicity._norms(units.end - units.start)
    bags = [plain(w) for w in words]
    for i, a in enumerate(bags):
        for j, b in enumerate(bags):
            want = sum(v * b[k] for k, v in a.items()) / norms[i] / norms[j]
            assert abs(want - rows[i] @ rows[j]) < 1e-4  # hashed features may meet


# ---- 4 substrings ------------------------------------------------------------------------------------------------

def plain_repeats(texts, window=35):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(b" ".join(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[b" ".join(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out)


def repeats(rng):
    texts = [None, "", " ", "a " * 200, "b " * 35, "b " * 35 + "c", "x " * 36, "x " * 10 + "y", "d " * 35, "p q r " * 40,
             "zz " + "p q r " * 20 + "e", "é ü " * 50, "w" * 3000 + " v" * 40]
    for _ in range(30):
        base = [rng.choice("abcdefgh") for _ in range(150)]
        for _ in range(3):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(150)] = "M%d" % rng.randrange(9)
            start = rng.randrange(60)
            texts.append(" ".join(words[start:start + rng.randrange(30, 150)]))
    return texts + [" ".join(rng.choice("uv") for _ in range(80)) for _ in range(10)]


@pytest.mark.parametrize("table_bits", [6, 20])
def test_repeated_words_match_brute_force(spark, table_bits):
    texts = repeats(random.Random(9))
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(texts)]
    docs = frame(spark, rows).withColumn("key", F.lit("?")).repartition(4)
    got = sorted((r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs, table_bits=table_bits).collect())
    assert got == plain_repeats(texts)
    assert substrings.remove_repeats(docs.limit(0), table_bits=table_bits).count() == 0


def test_marks_stay_with_their_text_when_many_rows_have_no_id(spark):
    rng = random.Random(30)
    passage = " ".join("p%d" % i for i in range(40))
    seen, pair = {}, None
    while pair is None:  # a text with a repeat and one without, whose hashes end in the same 28 bits
        twice = len(seen) % 2
        tail = "t%d" % rng.getrandbits(40)
        text = f"{passage} {passage} {tail}" if twice else " ".join("q%d" % i for i in range(60)) + " " + tail
        low = xxhash.xxh64_intdigest(text, seed=42) & (1 << 28) - 1
        other = seen.setdefault((low, twice), text) and seen.get((low, 1 - twice))
        pair = other and (text, other)
    texts = list(pair) + [text_of(rng, 40) for _ in range(400)] * 2 + [text_of(rng, 40) for _ in range(400)]
    for ids in ([None] * len(texts), [7] * len(texts)):
        docs = frame(spark, list(zip(ids, texts))).repartition(4)
        got = sorted((r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(docs, table_bits=16).collect())
        assert got == plain_repeats(texts)
        sizes = substrings.marks(substrings.repeated_blocks(docs, table_bits=16)).select(F.size("at").alias("n")).collect()
        assert len(sizes) == 401 and max(r.n for r in sizes) <= 81


def test_parse_is_local():
    rng = random.Random(10)
    shared = text_of(rng, 60)
    words = recompression.words_of([(text_of(rng, 30) + " " + shared).encode(), (shared + " " + text_of(rng, 9)).encode()])
    parsed = recompression.parse(words)
    assert parsed.size.max() <= 16 and parsed.size.sum() == len(words.start)
    inside = [[(int(a) - base, n) for a, n, lo, hi in zip(parsed.at, parsed.name.tolist(), parsed.low, parsed.high)
               if base <= lo and hi <= base + 60] for base in (30, 90)]
    assert inside[0] == inside[1] and len(inside[0]) > 5


# ---- 5 personal data ---------------------------------------------------------------------------------------------

def plain_spans(text):
    text = text or ""
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda m: re.sub(r"\D", "", m[0])
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15)}
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in tests.items() for m in re.finditer(p, text) if ok(m)]


PERSONAL = [
    None, "", "a@b.c_x@y.z.w", "x😀y me@ex.com 😀 1.2.3.4.5.6.7.8 256.1.1.1 000001.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567 +12 +1234567890123456", "a@b", "@@a@b.c",
    "1" * 300 + "." + "2.3.4", "a." * 20_000, "1 " * 9_000 + "5", "+1" + "(" * 5_000, "a" * 50_000, "4111111111111111" * 2,
    'api key = "AbCdEf0123456789AbCdEf0123456789" mail joe [at] example [dot] com, call (555) 123-4567 now',
    'token = "0123456789abcdef0123456789abcdef01234567"', "see /" + "x1" * 20 + " and isbn 978-12-3456"]


def test_base_spans_match_plain_rules_and_more_is_added(spark):
    docs = frame(spark, list(enumerate(PERSONAL)) + [(7, PERSONAL[7])]).withColumn("base", F.lit("?"))
    got = personal_data.report(docs).collect()
    assert len(got) == len(PERSONAL) + 1
    for r in got:
        want = plain_spans(PERSONAL[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want)
                                                           for k in personal_data.BASE_KINDS]
        assert r.spans.split(",")[:len(want)] == (want or [""])[:len(want)]
    spans = {r.doc_id: r.spans for r in got}
    assert spans[14] == "contact:50:76,number:83:97,secret:11:43" and spans[15] == "secret:9:49" and spans[16] == ""
    assert personal_data.report(docs.limit(0)).count() == 0


def test_redaction_keeps_the_rest(spark):
    docs = frame(spark, list(enumerate(PERSONAL)), "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r for r in personal_data.redact(docs).collect()}
    assert got[3].text == "x😀y <EMAIL> 😀 <IP>.<IP> 256.1.1.1 <IP>" and got[3].n_chars == len(got[3].text)
    assert got[0].text is None and got[1].text == "" and got[6].text == "a@b"
    assert got[15].text == 'token = "<SECRET>"'


def test_reliabilities_tell_good_from_bad_labelers():
    rng = np.random.default_rng(11)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < q, truth, ~truth) * 2 - 1 for q in (0.95, 0.9, 0.6)], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    likely, table = personal_data.reliabilities(patterns, counts.astype(float))
    assert table[1, 0, 2] > 0.9 and 0.5 < table[1, 2, 2] < 0.7
    assert all((p > 0.5) == (votes[0] > 0) for votes, p in zip(patterns, likely) if votes[0] == votes[1])


# ---- 6 licences --------------------------------------------------------------------------------------------------

def plain_matches(text, known):
    """Every unit by itself, in plain Python."""
    def line(c):
        c = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in c)
        c = re.sub(licenses.COPYRIGHT_LINE, "", c)
        for pattern, to in licenses.LINE_RULES:
            c = re.sub(pattern, to, c)
        return c.strip(" ")

    def canonical(t):
        c = " " + " ".join(x for x in map(line, re.split("\r?\n|\r", t)) if x) + " "
        for pattern, to in licenses.SPELLINGS:
            end = "" if pattern.endswith(")") else " "
            c = re.sub(f" {pattern}{end}", f" {to}{end}", c)
        return c.strip(" ")

    names = {(canonical(t), n) for n, t in known}
    units = [*re.split("\r?\n|\r", text), *re.split(r"(?:\r?\n|\r)[\x20\t]*(?:\r?\n|\r)+", text), text]
    hits = [[n for c, n in names if c and c == canonical(u)] for u in units]
    return sum(map(len, hits)), ",".join(sorted({n for h in hits for n in h})), bool(hits[-1])


def test_licenses_against_a_plain_scan(spark):
    rng = random.Random(3)
    bodies = [t for _, t in licenses.KNOWN]
    wrap = lambda t, n: "\n\n".join(textwrap.fill(p, n) for p in t.split("\n\n"))
    texts = ["", " \n\r\n ", "Licenced under the MIT Licence.", "licences\n\nv 2.0", "Copyright (c) 2020 X", "(c) You must",
             "Copyright 2020 X\nLicensed under the MIT License.\nAll rights reserved.", "1.0\n2.0.\n v1.0", "\u2028MIT\u2028",
             "Licensed under the Mozilla Public Licence, version 2.0\r\nLicensed under CC BY 4.0\rx"]
    for body in bodies:
        texts.append(wrap(body, rng.randrange(20, 120)))  # lines may begin with "copyright holders"
        texts.append(f"Copyright © {rng.randrange(1990, 2030)} Foo\n\n" + wrap(body.upper(), 70).replace("\n", rng.choice(["\n", "\r\n"])))
        texts.append(f"{text_of(rng, 5)}\n\n{body}\n \n{rng.choice(bodies)}\n{text_of(rng, 3)}")
    known = [*licenses.KNOWN, ("Other", "Licensed under the MIT License."), ("Nothing", "Copyright 2020 X")]
    docs = frame(spark, list(enumerate(texts)) + [(None, texts[2]), (3, texts[2])]).withColumn("licenses", F.lit("?"))
    got = licenses.scan(docs, known).collect()
    want = [(i, *plain_matches(t, known)) for i, t in enumerate(texts)] + [(k, *plain_matches(texts[2], known)) for k in (None, 3)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    # The whole of a known text is found however its lines are broken.
    full = [r for r in got if r.doc_id is not None and r.doc_id >= 10 and (r.doc_id - 10) % 3 < 2]
    assert all(r.is_license for r in full if r.doc_id != 3)


def test_license_forms(spark):
    body = licenses._MIT_BODY
    texts = ["MIT Licence\n\nCopyright (c) 2020 Foo\n\n" + body.replace("sublicense", "sub-license"), None, "",
             "RELEASED!! UNDER!! THE!! MIT!! LICENSE.!!", "x\nLicensed under CC BY-NC 4.0.\ny", "Copyright 2020 Foo",
             body.replace("charge", "cost"), "Licensed under the Apache License, v. 2"]
    docs = frame(spark, list(enumerate(texts)) + [(4, texts[4])]).withColumn("found", F.lit(1))
    got = [(r.doc_id, r.n_matches, r.licenses, r.is_license) for r in licenses.scan(docs).orderBy("doc_id").collect()]
    assert got == [(0, 1, "MIT", True), (1, 0, "", False), (2, 0, "", False), (3, 3, "MIT", True),
                   (4, 1, "CC-BY-NC-4.0", False), (4, 1, "CC-BY-NC-4.0", False), (5, 0, "", False), (6, 0, "", False),
                   (7, 3, "Apache-2.0", True)]


# ---- 7 quality ---------------------------------------------------------------------------------------------------

def graded(rng):
    rows, labels = [], []
    for i in range(300):
        grade = i % 3
        words = text_of(rng, 40).split()
        noisy = {0: 35, 1: 12, 2: 0}[grade]
        words[:noisy] = [w.upper() + "###" for w in words[:noisy]]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(grade > 0), int(grade == 1)))
    return rows, labels


def test_ordinal_grades_on_held_out_documents(spark):
    rows, labels = graded(random.Random(12))
    docs = frame(spark, rows + [(900, None), (901, ""), (None, "x"), (5, rows[5][1])]).withColumn("kept", F.lit("?"))
    tags = frame(spark, labels[:200] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.grades(docs, tags).collect()}
    held = [got[i] for i in range(200, 300)]
    assert np.mean([round(r.expected_grade) == r.doc_id % 3 for r in held]) > 0.9
    assert np.mean([r.kept == (r.doc_id % 3 > 0) for r in held]) > 0.95
    assert quality.select_good(docs, tags).columns == docs.columns
    none = quality.grades(docs, tags.limit(0)).collect()
    assert len(none) == 304 and all(r.kept and r.expected_grade is None for r in none)
    assert quality.grades(docs.limit(0), tags).count() == 0


def test_thresholds_stay_in_order():
    rng = np.random.default_rng(13)
    x = rng.normal(size=(400, 6)).astype(np.float32) / 10
    y = np.digitize(x[:, 0] * 10 + rng.normal(size=400) * 0.2, [-1, 0, 1])
    model = quality.fit_ordinal(x, y, 4)
    assert (np.diff(model.thresholds) > 0).all()
    tails = model.tails(x)
    assert (np.diff(tails, axis=1) <= 1e-6).all() and np.corrcoef(tails.sum(axis=1), y)[0, 1] > 0.85


def test_hashed_features_see_the_whole_text():
    long = b"ab " * 400_000
    x = features.hashed([b"", b"ab ab", long, long + b"Z" * 400_000])
    assert x[0].sum() == 0 and np.isclose((x[1] ** 2).sum(), 1, atol=1e-3)
    assert np.abs(x[2] - x[3]).max() > 0.2


# ---- 8 decontamination -------------------------------------------------------------------------------------------

def plain_hits(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    parts = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            parts.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(p) for p in parts}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in parts:
                    hit.update(range(i, i + n))
                    found |= parts[tuple(w[i:i + n])]
        names = sorted(str(x) for x in found)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def exam(rng):
    items = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.choice([3, 9, 10, 11, 40])))) for i in range(12)]
    items += [(12, None), (13, "..."), (3, items[3][1]), (14, "É x"), (15, items[0][1])]
    docs = [(0, None), (1, ""), (2, "É, X!"), (3, "a"), (4, "a b " * 2000)]
    for i in range(30):
        body = [rng.choice("abcdefg") for _ in range(60)]
        source = (items[rng.randrange(12)][1] or "").upper().split()
        at = rng.randrange(50)
        docs.append((10 + i, "- ".join(body[:at] + source[rng.randrange(3):] + body[at:])))
    return docs + [docs[-1]], items


@pytest.mark.parametrize("block", [150_000, 60])
def test_contamination_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 25)
    docs, items = exam(random.Random(14))
    got = sorted(tuple(r) for r in decontamination.contamination(
        frame(spark, docs).withColumn("n_hit", F.lit("?")), frame(spark, items, "item_id long, text string")).select(
            "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert got == plain_hits(docs, items)


def test_removal_cuts_spans_and_drops_covered_documents(spark):
    item = "one two three four five six seven eight nine ten"
    docs = frame(spark, [(1, f"Intro, {item.title()}! Rest of a clean text with more than ten words, you see."), (2, item),
                         (3, "clean"), (4, None)]).withColumn("n_chars", F.length("text").cast("long"))
    items = frame(spark, [(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.remove_contamination(docs, items).collect()}
    assert set(got) == {1, 3, 4} and got[3].text == "clean" and got[4].text is None
    assert got[1].text == "Intro, ! Rest of a clean text with more than ten words, you see." and got[1].n_chars == len(got[1].text)
    untouched = decontamination.remove_contamination(docs, items.limit(0))
    assert sorted(map(tuple, untouched.collect())) == sorted(map(tuple, docs.collect()))


# ---- 9 html ------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header class="site"><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div id="wrap"><div class="cookie-notice">We use cookies, really, lots, of, them, to, track.</div>
<div class="content"><h2>Title</h2><p>One, two, three, four, five words and so on and on.
<p>Second&nbsp;para &amp; <b>more<br>line</b>, with, commas, everywhere here.</p><ul><li>item a<li>item b</ul></div>
<div class="comments"><p>I, as, a, reader, say, lots, of, things, here, yes, ok</p></div>
<aside><p>x, y, z, q, w, e, r</p></aside></div><form><p>a, b, c</p></form><footer>&copy; me</footer>"""


def test_main_text_of_odd_pages(spark):
    want = "Title\nOne, two, three, four, five words and so on and on.\nSecond para & more line, with, commas, everywhere here.\nitem a\nitem b"
    pages = {1: (PAGE, want), 2: (None, ""), 3: ("", ""), 4: ("plain &lt;text&gt;", "plain <text>"), 5: ("<div>" * 5000 + "deep", "deep"),
             6: ("<article><h1>H</h1><p><b>Short.<br></article><footer>no</footer>", "H\nShort."),
             7: ("</p></div><p>stray</i> tags", "stray tags"), 8: ("<article><p>é " + "long " * 50_000 + "</article>", "é " + ("long " * 50_000).strip())}
    docs = spark.createDataFrame([(i, "u", h, "?") for i, (h, _) in pages.items()], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(docs.union(docs.filter("page_id = 1"))).collect()}
    assert {i: r.text for i, r in got.items()} == {i: w for i, (_, w) in pages.items()}
    assert all(r.n_chars == len(r.text) for r in got.values())


LONG = ", ".join("word%d and more" % i for i in range(40))


@pytest.mark.parametrize("page, want", [
    (f"<div id=a><p>{LONG}</p></div><div id=b><p>Short, b.</p></div>", [LONG, "Short, b."]),
    (f"<div id=a><p>{LONG}</p></div><h2>More</h2><ul><li>one<li>two</ul><table><tr><td>cell</table><blockquote>said</blockquote>"
     "<pre>x = 1</pre><p>End.</p><ul><li><a href=x>Elsewhere</a></ul><div class=related><p>not, this</p></div>",
     [LONG, "More", "one", "two", "cell", "said", "x = 1", "End."]),
    (f"<article class='post comments-open'><p>{LONG}</p></article><div class=comments><p>me, too</p></div>", [LONG]),
    (f"<div><p>Brief, it, is.</p></div><div class=post-comments><p>{LONG}</p></div>", ["Brief, it, is."]),
    (f"<div class='content has-sidebar'><p>{LONG}</p><div class=sidebar><p>side, bar</p></div></div>", [LONG]),
])
def test_main_text_keeps_what_stands_beside_and_in_marked_containers(page, want):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == "\n".join(want)


# ---- 10 top-k ----------------------------------------------------------------------------------------------------

def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(15)
    vectors = [(i, [float(x) for x in rng.normal(size=8) * (3 if i % 7 else 0.2)]) for i in range(230)]
    vectors += [(300 + i, vectors[5][1]) for i in range(40)] + [(7, vectors[7][1])]
    odd = [(900, None), (901, []), (902, [1.0, None]), (903, [float("nan")] * 8), (904, [float("inf")] * 8), (None, [1.0] * 8),
           (920, [1.0, -2.0])]
    rows = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("?"))
    made = topk.quantised(rows, "vec_id", "embedding")
    got = sorted(tuple(r) for r in topk.top_k(made.filter("vec_id % 20 = 0"), made, blocks=(3, 4)).collect())
    pad = lambda v: np.floor(64 * np.array(v + [0.0] * (8 - len(v)))).astype(int)
    ints = [(i, pad(v)) for i, v in vectors + [odd[-1]]]
    want = []
    for q, a in ints:
        if q % 20 == 0:
            best = sorted((-int(a @ b), i) for i, b in ints if i != q)[:20]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    few = made.filter("vec_id < 3")
    assert topk.top_k(few.filter("vec_id = 0"), few).count() == 2 and topk.top_k(few.limit(0), few.limit(0)).count() == 0


def test_top_k_of_large_components_and_repeats(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    vectors += [(100 + i, [float(x) * 10 ** int(e) for x, e in zip(rng.normal(size=4), rng.integers(0, 12, 4))]) for i in range(40)]
    vectors += [(180, [1e300, -1e300, 1.5, 0.0]), (200, [-1e300, 1.0, 0.0, 0.0]), (201, [2.0 ** 53 + 2, 0.0, 0.0, 1.0])]
    vectors += [(40, [1.0, 2.0, 3.0, 4.0])] * 2 + [(40, [-4.0, 3.0, 0.0, 1.0])]  # a query id that is repeated, with two more vectors
    vectors += [(300, [0.5, 0.5, 0.5, 0.5])] * 50  # a third of the rows alike
    made = topk.quantised(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = sorted(tuple(r) for r in topk.top_k(made.filter("vec_id % 20 = 0"), made, blocks=(3, 2)).collect())
    ints = [(i, [math.floor(Fraction(x) * 64) for x in v]) for i, v in vectors]
    want = []
    for q in {i for i, _ in ints if i % 20 == 0}:
        asked = {tuple(v) for i, v in ints if i == q}
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for a in asked for i, b in ints if i != q)[:20]
        want += [(q, r, i, min(max(-s, -(1 << 63)), (1 << 63) - 1)) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


PROSE = "A paragraph of an article, with commas, and it goes on for more than eighty characters, as they do."


@pytest.mark.parametrize("body, want", [
    (f"<form><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p><label>Name</label><input></form>", ["T", PROSE, PROSE]),
    (f"<form><label>Mail</label><input></form><p>{PROSE}</p>", [PROSE]),
    (f"<fieldset><p>{PROSE}</p></fieldset>", [PROSE]),
    (f"<nav><ul><li><a>Home</a></li><li><a>About</a></li></ul><div><p>{PROSE}</p><p>{PROSE}</p></div>", [PROSE, PROSE]),
    (f"<nav><a>Home</a><p>{PROSE}</p><p>{PROSE}</p>", [PROSE, PROSE]),
    (f"<nav><ul><li><a>Home</a></li></ul></nav><p>{PROSE}</p>", [PROSE]),
    (f"Intro <b>text</b>. <div><p>{PROSE}</p><p>{PROSE}</p></div>Closing<script>x</script> words", ["Intro text.", PROSE, PROSE, "Closing", "words"]),
    (f"<div class=widget><p>{PROSE}</p><p>{PROSE}</p></div>", [PROSE, PROSE]),
    (f"<div class=comments><p>{PROSE}</p><p>{PROSE}</p></div><p>A short article, yes.</p>", ["A short article, yes."]),
    (f"<div class=sidebar><p>{PROSE}</p></div><div><p>{PROSE} 1</p><p>{PROSE} 2</p></div>", [PROSE + " 1", PROSE + " 2"]),
])
def test_article_text_in_unusual_places(body, want):
    assert html_text.main_text(f"<html><body>{body}</body></html>") == "\n".join(want)
