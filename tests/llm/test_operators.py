"""The corpus operators against brute force, on the smallest tables and on odd rows."""

from __future__ import annotations

import hashlib
import html as stdlib_html
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ventus.llm import bpe, html, mixing, neardup, quality, suffixes, text, tokens, toxicity, vectors, wordspans
from ventus.llm.components import components
from ventus.llm.shelf import Shelf

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k % 997}x{k // 997}" for k in range(30_000))
SPAN = " ".join(f"span{k}" for k in range(60))
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, "One TWO"), (7, LONG), (8, LONG + " tail"), (9, "é ñ 日本語 🙂 x" * 40),
    (10, SPAN + " a b c"), (11, "q r s " + SPAN), (12, SPAN + " a b c"), (13, "stutter " * 300), (14, "line\nline\n\nline\n"), (None, SPAN), (15, "<|endoftext|> # * | < >"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", 1) for i, t in ODD], "doc_id long, text string, rule string, n_words int")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


# quality


def counted(x):
    x = x or ""
    w, seen, dup = WORD.findall(x), set(), 0
    for line in x.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeat = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), dup, len(repeat)


def test_text_stats(docs, odd):
    for table in (docs, odd):
        got = sorted((str(r[0]), tuple(r[1:6])) for r in quality.text_stats(table).collect())
        assert got == sorted((str(i), counted(t)) for i, t in pairs(table))
    assert quality.text_stats(odd.limit(0)).count() == 0


def test_rules_learn_and_apply(spark, docs):
    rng = np.random.default_rng(0)
    a, b = rng.random(2000), rng.random(2000)
    bad = (a > 0.7) | ((b > 0.5) & (a < 0.2))
    rules = quality.learn_rules({"a": a, "b": b}, ~bad)
    hit = np.zeros(2000, dtype=bool)
    for rule in rules:
        hit |= quality.covers(rule, {"a": a, "b": b}, 2000)
    assert (hit == bad).mean() > 0.98
    table = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a[:200], b[:200], strict=True)], "a double, b double")
    got = [r[0] for r in table.select(quality.rule_number(rules, {"a": F.col("a"), "b": F.col("b")})).collect()]
    assert [g > 0 for g in got] == hit[:200].tolist()
    assert quality.learn_rules({"a": a}, np.ones(2000, dtype=bool)) == []
    labels = spark.createDataFrame([(r.doc_id, int(r.doc_id % 3 > 0), None) for r in docs.collect()], "doc_id long, quality int, toxic int")
    out = quality.judge(docs, quality.fit(docs, labels))
    assert out.count() == docs.count()
    assert out.where("base_failed and kept").count() == 0


# near-duplicates


def shingles(t, k):
    w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def near_brute(rows, k):
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, odd, k):
    for table in (docs, odd):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(table, shingle_words=k).collect()}
        null = got.pop(None, None)
        assert got == near_brute(pairs(table), k)
        assert null is None or null[1:] == (None, True)
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicates_link_chains(spark):
    """A chain of edits links its ends, and a group in which no two members are equal is one component."""
    base = [f"t{k}" for k in range(60)]
    chain = [" ".join(base[:k] + [f"new{j}" for j in range(k)] + base[k:]) for k in range(0, 12, 2)]
    group = [" ".join([*base[:30], f"only{k}", *base[30:], "z"]) for k in range(40)]
    rows = [(100 + k, t) for k, t in enumerate(chain)] + [(500 + k, t) for k, t in enumerate(group)] + [(9, group[0])]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle_words=2).collect()}
    assert got == near_brute(rows, 2)
    kept = neardup.keep_first(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _x int"), shingle_words=2)
    assert kept.columns == ["doc_id", "text", "_x"]
    assert {r.doc_id for r in kept.collect()} == {i for i, x in got.items() if x[2]}


def test_cells_link_without_all_pairs():
    """300 sets, alike all and in no component yet: fewer links than sets, and one component."""
    sets = [np.sort(np.append(np.arange(100), 1000 + k)).astype(np.uint64) for k in range(300)]
    half = lambda loose: pa.record_batch([pa.array([0] * 300), pa.array([0] * 300, pa.int32()), pa.array([0] * 300, pa.int32()), pa.array(range(300)), pa.array(range(300)), pa.array([loose] * 300), pa.array([x.tobytes() for x in sets])], names=["head", "i", "j", "doc", "own", "loose", "members"])
    out = [b for b in neardup._cells(80)(iter([half(True), half(False)])) if b.num_rows]
    links = [(a, b) for x in out for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]
    assert sorted(links) == [(k, 0) for k in range(1, 300)]


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 10), (20, 20), (None, 1), *[(50, 100 + k) for k in range(200)], *[(300 + k, 301 + k) for k in range(40)]]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Shelf(spark)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 8, 50: 50, **{100 + k: 50 for k in range(200)}, **{300 + k: 300 for k in range(41)}}


# repeated spans


def cut_brute(rows, size, units, join):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        u = units(t or "")
        gone = [False] * len(u)
        for j in range(len(u) - size + 1):
            if (g := tuple(u[j : j + size])) in seen:
                gone[j : j + size] = [True] * size
            else:
                seen.add(g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(u), sum(gone), runs, sha(join([x for x, g in zip(u, gone, strict=True) if not g])))
    return out


def test_word_spans(docs, odd):
    for table in (docs, odd):
        want = cut_brute(pairs(table), 20, WORD.findall, lambda u: " ".join(u).encode())
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in wordspans.remove_repeats(table, emit=wordspans.Digest()).collect()}
        assert got == {i: (n, m, h) for i, (n, m, _, h) in want.items()}
    rows = wordspans.remove_repeats(odd)
    assert rows.columns == [*odd.columns, "n_removed"]
    assert {r.doc_id: r.text for r in rows.collect()}[2] == ""
    assert wordspans.remove_repeats(odd.limit(0)).count() == 0
    spans = wordspans.remove_repeats(odd, emit=wordspans.Spans()).where("doc_id = 11").collect()
    assert [(r.start, r.end) for r in spans] == [(3, 63)]


def test_byte_strings(docs, odd, monkeypatch):
    for table, most in ((odd.where("doc_id not in (7, 8)"), 4096), (docs.where(F.length("text") < 4000), 4096), (docs.where(F.length("text") < 4000), 2)):
        monkeypatch.setattr(suffixes, "SHARD_PATHS", most)  # 2: windows have to be merged across shards
        want = cut_brute(pairs(table), 100, lambda t: list(t.encode()), bytes)
        got = {r.doc_id if r.doc_id is not None else None: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(table, emit=suffixes.Digest()).collect()}
        got = {None if i == (1 << 63) - 1 else i: v for i, v in got.items()}
        assert got == want
    assert suffixes.remove_repeats(odd.limit(0)).count() == 0


def test_byte_strings_that_documents_repeat_in_other_contexts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARD_PATHS", 2)
    other = lambda *x: hashlib.sha512(str(x).encode()).hexdigest()
    passages = [other(k) + other(k, "more")[:20] for k in range(20)]
    rows = [(0, "".join(p + other(p, 0) for p in passages)), *((i, "".join(p + other(p, i, k) for k in range(6) for p in passages)) for i in (1, 2))]
    want = cut_brute(rows, 100, lambda t: list(t.encode()), bytes)
    got = {r.doc_id: tuple(r[1:]) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), emit=suffixes.Digest()).collect()}
    assert got == want


def test_spans_go_to_their_own_row(spark, monkeypatch):
    """Rows without id, and rows of one id, are matched with smaller ids and with themselves only."""
    monkeypatch.setattr(suffixes, "SHARD_PATHS", 2)
    fill = lambda i, n: " ".join(f"f{i}x{k}" for k in range(n))
    rows = [(1, SPAN), (2, fill(2, 300)), (None, fill("a", 200) + " " + SPAN), (None, "short"), (None, fill("b", 10) + " " + SPAN[90:] + " end"), (7, fill("c", 150) + " " + SPAN), (7, fill("d", 40)), (7, SPAN[60:] + " " + fill("e", 5)), (8, fill(8, 40)), (8, fill(8, 40)), (9, fill(9, 20) + " " + SPAN)]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for op, size, units, join in ((wordspans, 20, WORD.findall, lambda u: " ".join(u).encode()), (suffixes, 100, lambda t: list(t.encode()), bytes)):
        less = lambda i: [r for r in rows if r[0] is not None and (i is None or r[0] < i)]
        want = [(str(i), *v) for i, t in rows for v in [cut_brute([*less(i), (10**9, t)], size, units, join)[10**9]]]
        got = [(str(r.doc_id), *r[1:]) for r in op.remove_repeats(table, emit=op.Digest()).collect()]
        assert sorted(got) == sorted(want if op is suffixes else [(i, n, m, h) for i, n, m, _, h in want])


def test_words_that_differ_everywhere_are_not_equal(spark):
    """A Thue-Morse word and its complement, which sums of powers modulo 2**64 can't tell apart."""
    bits = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = bits.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"r{k}" for k in range(19))
    rows = [(1, bits), (2, other), (3, f"{bits} {rest}"), (4, f"{other} {rest}"), (5, f"{bits}\n{other}\n"), (6, " ".join(bits)), (7, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, shingle_words=2).collect()}
    assert got == near_brute(rows, 2)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in wordspans.remove_repeats(docs, emit=wordspans.Digest()).collect()}
    assert got == {i: (n, m, h) for i, (n, m, _, h) in cut_brute(rows, 20, WORD.findall, lambda u: " ".join(u).encode()).items()}
    got = {r.doc_id: tuple(r[1:]) for r in suffixes.remove_repeats(docs, emit=suffixes.Digest()).collect()}
    assert got == cut_brute(rows, 100, lambda t: list(t.encode()), bytes)
    assert {r.doc_id: tuple(r[1:6]) for r in quality.text_stats(docs).collect()} == {i: counted(t) for i, t in rows}
    w = text.words_of(text.Texts(np.frombuffer(b"abcdefgh abcdefg abcdefgh\0 abcdefgh", np.uint8), np.array([0, 35]), 0, np.array([True])))
    codes = text.word_codes(np.frombuffer(b"abcdefgh abcdefg abcdefgh\0 abcdefgh", np.uint8), w)
    assert len(set(codes.tolist())) == 3 and codes[0] == codes[3]


def test_runs_of_one_word_that_documents_share(spark):
    """Of the windows that a document holds several times only the first is told by other documents."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(40):
        parts = [f"{a} " * int(n) + " ".join(f"x{k}" for k in rng.integers(0, 6, 3)) for a, n in zip(rng.choice(["na", "be", "co"], 8), rng.integers(5, 45, 8), strict=True)]
        rows.append((i, " ".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = cut_brute(rows, 20, WORD.findall, lambda u: " ".join(u).encode())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in wordspans.remove_repeats(docs, emit=wordspans.Digest()).collect()}
    assert got == {i: (n, m, h) for i, (n, m, _, h) in want.items()}
    got = {r.doc_id: tuple(r[1:]) for r in suffixes.remove_repeats(docs, emit=suffixes.Digest()).collect()}
    assert got == cut_brute(rows, 100, lambda t: list(t.encode()), bytes)


def test_nonbranching_paths_are_compacted(spark):
    """Chains of 1, 2, 3, 8 and 21 edges, told apart where the node between two edges branches."""
    rows, want, at = [], {}, 0
    for length in (1, 2, 3, 8, 21):
        names = list(range(at + 1, at + 1 + length))
        for k, e in enumerate(names):
            beside = [names[j] if 0 <= j < length else None for j in (k - 1, k + 1)]
            rows.append((e, -e, 2, *(x for b in beside for x in (b, b and -b))))
        want[names[0]] = 2 * length
        at += length
    rows.append((900, -900, 1, 1, -1, None, None))  # says that 1 comes before it, which 1 denies
    want[900] = 1
    schema = "one long, two long, count long, prev_one long, prev_two long, next_one long, next_two long"
    edges = spark.createDataFrame(rows, schema).withColumn("n", F.lit(2))
    assert {r.one: r.windows for r in wordspans.compacted(edges, Shelf(spark)).collect()} == want
    assert wordspans.compacted(edges.limit(0), Shelf(spark)).count() == 0


def test_edges_of_one_code_are_told_apart_by_the_other(spark):
    """Edges A-B, and others that share a half of B's name."""
    none = (None,) * 4
    rows = [(1, 10, 2, *none[:2], 2, 20), (2, 20, 1, 1, 10, *none[:2]), (2, 77, 5, *none), (6, 20, 7, *none)]
    edges = spark.createDataFrame(rows, "one long, two long, count long, prev_one long, prev_two long, next_one long, next_two long").withColumn("n", F.lit(2))
    assert sorted((r.one, r.two, r.windows) for r in wordspans.compacted(edges, Shelf(spark)).collect()) == [(1, 10, 3), (2, 77, 5), (6, 20, 7)]


@pytest.mark.parametrize("doc_id", [5, None])
def test_equal_rows_of_one_id_cost_no_more_than_their_number(spark, monkeypatch, doc_id):
    """Beside one earlier copy: the shards get each path once a row, and every row gets the spans of one."""
    long = " ".join(f"w{k}" for k in range(400))
    put, seen = Shelf.put, {}

    def noted(self, df, name, large=False):
        out = put(self, df, name, large)
        if name in ("shards", "spans"):
            seen[name] = out.count() if name == "shards" else out.select(F.max(F.size("spans"))).first()[0]
        return out

    for n in (1, 200):
        docs = spark.createDataFrame([(1, long)] + [(doc_id, long)] * n, "doc_id long, text string")
        with monkeypatch.context() as m:
            m.setattr(Shelf, "put", noted)
            got = [(r.doc_id, r.n_removed) for r in suffixes.remove_repeats(docs, emit=suffixes.Digest()).collect()]
        assert sorted(got, key=str) == sorted([(1, 0)] + [(doc_id, len(long))] * n, key=str)
        if n == 1:
            one = dict(seen)
        assert seen["shards"] <= one["shards"] * n and seen["spans"] <= 4 * one["spans"]  # of a row, whatever the number of rows
    words = [(r.doc_id, r.n_removed) for r in wordspans.remove_repeats(docs, emit=wordspans.Digest()).collect()]
    assert sorted(words, key=str) == sorted([(1, 0)] + [(doc_id, 400)] * n, key=str)


def test_spans_are_checked_against_their_source():
    t = next(text.texts_of(pa.array([SPAN])))
    w = text.words_of(t)
    kind = pa.list_(pa.struct([("at", pa.int64()), ("windows", pa.int64()), ("digest", pa.binary())]))
    span = lambda d: pa.array([[{"at": 5 * 32 + 3, "windows": 3, "digest": d}]], kind)
    right = wordspans._digests(t, w, np.array([5]), np.array([27]))[0]
    assert right == xxhash.xxh3_128_digest(" ".join(SPAN.split()[5:27]).encode() + b" ")
    assert np.flatnonzero(wordspans.removed_words(t, span(right), 20)[1]).tolist() == list(range(5, 27))
    with pytest.raises(ValueError):
        wordspans.removed_words(t, span(b"x"), 20)


def test_long_texts_are_worked_on_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    long = " ".join(f"v{k}" for k in rng.integers(0, 3000, 3000))
    rows = [(1, long), (2, "x y " + long[200:]), (3, long[:9000] + long[3000:9000])]
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(wordspans, "BLOCK_WORDS", 300)
    column = pa.array([t for _, t in rows])
    t = next(text.texts_of(column))
    w = text.words_of(t)
    start, count, anchor, _ = wordspans.paths(text.word_codes(t.data, w), w.first, 20, 6)
    assert sorted(np.concatenate([np.arange(a, a + n) for a, n in zip(start, count, strict=True)]).tolist()) == np.flatnonzero(text.inside(w.first, 20)).tolist()
    parts = list(suffixes.paths(t.data, t.offsets, 100, 24))
    assert len(parts) > 10
    assert sum(int(x[1].sum()) for x in parts) == int(text.inside(t.offsets, 100).sum())
    nothing = pa.array([None] * 3, pa.list_(pa.int64()))
    brute = {i: cut_brute([(i, t)], 100, lambda t: list(t.encode()), bytes)[i][1] for i, t in rows}
    assert [int(x) for x in text.per_text(suffixes.removed_bytes(t, nothing, 100, 24), t.offsets)] == [brute[i] for i, _ in rows]


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for raw in (b"banana" * 5, bytes(rng.integers(97, 99, 2000).astype(np.uint8)), b"\0" * 50 + b"a\0\0b" * 9, b"x", b"ab" * 400):
        data = np.frombuffer(raw, dtype=np.uint8)
        sa, tied = suffixes.suffix_array(data, 100)
        assert sorted(sa.tolist()) == list(range(len(raw)))
        assert [raw[i : i + 100] for i in sa] == sorted(raw[i : i + 100] for i in range(len(raw)))
        common = suffixes.common_prefixes(data, sa, tied, 100)
        some = rng.random(len(raw)) < 0.4
        few, _ = suffixes.suffix_array(data, 100, some)
        assert sorted(few.tolist()) == np.flatnonzero(some).tolist() and [raw[i : i + 100] for i in few] == sorted(raw[i : i + 100] for i in few)
        for k in range(1, len(raw)):
            x, y, c = raw[sa[k - 1] :], raw[sa[k] :], 0
            while c < min(len(x), len(y), 100) and x[c] == y[c]:
                c += 1
            assert c == common[k]


# toxicity


def test_toxicity_learns_and_keeps(spark, odd):
    rng = np.random.default_rng(1)
    plain = [" ".join(rng.choice(["river", "stone", "green", "walks", "under", "light", "paper"], 30)) for _ in range(600)]
    rows = [(k, t + (" vile grobbling" if k % 4 == 0 else ""), int(k % 4 == 0)) for k, t in enumerate(plain)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, may_learn=F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i] >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows if i % 3 == 0]
    assert np.mean(held) > 0.98
    kept = toxicity.keep_clean(docs.withColumn("score", F.lit("x")), model)
    assert kept.columns == ["doc_id", "text", "score"]
    assert {r.doc_id for r in kept.collect()} == {i for i in got if got[i] < toxicity.THRESHOLD}
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
    flat = toxicity.learn(docs, labels.limit(0))
    assert {round(r.score, 6) for r in toxicity.score(docs, flat).collect()} == {0.5}


def test_scores_are_those_of_brute_force(docs, odd):
    """Distinct n-grams of every whole text, hashed and weighted one by one."""
    mask, bits = (1 << 64) - 1, 12
    weights = np.random.default_rng(6).normal(0, 0.2, 1 << bits).astype(np.float32)
    model = toxicity.Model(-1.5, weights, bits=bits)

    def bucket(gram):
        h = 0
        for c in gram:
            h = (h * text._BASES[0] + int(toxicity._codes[c])) & mask
        h = (h + len(gram)) & mask
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = ((h ^ h >> shift) * times) & mask
        return (h ^ h >> 31) >> (64 - bits)

    for table in (docs.orderBy("doc_id").limit(40), odd.where("doc_id not in (7, 8)")):
        got = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
        for i, t in pairs(table):
            raw = (t or "").encode()
            grams = {raw[k : k + n] for n in toxicity.SIZES for k in range(len(raw) - n + 1)}
            z = -1.5 + float(sum(weights[b] for b in {bucket(g) for g in grams}))
            assert abs(got[i] - 1 / (1 + np.exp(-np.clip(z, -50, 50)))) < 1e-4


def test_buckets_of_long_texts_come_from_blocks(monkeypatch):
    long = next(text.texts_of(pa.array([LONG])))
    whole = toxicity.buckets(long)
    used = np.random.default_rng(0).random(1 << toxicity.BITS) < 0.1
    some = toxicity.buckets(long, of_use=used)
    monkeypatch.setattr(toxicity, "BLOCK_BYTES", 1001)
    for want, got in ((whole, toxicity.buckets(long)), (some, toxicity.buckets(long, of_use=used))):
        assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


def test_a_text_of_25_mb_fits_into_an_executor():
    import subprocess
    import sys

    code = "import resource, numpy as np, pyarrow as pa; from ventus.llm import text, toxicity as x; m = x.Model(0.0, np.ones(1 << x.BITS, dtype=np.float32)); t = next(text.texts_of(pa.array([' '.join(map(str, range(3_500_000)))]))); base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; m.score(t); x.buckets(t); print(len(t.data), base, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    n, base, peak = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert n > 25_000_000 and peak - base < 400_000  # KB


def test_toxicity_learns_from_long_texts_and_either_layout(spark):
    rng = np.random.default_rng(2)
    words = ["river", "stone", "green", "walks", "under", "light", "paper"]
    rows = [(k, " ".join(rng.choice(words, 9000 if k % 50 < 2 else 40)) + (" vile grobbling" if k % 2 else ""), k % 2) for k in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(7, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, 0), (900, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    one, two = toxicity.learn(docs, labels), toxicity.learn(docs.repartition(7), labels.repartition(3))
    assert np.allclose(one.weights, two.weights, atol=1e-5) and abs(one.bias - two.bias) < 1e-4
    got = {r.doc_id: r.score for r in toxicity.score(docs.where("text is not null and doc_id is not null"), one).collect()}
    assert np.mean([(got[i] >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows]) > 0.98
    pos, all_ = np.array([5.0, 1.0, 300.0]), np.array([10.0, 2.0, 320.0])
    ratio = toxicity.log_count_ratios(pos, all_, 400, 800)
    assert ratio[0] == ratio[1] == 0 and abs(ratio[2] - np.log((301 / 402) / (21 / 402))) < 1e-9


def test_crc_of_ids_is_that_of_their_text(spark):
    got = spark.range(20).select(F.crc32(F.col("id").cast("string").cast("binary"))).collect()
    assert [r[0] for r in got] == [zlib.crc32(str(k).encode()) for k in range(20)]


# tokens


HARD = ["  a  b ", "\n\nx\t y", "<|endoftext|> a<|endoftext|>b", "a b ́c", "ÅNGSTRÖM Σας ΣΑΣ", "\x1c a\x1cb\x1d  c", "it's we'll  've", "日本語 テキスト 123 4 5", "🙂 🙃‍ x", "İstanbul", "a\xa0\xa0b", "x" * 3000 + " " + "y " * 1000, "\r\n \r\n", "foo\x85bar"]


@pytest.fixture(scope="module")
def hard(spark, odd):
    return odd.select("doc_id", "text").union(spark.createDataFrame([(100 + k, t) for k, t in enumerate(HARD)], "doc_id long, text string"))


def test_token_counts(docs, hard):
    reference = tokens.tokenizer(tokens.vocabulary_path("word_bpe_49k.json"))
    for table in (docs, hard):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.token_counts(table).collect()}
        assert got == {i: (len((t or "").encode()), len(reference.encode(t or "", add_special_tokens=False).ids)) for i, t in pairs(table)}
    assert tokens.token_counts(hard.limit(0)).count() == 0


def test_bpe_round_trip(docs, hard):
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    reference = tokens.tokenizer(path)
    for table in (docs, hard):
        want = {i: reference.encode(t or "", add_special_tokens=False).ids for i, t in pairs(table)}
        got = {r.doc_id: r for r in bpe.round_trip(table, path, is_path=True, block_bytes=100_000).collect()}
        assert {i: list(r.ids) for i, r in got.items()} == want
        assert {i: r.decoded for i, r in got.items()} == {i: reference.decode(x, skip_special_tokens=False) for i, x in want.items()}
        digest = {r.doc_id: tuple(r[1:]) for r in bpe.round_trip(table, emit=bpe.Digest()).collect()}
        assert digest == {i: (len(x), sha(np.array(x, dtype="<u4").tobytes()), sha(got[i].decoded.encode())) for i, x in want.items()}
    assert bpe.round_trip(hard.limit(0)).count() == 0


# mixing


def test_mixing(spark, docs, sf_dir, odd):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    targets = {"en": 0.4, "fr": 0.2, "de": 0.25, "es": 0.15}
    out = mixing.mix(docs, labels, targets).toPandas()
    assert len(out) == docs.count() and (out.rate >= 0).all()
    share = out.n_tokens / out.n_tokens.sum()
    for d, t in targets.items():
        assert abs((share * out.rate * out[f"p_{d}"]).sum() - t) < 0.005
    # plain projected gradient on the same posteriors, far past convergence
    a = np.array([share * out[f"p_{d}"] for d in sorted(targets)])
    b, w, r = np.array([targets[d] for d in sorted(targets)]), share.to_numpy(), np.ones(len(out))
    scaled = np.divide(a, w, out=np.zeros_like(a), where=w > 0)
    of = a.sum(axis=1)
    for _ in range(4000):
        r = np.maximum(0, r - 0.9 * (scaled.T @ ((a @ r - b) / of) + 1e-3 * (r - 1)))
    some = w > 0
    assert np.abs(out.rate.to_numpy()[some] - r[some]).max() < 0.01
    langs = {r.doc_id: r.lang for r in docs.collect()}
    best = out[[f"p_{d}" for d in sorted(targets)]].to_numpy().argmax(axis=1)
    long = out.n_tokens.to_numpy() > 30
    assert np.mean([sorted(targets)[k] == langs[i] for k, i in zip(best[long], out.doc_id[long], strict=True)]) > 0.95
    assert mixing.mix(odd, labels, targets, "rule").count() == len(ODD)
    assert mixing.mix(odd.limit(0), labels, targets, "rule").count() == 0


def test_membership_is_soft_where_classes_overlap(spark):
    """Two sources that use the same words, each some more often: documents belong to both in part, and targets are met in expectation."""
    rng = np.random.default_rng(12)
    words = np.array([f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)])
    weights = {"web": np.linspace(1.3, 3, 60), "book": np.linspace(3, 1.3, 60)}
    rows = [(k, " ".join(rng.choice(words, int(rng.integers(5, 20)), p=w / w.sum())), name) for k in range(1200) for name in [("web", "book")[k % 3 == 0]] for w in [weights[name]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = {"web": 0.55, "book": 0.45}
    got = mixing.mix(docs, docs.select("doc_id").where("doc_id % 2 = 0"), targets, "source").toPandas()
    p = got.p_book.to_numpy()
    assert ((p > 0.1) & (p < 0.9)).mean() > 0.5
    truth = np.array([r[2] == "book" for r in sorted(rows)])[got.doc_id]
    for low in (0.1, 0.3, 0.5, 0.7):  # of documents of like posterior the like share is of the class
        some = (p >= low) & (p < low + 0.2)
        assert some.sum() < 50 or abs(truth[some].mean() - p[some].mean()) < 0.15
    weight = got.n_tokens * got.rate
    assert got.rate.min() >= 0 and abs((weight * p).sum() / weight.sum() - 0.45) < 0.01


def test_posteriors_are_those_of_brute_force(spark, docs, odd, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    domains, buckets = ["de", "en", "es", "fr"], 64
    model = mixing.learn(docs, labels, domains, "lang", buckets=buckets)
    words = lambda t: (t or "").lower().split(" ")
    def bucket(w):  # Spark's hash of several columns: each is the seed of the next; ints are four bytes
        out = []
        for part, x in ((0, w), (1, w[-3:]), (2, w[:2])):
            code = xxhash.xxh64(part.to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(x.encode(), seed=42)).intdigest()
            out.append((code - 2**64 if code >= 2**63 else code) % buckets)
        return out

    hashed = lambda *x: [r[0] for r in spark.createDataFrame([(i,) for i in x], "i long").select(F.pmod(F.xxhash64("i", F.lit("grown")), F.lit(3)) < 2).collect()]
    known = {r.doc_id for r in labels.select("doc_id").distinct().collect()}
    rows = [(r.doc_id, r.lang, r.text) for r in docs.collect() if r.doc_id in known and r.lang in domains]
    counts, n = np.zeros((4, buckets)), np.zeros(4)
    for (_, lang, t), grown in zip(rows, hashed(*[i for i, _, _ in rows]), strict=True):
        n[domains.index(lang)] += 1
        if grown:
            np.add.at(counts[domains.index(lang)], [b for w in words(t) for b in bucket(w)], 1)
    weights = np.log((counts + 64 * (counts.sum(axis=0) + 1 / buckets) / (counts.sum() + 1)) / (counts.sum(axis=1, keepdims=True) + 64))
    assert np.allclose([model.weights[d] for d in domains], weights) and model.temperature in mixing.TEMPERATURES
    for table in (docs, odd):
        got = {r.doc_id: (r.n, list(r.p)) for r in model.posteriors(table).withColumnRenamed("n_tokens", "n").collect()}
        for i, t in pairs(table):
            z = np.log(n / n.sum()) + model.temperature * (len(WORD.findall(t or "")) > 0) * sum((weights[:, b] for w in words(t) for b in bucket(w)), np.zeros(4))
            assert got[i][0] == len(WORD.findall(t or "")) and np.allclose(got[i][1], np.exp(z - z.max()) / np.exp(z - z.max()).sum(), atol=1e-3)


def test_mixing_reaches_odd_targets(spark, docs, sf_dir, odd):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    targets = {"en": 0.97, "fr": 0.03}
    two = docs.where("lang in ('en', 'fr')")
    rates = mixing.mix(two, labels, targets).toPandas()
    share = rates.n_tokens / rates.n_tokens.sum()
    for d, t in targets.items():
        assert abs((share * rates.rate * rates[f"p_{d}"]).sum() - t) < 0.01
    mixed = mixing.apply_rates(two, labels, targets)
    assert mixed.columns == docs.columns and 0.3 * two.count() < mixed.count() < 2 * two.count()
    rare = two.where("lang = 'en'").unionByName(two.where("lang = 'fr'").join(labels, "doc_id", "left_semi").orderBy("doc_id").limit(8))
    rates = mixing.mix(rare, labels, {"en": 0.5, "fr": 0.5}).toPandas()
    share = rates.n_tokens / rates.n_tokens.sum()
    assert abs((share * rates.rate * rates.p_fr).sum() - 0.5) < 0.01
    tripled = mixing.apply_rates(two, labels, {"en": 0.5, "fr": 0.5}, budget=3.0 * two.agg(F.sum(mixing.n_tokens())).first()[0])
    assert 2.2 * two.count() < tripled.count() < 3.8 * two.count()
    plain = odd.withColumn("_row", F.lit(1)).withColumn("p", F.lit(2))
    assert mixing.apply_rates(plain, labels, targets, "rule").columns == plain.columns
    assert mixing.apply_rates(plain.limit(0), labels, targets, "rule").count() == 0
    assert mixing.apply_rates(plain, labels.limit(0), targets, "rule").where("text is null").count() == 1


# embeddings


def test_near_vectors(spark, sf_dir):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((5, 16))
    rows = [(k, (centre[k % 5] + 0.05 * rng.standard_normal(16)).tolist(), k % 2) for k in range(300)]
    rows += [(1000 + k, rows[0][1], 0) for k in range(30)]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [1.0] * 15 + [float("nan")], 0), (2003, [None] + [1.0] * 15, 0), (2004, rows[0][1], None), (2005, [], 0), (2006, [1.0, 2.0], 0), (2007, [2.0, 4.0], 0), (None, rows[0][1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit(1))
    ok = {i: (np.array(v), c) for i, v, c in rows if i is not None and v and c is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    link = {i: {j for j in ok if j != i and ok[j][1] == ok[i][1] and len(ok[j][0]) == len(ok[i][0]) and ok[i][0] @ ok[j][0] / np.linalg.norm(ok[i][0]) / np.linalg.norm(ok[j][0]) >= 0.93} for i in ok}
    least = {i: i for i in ok}
    for _ in range(20):
        least = {i: min([least[i], *(least[j] for j in link[i])]) for i in ok}
    for block in (512, 16):
        got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(table, block=block).collect()}
        assert len(got) == len(rows)
        assert {i: got[i] for i in ok} == {i: (len(link[i]), least[i]) for i in ok}
        assert all(got[i] == (0, i) for i in got if i not in ok)
    assert vectors.near_vectors(table.limit(0)).count() == 0
    real = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert vectors.near_vectors(real).count() == real.count()


# pages


def test_main_text_of_tables(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in html.main_text(pages).collect()}
    for page in pages.collect():
        article = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        blocks = [" ".join(stdlib_html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[page.page_id].text == "\n".join(x for x in blocks if x)
        assert got[page.page_id].n_chars == len(got[page.page_id].text)


def test_main_text_of_odd_pages(spark):
    menu = "<div><p>Our menu line</p><p>Contact us today</p></div>"
    rows = [
        (1, "http://a.org/x/1", f"<body>{menu}<p>Only here one.</p></body>"),
        (2, "http://a.org/x/2", f"<body>{menu}<p>Only here two.</p></body>"),
        (3, "http://a.org/y/3", None),
        (4, None, ""),
        (5, "http://[bad", "<p>a &amp; b<br>c &lt;d&gt;</p>"),
        (6, "http://b.org/1", "<header>H</header><article><h1>T</h1><p>one<p>two <b>bold<br></article><aside>no</aside><form>no</form><div class='comments'>no</div>"),
        (7, "http://b.org/2", "<main><p>t<script>x('</p>')</script>u</p><div class='ad-box'>no</div><ul><li>i<li>j</ul><p hidden>no</p></main><footer>no</footer>"),
        (8, "http://b.org/2", "<main><p>t<script>x('</p>')</script>u</p></main>"),
        (9, "http://c.org/", "plain > text <!-- <p>no</p> --> goes on<style>p{}</style>"),
    ]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert got == {1: "Only here one.", 2: "Only here two.", 3: "", 4: "", 5: "a & b c <d>", 6: "T\none\ntwo bold", 7: "tu\ni\nj", 8: "tu", 9: "plain > text goes on"}
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_of_a_host_of_mixed_pages(spark):
    menu = "<div>Shared menu line</div>"
    page = lambda k, text: f"{menu}<article><p>{text}</p></article>" if k % 3 == 0 else f"{menu}<div>{text}</div>"
    # the least id of the directory marks an article; neighbours by path share a section line that the others haven't
    rows = [(k, f"http://h.org/d/s{k // 3}/p{k}", page(k, f"Own text {k}") + f"<div>Section {k // 3}</div>") for k in range(60)] + [(90, "http://x.org/d/s0/p", f"{menu}<div>Alone</div>")]
    for n in (1, 7):
        table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)
        got = {r.page_id: r.text for r in html.main_text(table).collect()}
        assert got == {**{k: f"Own text {k}" for k in range(60)}, 90: "Shared menu line\nAlone"}


def test_differencing_decides_within_articles(spark):
    parts = '<div class="share">Tell your friends of us.</div><p class="alert">We move house in May.</p>'
    own = lambda k: f'<div class="alert">Flood {k} came.</div><table class="widget"><tr><td>Bolt<td>{k}</table>'
    page = lambda k: f"<article><h1>Title {k}</h1><p>One sentence of all.</p><p>Text {k}.</p>{own(k)}{parts}</article>"
    rows = [(k, f"http://h.org/d/p{k}", page(k)) for k in range(6)]
    # of one article in two places and of a page without a neighbour nothing tells what is shared; copies look further for a partner
    rows += [(10, "http://two.org/a", page(10)), (11, "http://two.org/b", page(10)), (12, "http://one.org/", page(12)), (13, "http://h.org/d/p3x", page(3))]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    text = lambda k: f"Title {k}\nOne sentence of all.\nText {k}.\nFlood {k} came.\nBolt\n{k}"
    whole = lambda k: f"{text(k)}\nTell your friends of us.\nWe move house in May."
    assert got == {**{k: text(k) for k in range(6)}, 10: whole(10), 11: whole(10), 12: whole(12), 13: text(3)}


def test_copies_of_a_page_are_no_partners(spark):
    rng = np.random.default_rng(4)
    page = lambda k: f"<div>Menu</div><div>Own {k}</div><div>More of {k}</div>"
    # long runs of copies pass over whole partitions of the sort; the second host has nothing but copies
    kinds = [int(k) for n, k in zip(rng.integers(1, 40, 12), rng.integers(0, 5, 12), strict=True) for _ in range(n)]
    rows = [(k, f"http://h.org/{k:04}", page(kind)) for k, kind in enumerate(kinds)] + [(k, f"http://i.org/{k}", page(9)) for k in range(1000, 1030)]
    for n in (1, 5):
        spark.conf.set("spark.sql.shuffle.partitions", str(4 * n))
        try:
            got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == {**{k: f"Own {kind}\nMore of {kind}" for k, kind in enumerate(kinds)}, **dict.fromkeys(range(1000, 1030), "Menu\nOwn 9\nMore of 9")}


def test_every_page_meets_its_nearest_page(spark, sf_dir):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    pages += [(k + 100000, u, h) for k, u, h in pages[::3]] + [(k + 200000, f"{u}/x", h) for k, u, h in pages[::5]]
    blocks = {k: html.page_blocks(h) for k, _, h in pages}
    content = {k: [x for x, kind in b if kind != html.OUT] for k, b in blocks.items()}
    order = sorted((*html.place(u), k) for k, u, _ in pages)
    best = {}
    for at, (host, path, k) in enumerate(order):
        near = [next((x for x in side if x[0] == host and content[x[2]] != content[k]), None) for side in (order[:at][::-1], order[at + 1 :])]
        partner = html.nearest(near[0], (host, path, k), near[1])
        if partner is not None:
            best[k] = b"".join(html._code(x) for x, _ in blocks[partner])
    shelf = html.Shelf(spark)
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    sketches = table.mapInArrow(html._sketch, "page_id long, host string, path string, content binary, codes binary")
    assert best and {r.page_id: bytes(r.other) for r in html.partners(sketches, shelf).collect()} == best


def test_main_text_keeps_what_the_article_says(spark):
    pages = {
        "<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here.</p></article>": "Energy is E=m here.",
        "<article><p class='alert'>Mind the gap.</p><p class=\"share\">We share.</p><li class='related'>x</li></article>": "Mind the gap.\nWe share.\nx",
        "<article><p>a</p><div class='related'>no</div><div class='alert'>yes</div><p class='ad'>no</p><p class='notice'>no</p></article>": "a\nyes",
        "<article><noscript>plain words</noscript><object>as text</object><select><option>no</select></article>": "plain words\nas text",
    }
    rows = [(k, f"http://h{k}.org/", x) for k, x in enumerate(pages)]
    rows += [(50, "http://r.org/a", "<article>one</article>"), (50, "http://r.org/a", "<article>two</article>")]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == [*enumerate(pages.values()), (50, "one"), (50, "two")]


@pytest.mark.parametrize(
    ("part", "in_article", "in_free_page"),
    [
        ('<div class="share-price">Share price rose 5%.</div>', True, True),
        ('<section id="related-work">Older work.</section>', True, True),
        ('<table class="widget-prices"><tr><td>Bolt</td></tr></table>', True, True),
        ('<ul class="menu"><li>Soup<li>Fish</ul>', True, False),
        ('<div class="alert">Tsunami came.</div>', True, False),
        ('<p class="share">Everybody got a share.</p>', True, True),
        ('<div class="quote">See <a href="/x">this</a> and much more that is said here.</div>', True, True),
        ('<div class="widget">Mostly told here, <a href="/x">one</a> link.</div>', True, False),
        ('<div class="share"><a href="/a">Post</a> <a href="/b">Mail</a></div>', False, False),
        ('<ul class="related-posts"><li><a href="/a">One</a><li><a href="/b">Two</a></ul>', False, False),
        ('<div class="cookie-banner">We use cookies.</div>', False, False),
        ('<div class="box ad-slot-2">Buy now.</div>', False, False),
        ('<div id="comments"><p>First!</p></div>', False, False),
        ('<p class="sponsor">Paid for.</p>', False, False),
    ],
)
def test_names_of_elements(part, in_article, in_free_page):
    for page, stays in ((f"<article><p>Before</p>{part}<p>After</p></article>", in_article), (f"<p>Before</p>{part}<p>After</p>", in_free_page)):
        lines = [t for t, _ in html.page_lines(page)]
        assert lines[0] == "Before" and lines[-1] == "After" and (len(lines) > 2) == stays


def test_common_lines_of_long_pages():
    rng = np.random.default_rng(8)
    a, b = ([f"l{k}" for k in rng.integers(0, 40, 900)] for _ in range(2))
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    picked, rest = [x for x, f in zip(a, html.common_lines(a, b), strict=True) if f], iter(b)
    assert len(picked) == best[-1][-1] and all(x in rest for x in picked)
    assert html.common_lines(["x"] * 30000, ["x"] * 30000) == [True] * 30000


def test_common_lines_is_a_longest_common_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = ["abc"[k] for k in rng.integers(0, 3, rng.integers(0, 12))], ["abc"[k] for k in rng.integers(0, 3, rng.integers(0, 12))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        flags = html.common_lines(a, b)
        picked, rest = [x for x, f in zip(a, flags, strict=True) if f], iter(b)
        assert len(picked) == best[-1][-1] and all(x in rest for x in picked)


def test_texts_are_sliced_whole():
    column = pa.array(["ab", None, "", "c" * 50, "d"])
    got = list(text.texts_of(column, max_bytes=10))
    assert [t.raw(k) for t in got for k in range(len(t))] == [b"ab", b"", b"", b"c" * 50, b"d"]
    assert list(text.texts_of(pa.array([], pa.string()))) == []


def test_columns_of_the_same_names_pass_through(spark):
    rows = [(1, SPAN, 7, "a", [1], 5), (2, "x " + SPAN, 8, "b", [2], 6), (3, SPAN, 9, "c", [3], 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc int, anchor string, spans array<int>, n_removed int").withColumn("_copy", F.lit(1)).withColumn("_row", F.lit("r")).withColumn("e", F.lit(2)).withColumn("p", F.lit(3))
    cut = {r.doc_id: r for r in wordspans.remove_repeats(docs).collect()}
    assert [(cut[k].doc, cut[k].anchor, cut[k].spans, cut[k].n_removed) for k in (1, 2, 3)] == [(7, "a", [1], 0), (8, "b", [2], 60), (9, "c", [3], 60)]
    assert neardup.keep_first(docs).columns == docs.columns
    labels = spark.createDataFrame([(1,), (2,)], "doc_id long")
    mixed = mixing.apply_rates(docs.withColumn("lang", F.lit("en")), labels, {"en": 1.0, "fr": 1.0})
    assert mixed.columns == [*docs.columns, "lang"] and {r.e for r in mixed.collect()} <= {2}
