"""Hard negatives, spelling variants and mixing against brute force."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.llm import entry, hard_negatives, mixing, spelling

SF = "/root/testdata/sf0.001"


def test_hard_negatives_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = entry.op11_hard_negatives(spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.OP11_SQL})").fetchall()
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("dim,top", [(1, 3), (7, 1000), (64, 200), (64, 2**26), (3000, 2**20)])
def test_residue_products_are_exact(dim, top):
    rng = np.random.default_rng(dim)
    a, b = (rng.integers(-top, top + 1, (n, dim)) for n in (5, 9))
    numbers = hard_negatives.Residues.of(dim, int(max((x.astype(object) ** 2).sum(1).max() for x in (a, b))))
    got = numbers.product(numbers.split(a), numbers.split(b))
    assert (got.astype(object) == a.astype(object) @ b.astype(object).T).all()


def plain_negatives(rows, every):
    out = []
    for a, la, qa in rows:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(qa, q)), i, lab == la) for i, lab, q in rows if i != a)
        for s, p, _ in [x for x in scored if x[2]][:5]:
            fit = [(i, -t) for t, i, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, r + 1, i, -s, t) for r, (i, t) in enumerate(fit)]
    return sorted(out)


def test_hard_negatives_with_ties_copies_and_bad_rows(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        v = [1.0, 0.5, -0.25] if i % 3 == 0 else [rng.choice([-1.0, -0.5, 0.0, 0.3, 1.0]) for _ in range(3)]
        rows.append((i, rng.randint(0, 2), v, "x"))
    bad = [(1000, None, [1.0, 1.0, 1.0], "x"), (1001, 1, None, "x"), (1002, 1, [1.0, None, 1.0], "x"), (1003, 1, [1.0, float("nan"), 1.0], "x"), (1004, 1, [float("inf"), 1.0, 1.0], "x"), (None, 1, [1.0, 1.0, 1.0], "x"), (1005, 1, [], "x"), (1006, 1, [1.0], "x"), (1007, 1, [1e38, 1.0, 1.0], "x")]
    schema = "vec_id long, label int, embedding array<float>, `q.d` string"
    df = spark.createDataFrame(rows + rows[:40] + bad, schema)
    plain = [(i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, lab, v, _ in rows]
    want = plain_negatives(plain, 10)
    anchors = F.col("vec_id") % 10 == 0
    assert want and sorted(map(tuple, hard_negatives.mine(df, anchors).collect())) == want
    assert sorted(map(tuple, hard_negatives.mine(df, anchors, piece=8).collect())) == want  # several pieces
    assert hard_negatives.mine(df.where("false"), anchors).count() == 0


def plain_words(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def plain_variants(words):
    holes = {}
    for w in words:
        for k in range(len(w)):
            holes.setdefault((k, w[:k] + w[k + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for (k, short), group in holes.items():
        for w in group:
            near[w] |= group - {w}
            if short in words:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, c in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * c else None
    out = {}
    for w, c in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, c, len(near[w]), words[form[w]] if form[w] else None)
    return out


def test_spelling_equals_brute_force_on_a_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain_variants(plain_words(docs))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in entry.op12_spelling_variants(spark, SF).collect()}
    assert got == want and any(f for f, *_ in want.values())


def test_spelling_of_dense_words_in_split_lists(spark):
    rng = random.Random(8)
    letters = "abÀé"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 7))) for _ in range(700)]
    words += ["a" * 5, "a" * 6, "a" * 7, "x" * 39 + "y", "x" * 40, "x" * 41, "x" * 45 + "yz", "x" * 46 + "yz", "x" * 45 + "yy"]
    docs = []
    for k in range(60):
        docs.append((k, " ".join(w for w in words for _ in range(rng.choice([0, 0, 1, 4])))))
    docs += [(None, "Hello WORLD hello-world"), (70, None), (71, ""), (72, "!!"), (73, "Z" * 1500)] * 3
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, `word.n` int")
    want = plain_variants(plain_words(docs))
    for options in ({}, {"least": 5, "block_rows": 16}, {"least": 2, "max_grams": 100}):
        got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, **options).collect()}
        assert got == want
    assert spelling.variants(df.where("false")).count() == 0


def plain_targets(sizes, most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(most * sizes[s] for s in full)) / sum(weight[s] for s in rest) if rest else 0
        more = {s for s in rest if weight[s] * level > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in names}
        full |= more


def check_mix(df, tolerance):
    docs = [(r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in df.collect()]
    sums = Counter()
    for _, n, s in docs:
        sums[s] += n
    want = plain_targets(sums)
    got = mixing.mix(df).collect()
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 3)) for r in got) == Counter((i, n, sums[s], round(want[s], 3)) for i, n, s in docs)
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in got)
    of = {}
    for i, n, s in docs:
        assert of.setdefault((i, n), s) == s
    taken, smallest = Counter(), {}
    for r in got:
        s = of[r.doc_id, r.size]
        taken[s] += r.taken
        if 0 < r.size and r.copies < 3:
            smallest[s] = min(smallest.get(s, r.size), r.size)
    for s, t in want.items():
        assert 0 <= t + 0.51 - taken[s] <= max(tolerance * t, smallest.get(s, 0)) + 1.02, s
    return got, docs, want


def test_mix_meets_targets(spark):
    got, docs, want = check_mix(spark.read.parquet(f"{SF}/documents.parquet"), 0.01)
    # rates solve the dual: they are tilts of one multiplier a source and add up to the target
    source, by = {d[0]: d[2] for d in docs}, {}
    for r in got:
        by.setdefault(source[r.doc_id], []).append(r)
    for s, rows in by.items():
        assert abs(sum(r.rate * r.size for r in rows) / want[s] - 1) < 1e-4
        tilt = [np.log(r.rate) / r.size for r in rows if r.size > 20 and 0.01 < r.rate < 2.999]
        assert not tilt or max(tilt) - min(tilt) < 1e-5 + 1e-3 * abs(tilt[0])
    again = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet").repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_mix_of_odd_tables(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 30))), rng.choice(["a", "a", "a", "b", None, "é", "Z"]), 1) for i in range(400)]
    rows += [(1000, "word " * 200_000, "a", 1), (1001, None, "b", 1), (1002, "", "empty", 1), (None, "x y z", "a", 1)]
    rows += [(7000, "a b c d e f", "z", 1)] * 60
    schema = "doc_id long, text string, source string, `size.row` int"
    check_mix(spark.createDataFrame(rows, schema), 0.01)
    empty = spark.createDataFrame([], schema)
    assert mixing.mix(empty).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, None, "a", 1), (2, " ", None, 1)], schema)).collect()
    assert [(r.taken, r.target) for r in blank] == [(0, 0.0)] * 2
