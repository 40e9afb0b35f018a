"""Corpus operators against brute force, exact round trips and held-out accuracy, with awkward rows throughout."""

import collections
import hashlib
import io
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattiq.llm import ann, bpe, chat, entry, exact_dedup, langid, ngram_join, packing, passages, phrase_dedup, suffix_dedup
from lattiq.llm.components import connected_components
from lattiq.llm.signature_tree import Forest, bitmap, collisions, fold, traverse_all
from lattiq.session import table

SF = "/root/testdata/sf0.001"
SPACE = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, hash string, run int"


def small_corpus():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base = [text(n) for n in (3, 30, 60, 90, 120, 150, 200, 260)]
    passage = text(70)
    docs = base + [base[5], base[5], base[2] + "\n", base[6].replace("w1", "W1")]
    docs += [b[:200] + " " + passage + " " + b[200:] for b in (text(90), text(120), base[4])]
    near = base[7].split(" ")
    for k in range(4):
        docs.append(" ".join(near[:k * 9] + ["new"] + near[k * 9 :]))
    docs += [None, "", " \n ", "one two", "one  two", "ONE two", "é" * 500, "ab" * 900, "x " * 130, passage]
    rows = [(i, t, "clash", i % 3) for i, t in enumerate(docs)]
    rows.append(rows[4])  # a repeated row
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return small_corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(spark, docs, rows, empty):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", "", t or "") for i, t, *_ in rows}
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[norm[i]].append((-len(t or ""), i))
    got = exact_dedup.exact_groups(docs, runs=4, fan_in=2).collect()
    assert len(got) == len(rows)
    for r in got:
        g = groups[norm[r.doc_id]]
        assert r.keep_id == min(g)[1] and r.group_size == len(g) and r.kept == (r.doc_id == r.keep_id)
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g)[1] for g in groups.values())
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_dedup_twin(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = entry.op10_exact_dedup(spark, SF)
    mine = sorted(tuple(r) for r in got.collect())
    assert mine == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({entry.OP10_SQL})").fetchall())


def shingles(text):
    w = re.findall(SPACE, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block", [256, 2])
def test_jaccard_components(docs, rows, block):
    want = components(rows)
    got = ngram_join.jaccard_components(docs, block=block).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_jaccard_empty_and_one_of_each(docs, rows, empty):
    assert ngram_join.jaccard_components(empty).count() == 0
    want = components(rows)
    stay = {r.doc_id for r in ngram_join.one_of_each(docs).collect()}
    assert stay == {i for i, (_, c) in want.items() if i == c}


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(2)
    sets = []
    for n in (5, 40, 900, 1300, 1500, 4200, 5600):
        s = rng.integers(0, 2**63, n, dtype=np.uint64)
        for _ in range(4):
            drop = rng.random(n) < rng.uniform(0, 0.15)
            sets.append(np.unique(np.concatenate([s[~drop], rng.integers(0, 2**63, int(drop.sum() * rng.uniform(0, 1)), dtype=np.uint64)])))
    n = np.array([len(s) for s in sets])
    maps = [bitmap(s) for s in sets]
    seen = set()
    traverse_all(n, n, maps, [collisions(len(s), m) for s, m in zip(sets, maps)], np.arange(len(sets)), 80, lambda i, j: seen.add((min(i, j), max(i, j))), lambda x, y: False)
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if ngram_join.similar(sets[i], sets[j], 80)}
    assert true and true <= seen
    assert Forest(3).join(0, 2)


@pytest.mark.parametrize("limit", [1200, 5000])
def test_signature_tree_loses_no_pair_of_nodes_across_widths(limit):
    rng = np.random.default_rng(limit)
    nodes = []
    for _ in range(12):
        text = rng.integers(0, 2**63, limit * 2, dtype=np.uint64)
        sizes = np.cumprod([limit * rng.uniform(0.7, 0.99)] + [rng.uniform(1.01, 1.24)] * 4).astype(int)
        cut = int(rng.integers(1, 4))
        nodes += [[np.sort(text[:n]) for n in part] for part in (sizes[:cut], sizes[cut:])]
    lo, hi = (np.array([f(len(s) for s in node) for node in nodes]) for f in (min, max))
    maps, extra = [], []
    for node in nodes:  # as ngram_join._signatures makes them
        own = [bitmap(s) for s in node]
        extra.append([max(c) for c in zip(*[collisions(len(s), m) for s, m in zip(node, own)])])
        width = min(map(len, own))
        maps.append(np.bitwise_or.reduce([fold(m, width) for m in own]))
    seen = set()
    traverse_all(lo, hi, maps, extra, np.arange(len(nodes)), 80, lambda i, j: seen.add((min(i, j), max(i, j))), lambda x, y: False)
    true = {(i, j) for i in range(len(nodes)) for j in range(i + 1, len(nodes)) if any(ngram_join.similar(a, b, 80) for a in nodes[i] for b in nodes[j])}
    assert true and true <= seen


@pytest.mark.parametrize("sizes", [(1100, 1300, 1600), (4700, 5300, 6500)])
def test_jaccard_of_growing_texts_across_widths(spark, sizes):
    rows = []
    for k in range(8):  # whichever version heads the star, the others are joined
        words = [f"v{k}w{i}" for i in range(sizes[-1] + 4)]
        rows += [(10 * k + i, " ".join(words[: n + 4])) for i, n in enumerate(sizes)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {}
    for k in range(0, len(rows), len(sizes)):
        want |= components(rows[k : k + len(sizes)])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_connected_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 200), (200, 300), (7, 7), (300, 100)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and got[300] == 100 and {got[k] for k in range(500, 560)} == {500}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("rows", [2, 7, 200_000])
def test_connected_components_in_tasks_of_any_size(spark, rows):
    rng = np.random.default_rng(rows)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100, k) for k in range(101, 130)] + [(100, 101)] * 5
    up: dict[int, int] = {}
    for _ in range(60):
        for a, b in pairs:
            if a != b:
                up[a] = up[b] = min(up.get(a, a), up.get(b, b))
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    assert {r.node: r.label for r in connected_components(edges, rows).collect()} == up


def test_bpe_equals_the_tokenizer(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    mine = bpe.ByteBpe(bpe.default_path())
    rng = random.Random(4)
    letters = "abcde  \n\t'sLl019éßçА中🙂½²\x1c\x85 ​_-!<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 3000, "ab" * 400, "hi <|endoftext|> you<|endoftext|>", " " * 500, "", "é" * 90]
    for text, got in zip(texts, mine.encode_batch(texts)):
        ids = np.frombuffer(got, "<u4").tolist()
        assert ids == tok.encode(text, add_special_tokens=False).ids, text
        assert mine.decode(got) == text == tok.decode(ids, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe.digest_documents(docs).collect()}
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(empty).count() == 0


def phrases(rows, size):
    first, out = {}, {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = re.findall(SPACE, t or "")
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    for i, t, *_ in rows:
        w = re.findall(SPACE, t or "")
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = True
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_phrase_dedup(docs, rows, hot):
    got = phrase_dedup.dedup_phrases(docs, hot=hot).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == phrases(rows, 50)


def repeats(rows, size):
    count, out = collections.Counter(), {}
    for _, t, *_ in rows:
        b = (t or "").encode()
        count.update(b[k : k + size] for k in range(len(b) - size + 1))
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - size + 1):
            if count[b[k : k + size]] > 1:
                gone[k : k + size] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup(docs, rows, hot):
    got = suffix_dedup.dedup_bytes(docs, hot=hot).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == repeats(rows, 400)


def test_passages_of_an_empty_table(empty):
    assert phrase_dedup.dedup_phrases(empty).count() == 0 and suffix_dedup.dedup_bytes(empty).count() == 0


def test_long_texts_are_read_in_segments(spark, monkeypatch):
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh ") for _ in range(9000))
    rows = [(1, a), (2, a[3000:6000] + "#" + a[:700]), (3, "q" * 900)]
    win = passages.Windows(400, 64, suffix_dedup.read_bytes)
    monkeypatch.setattr(passages, "_SEGMENT", 1000)
    units, _ = win.read(a)
    cut = [(s + x, s + y, v) for s, _, xs, ys, vs in win.runs(units) for x, y, v in zip(xs, ys, vs)]
    monkeypatch.setattr(passages, "_SEGMENT", 1 << 18)
    whole = {k: v for s, _, xs, ys, vs in win.runs(units) for x, y, v in zip(xs, ys, vs) for k in range(x, y)}
    assert all(whole[k] == v for x, y, v in cut for k in range(x, y)) and sum(y - x for x, y, _ in cut) == len(whole)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_bytes(df).collect()}
    assert got == repeats(rows, 400)


def test_interval_expansion_gives_common_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(30):
        parts = [rng.integers(0, 3, rng.integers(1, 60)) for _ in range(4)]
        parts.append(parts[0])
        codes = np.concatenate([np.append(p, 3 + k) for k, p in enumerate(parts)]).astype(np.int64)
        order = suffix_dedup.suffix_order(codes)
        tails = [tuple(codes[k:]) for k in order]
        assert tails == sorted(tails)
        lcp = suffix_dedup.bounded_lcp(codes, order, 3, 12)
        for k in range(1, len(codes)):
            same = next(n for n, (x, y) in enumerate(zip(tails[k - 1], tails[k])) if x != y)
            assert lcp[k] == (same if same < 12 else -1)


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    got = packing.pack(docs, capacity=64, slack=0, group_items=5).toPandas().sort_values(["sequence_id", "offset"])
    for _, g in got.groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.cumsum(g.length) - g.length).all() and g.length.sum() <= 64
    assert got.sequence_id.nunique() <= 1.1 * np.ceil(got.length.sum() / 64)
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        p = got[got.doc_id == i].drop_duplicates("piece").sort_values("piece")
        assert p.length.sum() == len(ids) and (p.length.iloc[1:] == 64).all() and list(p.start) == list(np.cumsum(p.length) - p.length)
        for s, n, c in zip(p.start, p.length, p.ids_crc32):
            assert c == zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())
    assert packing.pack(empty).count() == 0


def test_packing_lets_texts_go():
    one = pa.record_batch({"doc_id": pa.array([1, 2, None]), "text": ["x" * 400_000, None, "y" * 600_000]})
    stream = io.BytesIO()
    with pa.ipc.new_stream(stream, one.schema) as out:
        for _ in range(20):
            out.write_batch(one)
    stream.seek(0)
    tracemalloc.start()
    ids, cols = packing.collect_pieces(pa.ipc.open_stream(stream), lambda texts: [b"\1\0\0\0" * (len(t or "") // 100_000) for t in texts], 4)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 2_000_000  # of 20 MB
    assert pa.concat_arrays(ids).to_pylist() == [1, 1, 2, None, None] * 20
    assert [c.tolist()[:5] for c in cols[:3]] == [[0, 1, 0, 0, 1], [0, 1, 0, 0, 3], [1, 4, 1, 3, 4]]


def test_the_cache_of_words_is_small():
    encoder, letters = bpe.ByteBpe(bpe.default_path()), str.maketrans("0123456789", "ghijklmnop")
    for k in range(0, 120_000, 6_000):
        encoder.encode_batch([" ".join(f"w{x:x}".translate(letters) for x in range(k, k + 6_000))])
        assert len(encoder.cache) <= 60_000


def test_best_fit_is_tight():
    sizes = np.random.default_rng(0).integers(1, 1025, 5000)
    bins, offsets = packing.best_fit(sizes, 1024)
    fill = np.bincount(bins, weights=sizes)
    assert fill.max() <= 1024 and len(fill) <= np.ceil(sizes.sum() / 1024) * 1.01


def test_language_id_on_held_out_documents(spark):
    d = table(spark, SF, "documents")
    got = entry.op6_language_id(spark, SF).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == d.count() and len(held) and (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ,. 34"), (4, "the the of and " * 80_000)], "doc_id long, text string")
    model = langid.fit(d)
    seen = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [seen[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and seen[4].lang_pred == "en"
    assert {r.doc_id for r in langid.keep_identified(odd, model).collect()} == {4}
    assert langid.identify(odd, langid.fit(d.where("lang IS NULL"))).where("lang_pred <> 'und'").count() == 0


def test_neighbours_against_brute_force(spark):
    e = table(spark, SF, "embeddings")
    got = ann.search(e, F.col("vec_id") % 100 == 0, rows_per_part=60, sample_rows=500).collect()
    true = set(exact_search(e, F.col("vec_id") % 100 == 0))
    assert len(got) == len(true) and len({(r.query_id, r.vec_id) for r in got} & true) >= 0.9 * len(true)


def exact_search(vectors, is_query, k=10):
    """Brute force, to measure recall against."""
    good = vectors.where(ann.usable(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("v"), is_query.alias("q")).collect()
    out = []
    for q in (r for r in good if r.q):
        near = sorted((float(np.sqrt(((np.array(r.v) - np.array(q.v)) ** 2).sum())), r.vec_id) for r in good if r.vec_id != q.vec_id)
        out += [(q.vec_id, v) for _, v in near[:k]]
    return out


def test_stages_with_clashing_columns_and_extreme_ids(spark):
    names = ("_stay", "_key", "_won", "stay", "won", "times", "row", "label", "token")
    least = -(2**63)
    text = "one two three four five six seven"
    rows = [(least, text, *names), (5, text + " ", *names), (5, text + " ", *names), (None, None, *names), (7, "", *names), (8, text + " eight", *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string" + "".join(f", {n} string" for n in names))
    groups = {(r.doc_id, r.kept, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(df).collect()}
    assert groups == {(least, False, 5, 3), (5, True, 5, 3), (None, False, 7, 2), (7, True, 7, 2), (8, True, 8, 1)}
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [5, 7, 8]
    near = ngram_join.one_of_each(df)
    assert near.columns == df.columns and {r.doc_id for r in near.collect()} == {least, None, 7, 8}


def test_planted_passages_around_the_threshold(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    rows, want = [], {}
    for i, length in enumerate((60, 399, 400, 401, 700)):
        passage = word(length)
        for side in (0, 1):
            rows.append((2 * i + side, word(50) + "AB"[side] + passage + "CD"[side] + word(60)))
            want[2 * i + side] = (length if length >= 400 else 0)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup_bytes(df).collect()}
    assert got == want


def test_neighbours_of_awkward_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, nan]), (5, [1.0, None]), (6, [float("inf"), 1.0]), (7, [2.0, 0.0]), (8, [1.0, 2.0, 3.0]), (100, [1.0, 0.0]), (200, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, F.col("vec_id") % 100 == 0, block_rows=2).collect()]
    assert sorted(got) == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 7, 1.0), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 7, 1.0)]
    assert ann.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def brute_viterbi(model, seen):
    import itertools

    score = sum(e[:, seen[:, k]] for k, e in enumerate(model.emit)).T

    def total(path):
        return model.start[path[0]] + sum(score[t, s] for t, s in enumerate(path)) + sum(model.step[a, b] for a, b in itertools.pairwise(path))

    return max(total(p) for p in itertools.product(range(len(model.start)), repeat=len(seen))), total


def test_viterbi_and_rendering(spark):
    written = chat.transcripts(table(spark, SF, "conversations")).collect()
    model = chat.fit([chat.labelled_lines([t.asDict() for t in r.turns], r.style) for r in written])
    for r in written[:5]:
        seen = chat.features(r.transcript.split("\n"))[:5]
        best, total = brute_viterbi(model, seen)
        assert total(model.decode(seen).tolist()) == pytest.approx(best)
    right = [[p[0] for p in chat.parse(r.transcript, model)] == [t.role for t in r.turns] for r in written]
    assert np.mean(right) > 0.95
    turns = chat.parse("User: what is <|end|>?\n\nAssistant: this\n- one\n- two", model)
    assert [t[0] for t in turns] == ["user", "assistant"] and turns[1][1] == "this\n- one\n- two"
    assert chat.render(turns[:1]) == "<|user|>\nwhat is < |end|>?\n<|end|>\n"
    assert chat.parse(None, model) == [] and chat.parse(" \n", model) == []


def test_awkward_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, None, None), (2, None, "tool", "x"), (None, 3, "assistant", "a\nb")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    w = chat.transcripts(df)
    out = chat.format_transcripts(w, chat.fit_on(w)).collect()
    assert len(out) == 3 and all(r.rendered is not None for r in out)
    none = chat.transcripts(df.limit(0))
    assert chat.format_transcripts(none, chat.fit_on(none)).count() == 0


def test_interval_expansion_of_small_strings():
    """The kernel alone, against counting, with few letters and so with long and periodic repeats."""
    for seed in range(60):
        rng = random.Random(seed)
        letters, size = bytes(rng.sample(range(256), rng.choice([1, 2, 4, 20]))), rng.choice([3, 9, 12, 20])
        base = bytes(rng.choice(letters) for _ in range(60))
        noise = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 15))) for _ in range(12)]
        texts = sorted({noise[2 * k] + base[rng.randint(0, 20) : rng.randint(21, 60)] + noise[2 * k + 1] for k in range(rng.randint(1, 6))})
        texts = [t for t in texts if len(t) >= size]
        if not texts:
            continue
        n = len(texts)
        marks = suffix_dedup.expand(size, 3)([1] * n, texts, [0] * n, [1] * n, [-1] * n)
        seen = collections.Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
        want = [{i for i in range(len(t) - size + 1) if seen[t[i : i + size]] > 1} for t in texts]
        assert [{i for a, b, _ in m for i in range(a, b + 1)} for m in marks] == want
