"""The numpy parts and single operators against plain versions."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from suitelens.llm import decontaminate, langid, packing, prefix_doubling, repeats, sharding, shingle_join, simple8b, suffix_trees, topk, words
from suitelens.llm.repeats import window_names_sliced
from suitelens.llm.token_store import pack_block, unpack_block
from tests.llm import brute


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 15) | st.integers(0, 70_000) | st.integers(0, (1 << 60) - 1) | st.just(0), max_size=1500))
def test_simple8b_round_trip(ids):
    a = np.array(ids, np.uint64)
    coded, lanes = simple8b.encode(a)
    assert np.array_equal(simple8b.decode(coded, lanes, len(a)), a)
    assert len(lanes) == -(-len(a) // simple8b.LANE) + 1


def test_simple8b_packs_small_ids_densely():
    assert len(simple8b.encode(np.ones(512, np.uint64))[0]) == 9
    assert len(simple8b.encode(np.full(300, 1000, np.uint64))[0]) == 50


def test_block_round_trip():
    rng = np.random.default_rng(1)
    counts = np.array([0, 5, 1, 2000, 0, 3])
    ids = rng.integers(0, 50_000, counts.sum()).astype(np.uint32)
    docs = np.array([-5, 0, 1, 2, 2, 1 << 40])
    back = unpack_block(pack_block(docs, counts, ids))
    assert all(np.array_equal(x, y) for x, y in zip(back, (docs, counts, ids), strict=True))
    with pytest.raises(ValueError):
        unpack_block(b"none" + bytes(40))


def best_by_trying(places, cost, size):
    least = None
    inner = list(range(1, len(places) - 1))
    for k in range(len(inner) + 1):
        for some in itertools.combinations(inner, k):
            cuts = [0, *some, len(places) - 1]
            sizes = [places[b] - places[a] for a, b in zip(cuts, cuts[1:])]
            if max(sizes) <= size:
                # windows of small powers of two are transitions at the end only
                c = sum(packing.padding(n, size) if n >= size // 8 or k == len(sizes) - 1 else size - n for k, n in enumerate(sizes))
                c += sum(cost[j] for j in cuts[1:])
                least = c if least is None else min(least, c)
    return least


def test_packing_is_optimal():
    rng = random.Random(2)
    for _ in range(60):
        size = 16
        total = rng.randint(1, 60)
        ends = np.array(sorted({*rng.sample(range(1, total + 1), min(total, 3)), total}))
        stops = np.array(sorted(rng.sample(range(1, total + 1), min(total, 4))))
        places, cost = packing.allowed_cuts(ends, stops, size)
        if len(places) > 16:
            continue
        cuts = packing.best_cuts(places, cost, size)
        assert cuts[0] == 0 and cuts[-1] == total and np.diff(cuts).max() <= size
        price = dict(zip(places.tolist(), cost.tolist(), strict=True))
        sizes = np.diff(cuts).tolist()
        got = sum(packing.padding(n, size) if n >= size // 8 or k == len(sizes) - 1 else size - n for k, n in enumerate(sizes))
        assert got + sum(price[c] for c in cuts[1:].tolist()) == best_by_trying(places.tolist(), cost.tolist(), size)


def test_window_names_and_ranks():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 3, 400).astype(np.uint8)
    for width in (1, 2, 5, 8, 20, 50):
        names = window_names_sliced(words.mix(data.astype(np.uint64)), width)
        seen = {}
        for i, n in enumerate(names.tolist()):
            assert seen.setdefault(n, bytes(data[i:i + width])) == bytes(data[i:i + width])
        assert len(set(names.tolist())) == len({bytes(data[i:i + width]) for i in range(400 - width + 1)})
    small = rng.integers(0, 2, 300).astype(np.uint64)
    starts = np.arange(0, 290)
    for method in (prefix_doubling.rank_windows, suffix_trees.repeat_numbers):
        number = method(words.mix(small), starts, 6)
        want = {}
        for s, r in zip(starts.tolist(), number.tolist(), strict=True):
            assert want.setdefault(r, bytes(small[s:s + 6])) == bytes(small[s:s + 6])
        assert len(want) == len({bytes(small[s:s + 6]) for s in starts.tolist()})


@pytest.mark.parametrize("letters,limit", [(2, 7), (2, 1 << 15), (5, 1), (30, 40)])
def test_suffix_trees_against_all_windows(letters, limit):
    rng = np.random.default_rng(letters + limit)
    width = 6
    text = rng.integers(0, letters, 500).astype(np.uint64)
    text[300:340], text[400:440] = text[100:140], text[100:140]
    starts = np.concatenate([np.arange(a, a + n) for a, n in ((0, 1), (8, 7), (40, 3), (98, 7), (298, 7), (399, 4), (420, 7), (120, 7), (480, 7))])
    window = [tuple(text[s:s + width].tolist()) for s in starts.tolist()]
    number = suffix_trees.repeat_numbers(words.mix(text), starts, width, limit)
    assert len(set(zip(window, number.tolist(), strict=True))) == len(set(window)) == len(set(number.tolist()))
    # groups hold whole prefixes, each suffix at most once, and all that share a window
    rank = np.unique(text, return_inverse=True)[1] + 1
    groups = [g.tolist() for g in suffix_trees.prefix_groups(rank, starts, width, limit)]
    held = [i for g in groups for i in g]
    assert len(held) == len(set(held)) and {i for i, w in enumerate(window) if window.count(w) > 1} <= set(held)
    assert all(len(g) <= limit or len({window[i] for i in g}) == 1 for g in groups)
    assert all({window[i] for i in g}.isdisjoint(window[i] for i in set(held) - set(g)) for g in groups)
    # topmost deep nodes: each repeated window once; no longer string has the same places within the contexts
    stops = suffix_trees.context_stops(starts, width)
    order, common = suffix_trees.sorted_leaves(rank, starts, stops)
    suffix = [tuple(text[starts[i]:stops[i]].tolist()) for i in order.tolist()]
    assert [s for s in suffix] == sorted(suffix)
    nodes = list(zip(*(x.tolist() for x in suffix_trees.deep_nodes(common, width)), strict=True))
    assert sorted(suffix[a][:width] for a, _, _ in nodes) == sorted(w for w in set(window) if window.count(w) > 1)
    for a, n, d in nodes:
        leaves = suffix[a:a + n]
        assert n == window.count(leaves[0][:width]) and len({s[:d] for s in leaves}) == 1
        assert min(map(len, leaves)) == d or len({s[:d + 1] for s in leaves}) > 1


@pytest.mark.parametrize("width", [5, 8, 20, 50])
def test_prefix_doubling_by_sorts(spark, width):
    rng = random.Random(width)
    texts = ["".join(rng.choice("abü") for _ in range(rng.randint(0, 150))) for _ in range(12)]
    texts += [texts[0], texts[1][20:90] + texts[2], "x" * 200, "x" * 120, "", None]
    docs = [(i if i != 3 else None, t) for i, t in enumerate(texts)] + [(5, texts[5])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    places = {}
    for i, t in docs:
        data = (t or "").encode()
        for a in range(len(data) - width + 1):
            places.setdefault(data[a:a + width], []).append((i, a))
    want = sorted(sorted(map(str, p)) for p in places.values() if len(p) > 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {}
        for r in prefix_doubling.repeated_strings(df, width).collect():
            got.setdefault(r.rank, []).append((r.doc_id, r.start))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(sorted(map(str, p)) for p in got.values()) == want


def test_prefix_tree_finds_all_links():
    rng = random.Random(5)
    base = rng.sample(range(1, 10_000), 80)
    sets = [np.array(sorted({*rng.sample(base, rng.randint(40, 80)), *rng.sample(range(10_000, 20_000), rng.randint(0, 25))}), np.uint64)
            for _ in range(60)] + [np.zeros(0, np.uint64)]
    tree = shingle_join.PrefixTree(sets)
    for probe in sets[:30]:
        got = tree.overlaps(probe).tolist()
        for s, o in zip(sets, got, strict=True):
            both = len(np.intersect1d(s, probe))
            linked = 100 * both >= 75 * (len(s) + len(probe) - both) and len(s) > 0
            assert (o == both) if linked else (o == -1 or len(s) == 0)


def test_longer_vectors_behind_shorter_ones():
    rng = np.random.default_rng(7)
    v = rng.integers(-256, 256, (3000, 8)).astype(float)
    v[:1500] //= 64  # a file of short vectors before one of long ones, within a step and across steps
    norm2, ids = (v ** 2).sum(1), np.arange(3000)
    asked = np.arange(0, 3000, 100)
    block = topk.Queries(asked, asked, v[asked], np.linalg.svd(v.T @ v)[0], 5, (ids[1500:2500], v[1500:2500]))
    for size in (3000, 700):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[a:a + size]) for c in (ids, ids)] + [pa.array(v[a:a + size].astype(int).tolist()),
                   pa.array(norm2[a:a + size])], names=["row", "vec_id", "v", "norm2"]) for a in range(0, 3000, size)]
        got = {(h["query"], h["row"]): h["score"] for b in block.search(iter(batches)) for h in b.to_pylist()}
        for q in asked.tolist():
            scores = np.delete(v @ v[q], q)
            assert sorted((s for (one, _), s in got.items() if one == q), reverse=True) == sorted(scores.tolist(), reverse=True)[:5]


def test_top_products_of_more_files_than_cores(spark, monkeypatch):
    monkeypatch.setattr(topk, "PARTITION_VALUES", 320)
    monkeypatch.setattr(topk, "STEP", 16)
    monkeypatch.setattr(topk, "HEAD", 16)
    rng = np.random.default_rng(8)
    v = np.floor(256 * (rng.normal(size=(2400, 8)) * np.exp(rng.uniform(-3, 3, (2400, 1))))) / 256
    docs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    known = topk.quantised(docs)
    assert known.inputFiles() and len(known.inputFiles()) > 2 * known.rdd.getNumPartitions()
    got = {(r.query_id, r["rank"]): r.score for r in topk.top_products(docs, F.col("vec_id") % 40 == 0).collect()}
    scaled = 256 * v
    for q in range(0, 2400, 40):
        scores = np.sort(np.delete(scaled @ scaled[q], q))[::-1][:5]
        assert [got[q, k] for k in range(1, 6)] == scores.tolist()


def hot_string_texts(words_):
    """Texts around one string that is shorter than a window, some of them around a longer passage too."""
    rng = random.Random(11)
    hot = "see http://example.org/a for terms" if not words_ else " ".join(f"hot{k}" for k in range(14))
    out = []
    for i in range(300):
        a, z = (" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) + str(rng.randrange(10**6)) for _ in range(25)) for _ in range(2))
        out.append((i, f"{a} {hot} {z}"))
        if i % 10 == 9:  # a window with the hot string in it that starts earlier, in another and in the same text
            out.append((1000 + i, f"x {' '.join(a.split()[-12:])} {hot} {' '.join(z.split()[:12])} y"))
            out.append((2000 + i, f"{hot} {z} {hot} {z}"))
    return out


@pytest.mark.parametrize("most", [0, 40, None])
@pytest.mark.parametrize("words_", [False, True])
def test_windows_of_a_hot_string_are_dealt_evenly(spark, monkeypatch, words_, most):
    rows = hot_string_texts(words_)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9, "doc_id")
    kind = repeats.Symbols(words=words_, width=20 if words_ else 50, gram=8 if words_ else 20, strict=not words_)
    if most is not None:
        monkeypatch.setattr(repeats, "HEAVY_CONTEXTS", most)
    out = (suffix_trees.dedup_words if words_ else prefix_doubling.dedup_substrings)(docs).select("doc_id", "n_symbols", "n_removed", "kept").collect()
    got = sorted((r.doc_id, r.n_symbols, r.n_removed, brute.sha(bytes(r.kept))) for r in out)
    want = brute.op2(rows) if words_ else [(d, n, gone, kept) for d, n, gone, _, kept in brute.op5(rows)]
    assert got == want
    if most == 40:  # a bucket's share of the hot windows
        batches = repeats.pack_batches(docs, "doc_id", "text")
        answers = repeats._repeated_anchors(batches, kind, 12, most)
        assert answers.agg(F.sum("n_heavy")).first()[0] > 200
        sent = repeats._sent_windows(repeats.with_answers(batches, answers.select("batch", "bucket", "bits"), "anchors"), kind, 12, 12)
        size = sorted(r["sum(n)"] for r in sent.select("bucket", (F.length("body") + F.length("heavy")).alias("n")).groupBy("bucket").sum("n").collect())
        assert len(size) == 12 and size[-1] < 0.15 * sum(size)  # by anchor it is 0.17 for bytes, 0.26 for words


@pytest.mark.parametrize("most", [0, 40])
@pytest.mark.parametrize("words_", [False, True])
def test_buckets_grow_before_there_are_more_of_them(spark, monkeypatch, words_, most):
    """Each batch has a message for nearly every bucket, so their number must not grow with the batches'."""
    rows = hot_string_texts(words_)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9, "doc_id")
    for name, value in (("HEAVY_CONTEXTS", most), ("BUCKET_ANCHORS", 64), ("BUCKET_WINDOWS", 256), ("MOST_SLICES", 32), ("ENOUGH_BUCKETS", 4)):
        monkeypatch.setattr(repeats, name, value, raising=False)
    real, used = repeats.dealt, []
    monkeypatch.setattr(repeats, "dealt", lambda df, buckets: used.append(buckets) or real(df, buckets))
    out = (suffix_trees.dedup_words if words_ else prefix_doubling.dedup_substrings)(docs).select("doc_id", "n_symbols", "n_removed", "kept").collect()
    got = sorted((r.doc_id, r.n_symbols, r.n_removed, brute.sha(bytes(r.kept))) for r in out)
    assert got == (brute.op2(rows) if words_ else [(d, n, gone, kept) for d, n, gone, _, kept in brute.op5(rows)])
    assert len(used) == 2 and max(used) == 12  # as many as there are at least; one slice each makes hundreds


def test_benchmark_in_blocks(spark, tables, doc_rows, monkeypatch):
    docs, items = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/benchmark.parquet")
    monkeypatch.setattr(decontaminate.benchmark_blocks, "__defaults__", ("item_id", "text", 60))
    out = decontaminate.find_matches(docs, items)
    want = brute.op7(doc_rows, [(r.item_id, r.text) for r in items.collect()])
    assert sorted((r.doc_id, r.n_words, len(r.hits), len(r["items"])) for r in out.collect()) == [w[:4] for w in want]
    clean = decontaminate.decontaminate(docs, items)
    assert sorted(r.doc_id for r in clean.collect()) == [w[0] for w in want if not w[5]] and clean.columns == docs.columns
    for r in out.collect():
        assert {m.doc_word + k for m in r.matches for k in range(m.n_words)} == set(r.hits)


def test_language_accuracy_on_held_out_documents(spark):
    rng = random.Random(1)
    parts = {"aa": ["ka", "ti", "mo", "ren", "sul"], "bb": ["ax", "ti", "ol", "ren", "quo"], "cc": ["éa", "ñi", "mo", "ßu", "lä"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), lang)
            for i in range(900) for lang in [rng.choice(list(parts))]]
    rows += [(2000, None, "aa"), (2001, "12 .. 4", "bb"), (2002, "", None), (2003, "ka ti", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, allowed=~langid.held_out())
    out = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    held = [r for r in spark.createDataFrame(rows, docs.schema).where(langid.held_out()).collect() if r.doc_id < 2000]
    assert np.mean([out[r.doc_id].lang_pred == r.lang for r in held]) >= 0.97
    assert all(out[d].lang_pred == "und" and out[d].score == 0 and out[d].rejected for d in (2000, 2001, 2002))
    assert sum(out[r.doc_id].rejected for r in held) <= 0.02 * len(held)
    scores = [out[r.doc_id].score for r in held]
    assert 0 <= min(scores) and max(scores) <= 1


def test_language_of_one_or_no_label(spark):
    docs = spark.createDataFrame([(1, "ab", "x"), (2, "cd", None), (3, None, "x")], "doc_id long, text string, lang string")
    out = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert out == {1: "x", 2: "x", 3: "und"}
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.predict(none, langid.fit(none)).collect()} == {"und"}


def test_language_training_keeps_no_ngrams_of_whole_texts():
    import tracemalloc

    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 123, langid.DOCUMENT_BYTES, np.uint8).tobytes() for _ in range(300)]
    tracemalloc.start()
    try:
        langid.train(texts, np.arange(300) % 2, ["aa", "bb"], epochs=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # the embeddings and the texts, and no twelve bytes for each byte of text
    assert peak < 10 * sum(map(len, texts))


def test_shards_keep_groups_and_split_hot_ones(spark):
    rows = [(i, f"text {i % 50}") for i in range(200)] + [(1000 + i, "hot") for i in range(300)] + [(2000 + i, f"single {i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard_documents(docs, shards=8).collect()
    text = dict(rows)
    by_text, counts = {}, {}
    for r in out:
        by_text.setdefault(text[r.doc_id], set()).add(r.shard)
        counts[r.shard] = counts.get(r.shard, 0) + 1
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 8
    assert len(by_text["hot"]) <= 5
    assert [t for t, s in by_text.items() if len(s) > 1 and t != "hot"] == []  # no group that fits is cut beside a hot one


@pytest.mark.parametrize("copies, groups, hot, singles, shards", [(12, 60, 400, 200, 10), (3, 300, 0, 0, 6), (30, 12, 350, 100, 8)])
def test_shards_cut_no_group_that_fits(spark, copies, groups, hot, singles, shards):
    rows = [(i, f"text {i % groups}") for i in range(copies * groups)] + [(10_000 + i, "hot") for i in range(hot)] + [(20_000 + i, f"single {i}") for i in range(singles)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=shards).collect()
    text, by_text, counts = dict(rows), {}, {}
    for r in out:
        by_text.setdefault(text[r.doc_id], set()).add(r.shard)
        counts[r.shard] = counts.get(r.shard, 0) + 1
    assert len(out) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    cut = [t for t, s in by_text.items() if len(s) > 1 and t != "hot"]
    # a shard's end may cut the one group that lies across it when there are no single documents to fill it with
    assert len(cut) <= (0 if singles else shards)


def test_links_of_the_join(spark, doc_rows):
    docs = spark.createDataFrame(doc_rows, "doc_id long, text string")
    _, links = shingle_join.jaccard_classes(docs, links=True)
    sets = {d: brute.shingles(t) for d, t in doc_rows}
    rows = links.collect()
    assert rows
    for r in rows:
        assert (r.overlap, r.union) == (len(sets[r.a] & sets[r.b]), len(sets[r.a] | sets[r.b])) and 100 * r.overlap >= 75 * r.union


def test_repeated_rows_of_one_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (3, text + " more"), (None, "x")], "doc_id long, text string")
    out = prefix_doubling.dedup_substrings(docs).select("doc_id", "n_removed").collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in out) == [(0, 0), (1, 0), (1, 0), (2, len(text)), (3, len(text))]
    classes = shingle_join.jaccard_classes(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in classes) == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 1)]
    assert sorted(r.doc_id or 0 for r in shingle_join.keep_one(docs).collect()) == [0, 1]


def test_components_of_random_links(spark):
    from suitelens.llm.components import components
    rng = random.Random(8)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, k) for k in range(1001, 1060)] + \
        [(k, k + 1) for k in range(2000, 2040)] + [(5, 5)]
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: top(x) for x in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def thue_morse(bits, a="a", b="b"):
    out = a, b
    for _ in range(bits):
        out = out[0] + out[1], out[1] + out[0]
    return out


def test_words_that_collide_under_polynomials_have_their_own_names():
    one, two = thue_morse(10)
    assert len(one) == 1024 and one != two
    for kind in (np.uint8, np.uint32):
        data = np.frombuffer((one + two).encode(), np.uint8).astype(kind)
        for key in (0, words.fresh_key()):
            a, b = words.word_names(data, np.array([0, 1024]), np.array([1024, 2048]), key).tolist()
            assert a != b


def test_colliding_words_in_all_operators(spark):
    import hashlib

    from suitelens.llm import tokens
    from suitelens.llm.common import END_ID, new_shared_dir, tokenizer_path
    from suitelens.llm.token_store import read_checksums, write_tokens
    one, two = thue_morse(10)
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer_path())
    ids, n = tokens.Encoder(tokenizer_path()).encode([one, two])
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tok.encode(t, add_special_tokens=False).ids for t in (one, two)]
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join([*base[:10], w, *base[10:20]]) for w in (one, two)] + [one, two] + [" ".join([*base, w, *base[::-1]]) for w in (one, two)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_symbols, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_trees.dedup_words(df).collect())
    assert got == brute.op2(rows)
    assert sorted(tuple(r) for r in shingle_join.jaccard_classes(df).collect()) == brute.op8(rows)
    path = new_shared_dir(spark, "colliding")
    write_tokens(df, path, tokenizer_path(), END_ID)
    got = sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in read_checksums(spark, path).collect())
    assert got == [(d, k, c) for d, _, k, c in brute.op1(rows, lambda t: tok.encode(t, add_special_tokens=False).ids)]


def test_language_rejects_gibberish_and_unlearned_alphabets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, allowed=~langid.held_out())
    rng = random.Random(6)

    def noise(letters):
        return [" ".join("".join(rng.choices(letters, k=rng.randint(2, 10))) for _ in range(rng.randint(8, 60))) for _ in range(300)]

    for letters in ("abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω"):
        odd = spark.createDataFrame(list(enumerate(noise(letters))), "doc_id long, text string")
        assert langid.predict(odd, model).filter("rejected").count() >= 0.95 * 300
    clean = langid.predict(docs.filter(langid.held_out()).filter("lang is not null and text is not null"), model)
    assert clean.filter("rejected").count() <= 0.02 * clean.count()
    assert clean.filter("lang = lang_pred").count() >= 0.95 * clean.count()


def test_language_of_long_texts_is_learned(spark):
    rng = random.Random(2)
    long = ["".join(rng.choices(["ka", "ti ", "mo"], k=1500)) for _ in range(40)]
    short = ["".join(rng.choices(["xo", "qu ", "zze"], k=60)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([*((t, "long") for t in long), *((t, "short") for t in short)])],
                                 "doc_id long, text string, lang string")
    model = langid.fit(docs, document_bytes=1000)
    assert model.languages == ["long", "short"]
    assert langid.predict(docs, model).filter("lang_pred = lang and not rejected").count() == 80
