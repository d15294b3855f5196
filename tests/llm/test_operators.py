"""Each operator against a plain Python version, with the odd cases: nulls, empty and very long texts, ties,
repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import byte_bpe, chat_windows, chunked_text, components, dominance_packing, embedding_dedup, order_minhash, quality_cascade, quality_gbt, token_matrices, toxicity_ftrl, url_filter

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PLAIN = Tokenizer.from_file(JSON)
ODD = [None, "", " ", "\n\n", "a", "it's  2  spaces\n \n\tand </s>[INST] \\x", "ab" * 3000, "wort " * 4000, "é漢🙂 <|endoftext|>\r\n", "the same text here now", "the same text here now"]
DOCS = "doc_id long, text string, score string, length int, kept string"


def docs_frame(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "x", 1, None) for i, t in enumerate(texts)], DOCS)


def roots_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(9)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = roots_of(edges, {n for e in edges for n in e})
    assert all(got.get(n, n) == r for n, r in want.items())
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# 1


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 16))
    rows = []
    for i in range(240):
        v = centres[i % 6] + rng.standard_normal(16) * rng.choice([0.02, 0.12, 0.2, 2.0])
        rows.append((i, [float(x) for x in v], int(i % 2), "x"))
    rows += [(240, rows[0][1], 0, "x"), (0, rows[0][1], 0, "x"), (241, None, 0, ""), (242, [], 1, ""), (243, [0.0] * 16, 1, ""), (244, [float("nan")] * 16, 1, ""), (245, [None] * 16, 1, ""), (246, rows[0][1], None, ""), (247, rows[1][1][:8], 1, ""), (248, [float("inf")] + [1.0] * 15, 0, "")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")
    got = embedding_dedup.deduplicate_vectors(frame, block=16).collect()
    good = [(k, v, lab) for k, (_, v, lab, _) in enumerate(rows) if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v, _ in good}
    pairs = [(a, b) for a, va, la in good for b, vb, lb in good if a < b and la == lb and len(va) == len(vb) and unit[a] @ unit[b] >= 0.98]
    links = Counter(x for p in pairs for x in p)
    root = roots_of(pairs, range(len(rows)))
    name = {r: min(rows[k][0] for k in root if root[k] == r) for r in set(root.values())}
    want = sorted((rows[k][0], links[k], name[root[k]], rows[k][0] == name[root[k]]) for k in range(len(rows)))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == want
    assert embedding_dedup.deduplicate_vectors(frame.limit(0)).count() == 0


# 2


def fewest(items, capacity):
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in {rooms[k]: k for k in range(len(rooms)) if rooms[k] >= items[i]}.values():
            rooms[k] -= items[i]
            go(i + 1, rooms)
            rooms[k] += items[i]
        go(i + 1, [*rooms, capacity - items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_dominance_reduction_is_optimal(items):
    fixed, rest = dominance_packing.reduce_by_dominance(Counter(items), 20)
    left = [x for x, c in rest.items() for _ in range(c)]
    assert Counter(left) + Counter(x for g in fixed for x, c in g.pattern for _ in range(c * g.bins)) == Counter(items)
    assert sum(g.bins for g in fixed) + (fewest(left, 20) if left else 0) == (fewest(items, 20) if items else 0)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
def test_plan_packs_everything(histogram):
    groups = dominance_packing.plan(histogram, 50)
    assert all(sum(x * c for x, c in g.pattern) <= 50 for g in groups)
    packed = Counter()
    for g in groups:
        for x, c in g.pattern:
            packed[x] += c * g.bins
    assert packed == Counter(histogram)


def plain_ids(texts):
    """Ids by a plain call of the library, a text at a time."""
    return [PLAIN.encode(t or "", add_special_tokens=False).ids for t in texts]


def texts_of(encoder, texts):
    ids, counts = encoder.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


PIECES = st.sampled_from([" ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u3000", "\u2028", "a", "bc", "ABC", "'s", "'", "12", ",", ".!", "é漢", "🙂", "\u200b", "<|endoftext|>", "<|", "|>"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=1, max_size=6))
def test_chunks_encode_like_the_tokenizer(texts):
    assert texts_of(chunked_text.hf_chunks(JSON), texts) == plain_ids(texts)


def test_special_strings_can_be_text():
    tokenizer = Tokenizer.from_file(JSON)
    text = "a <|endoftext|> b"
    assert plain_ids([text]) == [[64, 220, 50256, 275]]
    tokenizer.encode_special_tokens = True
    assert texts_of(chunked_text.hf_chunks(JSON, True), [text]) == [tokenizer.encode(text, add_special_tokens=False).ids]


def test_small_caches_change_nothing(spark):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    shared = chunked_text.hf_chunks(JSON)
    alone = lambda strings: (np.array([x for ids in plain_ids(strings) for x in ids], np.uint32), np.array([len(x) for x in plain_ids(strings)]))
    small = chunked_text.ChunkEncoder(chunked_text.PretokenEncoder(public_tokenizers.PATTERN, alone, 50).encode, shared.whole, max_entries=300, longest=4)
    want = plain_ids(texts)
    for part in (1, 7, 50):
        got = [x for i in range(0, len(texts), part) for x in texts_of(small, texts[i : i + part])]
        assert got == want
    assert all(len(x) <= 4 for x in small.cache.store.known)
    assert texts_of(shared, texts) == want


def test_strings_found_again_stay_in_a_full_cache():
    sent = Counter()

    def encode(strings):
        sent.update(strings)
        return np.array([int(x[1:]) for x in strings], np.uint32), np.ones(len(strings), np.int64)

    cache, common = chunked_text.Cache(encode, 100), [f"c{i}" for i in range(20)]
    for k in range(12):
        strings = [f"u{30 * k + i}" for i in range(30)] + common * (k % 3 < 2)
        rows = cache.rows(strings)
        ids, lengths = cache.store.gather(rows)
        cache.close()
        assert ids.tolist() == [int(x[1:]) for x in strings] and lengths.tolist() == [1] * len(strings)
        assert len(cache.store.known) <= 100
    assert max(sent.values()) == 1


def test_the_library_is_given_each_chunk_once_and_nothing_more(monkeypatch):
    sent = []

    class Recorder:
        def __init__(self, tokenizer):
            object.__setattr__(self, "tokenizer", tokenizer)

        from_file = classmethod(lambda cls, path: cls(Tokenizer.from_file(path)))

        def __getattr__(self, name):
            return getattr(self.tokenizer, name)

        def __setattr__(self, name, value):
            setattr(self.tokenizer, name, value)

        def encode_batch_fast(self, texts, **options):
            sent.extend(texts)
            return self.tokenizer.encode_batch_fast(texts, **options)

    monkeypatch.setattr("tokenizers.Tokenizer", Recorder)
    encoder = chunked_text.hf_chunks.__wrapped__(JSON)
    chunks = [f"{w}{i}{end}" for i in range(900) for w, end in (("w", ""), ("é漢", ",\n"), ("<|", "\xa0"), ("ab\x0b", "\t\t"))]
    texts = [" ".join(["x", *chunks, *chunks])] * 2
    assert texts_of(encoder, texts) == plain_ids(texts)
    assert sorted(w for x in sent if x != "x" for w in x[1:].split(" ")) == sorted(["x", *chunks])
    assert len(sent) < len(chunks) // 50


def test_packing_places_every_piece(spark, monkeypatch):
    monkeypatch.setattr(dominance_packing, "BUCKET_ROWS", 7)
    texts = ODD + [f"w{i} " * (i % 40) for i in range(150)]
    frame = docs_frame(spark, texts, [None if i == 3 else i for i in range(len(texts))])
    rows = dominance_packing.pack_documents(frame, JSON, 64).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, ids in enumerate(plain_ids(texts)):
        ids = np.array([*ids, 2], "<u4").tobytes()
        at = 0
        for k, r in enumerate(sorted(by[None if i == 3 else i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(ids[4 * at : 4 * (at + r["length"])]))
            assert r["length"] == 64 or k == 0
            at += r["length"]
        assert 4 * at == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1 + 1.02 * sum(r["length"] for r in rows) / 64
    assert dominance_packing.pack_documents(frame.limit(0), JSON, 64).count() == 0


def test_packing_of_repeated_ids_by_either_join(spark, monkeypatch):
    frame = docs_frame(spark, ["same text"] * 30 + ["another one"] * 5 + [None, ""], [7] * 37)
    placed = []
    for most in (10**6, 0):
        monkeypatch.setattr(dominance_packing, "BROADCAST_ROWS", most)
        rows = dominance_packing.pack_documents(frame, JSON, 16).collect()
        taken = [(r["sequence_id"], k) for r in rows for k in range(r["offset"], r["offset"] + r["length"])]
        assert len(rows) == 37 and len(set(taken)) == len(taken) == sum(r["length"] for r in rows)
        placed.append(sorted(taken))
    assert placed[0] == placed[1]


def test_reduction_goes_on_after_late_sets():
    # beside 6 three pieces of 1 fit, until 9 has taken one of them
    fixed, rest = dominance_packing.reduce_by_dominance({9: 1, 6: 1, 1: 3}, 10)
    assert not rest and sum(g.bins for g in fixed) == 2


# 3

URLS = [None, "", "no scheme", "http://", "http://com", "http://com/", "https://EXAMPLE.com/en/x?q=/fr/", "http://www.example.com/en/", "http://a.www.example.com/en/b", "http://www.example.com/de/", "http://badexample.com/en/", "http://x.net/es/1", "http://net/fr/", "ftp://x.net#/es/", "http://x.net:80/es/", "http://.net/es/", "http://net./es/", "a://b://c.net/es/", "http://x-example.com/en/", "http://exámple.COM/en/", "http://x.net/es\n/", "http://x.net/es/\n"]


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("rules", [url_filter.RULES, [("b.com", "/", "block"), ("a.b.com", "/x", "allow"), ("c.com", "/", "block"), ("c.com", "/", "allow"), ("com", "/en/long/path/", "block"), ("example.com", "/", "allow"), ("x-example.com", "/", "block"), ("example.com", "/en/", "block")]])
def test_urls_against_every_rule(spark, rules):
    urls = URLS + [f"http://{h}/{p}" for h in ("a.b.com", "b.com", "z.c.com", "c.com.", "www.example.com", "x-example.com") for p in ("", "x", "en/", "en/long/path/1")] * 2
    pages = spark.createDataFrame([(i, u, "mine", "k") for i, u in enumerate(urls)], "page_id long, url string, host string, key string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark, rules)).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}
    none = url_filter.filter_urls(pages, url_filter.rules_frame(spark, []))
    assert {r["verdict"] for r in none.collect()} == {"allow"} and none.count() == len(urls)
    assert url_filter.filter_urls(pages.limit(0), url_filter.rules_frame(spark, rules)).count() == 0


def test_many_path_rules_on_one_host(spark):
    rng = random.Random(11)
    rules = [("hot.com", f"/{rng.randrange(3000)}/" + "x/" * rng.randrange(4), rng.choice(["allow", "block"])) for _ in range(10_000)] + [("com", "/", "block"), ("a.hot.com", "/7", "allow"), ("bad/host", "/", "block"), (None, "/", "block"), ("hot.com", None, "block")]
    best = {}
    for h, p, v in rules:
        if h and p and "/" not in h:
            best[h, p] = max(v, best.get((h, p), ""))
    urls = [f"http://{rng.choice(['hot.com', 'a.hot.com', 'b.a.hot.com', 'other.com', 'hot.net'])}/{rng.randrange(3000)}/" + "x/" * rng.randrange(5) for _ in range(400)] + ["http://hot.com/7/x/"] * 300
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark, rules)).collect()}
    few = {}
    for i, u in enumerate(urls):
        if u not in few:
            path = "/" + u.split("/", 3)[3]
            few[u] = judged(u, [(h, p, v) for (h, p), v in best.items() if path.startswith(p)])
        assert got[i] == few[u]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200])
def test_bucket_search(spark, n):
    borders = [bytes([1 + i // 100, i % 100]) for i in range(n)]
    keys = [b"", b"\x01", b"\x01\x00", b"\x01\x05a", b"\x02\x40", b"\xff"]
    rows = spark.createDataFrame([(bytearray(k),) for k in keys], "key binary").select(url_filter.bucket_of(F.col("key"), borders)).collect()
    assert [r[0] for r in rows] == [sum(b <= k for b in borders) for k in keys]


def test_native_plans_have_no_python(spark):
    docs = docs_frame(spark, ODD)
    pages = spark.createDataFrame([(1, "http://a.net/es/")], "page_id long, url string")
    for frame in (quality_cascade.apply_cascade(docs, ["doc_id"]), url_filter.filter_urls(pages, url_filter.rules_frame(spark, url_filter.RULES))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), plan


# 4


def test_token_matrices_are_lossless(spark, tmp_path):
    texts = ODD + [f"w{i} " * (i % 30) for i in range(60)]
    frame = docs_frame(spark, texts)
    rows = token_matrices.write_token_matrices(frame, f"file://{tmp_path}/m", JSON, 128).collect()
    want = [ids + [2] for ids in plain_ids(texts)]
    pieces = {}
    for r in rows:
        ids, positions, ends = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2"), r["cu_seqlens"]
        assert len(ids) == 128 and ends[0] == 0 and ends[-1] == r["n_tokens"] and not ids[ends[-1] :].any()
        for k, (a, b) in enumerate(zip(ends, ends[1:])):
            assert positions[a:b].tolist() == list(range(b - a))
            pieces[r["doc_ids"][k], r["pieces"][k]] = (r["starts"][k], ids[a:b].tolist())
    for i, ids in enumerate(want):
        mine = [pieces[k] for k in sorted(k for k in pieces if k[0] == i)]
        assert [x for _, part in mine for x in part] == ids and all(len(part) == 128 for _, part in mine[1:])
        assert [s for s, _ in mine] == np.cumsum([0, *(len(part) for _, part in mine[:-1])]).tolist()
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert token_matrices.packed_sequences(frame.limit(0), JSON, 128).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40))
def test_tree_packing_is_best_fit_decreasing(lengths):
    rooms, want = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fit = [k for k, r in enumerate(rooms) if r >= lengths[i]]
        k = min(fit, key=lambda k: rooms[k], default=None)
        if k is None:
            rooms.append(30 - lengths[i])
        else:
            rooms[k] -= lengths[i]
    got = token_matrices.best_fit_decreasing(lengths, 30)
    assert sorted(30 - sum(lengths[i] for i in s) for s in got) == sorted(rooms)
    assert sorted(i for s in got for i in s) == list(range(len(lengths)))


# 5 and 7


def test_trees_fit_and_walk():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality_gbt.fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97
    one = x[1500]
    total = model.base
    for t in range(len(model.feature)):
        node = 0
        while node < model.feature.shape[1]:
            node = 2 * node + 1 + int(one[model.feature[t, node]] > model.threshold[t, node])
        total += model.leaf[t, node - model.feature.shape[1]]
    assert abs(1 / (1 + np.exp(-total)) - model.score(x[1500:1501])[0]) < 1e-12
    assert quality_gbt.fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3
    assert (quality_gbt.fit(x, np.ones(2000)).score(x[:3]) > 0.99).all()


def plain_statistics(text):
    words, lines, data = text.split(), [x for x in text.split("\n") if x.strip()], text.encode()
    n, size = max(len(words), 1), max(len(data), 1)
    ascii_letters = [c for c in text if c.isascii() and c.isalpha()]
    return [
        math.log(1 + len(words)),
        sum(len(w) for w in words) / n,
        sum(c in "#$%&*<>|" for c in text) / n,
        text.count("!") / n,
        sum(c.isupper() for c in ascii_letters) / max(len(ascii_letters), 1),
        sum(c in "0123456789" for c in text) / size,
        1 - len(set(lines)) / max(len(lines), 1),
        len(set(words)) / n,
        len({tuple(words[i : i + 3]) for i in range(len(words) - 2)}) / max(len(words) - 2, 1),
        text.count(".") / n,
        text.count(",") / n,
        sum(len(c.encode()) for c in text if not c.isascii()) / size,
        len(lines) / n,
        math.log(1 + max((len(w) for w in words), default=0)),
        text.count(" ") / size,
        sum(ord(c) < 9 or 14 <= ord(c) < 32 for c in text) / size,
    ]


def plain_score(model, x):
    total = model.base
    for t in range(len(model.feature)):
        node = 0
        while node < model.feature.shape[1]:
            node = 2 * node + 1 + int(x[model.feature[t, node]] > model.threshold[t, node])
        total += model.leaf[t, node - model.feature.shape[1]]
    return 1 / (1 + math.exp(-total))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aZ9 \n\t.,!#<|é漢\x01\x0b\xa0"), max_size=80))
def test_statistics_are_the_plain_ones(text):
    assert np.allclose(quality_gbt.statistics(text), plain_statistics(text), rtol=1e-12, atol=1e-12)


def test_quality_query_against_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet").collect() for n in ("documents", "labels"))
    apart = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    quality = {r["doc_id"]: r["quality"] for r in labels if not apart(r["doc_id"])}
    learn = [r for r in docs if r["doc_id"] in quality]
    frame = spark.createDataFrame(learn).select("doc_id").selectExpr("doc_id", "xxhash64(doc_id) as h").collect()
    order = {r["doc_id"]: r["h"] for r in frame}
    learn.sort(key=lambda r: order[r["doc_id"]])
    model = quality_gbt.fit(np.array([quality_gbt.statistics(r["text"] or "") for r in learn]), np.array([quality[r["doc_id"]] for r in learn], float))
    got = {r["doc_id"]: r for r in quality_gbt.op5_quality_classifier(spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs:
        want = plain_score(model, quality_gbt.statistics(r["text"] or ""))
        assert abs(got[r["doc_id"]]["score"] - want) < 1e-9
        assert (got[r["doc_id"]]["held_out"], got[r["doc_id"]]["predicted"]) == (apart(r["doc_id"]), int(want >= 0.7))


def plain_slots(text):
    words, big = re.findall(r"\w+", text.lower()), 1 << 64
    h = [xxhash.xxh64_intdigest(w) for w in words]
    p, q, r = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    mixed = h + [(a * p % big) ^ (b * q % big) for a, b in zip(h, h[1:])] + [(a * p % big) ^ (b * r % big) for a, b in zip(h, h[2:])]
    return sorted({(v * q % big) >> (64 - toxicity_ftrl.BITS) for v in mixed})


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB é漢'_1 \n"), max_size=60))
def test_slots_are_the_plain_ones(text):
    assert toxicity_ftrl.Hasher().slots(text).tolist() == plain_slots(text)


def plain_ftrl(rows, passes, alpha=1.0, beta=1.0, l1=6.0, l2=0.1):
    """Weights by slot from dictionaries, one coordinate at a time; the bias has no L1."""
    bias = 2**toxicity_ftrl.BITS
    z, n = Counter(), Counter()
    weight = lambda i: 0.0 if abs(z[i]) <= (0 if i == bias else l1) else -(z[i] - math.copysign(0 if i == bias else l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(passes):
        for slots, y in rows:
            at = [*slots, bias]
            w = [weight(i) for i in at]
            g = 1 / (1 + math.exp(-min(35, max(-35, sum(w))))) - y
            for i, v in zip(at, w):
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * v
                n[i] += g * g
    return {i: weight(i) for i in n if weight(i)}


def test_toxicity_against_a_plain_version_whatever_the_batches(spark):
    rng = random.Random(14)
    texts = [" ".join(rng.choice(["good", "fine", "day", "sun", "rain"]) for _ in range(30)) + (" vile stuff" if i % 4 == 0 else "") for i in range(300)] + [None, ""]
    docs = docs_frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(len(texts))], "doc_id long, toxic int")
    order = {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", "xxhash64(doc_id) as h").collect()}
    learn = sorted((i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 != 2), key=order.get)
    want = plain_ftrl([(plain_slots(texts[i] or ""), float(i % 4 == 0)) for i in learn], 4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = toxicity_ftrl.train(docs.repartition(3), labels)
            assert np.nonzero(got)[0].tolist() == sorted(want) and all(abs(got[i] - w) < 1e-9 for i, w in want.items())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    scores = {r["doc_id"]: r["score"] for r in toxicity_ftrl.score_documents(docs, got, ["doc_id", "score"]).collect()}
    for i, t in enumerate(texts):
        total = sum(want.get(s, 0.0) for s in plain_slots(t or "")) + want.get(2**toxicity_ftrl.BITS, 0.0)
        assert abs(scores[i] - 1 / (1 + math.exp(-total))) < 1e-9
        assert (scores[i] >= 0.3) == (i % 4 == 0 and bool(t))


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    scored = toxicity_ftrl.score_documents(docs, toxicity_ftrl.train(docs, labels), ["doc_id"]).join(labels, "doc_id")
    rows = [r for r in scored.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([(r["score"] >= 0.3) == (r["toxic"] == 1) for r in rows]) > 0.95  # of some 3,000 learned rows a tenth are toxic
    assert np.mean([r["score"] < 0.3 for r in rows if not r["toxic"]]) > 0.99


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality_gbt.op5_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_ftrl_is_sparse_and_right():
    hasher, rng = toxicity_ftrl.Hasher(), random.Random(4)
    words = [f"w{i}" for i in range(300)]
    data = [([rng.choice(words) for _ in range(60)], rng.random() < 0.2) for _ in range(1500)]
    data = [(hasher.slots(" ".join([*w, *(["vile"] if y else [])])), float(y)) for w, y in data]
    model = toxicity_ftrl.Ftrl()
    for slots, y in data[:1200]:
        model.learn(slots, y)
    w = model.weights(slice(None))
    assert np.mean([(w[s].sum() + w[-1] > np.log(0.3 / 0.7)) == (y > 0) for s, y in data[1200:]]) > 0.97
    assert (w != 0).sum() < 500


def test_classifiers_take_odd_rows(spark):
    docs = docs_frame(spark, ODD)
    docs = docs.union(docs)  # repeated rows and ids
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 1), (4, None, None), (7, 0, 1), (7, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    for labelled in (labels, labels.limit(0)):
        q = quality_gbt.score_documents(docs, quality_gbt.train(docs, labelled), ["doc_id", "score", "kept"]).collect()
        t = toxicity_ftrl.score_documents(docs, toxicity_ftrl.train(docs, labelled), ["doc_id", "score", "kept"]).collect()
        assert [*q[0].asDict()] == [*t[0].asDict()] == ["doc_id", "kept", "score"]
        assert len(q) == len(t) == 2 * len(ODD) and all(0 <= r["score"] <= 1 for r in [*q, *t])
    assert quality_gbt.score_documents(docs.limit(0), quality_gbt.fit(np.zeros((0, 16)), np.zeros(0)), ["doc_id"]).count() == 0


# 6


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.Bpe(byte_bpe.load_ranks(RANKS))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t\r\x0b\x1c\x85\xa0　abcABC1,.!'\"é漢🙂\u200b<|[]"), max_size=40))
def test_chunks_encode_like_whole_texts(tiktoken_encoding, bpe, text):
    want = tiktoken_encoding.encode_ordinary(text)
    assert [x for p in regex.findall(public_tokenizers.PATTERN, text) for x in bpe.merge(p.encode())] == want
    pretokens = chunked_text.PretokenEncoder(public_tokenizers.PATTERN, lambda strings: bpe.merge_all([x.encode() for x in strings]), 10)
    assert texts_of(chunked_text.ChunkEncoder(pretokens.encode), [text, text[1:]]) == [want, tiktoken_encoding.encode_ordinary(text[1:])]


def merged_plainly(ranks, piece):
    """The least rank first, the leftmost of equal ones, by trying all pairs."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        r, i = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=(None, 0))
        if r is None:
            return [ranks[p] for p in parts]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.permutations([a + b for a in (b"a", b"b", b"c", b"ab", b"aa", b"bca") for b in (b"a", b"b", b"cc", b"ab")]), st.lists(st.text("abc", min_size=1, max_size=14), min_size=1, max_size=8))
def test_any_ranks_merge_as_the_plain_rule(tokens, pieces):
    """The tokens come in any order, so merges may make pairs of lower rank."""
    ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(dict.fromkeys(tokens))}
    bpe = byte_bpe.Bpe(ranks)
    want = [merged_plainly(ranks, p.encode()) for p in pieces]
    ids, counts = bpe.merge_all([p.encode() for p in pieces])
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    assert [bpe.merge(p.encode()) for p in pieces] == want


def test_bpe_digests(spark, tiktoken_encoding):
    texts = [*ODD, "x" * 50_000, "hello" * 9000, "".join(random.Random(3).choices("etaoin", k=300_000))]
    encoded_rows = byte_bpe.encode_texts(docs_frame(spark, texts), RANKS, public_tokenizers.PATTERN)
    got = {r["doc_id"]: r for r in byte_bpe.decode_ids(encoded_rows, RANKS).collect()}
    once = byte_bpe.round_trip(docs_frame(spark, texts * 2), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(map(tuple, once)) == sorted([(r["doc_id"] + k, *r[1:]) for r in got.values() for k in (0, len(texts))])
    for i, t in enumerate(texts):
        ids = tiktoken_encoding.encode_ordinary(t or "")
        assert got[i]["ids_text"] == " ".join(map(str, ids)) and bytes(got[i]["decoded"]) == (t or "").encode() and got[i]["n_tokens"] == len(ids)
    assert byte_bpe.encode_texts(docs_frame(spark, texts).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# 8


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], max(row[j + 1], row[j], last + (x == y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=25), st.data())
def test_similar_is_the_exact_alignment(a, data):
    b = list(a)
    for _ in range(data.draw(st.integers(0, 8))):
        if b and data.draw(st.booleans()):
            del b[data.draw(st.integers(0, len(b) - 1))]
        else:
            b.insert(data.draw(st.integers(0, len(b))), data.draw(st.sampled_from("abcd")))
    n = max(len(a), len(b))
    assert order_minhash.similar(a, b) == (n == 0 or 10 * longest_common(a, b) >= 8 * n)


def test_alignment_of_long_texts(monkeypatch):
    rng = random.Random(21)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(2500)]
    for share in (0.05, 0.185, 0.195, 0.21):
        copy = list(words)
        for at in rng.sample(range(len(words)), int(len(words) * share)):
            copy[at] = f"new{at}"
        copy = ["front"] * 20 + copy[:-20]
        exact = longest_common(words, copy)
        assert (5 * exact >= 4 * len(words)) == order_minhash.similar(words, copy)
        whole = order_minhash._banded_common(words, copy, 500)
        monkeypatch.setattr(order_minhash, "SHORT_WORDS", 10)  # lists of places
        assert order_minhash.similar(words, copy) == (5 * exact >= 4 * len(words))
        assert order_minhash._banded_common(words, copy, 500) == whole == exact
        monkeypatch.undo()


def test_a_very_long_pair_needs_little_memory():
    import tracemalloc

    rng = random.Random(22)
    words = [f"w{int(rng.paretovariate(0.5))}" if rng.random() < 0.6 else f"u{i}" for i in range(300_000)]
    copy = [f"x{i}" if i % 100 == 50 else w for i, w in enumerate(words)]
    copy[1000:1000] = ["more"] * 500
    tracemalloc.start()  # a strict threshold keeps the band, and so the time of this test, small
    assert order_minhash.similar(words, copy, 0.98)
    assert not order_minhash.similar(words, copy, 0.995)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "BLOCK_WORDS", 300)
    monkeypatch.setattr(order_minhash, "LEADER_BLOCK", 8)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = list(ODD)
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([8, 40, 120]))]
        for _ in range(rng.choice([1, 4, 9])):
            copy = list(base)
            for _ in range(len(base) // 40):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [" ".join(passage + [rng.choice(words) for _ in range(rng.choice([20, 60]))]) for _ in range(20)]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs_frame(spark, texts)).collect()}
    split = [(t or "").split() for t in texts]
    shingles = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if (texts[a] or "") == (texts[b] or "") or (shingles[a] & shingles[b] and order_minhash.similar(split[a], split[b]))]
    assert got == roots_of(pairs, range(len(texts)))
    assert order_minhash.near_duplicates(docs_frame(spark, texts).limit(0)).count() == 0


def test_common_words_are_those_of_bags():
    rng = random.Random(3)
    texts = [[rng.randrange(12) for _ in range(rng.choice([0, 1, 5, 40]))] for _ in range(30)]
    common = order_minhash._common_words(texts)
    for i, t in enumerate(texts):
        assert common(i).tolist() == [sum((Counter(t) & Counter(o)).values()) for o in texts]
    assert order_minhash._common_words([[]])(0).tolist() == [0]


def test_rows_of_a_small_mixed_bucket_are_needed_once(spark):
    members = spark.range(400).selectExpr("1L AS key", "cast(id AS string) AS node", "90 AS n_words", "cast(id AS string) AS comp", "id > 5 AS outside", "90L * 394 AS words_out", "90L * 6 AS words_in")
    assert order_minhash._pairs_of_blocks(members, 1_000_000).groupBy("a", "b", "blk").count().collect() == [(0, 0, 0, 400)]
    placed = order_minhash._pairs_of_blocks(members, 10_000)  # four blocks and one: each pair has all its rows
    assert {(r["a"], r["b"]) for r in placed.select("a", "b").distinct().collect()} == {(a, b) for b in range(5) for a in range(min(b + 1, 4))}
    assert placed.where("outside").count() == 394 * 5 and placed.where("not outside").count() == 6 * 4


def test_texts_that_share_a_passage_are_not_aligned(monkeypatch):
    texts = ["same words " * 25 + " ".join(f"{i}x{w}" for w in range(40)) for i in range(200)]
    texts[7], texts[9] = "new " + texts[3], texts[3].replace("3x5", "y")
    n = len(texts)
    columns = {"key": [1] * n, "a": [0] * n, "b": [0] * n, "outside": [i > 0 for i in range(n)], "blk": [0] * n, "node": [b"%d" % i for i in range(n)], "comp": [b"%d" % i for i in range(n)], "n_words": [len(t.split()) for t in texts], "keys": [[1]] * n, "text": texts}
    real, aligned = order_minhash.similar, []
    monkeypatch.setattr(order_minhash, "similar", lambda a, b, t: aligned.append(1) or real(a, b, t))
    rows = type("Rows", (), {"select": lambda self, *names: self, "mapInArrow": lambda self, run, schema: run})()
    links = [x for out in order_minhash._settle(rows, 0.8)(iter([pa.RecordBatch.from_pydict(columns)])) for x in out.to_pylist()]
    assert len(links) == 2 and {x for link in links for x in link.values()} == {b"3", b"7", b"9"}
    assert len(aligned) <= 3


def test_scattered_edits_are_found(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(80, 400))]
        copy = list(base)
        for at in rng.sample(range(len(base)), int(len(base) * (0.1 + i / 600))):
            copy[at] = "x"
        assert order_minhash.similar(base, copy)
        texts += [" ".join(base), " ".join(copy)]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs_frame(spark, texts)).collect()}
    assert all(got[i] in (i, i - i % 2) for i in got)
    assert sum(got[i] == i - 1 for i in range(1, len(texts), 2)) >= 58


# 9


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_cascade_counts(spark):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice("abcd") for _ in range(n)) for n in range(0, 30)] + ["a b c\na b c\n\x0b\na b c ", "x # $\n" * 40, "A" * 9 + "\u00a0é " * 80, "Ünïcode WORDS " * 40]
    rows = quality_cascade.apply_cascade(docs_frame(spark, texts), ["doc_id"]).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counted(texts[r["doc_id"]] or ""), texts[r["doc_id"]]
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert len(rows) == len(texts)
    assert quality_cascade.apply_cascade(docs_frame(spark, texts).limit(0), ["doc_id"]).count() == 0


def test_rules_run_by_rejection_of_what_is_left_per_second():
    rules = {r.name: r for r in quality_cascade.base_rules() + quality_cascade.default_rules()}
    picked = [rules[n] for n in ("few_words", "repeats", "symbols", "digits")]
    patterns = [(frozenset(), 70), (frozenset(["few_words", "symbols"]), 20), (frozenset(["repeats"]), 8), (frozenset(["symbols"]), 2)]
    seconds = {"few_words": 0.1, "repeats": 2.0, "symbols": 1.0, "digits": 0.5}
    # alone, symbols (22 a second) would come before repeats (4 a second); after few_words 2 are left to it
    assert [r.name for r in quality_cascade.order_rules(picked, quality_cascade.Measured(seconds, patterns))] == ["few_words", "repeats", "symbols", "digits"]


def test_cascade_keeps_the_same_rows_in_any_order_and_skips_later_rules(spark):
    rng = random.Random(5)
    texts = ODD + ["word " * 60, "A B " * 40, "1234 " * 80] + [" ".join(rng.choice(["a", "b#", "CC", "12", f"w{k}"]) for k in range(n)) for n in range(0, 200, 7)]
    docs = spark.createDataFrame([(i, t, "x", 9, True, "y") for i, t in enumerate(texts)], "doc_id long, text string, n_words string, n_lines int, kept boolean, __text string")
    keep = ["doc_id", "n_words", "n_lines", "kept", "__text", "text"]
    judged = quality_cascade.apply_cascade(docs, keep).collect()
    assert sorted(judged[0].asDict()) == sorted(["doc_id", "__text", *quality_cascade.RESULTS])
    kept = quality_cascade.kept_documents(docs, keep)
    assert kept.columns == ["doc_id", "__text", "text"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in judged if r["kept"])
    every = quality_cascade.base_rules() + quality_cascade.default_rules()
    raises = quality_cascade.Rule("never", lambda c: F.raise_error(F.lit("reached")).isNotNull())
    words = quality_cascade.with_words(docs, [])
    stop = quality_cascade.Rule("all", lambda c: c("n_words") >= 0)
    assert {r[0] for r in words.select(quality_cascade.cascade([stop, raises], quality_cascade.raw)).collect()} == {"all"}
    for order in (every, every[::-1]):
        names = words.select(quality_cascade.cascade(order, quality_cascade.raw).alias("r")).collect()
        assert [r["r"] is None for r in names] == [r["kept"] for r in sorted(judged, key=lambda r: r["doc_id"])]


# 10


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("\\n<|>/sINST[]\nim_startd"), max_size=30))
def test_escape_is_reversible(text):
    assert chat_windows.unescape(chat_windows.escape(text)) == text
    assert not any(c in chat_windows.escape(text) for c in chat_windows.CONTROL)


def test_chat_round_trip(spark):
    rng = random.Random(6)
    said = ["", None, "<|im_end|>\n", "[INST] \\ </s>", "word " * 30, "x " * 300, "<s><<SYS>>", "\\n\n"]
    rows = [(c, t, rng.choice(["user", "assistant", "tool\nx", None]) if t else rng.choice(["system", "user"]), rng.choice(said), "z") for c in [1, 2, 3, None, 4] for t in range(rng.choice([1, 3, 40]))]
    rows += [(9, 1, "user", "tie", "z"), (9, 1, "assistant", "tie", "z"), (9, None, "system", "first", "z"), (9, 1, "assistant", "tie", "z")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, window string")
    windows = chat_windows.format_conversations(frame, JSON, budget=200, history=60)
    for r in windows.collect():
        turns = chat_windows.parse_window(r["text"])
        assert len(turns) == r["n_repeated"] + r["n_new"]
        assert r["n_tokens"] <= 200 or r["n_new"] == 1
    got = {r["conv_id"]: r for r in chat_windows.conversation_digests(windows).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=key)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_windows.format_conversations(frame.limit(0), JSON).count() == 0


def test_windows_keep_the_budget_behind_history():
    rng = random.Random(8)
    for system in (0, 1) * 50:
        sizes = [rng.choice([5, 20, 40, 55, 150, 185, 200, 260]) for _ in range(40)]
        turns = [chat_windows.Turn("system" if system and not i else "user", str(i), tokens=20 if system and not i else n) for i, n in enumerate(sizes)]
        state = chat_windows.Windows(200, 60)
        made = [w for k in range(0, 40, 7) for w in state.add(turns[k : k + 7], False)] + list(state.add([], True))
        assert made == list(chat_windows.Windows(200, 60).add(turns, True))
        done = 0
        for number, first, repeated, new, tokens, _, _ in made:
            front = 20 if system and number else 0
            assert first == done and new >= 1
            assert tokens <= 200 or (new == 1 and repeated == bool(front) and front + turns[first].tokens > 200)
            done += new
        assert done == 40


def alike(a, b):
    """Whether four fifths of the longer text's words are a common subsequence; the bag of words bounds it."""
    n = max(len(a), len(b))
    if not n or 5 * sum((Counter(a) & Counter(b)).values()) < 4 * n:
        return False
    return 5 * longest_common(a, b) >= 4 * n


def plain_verdict(text):
    n, chars, symbols, copies, repeats = counted(text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    upper, digits = len(regex.findall(r"\p{Lu}", text)), len(re.findall("[0-9]", text))
    return not (n < 50 or 100 * repeats > 50 * n or symbols > 0.3 * n or upper > 0.4 * chars or digits > 0.5 * chars or 10 * copies > 4 * len(lines) or chars < 2 * n or chars > 15 * n)


def test_pipeline_stages_against_plain_versions(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    (_, rules), (_, classifier), (_, dedup), (_, packing) = corpus_pipeline.STAGES
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = spark.createDataFrame(rules(spark, docs, sf).collect(), docs.schema)
    given = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert kept.columns == corpus_pipeline.COLUMNS == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in given.items() if plain_verdict(t)}

    scored = spark.createDataFrame(classifier(spark, kept, sf).collect(), docs.schema)
    model = quality_gbt.train(kept, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = kept.collect()
    assert {r["doc_id"] for r in scored.collect()} == {r["doc_id"] for r in rows if plain_score(model, plain_statistics(r["text"])) >= 0.7}

    one = spark.createDataFrame(dedup(spark, scored, sf).collect(), docs.schema)
    words = {r["doc_id"]: r["text"].split() for r in scored.collect()}
    root = roots_of([(a, b) for a in words for b in words if a < b and alike(words[a], words[b])], words)
    assert {r["doc_id"] for r in one.collect()} == set(root.values())

    packed = packing(spark, one, sf).collect()
    ids = {r["doc_id"]: x + [2] for r, x in zip(one.collect(), plain_ids([r["text"] for r in one.collect()]))}
    assert {i: sum(r["length"] for r in packed if r["doc_id"] == i) for i in ids} == {i: len(x) for i, x in ids.items()}
    assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in packed)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in packed)
    assert all((c == b + n) if a == d else (c == 0) for (a, b, n), (d, c, _) in zip(places, places[1:])) and all(b + n <= 1024 for _, b, n in places)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "piece", "length").collect())) == sorted((r["doc_id"], r["piece"], r["length"]) for r in packed)


def test_pipeline_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    good = " ".join(rng.choice(["river", "stone", "walks", "under", "light,", "green.", "house", "seven"]) + str(i % 17) for i in range(90))
    rows = [(1, good, "en", "a", 9), (1, good, "en", "a", 9), (None, good + " end", None, None, None), (2, None, "en", "a", 0), (3, "", "en", "a", 0), (None, None, None, None, None), (4, "x" * 200_000, "en", "a", 1), (5, good[::-1], "", "", -1)]
    docs = spark.createDataFrame([(*r, "mine", 0.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars int, score string, kept double")
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    for given in (docs, docs.limit(0)):
        now = given
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, f"file://{tmp_path}")
            found = out.collect()
            assert name == "best-fit packing" or out.columns == corpus_pipeline.COLUMNS
            now = now if name == "best-fit packing" else spark.createDataFrame(found, out.schema)
        assert sorted({r["doc_id"] for r in found}, key=str) == sorted({r["doc_id"] for r in now.collect()}, key=str)
        assert given is docs or not found
    kept = corpus_pipeline.quality_rules(spark, docs, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"][:5]) for r in kept) == sorted((r[0] or 0, r[1][:5]) for r in rows if r[1] and plain_verdict(r[1]))


def test_one_row_of_each_class_with_repeated_and_null_ids(spark):
    import corpus_pipeline

    rng = random.Random(9)
    a, b, c = (" ".join(f"{x}{rng.randrange(900)}" for _ in range(60)) for x in "abc")
    rows = [(1, a), (2, a + " more"), (2, b), (3, b), (None, c), (None, a), (None, c), (2, b)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (2, b), (None, c)], key=str)
