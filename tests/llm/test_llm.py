"""Operators on small tables with nulls, ties and long texts, against brute force or the tokenizer libraries."""

import base64
import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as PT
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import (
    byte_bpe, chat_format, components, exact_dedup, jaccard_join, language_id, mixing, neighbours, pretokens, quality, queries, token_files, toxicity, turn_repair,
)

SF = "/root/testdata/sf0.001"
ODD = [
    (1, "Hello  world\n\n it's 1234 don't <|endoftext|> \t x", "en", "s1", 7, None), (2, None, None, None, 0, "a"), (3, "", "en", "s1", 0, "b"),
    (4, "   \n", "fr", "s2", 4, "c"), (5, "é ß   日本語 🎈🎈 \x1c x\x85y", "de", "s2", 9, "d"), (6, "word " * 30000, "en", "s3", 1, "e"),
    (7, "x" * 5000, "en", "s3", 1, "f"), (8, "Hello world it's 1234 don't\n<|endoftext|> x", "en", "s1", 7, "g"), (8, "Hello", "en", "s1", 7, "g"), (None, "lost id", "en", None, 7, "g"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def _texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def _encoding():
    import tiktoken

    with open(PT.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PT.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_and_decodes(odd, documents):
    enc = _encoding()
    for df in (odd, documents.limit(60)):
        found = byte_bpe.round_trip(df, PT.path("byte_bpe_50k.tiktoken"), PT.PATTERN)
        got = Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in found.collect())
        want = Counter((i, tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for i, t in _texts(df))
        assert got == want
        digest = {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.digests(found).collect()}
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert digest == {(len(ids), sha(" ".join(map(str, ids)).encode()), sha(raw)) for _, ids, raw in want}
    ids = byte_bpe.encode(odd, PT.path("byte_bpe_50k.tiktoken"), PT.PATTERN)
    back = byte_bpe.decode(ids, PT.path("byte_bpe_50k.tiktoken"), PT.PATTERN)
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t in _texts(odd))


def test_packed_ids_are_addressable():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 513, 5000):
        ids = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        p = token_files.Packed(token_files.pack(ids))
        assert len(p) == n and (p.slice(0, n) == ids).all()
        for i in range(0, n, 37):
            assert p[i] == ids[i]
            assert (p.slice(i, min(91, n - i)) == ids[i : i + 91]).all()


def test_token_files_equal_tokenizers(spark, odd, documents, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PT.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for k, df in enumerate((odd, odd.unionByName(odd), documents, odd.limit(0))):
        token_files.write_tokens(df, f"{tmp_path}/{k}", PT.path("byte_bpe_50k.json"), PT.PATTERN)
        rows = sorted(token_files.read_tokens(spark, f"{tmp_path}/{k}").collect(), key=lambda r: r["start"])
        got = [(r["doc_id"], r["n_tokens"], zlib.crc32(r["ids"])) for r in rows]
        ids = [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")) for i, x in _texts(df)]
        assert Counter(got) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in ids)
        assert [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:n]) for n in range(len(rows))]
        assert [i for i, *_ in got] == sorted((i for i, _ in ids), key=lambda i: (i is not None, i))
        asked = [(i, at) for i, x in ids for at in {0, len(x) // 2, len(x) - 1, len(x), -1}]
        wanted = spark.createDataFrame([*asked, (10**9, 0), (None, 0)], "doc_id long, at long")
        found = Counter((r["doc_id"], r["at"], r["token"]) for r in token_files.tokens_at(spark, f"{tmp_path}/{k}", wanted).collect())
        assert found == Counter((i, at, int(x[at])) for i, at in asked if i is not None for j, x in ids if i == j and 0 <= at < len(x))


def test_units_survive_a_small_memo():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PT.path("byte_bpe_50k.json"))
    own = pretokens.UnitEncoder(PT.PATTERN, lambda pieces: [[x.id for x in t.model.tokenize(p)] for p in pieces], memo=8)
    texts = [x[1] for x in ODD if x[1] and len(x[1]) < 1000 and "<|" not in x[1]] * 3
    for text in texts:
        assert own.encode([text, None, text])[2].tolist() == t.encode(text, add_special_tokens=False).ids
    assert len(own.memo) <= 12 and len(own.older) <= 12


def test_op5_gives_added_tokens_their_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PT.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  y\n", "it's <|endoftext| > plain", "", None, "word's  <|endoftext|>\n\n next"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op5_token_files(spark, str(tmp_path)).collect()}
    want, start = {}, 0
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        want[i], start = (start, len(ids), zlib.crc32(ids.tobytes())), start + len(ids)
    assert got == want


def _brute_groups(rows):
    def key(i, text):
        w = (text or "").encode().lower().split()
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[a : a + 5]) for a in range(len(w) - 4)}

    sets = [(i, key(i, t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return Counter((i, len(s), low.get(root(k))) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("blocks", [False, True])
def test_jaccard_groups_equal_brute_force(spark, odd, documents, blocks, monkeypatch):
    base = "the quick brown fox jumps over the lazy dog and then runs away from all of the other animals in the wood " * 2
    w = [f"w{i}" for i in range(100)]
    chain = [" ".join([*w[:k], *[f"z{k}_{i}" for i in range(k, 100)]]) for k in range(99, 60, -3)]
    extra = [(100 + i, t, "en", "s", 1, "") for i, t in enumerate([base, base.upper(), base + " end", "a b", "A  b", "a b c", *chain, " ".join(w)])]
    if blocks:  # groups and buckets beyond a block of two
        monkeypatch.setattr(jaccard_join, "BUCKET_BLOCK", 2)
        monkeypatch.setattr(jaccard_join, "GROUP_BLOCK", 2)
    for df in (documents.limit(120), odd.unionByName(spark.createDataFrame(extra, SCHEMA)), odd.limit(0)):
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_groups(df).collect())
        assert got == _brute_groups(_texts(df))


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(60):
        base = np.unique(rng.integers(0, 2**63, rng.integers(20, 400)).astype(np.uint64))
        for _ in range(3):
            keep = base[rng.random(len(base)) > 0.06]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 10)).astype(np.uint64)])))
    nodes = range(len(sets))
    tree = jaccard_join.signature_tree([(i, i, len(s), jaccard_join._bitmap(s, 8)) for i, s in enumerate(sets)])
    found = set(jaccard_join.tree_join(tree, jaccard_join.Sets()))
    true = {
        (a, b) for a in nodes for b in nodes if a < b and (o := len(np.intersect1d(sets[a], sets[b]))) * 5 >= 4 * (len(sets[a]) + len(sets[b]) - o)
    }
    assert true and true <= found and len(found) < 3 * len(true) + 50


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (95, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 90: 90, 95: 90, 100: 90}
    assert components.components(links.limit(0)).count() == 0


def test_neighbours_recall_and_scores(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    bad = [(10_000, None), (10_020, [0.0] * 64), (10_040, [float("nan")] + [1.0] * 63), (10_060, [None] + [1.0] * 63), (10_080, [1.0])]
    same = [(20_000 + i, [0.5] * 64) for i in range(60)]
    df = vectors.unionByName(spark.createDataFrame(bad + same, "vec_id long, embedding array<float>"))
    index, books = neighbours.build(neighbours.usable(df))
    got: dict = {}
    for r in neighbours.search(index, books, index.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {r["vec_id"]: np.array(r["vector"]) for r in index.collect()}
    assert set(good) == {r["vec_id"] for r in vectors.collect()} | {20_000 + i for i in range(60)}
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids])
    hit = n = 0
    for q in ids[ids % 20 == 0]:
        s = (x * good[q]).sum(1)
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:20]
        own = sorted(got[q])
        assert [r for r, *_ in own] == list(range(1, len(own) + 1))
        assert all(abs(score - (good[q] * good[v]).sum()) < 1e-12 for _, v, score in own)
        assert [(-a[2], a[1]) for a in own] == sorted((-a[2], a[1]) for a in own)
        hit += len({v for _, v, _ in own} & set(ids[order]))
        n += len(order)
    assert hit / n >= 0.9
    assert [v for _, v, _ in sorted(got[20_000])] == [20_001 + i for i in range(20)]
    empty = neighbours.build(neighbours.usable(df.limit(0)))
    assert neighbours.search(*empty, empty[0]).count() == 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_neighbours_recall_on_the_plain_tables(spark, size):
    df = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").select("vec_id", "embedding")
    index, books = neighbours.build(neighbours.usable(df))
    got: dict = {}
    for r in neighbours.search(index, books, index.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = sorted((r["vec_id"], r["embedding"]) for r in df.collect())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    best = {q: [k for k in np.lexsort((ids, -(x * v).sum(1))) if ids[k] != q][:20] for q, v in zip(ids, x, strict=True) if q % 20 == 0}
    assert set(got) == set(best) and all(len(v) == 20 for v in got.values())
    assert sum(len(got[q] & set(ids[at])) for q, at in best.items()) >= 0.93 * 20 * len(best)


@pytest.mark.parametrize("n", [1, 2, 12, 19, 21, 27])
def test_neighbours_among_few_vectors_are_enough(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(n)] + [(0, rng.normal(size=16).tolist()) for _ in range(4)]
    index, books = neighbours.build(neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    found = Counter(r["query_id"] for r in neighbours.search(index, books, index.dropDuplicates(["vec_id"])).collect())
    rows_of = Counter(i for i, _ in rows)
    assert found == Counter({i: min(20, len(rows) - rows_of[i]) for i in range(n)})


def test_neighbours_with_the_whole_share_are_exact(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 40)  # some lists share a bin, others need several
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(150, 8)), rng.normal(size=(150, 8)) * 0.1 + 3])
    index, books = neighbours.build(neighbours.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")))
    got: dict = {}
    for r in neighbours.search(index, books, index, k=5, share=1).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for i, v in enumerate(x):
        best = [int(j) for j in np.lexsort((np.arange(300), -(x * v).sum(1))) if j != i][:5]
        assert [j for _, j in sorted(got[i])] == best


def test_language_id_held_out(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    n, right = found.count(), found.filter("lang = lang_pred").count()
    assert right >= 0.95 * n
    filters = language_id.learn(odd)
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(odd, filters).filter("doc_id in (2, 3, 4)").collect()}
    assert got == {(2, "und"), (3, "und"), (4, "und")}
    marks = spark.createDataFrame([(1, "½ ²"), (2, "12 _ Ⅷ"), (3, "½ ² und die")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] == "und" for r in language_id.identify(marks, filters).collect()} == {1: True, 2: True, 3: False}
    # A hot text's copies count once: the other texts' n-grams stay common.
    texts = docs.filter("lang = 'de'").limit(100).select("lang", "text")
    hot = texts.unionByName(spark.range(400).select(F.lit("de").alias("lang"), F.lit("aaaa bbbb cccc").alias("text")))
    assert (language_id.learn(hot).masks[0] > 0).sum() >= (language_id.learn(texts).masks[0] > 0).sum()


def test_language_scores_equal_plain_python(spark, documents, odd):
    labelled = documents.filter("doc_id % 3 = 0")
    filters = language_id.learn(labelled)
    for df in (documents.limit(40), odd):
        for r in language_id.identify(df.join(df.select("doc_id"), "doc_id", "left_semi"), filters).collect():
            candidates = []
            for text in [t for i, t in _texts(df) if i == r["doc_id"]]:
                data = b" " + bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in (text or "").lower().encode()) + b"  "
                hits = [0] * len(filters.languages)
                for at in range(len(data) - 3):
                    code, mask = int.from_bytes(data[at : at + 4], "little"), (1 << 64) - 1
                    for h in language_id.HASHES:
                        mask &= int(filters.masks[0][(code * h & 0xFFFFFFFF) >> 14])
                    hits = [n + (mask >> k & 1) for k, n in enumerate(hits)]
                e = [max(0.0, (n / max(1, len(data) - 3) - f) / (1 - f)) for n, f in zip(hits, filters.false_rate, strict=True)]
                best = max(range(len(e)), key=lambda k: (e[k], -k))
                blank = not any(c.isalpha() for c in text or "")
                candidates.append(("und", 0.0) if blank else (filters.languages[best], e[best] / sum(e) if sum(e) else 0.0))
            assert any(r["lang_pred"] == lang and abs(r["score"] - p) < 1e-9 for lang, p in candidates)
    nothing = language_id.learn(odd.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(odd, nothing).collect()} == {"und"}


def test_bitmask_filters_name_all_languages():
    f = language_id.Filters({f"l{i:02}": np.arange(i, 2000, i + 1) for i in range(70)})
    masks = f.languages_of(np.arange(100, dtype=np.uint32))
    for i in (0, 3, 63, 64, 69):
        assert all(masks[i // 64, c] >> np.uint64(i % 64) & np.uint64(1) for c in range(i, 100, i + 1))


def test_toxicity_held_out(spark, odd):
    """At least seven of ten toxic texts of the held-out fold are caught, and two of a hundred others flagged at most."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = queries.op6_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").toPandas()
    r = found["score"].rank()
    p, n = (found.toxic == 1).sum(), (found.toxic == 0).sum()
    assert (r[found.toxic == 1].sum() - p * (p + 1) / 2) / (p * n) >= 0.85
    assert found.predicted[found.toxic == 1].mean() >= 0.7 and found.predicted[found.toxic == 0].mean() <= 0.02
    for some in (labels.limit(0), labels.filter("toxic = 0").limit(20), labels.limit(20)):
        got = toxicity.score(odd, toxicity.learn(docs.limit(200), some)).collect()
        assert len(got) == len(ODD) and all(0 <= x["score"] <= 1 for x in got)


def test_toxicity_finds_planted_words_and_equals_plain_python(spark):
    rng = np.random.default_rng(2)
    syllables = [a + b for a in "bdfglmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows = []
    for i in range(900):
        words = [word() for _ in range(rng.integers(20, 200))]
        for at in rng.integers(0, len(words), 4 if i % 3 == 0 else 0):
            words[at] = rng.choice(["wretchedness", "blockhead", "gutterswine"])
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int").filter("doc_id % 5 > 0")
    model = toxicity.learn(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    assert np.mean([got[i]["predicted"] for i, _, t in held if t]) >= 0.9 and np.mean([got[i]["predicted"] for i, _, t in held if not t]) <= 0.05
    # Every word under both dictionaries, without the shortcut for words that share nothing with the toxic one.
    of, under = toxicity._compressor(model.toxic), toxicity._compressor(model.ordinary)
    none = len(under(toxicity.MARK + toxicity.TAIL))
    for i, text, _ in rows[:30]:
        framed = [toxicity.MARK + f" {w} ".encode() + toxicity.TAIL for w in text.split()]
        flagged = [(len(under(w)) - len(of(w))) / max(toxicity.CHEAP, len(under(w)) - none) >= model.least for w in framed]
        found = sum(flagged) / len(flagged) ** 0.5
        assert abs(got[i]["score"] - found / (found + model.cut)) < 1e-9 and got[i]["predicted"] == int(found >= model.cut)
    # A full memo is emptied and changes nothing.
    flags = toxicity.Flags(model.toxic, model.ordinary, model.least)
    whole = [flags.statistic(r[1]) for r in rows[:50]]
    flags.clear()
    toxicity.MEMO, before = 16, toxicity.MEMO
    assert [flags.statistic(r[1]) for r in rows[:50]] == whole and len(flags) <= 16
    toxicity.MEMO = before


def test_quality_held_out_and_shrinkage(spark, odd):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = queries.op7_quality(spark, sf).filter("held_out").join(labels, "doc_id").toPandas()
    assert found.kept[found.quality == 1].mean() >= 0.98
    assert found.kept[found.quality == 0].mean() <= 0.1
    rows = [("big", "a", 0.9)] * 400 + [("bad", "a", 0.1)] * 400 + [("tiny", "a", 0.1)] + [(None, None, None)]
    sites, mean = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    post = {r["host"]: r["host_posterior"] for r in sites.collect()}
    assert post["bad"] < post["tiny"] < mean < post["big"]
    model = quality.learn(odd, labels.limit(0))
    got = {(r["doc_id"], r["kept"]) for r in quality.judge(odd, model).collect()}
    assert len(quality.judge(odd, model).collect()) == len(ODD) and (2, False) in got and (3, False) in got
    assert quality.keep_good(odd, model).columns == odd.columns


def test_quality_scores_equal_plain_python(spark, documents):
    model = quality.learn(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = documents.limit(150).collect()
    p = {r["doc_id"]: float(model.predict(np.array([quality.features(r["text"])]))[0]) for r in rows}
    at = {r["doc_id"]: (r["source"], r["lang"]) for r in rows}
    groups: dict = {}
    for i, key in at.items():
        groups.setdefault(key, []).append(p[i])

    def strength(of):
        n, k = sum(map(len, of)), len(of)
        mean = sum(map(sum, of)) / n
        within = max(1e-9, (sum(x * x for g in of for x in g) - sum(sum(g) ** 2 / len(g) for g in of)) / max(1, n - k))
        between = (sum(sum(g) ** 2 / len(g) for g in of) - n * mean * mean - (k - 1) * within) / max(1e-9, n - sum(len(g) ** 2 for g in of) / n)
        return min(quality.STRONGEST, max(quality.WEAKEST, within / between)) if between > 0 else quality.STRONGEST

    hosts: dict = {}
    for (host, _), g in groups.items():
        hosts.setdefault(host, []).extend(g)
    mean = sum(p.values()) / len(p)
    of_host, of_path = strength(list(hosts.values())), strength(list(groups.values()))
    logit = lambda x: np.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    for r in quality.judge(documents.limit(150), model).collect():
        g, h = groups[at[r["doc_id"]]], hosts[at[r["doc_id"]][0]]
        host = (of_host * mean + sum(h)) / (of_host + len(h))
        path = (of_path * host + sum(g) - p[r["doc_id"]]) / (of_path + len(g) - 1)
        score = 1 / (1 + np.exp(-(logit(p[r["doc_id"]]) + logit(path) - logit(mean))))
        assert abs(r["score"] - score) < 1e-6 and abs(r["host_posterior"] - host) < 1e-6 and r["kept"] == (r["score"] >= 0.5)
    kept = {r["doc_id"] for r in quality.keep_good(documents.limit(150), model).collect()}
    assert kept == {r["doc_id"] for r in quality.judge(documents.limit(150), model).collect() if r["kept"]}


@pytest.mark.parametrize("cells", [exact_dedup.MAX_CELLS, 1 << 9])
def test_exact_groups_equal_sql(spark, odd, documents, cells, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_CELLS", cells)  # with few cells digests are dealt to ranges
    con = duckdb.connect()
    for df in (odd.filter("doc_id is not null"), documents, odd.limit(0)):
        con.register("documents", df.toPandas())
        want = Counter(con.execute(queries.SQL["op8_exact_dedup"]).fetchall())
        cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert Counter(tuple(r) for r in exact_dedup.exact_groups(df).select(*cols).collect()) == want
        kept = exact_dedup.drop_exact_duplicates(df)
        assert kept.columns == df.columns
        assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in want.elements() if r[3])
    twice = odd.unionByName(odd)
    assert exact_dedup.drop_exact_duplicates(twice).count() == exact_dedup.exact_groups(twice).filter("kept").count()


def _targets(sizes):
    w = [(5, 2, 1)[k % 3] for k in range(len(sizes))]
    left, target = 1.5 * sum(sizes), [0.0] * len(sizes)
    open_ = set(range(len(sizes)))
    while open_:
        level = left / sum(w[k] for k in open_)
        full = {k for k in open_ if w[k] * level >= 2 * sizes[k]}
        if not full:
            for k in open_:
                target[k] = w[k] * level
            break
        for k in full:
            target[k] = 2.0 * sizes[k]
            left -= target[k]
        open_ -= full
    return target


def test_mixture_meets_targets(spark, odd, documents):
    for df in (documents, odd):
        rows = mixing.mixture(df).collect()
        again = mixing.mixture(df).collect()
        assert Counter(map(tuple, rows)) == Counter(map(tuple, again)) and len(rows) == df.count()
        size = Counter()
        for r in rows:
            size[r["source"]] += r["size"]
            assert 0 <= r["taken"] <= 2 * r["size"]
        want = Counter((i, len((t or "").encode().split())) for i, t in _texts(df))
        assert Counter((r["doc_id"], r["size"]) for r in rows) == want
        names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
        for name, target in zip(names, _targets([size[n] for n in names]), strict=True):
            own = [r for r in rows if r["source"] == name]
            assert all(abs(r["target"] - target) < 1e-6 * max(1, target) and r["source_size"] == size[name] for r in own)
            assert sum(r["taken"] for r in own) == int(target + 1e-9)
    assert mixing.mixture(odd.limit(0)).count() == 0
    kept = mixing.mixed_documents(documents)
    assert kept.columns == documents.columns
    words = Counter()
    for r in kept.select("source", mixing.word_count(F.col("text")).alias("n")).collect():
        words[r["source"]] += r["n"]
    rows = mixing.mixture(documents).collect()
    for name in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == name]
        assert abs(words[name] - own[0]["target"]) <= max(r["size"] for r in own) + 1


def test_words_taken_equal_plain_python(spark, documents, odd):
    for df in (documents, odd):
        keyed = df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", F.xxhash64("text"), F.lit(7)).alias("key"),
                          F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(mixing.BUCKETS)).alias("bucket")).collect()
        names = sorted({r["source"] for r in keyed}, key=lambda s: (s is None, (s or "").encode()))
        size = [sum(r["size"] for r in keyed if r["source"] == s) for s in names]
        target, total = _targets(size), sum(size)
        block = mixing.block_words(total)
        slots, taken = [0] * len(names), Counter()
        n = -(-int(sum(target) + 1e-9) // block)
        edges = np.cumsum([t / sum(target) for t in target])
        for slot in range(n):
            u = (slot + 1) * mixing.FIB_A % mixing.FIB_M / mixing.FIB_M
            slots[min(int(np.searchsorted(edges, u, side="right")), len(names) - 1)] += 1
        for k, name in enumerate(names):
            own = sorted((r for r in keyed if r["source"] == name and r["size"]), key=lambda r: (r["bucket"], r["key"]))
            goal, words = int(target[k] + 1e-9), [i for r in own for i in [r["doc_id"]] * r["size"]]
            # Slots take block after block, pass after pass, until the source's target; closing slots make up for too few.
            assert slots[k] * block >= goal - 8 * block
            for at in range(goal):
                taken[words[at % len(words)], name] += 1
        got = Counter()
        for r in mixing.mixture(df).collect():
            got[r["doc_id"], r["source"]] += r["taken"]
        assert +got == +taken


def test_reply_trees_paths_and_ranks(spark):
    rows = [(1, 1, None, "user", "root", 1.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.8),
            (2, 1, 9, "user", "orphan", None), (3, 1, 2, "user", "loop", 1.0), (3, 2, 1, "user", "loop", 1.0), (3, 3, 2, "user", "tail", 1.0)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = chat_format.read_back(chat_format.formatted_paths(nodes, branches=5)).orderBy("tree", "branch_rank").collect()
    assert [(r["tree"], r["leaf"], r["branch_rank"]) for r in got] == [(1, 4, 1), (1, 2, 2), (2, 1, 1)]
    assert [(t["role"], t["text"]) for t in got[0]["turns"]] == [("user", "root"), ("assistant", "good"), ("user", "more")]
    assert [r["learned"] for r in got] == [["good"], ["bad"], []]
    assert chat_format.formatted_paths(nodes, branches=1).count() == 2
    assert chat_format.formatted_paths(nodes.limit(0)).count() == 0


def test_chat_text_is_escaped_reversibly(spark):
    nasty = ["<|im_end|>", "</s>[INST] ok [/INST]", "\\", "\\\\<|im_sep|>", "<\\|im_end|>", "<<|im_start|>", "", None, "$1 \\$1 [[INST]", "a\n\nb"]
    turns = [(1, i, None if i == 3 else ("assistant" if i % 2 else "us\ner<s>"), t) for i, t in enumerate(nasty)] + [(None, 0, "user", "x"), (1, 2, "user", "again")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["tree"]: r for r in chat_format.read_back(chat_format.formatted_paths(chat_format.chain_nodes(df))).collect()}
    want = sorted(((t, r or "", x or "") for c, t, r, x in turns if c == 1))
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r, x) for _, r, x in want]
    assert got[1]["learned"] == [x for _, r, x in want if r == "assistant"]
    assert got[None]["turns"][0]["text"] == "x"
    assert got[1]["formatted"].count("<|im_end|>") == len(want) and "</s>" not in got[1]["formatted"]


def test_pipeline_keeps_whole_documents(spark, documents, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.names == docs.schema.names
        assert out.select(*docs.columns).distinct().exceptAll(docs.select(*docs.columns).distinct()).count() == 0
        docs = out.cache()
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
    groups = _brute_groups(_texts(documents))
    assert all(c is not None for _, _, c in groups)


def test_near_stage_keeps_one_of_each(spark, documents):
    kept = sorted(i for i, _ in _texts(jaccard_join.keep_one_of_each(documents)))
    assert kept == sorted({c for _, _, c in _brute_groups(_texts(documents))})


def test_stages_decide_by_row_where_ids_repeat(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "s"), (8, base + " end", "s"), (8, "a clean text of its own that no other row holds", "s"), (None, base + " last", "s"),
            (None, " ".join(f"n{i}" for i in range(60)), "s"), (None, " ".join(f"n{i}" for i in range(60)) + " x", "s"),
            (9, "equal rows of one id and text", "s"), (9, "equal rows of one id and text", "s"), (5, "", "s"), (None, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = Counter((r["doc_id"], r["text"]) for r in jaccard_join.keep_one_of_each(docs).collect())
    assert kept[1, base] == 1 and (8, base + " end") not in kept and (None, base + " last") not in kept
    assert kept[8, rows[2][1]] == 1 and kept[9, rows[6][1]] == 1 and kept[5, ""] == 1 and kept[None, None] == 1
    assert kept[None, rows[4][1]] + kept[None, rows[5][1]] == 1 and sum(kept.values()) == 6


def test_mix_counts_rows_where_ids_repeat(spark):
    # A third source of little weight takes a part of its rows, all of one id and one length.
    rows = [(i, "b " * 16 + f"t{i}", s) for s in "ab" for i in range(400)] + [(7, " ".join(f"{x}" for x in range(k, k + 16)), "c") for k in range(400)] + [(7, "same " * 16, "c")] * 80
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(1).localCheckpoint()
    want = Counter()
    for r in mixing.mixture(docs).collect():
        want[r["source"], r["doc_id"], r["size"]] += int(np.floor(r["taken"] / r["size"] + 0.5))
    got = mixing.mixed_documents(docs).collect()
    assert Counter((r["source"], r["doc_id"], len(r["text"].split())) for r in got) == +want
    assert 0 < want["c", 7, 16] < 480


def test_registered(spark):
    import __spark_entry__ as entry

    for n in range(1, 14):
        assert len([q for q in queries.QUERIES if q.startswith(f"op{n}_")]) == 1
    assert set(queries.SQL) <= set(queries.QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert len(corpus_pipeline.STAGES) == 5 and all(callable(f) for _, f in corpus_pipeline.STAGES)


def _cheapest(rows):
    """(cost, audit, turns) by Dijkstra's method over (rows read, turns said), each state's least (cost, audit) first."""
    import heapq
    import re

    legal, heap, done = re.compile("(s?(ua)+)?"), [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, said = heapq.heappop(heap)
        roles = "".join(r[:1] or "-" for r, _ in said)
        # What is said so far matters only by whether it is nothing, an s, or ends in u or a.
        state = (i, "" if not said else roles if roles == "s" else roles[-1])
        if state in done:
            continue
        done.add(state)
        if i == len(rows) and legal.fullmatch(roles):
            return cost, audit, said
        grown = [(cost + 3, audit + "I", i, (*said, (r, ""))) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, lost, cut = rows[i]
            grown.append((cost + 4, audit + "D", i + 1, said))
            if not lost:
                grown.append((cost + 3 * cut, audit + "K", i + 1, (*said, (role, text))))
                grown += [(cost + 3 + 3 * cut, audit + "R", i + 1, (*said, (r, text))) for r in ("user", "assistant")]
        for g in grown:
            if re.fullmatch("s?(ua)*u?", "".join(r[:1] or "-" for r, _ in g[3])):
                heapq.heappush(heap, g)


def _repaired_by_hand(rows):
    """The contract's row of one conversation: (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, judged, counts = set(), [], Counter()
    for _, role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, *_ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, said = _cheapest(judged)
    text = "\n".join(f"{r}:{t}" for r, t in said)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def _damaged_by_hand(rows):
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    return out


@pytest.mark.parametrize("freeze", [1, 3, 64])
def test_turn_repair_equals_dijkstra(spark, monkeypatch, freeze):
    monkeypatch.setattr(turn_repair, "FREEZE", freeze)
    rng = np.random.default_rng(freeze)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "unknown"], ["Yes.", "No!", "cut off", "", " \n", None, "Why?", "é…", "Yes."]
    rows = []
    for conv in [*range(120), None]:
        for turn in range(int(rng.integers(1, 14))):
            no = None if rng.random() < 0.1 else int(turn + (rng.random() < 0.1))
            rows.append((conv, no, roles[int(rng.choice(7, p=[0.35, 0.35, 0.1, 0.05, 0.05, 0.05, 0.05]))], texts[int(rng.integers(len(texts)))]))
    rows += [(900, t, "user", "same words.") for t in range(150)] + [(901, t, ("user", "assistant")[t % 3 % 2], f"text {t}.") for t in range(400)]
    want = {conv: _repaired_by_hand(own) for conv, own in _damaged_by_hand(rows).items()}
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, kept string")
    got = {r[0]: tuple(r)[1:] for r in turn_repair.repaired(turn_repair.damaged(df)).collect()}
    assert got == want


def test_turn_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.repaired(turn_repair.damaged(empty)).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = turn_repair.repaired(turn_repair.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], empty.schema))).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_sizes_are_read_as_spark_writes_them(spark):
    from quern.llm import shared

    assert [shared.byte_count(x) for x in ("64MB", "8m", "100", "1kb", "-1", "2 g")] == [64 << 20, 8 << 20, 100, 1024, -1, 2 << 30]
    names = [f"spark.sql.execution.arrow.{n}" for n in ("maxRecordsPerBatch", "maxBytesPerBatch")]
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[1], "64MB")
    shared.bounded_batches(spark)
    assert spark.conf.get(names[1]) == str(8 << 20)
    spark.conf.set(names[1], "1m")
    shared.bounded_batches(spark)
    assert spark.conf.get(names[1]) == "1m"
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def test_exact_stage_in_ranges_keeps_the_same_rows(spark, odd, monkeypatch):
    more = spark.createDataFrame([(i, f"text {i % 40}" + " " * (i % 3), "en", "s", i, "k") for i in range(200)], odd.schema)
    docs = odd.unionByName(odd).unionByName(more)
    key = lambda df: Counter(tuple(map(str, r)) for r in df.collect())
    want = key(exact_dedup.drop_exact_duplicates(docs))
    monkeypatch.setattr(exact_dedup, "MAX_CELLS", 1 << 9)
    got = exact_dedup.drop_exact_duplicates(docs)
    assert got.columns == docs.columns and key(got) == want
    keep = {r["keep_id"] for r in exact_dedup.exact_groups(docs).collect()}
    assert {r["doc_id"] for r in got.collect()} == keep


CLASHING = {"row": "r", "p": "p", "host": "h", "path": "q", "digest": "d", "gone": "g", "h": "x", "n": "y", "row_no": "z", "score": "s", "chars": "c", "again": "a", "label": "l", "shard": "t"}


def _with_clashes(df):
    return df.select("*", *[F.concat(F.lit(v), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(k) for k, v in CLASHING.items()])


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_clashing_columns_and_take_empty_tables(spark, odd, documents, stage):
    name, function = corpus_pipeline.STAGES[stage]
    docs = _with_clashes(odd.drop("keep_id").unionByName(documents.limit(60).select("doc_id", "text", "lang", "source", "n_chars")))
    found = function(spark, docs, SF)
    assert found.columns == docs.columns, name
    rows = found.collect()
    assert 0 < len(rows) and all(r["row"] == f"r{'-' if r['doc_id'] is None else r['doc_id']}" and r["digest"][1:] == r["p"][1:] == r["gone"][1:] for r in rows)
    empty = function(spark, docs.limit(0), SF)
    assert empty.columns == docs.columns and empty.collect() == []


def test_quality_stage_decides_as_the_operator_judges(spark, documents):
    """Whole rows stay exactly where the score, recomputed here from evidence and shrunken means, reaches the bound."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn(documents, labels)
    kept = Counter(r["doc_id"] for r in quality.keep_good(documents, model).collect())
    judged = {r["doc_id"]: r for r in quality.judge(documents, model).collect()}
    want = Counter(i for i, r in judged.items() if r["score"] >= quality.KEEP_FROM)
    assert kept == want and 0 < sum(kept.values()) < documents.count()
    own = {r["doc_id"]: r["p"] for r in documents.select("doc_id", quality.evidence(F.col("text"), model).alias("p")).collect()}
    assert all(abs(judged[i]["doc_score"] - (p or 0.0)) < 1e-12 for i, p in own.items())
    logit = lambda p: np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    mean = np.mean([p for p in own.values() if p is not None])
    for i, r in judged.items():
        if own[i] is not None:
            score = 1 / (1 + np.exp(-(logit(own[i]) + logit(r["path_posterior"]) - logit(mean))))
            assert abs(score - r["score"]) < 1e-6


def test_toxicity_counts_a_copied_passage_once(spark):
    from quern.llm import toxicity

    passage = " ".join(f"word{i}" for i in range(30))
    rows = [(1, f"{passage} own{i} idiot end{i}", i) for i in range(12)] + [(0, f"plain{i} text", i) for i in range(4)]
    found = toxicity._sampled_windows(spark.createDataFrame(rows, "label int, text string, h long"))
    toxic = found[1][0] + found[1][1]
    assert toxic.count("word7") == 1 and toxic.count("idiot") == 12 and found[0][0] + found[0][1]


def test_toxic_dictionary_holds_rarer_marks_beside_frequent_ones():
    """A few words in most toxic texts and many in few: both stay, and what is as frequent in ordinary windows does not."""
    rng = np.random.default_rng(5)
    syllables = [a + b for a in "bdfglmnprst" for b in "aeiou"]
    common = ["".join(rng.choice(syllables, rng.integers(2, 6))) for _ in range(4000)]
    frequent, rare = [f"scum{i}zz" for i in range(5)], ["quxx" + "".join(rng.choice(syllables, 3)) for _ in range(60)]
    toxic = tuple([*rng.choice(common, 20000), *rng.choice(frequent, 6000), *rare * 40] for _ in range(2))
    ordinary = tuple(rng.choice(common, 30000).tolist() for _ in range(2))
    toxic = tuple([str(w) for w in half] for half in toxic)
    found, plain = toxicity.dictionaries(toxic, ordinary)
    held = lambda words: np.mean([toxicity.gain(w, found, plain) >= 0.5 for w in words])
    assert held(frequent) == 1 and held(rare) >= 0.9 and held(common[:500]) <= 0.02
    # Without a word that both halves hold, the windows of greatest gain train it.
    assert toxicity.dictionaries((["aa", "bb"], ["cc"]), (["dd"], ["ee"]))[0]


def test_plans_of_near_dedup_and_mixing_stay_short(documents, monkeypatch):
    """The driver plans a plan anew after each of its exchanges, so a long one costs it memory."""
    from quern.llm import components

    exchanges = {}

    def of(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")

    for module, name in ((components, "checkpointed"), (jaccard_join, "checkpointed"), (jaccard_join, "written"), (mixing, "written")):

        def counted(df, *name_of, own=getattr(module, name), at=(module.__name__, name)):
            exchanges[at] = max(exchanges.get(at, 0), of(df))
            return own(df, *name_of)

        monkeypatch.setattr(module, name, counted)
    kept, mixed = jaccard_join.keep_one_of_each(documents), mixing.mixed_documents(documents)
    assert exchanges["quern.llm.components", "checkpointed"] <= 8 and max(exchanges.values()) <= 20
    assert of(kept) <= 14 and of(mixed) <= 6
