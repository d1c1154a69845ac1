"""Corpus operators against brute force, an exact round trip, held-out accuracy or their SQL."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

pytest.importorskip("harrow.llm.queries")

import oracle  # noqa: E402
from harrow.llm import rans  # noqa: E402
from harrow.llm.decontaminate import words  # noqa: E402
from harrow.llm.fmindex import FMIndex  # noqa: E402
from harrow.llm.fmindex import suffix_array as by_doubling  # noqa: E402
from harrow.llm.induced import suffix_array as by_induction  # noqa: E402
from harrow.llm.queries import ORACLES, QUERIES  # noqa: E402
from harrow.llm.sentences import runs, split  # noqa: E402
from harrow.llm.simhash import link  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r["doc_id"], r["text"], r["source"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = oracle.connect(SF)
    assert oracle.compare(spark, con, name, SF, QUERIES[name], ORACLES[name]) == ""


def test_sentence_spans(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op1_sentence_spans"](spark, SF).collect()}
    seen = set()
    for i, text, *_ in docs:
        sentences = split(text)
        assert "".join(sentences) == text
        gone = set()
        for start, (end, key) in enumerate(zip(*runs(sentences, 3, 20))):
            if key in seen:
                gone |= set(range(start, end))
            seen.add(key)
        assert got[i]["n_removed"] == len(gone)
        assert got[i]["text"] == "".join(s for k, s in enumerate(sentences) if k not in gone)
    assert sum(r["n_removed"] for r in got.values()) > 0


def removed_words(spark, texts):
    from harrow.llm.sentences import drop_repeated_spans

    rows = drop_repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r["kept"] for r in sorted(rows, key=lambda r: r["row"]["doc_id"])]


@pytest.mark.parametrize("blank", [" ", "\t", "\u00a0", ""])
def test_passages_off_the_grid(spark, blank):
    """A passage of 160 words in other surroundings, without sentence marks; for "" of 160 Han characters."""
    rng = np.random.default_rng(5)
    word = (lambda n: [chr(0x4E00 + x) for x in rng.integers(0, 5000, n)]) if not blank else (lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)])
    passage = word(160)
    texts = [blank.join(word(k) + passage + word(9)) for k in (1, 7, 12)]
    for text, kept in zip(texts[1:], removed_words(spark, texts)[1:]):
        gone = len(text) - len(kept)
        assert gone >= 0.6 * len(blank.join(passage))
        assert text.endswith(kept[-5:])


def test_whole_copies_vanish(spark):
    """Copies of any length, and passages with short last sentences, against plain comparison of texts."""
    long = "One two three four five six seven eight nine ten. " * 2 + "Alpha beta gamma delta epsilon. Short one. End."
    short = ["Only this.", "Two here. And more.", "Yes. No. Maybe so.", "no mark at all", long]
    texts = [*short, *short, f"Another start of it. {long} It goes on in its own way. Then it ends."]
    kept = removed_words(spark, texts)
    assert kept[:5] == short and kept[5:10] == [""] * 5
    assert kept[10] == "Another start of it. It goes on in its own way. Then it ends."
    assert removed_words(spark, ["At 192.168.0.1 runs a.", "See 192.168.0.1 and b."]) == ["At 192.168.0.1 runs a.", "See 192.168.0.1 and b."]


def test_copies_in_the_tables_vanish(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    seen = set()
    for r, kept in zip(docs, removed_words(spark, [r["text"] for r in docs])):
        assert r["text"] not in seen or kept == ""
        seen.add(r["text"])
    assert len(seen) < len(docs)


def test_sentence_marks_of_other_scripts(spark):
    for mark in "\u3002\uff01\uff1f\u0964\u061f\u06d4":
        sentences = split(f"aa bb{mark}cc dd{mark} ee")
        assert sentences == [f"aa bb{mark}", f"cc dd{mark} ", "ee"]


def fingerprint(text: str) -> int:
    import xxhash

    w = text.encode().lower().split()
    shingles = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(keys: np.ndarray, names: np.ndarray, budget: int) -> np.ndarray:
    near = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= budget
    names = names.copy()
    while True:
        least = np.array([names[row].min() for row in near])
        if (least == names).all():
            return names
        names = least


def test_simhash_classes(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op2_simhash_trie"](spark, SF).collect()}
    keys = np.array([fingerprint(d[1]) for d in docs], np.uint64)
    want = classes(keys, np.array([d[0] for d in docs]), 4)
    for (i, *_), key, name in zip(docs, keys.tolist(), want.tolist()):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{key:016x}", name)


@pytest.mark.parametrize("seed", range(8))
def test_trie_links(seed):
    rng = np.random.default_rng(seed)
    keys = rng.integers(0, 2**63, 12, dtype=np.uint64)[rng.integers(0, 12, 150)]
    for _ in range(seed % 5):
        keys = keys ^ (np.uint64(1) << rng.integers(0, 64, len(keys), dtype=np.uint64))
    keys = np.unique(keys)
    turn = lambda x: x << np.uint64(32) | x >> np.uint64(32)
    name = np.arange(len(keys))
    pairs = [link([keys], 4, 2)] + [tuple(turn(x) for x in link([np.unique(turn(keys))], 4, 1))]
    while True:
        before = name.copy()
        for a, b in pairs:
            for x, y in zip(np.searchsorted(keys, a), np.searchsorted(keys, b)):
                name[name == name[x]] = name[name == name[y]] = min(name[x], name[y])
        if (before == name).all():
            break
    want = classes(keys, np.arange(len(keys)), 4)
    assert len(np.unique(name)) == len(np.unique(want))
    assert all(len(np.unique(want[name == n])) == 1 for n in np.unique(name))


def test_trie_links_across_cells(spark, docs):
    from harrow.llm.simhash import near_groups

    keys = np.array([fingerprint(d[1]) for d in docs], np.uint64)
    rows = spark.createDataFrame([(d[0], int(k)) for d, k in zip(docs, keys.view(np.int64))], "doc_id long, fp long")
    got = {r["fp"]: r["component_id"] for r in near_groups(rows, cell=8).collect()}
    want = classes(keys, np.array([d[0] for d in docs]), 4)
    assert [got[int(k)] for k in keys.view(np.int64)] == want.tolist()


def test_tokens(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, at = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: r for r in QUERIES["op3_rans_tokens"](spark, SF).collect()}
    for i, text, *_ in docs:
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@pytest.mark.parametrize("n", [0, 1, 63, 5000, 700_000])
def test_rans_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 5000
    table = rans.Table(rans.quantize(np.bincount(ids, minlength=1), 18), 18)
    block = rans.encode(ids, table)
    assert (rans.decode(block, n, table) == ids).all()
    steps = np.frombuffer(block["steps"], "<i4")
    for k, step in enumerate(steps):
        assert (rans.decode(block, n, table, k) == ids[step * block["lanes"]:]).all()
    if len(steps) > 1:
        assert (rans.decode(block, n, table, 0, 1) == ids[:steps[1] * block["lanes"]]).all()
    if n > 63:
        with pytest.raises(ValueError):
            rans.decode(block | {"payload": block["payload"][:-4] + b"\1\2\3\4"}, n, table)


def test_top_k_many_blocks(spark):
    from pyspark.sql import functions as F

    from harrow.llm.topk import top_k

    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    same = v.limit(120).select((F.col("vec_id") + 100_000).alias("vec_id"), F.expr("transform(embedding, x -> cast(0.1 as float))").alias("embedding"), "label")
    v = v.unionByName(same)
    rows = v.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.floor(64 * np.array([r["embedding"] for r in rows], float)).astype(int)
    score = x @ x.T
    want = []
    for q in np.flatnonzero(ids % 20 == 0):
        other = ids != ids[q]
        best = np.lexsort((ids[other], -score[q][other]))[:20]
        want += [(int(ids[q]), k + 1, int(ids[other][b]), int(score[q][other][b])) for k, b in enumerate(best)]
    got = sorted(tuple(r) for r in top_k(v, v.filter("vec_id % 20 = 0"), block=64, query_block=7).collect())
    assert got == sorted(want)


def removed(docs, size=100):
    seen, out = set(), {}
    for i, text, *_ in docs:
        raw = text.encode()
        edge = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - size + 1):
            key = raw[p:p + size]
            if key in seen:
                edge[p] += 1
                edge[p + size] -= 1
            seen.add(key)
        gone = np.cumsum(edge)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_repeated_bytes(spark, docs):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op5_suffix_dedup"](spark, SF).collect()}
    assert got == removed(docs)


def test_repeated_bytes_in_small_shards(spark, docs):
    from pyspark.sql import functions as F

    from harrow.llm.substrings import drop_repeated_bytes

    out = drop_repeated_bytes(spark.read.parquet(f"{SF}/documents.parquet"), shard=20)
    got = {r["doc_id"]: hashlib.sha256(r["kept"]).hexdigest() for r in out.select(F.col("row.doc_id"), "kept").collect()}
    assert got == {i: x[3] for i, x in removed(docs).items()}


@pytest.mark.parametrize("seed", range(30))
def test_suffix_arrays(seed):
    rng = np.random.default_rng(seed)
    t = rng.integers(1, rng.integers(2, 6), rng.integers(1, 150)).astype(np.uint8)
    if seed % 3 == 0:
        t = np.tile(t[:7], 12)
    want = sorted(range(len(t)), key=lambda i: t[i:].tobytes())
    assert by_induction(t).tolist() == want
    assert by_doubling(t.astype(np.int64)).tolist() == want
    index = FMIndex(t.astype(np.int64), 7)
    for size in (1, 2, 3):
        p = rng.integers(1, 6, (1, size))
        lo, hi = index.search(p, np.array([size]))
        found = sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) if hi[0] > lo[0] else []
        assert found == [i for i in range(len(t) - size + 1) if (t[i:i + size] == p[0]).all()]


def test_language_held_out(spark, docs):
    lang = {d[0]: d[3] for d in docs}
    rows = QUERIES["op6_language_id"](spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and lang
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_held_out(spark):
    rows = QUERIES["op7_toxicity_fm"](spark, "/root/testdata/sf0.1").collect()
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    hits = sum(p and t for p, t in held)
    assert hits / sum(t for _, t in held) > 0.8
    assert hits / sum(p for p, _ in held) > 0.8


def test_mix_meets_targets(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op8_source_mix"](spark, SF).collect()}
    size = {d[0]: len(d[1].split()) for d in docs}
    by = {}
    for i, _, source, _ in docs:
        by.setdefault(source, []).append(i)
    order = sorted(by)
    total = {s: sum(size[i] for i in by[s]) for s in order}
    left, want, open_ = 1.5 * sum(total.values()), {}, dict(zip(order, [5, 2, 1] * len(order)))
    while True:
        full = [s for s, w in open_.items() if left * w / sum(open_.values()) > 2 * total[s]]
        if not full:
            break
        want |= {s: 2.0 * total[s] for s in full}
        left -= sum(want[s] for s in full)
        open_ = {s: w for s, w in open_.items() if s not in full}
    want |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    for s in order:
        rows = [got[i] for i in by[s]]
        assert all(r["size"] == size[r["doc_id"]] and r["source_size"] == total[s] and abs(r["target"] - want[s]) < 1e-6 for r in rows)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
        assert abs(sum(r["taken"] for r in rows) - want[s]) <= 0.02 * want[s]
    again = {r["doc_id"]: r["taken"] for r in QUERIES["op8_source_mix"](spark, SF).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}


def test_splitting_tree():
    from harrow.llm.mixing import split_tree

    quotas = np.array([1000, 10, 0, 333])
    for shards in (1, 2, 7, 64):
        tree = split_tree(quotas, shards, 3)
        assert (tree.sum(axis=0) == quotas).all() and (tree >= 0).all()
        assert np.ptp(tree.sum(axis=1)) <= max(2, np.log2(shards) + 1)
        assert (tree == split_tree(quotas, shards, 3)).all()


def test_url_rules_joined_like_trie(spark):
    from harrow.llm.queries import URL_RULES
    from harrow.llm.urlfilter import filter_urls

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame([*URL_RULES, ("block", "", "/de/1"), ("allow", "com", "/de/19")], "verdict string, host string, path string")
    rows = [sorted(map(str, filter_urls(pages, rules, max_rules=n).collect())) for n in (100, 0)]
    assert rows[0] == rows[1]


def test_cut_words_leave_no_window(spark, docs):
    from harrow.llm.decontaminate import find

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    windows = {tuple(w[i:i + 10]) for w in (words(r["text"]) for r in bench.collect()) for i in range(max(1, len(w) - 9))}
    out = {r["row"]["doc_id"]: r for r in find(spark.read.parquet(f"{SF}/documents.parquet"), bench, clean=True).collect()}
    sliced = {r["row"]["doc_id"]: r for r in find(spark.read.parquet(f"{SF}/documents.parquet"), bench, pass_words=200).collect()}
    whole = {r["row"]["doc_id"]: r for r in find(spark.read.parquet(f"{SF}/documents.parquet"), bench).collect()}
    assert any(r["spans"] for r in out.values())
    for i, text, *_ in docs:
        w = words(out[i]["kept"])
        assert not any(tuple(w[k:k + 10]) in windows for k in range(max(1, len(w) - 9)))
        assert out[i]["spans"] or out[i]["kept"] == text
        assert (sliced[i]["spans"], sliced[i]["items"]) == (whole[i]["spans"], whole[i]["items"])


def test_parities_never_exclude_similar_sets():
    from harrow.llm.jaccard import apart, packed, parities, unpacked

    rng = np.random.default_rng(6)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 900))).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**63, int(rng.integers(1, 900))).astype(np.uint64)]))
        assert apart(parities(a), parities(b)) <= len(np.setxor1d(a, b))
        assert (unpacked(packed(a)) == a >> np.uint64(16)).all()
    none = np.zeros(0, np.uint64)
    assert apart(parities(none), parities(none)) == 0 and len(unpacked(packed(none))) == 0


def least_of_similar(rows: list[tuple[int | None, str | None]]) -> list[int]:
    """The least id of every class of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    where = {}
    for k, s in enumerate(sets):
        for x in s or {()}:
            where.setdefault(x, []).append(k)
    group = list(range(len(rows)))
    for k, s in enumerate(sets):
        common = {}
        for x in s or {()}:
            for j in where[x]:
                common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if j < k and group[j] != group[k] and (not s or n / (len(s) + len(sets[j]) - n) >= 0.8 - 1e-12):
                a, b = sorted((group[j], group[k]))
                group = [a if g == b else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted(least.values())


def test_pipeline_drops_similar_documents(spark):
    """The stage against brute-force Jaccard over all pairs, with rows of one id, without an id and without words."""
    import corpus_pipeline as P

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id < 2400").collect()]
    base = [f"w{k}" for k in range(60)]
    rows += [(10**6 + k, " ".join(base[:50 + k % 9] + [f"own{k}"])) for k in range(60)] + [(None, rows[0][1]), (None, None), (2 * 10**6, ""), (2 * 10**6 + 1, None)]
    out = P.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(r["doc_id"] for r in out if r["doc_id"] is not None) == least_of_similar(rows)
    assert sum(r["doc_id"] is None for r in out) == 2
    assert not {205, 2250} & {r["doc_id"] for r in out} and 1700 in {r["doc_id"] for r in out}


def test_pipeline_stages(spark):
    """Every stage against a plain version over its own input."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for (name, stage), _ in zip(P.STAGES, range(5)):
        before = {}
        for r in docs.collect():
            before.setdefault(r["doc_id"], []).append(r)
        out = stage(spark, docs, SF)
        if name == "tokens":
            assert out.count() == sum(map(len, before.values()))
            break
        out = P.cut(out, name)
        assert out.columns == docs.columns
        after = out.collect()
        assert after and all(r["doc_id"] in before for r in after)
        if name == "simhash":
            assert sorted(r["doc_id"] for r in after) == least_of_similar([(i, r["text"]) for i, group in before.items() for r in group])
        if name in ("toxicity", "simhash", "mixing"):
            assert all(r == before[r["doc_id"]][0] for r in after)
        if name == "mixing":
            assert max(np.unique([r["doc_id"] for r in after], return_counts=True)[1]) <= 2
        docs = out


def test_pipeline_is_registered(spark):
    import __spark_entry__ as entry

    assert {"pipeline", *QUERIES} <= set(entry.queries())
    assert entry.queries()["pipeline"](spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert duckdb.__version__
