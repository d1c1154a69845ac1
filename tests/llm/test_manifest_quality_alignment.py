"""Merkle manifest, quality discriminant and token alignment against plain versions, with nulls, ties, repeated rows,
empty tables, long texts and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("harrow.llm.queries")

from pyspark.sql import functions as F  # noqa: E402

from harrow.llm import alignment, merkle, quality  # noqa: E402
from harrow.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
CLASH = ["row", "tree", "pos", "n", "hash", "level", "proof", "score", "id", "x", "y", "fold", "block", "pair", "kept"]
ROWS = [
    (1, "same text here. and on.", "a"), (1, "same text here. and on.", "a"), (2, None, None), (3, "", ""), (4, "line\nline\n", "a"), (None, "no id", "b"), (None, "no id", "b"),
    (5, "x" * 50_000, "c"), (6, "a  b\t c \n", None), (7, "<|endoftext|> <s> </s> <unk> <0x41>", "é"), (8, "▁ odd ▁", "a"), (9, " lead", "a"), (10, "trail ", "a"),
    (11, "Straße 😀 naïve     中文字", "b"), (12, "\n", "c"), (13, "it's 'tis don't 12 345,678", "b"), (14, "  ", "a"), (-3, "word " * 3000, "a"), (15, "\x00\x01", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(k) for k, c in enumerate(CLASH)})


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves, fanout):
    """The root, and per leaf the (left, right) digests of every level."""
    ways, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // fanout * fanout:(k // fanout + 1) * fanout]
            ways[i].append(("".join(run[:k % fanout]), "".join(run[k % fanout + 1:])))
        at, level = [k // fanout for k in at], [h(*level[k:k + fanout]) for k in range(0, len(level), fanout)]
    return level[0], ways


def plain_manifest(rows, fanout):
    """(leaf, subroot, root, proof) of every row (source, doc_id, leaf), sorted."""
    groups = {}
    for source, doc_id, digest in rows:
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, digest))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: tree([x[2] for x in sorted(groups[s])], fanout) for s in names}
    root, upper = tree([made[s][0] for s in names], fanout)
    out = []
    for s, above in zip(names, upper):
        out += [(x[2], made[s][0], root, way + above) for x, way in zip(sorted(groups[s]), made[s][1])]
    return sorted(out)


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_manifest(spark, docs, fanout):
    cols = ["doc_id", "source", "text"]
    made = merkle.manifest(docs, merkle.leaf_of([F.col(c) for c in cols]), ["doc_id", "row"], fanout=fanout, carry={"leaf_again": F.col("doc_id")})
    got = made.withColumn("root_again", merkle.folded(F.col("leaf"), F.col("proof"))).withColumn("digest", merkle.digest_of(F.col("proof"))).collect()
    want = plain_manifest([(s, i, leaf(i, s, t)) for i, t, s in ROWS], fanout)
    assert sorted((r["leaf"], r["subroot"], r["root"], [(p["left"].hex(), p["right"].hex()) for p in r["proof"]]) for r in got) == want
    assert all(r["root_again"] == r["root"] for r in got)
    assert all(r["digest"] == h(*[p["left"].hex() + p["right"].hex() for p in r["proof"]]) for r in got)
    assert all(r["row"]["doc_id"] == r["leaf_again"] and r["row"]["row"] == 0 for r in got)


def test_manifest_of_many_levels(spark):
    """A source with most rows, several partitions, and more sources than one run holds."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 40).cast("string"))).alias("source"))
    made = merkle.manifest(df, merkle.leaf_of([F.col("doc_id")]), ["doc_id"]).collect()
    want = plain_manifest([("hot" if i % 3 else f"s{i % 40}", i, leaf(i)) for i in range(3000)], 3)
    assert sorted((r["leaf"], r["subroot"], r["root"], [(p["left"].hex(), p["right"].hex()) for p in r["proof"]]) for r in made) == want


def test_manifest_edges(spark, docs):
    cols = merkle.leaf_of([F.col("doc_id")])
    assert merkle.manifest(docs.limit(0), cols, ["doc_id"]).collect() == []
    one = merkle.manifest(docs.filter("doc_id = 3"), cols, ["doc_id"]).collect()
    assert [(r["leaf"], r["subroot"], r["root"], r["proof"]) for r in one] == [(leaf(3), leaf(3), leaf(3), [])]
    two = merkle.manifest(docs.filter("doc_id in (2, 3)"), cols, ["doc_id"]).collect()
    assert {r["root"] for r in two} == {h(leaf(2), leaf(3))}
    assert {r["subroot"] for r in two} == {leaf(2), leaf(3)}


def test_manifest_finds_tampering(spark):
    got = {r["doc_id"]: r for r in QUERIES["op11_merkle_manifest"](spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for i, r in got.items():
        changed = zlib.crc32(str(i).encode()) % 2 == 0 and "\n" in (texts[i] or "")
        assert r["verified"] == (not changed) and (r["folded_root"] == r["root"]) == r["verified"]
    assert {r["verified"] for r in got.values()} == {True, False}


def test_quality_is_the_plain_discriminant(spark):
    """Scores against densities that are written out: determinants and solved systems instead of cached factors."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.labelled_statistics(docs, labels, "text", "doc_id", "quality").collect()
    x, y, fold = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]), np.array([r["fold"] for r in rows])
    q = np.rint(x * quality.STEPS) / quality.STEPS

    def density(train):
        s, n = {}, {k: int((y[train] == k).sum()) for k in (0, 1)}
        cov = {k: np.cov(q[train][y[train] == k].T, bias=True) for k in (0, 1)}
        pooled = sum(n[k] * cov[k] for k in (0, 1)) / sum(n.values())
        scale = np.sqrt(np.diag(pooled) + 1e-4)
        for k in (0, 1):
            c = (n[k] * cov[k] + x.shape[1] * pooled) / (n[k] + x.shape[1]) / np.outer(scale, scale)
            rho = max(quality.shrinkage(c, n[k]), 1e-3)
            s[k] = (1 - rho) * c + (rho * np.trace(c) / len(c) + 1e-6) * np.eye(len(c))

        def of(v):
            out = []
            for k in (0, 1):
                z = (v - q[train][y[train] == k].mean(axis=0)) / scale
                out.append(-0.5 * np.linalg.slogdet(s[k])[1] - 0.5 * z @ np.linalg.solve(s[k], z))
            return np.clip(out[1] - out[0], -quality.REACH, quality.REACH)

        return of

    every = density(np.ones(len(y), bool))
    apart = [density(fold != f) for f in range(quality.FOLDS)]
    cells = Counter((round(apart[f](v) * quality.CELLS), int(k)) for v, k, f in zip(x, y, fold))
    z = sorted({c for c, _ in cells})
    slope, shift = quality.calibrate(np.array(z) / quality.CELLS, np.array([[cells[c, 0], cells[c, 1]] for c in z], float))
    got = quality.quality(docs, docs, labels).collect()
    for r in got[::7]:
        want = 1 / (1 + np.exp(-(slope * every(quality.statistics(r["row"]["text"])) + shift)))
        assert abs(r["score"] - want) < 1e-3 and r["predicted"] == int(r["score"] >= 0.5)


def test_quality_on_documents_kept_out(spark):
    folder = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [r for r in QUERIES["op12_quality_qda"](spark, folder).collect() if r["held_out"] and r["doc_id"] in marks]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert len(got) > 80 and np.mean([r["predicted"] == marks[r["doc_id"]] for r in got]) >= 0.97


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (4, 0), (5, None), (None, 1), (9, 2), (7, 1)], "doc_id long, quality int")
    rows = quality.labelled_statistics(docs, labels, "text", "doc_id", "quality").select("y").collect()
    assert sorted(r["y"] for r in rows) == [0, 0, 1, 1, 1]  # of several labels the highest; both rows of id 1
    got = quality.quality(docs, docs, labels).collect()
    assert sorted(str(r["row"]) for r in got) == sorted(map(str, docs.collect()))
    assert all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if not r["row"]["text"]}) == 1 and len({r["score"] for r in got if r["row"]["doc_id"] == 1}) == 1
    assert quality.quality(docs.limit(0), docs, labels).collect() == []
    assert {r["score"] for r in quality.quality(docs, docs, labels.limit(0)).collect()} == {0.5}
    assert {round(r["score"], 6) for r in quality.quality(docs, docs, labels.filter("quality = 0")).collect()} == {round(1 / 6, 6)}  # ids 1 (two rows), 3 and 4


def plain_alignment(rows):
    """Contract columns by document, tokens walked one by one over whole texts."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    a_kind = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_kind.encode_special_tokens = True
    b_kind = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    alphabet = {}
    for b in range(256):  # the library shows which character a byte has
        if b < 128:
            alphabet[ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0]] = b
    for code in range(128, 0x500):
        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(code))[0][0]
        alphabet.update(zip(shown, chr(code).encode()))
    for code in (0x800, 0x4E2D, 0xFFFD, *range(0x1000, 0x10000, 0x1000), 0x10000, 0x1F600, 0x40000, 0x80000, 0xC0000, 0x100000):
        if not 0xD800 <= code < 0xE000:
            shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(code))[0][0]
            alphabet.update(zip(shown, chr(code).encode()))

    def a_of(i):
        token = a_kind.id_to_token(i)
        return bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()

    def b_of(i):
        piece = b_kind.id_to_piece(i)
        found = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(found[1], 16)]) if found else piece.replace("▁", " ").encode()

    told, counts = [], Counter()
    for text in rows:
        a = a_kind.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_kind.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if not text or b"".join(map(a_of, a)) != raw or b"".join(map(b_of, b)) != raw:
            told.append((0, 0, 0, [], ""))
            continue
        ends_a, ends_b = ([sum(len(of(i)) for i in ids[:k + 1]) for k in range(len(ids))] if len(ids) < 400 else np.cumsum([len(of(i)) for i in ids]).tolist() for ids, of in ((a, a_of), (b, b_of)))
        groups, links, p, q = [], [], 0, 0
        for stop in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(stop, p) + 1, ends_b.index(stop, q) + 1
            groups.append(",".join(map(str, a[p:x])) + "|" + ",".join(map(str, b[q:y])))
            links.append((a[x - 1], b[y - 1]))
            p, q = x, y
        counts.update(links)
        told.append((len(a), len(b), len(groups), links, ";".join(groups)))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    return [(na, nb, ng, len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), groups) for na, nb, ng, links, groups in told]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def aligned(docs, **more):
    import public_tokenizers as P

    return alignment.align(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), groups=True, **more)


@pytest.mark.parametrize("block_size", [1 << 23, 1, 40])
def test_alignment(spark, docs, block_size):
    got = aligned(docs, block_size=block_size).collect()
    want = plain_alignment([t for _, t, _ in ROWS])
    key = lambda x: str(x)
    assert sorted(((r["row"]["doc_id"], *[r[c] for c in COLUMNS]) for r in got), key=key) == sorted(((i, *w) for (i, _, _), w in zip(ROWS, want)), key=key)
    assert all(r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") for r in got)
    assert got[0]["row"].asDict().keys() == set(docs.columns) - {"text"}


def test_alignment_of_the_tables(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op13_token_alignment"](spark, SF).collect()}
    for r, w in zip(rows, plain_alignment([r["text"] for r in rows])):
        g = got[r["doc_id"]]
        assert tuple(g[c] for c in COLUMNS[:-1]) == w[:-1]
        assert g["groups_sha256"] == (hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "")


def test_alignment_edges(spark, docs):
    assert aligned(docs.limit(0)).collect() == []
    bad = docs.select("doc_id", F.unhex(F.lit("ff41")).alias("text")).limit(2)
    assert [(r["n_a"], r["groups"], r["groups_sha256"]) for r in aligned(bad).collect()] == [(0, "", "")] * 2


def test_coalescing_and_overlaps():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        a, b = (np.append(np.flatnonzero(rng.random(n - 1) < 0.4) + 1, n) for _ in range(2))
        in_a, in_b = alignment.coalesce(a, b)
        both = sorted(set(a.tolist()) & set(b.tolist()))
        assert np.cumsum(in_a).tolist() == [int((a <= s).sum()) for s in both] and np.cumsum(in_b).tolist() == [int((b <= s).sum()) for s in both]
        x, y = alignment.overlaps(a, b)
        starts = lambda e: np.append(0, e[:-1])
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(starts(a)[i], starts(b)[j]) < min(a[i], b[j])]
        assert list(zip(x.tolist(), y.tolist())) == want
