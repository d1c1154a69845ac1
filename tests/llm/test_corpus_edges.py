"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest

pytest.importorskip("harrow.llm.queries")

from pyspark.sql import functions as F  # noqa: E402

from harrow.llm import decontaminate, langid, mixing, sentences, simhash, substrings, tokens, topk, toxicity, urlfilter  # noqa: E402

LONG = "Der lange Satz wird hier wiederholt und wiederholt. " * 4000
SAME = "one two three four five six seven eight nine ten. " * 4 + "the end of this text comes here, at last. so it is. indeed."
ROWS = [
    (1, SAME, "en", "a"), (2, SAME, "en", "a"), (2, SAME, "en", "a"), (3, None, None, None), (4, "", "de", "b"),
    (5, LONG, "de", "b"), (None, "a text without an id", "en", None), (None, None, None, None), (6, "  \n\t ", "fr", "b"),
    (7, "123 456", "fr", ""), (8, "übermäßig schöne Straße " * 30, "de", None), (9, "x", "en", "a"), (2, "same id, other text", "en", "c"),
]
CLASH = ["row", "kept", "size", "h1", "at", "fp", "score", "shards", "key", "u", "hits", "tie"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit(k) for k, c in enumerate(CLASH)})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 1), (4, None, 1), (5, 0, None), (9, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def operators(spark, labels):
    bench = spark.createDataFrame([(1, "three four five six seven eight nine ten one two"), (2, None), (None, "x"), (3, ""), (3, "Straße")], "item_id long, text string")
    return {
        "sentences": lambda d: sentences.drop_repeated_spans(d),
        "substrings": lambda d: substrings.drop_repeated_bytes(d),
        "language": lambda d: langid.identify(d, d),
        "toxicity": lambda d: toxicity.toxicity(d, d, labels),
        "mixing": lambda d: mixing.mix(d),
        "decontaminate": lambda d: decontaminate.find(d, bench),
        "clean": lambda d: decontaminate.find(d, bench, clean=True),
    }


NAMES = ["sentences", "substrings", "language", "toxicity", "mixing", "decontaminate", "clean"]


@pytest.mark.parametrize("name", NAMES)
def test_rows_survive(spark, docs, labels, name):
    out = operators(spark, labels)[name](docs)
    got = sorted(map(str, (r["row"] for r in out.collect())))
    assert got == sorted(map(str, docs.collect()))


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, labels, name):
    out = operators(spark, labels)[name](docs.limit(0))
    assert out.collect() == []


def by_id(df, *cols):
    return sorted((tuple(r) for r in df.select(F.col("row.doc_id"), *cols).collect()), key=str)


def test_sentences_values(docs):
    got = by_id(sentences.drop_repeated_spans(docs), F.col("row.text"), "kept", "n_removed")
    for doc_id, text, kept, n in got:
        if text == SAME and doc_id == 2:
            assert n > 0 and len(kept) < len(text)
        if not text:
            assert kept == text and n == 0
    assert len({g for g in got if g[1] == SAME and g[0] == 2}) == 1


def test_substrings_values(docs):
    for doc_id, text, n, gone in by_id(substrings.drop_repeated_bytes(docs), F.col("row.text"), "n_bytes", F.size("removed")):
        assert n == len((text or "").encode())
        assert gone == (1 if text in (LONG, SAME) and (doc_id != 1 or False) else gone)


def test_language_values(docs):
    rows = langid.identify(docs, docs).select("row.text", "lang_pred", "score", "rejected").collect()
    for r in rows:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert r["lang_pred"] in {"en", "de", "fr"}
    none = langid.identify(docs, docs.limit(0)).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]


def test_toxicity_without_labels(docs, labels):
    rows = toxicity.toxicity(docs, docs, labels.limit(0)).collect()
    assert {r["score"] for r in rows} == {0.5} and all(r["predicted"] == 1 for r in rows)


def test_mixing_values(docs):
    rows = mixing.mix(docs).collect()
    assert all(r["size"] == len((r["row"]["text"] or "").split()) for r in rows)
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.expand(mixing.mix(docs)).count() == sum(r["passes"] for r in rows)


def test_decontaminate_values(docs, spark):
    bench = spark.createDataFrame([(1, "three four five six seven eight nine ten one two"), (None, "x"), (3, "Straße")], "item_id long, text string")
    got = by_id(decontaminate.digest(decontaminate.find(docs, bench), "row"), "n_words", "n_hit", "n_items", "contaminated")
    assert (9, 1, 1, 0, True) in got and (3, 0, 0, 0, False) in got
    assert all(g[3] == 1 for g in got if g[0] in (1, 8))
    none = decontaminate.digest(decontaminate.find(docs, bench.limit(0)), "row").agg(F.sum("n_hit")).first()[0]
    assert none == 0


def test_decontaminate_passes_like_one(spark):
    """Slices whose passages overlap, meet only after a cut, or fill the whole document."""
    a, b = "a b c d e f g h i j", "f g h i j k l m n o"
    bench = spark.createDataFrame([(1, a), (2, b), (3, "p q r s t u v w x y"), (4, "z")], "item_id long, text string")
    texts = [a, "a b c d e f g h i j k l m n o end", "p q r s t z u v w x y", "p q r z s t u v w x y", "z", "free text", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [[tuple(r) for r in decontaminate.find(docs, bench, clean=True, pass_words=n).orderBy("row.doc_id").collect()] for n in (1000, 12, 1)]
    assert got[0] == got[1] == got[2]
    assert [len(decontaminate.words(r[1])) for r in got[1]] == [0, 1, 0, 0, 0, 2, 0, 0]
    assert [bool(r[3]) for r in got[1]] == [True] * 5 + [False] * 3


def test_simhash_edges(spark, docs):
    rows = simhash.simhash_groups(docs).collect()
    assert len(rows) == len(ROWS)
    zero = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in zero} == {3, 4, 6, None} and {r["component_id"] for r in zero} == {3}
    assert simhash.simhash_groups(docs.limit(0)).collect() == []
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and 1 in ids
    assert simhash.drop_near_duplicates(docs.limit(0)).collect() == []


def test_tokens_edges(spark, docs, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokens.write_tokens(docs, f"{tmp_path}/a", path)
    rows = tokens.read_tokens(spark, f"{tmp_path}/a").orderBy("start").collect()
    assert len(rows) == len(ROWS)
    assert [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:k]) for k in range(len(rows))]
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in rows), key=lambda x: (x is not None, x))
    assert all(len(r["ids"]) == r["n_tokens"] and r["ids"][-1] == 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] == 3} == {1}
    tokens.write_tokens(docs.limit(0), f"{tmp_path}/b", path)
    assert tokens.read_tokens(spark, f"{tmp_path}/b").collect() == []


def test_tokens_are_those_of_the_library(spark, tmp_path):
    """Ids of special tokens, control characters, tabs and runs of blanks against the plain library on whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|> <|endoftext|>\n", "tab\there \t and", "two  blanks", " lead", "trail ", "a\n b\nc", "\x00 \x01\x1c d", "\u00a0 e\u2003f",
             "it's <|endoftext|>'s", None, "", " ", "über 中文 😀 " * 40, "<|endoftext |>", "z" * 5000, "w <|endoftext|> " * 30]
    plain = Tokenizer.from_file(path)
    for name, part in (("a", texts), ("b", texts * 3)):
        rows = spark.createDataFrame(list(enumerate(part)), "doc_id long, text string")
        tokens.write_tokens(rows, f"{tmp_path}/{name}", path)
        got = {r["doc_id"]: r["ids"] for r in tokens.read_tokens(spark, f"{tmp_path}/{name}").collect()}
        for i, text in enumerate(part):
            assert got[i] == [*plain.encode(text or "", add_special_tokens=False).ids, 0]


def test_top_k_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, []), (8, [1.0]), (None, [1.0, 1.0]), (20, [-1.0, -1.0]), (9, [3e30, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("length", F.lit(1)).withColumn("v", F.lit(2))
    got = sorted(tuple(r) for r in topk.top_k(v, v.filter("vec_id % 20 = 0")).collect())
    assert [g[2] for g in got if g[0] == 0] == [9, 1, 2, 8, 7, 20]
    assert [g[3] for g in got if g[0] == 0][1:] == [64 * 64 + 128 * 128] * 2 + [64 * 64, 0, -64 * 64 - 64 * 128]
    assert topk.top_k(v.limit(0), v.limit(0)).collect() == []
    assert topk.top_k(v, v.limit(0)).collect() == []


def test_url_edges(spark):
    urls = [None, "", "no scheme/en/", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://example.net", "http://example.net/EN/", "http://x.org/fr/#a",
            "ftp://u:p@de.example.com:80/de/", "http://example.com:80/de/", "a://b://c.net/", "http://example.com/de/\nx"]
    pages = spark.createDataFrame([(i, u, "row") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = spark.createDataFrame([("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), (None, "x", "/")],
                                  "verdict string, host string, path string")
    got = [tuple(r) for r in urlfilter.filter_urls(pages, rules).orderBy("row.page_id").select("host", "path", "rule", "verdict").collect()]
    assert got[:4] == [("", "", None, "allow")] * 4
    assert got[4] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[5] == ("example.net", "", None, "allow")
    assert got[6] == ("example.net", "/EN/", "net/", "block")
    assert got[7] == ("x.org", "/fr/", "org/fr/", "allow")
    assert got[8][2:] == (None, "allow") and got[9][2:] == (None, "allow")
    assert got[11] == ("example.com", "/de/\nx", "example.com/de/", "block")
    assert urlfilter.filter_urls(pages.limit(0), rules).collect() == []
    assert urlfilter.filter_urls(pages, rules.limit(0)).filter("verdict <> 'allow'").count() == 0
