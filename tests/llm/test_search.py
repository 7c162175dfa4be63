"""Ranked search, n-gram join and collocations against their SQL, on small tables with nulls, empty, long and
repeated texts, ties, repeated and null ids, empty tables and clashing column names."""
from __future__ import annotations

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import phrases, ranked, trie
from gridloom.llm.queries import oracle_sql

SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string())])


def some_rows(seed: int, n: int) -> list[tuple]:
    rnd = random.Random(seed)
    vocab = [rnd.choice(["", "É", "ß"]) + "".join(rnd.choice("abXY9_$") for _ in range(rnd.randint(1, 4))) for _ in range(60)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randint(1, 60))] for _ in range(8)]
    out = [(None, None, None), (1, "", "a"), (2, " \n\t ", "a"), (3, "...", None), (4, "one", "a"), (4, "ONE", "b"), (5, "one two three four", "b"),
           (6, "x " * 3000, "a"), (7, "y" * 4000, None), (None, "one two three four", "a"), (8, "a\x0bb\x0cc\x00d e", "a")]
    for k in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 6])):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        sep = rnd.choice([" ", "  ", "\t", " \n", ", "])
        out.append((rnd.choice([None, 9, k + 10, k + 10, k + 10]), sep.join(words), rnd.choice(["a", "a", "b", None])))
    return out


def expected(name: str, docs: list[tuple], items: list[tuple] = ()) -> list[tuple]:
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([dict(zip(SCHEMA.names, r)) for r in docs], schema=SCHEMA))
    con.register("benchmark", pa.Table.from_pylist([dict(zip(["item_id", "text"], r)) for r in items], schema=pa.schema([("item_id", pa.int64()), ("text", pa.string())])))
    out = con.execute(oracle_sql()[name]).to_arrow_table()
    return sorted((tuple(r[c] for c in sorted(out.schema.names)) for r in out.to_pylist()), key=str)


def result(df) -> list[tuple]:
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_ranked_search(spark, seed, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 200)  # many blocks a stratum
    monkeypatch.setattr(ranked, "CELLS", 64)
    monkeypatch.setattr(ranked, "PART_TERMS", 100)  # several parts
    docs = some_rows(seed, 150)
    items = [(i, t) for i, t, _ in some_rows(seed + 10, 12)] + [(50, "one ONE one"), (50, "two"), (51, None)]
    table = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, lang string, m string, terms int")
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    got = ranked.search(ranked.build(table), asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert result(got) == expected("op11_ranked_search", docs, items)


def test_ranked_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([("a", "one"), ("b", None)], "item_id string, text string")
    assert ranked.search(ranked.build(none), items).collect() == []
    one = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert ranked.search(ranked.build(one), items.where("false")).collect() == []
    assert [tuple(r)[:3] for r in ranked.search(ranked.build(one), items).collect()] == [("a", 1, 1)]


@pytest.mark.parametrize("seed", [3, 4])
def test_join_equals_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 60)  # tries in blocks
    monkeypatch.setattr(trie, "GATHER", 300)  # several chunks
    docs = some_rows(seed, 250)
    table = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, lang string, node string, n int")
    got = trie.classes(table)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert result(got) == expected("op12_ngram_join", docs)


def test_join_of_nothing(spark):
    assert trie.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert result(trie.classes(only)) == [(1, 1, 0), (2, 2, 0)]


def test_trie_finds_every_partner():
    rnd = random.Random(5)
    for _ in range(40):
        base = [rnd.sample(range(1, 60), rnd.randint(3, 20)) for _ in range(4)]
        drawn = {tuple(sorted(set(rnd.choice(base)) ^ set(rnd.sample(range(1, 60), rnd.randint(0, 3))))) for _ in range(30)} - {()}
        sequences = [np.array(s, np.uint64) for s in sorted(drawn)]
        sizes = np.array([len(s) + rnd.randint(0, 1) for s in sequences])
        tree = trie.Trie(sequences, sizes)
        tree.label(np.arange(len(sequences)))
        for i, s in enumerate(sequences):
            want = {j for j, t in enumerate(sequences) if j != i and 9 * len(np.intersect1d(s, t)) >= 4 * (sizes[i] + sizes[j])}
            assert set(tree.probe(s, int(sizes[i]), i)) == want


@pytest.mark.parametrize("hot", [1 << 16, 20])
def test_collocations(spark, hot, monkeypatch):
    monkeypatch.setattr(phrases, "HOT", hot)  # at 20 the usual pairs and triples are hot
    monkeypatch.setattr(phrases, "GATHER", 6000)
    monkeypatch.setattr(phrases, "RANGE_BYTES", 200_000)
    docs = some_rows(6, 700)
    table = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, lang string, n string, word int")
    got = phrases.collocations(table)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = expected("op13_collocations", docs)
    assert len(want) > 5 and result(got) == want


def test_collocations_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([("a b", None), (None, "x")], "text string, lang string")).collect() == []
