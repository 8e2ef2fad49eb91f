"""A benchmark that takes several automata gives what one automaton gives."""

from collections import Counter

from leafvoice.llm import decontaminate


def words(seed, n):
    return " ".join(f"q{(seed * 7919 + i * i * 31 + i) % 997}" for i in range(n))


def rows_of(df):
    return Counter((repr(r[0]), r.n_words, r.n_hit, tuple(r["items"]), tuple(map(tuple, r.spans))) for r in df.collect())


def test_parts_are_united(spark, monkeypatch):
    items = [(i, words(i, 40)) for i in range(30)] + [(100, words(100, 900)), (100, words(100, 900)), (None, words(5, 40)), (101, "One"), (102, None), (103, "!!")]
    long = words(100, 900).split()
    docs = [(1, "x " + words(3, 40) + ", " + words(4, 40) + " y"), (2, " ".join(long[200:700])), (3, None), (4, ""), (5, "nothing here"), (6, "one"),
            (6, "one"), (None, words(5, 25)), (7, " ".join(long[190:215]) + " -- " + words(9, 12)), (8, words(5, 25))]
    docs += [(9, words(8, 30))] * 4
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole, with_rows = rows_of(decontaminate.find_contamination(d, bench)), rows_of(decontaminate.find_contamination(d, bench, keep=["text", "doc_id"]))
    assert sum(k[2] > 0 for k in whole) >= 6
    monkeypatch.setattr(decontaminate, "AUTOMATON_WORDS", 1000)
    monkeypatch.setattr(decontaminate, "CHUNK_WINDOWS", 60)
    assert rows_of(decontaminate.find_contamination(d, bench)) == whole
    assert rows_of(decontaminate.find_contamination(d, bench, keep=["text", "doc_id"])) == with_rows
