"""The stages of the pipeline and run() against plain Python, at production width, on awkward rows."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline as C
from leafvoice.llm import quality

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DOC = "doc_id long, text string, lang string, source string, n_chars long, _size long, _kept long, _d string, row string, own long, id string, n long"


def prose(seed, n):
    return " ".join(f"Word{x}" if x % 11 == 0 else f"word{x}" for x in np.random.default_rng(seed).integers(0, 900, n))


BASE = prose(1, 200)
TEST = "the capital of the northern province was moved twice before the war"
TEXTS = [
    (1, BASE), (2, BASE), (2, BASE), (3, BASE.replace("word7", "other7") + " tail"), (4, prose(2, 120)), (4, prose(3, 90)), (None, BASE), (None, prose(4, 80)),
    (None, prose(4, 80)), (5, None), (6, ""), (7, "too short"), (8, prose(5, 70) + " " + TEST.upper() + ". " + prose(6, 60)), (9, prose(7, 400)), (10, prose(8, 55)),
    (11, "again and again " * 40), (12, prose(2, 120).lower()), (13, prose(9, 61) + "\n" + prose(10, 50)), (14, " ".join(BASE.split()[:190])),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", None if k % 7 == 6 else f"s{k % 2}", 5, -1, -2, "d", "r", -3, "x", -4) for k, (i, t) in enumerate(TEXTS)]
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (9, 1, 0), (None, 0, 0), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, TEST), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def bag(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def passes_rules(t):
    w = BLANK.findall(t or "")
    c, hit = Counter(zip(w, w[1:], w[2:])), set()
    for j in range(len(w) - 2):
        if c[tuple(w[j: j + 3])] > 1:
            hit.update((j, j + 1, j + 2))
    return len(w) >= 50 and 100 * len(hit) <= 50 * len(w)


def shingles(t):
    w = [x.translate(LOW) for x in BLANK.findall(t or "")]
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}


def deduplicated(rows):
    """Distinct (id, text); texts of 0.8 or more are one group, of which the smallest id stays."""
    texts = sorted({t for _, t in rows if shingles(t)})
    label = {t: t for t in texts}
    for a, b in combinations(texts, 2):
        x, y = shingles(a), shingles(b)
        if 100 * len(x & y) >= 80 * len(x | y):
            old, new = label[b], label[a]
            label = {t: new if v == old else v for t, v in label.items()}
    groups, out = defaultdict(list), []
    for i, t in set(rows):
        if shingles(t):
            groups[label[t]].append((i is None, i or 0, t))
        else:
            out.append((i, t))
    for members in groups.values():
        none, i, _ = min(members)
        out.append((None if none else i, {t for n, j, t in members if (n, j) == (none, i)}))
    return out


def same_kept(got, want):
    """``want`` has a set of texts where equal ids leave open which one stays."""
    got = list(got.elements())
    assert len(got) == len(want)
    for i, t in want:
        found = next((g for g in got if g[0] == i and (g[1] in t if isinstance(t, set) else g[1] == t)), None)
        assert found is not None, (i, t)
        got.remove(found)


def test_quality_rules(spark, docs, folder):
    out = C.quality_rules(spark, docs, folder)
    assert out.columns == docs.columns and bag(out) == Counter((i, t) for i, t in TEXTS if passes_rules(t))


def test_near_dedup(spark, docs, folder):
    out = C.minhash_near_dedup(spark, docs, folder)
    assert out.columns == docs.columns
    same_kept(bag(out), deduplicated(TEXTS))
    assert {tuple(r)[5:] for r in out.collect()} == {(-1, -2, "d", "r", -3, "x", -4)}


def test_near_dedup_keeps_different_texts_of_one_id(spark, docs, folder):
    kept = bag(C.minhash_near_dedup(spark, docs, folder))
    assert kept[4, prose(3, 90)] == 1 and kept[4, prose(2, 120)] == 1 and kept[None, prose(4, 80)] == 1 and not kept[None, BASE] and kept[1, BASE] == 1


def contaminated(t):
    w, item = (ITEM.findall((y or "").translate(LOW)) for y in (t, TEST))
    windows = {tuple(item[i: i + 10]) for i in range(len(item) - 9)}
    return any(tuple(w[i: i + 10]) in windows for i in range(len(w) - 9))


def test_decontamination(spark, docs, folder):
    out = C.benchmark_decontamination(spark, docs, folder)
    assert out.columns == docs.columns and bag(out) == Counter((i, t) for i, t in TEXTS if not contaminated(t))
    assert sum(contaminated(t) for _, t in TEXTS) == 1


def test_mix(spark, docs, folder):
    out = C.mix(spark, docs, folder)
    assert out.columns == docs.columns
    sizes, taken = Counter(), Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(BLANK.findall(r["text"] or ""))
    copies = Counter()
    for r in out.collect():
        taken[r["source"]] += len(BLANK.findall(r["text"]))
        copies[r["doc_id"], r["text"], r["source"]] += 1
    there = Counter((r["doc_id"], r["text"], r["source"]) for r in docs.collect())
    assert all(n <= 3 * there[k] for k, n in copies.items())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = dict(zip(names, (5, 2, 1)))
    total, fixed = sum(sizes.values()), {}
    while True:
        unit = (total - sum(fixed.values())) / max(1, sum(w for s, w in weights.items() if s not in fixed))
        over = {s: 3 * sizes[s] for s in names if s not in fixed and unit * weights[s] > 3 * sizes[s]}
        if not over:
            break
        fixed |= over
    for s in names:
        assert abs(taken[s] - fixed.get(s, unit * weights[s])) <= 400


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


def check_packs(rows, docs):
    """``rows``: doc_id, start, n_tokens, ids_crc32 of ``docs`` (id, text) in any order within an id."""
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(docs, ids_of(t for _, t in docs)))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_token_output(spark, docs, folder):
    check_packs(C.token_output(spark, docs, folder).collect(), TEXTS)


def test_run(spark, folder):
    """All stages in order: each acts on what the one before it kept."""
    rows = C.run(spark, folder).collect()
    clean = [(i, t) for i, t in deduplicated([x for x in TEXTS if passes_rules(x[1])])]
    clean = [(i, t) for i, t in clean if not contaminated(next(iter(t)) if isinstance(t, set) else t)]
    possible = defaultdict(set)
    for (i, texts) in clean:
        for t in texts if isinstance(texts, set) else {texts}:
            possible[i] |= {(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids_of([t])}
    assert rows and all((r["n_tokens"], r["ids_crc32"]) in possible[r["doc_id"]] for r in rows)
    assert all(n <= 3 * len(possible[i]) for i, n in Counter(r["doc_id"] for r in rows).items())
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_stages_on_an_empty_table(spark, docs, folder):
    for name, stage in C.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == [], name


def test_classifier_with_nothing_to_learn_from(spark):
    """All documents held out: every score is 0.5."""
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    measured = quality.measure(docs)
    model = quality.train(measured.limit(0), docs.select("doc_id"))
    assert [r["score"] for r in quality.score(measured, model).collect()] == [0.5, 0.5]
