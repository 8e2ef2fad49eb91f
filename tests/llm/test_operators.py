"""The training-data operators against plain Python, on awkward rows: nulls, empty and long texts, ties, repeated rows,
empty tables, and extra columns with clashing names."""

import contextlib
import hashlib
import io
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from leafvoice.llm import chat, decontaminate, fmindex, graph, minhash, mixing, quality, rules, suffixarray, suffixtree, tokens
from leafvoice.llm.tables import Steps

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DOC = "doc_id long, text string, source string, row long, n long, label string, _row string, size double"


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}é" if x % 7 == 0 else f"w{x}" for x in rng.integers(0, vocabulary, n))


BASE = prose(1, 300)
TEXTS = [
    (0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "ONE"), (5, "a b"), (6, BASE), (7, BASE), (8, BASE.replace(" w3 ", " x3 ") + " tail words"),
    (9, prose(2, 200) + " " + " ".join(BASE.split()[50:130]) + " " + prose(3, 90)), (10, prose(4, 9000)), (11, "St " * 700),
    (12, "line one here\n" * 60), (12, "line one here\n" * 60), (None, BASE), (None, "lonely words"), (13, "a\x0bb\r\nc"), (14, "漢字 ü" * 30),
    (15, " ".join(BASE.split()[:250])), (16, "### $$$ %% " * 40 + prose(5, 60)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if k % 5 == 0 else f"s{k % 3}", 7, 8, "x", "y", 1.5) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOC).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def shuffled(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def words(t):
    return WORD.findall(t or "")


def test_minhash(docs, empty):
    sets = []
    for i, t in TEXTS:
        w = words((t or "").translate(LOW))
        sets.append((i, frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else [])))
    near = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    want = []
    for i, s in sets:
        if i is None:
            want.append((None, len(s), None, True))
            continue
        seen, todo = {i}, [s]
        while todo:
            x = todo.pop()
            for j, y in sets:
                if j is not None and j not in seen and near(x, y):
                    seen.add(j)
                    todo.append(y)
        want.append((i, len(s), min(seen), min(seen) == i))
    assert shuffled(minhash.near_duplicates(docs, width=2).collect()) == shuffled(want)
    assert minhash.near_duplicates(empty).collect() == []


def test_minhash_chain_across_tiles(spark):
    """Many near copies around one text, some of which are linked through others only."""
    rng, base, rows = np.random.default_rng(3), prose(9, 120).split(), []
    for i in range(300):
        w = list(base)
        for k in rng.choice(120, int(rng.integers(0, 16)), replace=False):
            w[k] = f"y{rng.integers(10**6)}"
        rows.append((i, " ".join(w)))
    sets = [frozenset(zip(t.split(), t.split()[1:])) for _, t in rows]
    label = list(range(300))
    changed = True
    while changed:
        changed = False
        for a in range(300):
            for b in range(a):
                if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    x, y = max(label[a], label[b]), min(label[a], label[b])
                    label = [y if z == x else z for z in label]
                    changed = True
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(label))


def test_components(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 3), (7, 7)]
    got = graph.components(spark.createDataFrame(pairs, "a long, b long"), Steps(spark, "test"))
    label = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}
    for _ in range(100):
        for a, b in pairs:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    assert {r.node: r.label for r in got.collect()} == label
    assert graph.components(spark.createDataFrame([], "a long, b long"), Steps(spark, "test")).collect() == []


def test_circulant_signature_is_one_permutation_shifted():
    v = np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64)
    sig = minhash.circulant(v, np.array([0, 0, 50]), 64)
    assert sig.shape == (1, 64) and len(set(sig[0].tolist())) > 32
    x = np.arange(1 << 16, dtype=np.uint32)
    y = x.copy()
    minhash._permute(y, np.empty_like(y))
    assert len(np.unique(y)) == len(x)


def test_token_packs(spark, docs, empty, tmp):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    odd = ["'s don't I'LL x_y İΣΣ q\x85z ﬁ ½ <|endoftext|>", "á b c d", "ABC def. ghi,, (x)"]
    rows = [(i, x) for i, x in TEXTS] + [(100 + k, x) for k, x in enumerate(odd)]
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(100 + k, x) for k, x in enumerate(odd)], "doc_id long, text string"))
    folder = f"file://{tmp}/out"
    tokens.write_tokens(more, folder, path)
    ids = {x: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4").tobytes() for _, x in rows}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for i, x in order:
        want.append((i, start, len(ids[x]) // 4, ids[x]))
        start += len(ids[x]) // 4
    got = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in tokens.read_tokens(spark, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert [x.tobytes() for x in tokens.read_document(spark, folder, 9)] == [ids[dict(TEXTS)[9]]]
    with pytest.raises(ValueError):
        tokens.unpack_index(b"LVT1" + b"\0" * 40, b"other")
    tokens.write_tokens(empty, folder + "0", path)
    assert tokens.read_tokens(spark, folder + "0").collect() == []


def test_mixing(docs, empty):
    size = Counter()
    for k, (_, t) in enumerate(TEXTS):
        size[None if k % 5 == 0 else f"s{k % 3}"] += len(words(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:
        unit = (sum(size.values()) - sum(fixed.values())) / max(1, sum(weight[s] for s in names if s not in fixed))
        over = {s: 3 * size[s] for s in names if s not in fixed and unit * weight[s] > 3 * size[s]}
        if not over:
            break
        fixed |= over
    target = {s: fixed.get(s, unit * weight[s]) for s in names}
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(TEXTS)
    taken = Counter()
    for r in rows:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source]) and 0 <= r.copies <= 3
        assert r.size or not r.copies
        taken[r.source] += r.copies * r.size
    for s in names:
        largest = max(len(words(t)) for k, (_, t) in enumerate(TEXTS) if (None if k % 5 == 0 else f"s{k % 3}") == s)
        assert abs(taken[s] - target[s]) <= largest
    assert shuffled(rows) == shuffled(mixing.mix_sources(docs).collect())
    assert mixing.mixed_documents(docs).count() == sum(r.copies for r in rows) and mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix_sources(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []


def test_pareto_prefers_by_inclusion_odds(spark):
    """A third of a source is taken: the words come near, and another seed takes others."""
    d = spark.createDataFrame([(i, "w " * (1 + i % 9), "a" if i % 4 else "b") for i in range(4000)], "doc_id long, text string, source string")
    one, two = ({r.doc_id for r in mixing.mix_sources(d, seed=s).where("source = 'b' and copies > 1").collect()} for s in (1, 2))
    rows = mixing.mix_sources(d, seed=1).collect()
    for s in "ab":
        assert math.isclose(sum(r.copies * r.size for r in rows if r.source == s), next(r.target for r in rows if r.source == s), abs_tol=9)
    assert one != two


def rule_counts(t):
    w, lines = words(t), [x for x in (t or "").split("\n") if WORD.search(x)]
    c, hit = Counter(zip(w, w[1:], w[2:])), set()
    for j in range(len(w) - 2):
        if c[tuple(w[j: j + 3])] > 1:
            hit.update((j, j + 1, j + 2))
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(hit), failed


def test_rules(spark, docs, empty):
    labels = spark.createDataFrame([(6, 1), (7, 1), (16, 0), (None, 0), (3, None)], "doc_id long, quality int")
    got = rules.judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert shuffled(got) == shuffled([(i, *rule_counts(t)) for i, t in TEXTS])
    kept = rules.kept_documents(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r.text for r in kept.collect()) == Counter(t for _, t in TEXTS if not rule_counts(t)[5])
    assert rules.judge(empty, labels.limit(0)).collect() == []


def test_rules_are_learnt(spark):
    rows = [(i, prose(i, 80) if i % 3 else prose(i, 80).replace(" w1", "! ### W1")) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(200)], "doc_id long, quality int")
    got = rules.judge(spark.createDataFrame(rows, "doc_id long, text string"), labels).where("not base_failed").collect()
    assert len(got) == 240 and all(r.kept == (r.doc_id % 3 != 0) for r in got)


def test_chats(spark):
    rows = [(1, 0, "user", "hi <s>[user] \\l \\-"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, None, "system", None), (2, 0, None, ""), (None, 3, "assistant", "ü\n"),
            (1, 1, "assistant", "</s>[INST] ok [/INST]"), (3, 0, "we]ird", "x\\")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(turns.withColumn("content", chat.text_part(turns.text)))
    want = defaultdict(list)
    for c, n, r, t in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want[c].append((r or "", t or ""))
    got = {r.conv_id: r for r in chat.read_chats(made).collect()}
    assert {k: [tuple(t) for t in v.turns] for k, v in got.items()} == want
    assert {k: v.learnt for k, v in got.items()} == {k: "".join(t for r, t in v if r == "assistant") for k, v in want.items()}
    parts = [[("text", "see [1] ", None, None), ("image", None, "a.png", 3), ("audio", None, "b.wav", None), None, ("other", "<x>", None, None), ("document", "no", "c.pdf", 2)], None]
    mixed = spark.createDataFrame([(1, i, "user", p) for i, p in enumerate(parts)], f"conv_id long, turn long, role string, content {chat.CONTENT}")
    r = chat.format_chats(mixed).first()
    assert r.formatted == "<s>[user] see \\b1\\e <image:1><audio:2>\\lx><document:5></s><s>[user] </s>"
    assert [(a.turn, a.place, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, 1, "image", "a.png", 768), (0, 2, "audio", "b.wav", 25), (0, 5, "document", "c.pdf", 1024)]
    assert chat.format_chats(mixed.limit(0)).collect() == []


def test_suffix_array(docs, empty):
    rows = [(i, (t or "").encode()) for i, t in TEXTS]
    seen = Counter(b[s: s + 200] for _, b in rows for s in range(len(b) - 199))
    want = []
    for i, b in rows:
        mask = np.zeros(len(b), bool)
        for s in range(len(b) - 199):
            if seen[b[s: s + 200]] > 1:
                mask[s: s + 200] = True
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        want.append((i, len(b), int(mask.sum()), int((np.diff(mask.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    assert shuffled((*r[:5], bytes(r.kept)) for r in suffixarray.remove_repeated_bytes(docs).collect()) == shuffled(want)
    assert suffixarray.remove_repeated_bytes(empty).collect() == []


def test_previous_factors():
    text = np.frombuffer(b"abcabcabdabcabc" * 3, np.uint8)
    starts = np.arange(len(text) - 15)
    pos, share = suffixarray.suffix_order(text, starts, 16)
    raw = text.tobytes() + b"\0" * 16
    assert pos.tolist() == sorted(starts.tolist(), key=lambda s: (raw[s: s + 16], s))
    length, source = suffixarray.previous_factors(pos, share)
    for p, n, q in zip(pos.tolist(), length.tolist(), source.tolist()):
        best = max((sum(1 for _ in iter_same(raw, a, p)) for a in range(p)), default=0)
        assert n == min(16, best) // 8 * 8 or n == 15 and best >= 15
        assert n == 0 or (q < p and raw[q: q + n] == raw[p: p + n])


def iter_same(raw, a, b):
    for k in range(16):
        if raw[a + k] != raw[b + k]:
            return
        yield k


def test_fm_index_counts():
    rng = np.random.default_rng(1)
    text, first = rng.integers(0, 3, 400).astype(np.uint64), np.array([0, 60, 61, 200, 400])
    asked, at = rng.integers(0, 4, 300).astype(np.uint64), np.array([0, 5, 100, 300])
    count = Counter(tuple(text[i: i + 6]) for a, b in zip(first, first[1:]) for i in range(a, b - 5))
    want = {i: count[tuple(asked[i: i + 6])] for a, b in zip(at, at[1:]) for i in range(a, b - 5) if count[tuple(asked[i: i + 6])]}
    place, lo, hi = fmindex.FMIndex(text, first, 6).windows(asked, at, 6)
    assert {int(p): int(b - a) for p, a, b in zip(place, lo, hi)} == want and want


def test_fm_index_dedup(docs, empty):
    least = {}
    for i, t in TEXTS:
        w = words(t)
        for s in range(len(w) - 49):
            if i is not None:
                least[tuple(w[s: s + 50])] = min(i, least.get(tuple(w[s: s + 50]), i))
    want = []
    for i, t in TEXTS:
        w = words(t)
        mask = [False] * len(w)
        for s in range(len(w) - 49):
            if i is not None and least[tuple(w[s: s + 50])] < i:
                mask[s: s + 50] = [True] * 50
        kept = " ".join(x for x, m in zip(w, mask) if not m)
        want.append((i, len(w), sum(mask), hashlib.sha256(kept.encode()).hexdigest(), kept))
    assert shuffled(fmindex.remove_repeated_words(docs).collect()) == shuffled(want)
    assert fmindex.remove_repeated_words(empty).collect() == []


@pytest.mark.parametrize("held", [2])
def test_hot_anchors_are_dealt(docs, spark, monkeypatch, held):
    """One passage in many texts, its shards kept tiny: same answer as in one shard."""
    from leafvoice.llm import repeats

    hot = " ".join(prose(77, 70).split())
    rows = [(i, f"{prose(100 + i, 30)} {hot} {prose(300 + i, 20)}") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    whole = [shuffled(f(d).collect()) for f in (suffixarray.remove_repeated_bytes, fmindex.remove_repeated_words)]
    monkeypatch.setattr(repeats, "HELD", held)
    assert [shuffled(f(d).collect()) for f in (suffixarray.remove_repeated_bytes, fmindex.remove_repeated_words)] == whole
    assert sum(r[2] for r in whole[1]) >= 39 * 70


def test_decontamination(spark, docs, empty):
    test_words = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    items = [(1, BASE.upper().replace(" ", ", ")), (2, "One"), (3, None), (4, "!!"), (None, "lonely - words"), (2, "One")]
    windows = defaultdict(set)
    for i, t in items:
        w = test_words.findall((t or "").translate(LOW))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j: j + n])].add(i)
    want = []
    for i, t in TEXTS:
        w = test_words.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j: j + n]) in windows:
                    hit.update(range(j, j + n))
                    found |= {str(x) for x in windows[tuple(w[j: j + n])] if x is not None}
        want.append((i, len(w), len(hit), sorted(found)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs, bench).collect()
    assert shuffled(r[:4] for r in got) == shuffled(want)
    text = dict(TEXTS)
    for r in got:
        if r.doc_id in (6, 9):
            inside = " ".join(text[r.doc_id].encode()[s.start: s.end].decode() for s in r.spans)
            assert len(test_words.findall(inside)) == r.n_hit > 0
    assert decontaminate.find_contamination(empty, bench).collect() == []
    assert all(r.n_hit == 0 for r in decontaminate.find_contamination(docs, bench.limit(0)).collect())


def test_suffix_tree(spark, docs, empty):
    learn = docs.where("doc_id < 12")
    count = Counter(x for i, t in TEXTS if i is not None and i < 12 for x in [*words((t or "").translate(LOW)), None])
    n, v = sum(count.values()), len(count)
    got = suffixtree.score_documents(docs, learn).collect()
    want = Counter()
    for i, t in TEXTS:
        w = [*words((t or "").translate(LOW)), None]
        want[(i, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 4))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert suffixtree.score_documents(empty, learn).collect() == []
    assert all(r.n_known == 0 for r in suffixtree.score_documents(docs, empty).collect())


def test_suffix_tree_learns_contexts(spark):
    """After a comes b, after c d: contexts tell what single counts can't; and each state's distribution sums to one."""
    learn = spark.createDataFrame([(" ".join("a b" if x else "c d" for x in np.random.default_rng(i).integers(0, 2, 60)),) for i in range(50)], "text string")
    asked = spark.createDataFrame([(1, "a b c d a b"), (2, "a d c b a d")], "doc_id long, text string")
    got = {r.doc_id: r for r in suffixtree.score_documents(asked, learn).collect()}
    assert got[1].score > got[1].base_score and got[1].score > got[2].score + 5


def plain_tree(texts, depth=3):
    """A function of text: the suffix tree's score by counts of word tuples, contexts of any number."""
    rows = [[None, *words((t or "").translate(LOW)), None] for t in texts]
    single = Counter(x for r in rows for x in r[1:])
    n, grams = sum(single.values()), Counter(tuple(r[i: j + 1]) for r in rows for j in range(1, len(r)) for i in range(max(0, j - depth), j))
    total, kinds = Counter(), Counter()
    for g, k in grams.items():
        total[g[:-1]] += k
        kinds[g[:-1]] += 1
    unseen = min(0.5, max(1e-6, sum(k == 1 for x, k in single.items() if x is not None) / n))
    candidates = {c for c in total if total[c] >= suffixtree.LEAST_COUNT}

    def p(c, x):
        if not c:
            return (1 - unseen) * single[x] / n if x in single else unseen
        return (max(grams[(*c, x)] - 1, 0) + kinds[c] * p(c[1:], x)) / total[c]

    everything, kept = [*single, "never seen"], set()
    for c in sorted(candidates, key=len, reverse=True):
        assert math.isclose(sum(p(c, x) for x in everything), 1)
        if c in kept or sum(p(c, x) * math.log2(p(c, x) / p(c[1:], x)) for x in everything) >= suffixtree.LEAST_DIVERGENCE:
            kept.update(c[i:] for i in range(len(c)))

    def score(t):
        r = [None, *words((t or "").translate(LOW)), None]
        return sum(math.log10(p(next((c for i in range(max(0, j - depth), j) if (c := tuple(r[i:j])) in kept), ()), r[j])) for j in range(1, len(r)))
    return score, kept


def test_suffix_tree_blocks(spark, monkeypatch):
    """Neither the number of parts nor dealing hot contexts changes a score; a task's pairs leave it as one row per part."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.zipf(1.4, 300) % 40) for _ in range(20)]
    learn = spark.createDataFrame([(t,) for t in texts * 2], "text string")
    asked = spark.createDataFrame([(None, texts[0]), (1, "new " + texts[1]), (1, None), (2, ""), (3, texts[2]), (3, texts[2])], "doc_id long, text string")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    want = sorted(suffixtree.score_documents(asked, learn).collect(), key=key)
    for name, value in (("PART_TOKENS", 500), ("PART_BYTES", 50), ("HOT_CONTEXT", 100), ("COMMON_CONTEXT_SHARE", 1.0), ("COMMON_SHARE", 1.0)):
        monkeypatch.setattr(suffixtree, name, value)
    got = sorted(suffixtree.score_documents(asked, learn).collect(), key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want] and len(got) == 6
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9)

    class Shared:
        value = np.full(suffixtree.FILTER_BITS >> 6, ~np.uint64(0)), np.full(suffixtree.FILTER_BITS >> 6, ~np.uint64(0)), np.zeros(0, np.uint64)

    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    blocks = pa.Table.from_batches(list(suffixtree._pair_counts(Shared, 2, 3)([batch])))
    assert sorted(blocks["part"].to_pylist()) == [0, 1, 2]
    split = [["</s>", *t.split(), "</s>"] for t in texts]
    counts = Counter(tuple(t[i: i + 3]) for t in split for i in range(len(t) - 2))
    out = suffixtree._repeated_pairs(blocks)
    assert sorted(n for x, n in zip(out["x"].to_pylist(), out["n"].to_pylist()) if x is not None) == sorted(n for n in counts.values() if n > 1)
    assert sum(n for x, n in zip(out["x"].to_pylist(), out["n"].to_pylist()) if x is None) == sum(counts.values())


def test_suffix_tree_exchanges_little(spark):
    """A pair of common words takes less than one word's fingerprint did; weights stay where they are; what the parent's filter
    rules out sends no key."""
    rng = np.random.default_rng(6)
    texts = [" ".join([f"w{k}" for k in rng.zipf(1.3, 400) % 50] + [f"rare{i} rare{i % 7} rare{i}"]) for i in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    every, u = np.full(suffixtree.FILTER_BITS >> 6, ~np.uint64(0)), np.uint64
    h = suffixtree.word_hashes(*suffixtree.text_slices([batch]).__next__()[1:], lower=True)[0]
    words_, counts = np.unique(h, return_counts=True)

    class Shared:
        value = every, every, np.zeros(0, u), words_[counts > 20]

    plain = type("Plain", (), {"value": Shared.value[:3]})
    tables = []
    for shared, common in ((Shared, Shared.value[3]), (plain, np.zeros(0, u))):
        blocks = pa.Table.from_batches(list(suffixtree._pair_counts(shared, 1, 3)([batch])))
        pairs = sum(blocks["size"].to_pylist())
        out = suffixtree._repeated_pairs(blocks, common)
        tables.append((sorted(zip(*(c.to_pylist() for c in out.select(["c", "n", "kinds"]).columns)), key=str), sum(len(b or b"") for name in blocks.schema.names[2:] for b in blocks[name].to_pylist()) / pairs))
    assert tables[0][0] == tables[1][0] and tables[0][1] < 8

    steps = Steps(spark, "test")
    rows = spark.range(100).selectExpr("id % 10 AS part", "id AS k")
    kept = steps.bucketed(iter([rows, rows.where("k < 50")]), "rows", "part")
    both = rows.groupBy("part").cogroup(kept.groupBy("part")).applyInArrow(lambda a, b: pa.table({"part": a["part"][:1], "n": [len(b)]}), "part long, n long")
    assert Counter((r.part, r.n) for r in both.collect()) == Counter((i, 15) for i in range(10))
    with contextlib.redirect_stdout(io.StringIO()) as told:
        both.explain()
    assert told.getvalue().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
    steps.free(kept)

    # No context of one word is kept: none of two has a key, though its filter lets all pass.
    none = np.zeros_like(every)
    vocabulary = suffixtree.Vocabulary(words_, counts, int(counts.sum()), len(words_), 30, 0.1)
    asked = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(texts)], names=["doc_id", "text"])
    for first, sent in ((none, False), (every, True)):
        value = vocabulary, [(first, first), (every, every)], np.zeros(0, u), np.zeros(0)
        run = suffixtree._scored(type("Given", (), {"value": value}), 3)
        got = spark.createDataFrame([(1,)], "x int").mapInArrow(lambda _: (pa.RecordBatch.from_pydict({"n": [sum(map(len, b["keys"].to_pylist()))]}) for b in run([asked])), "n long").collect()
        assert (got[0].n > 0) == sent


@pytest.mark.parametrize("share", [2e-6, 2.0])
def test_suffix_tree_keeps_all_frequent_contexts(spark, monkeypatch, share):
    """Scores equal plain counting, also of words and contexts of less than 4e-4 of all tokens, looked up or joined."""
    monkeypatch.setattr(suffixtree, "COMMON_CONTEXT_SHARE", share)
    texts = [prose(i, 700, 3000) for i in range(250)] + ["rare pair of words " * 2 + f"u{i}" for i in range(20)] + [None, ""]
    texts += [f"k{i % 2} m m m m e{i % 2}" for i in range(80)]
    rows = [(i, t) for i, t in enumerate(["rare pair of words rare", "k1 m m m m e1 m m e0", "Pair of words of rare never", None, texts[0][:900]])]
    rows += [(i, t) for i, t in TEXTS if i is not None and len(t or "") < 3000]
    score, kept = plain_tree(texts)
    assert ("rare",) in kept and ("pair",) in kept and 40 < 4e-4 * sum(len(words(t)) for t in texts)
    learn = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    asked = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixtree.score_documents(asked, learn).collect()
    assert Counter((r.doc_id, round(r.score, 5)) for r in got) == Counter((i, round(score(t), 5)) for i, t in rows)
    if share < 1:
        score, kept = plain_tree(texts, 6)
        assert ("k1", "m", "m", "m", "m") in kept
        got = suffixtree.score_documents(asked, learn, depth=6).collect()
        assert Counter((r.doc_id, round(r.score, 5)) for r in got) == Counter((i, round(score(t), 5)) for i, t in rows)


def test_pair_hash_is_sparks(spark):
    c, x = np.random.default_rng(2).integers(-(1 << 63), (1 << 63) - 1, (2, 50))
    got = spark.createDataFrame([(int(a), int(b)) for a, b in zip(c, x)], "c long, x long").selectExpr("xxhash64(c, x) h").collect()
    assert suffixtree.pair_hash(c.view(np.uint64), x.view(np.uint64)).view(np.int64).tolist() == [r.h for r in got]


def test_quality(spark, docs, empty):
    rows = [(i, prose(i, 60) if i % 3 else prose(i, 20).upper() + "!!! ###" * 9) for i in range(400)]
    d = quality.measure(spark.createDataFrame(rows, "doc_id long, text string"))
    model = quality.train(d, spark.createDataFrame([(i,) for i in range(200) if i % 3], "doc_id long"))
    got = {r.doc_id: r.score for r in quality.score(d, model).collect()}
    assert all((got[i] >= 0.5) == (i % 3 != 0) for i in range(200, 400)) and 0.5 < model.prior < 0.85
    some = quality.score(quality.measure(docs), model).collect()
    assert len(some) == len(TEXTS) and all(0 <= r.score <= 1 for r in some)
    nothing = quality.train(quality.measure(empty), spark.createDataFrame([], "doc_id long"))
    assert nothing.prior == 0.5


def test_quality_on_held_out_labels(spark):
    from leafvoice.llm.registry import QUERIES

    sf = "/root/testdata/sf0.01"
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op1_pu_quality"](spark, sf).collect()
    held = [(r.score, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert sum(g > b for g in good for b in bad) >= 0.97 * len(good) * len(bad)
