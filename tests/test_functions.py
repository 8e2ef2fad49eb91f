import random

import pytest
from pyspark.sql import functions as F

from leafvoice.functions import fixed, measures as M, segmenting as N, text as T
from tests import loops


def run(spark, values, schema, **cols):
    rows = [(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, " + schema).repartition(4)
    return df.select("i", *[c.alias(k) for k, c in cols.items()]).orderBy("i").collect()


def soup(rng, n, words):
    return ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", ""]) for _ in range(rng.randint(0, 40)))
            for _ in range(n)]


def test_repairs_match_loops(spark):
    rng = random.Random(1)
    parts = []
    for w in fixed.LIGATURE_WORDS:
        for lig in fixed.LIGATURES:
            if lig in w:
                h, t = w.split(lig, 1)
                parts += [h, t, t + ".", "(" + h, h.title(), t.upper()]
    parts += ["the", "at", "é", "éle", "x", "rst", "con", "dence", "of", "head-", "tail", "or", "pur-", "suit", "-"]
    parts = [p for p in parts if p]
    texts = soup(rng, 1500, parts) + [" ".join(rng.sample(parts, 2)) for _ in range(1500)]
    got = run(spark, texts, "t string", lig=T.repair_ligatures("t"), hyp=T.repair_hyphenation("t"))
    for t, r in zip(texts, got):
        assert r.lig == loops.fix_ligatures(t), t
        assert r.hyp == loops.fix_hyphens(t), t


REPAIRS = [
    ("She climbed the mast with great con dence.", "confidence"),
    ("a scienti c voyage", "scientific"),
    ("Take the rst ferry after noon.", "first"),
    ("(“Lantern- light on the Quay”)", "Lanternlight"),
    ("gulls in pur- suit of crumbs", "pursuit"),
    ("mate- rial for sail- ors", "material"),
    ("a dif cult moor- ing", "difficult"),
]
KEPT = ["the at roof of the shed", "north- or south-facing", "Harbour- and River-born",
        "the ferry left the quay at six"]


def test_repair_cases(spark):
    got = run(spark, [a for a, _ in REPAIRS] + KEPT, "t string", o=T.repair_text("t"))
    for (src, want), r in zip(REPAIRS, got):
        assert want in r.o
    for src, r in zip(KEPT, got[len(REPAIRS):]):
        assert r.o == src


def test_repair_per_row(spark):
    rows = [("a scienti c voyage", "en"), ("le scienti c voyage", "fr"), ("the rst ferry", None)]
    df = spark.createDataFrame(rows, "t string, lang string")
    got = [r.o for r in df.select(T.clean_for_speech("t", F.col("lang") == "en").alias("o")).collect()]
    assert got == ["a scientific voyage", "le scienti c voyage", "the rst ferry"]


def test_clean(spark):
    cases = {
        "a ```code\nmore``` b": "a b",
        "was \\[ y^2 \\] it": "was it",
        "p \\(q\\) r": "p r",
        "m \\begin{eq}a\nb\\end{eq} n": "m n",
        "cost $5 and $6 now": "cost 6 now",
        "soft\u00adly ─── spoken": "softly spoken",
        "un-\ncertain  end ": "uncertain end",
        "\u00a0\ufeff ": "",
    }
    got = run(spark, list(cases), "t string", o=T.clean_for_speech("t"))
    assert [r.o for r in got] == list(cases.values())


def test_splitters(spark):
    rng = random.Random(2)
    words = ["Dr.", "U.S.", "e.g.", "end.", "End!", "no?", "wait...", '"Quote', "(Par", "x9.S.", "word", "Cap", "a.",
             "4.15", "etc.", "don't.", "well", ",", ";", "—", "Dr.A."]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "B."]) for _ in range(rng.randint(1, 60))) for _ in range(600)]
    got = run(spark, texts, "t string", s=N.split_sentences_simple("t"), a=T.ends_with_abbreviation("t"),
              c=N.enforce_max_length(F.array("t"), 60))
    for t, r in zip(texts, got):
        assert r.s == loops.split_simple(t), t
        assert r.a == loops.abbreviated(t), t
        assert r.c == loops.cap(t, 60), t


def test_unicode_splitter(spark):
    cases = {
        'He saw Mr. Ellis. "You know," she said. Then he left.':
            ["He saw Mr. Ellis.", '"You know," she said.', "Then he left."],
        "It cost 4.15 then. Really?! Yes": ["It cost 4.15 then.", "Really?!", "Yes"],
        "once, e.g. in March and later. Done": ["once, e.g. in March and later.", "Done"],
        "Élan is here. Étienne too.": ["Élan is here.", "Étienne too."],
    }
    got = run(spark, list(cases), "t string", o=N.split_sentences("t"))
    assert [r.o for r in got] == list(cases.values())


def test_word_offsets(spark):
    rng = random.Random(3)
    cases = [("".join(rng.choice(["ab", "c", " ", "  ", "\n", "déf"]) for _ in range(rng.randint(0, 12))), rng.randint(-2, 25))
             for _ in range(500)]
    got = run(spark, cases, "t string, n int", w=T.word_index_at_char("t", "n"), c=T.char_index_of_word("t", "n"),
              g=T.split_keeping_gaps("t"), k=T.word_count("t"))
    for (t, n), r in zip(cases, got):
        assert r.w == loops.word_at(t, n), (t, n)
        assert r.c == loops.start_of_word(t, n), (t, n)
        assert "".join(g.text for g in r.g) == t and [g.text for g in r.g if g.is_word] == t.split()
        assert r.k == max(1, len(t.split()))


def test_letters_are_all_but_blanks(spark):
    rows = spark.range(1, 0x30000).where("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    one = lambda cls: F.col("c").rlike(f"^{cls}\\z")
    got = rows.agg(F.count_if(one(T.NWS) != one(T.LETTER)).alias("other"), F.count_if(~one(T.LETTER)).alias("blanks")).first()
    assert got.other == 0 and got.blanks == len(T.BLANK_CHARS)


def test_words_are_found_without_asking_each_letter_for_all_blanks(spark):
    """The word functions against a negated class of all blanks, which each letter is held against as a whole."""
    import time

    df = spark.createDataFrame([("The quiet harbour lay under a low grey sky until noon. " * 40,)] * 500, "t string").repartition(2).cache()
    df.count()

    def seconds(*cols):
        def once():
            start = time.time()
            df.select(*cols).write.format("noop").mode("overwrite").save()
            return time.time() - start

        return min(once() for _ in range(4))

    pieces = F.regexp_extract_all("t", F.lit(f"({T.NWS}+|{T.WS}+)"), F.lit(1))
    old = seconds(F.regexp_count("t", F.lit(f"{T.NWS}+")), F.transform(pieces, lambda p: F.struct(p, p.rlike(f"^{T.NWS}"))))
    assert seconds(T.word_index_at_char("t", F.lit(900)), T.split_keeping_gaps("t")) < 0.8 * old


def test_labels(spark):
    titles = ["", "The Long Quiet", "Ünïcode", "emoji 😀 title", "z" * 300]
    got = run(spark, titles, "t string", h=T.title_hash_bucket("t"), ini=T.title_initial("t"))
    assert [r.h for r in got] == [loops.hue(t) for t in titles]
    assert [r.ini for r in got] == ["?", "T", "Ü", "E", "Z"]
    secs = [0.0, 59.4, 59.7, 61.0, 3599.0, 3661.5, -3.0]
    got = run(spark, secs, "s double", t=T.fmt_time("s"), m=T.fmt_mins("s"))
    assert [r.t for r in got] == ["0:00", "0:59", "0:59", "1:01", "59:59", "1:01:01", "0:00"]
    assert [r.m for r in got] == ["0s", "59s", "60s", "1m", "1h 0m", "1h 1m", "-3s"]
    ids = ["ch_1", "ch_12", "x", "", "0"]
    assert [r.o for r in run(spark, ids, "t string", o=T.chapter_index_from_id("t"))] == [0, 11, 0, 0, 0]
    names = ["Microsoft Aria - English", "Google UK English Female", None]
    assert [r.o for r in run(spark, [(n,) for n in names], "t string", o=T.voice_label("t"))] == [
        "Aria", "UK English Female", "Voice"]


def test_measures(spark):
    r = run(spark, ["hello world!!!"], "t string", a=M.est_sentence_seconds("t"), d=M.duration_seconds("t", 2.0),
            z=M.position_seconds(5, 0.0), s=M.seek_char(0.25, 1.0, "t"), p=M.progress_pct(1, 4), q=M.progress_pct(1, 0),
            b=M.size_bucket(F.lit(11.3)), c=M.clamp_rate(20.0))[0]
    assert (r.a, r.d, r.z, r.s, r.p, r.q, r.b, r.c) == (1.0, 0.5, 0.0, 4, 25.0, 0.0, 11.5, 10.0)


@pytest.mark.parametrize("text,drop", [("12", True), ("iv", True), ("Did", True), ("mild", True), ("12345", False), ("a1", False)])
def test_page_numbers(spark, text, drop):
    assert run(spark, [text], "t string", o=T.is_page_number("t"))[0].o is drop


def test_sentences_of_all_scripts(spark):
    """Against the rules one by one, on texts in several scripts and with marks and closers in odd places."""
    rng = random.Random(12)
    latin = ["The", "end", "a", "É", "Dr", "3", "U", "x́", "ª", "Ⅷ"]
    scripts = [latin, ["漢字", "かな", "カナ", "3"], ["नमस्ते", "हिन्दी"], ["مرحبا", "سلام", "٣"], ["Привет", "мир"], ["Բարեւ", "աշխարհ"], ["မြန်မာ"], ["ሰላም"], latin + ["漢", "ǅ"]]
    marks = [".", ". ", "!", "?! ", "...", "。", "！", "।", "॥ ", "؟", "۔ ", "։", "။", "።", "．", "‼", ".‍", "!́", "․ ", "｡"]
    between = [" ", " ", " ", "", ", ", "、", "：", "; ", " (", ") ", "”", "’ ", "「", "」", "\" ", "' ", "–", "،", "#", " & "]
    texts = []
    for _ in range(1500):
        words = rng.choice(scripts)
        t = "".join(rng.choice(words) + (rng.choice(marks) if rng.random() < 0.5 else "") + rng.choice(between) for _ in range(rng.randint(1, 9)))
        texts.append(" ".join(t.split()))
    for t, r in zip(texts, run(spark, texts, "t string", s=N.segment_sentences("t"))):
        cuts = [0, *loops.sentence_ends(t), len(t)]
        want = [p for p in (t[a:b].strip() for a, b in zip(cuts, cuts[1:])) if p]
        assert r.s == want, (t, r.s, want)


def test_long_runs_of_marks(spark):
    """Dot leaders and the like take a time in proportion to their length."""
    import time

    texts = ["." * 200_000 + " a", "!" * 200_000, "a." * 50_000, ") " * 50_000 + "." + ")" * 50_000 + " x", "…" * 1000]
    begin = time.time()
    run(spark, texts, "t string", s=F.size(N.segment_sentences("t")))
    assert time.time() - begin < 20


def test_quick_tests_leave_the_patterns_results(spark):
    """The range that tells ordinary letters first changes no match, whatever blanks and marks stand around."""
    import random

    from leafvoice.functions import fixed

    rng = random.Random(5)
    bits = ["con dence", "rst", "rst,", "“rst”", "é", "nal", " ", "﻿", "　", " ", " ", "  ", "\n", "\t", "(", "x", "of ce", "$a$", "$", "\\(b\\)", "\\[", "\\]", "­"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(400)] + [(400, None)]
    df = spark.createDataFrame(rows, "i int, text string")
    plain = lambda f: lambda c: F.regexp_replace(c, f, " ")
    shell, nws, ws = T._SHELL, T.NWS, T.WS
    marked = lambda c: F.regexp_replace(c, f"(?i)(?<!{nws})({shell})(?={T._all(T._TAILS)}(?![A-Za-z]){shell}(?!{nws}))", f"$1{T.FRAGMENT}")
    out = df.select(
        F.trim(plain(f" *[{T.BLANKS}&&[^ ]]{ws}*| {{2,}}{ws}*")("text")).alias("w0"), T.collapse_whitespace("text").alias("w1"),
        plain(fixed.LATEX_INLINE)(plain(fixed.LATEX_BLOCK)("text")).alias("l0"), T.strip_latex("text").alias("l1"),
        (F.regexp_count(marked("text"), F.lit(T.FRAGMENT)) > 0).alias("m0"), (F.regexp_replace("text", " {2,}", " ") != T.repair_ligature_initials("text")).alias("m1"),
    ).collect()
    assert all((r.w0, r.l0, r.m0) == (r.w1, r.l1, r.m1) for r in out) and any(r.m0 for r in out) and out[400].l1 is None
