import random

import numpy as np
import pytest
from conftest import rows

from tidemesh.llm import endings, leakage, mixing, tokens, truncation

WORDS = "amber basin cedar delta ember fjord grove heath inlet jetty knoll ledge marsh north ochre plain quartz ridge shoal thicket upland valley weir yonder zenith".split()


def item(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, score int")


def leaks(spark, *texts, items=2):
    it = spark.createDataFrame([(100 + k, item(k), 1) for k in range(items)] + [(900, None, 1), (901, "", 1), (902, "only nine words here to find as a whole", 1)], "item_id long, text string, matched int")
    return rows(leakage.leaked_items(docs(spark, *texts), it), "doc_id", "item_id")


def test_passages_in_any_layout_with_changes(spark):
    a = item(0).split()
    quoted = "+> " + "\n+> ".join(" ".join(a[k : k + 7]) for k in range(5, 29, 7))
    changed = a[10:34].copy()
    for k in (6, 12, 18):
        changed[k] = "other"
    four = a[10:34].copy()
    for k in (4, 9, 14, 19):
        four[k] = "other"
    dropped = a[10:19] + a[20:42]
    texts = [item(0).upper().replace(" ", ", "), quoted, "x " + " ".join(changed) + " y", " ".join(four), " ".join(a[3:26]), "// " + " ".join(dropped), None, "", "only nine words, here to find as a whole!", item(1) + " filler " * 3000 + item(0)]
    assert leaks(spark, *texts) == [(0, 100), (1, 100), (2, 100), (5, 100), (8, 902), (9, 100), (9, 101)]


def test_leaks_of_nothing_and_of_every_item(spark):
    it = spark.createDataFrame([(100 + k, item(k)) for k in range(5)], "item_id long, text string")
    d = docs(spark, *[item(k) for k in range(5)])
    assert rows(leakage.leaked_items(d, it), "doc_id", "item_id") == [(k, 100 + k) for k in range(5)]
    assert rows(leakage.leaked_items(d, it.limit(0))) == [] and rows(leakage.leaked_items(d.limit(0), it)) == []


def test_passages_that_many_items_share(spark):
    form = item(50, 30)
    it = spark.createDataFrame([(k, item(0)) for k in range(20)] + [(100 + k, f"{form} {item(200 + k, 10)}") for k in range(20)], "item_id long, text string")
    d = docs(spark, item(0), "x " + form + " y", " ".join(form.split()[:23]))
    want = [(0, k) for k in range(20)] + [(1, 100 + k) for k in range(20)]
    assert rows(leakage.leaked_items(d, it), "doc_id", "item_id") == want == rows(leakage.leaked_items(d.repartition(3), it.repartition(5), most_bits=1 << 15), "doc_id", "item_id")


def test_every_passage_of_a_pair_is_tried(spark):
    a = item(0).split()
    bad, good = a[:40], a[10:34]
    for k in range(3, 40, 6):
        bad[k] = "other"
    for k in (6, 12, 18):
        good[k] = "other"
    far = " ".join(bad) + " filler" * 400 + " " + " ".join(good)
    near = " ".join(bad) + " filler " + " ".join(good)
    late = " ".join([*a[10:32], "other", a[33], "end"])  # 22 words, one changed, one more
    assert leaks(spark, " ".join(bad), far, near, late, " ".join([*a[10:31], "other", "other", "other", "end"])) == [(1, 100), (2, 100), (3, 100)]


def test_long_items_and_texts_of_one_word_over_and_over(spark):
    long = [f"{w}{k}" for k, w in enumerate(item(7, 900).split())]
    it = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(["same"] * 80)), (3, " ".join(["same"] * 80))], "item_id long, text string")
    d = docs(spark, " ".join(long[250:274]), " ".join(long[876:]), "x " * 5000 + " ".join(long), "same " * 300_000, " ".join(long[500:523]), "same " * 23)
    assert rows(leakage.leaked_items(d, it), "doc_id", "item_id") == [(0, 1), (1, 1), (2, 1), (3, 2), (3, 3)]
    twice = d.unionByName(d)
    assert rows(leakage.leaked_items(twice, it), "doc_id", "item_id") == [(0, 1), (1, 1), (2, 1), (3, 2), (3, 3)]


def test_long_passages_with_even_changes_and_short_items(spark):
    even = item(0).split()[10:42]
    for k in (8, 13, 18, 23):
        even[k] = "other"
    short = {1: "amber", 3: "one two three", 8: "a b c d e f g h", 9: "k l m n o p q r s"}
    it = spark.createDataFrame([(100, item(0)), *short.items()], "item_id long, text string")
    d = docs(spark, " ".join(even), "x amber y", "one two three", "one two x three", "z a b c x e f g h z", "a x c d e f g h", "k l m n x p q r s", "k l m n o p q s", "a b c x e x g h", "k l m n x y p q s", "a b c d x e f g h", "one two")
    assert rows(leakage.leaked_items(d, it), "doc_id", "item_id", "errors") == [(0, 100, 4), (1, 1, 0), (2, 3, 0), (4, 8, 1), (5, 8, 1), (6, 9, 1), (7, 9, 1), (10, 8, 1)]


def test_alignment_score_and_path():
    a, b = np.array([1, 2, 3, 4, 5]), np.array([9, 1, 2, 4, 5, 8])
    score, path, _ = leakage.align(a, b)
    assert score == 2 and path.count(0) >= 2
    assert leakage.align(a, np.array([7, 7]))[0] == 0
    assert leakage.passage([0] * 10 + [1] + [0] * 15, 24, 8, 60) == (26, 1) and leakage.passage([0] * 23, 24, 8, 60) is None and leakage.passage([0] * 9, 24, 8, 9) == (9, 0)


HUNK = "diff --git a/x.py b/x.py\nindex 1..2 100644\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n a = 1\n+b = 2\n c = 3"


@pytest.mark.parametrize(
    "text, want",
    [
        ("Fix the reader", "complete"), ("Fix the reader\n\nIt failed on empty scans.", "complete"), ("Fix the reader\n\nIt failed on empty sc", "sentence"), ("Fix the reader\n\nIt failed on empty scans ...", "sentence"),
        ("more work...", "complete"), ("Fix it\n\nIt failed.\n\nSigned-off-by: A B <a.b@c.invalid>", "complete"), ("Fix it\n\nIt failed.\n\nSigned-off-by: A B <a.b@c", "word"), ("Fix it\n\nCloses #12", "complete"),
        ("Merge branch 'fix/reader' into release", "complete"), ("Merge branch 'fix/rea", "word"), ("Merge pull request #3 from a/b\n\nfix the reader", "complete"), ("Merge branch 'a'\n\n# Conflicts:\n#\tlib/a/b.py", "complete"),
        ("Fix it\n\n" + HUNK + "\n", "complete"), ("Fix it\n\n" + HUNK, "open"), ("Fix it\n\n" + HUNK[:-6], "hunk"), ("Fix it\n\n" + HUNK[:-6] + "...", "hunk"), ("Fix it\n\n" + HUNK.replace("\n", "\r\n") + "\r\n", "complete"), ("Fix it\n\n" + HUNK[:30], "hunk"),
        ("Fix it\n\n" + HUNK + "\n-- \n2.30.1", "complete"), ("Fix it\n\n" + HUNK + "\n\\ No newline at end of file", "complete"), ("commit 4cd172ed67b85146e8b1bf3a826d66772ec8bf7f\nAuthor: A B\nDate:  2019", "word"), ("", "complete"), (None, "complete"), (" \n\t", "complete"),
    ],
)
def test_endings(text, want):
    assert endings.ending(text) == want


def test_cut_words_limits_rates_and_copies(spark):
    rng = random.Random(3)
    text = lambda n: "Fix\n\n" + " ".join(rng.choice(WORDS) for _ in range(n)) + "."
    whole = [text(rng.randint(5, 60)) for _ in range(120)]
    cut = [text(80)[:200] for _ in range(30)]
    rows_ = [(i, "Mail-Box " if i % 2 else "mail_box", t) for i, t in enumerate(whole)] + [(1000 + i, "short", t) for i, t in enumerate(cut)]
    rows_ += [(2000, "short", "Rework the thick"), (2001, "short", "Rework the thick"), (2002, None, "Rework the thicket"), (2003, None, None), (2004, "mail_box", "")]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows_], "doc_id long, source string, text string, verdict string, posterior double")
    judged = truncation.judge_endings(df)
    got = {r.doc_id: (r.cut, r.evidence) for r in judged.collect()}
    assert len(got) == len(rows_)
    assert not any(got[i][0] for i in range(120)) and sum(got[1000 + i][0] for i in range(30)) >= 29
    assert got[2000] == got[2001] == (True, "word") and not got[2002][0] and not got[2003][0] and not got[2004][0]
    rates = {r.source: (r.documents, r.cut_documents) for r in truncation.cut_rates(judged).collect()}
    assert rates["mail_box"] == (121, 0) and rates[None] == (2, 0) and rates["short"][0] == 32
    assert rows(truncation.judge_endings(df.limit(0))) == []


def test_endings_and_lengths_decide_together():
    base = [("complete", "stop", None, 0.0, 0, 5000), ("complete", "letter", None, 0.0, -2, 800), ("hunk", "letter", None, 0.0, 4, 60), ("hunk", "letter", "a", 0.95, 4, 100), ("sentence", "letter", "a", 0.95, -2, 40), ("sentence", "letter", None, 0.0, -2, 20)]
    rate, odds, shares = truncation.evidence_odds(base)
    assert 0.005 < rate < 0.03 and odds["sentence", "letter"] > 50 and odds["complete", "stop"] < 0.1 and shares["a"] > 0.95
    # a heap of whole texts of one length is no limit, however sure the length law is of it
    heap = truncation.evidence_odds([*base, ("complete", "stop", "b", 0.9, 0, 300)])[2]
    assert heap["b"] < 0.2 and heap["a"] > 0.95


def test_words_lean_to_a_cut_or_an_end(spark):
    text = "the thicket and the thin reed " * 40
    rows_ = [(0, "s", text + "the thick"), (1, "s", text + "the thicket"), (2, "s", text + "and the"), (3, "s", "x" * 3000 + " " + "y" * 200)]
    df = spark.createDataFrame(rows_, "doc_id long, source string, text string")
    seen = df.select("doc_id", "source", "text").mapInArrow(truncation._scan, truncation._SCAN).cache()
    lean = dict(rows(truncation._word_odds(seen, seen.filter("verdict is not null"))))
    assert lean["thick"] >= 3 and lean["thicket"] <= 0 and lean["the"] <= 0 and set(lean) == {"thick", "thicket", "the"}


def test_change_ids_and_lists_are_endings(spark):
    assert endings.ending("Fix it\n\nIt failed.\n\nChange-Id: I7bcd4c7a1334") == "complete"
    assert [endings.tail(t) for t in ("a\n", "a.", "a b", "a 3", "a ...", "a)", "", None)] == ["newline", "stop", "letter", "digit", "dots", "other", "other", "other"]


def test_censored_fit_recovers_the_law_and_the_limit():
    rng = np.random.default_rng(5)
    x = np.minimum(np.exp(rng.normal(5.5, 0.8, 20_000)).astype(int) + 1, 400)
    length, count = np.unique(x, return_counts=True)
    limits, posterior, mu, sigma = truncation.censored_lognormal(length, count)
    assert limits.tolist() == [400] and posterior[0] > 0.95 and mu == pytest.approx(5.5, abs=0.05) and sigma == pytest.approx(0.8, abs=0.05)
    assert len(truncation.censored_lognormal(np.array([3]), np.array([2]))[0]) == 0


def test_token_counts_equal_the_tokenizer(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokens.TOKENIZER, "rb"))}
    e = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "a", "it's  a\t\ttest\n\n\n  of  'll", "größer ½ ²³ 日本語", "x\x1cy \x1f z", "  ", "a" * 3000, "foo_bar(12345, \"q\")\r\n"]
    count = tokens.counter()
    assert [count(t) for t in texts] == [len(e.encode_ordinary(t)) for t in texts]
    assert [count(t) for t in texts] == [len(e.encode_ordinary(t)) for t in texts]


def test_flight_keeps_both_totals():
    r = random.Random(1)
    size = [float(r.randint(1, 500)) for _ in range(700)]
    p = mixing.flight(size, [0.3] * 700, random.Random(2))
    left = [v for v in p if 0 < v < 1]
    assert len(left) <= 2 and sum(p) == pytest.approx(210) and sum(a * b for a, b in zip(size, p)) == pytest.approx(0.3 * sum(size))
    landed = mixing.flight(size, p, random.Random(3), land=True)
    assert set(landed) == {0.0, 1.0}
    mean = sum(mixing.flight([1.0, 2.0, 4.0, 8.0], [0.25] * 4, random.Random(k), land=True)[0] for k in range(4000)) / 4000
    assert mean == pytest.approx(0.25, abs=0.03)


def test_mix_reaches_shares_within_repeats(spark, monkeypatch):
    rng = random.Random(4)
    rows_ = [(i, rng.choice(("Big-One", "big_one", " BIG_ONE ")) if i < 600 else "small", " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 80)))) for i in range(660)]
    rows_ += [(1000, None, "no source"), (1001, "big_one", None), (1002, "small", ""), (1003, "other", "no target")]
    df = spark.createDataFrame([(*r, 5) for r in rows_], "doc_id long, source string, text string, n_tokens int")
    goal = spark.createDataFrame([("big_one", 3.0, 1), ("small", 1.0, 3), ("gone", 1.0, 2), ("none", None, 1), ("small", 1.0, 3)], "source string, target_share double, max_repeats int")
    for chunk in (mixing.FLIGHT, 50):
        monkeypatch.setattr(mixing, "FLIGHT", chunk)
        mixed, report = mixing.mix(df, goal)
        m, r = mixed.collect(), {x.source: x for x in report.collect()}
        assert len({x.doc_id for x in m}) == len(m) and all(1 <= x.copies <= (1 if x.source == "big_one" else 3) for x in m)
        assert not {x.doc_id for x in m} & {1000, 1001, 1002, 1003} and set(r) == {"big_one", "small", "gone"}
        assert r["big_one"].reached_share == pytest.approx(0.75, abs=0.01) and r["small"].reached_share == pytest.approx(0.25, abs=0.01) and r["gone"].reached_share == 0
        assert r["big_one"].target_share == 0.6 and r["small"].copies == sum(x.copies for x in m if x.source == "small")
    few, report = mixing.mix(df, goal, total_tokens=2000)
    assert sum(x.n_tokens * x.copies for x in few.collect()) == pytest.approx(2000, rel=0.06)
    assert mixing.mix(df.limit(0), goal)[0].count() == 0 and mixing.mix(df, goal.limit(0))[0].count() == 0
